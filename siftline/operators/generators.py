"""Hash-drawn seed rows and reversible renames of a column (G2, G8, G12, G13): every value from a hash of id and name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PATTERNS = ("single", "parallel", "multi_turn", "error_recovery")
DOMAINS = 20
SCHEMAS = 197
TYPES = ("string", "integer", "number", "boolean")


def drawn(seed: str, key: Column, name: str, n: int) -> Column:
    """A number below n that depends on the seed, the key and the name alone."""
    h = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit(name), key.cast("string"))), 1, 8)
    return F.pmod(F.conv(h, 16, 10).cast("long"), F.lit(n))


def picked(options: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (index + 1).cast("int"))


def seeds(spark: SparkSession, n: int, seed: str = "g") -> DataFrame:
    """One row a seed: pattern by id, schema, domain, tool name, 2-4 typed properties."""
    i = F.col("id")
    rows = spark.range(n).select(
        i, picked(PATTERNS, i % 4).alias("pattern"), drawn(seed, i, "schema", SCHEMAS).alias("schema_no"), drawn(seed, i, "domain", DOMAINS).alias("domain"), (drawn(seed, i, "props", 3) + 2).alias("n_props"),
    )
    props = F.transform(F.sequence(F.lit(1), F.col("n_props")), lambda k: picked(TYPES, F.pmod(F.col("schema_no") + k, F.lit(4))))
    return rows.withColumns({"tool": F.format_string("d%02d_tool_%03d", "domain", "schema_no"), "types": props})


def receipt(call: Column) -> Column:
    """The mock executor's receipt of a canonical call."""
    return F.concat(F.lit("mock-"), F.substring(F.sha2(call, 256), 1, 12))


def executed(call: Column, stage: Column, pattern: Column) -> Column:
    """A receipt, or UNAVAILABLE in the first stage of an error_recovery pattern."""
    down = (pattern == "error_recovery") & (stage == 0)
    return F.struct((~down).alias("ok"), F.when(~down, receipt(call)).alias("receipt"), F.when(down, F.lit("UNAVAILABLE")).alias("code"))


def name_map(names: DataFrame, column: str, seed: str, prefix: str = "fn_") -> DataFrame:
    """(name, mock): a bijection; ranks of the hash order make the mock names distinct."""
    from siftline.operators.selection import positions

    d = names.select(F.col(column).alias("name")).where("name is not null").distinct()
    h = d.withColumn("h", F.concat(F.md5(F.concat(F.lit(seed), F.col("name"))), F.col("name")))
    return positions(h, "h").select("name", F.concat(F.lit(prefix), F.lpad(F.col("position").cast("string"), 8, "0")).alias("mock"))


def renamed(df: DataFrame, column: str, mapping: DataFrame, back: bool = False) -> DataFrame:
    """The column through the map, or back; a name the map lacks raises when read."""
    old, new = ("mock", "name") if back else ("name", "mock")
    m = mapping.select(F.col(old).alias("__old"), F.col(new).alias("__new"))
    j = df.join(m, df[column] == m["__old"], "left")
    value = F.when(F.col(column).isNull(), None).when(F.col("__new").isNull(), F.raise_error(F.concat(F.lit("unknown name "), F.col(column)))).otherwise(F.col("__new"))
    return j.withColumn(column, value).drop("__old", "__new")
