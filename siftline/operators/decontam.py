"""N-gram decontamination (P4-P9, F1-F5, J1, W3): index, boilerplate rule, hits, longest run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions import jsons as J
from siftline.functions import text as T
from siftline.functions.grams import DIGEST, gram_rows, jaccard, matches, part_pairs, part_rows
from siftline.session import scratch

N, MAX_DF, MIN_HITS, MIN_RUN = 8, 2, 2, 6


def leaf_texts(df: DataFrame, key: str, record: str) -> DataFrame:
    """(key, leaf, text): every string of a JSON record, in order; grams never cross leaves."""
    return df.select(key, F.posexplode_outer(J.leaves_udf(F.col(record))).alias("leaf", "text")).where("text is not null")


def eval_index(sets: dict[str, DataFrame], max_df: int = MAX_DF, n: int = N, text: str = "text") -> DataFrame:
    """(g1, g2, gram, mask, df): grams of each set whose row frequency is at most ``max_df`` (0: all), sets as bits."""
    if not sets:
        raise ValueError("no evaluation set is available")
    parts = None
    for bit, (_, df) in enumerate(sets.items()):
        g = gram_rows(df, [], text, "words", n, shown=True).groupBy(*DIGEST).agg(F.any_value("gram").alias("gram"), F.count("*").alias("df"))
        g = (g.where(F.col("df") <= max_df) if max_df else g).select(*DIGEST, "gram", F.lit(1 << bit).alias("bit"), "df")
        parts = g if parts is None else parts.unionByName(g)
    return parts.groupBy(*DIGEST).agg(F.any_value("gram").alias("gram"), F.bit_or("bit").alias("mask"), F.max("df").alias("df"))


def set_names(mask: Column, sets: list[str]) -> Column:
    """The sets of a mask, in order."""
    return F.array_compact(F.array(*(F.when(mask.bitwiseAND(1 << i) != 0, F.lit(s)) for i, s in enumerate(sets))))


def hits(df: DataFrame, index: DataFrame, sets: list[str], key: str, text: str = "text", n: int = N) -> DataFrame:
    """(key, eval_set, n_hits): distinct matched grams of each row and set."""
    met = matches(df, [key], text, "words", n, index)
    return met.select(key, F.explode(set_names(F.col("mask"), sets)).alias("eval_set")).groupBy(key, "eval_set").agg(F.count("*").alias("n_hits"))


def contaminated(df: DataFrame, index: DataFrame, sets: list[str], key: str, text: str = "text", min_hits: int = MIN_HITS) -> DataFrame:
    """Rows to remove: (key, eval_sets in the order of ``sets``, n_hits of the strongest set)."""
    met = hits(df, index, sets, key, text).where(F.col("n_hits") >= min_hits)
    order = F.transform(F.array(*map(F.lit, sets)), lambda s: F.when(F.array_contains(F.col("found"), s), s))
    out = met.groupBy(key).agg(F.collect_set("eval_set").alias("found"), F.max("n_hits").alias("n_hits"))
    return out.select(key, F.array_join(F.array_compact(order), ",").alias("eval_sets"), "n_hits")


def split(df: DataFrame, removed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """K6, K7: the kept rows, and the removal log."""
    return df.join(removed.select(key), key, "left_anti"), removed


def longest_run(leaves: DataFrame, index: DataFrame, sets: list[str], key: str, text: str = "text", n: int = N, min_run: int = MIN_RUN, skip: tuple[str, ...] = ()) -> DataFrame:
    """(key, run, leaf, start, eval_sets, window, removed) from (key, leaf, text): the longest run of consecutive matched positions.

    The first of equally long runs counts. ``eval_sets`` are those that any gram of it is from,
    ``skip`` sets match nothing; ``window`` is the run's tokens, at most 200 characters. Gaps and
    islands over matched positions only: what doesn't match never leaves the scan.
    """
    asked = sum(1 << i for i, s in enumerate(sets) if s not in skip)
    probe = index.select(*DIGEST, F.col("mask").bitwiseAND(asked).alias("mask")).where("mask <> 0")
    met = matches(leaves, [key, "leaf"], text, "words", n, probe, distinct=False)
    island = F.col("pos") - F.row_number().over(Window.partitionBy(key, "leaf").orderBy("pos"))
    runs = met.withColumn("island", island).groupBy(key, "leaf", "island").agg(F.count("*").alias("run"), F.min("pos").alias("start"), F.bit_or("mask").alias("mask"))
    best = runs.groupBy(key).agg(F.min(F.struct((-F.col("run")).alias("run"), "leaf", "start", "mask")).alias("b"))
    best = best.select(key, (-F.col("b.run")).alias("run"), "b.leaf", "b.start", "b.mask")
    rows = leaves.select(key, "leaf", F.col(text).alias("text")).join(best, [key, "leaf"]).withColumn("t", T.normalize_tokens(F.col("text")))
    shown = F.substring(F.array_join(F.slice("t", F.col("start") + 1, (F.col("run") + n - 1).cast("int")), " "), 1, 200)
    return rows.select(key, "run", "leaf", "start", F.array_join(set_names(F.col("mask"), sets), ",").alias("eval_sets"), shown.alias("window"), (F.col("run") >= min_run).alias("removed"))


def first_gram_hit(df: DataFrame, protected: DataFrame, key: str, cut: str, text: str = "text", n: int = N) -> DataFrame:
    """(key, n_shared) of rows that share any gram with the protected texts; one hit is enough.

    ``cut``: ``ascii`` words or ``letters`` without separators.
    """
    index = gram_rows(protected, [], text, cut, n).select(*DIGEST).distinct().withColumn("mask", F.lit(1))
    return matches(df, [key], text, cut, n, index).groupBy(key).agg(F.count("*").alias("n_shared"))


def near_pairs(df: DataFrame, key: str, form: Column, n: int, threshold: float) -> DataFrame:
    """(a, b, jaccard) with a < b: an exact set-similarity self-join of character n-grams.

    Texts of one form are one class: its smallest key stands for it in the join, and every
    other member is paired with that key alone, so copies never meet each other. Classes
    meet under the keys of :func:`siftline.functions.grams.part_keys`, of which two sets of
    the threshold's similarity share one; their texts are fetched and compared then. No gram
    is ever a row, so a common one has no price. Rows without a key are left out.
    """
    spark = df.sparkSession
    own = df.select(F.col(key).alias("id"), form.alias("form")).where("id is not null and form is not null")
    own = own.withColumn("class", F.substring(F.unhex(F.sha2("form", 256)), 1, 16))
    first = own.groupBy("class").agg(F.min(F.struct("id", "form")).alias("r")).select("class", F.col("r.id").alias("rep"), F.col("r.form").alias("form"))
    first, path = first.withColumn("num", F.monotonically_increasing_id()), scratch(spark)
    first.write.parquet(path)
    classes = spark.read.schema(first.schema).parquet(path)
    members = own.select("id", "class").join(classes.select("class", "rep"), "class").where("id != rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("jaccard"))
    met = part_pairs(part_rows(classes, "num", "form", n, threshold), "num", threshold)
    side = lambda place, c: classes.select(F.col("num").alias(place), F.col("rep").alias(c), F.col("form").alias(f"form_{c}"))
    full = met.join(side("x", "a"), "x").join(side("y", "b"), "y")
    near = jaccard(full, ["a", "b"], "form_a", "form_b", n).where(F.col("jaccard") >= threshold)
    near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.round("jaccard", 6).alias("jaccard"))
    return near.unionByName(members)
