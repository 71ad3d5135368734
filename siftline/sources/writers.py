"""Sinks and ledgers (K1-K15): Spark's own commit protocol, refusals before a job, assertions after."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_json(spark: SparkSession, path: str, value: object, replace: bool = True) -> None:
    """K1, K3: one JSON document, written beside and renamed; without ``replace`` an existing one raises."""
    fs, p = _path(spark, path)
    if fs.exists(p) and not replace:
        raise FileExistsError(path)
    write_bytes(spark, path, json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2).encode())


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file, written beside and renamed."""
    fs, p = _path(spark, path)
    tmp = p.suffix(".tmp")
    out = fs.create(tmp, True)
    out.write(bytearray(content))
    out.close()
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(tmp, p):
        raise OSError(f"could not rename {tmp} to {path}")


def refuse_non_empty(spark: SparkSession, path: str) -> None:
    """K9: an output folder with anything in it raises."""
    fs, p = _path(spark, path)
    if fs.exists(p) and len(fs.listStatus(p)):
        raise FileExistsError(f"{path} is not empty")


def write_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line, null fields left out; an existing path raises."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("errorifexists").text(path)


def split_write(df: DataFrame, flag: str, kept: str, log: str, key: list[str]) -> dict[str, int]:
    """K5-K7: rows without a flag to ``kept`` as parquet, a removal log of the others as lines; returns counts."""
    df.where(~F.col(flag)).drop(flag).write.mode("errorifexists").option("compression", "zstd").parquet(kept)
    digest = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias("row_sha256")
    write_lines(df.where(flag).select(*key, digest), log)
    n = df.groupBy(flag).count().collect()  # two rows
    by = {bool(r[0]): r["count"] for r in n}
    return {"in": sum(by.values()), "kept": by.get(False, 0), "removed": by.get(True, 0)}


def append_ledger(new: DataFrame, ledger: DataFrame | None, members: DataFrame, path: str, key: str, rubric: str) -> int:
    """All or nothing: right rubric, members of the batch, no id twice or told before."""
    ok = F.col("verdict").isin("accept", "reject", "borderline") & (F.length("reason").between(1, 160)) & ~F.col("reason").contains("\n") & (F.col("rubric_sha") == rubric)
    bad = new.where(~F.coalesce(ok, F.lit(False))).limit(1).count()
    bad += new.groupBy(key).count().where("count > 1").limit(1).count()
    bad += new.join(members, key, "left_anti").limit(1).count()
    if ledger is not None:
        bad += new.join(ledger, key, "left_semi").limit(1).count()
    if bad:
        raise ValueError("the decisions break a rule of the ledger; nothing was appended")
    new.write.mode("append").parquet(path)
    return new.count()


def markdown(rows: DataFrame, title: str) -> str:
    """K8: a small aggregate as a table; the caller passes a report, not a corpus."""
    names = rows.columns
    lines = [f"# {title}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows.collect()]) + "\n"


def frozen_subset(df: DataFrame, order: list[str], seed: str, key: str, n: int) -> DataFrame:
    """The first n rows of a seeded order over the sorted set."""
    from siftline.operators.common import hash_order

    return df.orderBy(hash_order(seed, F.col(key)), *order).limit(n)


def flushed_items(items: DataFrame, key: str = "id") -> DataFrame:
    """Items by id, null ids last."""
    return items.orderBy(F.col(key).asc_nulls_last())
