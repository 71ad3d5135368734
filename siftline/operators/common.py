"""What operators share: checked broadcasts and deterministic order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows up to which a build side is broadcast; beyond it Spark shuffles both sides.
BROADCAST_ROWS = 200_000
#: Most ranges that keys are cut into.
RANGES = 256


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The frame with a broadcast hint if a count of at most ``rows + 1`` rows proves it small.

    The counted rows are kept, so a small side is computed once.
    """
    head = df.limit(rows + 1).persist()
    if head.count() <= rows:
        return F.broadcast(head)
    head.unpersist()
    return df


def hash_order(seed: str, key: Column) -> Column:
    """A sort key both engines share: md5 of seed and id as text."""
    return F.md5(F.concat(F.lit(seed), F.lit(":"), key.cast("string")))


def ranges(df: DataFrame, key: str) -> Column:
    """The number of a row's range of keys, in key order, nulls last.

    The bounds are taken once and stand in the expression, so every read of the rows gives
    the same ranges. Those of ``repartitionByRange`` are drawn anew by each plan, and partitions
    are coalesced by its columns, so two reads may number them differently. Which bounds
    are taken decides only how even the ranges are.
    """
    n = max(1, min(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    step = max(1, df.count() // (20 * n))
    drawn = df.select(key).where(F.col(key).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(step)) == 0)).distinct()
    keys = [r[0] for r in drawn.orderBy(key).collect()]
    bounds = sorted({len(keys) * i // n for i in range(1, n)} & set(range(len(keys))))

    def cut(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(key) < F.lit(keys[bounds[mid]]), cut(lo, mid)).otherwise(cut(mid + 1, hi))

    return F.when(F.col(key).isNull(), F.lit(len(bounds) + 1)).otherwise(cut(0, len(bounds)))


def with_offsets(df: DataFrame, key: str, amount: Column) -> DataFrame:
    """Adds ``__p``, the range of the key, and ``__o``, the sum of ``amount`` over all ranges before it."""
    rows = df.withColumn("__p", ranges(df, key))
    starts, total = [], 0
    for p, n in rows.groupBy("__p").agg(F.sum(amount)).orderBy("__p").collect():  # one row a range
        starts.append((p, total))
        total += n or 0
    offsets = df.sparkSession.createDataFrame(starts or [(0, 0)], "__p int, __o bigint")
    return rows.join(F.broadcast(offsets), "__p")


def in_range(key: str):
    """A window over the rows of a range of keys in key order, nulls last."""
    return Window.partitionBy("__p").orderBy(F.col(key).asc_nulls_last())
