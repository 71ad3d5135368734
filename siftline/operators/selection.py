"""Sampling, ranking and ledgers (O1-O11, W1, W2, W12-W14, J5, A3, F21, K13) with orders both engines share."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.operators.common import hash_order, in_range, with_offsets


def even_quotas(n: int, strata: list[str]) -> dict[str, int]:
    """O3: equal shares; the remainder goes to earlier strata."""
    return {s: n // len(strata) + (i < n % len(strata)) for i, s in enumerate(strata)}


def largest_remainder(n: int, mix: dict[str, float]) -> dict[str, int]:
    """Floors, then one more in the order of the remainders, ties in the order given."""
    exact = {k: Fraction(str(v)) * n for k, v in mix.items()}
    out = {k: int(x) for k, x in exact.items()}
    order = sorted(mix, key=lambda k: (out[k] - exact[k], list(mix).index(k)))
    for k in order[: n - sum(out.values())]:
        out[k] += 1
    return out


def stratified(df: DataFrame, stratum: str, key: str, quotas: dict[str, int], seed: str) -> DataFrame:
    """The first rows of each stratum in hash order; one bounded top-k for each stratum."""
    parts = [df.where(F.col(stratum) == s).orderBy(hash_order(seed, F.col(key)), key).limit(n) for s, n in quotas.items() if n]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def interleaved(df: DataFrame, domain: str, key: str, n: int) -> DataFrame:
    """The i-th row of each domain in turn until n rows; each domain needs its first n rows alone."""
    domains = [r[0] for r in df.select(domain).distinct().orderBy(domain).collect()]
    heads = stratified_heads(df, domain, key, domains, n)
    order = Window.orderBy("i", domain)
    return heads.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)


def stratified_heads(df: DataFrame, domain: str, key: str, domains: list, n: int) -> DataFrame:
    parts = None
    for d in domains:
        p = df.where(F.col(domain) == d).orderBy(key).limit(n)
        p = p.withColumn("i", F.row_number().over(Window.partitionBy(domain).orderBy(key)))
        parts = p if parts is None else parts.unionByName(p)
    return parts


def last_write(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The row of each key that was written last; combines before the shuffle."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("b"))
    return best.select(key, *(F.col(f"b.{c}").alias(c) for c in rest))


def shortest_passed(df: DataFrame, seed: str, chars: str, index: str, passed: Column) -> DataFrame:
    """O1: the passed row of each seed with fewest characters, ties by index."""
    return df.where(passed).groupBy(seed).agg(F.min(F.struct(chars, index)).alias("b")).select(seed, F.col(f"b.{chars}").alias(chars), F.col(f"b.{index}").alias(index))


def first_valid(df: DataFrame, seed: str, index: str, reason: Column) -> DataFrame:
    """O2: the first candidate without a reason, and how many rejected ones stand before it."""
    rows = df.select(seed, F.col(index).alias("i"), reason.alias("reason"))
    best = rows.groupBy(seed).agg(F.min(F.when(F.col("reason").isNull(), F.col("i"))).alias("chosen"), F.count("*").alias("candidates"))
    before = rows.join(best, seed).where(F.col("reason").isNotNull() & (F.col("chosen").isNull() | (F.col("i") < F.col("chosen"))))
    n = before.groupBy(seed).agg(F.count("*").alias("rejected_before"))
    return best.join(n, seed, "left").select(seed, "chosen", "candidates", F.coalesce("rejected_before", F.lit(0)).alias("rejected_before"))


def positions(df: DataFrame, key: str) -> DataFrame:
    """Global 0-based positions in key order, nulls last, without one big window: ranges of keys, counted, then offset.

    The key must be unique, else rows of one key share their positions in any order.
    """
    placed = with_offsets(df, key, F.lit(1))
    return placed.withColumn("position", F.col("__o") + F.row_number().over(in_range(key)) - 1).drop("__p", "__o")


def batches(df: DataFrame, done: DataFrame, key: str, size: int) -> DataFrame:
    """Keys that are not done, in chunks: (batch, first, last, n)."""
    rest = df.select(key).join(done.select(key), key, "left_anti")
    cut = positions(rest, key).withColumn("batch", F.floor(F.col("position") / size))
    return cut.groupBy("batch").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("n"))


def verdict_summary(df: DataFrame, verdict: Column, kinds: list[str]) -> DataFrame:
    """Counts of each verdict with zeros, and the acceptance rate (null for no rows)."""
    counts = [F.count_if(verdict == k).alias(k) for k in kinds]
    return df.agg(F.count("*").alias("n"), *counts).withColumn("accept_rate", F.round(F.try_divide(kinds[0], "n"), 6))


def split_last(df: DataFrame, key: str, share: float, cap: int, seed: str) -> DataFrame:
    """n_val = min(max(1, floor(share * n)), cap) rows in hash order are for validation."""
    n = df.count()
    n_val = min(max(1, int(n * share)), cap)
    val = df.select(key).orderBy(hash_order(seed, F.col(key)), key).limit(n_val).withColumn("is_val", F.lit(True))
    return df.select(key).join(F.broadcast(val), key, "left").select(key, F.coalesce("is_val", F.lit(False)).alias("is_val"))


def distinct_pool(df: DataFrame, value: str, order: list[str], cap: int) -> DataFrame:
    """Distinct values by first appearance, at most ``cap``; copies meet as digests."""
    d = df.where(F.col(value).isNotNull()).select(F.sha2(value, 256).alias("digest"), F.col(value).alias("value"), F.struct(*order).alias("at"))
    first = d.groupBy("digest").agg(F.min("at").alias("at"), F.any_value("value").alias("value"))
    return first.orderBy("at").limit(cap).select("value", *(F.col(f"at.{c}").alias(c) for c in order))


def random_subset(items: Column, key: Column, seed: str, low: int, high: int) -> Column:
    """Between ``low`` and ``high`` items of an array, in hash order of seed, key and item."""
    mark = lambda x: F.md5(F.concat_ws(":", F.lit(seed), key.cast("string"), x))
    k = F.lit(low) + F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}k"), key.cast("string"))), 1, 8), 16, 10).cast("long"), F.least(F.lit(high), F.size(items)) - low + 1)
    return F.transform(F.slice(F.array_sort(F.transform(items, lambda x: F.struct(mark(x).alias("m"), x.alias("x")))), F.lit(1), k.cast("int")), lambda e: e["x"])
