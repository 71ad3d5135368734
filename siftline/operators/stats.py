"""Paired evaluation and distributions (J6-J9, A3-A33): joins that assert, grouped aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions import scalar_stats as S


def paired(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, a, b) of two arms; null values drop, duplicates and one-sided keys raise when read."""
    left = a.where(F.col(value).isNotNull()).groupBy(key).agg(F.count("*").alias("na"), F.first(value).alias("a"))
    right = b.where(F.col(value).isNotNull()).groupBy(key).agg(F.count("*").alias("nb"), F.first(value).alias("b"))
    both = left.join(right, key, "full")
    fine = (F.coalesce("na", F.lit(0)) == 1) & (F.coalesce("nb", F.lit(0)) == 1)
    checked = F.when(fine, F.col("a")).otherwise(F.raise_error(F.concat(F.lit("unpaired or repeated key "), F.col(key).cast("string"))))
    return both.select(key, checked.alias("a"), "b")


def paired_counts(pairs: DataFrame, by: list[str] = ()) -> DataFrame:
    """Counts, accuracies, difference and Wald intervals of boolean arms a and b."""
    a, b = F.col("a").cast("boolean"), F.col("b").cast("boolean")
    out = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(a).alias("correct_a"), F.count_if(b).alias("correct_b"), F.count_if(a & ~b).alias("n10"), F.count_if(~a & b).alias("n01"))
    n, d = F.col("n"), (F.col("correct_b") - F.col("correct_a")) / F.col("n")
    gap = F.col("n01") - F.col("n10")
    se = F.sqrt(F.greatest(F.col("n10") + F.col("n01") - gap * gap / n, F.lit(0.0))) / n
    return out.select(
        *by, "n", "correct_a", "correct_b", "n10", "n01", F.round(F.col("correct_a") / n, 4).alias("acc_a"), F.round(F.col("correct_b") / n, 4).alias("acc_b"),
        F.round(d, 4).alias("delta"), F.round(d - 1.96 * se, 4).alias("low95"), F.round(d + 1.96 * se, 4).alias("high95"),
        F.round(d - 1.6448536269514722 * se, 4).alias("low_one_sided"), F.round(d + 1.6448536269514722 * se, 4).alias("high_one_sided"),
    )


def with_tests(counts: DataFrame, margin: float, alpha: float = 0.05) -> DataFrame:
    """A6, A9, A10 for each row of counts: as many rows as benchmarks."""

    def run(parts):
        for p in parts:
            rows = [(int(n), int(x), int(y)) for n, x, y in zip(p["n"], p["n10"], p["n01"])]
            bounds = [S.exact_paired_bounds(*r, alpha) for r in rows]
            yield p.assign(mcnemar_p=[round(S.mcnemar_exact(x, y), 9) for _, x, y in rows], lower=[round(b[0], 6) for b in bounds], upper=[round(b[1], 6) for b in bounds], verdict=[S.noninferior(*r, margin, alpha) for r in rows])

    schema = counts.withColumns({"mcnemar_p": F.lit(0.0), "lower": F.lit(0.0), "upper": F.lit(0.0), "verdict": F.lit("")}).schema
    return counts.mapInPandas(run, schema)


def describe(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """N, mean, median, sample deviation (0 for one row), p10, p90, min and max of non-null values."""
    v = F.col(value)
    return df.groupBy(*by).agg(
        F.count(v).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.percentile(v, 0.5), 6).alias("median"), F.round(F.when(F.count(v) == 1, 0.0).otherwise(F.stddev_samp(v)), 6).alias("std"),
        F.round(F.percentile(v, 0.1), 6).alias("p10"), F.round(F.percentile(v, 0.9), 6).alias("p90"), F.min(v).alias("min"), F.max(v).alias("max"),
    )


def index_percentile(df: DataFrame, value: str, shares: tuple[float, ...], by: list[str] = ()) -> DataFrame:
    """sorted[min(n - 1, int(p * n))], by rank and without collecting a group."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    # distinct values with counts first: the window sees values, not rows
    c = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    ranked = c.withColumns({"upto": F.sum("c").over(w.orderBy(value)), "n": F.sum("c").over(w)})
    out = [F.min(F.when(F.col("upto") > F.least(F.col("n") - 1, F.floor(F.col("n") * p)), F.col(value))).alias(f"p{round(p * 100)}") for p in shares]
    return ranked.groupBy(*by).agg(F.max("n").alias("n"), *out)


def think_headroom(rows: DataFrame, seed: str, chars: str, passed: Column) -> DataFrame:
    """Pass rate, mean min/max ratio of seeds with two passes, and seeds whose shortest is under half the median."""
    total = rows.agg(F.count("*").alias("rollouts"), F.count_if(passed).alias("passes"))
    seeds = rows.where(passed).groupBy(seed).agg(F.count("*").alias("k"), F.min(chars).alias("lo"), F.max(chars).alias("hi"), F.percentile(chars, 0.5).alias("mid")).where("k >= 2")
    ratio = F.when(F.col("hi") == 0, 1.0).otherwise(F.col("lo") / F.col("hi"))
    found = seeds.agg(F.count("*").alias("eligible"), F.round(F.percentile(ratio, 0.5), 6).alias("p50_ratio"), F.count_if(F.col("lo") < F.col("mid") * 0.5).alias("pruneable"))
    both = total.withColumn("k", F.lit(1)).join(found.withColumn("k", F.lit(1)), "k").drop("k")  # single rows
    return both.withColumns({"pass_rate": F.round(F.try_divide("passes", "rollouts"), 6), "prune_rate": F.round(F.try_divide("pruneable", "eligible"), 6)})


def consistency(rows: DataFrame, by: list[str], reward: str, tokens: str, finish: str) -> DataFrame:
    """A19a-A19g for each group of completions."""
    r, t = F.col(reward), F.when(F.col(tokens) > 0, F.col(tokens))
    ok = F.max(r) > 0.5
    valid = F.avg((r > -1).cast("double"))
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.round(F.stddev_samp(r), 6).alias("reward_std"), F.round(F.max(r) - F.avg(r), 6).alias("passk_gap"), F.round(F.stddev_samp(t) / F.nullif(F.avg(t), F.lit(0.0)), 6).alias("len_cv"),
        F.round(valid, 6).alias("valid_frac"), F.round(F.when(ok, F.avg((r > 0.5).cast("double"))), 6).alias("success_frac"),
        F.round(F.when(F.max(r) > -1, valid), 6).alias("valid_repro"), F.round(F.avg((F.col(finish) == "length").cast("double")), 6).alias("trunc_frac"),
    )


def advantages(rows: DataFrame, group: str, reward: str, normalise: str = "std", eps: float = 1e-6) -> DataFrame:
    """Reward less the group's mean, over its population deviation ("std") or not ("mean").

    Groups of zero deviation give zeros. Rounding leans up by 1e-10, so that sums in
    another order don't part at a half. The group statistics are aggregated first and
    joined back, so a hot group is never one window.
    """
    g = rows.groupBy(group).agg(F.avg(reward).alias("m"), F.stddev_pop(reward).alias("sd"))
    out = rows.join(g, group)
    d = F.col(reward) - F.col("m")
    adv = F.when(F.col("sd") == 0, 0.0).otherwise(d / (F.col("sd") + eps) if normalise == "std" else d)
    return out.withColumns({"advantage": F.round(adv + 1e-10, 6), "skipped": F.col("sd") == 0}).drop("m", "sd")


def agreement(rows: DataFrame, key: str | list[str], passed: Column) -> DataFrame:
    """(C(p, 2) + C(n - p, 2)) / C(n, 2) of each key's repeated outcomes; null for one."""
    g = rows.groupBy(*([key] if isinstance(key, str) else key)).agg(F.count("*").alias("n"), F.count_if(passed).alias("p"))
    n, p = F.col("n"), F.col("p")
    return g.withColumn("agreement", F.round(F.try_divide(p * (p - 1) + (n - p) * (n - p - 1), n * (n - 1)), 6))


# Probabilities that a Poisson(1) draw is at most 0, 1, 2, ..; beyond the last one, one more.
POISSON = tuple(math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(12))


def poisson_weight(key: Column, rep: Column, seed: int) -> Column:
    """A Poisson(1) draw from the md5 of seed, key and replicate, which both engines have."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), rep.cast("string")))
    u = F.conv(F.substring(h, 1, 12), 16, 10).cast("double") / float(1 << 48)
    draw = F.lit(len(POISSON))
    for k in reversed(range(len(POISSON))):
        draw = F.when(u < POISSON[k], k).otherwise(draw)
    return draw.cast("double")


def replicates(rows: DataFrame, key: str, num: str, den: str, b: int = 1000, seed: int = 0) -> DataFrame:
    """(rep, m): sum(num) / sum(den) of each replicate."""
    keys = rows.groupBy(key).agg(F.sum(num).alias("num"), F.sum(den).alias("den"))
    w = keys.select(key, "num", "den", F.explode(F.sequence(F.lit(0), F.lit(b - 1))).alias("rep")).withColumn("w", poisson_weight(F.col(key), F.col("rep"), seed))
    return w.groupBy("rep").agg((F.sum(F.col("w") * F.col("num")) / F.nullif(F.sum(F.col("w") * F.col("den")), F.lit(0.0))).alias("m"))


def poisson_bootstrap(rows: DataFrame, key: str, num: str, den: str, b: int = 1000, seed: int = 0) -> DataFrame:
    """Percentile interval of sum(num) / sum(den) under resampling of keys.

    Each key draws a Poisson(1) weight for each replicate from its own hash, so replicates
    are summed before the shuffle and no key moves; pairs of arms share the weight of their key.
    """
    point = rows.agg((F.sum(num) / F.nullif(F.sum(den).cast("double"), F.lit(0.0))).alias("point")).withColumn("k", F.lit(1))
    low, high = F.percentile("m", 0.025), F.percentile("m", 0.975)
    return replicates(rows, key, num, den, b, seed).agg(low.alias("low"), high.alias("high")).withColumn("k", F.lit(1)).join(point, "k").select("point", "low", "high")
