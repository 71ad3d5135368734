"""Arms of repeated evaluations (A26, A28, A29, F24, F25, Y24, Y40, Y42, Y43, Y45): one or two levels of grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.operators import stats as S


def rate(part: Column, whole: Column, digits: int = 4) -> Column:
    """Null for nothing, else rounded."""
    return F.round(F.try_divide(part, whole), digits)


def half_width(share: Column, n: Column) -> Column:
    """A5: of the normal 95 % interval."""
    return F.round(1.96 * F.sqrt(F.greatest(share * (1 - share), F.lit(0.0)) / n), 4)


def infra_error(finish: Column) -> Column:
    """F24."""
    return F.startswith(finish, F.lit("error"))


def clean(rows: DataFrame, finish: str) -> DataFrame:
    """Completions that no infrastructure error ended; a null finish stays."""
    return rows.where(~F.coalesce(infra_error(F.col(finish)), F.lit(False)))


def near_miss(flags: Column, finish: Column) -> Column:
    """all of the format but the opening thought tag, from P22's flags."""
    once = (flags["think_close"] == 1) & (flags["solution_open"] == 1) & (flags["solution_close"] == 1)
    return (flags["think_open"] == 0) & once & (flags["search"] > 0) & (finish == "stop")


def arm_summary(rows: DataFrame, by: list[str], seed: str, item: str, correct: str, truncated: str, seeds: int) -> DataFrame:
    """Mean and sample deviation of per-seed rates, mean agreement of items; an item without all seeds raises when read."""
    c, t = F.col(correct).cast("boolean"), F.col(truncated).cast("boolean")
    per_seed = rows.groupBy(*by, seed).agg(F.avg(c.cast("double")).alias("rate"), F.count_if(t).alias("t"))
    over = per_seed.groupBy(*by).agg(F.round(F.avg("rate"), 6).alias("pass_rate"), F.round(F.stddev_samp("rate"), 6).alias("seed_sd"), F.sum("t").alias("truncated"))
    per_item = S.agreement(rows, [*by, item], c)
    whole = F.when(F.col("n") == seeds, F.col("agreement")).otherwise(F.raise_error(F.lit("incomplete seed matrix")))
    items = per_item.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(whole), 6).alias("agreement"))
    return over.join(items, by)


def call_eval(parts: DataFrame, by: list[str]) -> DataFrame:
    """A28 of parts with counts: four rates with their intervals, tokens a second summed and in parallel."""
    names = ("n_pos", "n_neg", "format_valid", "name_match", "arg_match", "over_trigger", "gen_tokens")
    g = parts.groupBy(*by).agg(*(F.sum(n).alias(n) for n in names), F.sum("gen_time").alias("total"), F.max("gen_time").alias("longest"))
    rates = {"format_validity": ("format_valid", "n_pos"), "name_acc": ("name_match", "n_pos"), "arg_acc": ("arg_match", "n_pos"), "over_trigger_rate": ("over_trigger", "n_neg")}
    out = [x for n, (a, b) in rates.items() for x in (rate(F.col(a), F.col(b)).alias(n), half_width(rate(F.col(a), F.col(b)), F.col(b)).alias(f"{n}_ci95"))]
    return g.select(*by, "n_pos", "n_neg", *out, "gen_tokens", rate(F.col("gen_tokens"), F.col("total"), 2).alias("tok_s"), rate(F.col("gen_tokens"), F.col("longest"), 2).alias("tok_s_parallel"))


def k_sweep(parts: DataFrame, k: str, workers: int = 2) -> DataFrame:
    """One row for each k that all workers reported."""
    g = parts.groupBy(k).agg(F.count("*").alias("parts"), *(F.sum(n).alias(n) for n in ("correct", "n", "gen_tokens")), F.sum("gen_time").alias("total"), F.max("gen_time").alias("longest"))
    return g.where(F.col("parts") >= workers).select(
        k, rate(F.col("correct"), F.col("n")).alias("acc"), "correct", "n", "gen_tokens", rate(F.col("gen_tokens"), F.col("total"), 2).alias("tok_s"), rate(F.col("gen_tokens"), F.col("longest"), 2).alias("tok_s_parallel"), F.round("total", 1).alias("gen_time_sum_s")
    )


def format_probe(rows: DataFrame, arm: str, prompt: str) -> DataFrame:
    """Y45 of rows with (format_valid, method, strict, lenient, finish, think_open, tags_ok, marker): shares, means,
    the mean over prompts of the best of each, and how far the failures got."""
    stop = F.col("finish") == "stop"
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    flat = rows.groupBy(arm).agg(
        F.count("*").alias("n"), share(F.col("format_valid")).alias("fmt_ok"), *(share(F.col("method") == m).alias(n) for n, m in (("env", "search_replace"), ("fb", "diff_fallback"), ("fail", "format_fail"))),
        share(F.col("finish") == "length").alias("trunc"), F.round(F.avg("strict"), 6).alias("strict_mean"), F.round(F.avg("lenient"), 6).alias("lenient_mean"),
        share(F.col("think_open") >= 1).alias("open_think"), share(F.col("tags_ok")).alias("tags_ok"), share(F.col("marker")).alias("srmark"), F.count_if(stop).alias("n_stop"), F.count_if(stop & F.col("tags_ok")).alias("n_ready"),
        share(stop & F.col("tags_ok") & F.col("format_valid")).alias("ready_valid"),
    )
    best = rows.groupBy(arm, prompt).agg(F.max("strict").alias("s"), F.max("lenient").alias("l")).groupBy(arm).agg(F.round(F.avg("s"), 6).alias("strict_best"), F.round(F.avg("l"), 6).alias("lenient_best"))
    return flat.join(best, arm)


def followed(subset: DataFrame, raw: DataFrame, key: str, follows: str, truncated: str) -> DataFrame:
    """(n, correct, pass_rate, truncated_n) of a frozen subset: an item counts if every instruction was followed."""
    from siftline.operators.records import scored_subset

    j = scored_subset(subset.select(key), raw.select(key, follows, truncated), key)
    return j.agg(F.count(key).alias("n"), F.count_if(F.forall(follows, lambda x: x)).alias("correct"), F.count_if(F.col(truncated)).alias("truncated_n")).withColumn("pass_rate", rate(F.col("correct"), F.col("n"), 6))


def structured_verdicts(a: DataFrame, b: DataFrame, key: str, fields: tuple[str, ...] = ("correct", "truncated")) -> DataFrame:
    """A7's counts for each field of two arms, as rows."""
    long = lambda d: d.select(key, F.explode(F.create_map(*(x for f in fields for x in (F.lit(f), F.col(f).cast("boolean"))))).alias("field", "v")).select(F.concat_ws(":", "field", key).alias("k"), "v")
    pairs = S.paired(long(a), long(b), "k", "v").withColumn("field", F.split_part("k", F.lit(":"), F.lit(1)))
    return S.paired_counts(pairs, ["field"])
