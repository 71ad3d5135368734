"""Batch quota gates and shadow reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import text as T
from siftline.operators.decontam import near_pairs

#: Largest share of a batch that one first-two-words, first-four-words or style group may have, and the gates' names.
LIMITS = {"prefix2": 0.25, "prefix4": 0.10, "style": 0.35}
NAMES = {"prefix2": "batch_prefix_2", "prefix4": "batch_prefix_4", "style": "batch_style"}
NEAR = 0.92


def quota_gates(rows: DataFrame, key: str, text: str, style: str, least: int = 10) -> DataFrame:
    """(key, gates): every member of a group over its share is rejected; small batches have no quotas.

    Survivors are then compared by character 3-grams: a row goes if any earlier survivor,
    rejected as a near copy or not, is within ``NEAR``. Groups are counted in one pass; those
    over their share are at most 1 / share of them, so they stand in the plan and no text moves.
    """
    d = rows.select(F.col(key).alias("k"), F.col(text).alias("t"), T.first_words(F.col(text), 2).alias("prefix2"), T.first_words(F.col(text), 4).alias("prefix4"), F.col(style).cast("string").alias("style"))
    total, over = d.count(), {name: [] for name in LIMITS}
    if total >= least:
        counts = d.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in LIMITS))).alias("g")).groupBy("g.name", "g.value").agg(F.count("*").alias("n"))
        share = F.create_map(*(F.lit(x) for item in LIMITS.items() for x in item))[F.col("name")]
        for r in counts.where(F.col("n") / total > share).collect():
            over[r["name"]].append(r["value"])
    d = d.select("k", "t", *(reduce(Column.__or__, [F.col(n).eqNullSafe(v) for v in over[n]], F.lit(False)).alias(f"over_{n}") for n in LIMITS))
    gates = F.array_compact(F.array(*(F.when(F.col(f"over_{n}"), F.lit(NAMES[n])) for n in LIMITS)))
    d = d.select("k", "t", gates.alias("gates"))
    alive = d.where(F.size("gates") == 0)
    near = near_pairs(alive, "k", T.collapsed(F.col("t")), 3, NEAR).select(F.col("b").alias("k")).distinct().withColumn("near", F.lit(True))
    out = d.select("k", "gates").join(near, "k", "left")
    every = F.when(F.col("near"), F.array_append("gates", F.lit("skeleton_similarity"))).otherwise(F.col("gates"))
    return out.select(F.col("k").alias(key), F.array_join(every, ",").alias("gates"))


def shadow_report(rows: DataFrame, strata: list[str], gates: Column, names: list[str]) -> DataFrame:
    """N, passed and the share that fails each gate, for each stratum."""
    fails = [F.round(F.avg(F.array_contains(gates, n).cast("double")), 6).alias(f"fail_{n}") for n in names]
    return rows.groupBy(*strata).agg(F.count("*").alias("n"), F.count_if(F.size(gates) == 0).alias("passed"), *fails)
