"""Job events (T1, T2, T5, T6): terminal states confirmed by repeated polls, each told once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("completed", "failed")


def confirmed(polls: DataFrame, job: str, at: list[str], state: Column, needed: int = 2) -> DataFrame:
    """(event_id, job, state, at): the first poll at which a terminal state has stood ``needed`` polls in a row.

    Polls of one job are ordered, so a job is one window partition; its state is three numbers.
    """
    w = Window.partitionBy(job).orderBy(*at)
    rows = polls.select(job, *at, state.alias("state"))
    rows = rows.withColumn("fresh", F.coalesce((F.lag("state").over(w) != F.col("state")).cast("int"), F.lit(1)))
    rows = rows.withColumn("island", F.sum("fresh").over(w))
    rows = rows.withColumn("confirmations", F.row_number().over(Window.partitionBy(job, "island").orderBy(*at)))
    hit = rows.where(F.col("state").isin(*TERMINAL) & (F.col("confirmations") == needed))
    first = hit.groupBy(job, "state").agg(F.min(F.struct(*at)).alias("a"))
    return first.select(F.concat_ws("--", F.col(job).cast("string"), "state").alias("event_id"), job, "state", *(F.col(f"a.{c}").alias(c) for c in at))


def unread(events: DataFrame, acks: DataFrame, key: str = "event_id") -> DataFrame:
    """T5: events without an acknowledgement."""
    return events.join(acks.select(key), key, "left_anti")


def emit_once(events: DataFrame, told: DataFrame, key: str = "event_id") -> DataFrame:
    """Events not told yet, one for each id."""
    return events.dropDuplicates([key]).join(told.select(key), key, "left_anti")
