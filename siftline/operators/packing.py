"""Token packing (W16, W17, P52, Y49): fixed blocks from a stream of examples."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.operators.common import in_range, with_offsets


def running_start(df: DataFrame, key: str, size: str) -> DataFrame:
    """Adds ``start``: the sum of ``size`` over all rows up to the key, itself left out; nulls last.
    Ranges of keys are summed, their totals offset on the driver (one number each), then each sums locally."""
    local = F.sum(size).over(in_range(key)) - F.col(size)
    return with_offsets(df, key, F.col(size)).withColumn("start", F.col("__o") + local).drop("__p", "__o")


def stream_blocks(df: DataFrame, key: str, size: str, length: int) -> DataFrame:
    """(block, n_pieces, first_key): examples end to end, cut every ``length`` tokens; the rest is dropped."""
    rows = df.select(key, F.col(size).alias("size"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    placed = running_start(rows, key, "size").where("size > 0")
    spans = F.sequence(F.floor(F.col("start") / length), F.floor((F.col("start") + F.col("size") - 1) / length))
    pieces = placed.select(key, F.explode(spans).alias("block")).where(F.col("block") < total // length)
    return pieces.groupBy("block").agg(F.count("*").alias("n_pieces"), F.min(key).alias("first_key"))


def token_blocks(df: DataFrame, order: list[str], shard: str, ids: str, labels: str, length: int, pad: int, head_drop: float = 0.0, seed: int = 0, ignore: int = -100) -> DataFrame:
    """(shard, block, ids, labels): greedy blocks of ``length`` tokens in order inside each shard.

    An example that doesn't fit keeps the tail that does; a full block is closed; the last one
    is padded. With ``head_drop`` an example that joins others loses its first token with that
    probability, drawn from a hash of seed, shard and place. One stream is one shard. Batches
    stream in order and only the open block is held, so memory doesn't grow with a shard.
    """
    rows = df.select(F.col(shard).alias("shard"), *order, F.col(ids).alias("ids"), F.col(labels).alias("labels"))
    dealt = rows.repartition("shard").sortWithinPartitions("shard", *order).select("shard", "ids", "labels")

    def run(parts):
        open_shard, block, place, held = None, 0, 0, ([], [])

        def close():
            return {"shard": open_shard, "block": block, "ids": held[0] + [pad] * (length - len(held[0])), "labels": held[1] + [ignore] * (length - len(held[1]))}

        for part in parts:
            out = []
            for s, x, y in zip(part["shard"], part["ids"], part["labels"]):
                if s != open_shard:
                    if held[0]:
                        out.append(close())
                    open_shard, block, place, held = s, 0, 0, ([], [])
                room = length - len(held[0])
                x, y = list(x)[-room:], list(y)[-room:]
                if held[0] and head_drop:
                    draw = int.from_bytes(hashlib.sha256(f"{seed}:{s}:{place}".encode()).digest()[:7])
                    if draw < head_drop * (1 << 56):
                        x, y = x[1:], y[1:]
                place += 1
                held = (held[0] + x, held[1] + y)
                if len(held[0]) >= length:
                    out.append(close())
                    block, held = block + 1, ([], [])
            yield pd.DataFrame(out, columns=["shard", "block", "ids", "labels"])
        if held[0]:
            yield pd.DataFrame([close()])

    return dealt.mapInPandas(run, "shard bigint, block bigint, ids array<int>, labels array<int>")


def turn_labels(ids: Column, roles: Column, ignore: int = -100) -> Column:
    """Ids of assistant turns as labels, all other turns masked; from token arrays of each turn and its roles."""
    return F.flatten(F.transform(F.arrays_zip(ids.alias("t"), roles.alias("r")), lambda z: F.transform(z["t"], lambda x: F.when(z["r"] == "assistant", x).otherwise(F.lit(ignore)))))
