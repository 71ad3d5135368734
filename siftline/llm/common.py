"""What the operators of this subpackage share: batches, checkpoints, components."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegralType, NullType, StructType

#: Text bytes that one call of a batch function gets at most (a single longer text comes alone),
#: and rows that Spark puts in one Arrow batch at most.
BATCH_BYTES, BATCH_ROWS = 8_000_000, 2_000
_OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Only the named inputs under the operator's own names, so extra columns can't clash."""
    bound_batches(df.sparkSession)
    return df.select(*(c.alias(k) if isinstance(c, Column) else df[c].alias(k) for k, c in columns.items()))


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS: both ends of a pipe to Python hold whole batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def integer_key(df: DataFrame, key: str) -> Column:
    """The id column as bigint; ids that are no integers raise here and not in a task."""
    if not isinstance(df.schema[key].dataType, (IntegralType, NullType)):
        raise TypeError(f"{key} must be an integer column, not {df.schema[key].dataType.simpleString()}")
    return df[key].cast("bigint")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of texts (or binaries) end to end, and where each begins, with the end; a null has none."""
    column = column.fill_null(b"" if pa.types.is_binary(column.type) else "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


@lru_cache(1)
def _c_library():
    try:
        lib = ctypes.CDLL("libc.so.6")
        return lib if hasattr(lib, "malloc_trim") else None
    except OSError:
        return None


def give_back() -> None:
    """Return a worker's freed memory to its machine, where the C library can: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if lib := _c_library():
        lib.malloc_trim(0)


def slices(batch: pa.RecordBatch, text_index: int | None) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most BATCH_BYTES of the text column; memory is given back after the last one."""
    if text_index is None or batch.num_rows < 2 or batch.nbytes <= BATCH_BYTES:
        yield batch
        give_back()
        return
    start, size = 0, 0
    for i, s in enumerate(pc.binary_length(batch.column(text_index)).to_pylist()):
        if i > start and size + (s or 0) > BATCH_BYTES:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += s or 0
    yield batch.slice(start)
    give_back()


def map_batches(df: DataFrame, make: Callable[[], Callable[..., dict | list]], schema: str, text: str | None = "text") -> DataFrame:
    """``make()`` runs once per task and returns ``f(**columns as lists) -> {column: list}``.

    Arrow batches are cut to a bounded number of text bytes first, so memory follows
    the longest text and not the rows in a batch.
    """
    kind = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)
    names = df.columns
    index = names.index(text) if text in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part in slices(batch, index):
                out = f(**{n: part.column(i).to_pylist() for i, n in enumerate(names)})
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[field.name], type=field.type, from_pandas=False) for field in arrow], schema=arrow
                )
                del out

    return df.mapInArrow(run, kind)


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir, which driver and executors share.

    Where the setting is unset a local session gets a local folder; a cluster raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _OWN.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="siftline-"))
    return f"{base.rstrip('/')}/siftline-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, frame: DataFrame) -> None:
    """Delete the files of a frame made by :func:`materialize` that is no longer read."""
    for name in {os.path.dirname(f) for f in frame.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge table: (node, component = smallest node reachable).

    Alternating large-star and small-star rounds; every round is a grouped minimum
    and a join back, both safe for hot nodes (AQE splits the join), and ends in the
    shared folder. Nodes without an edge to another node don't appear.
    """
    spark = edges.sparkSession
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v")
    e = materialize(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        # large star: neighbours above u join the smallest neighbour of u (or u itself)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: neighbours below u, and u, join the smallest of them
        large = materialize(large.where("u != v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v")))
        after = materialize(small.where("u != v").distinct())
        same = after.count() == e.count() and after.exceptAll(e).isEmpty()
        release(spark, large)
        release(spark, e)
        e = after
        if same:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
