"""Sources (S1-S24): discovery on the driver, rows read by Spark, strictness as lazy assertions."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StructType

SUFFIXES = (".jsonl", ".parquet")
FRESH_SECONDS = 300


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def discover(spark: SparkSession, inputs: list[str], suffixes: tuple[str, ...] = SUFFIXES) -> list[str]:
    """Sorted files of the given kinds, recursive; a single file is taken; nothing found raises."""
    out: list[str] = []
    for path in inputs:
        fs, p = _fs(spark, path)
        if not fs.exists(p):
            continue
        found = fs.listFiles(p, True)
        own = []
        while found.hasNext():
            name = found.next().getPath().toString()
            if name.endswith(suffixes):
                own.append(name)
        out += sorted(own)
    if not out:
        raise FileNotFoundError(f"no {' or '.join(suffixes)} files under {inputs}")
    return out


def complete(spark: SparkSession, path: str, min_age: float = FRESH_SECONDS, now: float | None = None) -> bool:
    """A .done marker, a manifest beside it, or an age of at least ``min_age`` seconds."""
    import time

    fs, p = _fs(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(p.getParent(), "manifest.json")
    if fs.exists(p.suffix(".done")) or fs.exists(beside):
        return True
    return (now or time.time()) - fs.getFileStatus(p).getModificationTime() / 1000 >= min_age


def settled_files(spark: SparkSession, inputs: list[str], min_age: float = FRESH_SECONDS) -> tuple[list[str], list[str]]:
    """(files to read, parquet files skipped because they may still be written)."""
    files = discover(spark, inputs)
    skipped = [f for f in files if f.endswith(".parquet") and not complete(spark, f, min_age)]
    return [f for f in files if f not in skipped], skipped


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines are skipped; a bad line fails the scan with its file and text."""
    lines = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_path").alias("file")).where("trim(value) != ''")
    bad = F.raise_error(F.concat(F.lit("not a JSON object in "), F.col("file"), F.lit(": "), F.substring("value", 1, 80)))
    kind = F.schema_of_variant(F.try_parse_json("value"))
    checked = F.when(kind.startswith("OBJECT"), F.col("value")).otherwise(bad)
    return lines.select(F.from_json(checked, schema).alias("r")).select("r.*")


@F.pandas_udf(BooleanType())
def _one_document(s: pd.Series) -> pd.Series:
    def test(text: str) -> bool:
        try:
            json.loads(text)
        except ValueError:
            return False
        return True

    return s.map(test)


def json_array_or_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A whole-file array (or object), else one object a line."""
    whole = spark.read.text(path, wholetext=True)
    is_doc = whole.select(F.bool_and(_one_document("value")).alias("ok")).first()[0]
    if not is_doc:
        return jsonl(spark, path, schema)
    v = F.col("value")
    items = F.when(F.ltrim(v).startswith("["), F.from_json(v, ArrayType(StructType.fromDDL(schema)))).otherwise(F.array(F.from_json(v, schema)))
    return whole.select(F.explode(items).alias("r")).select("r.*")


def arrow_ipc(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Arrow files, stream format first, then file format; one task a file."""
    names = [p.strip().split()[0] for p in schema.split(",")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                try:
                    reader = pa.ipc.open_stream(io.BytesIO(content))
                    parts = list(reader)
                except pa.ArrowInvalid:
                    f = pa.ipc.open_file(io.BytesIO(content))
                    parts = [f.get_batch(i) for i in range(f.num_record_batches)]
                for part in parts:
                    yield part.select(names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(read, schema)


def zipped_csv(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """(member, row_no, fields): CSV rows of zip members under a prefix; byte order marks stripped, ``._`` files dropped."""
    import csv

    def read(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(z.namelist()):
                        if not name.startswith(prefix) or not name.endswith(".csv") or PurePosixPath(name).name.startswith("._"):
                            continue
                        rows = list(csv.reader(io.StringIO(z.read(name).decode("utf-8-sig"))))
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array(range(len(rows)), pa.int64()), pa.array(rows, pa.list_(pa.string()))], names=["member", "row_no", "fields"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(read, "member string, row_no bigint, fields array<string>")


def by_suffix(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet or JSON lines by the file's suffix."""
    return spark.read.parquet(path) if path.endswith(".parquet") else jsonl(spark, path, schema)


def overrides(values: list[str], known: tuple[str, ...]) -> dict[str, str]:
    """NAME=PATH pairs with known names."""
    out = {}
    for v in values:
        name, eq, path = v.partition("=")
        if not eq or name not in known or not path:
            raise ValueError(f"expected NAME=PATH with a name of {known}: {v}")
        out[name] = path
    return out


def eval_sets(spark: SparkSession, paths: dict[str, str], load: Callable[[SparkSession, str], DataFrame], strict: bool = False) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """(sets found, reasons of those skipped); ``strict`` blocks on a missing set; none at all raises."""
    found, skipped = {}, {}
    for name, path in paths.items():
        fs, p = _fs(spark, path)
        if fs.exists(p):
            found[name] = load(spark, path)
        elif strict:
            raise FileNotFoundError(f"BLOCKED: {name} is missing at {path}")
        else:
            skipped[name] = f"SKIPPED: {path} is missing"
    if not found:
        raise FileNotFoundError("every evaluation set is missing")
    return found, skipped


def two_fields(df: DataFrame, ask: str, answer: str) -> DataFrame:
    """Question and answer columns as a conversation; empty ones are left out."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    return df.where(F.coalesce(F.length(ask), F.lit(0)) * F.coalesce(F.length(answer), F.lit(0)) > 0).select(F.array(turn("user", ask), turn("assistant", answer)).alias("messages"))


def chat_turns(df: DataFrame, *columns: str) -> DataFrame:
    """The first of the columns that is there, user and assistant turns with content, two or more."""
    m = F.coalesce(*(F.col(c) for c in columns if c in df.columns))
    kept = F.filter(m, lambda x: x.role.isin("user", "assistant") & (F.coalesce(F.length(x.content), F.lit(0)) > 0))
    return df.select(kept.alias("messages")).where(F.size("messages") >= 2)


def tool_dialogues(spark: SparkSession, path: str, messages: str = "messages", tools: str = "tools") -> DataFrame:
    """(messages, tools) of a parquet source, two columns read: tools as text must be a JSON array or object that
    isn't empty, messages two or more; others are left out. Null content is empty text."""
    rows = spark.read.parquet(path).select(F.col(messages).alias("messages"), F.col(tools).alias("tools"))
    kind = F.schema_of_variant(F.try_parse_json("tools"))
    full = (kind.startswith("ARRAY") | kind.startswith("OBJECT")) & ~F.regexp_replace("tools", r"\s", "").isin("[]", "{}")
    kept = rows.where(F.coalesce(full, F.lit(False)) & (F.size("messages") >= 2))
    return kept.select(F.transform("messages", lambda m: m.withField("content", F.coalesce(m["content"], F.lit("")))).alias("messages"), "tools")


def union_sources(parts: list[DataFrame | None]) -> DataFrame:
    """An ordered union; a missing source is skipped, missing columns are null."""
    have = [p for p in parts if p is not None]
    if not have:
        raise FileNotFoundError("no source is there")
    out = have[0]
    for p in have[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def checkpoint_log(log: DataFrame, seeds: DataFrame, key: str, digest: str, order: list[str], last_wins: bool) -> DataFrame:
    """Log rows with known ids and equal digests; repeats raise, or the last of ``order`` wins."""
    j = log.join(seeds.select(key, F.col(digest).alias("__want")), key, "left")
    fault = F.when(F.col("__want").isNull(), "unknown id").when(F.col("__want") != F.col(digest), "changed seed")
    n = F.count("*").over(Window.partitionBy(key))
    if last_wins:
        from siftline.operators.selection import last_write

        checked = j.withColumn(digest, F.when(fault.isNull(), F.col(digest)).otherwise(F.raise_error(fault))).drop("__want")
        return last_write(checked, key, order)
    fault = F.coalesce(fault, F.when(n > 1, "repeated id"))
    return j.withColumn(digest, F.when(fault.isNull(), F.col(digest)).otherwise(F.raise_error(fault))).drop("__want")


def arms(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rollout files with their arm's name, without extension and ``l2_``."""
    name = F.regexp_replace(F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.[^.]*$", ""), "^l2_", "")
    return spark.read.schema(schema).json(path).select("*", name.alias("arm"))


def items_file(spark: SparkSession, path: str) -> DataFrame:
    """(bench, item): {items: {bench: [..]}} or a list, item as JSON text."""
    text = spark.read.text(path, wholetext=True).select("value")

    def read(batches):
        for batch in batches:
            for t in batch.column(0).to_pylist():
                v = json.loads(t)
                groups = v["items"] if isinstance(v, dict) else {"": v}
                rows = [(b, json.dumps(x, sort_keys=True, ensure_ascii=False)) for b, xs in groups.items() for x in xs]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["bench", "item"])

    return text.mapInArrow(read, "bench string, item string")


def prefix_limited(df: DataFrame, source: str, key: str, skip: int, take: int, longest: int, text: str) -> DataFrame:
    """Positions ``skip`` to ``skip + take`` of each source in key order, short texts alone."""
    names = [r[0] for r in df.select(source).distinct().orderBy(source).collect()]
    parts = [df.where(F.col(source) == s).orderBy(key).offset(skip).limit(take) for s in names]
    return union_sources(parts).where(F.length(text) <= longest)
