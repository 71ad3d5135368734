"""Readers, writers, the ledger and the event stream on small files."""

import datetime as dt
import json
import zipfile

import pyarrow as pa
import pytest

from siftline.operators import events
from siftline.sources import readers, writers
from siftline.streaming import job_events
from pyspark.sql import functions as F


def test_discovery_and_freshness(spark, tmp_path):
    (tmp_path / "b").mkdir()
    for name in ("b/z.jsonl", "a.parquet", "note.txt"):
        (tmp_path / name).write_text("{}")
    found = readers.discover(spark, [str(tmp_path)])
    assert [f.rsplit("/", 1)[1] for f in found] == ["a.parquet", "z.jsonl"]
    with pytest.raises(FileNotFoundError):
        readers.discover(spark, [str(tmp_path / "none")])
    assert readers.settled_files(spark, [str(tmp_path)])[1] == [f for f in found if f.endswith(".parquet")]
    (tmp_path / "a.parquet.done").write_text("")
    assert readers.settled_files(spark, [str(tmp_path)])[1] == []


def test_strict_lines(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1}\n\n{"a": 2}\n')
    assert [r.a for r in readers.jsonl(spark, str(p), "a int").collect()] == [1, 2]
    p.write_text('{"a": 1}\n[2]\n')
    with pytest.raises(Exception, match="not a JSON object"):
        readers.jsonl(spark, str(p), "a int").collect()


def test_array_or_lines(spark, tmp_path):
    p = tmp_path / "x.json"
    p.write_text('[{"a": 1, "b": "x"},\n {"a": 2, "b": "y"}]')
    assert [tuple(r) for r in readers.json_array_or_lines(spark, str(p), "a int, b string").collect()] == [(1, "x"), (2, "y")]
    p.write_text('{"a": 1, "b": "x"}\n{"a": 2, "b": "y"}\n')
    assert readers.json_array_or_lines(spark, str(p), "a int, b string").count() == 2


@pytest.mark.parametrize("kind", ["stream", "file"])
def test_arrow_files(spark, tmp_path, kind):
    t = pa.table({"a": [1, 2], "b": ["x", "y"]})
    with pa.OSFile(str(tmp_path / "x.arrow"), "wb") as f, (pa.ipc.new_stream if kind == "stream" else pa.ipc.new_file)(f, t.schema) as w:
        w.write_table(t)
    got = readers.arrow_ipc(spark, str(tmp_path / "x.arrow"), "a bigint, b string").collect()
    assert [tuple(r) for r in got] == [(1, "x"), (2, "y")]


def test_zipped_csv(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("t/b.csv", "﻿q,a\n1,2\n")
        z.writestr("t/._b.csv", "junk")
        z.writestr("other.csv", "n")
    got = readers.zipped_csv(spark, str(tmp_path / "x.zip"), "t/").orderBy("row_no").collect()
    assert [r.fields for r in got] == [["q", "a"], ["1", "2"]]


def test_eval_sets(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "x"}')
    load = lambda s, p: readers.jsonl(s, p, "text string")
    found, skipped = readers.eval_sets(spark, {"a": str(tmp_path / "a.jsonl"), "b": str(tmp_path / "b")}, load)
    assert list(found) == ["a"] and "missing" in skipped["b"]
    with pytest.raises(FileNotFoundError, match="BLOCKED"):
        readers.eval_sets(spark, {"b": str(tmp_path / "b")}, load, strict=True)
    assert readers.overrides(["a=/x"], ("a",)) == {"a": "/x"}
    with pytest.raises(ValueError):
        readers.overrides(["c=/x"], ("a",))


def test_checkpoint_logs(spark):
    seeds = spark.createDataFrame([("a", "1"), ("b", "2")], "id string, sha string")
    log = spark.createDataFrame([("a", "1", 0, "x"), ("a", "1", 1, "y")], "id string, sha string, pos int, v string")
    assert [r.v for r in readers.checkpoint_log(log, seeds, "id", "sha", ["pos"], True).collect()] == ["y"]
    with pytest.raises(Exception, match="repeated id"):
        readers.checkpoint_log(log, seeds, "id", "sha", ["pos"], False).collect()
    bad = spark.createDataFrame([("z", "1", 0, "x")], log.schema)
    with pytest.raises(Exception, match="unknown id"):
        readers.checkpoint_log(bad, seeds, "id", "sha", ["pos"], False).collect()


def test_items_and_arms(spark, tmp_path):
    (tmp_path / "l2_base.jsonl").write_text('{"a": 1}\n')
    assert readers.arms(spark, str(tmp_path / "l2_base.jsonl"), "a int").first().arm == "base"
    (tmp_path / "i.json").write_text(json.dumps({"items": {"m": [{"b": 1}, {"b": 2}]}}))
    assert [tuple(r) for r in readers.items_file(spark, str(tmp_path / "i.json")).collect()] == [("m", '{"b": 1}'), ("m", '{"b": 2}')]


def test_split_write_and_json(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", False), (2, "b", True), (3, "c", False)], "id int, t string, gone boolean")
    n = writers.split_write(df, "gone", str(tmp_path / "kept"), str(tmp_path / "log"), ["id"])
    assert n == {"in": 3, "kept": 2, "removed": 1}
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 2
    with pytest.raises(FileExistsError):
        writers.refuse_non_empty(spark, str(tmp_path))
    writers.write_json(spark, str(tmp_path / "m.json"), {"a": 1})
    assert json.loads((tmp_path / "m.json").read_text()) == {"a": 1}
    with pytest.raises(FileExistsError):
        writers.write_json(spark, str(tmp_path / "m.json"), {}, replace=False)


def test_ledger(spark, tmp_path):
    sha = "0" * 64
    members = spark.createDataFrame([("a",), ("b",)], "id string")
    row = lambda i, v="accept": (i, v, "fine", sha)
    schema = "id string, verdict string, reason string, rubric_sha string"
    path = str(tmp_path / "ledger")
    assert writers.append_ledger(spark.createDataFrame([row("a")], schema), None, members, path, "id", sha) == 1
    ledger = spark.read.parquet(path)
    for bad in ([row("a")], [row("z")], [row("b"), row("b")], [row("b", "maybe")]):
        with pytest.raises(ValueError):
            writers.append_ledger(spark.createDataFrame(bad, schema), ledger, members, path, "id", sha)


def test_event_stream_equals_batch(spark, tmp_path):
    at = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i)
    states = {"j1": "running failed failed completed completed failed failed".split(), "j2": "completed running completed".split(), "j3": "failed failed".split()}
    rows = [(j, at(i), s) for j, ss in states.items() for i, s in enumerate(ss)]
    df = spark.createDataFrame(rows, "job string, at timestamp, state string")
    batch = {r.event_id: r["at"] for r in events.confirmed(df, "job", ["at"], F.col("state")).collect()}
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    polls = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = job_events.stream(polls).writeStream.format("memory").queryName("told").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.event_id: r["at"] for r in spark.sql("select * from told").collect()} == batch
    assert set(batch) == {"j1--failed", "j1--completed", "j3--failed"}
