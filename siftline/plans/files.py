"""Queries of sources and sinks: whole tables written as files of each kind and read back."""

from __future__ import annotations

import csv
import io
import json
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from siftline.functions import text as T
from siftline.operators import conversations as C
from siftline.operators import selection as S
from siftline.sources import readers as R
from siftline.sources import writers as W
from siftline.session import scratch, table

RUBRIC = "0" * 64


def lines_roundtrip(spark, sf):
    """Turns as JSON lines, found and read strictly."""
    path = scratch(spark) + "/turns.jsonl"
    W.write_lines(table(spark, sf, "conversations"), path)
    R.discover(spark, [path], (".txt",))
    back = R.by_suffix(spark, path, "conv_id bigint, turn bigint, role string, text string")
    return back.select("conv_id", "turn", "role", F.md5("text").alias("digest"))


def split_roundtrip(spark, sf):
    """Documents split by a flag; kept rows as parquet, the removal log as lines."""
    base = scratch(spark)
    d = table(spark, sf, "documents").withColumn("gone", F.coalesce(F.length("text"), F.lit(0)) % 3 == 0)
    W.refuse_non_empty(spark, base)
    W.split_write(d, "gone", f"{base}/kept.parquet", f"{base}/removed.jsonl", ["doc_id"])
    kept = R.by_suffix(spark, f"{base}/kept.parquet", "").select("doc_id", F.md5("text").alias("digest"), F.lit(True).alias("kept"))
    log = R.by_suffix(spark, f"{base}/removed.jsonl", "doc_id bigint, row_sha256 string")
    return kept.unionByName(log.select("doc_id", F.lit(None).cast("string").alias("digest"), F.lit(False).alias("kept")))


def array_scan(spark, sf):
    """The benchmark as one JSON array; its size is bounded by the evaluation sets."""
    path = scratch(spark) + "/items.json"
    rows = [r.asDict() for r in table(spark, sf, "benchmark").collect()]
    W.write_bytes(spark, path, json.dumps(rows, ensure_ascii=False).encode())
    return R.json_array_or_lines(spark, path, "item_id bigint, text string").select("item_id", F.md5("text").alias("digest"))


def arrow_scan(spark, sf):
    """The benchmark as Arrow files of both formats."""
    base, t = scratch(spark), pa.Table.from_pylist([r.asDict() for r in table(spark, sf, "benchmark").collect()], schema=pa.schema([("item_id", pa.int64()), ("text", pa.string())]))
    for name, make in (("a.arrow", pa.ipc.new_stream), ("b.arrow", pa.ipc.new_file)):
        sink = pa.BufferOutputStream()
        with make(sink, t.schema) as w:
            w.write_table(t)
        W.write_bytes(spark, f"{base}/{name}", sink.getvalue().to_pybytes())
    back = R.arrow_ipc(spark, base, "item_id bigint, text string")
    return back.groupBy("item_id", F.md5("text").alias("digest")).agg(F.count("*").alias("n"))


def csv_scan(spark, sf):
    """Nations as CSV members of a zip file, with byte order marks."""
    rows = [[str(v) for v in r] for r in table(spark, sf, "nation").select("n_nationkey", "n_name").collect()]
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w") as z:
        for part in range(2):
            own = io.StringIO()
            csv.writer(own).writerows([r for r in rows if int(r[0]) % 2 == part])
            z.writestr(f"t/part{part}.csv", "﻿" + own.getvalue())
            z.writestr(f"t/._part{part}.csv", "junk")
    path = scratch(spark) + "/x.zip"
    W.write_bytes(spark, path, content.getvalue())
    back = R.zipped_csv(spark, path, "t/")
    return back.select("member", F.element_at("fields", 1).cast("bigint").alias("nation"), F.element_at("fields", 2).alias("name"))


def items_scan(spark, sf):
    """regions' nations as an items document, by region."""
    rows = table(spark, sf, "nation").select("n_regionkey", "n_nationkey").collect()
    groups: dict[str, list] = {}
    for r in rows:
        groups.setdefault(f"r{r[0]}", []).append({"id": r[1]})
    path = scratch(spark) + "/items.json"
    W.write_json(spark, path, {"items": groups, "_meta": {"n": len(rows)}})
    items = R.items_file(spark, path)
    return W.flushed_items(items.select("bench", F.get_json_object("item", "$.id").cast("bigint").alias("id")))


def rollout_arms(spark, sf):
    """Two arms' files, named by their files; the last record of an id wins."""
    base = scratch(spark)
    for arm in ("base", "wide"):
        rows = table(spark, sf, "nation").select("n_nationkey", "n_regionkey").orderBy("n_nationkey").collect()
        text = "\n".join(json.dumps({"id": r[1], "at": r[0], "value": r[0] + len(arm)}) for r in rows)
        W.write_bytes(spark, f"{base}/l2_{arm}.jsonl", text.encode())
    rows = R.arms(spark, base, "id bigint, at bigint, value bigint").withColumn("key", F.concat_ws(":", "arm", "id"))
    return S.last_write(rows, "key", ["at"]).select("arm", "id", "value")


def source_adapters(spark, sf):
    """Conversations, and each one's first question and answer, as one source."""
    c = C.gathered(table(spark, sf, "conversations"))
    chats = R.chat_turns(c.select(F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages")), "conversations", "messages")
    t = table(spark, sf, "conversations")
    ask = t.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("query"))
    answer = t.where("role = 'assistant'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("response"))
    pairs = R.two_fields(ask.join(answer, "conv_id"), "query", "response")
    both = R.union_sources([chats.withColumn("source", F.lit("chat")), None, pairs.withColumn("source", F.lit("pair"))])
    shown = F.md5(F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|"))
    return both.groupBy("source", shown.alias("digest")).agg(F.count("*").alias("n"), F.any_value(F.size("messages")).cast("bigint").alias("turns"))


def tool_source(spark, sf):
    """Dialogues with tools as text, some of them broken or empty."""
    c = C.gathered(table(spark, sf, "conversations"))
    tools = F.when(F.col("conv_id") % 4 == 0, "[]").when(F.col("conv_id") % 4 == 1, "{broken").when(F.col("conv_id") % 4 == 2, F.concat(F.lit('[{"name": "t'), "conv_id", F.lit('"}]')))
    path = scratch(spark) + "/tools.parquet"
    c.select("conv_id", F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.when(m["role"] != "system", m["content"]).alias("content"))).alias("messages"), tools.alias("tools")).write.parquet(path)
    back = R.tool_dialogues(spark, path)
    return back.select("tools", F.size("messages").cast("bigint").alias("turns"), F.aggregate("messages", F.lit(0), lambda a, m: a + F.length(m["content"])).cast("bigint").alias("chars"))


def negatives(spark, sf):
    """Positions 2 to 6 of each source, short texts alone."""
    d = table(spark, sf, "documents").where("text is not null and source is not null")
    return R.prefix_limited(d.select("source", "doc_id", "text"), "source", "doc_id", 2, 5, 4000, "text").select("source", "doc_id")


def checkpoint_scan(spark, sf):
    """A log of labelled documents against seeds of all; unknown, changed or repeated ids would raise."""
    seeds = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha"))
    log = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha"), "quality")
    return R.checkpoint_log(log, seeds, "id", "sha", ["id"], False).select("id", "quality")


def ledger_roundtrip(spark, sf):
    """Two batches of decisions, appended and read."""
    d = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "accept").otherwise("reject").alias("verdict"), F.lit("by quality").alias("reason"), F.lit(RUBRIC).alias("rubric_sha"))
    path, members = scratch(spark) + "/ledger", table(spark, sf, "documents").select("doc_id")
    W.append_ledger(d.where("doc_id % 2 = 0"), None, members, path, "doc_id", RUBRIC)
    W.append_ledger(d.where("doc_id % 2 = 1"), spark.read.parquet(path), members, path, "doc_id", RUBRIC)
    return spark.read.parquet(path).select("doc_id", "verdict")


def frozen_items(spark, sf):
    """Forty items of a seeded order."""
    return W.frozen_subset(table(spark, sf, "benchmark"), ["item_id"], "freeze", "item_id", 40).select("item_id")


def text_pool(spark, sf):
    """A hundred distinct texts by first appearance."""
    return S.distinct_pool(table(spark, sf, "documents"), "text", ["doc_id"], 100).select("doc_id", F.md5("value").alias("digest"))


def word_subsets(spark, sf):
    """One to four of the first words of each item."""
    b = table(spark, sf, "benchmark").select("item_id", F.array_distinct(F.slice(T.ascii_tokens(F.col("text")), 1, 12)).alias("w")).where("size(w) > 0")
    return b.select("item_id", F.array_join(S.random_subset(F.col("w"), F.col("item_id"), "pick", 1, 4), " ").alias("words"))


def report_lines(spark, sf):
    """K8: a profile by language as a table, one row a line."""
    rows = table(spark, sf, "documents").where("lang is not null").groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang")
    return spark.createDataFrame([(i, x) for i, x in enumerate(W.markdown(rows, "Languages").splitlines())], "line bigint, text string")


FIRST = "SELECT conv_id, min_by(text, turn) FILTER (role = 'user') AS q, min_by(text, turn) FILTER (role = 'assistant') AS a FROM conversations GROUP BY conv_id"
ORACLES = {
    "lines_roundtrip": "SELECT conv_id, turn, role, md5(text) AS digest FROM conversations",
    "split_roundtrip": "SELECT doc_id, CASE WHEN coalesce(length(text), 0) % 3 <> 0 THEN md5(text) END AS digest, coalesce(length(text), 0) % 3 <> 0 AS kept FROM documents",
    "array_scan": "SELECT item_id, md5(text) AS digest FROM benchmark",
    "arrow_scan": "SELECT item_id, md5(text) AS digest, 2 * count(*) AS n FROM benchmark GROUP BY ALL",
    "csv_scan": "SELECT 't/part' || n_nationkey % 2 || '.csv' AS member, n_nationkey::BIGINT AS nation, n_name AS name FROM nation",
    "items_scan": "SELECT 'r' || n_regionkey AS bench, n_nationkey::BIGINT AS id FROM nation",
    "rollout_arms": "SELECT arm, n_regionkey::BIGINT AS id, max(n_nationkey + length(arm))::BIGINT AS value FROM nation, (SELECT unnest(['base', 'wide']) AS arm) GROUP BY arm, n_regionkey",
    "source_adapters": f"""WITH t AS (SELECT conv_id, turn, role, text FROM conversations WHERE role IN ('user', 'assistant') AND coalesce(length(text), 0) > 0), c AS (SELECT conv_id, count(*) AS turns, md5(string_agg(role || ':' || text, '|' ORDER BY turn)) AS digest FROM t GROUP BY conv_id HAVING count(*) >= 2),
p AS (SELECT md5('user:' || q || '|assistant:' || a) AS digest FROM ({FIRST}) WHERE length(q) > 0 AND length(a) > 0) SELECT 'chat' AS source, digest, count(*) AS n, any_value(turns) AS turns FROM c GROUP BY digest UNION ALL SELECT 'pair', digest, count(*), 2 FROM p GROUP BY digest""",
    "tool_source": "SELECT '[{\"name\": \"t' || conv_id || '\"}]' AS tools, count(*) AS turns, coalesce(sum(length(text)) FILTER (role <> 'system'), 0)::BIGINT AS chars FROM conversations WHERE conv_id % 4 = 2 GROUP BY conv_id HAVING count(*) >= 2",
    "negatives": "SELECT source, doc_id FROM (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE text IS NOT NULL AND source IS NOT NULL) WHERE k BETWEEN 3 AND 7 AND length(text) <= 4000",
    "checkpoint_scan": "SELECT doc_id AS id, quality FROM labels JOIN documents USING (doc_id)",
    "ledger_roundtrip": "SELECT doc_id, CASE WHEN quality = 1 THEN 'accept' ELSE 'reject' END AS verdict FROM labels",
    "frozen_items": "SELECT item_id FROM benchmark ORDER BY md5('freeze:' || item_id), item_id LIMIT 40",
    "text_pool": "SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents WHERE text IS NOT NULL GROUP BY text ORDER BY 1 LIMIT 100",
    "word_subsets": """WITH w AS (SELECT item_id, regexp_extract_all(replace(lower(text), '_', ' '), '[a-z0-9]+')[1:12] AS a FROM benchmark), d AS (SELECT item_id, list_distinct(a) AS w FROM w WHERE len(a) > 0),
k AS (SELECT item_id, w, 1 + ('0x' || substr(md5('pickk:' || item_id), 1, 8))::BIGINT % least(4, len(w)) AS k FROM d), s AS (SELECT item_id, list_sort([md5('pick:' || item_id || ':' || x) || x FOR x IN w])[1:k] AS s FROM k) SELECT item_id, array_to_string([substr(x, 33) FOR x IN s], ' ') AS words FROM s""",
    "report_lines": "WITH l AS (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang), r AS (SELECT 3 + row_number() OVER (ORDER BY lang) AS line, '| ' || lang || ' | ' || n || ' |' AS text FROM l) SELECT line::BIGINT AS line, text FROM r UNION ALL VALUES (0, '# Languages'), (1, ''), (2, '| lang | n |'), (3, '|---|---|')",
}
QUERIES = {name: globals()[name] for name in ORACLES}
