"""Queries of sampling, ranking, ledgers and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.operators import selection as S
from siftline.operators.common import hash_order
from siftline.session import table

LANGS = ["en", "fr", "de", "es"]
MIX = {"en": 0.5, "fr": 0.25, "de": 0.15, "es": 0.1}
DECISION = "CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'accept' WHEN l.toxic = 1 THEN 'reject' ELSE 'borderline' END"


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", "source")


def stratified_sample(spark, sf):
    return S.stratified(_docs(spark, sf), "lang", "doc_id", S.even_quotas(50, LANGS), "s1")


def largest_remainder(spark, sf):
    """Quotas of a mix, taken in hash order."""
    return S.stratified(_docs(spark, sf), "lang", "doc_id", S.largest_remainder(37, MIX), "s2")


def roundrobin_interleave(spark, sf):
    return S.interleaved(_docs(spark, sf), "lang", "doc_id", 60).select("position", "lang", "doc_id")


def last_write_wins(spark, sf):
    return S.last_write(table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


def shortest_passed(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", F.get_json_object("props", "$.k").cast("long").alias("chars"), "event_type")
    return S.shortest_passed(e, "user_id", "chars", "event_id", F.col("event_type") == "purchase")


def first_valid(spark, sf):
    e = table(spark, sf, "events")
    reason = F.when(F.col("event_type") == "error", "error").when(F.col("value") > 30, "too_large")
    return S.first_valid(e, "user_id", "event_id", reason)


def resume_antijoin(spark, sf):
    """Documents without a label, by source."""
    return _docs(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("pending"), F.min("doc_id").alias("next_id"))


def resume_retry(spark, sf):
    """Not completed, or completed with a failure."""
    j = _docs(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left").where("quality is null or toxic = 1")
    return j.select("doc_id", F.when(F.col("quality").isNull(), "new").otherwise("retry").alias("why"))


def sidecar_join(spark, sf):
    """Main rows with their sidecar; unmatched ones are skipped."""
    d = table(spark, sf, "documents").select("doc_id", F.length("text").alias("chars"))
    return d.join(table(spark, sf, "labels"), "doc_id").groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))


def judge_batches(spark, sf):
    return S.batches(_docs(spark, sf), table(spark, sf, "labels"), "doc_id", 20)


def judge_summary(spark, sf):
    l = table(spark, sf, "labels")
    v = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "accept").when(F.col("toxic") == 1, "reject").otherwise("borderline")
    return S.verdict_summary(l, v, ["accept", "reject", "borderline"])


def strata_counts(spark, sf):
    """Counts for every tier of the plan, zeros included."""
    tiers = spark.createDataFrame([(x,) for x in (*LANGS, "ja")], "lang string")
    n = _docs(spark, sf).groupBy("lang").agg(F.count("*").alias("n"))
    return F.broadcast(tiers).join(n, "lang", "left").select("lang", F.coalesce("n", F.lit(0)).alias("n"))


def validation_split(spark, sf):
    return S.split_last(_docs(spark, sf), "doc_id", 0.02, 500, "s3")


def worker_split(spark, sf):
    """Alternate positions go to two workers."""
    p = S.positions(_docs(spark, sf).select("doc_id"), "doc_id")
    return p.groupBy(F.pmod("position", F.lit(2)).alias("worker")).agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def weighted_style(spark, sf):
    """A stable pick by cumulative weight of a hash of the id."""
    u = F.conv(F.substring(hash_order("s4", F.col("doc_id")), 1, 8), 16, 10).cast("double") / 4294967296.0
    style = F.when(u < 0.5, "plain").when(u < 0.8, "formal").otherwise("terse")
    return _docs(spark, sf).groupBy(style.alias("style"), "lang").agg(F.count("*").alias("n"))


def replay_mix(spark, sf):
    """round(r / (1 - r) * n) replayed rows, halves up, drawn with replacement by hashing their number."""
    docs = _docs(spark, sf).select("doc_id")
    n = docs.count()
    k = (n + 2) // 4  # r = 0.2
    draw = spark.range(k).select("id", F.pmod(F.conv(F.substring(hash_order("s5", F.col("id")), 1, 8), 16, 10).cast("long"), F.lit(max(n, 1))).alias("position"))
    replay = draw.join(S.positions(docs, "doc_id"), "position")
    count = lambda rows, origin: rows.agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids")).select(F.lit(origin).alias("origin"), "n", "ids")
    return count(docs, "new").unionByName(count(replay, "replay"))


def freshness(spark, sf):
    """Users whose last event is within 120 seconds of the newest one."""
    e = table(spark, sf, "events")
    newest = e.agg(F.max("ts")).first()[0]
    last = e.groupBy("user_id").agg(F.max("ts").alias("ts"))
    return last.select("user_id", (F.timestamp_diff("SECOND", "ts", F.lit(newest)) <= 120).alias("fresh"))


def _taken(quotas: dict[str, int], seed: str) -> str:
    limits = " ".join(f"WHEN '{k}' THEN {v}" for k, v in quotas.items())
    return f"SELECT doc_id, lang, source FROM (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang ORDER BY md5('{seed}:' || doc_id), doc_id) AS i FROM documents) WHERE i <= CASE lang {limits} ELSE 0 END"


POS = "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents"
HEX = "('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT"
ORACLES = {
    "stratified_sample": _taken(S.even_quotas(50, LANGS), "s1"),
    "largest_remainder": _taken(S.largest_remainder(37, MIX), "s2"),
    "roundrobin_interleave": "SELECT position, lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (ORDER BY i, lang) AS position FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM documents WHERE lang IS NOT NULL)) WHERE position <= 60",
    "last_write_wins": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events) WHERE i = 1",
    "shortest_passed": "SELECT user_id, chars, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY chars, event_id) AS i FROM (SELECT user_id, event_id, json_extract_string(props, '$.k')::BIGINT AS chars FROM events WHERE event_type = 'purchase')) WHERE i = 1",
    "first_valid": "WITH r AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 'error' WHEN value > 30 THEN 'too_large' END AS reason FROM events), b AS (SELECT user_id, min(event_id) FILTER (reason IS NULL) AS chosen, count(*) AS candidates FROM r GROUP BY user_id) SELECT b.*, (SELECT count(*) FROM r WHERE r.user_id = b.user_id AND reason IS NOT NULL AND (chosen IS NULL OR event_id < chosen)) AS rejected_before FROM b",
    "resume_antijoin": "SELECT source, count(*) AS pending, min(doc_id) AS next_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY source",
    "resume_retry": "SELECT d.doc_id, CASE WHEN quality IS NULL THEN 'new' ELSE 'retry' END AS why FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE quality IS NULL OR toxic = 1",
    "sidecar_join": "SELECT quality, toxic, count(*) AS n, sum(length(text)) AS chars FROM documents JOIN labels USING (doc_id) GROUP BY ALL",
    "judge_batches": "SELECT batch, min(doc_id) AS first, max(doc_id) AS last, count(*) AS n FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 20 AS batch FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) GROUP BY batch",
    "judge_summary": f"SELECT count(*) AS n, count(*) FILTER (v = 'accept') AS accept, count(*) FILTER (v = 'reject') AS reject, count(*) FILTER (v = 'borderline') AS borderline, round(count(*) FILTER (v = 'accept') / nullif(count(*), 0), 6) AS accept_rate FROM (SELECT {DECISION} AS v FROM labels l)",
    "strata_counts": "SELECT t.lang, count(d.doc_id) AS n FROM (VALUES ('en'), ('fr'), ('de'), ('es'), ('ja')) t(lang) LEFT JOIN documents d ON d.lang = t.lang GROUP BY t.lang",
    "validation_split": "SELECT doc_id, row_number() OVER (ORDER BY md5('s3:' || doc_id), doc_id) <= least(greatest(1, floor(count(*) OVER () * 0.02)), 500) AS is_val FROM documents",
    "worker_split": f"SELECT position % 2 AS worker, count(*) AS n, sum(doc_id) AS ids FROM ({POS}) GROUP BY 1",
    "weighted_style": f"SELECT CASE WHEN u < 0.5 THEN 'plain' WHEN u < 0.8 THEN 'formal' ELSE 'terse' END AS style, lang, count(*) AS n FROM (SELECT lang, {HEX.format(seed='s4', key='doc_id')} / 4294967296.0::DOUBLE AS u FROM documents) GROUP BY ALL",
    "replay_mix": f"WITH p AS ({POS}), k AS (SELECT round(0.25 * count(*))::BIGINT AS k, count(*) AS n FROM documents), r AS (SELECT {HEX.format(seed='s5', key='i')} % n AS position FROM k, range(0, (SELECT k FROM k)) t(i)) SELECT 'new' AS origin, count(*) AS n, sum(doc_id) AS ids FROM documents UNION ALL SELECT 'replay', count(*), sum(doc_id) FROM r JOIN p USING (position)",
    "freshness": "SELECT user_id, max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 120 SECOND OR date_diff('second', max(ts), (SELECT max(ts) FROM events)) <= 120 AND epoch((SELECT max(ts) FROM events)) - epoch(max(ts)) < 121 AS fresh FROM events GROUP BY user_id",
}
QUERIES = {name: globals()[name] for name in ORACLES}
