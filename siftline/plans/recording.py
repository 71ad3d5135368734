"""Queries of record identity, masks and record joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.operators import records as R
from siftline.plans.fixtures import Fixture, Mixed
from siftline.session import table

IDS = Mixed(Fixture("id int, a string, b string", [(1, "x1", "u"), (2, " ", "u2"), (3, None, None)]), "documents", ("1000 + doc_id", "CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN '  ' END", "CASE doc_id % 2 WHEN 0 THEN lang END"), "TRUE")
INSTANCES = Mixed(
    Fixture("id int, iid string", [(1, "own__repo.abc123.func_pm__z9"), (2, "a__b.1f.lm_rewrite__q"), (3, "odd")]), "documents",
    ("1000 + doc_id", "concat('own', doc_id % 7, '__repo', doc_id % 5, '.', substr(md5(CAST(doc_id AS STRING)), 1, 8), '.', CASE doc_id % 3 WHEN 0 THEN 'func_pm_op' WHEN 1 THEN 'lm_rewrite' ELSE 'combine_file' END, '__', doc_id)"), "TRUE",
)
CAPS = Mixed(Fixture("id int, prompt int", [(1, 100), (2, 7000), (3, 9000)]), "documents", ("1000 + doc_id", "length(text)"))


def record_ids(spark, sf):
    return IDS.frame(spark, sf).select("id", R.record_id(F.lit("src"), F.col("id"), F.col("a"), F.col("b")).alias("record_id"))


def batch_prompts(spark, sf):
    """Batches of twenty items with id and digest."""
    b = table(spark, sf, "benchmark").select(F.floor(F.col("item_id") / 20).alias("no"), F.struct("item_id", "text").alias("r"))
    g = b.groupBy("no").agg(F.array_sort(F.collect_list("r")).alias("rs"), F.min("r.item_id").alias("lo"), F.max("r.item_id").alias("hi"))
    text = F.array_join(F.transform("rs", lambda r: r.text), "\n")
    bid = R.batch_id("bench", F.col("lo"), F.col("hi"), F.sha2(text, 256))
    return g.select(bid.alias("batch_id"), F.md5(R.batch_prompt("judge", "s", bid, F.transform("rs", lambda r: r.text))).alias("prompt"))


def instance_parse(spark, sf):
    return INSTANCES.frame(spark, sf).select("id", R.instance_parts(F.col("iid")).alias("p")).select("id", "p.*")


def token_caps(spark, sf):
    return CAPS.frame(spark, sf).select("id", R.token_cap(F.col("prompt"), 4096, 8192).cast("bigint").alias("cap"))


def generation_lengths(spark, sf):
    """P47, P48 on the benchmark's characters as token ids."""
    ids = F.transform(F.split("text", ""), lambda c: F.ascii(c))
    b = table(spark, sf, "benchmark").select("item_id", ids.alias("ids"))
    return b.select("item_id", R.generated_length(F.col("ids"), [46, 120]).cast("bigint").alias("n"), R.hit_cap(F.col("ids"), [120], 150).alias("capped"))


def label_masks(spark, sf):
    """Words as tokens, the quoted middle third as the supervised span."""
    t = table(spark, sf, "benchmark").select("item_id", F.length("text").alias("n"), F.transform(F.split("text", " "), lambda w: F.length(w)).alias("ws"))
    ends = F.aggregate("ws", F.array().cast("array<int>"), lambda a, w: F.array_append(a, F.coalesce(F.try_element_at(a, F.lit(-1)) + 1, F.lit(0)) + w))
    t = t.withColumn("e", ends).withColumn("tok", F.zip_with("e", "ws", lambda e, w: F.struct(w.alias("id"), (e - w).alias("start"), e.alias("end"))))
    spans = F.array(F.struct(F.floor(F.col("n") / 3).cast("int").alias("start"), F.floor(F.col("n") * 2 / 3).cast("int").alias("end")))
    labels = t.withColumn("spans", spans).select("item_id", R.masked_labels(F.col("tok"), F.col("spans")).alias("l"))
    return labels.select("item_id", F.size(F.filter("l", lambda x: x != -100)).cast("bigint").alias("supervised"), F.size("l").cast("bigint").alias("tokens"))


def tails_and_prefixes(spark, sf):
    """The last five words, and the words an item shares with the next one's start."""
    b = table(spark, sf, "benchmark").select("item_id", F.split("text", " ").alias("w"))
    nxt = b.select((F.col("item_id") - 1).alias("item_id"), F.col("w").alias("v"))
    return b.join(nxt, "item_id").select("item_id", F.array_join(R.tail(F.col("w"), 5), " ").alias("tail"), R.common_prefix(F.col("w"), F.col("v")).cast("bigint").alias("prefix"))


def paired_shared(spark, sf):
    """Labels against the documents' length class on shared ids."""
    l = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("bigint").alias("v"))
    d = table(spark, sf, "documents").select("doc_id", (F.length("text") > 1000).cast("bigint").alias("v"))
    return R.paired_shared(l, d, "doc_id", "v").groupBy("a", "b").agg(F.count("*").alias("n"))


def scored_subset(spark, sf):
    """Every labelled document has its text."""
    l, d = table(spark, sf, "labels"), table(spark, sf, "documents").select("doc_id", F.length("text").cast("bigint").alias("chars"))
    return R.scored_subset(l, d, "doc_id").select("doc_id", "quality", "chars")


def dataset_identity(spark, sf):
    keys = table(spark, sf, "documents").select("lang", F.sha2("text", 256).alias("k"))
    return R.identity(keys, "lang", "k")


WORDS = "SELECT item_id, string_split(text, ' ') AS w, text FROM benchmark"
ORACLES = {
    "record_ids": f"SELECT id, coalesce(nullif(trim(a), ''), nullif(trim(b), ''), substr(sha256('src'), 1, 12) || ':' || id) AS record_id FROM {IDS.sql}",
    "batch_prompts": "WITH g AS (SELECT item_id // 20 AS no, string_agg(text, chr(10) ORDER BY item_id) AS t, min(item_id) AS lo, max(item_id) AS hi FROM benchmark GROUP BY 1), b AS (SELECT *, 'bench-' || lpad(lo::VARCHAR, 9, '0') || '-' || lpad(hi::VARCHAR, 9, '0') || '-' || substr(sha256(t), 1, 12) AS id FROM g) SELECT id AS batch_id, md5('judge' || chr(10) || 'rubric_sha: s' || chr(10) || 'batch: ' || id || chr(10) || t) AS prompt FROM b",
    "instance_parse": f"SELECT id, replace(split_part(iid, '.', 1), '__', '/') AS repo, split_part(iid, '.', 2) AS commit, split_part(iid, '.', 1) || '.' || split_part(iid, '.', 2) AS mirror, regexp_replace(split_part(iid, '.', 3), '__[^_]*$', '') AS strategy FROM {INSTANCES.sql}",
    "token_caps": f"SELECT id, greatest(512, least(4096, 8192 - prompt - 600))::BIGINT AS cap FROM {CAPS.sql}",
    "generation_lengths": "SELECT item_id, CASE WHEN coalesce(nullif(instr(text, '.'), 0), nullif(instr(text, 'x'), 0)) IS NULL THEN length(text) ELSE least(coalesce(nullif(instr(text, '.'), 0), 1000000), coalesce(nullif(instr(text, 'x'), 0), 1000000)) END AS n, length(text) >= 150 AND NOT contains(text, 'x') AS capped FROM benchmark",
    "label_masks": f"WITH t AS (SELECT item_id, length(text) AS n, w, unnest(range(1, len(w) + 1)) AS i FROM ({WORDS})), e AS (SELECT item_id, n, length(w[i]) AS l, length(array_to_string(w[1:i], ' ')) AS e FROM t) SELECT item_id, count(*) FILTER (l > 0 AND e - l >= n // 3 AND e <= floor(n * 2 / 3)) AS supervised, count(*) AS tokens FROM e GROUP BY item_id",
    "tails_and_prefixes": f"WITH w AS ({WORDS}) SELECT a.item_id, array_to_string(a.w[-5:], ' ') AS tail, coalesce(list_position([a.w[i] = b.w[i] FOR i IN range(1, least(len(a.w), len(b.w)) + 1)], FALSE) - 1, least(len(a.w), len(b.w)))::BIGINT AS prefix FROM w a JOIN w b ON b.item_id = a.item_id + 1",
    "paired_shared": "SELECT quality::BIGINT AS a, (length(text) > 1000)::BIGINT AS b, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL",
    "scored_subset": "SELECT doc_id, quality, length(text) AS chars FROM labels JOIN documents USING (doc_id)",
    "dataset_identity": "WITH k AS (SELECT lang, sha256(text) AS k FROM documents), b AS (SELECT lang, substr(sha256(k), 1, 4) AS bucket, count(*) AS n, sha256(coalesce(string_agg(k, chr(10) ORDER BY k), '')) AS d FROM k GROUP BY ALL) SELECT lang, sum(n)::BIGINT AS n, sha256(string_agg(bucket || d, chr(10) ORDER BY bucket)) AS identity FROM b WHERE bucket IS NOT NULL GROUP BY lang",
}
QUERIES = {name: globals()[name] for name in ORACLES}
