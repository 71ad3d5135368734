"""Queries of instructions, batches and programs."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import text as T
from siftline.operators import authoring as A
from siftline.operators import toolcalls as C
from siftline.plans.texts import CHECKS, SAMPLES
from siftline.session import table


def instruction_seeds(spark, sf):
    """A bundle of constraints for each document."""
    d = table(spark, sf, "documents").select("doc_id", A.bundle_of(F.col("doc_id")).alias("b")).select("doc_id", "b.*")
    return A.native_enough(d, "group").select("doc_id", "name", "group", F.array_join("types", ",").alias("types"), F.array_join("wording", "；").alias("wording"))


def response_faults(spark, sf):
    """What the samples and all documents break of their bundle, some of them contaminated or null."""
    s = SAMPLES.frame(spark, sf)
    response = F.when(F.col("id") % 13 != 5, F.col("text"))
    f = s.select("id", A.response_faults(F.col("id"), response, F.col("id") % 17 == 3).alias("f"))
    return f.select(F.explode(F.when(F.size("f") > 0, F.col("f")).otherwise(F.array(F.lit("accepted")))).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def trainer_pairs(spark, sf):
    """Two turns where a document has both a text and a language."""
    m = A.two_turns(F.coalesce("lang", F.lit("?")), F.when(F.col("doc_id") % 5 > 0, F.col("text")))
    d = table(spark, sf, "documents").select("doc_id", m.alias("m")).where("m is not null")
    return d.select("doc_id", F.md5(F.array_join(F.transform("m", lambda t: F.concat(t["role"], F.lit(":"), t["content"])), "|")).alias("digest"))


def judge_rows(spark, sf):
    """P41."""
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("?")).alias("question"), F.col("source").alias("subset_name"), F.when(F.col("doc_id") % 3 == 0, F.lit("[]")).alias("available_tools"), F.lit(1).alias("quality"))
    out = A.judge_projection(d, "doc_id")
    return out.select("doc_id", "subset_name", F.md5(F.coalesce("question", F.lit("-"))).alias("question"), "tools")


def pilot_report(spark, sf):
    """each item's first word as literal, its second as a name that must not leak, in a request of some of its words."""
    w = F.split("text", " ")
    b = table(spark, sf, "benchmark").select("item_id", F.array_join(F.slice(w, 1, 3), " ").alias("full"), F.array(w[0]).alias("literals"), F.array(w[3]).alias("names"), F.array_join(F.slice(w, 2, 4), " ").alias("part"))
    return A.pilot_report(b.withColumn("request", F.when(F.col("item_id") % 3 == 0, F.col("part")).otherwise(F.col("full"))), "request", "literals", "names")


def rollout_totals(spark, sf):
    """Events as rollouts of their users."""
    e = table(spark, sf, "events").select("user_id", (F.floor("value") / 4).alias("strict"), (F.floor(F.col("value") * 2) / 4).alias("lenient"), (F.col("event_type") != "error").alias("ok"))
    return A.rollout_totals(e, "user_id", "strict", "lenient", "ok")


def gold_fixes(spark, sf):
    """A patch of each document taken back; one in five doesn't fit."""
    n = F.col("n").cast("string")
    d = table(spark, sf, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    body = F.concat(F.lit("a\nsize "), F.when(F.col("doc_id") % 5 == 0, F.lit("?")).otherwise(n), F.lit("\nz\n"))
    patch = F.concat(F.lit("--- a/f\n+++ b/f\n@@ -1,3 +1,3 @@\n a\n-size old\n+size "), n, F.lit("\n z\n"))
    fixed = A.gold_fix(d.select("doc_id", F.create_map(F.lit("f"), body, F.lit("g"), n).alias("files"), patch.alias("patch")), "doc_id", "files", "patch")
    return fixed.select("doc_id", F.col("fixed")["f"].alias("f"), F.col("fixed")["g"].alias("g"), F.col("error").isNotNull().alias("failed"))


def program_texts(spark, sf):
    """Y52, Y53."""
    i, code = F.col("item_id").cast("string"), F.concat(F.lit("def f"), F.col("item_id").cast("string"), F.lit("(): pass"))
    a = A.check_program(code, F.lit("def check(c): c()"), F.concat(F.lit("f"), i))
    b = A.assert_program(code, F.when(F.col("item_id") % 2 == 0, "import math").otherwise(" "), F.array(F.concat(F.lit("assert f"), i, F.lit("()")), F.lit("assert True")))
    return table(spark, sf, "benchmark").select("item_id", F.md5(a).alias("check_digest"), F.md5(b).alias("assert_digest"))


def seed_batches(spark, sf):
    """Rows of both batches by tier."""
    s = C.seed_plans(spark, table(spark, sf, "documents").count())
    s = s.withColumn("request", C.request_of(F.col("pattern"), F.col("plan"), F.col("links")))
    p = A.paraphrase_batch(s).select(F.lit("paraphrase").alias("batch"), "tier", F.size("derived").alias("derived"))
    a = A.audit_batch(s).select(F.lit("audit").alias("batch"), "tier", F.when(F.contains("prompt", F.lit("Expected calls: [{")), 0).alias("derived"))
    return p.unionByName(a).groupBy("batch", "tier").agg(F.count("*").alias("n"), F.sum("derived").alias("derived"))


def think_scores(spark, sf):
    """Thinking length of each turn, and whether what follows is a JSON object."""
    text = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<think>"), "text", F.lit('</think>{"calls": ['), "turn", F.lit("]}"))).otherwise(F.col("text"))
    t = table(spark, sf, "conversations").where("text is not null").select("conv_id", "turn", T.think_split(text).alias("s"))
    return t.select("conv_id", "turn", F.col("s.chars").alias("chars"), F.col("s.closed").alias("closed"), F.coalesce(F.schema_of_variant(F.try_parse_json("s.payload")).startswith("OBJECT"), F.lit(False)).alias("passed"))


def _check(c: dict) -> str:
    sql = CHECKS[c["type"]]
    swaps = {"char_range": ("BETWEEN 5 AND 12", f"BETWEEN {c.get('min')} AND {c.get('max')}")}
    if c["type"] == "keyword_count":
        return f"(length(text) - length(replace(text, '{c['keyword']}', ''))) / {len(c['keyword'])} = {c['count']}"
    return sql.replace(*swaps.get(c["type"], ("", ""))) if c["type"] in swaps else sql


FAULTS = " ".join(f"WHEN {k} THEN list_filter([{', '.join(f'''CASE WHEN NOT coalesce({_check(c)}, FALSE) THEN '{c['type']}' END''' for c in b[1])}], lambda q: q IS NOT NULL)" for k, b in enumerate(A.BUNDLES))
PICK = lambda f: "[" + ", ".join("'" + f(b) + "'" for b in A.BUNDLES) + "][doc_id % 10 + 1]"
ORACLES = {
    "instruction_seeds": f"""SELECT doc_id, {PICK(lambda b: b[0])} AS name, {PICK(lambda b: b[2])} AS "group", {PICK(lambda b: ','.join(c['type'] for c in b[1]))} AS types, {PICK(lambda b: '；'.join(map(A.constraint_text, b[1])))} AS wording FROM documents""",
    "response_faults": f"""WITH s AS (SELECT id, text FROM {SAMPLES.sql}), f AS (SELECT CASE WHEN id % 17 = 3 THEN ['contamination_8gram'] WHEN id % 13 = 5 OR text IS NULL THEN ['no_passing_candidate'] ELSE CASE id % 10 {FAULTS} END END AS f FROM s)
SELECT reason, count(*) AS n FROM (SELECT unnest(CASE WHEN len(f) > 0 THEN f ELSE ['accepted'] END) AS reason FROM f) GROUP BY reason""",
    "trainer_pairs": "SELECT doc_id, md5('user:' || coalesce(lang, '?') || '|assistant:' || text) AS digest FROM documents WHERE text IS NOT NULL AND doc_id % 5 > 0",
    "judge_rows": "SELECT doc_id, nullif(source, '') AS subset_name, md5(coalesce(nullif(coalesce(text, '?'), ''), '-')) AS question, CASE WHEN doc_id % 3 = 0 THEN '[]' END AS tools FROM documents WHERE coalesce(text, '?') <> ''",
    "pilot_report": """WITH b AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark), r AS (SELECT CASE WHEN item_id % 3 = 0 THEN array_to_string(w[2:5], ' ') ELSE array_to_string(w[1:3], ' ') END AS r, w[1] AS l, w[4] AS n FROM b),
f AS (SELECT NOT contains(r, l) AS missing, contains(r, n) AS leaked FROM r) SELECT count(*) AS n, count(*) FILTER (NOT missing AND NOT leaked) AS ok, count(*) FILTER (missing) AS literal_missing, count(*) FILTER (leaked) AS name_leak, round(count(*) FILTER (NOT missing AND NOT leaked) / count(*), 4) AS ok_rate FROM f""",
    "rollout_totals": """WITH e AS (SELECT user_id, floor(value) / 4 AS strict, floor(value * 2) / 4 AS lenient, event_type <> 'error' AS ok FROM events), p AS (SELECT user_id, count(*) AS n, count(*) FILTER (ok) AS k, sum(strict) AS ss, max(strict) AS bs, sum(lenient) AS sl, max(lenient) AS bl FROM e GROUP BY user_id)
SELECT sum(n)::BIGINT AS total, sum(k)::BIGINT AS fmt_ok, round(sum(ss), 6) AS strict_sum, round(sum(bs), 6) AS strict_best, round(sum(sl), 6) AS lenient_sum, round(sum(bl), 6) AS lenient_best FROM p""",
    "gold_fixes": """WITH d AS (SELECT doc_id, coalesce(length(text), 0)::VARCHAR AS n FROM documents), b AS (SELECT doc_id, n, 'a' || chr(10) || 'size ' || CASE WHEN doc_id % 5 = 0 THEN '?' ELSE n END || chr(10) || 'z' || chr(10) AS body, chr(10) || 'a' || chr(10) || 'size ' || n || chr(10) || 'z' AS want FROM d)
SELECT doc_id, CASE WHEN contains(chr(10) || body, want) THEN substr(replace(chr(10) || body, want, chr(10) || 'a' || chr(10) || 'size old' || chr(10) || 'z'), 2) END AS f, CASE WHEN contains(chr(10) || body, want) THEN n END AS g, NOT contains(chr(10) || body, want) AS failed FROM b""",
    "program_texts": "WITH p AS (SELECT item_id, 'def f' || item_id || '(): pass' AS c, chr(10) AS l FROM benchmark) SELECT item_id, md5(c || l || l || 'def check(c): c()' || l || l || 'check(f' || item_id || ')' || l) AS check_digest, md5(c || l || l || CASE WHEN item_id % 2 = 0 THEN 'import math' || l || l ELSE '' END || 'assert f' || item_id || '()' || l || 'assert True' || l) AS assert_digest FROM p",
    "think_scores": """WITH t AS (SELECT conv_id, turn, text, turn % 2 = 0 AS c FROM conversations WHERE text IS NOT NULL) SELECT conv_id, turn, CASE WHEN c THEN length(text) ELSE 0 END AS chars, c AS closed, coalesce(CASE WHEN json_valid(CASE WHEN c THEN '{"calls": [' || turn || ']}' ELSE text END) THEN json_type(CASE WHEN c THEN '{"calls": [' || turn || ']}' ELSE text END) = 'OBJECT' END, FALSE) AS passed FROM t""",
}
ROWS_ONLY = ("seed_batches",)
QUERIES = {name: globals()[name] for name in (*ORACLES, *ROWS_ONLY)}
