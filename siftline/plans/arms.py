"""Queries of arms, prompt selection and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import text as T
from siftline.operators import arms as A
from siftline.operators import packing as K
from siftline.operators import prompts as P
from siftline.session import table

#: Columns that both engines read.
SEEDED = {"arm": "coalesce(lang, 'none')", "item": "doc_id", "ok": "(doc_id * (seed + 3)) % 7 < 3", "cut": "(doc_id + seed) % 11 = 0"}
PART = {"model": "event_type", "worker": "event_id % 2", "pos": "CASE WHEN user_id % 3 > 0 THEN 1 ELSE 0 END", "hit": "CASE WHEN user_id % 3 > 0 AND event_id % 4 > 0 THEN 1 ELSE 0 END"}
PROBE = {
    "arm": "CASE doc_id % 4 WHEN 0 THEN 'P' WHEN 1 THEN 'F_system' WHEN 2 THEN 'F_user' ELSE 'F_user_prefill' END", "pi": "doc_id % 97", "method": "CASE coalesce(length(text), 0) % 3 WHEN 0 THEN 'search_replace' WHEN 1 THEN 'diff_fallback' ELSE 'format_fail' END",
    "strict": "CASE WHEN coalesce(length(text), 0) % 3 = 2 THEN -1.0e0 ELSE (doc_id % 9) / 8.0e0 END", "lenient": "(doc_id % 5) / 4.0e0", "finish": "CASE WHEN coalesce(length(text), 0) % 5 = 0 THEN 'length' ELSE 'stop' END",
    "think_open": "doc_id % 3", "tags_ok": "doc_id % 2 = 0", "marker": "doc_id % 6 > 1", "format_valid": "coalesce(length(text), 0) % 3 < 2",
}
IID = "concat('own', doc_id % 9, '__repo', doc_id % 11, '.', substr(md5(CAST(doc_id % 200 AS STRING)), 1, 8), '.func_pm__', doc_id % 150)"
BASE = {
    "instance_id": IID, "ord": "doc_id", "problem": "CASE doc_id % 5 WHEN 0 THEN ' ' ELSE 'why' END",
    "patch": "CASE WHEN doc_id % 97 = 0 THEN repeat('diff --git a/f b/f ', 6000) ELSE CASE doc_id % 7 WHEN 0 THEN ' ' WHEN 1 THEN 'GIT binary patch' WHEN 2 THEN NULL WHEN 3 THEN 'no file @@' ELSE concat('diff --git a/f', doc_id, ' b/f', chr(10), '@@') END END",
}
VERIFIED = {"instance_id": IID, "repo": "concat('own', doc_id % 9, '/repo', doc_id % 11)", "base_commit": "concat(substr(md5(CAST(doc_id % 200 AS STRING)), 1, 8), 'ffff')"}
PATH = "CASE doc_id % 4 WHEN 0 THEN concat('in/toucan-1.5m/', source) WHEN 1 THEN 'in/tau-train-query.jsonl' WHEN 2 THEN concat('toolmind/', source, '/x') ELSE source END"


def _read(spark, sf, name: str, columns: dict[str, str], where: str = "true"):
    return table(spark, sf, name).where(where).selectExpr(*(f"{x} AS {n}" for n, x in columns.items()))


def _sql(name: str, columns: dict[str, str], where: str = "true") -> str:
    return f"(SELECT {', '.join(f'{x} AS {n}' for n, x in columns.items())} FROM {name} WHERE {where})"


def arm_summary(spark, sf):
    """Three seeds of every document, by language."""
    d = table(spark, sf, "documents").withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return A.arm_summary(d.selectExpr("seed", *(f"{x} AS {n}" for n, x in SEEDED.items())), ["arm"], "seed", "item", "ok", "cut", 3)


def _parts(spark, sf):
    e = table(spark, sf, "events").selectExpr("value", *(f"{x} AS {n}" for n, x in PART.items()))
    hit, neg = F.sum("hit"), F.sum(1 - F.col("pos"))
    return e.groupBy("model", "worker").agg(F.sum("pos").alias("n_pos"), neg.alias("n_neg"), hit.alias("format_valid"), hit.alias("name_match"), F.floor(hit / 2).alias("arg_match"), F.floor(neg / 3).alias("over_trigger"), F.count("*").alias("gen_tokens"), F.sum("value").alias("gen_time"))


def call_eval(spark, sf):
    """A28."""
    return A.call_eval(_parts(spark, sf), ["model"])


def k_sweep(spark, sf):
    """A29."""
    p = _parts(spark, sf).select(F.length("model").cast("bigint").alias("k"), F.col("format_valid").alias("correct"), F.col("n_pos").alias("n"), "gen_tokens", "gen_time")
    return A.k_sweep(p, "k", 3)


def format_probe_table(spark, sf):
    """Y45."""
    return A.format_probe(_read(spark, sf, "documents", PROBE), "arm", "pi")


def near_misses(spark, sf):
    """Outputs that lack the opening tag alone, by finish."""
    text = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("</think><solution>x</solution><<<<<<< SEARCH"))).otherwise(F.concat(F.lit("<think>"), "text", F.lit("</think><solution>x</solution>")))
    finish = F.when(F.col("doc_id") % 4 == 0, "length").otherwise("stop")
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", A.near_miss(T.tag_flags(text), finish).alias("near"))
    return d.groupBy("near").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def structured_verdicts(spark, sf):
    """Two arms over all documents, on being right and on being cut."""
    arm = lambda k: _read(spark, sf, "documents", {"item": "doc_id", "correct": f"(doc_id * {k}) % 7 < 3", "truncated": f"(doc_id + {k}) % 11 = 0"})
    return A.structured_verdicts(arm(3), arm(5), "item")


def strict_instructions(spark, sf):
    """Labelled documents whose every line passes."""
    raw = table(spark, sf, "documents").select("doc_id", F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda l: F.length(l) < 400).alias("follows"), (F.length("text") > 2000).alias("cut"))
    return A.followed(table(spark, sf, "labels").select("doc_id"), raw, "doc_id", "follows", "cut")


def prompt_selection(spark, sf):
    """The first drop reason of every resolved row."""
    rows = _read(spark, sf, "documents", {"instance_id": IID, "ord": "doc_id"}, "coalesce(length(text), 0) % 5 <> 0")
    base = P.gold_patches(_read(spark, sf, "documents", BASE, "doc_id % 3 <> 0"), rows, "instance_id", ["ord"], "patch", "problem")
    tasks = table(spark, sf, "documents").where("doc_id % 11 = 7").selectExpr("concat('repo', doc_id % 11) AS name").distinct()
    return P.selection(rows, base, _read(spark, sf, "documents", VERIFIED, "doc_id % 41 = 0"), tasks).select(F.col("ord").alias("doc_id"), "reason")


def prompt_reconciliation(spark, sf):
    """Rows of each reason, and in all."""
    return prompt_selection(spark, sf).rollup("reason").agg(F.count("*").alias("n"))


def gold_patches(spark, sf):
    """The first base row of each wanted id."""
    base = _read(spark, sf, "documents", BASE, "doc_id % 3 <> 0")
    return P.gold_patches(base, _read(spark, sf, "documents", {"instance_id": IID}, "doc_id % 2 = 0"), "instance_id", ["ord"], "patch", "problem").select("instance_id", F.md5("patch").alias("patch"), "problem")


def commit_prefixes(spark, sf):
    """Rows whose short commit fits a verified commit of the repository, by either rule."""
    rows = _read(spark, sf, "documents", {"doc_id": "doc_id", "repo": VERIFIED["repo"], "short": "substr(md5(CAST(doc_id % 200 AS STRING)), 1, 4 + doc_id % 12)"})
    _, commits = P.eval_keys(_read(spark, sf, "documents", VERIFIED, "doc_id % 41 = 0"))
    return rows.join(commits, "repo").select("doc_id", P.same_commit(F.col("short"), F.col("commits")).alias("begins"), P.same_commit(F.col("short"), F.col("commits"), either=True).alias("either"))


def strategy_labels(spark, sf):
    """P32b, P32c."""
    iid = F.expr("concat('o__r.', substr(md5(CAST(doc_id AS STRING)), 1, 8), '.', CASE doc_id % 3 WHEN 0 THEN 'func_pm_op__z' WHEN 1 THEN 'lm_rewrite__q__r' ELSE '77x' END, doc_id % 13)")
    d = table(spark, sf, "documents").select(P.strategy_v0(iid).alias("v0"), P.strategy_relabelled(iid).alias("relabelled"))
    return d.groupBy("v0", "relabelled").agg(F.count("*").alias("n"))


def source_licenses(spark, sf):
    """P38."""
    d = table(spark, sf, "documents").select(P.source_license(F.expr(PATH)).alias("l"))
    return d.groupBy("l.group", "l.status", "l.label").agg(F.count("*").alias("n"))


def row_merge(spark, sf):
    """Every document with its label row; labels are made for all here."""
    d = table(spark, sf, "documents")
    return P.merged(d.select("doc_id", F.length("text").cast("bigint").alias("chars")), d.select("doc_id", "source"), "doc_id")


def turn_labels(spark, sf):
    """Words of each turn as tokens; those of assistant turns are supervised."""
    t = table(spark, sf, "conversations").select("conv_id", F.struct("turn", "role", F.transform(F.split(F.coalesce("text", F.lit("")), " "), lambda w: F.length(w)).alias("ids")).alias("t"))
    c = t.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    c = c.select("conv_id", K.turn_labels(F.transform("ts", lambda x: x["ids"]), F.transform("ts", lambda x: x["role"])).alias("l"))
    return c.select("conv_id", F.size("l").cast("bigint").alias("n"), F.size(F.filter("l", lambda x: x != -100)).cast("bigint").alias("supervised"))


SEED_ROWS = f"r AS (SELECT seed, {', '.join(f'{x} AS {n}' for n, x in SEEDED.items())} FROM (SELECT *, unnest(range(0, 3)) AS seed FROM documents))"
PARTS = f"""p AS (SELECT model, worker, sum(pos) AS n_pos, sum(1 - pos) AS n_neg, sum(hit) AS hit, floor(sum(hit) / 2) AS half, floor(sum(1 - pos) / 3) AS over_trigger, count(*) AS gen_tokens, sum(value) AS gen_time
FROM (SELECT value, {', '.join(f'{x} AS {n}' for n, x in PART.items())} FROM events) GROUP BY model, worker)"""


def _ci(share: str, n: str) -> str:
    return f"round(1.96 * sqrt(greatest({share} * (1 - {share}), 0) / {n}), 4)"


def _rates() -> str:
    out = []
    for name, part, n in (("format_validity", "hit", "n_pos"), ("name_acc", "hit", "n_pos"), ("arg_acc", "half", "n_pos"), ("over_trigger_rate", "over_trigger", "n_neg")):
        share = f"round({part} / {n}, 4)"
        out += [f"{share} AS {name}", f"{_ci(share, n)} AS {name}_ci95"]
    return ", ".join(out)


ORACLES = {
    "arm_summary": f"""WITH {SEED_ROWS}, s AS (SELECT arm, seed, avg(ok::INT) AS rate, count(*) FILTER (cut) AS t FROM r GROUP BY arm, seed), i AS (SELECT arm, item, count(*) FILTER (ok) AS p, count(*) AS k FROM r GROUP BY arm, item),
o AS (SELECT arm, round(avg(rate), 6) AS pass_rate, round(stddev_samp(rate), 6) AS seed_sd, sum(t)::BIGINT AS truncated FROM s GROUP BY arm) SELECT o.*, n, agreement FROM o JOIN (SELECT arm, count(*) AS n, round(avg(round((p * (p - 1) + (k - p) * (k - p - 1)) / (k * (k - 1)), 6)), 6) AS agreement FROM i GROUP BY arm) USING (arm)""",
    "call_eval": f"WITH {PARTS}, g AS (SELECT model, sum(n_pos)::BIGINT AS n_pos, sum(n_neg)::BIGINT AS n_neg, sum(hit) AS hit, sum(half) AS half, sum(over_trigger) AS over_trigger, sum(gen_tokens)::BIGINT AS gen_tokens, sum(gen_time) AS total, max(gen_time) AS longest FROM p GROUP BY model) SELECT model, n_pos, n_neg, {_rates()}, gen_tokens, round(gen_tokens / total, 2) AS tok_s, round(gen_tokens / longest, 2) AS tok_s_parallel FROM g",
    "k_sweep": f"WITH {PARTS}, g AS (SELECT length(model)::BIGINT AS k, count(*) AS parts, sum(hit)::BIGINT AS correct, sum(n_pos)::BIGINT AS n, sum(gen_tokens)::BIGINT AS gen_tokens, sum(gen_time) AS total, max(gen_time) AS longest FROM p GROUP BY 1) SELECT k, round(correct / n, 4) AS acc, correct, n, gen_tokens, round(gen_tokens / total, 2) AS tok_s, round(gen_tokens / longest, 2) AS tok_s_parallel, round(total, 1) AS gen_time_sum_s FROM g WHERE parts >= 3",
    "format_probe_table": f"""WITH r AS (SELECT * FROM {_sql('documents', PROBE)}), f AS (SELECT arm, count(*) AS n, round(avg(format_valid::INT), 6) AS fmt_ok, round(avg((method = 'search_replace')::INT), 6) AS env, round(avg((method = 'diff_fallback')::INT), 6) AS fb, round(avg((method = 'format_fail')::INT), 6) AS fail,
round(avg((finish = 'length')::INT), 6) AS trunc, round(avg(strict), 6) AS strict_mean, round(avg(lenient), 6) AS lenient_mean, round(avg((think_open >= 1)::INT), 6) AS open_think, round(avg(tags_ok::INT), 6) AS tags_ok, round(avg(marker::INT), 6) AS srmark, count(*) FILTER (finish = 'stop') AS n_stop, count(*) FILTER (finish = 'stop' AND tags_ok) AS n_ready, round(avg((finish = 'stop' AND tags_ok AND format_valid)::INT), 6) AS ready_valid FROM r GROUP BY arm),
b AS (SELECT arm, round(avg(s), 6) AS strict_best, round(avg(l), 6) AS lenient_best FROM (SELECT arm, pi, max(strict) AS s, max(lenient) AS l FROM r GROUP BY arm, pi) GROUP BY arm) SELECT * FROM f JOIN b USING (arm)""",
    "near_misses": """WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || '</think><solution>x</solution><<<<<<< SEARCH' ELSE '<think>' || text || '</think><solution>x</solution>' END AS t, doc_id % 4 <> 0 AS stop FROM documents WHERE text IS NOT NULL)
SELECT NOT contains(t, '<think>') AND len(string_split(t, '</think>')) = 2 AND len(string_split(t, '<solution>')) = 2 AND len(string_split(t, '</solution>')) = 2 AND contains(t, '<<<<<<< SEARCH') AND stop AS near, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM t GROUP BY near""",
    "structured_verdicts": """WITH p AS (SELECT unnest(['correct', 'truncated']) AS field, unnest([(doc_id * 3) % 7 < 3, (doc_id + 3) % 11 = 0]) AS a, unnest([(doc_id * 5) % 7 < 3, (doc_id + 5) % 11 = 0]) AS b FROM documents),
c AS (SELECT field, count(*) AS n, count(*) FILTER (a) AS correct_a, count(*) FILTER (b) AS correct_b, count(*) FILTER (a AND NOT b) AS n10, count(*) FILTER (b AND NOT a) AS n01 FROM p GROUP BY field),
d AS (SELECT *, (correct_b - correct_a) / n AS d, sqrt(greatest(n10 + n01 - (n01 - n10) * (n01 - n10) / n, 0)) / n AS se FROM c)
SELECT field, n, correct_a, correct_b, n10, n01, round(correct_a / n, 4) AS acc_a, round(correct_b / n, 4) AS acc_b, round(d, 4) AS delta, round(d - 1.96 * se, 4) AS low95, round(d + 1.96 * se, 4) AS high95, round(d - 1.6448536269514722 * se, 4) AS low_one_sided, round(d + 1.6448536269514722 * se, 4) AS high_one_sided FROM d""",
    "strict_instructions": "WITH r AS (SELECT doc_id, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: length(l) >= 400)) = 0 AS ok, length(text) > 2000 AS cut FROM documents JOIN labels USING (doc_id)) SELECT count(*) AS n, count(*) FILTER (ok) AS correct, count(*) FILTER (cut) AS truncated_n, round(count(*) FILTER (ok) / count(*), 6) AS pass_rate FROM r",
    "gold_patches": f"WITH b AS (SELECT * FROM {_sql('documents', BASE, 'doc_id % 3 <> 0')}), w AS (SELECT DISTINCT {IID} AS instance_id FROM documents WHERE doc_id % 2 = 0) SELECT instance_id, md5(coalesce(patch, '')) AS patch, problem FROM (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY ord) AS k FROM b JOIN w USING (instance_id)) WHERE k = 1",
    "commit_prefixes": f"WITH r AS (SELECT doc_id, {VERIFIED['repo']} AS repo, substr(md5(CAST(doc_id % 200 AS STRING)), 1, (4 + doc_id % 12)::INT) AS short FROM documents), c AS (SELECT DISTINCT repo, base_commit AS c FROM {_sql('documents', VERIFIED, 'doc_id % 41 = 0')}) SELECT doc_id, bool_or(starts_with(c, short)) AS begins, bool_or(starts_with(c, short) OR starts_with(short, substr(c, 1, length(short)::INT))) AS either FROM r JOIN c USING (repo) GROUP BY doc_id",
    "strategy_labels": """WITH i AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'func_pm_op__z' WHEN 1 THEN 'lm_rewrite__q__r' ELSE '77x' END AS s, CASE doc_id % 3 WHEN 0 THEN 'func_pm_op__z' WHEN 1 THEN 'lm_rewrite__q__r' ELSE '77x' END || doc_id % 13 AS t FROM documents)
SELECT coalesce(nullif(rtrim(regexp_extract(t, '^[a-zA-Z_]+'), '_'), ''), nullif(string_split(string_split(t, '__')[1], '_')[1], ''), 'other') AS v0, CASE WHEN contains(t, '__') THEN array_to_string(string_split(t, '__')[1:-2], '__') ELSE coalesce(nullif(regexp_replace(t, '[0-9]', '', 'g'), ''), 'numeric') END AS relabelled, count(*) AS n FROM i GROUP BY ALL""",
    "source_licenses": f"""WITH p AS (SELECT string_split({PATH}, '/') AS p FROM documents), g AS (SELECT CASE WHEN list_contains(p, '{P.LICENSES[0][0]}') THEN 0 WHEN p[-1] IN {P.LICENSES[1][1]} THEN 1 WHEN list_contains(p, '{P.LICENSES[2][0]}') THEN 2 ELSE 3 END AS k FROM p)
SELECT {[x[2] for x in P.LICENSES] + [P.NO_LICENSE[0]]}[k + 1] AS "group", {[x[3] for x in P.LICENSES] + [P.NO_LICENSE[1]]}[k + 1] AS status, {[x[4] for x in P.LICENSES] + [P.NO_LICENSE[2]]}[k + 1] AS label, count(*) AS n FROM g GROUP BY k""",
    "row_merge": "SELECT doc_id, length(text) AS chars, source FROM documents",
    "turn_labels": "SELECT conv_id, sum(len(string_split(coalesce(text, ''), ' ')))::BIGINT AS n, coalesce(sum(len(string_split(coalesce(text, ''), ' '))) FILTER (role = 'assistant'), 0)::BIGINT AS supervised FROM conversations GROUP BY conv_id",
}
SELECTION = f"""WITH r AS (SELECT * FROM {_sql('documents', {'instance_id': IID, 'ord': 'doc_id', 'repo': VERIFIED['repo'], 'c8': "substr(md5(CAST(doc_id % 200 AS STRING)), 1, 8)"}, 'coalesce(length(text), 0) % 5 <> 0')}),
b AS (SELECT instance_id, min_by(coalesce(patch, ''), ord) AS patch, min_by(problem, ord) AS problem FROM {_sql('documents', BASE, 'doc_id % 3 <> 0')} GROUP BY instance_id), v AS (SELECT * FROM {_sql('documents', VERIFIED, 'doc_id % 41 = 0')}), t AS (SELECT DISTINCT 'repo' || doc_id % 11 AS name FROM documents WHERE doc_id % 11 = 7),
f AS (SELECT r.*, patch, problem, ord > min(ord) OVER (PARTITION BY r.instance_id) AS dup FROM r LEFT JOIN b ON b.instance_id = r.instance_id)
SELECT ord AS doc_id, CASE WHEN dup THEN 'dup_instance' WHEN instance_id IN (SELECT instance_id FROM v) THEN 'decontam_instance_id' WHEN instance_id IN (SELECT name FROM t) OR string_split(repo, '/')[-1] IN (SELECT name FROM t) THEN 'decontam_terminal'
WHEN EXISTS (SELECT 1 FROM v WHERE v.repo = f.repo AND starts_with(v.base_commit, f.c8)) THEN 'decontam_repo_commit' WHEN patch IS NULL THEN 'no_oracle_in_base' WHEN trim(patch) = '' THEN 'empty_patch' WHEN strlen(patch) > 102400 THEN 'patch_too_large'
WHEN (contains(patch, 'GIT binary patch') OR contains(patch, 'Binary files')) AND NOT contains(patch, '@@') THEN 'binary_only' WHEN trim(problem) = '' THEN 'empty_problem_statement' WHEN NOT regexp_matches(patch, 'diff --git a/\\S+ b/') THEN 'no_touched_files' ELSE 'selected' END AS reason FROM f"""
ORACLES |= {"prompt_selection": SELECTION, "prompt_reconciliation": f"SELECT reason, count(*) AS n FROM ({SELECTION}) GROUP BY ROLLUP (reason)"}
QUERIES = {name: globals()[name] for name in ORACLES}
