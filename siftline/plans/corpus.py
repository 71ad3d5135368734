"""Queries of corpus intake and decontamination."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import text as T
from siftline.operators import decontam as D
from siftline.session import table

N = D.N
TOKENS = r"regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}]+')"


def _grams(name: str, key: str, n: int = N, tokens: str = TOKENS, positions: bool = False) -> str:
    """A CTE body: the n-grams of each row, distinct or with positions."""
    inner = f"SELECT {key}, {tokens} AS t FROM {name} WHERE text IS NOT NULL"
    if positions:
        return f"SELECT {key}, i - 1 AS pos, array_to_string(t[i:i + {n - 1}], ' ') AS gram FROM (SELECT {key}, t, unnest(range(1, len(t) - {n - 2})) AS i FROM ({inner}) WHERE len(t) >= {n})"
    return f"SELECT DISTINCT {key}, array_to_string(t[i:i + {n - 1}], ' ') AS gram FROM (SELECT {key}, t, unnest(range(1, len(t) - {n - 2})) AS i FROM ({inner}) WHERE len(t) >= {n})"


INDEX = f"b AS ({_grams('benchmark', 'item_id')}), idx AS (SELECT gram, count(*) AS df FROM b GROUP BY gram HAVING count(*) <= 2)"
HITS = f"{INDEX}, d AS ({_grams('documents', 'doc_id')}), hit AS (SELECT doc_id, count(*) AS n_hits FROM d JOIN idx USING (gram) GROUP BY doc_id)"


def _index(spark, sf):
    return D.eval_index({"benchmark": table(spark, sf, "benchmark")})


def decontam_index(spark, sf):
    return _index(spark, sf).select("gram", "mask", "df")


def decontam_8gram(spark, sf):
    return D.hits(table(spark, sf, "documents"), _index(spark, sf), ["benchmark"], "doc_id")


def decontam_removed(spark, sf):
    return D.contaminated(table(spark, sf, "documents"), _index(spark, sf), ["benchmark"], "doc_id")


def decontam_summary(spark, sf):
    """K9: totals of rows in, kept and removed."""
    docs = table(spark, sf, "documents")
    removed = D.contaminated(docs, _index(spark, sf), ["benchmark"], "doc_id")
    total, out = docs.agg(F.count("*").alias("n_in")), removed.agg(F.count("*").alias("n_removed"))
    both = total.withColumn("k", F.lit(1)).join(out.withColumn("k", F.lit(1)), "k")  # two single rows
    return both.select("n_in", (F.col("n_in") - F.col("n_removed")).alias("n_kept"), "n_removed")


def decontam_longest_run(spark, sf):
    """Runs in each line of a document (its leaves); items form three sets, the last of which is skipped."""
    items = table(spark, sf, "benchmark")
    sets = {f"set{i}": items.where(F.col("item_id") % 3 == i) for i in range(3)}
    record = F.to_json(F.struct(F.split("text", "\n").alias("lines")))
    leaves = D.leaf_texts(table(spark, sf, "documents").select("doc_id", record.alias("record")), "doc_id", "record")
    return D.longest_run(leaves, D.eval_index(sets, max_df=0), list(sets), "doc_id", skip=("set2",))


def decontam_ascii8(spark, sf):
    """ASCII 8-grams, one hit suffices."""
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    return D.first_gram_hit(docs, items, "doc_id", "ascii")


def char8_overlap(spark, sf):
    """Character 8-grams of the letters alone, one hit suffices."""
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    return D.first_gram_hit(docs, items, "doc_id", "letters")


def char3_neardup(spark, sf):
    """User turns, and each with its beginning repeated, of character 3-gram Jaccard of 0.92 or more; copies pair with the first alone."""
    turns = table(spark, sf, "conversations").where("role = 'user' and text is not null").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text")
    near = turns.select(F.concat(F.lit("n:"), "id").alias("id"), F.concat("text", F.lit(" "), F.substring("text", 1, 4)).alias("text"))
    return D.near_pairs(turns.unionByName(near), "id", T.collapsed(F.col("text")), 3, 0.92)


def normalized_tokens(spark, sf):
    """Number and digest of the normal tokens of every text."""
    t = F.col("t")
    return table(spark, sf, "documents").select("doc_id", T.normalize_tokens(F.col("text")).alias("t")).select("doc_id", F.size(t).alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("digest"))


def corpus_profile(spark, sf):
    """A1: rows, mean characters, characters over four as tokens, for each source."""
    n = F.length("text")
    return table(spark, sf, "documents").groupBy("source").agg(
        F.count("*").alias("n_rows"), F.round(F.avg(n), 4).alias("avg_chars"), F.sum(F.floor(n / 4)).alias("est_tokens"),
        F.count_if(F.col("lang").isNull()).alias("null_langs"), F.max(n).alias("max_chars"),
    )


def corpus_profile_rollup(spark, sf):
    """A2: the profile by language and source, by language, and overall."""
    n = F.length("text")
    return table(spark, sf, "documents").rollup("lang", "source").agg(
        F.grouping_id().cast("long").alias("level"), F.count("*").alias("n_rows"), F.round(F.avg(n), 4).alias("avg_chars"), F.sum(n).alias("chars")
    )


def license_label(spark, sf):
    """A CASE on the source's name gives group, status and label."""
    s = F.col("source")
    group = F.when(s.isin("src0", "src1", "src2"), "declared").when(s.rlike("^src1[0-9]$"), "review_required").otherwise("unknown")
    status = F.when(group == "declared", "measured").when(group == "review_required", "suspected").otherwise("unknown")
    return table(spark, sf, "documents").groupBy(group.alias("license_group"), status.alias("license_status")).agg(F.count("*").alias("n_rows"))


def structural_counts(spark, sf):
    """Structural signals of the conversations."""
    c = table(spark, sf, "conversations")
    signals = F.array(
        F.concat(F.lit("role:"), F.col("role")), F.when(F.col("text").contains("?"), F.lit("question")),
        F.when(F.col("text").contains("\n"), F.lit("multi_line")), F.when(F.col("turn") == 0, F.lit("conversation")),
    )
    return c.select(F.explode(F.array_compact(signals)).alias("signal")).groupBy("signal").agg(F.count("*").alias("n"))


def drop_reason_cascade(spark, sf):
    """the first drop reason of every document, in order."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = docs.select("doc_id", F.length("text").alias("chars"), F.sha2("text", 256).alias("digest"))
    rows = rows.join(rows.groupBy("digest").agg(F.min("doc_id").alias("first_id")), "digest").join(labels, "doc_id", "left")
    reason = (
        F.when(F.col("chars") == 0, "empty").when(F.col("doc_id") > F.col("first_id"), "duplicate").when(F.col("toxic") == 1, "toxic")
        .when(F.col("quality") == 0, "low_quality").when(F.col("chars") > 20000, "too_long").otherwise("kept")
    )
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))


def reconciliation(spark, sf):
    """Drops and kept rows add up to what was read."""
    by = drop_reason_cascade(spark, sf)
    n = F.col("n")
    return by.agg(F.sum(n).alias("n_read"), F.sum(F.when(F.col("reason") == "kept", n).otherwise(0)).alias("n_kept"), F.sum(F.when(F.col("reason") != "kept", n).otherwise(0)).alias("n_dropped"))


def dedup_first(spark, sf):
    """The first document of each text."""
    return table(spark, sf, "documents").groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"))


def prefix_theta_join(spark, sf):
    """Pages, and the folders they lie in, whose path starts with another one's path on the same host."""
    url = F.regexp_extract("url", "^[^:]*://([^/?#]*)", 1)
    path = F.regexp_replace(F.regexp_extract("url", "^[^:]*://[^/?#]*([^?#]*)", 1), "(/|\\.html)$", "")
    p = table(spark, sf, "pages").select("page_id", url.alias("host"), path.alias("path"))
    p = p.unionByName(p.select((-F.col("page_id") - 1).alias("page_id"), "host", F.regexp_replace("path", "[^/]*$", "").alias("path")))
    heads = p.select(F.col("page_id").alias("parent_id"), F.col("host").alias("h"), F.col("path").alias("parent_path"))
    # a path is cut at the lengths that paths of its host have, so a cut is an equi-join key; no pair of a host is compared twice
    lengths = p.where("path <> ''").select(F.col("host").alias("h"), F.length("path").alias("n")).distinct().groupBy("h").agg(F.collect_list("n").alias("ns"))
    cuts = p.join(lengths, F.col("host") == F.col("h")).select("page_id", "host", "path", F.explode("ns").alias("n"))
    cuts = cuts.where("n < length(path)").withColumn("prefix", F.expr("substring(path, 1, n)"))
    met = cuts.join(heads, (F.col("host") == F.col("h")) & (F.col("prefix") == F.col("parent_path")))
    return met.groupBy("host").agg(F.count("*").alias("n_pairs"), F.countDistinct("page_id").alias("n_children"))


LETTERS = r"regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\p{L}\p{N}]', '', 'g')"
FIRST = "SELECT *, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents"
CASCADE = f"""SELECT CASE WHEN length(text) = 0 THEN 'empty' WHEN d.doc_id > first_id THEN 'duplicate' WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'low_quality'
 WHEN length(text) > 20000 THEN 'too_long' ELSE 'kept' END AS reason, count(*) AS n, sum(length(text)) AS chars FROM ({FIRST}) d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1"""
C3 = "trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))"

ORACLES = {
    "decontam_index": f"WITH {INDEX} SELECT gram, 1 AS mask, df FROM idx",
    "decontam_8gram": f"WITH {HITS} SELECT doc_id, 'benchmark' AS eval_set, n_hits FROM hit",
    "decontam_removed": f"WITH {HITS} SELECT doc_id, 'benchmark' AS eval_sets, n_hits FROM hit WHERE n_hits >= 2",
    "decontam_summary": f"WITH {HITS}, r AS (SELECT count(*) AS n FROM hit WHERE n_hits >= 2), t AS (SELECT count(*) AS n FROM documents) SELECT t.n AS n_in, t.n - r.n AS n_kept, r.n AS n_removed FROM t, r",
    "decontam_longest_run": f"""WITH b AS (SELECT gram, bit_or(1 << (item_id % 3)::INT) & 3 AS mask FROM ({_grams("benchmark", "item_id")}) GROUP BY gram),
l AS (SELECT doc_id, i - 1 AS leaf, lines[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)),
t AS (SELECT doc_id, leaf, {TOKENS} AS t FROM l),
d AS (SELECT doc_id, leaf, i - 1 AS pos, array_to_string(t[i:i + 7], ' ') AS gram FROM (SELECT doc_id, leaf, t, unnest(range(1, len(t) - 6)) AS i FROM t WHERE len(t) >= 8)),
m AS (SELECT doc_id, leaf, pos, mask, pos - row_number() OVER (PARTITION BY doc_id, leaf ORDER BY pos) AS island FROM d JOIN b USING (gram) WHERE mask <> 0),
r AS (SELECT doc_id, leaf, count(*) AS run, min(pos) AS start, bit_or(mask) AS mask FROM m GROUP BY doc_id, leaf, island),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY run DESC, leaf, start) AS k FROM r)
SELECT doc_id, run, leaf, start, array_to_string(list_filter([CASE WHEN mask & 1 <> 0 THEN 'set0' END, CASE WHEN mask & 2 <> 0 THEN 'set1' END], lambda x: x IS NOT NULL), ',') AS eval_sets,
substr(array_to_string(t[start + 1:start + run + 7], ' '), 1, 200) AS "window", run >= 6 AS removed FROM o JOIN t USING (doc_id, leaf) WHERE k = 1""",
    "decontam_ascii8": f"""WITH b AS (SELECT DISTINCT gram FROM ({_grams("benchmark", "item_id", 8, "regexp_extract_all(replace(lower(text), '_', ' '), '[a-z0-9]+')")})),
d AS ({_grams("documents", "doc_id", 8, "regexp_extract_all(replace(lower(text), '_', ' '), '[a-z0-9]+')")}) SELECT doc_id, count(*) AS n_shared FROM d JOIN b USING (gram) GROUP BY doc_id""",
    "char8_overlap": f"""WITH b AS (SELECT DISTINCT substr(s, i, 8) AS gram FROM (SELECT s, unnest(range(1, length(s) - 6)) AS i FROM (SELECT {LETTERS} AS s FROM benchmark))),
d AS (SELECT DISTINCT doc_id, substr(s, i, 8) AS gram FROM (SELECT doc_id, s, unnest(range(1, length(s) - 6)) AS i FROM (SELECT doc_id, {LETTERS} AS s FROM documents)))
SELECT doc_id, count(*) AS n_shared FROM d JOIN b USING (gram) GROUP BY doc_id""",
    "char3_neardup": f"""WITH t AS (SELECT conv_id || ':' || turn AS id, text FROM conversations WHERE role = 'user' AND text IS NOT NULL), o AS (SELECT id, {C3} AS s FROM (SELECT * FROM t UNION ALL SELECT 'n:' || id, text || ' ' || substr(text, 1, 4) FROM t)), s AS (SELECT min(id) AS id, s FROM o GROUP BY s),
g AS (SELECT id, list_distinct(CASE WHEN length(s) < 3 THEN [s] ELSE [substr(s, i, 3) FOR i IN range(1, length(s) - 1)] END) AS g FROM s WHERE length(s) > 0),
p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.g, b.g)) AS n, len(a.g) + len(b.g) AS m FROM g a JOIN g b ON a.id < b.id AND len(a.g) >= 0.92 * len(b.g) AND len(b.g) >= 0.92 * len(a.g))
SELECT a, b, round(n / (m - n), 6) AS jaccard FROM p WHERE n / (m - n) >= 0.92 UNION ALL SELECT s.id, o.id, 1.0::DOUBLE FROM o JOIN s USING (s) WHERE o.id <> s.id""",
    "normalized_tokens": f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {TOKENS} AS t FROM documents)",
    "corpus_profile": "SELECT source, count(*) AS n_rows, round(avg(length(text)), 4) AS avg_chars, sum(length(text) // 4) AS est_tokens, count(*) FILTER (lang IS NULL) AS null_langs, max(length(text)) AS max_chars FROM documents GROUP BY source",
    "corpus_profile_rollup": "SELECT lang, source, grouping_id(lang, source) AS level, count(*) AS n_rows, round(avg(length(text)), 4) AS avg_chars, sum(length(text)) AS chars FROM documents GROUP BY ROLLUP (lang, source)",
    "license_label": "SELECT license_group, CASE license_group WHEN 'declared' THEN 'measured' WHEN 'review_required' THEN 'suspected' ELSE 'unknown' END AS license_status, count(*) AS n_rows FROM (SELECT CASE WHEN source IN ('src0', 'src1', 'src2') THEN 'declared' WHEN regexp_matches(source, '^src1[0-9]$') THEN 'review_required' ELSE 'unknown' END AS license_group FROM documents) GROUP BY 1, 2",
    "structural_counts": "SELECT signal, count(*) AS n FROM (SELECT unnest(['role:' || role, CASE WHEN contains(text, '?') THEN 'question' END, CASE WHEN contains(text, chr(10)) THEN 'multi_line' END, CASE WHEN turn = 0 THEN 'conversation' END]) AS signal FROM conversations) WHERE signal IS NOT NULL GROUP BY signal",
    "drop_reason_cascade": CASCADE,
    "reconciliation": f"SELECT sum(n) AS n_read, sum(n) FILTER (reason = 'kept') AS n_kept, coalesce(sum(n) FILTER (reason <> 'kept'), 0) AS n_dropped FROM ({CASCADE})",
    "dedup_first": "SELECT md5(text) AS digest, min(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY md5(text)",
    "prefix_theta_join": r"""WITH o AS (SELECT page_id, regexp_extract(url, '^[^:]*://([^/?#]*)', 1) AS host, regexp_replace(regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1), '(/|\.html)$', '') AS path FROM pages), p AS (SELECT * FROM o UNION ALL SELECT -page_id - 1, host, regexp_replace(path, '[^/]*$', '') FROM o)
SELECT a.host, count(*) AS n_pairs, count(DISTINCT a.page_id) AS n_children FROM p a JOIN p b ON a.host = b.host AND starts_with(a.path, b.path) AND length(b.path) < length(a.path) AND length(b.path) >= 1 GROUP BY a.host""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
