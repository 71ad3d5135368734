"""Instructions, batches and programs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import text as T
from siftline.operators import rewards as W
from siftline.operators import toolcalls as C

# The rotating bundles of constraints (name, constraints, group) and how each constraint is worded.
BUNDLES = [
    ("polite", [{"type": "sentence_count", "count": 2}, {"type": "polite_style"}, {"type": "keyword_count", "keyword": "案内", "count": 1}], "mifeval_like"),
    ("plain", [{"type": "char_range", "min": 12, "max": 80}, {"type": "plain_style"}, {"type": "forbidden_word", "word": "禁止語"}], "mifeval_like"),
    ("paragraph", [{"type": "paragraph_count", "count": 2}, {"type": "keyword_count", "keyword": "確認", "count": 1}], "native"),
    ("bullets", [{"type": "bullet_count", "count": 3}, {"type": "keyword_count", "keyword": "確認", "count": 3}], "mifeval_like"),
    ("numbers", [{"type": "numbered_list_count", "count": 3}, {"type": "forbidden_word", "word": "禁止語"}], "mifeval_like"),
    ("heading", [{"type": "heading"}, {"type": "polite_style"}], "mifeval_like"),
    ("json", [{"type": "json_object", "keys": ["題名", "状態"]}], "mifeval_like"),
    ("table", [{"type": "markdown_table", "rows": 2}, {"type": "keyword_count", "keyword": "確認", "count": 2}], "native"),
    ("hiragana", [{"type": "script_only", "script": "hiragana"}, {"type": "char_range", "min": 8, "max": 30}], "native"),
    ("ending", [{"type": "ending", "suffix": "以上です。"}, {"type": "sentence_count", "count": 2}, {"type": "polite_style"}], "native"),
]
WORDING = {
    "char_range": "文字数={min}〜{max}（空白除外）", "sentence_count": "文数={count}", "paragraph_count": "段落数={count}", "keyword_count": "語「{keyword}」の出現={count}回", "forbidden_word": "不使用語=「{word}」", "script_only": "仮名範囲={script}",
    "bullet_count": "箇条書き={count}項", "numbered_list_count": "番号付き項目={count}", "heading": "先頭行=#見出し", "json_object": "JSON形式; キー={keys}", "markdown_table": "縦棒表; データ行>={rows}", "polite_style": "文体=です・ます調", "plain_style": "文体=常体", "ending": "終端文字列=「{suffix}」",
}
SCRIPT_NAMES = {"hiragana": "平仮名"}


def constraint_text(c: dict) -> str:
    """Y31; an unknown type raises KeyError."""
    shown = {k: ",".join(v) if isinstance(v, list) else SCRIPT_NAMES.get(v, v) for k, v in c.items()}
    return WORDING[c["type"]].format(**shown)


def bundle_of(index: Column) -> Column:
    """struct<name, group, types, wording> of a number's bundle."""
    row = lambda b: F.struct(F.lit(b[0]).alias("name"), F.lit(b[2]).alias("group"), F.array(*(F.lit(c["type"]) for c in b[1])).alias("types"), F.array(*(F.lit(constraint_text(c)) for c in b[1])).alias("wording"))
    return F.element_at(F.array(*map(row, BUNDLES)), (F.pmod(index, F.lit(len(BUNDLES))) + 1).cast("int"))


def native_enough(seeds: DataFrame, group: str) -> DataFrame:
    """The seeds, if native constraints are a third of them or more; else reading them raises."""
    share = seeds.agg(F.count_if(F.col(group) == "native").alias("native"), F.count("*").alias("n"))  # one row
    fine = F.when(F.col("native") * 3 >= F.col("n"), F.lit(1)).otherwise(F.raise_error(F.lit("native constraint mix is below one third")))
    return seeds.join(F.broadcast(share.select(fine.alias("fine"))), F.col("fine") == 1, "left_semi")


def response_faults(index: Column, response: Column, dirty: Column) -> Column:
    """Contamination alone, else a missing response alone, else every constraint of the bundle that fails."""
    out = F.array().cast("array<string>")
    for k, (_, constraints, _) in enumerate(BUNDLES):
        out = F.when(F.pmod(index, F.lit(len(BUNDLES))) == k, T.failures(response, constraints)).otherwise(out)
    return F.when(F.coalesce(dirty, F.lit(False)), F.array(F.lit("contamination_8gram"))).when(response.isNull(), F.array(F.lit("no_passing_candidate"))).otherwise(out)


def two_turns(ask: Column, answer: Column) -> Column:
    """A user and an assistant turn; null where there is no answer."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.when(answer.isNotNull(), F.array(turn("user", ask), turn("assistant", answer)))


def judge_projection(df: DataFrame, key: str) -> DataFrame:
    """The key and what a judge may see, in this order; a row without messages and question raises when read."""
    named = [c for c in ("subset_name", "question", "target_tools") if c in df.columns]
    have = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    kept = [F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in named]
    tools = F.coalesce(have("tools").cast("string"), have("available_tools").cast("string")).alias("tools")
    told = have("messages").isNotNull() | (F.nullif(have("question").cast("string"), F.lit("")).isNotNull())
    own = F.when(told, F.col(key)).otherwise(F.raise_error(F.concat(F.lit("no messages or question: "), F.col(key).cast("string"))))
    return df.select(own.alias(key), *kept, have("messages").alias("messages"), tools)


def paraphrase_batch(seeds: DataFrame) -> DataFrame:
    """Seeds of all tiers but the first, with the literals that a request must keep."""
    return seeds.where("tier <> 'T1'").select("id", "tier", "request", C.supplied(F.col("plan"), F.col("links")).alias("literals"), F.col("links").alias("derived"))


def audit_batch(seeds: DataFrame) -> DataFrame:
    """One prompt a seed: its request and the calls it should lead to."""
    prompt = F.concat(F.lit("Request: "), "request", F.lit("\nExpected calls: "), F.array_join(F.transform("plan", C.canonical_calls), "\n"))
    return seeds.select("id", "tier", prompt.alias("prompt"))


def pilot_report(rows: DataFrame, text: str, literals: str, names: str) -> DataFrame:
    """rows, those with a missing literal or a leaked name, and the share with neither."""
    missing = F.exists(literals, lambda x: ~F.contains(F.coalesce(text, F.lit("")), x))
    leaked = F.exists(names, lambda x: F.contains(F.coalesce(text, F.lit("")), x))
    out = rows.agg(F.count("*").alias("n"), F.count_if(~missing & ~leaked).alias("ok"), F.count_if(missing).alias("literal_missing"), F.count_if(leaked).alias("name_leak"))
    return out.withColumn("ok_rate", F.round(F.col("ok") / F.greatest("n", F.lit(1)), 4))


def rollout_totals(rows: DataFrame, prompt: str, strict: str, lenient: str, valid: str) -> DataFrame:
    """Totals over prompts: rollouts, valid ones, sums and sums of the best of each prompt."""
    per = rows.groupBy(prompt).agg(F.count("*").alias("n"), F.count_if(F.col(valid)).alias("ok"), *(f(c).alias(f"{k}_{c}") for c in (strict, lenient) for k, f in (("sum", F.sum), ("best", F.max))))
    return per.agg(F.sum("n").alias("total"), F.sum("ok").alias("fmt_ok"), *(F.round(F.sum(f"{k}_{c}"), 6).alias(f"{c}_{k}") for c in (strict, lenient) for k in ("sum", "best")))


def gold_fix(instances: DataFrame, key: str, files: str, patch: str) -> DataFrame:
    """(key, fixed map, error): files with a patch taken back, each hunk anchored by its content."""
    edits = W.hunk_edits(instances.select(key, patch), key, patch)
    back = F.transform("edits", lambda e: F.struct(e["path"].alias("path"), e["new"].alias("search"), e["search"].alias("new")))
    j = instances.select(key, F.col(files).alias("files")).join(edits, key, "left").withColumn("x", F.when(F.col("edits").isNotNull(), W.applied(F.col("files"), back)))
    error = F.when(F.col("edits").isNull(), "no usable hunk").otherwise(F.col("x.error"))
    return j.select(key, F.when(error.isNull(), F.map_concat(F.map_filter("files", lambda k, v: ~F.map_contains_key("x.files", k)), "x.files")).alias("fixed"), error.alias("error"))


def check_program(code: Column, test: Column, entry: Column) -> Column:
    """A candidate, its tests and the call of their check."""
    return F.concat_ws("\n", code, F.lit(""), test, F.lit(""), F.concat(F.lit("check("), entry, F.lit(")")), F.lit(""))


def assert_program(code: Column, setup: Column, asserts: Column) -> Column:
    """A candidate, setup code if there is any, and assertions."""
    blank = F.coalesce(F.regexp_replace(setup, r"\s", ""), F.lit("")) == ""
    return F.concat(code, F.lit("\n\n"), F.when(blank, "").otherwise(F.concat(setup, F.lit("\n\n"))), F.array_join(asserts, "\n"), F.lit("\n"))
