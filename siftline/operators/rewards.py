"""Edits and their rewards (P20, P25-P31, A32*, Y19-Y21) as columns and joins.

An edit is ``struct<path, search, new>``; what a completion says becomes an array of them,
from SEARCH/REPLACE blocks by one pattern, from a diff by gaps and islands over its lines.
Applying is a fold inside the JVM. Only what no built-in can do, the unified diff of two
texts and the matched share of two diffs, runs in Arrow functions, one call a batch.
The diffs of an instance's target are made once and joined to all its completions.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# Tags, patterns, the limit of compared characters, the reward of what can't be read.
TAGS = ("<think>", "</think>", "<solution>", "</solution>")
BLOCK = r"(?d)```.*?\n### (.*)\n<<<<<<< SEARCH\n([\s\S]*?)\n=======\n([\s\S]*?)\n>>>>>>> REPLACE\n```"
THOUGHT = r"(?is)<think>.*?</think>"
FENCED_DIFF = r"(?s)```(?:diff|patch)[^\n]*\n(.*?)(?:```|\z)"
FENCED = r"(?s)```[a-zA-Z0-9_+-]*\n(.*?)```"
MAX_CHARS, UNREADABLE = 20_000, -1.0
EDIT = "struct<path:string,search:string,new:string>"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def solution(text: Column) -> tuple[Column, Column]:
    """P20: (solution, error): each tag stands exactly once and the thought is not empty."""
    between = lambda a, b: stripped(F.substring_index(F.split_part(text, F.lit(a), F.lit(2)), b, 1))
    counted = [F.when(F.regexp_count(text, F.lit(t)) != 1, F.lit(f"count of {t} is not 1")) for t in TAGS]
    return between(*TAGS[2:]), F.coalesce(*counted, F.when(between(*TAGS[:2]) == "", "Thought is empty"))


def block_edits(text: Column) -> Column:
    """P25: SEARCH/REPLACE blocks in order."""
    path, search, new = (F.regexp_extract_all(text, F.lit(BLOCK), i) for i in (1, 2, 3))
    return F.arrays_zip(path.alias("path"), search.alias("search"), new.alias("new"))


def applied(files: Column, edits: Column, silent: bool = False) -> Column:
    """struct<files, error>: every occurrence that begins a line; a search that is missing or changes nothing is an error unless silent."""

    def step(done: Column, e: Column) -> Column:
        search, new = F.concat(F.lit("\n"), e["search"]), F.concat(F.lit("\n"), e["new"])
        wrong = F.when(search == new, "Search and replace blocks are identical").when(~F.contains(done["body"], search), F.concat(F.lit("Search block not found in the code: "), search))
        error = F.coalesce(done["error"], F.lit(None) if silent else wrong).cast("string")
        return F.struct(F.replace(done["body"], search, new).alias("body"), error.alias("error"))

    start = lambda p: F.struct(F.concat(F.lit("\n"), F.coalesce(F.try_element_at(files, p), F.lit(""))).alias("body"), F.lit(None).cast("string").alias("error"))
    one = lambda p: F.struct(p.alias("path"), F.aggregate(F.filter(edits, lambda e: e["path"] == p), start(p), step).alias("x"))
    each = F.transform(F.array_distinct(F.transform(edits, lambda e: e["path"])), one)
    error = F.try_element_at(F.array_compact(F.transform(each, lambda r: r["x"]["error"])), F.lit(1))
    after = F.map_from_entries(F.transform(each, lambda r: F.struct(r["path"], F.substring(r["x"]["body"], F.lit(2), F.length(r["x"]["body"])))))
    return F.struct(after.alias("files"), error.alias("error"))


def patch_of(text: Column) -> Column:
    """The last fenced diff outside thoughts, else all from ``diff --git`` on, else from a bare ``---``/``+++`` head on; else null."""
    shown = F.regexp_replace(text, THOUGHT, "")
    trim = lambda t: F.regexp_replace(t, r"^\n+|\n+\z", "")
    usable = F.filter(F.regexp_extract_all(shown, F.lit(FENCED_DIFF), 1), lambda b: b.rlike(r"(?dm)^diff --git ") | F.contains(b, F.lit("@@")))
    found = lambda pattern: F.nullif(F.regexp_extract(shown, pattern, 0), F.lit(""))
    headed = F.when(F.contains(shown, F.lit("@@")), found(r"(?dms)^--- [^\n]*\n\+\+\+ .*"))
    return F.coalesce(trim(F.try_element_at(usable, F.lit(-1))), trim(found(r"(?dms)^diff --git .*")), trim(headed))


def hunk_edits(df: DataFrame, key: str | list[str], patch: str) -> DataFrame:
    """(key, edits) of each patch with a usable hunk; keys are unique.

    Lines are numbered islands: a file line, a file's end, ``@@`` and a line of no hunk each
    begin one. Islands that begin with ``@@`` are hunks; line numbers in them don't count.
    """
    keys = [key] if isinstance(key, str) else list(key)
    whole = F.split(F.regexp_replace(patch, r"\r?\n\z", ""), r"\r\n|\r|\n")
    rows = df.where(F.col(patch).isNotNull()).select(*keys, F.posexplode(whole).alias("pos", "line"))
    line, order = F.col("line"), Window.partitionBy(*keys).orderBy("pos")
    path = F.regexp_replace(F.split_part(F.trim(F.substring(line, F.lit(5), F.length(line))), F.lit("\t"), F.lit(1)), "^[ab]/", "")
    head = F.when(line.startswith("+++ "), "file").when(line.startswith("--- ") | line.startswith("diff --git "), "end").when(line.startswith("@@"), "hunk").when(~line.rlike(r"^($|[-+ \\])"), "end")
    rows = rows.withColumns({"head": head, "path": F.when(head == "file", F.when(path == "/dev/null", "").otherwise(path))})
    rows = rows.withColumns({"island": F.count("head").over(order), "path": F.last("path", ignorenulls=True).over(order)})
    side = lambda signs: F.array_join(F.transform(F.filter(F.array_sort("ls"), lambda x: x["mark"].isin(*signs)), lambda x: x["rest"]), "\n")
    marked = F.struct("pos", F.substring(line, 1, 1).alias("mark"), F.substring(line, F.lit(2), F.length(line)).alias("rest"))
    hunks = rows.groupBy(*keys, "island").agg(F.max("head").alias("head"), F.max("path").alias("path"), F.collect_list(F.when(F.col("head").isNull(), marked)).alias("ls"))
    hunks = hunks.where("head = 'hunk' and path <> ''").select(*keys, "island", "path", side(("-", " ", "")).alias("search"), side(("+", " ", "")).alias("new")).where("search <> new")
    edits = F.transform(F.array_sort(F.collect_list(F.struct("island", "path", "search", "new"))), lambda e: F.struct(e["path"].alias("path"), e["search"].alias("search"), e["new"].alias("new")))
    return hunks.groupBy(*keys).agg(edits.alias("edits"))


def bare_hunks(df: DataFrame, key: str, text: str, files: str) -> DataFrame:
    """(key, edits) from plain fences with ``+``, ``-`` or empty lines, for instances of one file; the first usable fence counts."""
    one = df.where(F.size(files) == 1)
    shown = F.regexp_extract_all(F.regexp_replace(text, THOUGHT, ""), F.lit(FENCED), 1)
    b = one.select(key, F.map_keys(files)[0].alias("path"), F.posexplode(shown).alias("fence", "body")).where(F.col("body").rlike(r"(?dm)^([-+]|\n)"))
    body = F.when(F.col("body").rlike(r"(?dm)^@@ .* @@"), F.col("body")).otherwise(F.concat(F.lit("@@ -1 +1 @@\n"), F.col("body")))
    patches = b.select(key, "fence", F.concat(F.lit("--- a/"), "path", F.lit("\n+++ b/"), "path", F.lit("\n"), body).alias("patch"))
    return hunk_edits(patches, [key, "fence"], "patch").groupBy(key).agg(F.min_by("edits", "fence").alias("edits"))


@F.pandas_udf(StringType())
def change(old: pd.Series, new: pd.Series) -> pd.Series:
    """A unified diff with three lines of context and no file lines; empty for equal texts."""
    lines = (list(difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), lineterm="")) for a, b in zip(old, new))
    return pd.Series(["\n".join(x[2:]) for x in lines], dtype="object")


@F.pandas_udf(DoubleType())
def matched_share(a: pd.Series, b: pd.Series) -> pd.Series:
    """The matched share of two changes, their line ends and trailing blanks made equal; 0 if one is empty."""
    plain = lambda s: s.fillna("").str.replace("\r\n", "\n").str.replace(r"[^\S\n]+(?=\n|$)", "", regex=True).str.slice(0, MAX_CHARS)
    ratios = (difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() if x and y else 0.0 for x, y in zip(plain(a), plain(b)))
    return pd.Series(list(ratios), dtype="float64")


def targets(instances: DataFrame, key: str, files: str, after: str | None = None, patch: str | None = None) -> DataFrame:
    """A32g, Y20: (key, files, goal map<path, change>): each instance's target as diffs, made once (A32f).

    ``after`` maps are preferred; without one the patch is applied, and one that doesn't fit raises.
    """
    given = F.when(F.size(after) > 0, F.col(after)) if after else F.lit(None).cast("map<string,string>")
    rows = instances.select(key, F.col(files).alias("files"), given.alias("goal"), (F.col(patch) if patch else F.lit(None).cast("string")).alias("patch"))
    edits = hunk_edits(rows.where("goal is null"), key, "patch")
    x = applied(F.col("files"), F.col("edits"))
    rows = rows.join(edits, key, "left").withColumn("x", F.when(F.col("edits").isNotNull(), x))
    fault = F.coalesce(F.col("x.error"), F.when(F.col("edits").isNull(), F.lit("neither files nor a usable patch")))
    goal = F.coalesce("goal", F.when(fault.isNull(), F.col("x.files")).otherwise(F.raise_error(fault)))
    each = rows.select(key, "files", F.explode_outer(goal).alias("path", "new"))
    each = each.withColumn("change", change(F.try_element_at("files", F.col("path")), F.col("new")))
    pairs = F.collect_list(F.when(F.col("change") != "", F.struct("path", "change")))
    return each.groupBy(key).agg(F.any_value("files").alias("files"), F.map_from_entries(pairs).alias("goal"))


def compared(rows: DataFrame, key: str) -> DataFrame:
    """(key, reward, n_pred_files, per_file) from (key, files, goal, pred): the mean over all changed files; none at all is 1."""
    paths = F.array_union(F.map_keys("goal"), F.map_keys("pred"))
    each = rows.select(key, "goal", F.explode(paths).alias("path"), "files", "pred")
    each = each.select(key, "path", F.coalesce(F.try_element_at("goal", F.col("path")), F.lit("")).alias("want"), F.when(F.map_contains_key("pred", F.col("path")), change(F.try_element_at("files", F.col("path")), F.try_element_at("pred", F.col("path")))).otherwise("").alias("got"))
    each = each.where("want <> '' or got <> ''").withColumn("similarity", matched_share("got", "want"))
    out = each.groupBy(key).agg(F.avg("similarity").alias("reward"), F.count_if(F.col("got") != "").alias("n_pred_files"), F.array_sort(F.collect_list(F.struct("path", "similarity"))).alias("per_file"))
    none = F.array().cast("array<struct<path:string,similarity:double>>")
    return rows.select(key).join(out, key, "left").select(key, F.coalesce("reward", F.lit(1.0)).alias("reward"), F.coalesce("n_pred_files", F.lit(0)).alias("n_pred_files"), F.coalesce("per_file", none).alias("per_file"))


def reward_rows(read: DataFrame, key: str) -> DataFrame:
    """A32e from (key, files, goal, pred, method, error); a null ``pred`` is what couldn't be read."""
    fine = compared(read.where("pred is not null").select(key, "files", "goal", "pred"), key)
    out = read.select(key, "method", "error", F.size("goal").alias("n_oracle_files"), F.col("pred").isNotNull().alias("format_valid")).join(fine, key, "left")
    reward = F.when(F.col("format_valid"), F.col("reward")).otherwise(UNREADABLE)
    method = F.when(F.col("format_valid"), F.col("method")).otherwise("format_fail")
    return out.select(key, reward.alias("reward"), "format_valid", method.alias("method"), F.when(~F.col("format_valid"), F.col("error")).alias("error"), F.coalesce("n_pred_files", F.lit(0)).alias("n_pred_files"), "n_oracle_files", "per_file")


def scored(completions: DataFrame, goals: DataFrame, key: str, instance: str, text: str, fallback: bool = True) -> DataFrame:
    """A32b-A32e: one row a completion: SEARCH/REPLACE inside the tags, else (``fallback``) a diff, else -1 with the first error."""
    answer, error = solution(F.col("text"))
    c = completions.select(key, instance, F.col(text).alias("text")).join(goals, instance).withColumns({"error": error, "edits": block_edits(answer)})
    c = c.withColumn("error", F.coalesce("error", F.when(F.size("edits") == 0, "No valid search blocks found")))
    c = c.withColumn("x", F.when(F.col("error").isNull(), applied(F.col("files"), F.col("edits")))).withColumn("error", F.coalesce("error", "x.error"))
    strict = F.when(F.col("error").isNull(), F.col("x.files"))
    if not fallback:
        return reward_rows(c.select(key, "files", "goal", strict.alias("pred"), F.lit("search_replace").alias("method"), "error"), key)
    again = hunk_edits(c.where("error is not null").select(key, patch_of(F.col("text")).alias("patch")), key, "patch").withColumnRenamed("edits", "hunks")
    c = c.drop("edits").join(again, key, "left").withColumn("y", F.when(F.col("error").isNotNull() & F.col("hunks").isNotNull(), applied(F.col("files"), F.col("hunks"))))
    loose = F.when(F.col("y.error").isNull(), F.col("y.files"))
    method = F.when(F.col("error").isNull(), "search_replace").otherwise("diff_fallback")
    return reward_rows(c.select(key, "files", "goal", F.coalesce(strict, loose).alias("pred"), method.alias("method"), "error"), key)


def lenient(completions: DataFrame, goals: DataFrame, key: str, instance: str, text: str) -> DataFrame:
    """A32h: (key, reward): blocks anywhere outside thoughts, else a diff, else bare hunks of a single file, else -1."""
    c = completions.select(key, instance, F.col(text).alias("text")).join(goals, instance)
    c = c.withColumns({"blocks": block_edits(F.regexp_replace("text", THOUGHT, "")), "patch": patch_of(F.col("text"))})
    rest = c.where(F.size("blocks") == 0)
    by_diff = hunk_edits(rest, key, "patch").withColumnRenamed("edits", "hunks")
    by_fence = bare_hunks(rest.where("patch is null"), key, "text", "files").withColumnRenamed("edits", "bare")
    c = c.join(by_diff, key, "left").join(by_fence, key, "left")
    edits = F.coalesce(F.when(F.size("blocks") > 0, F.col("blocks").cast(f"array<{EDIT}>")), F.col("hunks").cast(f"array<{EDIT}>"), F.col("bare").cast(f"array<{EDIT}>"))
    c = c.withColumn("x", F.when(edits.isNotNull(), applied(F.col("files"), edits)))
    pred = F.when(F.col("x.error").isNull(), F.col("x.files"))
    return reward_rows(c.select(key, "files", "goal", pred.alias("pred"), F.lit("lenient").alias("method"), F.col("x.error").alias("error")), key).select(key, "reward")
