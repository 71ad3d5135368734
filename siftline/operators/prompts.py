"""Selection of repair prompts (S19, F22, F23, J2b, J3, J4, J4b, P32b, P32c, P38): flags by joins, the first drop reason by order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import text as T
from siftline.operators.records import instance_parts

# The largest patch in bytes, and the drop reasons in the order they are told.
MAX_PATCH_BYTES = 100 * 1024
REASONS = (
    "dup_instance", "decontam_instance_id", "decontam_terminal", "decontam_repo_commit", "no_oracle_in_base", "empty_patch", "patch_too_large", "binary_only", "empty_problem_statement", "no_touched_files",
)
# License groups by a folder or a file name of the path: (folder, names, group, status, label).
LICENSES = [
    ("toucan-1.5m", (), "A_declared", "measured_local_readme", "Toucan local README declares Apache-2.0."),
    (None, ("APIGen-MT-5k-query.jsonl", "tau-train-query.jsonl"), "B_suspected_noncommercial_or_review_required", "user_directed_suspicion_not_independently_verified", "Do not use commercially until upstream terms are reviewed."),
    ("toolmind", (), "UNVERIFIED_upstream", "hypothesized", "ToolMind local README declares Apache-2.0; upstream component terms were not verified offline."),
]
NO_LICENSE = ("UNKNOWN", "unknown", "No local license mapping.")


def source_license(path: Column) -> Column:
    """struct<group, status, label> of a source's path."""
    told = lambda g, s, l: F.struct(F.lit(g).alias("group"), F.lit(s).alias("status"), F.lit(l).alias("label"))
    parts, out = F.split(path, "/"), told(*NO_LICENSE)
    for folder, names, *rest in reversed(LICENSES):
        out = F.when(F.array_contains(parts, folder) if folder else F.element_at(parts, -1).isin(*names), told(*rest)).otherwise(out)
    return out


def eval_keys(verified: DataFrame, key: str = "instance_id", repo: str = "repo", commit: str = "base_commit") -> tuple[DataFrame, DataFrame]:
    """The distinct ids, and each repository's distinct commits, of an evaluation set."""
    return verified.select(key).distinct(), verified.groupBy(repo).agg(F.collect_set(commit).alias("commits"))


def binary_only(patch: Column) -> Column:
    """a patch of binary files without any hunk."""
    marked = F.contains(patch, F.lit("GIT binary patch")) | F.contains(patch, F.lit("Binary files"))
    return marked & ~F.contains(patch, F.lit("@@"))


def gold_patches(base: DataFrame, wanted: DataFrame, key: str, order: list[str], *values: str) -> DataFrame:
    """Of the wanted ids, the first base row in file order."""
    rows = base.join(wanted.select(key).distinct(), key, "left_semi")
    first = rows.groupBy(key).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("b"))
    return first.select(key, *(F.coalesce(f"b.{v}", F.lit("")).alias(v) for v in values))


def same_commit(short: Column, commits: Column, either: bool = False) -> Column:
    """Whether any commit begins with the short one; ``either`` (J4b) lets the shorter of both be the prefix."""
    return F.exists(commits, lambda c: F.startswith(c, short) | (F.startswith(short, F.substring(c, F.lit(1), F.length(short))) if either else F.lit(False)))


def merged(main: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """Rows of both by position-free key; one without its counterpart raises when read."""
    other = side.withColumnRenamed(key, "other_key")
    j = main.join(other, main[key] == other["other_key"], "full")
    fault = F.raise_error(F.concat(F.lit("key mismatch in join: "), F.coalesce(key, "other_key").cast("string")))
    return j.withColumn(key, F.when(F.col(key).isNotNull() & F.col("other_key").isNotNull(), F.col(key)).otherwise(fault)).drop("other_key")


def strategy_v0(iid: Column) -> Column:
    """The older label: letters after the commit, else the first word of the third part."""
    labelled = F.rtrim(F.regexp_extract(iid, r"\.[0-9a-f]{6,}\.([a-zA-Z_]+)", 1), F.lit("_"))
    third = F.split_part(F.split_part(F.split_part(iid, F.lit("."), F.lit(3)), F.lit("__"), F.lit(1)), F.lit("_"), F.lit(1))
    return F.coalesce(F.nullif(labelled, F.lit("")), F.nullif(third, F.lit("")), F.lit("other"))


def strategy_relabelled(iid: Column) -> Column:
    """The third part without its last ``__`` suffix, else its letters."""
    rest = F.regexp_extract(iid, r"(?s)^[^.]*\.[^.]*\.(.*)$", 1)
    known = iid.rlike(r"^[^.]*\.[^.]*\.")
    cut = F.regexp_replace(rest, r"(?s)__(?!.*__).*$", "")
    return F.when(~known, "other").when(F.contains(rest, F.lit("__")), cut).otherwise(F.coalesce(F.nullif(F.regexp_replace(rest, r"\d", ""), F.lit("")), F.lit("numeric")))


def selection(rows: DataFrame, base: DataFrame, verified: DataFrame, tasks: DataFrame, key: str = "instance_id", order: str = "ord") -> DataFrame:
    """(key, order, reason): the first drop reason of every resolved row, or ``selected``.

    ``base`` has (key, patch, problem) once a key, ``tasks`` names of tasks. Rows of one id
    after its first are told apart by a grouped minimum, so a hot id is no window.
    """
    ids, commits = eval_keys(verified, key)
    p = instance_parts(F.col(key))
    r = rows.select(key, order).join(rows.groupBy(key).agg(F.min(order).alias("first")), key)
    r = r.select(key, order, "first", p["repo"].alias("repo"), p["commit"].alias("commit"), F.element_at(F.split(p["repo"], "/"), -1).alias("name"))
    flag = lambda df, column, name: df.select(F.col(df.columns[0]).alias(column)).distinct().withColumn(name, F.lit(True))
    r = r.join(flag(ids, key, "known_id"), key, "left").join(flag(tasks, key, "task_id"), key, "left").join(flag(tasks, "name", "task_repo"), "name", "left")
    r = r.join(commits, "repo", "left").join(base.select(key, "patch", "problem"), key, "left")
    blank = lambda c: F.regexp_replace(c, r"(?U)\s", "") == ""
    tests = (
        F.col(order) > F.col("first"), F.col("known_id"), F.coalesce("task_id", F.lit(False)) | F.coalesce("task_repo", F.lit(False)), (F.col("commit") != "") & same_commit(F.col("commit"), F.col("commits")), F.col("patch").isNull(),
        blank(F.col("patch")), F.octet_length("patch") > MAX_PATCH_BYTES, binary_only(F.col("patch")), blank(F.col("problem")), F.size(T.touched_files(F.col("patch"))) == 0,
    )
    reason = F.coalesce(*(F.when(t, F.lit(n)) for n, t in zip(REASONS, tests)), F.lit("selected"))
    return r.select(key, order, reason.alias("reason"))
