"""Record identity, prompts, masks and joins of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def record_id(source: Column, index: Column, *candidates: Column) -> Column:
    """The first non-blank candidate, else a digest of the source and the position."""
    first = F.coalesce(*(F.nullif(F.trim(c.cast("string")), F.lit("")) for c in candidates))
    return F.coalesce(first, F.concat(F.substring(F.sha2(source, 256), 1, 12), F.lit(":"), index.cast("string")))


def batch_id(stem: str, first: Column, last: Column, sha: Column) -> Column:
    """P42."""
    return F.format_string(f"{stem}-%09d-%09d-%s", first, last, F.substring(sha, 1, 12))


def batch_prompt(rubric: str, sha: str, batch: Column, records: Column) -> Column:
    """The rubric, its digest, the batch and its records, one a line."""
    return F.concat(F.lit(f"{rubric}\nrubric_sha: {sha}\nbatch: "), batch, F.lit("\n"), F.array_join(records, "\n"))


# How each probe arm asks for the format.
ARMS = {"P": "", "F_system": "system", "F_user": "user", "F_user_prefill": "user"}
FORCE = "Use the required tags."


def forced(messages: Column, arm: str) -> Column:
    """The messages of an arm; the instruction stands in a system turn or after the last user turn, a prefill at the end."""
    turn = lambda role, text: F.array(F.struct(F.lit(role).alias("role"), F.lit(text).alias("content")))
    if ARMS[arm] == "system":
        return F.concat(turn("system", FORCE), messages)
    if ARMS[arm] == "user":
        n = F.size(messages)
        out = F.transform(messages, lambda m, i: F.struct(m.role.alias("role"), F.when((i == n - 1) & (m.role == "user"), F.concat(m.content, F.lit("\n\n" + FORCE))).otherwise(m.content).alias("content")))
        return F.concat(out, turn("assistant", "<think>")) if arm.endswith("prefill") else out
    return messages


def token_cap(prompt: Column, want: int, context: int, margin: int = 600) -> Column:
    """P46."""
    return F.greatest(F.lit(512), F.least(F.lit(want), F.lit(context) - prompt - margin))


def generated_length(ids: Column, ends: list[int]) -> Column:
    """Up to and with the first end token, else all."""
    first = F.array_min(F.filter(F.array(*(F.array_position(ids, e) for e in ends)), lambda p: p > 0))
    return F.coalesce(first, F.size(ids).cast("bigint"))


def hit_cap(ids: Column, ends: list[int], cap: int) -> Column:
    """P48."""
    return (F.size(ids) >= cap) & ~F.arrays_overlap(ids, F.array(*map(F.lit, ends)))


def masked_labels(tokens: Column, spans: Column) -> Column:
    """Ids of (id, start, end) tokens that lie in a span and aren't empty, else -100."""
    inside = lambda t: F.exists(spans, lambda s: (t.start >= s.start) & (t.end <= s.end)) & (t.end > t.start)
    return F.transform(tokens, lambda t: F.when(inside(t), t.id).otherwise(F.lit(-100)))


def tail(ids: Column, cap: int) -> Column:
    """The last ``cap`` items; 0 keeps all."""
    return F.when(F.lit(cap) > 0, F.slice(ids, F.greatest(F.size(ids) - cap + 1, F.lit(1)), F.greatest(F.size(ids), F.lit(1)))).otherwise(ids) if cap else ids


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading items two arrays share."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.least(F.size(a), F.size(b)).cast("bigint"))


def instance_parts(iid: Column) -> Column:
    """owner__repo.commit.strategy__hash as (repo, commit, mirror, strategy)."""
    head, commit, rest = F.split_part(iid, F.lit("."), F.lit(1)), F.split_part(iid, F.lit("."), F.lit(2)), F.split_part(iid, F.lit("."), F.lit(3))
    return F.struct(F.replace(head, F.lit("__"), F.lit("/")).alias("repo"), commit.alias("commit"), F.concat(head, F.lit("."), commit).alias("mirror"), F.regexp_replace(rest, "__[^_]*$", "").alias("strategy"))


def paired_shared(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Shared keys alone, nulls left out."""
    return a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key).na.drop()


def scored_subset(frozen: DataFrame, raw: DataFrame, key: str) -> DataFrame:
    """Every frozen key has exactly one raw row; a missing or second one raises when read."""
    n = raw.groupBy(key).agg(F.count("*").alias("__n"), *(F.first(c).alias(c) for c in raw.columns if c != key))
    j = frozen.join(n, key, "left")
    fine = F.coalesce(F.col("__n"), F.lit(0)) == 1
    return j.withColumn(key, F.when(fine, F.col(key)).otherwise(F.raise_error(F.concat(F.lit("incomplete key "), F.col(key).cast("string"))))).drop("__n")


def ingested(seeds: DataFrame, replies: DataFrame, key: str, text: str) -> DataFrame:
    """(.., text, error): unknown or repeated replies raise when read, seeds without one fail the gate."""
    n = replies.groupBy(key).agg(F.first(text).alias("__t"), F.count("*").alias("__n"))
    j = seeds.join(n, key, "full")
    known = F.coalesce(*(F.col(c).isNotNull() for c in seeds.columns if c != key), F.lit(True))
    fault = F.when(~known, "unknown id").when(F.col("__n") > 1, "repeated id")
    out = F.when(fault.isNotNull(), F.raise_error(fault)).otherwise(F.col("__t"))
    return j.withColumns({text: out, "error": F.when(F.length(F.trim(F.coalesce("__t", F.lit("")))) == 0, "request")}).drop("__t", "__n")


def rewards_of(row: DataFrame, *names: str) -> Column:
    """The first reward list a record has."""
    return F.coalesce(*(F.col(n) for n in names if n in row.columns))


def identity(items: DataFrame, bench: str, key: str) -> DataFrame:
    """One digest of each benchmark's keys, whatever their order, nulls left out: keys are digested in 65,536 buckets by their
    hash, then the buckets in order, so no row holds more than a bucket's keys."""
    bucket = F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 4)
    parts = items.where(F.col(key).isNotNull()).groupBy(bench, bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(key)), "\n"), 256).alias("d"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "d"))), lambda x: F.concat(x["bucket"], x["d"])), "\n")
    return parts.groupBy(bench).agg(F.sum("n").alias("n"), F.sha2(whole, 256).alias("identity"))


def protocol_differences(a: DataFrame, b: DataFrame, fields: list[str]) -> list[str]:
    """fields of two one-row frames that are null or differ."""
    x, y = a.select(*fields).first(), b.select(*fields).first()
    return [f for f in fields if x[f] is None or x[f] != y[f]]
