"""Conversations (P34-P37, P45, W15, G15, S16): ordered messages of each conversation, with error reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Source roles and the role each becomes.
ROLES = {"system": "system", "user": "user", "assistant": "assistant", "tool": "tool", "function": "tool", "tool_response": "tool", "tool_call": "assistant"}
TOOLS_HEAD = "You may call these tools:\n"
TOOLS_TAIL = "\nReply with a tool call when one is needed."


def role_of(role: Column) -> Column:
    """The mapped role; null for an unknown one."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair)), role)


def gathered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, messages): array of (turn, role, content) in turn order; null content is empty."""
    rows = turns.select(conv, F.struct(F.col(turn).alias("turn"), F.col(role).alias("source_role"), role_of(F.col(role)).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("content")).alias("m"))
    return rows.groupBy(conv).agg(F.array_sort(F.collect_list("m")).alias("messages"))


def normalized(conversations: DataFrame, native: bool = False) -> DataFrame:
    """(.., messages, error): system text folded into the first user turn, or kept first in ``native`` form.

    The first failing rule is the error: unknown_role, multiple_systems, no_user, no_assistant.
    """
    m = F.col("messages")
    system = F.filter(m, lambda x: x.role == "system")
    rest = F.filter(m, lambda x: x.role != "system")
    d = conversations.withColumns({"__sys": F.trim(F.coalesce(F.get(system, F.lit(0)).content, F.lit(""))), "__rest": rest, "__n": F.size(system)})
    d = d.withColumn("__user", F.array_position(F.transform("__rest", lambda x: x.role), "user") - 1)
    has = F.length("__sys") > 0
    error = (
        F.when(F.exists(m, lambda x: x.role.isNull()), "unknown_role").when(F.col("__n") > 1, "multiple_systems")
        .when(has & (F.col("__user") < 0) & F.lit(not native), "no_user").when(~F.exists("__rest", lambda x: x.role == "assistant"), "no_assistant")
    )
    plain = F.transform("__rest", lambda x: F.struct(x.role.alias("role"), x.content.alias("content")))
    if native:
        head = F.array(F.struct(F.lit("system").alias("role"), F.col("__sys").alias("content")))
        out = F.when(has, F.concat(head, plain)).otherwise(plain)
    else:
        folded = F.transform("__rest", lambda x, i: F.struct(x.role.alias("role"), F.when(i == F.col("__user"), F.concat(F.col("__sys"), F.lit("\n\n"), x.content)).otherwise(x.content).alias("content")))
        out = F.when(has, folded).otherwise(plain)
    return d.withColumns({"error": error, "messages": F.when(error.isNull(), out)}).drop("__sys", "__rest", "__n", "__user")


def before_first_assistant(messages: Column) -> Column:
    """The messages before the first assistant turn; all of them if there is none."""
    at = F.array_position(F.transform(messages, lambda x: x.role), "assistant")
    return F.when(at > 0, F.slice(messages, F.lit(1), (at - 1).cast("int"))).otherwise(messages)


def rendered(messages: Column) -> Column:
    """One text with role wrappers."""
    return F.array_join(F.transform(messages, lambda x: F.concat(F.lit("<|"), x.role, F.lit("|>\n"), x.content, F.lit("<|end|>\n"))), "")


def assistant_spans(text: Column) -> Column:
    """Start and end (exclusive, from 0) of each assistant content in a rendered text."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)<\|(\w+)\|>\n(.*?)<\|end\|>\n"), 0)
    ends = F.aggregate(parts, F.array().cast("array<int>"), lambda a, p: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + F.length(p))))
    spans = F.zip_with(parts, ends, lambda p, e: F.struct((e - F.length(p) + F.length(F.regexp_extract(p, r"^<\|\w+\|>\n", 0))).alias("start"), (e - 8).alias("end"), p.startswith("<|assistant|>").alias("own")))
    return F.transform(F.filter(spans, lambda s: s.own), lambda s: F.struct(s.start.alias("start"), s.end.alias("end")))


def trainer_record(conversations: DataFrame, source: str, domain: str) -> DataFrame:
    """Messages with source and domain, bad ones left out."""
    return conversations.where("error is null").select("messages", F.lit(source).alias("_source"), F.lit(domain).alias("_domain"))


def tools_text(tools: Column) -> Column:
    """A header, one JSON text a line, a fixed end."""
    return F.concat(F.lit(TOOLS_HEAD), F.array_join(tools, "\n"), F.lit(TOOLS_TAIL))


def tool_calls(text: Column) -> Column:
    """(name, args) of each tool_call block; blocks without a function are skipped."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), 1)
    found = F.filter(blocks, lambda b: b.rlike(r"<function=[^>\s]+>"))
    pairs = lambda b: F.arrays_zip(F.regexp_extract_all(b, F.lit(r"(?s)<parameter=([^>\s]+)>(.*?)</parameter>"), 1).alias("k"), F.transform(F.regexp_extract_all(b, F.lit(r"(?s)<parameter=([^>\s]+)>(.*?)</parameter>"), 2), lambda s: F.trim(s)).alias("v"))
    return F.transform(found, lambda b: F.struct(F.regexp_extract(b, r"<function=([^>\s]+)>", 1).alias("name"), F.map_from_entries(F.transform(pairs(b), lambda p: F.struct(p.k, p.v))).alias("args")))
