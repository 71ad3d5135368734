"""Queries of conversations, gates and job events."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.operators import conversations as C
from siftline.operators import events as E
from siftline.operators import gates as G
from siftline.plans.fixtures import Fixture, Mixed
from siftline.session import table

CALLS = Mixed(Fixture("id int, text string", [
    (1, "ok <tool_call>\n<function=get_time>\n<parameter=city>Tokyo</parameter>\n<parameter=n> 3 </parameter>\n</function>\n</tool_call>"),
    (2, "none"), (3, "<tool_call>broken</tool_call><tool_call><function=a></function></tool_call>"),
]), "conversations", ("1000 + conv_id * 1000 + turn", "CASE turn % 3 WHEN 0 THEN concat(text, '<tool_call>', chr(10), '<function=f', turn, '>', chr(10), '<parameter=n>', length(text), '</parameter>', chr(10), '<parameter=m> ', conv_id, ' </parameter></function></tool_call>') WHEN 1 THEN text ELSE concat('<tool_call>', text, '</tool_call><tool_call><function=g></function></tool_call>') END"))


def _conv(spark, sf):
    return C.gathered(table(spark, sf, "conversations"))


def conv_normalize(spark, sf):
    """P35 native: roles in order, number of messages, first error."""
    d = C.normalized(_conv(spark, sf), native=True)
    return d.select("conv_id", F.array_join(F.transform("messages", lambda m: m.role), ",").alias("roles"), F.when(F.col("messages").isNotNull(), F.size("messages")).alias("n"), "error")


def conv_preamble(spark, sf):
    """P35 preamble: the system text stands in the first user turn."""
    d = C.normalized(_conv(spark, sf))
    return d.select("conv_id", "error", F.md5(F.get(F.col("messages"), F.lit(0)).content).alias("first_digest"), F.when(F.col("messages").isNotNull(), F.size("messages")).alias("n"))


def conv_first_assistant(spark, sf):
    """How many messages, and which roles, stand before the first assistant turn."""
    d = _conv(spark, sf).select("conv_id", C.before_first_assistant(F.col("messages")).alias("m"))
    return d.select("conv_id", F.size("m").alias("n"), F.array_join(F.transform("m", lambda x: x.role), ",").alias("roles"))


def conv_render(spark, sf):
    """The rendered text's digest and how many characters are the assistant's."""
    d = C.normalized(_conv(spark, sf)).where("error is null").select("conv_id", C.rendered(F.col("messages")).alias("r"))
    d = d.withColumn("s", C.assistant_spans(F.col("r")))
    return d.select("conv_id", F.md5("r").alias("digest"), F.aggregate("s", F.lit(0), lambda a, x: a + x.end - x.start).cast("long").alias("own_chars"), F.size("s").alias("n_spans"))


def conv_trainer(spark, sf):
    """Records written and left out."""
    d = C.normalized(_conv(spark, sf))
    return d.agg(F.count("*").alias("n_in"), F.count_if(F.col("error").isNull()).alias("written"), F.count_if(F.col("error").isNotNull()).alias("bad"))


def xml_tool_calls(spark, sf):
    c = CALLS.frame(spark, sf).select("id", F.explode_outer(C.tool_calls(F.col("text"))).alias("c"))
    return c.select("id", F.col("c.name").alias("name"), F.array_join(F.array_sort(F.transform(F.map_entries("c.args"), lambda e: F.concat(e.key, F.lit("="), e.value))), ";").alias("args"))


def _turns(spark, sf):
    t = table(spark, sf, "conversations").where("role = 'user' and text is not null")
    own = t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", F.pmod("conv_id", F.lit(4)).alias("style"))
    near = own.where("id % 3 = 0").select((F.col("id") + 500_000_000).alias("id"), F.concat("text", F.lit(" !")).alias("text"), "style")  # near copies of a third
    return own.unionByName(near)


def gates_quota(spark, sf):
    return G.quota_gates(_turns(spark, sf), "id", "text", "style")


def gates_shadow(spark, sf):
    """By style, on cheap row gates."""
    t = _turns(spark, sf)
    gates = F.array_compact(F.array(F.when(F.length("text") < 40, F.lit("short")), F.when(F.col("text").rlike("[0-9]"), F.lit("number")), F.when(F.contains("text", F.lit("\n")), F.lit("lines"))))
    return G.shadow_report(t.withColumn("g", gates), ["style"], F.col("g"), ["short", "number", "lines"])


def job_events(spark, sf):
    e = table(spark, sf, "events").select("user_id", "ts", F.col("event_id").alias("poll"), "event_type")
    state = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("running")
    return E.confirmed(e, "user_id", ["ts", "poll"], state).select("event_id", "user_id", "state", "poll")


def unread_events(spark, sf):
    """T5: events of users who never clicked are unread, here."""
    acks = table(spark, sf, "events").where("event_type = 'click'").select("user_id").distinct()
    told = job_events(spark, sf)
    ack = told.join(acks, "user_id", "left_semi").where("state = 'failed'").select("event_id")
    return E.unread(told, ack).select("event_id", "state")


MSGS = """t AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 'system' WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'assistant' WHEN 'tool' THEN 'tool' WHEN 'function' THEN 'tool' WHEN 'tool_response' THEN 'tool' WHEN 'tool_call' THEN 'assistant' END AS r, coalesce(text, '') AS c FROM conversations),
s AS (SELECT conv_id, bool_or(r IS NULL) AS unknown, count(*) FILTER (r = 'system') AS n_sys, trim(coalesce(min_by(c, turn) FILTER (r = 'system'), '')) AS sys, min(turn) FILTER (r = 'user') AS u, count(*) FILTER (r = 'assistant') AS n_as, min(turn) FILTER (r = 'assistant') AS fa FROM t GROUP BY conv_id)"""
ERR = "CASE WHEN unknown THEN 'unknown_role' WHEN n_sys > 1 THEN 'multiple_systems' {x} WHEN n_as = 0 THEN 'no_assistant' END"
ERR_P = ERR.format(x="WHEN length(sys) > 0 AND u IS NULL THEN 'no_user'")
PRE = f"{MSGS}, e AS (SELECT *, {ERR_P} AS error FROM s), m AS (SELECT t.conv_id, turn, r, CASE WHEN turn = u AND length(sys) > 0 THEN sys || chr(10) || chr(10) || c ELSE c END AS c FROM t JOIN e USING (conv_id) WHERE r <> 'system' AND error IS NULL)"
POLL = "e AS (SELECT user_id, ts, event_id AS poll, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS state FROM events), f AS (SELECT *, CASE WHEN lag(state) OVER w IS DISTINCT FROM state THEN 1 ELSE 0 END AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, poll)), i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, poll) AS island FROM f), c AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY ts, poll) AS k FROM i), told AS (SELECT user_id || '--' || state AS event_id, user_id, state, min_by(poll, (ts, poll)) AS poll FROM c WHERE k = 2 AND state <> 'running' GROUP BY user_id, state)"
TURNS = "o0 AS (SELECT conv_id * 1000 + turn AS id, text, conv_id % 4 AS style FROM conversations WHERE role = 'user' AND text IS NOT NULL), u AS (SELECT * FROM o0 UNION ALL SELECT id + 500000000, text || ' !', style FROM o0 WHERE id % 3 = 0), t AS (SELECT id, text, style, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+')[1:2], ' ') AS p2, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+')[1:4], ' ') AS p4 FROM u)"
ORACLES = {
    "conv_normalize": f"WITH {MSGS}, e AS (SELECT *, {ERR.format(x='')} AS error FROM s), m AS (SELECT conv_id, string_agg(r, ',' ORDER BY turn) AS roles, count(*) AS n FROM t WHERE r <> 'system' GROUP BY conv_id) SELECT e.conv_id, CASE WHEN error IS NULL THEN CASE WHEN length(sys) > 0 THEN 'system,' ELSE '' END || roles END AS roles, CASE WHEN error IS NULL THEN n + (length(sys) > 0)::INT END AS n, error FROM e LEFT JOIN m USING (conv_id)",
    "conv_preamble": f"WITH {PRE}, o AS (SELECT conv_id, md5(min_by(c, turn)) AS first_digest, count(*) AS n FROM m GROUP BY conv_id) SELECT e.conv_id, error, first_digest, n FROM e LEFT JOIN o USING (conv_id)",
    "conv_first_assistant": f"WITH {MSGS} SELECT s.conv_id, count(t.turn) AS n, coalesce(string_agg(r, ',' ORDER BY turn), '') AS roles FROM s LEFT JOIN t ON t.conv_id = s.conv_id AND (fa IS NULL OR turn < fa) GROUP BY s.conv_id",
    "conv_render": f"WITH {PRE} SELECT conv_id, md5(string_agg('<|' || r || '|>' || chr(10) || c || '<|end|>' || chr(10), '' ORDER BY turn)) AS digest, sum(CASE WHEN r = 'assistant' THEN length(c) ELSE 0 END) AS own_chars, count(*) FILTER (r = 'assistant') AS n_spans FROM m GROUP BY conv_id",
    "conv_trainer": f"WITH {MSGS}, e AS (SELECT {ERR_P} AS error FROM s) SELECT count(*) AS n_in, count(*) FILTER (error IS NULL) AS written, count(*) FILTER (error IS NOT NULL) AS bad FROM e",
    "xml_tool_calls": f"""WITH b AS (SELECT id, unnest(regexp_extract_all(text, '(?s)<tool_call>(.*?)</tool_call>', 1)) AS b FROM {CALLS.sql}),
c AS (SELECT id, trim(regexp_extract(b, '<function=([^>]+)>', 1)) AS name, regexp_extract_all(b, '(?s)<parameter=([^>]+)>(.*?)</parameter>', 1) AS k, regexp_extract_all(b, '(?s)<parameter=([^>]+)>(.*?)</parameter>', 2) AS v FROM b WHERE regexp_matches(b, '<function=([^>]+)>'))
SELECT t.id, name, array_to_string(list_sort([trim(k[i]) || '=' || trim(v[i]) FOR i IN range(1, len(k) + 1)]), ';') AS args FROM (SELECT id FROM {CALLS.sql}) t LEFT JOIN c ON c.id = t.id""",
    "gates_quota": f"""WITH {TURNS}, o AS (SELECT *, count(*) OVER () AS n, count(*) OVER (PARTITION BY p2) AS a, count(*) OVER (PARTITION BY p4) AS b, count(*) OVER (PARTITION BY style) AS c FROM t),
g AS (SELECT id, text, array_to_string(list_filter([CASE WHEN n >= 10 AND a / n > 0.25 THEN 'batch_prefix_2' END, CASE WHEN n >= 10 AND b / n > 0.10 THEN 'batch_prefix_4' END, CASE WHEN n >= 10 AND c / n > 0.35 THEN 'batch_style' END], lambda x: x IS NOT NULL), ',') AS gates FROM o),
s AS (SELECT id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS s FROM g WHERE gates = ''),
k AS (SELECT id, list_distinct(CASE WHEN length(s) < 3 THEN [s] ELSE [substr(s, i, 3) FOR i IN range(1, length(s) - 1)] END) AS g FROM s),
d AS (SELECT DISTINCT y.id FROM k x JOIN k y ON x.id < y.id AND len(x.g) >= 0.92 * len(y.g) AND len(y.g) >= 0.92 * len(x.g) WHERE len(list_intersect(x.g, y.g)) / (len(x.g) + len(y.g) - len(list_intersect(x.g, y.g))) >= 0.92)
SELECT g.id, CASE WHEN d.id IS NOT NULL THEN 'skeleton_similarity' ELSE gates END AS gates FROM g LEFT JOIN d ON d.id = g.id""",
    "gates_shadow": f"WITH {TURNS} SELECT style, count(*) AS n, count(*) FILTER (NOT a AND NOT b AND NOT c) AS passed, round(avg(a::INT), 6) AS fail_short, round(avg(b::INT), 6) AS fail_number, round(avg(c::INT), 6) AS fail_lines FROM (SELECT style, length(text) < 40 AS a, regexp_matches(text, '[0-9]') AS b, contains(text, chr(10)) AS c FROM t) GROUP BY style",
    "job_events": f"WITH {POLL} SELECT * FROM told",
    "unread_events": f"WITH {POLL} SELECT event_id, state FROM told WHERE NOT (state = 'failed' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'click'))",
}
QUERIES = {name: globals()[name] for name in ORACLES}
