"""Queries of JSON functions, tool calls, edits, packing and generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import jsons as J
from siftline.operators import generators as G
from siftline.operators import packing as K
from siftline.operators import rewards as W
from siftline.operators import toolcalls as C
from siftline.session import table

# ---- edits and rewards: a small file for each document, and completions of eight kinds ----

#: Columns that both engines read: a file, what it should become, and a completion by the document's number.
FILE = {
    "path": "concat('src/', coalesce(source, 'none'), '.txt')", "n": "coalesce(length(text), 0) + 1",
    "body": "concat('id ', doc_id, chr(10), 'lang ', coalesce(lang, 'none'), chr(10), 'size ', n, chr(10), 'end', chr(10))", "goal": "replace(body, concat('size ', n), 'size 0')",
}


def _block(search: str, new: str) -> str:
    return f"concat('```', chr(10), '### ', path, chr(10), '<<<<<<< SEARCH', chr(10), {search}, chr(10), '=======', chr(10), {new}, chr(10), '>>>>>>> REPLACE', chr(10), '```')"


SIZE = "concat('size ', n)"
PATCH = f"concat('```diff', chr(10), 'diff --git a/', path, ' b/', path, chr(10), '--- a/', path, chr(10), '+++ b/', path, chr(10), '@@ -2,2 +2,2 @@', chr(10), ' lang ', coalesce(lang, 'none'), chr(10), '-', {SIZE}, chr(10), '+size 0', chr(10), '```')"
KINDS = [
    f"concat('<think>why</think><solution>', chr(10), {_block(SIZE, chr(39) + 'size 0' + chr(39))}, chr(10), '</solution>')", f"concat('<think>why</think><solution>', {_block(SIZE, chr(39) + 'size 1' + chr(39))}, '</solution>')",
    f"concat('<think>not sure</think>', chr(10), {PATCH})", "concat('no format ', n)", f"concat('<think>why</think><solution>', {_block(chr(39) + 'width' + chr(39), SIZE)}, '</solution>')",
    f"concat('<think>why</think><solution>', {_block(SIZE, SIZE)}, '</solution>')", f"concat('<think> </think><solution>', {_block(SIZE, chr(39) + 'size 0' + chr(39))}, '</solution>')", _block(SIZE, "'size 0'"),
]
COMPLETION = "CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN {k}" for i, k in enumerate(KINDS)) + " END"


def _completions(spark, sf):
    d = table(spark, sf, "documents")
    for name, x in FILE.items():
        d = d.withColumn(name, F.expr(x))
    return d.withColumn("completion", F.expr(COMPLETION)).select("doc_id", "path", "body", "goal", "completion")


def edit_reward(spark, sf):
    """A32b-A32g, P20, P25-P31: rewards of all completions; targets are files for odd documents, patches for even ones."""
    c = _completions(spark, sf)
    patch = F.concat(F.lit("--- a/"), "path", F.lit("\n+++ b/"), "path", F.lit("\n@@ -3 +3 @@\n-"), F.split_part("body", F.lit("\n"), F.lit(3)), F.lit("\n+size 0\n"))
    inst = c.select("doc_id", F.create_map("path", "body").alias("files"), F.when(F.col("doc_id") % 2 == 1, F.create_map("path", "goal")).alias("after"), F.when(F.col("doc_id") % 2 == 0, patch).alias("patch"))
    goals = W.targets(inst, "doc_id", "files", "after", "patch").withColumnRenamed("doc_id", "instance")
    out = W.scored(c.withColumn("instance", F.col("doc_id")), goals, "doc_id", "instance", "completion")
    r = F.col("reward")
    return out.select("doc_id", "format_valid", "method", "error", (r == 1).alias("exact"), (r == -1).alias("failed"), ((r > 0) & (r < 1)).alias("partly"), "n_pred_files", F.col("n_oracle_files").cast("bigint").alias("n_oracle_files"))


def lenient_reward(spark, sf):
    """A32h, Y21."""
    c = _completions(spark, sf).withColumn("instance", F.col("doc_id"))
    goals = W.targets(c.select("instance", F.create_map("path", "body").alias("files"), F.create_map("path", "goal").alias("after")), "instance", "files", "after")
    r = F.col("reward")
    return W.lenient(c, goals, "doc_id", "instance", "completion").select("doc_id", (r == 1).alias("exact"), (r == -1).alias("failed"))


def patch_edits(spark, sf):
    """Hunks of every completion with a diff."""
    c = _completions(spark, sf).select("doc_id", W.patch_of(F.col("completion")).alias("patch"))
    return W.hunk_edits(c, "doc_id", "patch").select("doc_id", F.inline("edits"))


def sequence_similarity(spark, sf):
    """P31 on every benchmark item and the item after it."""
    b = table(spark, sf, "benchmark").select("item_id", "text")
    nxt = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return b.join(nxt, "item_id").select("item_id", F.round(W.matched_share("text", "other"), 6).alias("ratio"))


# ---- tool calls ----


def _spec(kind: str, enum: tuple[str, ...] = ()):
    return F.struct(F.lit(kind).alias("type"), F.array(*map(F.lit, enum)).cast("array<string>").alias("enum"), F.lit(f"a {kind}").alias("description"))


def _tool(name: str, props: dict, required: tuple[str, ...]):
    return F.struct(F.lit(name).alias("name"), F.create_map(*(x for k, v in props.items() for x in (F.lit(k), v))).alias("props"), F.array(*map(F.lit, required)).alias("required"))


LOG_TOOL = ("log_event", {"k": ("integer", ()), "kind": ("string", ('"click"', '"view"', '"purchase"'))}, ("k",))
EVENT = {
    "name": "CASE event_id % 7 WHEN 1 THEN concat('log_', event_type) ELSE 'log_event' END", "k": "CASE event_id % 7 WHEN 2 THEN NULL WHEN 3 THEN concat('\"', user_id, '\"') WHEN 4 THEN '1.5' ELSE CAST(user_id AS STRING) END",
    "kind": "concat('\"', event_type, '\"')", "more": "CASE event_id % 7 WHEN 5 THEN 'true' END",
}


def _log_tool():
    name, props, required = LOG_TOOL
    return F.array(_tool(name, {k: _spec(*v) for k, v in props.items()}, required))


def call_checks(spark, sf):
    """the first rule that a call made of each event breaks."""
    e = table(spark, sf, "events").select("event_id", *(F.expr(x).alias(n) for n, x in EVENT.items()))
    args = F.map_filter(F.create_map(F.lit("k"), "k", F.lit("kind"), "kind", F.lit("more"), "more"), lambda k, v: v.isNotNull())
    call = F.struct(F.col("name"), args.alias("args"))
    return e.withColumn("call", call).select("event_id", C.call_fault(F.col("call"), _log_tool()).alias("reason"), F.md5(C.canonical_call(F.col("call"))).alias("digest"))


ONE_CALL = """concat('{"name": "log_event", "arguments": {"kind": "', event_type, '", "k": ', user_id, '}}')"""
TURN = f"""CASE event_id % 8 WHEN 0 THEN concat('{{"calls": [', {ONE_CALL}, ']}}') WHEN 1 THEN concat(' ```json', chr(10), '{{"calls": [', {ONE_CALL}, ']}}', chr(10), '``` ') WHEN 2 THEN concat('```', {ONE_CALL})
WHEN 3 THEN concat('{{"calls": [', {ONE_CALL}) WHEN 4 THEN '{{"calls": []}}' WHEN 5 THEN {ONE_CALL} WHEN 6 THEN concat('{{"calls": [', {ONE_CALL}, ', ', {ONE_CALL}, ']}}') ELSE '{{"calls": [{{"name": "log_event"}}]}}' END"""


def model_turns(spark, sf):
    """Calls of a model's turn, or the reason it is refused."""
    t = table(spark, sf, "events").select("event_id", F.expr(TURN).alias("text"))
    t = t.select("event_id", C.turn_calls(F.col("text"), _log_tool()).alias("x"))
    return t.select("event_id", "x.reason", F.coalesce(F.size("x.calls"), F.lit(0)).cast("bigint").alias("n_calls"))


def _records(spark, sf):
    """Traces of conversations: two turns a stage, a call for each turn, damaged by the conversation's number."""
    t = table(spark, sf, "conversations").select("conv_id", F.struct("turn", "role", F.length(F.coalesce("text", F.lit(""))).alias("n"), F.regexp_extract(F.lower(F.coalesce("text", F.lit(""))), "[a-z]+", 0).alias("w")).alias("t"))
    d = t.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts")).withColumn("damage", F.col("conv_id") % 8)
    size = lambda x: F.when(F.col("damage") == 6, C.json_text(x["n"].cast("string"))).when(F.col("damage") != 7, x["n"].cast("string"))
    args = lambda x: F.map_filter(F.create_map(F.lit("size"), size(x), F.lit("word"), C.json_text(x["w"])), lambda k, v: v.isNotNull())
    call = lambda x: F.struct(F.concat(F.lit("say_"), x["role"]).alias("name"), args(x).alias("args")).cast(C.CALL)
    stages = F.sequence(F.lit(0), F.ceil(F.size("ts") / 2).cast("int") - 1)
    d = d.withColumn("plan", F.transform(stages, lambda s: F.transform(F.slice("ts", s * 2 + 1, F.lit(2)), call)))
    longer = lambda c: F.struct(c["name"].alias("name"), F.transform_values(c["args"], lambda k, v: F.when(k == "size", F.concat(v, F.lit("0"))).otherwise(v)).alias("args"))
    other = F.transform("plan", lambda calls, s: F.transform(calls, lambda c, i: F.when((s == 0) & (i == 0), longer(c)).otherwise(c)))
    d = d.withColumn("selected", F.when(F.col("damage") == 2, F.slice("plan", F.lit(1), F.size("plan") - 1)).when(F.col("damage") == 3, other).otherwise(F.col("plan")))
    told = F.transform("selected", lambda calls, s: F.transform(calls, lambda c: C.executed(c, s, F.lit("single")).cast(C.RESULT)))
    d = d.withColumn("results", told)
    fewer = F.transform("results", lambda rs, s: F.when(s == 0, F.slice(rs, F.lit(1), F.size(rs) - 1)).otherwise(rs))
    wrong = F.transform("results", lambda rs, s: F.transform(rs, lambda r, i: F.when((s == 0) & (i == 0), r.withField("call", F.lit("other"))).otherwise(r)))
    d = d.withColumn("results", F.when(F.col("damage") == 4, fewer).when(F.col("damage") == 5, wrong).otherwise(F.col("results")))
    tools = F.array(*(_tool(f"say_{r}", {"size": _spec("integer"), "word": _spec("string")}, ("size",)) for r in ("user", "assistant", "system")))
    failures = F.when(F.col("damage") == 1, F.array(F.lit("json_parse"))).otherwise(F.array().cast("array<string>"))
    return d.select("conv_id", F.lit("single").alias("pattern"), "plan", "selected", "results", tools.alias("tools"), failures.alias("failures"), F.array().cast(f"array<{C.LINK}>").alias("links"))


def trace_acceptance(spark, sf):
    """The first rule each record breaks."""
    d = _records(spark, sf)
    return d.select("conv_id", F.coalesce(C.rejection(d), F.lit("accepted")).alias("reason"))


def trace_messages(spark, sf):
    """Rendered traces, by role."""
    d = _records(spark, sf).select("conv_id", F.explode(C.training_messages(F.lit("go"), F.col("selected"), F.col("results"))).alias("m"))
    return d.groupBy("conv_id", F.col("m.role").alias("role")).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.size("m.tool_calls"), F.lit(0))).alias("n_calls"))


ASKED = """CASE item_id % 6 WHEN 0 THEN concat('Find "', w, '" among ', item_id, ' .') WHEN 1 THEN concat('Find "', w, '" .') WHEN 2 THEN concat('Use lookup_item: "', w, '" ', item_id, '.0 .')
WHEN 3 THEN concat('Find "', w, '" among ', item_id, ' or 99999 .') WHEN 4 THEN '  ' ELSE concat('The Lookup Item of "', w, '" and "zzz" at ', item_id, ' .') END"""


def request_gates(spark, sf):
    """Gates that a request for each benchmark item fails."""
    b = table(spark, sf, "benchmark").select("item_id", F.regexp_extract(F.lower("text"), "[a-z]+", 0).alias("w")).withColumn("request", F.expr(ASKED))
    call = F.struct(F.lit("lookup_item").alias("name"), F.create_map(F.lit("item_no"), F.col("item_id").cast("string"), F.lit("phrase"), C.json_text(F.col("w"))).alias("args"))
    tools = F.array(_tool("lookup_item", {"item_no": _spec("integer"), "phrase": _spec("string")}, ("item_no", "phrase")))
    found = C.request_failures(F.col("request"), tools, F.array(F.array(call)).cast(f"array<array<{C.CALL}>>"), F.array().cast(f"array<{C.LINK}>"))
    return b.select("item_id", F.array_join(found, ",").alias("failures"))


def seed_records(spark, sf):
    """As many seeds as documents, accepted, asked for, renamed and restored."""
    s = C.seed_plans(spark, table(spark, sf, "documents").count())
    s = s.withColumns({"selected": F.col("plan"), "failures": F.array().cast("array<string>"), "request": C.request_of(F.col("pattern"), F.col("plan"), F.col("links"))})
    s = s.withColumns({"accepted": C.rejection(s).isNull(), "asked": F.size(C.request_failures(F.col("request"), s["tools"], s["plan"], s["links"])) == 0, "names": C.mock_names(F.col("tools"))})
    back = C.renamed(C.renamed(s.withColumn("before", F.to_json(F.struct("plan", "results"))), "names"), "names", back=True)
    return back.select("id", "pattern", "tier", F.size("tools").alias("n_tools"), F.size(F.flatten("plan")).alias("n_calls"), F.size("links").alias("n_links"), "accepted", "asked", (F.to_json(F.struct("plan", "results")) == F.col("before")).alias("restored"))


def call_match(spark, sf):
    """Calls made of the first words of each item against the same calls in another order, with numbers as text, one in four damaged."""
    w = table(spark, sf, "benchmark").select("item_id", F.slice(F.split("text", " "), 1, 4).alias("w"))
    call = lambda name, x: F.struct(name.alias("name"), F.struct(x.alias("x")).alias("arguments"))
    gold = F.transform("w", lambda v, i: call(v, i))
    damage = F.col("item_id") % 4
    pred = F.transform("w", lambda v, i: call(F.when((damage == 1) & (i == 0), F.concat(v, F.lit("?"))).otherwise(v), F.concat(F.when((damage == 2) & (i == 1), i + 1).otherwise(i).cast("string"), F.lit(".0"))))
    pred = F.when(damage == 3, F.slice(pred, 1, 3)).otherwise(F.reverse(pred))
    m = w.select("item_id", J.match_udf(F.to_json(gold), F.to_json(pred)).alias("m"))
    return m.select("item_id", "m.name_match", "m.arg_match")


# ---- JSON, packing, generators ----


def json_leaves(spark, sf):
    """Text leaves of the events' properties and of a nested wrapper."""
    e = table(spark, sf, "events").select("event_id", F.concat(F.lit('{"wrap": ["x", '), F.to_json(F.struct(F.col("event_type").alias("t"))), F.lit("]}")).alias("j"))
    return e.select("event_id", F.array_join(J.leaves_udf("j"), "|").alias("leaves"))


def json_canonical(spark, sf):
    """Sorted keys, no spaces."""
    e = table(spark, sf, "events").select("event_id", F.concat(F.lit('{"z": "'), F.col("event_type"), F.lit('", "a": '), F.get_json_object("props", "$.k"), F.lit("}")).alias("j"))
    return e.select("event_id", J.canonical_udf("j").alias("canonical"))


def json_signals(spark, sf):
    """P39 at any depth, JSON in strings too."""
    calls = F.when(F.col("turn") % 2 == 1, F.array(F.struct(F.struct(F.lit("f").alias("name"), F.lit("{}").alias("arguments")).alias("function"))))
    extra = F.when(F.col("turn") % 3 == 0, F.lit('[{"role": "x", "function_call": 1}]'))
    c = table(spark, sf, "conversations").select(F.to_json(F.struct(F.array(F.struct("role", F.lit("t").alias("content"))).alias("messages"), "conv_id", calls.alias("tool_calls"), extra.alias("extra"))).alias("j"))
    return c.select(F.explode(J.signals_udf("j")).alias("signal", "n")).groupBy("signal").agg(F.sum("n").alias("n"))


def stream_blocks(spark, sf):
    """Blocks of 2,048 tokens, four characters a token."""
    d = table(spark, sf, "documents").select("doc_id", F.ceil(F.length("text") / 4).alias("size"))
    return K.stream_blocks(d, "doc_id", "size", 2048)


def pack_blocks(spark, sf):
    """The words of every document as tokens, packed into blocks of 256 in shards of 1,000 ids."""
    t = F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda w: w != "")
    d = table(spark, sf, "documents").select("doc_id", F.floor(F.col("doc_id") / 1000).alias("shard"), F.transform(t, lambda w: F.length(w)).alias("ids"))
    out = K.token_blocks(d, ["doc_id"], "shard", "ids", "ids", 256, 0)
    return out.select("shard", "block", F.size(F.filter("labels", lambda x: x != -100)).cast("bigint").alias("used"), F.aggregate("ids", F.lit(0), lambda a, x: a + x).cast("bigint").alias("total"))


def seed_table(spark, sf):
    """As many seeds as documents."""
    n = table(spark, sf, "documents").count()
    return G.seeds(spark, n).select("id", "pattern", "tool", "n_props", F.array_join("types", ",").alias("types"))


def mock_receipts(spark, sf):
    """G8."""
    s = G.seeds(spark, table(spark, sf, "documents").count())
    x = G.executed(F.concat_ws(":", "tool", F.col("id").cast("string")), F.lit(0), F.col("pattern")).alias("x")
    return s.select("id", x).select("id", "x.ok", "x.receipt", "x.code")


def bijection_roundtrip(spark, sf):
    """Sources mapped to mock names and mapped back."""
    docs = table(spark, sf, "documents").select("doc_id", "source")
    m = G.name_map(docs, "source", "b")
    there = G.renamed(docs.withColumn("own", F.col("source")), "source", m)
    back = G.renamed(there.withColumn("mock", F.col("source")), "source", m, back=True)
    return back.groupBy("own", "mock").agg(F.count("*").alias("n"), F.bool_and(F.col("own").eqNullSafe(F.col("source"))).alias("restored"))


def router_blocks(spark, sf):
    """Rows that two versions of a table don't share."""
    a = table(spark, sf, "embeddings").select("vec_id", "label")
    b = a.withColumn("label", F.when(F.col("vec_id") % 100 == 0, F.col("label") + 1).otherwise(F.col("label")))
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


H = "(('0x' || substr(md5('g:{n}:' || id), 1, 8))::BIGINT % {m})"
SEEDS = f"""s AS (SELECT id, ['single', 'parallel', 'multi_turn', 'error_recovery'][(id % 4) + 1] AS pattern, {H.format(n="schema", m=197)} AS schema_no, {H.format(n="domain", m=20)} AS domain, {H.format(n="props", m=3)} + 2 AS n_props FROM range(0, (SELECT count(*) FROM documents)) t(id)),
g AS (SELECT *, 'd' || lpad(domain::VARCHAR, 2, '0') || '_tool_' || lpad(schema_no::VARCHAR, 3, '0') AS tool FROM s)"""
BLOCK = r"```.*?\n### (.*)\n<<<<<<< SEARCH\n([\s\S]*?)\n=======\n([\s\S]*?)\n>>>>>>> REPLACE\n```"
MADE = f"n0 AS (SELECT *, {FILE['path']} AS path, {FILE['n']} AS n FROM documents), n1 AS (SELECT *, {FILE['body']} AS body FROM n0), n2 AS (SELECT *, {FILE['goal']} AS goal FROM n1), made AS (SELECT doc_id, path, body, goal, {COMPLETION} AS completion FROM n2)"
ONCE = " ".join(f"WHEN len(string_split(completion, '{t}')) <> 2 THEN 'count of {t} is not 1'" for t in W.TAGS)
#: The strict reading (answer, error, strict_after) and the loose one (loose, loose_after) of every completion.
RUNS = rf"""{MADE}, a AS (SELECT *, regexp_extract(completion, '(?s)<solution>(.*)</solution>', 1) AS answer, trim(regexp_extract(completion, '(?s)<think>(.*)</think>', 1)) AS thought, regexp_replace(completion, '(?s)<think>.*?</think>', '', 'g') AS shown FROM made),
p AS (SELECT *, regexp_extract(answer, '{BLOCK}', 2) AS search, regexp_extract(answer, '{BLOCK}', 3) AS new, regexp_extract(shown, '(?s)```diff\n(.*?)\n```', 1) AS patch FROM a),
h AS (SELECT *, list_filter(string_split(patch, chr(10)), lambda x: NOT starts_with(x, '---') AND NOT starts_with(x, '+++')) AS ls FROM p),
o AS (SELECT *, array_to_string([substr(x, 2) FOR x IN ls IF x[1] IN ('-', ' ')], chr(10)) AS dsearch, array_to_string([substr(x, 2) FOR x IN ls IF x[1] IN ('+', ' ')], chr(10)) AS dnew FROM h),
e AS (SELECT *, CASE {ONCE} WHEN thought = '' THEN 'Thought is empty' WHEN NOT regexp_matches(answer, '{BLOCK}') THEN 'No valid search blocks found' WHEN search = new THEN 'Search and replace blocks are identical'
WHEN NOT contains(chr(10) || body, chr(10) || search) THEN 'Search block not found in the code: ' || chr(10) || search END AS error, substr(replace(chr(10) || body, chr(10) || search, chr(10) || new), 2) AS strict_after,
patch <> '' AND contains(chr(10) || body, chr(10) || dsearch) AS loose, substr(replace(chr(10) || body, chr(10) || dsearch, chr(10) || dnew), 2) AS loose_after FROM o)"""
#: One row a call of the conversations' traces.
TRACES = r"""t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, 'say_' || role AS name, length(coalesce(text, '')) AS n, regexp_extract(lower(coalesce(text, '')), '[a-z]+') AS w, conv_id % 8 AS damage FROM conversations),
z AS (SELECT *, i // 2 AS stage, i % 2 AS c, CASE damage WHEN 6 THEN '"' || n || '"' WHEN 7 THEN NULL ELSE n::VARCHAR END AS size FROM t),
v AS (SELECT *, CASE WHEN damage = 3 AND i = 0 THEN size || '0' ELSE size END AS sel_size, count(*) OVER (PARTITION BY conv_id, stage) AS n_stage FROM z),
q AS (SELECT *, concat_ws(',', size, w, name) AS plan, concat_ws(',', sel_size, w, name) AS sel, CASE WHEN name NOT IN ('say_user', 'say_assistant', 'say_system') THEN 'undeclared_function' WHEN sel_size IS NULL THEN 'missing_required' WHEN NOT regexp_matches(sel_size, '^-?\d+$') THEN 'type_integer:size'
WHEN damage = 5 AND i = 0 AND name <> 'other' THEN 'executor_inconsistent' END AS fault FROM v)"""
ORACLES = {
    "json_leaves": "SELECT event_id, 'x|' || event_type AS leaves FROM events",
    "json_canonical": "SELECT event_id, '{\"a\":' || json_extract_string(props, '$.k') || ',\"z\":\"' || event_type || '\"}' AS canonical FROM events",
    "stream_blocks": "WITH d AS (SELECT doc_id, ceil(length(text) / 4)::BIGINT AS size FROM documents), p AS (SELECT *, (sum(size) OVER (ORDER BY doc_id) - size)::BIGINT AS start FROM d), b AS (SELECT doc_id, unnest(range(start // 2048, (start + size - 1) // 2048 + 1)) AS block FROM p WHERE size > 0) SELECT block, count(*) AS n_pieces, min(doc_id) AS first_key FROM b WHERE block < (SELECT sum(size)::BIGINT // 2048 FROM d) GROUP BY block",
    "seed_table": f"WITH {SEEDS} SELECT id, pattern, tool, n_props, array_to_string([['string', 'integer', 'number', 'boolean'][(schema_no + k) % 4 + 1] FOR k IN range(1, n_props + 1)], ',') AS types FROM g",
    "mock_receipts": f"WITH {SEEDS} SELECT id, pattern <> 'error_recovery' AS ok, CASE WHEN pattern <> 'error_recovery' THEN 'mock-' || substr(sha256(tool || ':' || id), 1, 12) END AS receipt, CASE WHEN pattern = 'error_recovery' THEN 'UNAVAILABLE' END AS code FROM g",
    "json_signals": """WITH c AS (SELECT count(*) AS n, count(*) FILTER (turn % 2 = 1) AS odd, count(*) FILTER (turn % 3 = 0) AS third FROM conversations),
s AS (SELECT unnest(['key:messages', 'key:conv_id', 'messages', 'role', 'key:tool_calls', 'tool_calls', 'function', 'name_arguments', 'key:extra', 'function_call']) AS signal, unnest([n, n, n, n + third, odd, odd, odd, odd, third, third]) AS n FROM c) SELECT * FROM s WHERE n > 0""",
    "bijection_roundtrip": """WITH s AS (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL), m AS (SELECT source, 'b' || md5('b' || source) || source AS o FROM s), r AS (SELECT source, row_number() OVER (ORDER BY md5('b' || source) || source) AS k FROM s)
SELECT d.source AS own, 'fn_' || lpad((k - 1)::VARCHAR, 8, '0') AS mock, count(*) AS n, TRUE AS restored FROM documents d LEFT JOIN r ON r.source = d.source GROUP BY ALL""",
    "router_blocks": """WITH a AS (SELECT vec_id, label FROM embeddings), b AS (SELECT vec_id, CASE WHEN vec_id % 100 = 0 THEN label + 1 ELSE label END AS label FROM embeddings)
SELECT *, 'a' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'b' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""",
    "call_match": """WITH w AS (SELECT item_id, string_split(text, ' ')[1:4] AS w FROM benchmark),
g AS (SELECT item_id, [w[i] FOR i IN range(1, len(w) + 1)] AS gn, [w[i] || ':' || (i - 1) FOR i IN range(1, len(w) + 1)] AS gc, item_id % 4 AS d, w FROM w),
p AS (SELECT item_id, gn, gc, [CASE WHEN d = 1 AND i = 1 THEN w[i] || '?' ELSE w[i] END FOR i IN range(1, len(w) + 1) IF NOT (d = 3 AND i > 3)] AS pn,
[CASE WHEN d = 1 AND i = 1 THEN w[i] || '?' ELSE w[i] END || ':' || CASE WHEN d = 2 AND i = 2 THEN i ELSE i - 1 END FOR i IN range(1, len(w) + 1) IF NOT (d = 3 AND i > 3)] AS pc FROM g)
SELECT item_id, list_sort(gn) = list_sort(pn) AS name_match, list_sort(gc) = list_sort(pc) AS arg_match FROM p""",
    "edit_reward": f"""WITH {RUNS}, r AS (SELECT *, CASE WHEN error IS NULL THEN strict_after WHEN loose THEN loose_after END AS after FROM e)
SELECT doc_id, after IS NOT NULL AS format_valid, CASE WHEN error IS NULL THEN 'search_replace' WHEN loose THEN 'diff_fallback' ELSE 'format_fail' END AS method, CASE WHEN after IS NULL THEN error END AS error,
coalesce(after = goal, FALSE) AS exact, after IS NULL AS failed, coalesce(after <> goal AND after <> body, FALSE) AS partly, coalesce(after <> body, FALSE)::BIGINT AS n_pred_files, (goal <> body)::BIGINT AS n_oracle_files FROM r""",
    "lenient_reward": f"""WITH {RUNS}, b AS (SELECT *, regexp_extract(shown, '{BLOCK}', 2) AS lsearch, regexp_extract(shown, '{BLOCK}', 3) AS lnew FROM e),
r AS (SELECT *, CASE WHEN regexp_matches(shown, '{BLOCK}') THEN CASE WHEN contains(chr(10) || body, chr(10) || lsearch) AND lsearch <> lnew THEN substr(replace(chr(10) || body, chr(10) || lsearch, chr(10) || lnew), 2) END WHEN loose THEN loose_after END AS after FROM b)
SELECT doc_id, coalesce(after = goal, FALSE) AS exact, after IS NULL AS failed FROM r""",
    "patch_edits": f"""WITH {MADE}, l AS (SELECT doc_id, unnest(string_split(d, chr(10))) AS line, unnest(range(1, len(string_split(d, chr(10))) + 1)) AS i FROM (SELECT doc_id, regexp_extract(completion, '(?s)```diff\\n(.*?)\\n```', 1) AS d FROM made) WHERE d <> ''),
k AS (SELECT *, CASE WHEN starts_with(line, '+++ ') THEN 'file' WHEN starts_with(line, '--- ') OR starts_with(line, 'diff --git ') THEN 'end' WHEN starts_with(line, '@@') THEN 'hunk' END AS head FROM l),
h AS (SELECT *, count(head) OVER (PARTITION BY doc_id ORDER BY i) AS island, last_value(CASE WHEN head = 'file' THEN regexp_replace(substr(line, 5), '^[ab]/', '') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS path FROM k)
SELECT doc_id, max(path) AS path, string_agg(substr(line, 2), chr(10) ORDER BY i) FILTER (head IS NULL AND line[1] IN ('-', ' ')) AS search, string_agg(substr(line, 2), chr(10) ORDER BY i) FILTER (head IS NULL AND line[1] IN ('+', ' ')) AS new FROM h GROUP BY doc_id, island HAVING max(head) = 'hunk'""",
    "call_checks": f"""WITH e AS (SELECT event_id, {', '.join(f'{x} AS {n}' for n, x in EVENT.items())} FROM events)
SELECT event_id, CASE WHEN name <> 'log_event' THEN 'undeclared_function' WHEN more IS NOT NULL THEN 'unknown_argument' WHEN k IS NULL THEN 'missing_required' WHEN NOT regexp_matches(k, '^-?\\d+$') THEN 'type_integer:k' WHEN kind NOT IN ('"click"', '"view"', '"purchase"') THEN 'enum:kind' END AS reason,
md5('{{"arguments":{{' || concat_ws(',', '"k":' || k, '"kind":' || kind, '"more":' || more) || '}},"name":"' || name || '"}}') AS digest FROM e""",
    "model_turns": f"""WITH t AS (SELECT event_id, event_type, trim({TURN}) AS text FROM events), b AS (SELECT *, CASE WHEN starts_with(text, '```') THEN regexp_extract(text, '(?is)^```(?:json)?\\s*(.*?)\\s*```$', 1) ELSE text END AS body FROM t),
r AS (SELECT *, CASE WHEN starts_with(text, '```') AND NOT regexp_matches(text, '(?is)^```(?:json)?\\s*(.*?)\\s*```$') THEN 'json_fence' WHEN NOT json_valid(body) THEN 'json_parse' END AS bad FROM b),
c AS (SELECT *, CASE WHEN bad IS NULL THEN json_extract_string(body, '$.calls[*]') END AS calls, CASE WHEN bad IS NULL THEN json_keys(body) END AS keys FROM r),
f AS (SELECT *, CASE WHEN bad IS NOT NULL THEN bad WHEN keys <> ['calls'] THEN 'turn_shape' WHEN len(calls) = 0 THEN 'empty_calls' WHEN json_keys(calls[1]) <> ['name', 'arguments'] THEN 'call_shape' WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'enum:kind' WHEN len(list_distinct(calls)) < len(calls) THEN 'duplicate_call' END AS reason FROM c)
SELECT event_id, reason, CASE WHEN reason IS NULL THEN len(calls) ELSE 0 END AS n_calls FROM f""",
    "trace_acceptance": f"""WITH {TRACES}, g AS (SELECT conv_id, stage, damage, string_agg(plan, ',' ORDER BY c) AS plan, string_agg(sel, ',' ORDER BY c) AS sel, count(*) AS n_calls, count(*) - (damage = 4 AND stage = 0)::INT AS n_results,
min_by(fault, c) FILTER (fault IS NOT NULL AND (damage <> 4 OR stage > 0 OR c < 1)) AS fault FROM q GROUP BY conv_id, stage, damage),
s AS (SELECT *, CASE WHEN plan <> sel THEN 'plan_alignment' WHEN n_calls <> n_results THEN 'executor_cardinality' ELSE fault END AS reason, max(stage) OVER (PARTITION BY conv_id) + 1 AS n FROM g),
x AS (SELECT conv_id, damage, max(n) AS n, max(n) - (damage = 2)::INT AS n_selected, min_by(reason, stage) FILTER (reason IS NOT NULL) AS reason FROM s GROUP BY conv_id, damage)
SELECT conv_id, CASE WHEN damage = 1 THEN 'json_parse' WHEN n <> n_selected THEN 'incomplete_dialogue' ELSE coalesce(reason, 'accepted') END AS reason FROM x""",
    "trace_messages": f"""WITH {TRACES}, k AS (SELECT *, max(stage) OVER (PARTITION BY conv_id) AS last FROM q), s AS (SELECT * FROM k WHERE NOT (damage = 2 AND stage = last)), c AS (SELECT DISTINCT conv_id FROM q)
SELECT conv_id, 'user' AS role, 1 AS n, 0 AS n_calls FROM c UNION ALL SELECT conv_id, 'assistant', count(DISTINCT stage), count(*) FROM s GROUP BY conv_id UNION ALL SELECT conv_id, 'tool', count(*), 0 FROM s WHERE NOT (damage = 4 AND stage = 0 AND c = n_stage - 1) GROUP BY conv_id""",
    "request_gates": f"""WITH b AS (SELECT item_id, regexp_extract(lower(text), '[a-z]+') AS w FROM benchmark), r AS (SELECT *, {ASKED} AS request FROM b),
n AS (SELECT *, [x::DOUBLE FOR x IN regexp_extract_all(regexp_replace(request, '"[^"]*"', ' ', 'g'), '[0-9]+(?:\\.[0-9]+)?')] AS numbers, regexp_extract_all(request, '"[^"]*"') AS quoted, regexp_replace(lower(request), '[_.\\s-]', '', 'g') AS flat FROM r),
f AS (SELECT *, [CASE WHEN NOT list_contains(numbers, item_id::DOUBLE) OR NOT contains(request, '"' || w || '"') THEN 'typed_value_fidelity' END,
CASE WHEN contains(flat, 'lookupitem') OR contains(flat, 'itemno') OR contains(flat, 'phrase') THEN 'schema_derived_leak' END,
CASE WHEN len(list_filter(quoted, lambda x: x <> '"' || w || '"')) > 0 OR len(list_filter(numbers, lambda x: x <> item_id)) > 0 THEN 'operational_invention' END] AS fs FROM n)
SELECT item_id, CASE WHEN trim(request) = '' THEN 'request' ELSE array_to_string(list_filter(fs, lambda x: x IS NOT NULL), ',') END AS failures FROM f""",
}
ROWS_ONLY = ("sequence_similarity", "pack_blocks", "seed_records")
QUERIES = {name: globals()[name] for name in (*ORACLES, *ROWS_ONLY)}
