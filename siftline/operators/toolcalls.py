"""Tool calls as columns: checks, plans, traces, request gates, renames.

A value is its canonical JSON text. A call is ``struct<name, args map<string,string>>``; a
plan, and what a model selected, is ``array<array<call>>`` by stage; results have the same
shape. A tool is ``struct<name, props map<string,struct<type,enum,description>>, required>``.
Everything here is a column expression, so a record is judged where it is scanned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators.generators import drawn, picked

CALL = "struct<name:string,args:map<string,string>>"
TOOL = "struct<name:string,props:map<string,struct<type:string,enum:array<string>,description:string>>,required:array<string>>"
RESULT = "struct<ok:boolean,call:string,receipt:string,code:string,stage:int>"
LINK = "struct<stage:int,field:string,source:string>"

# The patterns' stages (calls in each) and their derived values (stage, field, source).
SHAPES = {
    "single": ((1,), ()),
    "parallel": ((2,), ()),
    "multi_turn": ((1, 1), ((1, "prior_receipt", "stage0.call0.result.receipt"),)),
    "error_recovery": ((1, 1), ((1, "recovery_code", "stage0.call0.error.code"),)),
    "long_chain": (
        (2, 1, 1, 1),
        (
            (1, "first_receipt", "stage0.call0.result.receipt"), (1, "second_receipt", "stage0.call1.result.receipt"), (2, "prior_receipt", "stage1.call0.result.receipt"),
            (3, "recovery_code", "stage2.call0.error.code"), (3, "prior_receipt", "stage1.call0.result.receipt"),
        ),
    ),
}
TIERS = {"single": "T1", "parallel": "T2", "multi_turn": "T3", "error_recovery": "T3", "long_chain": "T4"}
#: Which stage of a pattern is down, the reasons of unequal links, the names of the gates.
DOWN = {"error_recovery": 0, "long_chain": 2}
LINK_REASON = {"multi_turn": "multi_turn_result_mismatch", "error_recovery": "error_recovery_mismatch", "long_chain": "long_chain_result_mismatch"}
GATES = ("schema_semantics", "typed_value_fidelity", "schema_derived_leak", "operational_invention")
NUMBER = r"(?<![A-Za-z0-9_])[-+]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d+)?(?![A-Za-z0-9_])"
QUOTED = r'"(?:\\.|[^"\\])*"'
SOURCE = r"^stage(\d+)\.call(\d+)\.(result|error)\.([A-Za-z0-9_]+)$"
WHOLE_NUMBER = r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"


def json_text(text: Column) -> Column:
    """A string as JSON text; a null stays null."""
    both = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substring(both, F.lit(2), F.length(both) - 2))


def canonical_call(call: Column) -> Column:
    """P1 of a call: sorted keys, no spaces."""
    pairs = F.transform(F.array_sort(F.map_entries(call["args"])), lambda e: F.concat(json_text(e.key), F.lit(":"), e.value))
    return F.concat(F.lit('{"arguments":{'), F.array_join(pairs, ","), F.lit('},"name":'), json_text(call["name"]), F.lit("}"))


def canonical_calls(calls: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(calls, canonical_call), ","), F.lit("]"))


def first_of(reasons: Column) -> Column:
    """The first entry that is not null, else null."""
    return F.try_element_at(F.array_compact(reasons), F.lit(1))


# ---- checks of one call ----


def value_fault(value: Column, spec: Column) -> Column:
    """the type or enum that a value misses; a boolean is no number, an array holds strings."""
    kind, seen = spec["type"], F.schema_of_variant(F.try_parse_json(value))
    whole, number = value.rlike(r"^-?\d+$"), value.rlike(WHOLE_NUMBER)
    fine = (
        F.when(kind == "string", seen == "STRING").when(kind == "integer", whole).when(kind == "number", number).when(kind == "boolean", seen == "BOOLEAN")
        .when(kind == "array", seen.isin("ARRAY<STRING>", "ARRAY<VOID>")).otherwise(True)
    )
    wrong = F.when(~F.coalesce(fine, F.lit(False)), F.concat(F.lit("type_"), kind))
    return F.coalesce(wrong, F.when((F.size(spec["enum"]) > 0) & ~F.array_contains(spec["enum"], value), "enum"))


def tool_named(tools: Column, name: Column) -> Column:
    return F.try_element_at(F.filter(tools, lambda t: t["name"] == name), F.lit(-1))


def call_fault(call: Column, tools: Column) -> Column:
    """the first rule that a call breaks, or null."""
    tool, args = tool_named(tools, call["name"]), call["args"]
    faults = F.transform(F.map_entries(args), lambda e: F.concat(value_fault(e.value, F.element_at(tool["props"], e.key)), F.lit(":"), e.key))
    return (
        F.when(tool.isNull(), "undeclared_function").when(args.isNull(), "arguments_not_object")
        .when(F.size(F.array_except(F.map_keys(args), F.map_keys(tool["props"]))) > 0, "unknown_argument")
        .when(F.size(F.array_except(tool["required"], F.map_keys(args))) > 0, "missing_required").otherwise(first_of(faults))
    )


def turn_text(text: Column) -> tuple[Column, Column]:
    """F8: (JSON text of a turn, reason): one fence around it is taken off, half a fence is refused."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    inner = F.regexp_extract(bare, r"(?is)^```(?:json)?\s*(.*?)\s*```$", 1)
    fenced = bare.startswith("```")
    broken = fenced & ~bare.rlike(r"(?is)^```(?:json)?\s*(.*?)\s*```$")
    body = F.when(fenced, inner).otherwise(bare)
    return body, F.when(broken, "json_fence").when(F.try_parse_json(body).isNull(), "json_parse")


def turn_calls(text: Column, tools: Column) -> Column:
    """struct<calls, reason> of a model turn ``{"calls": [..]}``."""
    body, reason = turn_text(text)
    raw = F.from_json(body, "map<string,string>")
    items = F.from_json(raw["calls"], "array<string>")
    parts = F.transform(items, lambda x: F.from_json(x, "map<string,string>"))
    shape = lambda m: (F.size(m) == 2) & m["name"].isNotNull() & F.map_contains_key(m, "arguments")
    call = lambda m: F.struct(m["name"].alias("name"), F.from_json(m["arguments"], "map<string,string>").alias("args"))
    kept = lambda m: F.transform_values(m["args"], lambda k, v: F.when(v.rlike(r"^[\[{]|^(true|false|null)$") | v.rlike(WHOLE_NUMBER), v).otherwise(json_text(v)))
    calls = F.transform(F.transform(parts, call), lambda c: F.struct(c["name"].alias("name"), kept(c).alias("args")))
    fault = first_of(F.transform(F.arrays_zip(parts.alias("m"), calls.alias("c")), lambda z: F.when(~F.coalesce(shape(z["m"]), F.lit(False)), "call_shape").otherwise(call_fault(z["c"], tools))))
    twice = F.size(F.array_distinct(F.transform(calls, canonical_call))) < F.size(calls)
    why = F.coalesce(
        reason, F.when(raw.isNull() | (F.size(raw) != 1) | items.isNull(), "turn_shape"), F.when(F.size(items) == 0, "empty_calls"), fault, F.when(twice, "duplicate_call")
    )
    return F.struct(F.when(why.isNull(), calls).alias("calls"), why.alias("reason"))


def aligned(raws: Column, expected: Column) -> Column:
    """The calls in the expected order if both are the same multiset, else null."""
    bag = lambda calls: F.array_sort(F.transform(calls, canonical_call))
    return F.when(bag(raws) == bag(expected), expected)


# ---- plans, execution, acceptance ----


def executed(call: Column, stage: Column, pattern: Column) -> Column:
    """A receipt of the call; the stage of a pattern that is down gives a code."""
    down = reduce(lambda a, b: a | b, ((pattern == p) & (stage == s) for p, s in DOWN.items()))
    receipt = F.concat(F.lit("mock-"), F.substring(F.sha2(canonical_call(call), 256), 1, 12))
    return F.struct((~down).alias("ok"), call["name"].alias("call"), F.when(~down, receipt).alias("receipt"), F.when(down, "UNAVAILABLE").alias("code"), F.when(~down, stage + 1).cast("int").alias("stage"))


def linked_value(results: Column, source: Column) -> Column:
    """What ``stageI.callJ.(result|error).field`` names, as text; null if there is none."""
    part = lambda i: F.regexp_extract(source, SOURCE, i)
    at = F.get(F.get(results, F.try_to_number(part(1), F.lit("999")).cast("int")), F.try_to_number(part(2), F.lit("999")).cast("int"))
    return F.when(part(3) == "result", F.when(part(4) == "receipt", at["receipt"]).when(part(4) == "stage", at["stage"].cast("string"))).when((part(3) == "error") & (part(4) == "code"), at["code"])


def links_hold(links: Column, selected: Column, results: Column) -> Column:
    """every derived argument stands alone in its stage and equals what its source returned."""
    calls = lambda x: F.get(selected, x["stage"])
    same = lambda x: F.get(calls(x), F.lit(0))["args"][x["field"]] == json_text(linked_value(results, x["source"]))
    return F.forall(links, lambda x: F.coalesce((F.size(calls(x)) == 1) & same(x), F.lit(False)))


def stage_fault(stage: Column, record: dict[str, Column]) -> Column:
    """The first reason of one stage: plan, number of results, then each call and its result."""
    calls, results = F.get(record["selected"], stage), F.get(record["results"], stage)
    pairs = F.filter(F.arrays_zip(calls.alias("call"), results.alias("result")), lambda z: z["call"].isNotNull() & z["result"].isNotNull())
    one = lambda z: F.coalesce(call_fault(z["call"], record["tools"]), F.when(~z["result"].eqNullSafe(executed(z["call"], stage, record["pattern"]).cast(RESULT)), "executor_inconsistent"))
    return (
        F.when(canonical_calls(calls) != canonical_calls(F.get(record["plan"], stage)), "plan_alignment")
        .when(F.size(calls) != F.size(results), "executor_cardinality").otherwise(first_of(F.transform(pairs, one)))
    )


def rejection(df: DataFrame, patterns: tuple[str, ...] = tuple(LINK_REASON), dirty: str | None = None) -> Column:
    """the first rule a record breaks, or null: contamination (a column), generation
    failures, number of stages, each stage, links of the given patterns."""
    r = {c: df[c] for c in ("tools", "plan", "selected", "results", "pattern", "links", "failures")}
    n = F.least(F.size("selected"), F.size("plan"), F.size("results"))
    stages = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda s: F.when(s < n, stage_fault(s, r)))
    names = F.create_map(*(F.lit(x) for p in patterns for x in (p, LINK_REASON[p])))
    unequal = F.when(r["pattern"].isin(*patterns) & ~links_hold(r["links"], r["selected"], r["results"]), F.try_element_at(names, r["pattern"]))
    short = F.when(F.size("selected") != F.size("plan"), "incomplete_dialogue")
    return F.coalesce(*([df[dirty]] if dirty else []), F.get("failures", F.lit(0)), short, first_of(stages), unequal)


def contaminated(seeds: DataFrame, key: str, names: DataFrame, grams: DataFrame, text: Column) -> DataFrame:
    """(key, reason): a tool of an evaluator's name (lower case), else one shared 8-gram."""
    from siftline.operators.decontam import first_gram_hit

    by_name = seeds.select(key, F.explode("tools.name").alias("name")).select(key, F.lower("name").alias("name")).join(names.select(F.lower("name").alias("name")).distinct(), "name", "left_semi").select(key).distinct()
    shown = seeds.select(key, text.alias("text"))
    by_gram = first_gram_hit(shown, grams, key, "ascii").select(key)
    both = by_name.select(key, F.lit(0).alias("rank")).unionByName(by_gram.select(key, F.lit(1).alias("rank")))
    return both.groupBy(key).agg(F.min("rank").alias("rank")).select(key, F.when(F.col("rank") == 0, "contamination_function_name").otherwise("contamination_8gram").alias("reason"))


def training_messages(request: Column, selected: Column, results: Column) -> Column:
    """User, then the calls and the tool results of each stage."""
    none = F.lit(None).cast("string")
    turn = lambda role, content, name, calls: F.struct(F.lit(role).alias("role"), content.alias("content"), name.alias("name"), calls.alias("tool_calls"))
    asked = lambda calls: turn("assistant", none, none, F.transform(calls, canonical_call))
    told = lambda rs: F.transform(rs, lambda r: turn("tool", F.to_json(r), r["call"], F.lit(None).cast("array<string>")))
    stages = F.flatten(F.transform(F.arrays_zip(selected.alias("s"), results.alias("r")), lambda z: F.concat(F.array(asked(z["s"])), told(z["r"]))))
    return F.concat(F.array(turn("user", request, none, F.lit(None).cast("array<string>"))), stages)


# ---- seeds ----


def made_tool(i: Column, ordinal: int, links: list[str]) -> Column:
    """G1: 2-4 typed properties, at least two of them required, and the fields of derived values."""
    kinds = ("string", "integer", "number", "boolean", "array")
    number = drawn("tool", i, f"count{ordinal}", 3) + 2
    names = F.transform(F.sequence(F.lit(1), number), lambda k: F.format_string(f"arg_{ordinal + 1}_%d", k))
    kind = lambda k: picked(kinds, F.pmod(F.xxhash64(i, F.lit(ordinal), k), F.lit(5)))
    options = F.array(*(json_text(F.lit(x)) for x in ("low", "middle", "high")))
    spec = lambda k: F.struct(kind(k).alias("type"), F.when((kind(k) == "string") & (k % 3 == 0), options).otherwise(F.array().cast("array<string>")).alias("enum"), F.concat(F.lit("a setting of type "), kind(k)).alias("description"))
    more = [F.struct(F.lit(f).alias("key"), F.struct(F.lit("string").alias("type"), F.array().cast("array<string>").alias("enum"), F.lit("from an earlier result").alias("description")).alias("value")) for f in links]
    entries = F.transform(F.sequence(F.lit(1), number), lambda k: F.struct(F.element_at(names, k.cast("int")).alias("key"), spec(k).alias("value")))
    required = F.concat(F.slice(names, F.lit(1), (drawn("tool", i, f"required{ordinal}", 3) + 2).cast("int")), F.array(*map(F.lit, links)).cast("array<string>"))
    name = F.concat(F.lit(f"tool{ordinal + 1}_"), F.substring(F.md5(F.concat_ws(":", F.lit("name"), i.cast("string"))), 1, 8))
    return F.struct(name.alias("name"), F.map_from_entries(F.concat(entries, F.array(*more)) if more else entries).alias("props"), required.alias("required")).cast(TOOL)


def made_value(spec: Column, index: Column) -> Column:
    """A value of a property's type, an enum by position."""
    n = index.cast("string")
    plain = F.when(spec["type"] == "string", json_text(F.concat(F.lit("value-"), n))).when(spec["type"] == "integer", n).when(spec["type"] == "number", F.concat(n, F.lit(".25"))).when(spec["type"] == "boolean", (index % 2 == 0).cast("string"))
    return F.when(F.size(spec["enum"]) > 0, F.get(spec["enum"], F.pmod(index, F.lit(3)).cast("int"))).otherwise(F.coalesce(plain, F.concat(F.lit('["tag-'), n, F.lit('"]'))))


def made_call(tool: Column, index: Column, derived: dict[str, Column]) -> Column:
    """A call with all required arguments; derived ones come from earlier results."""
    own = F.filter(tool["required"], lambda k: ~k.isin(*derived)) if derived else tool["required"]
    args = F.map_from_entries(F.transform(own, lambda k: F.struct(k, made_value(tool["props"][k], index + F.array_position(tool["required"], k)))))
    if derived:
        args = F.map_concat(args, F.create_map(*(x for k, v in derived.items() for x in (F.lit(k), json_text(v)))))
    return F.struct(tool["name"].alias("name"), args.alias("args")).cast(CALL)


def near_namesake(tool: Column, ordinal: int) -> Column:
    """A tool of a like name whose first required field has another name."""
    first = tool["required"][0]
    other = F.concat(first, F.lit("_routing"))
    return F.struct(
        F.concat(tool["name"], F.lit(f"_assistant_{ordinal + 1}")).alias("name"), F.transform_keys(tool["props"], lambda k, v: F.when(k == first, other).otherwise(k)).alias("props"),
        F.transform(tool["required"], lambda k: F.when(k == first, other).otherwise(k)).alias("required"),
    )


def seed_plans(spark: SparkSession, n: int, distractors: int = 2) -> DataFrame:
    """(id, pattern, tier, tools, plan, results, links) of n seeds, by id modulo the patterns.

    Stages are made one after the other, so a derived argument is what its source returned.
    """
    parts, i = [], F.col("id")
    for k, (pattern, (stages, links)) in enumerate(SHAPES.items()):
        rows, o, plan, results = spark.range(n).where(i % len(SHAPES) == k), 0, [], []
        for s, count in enumerate(stages):
            fields = {f: src for stage, f, src in links if stage == s}
            for c in range(count):
                derived = {f: linked_value(F.array(*(F.array(*(F.col(x) for x in row)) for row in results)), F.lit(src)) for f, src in fields.items()}
                rows = rows.withColumn(f"tool{o}", made_tool(i, o, list(fields))).withColumn(f"call{o}", made_call(F.col(f"tool{o}"), i + 10 * o, derived))
                rows = rows.withColumn(f"result{o}", executed(F.col(f"call{o}"), F.lit(s), F.lit(pattern)).cast(RESULT))
                o += 1
            plan.append([f"call{o - count + c}" for c in range(count)])
            results.append([f"result{o - count + c}" for c in range(count)])
        nested = lambda cols: F.array(*(F.array(*map(F.col, x)) for x in cols))
        more = [near_namesake(F.col(f"tool{d % o}"), d).cast(TOOL) for d in range(distractors if TIERS[pattern] in ("T3", "T4") else 0)]
        linked = F.array(*(F.struct(F.lit(a).alias("stage"), F.lit(b).alias("field"), F.lit(x).alias("source")) for a, b, x in links)).cast(f"array<{LINK}>")
        parts.append(rows.select("id", F.lit(pattern).alias("pattern"), F.lit(TIERS[pattern]).alias("tier"), F.array(*(F.col(f"tool{j}") for j in range(o)), *more).alias("tools"), nested(plan).alias("plan"), nested(results).alias("results"), linked.alias("links")))
    return reduce(DataFrame.unionByName, parts)


# ---- requests and their gates ----


def supplied(plan: Column, links: Column) -> Column:
    """Distinct values that the user gives, in order: all but derived ones."""
    linked = F.transform(links, lambda x: F.concat_ws(":", x["stage"].cast("string"), x["field"]))
    own = lambda calls, s: F.flatten(F.transform(calls, lambda c: F.filter(F.map_entries(c["args"]), lambda e: ~F.array_contains(linked, F.concat_ws(":", s.cast("string"), e["key"])))))
    return F.array_distinct(F.transform(F.flatten(F.transform(plan, own)), lambda e: e["value"]))


def known(plan: Column) -> Column:
    """All argument values, and the strings and numbers inside containers."""
    every = F.flatten(F.transform(F.flatten(plan), lambda c: F.map_values(c["args"])))
    inside = lambda v: F.when(v.rlike(r"^[\[{]"), F.concat(F.regexp_extract_all(v, F.lit(QUOTED), 0), F.regexp_extract_all(F.regexp_replace(v, QUOTED, " "), F.lit(NUMBER), 0))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(every, F.flatten(F.transform(every, inside))))


def internal_names(tools: Column) -> Column:
    """Names of tools and properties with four characters or more."""
    names = F.flatten(F.transform(tools, lambda t: F.concat(F.array(t["name"]), F.map_keys(t["props"]))))
    return F.array_distinct(F.filter(names, lambda x: F.length(x) >= 4))


def flat_name(name: Column) -> Column:
    """P10."""
    return F.regexp_replace(F.lower(name), r"[_\-.\s]", "")


def decimal(text: Column) -> Column:
    return F.coalesce(text.try_cast("decimal(38,12)"), text.try_cast("double").try_cast("decimal(38,12)"))


def missing_values(request: Column, values: Column) -> Column:
    """Values without an equal number, or else without their literal, in the request."""
    numbers = F.transform(F.regexp_extract_all(request, F.lit(NUMBER), 0), decimal)
    return F.filter(values, lambda v: F.when(v.rlike(WHOLE_NUMBER), ~F.array_contains(numbers, decimal(v))).otherwise(~F.contains(request, v)))


def leaked_names(request: Column, names: Column, stop: tuple[str, ...] = ()) -> Column:
    """F16: names that stand in the request, exactly or without separators and case."""
    flat = flat_name(request)
    told = lambda n: (flat_name(n) != "") & F.contains(flat, flat_name(n)) & ~F.array_contains(F.array(*map(F.lit, stop)).cast("array<string>"), flat_name(n))
    return F.filter(names, lambda n: F.contains(request, n) | told(n))


def invented(request: Column, facts: Column) -> Column:
    """Quoted literals, and numbers outside quotes, that no known value has."""
    numbers = F.transform(F.filter(facts, lambda v: v.rlike(WHOLE_NUMBER)), decimal)
    quoted = F.filter(F.regexp_extract_all(request, F.lit(QUOTED), 0), lambda q: F.try_parse_json(q).isNotNull() & ~F.array_contains(facts, q))
    outside = F.regexp_extract_all(F.regexp_replace(request, QUOTED, " "), F.lit(NUMBER), 0)
    return F.concat(quoted, F.filter(outside, lambda x: ~F.coalesce(F.array_contains(numbers, decimal(x)), F.lit(False))))


def request_failures(request: Column, tools: Column, plan: Column, links: Column, stop: tuple[str, ...] = ()) -> Column:
    """All gates a request fails, in order; a blank request fails ``request`` alone."""
    bare = F.exists(tools, lambda t: F.exists(F.map_values(t["props"]), lambda p: F.coalesce(F.trim(p["description"]), F.lit("")) == ""))
    tests = (bare, F.size(missing_values(request, supplied(plan, links))) > 0, F.size(leaked_names(request, internal_names(tools), stop)) > 0, F.size(invented(request, known(plan))) > 0)
    found = F.array_compact(F.array(*(F.when(t, g) for t, g in zip(tests, GATES))))
    return F.when(F.coalesce(F.regexp_replace(request, r"\s", ""), F.lit("")) == "", F.array(F.lit("request"))).otherwise(found)


def request_of(pattern: Column, plan: Column, links: Column) -> Column:
    """A request in plain words: a lead for the pattern and the values the user gives."""
    leads = {
        "single": "Please carry this out", "parallel": "Please do both of these side by side", "multi_turn": "Do the first, then hand its receipt to the second",
        "error_recovery": "Try the first and, should it be down, recover by its code", "long_chain": "Go step by step, each with what came back before",
    }
    lead = F.try_element_at(F.create_map(*(F.lit(x) for kv in leads.items() for x in kv)), pattern)
    return F.concat(lead, F.lit(": "), F.array_join(supplied(plan, links), "; "), F.lit(" ."))


# ---- renames ----


def renamed(seeds: DataFrame, names: str, back: bool = False) -> DataFrame:
    """Tools, fields, calls and links through a map column, or back; an unknown name raises.

    Receipts depend on names, so results and derived arguments are made again (G14).
    """
    m = F.map_from_entries(F.transform(F.map_entries(names), lambda e: F.struct(e["value"], e["key"]))) if back else F.col(names)
    to = lambda x: F.coalesce(F.try_element_at(m, x), F.raise_error(F.concat(F.lit("unknown name "), x)))
    keyed = lambda mapping: F.transform_keys(mapping, lambda k, v: to(k))
    tools = F.transform("tools", lambda t: F.struct(to(t["name"]).alias("name"), keyed(t["props"]).alias("props"), F.transform(t["required"], to).alias("required")))
    plan = F.transform("plan", lambda s: F.transform(s, lambda c: F.struct(to(c["name"]).alias("name"), keyed(c["args"]).alias("args"))))
    links = F.transform("links", lambda x: F.struct(x["stage"].alias("stage"), to(x["field"]).alias("field"), x["source"].alias("source")))
    return recomputed(seeds.withColumns({"tools": tools, "plan": plan, "links": links}))


def recomputed(seeds: DataFrame) -> DataFrame:
    """Results, and derived arguments from them, folded over the stages."""
    start = F.struct(F.array().cast(f"array<array<{CALL}>>").alias("plan"), F.array().cast(f"array<array<{RESULT}>>").alias("results"))

    def stage(done: Column, calls: Column) -> Column:
        s = F.size(done["plan"])
        source = lambda k: F.get(F.filter("links", lambda x: (x["stage"] == s) & (x["field"] == k)), F.lit(0))["source"]
        value = lambda k, old: F.coalesce(json_text(linked_value(done["results"], source(k))), old)
        now = F.transform(calls, lambda c: F.struct(c["name"].alias("name"), F.transform_values(c["args"], value).alias("args")))
        told = F.transform(now, lambda c: executed(c, s, F.col("pattern")).cast(RESULT))
        return F.struct(F.array_append(done["plan"], now).alias("plan"), F.array_append(done["results"], told).alias("results"))

    folded = seeds.withColumn("folded", F.aggregate("plan", start, stage))
    return folded.withColumns({"plan": F.col("folded.plan"), "results": F.col("folded.results")}).drop("folded")


def mock_names(tools: Column, prefix: str = "m") -> Column:
    """A map from each name of a seed to its own mock name."""
    names = F.array_distinct(F.flatten(F.transform(tools, lambda t: F.concat(F.array(t["name"]), F.map_keys(t["props"])))))
    return F.map_from_entries(F.transform(names, lambda x, i: F.struct(x, F.format_string(f"{prefix}%03d", i))))


def receipt_sources(results: Column) -> Column:
    """A map from each receipt to ``stage:call``."""
    each = F.flatten(F.transform(results, lambda rs, s: F.transform(rs, lambda r, c: F.struct(r["receipt"].alias("k"), F.format_string("%d:%d", s, c).alias("v")))))
    return F.map_from_entries(F.filter(each, lambda e: e["k"].isNotNull()))


def item_flags(kind: Column, names: Column, known_names: Column, name_match: Column, arg_match: Column) -> Column:
    """Flags of a positive item; over-triggering of a negative one."""
    valid = (F.size(names) > 0) & (F.size(F.array_except(names, known_names)) == 0)
    neg = kind == "neg"
    return F.struct(
        F.when(~neg, valid).alias("format_valid"), F.when(~neg, name_match).alias("name_match"), F.when(~neg, arg_match).alias("arg_match"), F.when(neg, F.size(names) > 0).alias("over_trigger"),
    )


def structure(tools: DataFrame, column: str = "tools") -> DataFrame:
    """(kind, value, n): how many properties tools have, and of which types."""
    t = tools.select(F.explode(column).alias("t")).select("t.props")
    arity = t.select(F.lit("arity").alias("kind"), F.size("props").cast("string").alias("value"))
    types = t.select(F.explode(F.map_values("props")).alias("p")).select(F.lit("type").alias("kind"), F.col("p.type").alias("value"))
    return arity.unionByName(types).groupBy("kind", "value").agg(F.count("*").alias("n"))
