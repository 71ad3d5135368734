"""Tool calls as columns, and small parsers."""

import json

import pytest
from pyspark.sql import functions as F

from siftline.functions import parsers as R
from siftline.operators import toolcalls as C

TOOLS = [("f", {"n": ("integer", [], "d"), "s": ("string", ['"a"', '"b"'], "d"), "l": ("array", [], "d"), "x": ("number", [], "d"), "t": ("boolean", [], "d")}, ["n"])]


@pytest.fixture(scope="module")
def seeds(spark):
    df = C.seed_plans(spark, 60).withColumns({"selected": F.col("plan"), "failures": F.array().cast("array<string>")})
    df = df.withColumn("request", C.request_of(F.col("pattern"), F.col("plan"), F.col("links"))).cache()
    df.count()
    return df


def reasons(df, dirty=None):
    return {(r.pattern, r.reason) for r in df.withColumn("reason", C.rejection(df, dirty=dirty)).select("pattern", "reason").distinct().collect()}


def test_seeds_follow_their_shapes_and_are_accepted(seeds):
    assert reasons(seeds) == {(p, None) for p in C.SHAPES}
    for r in seeds.collect():
        stages, links = C.SHAPES[r.pattern]
        assert tuple(map(len, r.plan)) == stages and len(r.links) == len(links)
        for x in r.links:
            stage, call = int(x.source[5]), int(x.source[11])
            source = r.results[stage][call]
            assert json.loads(r.plan[x.stage][0].args[x.field]) == (source.receipt if x.source.endswith("receipt") else source.code)
        for tool in r.tools:
            assert len(tool.required) >= 2 and set(tool.required) <= set(tool.props)


def test_damage_is_named(spark, seeds):
    both = lambda **x: reasons(seeds.withColumns(x))
    every = lambda reason: {(p, reason) for p in C.SHAPES}
    assert both(failures=F.array(F.lit("json_parse"))) == every("json_parse")
    assert both(selected=F.slice("selected", F.lit(1), F.size("selected") - 1)) == every("incomplete_dialogue")
    twice = F.transform("selected", lambda s: F.concat(s, F.slice(s, 1, 1)))
    assert both(selected=twice) == every("plan_alignment")
    assert both(results=F.transform("results", lambda s: F.concat(s, F.slice(s, 1, 1)))) == every("executor_cardinality")
    assert both(results=F.transform("results", lambda s: F.transform(s, lambda r: r.withField("call", F.lit("other"))))) == every("executor_inconsistent")
    wrong = F.transform("plan", lambda s: F.transform(s, lambda c: F.struct(c["name"], F.transform_values(c["args"], lambda k, v: F.when(k.endswith("receipt") | (k == "recovery_code"), F.lit('"mock-0"')).otherwise(v)).alias("args"))))
    moved = seeds.withColumn("plan", wrong).withColumn("selected", wrong)
    moved = moved.withColumn("results", F.transform("selected", lambda s, i: F.transform(s, lambda c: C.executed(c, i, F.col("pattern")).cast(C.RESULT))))
    assert reasons(moved) == {("single", None), ("parallel", None), *C.LINK_REASON.items()}
    assert reasons(seeds.withColumn("dirty", F.lit("contamination_8gram")), "dirty") == every("contamination_8gram")
    bare = seeds.withColumn("tools", F.slice("tools", 1, 0))
    assert reasons(bare) == every("undeclared_function")


@pytest.mark.parametrize("name, args, reason", [
    ("f", {"n": "1", "s": '"a"'}, None), ("g", {}, "undeclared_function"), ("f", {"n": "1", "z": "1"}, "unknown_argument"), ("f", {}, "missing_required"), ("f", {"n": "true"}, "type_integer:n"), ("f", {"n": "1", "s": '"c"'}, "enum:s"), ("f", {"n": "1.0"}, "type_integer:n"),
    ("f", {"n": "1", "l": '["a"]'}, None), ("f", {"n": "1", "l": "[]"}, None), ("f", {"n": "1", "l": "[1]"}, "type_array:l"), ("f", {"n": "1", "x": "2.5"}, None), ("f", {"n": "1", "x": '"2"'}, "type_number:x"), ("f", {"n": "1", "t": "false"}, None), ("f", {"n": "1", "t": "0"}, "type_boolean:t"), ("f", None, "arguments_not_object"),
])
def test_call_faults(spark, name, args, reason):
    df = spark.createDataFrame([((name, args), TOOLS)], f"call {C.CALL}, tools array<{C.TOOL}>")
    assert df.select(C.call_fault(F.col("call"), F.col("tools"))).first()[0] == reason


def test_model_turns(spark):
    good, other = '{"name": "f", "arguments": {"n": 1}}', '{"arguments": {"n": 1}, "name": "f"}'
    texts = {
        f'```json\n{{"calls": [{good}]}}\n```': None, f'{{"calls": [{good}]}}': None, "``` x": "json_fence", "{": "json_parse", '{"calls": []}': "empty_calls", good: "turn_shape", "[1]": "turn_shape", '{"calls": 3}': "turn_shape",
        f'{{"calls": [{good}, {other}]}}': "duplicate_call", '{"calls": [{"name": "f"}]}': "call_shape", '{"calls": [{"name": "f", "arguments": {"n": 1, "q": 2}}]}': "unknown_argument",
    }
    df = spark.createDataFrame([(t, TOOLS) for t in texts], f"t string, tools array<{C.TOOL}>")
    got = {r.t: r.x for r in df.select("t", C.turn_calls(F.col("t"), F.col("tools")).alias("x")).collect()}
    assert {t: x.reason for t, x in got.items()} == texts
    assert got[f'{{"calls": [{good}]}}'].calls[0].args == {"n": "1"}


def test_canonical_calls_and_alignment(spark):
    calls = [("f", {"b": "1", "a": '"x"'}), ("g", {})]
    df = spark.createDataFrame([(calls, calls[::-1], calls[:1] * 2)], ", ".join(f"{n} array<{C.CALL}>" for n in "abc"))
    r = df.select(C.canonical_calls(F.col("a")), C.aligned(F.col("b"), F.col("a")), C.aligned(F.col("c"), F.col("a"))).first()
    assert json.loads(r[0]) == [{"arguments": {"a": "x", "b": 1}, "name": "f"}, {"arguments": {}, "name": "g"}] and r[0] == json.dumps(json.loads(r[0]), separators=(",", ":"))
    assert [c.name for c in r[1]] == ["f", "g"] and r[2] is None


def test_requests_and_their_gates(seeds):
    fails = lambda request: {tuple(r[0]) for r in seeds.select(C.request_failures(request, F.col("tools"), F.col("plan"), F.col("links"))).collect()}
    own = F.col("request")
    assert fails(own) == {()} and fails(F.lit(" \n")) == fails(F.lit(None).cast("string")) == {("request",)}
    assert fails(F.lit("nothing of it")) == {("typed_value_fidelity",)}
    assert fails(F.concat(own, F.lit(" "), F.col("tools")[0]["name"])) == {("schema_derived_leak",)}
    assert all("schema_derived_leak" in x for x in fails(F.concat(own, F.lit(" "), F.upper(F.replace(F.col("tools")[0]["name"], F.lit("_"), F.lit("-"))))))
    assert fails(F.concat(own, F.lit(' "made up"'))) == fails(F.concat(own, F.lit(" 987654"))) == {("operational_invention",)}
    assert fails(F.concat(own, F.lit(" x987654"))) == {()}
    blank = F.transform("tools", lambda t: t.withField("props", F.transform_values(t["props"], lambda k, v: v.withField("description", F.lit(" ")))))
    assert {tuple(r[0]) for r in seeds.select(C.request_failures(own, blank, F.col("plan"), F.col("links"))).collect()} == {("schema_semantics",)}


def test_renames_go_back(seeds):
    own = seeds.withColumns({"names": C.mock_names(F.col("tools")), "before": F.to_json(F.struct("plan", "results", "links"))})
    mock = C.renamed(own, "names")
    rows = mock.withColumn("selected", F.col("plan"))
    assert reasons(rows) == {(p, None) for p in C.SHAPES} and all(r.tools[0].name == "m000" for r in mock.collect())
    back = C.renamed(mock, "names", back=True)
    assert back.where(F.to_json(F.struct("plan", "results", "links")) != F.col("before")).count() == 0
    with pytest.raises(Exception, match="unknown name"):
        C.renamed(mock, "names").collect()


def test_contamination_messages_sources_and_profile(spark, seeds):
    first = seeds.orderBy("id").first()
    names = spark.createDataFrame([(first.tools[0].name.upper(),)], "name string")
    grams = spark.createDataFrame([("zz " + seeds.where("id = 4").first().request,)], "text string")
    got = {r.id: r.reason for r in C.contaminated(seeds, "id", names, grams, F.col("request")).collect()}
    assert got[first.id] == "contamination_function_name" and got[4] == "contamination_8gram"
    roles = [m.role for m in seeds.where("id = 4").select(C.training_messages(F.col("request"), F.col("selected"), F.col("results")).alias("m")).first().m]
    assert roles == ["user", "assistant", "tool", "tool", "assistant", "tool", "assistant", "tool", "assistant", "tool"]
    chain = seeds.where("id = 4").select("results", C.receipt_sources(F.col("results")).alias("s")).first()
    assert chain.s == {chain.results[0][0].receipt: "0:0", chain.results[0][1].receipt: "0:1", chain.results[1][0].receipt: "1:0", chain.results[3][0].receipt: "3:0"}
    profile = C.structure(seeds)
    assert {r.kind for r in profile.collect()} == {"arity", "type"} and profile.where("kind = 'arity'").agg(F.sum("n")).first()[0] == seeds.select(F.sum(F.size("tools"))).first()[0]
    flags = seeds.select(C.item_flags(F.lit("pos"), F.array(F.lit("a")), F.array(F.lit("a")), F.lit(True), F.lit(False)).alias("p"), C.item_flags(F.lit("neg"), F.array(F.lit("a")), F.array(F.lit("a")), F.lit(True), F.lit(False)).alias("n")).first()
    assert tuple(flags.p) == (True, True, False, None) and tuple(flags.n) == (None, None, None, True)


def test_small_parsers():
    call = "<tool_call><function=f><parameter=a>1</parameter><parameter=b>x y</parameter></function></tool_call>"
    assert R.python_calls(call) == "f(a=1, b='x y')" and R.python_calls(call * 2).startswith("[f(")
    with pytest.raises(ValueError):
        R.python_calls("none")
    assert R.natural_request('```json\n{"natural_request": "hi"}\n```') == "hi" == R.natural_request('so: {"natural_request": "hi"} ok')
    assert R.natural_request("no") is None
    assert R.replace_names("ab abc ab_c", {"ab": "x", "abc": "y"}) == "x y ab_c"
    assert R.containing("get_time_alt", ["get_time", "other"]) == "get_time"
    assert R.function_names({"name": "a", "x": [{"function_name": "b"}]}) == {"a", "b"}
    assert R.declared_tools('<T>[{"name": "a"}]</T>', "<T>", "</T>") == [{"name": "a"}] and R.declared_tools("x", "<T>", "") is None
    assert R.tier_mix("T1:0,T2:0.45,T3:0.3,T4:0.25")["T2"] == 0.45
    assert R.arm_spec("a=p:q:8:0.5") == ("a", "p:q", 8, 0.5)
    for bad in ("T1:1", "T1:0.5,T2:0.5,T3:0.5,T4:0"):
        with pytest.raises(ValueError):
            R.tier_mix(bad)
