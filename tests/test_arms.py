"""Arms, prompt selection and packing on small tables, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from siftline.functions import text as T
from siftline.operators import arms as A
from siftline.operators import packing as K
from siftline.operators import prompts as P
from siftline.operators import stats as S


def greedy(pairs, length, pad, ignore=-100):
    out, x, y = [], [], []
    for i, l in pairs:
        room = length - len(x)
        x, y = x + i[-room:], y + l[-room:]
        if len(x) == length:
            out.append((x, y))
            x, y = [], []
    return out + ([(x + [pad] * (length - len(x)), y + [ignore] * (length - len(y)))] if x else [])


@pytest.mark.parametrize("batch", [4000, 3])
def test_blocks(spark, batch):
    r = random.Random(1)
    rows = [(i % 3, i, ids := [r.randint(1, 99) for _ in range(r.randint(0, 25))], [x if x % 2 else -100 for x in ids]) for i in range(60)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    df = spark.createDataFrame(rows, "s bigint, i bigint, ids array<int>, labels array<int>")
    got = K.token_blocks(df, ["i"], "s", "ids", "labels", 16, 0).collect()
    dropped = K.token_blocks(df, ["i"], "s", "ids", "labels", 16, 0, head_drop=1.0).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for s in range(3):
        own = sorted((x.block, list(x.ids), list(x.labels)) for x in got if x.shard == s)
        assert [(x, y) for _, x, y in own] == greedy([(i, l) for k, _, i, l in rows if k == s], 16, 0)
    assert all(len(x.ids) == 16 == len(x.labels) for x in dropped) and len(dropped) <= len(got)


def test_turn_labels(spark):
    df = spark.createDataFrame([([[1, 2], [3], [4, 5]], ["user", "assistant", "user"])], "t array<array<int>>, r array<string>")
    assert df.select(K.turn_labels(F.col("t"), F.col("r"))).first()[0] == [-100, -100, 3, -100, -100]


def test_arm_summary(spark):
    rows = [("a", s, i, (s + i) % 3 == 0, i == 0) for s in range(3) for i in range(6)] + [("b", s, i, True, False) for s in range(3) for i in range(6)]
    df = spark.createDataFrame(rows, "arm string, seed int, item int, ok boolean, cut boolean")
    got = {r.arm: r for r in A.arm_summary(df, ["arm"], "seed", "item", "ok", "cut", 3).collect()}
    assert (got["a"].n, got["a"].pass_rate, got["a"].seed_sd, got["a"].truncated, got["a"].agreement) == (6, 0.333333, 0.0, 3, 0.333333)
    assert (got["b"].pass_rate, got["b"].agreement) == (1.0, 1.0)
    with pytest.raises(Exception, match="incomplete seed matrix"):
        A.arm_summary(df.where("seed > 0 or item > 0"), ["arm"], "seed", "item", "ok", "cut", 3).collect()


def test_rates_sweeps_and_probes(spark):
    parts = spark.createDataFrame([("m", 10, 0, 8, 6, 4, 0, 100, 2.0), ("m", 10, 5, 8, 6, 4, 1, 300, 4.0)], "model string, n_pos int, n_neg int, format_valid int, name_match int, arg_match int, over_trigger int, gen_tokens int, gen_time double")
    r = A.call_eval(parts, ["model"]).first()
    assert (r.format_validity, r.name_acc, r.arg_acc, r.over_trigger_rate, r.tok_s, r.tok_s_parallel, r.format_validity_ci95) == (0.8, 0.6, 0.4, 0.2, 66.67, 100.0, 0.1753)
    sweep = spark.createDataFrame([(8, 3, 4, 10, 1.0), (8, 1, 4, 30, 2.0), (16, 1, 1, 1, 1.0)], "k int, correct int, n int, gen_tokens int, gen_time double")
    assert [tuple(x) for x in A.k_sweep(sweep, "k").collect()] == [(8, 0.5, 4, 8, 40, 13.33, 20.0, 3.0)]
    rows = [("P", 1, True, "search_replace", 1.0, 1.0, "stop", 1, True, True), ("P", 1, False, "format_fail", -1.0, 0.5, "length", 0, False, False), ("P", 2, True, "diff_fallback", 0.5, 0.5, "stop", 1, True, False)]
    probe = A.format_probe(spark.createDataFrame(rows, "arm string, pi int, format_valid boolean, method string, strict double, lenient double, finish string, think_open int, tags_ok boolean, marker boolean"), "arm", "pi").first()
    assert (probe.n, probe.fmt_ok, probe.env, probe.fb, probe.fail, probe.strict_mean, probe.strict_best, probe.lenient_best, probe.n_stop, probe.n_ready) == (3, 0.666667, 0.333333, 0.333333, 0.333333, 0.166667, 0.75, 0.75, 2, 2)
    finish = spark.createDataFrame([("stop",), ("error: x",), (None,)], "finish string")
    assert A.clean(finish, "finish").count() == 2
    text = "x</think><solution>a</solution><<<<<<< SEARCH"
    df = spark.createDataFrame([(text, "stop"), ("<think>" + text, "stop"), (text, "length")], "t string, f string")
    assert [r[0] for r in df.select(A.near_miss(T.tag_flags(F.col("t")), F.col("f"))).collect()] == [True, False, False]
    sub, raw = spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("a", [True, True], False), ("b", [True, False], True), ("c", [True], True)], "k string, f array<boolean>, t boolean")
    assert tuple(A.followed(sub, raw, "k", "f", "t").first()) == (2, 1, 1, 0.5)
    arm = lambda xs: spark.createDataFrame([(i, *x) for i, x in enumerate(xs)], "k int, correct boolean, truncated boolean")
    both = {r.field: (r.n, r.n10, r.n01) for r in A.structured_verdicts(arm([(True, False), (True, True)]), arm([(False, False), (True, False)]), "k").collect()}
    assert both == {"correct": (2, 1, 0), "truncated": (2, 1, 0)}


def test_prompt_parts(spark):
    ids = ["own__repo.abcdef12.func_pm_remove__z9", "a__b.1f2e3d4c.lm_rewrite__q__r", "plain", "x__y.00ff00ff.1234"]
    df = spark.createDataFrame([(i,) for i in ids], "iid string")
    assert [r[0] for r in df.select(P.strategy_v0(F.col("iid"))).collect()] == ["func_pm_remove__z", "lm_rewrite__q__r", "other", "1234"]
    assert [r[0] for r in df.select(P.strategy_relabelled(F.col("iid"))).collect()] == ["func_pm_remove", "lm_rewrite__q", "other", "numeric"]
    patches = spark.createDataFrame([("GIT binary patch x",), ("Binary files a differ",), ("Binary files\n@@ -1 +1 @@",), ("@@",)], "p string")
    assert [r[0] for r in patches.select(P.binary_only(F.col("p"))).collect()] == [True, True, False, False]
    paths = spark.createDataFrame([("d/toucan-1.5m/x.parquet",), ("d/tau-train-query.jsonl",), ("toolmind/a/b",), ("z",)], "p string")
    assert [r[0].group[:3] for r in paths.select(P.source_license(F.col("p"))).collect()] == ["A_d", "B_s", "UNV", "UNK"]
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, m string")
    assert P.merged(a, spark.createDataFrame([(2, "f"), (1, "g")], "k int, f string"), "k").count() == 2
    with pytest.raises(Exception, match="key mismatch"):
        P.merged(a, spark.createDataFrame([(2, "f")], "k int, f string"), "k").collect()
    commits = spark.createDataFrame([("abc", ["abcd"]), ("abcd", ["abc"]), ("x", ["y"])], "s string, c array<string>")
    assert [tuple(r) for r in commits.select(P.same_commit(F.col("s"), F.col("c")), P.same_commit(F.col("s"), F.col("c"), either=True)).collect()] == [(True, True), (False, True), (False, False)]
    base = spark.createDataFrame([("a", 2, "late", "p"), ("a", 1, None, "q"), ("b", 1, "x", "y")], "id string, pos int, patch string, problem string")
    assert [tuple(r) for r in P.gold_patches(base, spark.createDataFrame([("a",)], "id string"), "id", ["pos"], "patch", "problem").collect()] == [("a", "", "q")]


def test_bootstrap_weights(spark):
    df = spark.range(400).select(F.col("id"), (F.col("id") % 4 == 0).cast("double").alias("x"), F.lit(1.0).alias("n"))
    r = S.poisson_bootstrap(df, "id", "x", "n", b=200).first()
    assert r.point == 0.25 and 0.19 < r.low < 0.235 < 0.265 < r.high < 0.31
    w = spark.range(20000).select(S.poisson_weight(F.col("id"), F.lit(3), 1).alias("w")).agg(F.avg("w"), F.var_pop("w")).first()
    assert abs(w[0] - 1) < 0.03 and abs(w[1] - 1) < 0.05
    text = spark.createDataFrame([("a", 1.0, 1.0), ("b", 0.0, 1.0)], "k string, x double, n double")
    assert S.poisson_bootstrap(text, "k", "x", "n", b=50).first().point == 0.5
