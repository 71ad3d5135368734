"""The exact near-pair join against all pairs, with copies."""

import random

from pyspark.sql import functions as F

from siftline.functions import text as T
from siftline.operators import decontam, gates


def grams(t):
    t = " ".join(t.lower().split())
    return {t[i : i + 3] for i in range(len(t) - 2)} if len(t) >= 3 else {t} - {""}


def test_near_pairs_and_gates(spark):
    r = random.Random(3)
    base = ["".join(r.choice("abcdef ") for _ in range(r.randint(60, 120))) for _ in range(12)]
    rows = [(i, b if i % 3 else b[:30] + "z" + b[31:]) for i, b in enumerate(r.choice(base) for _ in range(60))] + [(100, "ab"), (101, "AB"), (102, "")]
    form = lambda t: " ".join(t.lower().split())
    first = {}
    for i, t in rows:
        first.setdefault(form(t), i)
    sets = {i: grams(t) for i, t in rows if first[form(t)] == i and grams(t)}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.92 * len(sets[a] | sets[b])}
    want |= {(first[form(t)], i) for i, t in rows if first[form(t)] != i}
    df = spark.createDataFrame(rows, "id int, t string")
    assert {(x.a, x.b) for x in decontam.near_pairs(df, "id", T.collapsed(F.col("t")), 3, 0.92).collect()} == want
    alike = [(i, "same words here always", 0) for i in range(12)]
    got = gates.quota_gates(spark.createDataFrame(alike, "id int, t string, s int"), "id", "t", "s").collect()
    assert {x.gates for x in got} == {"batch_prefix_2,batch_prefix_4,batch_style"}
    few = gates.quota_gates(spark.createDataFrame(alike[:5], "id int, t string, s int"), "id", "t", "s").collect()
    assert {x.id: x.gates for x in few} == {0: "", 1: "skeleton_similarity", 2: "skeleton_similarity", 3: "skeleton_similarity", 4: "skeleton_similarity"}


def test_gates_move_no_text_for_group_shares(spark):
    """Groups over their share are few and stand in the plan: rows with their texts aren't joined with group sizes."""
    rows = [(i, f"{'same words' if i % 2 else f'w{i} v{i}'} then {i}", i % 4) for i in range(40)]
    got = gates.quota_gates(spark.createDataFrame(rows, "id int, t string, s int"), "id", "t", "s")
    plan = got._jdf.queryExecution().analyzed().toString()
    assert not [line for line in plan.splitlines() if "Join " in line and "<=>" in line]
    assert {x.id for x in got.collect() if "batch_prefix_2" in x.gates} == {i for i in range(40) if i % 2}
