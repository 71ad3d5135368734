"""Instructions, judge rows and patches taken back."""

import pytest
from pyspark.sql import functions as F

from siftline.operators import authoring as A


def test_constraints_and_mix(spark):
    assert A.constraint_text({"type": "script_only", "script": "hiragana"}) == "仮名範囲=平仮名" and A.constraint_text({"type": "json_object", "keys": ["a", "b"]}).endswith("a,b")
    with pytest.raises(KeyError):
        A.constraint_text({"type": "other"})
    d = spark.range(10).select("id", A.bundle_of(F.col("id"))["group"].alias("g"))
    assert A.native_enough(d, "g").count() == 10
    with pytest.raises(Exception, match="below one third"):
        A.native_enough(d.where("id < 2"), "g").collect()


def test_response_faults(spark):
    rows = [(0, "案内します。確認しました。", False), (0, "案内した。", False), (0, None, False), (1, "x", True), (6, '{"題名": 1, "状態": 2}', False)]
    df = spark.createDataFrame(rows, "i int, r string, d boolean")
    got = [list(r[0]) for r in df.select(A.response_faults(F.col("i"), F.col("r"), F.col("d"))).collect()]
    assert got == [["polite_style"], ["sentence_count", "polite_style"], ["no_passing_candidate"], ["contamination_8gram"], []]


def test_judge_rows(spark):
    df = spark.createDataFrame([(1, None, "q", 5), (2, "m", "", 6)], "id int, messages string, question string, quality int")
    assert [tuple(r) for r in A.judge_projection(df, "id").collect()] == [(1, "q", None, None), (2, None, "m", None)]
    with pytest.raises(Exception, match="no messages or question"):
        A.judge_projection(df.withColumns({"messages": F.lit(None).cast("string"), "question": F.lit("")}), "id").collect()


def test_patches_taken_back(spark):
    patch = "--- a/f\n+++ b/f\n@@ @@\n a\n-good\n+bad\n"
    df = spark.createDataFrame([(1, {"f": "a\nbad\n", "g": "x"}, patch), (2, {"f": "else"}, patch), (3, {"f": "a"}, "none")], "id int, files map<string,string>, patch string")
    got = {r.id: r for r in A.gold_fix(df, "id", "files", "patch").collect()}
    assert got[1].fixed == {"f": "a\ngood\n", "g": "x"} and got[2].fixed is None and got[3].error == "no usable hunk"


def test_programs(spark):
    df = spark.createDataFrame([("code", " ", ["assert 1"])], "c string, s string, a array<string>")
    assert df.select(A.assert_program(F.col("c"), F.col("s"), F.col("a"))).first()[0] == "code\n\nassert 1\n"
    assert df.select(A.check_program(F.col("c"), F.lit("t"), F.lit("f"))).first()[0] == "code\n\nt\n\ncheck(f)\n"
