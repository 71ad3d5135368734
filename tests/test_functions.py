"""Goldens of plain functions: text, JSON, scalar statistics."""

import math

import pytest

from siftline.functions import jsons as J
from siftline.functions import scalar_stats as S
from siftline.functions import text as T
from siftline.operators import selection


def test_tokens_of_cjk_and_sharp_s():
    assert T.token_list("漢字かな Straße_X") == ["漢", "字", "か", "な", "strasse", "x"]
    assert T.token_list("") == []
    assert len(T.token_list("一二三四五六七八九")) == 9


def test_udf_and_jvm_tokens_agree(spark):
    from pyspark.sql import functions as F

    texts = ["Straße_1 É", "ﬁn ①", "漢字 abc", "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.normalize_tokens(F.col("t"))).collect()]
    assert got == [None if t is None else T.token_list(t) for t in texts]


def test_canonical_and_leaves():
    assert J.canonical({"b": 1, "a": [True, None]}) == '{"a":[true,null],"b":1}'
    assert J.leaves({"a": '["x", {"k": "y"}]', "n": 3, "c": ["z", "[broken"]}) == ["x", "y", "z", "[broken"]
    assert J.leaves({"a": '["x"]'}, deep=False) == ['["x"]']
    with pytest.raises(ValueError):
        J.decoded('"[1]"', dict)
    assert J.decoded('"[1]"', list) == [1]


def test_matching():
    a, b = {"name": "f", "arguments": {"n": 1}}, {"name": "f", "arguments": {"n": 2}}
    assert J.calls_match([a, b], [b, a]) == (True, True)
    assert J.calls_match([a], [a, b]) == (False, False)


def test_exact_statistics():
    assert S.mcnemar_exact(4, 16) == pytest.approx(0.01182, abs=1e-5)
    assert S.mcnemar_exact(0, 0) == 1.0
    low, high = S.clopper_pearson(0, 10, 0.05)
    assert low == 0.0 and high == pytest.approx(1 - 0.025 ** 0.1, abs=1e-9)
    low, high = S.clopper_pearson(5, 10, 0.05)
    assert low == pytest.approx(0.187086, abs=1e-5) and high == pytest.approx(0.812914, abs=1e-5)
    low, high = S.exact_paired_bounds(600, 20, 17)
    assert low < -0.01 and high > 0
    assert S.noninferior(600, 20, 17, 0.01) == "INCONCLUSIVE"
    assert S.noninferior(1000, 0, 300, 0.01) == "PASS" and S.noninferior(1000, 300, 0, 0.01) == "FAIL"
    assert S.adoption(["PASS", "PASS"], False) == "AUTO_ADOPT" and S.adoption(["PASS"], True) == "USER_DECISION" and S.adoption(["FAIL", "PASS"], False) == "REJECT"
    assert math.isinf(S.log_binomial_cdf(-1, 3, 0.5))


def test_quotas():
    assert selection.even_quotas(10, ["a", "b", "c"]) == {"a": 4, "b": 3, "c": 3}
    assert selection.largest_remainder(10, {"T1": 0.0, "T2": 0.45, "T3": 0.3, "T4": 0.25}) == {"T1": 0, "T2": 5, "T3": 3, "T4": 2}


def test_gram_digests(spark):
    from siftline.functions import grams as G

    texts = ["Straße a b c d e f g h", "漢字かな ab_c " * 4, "a b c", "", None, "a b c d e f g h " * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for cut, n, pieces in (("words", 3, T.token_list), ("ascii", 2, G.ascii_words), ("letters", 4, lambda t: list(G.letters(t)))):
        join = G.CUTS[cut][1]
        want = {(i, join.join(p[j : j + n])) for i, t in enumerate(texts) if t for p in [pieces(t)] for j in range(len(p) - n + 1)}
        rows = G.gram_rows(df, ["id"], "text", cut, n, shown=True).collect()
        assert {(r.id, r.gram) for r in rows} == want and len(rows) == len(want)
        digest = {}
        assert all(digest.setdefault(r.gram, (r.g1, r.g2)) == (r.g1, r.g2) for r in rows) and len(set(digest.values())) == len(digest)
        index = G.gram_rows(df.where("id in (0, 2)"), [], "text", cut, n).select("g1", "g2").distinct().selectExpr("g1", "g2", "5 AS mask")
        found = [sorted((r.id, r.pos, r.g1, r["mask"]) for r in G.matches(df, ["id"], "text", cut, n, index, distinct=False, limit=limit).collect()) for limit in (1000, 0)]
        assert found[0] == found[1] and {x[0] for x in found[0]} >= {0}
    assert G.matches(df, ["id"], "text", "words", 3, index.where("false")).count() == 0
