"""Edits and rewards against difflib and texts made by hand."""

import difflib

import pytest
from pyspark.sql import functions as F

from siftline.operators import rewards as R

OLD = "def f():\n    return 1\n\ndef g():\n    return 2\n"
NEW = OLD.replace("return 1", "return 3")
BLOCK = "```python\n### a.py\n<<<<<<< SEARCH\n    return 1\n=======\n    return {}\n>>>>>>> REPLACE\n```"
TAGGED = "<think>why</think>\n<solution>\n" + BLOCK + "\n</solution>"
PATCH = "diff --git a/a.py b/a.py\n--- a/a.py\n+++ b/a.py\n@@ -1,2 +1,2 @@\n def f():\n-    return 1\n+    return 3\n"
CASES = {
    1: (TAGGED.format(3), 1.0, "search_replace", None), 2: (TAGGED.format(4), None, "search_replace", None), 3: ("no format", -1.0, "format_fail", "count of <think> is not 1"),
    4: ("<think>x</think>```diff\n" + PATCH + "```", 1.0, "diff_fallback", None), 5: (TAGGED.format(1), -1.0, "format_fail", "Search and replace blocks are identical"),
    6: ("</think><solution></solution><think>", -1.0, "format_fail", "Thought is empty"), 7: ("<think>t</think><solution>text</solution>", -1.0, "format_fail", "No valid search blocks found"),
    8: (TAGGED.replace("    return 1", "    return 9").format(3), -1.0, "format_fail", "Search block not found in the code: \n    return 9"),
    9: ("It is\n" + PATCH, 1.0, "diff_fallback", None), 10: ("--- a/a.py\n+++ b/a.py\n@@ x\n-    return 1\n+    return 3\nodd\n+lost", 1.0, "diff_fallback", None),
    11: (BLOCK.format(3), -1.0, "format_fail", "count of <think> is not 1"), 12: ("```\n-    return 1\n+    return 3\n```", -1.0, "format_fail", "count of <think> is not 1"),
    13: ("<solution>s</solution><think>later thought</think>" + BLOCK.format(3), -1.0, "format_fail", "No valid search blocks found"),
}


@pytest.fixture(scope="module")
def goals(spark):
    rows = [(1, {"a.py": OLD}, {"a.py": NEW}, None), (2, {"a.py": OLD}, None, PATCH)]
    return R.targets(spark.createDataFrame(rows, "inst int, files map<string,string>, goal_files map<string,string>, patch string"), "inst", "files", "goal_files", "patch")


def test_rewards(spark, goals):
    rows = [(10 * k + i, i, t) for k, (t, *_) in CASES.items() for i in (1, 2)]
    got = {r.id: r for r in R.scored(spark.createDataFrame(rows, "id int, inst int, text string"), goals, "id", "inst", "text").collect()}
    for k, (text, reward, method, error) in CASES.items():
        for i in (1, 2):  # the target from files, and from a patch
            r = got[10 * k + i]
            assert (r.method, r.error, r.format_valid, r.n_oracle_files) == (method, error, method != "format_fail", 1), (k, r)
            assert r.reward == pytest.approx(reward) if reward is not None else 0 < r.reward < 1
            assert r.n_pred_files == int(r.format_valid)
    changed = lambda new: "\n".join(x.rstrip() for x in list(difflib.unified_diff(OLD.splitlines(), new.splitlines(), lineterm=""))[2:])
    want = difflib.SequenceMatcher(None, changed(OLD.replace("return 1", "return 4")), changed(NEW), autojunk=False).ratio()
    assert got[21].reward == pytest.approx(want) and got[21].per_file[0].path == "a.py"
    strict = {r.id: r.method for r in R.scored(spark.createDataFrame(rows, "id int, inst int, text string"), goals, "id", "inst", "text", fallback=False).collect()}
    assert {k for k in CASES if strict[10 * k + 1] == "search_replace"} == {1, 2}


def test_lenient_rewards(spark, goals):
    rows = [(k, 1, t) for k, (t, *_) in CASES.items()]
    got = {r.id: r.reward for r in R.lenient(spark.createDataFrame(rows, "id int, inst int, text string"), goals, "id", "inst", "text").collect()}
    assert {k for k, v in got.items() if v == 1.0} == {1, 4, 9, 10, 11, 12, 13} and {k for k, v in got.items() if v == -1.0} == {3, 5, 6, 7, 8}


def test_hunks(spark):
    texts = {
        1: PATCH + "@@ -9 +9 @@\n ctx\n\n-gone\n\\ No newline at end of file\n+here\n", 2: PATCH.replace("+++ b/a.py", "+++ /dev/null"), 3: PATCH.replace("+++ b/a.py", "+++ a/dir/b.py\t2024"),
        4: "@@ -1 +1 @@\n-a\n+b", 5: "+++ b/x\n@@ @@\n-a\n+a\n@@ @@\n-a\nstop\n+b\n@@ @@\n+c", 6: None, 7: PATCH.replace("\n", "\r\n"),
    }
    got = {r.id: [tuple(e) for e in r.edits] for r in R.hunk_edits(spark.createDataFrame(list(texts.items()), "id int, p string"), "id", "p").collect()}
    first = ("a.py", "def f():\n    return 1", "def f():\n    return 3")
    assert got == {1: [first, ("a.py", "ctx\n\ngone", "ctx\n\nhere")], 3: [("dir/b.py", *first[1:])], 5: [("x", "a", ""), ("x", "", "c")], 7: [first]}


def test_apply_all_occurrences_at_line_starts(spark):
    rows = [(1, {"p": "ab\nxab\nab"}, [("p", "ab", "c")]), (2, {"p": "a"}, [("q", "", "new")]), (3, {"p": "a\nb"}, [("p", "a", "b"), ("p", "b\nb", "z")]), (4, {"p": "a"}, [("p", "zz", "y")])]
    df = spark.createDataFrame(rows, "id int, files map<string,string>, edits array<struct<path:string,search:string,new:string>>")
    got = {r.id: r.x for r in df.select("id", R.applied(F.col("files"), F.col("edits")).alias("x")).collect()}
    assert got[1].files == {"p": "c\nxab\nc"} and got[2].files == {"q": "new"} and got[3].files == {"p": "z"} and got[4].error.endswith("\nzz")
    assert [r.x.error for r in df.select(R.applied(F.col("files"), F.col("edits"), silent=True).alias("x")).collect()] == [None] * 4


def test_no_change_and_other_files(spark):
    rows = [(1, {"a": "x\ny", "b": "z"}, {}, {"a": "x\ny"}), (2, {"a": "x\ny", "b": "z"}, {"a": "@@"}, {"b": "w"}), (3, {"a": "x  \r\ny"}, {"a": "@@ -1,2 +1,2 @@\n x\n-y\n+q"}, {"a": "x  \r\nq"})]
    df = spark.createDataFrame(rows, "id int, files map<string,string>, goal map<string,string>, pred map<string,string>")
    got = {r.id: r for r in R.compared(df, "id").collect()}
    assert got[1].reward == 1.0 and got[1].per_file == [] and got[2].reward == 0.0 and len(got[2].per_file) == 2 and got[3].reward == 1.0
