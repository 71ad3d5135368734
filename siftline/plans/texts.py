"""Queries of the text functions and validators."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import text as T
from siftline.operators import rewards as W
from siftline.plans.fixtures import Fixture, Mixed
from siftline.session import table

ANSWERS = Mixed(Fixture("id int, text string, gold string", [
    (1, "<think>maybe 7</think>So the total is\n#### 1,234", "#### 1234"),
    (2, "first 3 then 4.50", "it is #### 4.5 then #### 9"), (3, "no digits here", "#### -2"),
    (4, "#### 5\nbut later 6", None), (5, "", "x"), (6, "-1,000.25 apples", "#### -1000.25"),
]), 'conversations', ('1000 + conv_id * 1000 + turn', "CASE turn % 4 WHEN 0 THEN concat('<think>', text, ' 7</think>so #### ', length(text)) WHEN 1 THEN concat(text, ' makes ', length(text) * 3, '.') WHEN 2 THEN text ELSE concat('#### 1,', 100 + length(text) % 900, ' and ', turn) END", "concat('#### ', CASE turn % 2 WHEN 0 THEN length(text) ELSE length(text) * 3 END)"))
CHOICES = Mixed(Fixture("id int, text string", [
    (1, "The answer is (B) because A is wrong"), (2, "A or C? I choose C"), (3, "<think>A</think> Answer: D"), (4, "nothing"), (5, "option A, no, answer is B"), (6, "BAD CAB"),
]), 'conversations', ('1000 + conv_id * 1000 + turn', "CASE turn % 4 WHEN 0 THEN concat('The answer is (', substr('ABCD', length(text) % 4 + 1, 1), ') as ', text) WHEN 1 THEN concat(text, ' ', substr('ABCDE', length(text) % 5 + 1, 1)) WHEN 2 THEN text ELSE concat('<think>option A</think>', text, ' Option ', substr('ABCD', length(text) % 4 + 1, 1), ', so B') END"))
THOUGHTS = Mixed(Fixture("id int, text string", [
    (1, "<think>abc</think>rest"), (2, "<think>open end"), (3, "plain"), (4, "<think></think><solution>x</solution>"), (5, "<think>why</think>\n<solution>done</solution>"),
    (6, "<think>a</think><think>b</think><solution>c</solution>"), (7, "</think>odd<think>z"), (8, "<<<<<<< SEARCH\n<<<<<<< SEARCH"),
]), 'conversations', ('1000 + conv_id * 1000 + turn', "CASE turn % 5 WHEN 0 THEN concat('<think>', text, '</think>', '<solution>', length(text), '</solution>') WHEN 1 THEN concat('<think>', text) WHEN 2 THEN text WHEN 3 THEN concat('<solution>s</solution><think>', text, '</think>') ELSE concat('<think> </think><solution>', text, '</solution><<<<<<< SEARCH') END"))
CODE = Mixed(Fixture("id int, text string", [
    (1, "a\n```python\ndef f():\n  return 1\n```\nb\n```\nprint(2)\n```"), (2, "```\nx = 1\n```"), (3, "none"), (4, "<think>```\ndef no()\n```</think>```py\nok\n```"),
]), 'conversations', ('1000 + conv_id * 1000 + turn', "CASE turn % 3 WHEN 0 THEN concat(text, chr(10), '```python', chr(10), 'def f', length(text), '():', chr(10), '```', chr(10), '```', chr(10), text, '```') WHEN 1 THEN text ELSE concat('```', chr(10), text, chr(10), '```') END"))
NAMES = Mixed(Fixture("id int, text string", [(1, "Get_User-Name.v2 now"), (2, "ÉCOLE_1"), (3, ""), (4, "A.b C-d")]), 'conversations', ('1000 + conv_id * 1000 + turn', 'text'))
NUMBERS = Mixed(Fixture("id int, a string, b string", [(1, "1.00001", "1"), (2, "1.1", "1"), (3, " x ", "x"), (4, None, "1"), (5, "2", "two"), (6, "1e3", "1000")]), 'conversations', ('1000 + conv_id * 1000 + turn', "concat(length(text), '.0')", 'concat(length(text) + turn % 2)'))

# Texts of this repository's own: at least one that passes and one that fails for each validator.
SAMPLES = Mixed(Fixture("id int, text string", [
    (1, "会場を案内します。時間を確認してください。"), (2, "会場を紹介する。時間を確認した。"), (3, "見出しなし\n\n二つ目の段落です。"), (4, "- 確認\n- 確認\n- 確認"),
    (5, "1. 一つ\n2. 二つ\n3) 三つ"), (6, "# 題名\n本文です。"), (7, '{"題名": "会", "状態": "済"}'), (8, "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |"),
    (9, "きょうはよいひ"), (10, "カタカナー"), (11, "漢字、文。"), (12, "案内は以上です。"), (13, "plain ascii text, 禁止語 included"), (14, ""), (15, '{"題名": 1}'),
]), 'documents', ('1000 + doc_id', 'text'))
BUNDLE = [{"type": "char_range", "min": 5, "max": 30}, {"type": "polite_style"}, {"type": "forbidden_word", "word": "禁止語"}, {"type": "other"}]
ARGS = {
    "char_range": {"min": 5, "max": 12}, "sentence_count": {"count": 2}, "paragraph_count": {"count": 2}, "keyword_count": {"keyword": "確認", "count": 3}, "forbidden_word": {"word": "禁止語"},
    "script_only": {"script": "hiragana"}, "bullet_count": {"count": 3}, "numbered_list_count": {"count": 3}, "heading": {}, "json_object": {"keys": ["題名", "状態"]}, "markdown_table": {"rows": 2},
    "polite_style": {}, "plain_style": {}, "ending": {"suffix": "以上です。"},
}

SENT = "list_filter([trim(x) FOR x IN regexp_split_to_array(text, '[。！？]+')], lambda x: length(x) > 0)"
LINES = "string_split(text, chr(10))"
CHECKS = {
    "char_range": r"length(regexp_replace(text, '\s', '', 'g')) BETWEEN 5 AND 12",
    "sentence_count": f"len({SENT}) = 2",
    "paragraph_count": r"len(list_filter([trim(x) FOR x IN regexp_split_to_array(text, '\n[ \t]*\n')], lambda x: length(x) > 0)) = 2",
    "keyword_count": "(length(text) - length(replace(text, '確認', ''))) / 2 = 3",
    "forbidden_word": "NOT contains(text, '禁止語')",
    "script_only": r"regexp_matches(regexp_replace(text, '\s', '', 'g'), '^[ぁ-ゖー、。]+$')",
    "bullet_count": rf"len(list_filter({LINES}, lambda x: regexp_matches(x, '^\s*[-*・]\s+\S'))) = 3",
    "numbered_list_count": rf"len(list_filter({LINES}, lambda x: regexp_matches(x, '^\s*\d+[.)、】【]\s*\S'))) = 3",
    "heading": rf"len(list_filter({LINES}, lambda x: regexp_matches(x, '^#{{1,6}}\s+\S'))) > 0",
    "json_object": "CASE WHEN json_valid(text) AND json_type(text) = 'OBJECT' THEN list_has_all(json_keys(text), ['題名', '状態']) ELSE FALSE END",
    "markdown_table": rf"len(list_filter({LINES}, lambda x: contains(x, '|'))) >= 4 AND len(list_filter({LINES}, lambda x: regexp_matches(trim(x), '^\|?\s*:?-{{3,}}:?\s*(\|\s*:?-{{3,}}:?\s*)+\|?$'))) > 0",
    "polite_style": f"len({SENT}) > 0 AND len(list_filter({SENT}, lambda x: regexp_matches(x, '(です|ます|ください|でした|ません)$'))) = len({SENT})",
    "plain_style": f"len({SENT}) > 0 AND len(list_filter({SENT}, lambda x: regexp_matches(x, '(だ|である|だった|ない|する|した|れる|られる)$'))) = len({SENT})",
    "ending": "ends_with(rtrim(text), '以上です。')",
}


def _validator(name):
    return lambda spark, sf: SAMPLES.frame(spark, sf).select("id", F.coalesce(T.VALIDATORS[name](F.col("text"), **ARGS[name]), F.lit(False)).alias("passed"))


def val_bundle(spark, sf):
    """all failures of a bundle, unknown types reported."""
    return SAMPLES.frame(spark, sf).select("id", F.array_join(T.failures(F.col("text"), BUNDLE), ",").alias("failures"))


def last_number(spark, sf):
    t = F.col("text")
    return ANSWERS.frame(spark, sf).select("id", T.last_number(t).alias("pred"), T.gold_number(F.col("gold")).alias("gold"), T.numbers_equal(T.last_number(t), T.gold_number(F.col("gold"))).alias("correct"))


def choice_letter(spark, sf):
    return CHOICES.frame(spark, sf).select("id", T.choice_letter(F.col("text")).alias("letter"))


def think_split(spark, sf):
    return THOUGHTS.frame(spark, sf).select("id", T.think_split(F.col("text")).alias("s")).select("id", "s.chars", "s.closed", "s.payload")


def think_solution(spark, sf):
    """P20, P22."""
    answer, error = W.solution(F.col("text"))
    return THOUGHTS.frame(spark, sf).select("id", F.when(error.isNull(), answer).alias("solution"), error.alias("error"), T.tag_flags(F.col("text")).alias("f")).select("id", "solution", "error", "f.think_open", "f.search", "f.exact")


def code_block(spark, sf):
    return CODE.frame(spark, sf).select("id", T.code_block(F.col("text")).alias("code"))


def identifiers(spark, sf):
    t = F.col("text")
    return NAMES.frame(spark, sf).select("id", T.plain_identifier(t).alias("plain"), T.strict_identifier(t).alias("strict"), T.first_words(t, 2).alias("two"), F.array_join(T.ascii_tokens(t), " ").alias("tokens"))


def numbers_equal(spark, sf):
    return NUMBERS.frame(spark, sf).select("id", T.numbers_equal(F.col("a"), F.col("b")).alias("equal"))


def text_shapes(spark, sf):
    """F13 counters over all documents: bullets, sentences, paragraphs, headings, non-blank length."""
    t = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", F.length(F.regexp_replace(t, r"\s", "")).alias("chars"), F.size(T.paragraphs(t)).alias("paragraphs"), T.VALIDATORS["heading"](t).alias("heading"),
        F.size(F.regexp_extract_all(t, F.lit(r"(?m)^[ \t]*[-*・][ \t]+\S"), 0)).alias("bullets"), T.first_words(t, 4).alias("prefix4"),
    )


def row_digest(spark, sf):
    """A stable key of an item's content, independent of column order."""
    return table(spark, sf, "benchmark").select("item_id", F.sha2(F.concat_ws("\x1f", F.lit("benchmark"), F.lit("text"), "text"), 256).alias("item_key"))


NUM = r"-?\d[\d,]*(?:\.\d+)?"
AFTER = "string_split(text, '</think>')[-1]"
MARK = rf"regexp_extract_all({AFTER}, '####\s*({NUM})', 1)"
ANY = f"regexp_extract_all({AFTER}, '{NUM}')"
GOLD = rf"nullif(replace(regexp_extract(gold, '####\s*({NUM})', 1), ',', ''), '')"
PRED = f"replace(CASE WHEN len({MARK}) > 0 THEN {MARK}[-1] WHEN len({ANY}) > 0 THEN {ANY}[-1] END, ',', '')"


def _equal(a: str, b: str) -> str:
    return f"coalesce(CASE WHEN try_cast({a} AS DOUBLE) IS NOT NULL AND try_cast({b} AS DOUBLE) IS NOT NULL THEN abs(try_cast({a} AS DOUBLE) - try_cast({b} AS DOUBLE)) < 1e-4 ELSE trim({a}) = trim({b}) END, FALSE)"


def _n(tag: str) -> str:
    return f"((length(text) - length(replace(text, '{tag}', ''))) / {len(tag)})::BIGINT"


EXACT = " AND ".join(f"{_n(t)} = 1" for t in T.TAGS)


def _between(a: str, b: str) -> str:
    return f"string_split(string_split(text, '{a}')[2], '{b}')[1]"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


BLOCK = f"regexp_extract_all({AFTER}, '(?s)```[A-Za-z0-9_+-]*\\n(.*?)```', 1)"
KEYED = rf"regexp_extract_all({AFTER}, '(?i:answer|option|choice)\s*(?i:is)?\s*[:=]?\s*\(?([A-D])\b', 1)"
ALONE = rf"regexp_extract_all({AFTER}, '\b([A-D])\b', 1)"
START, REST = "instr(text, '<think>')", "substr(text, instr(text, '<think>') + 7)"

ORACLES = {f"val_{k}": f"SELECT id, {v} AS passed FROM {SAMPLES.sql}" for k, v in CHECKS.items()} | {
    "val_bundle": f"SELECT id, array_to_string(list_filter([CASE WHEN NOT ({CHECKS['char_range'].replace('12', '30')}) THEN 'char_range' END, CASE WHEN NOT ({CHECKS['polite_style']}) THEN 'polite_style' END, CASE WHEN NOT ({CHECKS['forbidden_word']}) THEN 'forbidden_word' END, 'unknown_constraint:other'], lambda x: x IS NOT NULL), ',') AS failures FROM {SAMPLES.sql}",
    "last_number": f"SELECT id, {PRED} AS pred, {GOLD} AS gold, {_equal(PRED, GOLD)} AS correct FROM {ANSWERS.sql}",
    "choice_letter": f"SELECT id, CASE WHEN len({KEYED}) > 0 THEN {KEYED}[-1] WHEN len({ALONE}) > 0 THEN {ALONE}[-1] END AS letter FROM {CHOICES.sql}",
    "think_split": f"SELECT id, CASE WHEN {START} = 0 THEN 0 WHEN instr({REST}, '</think>') = 0 THEN length({REST}) ELSE instr({REST}, '</think>') - 1 END AS chars, {START} > 0 AND instr({REST}, '</think>') > 0 AS closed, CASE WHEN {START} > 0 AND instr({REST}, '</think>') > 0 THEN substr({REST}, instr({REST}, '</think>') + 8) ELSE text END AS payload FROM {THOUGHTS.sql}",
    "think_solution": f"SELECT id, CASE WHEN error IS NULL THEN solution END AS solution, error, think_open, search, exact FROM (SELECT *, CASE {' '.join(f"WHEN {_n(t)} <> 1 THEN 'count of {t} is not 1'" for t in T.TAGS)} WHEN length({_strip(_between(*T.TAGS[:2]))}) = 0 THEN 'Thought is empty' END AS error, {_strip(_between(*T.TAGS[2:]))} AS solution, {_n('<think>')} AS think_open, {_n('<<<<<<< SEARCH')} AS search, {EXACT} AS exact FROM {THOUGHTS.sql})",
    "code_block": f"SELECT id, CASE WHEN len(list_filter({BLOCK}, lambda x: contains(x, 'def '))) > 0 THEN list_filter({BLOCK}, lambda x: contains(x, 'def '))[-1] WHEN len({BLOCK}) > 0 THEN {BLOCK}[-1] END AS code FROM {CODE.sql}",
    "identifiers": rf"SELECT id, regexp_replace(lower(text), '[_\-.\s]', '', 'g') AS plain, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS strict, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+')[1:2], ' ') AS two, array_to_string(regexp_extract_all(replace(lower(text), '_', ' '), '[a-z0-9]+'), ' ') AS tokens FROM {NAMES.sql}",
    "numbers_equal": f"SELECT id, {_equal('a', 'b')} AS equal FROM {NUMBERS.sql}",
    "text_shapes": rf"SELECT doc_id, length(regexp_replace(text, '\s', '', 'g')) AS chars, len(list_filter([trim(x) FOR x IN regexp_split_to_array(text, '\n[ \t]*\n')], lambda x: length(x) > 0)) AS paragraphs, len(list_filter({LINES}, lambda x: regexp_matches(x, '^#{{1,6}}[ \t]+\S'))) > 0 AS heading, len(list_filter({LINES}, lambda x: regexp_matches(x, '^[ \t]*[-*・][ \t]+\S'))) AS bullets, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+')[1:4], ' ') AS prefix4 FROM documents",
    "row_digest": "SELECT item_id, sha256('benchmark' || chr(31) || 'text' || chr(31) || text) AS item_key FROM benchmark",
}
QUERIES = {name: _validator(name[4:]) if name.startswith("val_") and name != "val_bundle" else globals()[name] for name in ORACLES}
