"""Text functions (P4-P16, P19-P22, P33, Y2-Y5, F13) as column expressions, Arrow UDFs only where needed."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

WORD_RUN = r"[\p{L}\p{N}]+"
#: Characters whose normal form is their lower case (and ss for the sharp s): no UDF needed.
BEYOND_LATIN = r"[^\x00-\x7FÀ-ÖØ-öø-ÿ]"
#: Ranges whose characters are tokens of their own.
CJK = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x3040, 0x30FF), (0xAC00, 0xD7AF))


def _is_cjk(c: str) -> bool:
    return any(a <= ord(c) <= b for a, b in CJK)


def token_list(text: str) -> list[str]:
    """P4 for one string: NFKC, casefold, CJK characters single, other alphanumeric runs whole."""
    out, run = [], []
    for c in unicodedata.normalize("NFKC", text).casefold():
        single = _is_cjk(c)
        if single or not c.isalnum():
            if run:
                out.append("".join(run))
                run = []
            if single:
                out.append(c)
        else:
            run.append(c)
    return out + (["".join(run)] if run else [])


@F.pandas_udf(ArrayType(StringType()))
def _tokens_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else token_list(t))


def normalize_tokens(text: Column) -> Column:
    """P4. Latin texts stay in the JVM; only others reach the Arrow UDF, the rest is null there."""
    other = text.rlike(BEYOND_LATIN)
    plain = F.regexp_extract_all(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit(WORD_RUN), 0)
    return F.when(other, _tokens_udf(F.when(other, text))).otherwise(plain)


def ascii_tokens(text: Column) -> Column:
    """Y2: lower case, underscore is a space, runs of [a-z0-9]."""
    return F.regexp_extract_all(F.replace(F.lower(text), F.lit("_"), F.lit(" ")), F.lit("[a-z0-9]+"), 0)


def collapsed(text: Column) -> Column:
    """Lower case with white space collapsed and stripped, as P9 wants it."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def plain_identifier(text: Column) -> Column:
    """P10: without underscore, hyphen, dot and white space."""
    return F.regexp_replace(F.lower(text), r"[_\-.\s]", "")


def strict_identifier(text: Column) -> Column:
    """Letters a-z and digits alone."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def first_words(text: Column, n: int) -> Column:
    """The first n ASCII words, lower case, joined."""
    return F.array_join(F.slice(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0), 1, n), " ")


def after_think(text: Column) -> Column:
    """What stands after the last closing think tag."""
    return F.substring_index(text, "</think>", -1)


NUMBER = r"-?\d[\d,]*(?:\.\d+)?"


def last_number(text: Column) -> Column:
    """After the thinking, the last #### number, else the last number; commas dropped, null if none."""
    tail = after_think(text)
    marked = F.regexp_extract_all(tail, F.lit(rf"####\s*({NUMBER})"), 1)
    every = F.regexp_extract_all(tail, F.lit(NUMBER), 0)
    found = F.when(F.size(marked) > 0, F.element_at(marked, -1)).when(F.size(every) > 0, F.element_at(every, -1))
    return F.replace(found, F.lit(","), F.lit(""))


def gold_number(text: Column) -> Column:
    """The first #### number."""
    return F.nullif(F.replace(F.regexp_extract(text, rf"####\s*({NUMBER})", 1), F.lit(","), F.lit("")), F.lit(""))


def numbers_equal(a: Column, b: Column) -> Column:
    """Closer than 1e-4; texts that aren't numbers compare trimmed; null is unequal."""
    x, y = a.try_cast("double"), b.try_cast("double")
    return F.coalesce(F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) < 1e-4).otherwise(F.trim(a) == F.trim(b)), F.lit(False))


def choice_letter(text: Column) -> Column:
    """The last letter A-D after a keyword, else the last standalone one."""
    tail = after_think(text)
    keyed = F.regexp_extract_all(tail, F.lit(r"(?i:answer|option|choice)\s*(?i:is)?\s*[:=]?\s*\(?([A-D])\b"), 1)
    alone = F.regexp_extract_all(tail, F.lit(r"\b([A-D])\b"), 1)
    return F.when(F.size(keyed) > 0, F.element_at(keyed, -1)).when(F.size(alone) > 0, F.element_at(alone, -1))


def code_block(text: Column) -> Column:
    """The last fenced block after the thinking, one with a def before others; null if none."""
    blocks = F.regexp_extract_all(after_think(text), F.lit(r"(?s)```[A-Za-z0-9_+-]*\n(.*?)```"), 1)
    with_def = F.filter(blocks, lambda b: F.contains(b, F.lit("def ")))
    return F.when(F.size(with_def) > 0, F.element_at(with_def, -1)).when(F.size(blocks) > 0, F.element_at(blocks, -1))


def think_split(text: Column) -> Column:
    """Struct of thinking length, whether it is closed, and the payload."""
    start = F.locate("<think>", text)
    rest = F.substring(text, start + 7, F.length(text))
    end = F.locate("</think>", rest)
    length = F.when(start == 0, 0).when(end == 0, F.length(rest)).otherwise(end - 1).cast("long")
    closed = (start > 0) & (end > 0)
    payload = F.when(closed, F.substring(rest, end + 8, F.length(rest))).otherwise(text)
    return F.struct(length.alias("chars"), closed.alias("closed"), payload.alias("payload"))


def count_of(text: Column, literal: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))) / len(literal)).cast("long")


TAGS = ("<think>", "</think>", "<solution>", "</solution>")


def tag_flags(text: Column) -> Column:
    """Counts of the four tags and of search markers, and whether each tag stands exactly once."""
    counts = [count_of(text, t).alias(n) for t, n in zip(TAGS, ("think_open", "think_close", "solution_open", "solution_close"))]
    exact = F.lit(True)
    for t in TAGS:
        exact = exact & (count_of(text, t) == 1)
    return F.struct(*counts, count_of(text, "<<<<<<< SEARCH").alias("search"), exact.alias("exact"))


def touched_files(patch: Column) -> Column:
    """Paths of all diff headers, repeats kept."""
    return F.regexp_extract_all(patch, F.lit(r"(?m)^diff --git a/(\S+) b/"), 1)


def sentences(text: Column) -> Column:
    """Split at Japanese sentence ends, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(text, "[。！？]+"), lambda s: F.trim(s)), lambda s: F.length(s) > 0)


def paragraphs(text: Column) -> Column:
    """Split at blank lines, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(text, r"\n[ \t]*\n"), lambda s: F.trim(s)), lambda s: F.length(s) > 0)


def all_match(items: Column, pattern: str) -> Column:
    return F.forall(items, lambda s: s.rlike(pattern))


# Endings that make a sentence polite or plain.
POLITE = "(です|ます|ください|でした|ません)$"
PLAIN = "(だ|である|だった|ない|する|した|れる|られる)$"
SCRIPTS = {"hiragana": "ぁ-ゖー、。", "katakana": "ァ-ヺー、。", "kanji": "一-鿿、。"}
TABLE_RULE = r"^\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?$"

#: F13a-F13n: validator name -> (text, constraint arguments) -> passed.
VALIDATORS = {
    "char_range": lambda t, min, max: F.length(F.regexp_replace(t, r"\s", "")).between(min, max),
    "sentence_count": lambda t, count: F.size(sentences(t)) == count,
    "paragraph_count": lambda t, count: F.size(paragraphs(t)) == count,
    "keyword_count": lambda t, keyword, count: count_of(t, keyword) == count,
    "forbidden_word": lambda t, word: ~F.contains(t, F.lit(word)),
    "script_only": lambda t, script: F.regexp_replace(t, r"\s", "").rlike(f"^[{SCRIPTS[script]}]+$"),
    "bullet_count": lambda t, count: F.size(F.regexp_extract_all(t, F.lit(r"(?m)^[ \t]*[-*・][ \t]+\S"), 0)) == count,
    "numbered_list_count": lambda t, count: F.size(F.regexp_extract_all(t, F.lit(r"(?m)^[ \t]*\d+[.)、】【][ \t]*\S"), 0)) == count,
    "heading": lambda t: t.rlike(r"(?m)^#{1,6}[ \t]+\S"),
    "json_object": lambda t, keys: F.coalesce(F.size(F.array_except(F.array(*map(F.lit, keys)), F.json_object_keys(t))) == 0, F.lit(False)),
    "markdown_table": lambda t, rows: (F.size(F.filter(F.split(t, "\n"), lambda s: F.contains(s, F.lit("|")))) >= rows + 2)
    & F.exists(F.split(t, "\n"), lambda s: F.trim(s).rlike(TABLE_RULE)),
    "polite_style": lambda t: (F.size(sentences(t)) > 0) & all_match(sentences(t), POLITE),
    "plain_style": lambda t: (F.size(sentences(t)) > 0) & all_match(sentences(t), PLAIN),
    "ending": lambda t, suffix: F.endswith(F.regexp_replace(t, r"\s+$", ""), F.lit(suffix)),
}


def failures(text: Column, constraints: list[dict]) -> Column:
    """names of all constraints that fail, in order; unknown types are reported."""
    parts = []
    for c in constraints:
        kind, args = c["type"], {k: v for k, v in c.items() if k != "type"}
        if kind in VALIDATORS:
            parts.append(F.when(~F.coalesce(VALIDATORS[kind](text, **args), F.lit(False)), F.lit(kind)))
        else:
            parts.append(F.lit(f"unknown_constraint:{kind}"))
    return F.array_compact(F.array(*parts))
