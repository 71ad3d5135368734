"""PII surrogates: keyed, type-consistent replacements, distinct and the same everywhere.

Detected entities are e-mail addresses, phone numbers, IPv4 and IPv6 addresses, payment
card and account numbers, social security numbers, IBANs, secrets after a telling word
or prefix, and names after a title. Numbers that a checksum tells from cards and IBANs
stay. Each entity has a canonical form (digits of a phone number, lower-cased address,
full IPv6 groups), and its surrogate is drawn from a keyed hash of kind, canonical form
and attempt. It keeps type and layout: letters of the same script and case, digits,
separators, country codes, private address ranges, the card's first digit and checksum
validity, IBAN check digits, the gender of a name and its title.

A name that stands after a title is looked for in the rest of its document too, as a
whole word with a capital: "Mr John Smith met Smith" gives one surrogate for both. A
given name's gender is that of its titles in the document, else that of a list of common
names, else neutral; names of different gender are different entities.

Collision checks: an entity's surrogate may be neither another entity's surrogate nor
any real entity of its kind in the corpus. All first choices are compared in one grouped
pass; losers draw again until none is left. So different entities stay different, and
equal ones, in any layout, get one surrogate everywhere. From attempt ``WIDEN`` on a
private address may leave its range for 10.0.0.0/8, and from ``GROW`` on every kind
grows by one character an attempt (an IPv4 address by the digits of a port), so there is
room for any number of entities and the rounds end, even if a whole range is in use.

Only entities that needed another attempt are looked up when texts are rewritten. They
are broadcast up to ``LOOKUP_ROWS`` and joined by document beyond that.

Defined results: null texts stay null, texts without entities stay as they are. Rows and
columns stay (with ``marks``, columns named n_entities or kinds are replaced); repeated
rows change alike; a null id is allowed.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import free_name, map_batches, materialize, narrow, release, slices

LOOKUP_ROWS = 200_000
#: From these attempts on a private address may leave its range, and a surrogate grows by one
#: character an attempt, so there is always room.
WIDEN, GROW = 3, 6

# Name lists by script, and given names also by gender.
GIVEN = {
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Louis Marc Nils Oscar Paul Rafael Simon Thomas Victor".split(),
    ("latin", "f"): "Anna Berta Clara Diana Emma Flora Greta Helena Irene Julia Klara Laura Maria Nora Olivia Paula Rosa Sofia Teresa Vera".split(),
    ("latin", "n"): "Alex Andrea Chris Dominique Jamie Jules Kim Lee Maxime Noa Pat Robin Sacha Sam Toni".split(),
    ("cyrillic", "m"): "Андрей Борис Виктор Григорий Дмитрий Егор Иван Максим Николай Олег Павел Сергей".split(),
    ("cyrillic", "f"): "Алла Вера Галина Дарья Елена Зоя Ирина Мария Нина Ольга Софья Юлия".split(),
    ("cyrillic", "n"): "Саша Женя Валя Слава".split(),
}
SURNAME = {
    "latin": "Abel Baker Castro Dupont Engel Fischer Garnier Hansen Ibarra Jansen Keller Lambert Moreau Navarro Olsen Peters Quint Renard Santos Thorne Ulrich Vidal Weber Ximenez Young Zeller".split(),
    "cyrillic": "Белов Волков Громов Данилов Ершов Жуков Зимин Крылов Лебедев Морозов Носов Орлов Павлов Соболев Титов Фролов".split(),
}
TITLES = {
    "m": "Mr Herr Señor Monsieur господин".split(),
    "f": "Mrs Ms Miss Frau Señora Señorita Madame Mme госпожа".split(),
    "n": "Dr Prof Professor доктор".split(),
}
#: Common given names that are no surrogates, for the gender of names whose title tells none.
COMMON = {
    "m": "Alan Andrew Anthony Brian Charles Daniel Edward Frank George Henry Jack James Jean Johann John Joseph José Kevin Mark Michael Peter Pierre Richard Robert Stephen William".split(),
    "f": "Alice Barbara Caroline Catherine Charlotte Deborah Elizabeth Emily Hannah Isabel Jane Jennifer Karen Linda Lisa Margaret Marie Mary Nancy Patricia Rachel Ruth Sarah Susan Ursula".split(),
}
GENDER = {t: g for g, titles in TITLES.items() for t in titles}
KNOWN = {n.lower(): g for (_, g), names in GIVEN.items() if g != "n" for n in names} | {n.lower(): g for g, names in COMMON.items() for n in names}
SECRET_WORDS = "token api_key apikey api-key secret password passwd access_key private_key client_secret auth_token"

NAME = r"[^\W\d_a-zà-ÿа-я][^\W\d_]+(?:-[^\W\d_]+)?"
H, V4 = r"[0-9A-Fa-f]{1,4}", r"(?:\d{1,3}\.){3}\d{1,3}"
#: A whole quoted value, or all up to a blank, a closing quote, a tag or the next ``name=``.
VALUE = r"""\"(?P<q>(?:\\.|[^\"\\\n]){8,})\"|'(?P<s>(?:\\.|[^'\\\n]){8,})'|[\"']?(?P<v>(?![\"'])(?:[^\s\"'<,;&]|[,;&](?![\w.-]+[\"']?\s{0,3}[=:])|[\"'](?=\w)|<(?![/A-Za-z!])){7,}(?:[^\s\"'<>,;&]|&(?![\w.-]+[\"']?\s{0,3}[=:])))"""
KINDS: list[tuple[str, re.Pattern]] = [
    ("email", re.compile(r"[^\W_][\w.%+-]*@[^\W_][\w-]*(?:\.[^\W_][\w-]*)+")),
    ("secret", re.compile(r"(?i)(?:" + "|".join(SECRET_WORDS.split()) + r")\b[\"']?\s{0,3}[=:]\s{0,3}(?:" + VALUE + ")")),
    ("secret", re.compile(r"\b(?P<v>(?:AKIA[0-9A-Z]{12,}|gh[pousr]_[A-Za-z0-9]{20,}|xox[abp]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{16,}|eyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]{5,}))")),
    ("iban", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")),
    ("ipv6", re.compile(rf"(?<!\w)(?<!::)(?:(?:{H}:){{6}}{V4}|(?:{H}(?::{H}){{0,4}})?::(?:{H}:){{0,4}}{V4}|(?:{H}:){{7}}{H}|(?:{H}(?::{H}){{0,6}})?::(?:{H}(?::{H}){{0,6}})?)(?!\w|:[\w:])")),
    ("ipv4", re.compile(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)")),
    ("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")),
    ("phone", re.compile(r"(?<![\w+])\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,5}(?!\d)")),
    ("card", re.compile(r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?!\d)")),
    ("phone", re.compile(r"(?<![\w+.-])\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?![\d-])")),
]
PERSON = re.compile(r"\b(?P<t>" + "|".join(GENDER) + r")\b\.?[  ](?P<a>" + NAME + r")(?:[  ](?P<b>" + NAME + r"))?")
HAS = re.compile(r"\d")
#: What a text with secrets has at least, case-folded or as it is.
TELLING = ("token", "api_key", "apikey", "api-key", "secret", "passw", "access_key", "private_key")
PREFIXES = ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xoxa-", "xoxb-", "xoxp-", "sk-", "eyJ")


def digits(s: str) -> str:
    return "".join(c for c in s if c.isdecimal())


def canonical(kind: str, s: str) -> str:
    if kind in ("phone", "card", "ssn"):
        return digits(s)
    if kind == "iban":
        return s.replace(" ", "")
    if kind == "ipv6":
        return ":".join(re.findall("....", f"{int(ipaddress.IPv6Address(s)):032x}"))
    return s.lower() if kind == "email" or kind.startswith(("given", "surname")) else s


def script_of(name: str) -> str:
    return "cyrillic" if any("Ѐ" <= c <= "ӿ" for c in name) else "latin"


def is_ipv6(text: str, a: int, b: int) -> bool:
    """An address other than ``::`` that is no end of a longer run of hexadecimal groups."""
    try:
        value = int(ipaddress.IPv6Address(text[a:b]))
    except ValueError:
        return False
    return value > 0 and not (text[max(0, a - 1) : a] == ":" and re.search(rf"(?<!\w){H}:$", text[max(0, a - 6) : a]))


def valid_iban(canon: str) -> bool:
    return int("".join(str(int(c, 36)) for c in canon[4:] + canon[:4])) % 97 == 1


def holds(kind: str, text: str, a: int, b: int) -> bool:
    """Whether what a pattern found is such an entity, by its values and checksums."""
    found = text[a:b]
    if kind == "secret":
        return any(map(str.isalnum, found))  # else a mask
    if kind == "ipv6":
        return is_ipv6(text, a, b)
    if kind == "ipv4":
        return all(int(x) <= 255 for x in found.split("."))
    if kind == "phone":
        return len(digits(found)) >= 8
    if kind == "card":
        return luhn(digits(found))
    return kind != "iban" or valid_iban(found.replace(" ", ""))


def people(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Names after a title, and the same names in the rest of the text."""
    titled = list(PERSON.finditer(text))
    if not titled:
        return
    given: dict[str, list[str]] = {}
    family: set[str] = set()
    for m in titled:
        if m["b"]:
            given.setdefault(m["a"].lower(), []).append(GENDER[m["t"]])
        family.add((m["b"] or m["a"]).lower())

    def given_kind(name: str, own: str = "n") -> str:
        told = [g for g in (own, *given[name], KNOWN.get(name, "n")) if g != "n"]
        return f"given:{script_of(name)}:{told[0] if told else 'n'}"

    for m in titled:
        for g in "ab":
            if m[g]:
                name = m[g].lower()
                yield *m.span(g), given_kind(name, GENDER[m["t"]]) if g == "a" and m["b"] else f"surname:{script_of(name)}", name
    forms = {f for n in family | given.keys() for f in (n.title(), n.upper())} | {m[g] for m in titled for g in "ab" if m[g]}
    bare = re.compile(r"(?<![\w@-])(?:" + "|".join(re.escape(f) for f in sorted(forms, key=len, reverse=True)) + r")(?![\w@-])")
    words = [(m.start(), m.end(), m[0].lower()) for m in bare.finditer(text)]
    for (a, b, name), after in zip(words, [*words[1:], None]):
        first = name in given and (name not in family or after is not None and after[0] == b + 1 and after[2] in family)
        yield a, b, given_kind(name) if first else f"surname:{script_of(name)}", name


def find(text: str) -> list[tuple[int, int, str, str]]:
    """Spans (start, end, kind, canonical form) that don't overlap, in order."""
    spans: list[tuple[int, int, str, str]] = []
    number = bool(HAS.search(text))
    folded = text.casefold() if "=" in text or ":" in text else ""
    secret = any(x in folded for x in TELLING) or any(x in text for x in PREFIXES)
    needed = {"email": "@" in text, "secret": secret, "ipv6": text.count(":") > 1}  # the other kinds have a digit
    for kind, pattern in KINDS:
        if not needed.get(kind, number):
            continue
        for m in pattern.finditer(text):
            a, b = m.span(m.lastgroup or 0)
            if holds(kind, text, a, b):
                spans.append((a, b, kind, canonical(kind, text[a:b])))
    spans += people(text)
    if len(spans) < 2:
        return spans
    kept, end = [], 0
    order = {s: i for i, s in reversed([*enumerate(spans)])}
    for s in sorted(spans, key=lambda s: (s[0], order[s])):
        if s[0] >= end:
            kept.append(s)
            end = s[1]
    return kept


class Draw:
    """Keyed random numbers for one entity and attempt."""

    def __init__(self, secret: bytes, *parts: str):
        self.key, self.parts, self.n, self.pool = secret, "\x1f".join(parts).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hmac.digest(self.key, self.parts + self.n.to_bytes(4), "sha256")
            self.n += 1
        value, self.pool = int.from_bytes(self.pool[:4]), self.pool[4:]
        return value % n

    def like(self, s: str, hexa: bool = False) -> str:
        """Each character replaced by one of its script, case and class; others stay."""
        out = []
        for c in s:
            if c.isdecimal():
                out.append(str(self.below(10)))
            elif "a" <= c <= "z":
                out.append(chr(97 + self.below(6 if hexa else 26)))
            elif "A" <= c <= "Z":
                out.append(chr(65 + self.below(6 if hexa else 26)))
            elif "а" <= c <= "я":
                out.append(chr(0x430 + self.below(32)))
            elif "А" <= c <= "Я":
                out.append(chr(0x410 + self.below(32)))
            elif c.isalpha():  # another of the same block, class and case
                for _ in range(64):
                    d = chr((ord(c) & ~63) + self.below(64))
                    if unicodedata.category(d) == unicodedata.category(c):
                        c = d
                        break
                out.append(c)
            else:
                out.append(c)
        return "".join(out)


def luhn(d: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def surrogate(secret: bytes, kind: str, canon: str, attempt: int) -> str:
    """The canonical form of an entity's surrogate at an attempt."""
    draw, more = Draw(secret, kind, canon, str(attempt)), max(0, attempt - GROW)
    if kind == "email":
        local, _, domain = canon.rpartition("@")
        head, _, tld = domain.rpartition(".")
        return f"{draw.like(local + 'a' * more)}@{Draw(secret, 'domain', domain).like(head)}.{tld}"
    if kind == "phone":
        keep = max(0, len(canon) - 10)
        rest = draw.like(canon[keep:] + "0" * more)
        return canon[:keep] + str(2 + int(rest[0]) % 8) + rest[1:]
    if kind == "card":
        out = canon[0] + draw.like(canon[1:-1] + "0" * more)
        ends = [c for c in "0123456789" if luhn(out + c) == luhn(canon)]
        return out + ends[draw.below(len(ends))]
    if kind == "ssn":
        return f"9{draw.like(canon[1:] + '0' * more)}"
    if kind == "ipv4":
        a, b, _, _ = map(int, canon.split("."))
        keep = 1 if a in (10, 127) else 2 if (a, b) == (192, 168) or a == 172 and 16 <= b < 32 else 0
        first = [x for x in range(1, 224) if x not in (10, 127, 172, 192)]
        own = [str(first[draw.below(len(first))])] + [str(1 + draw.below(254)) for _ in range(3)]
        head = canon.split(".")[:keep] if attempt < WIDEN or not keep else ["10"]
        return ".".join(head + own[len(head) :]) + (":" + str(1 + draw.below(9)) + draw.like("0" * (more - 1)) if more else "")
    if kind == "ipv6":  # zero groups stay, so every layout of the address fits, until that leaves no room
        old = [int(g, 16) for g in canon.split(":")]
        fixed = {0} if old[0] >> 6 == 0x3FA or old[0] >> 9 == 0x7E or old[0] >> 8 == 0xFF else {5} if old[:6] == [0] * 5 + [0xFFFF] else set()
        fixed |= set([i for i in range(8) if not old[i]][: 8 - max(0, more - 1)])
        size = [4 if more or not g else len(f"{g:x}") for g in old]
        low = [16 ** (n - 1) for n in size]
        return ":".join(f"{g if i in fixed else low[i] + draw.below(16 ** size[i] - low[i]):04x}" for i, g in enumerate(old))
    if kind == "iban":
        body = draw.like(canon[4:] + "0" * more)
        number = int("".join(str(int(c, 36)) for c in body + canon[:2] + "00"))
        return f"{canon[:2]}{98 - number % 97:02d}{body}"
    if kind.startswith(("given", "surname")):
        part, script, *gender = kind.split(":")
        names = GIVEN[script, gender[0]] if part == "given" else SURNAME[script]
        out = names[draw.below(len(names))]
        for _ in range(attempt):  # compound names make room for more people than there are names
            out += "-" + names[draw.below(len(names))]
        return out.lower()
    return draw.like(canon + "a" * more, hexa=bool(re.fullmatch(r"[0-9a-fA-F:]+", canon)))


def ipv6_like(seen: str, canon: str) -> str:
    """An address in the layout of another: compressed, padded, dotted and cased alike."""
    new = [int(g, 16) for g in canon.split(":")]
    head, gap, tail = seen.partition("::")
    parts = [x.split(":") if x else [] for x in (head, tail)]
    n, end = (len(part) + any("." in x for x in part) for part in parts)

    def show(part: list[str], groups: list[int]) -> str:
        it = iter(groups)
        return ":".join(".".join(map(str, next(it).to_bytes(2) + next(it).to_bytes(2))) if "." in x else f"{next(it):x}".zfill(len(x)) for x in part)

    fits = not any(new[n : 8 - end])
    out = show(parts[0], new) + gap + show(parts[1], new[8 - end :]) if fits else ipaddress.IPv6Address(canon).compressed
    return out.upper() if seen.isupper() else out


def rendered(kind: str, seen: str, canon: str) -> str:
    """A surrogate's canonical form in the layout and case of what it replaces."""
    if kind in ("phone", "card", "ssn"):
        it = iter(canon)
        return "".join(next(it) if c.isdecimal() else c for c in seen) + "".join(it)
    if kind == "iban":
        it = iter(canon)
        return "".join(c if c == " " else next(it) for c in seen) + "".join(it)
    if kind == "ipv6":
        return ipv6_like(seen, canon)
    if kind == "email" or kind.startswith(("given", "surname")):
        if seen.isupper():
            return canon.upper()
        if kind != "email":
            return canon.title()
        return canon.title() if seen.istitle() else canon
    return canon


def replace(text: str, secret: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str, list[tuple[int, int, str, str]]]:
    """The text with surrogates, and the spans found."""
    spans, out, at = find(text), [], 0
    for a, b, kind, canon in spans:
        new = surrogate(secret, kind, canon, attempts.get((kind, canon), 0))
        out += [text[at:a], rendered(kind, text[a:b], new)]
        at = b
    return ("".join(out) + text[at:] if spans else text), spans


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, canon): the distinct entities of all texts."""

    def make():
        def f(text):
            found = sorted({(k, c) for t in text if t for _, _, k, c in find(t)})
            return {"kind": [k for k, _ in found], "canon": [c for _, c in found]}

        return f

    return map_batches(narrow(docs, text=text), make, "kind string, canon string").distinct()


def assign(found: DataFrame, secret: bytes) -> DataFrame:
    """(kind, canon, attempt, value): collision-free surrogates of distinct entities."""

    def drawn(rows: DataFrame, attempt: int) -> DataFrame:
        make = lambda: lambda kind, canon: {"kind": kind, "canon": canon, "attempt": [attempt] * len(kind), "value": [surrogate(secret, k, c, attempt) for k, c in zip(kind, canon)]}
        return map_batches(rows.select("kind", "canon"), make, "kind string, canon string, attempt int, value string", text=None)

    found = materialize(found)
    real = found.select("kind", F.col("canon").alias("value"), F.lit(0).alias("rank"), F.lit("").alias("owner"))
    claimed, pending, attempt = [], found, 0
    while True:
        new = materialize(drawn(pending, attempt))
        claims = real.unionByName(new.select("kind", "value", F.lit(2).alias("rank"), F.col("canon").alias("owner")))
        for won in claimed:
            claims = claims.unionByName(won.select("kind", "value", F.lit(1).alias("rank"), F.col("canon").alias("owner")))
        winner = claims.groupBy("kind", "value").agg(F.min(F.struct("rank", "owner")).alias("w")).where("w.rank = 2").select("kind", "value", F.col("w.owner").alias("canon"))
        claimed.append(materialize(new.join(winner, ["kind", "value", "canon"], "left_semi").select("kind", "canon", "attempt", "value")))
        left = materialize(new.join(claimed[-1], ["kind", "canon"], "left_anti").select("kind", "canon"))
        release(found.sparkSession, new)
        if attempt:
            release(found.sparkSession, pending)
        if left.isEmpty():
            return reduce(DataFrame.unionByName, claimed)
        pending, attempt = left, attempt + 1


def anonymize(docs: DataFrame, secret: bytes, text: str = "text", marks: bool = False, lookup_rows: int = LOOKUP_ROWS) -> DataFrame:
    """The documents with entities replaced; with ``marks`` also n_entities and kinds."""
    if marks:
        docs = docs.drop("n_entities", "kinds")
    again = assign(entities(docs, text), secret).where("attempt > 0").select("kind", "canon", "attempt")
    n = again.count()
    names, spark = docs.columns, docs.sparkSession
    rows, shared = docs, None
    if n <= lookup_rows:
        shared = spark.sparkContext.broadcast({(r["kind"], r["canon"]): r["attempt"] for r in again.collect()})
    else:
        place, digest, own = (free_name(docs, x) for x in ("place", "digest", "attempts"))

        def make():
            def f(text):
                out = [(t, k, c) for t in set(text) if t for k, c in {s[2:] for s in find(t)}]
                return {n: [r[i] for r in out] for i, n in enumerate(("text", "kind", "canon"))}

            return f

        per_text = map_batches(narrow(docs, text=text), make, "text string, kind string, canon string")
        per_text = per_text.select(F.xxhash64("text").alias(place), F.sha2("text", 256).alias(digest), "kind", "canon").distinct()
        per_text = per_text.join(again, ["kind", "canon"]).groupBy(place, digest).agg(F.collect_list(F.struct("kind", "canon", "attempt")).alias(own))
        rows = docs.withColumns({place: F.xxhash64(text), digest: F.sha2(F.col(text), 256)}).join(per_text, [place, digest], "left").select(*names, own)
    at = names.index(text)
    schema = docs.schema
    if marks:
        schema = docs.withColumns({"n_entities": F.lit(0).cast("long"), "kinds": F.lit("")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, at)):
            texts = batch.column(at).to_pylist()
            if shared is None:
                maps = [{(x["kind"], x["canon"]): x["attempt"] for x in m or ()} for m in batch.column(len(names)).to_pylist()]
            else:
                maps = [shared.value] * len(texts)
            done = [(None, []) if t is None else replace(t, secret, m) for t, m in zip(texts, maps)]
            columns = [pa.array([d[0] for d in done], batch.schema.field(i).type) if i == at else batch.column(i) for i in range(len(names))]
            if marks:
                columns.append(pa.array([len(d[1]) for d in done], pa.int64()))
                columns.append(pa.array([",".join(sorted({s[2].split(":")[0] for s in d[1]})) for d in done], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return rows.mapInArrow(run, schema)


def key_from(text: str) -> bytes:
    """A secret for tests and queries from a passphrase; production passes its own."""
    return hashlib.sha256(text.encode()).digest()
