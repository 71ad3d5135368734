"""PII surrogates, the registered queries against their SQL, and the pipeline end to end."""

import random
import re

import pytest
from compare import duck, duck_rows, spark_rows
from pyspark.sql import functions as F

import corpus_pipeline
from siftline.llm import queries, surrogates

KEY = surrogates.key_from("test")


def replaced(text, attempts=()):
    return surrogates.replace(text, KEY, dict(attempts))[0]


def test_surrogates_keep_type_and_layout():
    out = replaced("card 4111 1111 1111 1111, 4111111111111111; +1 (293) 555-9179 or +12935559179; 10.1.2.3 8.8.8.8; DE89 3704 0044 0532 0130 00")
    cards = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", out)
    assert cards[0].replace(" ", "") == cards[1] != "4111111111111111" and surrogates.luhn(cards[1]) and cards[1][0] == "4"
    a, b = re.search(r"(\+1 \(\d{3}\) \d{3}-\d{4}) or (\+1\d{10})", out).groups()
    assert surrogates.digits(a) == surrogates.digits(b) != "12935559179"
    assert re.search(r"; 10\.\d+\.\d+\.\d+ (?!8\.8\.8\.8)", out)
    iban = re.search(r"DE\d{2}( \d{4}){4} \d\d", out)[0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


@pytest.mark.parametrize("text", ["password: correcthorsebattery", "the key sk-abcdefghijklmnopqrst is ours"])
def test_secrets_need_no_digit(text):
    [(a, b, kind, canon)] = surrogates.find(text)
    assert kind == "secret" and canon not in replaced(text)
    assert replaced(text + ", 7 times") == replaced(text) + ", 7 times"


@pytest.mark.parametrize("value", ["2001:db8::8a2e:370:7334", "fe80::1", "::1", "::ffff:192.0.2.77", "FE80::AB", "2001:db8::", "dead::beef", "1:2:3:4:5:6:7:8"])
def test_ipv6_forms(value):
    text = f"from {value}: ok, ip:{value}, [{value}]:80"
    spans = surrogates.find(text)
    assert [(text[a:b], k) for a, b, k, _ in spans] == [(value, "ipv6")] * 3
    new = re.fullmatch(r"from (\S+): ok, ip:(\S+), \[(\S+)\]:80", replaced(text))
    assert new and new[1] == new[2] == new[3] != value and surrogates.canonical("ipv6", new[1])
    assert re.sub(r"\d+|[A-Fa-f]+|[\dA-Fa-f]+", "", new[1]) == re.sub(r"\d+|[A-Fa-f]+", "", value)
    assert len({surrogates.surrogate(KEY, "ipv6", spans[0][3], i) for i in range(40)}) > 20


def test_ipv6_layouts_are_one_entity():
    long, short = replaced("2001:0db8:0000:0000:0000:0000:0000:00a1 2001:db8::a1").split()
    assert surrogates.canonical("ipv6", long) == surrogates.canonical("ipv6", short) and len(long) == 39 and "::" in short
    for clean in ("std::vector at 12:30:45, a :: b", "aa:bb:cc:dd:ee:ff:00:11:22:33:44:55:66:77:88:99", "password: ********"):
        assert replaced(clean) == clean


@pytest.mark.parametrize(
    "text, value",
    [
        ("DB_PASSWORD=hunter2hunter2", "hunter2hunter2"), ("AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMI/K7MDENG", "wJalrXUtnFEMI/K7MDENG"), ("dbPassword: hunter2hunter2, x", "hunter2hunter2"),
        ("password=abc$defgh1jkl", "abc$defgh1jkl"), ("password=Abcdefg1!secretrest", "Abcdefg1!secretrest"), ("password=a#b%c&d*e!f1", "a#b%c&d*e!f1"), ("?token=abcdefgh12&user=bob", "abcdefgh12"),
        ('{"password": "my long, pass \\" phrase", "user": "bob"}', 'my long, pass \\" phrase'), ("secret='two words!'", "two words!"), ("<b>token=abcdefgh12</b>", "abcdefgh12"), ("password=\"abcd<efgh\"", "abcd<efgh"),
    ],
)
def test_secret_forms(text, value):
    assert [(text[a:b], k) for a, b, k, _ in surrogates.find(text)] == [(value, "secret")]
    assert value not in replaced(text)


def test_surrogates_keep_people_apart_and_together():
    out = replaced("Mr John Smith met Mrs Anna JONES; Mr Smith left. госпожа Анна Иванова")
    m = re.fullmatch(r"Mr (\w+) (\w+) met Mrs (\w+) ([A-Z]+); Mr (\w+) left. госпожа (\w+) (\w+)", out)
    assert m and m[2] == m[5] and m[1] in surrogates.GIVEN["latin", "m"] and m[3] in surrogates.GIVEN["latin", "f"]
    assert m[6] in surrogates.GIVEN["cyrillic", "f"]
    clean = "No data here, 3.14 and 2024-01-02; version 1.2.3."
    assert replaced(clean) == clean


def test_collisions_are_resolved(spark):
    names = [f"name{i}" for i in range(200)]  # far more than there are surnames
    rows = [(i, f"Mr {n.title()} wrote to u{i}@x.com") for i, n in enumerate(names)]
    rows = [(i, t.replace(str(i), chr(97 + i // 26) + chr(97 + i % 26))) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = surrogates.assign(surrogates.entities(df), KEY).collect()
    assert len(found) == 400 == len({(r.kind, r.value) for r in found})
    real = {(r.kind, r.canon) for r in found}
    assert not real & {(r.kind, r.value) for r in found} and max(r.attempt for r in found) > 0
    a = {r.doc_id: r.text for r in surrogates.anonymize(df, KEY).collect()}
    b = {r.doc_id: r.text for r in surrogates.anonymize(df, KEY, lookup_rows=0).collect()}
    assert a == b and len(set(a.values())) == 200


def by_rounds(found, key):
    """What ``assign`` should give, with dictionaries."""
    real, taken, out, attempt = set(found), set(), {}, 0
    while len(out) < len(real):
        asked = {}
        for kind, canon in sorted(real - out.keys()):
            asked.setdefault((kind, surrogates.surrogate(key, kind, canon, attempt)), canon)  # the smallest asks first
        for value, canon in asked.items():
            if value not in real and value not in taken:
                taken.add(value)
                out[value[0], canon] = (attempt, value[1])
        attempt += 1
    return out


def test_surrogates_equal_brute_force(spark):
    r = random.Random(3)
    family = "Adams Baker Young Weber Jones Fischer Иванов".split()
    make = [
        lambda: f"{r.choice(['Mr', 'Mrs', 'Dr'])} {r.choice(['John', 'Kim', 'Anna'])} {r.choice(family)}", lambda: f"Ms {r.choice(family)}", lambda: r.choice(family),
        lambda: f"192.168.{r.randint(0, 1)}.{r.randint(1, 9)}", lambda: f"+49 30 {r.randint(10, 30)} 5555", lambda: f"u{r.randint(1, 20)}@x.com", lambda: f"(212) 555-{r.randint(1000, 1020)}", lambda: "token=abcd" + r.choice("xyz") * 8, lambda: f"{r.randint(100, 104)}-22-3333",
    ]
    rows = [(i, " and ".join(r.choice(make)() for _ in range(r.randint(0, 6)))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {s[2:] for _, t in rows for s in surrogates.find(t)}
    want = by_rounds(found, KEY)
    got = {(x.kind, x.canon): (x.attempt, x.value) for x in surrogates.assign(surrogates.entities(df), KEY).collect()}
    assert got == want and len({(k, v) for (k, _), (_, v) in want.items()}) == len(found)
    assert not {(k, v) for (k, _), (_, v) in want.items()} & found
    attempts = {e: a for e, (a, _) in want.items()}
    texts = {x.doc_id: x.text for x in surrogates.anonymize(df, KEY).collect()}
    assert texts == {i: replaced(t, attempts) for i, t in rows}
    for i, t in rows:  # what was found is replaced by one value for each entity, the rest stays
        at = 0
        for a, b, kind, canon in surrogates.find(t):
            new = surrogates.rendered(kind, t[a:b], want[kind, canon][1])
            assert texts[i].startswith(t[at:a] + new) and surrogates.canonical(kind, new) == want[kind, canon][1]
            texts[i], at = texts[i][a - at + len(new) :], b
        assert texts[i] == t[at:]


def test_a_range_in_full_use_ends(spark):
    own = spark.range(1 << 16).select(F.lit("ipv4").alias("kind"), F.concat(F.lit("192.168."), F.shiftright("id", 8).cast("string"), F.lit("."), (F.col("id") % 256).cast("string")).alias("canon"))
    out = surrogates.assign(own, KEY)
    assert out.count() == 1 << 16 == out.select("value").distinct().count()
    assert out.join(own.select(F.col("canon").alias("value")), "value").count() == 0
    assert out.where(~F.col("value").rlike(r"^(10|192\.168)\.")).count() == 0


@pytest.mark.parametrize("kind, canon", [("ipv4", "10.1.2.3"), ("ssn", "123456789"), ("phone", "4930123456"), ("card", "4111111111111111"), ("iban", "DE89370400440532013000"), ("email", "a@b.cc"), ("secret", "abcdefgh"), ("surname:latin", "smith")])
def test_every_kind_has_room(kind, canon):
    base = surrogates.GROW
    for attempt in range(base + 1, base + 4):
        short, long = (surrogates.surrogate(KEY, kind, canon, a) for a in (0, attempt))
        assert (":" in long if kind == "ipv4" else len(long) > len(short)) and len({surrogates.surrogate(KEY, kind, canon, attempt + i) for i in range(8)}) == 8
        assert surrogates.canonical(kind, surrogates.rendered(kind, canon, long)) == long


def test_names_in_the_rest_of_a_document():
    out = replaced("Mr John Smith met Smith. Mrs Smith and John Smith; SMITH, smith, Smithers. Dr John Smith")
    m = re.fullmatch(r"Mr (\w+) (\w+) met (\w+)\. Mrs (\w+) and (\w+) (\w+); ([A-Z]+), smith, Smithers\. Dr (\w+) (\w+)", out)
    assert m and m[1] == m[5] == m[8] and {m[2], m[3], m[4], m[6], m[7].title(), m[9]} == {m[2]}
    assert m[1] in surrogates.GIVEN["latin", "m"] and "John" not in out
    assert replaced("Smith met John.") == "Smith met John."


def test_numbers_that_fail_their_checksum_stay():
    for clean in ("order 4111111111111112 of today", "DE89 3704 0044 0532 0130 01"):
        assert replaced(clean) == clean


def test_clashing_names(spark):
    rows = [(i, f"Mr Name{chr(97 + i % 26)}{chr(97 + i // 26)} of 10.0.0.{i}", 1, "k", "p", 2, "d") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_entities int, kinds string, place string, attempts int, Digest string")
    a = surrogates.anonymize(df, KEY, marks=True)
    b = surrogates.anonymize(df, KEY, marks=True, lookup_rows=0)
    assert a.columns == ["doc_id", "text", "place", "attempts", "Digest", "n_entities", "kinds"] == b.columns
    assert sorted(a.collect()) == sorted(b.collect()) and {(x.n_entities, x.place, x.attempts) for x in a.collect()} == {(2, "p", 2)}
    assert surrogates.anonymize(df, KEY).columns == df.columns


def test_surrogate_edges(edge, empty):
    out = surrogates.anonymize(edge, KEY)
    assert out.columns == edge.columns
    same = lambda d: sorted(map(str, d.select("doc_id", "text").collect()))
    assert same(out) == same(edge)
    assert surrogates.anonymize(empty, KEY, marks=True).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, sf_dir, name):
    assert spark_rows(queries.queries()[name](spark, sf_dir)) == duck_rows(duck(sf_dir), queries.oracle_sql()[name])


def test_pipeline(spark, sf_dir, edge):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.run(spark, sf_dir)
    assert set(docs.columns) < set(out.columns)
    rows = out.collect()
    assert 0 < len(rows) < docs.count() and len({r.doc_id for r in rows}) == len(rows)
    assert all(r.n_tokens == len(r.ids) for r in rows)
    mail = F.col("text").rlike(r"\w@mail\d\.example\.com")
    assert docs.where(mail).count() > 0 and out.where(mail).count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        edge = stage(spark, edge, sf_dir)
        assert edge.columns[:5] == docs.columns
    assert edge.count() >= 1
