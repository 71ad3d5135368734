"""Operators across documents: repeats, near copies, containment, host graph."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from siftline.llm import bk_tree, containment, link_graph, suffix_dedup
from siftline.llm.common import components
from siftline.llm.queries import URL_RULES


def brute_repeats(rows, length=100):
    first, out = {}, {}
    for d, t in sorted({(d, t) for d, t in rows if d is not None and t}):
        raw = t.encode()
        for p in range(len(raw) - length + 1):
            first.setdefault(raw[p : p + length], (d, p))
    for d, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        if d is not None:
            for p in range(len(raw) - length + 1):
                if first[raw[p : p + length]] < (d, p):
                    gone[p : p + length] = b"\1" * length
        runs = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(gone)))
        out[d] = (len(raw), sum(gone), runs, hashlib.sha256(bytes(b for b, x in zip(raw, gone) if not x)).hexdigest())
    return out


def passages(seed=4, n=80):
    r = random.Random(seed)
    word = lambda k: " ".join(r.choice("alpha beta gamma delta é日 kappa la mu".split()) + str(r.randint(0, 30)) for _ in range(k))
    shared = [word(k) for k in (8, 12, 20, 30, 60)]
    rows = [(i, " ".join(r.choice([word(r.randint(1, 20)), r.choice(shared), r.choice(shared)[r.randint(0, 40) :][: r.randint(60, 140)]]) for _ in range(r.randint(1, 8)))) for i in range(n)]
    rows += [(200, "ing " * 200), (201, "ing " * 90 + "x"), (202, rows[3][1]), (203, rows[3][1]), (204, ""), (205, None), (206, "a" * 99), (207, "a" * 100), (208, "a" * 101), (5, rows[5][1])]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("batch, hot", [(4000, 20_000), (7, 20_000), (4000, 1)])
def test_repeats_equal_brute_force(spark, batch, hot):
    rows = passages()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove_repeats(df, digest=True, hot=hot).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == brute_repeats(rows)


def test_repeats_edges(edge, empty):
    got = suffix_dedup.remove_repeats(edge).collect()
    assert len(got) == edge.count()
    assert all(r.n_bytes == r.n_removed + len(r.kept) for r in got)
    assert {r.n_removed for r in got if r.doc_id is None} == {0}
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_longest_previous_factor():
    r = random.Random(1)
    for t in (b"", b"a", b"banana", b"abcabcabcx", b"aaaaaaaa", bytes(range(40)), bytes(r.choice(b"ab") for _ in range(200))):
        suffixes = np.array(sorted(range(len(t)), key=lambda i: t[i:]), np.int64)
        match = lambda i, j: next((k for k in range(len(t) - max(i, j)) if t[i + k] != t[j + k]), len(t) - max(i, j))
        common = lambda a, b: np.array([match(i, j) for i, j in zip(suffixes[a].tolist(), suffixes[b].tolist())], np.int64)
        lpf = suffix_dedup.longest_previous_factor(suffixes, common)
        assert lpf.tolist() == [max((match(i, j) for j in range(i)), default=0) for i in suffixes.tolist()]


def test_previous_smaller():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 7, 8, 33, 200):
        x = rng.integers(0, max(1, n // 2), n) if n else np.zeros(0, np.int64)
        want = [max((j for j in range(i) if x[j] < x[i]), default=-1) for i in range(n)]
        assert suffix_dedup.previous_smaller(x).tolist() == want


def test_phrases_do_not_depend_on_chunks(monkeypatch):
    texts = [t.encode() for _, t in passages() if t]
    data, bounds = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    want = suffix_dedup.phrases(data, bounds, 100, 24)
    for chunk in (150, 997):
        monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
        assert all((a == b).all() for a, b in zip(want, suffix_dedup.phrases(data, bounds, 100, 24)))
    _, own, lo, hi, at = want
    assert (lo >= bounds[own]).all() and (hi + 100 <= bounds[own + 1]).all() and (lo <= at).all() and (at + 24 <= lo + 100 + hi - lo).all()
    assert (hi - lo + 1).sum() == sum(max(0, len(t) - 99) for t in texts)  # each string has one owner


def test_ids_must_be_integers(spark):
    with pytest.raises(TypeError, match="doc_id"):
        suffix_dedup.remove_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
    with pytest.raises(TypeError, match="doc_id"):
        bk_tree.keep_first(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


@pytest.mark.parametrize("radius", [0, 2, 14])
def test_forest_search_is_complete(radius):
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**63), 2**63 - 1, 150, dtype=np.int64)
    fps = np.unique(np.concatenate([base] + [base ^ (1 << rng.integers(0, 63, 150)) ^ (1 << rng.integers(0, 63, 150)) for _ in range(3)]))
    group = np.sort(rng.integers(0, 5, len(fps)))
    got = {(int(a), int(b)) for x, y in bk_tree.Forest(fps, group).links(radius) for a, b in zip(x, y)}
    far = np.bitwise_count(fps.view(np.uint64)[:, None] ^ fps.view(np.uint64)[None])
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero((far <= radius) & (group[:, None] == group[None]))) if j < i}
    assert got == want


def closed(ids, linked):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            low = min(label[b] for b in ids if b == a or linked(a, b))
            if low < label[a]:
                label[a], changed = low, True
    return label


def test_simhash_components(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    texts = {i: " ".join(r.choices(words, k=r.randint(0, 40))) for i in range(60)}
    texts |= {100 + i: t + " tail" for i, t in texts.items() if i % 2} | {300: "", 301: None, 302: " \t", 303: "one", 304: "ONE"}

    def fingerprint(t):
        w = (t or "").lower().split()
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fp = {i: fingerprint(t) for i, t in texts.items()}
    want = closed(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in bk_tree.near_duplicates(df).collect()}
    assert got == {i: (f"{fp[i]:016x}", want[i]) for i in texts}


@pytest.mark.parametrize("block, prune", [(1024, bk_tree.PRUNE), (3, 0.1)])  # the latter links what is not alike, so groups fall apart
def test_near_groups_equal_brute_force(spark, monkeypatch, block, prune):
    monkeypatch.setattr(bk_tree, "BLOCK", block)
    monkeypatch.setattr(bk_tree, "STAR", block)
    monkeypatch.setattr(bk_tree, "SHARD", 20_000 if block > 3 else 2)
    monkeypatch.setattr(bk_tree, "PRUNE", prune)
    r = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(25):
        base = r.choices(words, k=r.randint(5, 120))
        for c in range(r.randint(1, 6)):
            rows.append((len(rows), " ".join(w if r.random() > 0.02 * c else r.choice(words) for w in base)))
    rows += [(900, ""), (901, None), (902, rows[0][1].upper()), (0, rows[0][1])]
    sets = {i: frozenset(bk_tree.shingle_hashes(bk_tree.words_of(t), 5).tolist()) for i, t in rows}
    near = lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9
    want = closed(sorted(sets), near)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.key: r.group for r in bk_tree.near_groups(df).collect()} == want
    kept = {r.doc_id for r in bk_tree.keep_first(df).collect()}
    assert kept == {i for i, g in want.items() if i == g}


def test_near_groups_of_repeated_lines(spark):
    rows, r = [], random.Random(9)
    for i in range(30):  # one line repeated 40 times: the sets differ in a few shingles, the counted ones in most
        base = [f"d{i}x{r.randrange(10**6)}" for _ in range(300)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base + [f"line{i}w{j}" for j in range(8)] * 40))]
    got = {x.key: x.group for x in bk_tree.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: k // 2 * 2 for k in got} and len(got) == 60


def test_keys_of_near_copies():
    """Sets of similarity 0.8: at most 1 in a million may share no key; with 10 pairs of 5 minima, 0.7 % did."""
    rng, lost = np.random.default_rng(3), 0
    for _ in range(2000):
        h = rng.integers(0, 2**64, 90, dtype=np.uint64)
        a, b = (bk_tree.minima(np.concatenate([h[:80], own])) for own in (h[80:], rng.integers(0, 2**64, 10, dtype=np.uint64)))
        keys = (a == b)[: 2 * bk_tree.BANDS].reshape(-1, 2).all(1)
        lost += not keys.any()
    assert lost == 0 and 0.36**bk_tree.BANDS < 1e-6


def test_near_edges(edge, empty):
    assert bk_tree.near_duplicates(edge).count() == edge.count()
    assert bk_tree.near_duplicates(empty).count() == 0
    kept = bk_tree.keep_first(edge)
    assert kept.columns == edge.columns and {r.doc_id for r in kept.collect()} == {None, 0, 3, 4, 5, 7, 8}
    assert bk_tree.keep_first(empty).count() == 0


def test_components_of_a_chain_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 150)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)} | {200: 150}


def test_containment_equals_brute_force(spark, edge, empty):
    r = random.Random(8)
    words = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(r.choices(words, k=n))) for i, n in enumerate([3, 5, 6, 12, 30, 30, 60])] + [(50, None), (51, ""), (52, "v1 v2")]
    rows = []
    for i in range(80):
        parts = r.choices(words, k=r.randint(0, 200))
        for _, t in r.sample(items[:7], 2):
            parts += [w if r.random() > 0.03 else "zz" for w in t.split()] + r.choices(words, k=3)
        rows.append((i, ", ".join(parts).title()))
    rows += [(90, "V1 v2"), (91, None), (92, "")]
    sets = {i: set(containment.shingles(t)) for i, t in items}
    want = {(d, i) for d, t in rows for i, s in sets.items() if s and len(s & set(containment.shingles(t))) >= 0.8 * len(s) - 1e-9}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    frame = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in containment.matches(docs, frame).collect()} == want and want
    assert {(r.doc_id, r.item_id) for r in containment.matches(docs, frame, block_bytes=200).collect()} == want
    dirty = {d for d, _ in want}
    assert {r.doc_id for r in containment.clean(docs, frame).collect()} == {d for d, _ in rows} - dirty
    assert containment.clean(edge, frame).count() == edge.count()
    none = frame.where("item_id < 0")
    assert containment.matches(docs, none).count() == 0 and containment.clean(docs, none).count() == len(rows)
    assert containment.matches(empty, frame).count() == 0


def test_containment_of_short_and_unspaced_items(spark):
    items = [(1, "Ringed Seal"), (2, "polonium"), (3, "量子力学の基礎方程式を述べよ"), (4, "東京"), (5, "a b c d e f"), (6, "東京タワー")]
    rows = [(10, "a paper on the ringed seal, its young " + "and more " * 50), (11, "ringed. Polonium"), (12, "問題：量子力学の基礎方程式を述べよ。答えは次の通りです"), (13, "私は東京に住む"), (14, "ringed x seal"), (15, "a b c d e f")]
    docs, frame = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = containment.matches(docs, frame, any_length=True).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(10, 1), (11, 2), (12, 3), (13, 4), (15, 5)]
    assert {r.containment for r in found} == {1.0}
    assert [r.doc_id for r in containment.clean(docs, frame, any_length=True).collect()] == [14]


def test_url_rules_and_graph(spark):
    pages = [
        (1, "https://A.Example.org/es/x", '<a href="https://bad.com/q">'), (2, "http://example.org/en/12", None), (3, "https://x.org", ""), (4, "https://x.com/fr/", '<A HREF=//seen.net/a>'),
        (5, "https://bad.com/de/1?u=1", None), (6, "nourl", None), (7, None, None), (8, "https://linker.net/a", '<a href="http://bad.com/">'), (9, "https://seen.net/b#f", None), (1, "https://A.Example.org/es/x", None),
    ]
    df = spark.createDataFrame(pages, "page_id int, url string, html string")
    got = {r.page_id: r for r in link_graph.judge(df, URL_RULES).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in (1, 3, 5, 6, 7)] == [("a.example.org", "/es/x", "example.org/es/"), ("x.org", "", None), ("bad.com", "/de/1", "com/de/"), ("", "", None), ("", "", None)]
    assert {i: got[i].verdict for i in got} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "block", 6: "allow", 7: "allow", 8: "block", 9: "allow"}
    assert got[9].trust > 0 and got[8].distrust > 0
    assert link_graph.judge(df.where("page_id < 0"), URL_RULES).count() == 0


def test_distrust_reaches_far_and_faint_hosts(spark):
    link = lambda h: f'<a href="https://{h}/">'
    n = 14  # a chain to a blocked host, longer than ten links
    rows = [(i, f"https://h{i}.net/", link(f"h{i + 1}.net" if i + 1 < n else "bad.com")) for i in range(n)]
    rows += [(50, "https://bad.com/de/1", None), (51, "https://free.net/", None)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    got = {r.page_id: r for r in link_graph.judge(df, URL_RULES).collect()}
    assert {i for i in got if got[i].verdict == "block"} == {*range(n), 50}
    assert got[0].distrust == pytest.approx(0.15 * 0.85**n)
    seeds = spark.createDataFrame([("bad.com", 0.0, 1e-8)], "host string, trust double, distrust double")
    edges = spark.createDataFrame([(f"a{i}", "bad.com", 1) for i in range(2000)], "src string, dst string, n long")
    faint = link_graph.spread(edges, seeds).where("host != 'bad.com'")
    assert faint.count() == 2000 and faint.where("distrust > 0 and distrust < 1e-12").count() == 2000


def test_scores_equal_a_dense_matrix(spark):
    """Cyclic links between many hosts, one of which half of all pages link to."""
    r = random.Random(12)
    hosts = [f"h{i}.net" for i in range(30)] + ["bad.com", "good.fr.com", "hot.net"]
    rows = []
    for i in range(300):
        links = [r.choice(hosts) for _ in range(r.randint(0, 4))] + ["hot.net"] * (i % 2)
        host = r.choice(hosts)
        path = {"bad.com": "/de/x", "good.fr.com": "/fr/y"}.get(host, "/")
        rows.append((i, f"https://{host}{path}", "".join(f"<a href='https://{x}/'>" for x in links)))
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    pages = df.select("html", link_graph.url_host(F.col("url")).alias("host"))
    seeds = spark.createDataFrame([("bad.com", 0.0, 0.7), ("h3.net", 0.0, 0.3), ("good.fr.com", 1.0, 0.0)], "host string, trust double, distrust double")
    got = {x.host: (x.trust, x.distrust) for x in link_graph.spread(link_graph.host_edges(pages), seeds, tolerance=1e-4).collect()}
    n = np.zeros((len(hosts), len(hosts)))
    for _, url, html in rows:
        for x in re.findall(r"https://([^/]+)/'", html):
            a, b = hosts.index(url.split("/")[2]), hosts.index(x)
            n[a, b] += a != b
    for k, m, s in ((0, n, {"good.fr.com": 1.0}), (1, n.T, {"bad.com": 0.7, "h3.net": 0.3})):
        w = m / np.maximum(m.sum(1, keepdims=True), 1)
        want = np.linalg.solve(np.eye(len(hosts)) - 0.85 * w.T, 0.15 * np.array([s.get(h, 0.0) for h in hosts]))
        assert [got.get(h, (0, 0))[k] for h in hosts] == pytest.approx(want.tolist(), rel=5e-3, abs=1e-12)


def test_texts_are_dealt_once_and_spans_carry_no_hash(spark, tmp_path):
    r = random.Random(4)
    shared = "".join(r.choice("abcdef ") for _ in range(300))
    rows = [(i, "".join(r.choice("ghijkl ") for _ in range(200)) + shared[r.randint(0, 80) : 220 + r.randint(0, 80)]) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    found = suffix_dedup.settle(suffix_dedup.anchors(docs.select("doc_id", "text"), 100, 24), 100)
    assert found.where(f"ctx <> 0 or kind = {suffix_dedup.KIND_SPAN} and h <> 0").count() == 0
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = suffix_dedup.remove_repeats(docs)
        got = {x.doc_id: bytes(x.kept) for x in out.collect()}
        plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ReusedExchange" in plan
    assert {k: v[3] for k, v in brute_repeats(rows).items()} == {k: hashlib.sha256(v).hexdigest() for k, v in got.items()}


def test_near_groups_come_through_bk_trees(spark, monkeypatch):
    """Copies of long texts with one word changed differ in few fingerprint bits: the trees alone find them."""
    r = random.Random(8)
    rows, trees = [], set()
    for i in range(12):
        w = [f"w{r.randint(0, 50000)}" for _ in range(3000)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w[:1500], "other", *w[1501:]]))]
        a, b = (bk_tree.simhash(np.unique(bk_tree.shingle_hashes(bk_tree.words_of(t), 5))) for _, t in rows[-2:])
        if int(bk_tree.distance(np.int64([a]), np.int64([b]))[0]) <= 2:
            trees.add(i)
    monkeypatch.setattr(bk_tree, "candidate_links", lambda shards, sketches: spark.createDataFrame([], "a long, b long"))
    got = {x.key: x.group for x in bk_tree.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(trees) >= 6
    assert got == {k: k - k % 2 if k // 2 in trees else k for k, _ in rows}
