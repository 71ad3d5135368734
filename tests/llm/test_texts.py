"""Per-text operators: audio, language, tokens, counts, licenses."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken

from pyspark.sql import functions as F

from siftline.llm import byte_bpe, byte_cnn, license_scan, mpeg_audio, token_counts

RANKS, PIECES = P.path("byte_bpe_multi_50k.tiktoken"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def rank_library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["", " ", "  a", "\n\n x", "é" * 300, "日本語" * 50, "don't I'LL\x85x\x1c\x1dfoo", "🙂🙂 á", "\U00016ea7x", "x" * 3000, "\0\0a", "<s> </s> <|endoftext|>", "▁ a ▁▁b"]


def odd_texts(n=400, seed=3):
    r = random.Random(seed)
    return ODD + ["".join(r.choice(" ▁\t\nA'a0́éあ😀​\xa0\x1cᚠⅠ²<s>") for _ in range(r.randint(1, 80))) for _ in range(n)]


def test_bpe_equals_rank_library(rank_library):
    bpe = byte_bpe.ByteBPE(RANKS, P.PATTERN)
    for t in odd_texts():
        ids = bpe.encode(t)
        assert ids == np.array(rank_library.encode_ordinary(t), "<u4").tobytes()
        assert bpe.decode(ids) == t.encode()
        ends = bpe.offsets(ids)
        assert (len(ends) == 0 and t == "") or ends[-1] == len(t.encode())


def test_bpe_frames(spark, edge, empty, rank_library):
    got = byte_bpe.roundtrip_digest(edge, RANKS, P.PATTERN).collect()
    inner = lambda ids: sum(b"".join(map(rank_library.decode_single_token_bytes, ids[: k + 1])).decode(errors="ignore").encode() != b"".join(map(rank_library.decode_single_token_bytes, ids[: k + 1])) for k in range(len(ids)))
    split = {r.text: inner(rank_library.encode_ordinary(r.text or "")) if len(r.text or "") < 1000 else 0 for r in edge.collect()}
    assert any(split.values())
    want = Counter((r.doc_id, len(i := rank_library.encode_ordinary(r.text or "")), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest(), split[r.text]) for r in edge.collect())
    assert Counter(map(tuple, got)) == want
    assert byte_bpe.roundtrip_digest(empty, RANKS, P.PATTERN).count() == 0
    tokens = byte_bpe.tokenize(edge, RANKS, P.PATTERN)
    assert Counter((r.doc_id, r.text) for r in tokens.collect()) == Counter((r.doc_id, r.text) for r in edge.collect())
    back = byte_bpe.decode_ids(byte_bpe.encode_texts(edge, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert Counter(map(tuple, back.collect())) == Counter((r.doc_id, r.text or "") for r in edge.collect())


@pytest.mark.parametrize("chunk, overlap", [(32768, 1024), (50, 10), (30, 4), (20, 1)])
def test_token_counts_equal_library(chunk, overlap):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    counter = token_counts.PieceCounter(PIECES, chunk, overlap)
    assert counter.proven
    for t in [*odd_texts(), "word " * 500, "x" * 700, " " * 300]:
        assert counter.count(t) == len(model.encode(t)), t


def test_token_count_frames(edge, empty):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = Counter(map(tuple, token_counts.count_tokens(edge, PIECES).collect()))
    assert got == Counter((r.doc_id, len((r.text or "").encode()), n := len(model.encode(r.text or "")), n > 4096) for r in edge.collect())
    assert token_counts.count_tokens(empty, PIECES).count() == 0


def test_audio_round_trip_and_damage():
    for t in (None, "", "x", "y" * 192, "é" * 4000):
        n, payload = mpeg_audio.padded(t)
        media = mpeg_audio.wrap(payload)
        found = mpeg_audio.parse(media)
        assert mpeg_audio.unwrap(media, found) == payload and len(payload) % 192 == 0 and len(payload) >= max(192, n)
        assert found["frames"] == len(payload) // 192 == found["crc_ok"] == found["table"]["frames"]
        assert found["samples"] == found["frames"] * 1152 and found["micros"] == found["frames"] * 24000
        assert found["resyncs"] == 0 == found["skipped"] and found["tags"] == {"TSSE": 9}
    at = int(found["offsets"][5])
    junk = b"\xff\xfbbroken" * 5
    hurt = mpeg_audio.parse(media[:at] + junk + media[at:])
    assert hurt["frames"] == found["frames"] and hurt["resyncs"] == 1 and hurt["skipped"] == len(junk)
    flipped = bytearray(media)
    flipped[at + 10] ^= 4
    assert mpeg_audio.parse(bytes(flipped))["crc_ok"] == found["crc_ok"] - 1
    flipped = bytearray(media)
    flipped[at + mpeg_audio.DATA + 7] ^= 1
    with pytest.raises(ValueError, match="frame 5"):
        mpeg_audio.unwrap(bytes(flipped), found)
    assert mpeg_audio.parse(None)["frames"] == mpeg_audio.parse(b"\xff" * 50)["frames"] == 0


# header bytes, frame bytes with and without padding, Hz, samples: from the standard's tables, by hand
STREAMS = [
    ("fffb90c4", 417, 44100, 1152), ("fffb92c4", 418, 44100, 1152), ("fffda404", 576, 48000, 1152), ("ffffc004", 416, 44100, 384), ("fff380c4", 208, 22050, 576), ("ffe318c4", 72, 8000, 576), ("fff59404", 480, 24000, 1152),
]


@pytest.mark.parametrize("head, size, hz, samples", STREAMS)
def test_audio_of_other_writers(head, size, hz, samples):
    frame = bytes.fromhex(head).ljust(size, b"\x55")
    found = mpeg_audio.parse(b"junk" + frame * 7 + b"\xff" + frame * 5)
    assert (found["frames"], found["rate"], found["samples"], found["crc_frames"]) == (12, hz, 12 * samples, 0)
    assert found["micros"] == 12 * samples * 1_000_000 // hz and (found["resyncs"], found["skipped"]) == (2, 5)
    assert found["offsets"].tolist() == [4 + size * i + (i > 6) for i in range(12)] and set(found["sizes"].tolist()) == {size}


@pytest.mark.parametrize("head, size, side", [("fffb9044", 417, 32), ("fffb90c4", 417, 17), ("fff38044", 208, 17), ("fff380c4", 208, 9)])
def test_audio_bitrate_tables(head, size, side):
    raw = bytes.fromhex(head)
    toc = bytes(range(100))
    body = b"Xing" + (15).to_bytes(4) + (321).to_bytes(4) + (99_000).to_bytes(4) + toc + (50).to_bytes(4) + b"LAME3.100".ljust(21, b"\0") + (576 << 12 | 1000).to_bytes(3)
    first = raw + b"\0" * side + body
    frames = raw.ljust(size, b"\0") * 3
    if len(first) <= size:
        table = mpeg_audio.parse(first.ljust(size, b"\0") + frames)["table"]
        assert table == {"kind": "Xing", "frames": 321, "bytes": 99_000, "toc": list(toc), "delay": 576, "padding": 1000}
    vbri = b"VBRI" + bytes.fromhex("0001 0200 0064") + (99_000).to_bytes(4) + (321).to_bytes(4) + bytes.fromhex("0003 0002 0002 0010 0001 0002 0003")
    found = mpeg_audio.parse((raw + b"\0" * 32 + vbri).ljust(size, b"\0") + frames)
    assert found["table"] == {"kind": "VBRI", "bytes": 99_000, "frames": 321, "delay": 512, "toc": [2, 4, 6]} and found["frames"] == 3


def test_audio_statistics():
    assert mpeg_audio.sound(bytes([128, 129, 127, 228])) == {"peak": 100, "power": 10002 * 1000 // 4, "crossings": 2, "levels": 4}


def test_audio_frames(edge, empty):
    for r in mpeg_audio.media_digest(edge).collect():
        assert r.payload_bytes % 192 == 0 and r.payload_bytes >= r.n_bytes
    want = {r.doc_id: mpeg_audio.padded(r.text)[1] for r in edge.collect()}
    for r in mpeg_audio.media_digest(edge).collect():
        p = want[r.doc_id]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    media = mpeg_audio.store_texts(edge)
    assert all(len(r.seek_offsets) == r.frames == r.crc_ok for r in mpeg_audio.describe_media(media).collect())
    assert mpeg_audio.media_digest(empty).count() == 0


def test_language_accuracy_and_edges(spark, edge, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    own = docs.where(~byte_cnn.held_out(docs["doc_id"]))
    model = byte_cnn.train(own)
    assert model == byte_cnn.train(own.repartition(3))
    pred = byte_cnn.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(byte_cnn.held_out(F.col("doc_id"))).collect()
    assert sum(r.lang == r.lang_pred for r in pred) / len(pred) > 0.97
    assert all(0 <= r.score <= 1 for r in pred)
    for r in byte_cnn.predict(edge, model, keep=("text",)).collect():
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, r.text or "")))
    assert byte_cnn.predict(empty, model).count() == 0
    assert byte_cnn.train(empty) is None
    assert {r.lang_pred for r in byte_cnn.predict(edge, None).collect()} == {"und"}
    kept = byte_cnn.keep_known(edge, model, min_score=0.0)
    assert kept.columns == edge.columns and all(any(map(str.isalpha, r.text)) for r in kept.collect())


def test_network_equals_its_definition():
    rng = np.random.default_rng(4)
    net = byte_cnn.ByteCNN(["a", "b", "c"])
    x = rng.integers(0, 256, (3, byte_cnn.WINDOW), dtype=np.uint8)
    got = net.fused()(x)
    for row, p in zip(x.tolist(), got):
        pooled = [max(sum(float(t[j, row[i + j], f]) for j in range(w)) for i in range(len(row) - w + 1)) for w, t in net.tables.items() for f in range(byte_cnn.FILTERS)]
        z = np.tanh(pooled) @ net.out + net.bias
        assert p == pytest.approx(np.exp(z) / np.exp(z).sum(), rel=1e-4)
    again = byte_cnn.ByteCNN.load(net.dump()).fused()(x)
    assert (again == got).all()


def test_no_labels_keep_all(edge):
    assert byte_cnn.keep_known(edge, byte_cnn.train(edge.where("lang is null"))).count() == edge.count()


def test_held_out_is_crc32(spark):
    got = {r.id: r.h for r in spark.range(200).select("id", byte_cnn.held_out(F.col("id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(200)}


def brute_scan(words, found):
    places, blocks = {}, {}
    for k, t in enumerate(found):
        m = len(t.words)
        if t.exact:
            if x := [i for i in range(len(words) - m + 1) if tuple(words[i : i + m]) == t.words]:
                places[k] = x
        else:
            best = max(sum(min(n, Counter(words[i : i + m])[w]) for w, n in Counter(t.words).items()) for i in range(max(1, len(words) - m + 1)))
            if best >= t.need:
                blocks[k] = best / m
    return places, blocks


def test_license_scan_equals_brute_force():
    found = license_scan.templates(license_scan.PHRASES, license_scan.NOTICES, 0.8)
    scanner, r = license_scan.Scanner(found, Counter({"the": 9, "license": 3})), random.Random(2)
    vocabulary = sorted({w for t in found for w in t.words})[:40] + ["x", "y"]
    for _ in range(400):
        t = r.choice(found)
        words = r.choices(vocabulary, k=r.randint(0, 15)) + [x for x in t.words if r.random() < 0.9] + r.choices(vocabulary, k=r.randint(0, 8))
        places, blocks = scanner.scan(words)
        assert (places, {k: b[2] for k, b in blocks.items()}) == brute_scan(words, found)
        listed = scanner.scan_all(words)[1]
        for k, t in enumerate(found):  # every window that meets a notice is listed or overlaps one that is as good
            m, want = len(t.words), Counter(t.words)
            for i in range(0 if t.exact else max(1, len(words) - m + 1)):
                if (n := sum(min(c, Counter(words[i : i + m])[w]) for w, c in want.items())) >= t.need:
                    assert any(b[0] < i + m and i < b[1] and b[2] >= n / m for b in listed[k])


def test_license_frames(spark, edge, empty):
    rows = [(1, "Under The MIT License, under the mit license"), (2, "apache  license\nversion 2 cc-by-nc"), (3, "nothing"), (4, None)]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (8, 2, 0, 4, "mit")
    assert got[2].base_labels == "apache-2,cc-by-nc" and got[2].score == 1.0
    assert (got[3].n_base, got[3].first_word, got[3].labels, got[3].score) == (0, None, "", 0.0)
    assert got[4].n_words == 0
    assert license_scan.scan(edge).count() == edge.count() and license_scan.scan(empty).count() == 0


def test_every_license_block_is_listed(spark):
    notice = dict(license_scan.NOTICES)["bsd"]
    m = len(notice.split())
    words = "a b c " + notice + " " + notice + " d e f g " + notice.replace("source", "x") + " h"
    [r] = license_scan.scan(spark.createDataFrame([(1, words)], "doc_id long, text string")).collect()
    assert [(b.start, b.end) for b in r.blocks if b.label == "bsd"] == [(3, 3 + m), (3 + m, 3 + 2 * m), (7 + 2 * m, 7 + 3 * m)]
    assert (r.labels, r.score) == ("bsd", 1.0) and [b.containment < 1 for b in r.blocks] == [False, False, True]
