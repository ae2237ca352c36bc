"""Registered queries against their SQL, or, where SQL cannot say it, against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from compare import compare, connect

from loanlife.llm import licenses, syncmers, wordpieces
from loanlife.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.fixture(scope="module")
def texts(con):
    return {i: t or "" for i, t in con.execute("SELECT doc_id, text FROM documents").fetchall()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, ORACLES[name]) == []


def test_pieces_match_the_library(spark, texts):
    lib = sentencepiece.SentencePieceProcessor(
        model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in QUERIES["op5_pieces"](spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        ids = lib.encode(text)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
        spans = [(p.begin, p.end) for p in lib.encode(text, return_type="proto").pieces]
        assert got[i].spans_crc32 == zlib.crc32(np.array(spans, "<i8").reshape(-1, 2).tobytes())


def test_wordpieces_match_direct_search(spark, texts):
    begin, go_on = map(set, wordpieces.vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    for r in QUERIES["op8_wordpieces"](spark, SF).collect():
        words = [w for w in texts[r.doc_id].translate(wordpieces._BLANKS).split(" ") if w]
        found = [wordpieces.greedy(w, begin, go_on) for w in words]
        assert r.n_words == len(words)
        assert r.n_tokens == sum(len(f) if f else 1 for f in found)
        assert r.n_unknown == sum(f is None for f in found)


def test_syncmers_match_direct_computation(spark, texts):
    order = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in QUERIES["op4_syncmers"](spark, SF).collect()}
    assert got.keys() == texts.keys()

    def mark(text):
        return syncmers._hex(syncmers._sketch(
            syncmers.closed_syncmers(syncmers._points(text))[1], syncmers.SIZE))
    for i, after in zip(order, order[1:] + order[:1], strict=True):
        text, other, r = texts[i], texts[after], got[i]
        k = len(text) // 3
        edited = text[:len(text) - k] + other[:k]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == (mark(text), mark(edited))
        assert r.near_edited == syncmers.fingerprint_likeness(mark(text), mark(edited))
        assert r.near_next == syncmers.fingerprint_likeness(mark(text), mark(other))


def plain_syncmers(text, k=syncmers.K, s=syncmers.S):
    """(position, hash) by looking at every s-mer of every k-mer."""
    points = syncmers._points(text)
    gram = lambda i, n: int(syncmers._grams(points[i:i + n], n)[0])
    if len(points) < k:
        return [(0, gram(0, len(points)))] if len(points) else []
    out = []
    for i in range(len(points) - k + 1):
        inner = [gram(j, s) for j in range(i, i + k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((i, gram(i, k)))
    return out


def plain_alignment(a, b):
    def once(found):
        halves = [h >> 32 for _, h in found]
        return {h >> 32: at for at, h in found if halves.count(h >> 32) == 1}
    x, y = once(a), once(b)
    moves = Counter(y[h] - x[h] for h in x.keys() & y.keys())
    if not moves:
        return len(x), None, 0
    most = max(moves.values())
    return len(x), min(m for m, n in moves.items() if n == most), most


def test_syncmers_and_positions_match_plain_search(spark):
    rng = random.Random(4)
    texts = {i: "".join(rng.choice("abc é") for _ in range(rng.choice([0, 3, 7, 8, 9, 40, 160])))
             for i in range(40)}
    texts[40] = "shift " * 3 + texts[39] + " a passage that moved by some places"
    texts[39] = texts[39] + " a passage that moved by some places"
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()],
                                 "doc_id int, text string, n_placed string")
    got = {r.doc_id: r for r in syncmers.fingerprints(docs).collect()}
    order = sorted(texts, reverse=True)
    for i, after in zip(order, order[1:] + order[:1], strict=True):
        text, other, r = texts[i], texts[after], got[i]
        k = len(text) // 3
        own, edited, following = map(plain_syncmers, (text, text[:len(text) - k] + other[:k], other))
        at, hashes = syncmers.closed_syncmers(syncmers._points(text))
        assert list(zip(at.tolist(), hashes.tolist())) == own
        low = sorted({h >> 32 for _, h in own})[:syncmers.SIZE]
        assert r.fingerprint == "".join(f"{h:08x}" for h in low)
        assert (r.n_placed, r.edited_offset, r.edited_matched) == plain_alignment(own, edited)
        assert (r.n_placed, r.next_offset, r.next_matched) == plain_alignment(own, following)
    assert got[40].next_offset < 0 < got[40].next_matched


def test_licenses_match_plain_search(spark, texts):
    lines = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0",
             "Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
             "This work is licensed under the GNU General Public License, version 3.":
             "GPL-3.0-only"}
    want = sorted((i, name) for i, t in texts.items() for line, name in lines.items()
                  for _ in range(t.count(line)))
    got = QUERIES["op2_licenses"](spark, SF).collect()
    assert sorted((r.doc_id, r.license) for r in got) == want
    for r in got:
        known = [licenses.normalise(f) for x in r.identifiers for f in licenses.SENTENCES[x]]
        assert licenses.normalise(texts[r.doc_id][r.begin:r.end]) in known


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = QUERIES["op9_quality"](spark, sf).join(labels, "doc_id").collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.9
