"""The corpus pipeline on edge rows and on the smallest tables."""

import hashlib
import re

import corpus_pipeline
import pytest

from loanlife.llm.quality import score, train

SF = "/root/testdata/sf0.001"


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def _shingles(text):
    w = _words(text.lower() if text.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def run(spark):
    """Every stage's result, each applied to the one before."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.materialize(stage(spark, out[-1], SF), name))
    return out


def test_columns(run):
    assert all(d.schema.simpleString() == run[0].schema.simpleString() for d in run[:-1])
    assert run[-1].columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"]


def test_quality_stage(spark, run):
    model = train(run[0], spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in score(run[0], model).collect() if r.score >= 0.5}
    assert {r.doc_id for r in run[1].collect()} == good


def test_near_duplicate_stage(run):
    docs = {r.doc_id: _shingles(r.text) for r in run[1].collect()}
    root = {i: i for i in docs}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(docs)
    for i in ids:
        for j in ids:
            a, b = docs[i], docs[j]
            if j < i and a and b and 100 * len(a & b) >= 75 * len(a | b):
                p, q = top(i), top(j)
                root[max(p, q)] = min(p, q)
    assert sorted(r.doc_id for r in run[2].collect()) == [i for i in ids if top(i) == i]


def test_repeats_stage(run):
    before, after = ({r.doc_id: r for r in d.collect()} for d in run[2:4])
    assert before.keys() == after.keys()
    seen = {}
    for i, r in before.items():
        w = _words(r.text)
        for k in range(len(w) - 34):
            seen.setdefault(tuple(w[k:k + 35]), []).append((i, k))
    gone = {i: set() for i in before}
    for places in seen.values():
        if len(places) > 1:
            for i, k in places:
                gone[i].update(range(k, k + 35))
    for i, r in before.items():
        kept = [w for k, w in enumerate(_words(r.text)) if k not in gone[i]]
        assert _words(after[i].text) == kept
        assert after[i].n_chars == (r.n_chars if not gone[i] else len(after[i].text))


def test_contamination_stage(spark, run):
    items = [_shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {r.doc_id for r in run[3].collect() for own in [_shingles(r.text)]
            if any(100 * len(own & s) >= 75 * len(s) for s in items if s)}
    assert {r.doc_id for r in run[4].collect()} == {r.doc_id for r in run[3].collect()} - held


def test_encoding_stage(run):
    texts = {r.doc_id: r.text for r in run[4].collect()}
    got = {r.doc_id: r for r in run[5].collect()}
    assert got.keys() == texts.keys()
    for i, r in got.items():
        assert r.decoded_sha256 == hashlib.sha256(texts[i].encode()).hexdigest()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_edges_and_no_rows(spark, edges, no_rows, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, edges, SF)
    assert out.count() > 0
    if name != "encoding":
        assert out.columns == edges.columns
        for r in out.collect():     # values of further columns survive, too
            assert {r[c] for c in edges.columns if c not in ("doc_id", "text", "lang")} == {"x"}
    assert stage(spark, no_rows, SF).collect() == []
