"""Packing, ranked search and hard negatives against the library, brute force and defined edge cases."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import Row

from loanlife.llm import negatives, packing, ranked
from loanlife.llm.queries import QUERIES
from loanlife.llm.words import Powers, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def file():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


# ---- packing ---------------------------------------------------------------------------------

def check_pieces(rows, texts, file, capacity=1024, end=2):
    """Pieces hold the library's ids, and sequences have no gap and are not overfull."""
    library = tokenizers.Tokenizer.from_str(file)
    want = Counter()
    for own, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids + [end]
        first = len(ids) % capacity or capacity
        begins = [0, *range(first, len(ids), capacity)]
        for i, (a, b) in enumerate(zip(begins, [*begins[1:], len(ids)])):
            want[own, i, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_packing_of_all_documents(spark, file):
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = QUERIES["op11_packing"](spark, SF).collect()
    n = check_pieces(rows, texts, file)
    room = []
    for length in sorted((r.length for r in rows), reverse=True):   # plain best fit, bin by bin
        fits = [r for r in room if r >= length]
        if fits:
            room.remove(min(fits))
        room.append((min(fits) if fits else 1024) - length)
    assert n <= len(room)


def test_packing_edges(spark, edges, no_rows, file):
    texts = edges.select("doc_id", "text").collect()
    check_pieces(packing.pack(edges, file).collect(), texts, file)
    check_pieces(packing.pack(edges, file, capacity=7, end=5).collect(), texts, file, 7, 5)
    assert packing.pack(no_rows, file).collect() == []
    special = [(1, "a<|endoftext|>b  <|endoftext|>"), (2, "x" * 5000), (3, " " * 5000 + "\n\n x")]
    check_pieces(packing.pack(spark.createDataFrame(special, "doc_id long, text string"), file)
                 .collect(), special, file)


def test_counted_best_fit_is_best_fit():
    rng = random.Random(4)
    for _ in range(200):
        capacity = rng.randint(5, 40)
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(1, 60))]
        bins = []
        for n in sorted(sizes, reverse=True):
            fits = [b for b in bins if sum(b) + n <= capacity]
            (max(fits, key=sum) if fits else bins.append([]) or bins[-1]).append(n)
        got = packing.best_fit(Counter(sizes), capacity)
        want = Counter(tuple(sorted(Counter(b).items(), reverse=True)) for b in bins)
        assert sum(got.values()) == sum(want.values())
        assert sorted(packing.fill(c) for c, k in got.items() for _ in range(k)) == \
            sorted(sum(b) for b in bins)


def test_swaps_empty_bins():
    rng = random.Random(5)
    better = 0
    for _ in range(300):
        capacity = rng.randint(20, 60)
        counts = Counter(rng.randint(1, capacity) for _ in range(rng.randint(5, 80)))
        first, goal = packing.best_fit(counts, capacity), packing.least_bins(counts, capacity)
        got = packing.improve(first, capacity, goal)
        used = Counter()
        for content, bins in got.items():
            assert packing.fill(content) <= capacity
            for n, k in content:
                used[n] += k * bins
        assert used == counts
        squares = [sum(packing.fill(c) ** 2 * k for c, k in b.items()) for b in (first, got)]
        assert squares[1] >= squares[0] and goal <= sum(got.values()) <= sum(first.values())
        better += sum(got.values()) < sum(first.values())
    assert better > 0


def test_plan_of_a_billion_pieces():
    counts = {600: 10 ** 9, 424: 5 * 10 ** 8, 300: 7, 1024: 10 ** 10, 1: 3 * 10 ** 9}
    table = packing.plan(counts)
    assert len(table) < 100
    for n, c in counts.items():
        assert table[table[:, 0] == n][0, 1] == 0


# ---- ranked search ---------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = {i: i + 32 for i in range(65, 91)}


def brute_ranks(docs, items, k=50):
    terms = [(i, TERM.findall((t or "").translate(FOLD))) for i, t in docs]
    terms = [(i, t) for i, t in terms if t]
    big_n, big_l = len(terms), sum(len(t) for _, t in terms)
    df = Counter(x for _, t in terms for x in set(t))
    out = []
    for item, text in items:
        query, scored = set(TERM.findall((text or "").translate(FOLD))), []
        for i, t in terms:
            m, tf = 50 + 50 * len(t) * big_n // big_l, Counter(t)
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[x] + 1)))
                        * (10 ** 9 * tf[x] // (1000 * tf[x] + 20 * m)) for x in query if tf[x])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return Counter(out)


def found(df):
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


def test_search_edges(spark, edges, no_rows):
    from pyspark.sql import functions as F
    docs = edges.select("doc_id", "text").collect()
    asked = [(1, "ONE three five, w1 w29999!"), (1, "another"), (2, None), (3, "  -- "), (4, "zzz"),
             (None, "word 日本"), (5, "word"), (5, "word"), (6, "end")]
    items = spark.createDataFrame(asked, "item_id long, text string").withColumn("rank", F.lit("x"))
    assert found(ranked.search(edges, items)) == brute_ranks(docs, list(dict.fromkeys(asked)))
    assert found(ranked.search(edges, items, k=2)) == brute_ranks(docs, list(dict.fromkeys(asked)), 2)
    assert ranked.search(no_rows, items).collect() == []
    assert ranked.search(edges, items.where("item_id < 0")).collect() == []


def test_bounds_skip_and_stay_exact():
    """Blocks searched one after another find what full scoring finds, and score far fewer documents."""
    rng = np.random.default_rng(6)
    vocabulary = np.array([f"t{i}" for i in range(300)])
    share = 1 / np.arange(1, 301)
    texts = [" ".join(rng.choice(vocabulary, rng.integers(3, 60), p=share / share.sum()))
             for _ in range(3000)]
    asked = [(i, " ".join(rng.choice(vocabulary, 12, replace=False))) for i in range(20)]
    powers, gap = Powers(), ranked.gaps()
    sets = [np.unique(words(pa.array([t]), powers, True, gap).hashes) for _, t in asked]
    known = np.unique(np.concatenate(sets))
    w = words(pa.array(texts), powers, True, gap)
    n, total = w.counts, int(w.counts.sum())
    at = np.minimum(np.searchsorted(known, w.hashes), len(known) - 1)
    hit = known[at] == w.hashes
    row = np.repeat(np.arange(len(texts)), n)[hit]
    keys, counts = np.unique(row * len(known) + at[hit], return_counts=True)
    df = np.bincount(keys % len(known), minlength=len(known))
    weight = ranked.weights(len(texts), df)
    pairs, own = ranked.pair_up([np.searchsorted(known, s) for s in sets], weight)
    ends = np.searchsorted(keys, np.arange(len(texts) + 1) * len(known)).astype(np.int32)
    table = pa.record_batch(
        [pa.array(np.arange(len(texts))), pa.array(n),
         *(pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(np.int32)))
           for v in (keys % len(known), counts))], names=["doc_id", "n", "terms", "counts"])
    best, scored = [ranked.Best(10) for _ in own], 0
    full = np.append(weight, 0)
    for i in range(0, len(texts), 250):
        # A slice of its own, as a task would get it.
        part = pa.table([table.slice(i, 250)[c] for c in range(4)], names=table.schema.names)
        block = ranked._block(part.combine_chunks().to_batches()[0], weight, pairs, len(texts), total)
        row = {name: block.column(name)[0].values.to_numpy() for name in block.schema.names}
        row["ids"] = row["ids"], np.zeros(len(row["ids"]), dtype=bool)
        lists = ranked.Lists(row, len(weight), len(pairs))
        single = (full * lists.top)[pairs]
        bound = np.maximum(single.max(axis=1), lists.joint)
        assert (bound <= single.sum(axis=1)).all()
        for b, p in zip(best, own):
            scored += ranked.search_block(lists, pairs, p, bound[p], full, b)
    got = Counter((i, r + 1, int(d), int(s)) for i, b in enumerate(best)
                  for r, (d, s) in enumerate(zip(b.ids, b.scores)))
    assert got == brute_ranks(list(enumerate(texts)), asked, 10)
    assert scored < 0.5 * len(texts) * len(own)


# ---- hard negatives --------------------------------------------------------------------------

def test_packed_products_are_exact():
    rng = np.random.default_rng(7)
    for top in (1, 3, 200, 2 ** 12, 2 ** 22, 2 ** 27):
        a, b = (np.floor(rng.uniform(-top, top + 1, (n, 17))) for n in (5, 11))
        want = [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a]
        assert negatives.products(a, b).tolist() == want
        assert negatives.products(np.abs(a), -np.abs(b)).tolist() == \
            [[-sum(abs(int(x) * int(y)) for x, y in zip(u, v)) for v in b] for u in a]
    b[3, 2] = 2.0 ** 30
    a[:] = rng.integers(-9, 9, a.shape)
    assert negatives.products(a, b).tolist() == \
        [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a]
    with pytest.raises(OverflowError):
        negatives.products(np.full((1, 2), 1e30), np.full((1, 2), 1e30))


def brute_negatives(rows, every=100):
    kept = [(n, i, lab, [math.floor(256 * x) for x in v]) for n, (i, lab, v) in enumerate(rows)
            if i is not None and lab is not None and v is not None
            and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda u, v: sum(x * y for x, y in zip(u, v))
    out = Counter()
    for n, i, lab, v in kept:
        if i % every:
            continue
        scored = [(-dot(v, u), j, other) for m, j, other, u in kept if m != n]
        for s, j, _ in sorted(x for x in scored if x[2] == lab)[:5]:
            fit = sorted(x for x in scored if x[2] != lab and 80 * -s <= 100 * -x[0] <= 100 * -s)[:5]
            for r, (t, q, _) in enumerate(fit):
                out[i, j, r + 1, q, -s, -t] += 1
    return out


def test_hard_negatives_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 8))
    rows = []
    for i in range(900):
        v = np.float32(centres[i % 6] + rng.choice([0, 0.25, 0.5], 8)).tolist()   # many ties
        rows.append((i, int(rng.integers(0, 4)), v))
    rows += [rows[100], rows[100], (200, 3, rows[7][2]), (None, 1, rows[1][2]), (300, None, rows[1][2]),
             (400, 1, None), (500, 1, [1.0, None] * 4), (600, 2, [float("nan")] * 8),
             (700, 2, [float("inf")] + [0.0] * 7), (1000, 2, []), (1001, 2, [1.0, 2.0]),
             (1100, -3, [0.0] * 8), (1101, -3, [0.0] * 8), (1200, 99, [-5.0] * 8),
             (1300, 1, [3e4] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(4)
    from pyspark.sql import functions as F
    df = df.withColumns({c: F.lit("x") for c in ("row", "vector", "rank", "anchor")})
    want = brute_negatives(rows)
    got = lambda: Counter(tuple(r) for r in negatives.hard_negatives(df).collect())
    assert got() == want and len(want) > 50
    monkeypatch.setattr(negatives, "CHUNK_VALUES", 30)      # several chunks, small blocks
    monkeypatch.setattr(negatives, "ROWS", 16)
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    assert got() == want


def test_hard_negatives_without_rows_or_anchors(spark):
    schema = "vec_id long, label int, embedding array<float>"
    assert negatives.hard_negatives(spark.createDataFrame([], schema)).collect() == []
    assert negatives.hard_negatives(spark.createDataFrame([(1, 1, [1.0])], schema)).collect() == []
    one = spark.createDataFrame([(0, 1, [1.0])], schema)
    assert negatives.hard_negatives(one).collect() == []
    pair = spark.createDataFrame([Row(vec_id=0, label=1, embedding=[1.0]),
                                  Row(vec_id=1, label=1, embedding=[2.0]),
                                  Row(vec_id=2, label=2, embedding=[2.0])], schema)
    assert [tuple(r) for r in negatives.hard_negatives(pair).collect()] == [
        (0, 1, 1, 2, 131072, 131072)]
