"""Ranked lexical search by MaxScore with bounds of term pairs.

Documents are dealt into blocks. The index of a block holds, for every term of the query set, its
documents and impacts with the largest impact, and for chosen pairs of terms the list of documents that
hold both with the largest joint impact. At query time the terms of an item are taken pair by pair: a
pair adds at most the largest of its joint and its two single maxima, which is less than the sum of
the single ones where the two maxima do not meet. Pairs whose bounds together stay below the score of
the item's k-th best document so far cannot bring a document in by themselves; only documents of the
other pairs are scored, and one is dropped as soon as what is left cannot lift it. Whether a document
is in a pair's intersection list decides which bound counts for it.

Terms are compared by 64-bit hashes. Scores are 64-bit integers throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loanlife.llm.words import Powers, slices, words
from loanlife.support import materialize

TOP = 50
BLOCK_DOCS = 4096
BLOCK_TERMS = 200_000     # terms of the items, with repeats, that are looked up at a time
_NONE = np.iinfo(np.int64).max

_ITEMS = "item_id long, terms array<long>"
_POSTINGS = "doc_id long, n long, terms array<int>, counts array<int>"
_INDEX = ("ids array<long>, terms array<int>, ends array<int>, docs array<int>, parts array<int>, "
          "tops array<int>, pairs array<int>, pair_ends array<int>, pair_docs array<int>, "
          "pair_tops array<long>")
_FOUND = "entry int, doc_id long, score long"


def gaps() -> np.ndarray:
    """Bytes that separate terms: ASCII without digits and letters."""
    gap = np.zeros(256, dtype=bool)
    gap[:128] = True
    for a, b in ((48, 58), (65, 91), (97, 123)):
        gap[a:b] = False
    return gap


def item_terms(items: DataFrame) -> DataFrame:
    """``(item_id, terms)``: distinct term hashes of each item; repeated rows count once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, gap = Powers(), gaps()
        for batch in batches:
            for i, j in slices(batch.column(1)):
                w = words(batch.column(1).slice(i, j - i), powers, True, gap)
                sets = [np.unique(w.hashes[a:b]).view(np.int64)
                        for a, b in zip(w.offsets[:-1], w.offsets[1:], strict=True)]
                yield pa.record_batch([batch.column(0).slice(i, j - i),
                                       pa.array(sets, pa.list_(pa.int64()))],
                                      names=["item_id", "terms"])
    return (items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct()
            .mapInArrow(run, _ITEMS).where(F.size("terms") > 0))


def postings(docs: DataFrame, known: np.ndarray) -> DataFrame:
    """``(doc_id, n, terms, counts)``: all terms of a document counted, those of ``known`` listed.

    ``known`` are ascending hashes; ``terms`` are places in it.
    """
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, gap, own = Powers(), gaps(), sent.value
        for batch in batches:
            for i, j in slices(batch.column(1)):
                w = words(batch.column(1).slice(i, j - i), powers, True, gap)
                at = np.minimum(np.searchsorted(own, w.hashes), len(own) - 1)
                hit = own[at] == w.hashes
                row = np.repeat(np.arange(j - i), w.counts)[hit]
                keys, counts = np.unique(row * len(own) + at[hit], return_counts=True)
                ends = np.searchsorted(keys, np.arange(j - i + 1) * len(own)).astype(np.int32)
                listed = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(np.int32)))
                          for v in (keys % len(own), counts)]
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(w.counts), *listed],
                                      names=["doc_id", "n", "terms", "counts"])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, _POSTINGS)


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


def pair_up(items: list[np.ndarray], weight: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Terms of each item by weight, neighbours paired: all distinct pairs, ``-1`` for no partner, and
    the pairs of each item."""
    known, own = {}, []
    for terms in items:
        order = terms[np.lexsort((terms, weight[terms]))].tolist()
        if len(order) % 2:
            order.append(-1)
        own.append(np.array([known.setdefault((a, b), len(known))
                             for a, b in zip(order[::2], order[1::2], strict=True)], dtype=np.int64))
    return np.array(list(known), dtype=np.int64).reshape(-1, 2), own


def index(stored: DataFrame, weight: np.ndarray, pairs: np.ndarray, n_docs: int, n_terms: int,
          size: int = BLOCK_DOCS) -> DataFrame:
    """One row per block of at most ``size`` documents: term lists and pair intersection lists.

    ``parts`` is the impact of a term in a document before its weight, ``tops`` the largest of a list;
    ``pair_tops`` is the largest weighted joint impact.
    """
    sent = stored.sparkSession.sparkContext.broadcast((weight, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, pairs = sent.value
        for batch in batches:
            for i in range(0, batch.num_rows, size):
                yield _block(batch.slice(i, size), weight, pairs, n_docs, n_terms)
    return stored.where(F.size("terms") > 0).mapInArrow(run, _INDEX)


def _block(batch: pa.RecordBatch, weight: np.ndarray, pairs: np.ndarray, n_docs: int,
           n_terms: int) -> pa.RecordBatch:
    listed = batch.column(2)
    each = np.diff(listed.offsets.to_numpy())
    term, count = listed.flatten().to_numpy(), batch.column(3).flatten().to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(batch.num_rows, dtype=np.int32), each)
    length = 50 + 50 * batch.column(1).to_numpy() * n_docs // n_terms
    part = 1_000_000_000 * count // (1000 * count + 20 * length[doc])
    order = np.argsort(term, kind="stable")
    term, doc, part = term[order], doc[order], part[order]
    begins = np.flatnonzero(np.diff(np.concatenate([[-1], term])))
    terms, ends = term[begins], np.append(begins[1:], len(term))
    place = np.full(len(weight) + 1, -1)
    place[terms] = np.arange(len(terms))
    at = np.full(batch.num_rows, -1)
    which, pair_ends, pair_docs, pair_tops, total = [], [], [], [], 0
    for p in np.flatnonzero((place[pairs] >= 0).all(axis=1)).tolist():
        a, b = pairs[p]
        i, j = place[a], place[b]
        first = doc[begins[i]:ends[i]]
        second = doc[begins[j]:ends[j]]
        at[first] = np.arange(begins[i], ends[i])
        mine = at[second]
        both = np.flatnonzero(mine >= 0)
        at[first] = -1
        if len(both):
            total += len(both)
            which.append(p)
            pair_ends.append(total)
            pair_docs.append(second[both])
            pair_tops.append(int((weight[a] * part[mine[both]]
                                  + weight[b] * part[begins[j] + both]).max()))
    ids = batch.column(0)
    columns = [terms, ends, doc, part, np.maximum.reduceat(part, begins), np.array(which, dtype=int),
               np.array(pair_ends, dtype=int),
               np.concatenate(pair_docs) if pair_docs else np.zeros(0, dtype=int)]
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    return pa.record_batch(
        [one(ids), *(one(pa.array(c.astype(np.int32))) for c in columns),
         one(pa.array(np.array(pair_tops, dtype=np.int64)))],
        names=["ids", "terms", "ends", "docs", "parts", "tops", "pairs", "pair_ends", "pair_docs",
               "pair_tops"])


class Lists:
    """The lists of one index row, laid out for look-ups by term and by pair."""

    def __init__(self, row: dict, n_terms: int, n_pairs: int):
        self.ids, self.null = row["ids"]
        self.docs, self.parts = row["docs"], row["parts"].astype(np.int64)
        self.pair_docs = row["pair_docs"]
        self.top = np.zeros(n_terms + 1, dtype=np.int64)     # the last stands for "no partner"
        self.begin, self.end = np.zeros((2, n_terms + 1), dtype=np.int64)
        self.top[row["terms"]] = row["tops"]
        self.end[row["terms"]] = row["ends"]
        self.begin[row["terms"]] = np.concatenate([[0], row["ends"][:-1]])
        self.joint, self.pair_begin, self.pair_end = np.zeros((3, n_pairs), dtype=np.int64)
        self.joint[row["pairs"]] = row["pair_tops"]
        self.pair_end[row["pairs"]] = row["pair_ends"]
        self.pair_begin[row["pairs"]] = np.concatenate([[0], row["pair_ends"][:-1]])

    def term(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        return self.docs[self.begin[t]:self.end[t]], self.parts[self.begin[t]:self.end[t]]

    def pair(self, p: int) -> np.ndarray:
        return self.pair_docs[self.pair_begin[p]:self.pair_end[p]]


def _within(values: np.ndarray, ascending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each value in the list, and whether it is there."""
    if len(ascending) == 0:
        return np.zeros(len(values), dtype=int), np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)
    return at, ascending[at] == values


class Best:
    """The best documents of one item so far: scores down, then ids up, null ids last."""

    def __init__(self, k: int):
        self.k, self.bar = k, 1     # a document below the bar is of no use
        self.scores, self.ids = np.zeros((2, 0), dtype=np.int64)
        self.null = np.zeros(0, dtype=bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        null = np.concatenate([self.null, null])
        keep = np.lexsort((null, ids, -scores))[:self.k]
        self.scores, self.ids, self.null = scores[keep], ids[keep], null[keep]
        if len(keep) == self.k:
            self.bar = int(self.scores[-1])


def search_block(lists: Lists, pairs: np.ndarray, own: np.ndarray, bound: np.ndarray,
                 weight: np.ndarray, best: Best) -> int:
    """Offer one block's documents to an item; ``own`` are its pairs, ``bound`` what each adds at most.

    Returns the number of documents that were scored.
    """
    order = np.argsort(bound, kind="stable")
    own, bound = own[order], bound[order]
    upto = np.cumsum(bound)
    least = int(np.searchsorted(upto, best.bar))      # pairs before it cannot reach the bar together
    if least == len(own):
        return 0
    total = np.zeros(len(lists.ids), dtype=np.int64)
    for p in own[least:].tolist():
        for t in pairs[p].tolist():
            docs, parts = lists.term(t)
            total[docs] += weight[t] * parts
    left = int(upto[least - 1]) if least else 0
    found = np.flatnonzero((total > 0) & (total + left >= best.bar))
    scores, seen = total[found], len(found)
    for i in range(least - 1, -1, -1):
        if not bound[i]:
            break
        if not len(found):
            return seen
        p, left = int(own[i]), int(upto[i] - bound[i])
        a, b = pairs[p].tolist()
        joint = _within(found, lists.pair(p))[1]
        single = max(weight[a] * lists.top[a], weight[b] * lists.top[b])
        keep = scores + np.where(joint, lists.joint[p], single) + left >= best.bar
        found, scores = found[keep], scores[keep]
        for t in (a, b):
            docs, parts = lists.term(t)
            at, here = _within(found, docs)
            if here.any():
                scores = scores + np.where(here, weight[t] * parts[at], 0)
        keep = scores + left >= best.bar
        found, scores = found[keep], scores[keep]
    best.add(scores, lists.ids[found], lists.null[found])
    return seen


def _query(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, pairs, items = sent.value
        weight = np.append(weight, 0)
        own = np.concatenate(items)
        begins = np.cumsum([0, *map(len, items)])
        best = [Best(k) for _ in items]
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].values for name in batch.schema.names}
                row = {name: (v.fill_null(_NONE).to_numpy(), v.is_null().to_numpy(zero_copy_only=False))
                       if name == "ids" else v.to_numpy() for name, v in row.items()}
                lists = Lists(row, len(weight) - 1, len(pairs))
                single = weight * lists.top
                bound = np.maximum(single[pairs].max(axis=1), lists.joint)[own]
                for e, b in enumerate(best):
                    part = slice(begins[e], begins[e + 1])
                    search_block(lists, pairs, own[part], bound[part], weight, b)
        entry = np.repeat(np.arange(len(best), dtype=np.int32), [len(b.ids) for b in best])
        ids, null, scores = (np.concatenate([getattr(b, f) for b in best])
                             for f in ("ids", "null", "scores"))
        yield pa.record_batch([pa.array(entry), pa.array(ids, mask=null), pa.array(scores)],
                              names=["entry", "doc_id", "score"])
    return run


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of each item, ranks from 1.

    A term is a maximal run of ASCII letters and digits and of all characters beyond ASCII; A-Z are
    lower-cased. Null and empty texts have none: such documents score with nothing and such items
    have no row. Only scores above 0 count; equal ones go by ascending id, null ids last. Repeated
    documents are ranked one by one. Rows equal in item id and text are one item; different texts under
    one id are ranked apart. Other columns are ignored.

    The items are taken in blocks of about ``BLOCK_TERMS`` terms, so that what is broadcast stays
    bounded; each block reads the documents once.
    """
    spark = docs.sparkSession
    sets = materialize(item_terms(items), "items")
    count, total = sets.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    blocks = -(-total // BLOCK_TERMS)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for b in range(blocks):
        got = sets.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == b).toArrow()
        if got.num_rows:
            out = out.unionByName(_search_items(docs, got, k))
    return out


def _search_items(docs: DataFrame, items: pa.Table, k: int) -> DataFrame:
    spark = docs.sparkSession
    sets = [np.array(s, dtype=np.int64).view(np.uint64) for s in items.column("terms").to_pylist()]
    known = np.unique(np.concatenate(sets))
    stored = materialize(postings(docs, known), "postings")
    n_docs, n_terms = stored.where("n > 0").agg(F.count("*"), F.sum("n")).first()
    df = np.zeros(len(known), dtype=np.int64)
    counted = stored.select(F.explode("terms").alias("t")).groupBy("t").count().toArrow()
    df[counted.column("t").to_numpy()] = counted.column("count").to_numpy()
    weight = weights(n_docs, df)
    pairs, own = pair_up([np.searchsorted(known, s) for s in sets], weight)
    lists = materialize(index(stored, weight, pairs, n_docs, n_terms or 1), "index")
    sent = spark.sparkContext.broadcast((weight, pairs, own))
    names = spark.createDataFrame(
        list(zip(range(len(sets)), items.column("item_id").to_pylist(), strict=True)),
        "entry int, item_id long")
    best = Window.partitionBy("entry").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (lists.mapInArrow(_query(sent, k), _FOUND)
            .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .join(F.broadcast(names), "entry").select("item_id", "rank", "doc_id", "score"))
