"""Benchmark items inside documents: size-partitioned MinHash containment search.

Items fall into size classes, ``2**j`` to ``2**(j + 1) - 1`` distinct shingles. A whole document of
20,000 shingles would agree with the MinHash of an item of 30 once in 700 coordinates, so documents
are partitioned as well: for each class that occurs, their shingle sequences are cut into pieces of
``2**(j + 1)``, and every two neighbours make one domain of at most ``2**(j + 2)``. An item that stands
in one place lies within a domain, and with containment 0.75 their Jaccard similarity is at least
0.176; of 64 coordinates, one agrees then but for a chance of 4 in a million. The pieces of a larger
class are minima over pairs of pieces of the smaller one, so all classes cost one pass.

Every candidate is checked by exact containment in the full shingle set of the document. Items are a
stated query set: they go through in blocks of bounded size, each sent to all tasks, so documents are
never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlife.llm.words import Powers, Words, coordinates, runs, shingles, slices, words
from loanlife.support import materialize

SIZE, PERCENT, WORDS = 64, 75, 5
BLOCK_ITEMS, BLOCK_SHINGLES = 5_000, 1_500_000

_ITEMS = "item_id long, n_item long, values array<long>"
_HITS = "doc_id long, item_id long, n_item long, n_common long, containment double"


@dataclass
class Block:
    """Items of one block, sorted shingle sets, and their coordinates by size class."""

    ids: pa.Array
    values: np.ndarray
    offsets: np.ndarray
    classes: list[tuple[int, list[np.ndarray], list[np.ndarray]]]


def item_sets(items: DataFrame, length: int = WORDS) -> DataFrame:
    """``(item_id, n_item, values)`` of all items with words; repeated rows count once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for i, j in slices(batch.column(1)):
                values, offsets = shingles(words(batch.column(1).slice(i, j - i), powers, True),
                                           length)
                yield pa.record_batch(
                    [batch.column(0).slice(i, j - i), pa.array(np.diff(offsets)),
                     pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)),
                                              pa.array(values.view(np.int64)))],
                    names=["item_id", "n_item", "values"])
    return (items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct()
            .mapInArrow(run, _ITEMS).where("n_item > 0").distinct())


def item_blocks(items: DataFrame, length: int = WORDS, size: int = SIZE) -> Iterator[Block]:
    """The items in blocks of about ``BLOCK_ITEMS`` items and ``BLOCK_SHINGLES`` shingles."""
    sets = materialize(item_sets(items, length), "items")
    count, total = sets.agg(F.count("*"), F.coalesce(F.sum("n_item"), F.lit(0))).first()
    blocks = max(-(-count // BLOCK_ITEMS), -(-total // BLOCK_SHINGLES))
    for b in range(blocks):
        got = sets.where(F.pmod(F.xxhash64("values"), F.lit(blocks)) == b).toArrow()
        if got.num_rows == 0:
            continue
        got = got.sort_by([("n_item", "ascending"), ("item_id", "ascending")]).combine_chunks()
        column = got.column("values").combine_chunks()
        values = column.flatten().to_numpy().view(np.uint64)
        offsets = np.concatenate([[0], np.cumsum(got.column("n_item").to_numpy())])
        made = coordinates(values, offsets, size)
        level = np.floor(np.log2(np.diff(offsets))).astype(int)
        classes = []
        for j in np.unique(level).tolist():
            mine = np.flatnonzero(level == j)
            order = np.argsort(made[mine], axis=0, kind="stable")
            classes.append((j, [made[mine[order[:, k]], k] for k in range(size)],
                            [mine[order[:, k]] for k in range(size)]))
        yield Block(got.column("item_id").combine_chunks(), values, offsets, classes)


def _sequences(w: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of each row in text order, and their offsets (rows + 1)."""
    each = np.where(w.counts >= length, w.counts - length + 1, 0)
    short = np.flatnonzero((w.counts > 0) & (w.counts < length))
    offsets = np.concatenate([[0], np.cumsum(each)])
    at = np.repeat(w.offsets[:-1] - offsets[:-1], each) + np.arange(offsets[-1])
    values = runs(w.hashes, length)[at] if len(at) else np.zeros(0, dtype=np.uint64)
    if len(short):  # one shingle each, the same as in the sets
        sets, ends = shingles(w, length)
        values = np.insert(values, offsets[short], sets[ends[short]])
        each[short] = 1
        offsets = np.concatenate([[0], np.cumsum(each)])
    return values, offsets


def _minima(values: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    return coordinates(values, np.append(starts, len(values)), size)


def find_in(w: Words, block: Block, length: int, size: int,
            percent: int) -> list[tuple[int, int, int]]:
    """``(row, item, common)`` for every item held by a row, in order."""
    values, offsets = _sequences(w, length)
    each = np.diff(offsets)
    if not each.any():
        return []
    step = 2 << block.classes[0][0]
    pieces = -(-each // step)
    row = np.repeat(np.arange(len(each)), pieces)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    least = _minima(values, offsets[:-1][row] + inner * step, size)
    found, level = set(), block.classes[0][0]
    for j, sorted_values, owners in block.classes:
        while level < j:  # pairs of pieces of one row
            first = np.flatnonzero(inner % 2 == 0)
            second = np.minimum(first + 1, len(row) - 1)
            second = np.where(row[second] == row[first], second, first)
            least = np.minimum(least[first], least[second])
            row, inner = row[first], inner[first] // 2
            level += 1
        after = np.minimum(np.arange(len(row)) + 1, len(row) - 1)
        after = np.where(row[after] == row, after, np.arange(len(row)))
        domain = np.minimum(least, least[after])
        for k in range(size):
            own = domain[:, k]
            left = np.searchsorted(sorted_values[k], own, side="left")
            hit = np.flatnonzero(sorted_values[k][np.minimum(left, len(sorted_values[k]) - 1)]
                                 == own)
            if len(hit):
                right = np.searchsorted(sorted_values[k], own[hit], side="right")
                for h, a, b in zip(hit.tolist(), left[hit].tolist(), right.tolist(), strict=True):
                    found.update((int(row[h]), int(i)) for i in owners[k][a:b])
    out, at, own = [], -1, None
    for r, i in sorted(found):
        if r != at:
            at, own = r, np.unique(values[offsets[r]:offsets[r + 1]])
        item = block.values[block.offsets[i]:block.offsets[i + 1]]
        place = np.minimum(np.searchsorted(own, item), len(own) - 1)
        common = int((own[place] == item).sum())
        if common * 100 >= percent * len(item):
            out.append((r, i, common))
    return out


def find_items(docs: DataFrame, items: DataFrame, percent: int = PERCENT, length: int = WORDS,
               size: int = SIZE) -> DataFrame:
    """``(doc_id, item_id, n_item, n_common, containment)``: one row for every item of which a
    document holds at least ``percent`` % of the distinct ``length``-word shingles.

    Words are split at blanks and A-Z lower-cased; a shorter text is one shingle. Items and documents
    that are null, empty or without words are in no row. Null ids stay null, repeated documents have
    rows each, repeated items count once. Other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sent = texts.sparkSession.sparkContext.broadcast
    out = texts.sparkSession.createDataFrame([], _HITS)
    for block in item_blocks(items, length, size):
        out = out.union(texts.mapInArrow(_search(sent(vars(block)), percent, length, size), _HITS))
    return out


def _search(sent, percent: int, length: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, block = Powers(), Block(**sent.value)
        sizes = np.diff(block.offsets)
        for batch in batches:
            for i, j in slices(batch.column(1)):
                part = batch.slice(i, j - i)
                hits = find_in(words(part.column(1), powers, True), block, length, size, percent)
                rows, own, common = (np.array(x, dtype=np.int64) for x in zip(*hits)) if hits \
                    else (np.zeros(0, dtype=np.int64),) * 3
                yield pa.record_batch(
                    [part.column(0).take(pa.array(rows)), block.ids.take(pa.array(own)),
                     pa.array(sizes[own].astype(np.int64)), pa.array(common),
                     pa.array(common / np.maximum(sizes[own], 1))],
                    names=["doc_id", "item_id", "n_item", "n_common", "containment"])
    return run


def without_items(docs: DataFrame, items: DataFrame, percent: int = PERCENT, length: int = WORDS,
                  size: int = SIZE) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; nothing is shuffled."""
    schema, at = docs.schema, docs.columns.index("text")
    for block in item_blocks(items, length, size):
        docs = docs.mapInArrow(_reject(docs.sparkSession.sparkContext.broadcast(vars(block)), at, percent,
                                       length, size), schema)
    return docs


def _reject(sent, at: int, percent: int, length: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, block = Powers(), Block(**sent.value)
        for batch in batches:
            for i, j in slices(batch.column(at)):
                part = batch.slice(i, j - i)
                clean = np.ones(j - i, dtype=bool)
                for r, _, _ in find_in(words(part.column(at), powers, True), block, length, size,
                                       percent):
                    clean[r] = False
                yield part.filter(pa.array(clean))
    return run
