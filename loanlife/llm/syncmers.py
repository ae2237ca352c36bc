"""Document fingerprints from closed syncmers.

A k-mer of code points is chosen when the least hash of its s-mers is that of the first or the last
one. The choice depends on the k-mer alone, so equal passages give equal anchors wherever they stand
and whatever surrounds them. A fingerprint holds the least ``size`` distinct anchor hashes of a text,
each as eight hexadecimal digits, ascending; texts shorter than k are their own only anchor.

Two texts are matched by position, too: anchors that stand once in each give an offset, and the offset that
most of them share tells by how much a common passage moved and how many anchors agree with that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlife.llm.words import mix
from loanlife.operators.ranks import bucket_edges, with_bucket

K, S, SIZE = 8, 3, 128
RANGES = 10_000
_HEX = np.frombuffer(b"0123456789abcdef", dtype=np.uint8)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _grams(points: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` consecutive code points."""
    out = points[:len(points) - n + 1].astype(np.uint64)
    for i in range(1, n):
        out = out * np.uint64(0x100000001B3) + points[i:len(points) - n + 1 + i]
    return mix(out ^ np.uint64(n))


def closed_syncmers(points: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the chosen k-mers and their hashes."""
    n = len(points)
    if n == 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    if n < k:
        return np.zeros(1, dtype=np.int64), _grams(points, n)
    small = _grams(points, s)
    span = k - s + 1
    least, width = small, 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:len(least) - (span - width)], least[span - width:])
    at = np.flatnonzero((small[:n - k + 1] == least) | (small[span - 1:] == least))
    return at, _grams(points, k)[at]


def _sketch(hashes: np.ndarray, size: int) -> np.ndarray:
    """The least ``size`` distinct high halves."""
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    if len(high) > 8 * size:  # most hashes are far above the limit; all that could count stay
        limit = np.partition(high, 4 * size)[4 * size]
        some = np.unique(high[high <= limit])
        if len(some) >= size:
            return some[:size]
    return np.unique(high)[:size]


def _hex(sketch: np.ndarray) -> str:
    digits = sketch.astype(">u4").view(np.uint8)
    return np.column_stack([_HEX[digits >> 4], _HEX[digits & 15]]).tobytes().decode()


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated share of common anchors among all: of the least ``size`` of both sketches together,
    the part that both have. Two empty sketches are alike."""
    both = np.union1d(a, b)[:size]
    if len(both) == 0:
        return 1.0
    shared = np.isin(both, a, assume_unique=True) & np.isin(both, b, assume_unique=True)
    return float(shared.sum() / len(both))


def fingerprint_likeness(a: str, b: str, size: int = SIZE) -> float:
    """Likeness of two fingerprints as written."""
    x, y = (np.frombuffer(bytes.fromhex(t), dtype=">u4").astype(np.uint32) for t in (a, b))
    return likeness(x, y, size)


def placed(at: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Anchors that stand once in a text, ascending: the high half of the hash, then the position."""
    both = np.sort((hashes & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64))
    again = (both[1:] >> np.uint64(32)) == (both[:-1] >> np.uint64(32))
    once = np.ones(len(both), dtype=bool)
    once[1:] &= ~again
    once[:-1] &= ~again
    return both[once]


def aligned(a: np.ndarray, b: np.ndarray) -> tuple[int | None, int]:
    """The commonest offset from a's to b's positions of common ``placed`` anchors, and how many have
    it; of equally common ones the least. No common anchor: None and 0."""
    if not len(a) or not len(b):
        return None, 0
    half, low = np.uint64(32), np.uint64(0xFFFFFFFF)
    left = a >> half
    at = np.minimum(np.searchsorted(left, b >> half), len(a) - 1)
    same = left[at] == b >> half
    if not same.any():
        return None, 0
    moves, n = np.unique((b[same] & low).astype(np.int64) - (a[at[same]] & low).astype(np.int64),
                         return_counts=True)
    best = int(np.argmax(n))
    return int(moves[best]), int(n[best])


def anchors(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """``(doc_id, position, anchor)`` of every chosen k-mer, for matching by position."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at, hashes = closed_syncmers(_points(batch.column(1)[i].as_py() or ""), k, s)
                yield pa.record_batch(
                    [batch.column(0).take(pa.array(np.full(len(at), i))), pa.array(at),
                     pa.array(hashes.view(np.int64))], names=["doc_id", "position", "anchor"])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, position long, anchor long")


def _neighbours(docs: DataFrame, ranges: int) -> DataFrame:
    """Rows dealt by ranges of ids, each range followed by a copy of the next lower range's first
    row: ``range, doc_id, text, extra``, sorted within tasks.

    Only the bounds (at most ``ranges``) and the greatest id of each range reach the driver.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    edges = bucket_edges(texts, "doc_id", ranges)
    # Nulls come after all ids in descending order.
    known = with_bucket(texts.withColumn("place", F.coalesce("doc_id", F.lit(0))), "place",
                        sorted({float(e) for e in edges}), "range")
    dealt = known.select("doc_id", "text", F.when(F.col("doc_id").isNull(), -1)
                         .otherwise(F.col("range")).cast("int").alias("range"))
    heads = sorted((r["range"], r["head"]) for r in dealt.groupBy("range").agg(
        F.max("doc_id").alias("head")).collect())
    # The head of a range follows the last row of the next higher one; the highest follows the
    # lowest.
    session = texts.sparkSession
    after = [(heads[i][1], heads[(i + 1) % len(heads)][0]) for i in range(len(heads))]
    links = session.createDataFrame(after, "head long, goes int")
    extra = (texts.join(F.broadcast(links), F.col("doc_id").eqNullSafe(F.col("head")))
             .select(F.col("goes").alias("range"), "doc_id", "text", F.lit(True).alias("extra")))
    rows = dealt.select("range", "doc_id", "text", F.lit(False).alias("extra")).union(extra)
    return (rows.repartition("range")
            .sortWithinPartitions(F.col("range"), F.col("extra"), F.col("doc_id").desc_nulls_last(),
                                  F.col("text")))


def fingerprints(docs: DataFrame, k: int = K, s: int = S, size: int = SIZE,
                 ranges: int | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text)`` with its fingerprint and that of its edited text.

    The next document is the one with the next lower id, after the lowest the highest; of rows that
    repeat an id, by their text. The edited text has its last floor(n_chars / 3) code points replaced
    by the first as many, or all, of the next document's. Columns: ``doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``, the last two the
    likeness to the edited text's and to the next document's fingerprint; then ``n_placed``, the
    anchors that stand once in the text, and ``edited_offset, edited_matched, next_offset,
    next_matched``: the offset that most of them have in the edited text or the next document, and how
    many have it (null and 0 where none is common). Null texts count as empty; an empty text has an empty
    fingerprint, equal to other empty ones. A single document is its own next. Other columns are
    ignored.
    """
    if ranges is None:  # several for each task, so that tasks get about equal shares
        ranges = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(max(ranges, 2), RANGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                 "near_edited", "near_next", "n_placed", "edited_offset", "edited_matched",
                 "next_offset", "next_matched"]
        last, out, weight = None, [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                part, doc_id = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                extra = batch.column(3)[i].as_py()
                points = _points(batch.column(2)[i].as_py())
                if extra and (last is None or last[0] != part or last[3]):
                    continue  # a further row of the same head
                at, hashes = closed_syncmers(points, k, s)
                own, once = _sketch(hashes, size), placed(at, hashes)
                if last is not None and last[0] == part and not last[3]:
                    out.append(_row(last, points, own, once))
                    weight += len(points)
                    if len(out) >= 500 or weight > 1 << 22:
                        yield _batch(out, names)
                        out, weight = [], 0
                last = (part, doc_id, points, extra, at, hashes, own, once)
        if out:
            yield _batch(out, names)

    def _row(row, following, sketch, next_once):
        _, doc_id, points, _, own_at, own_hashes, own, once = row
        n = len(points)
        keep = n - n // 3
        edited = np.concatenate([points[:keep], following[:n // 3]])
        if n // 3 and min(len(edited), n) >= k:
            # Only k-mers that reach the new part, or the old text, need to be looked at again.
            begin = max(keep - k + 1, 0)
            at, hashes = closed_syncmers(edited[begin:], k, s) if len(edited) > keep \
                else (own_at[:0], own_hashes[:0])
            old = own_at <= keep - k
            at = np.concatenate([own_at[old], at + begin])
            hashes = np.concatenate([own_hashes[old], hashes])
        else:
            at, hashes = closed_syncmers(edited, k, s)
        edited_sketch = _sketch(hashes, size)
        text = edited.tobytes().decode("utf-32-le").encode()
        return (doc_id, n, hashlib.sha256(text).hexdigest(), _hex(own), _hex(edited_sketch),
                likeness(own, edited_sketch, size), likeness(own, sketch, size), len(once),
                *aligned(once, placed(at, hashes)), *aligned(once, next_once))

    def _batch(rows, names):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(),
                 pa.float64(), *[pa.int64()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds,
                                                                         strict=True)], names=names)
    return _neighbours(docs, ranges).select("range", "doc_id", "text", "extra").mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string,"
             " edited_fingerprint string, near_edited double, near_next double, n_placed long,"
             " edited_offset long, edited_matched long, next_offset long, next_matched long")
