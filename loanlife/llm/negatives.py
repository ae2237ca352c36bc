"""Hard negatives by exact inner products of Kronecker-packed vectors.

Components are whole numbers. Several candidates' components, made positive by a bias, lie in separated
fields of one wide integer; an anchor's component multiplies them all at once, and the sums over the
components are unpacked into the exact inner products. Fields are as wide as the largest possible sum
(by the norms at hand), so none runs into the next. The wide integers are whole doubles below 2**53:
all steps of a matrix product over them are exact. Vectors too large for one such field are multiplied
as Python integers.

Every pair of an anchor and a row is multiplied once: anchors meet the rows of their own label first,
which gives the positives, then all other rows, which gives the negatives. Rows stay where they are;
anchors travel to them in chunks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loanlife.support import materialize, scratch_path

SCALE = 256
PER_ANCHOR = 5
PER_POSITIVE = 5
LEAST, MOST = 80, 100         # a negative has this share of the positive's score, in percent
CHUNK_VALUES = 4_000_000      # anchor components sent to the tasks at a time
ROWS = 2048                   # rows multiplied at a time
ANCHORS = 512                 # anchors multiplied at a time
FILE_ROWS = 65_536
BITS = 53
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max

_TOP = "anchor int, positive int, vec_id long, score long"


def vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """``(vec_id, label, vector)`` of the rows that take part, components as whole numbers."""
    whole = F.transform("embedding", lambda x: _floor(x.cast("double") * scale))
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return (embeddings.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding")
            .where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
            .select("vec_id", "label", whole.alias("vector")))


def _floor(x):
    """Floor as a double of any size (the built-in one ends at 64 bits)."""
    return F.when(F.abs(x) < 2.0 ** 52, F.floor(x).cast("double")).otherwise(x)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, shorter ones filled with zeros."""
    ends = column.offsets.to_numpy()
    each = np.diff(ends)
    values = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(each), width))
    row = np.repeat(np.arange(len(each)), each)
    out[row, np.arange(len(row)) - np.repeat(ends[:-1] - ends[0], each)] = values
    return out


def products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-numbered vectors, as 64-bit integers.

    Fields hold sums of products of biased components; the bias is taken off again by the sums of
    the components. Sums of vectors longer than a field are formed as Python integers; a product
    beyond 64 bits is an error.
    """
    if not anchors.size or not rows.size:
        return np.zeros((len(anchors), len(rows)), dtype=np.int64)
    low_a, low_r = min(0.0, anchors.min()), min(0.0, rows.min())
    a, r = anchors - low_a, rows - low_r
    # Cauchy-Schwarz bounds every partial sum too, as all terms are positive.
    reach = np.sqrt((a * a).sum(axis=1).max() * (r * r).sum(axis=1).max()) * (1 + 1e-9) + 1
    bits = int(np.ceil(np.log2(reach + 1))) + 1 if np.isfinite(reach) else BITS + 1
    if bits > BITS:
        return _wide_products(anchors, rows)
    fields = BITS // bits
    width = -(-len(rows) // fields)
    packed = np.zeros((width, rows.shape[1]))
    for f in range(fields):
        part = r[f * width:(f + 1) * width]
        packed[:len(part)] += part * float(1 << (f * bits))
    sums = (a @ packed.T).astype(np.int64)
    out = np.empty((len(a), fields * width), dtype=np.int64)
    mask = np.int64((1 << bits) - 1)
    for f in range(fields):
        out[:, f * width:(f + 1) * width] = (sums >> np.int64(f * bits)) & mask
    out = out[:, :len(rows)]
    bias_a, bias_r = np.int64(low_a), np.int64(low_r)
    out += (bias_r * a.sum(axis=1).astype(np.int64))[:, None]
    out += (bias_a * r.sum(axis=1).astype(np.int64) + a.shape[1] * bias_a * bias_r)[None, :]
    return out


def _wide_products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Vectors that fit a field go the packed way among themselves, the rest as Python integers."""
    bound = np.sqrt(2.0 ** (BITS - 4) / anchors.shape[1]) / 2
    small_a, small_r = (np.abs(m).max(axis=1) < bound for m in (anchors, rows))
    out = np.empty((len(anchors), len(rows)), dtype=np.int64)
    if small_a.any() and small_r.any():
        out[np.ix_(small_a, small_r)] = products(anchors[small_a], rows[small_r])
    whole = lambda m: np.array([[int(x) for x in v] for v in m], dtype=object).reshape(m.shape)
    for mine, theirs in ((~small_a, np.ones(len(rows), dtype=bool)), (small_a, ~small_r)):
        if mine.any() and theirs.any():
            out[np.ix_(mine, theirs)] = (whole(anchors[mine]) @ whole(rows[theirs]).T).astype(np.int64)
    return out


@dataclass
class Anchors:
    """Anchors by label; the windows of scores wanted for each, ``low`` rising as rows are found."""

    row: np.ndarray
    label: np.ndarray
    matrix: np.ndarray
    low: np.ndarray      # anchors x windows; an empty window has low > high
    high: np.ndarray


class Tops:
    """The best ``k`` rows of each window: scores down, ids up."""

    def __init__(self, low: np.ndarray, k: int):
        self.k, self.low = k, low.copy()
        self.scores = np.full((*low.shape, k), _LOW)
        self.ids = np.full((*low.shape, k), _HIGH)
        self.taken = np.zeros((*low.shape, k), dtype=bool)

    def offer(self, a: np.ndarray, p: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of rows for anchors ``a``, one entry each."""
        order = np.lexsort((ids, -scores, a))
        a, scores, ids = a[order], scores[order], ids[order]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        best = place < self.k
        a, scores, ids, place = a[best], scores[best], ids[best], place[best]
        own = np.unique(a)
        at = np.searchsorted(own, a)
        both = [np.concatenate([old[own, p], np.full((len(own), self.k), fill)], axis=1) for old, fill
                in ((self.scores, _LOW), (self.ids, _HIGH), (self.taken, False))]
        for all_of, new in zip(both, (scores, ids, True), strict=True):
            all_of[at, self.k + place] = new
        keep = np.lexsort((both[1], -both[0], ~both[2]), axis=1)[:, :self.k]
        for old, all_of in zip((self.scores, self.ids, self.taken), both, strict=True):
            old[own, p] = np.take_along_axis(all_of, keep, axis=1)
        full = own[self.taken[own, p].all(axis=1)]
        self.low[full, p] = np.maximum(self.low[full, p], self.scores[full, p, -1])

    def table(self) -> pa.RecordBatch:
        a, p, _ = np.nonzero(self.taken)
        return pa.record_batch(
            [pa.array(a.astype(np.int32)), pa.array(p.astype(np.int32)), pa.array(self.ids[self.taken]),
             pa.array(self.scores[self.taken])], names=["anchor", "positive", "vec_id", "score"])


def _scan(sent, k: int, same: bool):
    """Offer all rows of a partition to all anchors of their own label, or of other labels."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(**sent.value)
        tops = Tops(anchors.low, k)
        for batch in batches:
            row, ids, label = (batch.column(i).to_numpy() for i in range(3))
            matrix = _matrix(batch.column(3), anchors.matrix.shape[1])
            order = np.argsort(label, kind="stable")
            for i in range(0, len(order), ROWS):
                part = order[i:i + ROWS]
                first, last = label[part[0]], label[part[-1]]
                begin, end = 0, len(anchors.row)
                if same:
                    begin = np.searchsorted(anchors.label, first)
                    end = np.searchsorted(anchors.label, last, side="right")
                for j in range(begin, end, ANCHORS):
                    a = np.arange(j, min(j + ANCHORS, end))
                    if not same and first == last and (anchors.label[a] == first).all():
                        continue
                    equal = anchors.label[a, None] == label[None, part]
                    if same:
                        equal &= anchors.row[a, None] != row[None, part]
                    _offer(products(anchors.matrix[a], matrix[part]), equal == same, a, ids[part],
                           anchors, tops)
        yield tops.table()
    return run


def _offer(scores: np.ndarray, allowed: np.ndarray, a: np.ndarray, ids: np.ndarray,
           anchors: Anchors, tops: Tops) -> None:
    """Pass on what lies in the windows, after raising them to the k-th best at hand."""
    for p in range(anchors.low.shape[1]):
        low, high = tops.low[a, p], anchors.high[a, p]
        inside = allowed & (scores >= low[:, None]) & (scores <= high[:, None])
        many = np.flatnonzero(inside.sum(axis=1) > 4 * tops.k)
        if len(many):
            kth = np.partition(np.where(inside[many], scores[many], _LOW), -tops.k, axis=1)[:, -tops.k]
            inside[many] &= scores[many] >= kth[:, None]
        at, col = np.nonzero(inside)
        if len(at):
            tops.offer(a[at], p, scores[at, col], ids[col])


def _best(rows: DataFrame, sent, k: int, same: bool) -> DataFrame:
    order = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "vec_id")
    return (rows.mapInArrow(_scan(sent, k, same), _TOP)
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))


def _ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def hard_negatives(embeddings: DataFrame, every: int = 100, positives: int = PER_ANCHOR,
                   negatives: int = PER_POSITIVE, least: int = LEAST, most: int = MOST,
                   scale: int = SCALE) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose ``vec_id`` is divisible by ``every``. Its positives are the ``positives``
    best other rows of its label by inner product, its negatives for each of them the ``negatives`` best
    rows of other labels with ``least`` to ``most`` percent of the positive's score (none where that is
    negative). Ties go by ascending ``vec_id``.

    Rows with a null label or vector, or a null or non-finite component, take no part; nor do rows with
    a null id. Repeated rows are rows of their own: a copy of an anchor is another anchor, and one of
    its positives. Shorter vectors count as ending in zeros. Further columns are ignored.
    """
    spark = embeddings.sparkSession
    valid = vectors(embeddings, scale).where("vec_id is not null")
    stored = materialize(valid.withColumn("row", F.monotonically_increasing_id())
                         .select("row", "vec_id", "label", "vector"), "vectors")
    count, dims, chosen = stored.agg(
        F.count("*"), F.max(F.size("vector")), F.count_if(F.col("vec_id") % every == 0)).first()
    schema = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
              "negative_score long")
    if not chosen:
        return spark.createDataFrame([], schema)
    parts = max(2 * spark.sparkContext.defaultParallelism, _ceil_div(count, FILE_ROWS))
    rows = materialize(stored.repartitionByRange(parts, "label", "row"), "rows")
    chunks = _ceil_div(chosen * max(dims, 1), CHUNK_VALUES)
    path = scratch_path(spark, "negatives")
    for chunk in range(chunks):
        mine = rows.where((F.col("vec_id") % every == 0)
                          & (F.pmod(F.xxhash64("row"), F.lit(chunks)) == chunk)).toArrow()
        if mine.num_rows:
            _chunk(rows, mine.sort_by([("label", "ascending"), ("row", "ascending")]), max(dims, 1),
                   positives, negatives, least, most).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _chunk(rows: DataFrame, mine: pa.Table, dims: int, positives: int, negatives: int, least: int,
           most: int) -> DataFrame:
    """Negatives of some anchors; at most ``positives`` rows per anchor come to the driver."""
    spark = rows.sparkSession
    mine = mine.combine_chunks()
    n = mine.num_rows
    own = dict(row=mine.column("row").to_numpy(), label=mine.column("label").to_numpy(),
               matrix=_matrix(mine.column("vector").combine_chunks(), dims))
    send = lambda low, high: spark.sparkContext.broadcast({**own, "low": low, "high": high})
    near = _best(rows, send(np.full((n, 1), _LOW), np.full((n, 1), _HIGH)), positives, True).toArrow()
    a, p, score = (near.column(c).to_numpy() for c in ("anchor", "rank", "score"))
    low, high = np.full((n, positives), 1), np.full((n, positives), 0)
    for i, j, s in zip(a.tolist(), (p - 1).tolist(), score.tolist(), strict=True):
        low[i, j], high[i, j] = _window(s, least, most)
    ids = mine.column("vec_id").to_numpy()
    known = spark.createDataFrame(pa.table({
        "anchor": near.column("anchor"), "positive": pa.array((p - 1).astype(np.int32)),
        "anchor_id": pa.array(ids[a]), "positive_id": near.column("vec_id"),
        "positive_score": near.column("score")}))
    return (_best(rows, send(low, high), negatives, False)
            .withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
            .join(known.hint("shuffle_hash"), ["anchor", "positive"])
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score",
                    "negative_score"))


def _window(score: int, least: int, most: int) -> tuple[int, int]:
    """Scores s with ``least * score <= 100 * s <= most * score``."""
    return max(_ceil_div(least * score, 100), _LOW), min(most * score // 100, _HIGH)
