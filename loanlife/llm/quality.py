"""Quality scores from a generalised additive model with pairwise interactions.

Text features are cut into bins. Shallow trees on one feature at a time, learnt in cycles with a
small step, add up to one lookup table per feature; then trees on two features add tables for the
pairs that explain most of what is left. A score is the sum of the looked-up values of a row's bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlife.llm.words import Powers, shingles, slices, words

TRAIN_ROWS = 20_000
FEATURES = ("log_words", "word_bytes", "long_words", "short_words", "upper", "digits", "stops",
            "commas", "bangs", "bars", "symbols", "line_ends", "beyond_ascii", "distinct_words",
            "distinct_shingles", "words_in_sentence", "one_byte_words", "capital_words")


def _class(chars: str) -> np.ndarray:
    table = np.zeros(256, dtype=np.int64)
    table[np.frombuffer(chars.encode(), dtype=np.uint8)] = 1
    return table


_BYTES = {"upper": _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digits": _class("0123456789"),
          "stops": _class(".?"), "commas": _class(",;:"), "bangs": _class("!"), "bars": _class("|"),
          "symbols": _class("#$%&*@^~<>{}[]=+_\\/"), "line_ends": _class("\n"),
          "beyond_ascii": (np.arange(256) >= 128).astype(np.int64)}


def text_features(column: pa.Array, powers: Powers) -> np.ndarray:
    """One row of ``FEATURES`` per text; null and empty texts are all zeros."""
    w = words(column, powers)
    counts = w.counts
    rows, n = len(counts), np.maximum(counts, 1)
    size = (w.ends - w.starts).astype(np.int64)
    cells = pa.compute.fill_null(pa.compute.binary_length(column.cast(pa.large_binary())), 0)
    length = cells.to_numpy().astype(np.int64)
    begins = np.concatenate([[0], np.cumsum(length + 1)])

    def per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        return total[at[1:]] - total[at[:-1]]
    out = dict.fromkeys(FEATURES)
    out["log_words"] = np.log1p(counts)
    out["word_bytes"] = per_text(size, w.offsets) / n
    out["long_words"] = per_text(size > 9, w.offsets) / n
    out["short_words"] = per_text(size <= 3, w.offsets) / n
    out["one_byte_words"] = per_text(size == 1, w.offsets) / n
    out["capital_words"] = per_text(_BYTES["upper"][w.data[w.starts]], w.offsets) / n
    for name, table in _BYTES.items():
        out[name] = per_text(table[w.data], begins) / np.maximum(length, 1)
    out["words_in_sentence"] = np.log1p(counts / (1 + out["stops"] * length))
    distinct = np.zeros(rows)
    for i in np.flatnonzero(counts):
        distinct[i] = len(np.unique(w.hashes[w.offsets[i]:w.offsets[i + 1]]))
    # Longer texts repeat more words by themselves; the power takes most of that out.
    out["distinct_words"] = distinct / n ** 0.85
    out["distinct_shingles"] = np.diff(shingles(w)[1]) / np.maximum(counts - 4, 1)
    return np.column_stack([out[name].astype(np.float64) for name in FEATURES])


@dataclass
class AdditiveModel:
    """Bin edges, one table per feature and one per chosen pair of features."""

    edges: list = field(default_factory=list)
    intercept: float = 0.0
    tables: list = field(default_factory=list)
    pairs: list = field(default_factory=list)
    pair_tables: list = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, i], side="right")
                                for i, e in enumerate(self.edges)]) if self.edges \
            else np.zeros((len(x), 0), dtype=np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.intercept)
        for i, t in enumerate(self.tables):
            total += t[b[:, i]]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            total += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-total))


def _gain(g: np.ndarray, h: np.ndarray, penalty: float) -> np.ndarray:
    return g * g / (h + penalty)


def _cut(g: np.ndarray, h: np.ndarray, least: float, penalty: float) -> tuple[float, int]:
    """Best split of ordered bins: gain and the first bin of the right side."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gains = _gain(gl, hl, penalty) + _gain(gr, hr, penalty) - _gain(g.sum(), h.sum(), penalty)
    gains[(hl < least) | (hr < least)] = 0
    at = int(np.argmax(gains))
    return float(gains[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, least: float, penalty: float) -> np.ndarray:
    """Leaf values per bin of a tree with up to three splits on one feature."""
    leaves = [(0, len(g))]
    for _ in range(3):
        best = max(((*_cut(g[a:b], h[a:b], least, penalty), k)
                    for k, (a, b) in enumerate(leaves)), default=(0.0, 0, 0))
        if best[0] <= 1e-9:
            break
        a, b = leaves.pop(best[2])
        leaves += [(a, a + best[1]), (a + best[1], b)]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + penalty)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, least: float,
               penalty: float) -> tuple[float, np.ndarray]:
    """A split on the first feature and one on the second in either half: gain and values."""
    ga, ha = np.cumsum(g, axis=0), np.cumsum(h, axis=0)
    best, out = 0.0, np.zeros_like(g)
    whole = _gain(g.sum(), h.sum(), penalty)
    for i in range(1, g.shape[0]):
        halves = ((ga[i - 1], ha[i - 1], slice(0, i)),
                  (ga[-1] - ga[i - 1], ha[-1] - ha[i - 1], slice(i, None)))
        if min(x[1].sum() for x in halves) < least:
            continue
        total, cuts = -whole, []
        for gs, hs, _ in halves:
            more, at = _cut(gs, hs, least, penalty)
            total += more + _gain(gs.sum(), hs.sum(), penalty)
            cuts.append(at if more > 0 else 0)
        if total > best:
            best, out = total, np.zeros_like(g)
            for (gs, hs, rows), at in zip(halves, cuts, strict=True):
                for cols in (slice(0, at), slice(at, None)):
                    if gs[cols].size:
                        out[rows, cols] = gs[cols].sum() / (hs[cols].sum() + penalty)
    return best, out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, rounds: int = 120, rate: float = 0.15,
        pairs: int = 6, pair_rounds: int = 40, least: float = 4.0,
        penalty: float = 1.0) -> AdditiveModel:
    """Fit by cyclic boosting of the logistic loss. No rows: a model that always gives one half."""
    if len(x) == 0:
        return AdditiveModel()
    model = AdditiveModel(edges=[np.unique(np.quantile(x[:, i], np.linspace(0, 1, bins + 1)[1:-1]))
                                 for i in range(x.shape[1])])
    b = model.bins(x)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model.intercept = float(np.log(share / (1 - share)))
    total = np.full(len(y), model.intercept)
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(s) for s in sizes]

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)
    for _ in range(rounds):
        for i, size in enumerate(sizes):
            g, h = slopes()
            step = rate * _tree(np.bincount(b[:, i], g, size), np.bincount(b[:, i], h, size),
                                least, penalty)
            model.tables[i] += step
            total += step[b[:, i]]

    def cells(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(b[:, i] * sizes[j] + b[:, j], v, sizes[i] * sizes[j]).reshape(
            sizes[i], sizes[j])
    g, h = slopes()
    ranked = sorted(((-_pair_tree(cells(i, j, g), cells(i, j, h), least, penalty)[0], i, j)
                     for i, j in combinations(range(len(sizes)), 2)))
    model.pairs = [(i, j) for gain, i, j in ranked[:pairs] if gain < 0]
    model.pair_tables = [np.zeros((sizes[i], sizes[j])) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for k, (i, j) in enumerate(model.pairs):
            g, h = slopes()
            step = rate * _pair_tree(cells(i, j, g), cells(i, j, h), least, penalty)[1]
            model.pair_tables[k] += step
            total += step[b[:, i], b[:, j]]
    return model


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Rows whose labels are never learnt from; false for a null id."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS, **options) -> AdditiveModel:
    """Learn ``labels.quality`` from at most ``max_rows`` labelled rows that are not held out.

    The sample is bounded by design: the ids with the least hash are taken. Their features, not
    their texts, reach the driver. Labels that are null or of unknown documents are ignored.
    """
    sample = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
              .select(F.col("doc_id").cast("long").alias("doc_id"),
                      F.col("quality").cast("int").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for i, j in slices(batch.column(2)):
                x = text_features(batch.column(2).slice(i, j - i), powers)
                yield pa.record_batch(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i),
                     pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1])
                     .cast(pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])
    got = (rows.mapInArrow(run, "doc_id long, quality int, x array<double>").distinct()
           .orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "x").limit(max_rows)
           .orderBy("doc_id", "quality", "x").toArrow())
    x = np.array(got.column("x").to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return fit(x, (got.column("quality").to_numpy() == 1).astype(np.float64), **options)


def score(docs: DataFrame, model: AdditiveModel, keep: list[str] | None = None, out: str = "score",
          verdict: str = "predicted") -> DataFrame:
    """``docs``, or its columns ``keep``, with the score (0 to 1) of every whole text as ``out`` and
    ``verdict`` (score >= 0.5).

    Null and empty texts get the score of a text without words. A column of ``docs`` that is already
    called so is an error; ``out`` and ``verdict`` may be given other names.
    """
    names = keep or docs.columns
    if {out.lower(), verdict.lower()} & {n.lower() for n in names}:
        raise ValueError(f"'{out}' or '{verdict}' is a column already")
    at = docs.columns.index("text")
    places = [docs.columns.index(n) for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for i, j in slices(batch.column(at)):
                part = batch.slice(i, j - i)
                p = model.score(text_features(part.column(at), powers))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in places), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                    names=[*names, out, verdict])
    schema = T.StructType([*(docs.schema[n] for n in names), T.StructField(out, T.DoubleType()),
                           T.StructField(verdict, T.IntegerType())])
    return docs.mapInArrow(run, schema)


def score_rows(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs(doc_id, text)``."""
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
