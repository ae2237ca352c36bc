"""Random forests for a binary label, grown a level at a time from counts per node, feature and bin.

Feature values become bins once. At a level each partition counts, tree after tree, its rows of both classes
in the bins of the features every node draws; the counts of a tree meet in one task, which finds the best
splits, and only splits reach the driver. What travels depends on nodes and bins, not on rows, and nodes are
bounded by the depth. Rows keep their place in every tree, so a level costs one step, not a walk from the root.

The rules are the usual ones of the built-in learner: bootstrap rows (Poisson), Gini gain, features drawn
anew for every node, and leaves of one parent that predict the same class become one leaf.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlife.operators.cox import _matrix
from loanlife.operators.resident import LEAST_ROWS, held
from loanlife.operators.trees import Trees

BINS = 32
ROWS = 500_000       # of a partition at most: counts are sent once per partition
DRAWS = 2 ** 16      # chances of a row's number of draws are rounded to one in so many
DONE = 2 ** 16 - 1   # place of a row that is not drawn or has reached its leaf
MAX_DEPTH = 16
_CHANCE = np.exp(-1.0) / np.cumprod([1.0, *range(1, 12)])      # of 0, 1, 2, ... draws
_POISSON = np.searchsorted(np.cumsum(_CHANCE), (np.arange(DRAWS) + 0.5) / DRAWS).astype(np.uint8)


# ---- bins ------------------------------------------------------------------------------------

def _values(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per feature of a partition: its rows, those without a label 0 or 1, and its distinct values, null
    where there are more than ``BINS``."""
    seen: dict[int, np.ndarray | None] = {}
    n = bad = 0
    for b in batches:
        y = b.column(0).to_numpy(zero_copy_only=False)
        n, bad = n + len(y), bad + int((~np.isin(y, (0.0, 1.0))).sum())
        x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
        for f in range(x.shape[1] if len(y) else 0):
            old = seen.get(f, np.zeros(0))
            if old is not None:
                got = np.union1d(old, x[:, f])
                seen[f] = got if len(got) <= BINS else None
    yield pa.record_batch([
        pa.array(list(seen), pa.int32()), pa.array([n] * len(seen), pa.int64()),
        pa.array([bad] * len(seen), pa.int64()),
        pa.array([None if s is None else s.tolist() for s in seen.values()], pa.list_(pa.float64()))],
        names=["f", "n", "bad", "v"])


def bin_edges(given: DataFrame) -> tuple[int, list[np.ndarray]]:
    """Number of rows (y, x), and upper ends of the bins, but the last, of each element of x: every value
    where there are at most ``BINS``, else quantiles."""
    values = F.array_sort(F.array_distinct(F.flatten(F.collect_list("v"))))
    found = given.mapInArrow(_values, "f int, n bigint, bad bigint, v array<double>").groupBy("f").agg(
        F.sum("n"), F.sum("bad"), F.when(~F.max(F.col("v").isNull()) & (F.size(values) <= BINS), values)
    ).orderBy("f").collect()
    if not found:
        raise ValueError("there are no rows")
    n, bad = found[0][1:3]
    if bad:
        raise ValueError(f"{bad} rows without a label 0 or 1")
    wide = [f for f, _, _, v in found if v is None]
    ends = given.select(*(F.col("x")[f].alias(f"f{f}") for f in wide)).approxQuantile(
        [f"f{f}" for f in wide], [i / BINS for i in range(1, BINS)], 0.25 / BINS) if wide else []
    quantiles = dict(zip(wide, ends, strict=True))
    return n, [np.unique(np.array(quantiles[f], dtype=float)) if v is None else np.array(v[:-1], dtype=float)
               for f, _, _, v in found]


# ---- rows in the executors -------------------------------------------------------------------

def _binned(rows: DataFrame, p: int, edges: list[np.ndarray], parts: int) -> RDD:
    """One element per partition: label plus twice the bin, rows x features. Rows are in order of their
    values, so that draws by position are the same whenever a partition is made again."""
    def pack(batches: list[pa.RecordBatch]):
        made = [np.zeros((0, p), dtype=np.uint8)]
        for b in batches:
            x, y = _matrix(b, 1, p), b.column(0).to_numpy()
            made.append(np.column_stack([2 * np.searchsorted(edges[f], x[:, f]) + y for f in range(p)]
                                        ).astype(np.uint8))
        whole = np.concatenate(made)
        return whole[np.argsort(whole.view(f"V{p}").ravel(), kind="stable")]
    return held(rows.select("y", "x"), parts, pack)


def _draws(n: int, seed: int, tree: int, part: int) -> np.ndarray:
    """How often a tree draws each row of a partition: Poisson with mean 1."""
    return _POISSON[np.random.default_rng([seed, tree, part]).integers(0, DRAWS, n, dtype=np.uint16)]


class _Nodes:
    """The features every node of a tree's level draws, and where their bins lie in the counts: for the
    j-th drawn feature, node after node, bin after bin, class 0 before class 1."""

    def __init__(self, nodes: int, seed: int, tree: int, level: int, width: np.ndarray, chosen: int):
        order = np.random.default_rng([seed, tree, level, 1]).random((nodes, len(width)))
        drawn = np.argpartition(order, chosen - 1, axis=1)[:, :chosen] if chosen < len(width) \
            else np.tile(np.arange(len(width)), (nodes, 1))
        self.features = np.sort(drawn, axis=1).T
        self.width = width[self.features]
        self.end = self.width.cumsum(axis=1)
        self.start = self.end - self.width
        self.size = self.end[:, -1]

    def count(self, codes: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        flat, base = codes.ravel(), rows * codes.shape[1]
        out = []
        for features, start, size in zip(self.features, 2 * self.start, self.size, strict=True):
            place = start.take(at)
            place += flat.take(base + features.take(at))
            out.append(np.bincount(place, minlength=2 * size))
        whole = np.concatenate(out)
        return whole.astype(np.min_scalar_type(int(whole.max(initial=0))))

    def best(self, counts: np.ndarray, min_leaf: int) -> tuple[np.ndarray, ...]:
        """Per node its rows and ones, and its best split: feature (-1 for none), bin, gain, and the
        rows and ones on the left."""
        m, offset, gini = len(self.start[0]), 0, lambda n, a: 2 * (a / n) * (1 - a / n)
        found = np.full(m, -1), np.zeros(m, int), np.zeros(m), np.zeros(m, int), np.zeros(m, int)
        for j, size in enumerate(self.size):
            both = counts[offset:offset + 2 * size].reshape(size, 2).T
            offset += 2 * size
            bins = np.arange(self.width[j].max())
            inside = bins < self.width[j][:, None]
            places = np.where(inside, self.start[j][:, None] + bins, 0)
            zeros, ones = (np.where(inside, c[places], 0).cumsum(axis=1) for c in both)
            n, total, all_ones = zeros + ones, (zeros + ones)[:, -1:], ones[:, -1:]
            if j == 0:
                rows, hits = total[:, 0], all_ones[:, 0]
            fits = (n >= max(min_leaf, 1)) & (total - n >= max(min_leaf, 1))
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = gini(total, all_ones) - (n * gini(n, ones) + (total - n) * gini(
                    total - n, all_ones - ones)) / total
            gain = np.where(fits, gain, 0.0)
            cut = gain.argmax(axis=1)
            node = np.arange(m)
            better = np.flatnonzero(gain[node, cut] > found[2])
            for column, new in zip(found, (self.features[j], cut, gain[node, cut], n[node, cut],
                                           ones[node, cut]), strict=True):
                column[better] = new[better]
        return rows, hits, *found


def _start(trees: int, seed: int):
    def run(part: int, own: Iterable) -> Iterator:
        for codes in own:
            yield codes, np.stack([np.where(_draws(len(codes), seed, t, part) > 0, 0, DONE).astype(
                np.uint16) for t in range(trees)])
    return run


def _moved(steps):
    """Rows one level down: ``steps`` has feature, last code on the left and both children of every node of
    a level."""
    def run(own: tuple) -> tuple:
        codes, at = own
        at = at.copy()
        for t, (feature, cut, child) in enumerate(steps.value):
            rows = np.flatnonzero(at[t] != DONE)
            node = at[t][rows].astype(np.int64)
            found = codes.ravel().take(rows * codes.shape[1] + feature.take(node))
            at[t][rows] = child.take(2 * node + (found > cut.take(node)))
        return codes, at
    return run


def _counts(active: list[int], make, seed: int):
    def run(part: int, own: Iterable) -> Iterator[tuple[int, np.ndarray]]:
        for codes, at in own:
            for t, nodes in enumerate(active):
                rows = np.flatnonzero(at[t] != DONE) if nodes else ()
                if len(rows):
                    rows = np.repeat(rows, _draws(len(codes), seed, t, part)[rows])
                    yield t, make(nodes, t).count(codes, rows, at[t][rows].astype(np.int64))
    return run


def _splits(active: list[int], make, min_leaf: int):
    def run(counts: Iterable[tuple[int, np.ndarray]]) -> Iterator[tuple[int, tuple]]:
        total: dict[int, np.ndarray] = {}
        for t, c in counts:
            total[t] = total[t] + c if t in total else c.astype(np.int64)
        for t, c in total.items():
            yield t, make(active[t], t).best(c, min_leaf)
    return run


# ---- trees -----------------------------------------------------------------------------------

class _Grown:
    """A tree's nodes so far, level after level, and those of the last level that may be split."""

    def __init__(self, rows: int, ones: int):
        self.levels = [0, 1]
        self.feature, self.left = np.array([-1]), np.array([-1])
        self.cut, self.gain = np.zeros(1, int), np.zeros(1)
        self.rows, self.ones = np.array([rows]), np.array([ones])
        self.open = np.array([0])

    def grow(self, found: tuple[np.ndarray, ...], last: bool, min_leaf: int) -> tuple[np.ndarray, ...]:
        """Splits taken in; the step that rows of the level make, as ``_moved`` wants it."""
        rows, hits, feature, cut, gain, low, low_ones = found
        s = np.flatnonzero(feature >= 0)
        parent, a = self.open[s], len(self.rows)
        self.feature[parent], self.cut[parent], self.gain[parent] = feature[s], cut[s], gain[s]
        self.left[parent] = a + 2 * np.arange(len(s))
        pair = lambda x, y: np.column_stack([x, y]).ravel()
        n, ones = pair(low[s], rows[s] - low[s]), pair(low_ones[s], hits[s] - low_ones[s])
        for name, new in (("feature", -1), ("left", -1), ("cut", 0), ("gain", 0.0)):
            old = getattr(self, name)
            setattr(self, name, np.append(old, np.full(2 * len(s), new, dtype=old.dtype)))
        self.rows, self.ones = np.append(self.rows, n), np.append(self.ones, ones)
        self.levels.append(len(self.rows))
        able = np.flatnonzero((n >= 2 * max(min_leaf, 1)) & (ones > 0) & (ones < n) & (not last))
        self.open = a + able
        place = np.full(2 * len(s), DONE, dtype=np.uint16)
        place[able] = np.arange(len(able))
        child = np.full((len(feature), 2), DONE, dtype=np.uint16)
        child[s] = place.reshape(-1, 2)
        return np.maximum(feature, 0), (2 * cut + 1).astype(np.uint8), child.ravel()

    def merged(self) -> np.ndarray:
        """Nodes that are kept once leaves of one parent that predict the same class are one leaf."""
        likely = 2 * self.ones > self.rows
        for a, b in reversed(list(zip(self.levels, self.levels[1:]))):
            node = a + np.flatnonzero(self.left[a:b] >= 0)
            left = self.left[node]
            same = (self.left[left] < 0) & (self.left[left + 1] < 0) & (likely[left] == likely[left + 1])
            self.left[node[same]] = -1
        keep = np.zeros(len(self.rows), dtype=bool)
        keep[0] = True
        for a, b in zip(self.levels, self.levels[1:]):
            left = self.left[a:b][keep[a:b] & (self.left[a:b] >= 0)]
            keep[left] = keep[left + 1] = True
        return np.flatnonzero(keep)


def _assembled(grown: list[_Grown], edges: list[np.ndarray]) -> Trees:
    parts, start = [], 0
    table = np.zeros((len(edges), BINS))
    for f, e in enumerate(edges):
        table[f, :len(e)] = e
    for t, g in enumerate(grown):
        kept = g.merged()
        place = np.full(len(g.rows) + 1, -1)
        place[kept] = start + np.arange(len(kept))
        left = g.left[kept]
        inner = left >= 0
        value = g.ones[kept] / np.maximum(g.rows[kept], 1) / len(grown)
        parts.append((np.full(len(kept), t), np.where(inner, g.feature[kept], -1),
                      np.where(inner, table[g.feature[kept], g.cut[kept]], 0.0),
                      np.where(inner, place[left], -1), np.where(inner, place[left + 1], -1),
                      np.where(inner, 0.0, value), np.where(inner, g.gain[kept] * g.rows[kept], 0.0)))
        start += len(kept)
    *columns, gain = (np.concatenate(c) for c in zip(*parts))
    return Trees(*columns, gain=gain)


def grow_forest(df: DataFrame, label: str, features: str, trees: int, depth: int, min_leaf: int,
                seed: int, chosen: int | None = None) -> Trees:
    """A forest over a vector column; labels are 0 and 1. ``chosen`` features are drawn for a node, by
    default the square root of their number, rounded up."""
    if not 0 <= depth <= MAX_DEPTH:
        raise ValueError(f"the depth must be 0 to {MAX_DEPTH}")
    given = df.select(F.col(label).cast("double").alias("y"), vector_to_array(features).alias("x"))
    n, edges = bin_edges(given)
    p, sc = len(edges), df.sparkSession.sparkContext
    chosen = min(p, chosen or int(np.ceil(np.sqrt(p))))
    width = np.array([len(e) + 1 for e in edges])
    cores = sc.defaultParallelism
    parts = min(cores, -(-n // LEAST_ROWS)) * -(-n // (ROWS * cores))
    state = _binned(given, p, edges, parts).mapPartitionsWithIndex(_start(trees, seed)).persist(StorageLevel.MEMORY_AND_DISK)
    before, grown, active, sent = None, None, [1] * trees, []
    try:
        for level in range(max(depth, 1)):
            make = lambda nodes, t, level=level: _Nodes(nodes, seed, t, level, width, chosen)
            tasks = min(trees, parts)
            found = dict(state.mapPartitionsWithIndex(_counts(active, make, seed)).partitionBy(
                tasks, lambda t, tasks=tasks: t % tasks).mapPartitions(
                _splits(active, make, min_leaf)).collect())
            if before is not None:
                before.unpersist()
            if level == 0:
                grown = [_Grown(int(found[t][0][0]), int(found[t][1][0])) if t in found else
                         _Grown(0, 0) for t in range(trees)]
            if depth == 0:
                break
            nothing = np.zeros(0, int), np.zeros(0, np.uint8), np.zeros(0, np.uint16)
            steps = [g.grow(found[t], level + 1 == depth, min_leaf) if t in found else nothing
                     for t, g in enumerate(grown)]
            active = [len(g.open) if t in found else 0 for t, g in enumerate(grown)]
            if not any(active):
                break
            sent.append(sc.broadcast(steps))
            before, state = state, state.map(_moved(sent[-1])).persist(StorageLevel.MEMORY_AND_DISK)
    finally:
        for held_rows in (before, state):
            if held_rows is not None:
                held_rows.unpersist()
        for s in sent:
            s.destroy()
    return _assembled(grown, edges)
