"""Rows held as one array per partition, for fits that pass over them thousands of times.

A pass is one small job: a function of each partition's arrays, whose results are added up. Nothing is
planned, converted or shuffled again between passes. Partitions are persisted and can be rebuilt from the
table they came from.
"""

from __future__ import annotations

import gc
import operator
import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTITION_ROWS = 50_000
BLOCK = 256          # rows worked on at a time, so that what is made of them stays in a core's cache
LEAST_ROWS = 4_000   # of a partition in a fit whose passes cost more than starting a task
PIECE_ROWS = 2_000   # packed at a time, to be dealt out evenly
PRODUCT_ROWS = 1_024 # of a block where little is made of a row but matrix products
FEW_MONTHS = 16      # in a block, each a small matrix product
DIRECT = 32          # partitions whose results the driver adds up itself


def partition_count(rows: int, cores: int = 1, least: int = PARTITION_ROWS) -> int:
    """A partition per ``least`` rows up to the number of cores, then per ``PARTITION_ROWS``, rounded up
    so that every core has the same number."""
    few, many = min(cores, -(-rows // least)), -(-rows // PARTITION_ROWS)
    return max(1, few, many if many <= cores else -(-many // cores) * cores)


def held(df: DataFrame, parts: int, pack: Callable[[list[pa.RecordBatch]], object], *by: str) -> RDD:
    """``pack`` of all batches of a partition, as one element per partition."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = pickle.dumps(pack([b for b in batches if b.num_rows]), 5)
        yield pa.record_batch([pa.array([made], pa.binary())], names=["made"])
    return (df.repartition(parts, *(F.xxhash64(c) for c in by)).mapInArrow(run, "made binary").rdd
            .map(lambda row: pickle.loads(row[0])))


def _settle(one):
    """Set aside, once per worker process, the objects its libraries made: they are looked through for
    garbage after every task, which takes longer than a small pass itself."""
    if not gc.get_freeze_count():
        gc.freeze()
    return one


def add_up(results: RDD, parts: int, add: Callable = operator.add):
    """Sum of one result per partition; beyond ``DIRECT`` partitions groups are added on executors."""
    results = results.map(_settle)
    if parts > DIRECT:
        return results.treeReduce(add, depth=2)
    total = None
    for one in results.collect():
        total = one if total is None else add(total, one)
    return total


def _narrow(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """A matrix as places and values of its columns of small whole numbers, such as indicators, which
    take one byte a value, and of the others."""
    with np.errstate(invalid="ignore"):
        small = ((np.abs(x) <= 127) & (x == np.rint(x))).all(axis=0)
    return (np.flatnonzero(small), x[:, small].astype(np.int8),
            np.flatnonzero(~small), np.ascontiguousarray(x[:, ~small]))


def _wide(packed: tuple[np.ndarray, ...], start: int, end: int) -> np.ndarray:
    few_at, few, rest_at, rest = packed
    if not len(few_at):
        return rest[start:end]
    out = np.empty((len(few[start:end]), len(few_at) + len(rest_at)))
    out[:, few_at], out[:, rest_at] = few[start:end], rest[start:end]
    return out


def _blocks(own: tuple, size: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(x, t, e)`` of a partition's rows, block after block; one empty block when there are none."""
    (t, e, x), size = own, size or BLOCK
    for i in range(0, max(len(t), 1), size):
        yield _wide(x, i, i + size), t[i:i + size], e[i:i + size]


class ResidentRows:
    """``(t, e, x)`` of a design, ``x`` a matrix, in order of t within a partition."""

    def __init__(self, rows: DataFrame, p: int):
        def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (b.slice(i, PIECE_ROWS) for b in batches for i in range(0, b.num_rows, PIECE_ROWS)):
                x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
                made = pickle.dumps((b.column(0).to_numpy(zero_copy_only=False),
                                     b.column(1).to_numpy(zero_copy_only=False), _narrow(x)), 5)
                yield pa.record_batch([pa.array([len(x)], pa.int32()), pa.array([made], pa.binary())],
                                      names=["n", "made"])

        def together(rows: Iterable) -> list[tuple]:
            own = [pickle.loads(row[0]) for row in rows]
            if not own:
                return [(np.zeros(0), np.zeros(0), _narrow(np.zeros((0, p))))]
            t, e = (np.concatenate([piece[i] for piece in own]) for i in range(2))
            order = np.argsort(t, kind="stable")
            x = np.concatenate([_wide(piece[2], 0, len(piece[0])) for piece in own])
            return [(t[order], e[order], _narrow(x[order]))]

        # Rows are packed where they are; only packed pieces are stored and dealt out.
        made = rows.select("t", "e", "x").mapInArrow(pieces, "n int, made binary").persist(
            StorageLevel.MEMORY_AND_DISK)
        try:
            self.count = made.agg(F.sum("n")).first()[0] or 0
            self.parts = partition_count(self.count, rows.sparkSession.sparkContext.defaultParallelism,
                                         LEAST_ROWS)
            self.rdd = made.select("made").repartition(self.parts).rdd.mapPartitions(together).persist(
                StorageLevel.MEMORY_AND_DISK)
            self.rdd.count()
        finally:
            made.unpersist()

    def close(self) -> None:
        self.rdd.unpersist()

    def moments(self, p: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Sum of e, and of each of the first ``p`` columns the number of values, their mean and their
        squared distances from it, missing ones left out. Equal values have a distance of exactly 0."""
        def run(own: tuple) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
            events, (n, total, square) = 0.0, np.zeros((3, p))
            pivot = _wide(own[2], 0, 1)[:, :p].sum(axis=0)
            pivot[~np.isfinite(pivot)] = 0.0
            for x, t, e in _blocks(own, PRODUCT_ROWS):
                away = x[:, :p] - pivot
                seen = ~np.isnan(away)
                away[~seen] = 0.0
                events += float(np.nansum(e))
                n, total, square = (n + seen.sum(axis=0), total + away.sum(axis=0),
                                    square + np.einsum("ij,ij->j", away, away))
            own_mean = total / np.maximum(n, 1)
            return events, n, pivot + own_mean, np.maximum(square - total * own_mean, 0.0)

        def merge(a: tuple, b: tuple) -> tuple:
            n = a[1] + b[1]
            share, apart = b[1] / np.maximum(n, 1), b[2] - a[2]
            mean = np.where(b[1] > 0, np.where(a[1] > 0, a[2] + apart * share, b[2]), a[2])
            return a[0] + b[0], n, mean, a[3] + b[3] + np.where(n > 0, apart ** 2 * a[1] * share, 0.0)
        return add_up(self.rdd.map(run), self.parts, merge)

    def total(self, block: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray],
              size: int | None = None) -> np.ndarray:
        """Sum of ``block(x, t, e)`` over all rows; a partition gives it one block of rows at a time."""
        def run(own: tuple) -> np.ndarray:
            total = None
            for x, t, e in _blocks(own, size):
                one = block(x, t, e)
                total = one if total is None else total + one
            return total
        return add_up(self.rdd.map(run), self.parts)

    def month_table(self, values: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
                    ) -> tuple[np.ndarray, np.ndarray]:
        """Sums of ``values(x, t, e)``, one row each, per distinct t, ascending."""
        return self.sums(lambda x, t, e: (values(x, t, e), np.zeros(0)))[:2]

    def month_products(self, parts: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, ...]]
                       ) -> tuple[np.ndarray, np.ndarray]:
        """Sums per distinct t, ascending, of each row's ``values``, and behind them of its ``weights``, one
        after the other, times its ``z``, where ``parts(x, t, e)`` gives all three."""
        def run(own: tuple) -> tuple[np.ndarray, np.ndarray]:
            months, table = np.unique(own[0]), None
            for x, t, e in _blocks(own, PRODUCT_ROWS):
                v, weights, z = parts(x, t, e)
                m = v.shape[1]
                if table is None:
                    table = np.zeros((len(months), m + weights.shape[1] * z.shape[1]))
                if not len(t):
                    continue
                here, first = np.unique(t, return_index=True)       # rows are in order of t
                at = np.searchsorted(months, here)
                table[at, :m] += np.add.reduceat(v, first, axis=0)
                if len(here) > FEW_MONTHS:
                    each = (weights[:, :, None] * z[:, None, :]).reshape(len(t), -1)
                    table[at, m:] += np.add.reduceat(each, first, axis=0)
                    continue
                for i, start, end in zip(at, first, [*first[1:], len(t)]):
                    table[i, m:] += (weights[start:end].T @ z[start:end]).ravel()
            return months, table
        return add_up(self.rdd.map(run), self.parts, self._merged)

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
        t, v = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
        if not len(t):
            return t, v
        order = np.argsort(t, kind="stable")
        months, first = np.unique(t[order], return_index=True)
        return months, np.add.reduceat(v[order], first, axis=0)

    def sums(self, block: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``block(x, t, e)`` gives values of its rows, to be added up per distinct t, and a sum of its own,
        to be added up over all rows: months, ascending, their sums, and the whole sum."""
        def run(own: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            months, table, total = np.unique(own[0]), None, None
            for x, t, e in _blocks(own):
                v, one = block(x, t, e)
                if table is None:
                    table, total = np.zeros((len(months), v.shape[1])), np.zeros(one.shape)
                total += one
                if len(t):      # rows are in order of t
                    here, first = np.unique(t, return_index=True)
                    table[np.searchsorted(months, here)] += np.add.reduceat(v, first, axis=0)
            return months, table, total

        def merge(a, b):
            return (*ResidentRows._merged(a, b), a[2] + b[2])
        return add_up(self.rdd.map(run), self.parts, merge)
