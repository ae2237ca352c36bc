"""Connected components of an edge table by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlife.support import materialize


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("high", "low")),
                    F.sum(F.pmod(F.xxhash64("low", "high"), F.lit(1 << 31)))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``(id, label)`` for every id of ``edges(a, b)``: the least id reachable from it.

    Each round links the neighbours of a node to the least of them, first the larger ones, then
    the smaller ones; both are a partial aggregate and a join, so a node with very many edges is
    merged before the shuffle and split in the join. The table of a round is written to the shared
    folder. Rounds grow with the logarithm of the longest path. Self links and nulls are ignored.
    """
    edges = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("high"),
                                     F.least("a", "b").alias("low")).distinct(), "edges")
    state = _state(edges)
    while True:
        both = edges.select(F.col("high").alias("u"), F.col("low").alias("v")).union(
            edges.select(F.col("low").alias("u"), F.col("high").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m"))
        wide = (both.where("v > u").join(least, "u")
                .select(F.col("v").alias("high"), F.col("m").alias("low")).distinct())
        wide = materialize(wide, "edges")
        least = wide.groupBy("high").agg(F.min("low").alias("m"))
        small = wide.join(least, "high")
        edges = materialize(
            small.select(F.col("high"), F.col("m").alias("low"))
            .union(small.where("low <> m").select(F.col("low").alias("high"),
                                                  F.col("m").alias("low"))).distinct(), "edges")
        before, state = state, _state(edges)
        if before == state:
            return edges.select(F.col("high").alias("id"), F.col("low").alias("label")).union(
                edges.select(F.col("low"), F.col("low")).distinct())
