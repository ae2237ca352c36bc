"""Global order without a global sort: running totals, hash samples and exact quantiles.

Each works in two levels. A bounded table of bucket counts is formed by partial aggregation and
only that table is ordered; rows are then handled inside their bucket or filtered by a cut value.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanlife.support import bounded_collect, broadcast_if_small, keyed


def suffix_sum(c: Column, order: str, by: Sequence[str] = ()) -> Column:
    """Sum over this row and all later ones of a short, already aggregated table."""
    w = Window.partitionBy(*keyed(by)).orderBy(order)
    return F.sum(c).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))


def running_sum(c: Column, order: str, by: Sequence[str] = ()) -> Column:
    """Sum over this row and all earlier ones of a short, already aggregated table."""
    w = Window.partitionBy(*keyed(by)).orderBy(order)
    return F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def bucket_edges(df: DataFrame, column: str, buckets: int) -> list[float]:
    """Strictly increasing interior edges of about equal row counts (a bounded driver list)."""
    if buckets < 2:
        return []
    probs = [i / buckets for i in range(1, buckets)]
    edges = df.agg(F.percentile_approx(column, probs, 4 * buckets)).first()[0]
    return sorted(set(edges or []))


def with_bucket(df: DataFrame, column: str, edges: Sequence[float], out: str = "__bucket"
                ) -> DataFrame:
    """Bucket number by binary search in the JVM; a pure function of the value."""
    if not edges:
        return df.withColumn(out, F.lit(0))
    splits = [-math.inf, *edges, math.inf]
    coded = Bucketizer(splits=splits, inputCol=column, outputCol=out).transform(df)
    return coded.withColumn(out, F.col(out).cast("int"))


def default_buckets(df: DataFrame) -> int:
    return max(8, min(4096, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def running_totals(df: DataFrame, order: str, values: Sequence[str], by: Sequence[str] = (),
                   buckets: int | None = None) -> DataFrame:
    """Descending running totals ``cum_<value>`` over the distinct values of ``order``.

    Rows with the same order value are merged first, so a hot value is one row. Buckets of the
    order value are ordered through their totals; windows only run inside a bucket. The input is
    read three times (edges, totals, windows), so pass a stored table.
    """
    by = list(by)
    edges = bucket_edges(df, order, buckets or default_buckets(df))
    merged = df.groupBy(*by, order).agg(*[F.sum(v).alias(v) for v in values])
    merged = with_bucket(merged, order, edges)
    if not edges:
        w = Window.partitionBy(*keyed(by)).orderBy(F.desc(order))
        return merged.withColumns({f"cum_{v}": F.sum(v).over(w) for v in values}).drop("__bucket")

    totals = merged.groupBy(*by, "__bucket").agg(*[F.sum(v).alias(f"__t_{v}") for v in values])
    above = Window.partitionBy(*keyed(by)).orderBy(F.desc("__bucket")).rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "__bucket", *[
        F.coalesce(F.sum(f"__t_{v}").over(above), F.lit(0)).alias(f"__o_{v}") for v in values])
    inside = Window.partitionBy(*by, "__bucket").orderBy(F.desc(order))
    placed = merged.withColumns({f"cum_{v}": F.sum(v).over(inside) for v in values})
    placed = placed.join(offsets, [*by, "__bucket"])
    return placed.select(*by, order, *values, *[
        (F.col(f"cum_{v}") + F.col(f"__o_{v}")).alias(f"cum_{v}") for v in values])


def row_hash(key: str, seed: int) -> Column:
    """Engine-independent ordering key of a row."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def hash_cuts(df: DataFrame, key: str, seed: int, sizes: Sequence[Column],
              by: Sequence[str] = ()) -> DataFrame:
    """Hash value of the k-th row in hash order, per group, for each k in ``sizes``.

    ``sizes`` are expressions over ``__n``, the size of the group. The cut is found from counts
    per 16-bit hash prefix and an exact rank inside the one prefix that holds it, so no group is
    ever ordered whole. Result: one row per group with ``cut_0``, ``cut_1``, ...; a cut of the
    empty string selects nothing.
    """
    by = list(by)
    hashed = df.select(*by, row_hash(key, seed).alias("__h")).withColumn(
        "__p", F.substring("__h", 1, 4))
    counts = hashed.groupBy(*by, "__p").agg(F.count(F.lit(1)).alias("__c"))
    group = Window.partitionBy(*keyed(by))
    counts = counts.withColumns({
        "__n": F.sum("__c").over(group),
        "__cum": F.sum("__c").over(group.orderBy("__p")),
    })
    wanted = F.explode(F.array(*[
        F.struct(F.lit(i).alias("cut"), s.cast("bigint").alias("k"))
        for i, s in enumerate(sizes)])).alias("__w")
    targets = counts.select(*by, "__p", "__cum", "__c", wanted).select(
        *by, "__p", (F.col("__cum") - F.col("__c")).alias("__before"), "__cum",
        F.col("__w.cut").alias("__cut"), F.col("__w.k").alias("__k"))
    nothing = targets.where("__k < 1").select(*by, "__cut", F.lit("").alias("__h")).distinct()
    holding = targets.where("__k > __before AND __k <= __cum").drop("__cum")
    near = hashed.join(broadcast_if_small(holding), [*by, "__p"])
    rank = Window.partitionBy(*by, "__cut").orderBy("__h")
    exact = near.withColumn("__r", F.row_number().over(rank) + F.col("__before")).where(
        "__r = __k").select(*by, "__cut", "__h")
    both = exact.unionByName(nothing)
    numbers = range(len(sizes))
    grouped = both.groupBy(*by) if by else both.groupBy()
    return grouped.agg(*[
        F.max(F.when(F.col("__cut") == i, F.col("__h"))).alias(f"cut_{i}") for i in numbers])


def join_cuts(df: DataFrame, cuts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Attach the cuts of each row's group; without groups they are plain constants."""
    if by:
        return df.join(broadcast_if_small(cuts), list(by))
    row = cuts.first()
    return df.withColumns({c: F.lit(row[c] if row else None).cast("string")
                           for c in cuts.columns})


def hash_sample(df: DataFrame, key: str, n: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """The ``n`` rows with the smallest hash, per group (whole groups when smaller).

    ``key`` must be unique and the group columns not NULL. After the cuts are known the sample
    is a filter on the scan.
    """
    cuts = hash_cuts(df, key, seed, [F.least(F.lit(n), F.col("__n"))], by)
    return join_cuts(df, cuts, by).where(row_hash(key, seed) <= F.col("cut_0")).drop("cut_0")


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                    by: Sequence[str] = (), bins: int = 2048,
                    max_groups: int = 10_000) -> dict[tuple, dict[str, list[float | None]]]:
    """Exact linearly interpolated quantiles of every column (per group), without sorting.

    Each pass counts values in equal-width bins of the bracket that holds a wanted order
    statistic, and narrows the bracket to one bin; a bin with a single value ends the search.
    Integer-like columns end after one pass, and later passes read only columns still searched.
    NaN counts as missing; infinite values have their place at the ends. Groups must be few
    (``max_groups``): their bin counts, ``bins`` for each open bracket, reach the driver.
    """
    by = list(by)
    spark = df.sparkSession
    # NaN is a missing value; infinities are counted at the ends and never enter a bracket.
    def values(numbers: Sequence[int]) -> DataFrame:
        v = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        return df.select(*by, F.explode(F.array(*[
            F.struct(F.lit(i).alias("c"), v(columns[i]).alias("v")) for i in numbers])
        ).alias("__s")).select(*by, "__s.c", "__s.v").where(F.col("v").isNotNull())
    inner = F.when(F.abs("v") != math.inf, F.col("v"))
    ends = bounded_collect(
        values(range(len(columns))).groupBy(*by, "c").agg(
            F.count(F.lit(1)).alias("n"), F.min(inner).alias("lo"), F.max(inner).alias("hi"),
            F.count_if(F.col("v") == -math.inf).alias("below"),
            F.count_if(F.col("v") == math.inf).alias("above")),
        max_groups * len(columns), "quantile groups")

    found: dict[tuple, float] = {}
    open_: dict[tuple, tuple[float, float, int]] = {}
    size: dict[tuple, int] = {}
    for r in ends:
        cell = (*[r[b] for b in by], r["c"])
        size[cell] = r["n"]
        for p in probs:
            low = math.floor(p * (r["n"] - 1))
            for k in {low, min(low + 1, r["n"] - 1)}:
                if k < r["below"]:
                    found[(*cell, k)] = -math.inf
                elif k >= r["n"] - r["above"]:
                    found[(*cell, k)] = math.inf
                elif r["lo"] == r["hi"]:
                    found[(*cell, k)] = r["lo"]
                else:
                    open_[(*cell, k)] = (r["lo"], r["hi"], k - r["below"])

    key_types = [df.schema[b].dataType.simpleString() for b in by]
    schema = ", ".join([*[f"`{b}` {t}" for b, t in zip(by, key_types)],
                        "c int, br int, lo double, hi double"])
    while open_:
        brackets = sorted({(key[:-1], lo, hi) for key, (lo, hi, _) in open_.items()},
                          key=lambda x: (str(x[0]), x[1]))
        number = {b: i for i, b in enumerate(brackets)}
        table = spark.createDataFrame(
            [(*cell, i, lo, hi) for i, (cell, lo, hi) in enumerate(brackets)], schema)
        wanted = sorted({key[-2] for key in open_})
        hit = values(wanted).join(F.broadcast(table), [*by, "c"]).where("v >= lo AND v <= hi")
        # Halves, so that the width of a very wide bracket is still a number. The two ends of a
        # bracket always fall in different bins, so each pass narrows it.
        half = lambda a, b: F.col(a) / 2 - F.col(b) / 2
        place = F.least(F.floor(half("v", "lo") / half("hi", "lo") * bins), F.lit(bins - 1))
        counted = hit.groupBy("br", place.alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        per: dict[int, list] = {}
        for r in sorted(counted, key=lambda r: (r["br"], r["bin"])):
            per.setdefault(r["br"], []).append(r)
        still: dict[tuple, tuple[float, float, int]] = {}
        for key, (lo, hi, k) in open_.items():
            left = k
            for r in per[number[(key[:-1], lo, hi)]]:
                if left < r["n"]:
                    if r["lo"] == r["hi"]:
                        found[key] = r["lo"]
                    else:
                        still[key] = (r["lo"], r["hi"], left)
                    break
                left -= r["n"]
        open_ = still

    out: dict[tuple, dict[str, list[float | None]]] = {}
    for cell, n in size.items():
        numbers = []
        for p in probs:
            pos = p * (n - 1)
            low = math.floor(pos)
            a, b = found[(*cell, low)], found[(*cell, min(low + 1, n - 1))]
            numbers.append(a if a == b or pos == low else a + (b - a) * (pos - low))
        out.setdefault(cell[:-1], {})[columns[cell[-1]]] = numbers
    for per_group in out.values():
        for c in columns:
            per_group.setdefault(c, [None] * len(probs))
    return out


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    if not columns:
        return {}
    got = exact_quantiles(df, columns, [0.5]).get((), {})
    return {c: got.get(c, [None])[0] for c in columns}
