"""Data-quality checks, for all partitions in one job each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlife.columns import ID

PARTITION = ["vintage_year", "vintage_quarter"]


def orphans(child: DataFrame, parent: DataFrame, key: str = ID,
            within: Sequence[str] = ()) -> DataFrame:
    """Distinct child keys that have no parent (in the same partition, when given)."""
    keys = [*within, key]
    return child.select(*keys).distinct().join(parent.select(*keys), keys, "left_anti")


def _verdict(name: str, ok: Column, detail: Column, keys: Sequence[str]) -> list[Column]:
    return [F.lit(name).alias("check"), *[F.col(k) for k in keys], ok.alias("ok"),
            detail.alias("detail")]


def check_orphans(panel: DataFrame, orig: DataFrame, keys: Sequence[str] = PARTITION
                  ) -> DataFrame:
    """Panel loans must exist in origination."""
    active = panel.select(*keys, ID).distinct()
    owned = orig.select(*keys, ID).distinct().withColumn("__own", F.lit(1))
    joined = active.join(owned, [*keys, ID], "left")
    per = joined.groupBy(*keys).agg(F.count_if(F.col("__own").isNull()).alias("bad"))
    return per.select(*_verdict("orphans", F.col("bad") == 0, F.col("bad").cast("string"), keys))


def check_counts(outcomes: DataFrame, orig: DataFrame, keys: Sequence[str] = PARTITION
                 ) -> DataFrame:
    """One outcome row per originated loan; a partition without outcomes is not derived yet."""
    a = orig.groupBy(*keys).agg(F.count(F.lit(1)).alias("a"))
    b = outcomes.groupBy(*keys).agg(F.count(F.lit(1)).alias("b"))
    both = a.join(b, list(keys), "full")
    ok = F.col("b").isNull() | F.coalesce(F.col("a") == F.col("b"), F.lit(False))
    text = F.concat_ws("/", F.coalesce(F.col("b"), F.lit(0)).cast("string"),
                       F.coalesce(F.col("a"), F.lit(0)).cast("string"))
    return both.select(*_verdict("counts", ok, text, keys))


def check_pk_nulls(panel: DataFrame, orig: DataFrame, keys: Sequence[str] = PARTITION
                   ) -> DataFrame:
    """Loan ids and panel months must not be NULL."""
    a = orig.groupBy(*keys).agg(F.count_if(F.col(ID).isNull()).alias("n1"))
    b = panel.groupBy(*keys).agg(F.count_if(F.col(ID).isNull()).alias("n2"),
                                 F.count_if(F.col("month").isNull()).alias("n3"))
    both = b.join(a, list(keys), "left").fillna(0, ["n1"])
    total = F.col("n1") + F.col("n2") + F.col("n3")
    text = F.concat_ws("/", *[F.col(c).cast("string") for c in ("n1", "n2", "n3")])
    return both.select(*_verdict("pk_nulls", total == 0, text, keys))


def check_recount(expected: DataFrame, stored: DataFrame, keys: Sequence[str] = PARTITION
                  ) -> DataFrame:
    """Rows left by cleaning the raw text again against the stored rows."""
    a = expected.groupBy(*keys).agg(F.count(F.lit(1)).alias("a"))
    b = stored.groupBy(*keys).agg(F.count(F.lit(1)).alias("b"))
    both = a.join(b, list(keys), "full").fillna(0, ["a", "b"])
    text = F.concat_ws("/", F.col("b").cast("string"), F.col("a").cast("string"))
    return both.select(*_verdict("recount", F.col("a") == F.col("b"), text, keys))


def check_whole(stored: DataFrame, states: DataFrame, name: str, keys: Sequence[str] = PARTITION
                ) -> DataFrame:
    """Every partition found in a table must be noted as stored in ``states``."""
    found = stored.select(*keys).distinct().withColumn("found", F.lit(True))
    both = found.join(states, list(keys), "full")
    ok = F.coalesce(F.col("stored"), F.lit(False))
    text = F.concat_ws("/", F.lit(name), F.when(ok, "stored").otherwise("open"))
    return both.select(*_verdict("whole", ok, text, keys))


def validation_report(*checks: DataFrame) -> DataFrame:
    """All checks stacked: (check, partition, ok, detail)."""
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def passed(report: DataFrame) -> bool:
    """True when there is at least one row and every row is ok."""
    row = report.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("ok")).alias("bad")).first()
    return row["n"] > 0 and row["bad"] == 0
