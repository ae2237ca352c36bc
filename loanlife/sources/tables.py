"""Loaders of the partitioned tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlife.columns import ID
from loanlife.support import broadcast_if_small, materialize


def load_table(spark: SparkSession, root: str, table: str, years: Iterable[int] | None = None,
               columns: Sequence[str] | None = None) -> DataFrame:
    """One table, restricted to vintages by partition pruning and to columns at the scan.

    A missing table raises ``AnalysisException``. An empty year list selects nothing and raises.
    """
    df = spark.read.parquet(f"{root.rstrip('/')}/{table}")
    if years is not None:
        years = sorted(set(years))
        if not years:
            raise FileNotFoundError(f"no '{table}' partitions for an empty year list")
        df = df.where(F.col("vintage_year").isin(*years))
    return df.select(*columns) if columns is not None else df


def restrict_ids(ids: DataFrame, key: str = ID, max_broadcast_rows: int = 1_000_000
                 ) -> Callable[[DataFrame], DataFrame]:
    """Semi-join transform. The id list is written once, counted, and broadcast only when small."""
    wanted = materialize(ids.select(key).where(F.col(key).isNotNull()).distinct(), "ids")
    if wanted.limit(max_broadcast_rows + 1).count() <= max_broadcast_rows:
        wanted = F.broadcast(wanted)
    return lambda df: df.join(wanted, key, "left_semi")


def ids_frame(spark: SparkSession, ids: Iterable, key: str = ID, key_type: str = "string"
              ) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], f"{key} {key_type}")


def loans_wide(orig: DataFrame, outcomes: DataFrame, columns: Sequence[str] | None = None
               ) -> DataFrame:
    """Origination with its outcome; every loan stays, vintage columns are origination's."""
    extra = outcomes.drop("vintage_year", "vintage_quarter")
    out = orig.join(extra, ID, "left")
    return out.select(*columns) if columns is not None else out


def load_loans(spark: SparkSession, root: str, years: Iterable[int] | None = None,
               columns: Sequence[str] | None = None) -> DataFrame:
    years = list(years) if years is not None else None
    return loans_wide(load_table(spark, root, "origination", years),
                      load_table(spark, root, "outcomes", years), columns)


def as_macro(df: DataFrame) -> DataFrame:
    return df.withColumn("month", F.col("month").cast("date"))


def load_macro(spark: SparkSession, path: str) -> DataFrame:
    return as_macro(spark.read.parquet(path))


def attach_macro(df: DataFrame, macro: DataFrame, on: str = "month",
                 series: Sequence[str] | None = None) -> DataFrame:
    """Left join of the monthly series; the month table is broadcast after its size is checked."""
    if series is not None:
        macro = macro.select("month", *series)
    table = broadcast_if_small(macro)
    if on != "month":
        table = table.withColumnRenamed("month", on)
    return df.join(table, on, "left")
