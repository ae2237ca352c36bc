"""Which partitions of a stored table are whole.

Beside a table ``t`` stands ``t.parts``: rows ``(keys, version, stored)``, appended one small file at a time.
A partition is noted as open before it is written and as stored afterwards; its latest row counts. So a
partition that a lost driver left half-written stays open, and one that keeps no rows is known to be done.
The table has a few rows per partition and run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlife.sources.sinks import existing_partitions, stored_table


def _path(table: str) -> str:
    return f"{table.rstrip('/')}.parts"


def partition_states(spark: SparkSession, table: str, keys: Sequence[str]) -> DataFrame:
    """``keys, stored`` of every partition ever noted; no rows where nothing was."""
    noted = stored_table(spark, _path(table))
    if noted is None:
        return spark.createDataFrame([], ", ".join([*[f"{k} int" for k in keys], "stored boolean"]))
    return noted.groupBy(*keys).agg(F.max_by("stored", "version").alias("stored"))


def partitions(spark: SparkSession, table: str, keys: Sequence[str], stored: bool = True
               ) -> set[tuple[int, ...]]:
    """Partitions that are whole or, with ``stored=False``, open (one entry per partition)."""
    states = partition_states(spark, table, keys)
    return {tuple(r) for r in states.where(F.col("stored") == stored).select(*keys).collect()}


def note(spark: SparkSession, table: str, keys: Sequence[str], values: Iterable[Sequence[int]],
         stored: bool) -> None:
    """Append the state of some partitions."""
    values = sorted({tuple(v) for v in values})
    if not values:
        return
    noted = stored_table(spark, _path(table))
    last = 0 if noted is None else noted.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]
    schema = ", ".join([*[f"{k} int" for k in keys], "version bigint", "stored boolean"])
    (spark.createDataFrame([(*map(int, v), last + 1, stored) for v in values], schema).coalesce(1)
     .write.mode("append").parquet(_path(table)))


def write_noted(spark: SparkSession, table: str, keys: Sequence[str], values: Iterable[Sequence[int]],
                write: Callable[[], None]) -> None:
    """Run ``write`` for some partitions; they count as stored only once it has ended."""
    values = list(values)
    note(spark, table, keys, values, False)
    write()
    note(spark, table, keys, values, True)


def adopt(spark: SparkSession, table: str, keys: Sequence[str]) -> None:
    """Note all partitions found at ``table`` as stored, for tables written before they had notes."""
    found = existing_partitions(spark, table, keys)
    if found is not None:
        note(spark, table, keys, [tuple(r) for r in found.collect()], True)
