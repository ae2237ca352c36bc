"""Writers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loanlife.columns import ID
from loanlife.support import broadcast_if_small


def lock_schema(df: DataFrame, schema: Mapping[str, str]) -> DataFrame:
    """Declared columns, in declared order, with declared types."""
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in schema.items()])


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ("vintage_year",),
                sort_by: Sequence[str] = (), level: int = 9, mode: str = "overwrite") -> None:
    """ZSTD Parquet, dictionary and statistics on, laid out by vintage.

    The rebalance hint lets adaptive execution split a hot vintage over several tasks and merge
    small ones; rows are sorted inside each file to make loan look-ups skip row groups.
    """
    keys = [c for c in partition_by if c in df.columns]
    if keys:
        df = df.hint("rebalance", *keys)
    if sort_by:
        df = df.sortWithinPartitions(*keys, *sort_by)
    (df.write.mode(mode).option("compression", "zstd")
       .option("parquet.compression.codec.zstd.level", level)
       .option("partitionOverwriteMode", "dynamic" if keys else "static")
       .partitionBy(*keys).parquet(path))
    if keys and stored_table(df.sparkSession, path) is None:
        # Nothing was written: one file without rows keeps the schema readable.
        (df.sparkSession.createDataFrame([], df.schema).coalesce(1)
           .write.mode("append").parquet(path))


def stored_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or ``None`` where there is none; a damaged one raises."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def existing_partitions(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame | None:
    found = stored_table(spark, path)
    return None if found is None else found.select(*keys).distinct()


def write_missing_partitions(df: DataFrame, path: str, keys: Sequence[str],
                             sort_by: Sequence[str] = (), force: bool = False) -> list[tuple]:
    """Write only the partitions that are not there yet; ``force`` rewrites the given ones.

    Other partitions are never touched. Returns the partition values written.
    """
    present = None if force else existing_partitions(df.sparkSession, path, keys)
    if present is not None:
        df = df.join(broadcast_if_small(present), list(keys), "left_anti")
    todo = [tuple(r) for r in df.select(*keys).distinct().orderBy(*keys).collect()]
    if todo:
        write_table(df, path, keys, sort_by)
    return todo


def write_handoff(df: DataFrame, path: str, columns: Sequence[str], label: str) -> None:
    df.select(*columns, label).write.mode("overwrite").parquet(path)


def write_predictions(df: DataFrame, path: str, prob_col: str, id_col: str = ID) -> None:
    df.select(id_col, prob_col).write.mode("overwrite").option("header", True).csv(path)


def write_result(df: DataFrame, path: str, run_id: str) -> None:
    """Small result table; each run has its own folder, so a re-run overwrites only itself."""
    (df.withColumn("run_id", F.lit(run_id)).coalesce(1)
       .write.mode("overwrite").option("header", True).csv(f"{path.rstrip('/')}/run={run_id}"))


def with_counts(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Row counter that rides along with whatever action runs the plan."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def observed_rows(seen: Observation, df: DataFrame) -> int:
    """The observed count of ``df``, whose action has run; errors are not caught.

    A plan that proved empty at run time may have lost its counter; it is then counted by itself.
    """
    found = seen.get
    return found["rows"] if "rows" in found else df.count()
