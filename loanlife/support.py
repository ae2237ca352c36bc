"""Helpers shared by the operators: scratch folders and size-checked small tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL_ROWS = 100_000


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, from ``spark.checkpoint.dir``.

    Only where a local session names none (tests) is a temporary folder made and set; on a cluster
    the setting is required, as executors could not see each other's files.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="loanlife-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_WRITTEN: dict[str, SparkSession] = {}    # scratch tables of this process, by path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several passes will read into the shared folder, and read it back.

    Later passes then scan only the columns they need, and lost executors cost a re-read of
    files instead of the joins and aggregations above them. The table stays until ``discard`` or
    ``clear_scratch``, since results are lazy and may read it later.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    _WRITTEN[path] = df.sparkSession
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)


def discard(df: DataFrame) -> None:
    """Delete the scratch tables that ``df`` reads; for intermediate tables whose readers are done.

    Only tables that this process wrote by ``materialize`` are deleted.
    """
    folders = {f.rsplit("/", 2)[-2] for f in df.inputFiles()}    # their names are unique
    for path, spark in list(_WRITTEN.items()):
        if path.rsplit("/", 1)[-1] in folders:
            _delete(spark, path)
            del _WRITTEN[path]


def clear_scratch(spark: SparkSession) -> int:
    """Delete every scratch table this process wrote in the session's application, once all results
    that read them have been used; returns their number."""
    mine = [p for p, s in _WRITTEN.items() if s.sparkContext is spark.sparkContext]
    for path in mine:
        _delete(spark, path)
        del _WRITTEN[path]
    return len(mine)


def small_table(df: DataFrame, max_rows: int = SMALL_ROWS) -> tuple[DataFrame, bool]:
    """Turn ``df`` into an in-memory relation when it has at most ``max_rows`` rows.

    At most ``max_rows + 1`` rows reach the driver. Spark knows the size of the relation and
    broadcasts it by itself; a larger table comes back unchanged and is joined by shuffle.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df, False
    return df.sparkSession.createDataFrame(rows, df.schema), True


def broadcast_if_small(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    small, ok = small_table(df, max_rows)
    return F.broadcast(small) if ok else small


def bounded_collect(df: DataFrame, max_rows: int, what: str) -> list:
    """Collect a result whose size is bounded by its meaning; raise when the bound is broken."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what}: more than {max_rows} rows")
    return rows


def keyed(by: Sequence[str]) -> list[Column]:
    """Window partition keys; the constant stands in for 'no strata'."""
    return [F.col(c) for c in by] or [F.lit(1)]
