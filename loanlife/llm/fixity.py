"""Fixity audit of archive replicas with Merkle trees over ordered offset ranges.

A leaf is the digest of one record at its offset. Leaves are grouped by offset range; a range's digest
covers the offsets and digests of its records in order. ``fanout`` neighbouring ranges make a node of
the next level, up to one root per archive. Two replicas are compared at the roots; only children of
mismatching nodes are looked at on the way down, and only records of mismatching ranges at the end.
All steps are aggregates and joins over digests: payloads are read once and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlife.support import materialize

RANGE_BYTES, FANOUT, ARCHIVE_RECORDS = 1 << 16, 16, 1_000


def response_record(url: Column, payload: Column) -> Column:
    """A WARC response record. Nulls count as empty; the length line counts bytes."""
    url, payload = F.coalesce(url, F.lit("")), F.coalesce(payload, F.lit(""))
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), url,
                    F.lit("\r\nContent-Length: "), F.octet_length(payload).cast("string"),
                    F.lit("\r\n\r\n"), payload, F.lit("\r\n\r\n"))


def tree(leaves: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels of the trees of ``leaves(side, archive, offset, digest)``, leaf ranges first.

    Each level is ``(side, archive, node, digest)``. A node covers at most ``fanout`` children, a
    range the records that begin in ``range_bytes`` bytes.
    """
    def digests(df: DataFrame, order: str) -> DataFrame:
        parts = F.transform(F.array_sort(F.collect_list(F.struct(order, "digest"))),
                            lambda x: F.concat_ws(":", x[order].cast("string"), x["digest"]))
        return df.groupBy("side", "archive", "node").agg(
            F.sha2(F.concat_ws("|", parts), 256).alias("digest"))
    level = materialize(digests(leaves.withColumn(
        "node", F.expr(f"offset div {range_bytes}L")), "offset"), "ranges")
    levels = [level]
    top = level.agg(F.max("node")).first()[0] or 0
    while top > 0:
        level = materialize(digests(level.select(
            "side", "archive", F.col("node").alias("child"), "digest",
            F.expr(f"node div {fanout}L").alias("node")), "child"), "nodes")
        levels.append(level)
        top //= fanout
    return levels


def _differing(level: DataFrame, key: str) -> DataFrame:
    """Nodes or records that are not the same in both replicas."""
    mine = level.where("side = 0").select("archive", key, F.col("digest").alias("expected"))
    other = level.where("side = 1").select("archive", key, F.col("digest").alias("found"))
    return mine.join(other, ["archive", key], "full").where("not expected <=> found")


def audit(primary: DataFrame, replica: DataFrame, range_bytes: int = RANGE_BYTES,
          fanout: int = FANOUT) -> DataFrame:
    """Records in which two replicas differ: ``archive, offset, status, expected, found``.

    Both inputs are ``(archive, offset, digest)``. ``status`` is ``altered``, ``missing`` (not in the
    replica) or ``extra`` (only there). Several records at one offset count as one whose digest is
    that of their sorted digests. Rows with a null archive or offset are not part of any tree and
    are ignored; a null digest is a digest of its own. Equal replicas give an empty result.
    """
    def side(df: DataFrame, n: int) -> DataFrame:
        return df.select(F.lit(n).alias("side"), F.col("archive").cast("long"),
                         F.col("offset").cast("long"),
                         F.coalesce("digest", F.lit("none")).alias("digest"))
    rows = side(primary, 0).unionByName(side(replica, 1)).where(
        "archive is not null and offset is not null")
    one = F.when(F.count("*") == 1, F.min("digest")).otherwise(
        F.sha2(F.concat_ws("|", F.sort_array(F.collect_list("digest"))), 256))
    leaves = materialize(rows.groupBy("side", "archive", "offset").agg(one.alias("digest")),
                         "leaves")
    levels = tree(leaves, range_bytes, fanout)
    bad = _differing(levels[-1], "node").select("archive", "node")
    for level in reversed(levels[:-1]):
        below = level.withColumn("parent", F.expr(f"node div {fanout}L")).join(
            bad.withColumnRenamed("node", "parent"), ["archive", "parent"], "left_semi")
        bad = _differing(below, "node").select("archive", "node")
    records = leaves.withColumn("node", F.expr(f"offset div {range_bytes}L")).join(
        bad, ["archive", "node"], "left_semi")
    return _differing(records, "offset").select(
        "archive", "offset", F.when(F.col("found").isNull(), "missing")
        .when(F.col("expected").isNull(), "extra").otherwise("altered").alias("status"),
        "expected", "found")


def layout(pages: DataFrame, payloads: dict[str, Column], id_column: str = "page_id",
           url_column: str = "url", archive_records: int = ARCHIVE_RECORDS) -> DataFrame:
    """Where each page's record lies: ``page_id, archive, offset, n_bytes`` and one digest column
    for each of ``payloads``, the first of which gives the lengths.

    Archives take ``archive_records`` consecutive ids; records follow each other by id, then digest.
    Null ids go to archive -1. Only lengths and digests are shuffled.
    """
    from pyspark.sql import Window
    first = next(iter(payloads))
    made = pages.select(
        F.col(id_column).cast("long").alias("page_id"),
        *[response_record(F.col(url_column), p).alias(f"_{n}") for n, p in payloads.items()])
    narrow = made.select(
        "page_id", F.coalesce(F.expr(f"page_id div {archive_records}L"), F.lit(-1)).alias("archive"),
        F.octet_length(f"_{first}").cast("long").alias("n_bytes"),
        *[F.sha2(f"_{n}", 256).alias(n) for n in payloads])
    order = Window.partitionBy("archive").orderBy("page_id", first).rowsBetween(
        Window.unboundedPreceding, -1)
    return narrow.withColumn("offset", F.coalesce(F.sum("n_bytes").over(order), F.lit(0)))
