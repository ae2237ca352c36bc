"""Raw quarter files to the stored tables: origination, monthly panel, outcomes, checks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlife import columns as K
from loanlife.functions.cleaning import keep_30y_fixed, transform_monthly, transform_origination
from loanlife.operators import checks as V
from loanlife.operators.outcomes import outcome_stats, outcomes
from loanlife.sources.manifest import partition_states, partitions, write_noted
from loanlife.sources.sinks import observed_rows, with_counts, write_table
from loanlife.sources.tables import restrict_ids
from loanlife.sources.text import quarter_files, scan_raw, with_file_vintage

KEYS = ["vintage_year", "vintage_quarter"]


@dataclass
class ConvertStats:
    """Rows read and kept; zero when every quarter was already there."""

    orig_raw: int = 0
    orig_kept: int = 0
    monthly_raw: int = 0
    monthly_kept: int = 0


def _quarters(spark: SparkSession, path: str) -> set[tuple[int, int]]:
    """Quarters that are whole at ``path`` (one entry per quarter)."""
    return partitions(spark, path, KEYS)


def _unread(spark: SparkSession, files: str | Sequence[str], path: str, force: bool
            ) -> dict[str, tuple[int, int]]:
    """Files of quarters not stored yet, by their names alone, with their quarters."""
    listed = quarter_files(spark, files if isinstance(files, str) else list(files))
    done = set() if force else _quarters(spark, path)
    return {f: quarter for f, quarter in sorted(listed.items()) if quarter not in done}


def _of_quarters(df: DataFrame, quarters: set[tuple[int, int]]) -> DataFrame:
    """Rows of some quarters as literal conditions, so that other partitions are never listed."""
    wanted = F.lit(False)
    for year in sorted({y for y, _ in quarters}):
        own = sorted(q for y, q in quarters if y == year)
        wanted = wanted | ((F.col(KEYS[0]) == year) & F.col(KEYS[1]).isin(*own))
    return df.where(wanted)


def convert(spark: SparkSession, origination: str | Sequence[str], monthly: str | Sequence[str],
            root: str, force: bool = False) -> ConvertStats:
    """All new quarter files in one job per table. Files of stored quarters are not opened unless
    forced. A quarter is stored once its write has ended, also when it keeps no rows; one that a lost
    run left half-written is read again and replaced."""
    stats = ConvertStats()
    new = _unread(spark, origination, f"{root}/origination", force)
    if new:
        raw, seen_raw = with_counts(with_file_vintage(scan_raw(spark, list(new), K.ORIGINATION_RAW)),
                                    "orig_raw")
        typed = transform_origination(raw, F.col("vintage_year"), F.col("vintage_quarter"))
        kept, seen_kept = with_counts(keep_30y_fixed(typed), "orig_kept")
        write_noted(spark, f"{root}/origination", KEYS, new.values(),
                    lambda: write_table(kept, f"{root}/origination", KEYS, [K.ID]))
        stats.orig_raw, stats.orig_kept = observed_rows(seen_raw, raw), observed_rows(seen_kept, kept)

    new = _unread(spark, monthly, f"{root}/monthly", force)
    if new:
        ids = spark.read.parquet(f"{root}/origination").select(K.ID)
        raw, seen_raw = with_counts(with_file_vintage(scan_raw(spark, list(new), K.MONTHLY_RAW)),
                                    "monthly_raw")
        panel, seen_kept = with_counts(transform_monthly(raw).transform(restrict_ids(ids)),
                                       "monthly_kept")
        write_noted(spark, f"{root}/monthly", KEYS, new.values(),
                    lambda: write_table(panel, f"{root}/monthly", KEYS, [K.ID, "month"]))
        stats.monthly_raw = observed_rows(seen_raw, raw)
        stats.monthly_kept = observed_rows(seen_kept, panel)
    return stats


def _undone_quarters(spark: SparkSession, root: str, force: bool) -> set[tuple[int, int]]:
    """Quarters to derive: whole in origination and not half-written in the panel."""
    quarters = _quarters(spark, f"{root}/origination") - partitions(
        spark, f"{root}/monthly", KEYS, stored=False)
    return quarters if force else quarters - _quarters(spark, f"{root}/outcomes")


def undone(spark: SparkSession, root: str, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """Origination and panel rows of the quarters without outcomes; other partitions are pruned.

    A loan's panel rows are stored under its own quarter.
    """
    quarters = _undone_quarters(spark, root, force)
    tables = (spark.read.parquet(f"{root}/{t}") for t in ("origination", "monthly"))
    return tuple(_of_quarters(df, quarters) for df in tables)


def derive_outcomes(spark: SparkSession, root: str, force: bool = False) -> DataFrame:
    """Outcome table of every stored quarter; returns its per-quarter summary."""
    quarters = _undone_quarters(spark, root, force)
    derived = outcomes(*undone(spark, root, force), ["month", "loan_age"])
    write_noted(spark, f"{root}/outcomes", KEYS, quarters,
                lambda: write_table(derived, f"{root}/outcomes", KEYS, [K.ID]))
    return outcome_stats(spark.read.parquet(f"{root}/outcomes"))


def validate(spark: SparkSession, root: str, raw_origination: str | None = None) -> DataFrame:
    """Every check over every stored quarter."""
    orig, panel = (spark.read.parquet(f"{root}/{t}") for t in ("origination", "monthly"))
    done = spark.read.parquet(f"{root}/outcomes")
    checks = [V.check_orphans(panel, orig), V.check_counts(done, orig),
              V.check_pk_nulls(panel, orig),
              *[V.check_whole(df, partition_states(spark, f"{root}/{t}", KEYS), t) for t, df in (
                  ("origination", orig), ("monthly", panel), ("outcomes", done))]]
    if raw_origination is not None:
        raw = with_file_vintage(scan_raw(spark, raw_origination, K.ORIGINATION_RAW))
        typed = transform_origination(raw, F.col("vintage_year"), F.col("vintage_quarter"))
        checks.append(V.check_recount(keep_30y_fixed(typed), orig))
    return V.validation_report(*checks)
