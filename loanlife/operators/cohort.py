"""Calendar-time prepayment rates from the outcome table alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanlife.functions.binning import cut
from loanlife.operators.ranks import running_sum
from loanlife.sources.tables import attach_macro


def month_spine(df: DataFrame, low: str, high: str) -> DataFrame:
    """Every month from the earliest ``low`` to the latest ``high``."""
    months = F.sequence(F.min(low), F.max(high), F.expr("interval 1 month"))
    return df.agg(F.explode(months).alias("month"))


def calendar_hazard(outcomes: DataFrame, macro: DataFrame | None = None) -> DataFrame:
    """Starts, ends, active loans and prepayment rate per calendar month.

    Loans are reduced to counts per (start, end, prepaid) month triple in one scan; all
    later steps run on month-grain tables.
    """
    seen = outcomes.where("first_obs_date IS NOT NULL AND last_obs_date IS NOT NULL")
    cells = seen.groupBy("first_obs_date", "last_obs_date",
                         (F.col("event_type") == "prepaid").alias("__pre")).agg(
        F.count(F.lit(1)).alias("n"))
    moves = cells.select(F.explode(F.array(
        F.struct(F.col("first_obs_date").alias("month"), F.col("n").alias("s"),
                 F.lit(0).cast("bigint").alias("e"), F.lit(0).cast("bigint").alias("p")),
        F.struct(F.col("last_obs_date").alias("month"), F.lit(0).cast("bigint").alias("s"),
                 F.col("n").alias("e"), F.when(F.col("__pre"), F.col("n")).otherwise(0).alias("p")),
    )).alias("m")).select("m.*")
    counts = moves.groupBy("month").agg(F.sum("s").alias("n_starts"), F.sum("e").alias("n_ends"),
                                        F.sum("p").alias("n_prepaid"))
    cal = month_spine(cells, "first_obs_date", "last_obs_date").join(counts, "month", "left")
    cal = cal.fillna(0, ["n_starts", "n_ends", "n_prepaid"])
    by_month = Window.partitionBy(F.lit(1)).orderBy("month")
    cal = cal.withColumn("__gone", F.lag("n_ends", 1, 0).over(by_month))
    cal = cal.withColumns({"cum_starts": running_sum(F.col("n_starts"), "month"),
                           "cum_ended": running_sum(F.col("__gone"), "month")}).drop("__gone")
    cal = cal.withColumn("active", F.col("cum_starts") - F.col("cum_ended"))
    cal = cal.withColumn("cpr_pct", F.try_divide(F.col("n_prepaid").cast("double"),
                                                 F.col("active").cast("double")) * 100)
    return attach_macro(cal, macro) if macro is not None else cal


def _year_cells(outcomes: DataFrame, *keys) -> DataFrame:
    """Counts per cohort year, exit year and prepaid flag: a few thousand rows."""
    return outcomes.where("last_obs_date IS NOT NULL").groupBy(
        *keys, F.year("last_obs_date").alias("end_year"),
        (F.col("event_type") == "prepaid").alias("__pre")).agg(F.count(F.lit(1)).alias("n"))


def snapshot_hazard(outcomes: DataFrame, years: Sequence[int], breaks: Sequence[float],
                    labels: Sequence[str] | None = None) -> DataFrame:
    """Monthly prepayment rate by loan-age bucket among loans alive in each given year."""
    cells = _year_cells(outcomes.where("first_obs_date IS NOT NULL"),
                        F.year("first_obs_date").alias("orig_year"))
    snap = cells.withColumn("snap_year", F.explode(F.array(*[F.lit(y) for y in years])))
    alive = snap.where("orig_year <= snap_year AND end_year >= snap_year")
    age = (F.col("snap_year") - F.col("orig_year")) * 12
    now = F.col("__pre") & (F.col("end_year") == F.col("snap_year"))
    out = alive.withColumn("age_bucket", cut(age, breaks, labels)).groupBy(
        "snap_year", "age_bucket").agg(
        F.sum("n").alias("n_loans"),
        F.sum(F.when(now, F.col("n")).otherwise(0)).alias("n_prepaid"))
    return out.withColumn("monthly_prepay_pct",
                          F.col("n_prepaid") / F.col("n_loans") / 12 * 100)


def age_calendar(outcomes: DataFrame, cal_years: Sequence[int], age_years: Sequence[int],
                 min_active: int, vintages: tuple[int, int]) -> DataFrame:
    """Age-by-calendar-year grid of monthly prepayment rates; thin cells are NULL."""
    cells = _year_cells(outcomes, "vintage_year").where(
        F.col("vintage_year").between(*vintages))
    at = cells.withColumn("cal_year", F.explode(F.array(*[F.lit(y) for y in cal_years]))).where(
        "end_year >= cal_year")
    sums = at.groupBy("vintage_year", "cal_year").agg(
        F.sum("n").alias("n_active"),
        F.sum(F.when(F.col("__pre") & (F.col("end_year") == F.col("cal_year")), F.col("n"))
              .otherwise(0)).alias("n_prepaid"))
    ages = F.array(*[F.lit(a) for a in age_years])
    grid = outcomes.sparkSession.createDataFrame([(y,) for y in cal_years], "cal_year int") \
        .withColumn("age_year", F.explode(ages))
    grid = grid.withColumn("vintage_year", F.col("cal_year") - F.col("age_year"))
    out = grid.join(sums, ["vintage_year", "cal_year"], "left")
    rate = F.col("n_prepaid") / F.col("n_active") / 12 * 100
    return out.select("cal_year", "age_year", F.when(
        F.col("n_active") >= min_active, rate).alias("monthly_prepay_pct"))


def loan_history(panel: DataFrame, loan_id, order: Sequence[str] = ("month",)) -> DataFrame:
    """Month-by-month rows of one loan, with the delinquency code as a number when it is one."""
    from loanlife.functions.cleaning import digits_only
    return panel.where(F.col("loan_seq_num") == F.lit(loan_id)).withColumn(
        "dq_months", digits_only(F.col("dq_status"))).orderBy(*order)


def first_loan(outcomes: DataFrame, vintage: int, event_type: str):
    """Smallest id among loans of one vintage and event type."""
    row = outcomes.where((F.col("vintage_year") == vintage) &
                         (F.col("event_type") == event_type)).agg(F.min("loan_seq_num")).first()
    return row[0]
