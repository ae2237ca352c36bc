"""Raw text to stored tables, twice and bit by bit."""

import pytest
from pyspark.sql import functions as F

from loanlife import columns as K
from loanlife.operators.checks import passed
from loanlife.plans import convert as P
from loanlife.plans.fixtures import view
from loanlife.sources.manifest import adopt, partitions
from loanlife.sources.sinks import existing_partitions, write_table

SF = "/root/testdata/sf0.001"


def write_quarters(spark, root, table, names, prefix, where):
    """One text file per quarter, named like the raw files."""
    df = view(spark, SF, table)
    for quarter, cond in where.items():
        lines = df.where(cond).select(F.concat_ws("|", *names).alias("value")).collect()
        (root / f"{prefix}_{quarter}.txt").write_text("\n".join(r[0] for r in lines) + "\n")


def halves(column):
    even = F.substring(column, -1, 1).isin("0", "2", "4", "6", "8")
    return {"2006Q1": even, "2006Q2": ~even}


def test_convert_derive_validate(spark, tmp_path):
    for d in ("o", "m"):
        (tmp_path / d).mkdir()
    write_quarters(spark, tmp_path / "o", "fx_raw_origination", K.ORIGINATION_RAW, "loans",
                   halves("loan_seq_num"))
    write_quarters(spark, tmp_path / "m", "fx_raw_monthly", K.MONTHLY_RAW, "loans_time",
                   halves("loan_seq_num"))
    root = str(tmp_path / "out")
    src = (str(tmp_path / "o"), str(tmp_path / "m"))
    stats = P.convert(spark, *src, root)
    raw = view(spark, SF, "fx_raw_origination")
    assert stats.orig_raw == raw.count()
    assert stats.orig_kept == raw.where("term_months = '360' AND amort_type = 'FRM'").count()
    assert 0 < stats.monthly_kept < stats.monthly_raw
    assert P.derive_outcomes(spark, root).count() == 2
    assert passed(P.validate(spark, root, src[0]))

    again = P.convert(spark, *src, root)
    assert (again.orig_raw, again.monthly_raw) == (0, 0)
    assert spark.read.parquet(f"{root}/monthly").count() == stats.monthly_kept
    spark.read.parquet(f"{root}/monthly").limit(3).select(
        F.lit("stray").alias(K.ID), *[c for c in spark.read.parquet(f"{root}/monthly").columns
                                      if c != K.ID]).write.mode("append").partitionBy(
        *P.KEYS).parquet(f"{root}/monthly")
    assert not passed(P.validate(spark, root))


def test_new_quarters_open_no_old_file(spark, tmp_path):
    for d in ("o", "m"):
        (tmp_path / d).mkdir()
    root, parts = str(tmp_path / "out"), halves("loan_seq_num")
    src = (str(tmp_path / "o"), str(tmp_path / "m"))
    seen = []
    for quarter, cond in parts.items():
        write_quarters(spark, tmp_path / "o", "fx_raw_origination", K.ORIGINATION_RAW, "loans",
                       {quarter: cond})
        write_quarters(spark, tmp_path / "m", "fx_raw_monthly", K.MONTHLY_RAW, "loans_time",
                       {quarter: cond})
        seen.append(P.convert(spark, *src, root))
        P.derive_outcomes(spark, root)
        # What is stored is not needed any more: a broken old file would fail if it were read.
        (tmp_path / "o" / f"loans_{quarter}.txt").write_bytes(b"\xff")
        (tmp_path / "m" / f"loans_time_{quarter}.txt").write_bytes(b"\xff")
    assert all(s.orig_kept and s.monthly_kept for s in seen)
    stored = spark.read.parquet(f"{root}/monthly")
    assert stored.count() == sum(s.monthly_kept for s in seen)
    assert spark.read.parquet(f"{root}/outcomes").count() == sum(s.orig_kept for s in seen)
    _, panel = P.undone(spark, root, force=True)
    plan = panel._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "vintage_year" in plan.split("PartitionFilters: [")[1]


def test_half_written_and_empty_quarters(spark, tmp_path, monkeypatch):
    for d in ("o", "m"):
        (tmp_path / d).mkdir()
    root, parts = str(tmp_path / "out"), halves("loan_seq_num")
    src = (str(tmp_path / "o"), str(tmp_path / "m"))
    write_quarters(spark, tmp_path / "o", "fx_raw_origination", K.ORIGINATION_RAW, "loans", parts)
    write_quarters(spark, tmp_path / "m", "fx_raw_monthly", K.MONTHLY_RAW, "loans_time", parts)
    # A third quarter whose loans all go in cleaning.
    write_quarters(spark, tmp_path / "o", "fx_raw_origination", K.ORIGINATION_RAW, "loans",
                   {"2006Q3": F.expr("term_months <> '360'")})
    (tmp_path / "m" / "loans_time_2006Q3.txt").write_text("")

    write = P.write_table

    def dies(df, path, *rest):
        if path.endswith("monthly"):
            write(df.where("vintage_quarter = 1").limit(5), path, *rest)
            raise RuntimeError("driver lost")
        write(df, path, *rest)
    monkeypatch.setattr(P, "write_table", dies)
    with pytest.raises(RuntimeError):
        P.convert(spark, *src, root)
    monkeypatch.setattr(P, "write_table", write)
    assert partitions(spark, f"{root}/origination", P.KEYS) == {(2006, 1), (2006, 2), (2006, 3)}
    assert partitions(spark, f"{root}/monthly", P.KEYS) == set()
    assert P.undone(spark, root)[0].count() == 0

    again = P.convert(spark, *src, root)
    assert again.orig_raw == 0 and again.monthly_kept > 5
    assert spark.read.parquet(f"{root}/monthly").count() == again.monthly_kept
    P.derive_outcomes(spark, root)
    assert passed(P.validate(spark, root))
    assert partitions(spark, f"{root}/outcomes", P.KEYS) == {(2006, 1), (2006, 2), (2006, 3)}
    third = P.convert(spark, *src, root)
    assert (third.orig_raw, third.monthly_raw) == (0, 0)

    old = str(tmp_path / "old")
    write_table(spark.read.parquet(f"{root}/origination"), old, P.KEYS)
    assert partitions(spark, old, P.KEYS) == set()
    adopt(spark, old, P.KEYS)
    adopt(spark, str(tmp_path / "none"), P.KEYS)
    assert partitions(spark, old, P.KEYS) == {(2006, 1), (2006, 2)}


def test_a_name_without_quarter_and_a_damaged_table_are_errors(spark, tmp_path):
    (tmp_path / "o").mkdir()
    (tmp_path / "o" / "loans.txt").write_text("x\n")
    with pytest.raises(ValueError):
        P.convert(spark, str(tmp_path / "o"), str(tmp_path / "o"), str(tmp_path / "out"))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception, match="(?i)parquet|read"):
        existing_partitions(spark, str(tmp_path / "bad"), P.KEYS)
    assert existing_partitions(spark, str(tmp_path / "none"), P.KEYS) is None


def test_an_empty_table_can_be_read_back(spark, tmp_path):
    empty = spark.createDataFrame([], "vintage_year int, vintage_quarter short, x string")
    write_table(empty, str(tmp_path / "t"), P.KEYS)
    assert spark.read.parquet(str(tmp_path / "t")).columns == empty.columns
    more = spark.createDataFrame([(2006, 1, "a")], empty.schema)
    write_table(more, str(tmp_path / "t"), P.KEYS)
    assert spark.read.parquet(str(tmp_path / "t")).select("x", "vintage_year").collect() == [
        ("a", 2006)]
