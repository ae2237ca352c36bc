"""Cleaning, typing, binning, scans and sinks on hand-made rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from loanlife import columns as K
from loanlife.functions import binning as B
from loanlife.functions import cleaning as C
from loanlife.functions.tails import chi2_tail, normal_two_sided
from loanlife.sources import sinks, tables, text


def values(df, c):
    return [r[c] for r in df.collect()]


def test_blank_and_sentinels(spark):
    df = spark.createDataFrame([("9999", " "), (" 9999", "x "), (None, "")], "fico string, z string")
    out = C.null_sentinels(C.blank_to_null(df), K.ORIGINATION_SENTINELS)
    assert values(out, "fico") == [None, " 9999", None]
    assert values(out, "z") == [None, "x ", None]


def test_yyyymm(spark):
    df = spark.createDataFrame([("200602",), ("200613",), (" 200601 ",), ("2006",), (None,)], "m string")
    assert values(df.select(C.yyyymm_to_date(F.col("m")).alias("d")), "d") == [
        datetime.date(2006, 2, 1), None, datetime.date(2006, 1, 1), None, None]


def test_typed_cast_ranges(spark):
    df = spark.createDataFrame([("255",), ("256",), ("-1",), ("x",), ("3.0",)], "v string")
    assert values(df.select(C.typed_cast(F.col("v"), K.U8).alias("v")), "v") == [
        255, None, None, None, None]
    assert dict(df.select(C.typed_cast(F.col("v"), K.U32).alias("v")).dtypes)["v"] == "bigint"


def test_cut_is_right_closed(spark):
    df = spark.createDataFrame([(659.0,), (660.0,), (660.5,), (781.0,), (None,)], "x double")
    assert values(df.select(B.cut(F.col("x"), *K.BINS["fico"]).alias("b")), "b") == [
        "<660", "<660", "660-700", "780+", None]
    with pytest.raises(ValueError):
        B.cut(F.col("x"), [1], ["a"])


def test_label_groups_first_match_wins(spark):
    df = spark.createDataFrame([(1,), (5,), (9,)], "x int")
    out = B.label_groups(df, {"low": F.col("x") < 6, "odd": F.col("x") == 5}, "g")
    assert values(out, "g") == ["low", "low"]


def test_tails():
    assert abs(chi2_tail(3.841458820694124, 1) - 0.05) < 1e-12
    assert abs(chi2_tail(9.487729036781154, 4) - 0.05) < 1e-12
    assert abs(chi2_tail(7.814727903251179, 3) - 0.05) < 1e-12
    assert abs(normal_two_sided(1.959963984540054) - 0.05) < 1e-12


def test_ragged_text(spark, tmp_path):
    path = tmp_path / "raw.txt"
    path.write_text("a|b|c\na|b\na||c|extra\n")
    rows = text.scan_raw(spark, str(path), ["x", "y", "z"]).collect()
    assert [tuple(r) for r in rows] == [("a", "b", "c"), ("a", "b", None), ("a", None, "c")]


def test_missing_partitions_only(spark, tmp_path):
    path = str(tmp_path / "t")
    keys = ["vintage_year"]
    one = spark.createDataFrame([(1, 2006), (2, 2007)], "loan_seq_num int, vintage_year int")
    assert sinks.write_missing_partitions(one, path, keys) == [(2006,), (2007,)]
    two = spark.createDataFrame([(9, 2007), (3, 2008)], "loan_seq_num int, vintage_year int")
    assert sinks.write_missing_partitions(two, path, keys) == [(2008,)]
    assert sorted(values(spark.read.parquet(path), "loan_seq_num")) == [1, 2, 3]
    assert sinks.write_missing_partitions(two, path, keys, force=True) == [(2007,), (2008,)]
    assert sorted(values(spark.read.parquet(path), "loan_seq_num")) == [1, 3, 9]


def test_load_table_prunes_partitions(spark, tmp_path):
    df = spark.createDataFrame([(1, 5.0, 2006), (2, 6.0, 2007)],
                               "loan_seq_num int, orig_rate double, vintage_year int")
    sinks.write_table(df, str(tmp_path / "origination"))
    got = tables.load_table(spark, str(tmp_path), "origination", [2007], ["loan_seq_num"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [vintage_year" in plan.replace("isnotnull(", "") or \
        "vintage_year#" in plan.split("PartitionFilters")[1]
    assert values(got, "loan_seq_num") == [2]
    with pytest.raises(FileNotFoundError):
        tables.load_table(spark, str(tmp_path), "origination", [])


def test_empty_write_keeps_schema(spark, tmp_path):
    df = spark.createDataFrame([], "loan_seq_num int, x double")
    sinks.write_table(df, str(tmp_path / "e"), partition_by=[])
    assert spark.read.parquet(str(tmp_path / "e")).dtypes == [("loan_seq_num", "int"), ("x", "double")]
