"""Scratch tables are deleted on demand, and nothing else is."""

import os

from loanlife import support


def folders(spark):
    root = support.shared_folder(spark).removeprefix("file:")
    return {f for f in os.listdir(root) if f.startswith("scratch-test")}


def test_discard_and_clear(spark, tmp_path):
    own = str(tmp_path / "own")
    spark.range(5).write.parquet(own)
    a, b = (support.materialize(spark.range(10), f"scratch-test-{n}") for n in "ab")
    assert len(folders(spark)) == 2
    support.discard(a.where("id > 3").union(spark.read.parquet(own)))
    assert len(folders(spark)) == 1 and b.count() == 10
    assert spark.read.parquet(own).count() == 5
    support.discard(spark.range(3))
    empty = support.materialize(spark.range(0), "scratch-test-c")
    assert empty.count() == 0
    before = spark.newSession()
    assert support.clear_scratch(before) >= 2
    assert folders(spark) == set() and support.clear_scratch(spark) == 0
    assert spark.read.parquet(own).count() == 5
