"""Rows kept in the executors: blocks, packing and what fits make of them."""

import numpy as np
import pytest

from loanlife.columns import EVENT, ID, TIME
from loanlife.operators import resident
from loanlife.operators.cox import Design
from loanlife.operators.neural import MlpWeights, Trainer, month_sums, row_key
from loanlife.operators.resident import BLOCK, ResidentRows, partition_count


def loans(spark, n=1500, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, int(rng.integers(1, 9)), int(rng.integers(0, 2)), float(rng.normal()),
             float(i % 2), float(rng.integers(0, 1000))) for i in range(n)]
    return spark.createDataFrame(rows, f"{ID} bigint, {TIME} int, {EVENT} int, a double, b double, c double")


def test_every_core_gets_the_same_number_of_partitions():
    assert partition_count(765_000, 12, 4_000) == 24
    assert [partition_count(n, 12, 4_000) for n in (0, 4_001, 10 ** 5, 600_000)] == [1, 2, 12, 12]


def test_narrow_columns_come_back_as_they_were():
    x = np.array([[1.0, 0.5, -127.0, 128.0, np.nan], [0.0, 2.0, 3.0, 1.0, 1.0], [1.0, 1.0, 0.0, 0.0, 0.0]])
    packed = resident._narrow(x)
    assert packed[0].tolist() == [0, 2]
    assert np.array_equal(resident._wide(packed, 0, 9), x, equal_nan=True)
    assert np.array_equal(resident._wide(packed, 1, 2), x[1:2])
    assert resident._wide(resident._narrow(np.zeros((0, 2))), 0, 9).shape == (0, 2)


def test_passes_work_on_blocks_and_add_up(spark):
    df = loans(spark)
    design = Design(df, TIME, EVENT, [df["a"], df["b"], df["c"]])
    rows = ResidentRows(design.rows, 3)
    try:
        most = rows.total(lambda x, t, e: np.array([len(x) > BLOCK, len(x), x[:, 1].sum(), x[:, 2].sum()]))
        want = df.toPandas()
        assert most.tolist() == [0, len(want), want.b.sum(), want.c.sum()]
        months, sums = rows.month_table(lambda x, t, e: np.stack([x[:, 2], e, x[:, 1]], axis=1))
        by = want.groupby(TIME)[["c", EVENT, "b"]].sum()
        assert months.tolist() == by.index.tolist() and np.array_equal(sums, by.to_numpy())
    finally:
        rows.close()
        design.close()


def test_first_layer_statistics_need_no_pass_of_their_own(spark, monkeypatch):
    df = loans(spark)
    w = MlpWeights.init(2, (5, 4), dropout=0.1)
    design = Design(df, TIME, EVENT, [df["a"], df["b"], row_key(ID)])
    rows = ResidentRows(design.rows, 3)
    try:
        trainer = Trainer(rows, 2, w, "efron")
        trainer.batch_stats(1)
        passes, total = [], rows.total
        monkeypatch.setattr(rows, "total", lambda block: passes.append(1) or total(block))
        stats, n = trainer.batch_stats(2)
        pre = df.select("a", "b").toPandas().to_numpy() @ w.arrays["W0"] + w.arrays["b0"]
        assert n == 1500 and len(passes) == 1
        assert np.allclose(stats[0], [pre.mean(axis=0), pre.var(axis=0)], atol=1e-12)
    finally:
        rows.close()
        design.close()


def test_cox_passes_read_the_arrays_only(spark):
    """Newton steps need the table once; a constant feature keeps its exact spread of zero."""
    df = loans(spark).selectExpr("*", "0.1D AS flat")
    design = Design(df, TIME, EVENT, [df["a"], df["flat"]])
    try:
        n, events, mean, sd = design.moments()
        design.rows = None
        sums = design.month_sums(lambda x: (x - mean, np.zeros(len(x))), 2)
        want = df.toPandas()
        assert (n, sd[1]) == (len(want), 0.0) and sums.d.sum() == events == want[EVENT].sum()
        assert sums.s0.tolist() == [(want[TIME] >= m).sum() for m in sums.t]
        sums.solve_ties(True)
        assert design.gram(lambda x: (x - mean, np.zeros(len(x))), 2, sums).shape == (2, 2)
    finally:
        design.held.close()


def test_compared_models_share_their_stored_loans(spark, monkeypatch):
    import __spark_entry__ as entry
    from loanlife.plans import modelling
    stored, real = [], modelling.materialize
    monkeypatch.setattr(modelling, "materialize", lambda df, name: stored.append(name) or real(df, name))
    monkeypatch.setattr(modelling, "compare_models", lambda spark, models: spark.range(1))
    monkeypatch.setattr(modelling, "cox_fit", lambda *a, **k: None)
    entry.queries()["model_comparison"](spark, "/root/testdata/sf0.001")
    assert sorted(stored) == ["design", "design", "model-macro-rows"]


@pytest.mark.parametrize("hidden,passes", [((4,), 2), ((5, 4), 3), ((6, 5, 4), 4), ((5, 4, 4, 3), 6)])
def test_an_epoch_needs_few_passes(spark, monkeypatch, hidden, passes):
    """Sums of the norms come with the risk sums and the gradients; layer by layer they are the same."""
    df = loans(spark)
    w = MlpWeights.init(2, hidden, dropout=0.1)
    design = Design(df, TIME, EVENT, [df["a"], df["b"], row_key(ID)])
    rows = ResidentRows(design.rows, 3)
    try:
        trainer = Trainer(rows, 2, w, "efron")
        trainer.gradient(1)
        made, add_up = [], resident.add_up
        monkeypatch.setattr(resident, "add_up", lambda *a: made.append(1) or add_up(*a))
        loss, grads, stats, n = trainer.gradient(2)
        assert len(made) == passes

        t, e, x = rows.rdd.map(lambda own: own).collect()[0]
        x = resident._wide(x, 0, n)
        f, last, tape = w.forward(x[:, :2], x[:, 2], 2, stats)
        sums = month_sums(*rows.month_table(lambda x, t, e: np.stack(
            [v := np.exp(w.forward(x[:, :2], x[:, 2], 2, stats)[0]), v * e, np.log(v) * e, e], axis=1)))
        sums.solve_ties(True)
        a, b = sums.row_weights()
        at = np.searchsorted(sums.t, t)
        g = -(e - np.exp(f) * (a[at] - e * b[at])) / e.sum()
        known = [None] * len(hidden)
        for i in reversed(range(len(hidden))):
            got = w.backward(g, last, tape, stats, known, n, i)
            known[i] = (got[f"c{i}"], got[f"g{i}"])
        want = w.backward(g, last, tape, stats, known, n)
        assert set(want) == set(grads)
        for k, v in want.items():
            assert np.allclose(grads[k], v, rtol=1e-9, atol=1e-12), k
    finally:
        rows.close()
        design.close()


def test_rows_are_packed_before_they_are_dealt_out(spark, monkeypatch):
    """Equal rows fill all partitions alike, and the table is read once, whatever it costs to make."""
    monkeypatch.setattr(resident, "LEAST_ROWS", 400)
    monkeypatch.setattr(resident, "PIECE_ROWS", 50)
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b
    df = loans(spark, 1600).selectExpr(ID, f"5 AS {TIME}", EVENT, "1.5D AS a", "2.0D AS b")
    df = df.repartition(3).mapInArrow(seen, df.schema)
    design = Design(df, TIME, EVENT, [df["a"], df["b"]])
    try:
        n, events, mean, sd = design.moments()
        held = [len(t) for t, e, x in design.held.rdd.collect()]
        assert (n, sum(held), len(held)) == (1600, 1600, 4) and max(held) <= 500
        assert read.value == 1600 and mean.tolist() == [1.5, 2.0] and sd.tolist() == [0.0, 0.0]
    finally:
        design.close()


def test_moments_are_those_of_the_values_there_are(spark, monkeypatch):
    monkeypatch.setattr(resident, "LEAST_ROWS", 100)
    df = loans(spark).selectExpr(ID, TIME, EVENT, "IF(a > 1, NULL, a) AS a", "c + 1e6 AS c", "0.1D AS flat")
    want = df.select("a", "c", "flat").toPandas()
    design = Design(df, TIME, EVENT, [df["a"], df["c"], df["flat"]])
    try:
        n, events, mean, sd = design.moments()
        assert n == 1500 and events == df.where(f"{EVENT} = 1").count()
        assert np.allclose(mean, want.mean(), rtol=1e-13) and np.allclose(sd, want.std(), rtol=1e-11)
        assert sd[2] == 0.0
    finally:
        design.close()
    gone = df.selectExpr(ID, TIME, EVENT, "CAST(NULL AS DOUBLE) AS a")
    for rows, message in ((gone, "no values"), (gone.limit(0), "no complete rows")):
        with pytest.raises(ValueError, match=message):
            Design(rows, TIME, EVENT, [rows["a"]]).moments()


@pytest.mark.parametrize("few", [0, 16])
def test_products_per_month_are_sums_of_products(spark, monkeypatch, few):
    monkeypatch.setattr(resident, "FEW_MONTHS", few)
    df = loans(spark)
    design = Design(df, TIME, EVENT, [df["a"], df["c"]])
    try:
        months, got = design.held.month_products(
            lambda x, t, e: (e[:, None], np.stack([e, x[:, 1]], axis=1), x))
        for m, row in zip(months, got):
            at = df.where(f"{TIME} = {int(m)}").toPandas()
            want = [at[EVENT].sum(), *(at[w] @ at[z] for w in (EVENT, "c") for z in ("a", "c"))]
            assert np.allclose(row, want)
    finally:
        design.close()
