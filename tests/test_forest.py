"""Forests against direct growth of single trees on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanlife.operators import classify, forest
from loanlife.operators.trees import Trees


def table(spark, n=3000, seed=3):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 12, n), rng.normal(size=n).round(3), rng.integers(0, 2, n),
                         rng.uniform(size=n).round(2)])
    chance = 1 / (1 + np.exp(-(0.6 * (x[:, 0] - 6) + x[:, 1] * (2 * x[:, 2] - 1))))
    y = (rng.uniform(size=n) < chance).astype(int)
    rows = [(int(b), *map(float, a)) for a, b in zip(x, y)]
    df = spark.createDataFrame(rows, "y int, a double, b double, c double, d double").repartition(5)
    return classify.assemble(df, list("abcd")), x, y


def direct(x, y, edges, depth, min_leaf):
    """One tree on all rows and features: share of ones per row, and the gain of each feature; leaves of
    one parent that predict the same class are merged."""
    gini = lambda v: 2 * v.mean() * (1 - v.mean())
    gains = np.zeros(x.shape[1])

    def node(rows, left):
        best = (0.0, None, None)
        if left and 0 < y[rows].mean() < 1:
            for f in range(x.shape[1]):
                for cut in edges[f]:
                    low = x[rows, f] <= cut
                    a, b = rows[low], rows[~low]
                    if min(len(a), len(b)) >= min_leaf:
                        gain = gini(y[rows]) - (len(a) * gini(y[a]) + len(b) * gini(y[b])) / len(rows)
                        if gain > best[0] + 1e-12:
                            best = (gain, f, cut)
        gain, f, cut = best
        if f is None:
            return [(rows, y[rows].mean())], []
        low = x[rows, f] <= cut
        (a, got), (b, more) = node(rows[low], left - 1), node(rows[~low], left - 1)
        if len(a) == len(b) == 1 and (a[0][1] > 0.5) == (b[0][1] > 0.5):
            return [(rows, y[rows].mean())], []
        return a + b, [*got, *more, (f, gain * len(rows))]

    leaves, used = node(np.arange(len(y)), depth)
    p = np.zeros(len(y))
    for rows, share in leaves:
        p[rows] = share
    for f, g in used:
        gains[f] += g
    return p, gains / gains.sum()


def test_a_tree_on_all_rows_is_a_direct_tree(spark, monkeypatch):
    data, x, y = table(spark)
    monkeypatch.setattr(forest, "_draws", lambda n, seed, tree, part: np.ones(n, np.uint8))
    n, edges = forest.bin_edges(data.select(F.col("y").cast("double"), F.array(*"abcd").alias("x")))
    monkeypatch.setattr(forest, "bin_edges", lambda given: (n, edges))
    model = forest.grow_forest(data, "y", "features", 2, 5, 40, 42, chosen=4)
    assert [len(e) for e in edges] == [11, 31, 1, 31]
    p, gains = direct(x, y, edges, 5, 40)
    assert np.allclose(model.probability(x), p, atol=1e-12)
    assert np.allclose(model.importance(4), gains, atol=1e-9)


def test_draws_are_poisson_and_differ_by_tree_and_partition():
    a, b, c = (forest._draws(200_000, 42, *at).astype(int) for at in ((0, 0), (1, 0), (0, 1)))
    assert abs(a.mean() - 1) < 0.01 and abs(a.var() - 1) < 0.02 and abs((a == 0).mean() - np.exp(-1)) < 0.005
    assert abs(np.corrcoef(a, b)[0, 1]) < 0.01 and abs(np.corrcoef(a, c)[0, 1]) < 0.01
    assert (forest._draws(200_000, 42, 0, 0) == a).all()


def test_forest_agrees_with_the_library_and_is_stored(spark, tmp_path):
    from pyspark.ml.classification import RandomForestClassifier
    data, x, y = table(spark, 6000)
    ours = classify.fit_forest(data, "y", trees=60, depth=6, min_leaf=30)
    lib = RandomForestClassifier(labelCol="y", numTrees=60, maxDepth=6, minInstancesPerNode=30, seed=42,
                                 featureSubsetStrategy="sqrt").fit(data)
    both = classify.score(lib, classify.score(ours, data, list("abcd"), "p"), list("abcd"), "q")
    p, q = np.array(both.select("p", "q").collect()).T
    assert np.corrcoef(p, q)[0, 1] > 0.99 and abs(p - q).mean() < 0.02
    assert np.allclose(ours.importance(4), lib.featureImportances.toArray(), atol=0.05)
    classify.save_model(ours, str(tmp_path / "f"))
    again = classify.load_model(str(tmp_path / "f"))
    assert np.allclose(again.probability(x), ours.probability(x)) and (again.gain == ours.gain).all()


def test_rows_leave_the_executors_as_counts_only(spark, monkeypatch):
    """A level is one pass over rows that keep their places, and partitions are no more than the cores."""
    parts, real = [], forest.held
    monkeypatch.setattr(forest, "held", lambda rows, n, pack: parts.append(n) or real(rows, n, pack))
    data, x, y = table(spark, 20_000)
    wide = data.union(data)
    assert isinstance(classify.fit_forest(wide, "y", trees=2, depth=3, min_leaf=30), Trees)
    assert parts == [min(spark.sparkContext.defaultParallelism, 10)]


def test_small_and_odd_tables(spark):
    data, x, y = table(spark, 100)
    model = classify.fit_forest(data, "y", trees=5, depth=4)          # fewer rows than a leaf needs
    assert len(model.tree) == 5 and (model.importance(4) == 0).all()
    one = classify.fit_forest(data.where("y = 1"), "y", trees=3, min_leaf=5)
    assert one.probability(x)[0] == pytest.approx(1.0)
    for bad in (data.where("y > 1"), data.withColumn("y", F.lit(None).cast("int")),
                data.withColumn("y", F.lit(2))):
        with pytest.raises(ValueError):
            classify.fit_forest(bad, "y", trees=2)


def test_metrics_score_every_row_once(spark):
    """The metrics read scores three times; the trees are walked once a row."""
    from loanlife.plans.evaluation import _metrics
    walked = spark.sparkContext.accumulator(0)

    def chance(v):
        walked.add(1)
        return v / 12

    rows = table(spark, 500)[0].select(F.lit("test").alias("split"), F.col("y").alias("label"),
                                       F.udf(chance, "double")("a").alias("p"))
    assert _metrics(rows, "m").first()["n"] == 500 and walked.value == 500


def test_scaling_and_logistic_scores_are_generated_in_small_methods(spark):
    """One long method is interpreted; the results are those of the plain expressions."""
    from loanlife.operators.features import Preprocessor
    names = [f"f{i}" for i in range(50)]
    df = spark.range(200).select((F.col("id") % 2).cast("int").alias("label"), *(
        F.when(F.col("id") % 97 != i, (F.col("id") * (i + 3) % 17).cast("double")).alias(n)
        for i, n in enumerate(names))).localCheckpoint()
    full = df.dropna()
    prep = Preprocessor.fit(full, names, [], fill_gaps=False)
    scaled = prep.transform(df, ["label"])
    assert "transform(" in scaled._jdf.queryExecution().executedPlan().toString()
    plain = df.select("label", *(e.alias(n) for n, e in prep.items()))
    assert scaled.collect() == plain.collect()
    model = classify.fit_logistic(classify.assemble(scaled.dropna(), names), "label", max_iter=10)
    margin = F.lit(float(model.intercept))
    for n, b in zip(names, model.coefficients.toArray()):
        if b:
            margin = margin + F.col(n) * F.lit(float(b))
    want = plain.select((1 / (1 + F.exp(-margin))).alias("p")).collect()
    scored = classify.score(model, scaled, names).select("p")
    assert "aggregate(" in scored._jdf.queryExecution().executedPlan().toString()
    assert scored.collect() == want and any(r.p is None for r in want)
