import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from panelwise.operators import attribution, balance, encode, impute, models, neighbours, network, tuning
from panelwise.session import cut_for_fitting


def people(spark, n, seed=1, copies=0):
    rng = random.Random(seed)
    rows = [(i, rng.gauss(0, 1), rng.uniform(0, 50), rng.randrange(3), rng.randrange(2)) for i in range(n)]
    rows += [(n + j, *rows[0][1:]) for j in range(copies)]
    return rows, spark.createDataFrame(rows, "id long, a double, b double, c int, d int")


@pytest.mark.parametrize("block", [7, 2000])
def test_neighbours_equal_brute_force(spark, monkeypatch, block):
    """With small blocks, and with a third of all rows being copies of one row."""
    monkeypatch.setattr(neighbours, "BLOCK", block)
    rows, df = people(spark, 120, copies=60)
    k = 5
    span_a = max(r[1] for r in rows) - min(r[1] for r in rows)
    span_b = max(r[2] for r in rows) - min(r[2] for r in rows)

    def d2(x, y):
        da, db = x[1] / span_a - y[1] / span_a, x[2] / span_b - y[2] / span_b
        return da * da + db * db + (x[3] != y[3]) + (x[4] != y[4])

    want = {}
    for x in rows:
        near = sorted((d2(x, y), y[0]) for y in rows if y[0] != x[0])[:k]
        want[x[0]] = [i for _, i in near]
    got = {}
    for r in neighbours.nearest_neighbours(df, "id", ["a", "b"], ["c", "d"], k).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbour_id"])
    assert got == want


def test_smote_rows_lie_between_and_counts_hold(spark):
    rows, df = people(spark, 200)
    df = df.withColumn("y", (F.col("id") % 5 == 0).cast("int"))
    out = balance.smote(df, "y", "id", ["a", "b"], ["c"], over=4, under=3, k=5, seed=2).persist()
    n = {r["kind"]: r["count"] for r in out.groupBy("kind").count().collect()}
    assert n == {"original": 40, "synthetic": 160, "common": 480}
    near = neighbours.nearest_neighbours(df.where("y = 1"), "id", ["a", "b"], ["c"], 5)
    by_id = {r[0]: r for r in rows}
    nbs = {}
    for r in near.collect():
        nbs.setdefault(r["id"], []).append(r["neighbour_id"])
    for r in out.where("kind = 'synthetic'").collect():
        s = by_id[r["id"]]
        assert any(
            min(s[1], t[1]) - 1e-9 <= r["a"] <= max(s[1], t[1]) + 1e-9
            and min(s[2], t[2]) - 1e-9 <= r["b"] <= max(s[2], t[2]) + 1e-9 and r["c"] in (s[3], t[3])
            for t in (by_id[i] for i in nbs[r["id"]])
        )


def test_imputation_fills_all_and_keeps_observed(spark):
    rows, df = people(spark, 200)
    gaps = df.withColumns({
        "b": F.when(F.col("id") % 7 != 0, F.col("a") * 10), "c": F.when(F.col("id") % 5 != 0, F.col("c")),
    })
    for out in (
        impute.sample_impute(gaps, "id", ["b", "c"]),
        impute.forest_impute(gaps, "id", ["a", "b"], ["c", "d"], max_iter=2, trees=10, seed=3),
    ):
        assert out.where("b IS NULL OR c IS NULL").count() == 0
        both = out.select("id", F.col("b").alias("b2"), F.col("c").alias("c2")).join(gaps, "id")
        assert both.count() == 200
        assert both.where("(b IS NOT NULL AND b <> b2) OR (c IS NOT NULL AND c <> c2)").count() == 0
    err = both.where("b IS NULL").agg(F.avg(F.abs(F.col("b2") - F.col("a") * 10))).first()[0]
    assert err < 3  # b follows from a, and the forest finds that


def test_multiple_imputation_stacks_runs(spark):
    _, df = people(spark, 60)
    gaps = df.withColumn("b", F.when(F.col("id") % 3 != 0, F.col("b")))
    out = impute.multiple_impute(lambda seed: impute.sample_impute(gaps, "id", ["b"], {1: seed}).drop("imp"), runs=3, parallel=2)
    assert {r["imp"]: r["count"] for r in out.groupBy("imp").count().collect()} == {1: 60, 2: 60, 3: 60}
    spread = out.where("id % 3 = 0").groupBy("id").agg(F.count_distinct("b").alias("k"))
    assert spread.where("k > 1").count() > 10


def test_one_hot_keeps_all_levels_and_survives_unknown_ones(spark):
    df = spark.createDataFrame([(1, 1), (2, 3), (3, None)], "id int, c int")
    hot = encode.one_hot(df, {"c": [1, 2]})
    assert hot.columns == ["id", "c_1", "c_2"]
    assert [tuple(r) for r in hot.collect()] == [(1, 1.0, 0.0), (2, 0.0, 0.0), (3, 0.0, 0.0)]


@pytest.fixture(scope="module")
def design(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        a, b, c = rng.gauss(0, 1), rng.gauss(0, 2), rng.gauss(5, 1)
        rows.append((i, float(rng.random() < 1 / (1 + math.exp(-(2 * a - b)))), Vectors.dense([a, b, c])))
    return cut_for_fitting(spark.createDataFrame(rows, ["row_id", "label", "features"]))


def share_right(scored):
    return tuning.accuracy(scored).first()["accuracy"]


def test_lasso_path(design, spark):
    top = models.largest_penalty(design)
    flat = models.logistic_l1(design, {"penalty": top * 1.02}).slopes
    some = models.logistic_l1(design, {"penalty": top * 0.9}).slopes
    assert not np.any(flat) and np.any(some)
    tuned = models.lasso_cv(design, "row_id", [1e10, 1.0, 0.1, 0.01], folds=3)
    assert tuned.chosen["penalty"] < 1 and share_right(tuned.scorer(design)) > 0.75
    assert [c["penalty"] for c in tuned.candidates] == [1e10, 1.0, 0.1, 0.01] and len(tuned.results) == 12
    coef = {r["feature"]: r["coef"] for r in models.coefficients(tuned.scorer, ["a", "b", "c"], spark).collect()}
    assert coef["a"] > 0 > coef["b"]


def test_svm_and_platt(design):
    assert share_right(models.linear_svm(design, {"cost": 1.0})(design)) > 0.75
    p = models.platt_svm(design, "row_id", 1.0, 3)(design)
    assert share_right(p) > 0.75 and p.agg(F.corr("p", "margin")).first()[0] > 0.5
    assert p.agg(F.avg(F.col("p") - F.col("label"))).first()[0] == pytest.approx(0, abs=0.05)


def test_network_learns_and_decay_shrinks(design):
    free = network.fit_network(design, {"size": 3, "decay": 0.001}, 40)
    tight = network.fit_network(design, {"size": 3, "decay": 10.0}, 40)
    assert share_right(free(design)) > 0.75
    assert np.abs(tight.weights).sum() < np.abs(free.weights).sum()


def test_network_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(0)
    x1, y, size = np.hstack([rng.normal(size=(20, 3)), np.ones((20, 1))]), rng.integers(0, 2, 20).astype(float), 2
    w = rng.normal(size=4 * size + size + 1)

    def loss(v):
        p = network._forward(v, x1, size)[1]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()

    g = network._gradient(w, x1, y, size)
    for i in range(len(w)):
        step = np.zeros(len(w))
        step[i] = 1e-6
        assert g[i] == pytest.approx((loss(w + step) - loss(w - step)) / 2e-6, abs=1e-4)


def test_search_trains_candidates_together(design):
    tuned = network.tune_network(design, "row_id", [{"size": 2, "decay": 0.01}, {"size": 1, "decay": 200.0}], 2, 25)
    assert len(tuned.results) == 4 and tuned.chosen["size"] == 2


def test_shap_adds_up_and_equals_the_definition(design):
    fit = models.boosted_trees(design, {"nrounds": 4, "max_depth": 3, "eta": 0.3})
    trees = attribution.trees_of(fit.model, design.sparkSession)
    shap = attribution.shap_values(design, "row_id", fit.model, ["a", "b", "c"])
    margin = fit(design).select("row_id", F.log(F.col("p") / (1 - F.col("p"))).alias("margin"))
    off = shap.groupBy("row_id").agg(F.sum("shap").alias("s")).join(margin, "row_id")
    gap = off.agg(F.max(F.abs(F.col("s") + attribution.base_value(trees) - F.col("margin")))).first()[0]
    assert gap < 1e-9

    # one row by the definition: average over all orders of learning the features
    def value(known, x, node):
        if node.getClass().getSimpleName() == "LeafNode":
            return node.prediction()
        f, at = node.split().featureIndex(), node.split().threshold()
        left, right = node.leftChild(), node.rightChild()
        if f in known:
            return value(known, x, left if x[f] <= at else right)
        n = node.impurityStats().count()
        return (left.impurityStats().count() * value(known, x, left) + right.impurityStats().count() * value(known, x, right)) / n

    x = design.where("row_id = 5").first()["features"].toArray()
    want = np.zeros(3)
    orders = list(itertools.permutations(range(3)))
    for tree, weight in zip(fit.model.trees, fit.model.treeWeights):
        root = tree._java_obj.rootNode()
        for order in orders:
            for i, f in enumerate(order):
                want[f] += 2 * weight * (value(set(order[: i + 1]), x, root) - value(set(order[:i]), x, root)) / len(orders)
    got = {r["feature"]: r["shap"] for r in shap.where("row_id = 5").collect()}
    assert [got["a"], got["b"], got["c"]] == pytest.approx(list(want))
    top = attribution.shap_summary(shap, 2).collect()
    assert {r["feature"] for r in top} == {"a", "b"}


def test_neighbours_take_text_and_refuse_null(spark):
    schema = "id long, a double, c string"
    df = spark.createDataFrame([(1, 0.0, "x"), (2, 0.1, "y"), (3, 1.0, "x"), (4, 0.9, "y")], schema)
    got = neighbours.nearest_neighbours(df, "id", ["a"], ["c"], 1).orderBy("id").collect()
    assert [r["neighbour_id"] for r in got] == [3, 4, 1, 2]
    with pytest.raises(ValueError, match="NULL"):
        neighbours.nearest_neighbours(df.unionByName(spark.createDataFrame([(5, None, "x")], schema)), "id", ["a"], ["c"], 1)


def test_networks_of_all_folds_are_scored_in_one_pass(spark, design):
    """The accuracies of scoring each network alone, in one aggregate of the table; an empty fold has none."""
    folded = tuning.with_folds(design, "row_id", 3).cache()
    nets = [network.Net(size, 0.1, fold) for size in (1, 2) for fold in (0, 1, 2, 7)]
    scorers = network.fit_networks(folded, nets, 5)
    spark.sparkContext.setJobGroup("scored", "scored")
    got = network.fold_accuracy(folded, nets, scorers)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("scored"))
    spark.sparkContext.setJobGroup("rest", "rest")
    want = [tuning.accuracy(s(folded.where(F.col("fold") == n.without_fold))).first() for n, s in zip(nets, scorers)]
    assert [(a, n) for a, n in got] == [(pytest.approx(w["accuracy"]) if w["n"] else None, w["n"]) for w in want] and jobs < len(nets)


def test_a_network_knows_nothing_of_the_fold_it_is_judged_on(spark, design):
    """Whatever the kept-out fold holds, the network trained without it is the same, its scales included."""
    folded = tuning.with_folds(design, "row_id", 3).cache()
    odd = folded.rdd.map(lambda r: (r.row_id, r.label, Vectors.dense(r.features.toArray() * (1000 if r.fold == 1 else 1)), r.fold)).toDF(folded.schema)
    nets = [network.Net(2, 0.1, 1), network.Net(2, 0.1, 0)]
    kept, other = (network.fit_networks(t, nets, 10) for t in (folded, odd))
    assert np.allclose(kept[0].weights, other[0].weights, atol=1e-6) and not np.allclose(kept[1].weights, other[1].weights, atol=1e-3)
    x = folded.where("fold = 0").limit(5).select("features")
    assert np.allclose([r.p for r in kept[0](x).collect()], [r.p for r in other[0](x).collect()], atol=1e-6)


def test_networks_are_trained_until_the_loss_no_longer_falls(design):
    """The steps end at a place of no slope; one that has ended waits for no other."""
    rows = design.select("features", "label").collect()
    x = np.array([r.features.toArray() for r in rows])
    x1, y = np.hstack([(x - x.mean(0)) / x.std(0, ddof=1), np.ones((len(x), 1))]), np.array([r.label for r in rows])
    for size, decay in ((1, 1.0), (2, 5.0)):
        w = network.fit_network(design, {"size": size, "decay": decay}).weights
        assert np.abs(network._gradient(w, x1, y, size) + 2 * decay * w).max() < 0.05


def test_a_search_for_steps_shortens_them_and_starts_again():
    """On a steep curved valley, with the end that no longer falls."""
    way = network.Descent(np.array([-1.2, 1.0]), 1, 200)
    while way.at is not None:
        a, b = way.at
        way.told(1 + (1 - a) ** 2 + 100 * (b - a * a) ** 2, np.array([-2 * (1 - a) - 400 * a * (b - a * a), 200 * (b - a * a)]))
    assert np.allclose(way.best, [1, 1], atol=1e-3) and 0 < way.left < 190
