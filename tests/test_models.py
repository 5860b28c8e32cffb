import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from basalt.models import explain, factory, own
from basalt.models.calibrate import Calibrator
from basalt.operators import metrics as M
from basalt.operators.split import random_split


@pytest.fixture(scope="module")
def blobs(spark):
    """Two classes that a line parts almost, and a number that a plane gives."""
    draw = np.random.default_rng(1)
    x = draw.normal(size=(600, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] + 0.4 * draw.normal(size=600) > 0).astype(int)
    z = 3 * x[:, 0] - 2 * x[:, 2] + 0.1 * draw.normal(size=600)
    rows = [(i, *map(float, r), int(a), float(b)) for i, (r, a, b) in enumerate(zip(x, y, z, strict=True))]
    return random_split(spark.createDataFrame(rows, "id long, a double, b double, c double, y int, z double"), "id").cache()


FEATURES = ["a", "b", "c"]


@pytest.mark.parametrize("name", factory.algorithms("classification"))
def test_classifiers_learn(blobs, name):
    params = {"numTrees": 5, "maxIter": 5} if name not in ("logistic", "mlp", "svm") and name not in factory.OWN_CLASSIFIERS else {}
    m = factory.Model(name, FEATURES, "y", params=params).fit(blobs.where("split = 'train'"))
    scored = m.predict(blobs.where("split = 'test'"))
    assert set(scored.select("prediction").distinct().toPandas()["prediction"]) <= {0, 1}
    lo, hi = scored.agg(F.min("score"), F.max("score")).first()
    assert 0 <= lo <= hi <= 1 and M.ranking_metrics(scored, "score", "y").first()["auc"] > 0.85


@pytest.mark.parametrize("name", factory.algorithms("regression"))
def test_regressors_learn(blobs, name):
    params = {"regParam": 0.01} if name in ("ridge", "lasso", "elastic_net") else {"numTrees": 10} if "trees" in name or name == "random_forest" else {}
    m = factory.Model(name, FEATURES, "z", "regression", params).fit(blobs.where("split = 'train'"))
    assert M.regression(m.predict(blobs.where("split = 'test'")), "score", "z").first()["r2"] > 0.5


def test_unknown_and_filtered_parameters(blobs):
    with pytest.raises(ValueError, match="no classification algorithm"):
        factory.Model("nothing", FEATURES, "y").fit(blobs)
    assert factory.Model("logistic", FEATURES, "y", params={"no_such": 1}).fit(blobs).importance()[0][0] == "a"


def test_discriminants_equal_numpy(blobs):
    rows = blobs.select(*FEATURES, "y").collect()
    x, y = np.array([r[:3] for r in rows]), np.array([r[3] for r in rows])
    for quadratic in (False, True):
        m = own.Discriminant(blobs, FEATURES, "y", quadratic, shrinkage=0.0, reg=0.0)
        covs = [np.cov(x[y == k].T, bias=True) for k in (0, 1)]
        pooled = sum(c * (y == k).mean() for k, c in enumerate(covs))
        logs = []
        for k in (0, 1):
            c = covs[k] if quadratic else pooled
            d = x - x[y == k].mean(0)
            logs.append(math.log((y == k).mean()) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d))
        want = 1 / (1 + np.exp(logs[0] - logs[1]))
        got = [r[0] for r in blobs.select(m.output()).collect()]
        assert np.allclose(got, want, atol=1e-9)


def test_neighbours_equal_brute_force(blobs):
    rows = blobs.select(*FEATURES, "y").collect()
    x, y = np.array([r[:3] for r in rows]), np.array([r[3] for r in rows], dtype=float)
    want = [y[np.argsort(((x - q) ** 2).sum(1), kind="stable")[:5]].mean() for q in x]
    assert np.allclose([r[0] for r in blobs.select(own.Neighbours(blobs, FEATURES, "y").output()).collect()], want)


def test_evaluation_covers_the_splits(blobs):
    rows = factory.Model("logistic", FEATURES, "y").fit(blobs.where("split = 'train'")).metric_rows(blobs)
    assert {(s, m) for s, m, _ in rows} == {(s, m) for s in ("train", "val", "test") for m in ("f1", "precision", "recall", "roc_auc", "gini", "ks", "log_loss", "psi") if (s, m) != ("train", "psi")}
    checks = factory.readiness(rows)
    assert [c["name"] for c in checks] == ["leakage", "near_random", "overfitting_gap", "psi"] and factory.verdict(checks) in ("ready", "needs_review", "not_ready")
    assert factory.readiness([("val", "roc_auc", 0.995), ("train", "roc_auc", 1.0), ("val", "psi", 0.3)])[0]["status"] == "fail"
    assert factory.verdict([{"status": "pass"}]) == "ready" and factory.verdict([{"status": "warn"}]) == "needs_review"


def test_leaderboard_orders_and_fails_honestly(blobs):
    rows = factory.leaderboard(blobs, FEATURES, "y", ["logistic", "nothing", "lda"]).orderBy("rank").collect()
    assert rows[0]["value"] >= rows[1]["value"] and rows[2]["algorithm"] == "nothing" and rows[2]["error"] and rows[2]["value"] is None
    falling = factory.leaderboard(blobs, FEATURES, "z", ["linear", "decision_tree"], "regression").orderBy("rank").collect()
    assert falling[0]["algorithm"] == "linear" and falling[0]["value"] <= falling[1]["value"]
    with pytest.raises(RuntimeError):
        factory.leaderboard(blobs, FEATURES, "y", ["nothing"])


@pytest.mark.parametrize("backend", ["random", "density", "predefined"])
def test_tuning(blobs, backend):
    model, table = factory.tune(blobs, FEATURES, "y", "lda", trials=3, backend=backend, candidates=[{"shrinkage": 0.1}, {"shrinkage": 0.9}])
    rows = table.orderBy("trial").collect()
    assert len(rows) == (2 if backend == "predefined" else 3) and [r["best"] for r in rows] == list(np.maximum.accumulate([r["value"] for r in rows]))
    assert model.params["shrinkage"] == float(max(rows, key=lambda r: r["value"])["params"]["shrinkage"])


def test_draws_stay_in_their_space():
    import random

    rng, seen = random.Random(0), []
    space = {"a": ("int", 2, 9), "b": ("log", 1e-3, 1.0), "c": ("choice", ["x", "y"]), "d": ("float", -1.0, 1.0)}
    for _ in range(100):
        p = factory.draw(space, rng, seen, lambda v: -v)
        seen.append((p["d"], p))
        assert 2 <= p["a"] <= 9 and isinstance(p["a"], int) and 1e-3 <= p["b"] <= 1.0001 and p["c"] in "xy" and -1 <= p["d"] <= 1
    assert np.mean([v for v, _ in seen[60:]]) > np.mean([v for v, _ in seen[:8]])


@pytest.mark.parametrize("method", ["isotonic", "platt", "beta"])
def test_calibration(spark, method):
    draw = np.random.default_rng(3)
    p = draw.uniform(0.02, 0.98, 3000)
    y = (draw.uniform(size=3000) < p**2).astype(int)
    d = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y, strict=True)] + [(None, 1)], "p double, y int")
    c = Calibrator(method).fit(d, "p", "y")
    assert c.before > 0.1 and c.after < 0.05 and c.recommended()
    out = Calibrator.from_state(c.state()).transform(d, "p").collect()
    known = sorted((r["p"], r["calibrated"]) for r in out if r["p"] is not None)
    assert all(a[1] <= b[1] + 1e-12 for a, b in zip(known, known[1:], strict=False)) and [r for r in out if r["p"] is None][0]["calibrated"] is None
    if method == "platt":  # the gradient of the likelihood is zero
        w, b = c.weights
        q = 1 / (1 + np.exp(-(w * p + b)))
        assert abs((y - q).sum()) < 1e-4 and abs(((y - q) * p).sum()) < 1e-4
    with pytest.raises(ValueError):
        Calibrator(method).fit(d.where("y = 1"), "p", "y")


def test_isotonic_equals_pool_adjacent_violators(spark):
    draw = np.random.default_rng(4)
    p, y = np.round(draw.uniform(size=80), 2), draw.integers(0, 2, 80)
    c = Calibrator("isotonic").fit(spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y, strict=True)], "p double, y int"), "p", "y")
    blocks = [[y[p == v].mean(), (p == v).sum(), [v]] for v in np.unique(p)]
    merged = []
    for b in blocks:
        merged.append(b)
        while len(merged) > 1 and merged[-2][0] >= merged[-1][0]:
            m, n, v = merged.pop()
            a = merged[-1]
            merged[-1] = [(a[0] * a[1] + m * n) / (a[1] + n), a[1] + n, a[2] + v]
    want = {v: m for m, _, vs in merged for v in vs}
    got = spark.createDataFrame([(float(v),) for v in want], "p double")
    assert all(math.isclose(r["calibrated"], want[r["p"]], abs_tol=1e-9) for r in c.transform(got, "p").collect())


def test_linear_contributions(blobs):
    m = factory.Model("logistic", FEATURES, "y").fit(blobs)
    values = explain.shap_values(m, blobs, "id")
    w, means = explain.linear_weights(m), blobs.agg(*[F.avg(c) for c in FEATURES]).first()
    row = blobs.where("id = 5").first()
    got = {r["feature"]: r["shap"] for r in explain.waterfall(values, "id", 5).collect()}
    assert all(math.isclose(got[c], w[i] * (row[c] - means[i]), rel_tol=1e-9) for i, c in enumerate(FEATURES))
    assert explain.mean_shap(values).orderBy("rank").first()["feature"] == "a" and explain.dependence(values, "a").count() == blobs.count()


def test_sampled_contributions_add_up(blobs):
    m = factory.Model("decision_tree", FEATURES, "y").fit(blobs)
    base = blobs.limit(1)
    some = blobs.where("id < 20")
    total = {r["id"]: r["s"] for r in explain.shap_values(m, some, "id", base, orders=3).groupBy("id").agg(F.sum("shap").alias("s")).collect()}
    start = m.predict(base).first()["score"]
    for r in m.predict(some).collect():
        assert math.isclose(total[r["id"]], r["score"] - start, abs_tol=1e-9)
    rows, table = explain.bootstrap_shap(m, blobs, "id", batches=2, rows=60)
    best = table.orderBy("rank").first()
    assert best["feature"] == "a" and best["low"] <= best["mean"] <= best["high"] and rows.select("batch").distinct().count() == 2


def test_surrogate_and_dependence(blobs):
    m = factory.Model("logistic", FEATURES, "y").fit(blobs)
    assert explain.lime(m, blobs, {"a": 0.0, "b": 0.0, "c": 0.0}, samples=300).first()["feature"] == "a"
    curve = explain.partial_dependence(m, blobs, "a", points=8)
    y = [r["mean_score"] for r in sorted(curve.collect(), key=lambda r: r["value"])]
    assert y == sorted(y) and len(y) == 8 and explain.thresholds(curve)
    assert explain.dependence_summary({"a": curve, "c": explain.partial_dependence(m, blobs, "c", points=5)})[0]["feature"] == "a"
    kinds = explain.categorical_dependence(m, blobs.withColumn("k", F.lit("x")), lambda d: d.withColumn("a", F.when(F.col("k") == "x", 2.0).otherwise(-2.0)), "k", ["x", "y"])
    got = {r["value"]: r["mean_score"] for r in kinds.collect()}
    assert got["x"] > 0.8 > 0.2 > got["y"]


def test_clusters(spark):
    draw = np.random.default_rng(5)
    at = np.array([(0, 0), (6, 6), (0, 7)])
    x = np.concatenate([a + 0.4 * draw.normal(size=(50, 2)) for a in at])
    d = spark.createDataFrame([(i, *map(float, r), i // 50) for i, r in enumerate(x)], "id long, u double, v double, truth int")
    for name, params in (("kmeans", {"k": 3}), ("hierarchical", {"k": 3}), ("dbscan", {"eps": 0.4, "least": 4})):
        found = factory.Clusters(name, ["u", "v"], "id", **params).fit_predict(d).join(d, "id").where("cluster >= 0")
        assert found.select("truth", "cluster").distinct().count() == 3, name
        metrics = {r["metric"]: r["value"] for r in factory.cluster_metrics(found, ["u", "v"]).collect()}
        assert metrics["silhouette"] > 0.7 and metrics["davies_bouldin"] < 0.5 and metrics["calinski_harabasz"] > 100
    inertia = [r["inertia"] for r in factory.elbow(d, ["u", "v"], 4).orderBy("k").collect()]
    assert len(inertia) == 3 and inertia[0] > 5 * inertia[1] and inertia[1] >= 0.9 * inertia[2]
    # silhouette by hand
    label, far = np.repeat([0, 1, 2], 50), np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    sil = []
    for i in range(150):
        mean = [far[i, label == k].sum() / ((label == k).sum() - (k == label[i])) for k in range(3)]
        b = min(m for k, m in enumerate(mean) if k != label[i])
        sil.append((b - mean[label[i]]) / max(b, mean[label[i]]))
    got = {r["metric"]: r["value"] for r in factory.cluster_metrics(d.withColumnRenamed("truth", "cluster"), ["u", "v"]).collect()}
    assert math.isclose(got["silhouette"], float(np.mean(sil)), abs_tol=1e-6)


def test_density_clusters_equal_brute_force(spark):
    draw = np.random.default_rng(6)
    for eps, least in ((0.5, 4), (0.25, 6)):
        x = np.concatenate([draw.normal(size=(120, 2)), draw.uniform(-4, 4, (60, 2)), np.tile([[3.0, 3.0]], (10, 1))])
        d = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, u double, v double")
        near = ((x[:, None] - x[None]) ** 2).sum(-1) <= eps * eps
        core = near.sum(1) >= least
        root = list(range(len(x)))

        def top(i):
            while root[i] != i:
                i = root[i]
            return i

        for i, j in zip(*np.nonzero(near & core[:, None] & core[None]), strict=True):
            root[max(top(i), top(j))] = min(top(i), top(j))
        got = {r["id"]: r["cluster"] for r in own.dbscan(d, ["u", "v"], "id", eps, least).collect()}
        for i in range(len(x)):
            around = {top(j) for j in np.flatnonzero(near[i] & core)}
            assert got[i] == (top(i) if core[i] else min(around) if around else -1)


def test_smote(spark):
    draw = np.random.default_rng(7)
    rows = [(i, float(a), float(b), int(i < 20)) for i, (a, b) in enumerate(draw.normal(size=(120, 2)))]
    d = spark.createDataFrame(rows, "id long, a double, b double, y int")
    out = own.smote(d, ["a", "b"], "y", "id").collect()
    assert sum(r["y"] for r in out) == 100 and len(out) == 200
    rare = np.array([r[1:3] for r in rows if r[3] == 1])
    old = {tuple(map(float, r[1:3])) for r in rows}
    for r in out:
        if (r["a"], r["b"]) not in old:  # between two rows of the rarer class
            p = np.array([r["a"], r["b"]])
            gap = np.linalg.norm(rare[:, None] - p, axis=-1) + np.linalg.norm(rare[None] - p, axis=-1) - np.linalg.norm(rare[:, None] - rare[None], axis=-1)
            assert gap[~np.eye(len(rare), dtype=bool)].min() < 1e-9
    assert sorted(out) == sorted(own.smote(d.repartition(5), ["a", "b"], "y", "id").collect())
    with pytest.raises(ValueError):
        own.smote(d.limit(30).where("id < 24"), ["a", "b"], "y", "id", k=30)


def test_neighbour_imputation(spark):
    draw = np.random.default_rng(8)
    x = draw.normal(size=(60, 3))
    holes = draw.random((60, 3)) < 0.2
    rows = [(i, *[None if holes[i, j] else float(x[i, j]) for j in range(3)]) for i in range(60)]
    d = spark.createDataFrame(rows, "id long, a double, b double, c double")
    got = {r["id"]: r for r in own.impute_neighbours(d, ["a", "b", "c"], k=3)(d).collect()}
    for i in range(60):
        for j, c in enumerate("abc"):
            if not holes[i, j]:
                assert got[i][c] == x[i, j]
                continue
            both = ~holes & ~holes[i]
            m = both.sum(1)
            gap = np.where(m > 0, (((x - x[i]) ** 2) * both).sum(1) * 3 / np.maximum(m, 1), np.inf)
            usable = [k for k in np.argsort(gap, kind="stable") if not holes[k, j] and np.isfinite(gap[k])][:3]
            want = x[usable, j].mean() if usable else x[~holes[:, j], j].mean()
            assert math.isclose(got[i][c], want, rel_tol=1e-9)
