"""Making, fitting, comparing and tuning models by name; every metric is of all rows of its split."""

from __future__ import annotations

import math
import random
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import clustering as K
from pyspark.ml import regression as R
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.core import settings as S
from basalt.core.lineage import checkpoint
from basalt.models import own
from basalt.operators import metrics as M
from basalt.operators.split import key_order

#: Defaults by algorithm, in MLlib's names; ``params`` override them and unknown ones are left out.
CLASSIFIERS: dict[str, tuple[type, dict]] = {
    "logistic": (C.LogisticRegression, {"maxIter": 100}),
    "decision_tree": (C.DecisionTreeClassifier, {"maxDepth": 6, "minInstancesPerNode": 20, "seed": S.SEED}),
    "random_forest": (C.RandomForestClassifier, {"numTrees": 20, "maxDepth": 8, "minInstancesPerNode": 20, "seed": S.SEED}),
    "gradient_boosting": (C.GBTClassifier, {"maxIter": 20, "maxDepth": 4, "stepSize": 0.1, "subsamplingRate": 0.8, "seed": S.SEED}),
    "xgboost": (C.GBTClassifier, {"maxIter": 20, "maxDepth": 6, "stepSize": 0.1, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "minInstancesPerNode": 5, "seed": S.SEED}),
    "lightgbm": (C.GBTClassifier, {"maxIter": 20, "maxDepth": 5, "stepSize": 0.1, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "seed": S.SEED}),
    "extra_trees": (C.RandomForestClassifier, {"numTrees": 20, "maxDepth": 8, "minInstancesPerNode": 20, "maxBins": 8, "bootstrap": False, "featureSubsetStrategy": "sqrt", "seed": S.SEED}),
    "naive_bayes": (C.NaiveBayes, {"modelType": "gaussian"}),
    "mlp": (C.MultilayerPerceptronClassifier, {"maxIter": 100, "seed": S.SEED}),
    "svm": (C.LinearSVC, {"maxIter": 100}),
}
REGRESSORS: dict[str, tuple[type, dict]] = {
    "linear": (R.LinearRegression, {}),
    "ridge": (R.LinearRegression, {"regParam": 1.0, "elasticNetParam": 0.0}),
    "lasso": (R.LinearRegression, {"regParam": 1.0, "elasticNetParam": 1.0}),
    "elastic_net": (R.LinearRegression, {"regParam": 1.0, "elasticNetParam": 0.5}),
    "decision_tree": (R.DecisionTreeRegressor, {"maxDepth": 6, "minInstancesPerNode": 20, "seed": S.SEED}),
    "random_forest": (R.RandomForestRegressor, {"numTrees": 20, "maxDepth": 8, "minInstancesPerNode": 20, "seed": S.SEED}),
    "gradient_boosting": (R.GBTRegressor, {"maxIter": 20, "maxDepth": 4, "stepSize": 0.1, "subsamplingRate": 0.8, "seed": S.SEED}),
    "xgboost": (R.GBTRegressor, {"maxIter": 20, "maxDepth": 5, "stepSize": 0.1, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "seed": S.SEED}),
    "lightgbm": (R.GBTRegressor, {"maxIter": 20, "maxDepth": 5, "stepSize": 0.1, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "seed": S.SEED}),
    "extra_trees": (R.RandomForestRegressor, {"numTrees": 20, "maxDepth": 8, "minInstancesPerNode": 20, "maxBins": 8, "bootstrap": False, "featureSubsetStrategy": "onethird", "seed": S.SEED}),
    "svm": (R.LinearRegression, {"loss": "huber", "epsilon": 1.35}),
}
OWN_CLASSIFIERS = {
    "knn": lambda d, f, t, **k: own.Neighbours(d, f, t, **k),
    "lda": lambda d, f, t, **k: own.Discriminant(d, f, t, **k),
    "qda": lambda d, f, t, **k: own.Discriminant(d, f, t, quadratic=True, **k),
    "adaboost": lambda d, f, t, **k: own.Boosted(d, f, t, **k),
}
OWN_REGRESSORS = {"knn": lambda d, f, t, **k: own.Neighbours(d, f, t, **k), "adaboost": lambda d, f, t, **k: own.Boosted(d, f, t, regression=True, **k)}
#: Lower is better.
FALLING = frozenset(["log_loss", "psi", "rmse", "mae", "mape", "median_ae"])
SPLITS = ("train", "val", "test", "oot")


def algorithms(task: str) -> list[str]:
    return sorted({**CLASSIFIERS, **OWN_CLASSIFIERS} if task == "classification" else {**REGRESSORS, **OWN_REGRESSORS})


class Model:
    """A fitted model: ``predict`` adds ``score`` (chance of 1, or the prediction) and ``prediction``; rows with null features have none."""

    def __init__(self, algorithm: str, features: list[str], target: str, task: str = "classification", params: dict | None = None) -> None:
        self.algorithm, self.features, self.target, self.task, self.params = algorithm, list(features), target, task, dict(params or {})
        self.fitted: PipelineModel | None = None
        self.made = None

    def fit(self, train: DataFrame, weight: str | None = None) -> Model:
        ours, mllib = (OWN_CLASSIFIERS, CLASSIFIERS) if self.task == "classification" else (OWN_REGRESSORS, REGRESSORS)
        if self.algorithm in ours:
            self.made = ours[self.algorithm](train, self.features, self.target, **self.params)
            return self
        if self.algorithm not in mllib:
            raise ValueError(f"no {self.task} algorithm is called {self.algorithm}; there are {', '.join(algorithms(self.task))}")
        kind, defaults = mllib[self.algorithm]
        made = kind(labelCol=self.target, featuresCol="__x")
        wanted = {**defaults, **self.params}
        if self.algorithm == "mlp":
            wanted.setdefault("layers", [len(self.features), 16, 2])
        known = {k: v for k, v in wanted.items() if made.hasParam(k)}
        made = made.setParams(**known)
        keep = [*self.features, self.target]
        if weight and made.hasParam("weightCol"):
            made, keep = made.setWeightCol(weight), [*keep, weight]
        stages = [VectorAssembler(inputCols=self.features, outputCol="__raw", handleInvalid="skip"), StandardScaler(inputCol="__raw", outputCol="__x", withMean=True, withStd=True), made]
        self.fitted = Pipeline(stages=stages).fit(train.select(*keep).where(F.col(self.target).isNotNull()))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        if self.made is not None:
            d = df.dropna(subset=self.features)
            out = self.made.transform(d).withColumnRenamed("__out", "score") if hasattr(self.made, "transform") else d.withColumn("score", self.made.output())
        else:
            d = self.fitted.transform(df.drop("prediction", "score"))
            if self.task != "classification":
                out = d.withColumn("score", F.col("prediction"))
            elif "probability" in d.columns:
                out = d.withColumn("score", vector_to_array("probability")[1])
            else:  # a margin has no chance of its own
                out = d.withColumn("score", 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1])))
            out = out.drop("__raw", "__x", "rawPrediction", "probability", "prediction")
        return out.withColumn("prediction", (F.col("score") >= 0.5).cast("int") if self.task == "classification" else F.col("score"))

    def evaluate(self, split: DataFrame) -> DataFrame:
        """(split, metric, value) on each of the splits that there are, to six digits; PSI is against the scores of train."""
        return split.sparkSession.createDataFrame(self.metric_rows(split), "split string, metric string, value double")

    def metric_rows(self, split: DataFrame, only: str | None = None) -> list[tuple[str, str, float | None]]:
        """Metrics of every split, or of ``only`` one; of train there are then just the scores, for PSI."""
        there = {r[0] for r in split.select("split").distinct().collect()}
        scored = checkpoint(self.predict(split.where(F.col(self.target).isNotNull())).select("split", "score", "prediction", F.col(self.target).alias("y")))
        rows: list[tuple[str, str, float | None]] = []
        for name in (s for s in SPLITS if s in there and only in (None, s)):
            d = scored.where(F.col("split") == name)
            if self.task == "classification":
                c = M.confusion(d, "score", "y").first()
                r = M.ranking_metrics(d, "score", "y").first()
                got = {"f1": c["f1"], "precision": c["precision"], "recall": c["recall"], "roc_auc": r["auc"], "gini": r["gini"], "ks": r["ks"], "log_loss": M.log_loss(d, "score", "y").first()[0]}
            else:
                got = M.regression(d, "score", "y").first().asDict()
            if name != "train" and "train" in there:
                got["psi"] = M.psi_numeric(scored.where("split = 'train'"), d, ["score"]).first()["psi"]
            rows += [(name, k, None if v is None else round(float(v), 6)) for k, v in got.items()]
        return rows

    def importance(self) -> list[tuple[str, float]]:
        """(feature, weight) by impurity or absolute coefficient, greatest first; empty where the model has neither."""
        last = self.fitted.stages[-1] if self.fitted else None
        for name in ("featureImportances", "coefficients"):
            if hasattr(last, name):
                values = [abs(float(x)) for x in getattr(last, name).toArray()]
                return sorted(zip(self.features, values, strict=True), key=lambda x: (-x[1], x[0]))
        return []


def wide(metrics: DataFrame) -> DataFrame:
    """One row a metric, one column a split."""
    return metrics.groupBy("metric").pivot("split", list(SPLITS)).agg(F.first("value"))


def leaderboard(split: DataFrame, features: list[str], target: str, names: list[str] | None = None, task: str = "classification", metric: str | None = None, params: dict[str, dict] | None = None) -> DataFrame:
    """Metrics of every algorithm on val (test if there is none), best first by ``metric``; nulls are last.

    An algorithm that can't be fitted to these data is a row with its reason; if none can, that is an error.
    """
    metric = metric or ("roc_auc" if task == "classification" else "rmse")
    there = {r[0] for r in split.select("split").distinct().collect()}
    on = next((s for s in ("val", "test") if s in there), None)
    if on is None:
        raise ValueError("a leaderboard needs a val or test split")
    rows, data = [], checkpoint(split.where(F.col("split").isin("train", on)).select("split", target, *features))
    for name in names or algorithms(task):
        try:
            model = Model(name, features, target, task, (params or {}).get(name)).fit(data.where("split = 'train'"))
            got = {m: v for _, m, v in model.metric_rows(data, on)}
            rows.append((name, got.get(metric), got, None))
        except (ValueError, PySparkException) as e:
            rows.append((name, None, {}, str(e)[:200]))
    if all(r[3] for r in rows):
        raise RuntimeError(f"no algorithm could be fitted: {rows[0][3] if rows else 'none was named'}")
    sign = 1 if metric in FALLING else -1
    rows.sort(key=lambda r: (r[1] is None, sign * (r[1] or 0.0), r[0]))
    ranked = [(i + 1, *r) for i, r in enumerate(rows)]
    return split.sparkSession.createDataFrame(ranked, "rank int, algorithm string, value double, metrics map<string,double>, error string")


def cross_validated(df: DataFrame, features: list[str], target: str, algorithm: str = "logistic", folds: int = 3, key: str | None = None) -> float:
    """Mean AUC over folds that the hash of the key (or of the row) deals."""
    fold = F.pmod(F.xxhash64(key_order(key) if key else F.struct(*features)), F.lit(folds))
    d = df.select(*features, target, fold.alias("__fold"))
    total = 0.0
    for i in range(folds):
        model = Model(algorithm, features, target).fit(d.where(F.col("__fold") != i))
        total += M.ranking_metrics(model.predict(d.where(F.col("__fold") == i)), "score", target).first()["auc"] or 0.0
    return total / folds


#: Search spaces in MLlib's names: ("int" | "float" | "log", low, high) or ("choice", values).
SPACES: dict[str, dict[str, tuple]] = {
    "logistic": {"regParam": ("log", 1e-5, 1.0), "elasticNetParam": ("float", 0.0, 1.0)},
    "ridge": {"regParam": ("log", 1e-4, 100.0)}, "lasso": {"regParam": ("log", 1e-4, 100.0)}, "elastic_net": {"regParam": ("log", 1e-4, 100.0), "elasticNetParam": ("float", 0.0, 1.0)},
    "decision_tree": {"maxDepth": ("int", 2, 12), "minInstancesPerNode": ("int", 1, 100)},
    "random_forest": {"numTrees": ("int", 10, 60), "maxDepth": ("int", 3, 12), "minInstancesPerNode": ("int", 1, 100), "featureSubsetStrategy": ("choice", ["sqrt", "log2", "onethird", "all"])},
    "extra_trees": {"numTrees": ("int", 10, 60), "maxDepth": ("int", 3, 12), "minInstancesPerNode": ("int", 1, 100)},
    **{n: {"maxIter": ("int", 5, 60), "maxDepth": ("int", 2, 8), "stepSize": ("log", 0.01, 0.3), "subsamplingRate": ("float", 0.5, 1.0)} for n in ("gradient_boosting", "xgboost", "lightgbm")},
    "naive_bayes": {"smoothing": ("log", 1e-3, 10.0)}, "svm": {"regParam": ("log", 1e-5, 10.0)}, "mlp": {"maxIter": ("int", 20, 200), "stepSize": ("log", 1e-3, 0.3)},
    "knn": {"k": ("int", 3, 50)}, "lda": {"shrinkage": ("float", 0.0, 0.9)}, "qda": {"reg": ("float", 0.0, 0.9)}, "adaboost": {"rounds": ("int", 5, 30), "rate": ("log", 0.05, 1.0)},
}


def draw(space: dict[str, tuple], rng: random.Random, seen: list[tuple[float, dict]] | None = None, better: Callable[[float], float] = float) -> dict:
    """Parameters by chance; with results at hand, two of three draws lie near one of the better ones (a tree-less estimate of densities)."""
    good = sorted(seen or [], key=lambda x: better(x[0]))[: max(1, len(seen or []) // 4)]
    near = rng.choice(good)[1] if len(seen or []) >= 8 and rng.random() < 2 / 3 else None
    out = {}
    for name, (kind, *law) in space.items():
        if kind == "choice":
            out[name] = near[name] if near and rng.random() < 0.7 else rng.choice(law[0])
            continue
        lo, hi = (math.log(x) for x in law) if kind == "log" else law
        x = rng.uniform(lo, hi)
        if near:
            at = math.log(near[name]) if kind == "log" else near[name]
            x = min(hi, max(lo, rng.gauss(at, 0.15 * (hi - lo))))
        out[name] = round(x) if kind == "int" else math.exp(x) if kind == "log" else x
    return out


def tune(split: DataFrame, features: list[str], target: str, algorithm: str, task: str = "classification", trials: int = 10, backend: str = "density", space: dict[str, tuple] | None = None, candidates: list[dict] | None = None, metric: str | None = None, seed: int = S.SEED) -> tuple[Model, DataFrame]:
    """The model of the best parameters, refitted on train, and (trial, value, best, params) of every trial on val.

    ``backend``: ``random``, ``density`` (later trials near the better ones), or ``predefined`` for ``candidates``.
    """
    metric = metric or ("roc_auc" if task == "classification" else "rmse")
    falling = metric in FALLING
    if backend not in ("random", "density", "predefined"):
        raise ValueError(f"no backend is called {backend}")
    space = space or SPACES.get(algorithm, {})
    rng, seen, rows = random.Random(seed), [], []
    data = checkpoint(split.where(F.col("split").isin("train", "val")).select("split", target, *features))
    best: float | None = None
    for i in range(len(candidates or []) if backend == "predefined" else trials):
        params = candidates[i] if backend == "predefined" else draw(space, rng, seen if backend == "density" else None, (lambda v: v) if falling else (lambda v: -v))
        model = Model(algorithm, features, target, task, params).fit(data.where("split = 'train'"))
        value = next((v for _, m, v in model.metric_rows(data, "val") if m == metric), None)
        if value is not None:
            seen.append((value, params))
            best = value if best is None else min(best, value) if falling else max(best, value)
        rows.append((i, value, best, {k: str(v) for k, v in params.items()}))
    if not seen:
        raise RuntimeError("no trial gave a value")
    chosen = (min if falling else max)(seen, key=lambda x: x[0])[1]
    final = Model(algorithm, features, target, task, chosen).fit(split.where("split = 'train'"))
    return final, split.sparkSession.createDataFrame(rows, "trial int, value double, best double, params map<string,string>")


class Clusters:
    """kmeans, hierarchical (Ward's linkage over the centres of a fine k-means) or dbscan over scaled columns."""

    def __init__(self, algorithm: str, features: list[str], key: str, **params) -> None:
        if algorithm not in ("kmeans", "hierarchical", "dbscan"):
            raise ValueError(f"no clustering algorithm is called {algorithm}")
        self.algorithm, self.features, self.key, self.params = algorithm, features, key, params

    def fit_predict(self, df: DataFrame) -> DataFrame:
        """(key, cluster) of the rows without null features."""
        d = df.dropna(subset=self.features)
        r = d.agg(*[x for c in self.features for x in (F.avg(c), F.stddev_pop(c))]).first()
        scaled = d.select(self.key, *[((F.col(c).cast("double") - (r[2 * i] or 0.0)) / (r[2 * i + 1] or 1.0)).alias(c) for i, c in enumerate(self.features)])
        if self.algorithm == "dbscan":
            return own.dbscan(scaled, self.features, self.key, **{"eps": 0.5, "least": 5} | self.params)
        d = VectorAssembler(inputCols=self.features, outputCol="features").transform(scaled)
        if self.algorithm == "kmeans":
            return K.KMeans(seed=S.SEED, **({"k": 8} | self.params)).fit(d).transform(d).select(self.key, F.col("prediction").cast("long").alias("cluster"))
        fine = K.KMeans(k=min(MICRO, max(2, d.count())), seed=S.SEED).fit(d)
        placed = fine.transform(d)
        sizes = {r["prediction"]: r["count"] for r in placed.groupBy("prediction").count().collect()}
        groups = ward([c.tolist() for c in fine.clusterCenters()], [sizes.get(i, 0) for i in range(len(fine.clusterCenters()))], self.params.get("k", 5))
        of = F.create_map(*[x for i, g in enumerate(groups) for x in (F.lit(i), F.lit(g).cast("long"))])
        return placed.select(self.key, F.element_at(of, F.col("prediction")).alias("cluster"))


#: Centres that Ward's linkage starts from (a documented bound).
MICRO = 100


def ward(centres: list[list[float]], sizes: list[int], k: int) -> list[int]:
    """Group of each centre: the two groups whose union adds least to the squared distances merge until k are left."""
    import numpy as np

    c, n = np.array(centres, dtype=float), np.array(sizes, dtype=float)
    alive, of = [i for i in range(len(c)) if n[i] > 0], np.arange(len(c))
    while len(alive) > max(1, k):
        x, w = c[alive], n[alive]
        cost = ((x[:, None] - x[None]) ** 2).sum(-1) * (w[:, None] * w[None]) / (w[:, None] + w[None])
        np.fill_diagonal(cost, np.inf)
        i, j = sorted(divmod(int(np.argmin(cost)), len(alive)))
        a, b = alive[i], alive[j]
        c[a] = (c[a] * n[a] + c[b] * n[b]) / (n[a] + n[b])
        n[a] += n[b]
        of[of == b] = a
        alive.pop(j)
    names = {g: i for i, g in enumerate(alive)}
    return [names.get(int(g), 0) for g in of]


def cluster_metrics(df: DataFrame, features: list[str], cluster: str = "cluster", sample: int = 5000, seed: int = S.SEED) -> DataFrame:
    """(metric, value): silhouette on a sample of rows, Davies-Bouldin, Calinski-Harabasz and inertia of all rows."""
    import numpy as np

    k = [F.col(c).cast("double") for c in features]
    d = df.dropna(subset=[*features, cluster]).where(F.col(cluster) >= 0)
    means = d.groupBy(cluster).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(k)], *[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(k)])
    rows = means.orderBy(cluster).collect()
    n, m = np.array([r["n"] for r in rows], dtype=float), np.array([[r[f"m{i}"] for i in range(len(k))] for r in rows]).reshape(len(rows), len(k))
    within = np.array([sum(r[f"v{i}"] for i in range(len(k))) * r["n"] for r in rows])
    inertia, total = float(within.sum()), n.sum()
    centre = (m * n[:, None]).sum(0) / max(total, 1)
    between = float((n * ((m - centre) ** 2).sum(1)).sum())
    out = {"inertia": inertia, "calinski_harabasz": None, "davies_bouldin": None, "silhouette": None}
    if len(rows) > 1:
        out["calinski_harabasz"] = between / (len(rows) - 1) / max(inertia / max(total - len(rows), 1), 1e-300)
        near = d.join(F.broadcast(means.select(cluster, *[f"m{i}" for i in range(len(k))])), cluster)  # a row a cluster
        gap = F.sqrt(sum(((c - F.col(f"m{i}")) * (c - F.col(f"m{i}")) for i, c in enumerate(k)), F.lit(0.0)))
        spread = {r[0]: r[1] for r in near.groupBy(cluster).agg(F.avg(gap)).collect()}
        s = np.array([spread[r[cluster]] for r in rows])
        far = np.sqrt(((m[:, None] - m[None]) ** 2).sum(-1))
        np.fill_diagonal(far, np.inf)
        out["davies_bouldin"] = float(((s[:, None] + s[None]) / far).max(1).mean())
        x = own.sampled(d, [*features, cluster], sample)
        label = x[:, -1]
        dist = np.sqrt(np.maximum(((x[:, None, :-1] - x[None, :, :-1]) ** 2).sum(-1), 0)) if len(x) <= 1000 else np.sqrt(np.maximum((x[:, :-1] ** 2).sum(1)[:, None] + (x[:, :-1] ** 2).sum(1) - 2 * x[:, :-1] @ x[:, :-1].T, 0))
        kinds = np.unique(label)
        if len(kinds) > 1:
            sums = np.stack([dist[:, label == c].sum(1) for c in kinds], 1)
            size = np.array([(label == c).sum() for c in kinds])
            at = np.searchsorted(kinds, label)
            a = sums[np.arange(len(x)), at] / np.maximum(size[at] - 1, 1)
            other = sums / size
            other[np.arange(len(x)), at] = np.inf
            b = other.min(1)
            sil = np.where(size[at] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)
            out["silhouette"] = float(sil.mean())
    return df.sparkSession.createDataFrame([(a, None if b is None else float(b)) for a, b in out.items()], "metric string, value double")


def elbow(df: DataFrame, features: list[str], most: int = 10) -> DataFrame:
    """(k, inertia) of k-means for k from 2."""
    d = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df)
    rows = [(k, float(K.KMeans(k=k, seed=S.SEED).fit(d).summary.trainingCost)) for k in range(2, most + 1)]
    return df.sparkSession.createDataFrame(rows, "k int, inertia double")


def readiness(rows: list[tuple[str, str, float | None]]) -> list[dict[str, str]]:
    """Four checks of the metric rows of a model: leakage, near_random, overfitting_gap and psi, each pass, warn or fail."""
    value = {(s, m): v for s, m, v in rows}
    on = next((s for s in ("val", "test", "train") if any(k[0] == s for k in value)), None)
    auc, train, psi = value.get((on, "roc_auc")), value.get(("train", "roc_auc")), value.get((on, "psi"))

    def check(name: str, status: str, detail: str) -> dict[str, str]:
        return {"name": name, "status": status, "detail": detail}

    if auc is None:
        out = [check(n, "warn", "there is no AUC to look at") for n in ("leakage", "near_random")]
    else:
        out = [check("leakage", "fail" if auc > S.LEAKAGE_AUC else "pass", f"AUC {auc:.3f} on {on}"), check("near_random", "fail" if auc < S.RANDOM_AUC else "pass", f"AUC {auc:.3f} on {on}")]
    if auc is None or train is None or on == "train":
        out.append(check("overfitting_gap", "warn", "there are no two splits to compare"))
    else:
        out.append(check("overfitting_gap", "warn" if train - auc > S.OVERFIT_GAP else "pass", f"AUC of train is {train - auc:.3f} above that of {on}"))
    if psi is None:
        out.append(check("psi", "warn", "there is no PSI to look at"))
    else:
        out.append(check("psi", "fail" if psi > S.PSI_FLAG else "warn" if psi > S.PSI_WATCH else "pass", f"PSI {psi:.3f} on {on}"))
    return out


def verdict(checks: list[dict[str, str]]) -> str:
    """not_ready if a check fails, needs_review if one warns, else ready."""
    states = {c["status"] for c in checks}
    return "not_ready" if "fail" in states else "needs_review" if "warn" in states else "ready"
