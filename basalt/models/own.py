"""Models that MLlib lacks: fitted by aggregates or on a bounded sample, applied to all rows by expressions or Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.core import settings as S

#: Rows of the sample that neighbours are sought in (a documented bound of these models).
SAMPLE_ROWS = 20_000


def vector(features: list[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in features])


def sampled(df: DataFrame, columns: list[str], rows: int = SAMPLE_ROWS, key: str | None = None) -> np.ndarray:
    """Values of a random sample of rows without nulls; by hash of the row, so that it doesn't depend on partitioning."""
    d = df.select(*[F.col(c).cast("double").alias(c) for c in columns], *([F.col(key).cast("string").alias("__key")] if key and key not in columns else [])).dropna(subset=columns)
    n = d.count()
    if n > rows:
        digest = F.pmod(F.xxhash64(*d.columns), F.lit(1 << 30))
        d = d.where(digest < int(1.1 * rows / n * (1 << 30))).limit(rows)
    return np.array([[r[c] for c in columns] for r in d.collect()], dtype=float).reshape(-1, len(columns))


def nearest(points: np.ndarray, queries: np.ndarray, k: int, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Positions and squared distances of the k points nearest to each query, nearest first, in blocks of queries."""
    k = min(k, len(points))
    at, far = np.zeros((len(queries), k), dtype=np.int64), np.zeros((len(queries), k))
    norms = (points**2).sum(1)
    for i in range(0, len(queries), block):
        q = queries[i : i + block]
        d = np.maximum((q**2).sum(1)[:, None] + norms - 2 * q @ points.T, 0)
        few = np.argpartition(d, k - 1, axis=1)[:, :k] if k < len(points) else np.tile(np.arange(len(points)), (len(q), 1))
        gap = np.take_along_axis(d, few, 1)
        order = np.argsort(gap, axis=1, kind="stable")
        at[i : i + block], far[i : i + block] = np.take_along_axis(few, order, 1), np.take_along_axis(gap, order, 1)
    return at, far


class Neighbours:
    """k nearest neighbours in a bounded sample of train: the share of the classes, or the mean of the target."""

    def __init__(self, df: DataFrame, features: list[str], target: str, k: int = 5, rows: int = SAMPLE_ROWS) -> None:
        self.features, self.k = features, k
        x = sampled(df, [*features, target], rows)
        self.x, self.y = x[:, :-1], x[:, -1]

    def output(self) -> Column:
        x, y, k = self.x, self.y, self.k

        @F.pandas_udf("double")
        def mean(v: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series(np.zeros(len(v)))
            at, _ = nearest(x, np.stack(v.to_numpy()).astype(float), k)
            return pd.Series(y[at].mean(1))

        return mean(vector(self.features))


class Discriminant:
    """Gaussian classes from counts, sums and products: one covariance for all (linear) or one each (quadratic).

    The linear one shrinks its covariance towards equal variances by ``shrinkage``; the quadratic one adds
    ``reg`` of the identity.
    """

    def __init__(self, df: DataFrame, features: list[str], target: str, quadratic: bool = False, shrinkage: float = 0.05, reg: float = 0.01) -> None:
        self.features = features
        k = len(features)
        c = [F.col(x).cast("double") for x in features]
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        rows = df.dropna(subset=[*features, target]).groupBy(F.col(target).cast("int").alias("y")).agg(F.count("*").alias("n"), *[F.avg(x).alias(f"m{i}") for i, x in enumerate(c)], *[F.covar_pop(c[i], c[j]).alias(f"p{i}_{j}") for i, j in pairs]).orderBy("y").collect()
        total = sum(r["n"] for r in rows)
        self.classes, means, covs, prior = [], [], [], []
        for r in rows:
            cov = np.zeros((k, k))
            for i, j in pairs:
                cov[i, j] = cov[j, i] = r[f"p{i}_{j}"] or 0.0
            self.classes.append(r["y"])
            means.append(np.array([r[f"m{i}"] for i in range(k)]))
            covs.append(cov)
            prior.append(r["n"] / total)
        if quadratic:
            covs = [(1 - reg) * x + reg * np.eye(k) for x in covs]
        else:
            pooled = sum((p * x for p, x in zip(prior, covs, strict=True)), np.zeros((k, k)))
            pooled = (1 - shrinkage) * pooled + shrinkage * max(np.trace(pooled) / max(k, 1), 1e-12) * np.eye(k)
            covs = [pooled] * len(rows)
        self.law = [(m, np.linalg.pinv(x), float(np.linalg.slogdet(x)[1]), math.log(p)) for m, x, p in zip(means, covs, prior, strict=True)]

    def output(self) -> Column:
        """Chance of the last class, for two classes that of 1."""
        logs = []
        for m, inv, det, logp in self.law:
            d = [F.col(c).cast("double") - float(m[i]) for i, c in enumerate(self.features)]
            quad = sum((float(inv[i, j]) * d[i] * d[j] for i in range(len(d)) for j in range(len(d))), F.lit(0.0))
            logs.append(F.lit(logp) - 0.5 * det - 0.5 * quad)
        if len(logs) < 2:
            return F.lit(float(self.classes[0]) if self.classes else 0.0)
        top = F.greatest(*logs)
        parts = [F.exp(x - top) for x in logs]
        return parts[-1] / sum(parts[1:], parts[0])


class Boosted:
    """Discrete AdaBoost on two classes: shallow trees, each fitted to rows weighted by the errors of those before.

    For regression, residuals of the sum so far are fitted (L2 boosting), at the same learning rate.
    """

    def __init__(self, df: DataFrame, features: list[str], target: str, regression: bool = False, rounds: int = 10, rate: float = 0.5, depth: int = 2) -> None:
        from pyspark.ml.classification import DecisionTreeClassifier
        from pyspark.ml.regression import DecisionTreeRegressor

        from basalt.core.lineage import checkpoint

        self.features, self.regression, self.trees = features, regression, []
        d = df.dropna(subset=[*features, target]).select(array_to_vector(vector(features)).alias("features"), F.col(target).cast("double").alias("y"))
        if regression:
            base = d.agg(F.avg("y")).first()[0] or 0.0
            self.base, now = base, d.withColumn("label", F.col("y") - base)
            for _ in range(rounds):
                model = DecisionTreeRegressor(maxDepth=depth, seed=S.SEED).fit(now)
                self.trees.append((rate, model))
                now = checkpoint(model.transform(now).withColumn("label", F.col("label") - rate * F.col("prediction")).select("features", "y", "label"))
            return
        n = d.count()
        now = d.select("features", F.col("y").alias("label"), F.lit(1.0 / max(n, 1)).alias("w"))
        for _ in range(rounds if n else 0):
            model = DecisionTreeClassifier(maxDepth=depth, weightCol="w", seed=S.SEED).fit(now)
            scored = model.transform(now).select("features", "label", "w", (F.col("prediction") != F.col("label")).cast("double").alias("miss"))
            wrong, every = scored.agg(F.sum(F.col("w") * F.col("miss")), F.sum("w")).first()
            err = min(max(wrong / every, 1e-10), 1 - 1e-10)
            if err >= 0.5:
                break
            alpha = rate * math.log((1 - err) / err)
            self.trees.append((alpha, model))
            if err <= 1e-9:
                break
            grown = scored.select("features", "label", (F.col("w") * F.exp(alpha * F.col("miss"))).alias("w"))
            total = grown.agg(F.sum("w")).first()[0]
            now = checkpoint(grown.select("features", "label", (F.col("w") / total).alias("w")))

    def transform(self, df: DataFrame) -> DataFrame:
        """df with ``__out``: the chance of class 1, or the prediction."""
        d = df.withColumn("__v", array_to_vector(vector(self.features)))
        total = F.lit(self.base if self.regression else 0.0)
        for i, (alpha, tree) in enumerate(self.trees):
            tree = tree.copy({tree.featuresCol: "__v", tree.predictionCol: f"__p{i}"})
            if not self.regression:
                tree = tree.copy({tree.rawPredictionCol: "", tree.probabilityCol: ""})
            d = tree.transform(d)
            total = total + alpha * (F.col(f"__p{i}") if self.regression else 2 * F.col(f"__p{i}") - 1)
        out = total if self.regression else 1 / (1 + F.exp(-total))
        return d.withColumn("__out", out).drop("__v", *[f"__p{i}" for i in range(len(self.trees))])


def dbscan(df: DataFrame, features: list[str], key: str, eps: float = 0.5, least: int = 5) -> DataFrame:
    """(key, cluster): density clusters by a grid join; -1 is noise, others the least key of their core points.

    Points meet only those of their own and adjacent cells of width ``eps``. A cell of ``least`` or more rows in a
    grid of width eps / sqrt(d) lies within eps, so its rows are all core points and linked through one of them.
    """
    from basalt.core.lineage import checkpoint
    from basalt.operators.graph import components

    if len(features) > 6:
        raise ValueError("a grid of more than 6 columns has too many adjacent cells; reduce them first")
    d = df.select(F.col(key).cast("long").alias("id"), vector(features).alias("v")).where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)))
    fine = eps / math.sqrt(len(features)) * (1 - 1e-9)
    d = checkpoint(d.withColumn("cell", F.transform("v", lambda x: F.floor(x / F.lit(fine)))))
    reach = math.ceil(math.sqrt(len(features)))
    shifts = np.stack(np.meshgrid(*[np.arange(-reach - 1, reach + 2)] * len(features), indexing="ij"), -1).reshape(-1, len(features))
    gap = np.maximum(np.abs(shifts) - 1, 0)
    shifts = shifts[(gap**2).sum(1) * fine**2 <= eps**2]
    sizes = d.groupBy("cell").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    dense = checkpoint(sizes.where(F.col("n") >= least))
    cells = sizes.select("cell", "n", F.explode(F.array(*[F.array(*[F.lit(int(x)).cast("long") for x in s]) for s in shifts])).alias("shift"))
    near = cells.select("cell", F.zip_with("cell", "shift", lambda a, b: a + b).alias("other"))
    near = checkpoint(near.join(sizes.select(F.col("cell").alias("other")), "other"))
    gap2 = F.aggregate(F.zip_with("v", "u", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
    # core points: rows of dense cells, and others with enough rows around
    thin = d.join(dense.select("cell"), "cell", "left_anti")
    around = thin.join(near, "cell").join(d.select(F.col("cell").alias("other"), F.col("v").alias("u")), "other").where(gap2 <= eps * eps).groupBy("id").agg(F.count("*").alias("n"))
    core = checkpoint(d.join(dense.select("cell"), "cell", "left_semi").select("id", "v", "cell").unionByName(thin.join(around.where(F.col("n") >= least), "id", "left_semi").select("id", "v", "cell")))
    inside = core.join(dense.select("cell", "least"), "cell").where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b"))
    # between cells one link is enough: the least pair that is near
    pairs = core.join(near, "cell").join(core.select(F.col("cell").alias("other"), F.col("id").alias("jd"), F.col("v").alias("u")), "other").where("id > jd").where(gap2 <= eps * eps)
    links = pairs.groupBy("cell", "other").agg(F.min(F.struct(F.col("id").alias("a"), F.col("jd").alias("b"))).alias("p")).select("p.a", "p.b")
    thin_links = pairs.join(dense.select("cell"), "cell", "left_anti").select(F.col("id").alias("a"), F.col("jd").alias("b"))
    other_links = pairs.join(dense.select(F.col("cell").alias("other")), "other", "left_anti").select(F.col("id").alias("a"), F.col("jd").alias("b"))
    roots = components(inside.union(links).union(thin_links).union(other_links).distinct())
    named = checkpoint(core.join(roots, core["id"] == roots["node"], "left").select("id", "v", "cell", F.coalesce("root", "id").alias("cluster")))
    edge = thin.join(named.select("id"), "id", "left_anti").join(near, "cell").join(named.select(F.col("cell").alias("other"), F.col("v").alias("u"), "cluster"), "other").where(gap2 <= eps * eps).groupBy("id").agg(F.min("cluster").alias("cluster"))
    found = named.select("id", "cluster").unionByName(edge)
    return d.select("id").join(found, "id", "left").select(F.col("id").alias(key), F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def smote(df: DataFrame, features: list[str], target: str, key: str, k: int = 5, ratio: float = 1.0, seed: int = S.SEED) -> DataFrame:
    """Rows of features and target: all of df, and new ones of the rarer class up to ``ratio`` of the other.

    A new row is x + u * (nn - x), with x a row of the rarer class, nn one of its k nearest in a bounded sample of
    that class, and both nn and u drawn by the hash of x's key; so results don't depend on partitioning. Needs numbers
    without nulls, and more than k rows of the rarer class.
    """
    nulls = df.select(*features).agg(*[F.count_if(F.col(c).isNull()) for c in features]).first()
    if any(nulls):
        raise ValueError("features hold nulls; impute them first")
    sizes = {r[0]: r[1] for r in df.groupBy(target).count().collect()}
    if len(sizes) != 2:
        raise ValueError("the target needs two classes")
    rare, common = sorted(sizes, key=lambda c: (sizes[c], c))
    if sizes[rare] <= k:
        raise ValueError(f"the rarer class needs more than {k} rows")
    own = df.where(F.col(target) == rare).select(F.col(key).cast("string").alias("id"), *[F.col(c).cast("double").alias(c) for c in features])
    points = sampled(own, features)
    missing = max(0, int(sizes[common] * ratio) - sizes[rare])
    each, more = divmod(missing, sizes[rare])
    # the first ``more`` rows in the order of the hash get one new row beside
    from basalt.operators.split import _numbered

    drawn = _numbered(own, "id", [], seed).withColumn("copies", F.lit(each) + (F.col("__i") <= more).cast("int")).where("copies > 0")
    drawn = drawn.select(*own.columns, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))

    def make(batches):
        for pdf in batches:
            x = pdf[features].to_numpy(dtype=float)
            at, _ = nearest(points, x, k + 1)
            out = x.copy()
            for i, (name, copy) in enumerate(zip(pdf["id"], pdf["copy"], strict=True)):
                rng = np.random.default_rng([seed, int(copy), *map(ord, str(name))])
                others = [j for j in at[i] if (points[j] != x[i]).any()][:k] or [at[i][0]]
                out[i] += rng.random() * (points[others[rng.integers(len(others))]] - x[i])
            yield pd.DataFrame(out, columns=features)

    new = drawn.mapInPandas(make, ", ".join(f"`{c}` double" for c in features)).withColumn(target, F.lit(rare))
    return df.select(*[F.col(c).cast("double").alias(c) for c in features], target).unionByName(new.select(*features, F.col(target).cast(df.schema[target].dataType)))


def impute_neighbours(train: DataFrame, columns: list[str], k: int = 5, rows: int = SAMPLE_ROWS):
    """Fill nulls by the mean of the k nearest rows of a bounded sample of train that know the column.

    Distances are over the columns that both rows know, scaled up to all of them; without any, the column's mean fills.
    """
    if len(columns) < 2:
        raise ValueError("neighbours need two columns or more")
    d = train.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in columns])
    n = d.count()
    some = d if n <= rows else d.where(F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) < int(1.1 * rows / n * (1 << 30))).limit(rows)
    x = np.array([[np.nan if v is None else v for v in r] for r in some.collect()], dtype=float).reshape(-1, len(columns))
    means = np.array([np.nan if v is None else v for v in d.agg(*[F.avg(c) for c in columns]).first()], dtype=float)

    @F.pandas_udf("array<double>")
    def fill(values: pd.Series) -> pd.Series:
        q = np.array([[np.nan if v is None else v for v in r] for r in values], dtype=float).reshape(-1, len(columns))
        known, mine = ~np.isnan(x), ~np.isnan(q)
        zero, qz = np.where(known, x, 0.0), np.where(mine, q, 0.0)
        for i in np.flatnonzero((~mine).any(1)):
            both = known & mine[i]
            m = both.sum(1)
            gap = np.where(m > 0, (((zero - qz[i]) ** 2) * both).sum(1) * len(columns) / np.maximum(m, 1), np.inf)
            for j in np.flatnonzero(~mine[i]):
                usable = np.flatnonzero(known[:, j] & np.isfinite(gap))
                near = usable[np.argsort(gap[usable], kind="stable")[:k]]
                q[i, j] = x[near, j].mean() if len(near) else means[j]
        return pd.Series([[None if np.isnan(v) else float(v) for v in r] for r in q])

    def run(df: DataFrame) -> DataFrame:
        d = df.withColumn("__f", fill(F.array(*[F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in columns])))
        return d.withColumns({c: F.col("__f")[i] for i, c in enumerate(columns)}).drop("__f")

    return run
