"""Explanations: Shapley values of any model, their stability, local surrogates and partial dependence."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.core import settings as S
from basalt.core.lineage import checkpoint
from basalt.models.factory import Model
from basalt.operators.order import column_quantiles, mode

#: Rows explained by sampling, and orders of features drawn for each (documented bounds; linear models explain all rows).
ROWS, ORDERS = 500, 10


def linear_weights(model: Model) -> list[float] | None:
    """Weights of the unscaled features if the model is linear in them."""
    last = model.fitted.stages[-1] if model.fitted else None
    if not hasattr(last, "coefficients"):
        return None
    sds = model.fitted.stages[1].std.toArray()
    return [float(w) / (float(s) or 1.0) for w, s in zip(last.coefficients.toArray(), sds, strict=True)]


def shap_values(model: Model, df: DataFrame, key: str, background: DataFrame | None = None, rows: int = ROWS, orders: int = ORDERS, seed: int = S.SEED) -> DataFrame:
    """(key, feature, value, shap): contributions to the score (for linear models to its log odds).

    Linear models: weight * (x - mean), for all rows. Others: mean change of the score as features go, in random
    orders, from a background row's values to the row's own, for a sample of rows; contributions of one row add up to
    its score less that of its background rows. All hybrids are scored in one distributed pass.
    """
    features = model.features
    d = df.dropna(subset=features)
    weights = linear_weights(model)
    if weights is not None:
        means = d.agg(*[F.avg(c) for c in features]).first()
        parts = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"), (F.lit(w) * (F.col(c) - F.lit(float(m)))).alias("shap")) for c, w, m in zip(features, weights, means, strict=True)]
        return d.select(key, F.inline(F.array(*parts)))
    total = d.count()
    some = d if total <= rows else d.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(1.2 * rows / total * (1 << 30))).limit(rows)
    some = checkpoint(some.select(key, *[F.col(c).cast("double").alias(c) for c in features]))
    base = (background if background is not None else d).dropna(subset=features)
    n = base.count()
    others = base.select(*features).where(F.pmod(F.xxhash64(*features), F.lit(1 << 30)) < int(min(1.0, 3.0 * orders / max(n, 1)) * (1 << 30))).limit(orders).collect() or base.select(*features).limit(orders).collect()
    rng = random.Random(seed)
    steps = []
    for o in range(orders):
        row, order = others[o % len(others)], list(range(len(features)))
        rng.shuffle(order)
        for k in range(len(order) + 1):  # the first k features of the order are the row's own
            mine = set(order[:k])
            steps.append(F.struct(F.lit(o).alias("o"), F.lit(k).alias("k"), F.lit(features[order[k - 1]] if k else None).cast("string").alias("moved"), *[(F.col(c) if i in mine else F.lit(float(row[c]))).alias(f"h_{i}") for i, c in enumerate(features)]))
    hybrids = some.select(F.col(key).alias("__key"), F.inline(F.array(*steps))).withColumnsRenamed({f"h_{i}": c for i, c in enumerate(features)})
    scored = model.predict(hybrids).select("__key", "o", "k", "moved", "score")
    per_order = scored.groupBy("__key", "o").agg(F.array_sort(F.collect_list(F.struct("k", "moved", "score"))).alias("s"))  # one more than the features
    gains = per_order.select("__key", F.inline(F.transform(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.struct(F.element_at("s", (i + 1).cast("int"))["moved"].alias("feature"), (F.element_at("s", (i + 1).cast("int"))["score"] - F.element_at("s", i.cast("int"))["score"]).alias("gain")))))
    mean = gains.groupBy("__key", "feature").agg(F.avg("gain").alias("shap"))
    values = some.select(F.col(key).alias("__key"), F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in features])))
    return mean.join(values, ["__key", "feature"]).select(F.col("__key").alias(key), "feature", "value", "shap")


def mean_shap(values: DataFrame) -> DataFrame:
    """(feature, mean_abs_shap, rank), most important first."""
    rows = values.groupBy("feature").agg(F.avg(F.abs("shap")).alias("m")).collect()
    ranked = sorted(rows, key=lambda r: (-r["m"], r["feature"]))
    return values.sparkSession.createDataFrame([(r["feature"], r["m"], i + 1) for i, r in enumerate(ranked)], "feature string, mean_abs_shap double, rank int")


def shap_table(df: DataFrame, features: list[str], target: str, algorithm: str = "logistic") -> DataFrame:
    """``mean_shap`` of a model that is fitted to df first."""
    d = df.withColumn("__id", F.xxhash64(*features))
    return mean_shap(shap_values(Model(algorithm, features, target).fit(df), d, "__id"))


def waterfall(values: DataFrame, key: str, of: object) -> DataFrame:
    """(feature, value, shap) of one row, greatest contribution first."""
    return values.where(F.col(key) == F.lit(of)).select("feature", "value", "shap").orderBy(F.desc(F.abs("shap")), "feature")


def dependence(values: DataFrame, feature: str) -> DataFrame:
    """(value, shap) of one feature, to be drawn against each other."""
    return values.where(F.col("feature") == feature).select("value", "shap")


def bootstrap_shap(model: Model, df: DataFrame, key: str, batches: int = 10, rows: int = 2000, seed: int = S.SEED) -> tuple[DataFrame, DataFrame]:
    """(batch, key, feature, value, shap) of batches drawn by hash, and (feature, mean, std, low, high, cv, rank) over them.

    low and high hold 95 of 100 batch means if those are normal; cv is the deviation over the mean: the lower, the stabler.
    """
    total = df.count()
    share = min(1.0, rows / max(total, 1))
    parts = []
    for b in range(batches):
        own = df.where(F.pmod(F.xxhash64(F.lit(seed + b), F.col(key)), F.lit(1 << 30)) < int(share * (1 << 30)))
        parts.append(shap_values(model, own, key, df, seed=seed + b).withColumn("batch", F.lit(b)))
    rows_of = parts[0]
    for p in parts[1:]:
        rows_of = rows_of.unionByName(p)
    rows_of = checkpoint(rows_of)
    means = rows_of.groupBy("batch", "feature").agg(F.avg(F.abs("shap")).alias("m"))
    stats = means.groupBy("feature").agg(F.avg("m").alias("mean"), F.coalesce(F.stddev_samp("m"), F.lit(0.0)).alias("std")).collect()
    ranked = sorted(stats, key=lambda r: (-r["mean"], r["feature"]))
    table = [(r["feature"], r["mean"], r["std"], r["mean"] - 1.96 * r["std"], r["mean"] + 1.96 * r["std"], r["std"] / r["mean"] if r["mean"] else None, i + 1) for i, r in enumerate(ranked)]
    return rows_of, df.sparkSession.createDataFrame(table, "feature string, mean double, std double, low double, high double, cv double, rank int")


def lime(model: Model, df: DataFrame, row: dict, samples: int = 1000, width: float = 0.75, seed: int = S.SEED) -> DataFrame:
    """(feature, weight): a ridge of the score on scaled perturbations of one row, weighted by nearness."""
    features = model.features
    r = df.agg(*[x for c in features for x in (F.avg(c), F.stddev_pop(c))]).first()
    sd = np.array([r[2 * i + 1] or 1.0 for i in range(len(features))], dtype=float)
    at = np.array([float(row[c]) for c in features])
    z = np.random.default_rng(seed).normal(size=(samples, len(features)))
    z[0] = 0
    d = df.sparkSession.createDataFrame([(i, *map(float, at + x * sd)) for i, x in enumerate(z)], "__i int, " + ", ".join(f"`{c}` double" for c in features))
    got = {x["__i"]: x["score"] for x in model.predict(d).select("__i", "score").collect()}
    y = np.array([got[i] for i in range(samples)])
    k = width * math.sqrt(len(features))
    w = np.exp(-(z**2).sum(1) / (2 * k * k))
    x = np.concatenate([z, np.ones((samples, 1))], 1)
    beta = np.linalg.solve((x.T * w) @ x + 1e-3 * np.eye(x.shape[1]), (x.T * w) @ y)
    rows = sorted(zip(features, beta[:-1].tolist(), strict=True), key=lambda t: (-abs(t[1]), t[0]))
    return df.sparkSession.createDataFrame(rows, "feature string, weight double")


def partial_dependence(model: Model, df: DataFrame, feature: str, points: int = 50, rows: int = 2000) -> DataFrame:
    """(value, mean_score) over a grid of the feature's quantiles, or over its values if it has fewer; of a sample of rows."""
    d = df.dropna(subset=model.features)
    n = d.count()
    some = d.select(*model.features)
    if n > rows:
        some = some.where(F.pmod(F.xxhash64(*model.features), F.lit(1 << 30)) < int(1.1 * rows / n * (1 << 30))).limit(rows)
    kinds = [r[0] for r in d.select(F.col(feature).cast("double").alias("v")).distinct().limit(points + 1).collect()]
    grid = sorted(kinds) if len(kinds) <= points else sorted(set(column_quantiles(d, [feature], [i / (points - 1) for i in range(points)])[feature]))
    spread = some.select(*[c for c in model.features if c != feature], F.explode(F.array(*[F.lit(float(x)) for x in grid])).alias(feature))
    return model.predict(spread).groupBy(F.col(feature).alias("value")).agg(F.avg("score").alias("mean_score"))


def thresholds(curve: DataFrame, least_slope: float = 0.001, least_rise: float = 0.01) -> list[dict[str, float]]:
    """Places of a partial dependence after which the mean score is by ``least_rise`` above its start, at a slope of ``least_slope``."""
    rows = sorted((r["value"], r["mean_score"]) for r in curve.collect())
    out = []
    for (x, a), (y, b) in zip(rows, rows[1:], strict=False):
        slope = (b - a) / (y - x)
        if abs(slope) >= least_slope and b - rows[0][1] >= least_rise:
            out.append({"value": x, "before": a, "after": b, "slope": slope})
    return out


def dependence_summary(curves: dict[str, DataFrame]) -> list[dict]:
    """Start, peak, trough and range of each curve, the widest first."""
    out = []
    for f, c in curves.items():
        y = [r["mean_score"] for r in sorted(c.collect(), key=lambda r: r["value"])]
        if y:
            out.append({"feature": f, "points": len(y), "baseline": y[0], "peak": max(y), "trough": min(y), "range": max(y) - min(y)})
    return sorted(out, key=lambda r: (-r["range"], r["feature"]))


def categorical_dependence(model: Model, df: DataFrame, encode, column: str, values: list[str] | None = None) -> DataFrame:
    """(value, mean_score) with a category set for all rows before ``encode`` makes the model's features."""
    found = values or [r[0] for r in df.where(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).limit(50).collect()] or [mode(df, column)]
    parts = [model.predict(encode(df.withColumn(column, F.lit(v)))).agg(F.avg("score").alias("mean_score")).select(F.lit(v).alias("value"), "mean_score") for v in found]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
