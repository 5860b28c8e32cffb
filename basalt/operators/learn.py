"""What needs a fitted model beside an operator: tree bins, cluster quality, permutation importance."""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basalt.core import settings as S
from basalt.models.factory import Model
from basalt.operators import metrics as M
from basalt.operators.order import PART_ROWS
from basalt.operators.split import key_order


def kmeans_quality(df: DataFrame, k: int, vector: str = "embedding") -> DataFrame:
    """Size and mean squared distance of every cluster."""
    d = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=S.SEED, maxIter=10).fit(d)
    centers = df.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(model.clusterCenters())], "prediction int, center array<double>")
    near = model.transform(d).join(F.broadcast(centers), "prediction")  # k rows
    gap = F.aggregate(F.zip_with(vector_to_array("features"), "center", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
    return near.groupBy("prediction").agg(F.count("*").alias("n"), F.avg(gap).alias("mean_squared_distance"))


def _shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """``__i`` as by ``split._numbered``; the hash is made again behind the exchange, not carried through it."""
    bucket = F.conv(F.substring(key_order(key, seed), 1, 3), 16, 10).cast("int")
    d = df.withColumn("__b", bucket)
    sizes = d.groupBy("__b").agg(F.count("*").alias("__c"))
    starts = sizes.select(F.col("__b").alias("__b2"), F.coalesce(F.sum("__c").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__s"))  # 4096 rows
    inside = Window.partitionBy("__b").orderBy("__h", key)
    dealt = d.repartition("__b").withColumn("__h", key_order(key, seed)).withColumn("__k", F.row_number().over(inside)).drop("__h", key)
    return dealt.join(F.broadcast(starts), F.col("__b") == F.col("__b2")).withColumn("__i", F.col("__s") + F.col("__k")).drop("__b", "__b2", "__s", "__k")


def permutation_importance(df: DataFrame, features: list[str], target: str, key: str, repeats: int = S.PERMUTATIONS, algorithm: str = "logistic") -> DataFrame:
    """Mean and deviation of the loss of AUC when a feature is permuted over all rows, most important first.

    Rows are numbered in two orders of the key's hash; each takes the value of the row of the same
    number in the other order. One permutation of a repeat serves all features. Scores are dealt once, in ranges, and
    the area under the curve is that within ranges and of ranges below.
    """
    model = Model(algorithm, features, target).fit(df)
    own = df.dropna(subset=[*features, target]).select(key, F.col(target).cast("int").alias(target), *features)
    scores = model.predict(own)
    base = M.ranking_metrics(scores, "score", target).first()["auc"]
    pos, neg = own.agg(F.sum(F.col(target).cast("long")), F.sum(1 - F.col(target).cast("long"))).first()
    parts = math.ceil((pos + neg) / PART_ROWS)
    bounds = sorted(set(scores.approxQuantile("score", [i / parts for i in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    ranges = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol="score", outputCol="__part") if bounds else None
    # many rows of one score, as of a tree, are counted before they are dealt
    tied = parts > 1 and len(bounds) < (parts - 1) // 2
    count = len(bounds) + 1
    areas: dict[int, list[float]] = {k: [] for k in range(len(features))}
    for r in range(repeats):
        here = _shuffled(own, key, 2 * r + 1)
        there = _shuffled(own.select(key, *features), key, 2 * r + 2).withColumnsRenamed({f: f"__{f}" for f in features})
        now = here.join(there, "__i").drop("__i")
        for k, f in enumerate(features):
            d = model.predict(now.withColumnsRenamed({f: f"__own_{f}", f"__{f}": f})).drop("prediction")
            d = d.withColumnsRenamed({f: f"__{f}", f"__own_{f}": f})
            d = ranges.transform(d) if ranges else d.withColumn("__part", F.lit(0))
            now = d.withColumn(f"__s{k}", F.struct((F.lit(k * count) + F.col("__part")).cast("int").alias("cell"), "score")).drop("score", "__part")
        cells = now.select(F.col(target).alias("y"), F.inline(F.array(*[F.col(f"__s{k}") for k in areas])))
        dealt = cells if tied else cells.repartition("cell")
        per = dealt.groupBy("cell", "score").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
        above = Window.partitionBy("cell").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
        area = F.col("n").cast("double") * (F.coalesce(F.sum("p").over(above), F.lit(0)) + F.col("p") / 2)
        rows = per.select("cell", "p", "n", area.alias("a")).groupBy("cell").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum("a").alias("a")).collect()
        for k in areas:
            before, total = 0, 0.0
            for x in sorted((x for x in rows if x["cell"] // count == k), key=lambda x: -x["cell"]):
                total += x["a"] + x["n"] * before
                before += x["p"]
            areas[k].append(total / (pos * neg))
    rows = []
    for k, f in enumerate(features):
        drops = [base - a for a in areas[k]]
        mean = sum(drops) / len(drops)
        rows.append((f, mean, (sum((x - mean) ** 2 for x in drops) / len(drops)) ** 0.5))
    ranked = sorted(rows, key=lambda x: (-x[1], x[0]))
    return df.sparkSession.createDataFrame([(f, float(m), float(s), i + 1) for i, (f, m, s) in enumerate(ranked)], "feature string, importance double, std double, rank int")


def tree_edges(train: DataFrame, column: str, target: str, bins: int = 10, least: float = 0.05) -> list[float]:
    """Edges of bins by a decision tree on one column, each leaf with a share of at least ``least`` of the rows.

    A classifier up to 20 distinct targets, a regressor beyond. The tree is as deep as ``bins`` leaves
    allow; its candidate splits are MLlib's quantile splits, so data of any size fits. The outer edges
    lie one beyond the range. Rows with a null column or target are left out; without any there are no edges.
    """
    d = train.select(array_to_vector(F.array(F.col(column).cast("double"))).alias("features"), F.col(target).cast("double").alias("label"), F.col(column).cast("double").alias("x")).dropna(subset=["label", "x"])
    lo, hi, n, classes, worst, whole = d.agg(F.min("x"), F.max("x"), F.count("*"), F.count_distinct("label"), F.min("label"), F.every(F.col("label") == F.floor("label"))).first()
    if not n:
        return []
    sorts = classes <= S.MAX_CLASSES and whole and worst >= 0
    tree = (DecisionTreeClassifier if sorts else DecisionTreeRegressor)(maxDepth=max(int(math.log2(bins)), 1), maxBins=256, minInstancesPerNode=max(int(least * n), 1), seed=S.SEED)
    inner = re.findall(r"feature 0 <= ([-+0-9.Ee]+)\)", tree.fit(d).toDebugString)
    return sorted({lo - 1, hi + 1, *map(float, inner)})
