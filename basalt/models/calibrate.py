"""Calibration of scores: isotonic, Platt and beta, with the expected error before and after."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.core import settings as S
from basalt.operators import metrics as M

METHODS = ("isotonic", "platt", "beta")


def _newton(df: DataFrame, features: list[Column], label: str, rounds: int = 25) -> list[float]:
    """Weights and bias of a logistic model by Newton's method; a round is one aggregate of gradient and Hessian."""
    x = [*features, F.lit(1.0)]
    k, w = len(x), np.zeros(len(x))
    y = F.col(label).cast("double")
    for _ in range(rounds):
        z = sum((float(w[i]) * x[i] for i in range(k)), F.lit(0.0))
        p = 1 / (1 + F.exp(-z))
        r = df.agg(*[F.sum((y - p) * c) for c in x], *[F.sum(p * (1 - p) * x[i] * x[j]) for i in range(k) for j in range(k)]).first()
        if r[0] is None:
            return w.tolist()
        step = np.linalg.solve(np.array(r[k:]).reshape(k, k) + 1e-9 * np.eye(k), np.array(r[:k]))
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


class Calibrator:
    """Maps a score to a calibrated one; null stays null.

    isotonic: the least-squares rising steps, linear between them, constant beyond; platt: a logistic of the score;
    beta: a logistic of ln(p) and -ln(1 - p) whose weights are not negative, falling back to isotonic where one is.
    """

    def __init__(self, method: str = "isotonic", bins: int = 10) -> None:
        if method not in METHODS:
            raise ValueError(f"no calibration is called {method}; there are {', '.join(METHODS)}")
        self.method, self.bins, self.used = method, bins, method
        self.weights: list[float] = []
        self.steps: tuple[list[float], list[float]] = ([], [])
        self.before = self.after = None

    def fit(self, df: DataFrame, score: str, label: str) -> Calibrator:
        d = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(F.col(score).cast("double").alias("p"), F.col(label).cast("int").alias("y"))
        kinds = d.agg(F.min("y"), F.max("y")).first()
        if tuple(kinds) != (0, 1):
            raise ValueError("calibration needs both classes")
        p = F.greatest(F.least(F.col("p"), F.lit(1 - 1e-6)), F.lit(1e-6))
        if self.method == "platt":
            self.weights = _newton(d, [F.col("p")], "y")
        elif self.method == "beta":
            a, b, c = _newton(d, [F.log(p), -F.log(1 - p)], "y")
            self.weights = [a, b, c]
            if a < 0 or b < 0 or not all(map(math.isfinite, (a, b, c))):
                self.used = "isotonic"
        if self.used == "isotonic":
            # one row a distinct score, weighted by its rows
            by = d.groupBy("p").agg(F.avg("y").alias("label"), F.count("*").cast("double").alias("w")).withColumnRenamed("p", "features")
            model = IsotonicRegression(weightCol="w").fit(by)
            self.steps = (list(model.boundaries.toArray()), list(model.predictions.toArray()))
        self.before = M.ece(d, "p", "y", self.bins).first()["ece"]
        self.after = M.ece(d.withColumn("q", self.output(F.col("p"))), "q", "y", self.bins).first()["ece"]
        return self

    def output(self, score: Column) -> Column:
        s = score.cast("double")
        if self.used == "platt":
            return 1 / (1 + F.exp(-(self.weights[0] * s + self.weights[1])))
        if self.used == "beta":
            p = F.greatest(F.least(s, F.lit(1 - 1e-6)), F.lit(1e-6))
            a, b, c = self.weights
            return 1 / (1 + F.exp(-(a * F.log(p) - b * F.log(1 - p) + c)))
        xs, ys = self.steps
        law_x, law_y = np.array(xs), np.array(ys)

        @F.pandas_udf("double")
        def steps(v):
            return type(v)(np.interp(v.to_numpy(dtype=float), law_x, law_y))

        return F.when(s.isNotNull(), steps(s))

    def transform(self, df: DataFrame, score: str, out: str = "calibrated") -> DataFrame:
        held = F.greatest(F.least(self.output(F.col(score)), F.lit(1.0)), F.lit(0.0))
        return df.withColumn(out, F.when(F.col(score).isNotNull(), held))

    def recommended(self) -> bool:
        """Whether the expected error falls by more than a thousandth."""
        return self.before is not None and self.before - self.after > S.ECE_GAIN

    def state(self) -> dict:
        return {"method": self.method, "used": self.used, "weights": self.weights, "steps": [list(x) for x in self.steps], "before": self.before, "after": self.after, "bins": self.bins}

    @classmethod
    def from_state(cls, state: dict) -> Calibrator:
        c = cls(state["method"], state["bins"])
        c.used, c.weights, c.steps, c.before, c.after = state["used"], state["weights"], tuple(state["steps"]), state["before"], state["after"]
        return c
