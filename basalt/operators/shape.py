"""Stages that reshape numbers: quantile maps, spline bases, principal components and noise."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.core import settings as S
from basalt.core.lineage import checkpoint
from basalt.operators.features import Stage
from basalt.operators.order import column_quantiles
from basalt.operators.relation import gram


def _uniform(key: str, seed: int, draw: int) -> Column:
    """Number in (0, 1) from the md5 of key, seed and draw: the same in every partitioning."""
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)), F.lit(str(draw))))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + 0.5) / F.lit(float(2**32))


def quantile_map(train: DataFrame, column: str, output: str = "uniform", quantiles: int = S.QUANTILES) -> Stage:
    """Place of each value among train's quantiles, linear between them, in 0 to 1 or as a normal score.

    Ties take the middle of the places they span; values at or beyond the ends become the ends, null
    stays null. Train without values gives null.
    """
    n = min(quantiles, train.where(F.col(column).isNotNull()).count())
    levels = [i / max(n - 1, 1) for i in range(max(n, 1))]
    edges = np.array(column_quantiles(train, [column], levels).get(column, []), dtype=float)
    # normal scores by inverting a table of the distribution; ends as far as 1e-7 of either tail
    z = np.linspace(-5.2, 5.2, 20_801)
    tail = NormalDist().inv_cdf(1 - 1e-7)
    cumulative = np.array([NormalDist().cdf(x) for x in z])

    @F.pandas_udf("double")
    def place(x: pd.Series) -> pd.Series:
        v, at = x.to_numpy(dtype=float), np.linspace(0, 1, len(edges))
        got = (np.interp(v, edges, at) + 1 - np.interp(-v, -edges[::-1], 1 - at[::-1])) / 2
        got = np.where(v <= edges[0], 0.0, np.where(v >= edges[-1], 1.0, got))
        if output == "normal":
            got = np.clip(np.interp(got, cumulative, z), -tail, tail)
        return pd.Series(got).where(x.notna().to_numpy(), None)

    c = F.col(column).cast("double")
    return lambda df: df.withColumn(column, F.when(c.isNotNull(), place(c)) if len(edges) else F.lit(None).cast("double"))


def spline(train: DataFrame, column: str, knots: int = S.KNOTS, degree: int = S.SPLINE_DEGREE) -> Stage:
    """B-spline basis on evenly spaced knots over train's range, the last function left out; constant beyond it.

    Functions of such a basis are shifts of one, a sum of truncated powers, so each is one expression.
    A constant column counts as the start of its range; null stays null.
    """
    lo, hi = train.agg(F.min(F.col(column).cast("double")), F.max(F.col(column).cast("double"))).first()
    if lo is None:
        return lambda df: df.withColumns({f"{column}_sp_{k}": F.lit(None).cast("double") for k in range(knots + degree - 2)})
    step = (hi - lo) / (knots - 1) or 1.0
    x = F.col(column).cast("double")
    u = F.when(x.isNotNull(), (F.greatest(F.least(x, F.lit(hi)), F.lit(lo)) - lo) / step)

    def shifted(k: int) -> Column:
        t = u + float(degree - k)
        terms = [(-1) ** i * math.comb(degree + 1, i) * F.pow(F.greatest(t - float(i), F.lit(0.0)), F.lit(float(degree))) for i in range(degree + 2)]
        return F.when(u.isNotNull(), sum(terms[1:], terms[0]) / math.factorial(degree))

    return lambda df: df.withColumns({f"{column}_sp_{k}": shifted(k) for k in range(knots + degree - 2)})


def pca(train: DataFrame, columns: list[str], components: int | float = S.COMPONENTS, prefix: str = "pc") -> Stage:
    """Columns replaced by their principal components; null counts as 0.

    A fraction keeps as many components as explain that share of the variance. The largest loading
    of each component is positive. Train only gives sums of products, columns squared numbers.
    """
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns}
    g, s, n = gram(train.select(*[v.alias(c) for c, v in filled.items()]), columns)
    mean = s / max(n, 1)
    values, vectors = np.linalg.eigh(g / max(n, 1) - np.outer(mean, mean))
    order = np.argsort(values)[::-1]
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    if isinstance(components, float) and components < 1:
        share = np.cumsum(values) / max(values.sum(), 1e-12)
        keep = min(int(np.searchsorted(share, components - 1e-12)) + 1, len(columns))
    else:
        keep = min(int(components), len(columns), max(n, 1))
    vectors = vectors * np.sign(vectors[np.argmax(np.abs(vectors), axis=0), np.arange(len(columns))])

    def made(k: int) -> Column:
        parts = [(filled[c] - float(mean[i])) * float(vectors[i, k]) for i, c in enumerate(columns)]
        return sum(parts[1:], parts[0]).alias(f"{prefix}{k + 1}")

    return lambda df: df.select(*[c for c in df.columns if c not in columns], *[made(k) for k in range(keep)])


def noise(train: DataFrame, column: str, key: str, kind: str = "gaussian", scale: float = S.NOISE, rows: float = S.NOISE_ROWS, seed: int = S.SEED) -> Stage:
    """Noise of ``scale`` standard deviations on a share of rows, drawn by the md5 of a key; null stays null."""
    width = scale * (train.agg(F.stddev_samp(column)).first()[0] or 0.0)
    chosen, u, v = (_uniform(key, seed, i) for i in range(3))
    draws = {
        "uniform": 2 * u - 1,
        "laplace": -F.signum(u - 0.5) * F.log(1 - 2 * F.abs(u - 0.5)),
        "gaussian": F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v),
    }
    if kind not in draws:
        raise ValueError(f"no noise is called {kind}; there are {', '.join(draws)}")
    c = F.col(column).cast("double")
    return lambda df: df.withColumn(column, F.when(chosen < rows, c + width * draws[kind]).otherwise(c))


#: Patterns of missing values that are summed apart, and those that are written out as expressions.
MOST_PATTERNS, EXPRESSED = 4096, 32


def impute_iterative(train: DataFrame, columns: list[str], rounds: int = S.ROUNDS, ridge: float = 1e-6) -> Stage:
    """Nulls by chained regressions: each column in turn is fitted on the others, as filled so far.

    Starts from means; a column without nulls in train is only a predictor, one without any value
    stays null; NaN is null. What is filled is a line in the known values of a row, one for each pattern of missing
    values, so sums of products by pattern, one aggregate, serve all rounds. With very many patterns the
    values are filled and checkpointed once a round instead.
    """
    value = {c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in columns}
    first = train.agg(*[F.avg(value[c]) for c in columns], *[F.count_if(value[c].isNull()) for c in columns]).first()
    k = len(columns)
    used = [c for c, m in zip(columns, first[:k], strict=True) if m is not None]
    means = [m for m in first[:k] if m is not None]
    gaps = [i for i, c in enumerate(used) if first[k + columns.index(c)]]
    size = len(used)
    steps: list[tuple[int, list[float], float]] = []

    def step(i: int, g: np.ndarray, s: np.ndarray, n: int) -> tuple[int, list[float], float]:
        others = [j for j in range(size) if j != i]
        cov = g / n - np.outer(s / n, s / n)
        part = cov[np.ix_(others, others)]
        part = part + ridge * np.diag(np.maximum(np.diag(part), 1e-12))
        w = np.zeros(size)
        w[others] = np.linalg.solve(part, cov[others, i])
        return i, w.tolist(), float(s[i] / n - w @ s / n)

    def start(gone: frozenset[int]) -> np.ndarray:
        """Rows of the filled columns in terms of 1 and the known values."""
        a = np.zeros((size + 1, size + 1))
        for j in range(-1, size):
            a[j + 1, 0 if j in gone else j + 1] = means[j] if j in gone else 1.0
        return a

    def advance(a: np.ndarray, i: int, w: list[float], b: float) -> None:
        a[i + 1] = np.array([b, *w]) @ a

    bits = sum((F.when(value[used[i]].isNull(), F.lit(1 << b)).otherwise(F.lit(0)).cast("long") for b, i in enumerate(gaps)), F.lit(0).cast("long")) if len(gaps) < 63 else None

    def pattern(mask: int) -> frozenset[int]:
        return frozenset(i for b, i in enumerate(gaps) if mask >> b & 1)

    if size > 1 and gaps and rounds:
        few = bits is not None and (1 << len(gaps) <= MOST_PATTERNS or train.select(bits.alias("m")).distinct().limit(MOST_PATTERNS + 1).count() <= MOST_PATTERNS)
        if few:
            x = [F.coalesce(value[c], F.lit(0.0)) for c in used]
            pairs = [(i, j) for i in range(size) for j in range(i, size)]
            rows = train.groupBy(bits.alias("m")).agg(F.count("*").alias("n"), *[F.sum(v).alias(f"s{i}") for i, v in enumerate(x)], *[F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in pairs]).collect()
            sums = []
            for r in rows:
                g = np.zeros((size + 1, size + 1))
                g[0, 0] = r["n"]
                for i in range(size):
                    g[0, i + 1] = g[i + 1, 0] = r[f"s{i}"]
                for i, j in pairs:
                    g[i + 1, j + 1] = g[j + 1, i + 1] = r[f"p{i}_{j}"]
                sums.append((pattern(r["m"]), g, start(pattern(r["m"]))))
            for _ in range(rounds):
                for i in gaps:
                    g = sum(a @ m @ a.T for gone, m, a in sums if i not in gone)
                    steps.append(step(i, g[1:, 1:], g[0, 1:], g[0, 0]))
                    for gone, _, a in sums:
                        if i in gone:
                            advance(a, *steps[-1])
        else:
            now = train.select(*[F.coalesce(value[c], F.lit(float(means[j]))).alias(f"x{j}") for j, c in enumerate(used)], *[value[used[i]].isNull().alias(f"gone{i}") for i in gaps])
            for _ in range(rounds):
                for i in gaps:
                    steps.append(step(i, *gram(now.where(~F.col(f"gone{i}")), [f"x{j}" for j in range(size)])))
                    _, w, b = steps[-1]
                    line = sum((F.col(f"x{j}") * float(v) for j, v in enumerate(w) if v), F.lit(float(b)))
                    now = now.withColumn(f"x{i}", F.when(F.col(f"gone{i}"), line).otherwise(F.col(f"x{i}")))
                now = checkpoint(now)

    def lines() -> dict[int, Column]:
        """Filled values of the columns with gaps, a case for each pattern."""
        known = [F.coalesce(value[c], F.lit(0.0 if j in gaps else float(means[j]))) for j, c in enumerate(used)]
        out = {i: value[used[i]] for i in gaps}
        for mask in range(1, 1 << len(gaps)):
            gone, a = pattern(mask), start(pattern(mask))
            for s in steps:
                if s[0] in gone:
                    advance(a, *s)
            for i in gone:
                out[i] = F.when(bits == mask, sum((known[j] * float(v) for j, v in enumerate(a[i + 1, 1:]) if v), F.lit(float(a[i + 1, 0])))).otherwise(out[i])
        return out

    @F.pandas_udf("array<double>")
    def fill(rows: pd.Series) -> pd.Series:
        x = np.array([[np.nan if v is None else v for v in r] for r in rows], dtype=float).reshape(len(rows), len(used))
        gone = np.isnan(x)
        x = np.where(gone, means, x)
        for i, w, b in steps:
            x[gone[:, i], i] = x[gone[:, i]] @ np.array(w) + b
        return pd.Series(list(x))

    def run(df: DataFrame) -> DataFrame:
        if 1 << len(gaps) <= EXPRESSED:
            filled = lines()
            return df.withColumns({c: filled[j] if j in filled else F.coalesce(value[c], F.lit(float(means[j]))) for j, c in enumerate(used)})
        d = df.withColumn("__f", fill(F.array(*[value[c] for c in used])))
        return d.withColumns({c: F.col("__f")[i] for i, c in enumerate(used)}).drop("__f")

    return run if used else lambda df: df
