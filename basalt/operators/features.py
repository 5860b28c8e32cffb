"""Feature stages: ``fit`` is one small aggregate, ``transform`` a projection.

Every builder takes the training frame and returns a function of a frame, so that the state learned
on train applies to other splits. Category states are joined; a dictionary of categories is
broadcast only when its counted rows are few.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations, combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.core import settings as S
from basalt.core.lineage import checkpoint
from basalt.core.schema import buckets, non_numeric, numeric
from basalt.operators.order import column_quantiles, mode, running
from basalt.operators.profile import skewness

Stage = Callable[[DataFrame], DataFrame]
BROADCAST_ROWS = 500_000


def _each(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    return df.withColumns(new)


def _lookup(df: DataFrame, state: DataFrame, column: str, value: str, out: str, default: Column) -> DataFrame:
    """Left join of a category state; its size is counted before it is broadcast."""
    key = f"__{column}"
    side = state.withColumnRenamed(column, key).select(key, F.col(value).alias("__v"))
    side = F.broadcast(side) if side.count() <= BROADCAST_ROWS else side
    joined = df.join(side, df[column] == F.col(key), "left")
    return joined.withColumn(out, F.coalesce("__v", default)).drop(key, "__v")


def impute(train: DataFrame, columns: list[str], strategy: str = "auto", fill: object = None, indicator_rate: float | None = S.INDICATOR_RATE, strategies: dict[str, str] | None = None, fills: dict[str, object] | None = None) -> Stage:
    """Fill columns that have nulls in train; numeric ``auto`` is the mean below a skewness of 0.5, else the median.

    ``strategies`` and ``fills`` override the strategy and the constant of single columns.
    """
    nums, strategies, fills = set(numeric(train)), strategies or {}, fills or {}
    aggs = [F.count("*").alias("n")]
    for c in columns:
        aggs.append(F.count(c).alias(f"{c}__n"))
        if c in nums:
            aggs += [F.avg(c).alias(f"{c}__mean"), skewness(c).alias(f"{c}__skew")]
    r = train.agg(*aggs).first()
    gaps = [c for c in columns if r[f"{c}__n"] < r["n"]]
    how = {}
    for c in gaps:
        wish = strategies.get(c, strategy)
        if c in nums:
            how[c] = ("mean" if abs(r[f"{c}__skew"] or 0.0) < S.IMPUTE_SKEW else "median") if wish == "auto" else wish
        else:
            how[c] = "constant" if wish == "constant" else "most_frequent"
        if c in nums and not r[f"{c}__n"] and how[c] != "constant":
            del how[c]
    medians = column_quantiles(train, [c for c, h in how.items() if h == "median"], [0.5]) if "median" in how.values() else {}
    values = {}
    for c, h in how.items():
        if h == "constant":
            values[c] = fills.get(c, fill) if fills.get(c, fill) is not None else 0 if c in nums else "MISSING"
        else:
            values[c] = r[f"{c}__mean"] if h == "mean" else medians[c][0] if h == "median" else mode(train, c)
    flags = [c for c in how if c in nums and indicator_rate is not None and 1 - r[f"{c}__n"] / max(1, r["n"]) > indicator_rate]
    return lambda df: df.withColumns({f"{c}_was_missing": F.col(c).isNull().cast("int") for c in flags}).withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()})


def clip_limits(train: DataFrame, columns: list[str], method: str, multiplier: float | None = None, lower: float = S.WINSOR, upper: float = S.WINSOR) -> dict[str, tuple[float, float]]:
    """Limits by winsor, iqr, zscore or mad; a column without spread has none."""
    if method == "winsor":
        return {c: (q[0], q[1]) for c, q in column_quantiles(train, columns, [lower, 1 - upper]).items()}
    if method == "mad":
        m = {c: q[0] for c, q in column_quantiles(train, columns, [0.5]).items()}
        gaps = train.select(*[F.abs(F.col(c) - F.lit(v)).alias(c) for c, v in m.items()])
        d = {c: q[0] for c, q in column_quantiles(gaps, list(m), [0.5]).items()} if m else {}
        k = S.MAD_LIMIT if multiplier is None else multiplier
        return {c: (m[c] - k * 1.4826 * v, m[c] + k * 1.4826 * v) for c, v in d.items() if v}
    if method == "zscore":
        r = train.agg(*[x for c in columns for x in (F.avg(c), F.stddev_samp(c))]).first()
        k = S.Z_LIMIT if multiplier is None else multiplier
        return {c: (r[2 * i] - k * r[2 * i + 1], r[2 * i] + k * r[2 * i + 1]) for i, c in enumerate(columns) if r[2 * i + 1]}
    k = S.IQR_FACTOR if multiplier is None else multiplier
    return {c: (a - k * (b - a), b + k * (b - a)) for c, (a, b) in column_quantiles(train, columns, [0.25, 0.75]).items() if b > a}


def clip(train: DataFrame, columns: list[str], method: str = "winsor", **how) -> Stage:
    limits = clip_limits(train, columns, method, **how)
    return lambda df: _each(df, {c: F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c).cast("double"), F.lit(hi)), F.lit(lo))) for c, (lo, hi) in limits.items()})


def scale_parameters(train: DataFrame, columns: list[str], strategy: str) -> dict[str, tuple[float, float]]:
    """(centre, width) of each column, nulls counted as 0; a column without spread has width 1."""
    filled = train.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    if strategy == "robust":
        found = {c: (b, d - a) for c, (a, b, d) in column_quantiles(filled, columns, [0.25, 0.5, 0.75]).items()}
    else:
        parts = {"standard": lambda c: (F.avg(c), F.stddev_pop(c)), "minmax": lambda c: (F.min(c), F.max(c) - F.min(c)), "max_abs": lambda c: (F.lit(0.0), F.max(F.abs(c)))}[strategy]
        r = filled.agg(*[x for c in columns for x in parts(c)]).first()
        found = {c: (r[2 * i], r[2 * i + 1]) for i, c in enumerate(columns)}
    return {c: (found.get(c, (0.0, 1.0))[0] or 0.0, found.get(c, (0.0, 1.0))[1] or 1.0) for c in columns}


def scale(train: DataFrame, columns: list[str], strategy: str = "robust", centering: bool = True, scaling: bool = True, empty: float = 0.0) -> Stage:
    """Nulls count as 0, at fit and at transform; ``empty`` is what l2_norm makes of rows of zeros only."""
    if strategy == "l2_norm":
        norm = F.sqrt(sum((F.pow(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(2)) for c in columns), F.lit(0.0)))
        return lambda df: df.withColumn("__norm", norm).withColumns({c: F.when(F.col("__norm") == 0, empty).otherwise(F.try_divide(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.col("__norm"))) for c in columns}).drop("__norm")
    if strategy == "none":
        return lambda df: df
    return scaled(scale_parameters(train, columns, strategy), centering, scaling)


def scaled(parameters: dict[str, tuple[float, float]], centering: bool = True, scaling: bool = True) -> Stage:
    return lambda df: _each(df, {c: (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.lit(a if centering else 0.0)) / F.lit(b if scaling else 1.0) for c, (a, b) in parameters.items()})


def unscaled(train: DataFrame, columns: list[str], strategy: str = "robust", centering: bool = True, scaling: bool = True) -> Stage:
    """The inverse of ``scale``; row-wise norms can't be undone."""
    if strategy == "l2_norm":
        raise NotImplementedError("the norm of a row is not kept")
    if strategy == "none":
        return lambda df: df
    parameters = scale_parameters(train, columns, strategy)
    return lambda df: _each(df, {c: F.col(c) * F.lit(b if scaling else 1.0) + F.lit(a if centering else 0.0) for c, (a, b) in parameters.items()})


#: Shape, and the least value that training data may have (None: any; exclusive with True).
SHAPES: dict[str, tuple[Callable[[Column], Column], float | None, bool]] = {
    "log": (F.log, 0.0, True), "log1p": (F.log1p, -1.0, True), "sqrt": (F.sqrt, 0.0, False), "cbrt": (F.cbrt, None, False), "reciprocal": (lambda c: F.try_divide(F.lit(1.0), c), None, False),
}

#: Shapes that have a limit at the edge of their domain, and none beyond: as IEEE 754 has it, infinite at the edge and NaN beyond.
LIMITS: dict[str, Callable[[Column], Column]] = {
    "log": lambda c: F.when(c > 0, F.log(c)).when(c == 0, -math.inf).when(c < 0, math.nan), "log1p": lambda c: F.when(c > -1, F.log1p(c)).when(c == -1, -math.inf).when(c < -1, math.nan),
    "reciprocal": lambda c: F.when(c == 0, F.pow(c, F.lit(-1.0))).otherwise(F.try_divide(F.lit(1.0), c)),
}


def reshape(train: DataFrame, columns: list[str], strategy: str, overrides: dict[str, str] | None = None, strict: bool = True) -> Stage:
    """A shape for each column, ``strategy`` unless ``overrides`` names another; null stays null.

    Train must lie in the shape's domain; without ``strict`` it need not, and values outside become infinite or NaN.
    """
    plans = {c: (overrides or {}).get(c, strategy) for c in columns}
    if unknown := sorted(set(plans.values()) - set(SHAPES) - {"yeo_johnson", "quantile_uniform", "quantile_normal", "none"}):
        raise ValueError(f"no shape is called {', '.join(unknown)}")
    r = train.agg(*[x for c in columns for x in (F.min(c), F.count_if(F.col(c) == 0))]).first() if strict else None
    for i, (c, name) in enumerate(plans.items() if strict else ()):
        lo, zeros = r[2 * i], r[2 * i + 1]
        least, strict = SHAPES[name][1:] if name in SHAPES else (None, False)
        if lo is not None and least is not None and (lo < least or strict and lo == least):
            raise ValueError(f"{name} needs values above {least} in {c}")
        if name == "reciprocal" and zeros:
            raise ValueError(f"reciprocal needs values other than 0 in {c}")
    done: list[Stage] = []
    plain = {c: n for c, n in plans.items() if n in SHAPES}
    shape = {n: SHAPES[n][0] if strict else LIMITS.get(n, SHAPES[n][0]) for n in plain.values()}
    done.append(lambda df: _each(df, {c: shape[n](F.col(c).cast("double")) for c, n in plain.items()}) if plain else df)
    for c, name in plans.items():
        if name not in SHAPES and name != "none":
            done.append(registry(name, c)(train))

    def run(df: DataFrame) -> DataFrame:
        for stage in done:
            df = stage(df)
        return df

    return run


def yeo_johnson_lambda(train: DataFrame, column: str, grid: int = 25, rounds: int = 4) -> float:
    """Maximum likelihood over a grid of lambdas, all in one aggregate, refined around the best: one scan a round."""
    x = F.col(column).cast("double")
    known = train.where(x.isNotNull())
    lo, hi = -2.0, 4.0
    best = 1.0
    for _ in range(rounds):
        grid_of = [lo + (hi - lo) * i / (grid - 1) for i in range(grid)]
        r = known.agg(F.count(x), F.sum(F.signum(x) * F.log1p(F.abs(x))), *[F.var_pop(yeo_johnson(x, g)) for g in grid_of]).first()
        if not r[0]:
            return best
        loss = [0.5 * r[0] * math.log(max(v or 1e-300, 1e-300)) - (g - 1) * r[1] for g, v in zip(grid_of, r[2:], strict=True)]
        best = grid_of[loss.index(min(loss))]
        step = (hi - lo) / (grid - 1)
        lo, hi = best - step, best + step
    return best


def yeo_johnson(x: Column, lam: float) -> Column:
    up = F.log1p(x) if abs(lam) < 1e-9 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-x) if abs(lam - 2) < 1e-9 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(down)


def arithmetic(a: str, b: str, operation: str, out: str | None = None) -> Stage:
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    value = {"sum": x + y, "difference": x - y, "product": x * y, "ratio": F.try_divide(x, y)}[operation]
    return lambda df: df.withColumn(out or f"{a}_{operation}_{b}", value)


def combine(a: str, b: str, separator: str = "_") -> Stage:
    return lambda df: df.withColumn(f"{a}{separator}{b}", F.concat_ws(separator, F.coalesce(F.col(a).cast("string"), F.lit("nan")), F.coalesce(F.col(b).cast("string"), F.lit("nan"))))


def date_parts(train: DataFrame, column: str, reference: str | None = None, drop: bool = True, hour: bool = False) -> Stage:
    """Age, calendar parts and cyclic encodings; the reference is given or the column's latest value."""
    last = None if reference else train.agg(F.max(F.col(column).cast("timestamp"))).first()[0]

    def run(df: DataFrame) -> DataFrame:
        latest = F.to_timestamp(F.lit(reference)) if reference else F.lit(last).cast("timestamp")
        ts = F.col(column).cast("timestamp")
        days = F.floor((F.unix_micros(latest.cast("timestamp")) - F.unix_micros(ts)) / 86_400_000_000)
        month, dow = F.month(ts), F.weekday(ts)

        def turn(f, c: Column, period: int) -> Column:
            return f(2 * math.pi * c / period)

        new = {
            "age_days": days, "age_months": F.bround(days / 30.44), "year": F.year(ts), "month": month, "day_of_week": dow, "quarter": F.quarter(ts),
            "month_sin": turn(F.sin, month, 12), "month_cos": turn(F.cos, month, 12), "dow_sin": turn(F.sin, dow, 7), "dow_cos": turn(F.cos, dow, 7), "is_weekend": F.coalesce((dow >= 5).cast("int"), F.lit(0)),
        }
        if hour:
            new |= {"hour_sin": turn(F.sin, F.hour(ts), 24), "hour_cos": turn(F.cos, F.hour(ts), 24)}
        out = df.withColumns({f"{column}_{k}": v for k, v in new.items()})
        return out.drop(column) if drop else out

    return run


def categories(train: DataFrame, column: str) -> DataFrame:
    """(category, index) in order of the category, numbered in ranges of distinct values."""
    distinct = train.where(F.col(column).isNotNull()).select(column).distinct().withColumn("__one", F.lit(1).cast("long"))
    return running(distinct, column, ["__one"]).select(column, F.col("__one_before").alias("index"))


def ordered(column: str, order: list[str]) -> Stage:
    """Numbers of categories in a given order; -1 for others and null."""

    def run(df: DataFrame) -> DataFrame:
        places = F.create_map(*[x for i, c in enumerate(order) for x in (F.lit(c), F.lit(i))])
        return df.withColumn(f"{column}_ordinal", F.coalesce(F.try_element_at(places, F.col(column).cast("string")), F.lit(-1)))

    return run


def ordinal(train: DataFrame, column: str, order: list[str] | None = None) -> Stage:
    if order:
        return ordered(column, order)
    state = categories(train, column)
    return lambda df: _lookup(df, state, column, "index", f"{column}_ordinal", F.lit(-1))


def binary_bits(train: DataFrame, column: str) -> Stage:
    state = categories(train, column)
    k = max(1, state.count())
    bits = max(1, math.ceil(math.log2(k))) if k > 1 else 1

    def run(df: DataFrame) -> DataFrame:
        code = F.coalesce("__i", F.lit(0))
        return _lookup(df, state, column, "index", "__i", F.lit(0)).withColumns({f"{column}_bin{i}": F.shiftright(code, i).bitwiseAND(F.lit(1)) for i in range(bits)}).drop("__i")

    return run


def one_hot(train: DataFrame, column: str, drop_first: bool = False) -> Stage:
    names = sorted(str(r[0]) for r in train.where(F.col(column).isNotNull()).select(column).distinct().limit(10_001).collect())
    if len(names) > 10_000:
        raise ValueError("too many categories for one-hot columns")
    return lambda df: _each(df, {f"{column}_{x}": F.coalesce((F.col(column).cast("string") == x).cast("int"), F.lit(0)) for x in names[int(drop_first) :]})


def rare_group(train: DataFrame, column: str, min_frequency: float = S.RARE_FREQUENCY, top: int | None = None, other: str = "Other") -> Stage:
    """Keep frequent categories (or the ``top`` ones); all others, and null, become ``other``."""
    freq = train.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    if top is None:
        total = F.broadcast(freq.agg(F.sum("n").alias("all")))  # one row
        kept = freq.join(total).where(F.col("n") / F.col("all") >= min_frequency)
    else:
        kept = freq.orderBy(F.desc("n"), column).limit(top)
    kept = kept.withColumn("keep", F.col(column))
    return lambda df: _lookup(df, kept.select(column, "keep"), column, "keep", f"{column}_grouped", F.lit(other))


def hash_encode(column: str, components: int = S.HASH_COMPONENTS) -> Stage:
    """Signed hashing by md5: bucket from the first 8 hex digits, sign from the parity of the next 8."""

    def run(df: DataFrame) -> DataFrame:
        digest = F.md5(F.coalesce(F.col(column).cast("string"), F.lit("__missing__")))
        bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % components
        sign = F.when(F.conv(F.substring(digest, 9, 8), 16, 10).cast("long") % 2 == 0, 1).otherwise(-1)
        return _each(df, {f"{column}_hash{i}": F.when(bucket == i, sign).otherwise(0) for i in range(components)})

    return run


def target_encode(train: DataFrame, column: str, target: str, m: float = S.SMOOTHING) -> Stage:
    prior = train.agg(F.avg(F.col(target).cast("double"))).first()[0]
    state = train.where(F.col(column).isNotNull()).groupBy(column).agg(((F.sum(F.col(target).cast("double")) + m * F.lit(prior)) / (F.count(target) + m)).alias("v"))
    return lambda df: _lookup(df, state, column, "v", f"{column}_target", F.lit(prior))


def frequency_encode(train: DataFrame, column: str) -> Stage:
    freq = train.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    all_rows, k = freq.agg(F.sum("n"), F.count("*")).first()
    return lambda df: _lookup(df, freq.withColumn("v", F.col("n") / (all_rows or 1)), column, "v", f"{column}_frequency", F.lit(1.0 / max(1, k)))


def high_cardinality(train: DataFrame, columns: list[str], target: str | None = None, strategy: str = "target_encoding", m: float = S.SMOOTHING, threshold: int = S.HIGH_CARDINALITY) -> Stage:
    """Encode the non-numeric columns of more than ``threshold`` categories in place; by frequency if there is no target."""
    wide = [c for c in columns if c in set(non_numeric(train))]
    kinds = train.agg(*[F.countDistinct(c) for c in wide]).first() if wide else []
    stages = []
    for c, n in zip(wide, kinds, strict=True):
        if n > threshold:
            by_target = strategy == "target_encoding" and target is not None
            stages.append((c, f"{c}_target" if by_target else f"{c}_frequency", target_encode(train, c, target, m) if by_target else frequency_encode(train, c)))

    def run(df: DataFrame) -> DataFrame:
        for c, made, stage in stages:
            df = stage(df).withColumn(c, F.col(made)).drop(made)
        return df

    return run


def woe_encode(train: DataFrame, column: str, target: str, limit: float = S.WOE_CLIP, bins: int = S.IV_BINS) -> Stage:
    """Weight of evidence of a category, or of a number's quantile bin; 0 for null and unseen categories.

    Numbers beyond train's range belong to the outer bins.
    """
    from basalt.operators.relation import category_bins, woe

    held = F.greatest(F.least("woe", F.lit(limit)), F.lit(-limit))
    if column not in numeric(train):
        state = woe(category_bins(train, [column], target)).select(F.col("bin").alias(column), held.alias("v"))
        return lambda df: _lookup(df, state, column, "v", f"{column}_woe", F.lit(0.0))
    uppers = sorted(set(column_quantiles(train, [column], [i / bins for i in range(1, bins + 1)]).get(column, [])))
    c = F.col(column).cast("double")
    at = F.lit(max(len(uppers) - 1, 0))
    for i in range(len(uppers) - 2, -1, -1):
        at = F.when(c <= uppers[i], i).otherwise(at)
    binned = train.where(c.isNotNull()).select(F.lit(column).alias("feature"), at.cast("string").alias("bin"), F.col(target).cast("int").alias("y"))
    found = {int(r["bin"]): r["v"] for r in woe(binned).select("bin", held.alias("v")).collect()}  # a row a bin
    value = F.lit(0.0)
    for i, v in found.items():
        value = F.when(at == i, F.lit(v)).otherwise(value)
    return lambda df: df.withColumn(f"{column}_woe", F.when(c.isNotNull(), value).otherwise(F.lit(0.0)))


def bin_edges(train: DataFrame, column: str, strategy: str, bins: int) -> list[float]:
    """Edges by quantiles, by equal widths, or half way between the centres of k-means on the column."""
    c = F.col(column).cast("double")
    if strategy == "quantile":
        return sorted(set(column_quantiles(train, [column], [i / bins for i in range(bins + 1)]).get(column, [])))
    lo, hi = train.agg(F.min(c), F.max(c)).first()
    if lo is None:
        return []
    if strategy == "kmeans":
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        d = train.where(c.isNotNull()).select(array_to_vector(F.array(c)).alias("features"))
        centres = sorted(float(x[0]) for x in KMeans(k=bins, seed=S.SEED).fit(d).clusterCenters()) if hi > lo else []
        return sorted({lo, hi, *((a + b) / 2 for a, b in zip(centres, centres[1:], strict=False))})
    # the ends are the range itself: lo + (hi - lo) * bins / bins can be less than hi
    return sorted({lo, hi, *(min(lo + (hi - lo) * i / bins, hi) for i in range(1, bins))})


def bin_labels(column: str, edges: list[float]) -> Stage:
    """``into_bins`` as text: the edges with three digits, or ``unknown``."""
    names = F.create_map(F.lit(-1), F.lit("unknown"), *[x for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) for x in (F.lit(i), F.lit(f"[{a:.3g}, {b:.3g})"))])
    place = into_bins(column, edges)
    return lambda df: place(df).withColumn(f"{column}_bin", F.element_at(names, F.col(f"{column}_bin")))


def bin_column(train: DataFrame, column: str, strategy: str = "quantile", bins: int = 10) -> Stage:
    """Right-closed bins, the lowest edge included; -1 outside and for null."""
    return into_bins(column, bin_edges(train, column, strategy, bins))


def into_bins(column: str, edges: list[float]) -> Stage:
    """Number of the right-closed bin of each value, the lowest edge included; -1 outside and for null."""

    def run(df: DataFrame) -> DataFrame:
        c, out = F.col(column).cast("double"), F.lit(-1)
        for i in range(len(edges) - 2, -1, -1):
            out = F.when((c > edges[i]) & (c <= edges[i + 1]), i).otherwise(out)
        if edges:
            out = F.when(c == edges[0], 0).otherwise(out)
        return df.withColumn(f"{column}_bin", out)

    return run


def rank_on_train(train: DataFrame, column: str, method: str = "percentile") -> Stage:
    """Rank of each value among train's, also of values that train doesn't have.

    percentile: share of train's values below; global: number up to and with it; dense: distinct values below.
    The values to rank join train's as rows of no weight; running totals over all distinct values then give
    every one its place, and a join on the value brings it back.
    """
    v = F.col(column).cast("double")
    freq = checkpoint(train.where(v.isNotNull()).groupBy(v.alias("__v")).agg(F.count("*").alias("__n"), F.lit(1).cast("long").alias("__k")))
    total = freq.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]

    def run(df: DataFrame) -> DataFrame:
        other = df.where(v.isNotNull()).select(v.alias("__v")).distinct().select("__v", F.lit(0).cast("long").alias("__n"), F.lit(0).cast("long").alias("__k"))
        both = freq.unionByName(other).groupBy("__v").agg(F.sum("__n").alias("__n"), F.sum("__k").alias("__k"))
        state = running(both, "__v", ["__n", "__k"])
        value = {"percentile": F.col("__n_before") / max(1, total), "global": (F.col("__n_before") + F.col("__n")).cast("double"), "dense": F.col("__k_before").cast("double")}[method]
        state = state.select("__v", value.alias("__rank"))
        return df.join(state, v == state["__v"], "left").withColumn(f"{column}_rank", F.col("__rank")).drop("__v", "__rank")

    return run


def group_relative(train: DataFrame, group: str, column: str, strategy: str) -> Stage:
    """Value against its group's statistics; an unseen group uses the global ones."""
    c = F.col(column).cast("double")
    state = train.where(F.col(group).isNotNull()).groupBy(group).agg(F.avg(c).alias("m"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("s"), F.sum(c).alias("t"))
    gm, gs, gt = train.agg(F.avg(c), F.coalesce(F.stddev_samp(c), F.lit(0.0)), F.sum(c)).first()
    m, s, t = F.coalesce("m", F.lit(gm)), F.coalesce("s", F.lit(gs)), F.coalesce("t", F.lit(gt))
    value = {"ratio": F.try_divide(c, m), "zscore": F.try_divide(c - m, s), "difference": c - m, "pct_of_total": 100 * F.try_divide(c, t)}[strategy]
    small = state.count() <= BROADCAST_ROWS

    def run(df: DataFrame) -> DataFrame:
        side = state.withColumnRenamed(group, "__g")
        return df.join(F.broadcast(side) if small else side, df[group] == F.col("__g"), "left").withColumn(f"{column}_{strategy}", value).drop("__g", "m", "s", "t")

    return run


def polynomial(columns: list[str], degree: int = 2, interaction_only: bool = False) -> Stage:
    """All monomials up to a degree, without a constant."""
    choose = combinations if interaction_only else combinations_with_replacement
    terms = [t for d in range(1, degree + 1) for t in choose(columns, d)]

    def name(t: tuple[str, ...]) -> str:
        return "_x_".join(c if t.count(c) == 1 else f"{c}_pow{t.count(c)}" for c in dict.fromkeys(t))

    def value(t: tuple[str, ...]) -> Column:
        out = F.col(t[0]).cast("double")
        for c in t[1:]:
            out = out * F.col(c).cast("double")
        return out

    return lambda df: df.select(*[c for c in df.columns if c not in columns], *[value(t).alias(name(t)) for t in terms])


def correlation(a: Column, b: Column) -> Column:
    """Pearson's r over the rows that have both; null where one of them doesn't vary."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


class LeakageError(ValueError):
    """A feature gives the target away."""


def leakage(df: DataFrame, columns: list[str], target: str, limit: float = S.LEAKAGE, reference: str | None = None, strict: bool = False) -> DataFrame:
    """(feature, r, level): critical above the limit; a name that contains the target's, or dates after the reference, are a warning.

    ``strict`` raises where a feature is critical.
    """
    y = F.col(target).cast("double")
    dates = set(buckets(df)["datetime"])
    nums = [c for c in columns if c not in dates and c in set(numeric(df))]
    late = {c: F.max(F.col(c).cast("timestamp")) > F.lit(reference).cast("timestamp") if reference and c in dates else F.lit(False) for c in columns}
    one = df.agg(*[(correlation(F.col(c).cast("double"), y) if c in nums else F.lit(None).cast("double")).alias(c) for c in columns], *[F.coalesce(late[c], F.lit(False)).alias(f"__late{i}") for i, c in enumerate(columns)])
    each = [F.struct(F.lit(c).alias("feature"), F.round(F.col(c), 6).alias("r"), (F.lit(target.lower() in c.lower()) | F.col(f"__late{i}")).alias("named")) for i, c in enumerate(columns)]
    rows = one.select(F.inline(F.array(*each)))
    out = rows.select("feature", "r", F.when(F.abs("r") > limit, "critical").when(F.col("named"), "warning").otherwise("ok").alias("level"))
    if strict and (bad := [r["feature"] for r in out.where("level = 'critical'").collect()]):
        raise LeakageError(f"these features give the target away: {', '.join(bad)}")
    return out


def recommend(summary: dict) -> list[str]:
    """Stages for a column from its statistics, in order."""
    if summary.get("constant"):
        return []
    out = ["impute"] if summary.get("missing_pct", 0) > 0 else []
    if summary.get("kind") == "numeric":
        if abs(summary.get("skewness") or 0) >= S.SKEW_ALERT:
            out += ["clip_lower", "clip_upper", "log" if summary["min"] > 0 else "log1p" if summary["min"] > -1 else "yeo_johnson"]
        return out
    return out + (["rare_group", "target_encode"] if summary.get("n_unique", 0) > S.HIGH_CARDINALITY else ["onehot_encode"])


def chain(train: DataFrame, steps: list[Callable[[DataFrame], Stage]]) -> Stage:
    """Fit builders one after the other, each on the output of those before."""
    done: list[Stage] = []
    for build in steps:
        stage = build(train)
        done.append(stage)
        train = stage(train)

    def run(df: DataFrame) -> DataFrame:
        for stage in done:
            df = stage(df)
        return df

    return run


def registry(name: str, column: str, target: str | None = None, **how) -> Callable[[DataFrame], Stage]:
    """Builder of a stage by its public name."""
    from basalt.operators import learn, shape  # which build on this module

    table: dict[str, Callable[[DataFrame], Stage]] = {
        "impute": lambda d: impute(d, [column], **how), "clip_both": lambda d: clip(d, [column], **how),
        "clip_lower": lambda d: clip(d, [column], upper=0.0, **how), "clip_upper": lambda d: clip(d, [column], lower=0.0, **how),
        **{f"clip_{m}": (lambda d, m=m: clip(d, [column], m, **how)) for m in ("iqr", "zscore", "mad")},
        **{s: (lambda d, s=s: reshape(d, [column], s)) for s in SHAPES},
        "yeo_johnson": lambda d: (lambda lam: lambda df: df.withColumn(column, yeo_johnson(F.col(column).cast("double"), lam)))(yeo_johnson_lambda(d, column)),
        "bucket_quantile": lambda d: bin_column(d, column, "quantile", **how), "bucket_uniform": lambda d: bin_column(d, column, "uniform", **how),
        "bucket_kmeans": lambda d: bin_column(d, column, "kmeans", **how), "bucket_tree": lambda d: into_bins(column, learn.tree_edges(d, column, target, **how)),
        **{f"{m}_rank": (lambda d, m=m: rank_on_train(d, column, m)) for m in ("percentile", "dense", "global")},
        "scale": lambda d: scale(d, [column], **how), "ordinal_encode": lambda d: ordinal(d, column, **how), "onehot_encode": lambda d: one_hot(d, column, **how),
        "rare_group": lambda d: rare_group(d, column, **how), "target_encode": lambda d: target_encode(d, column, target, **how), "frequency_encode": lambda d: frequency_encode(d, column),
        "woe_encode": lambda d: woe_encode(d, column, target, **how), "binary_encode": lambda d: binary_bits(d, column), "hash_encode": lambda d: hash_encode(column, **how),
        "polynomial": lambda d: polynomial([column], **how), "noise": lambda d: shape.noise(d, column, **how), "spline": lambda d: shape.spline(d, column, **how),
        **{f"quantile_{o}": (lambda d, o=o: shape.quantile_map(d, column, o, **how)) for o in ("uniform", "normal")},
    }
    if name not in table:
        raise KeyError(f"no stage is called {name}; there are {', '.join(sorted(table))}")
    return table[name]
