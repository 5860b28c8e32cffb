"""Findings over the profiles: alerts, flags, columns to drop, distributions and what charts are drawn from."""

from __future__ import annotations

import math
import unicodedata
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basalt.core import settings as S
from basalt.core.lineage import checkpoint
from basalt.core.schema import buckets, long_form
from basalt.operators import profile as P
from basalt.operators import relation as R
from basalt.operators.order import column_quantiles

#: The types of alerts.
ALERTS = ("HIGH_MISSING", "CONSTANT", "NEAR_ZERO_VARIANCE", "HIGH_CARDINALITY", "SKEWED", "ZEROS", "LOW_IV", "MULTICOLLINEAR", "HIGH_CORRELATION", "IMBALANCED")


def information(df: DataFrame, numeric: list[str], categorical: list[str], target: str) -> DataFrame:
    """Information value of numeric and categorical columns, one row each."""
    tables = [R.quantile_bins(df, numeric, target)] if numeric else []
    tables += [R.category_bins(df, categorical, target)] if categorical else []
    bins = tables[0] if len(tables) == 1 else tables[0].unionByName(tables[1])
    return R.iv_table(R.woe(bins))


def alerts(df: DataFrame, numeric: list[str], categorical: list[str], target: str | None = None) -> DataFrame:
    """(feature, type, detail) of all ten kinds of alert; without a target there is none of LOW_IV."""
    out = []

    def add(d: DataFrame, **rules) -> None:
        named = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(k).alias("type"), detail.alias("detail"))) for k, (cond, detail) in rules.items()]))
        out.append(d.select("feature", F.inline(named)))

    def percent(c: str):
        return F.format_string("%.1f%%", 100 * F.col(c))

    if numeric:
        add(
            P.numeric_summary(df, numeric),
            HIGH_MISSING=(F.col("missing_pct") > S.HIGH_MISSING, percent("missing_pct")), CONSTANT=(F.col("constant_flag"), F.lit("no variance")),
            NEAR_ZERO_VARIANCE=(F.col("near_zero_variance_flag"), F.lit("little variance")), SKEWED=(F.abs("skewness") >= S.SKEW_ALERT, F.format_string("%.2f", "skewness")),
            ZEROS=(F.col("zero_pct") >= S.ZEROS_ALERT, percent("zero_pct")),
        )
    if categorical:
        add(
            P.categorical_summary(df, categorical),
            HIGH_MISSING=(F.col("missing_pct") > S.HIGH_MISSING, percent("missing_pct")), HIGH_CARDINALITY=(F.col("cardinality_flag"), F.col("n_unique").cast("string")),
            CONSTANT=(F.col("n_unique") <= 1, F.lit("one value")), IMBALANCED=(F.col("imbalance") >= S.IMBALANCE_ALERT, F.format_string("%.2f", "imbalance")),
        )
    if target is not None:
        add(information(df, numeric, categorical, target), LOW_IV=(F.col("iv") < S.LOW_IV, F.format_string("%.4f", "iv")))
    if len(numeric) > 1:
        varied = _varied(df, numeric)
        if len(varied) > 1:
            add(R.vif(df, varied), MULTICOLLINEAR=(F.col("high"), F.format_string("%.2f", "vif")))
        pairs = R.high_correlation(df, numeric)
        both = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("feature"), F.col("b").alias("other"), "r"), F.struct(F.col("b").alias("feature"), F.col("a").alias("other"), "r"))))
        out.append(both.select("feature", F.lit("HIGH_CORRELATION").alias("type"), F.format_string("%.2f with %s", "r", "other").alias("detail")))
    empty = df.sparkSession.createDataFrame([], "feature string, type string, detail string")
    for d in out:
        empty = empty.unionByName(d)
    return empty


def _varied(df: DataFrame, columns: list[str]) -> list[str]:
    r = df.agg(*[F.min(c) for c in columns], *[F.max(c) for c in columns]).first()
    return [c for i, c in enumerate(columns) if r[i] is not None and r[i] != r[len(columns) + i]]


def flagged(df: DataFrame, numeric: list[str], categorical: list[str], target: str) -> DataFrame:
    """(flag, feature): constant, high_missing, low_iv and multicollinear columns."""
    found = checkpoint(alerts(df, numeric, categorical, target))
    names = {"CONSTANT": "constant", "HIGH_MISSING": "high_missing", "LOW_IV": "low_iv", "MULTICOLLINEAR": "multicollinear"}
    of = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    return found.where(F.col("type").isin(*names)).select(F.element_at(of, F.col("type")).alias("flag"), "feature").distinct()


def recommended_drops(df: DataFrame, numeric: list[str], categorical: list[str], target: str) -> DataFrame:
    """(feature, reasons): constant, nearly constant or of low information value, with the sorted reasons.

    The rules are those of ``alerts``, which measures much else: here moments of the numbers, levels of the categories
    and information values do.
    """
    out = []

    def add(d: DataFrame, **rules) -> None:
        out.append(d.select("feature", F.array_compact(F.array(*[F.when(F.col(c) if isinstance(c, str) else c, F.lit(k)) for k, c in rules.items()])).alias("found")))

    if numeric:
        add(P.spread_flags(df, numeric), constant="constant_flag", near_zero_variance="near_zero_variance_flag")
    if categorical:
        # one level or none: no two values differ
        ends = df.agg(*[x for i, c in enumerate(categorical) for x in (F.min(F.col(c).cast("string")).alias(f"a{i}"), F.max(F.col(c).cast("string")).alias(f"b{i}"))])
        levels = ends.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), (~F.coalesce(F.col(f"a{i}") < F.col(f"b{i}"), F.lit(False))).alias("one")) for i, c in enumerate(categorical)])))
        add(levels, constant="one")
    add(information(df, numeric, categorical, target), low_iv=F.col("iv") < S.LOW_IV)
    found = reduce(DataFrame.unionByName, out)
    return found.groupBy("feature").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))), ",").alias("reasons")).where("reasons <> ''")


def flag_issues(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """(feature, high_missing, near_zero_variance, high_cardinality, constant) of every column."""
    no = F.lit(False)
    out = []
    if numeric:
        s = P.numeric_summary(df, numeric)
        out.append(s.select("feature", (F.col("missing_pct") > S.HIGH_MISSING).alias("high_missing"), F.col("near_zero_variance_flag").alias("near_zero_variance"), no.alias("high_cardinality"), F.col("constant_flag").alias("constant")))
    if categorical:
        s = P.categorical_summary(df, categorical)
        out.append(s.select("feature", (F.col("missing_pct") > S.HIGH_MISSING).alias("high_missing"), no.alias("near_zero_variance"), F.col("cardinality_flag").alias("high_cardinality"), (F.col("n_unique") <= 1).alias("constant")))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def interactions(df: DataFrame, numeric: list[str], target: str, most: int = 8) -> list[str]:
    """The numeric columns of the greatest information value, best first, to look at in pairs."""
    rows = information(df, numeric, [], target).collect()
    return [r["feature"] for r in sorted(rows, key=lambda r: (-r["iv"], r["feature"]))[:most]]


def nullity_matrix(df: DataFrame, columns: list[str], rows: int = 500, seed: int = S.SEED) -> DataFrame:
    """Null flags (1 or 0) of a sample of rows."""
    total = df.count()
    some = df if total <= rows else df.sample(min(1.0, 1.1 * rows / total), seed=seed).limit(rows)
    return some.select(*[F.col(c).isNull().cast("int").alias(c) for c in columns])


def sample_rows(df: DataFrame, order: str, n: int = 5) -> DataFrame:
    """The first and the last rows in the order of a key; ``side`` says which."""
    first, last = df.orderBy(F.asc_nulls_last(order)).limit(n), df.orderBy(F.desc_nulls_last(order)).limit(n)
    return first.withColumn("side", F.lit("head")).unionByName(last.withColumn("side", F.lit("tail")))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """The rows that occur more than once, each content once with its number."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("group_size")).where("group_size > 1")


def density(df: DataFrame, column: str, bins: int = 40, points: int = 200, trim: bool = False) -> tuple[DataFrame, DataFrame]:
    """(bin, lo, hi, density) of a histogram and (x, density) of a Gaussian kernel estimate, of all rows.

    The kernel's width is Scott's. Kernels are summed over a histogram of fine bins, an eighth of a width
    each, whose count the range and the width bound. ``trim`` leaves out what lies beyond the 5th and 95th percentile.
    """
    d = df.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    if trim:
        low, high = column_quantiles(d, ["v"], [0.05, 0.95]).get("v", [0.0, 0.0])
        d = d.where(F.col("v").between(low, high))
    spark = df.sparkSession
    n, lo, hi, sd = d.agg(F.count("*"), F.min("v"), F.max("v"), F.stddev_samp("v")).first()
    if not n:
        return spark.createDataFrame([], "bin int, lo double, hi double, density double"), spark.createDataFrame([], "x double, density double")
    width = (hi - lo) / bins or 1.0
    at = F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1)).cast("int")
    counts = {r["bin"]: r["count"] for r in d.groupBy(at.alias("bin")).count().collect()}
    hist = [(i, lo + i * width, lo + (i + 1) * width, counts.get(i, 0) / n / width) for i in range(bins)]
    h = (sd or 1.0) * n ** (-1 / 5)
    fine = max(h / 8, (hi - lo) / 100_000) or 1.0
    cells = d.groupBy(F.floor((F.col("v") - lo) / fine).alias("c")).agg(F.count("*").alias("k"), F.avg("v").alias("m")).collect()  # 100,000 rows at most
    x = np.linspace(lo, hi, points)
    total = np.zeros(points)
    for r in cells:
        total += r["k"] * np.exp(-0.5 * ((x - r["m"]) / h) ** 2)
    y = total / (n * h * math.sqrt(2 * math.pi))
    return spark.createDataFrame(hist, "bin int, lo double, hi double, density double"), spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, density double")


def text_analysis(df: DataFrame, columns: list[str], top: int = 20) -> DataFrame:
    """(feature, kind, key, n): the top words and characters of string columns, their Unicode categories, and mean lengths.

    Characters are counted first, so categories are looked up for distinct characters only.
    """
    cells = long_form(df, columns, to="string").where("value is not null")
    words = cells.select("feature", F.explode(F.split(F.lower("value"), r"[ \t\n\r\f\x0b]+")).alias("key")).where("key <> ''").groupBy("feature", "key").agg(F.count("*").alias("n"))
    chars = checkpoint(cells.select("feature", F.explode(F.split("value", "")).alias("key")).where("key <> ''").groupBy("feature", "key").agg(F.count("*").alias("n")))

    def best(d: DataFrame, kind: str) -> DataFrame:
        w = Window.partitionBy("feature").orderBy(F.desc("n"), "key")
        return d.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= top).select("feature", F.lit(kind).alias("kind"), "key", F.col("n").cast("double").alias("n"))

    category = F.udf(lambda c: unicodedata.category(c[0]), "string")
    classes = chars.select("feature", category("key").alias("key"), "n").groupBy("feature", "key").agg(F.sum("n").cast("double").alias("n"))
    length = cells.groupBy("feature").agg(F.avg(F.length("value")).alias("n")).select("feature", F.lit("mean_length").alias("kind"), F.lit("").alias("key"), "n")
    return best(words, "word").unionByName(best(chars, "char")).unionByName(classes.select("feature", F.lit("category").alias("kind"), "key", "n")).unionByName(length)


def correlation_order(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns in the leaf order of average linkage on the distances of the rows of 1 - |r|; a matrix of columns squared."""
    k = len(columns)
    m = np.zeros((k, k))
    at = {c: i for i, c in enumerate(columns)}
    for r in R.pearson(df, columns).collect():
        i, j = at[r["a"]], at[r["b"]]
        m[i, j] = m[j, i] = 1 - abs(r["r"] or 0.0)
    far = np.sqrt(((m[:, None] - m[None]) ** 2).sum(-1))
    groups = [[i] for i in range(k)]
    while len(groups) > 1:
        gaps = [(far[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
        _, i, j = min(gaps)
        groups[i] += groups.pop(j)
    return [columns[i] for i in groups[0]] if groups else []


def trend_lines(df: DataFrame, y: str, x: str, kind: str = "linear", degree: int = 2, points: int = 50) -> DataFrame:
    """(x, y) of a trend: ``linear``, ``poly`` by normal equations, or ``loess`` by local lines over 200 bins of all rows."""
    d = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    n, lo, hi, mean = d.agg(F.count("*"), F.min("x"), F.max("x"), F.avg("x")).first()
    spark = df.sparkSession
    if not n:
        return spark.createDataFrame([], "x double, y double")
    grid, scale = np.linspace(lo, hi, points), (hi - lo) or 1.0
    if kind in ("linear", "poly"):
        degree = 1 if kind == "linear" else degree
        u = (F.col("x") - mean) / scale
        r = d.agg(*[F.avg(F.pow(u, F.lit(i))) for i in range(2 * degree + 1)], *[F.avg(F.pow(u, F.lit(i)) * F.col("y")) for i in range(degree + 1)]).first()
        a = np.array([[r[i + j] for j in range(degree + 1)] for i in range(degree + 1)])
        w = np.linalg.pinv(a) @ np.array(r[2 * degree + 1 :])
        fitted = sum(w[i] * ((grid - mean) / scale) ** i for i in range(degree + 1))
    else:
        cells = d.groupBy(F.least(F.floor((F.col("x") - lo) / scale * 200), F.lit(199)).alias("c")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n")).collect()
        bx, by, bn = (np.array([r[c] for r in cells], dtype=float) for c in ("x", "y", "n"))
        fitted = []
        for g in grid:
            gap = np.abs(bx - g)
            reach = np.sort(gap)[min(len(gap) - 1, max(2, int(0.3 * len(gap))))] or 1.0
            w = bn * np.clip(1 - np.minimum(gap / reach, 1) ** 3, 0, 1) ** 3
            design = np.stack([np.ones_like(bx), bx - g], 1)
            fitted.append((np.linalg.pinv(design.T * w @ design) @ (design.T * w @ by))[0])
    return spark.createDataFrame([(float(a), float(b)) for a, b in zip(grid, fitted, strict=True)], "x double, y double")


def chart_style(df: DataFrame, x: str, y: str) -> str:
    """The chart that suits two columns by their types: scatter, box, heatmap or line."""
    of = {c: k for k, cs in buckets(df).items() for c in cs}
    kinds = {of[x], of[y]}
    if "datetime" in kinds:
        return "line"
    if kinds == {"numeric"}:
        return "scatter"
    return "box" if "numeric" in kinds else "heatmap"


class Report:
    """All analyses of a table, over one checkpoint of the columns that they read."""

    def __init__(self, df: DataFrame, target: str | None = None, skip: list[str] = ()) -> None:
        self.df = checkpoint(df.drop(*skip))
        b = buckets(self.df)
        self.target = target
        self.numeric = [c for c in b["numeric"] if c != target]
        self.categorical = [c for c in b["categorical"] if c != target]
        self.datetime, self.boolean = b["datetime"], b["boolean"]

    def run_all(self) -> dict[str, DataFrame]:
        """Every table of the report that the columns allow."""
        out = {"overview": P.overview(self.df), "missing": P.missing_summary(self.df)}
        if self.numeric:
            out |= {"numeric": P.numeric_summary(self.df, self.numeric), "thresholds": P.threshold_guide(self.df, self.numeric)}
        if self.categorical:
            out |= {"categorical": P.categorical_summary(self.df, self.categorical), "text": text_analysis(self.df, self.categorical)}
        if self.datetime:
            out["datetime"] = P.datetime_summary(self.df, self.datetime)
        if self.boolean:
            out["boolean"] = P.boolean_summary(self.df, self.boolean)
        if len(self.numeric) > 1:
            out["correlation"] = R.pearson(self.df, self.numeric)
            if len(varied := _varied(self.df, self.numeric)) > 1:
                out |= {"vif": R.vif(self.df, varied), "components": R.pca_variance(self.df, varied)}
        out["alerts"] = alerts(self.df, self.numeric, self.categorical, self.target)
        if self.target is not None and self.numeric + self.categorical:
            out |= {"iv": information(self.df, self.numeric, self.categorical, self.target), "drops": recommended_drops(self.df, self.numeric, self.categorical, self.target)}
        return out
