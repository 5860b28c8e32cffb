"""Relations between features, and of features to a binary target."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.core import settings as S
from basalt.core.lineage import checkpoint
from basalt.core.schema import long_form
from basalt.operators.order import column_quantiles, running
from basalt.operators.profile import r6


#: Cells of a table of two columns that is made in full.
MOST_CELLS = 1_000_000


def quantile_bins(df: DataFrame, columns: list[str], target: str, bins: int = S.IV_BINS) -> DataFrame:
    """(feature, bin, y): right-closed quantile bins with distinct edges, named by their upper edge."""
    edges = {c: sorted(set(q)) for c, q in column_quantiles(df, columns, [i / bins for i in range(1, bins + 1)]).items()}
    law = df.sparkSession.createDataFrame(list(edges.items()), "feature string, edges array<double>")
    names = {r["feature"]: r["names"] for r in law.select("feature", F.transform("edges", lambda e: r6(e).cast("string")).alias("names")).collect()}

    def upper(c: str) -> Column:
        v = F.col(c).cast("double")
        below = sum(((v > e).cast("int") for e in edges[c]), F.lit(0))
        return F.when(v.isNotNull() & ~F.isnan(v), F.element_at(F.array(*map(F.lit, names[c])), below + 1))

    pairs = [F.struct(F.lit(c).alias("feature"), upper(c).alias("bin")) for c in columns if c in edges]
    if not pairs:
        return df.limit(0).select(F.lit("").alias("feature"), F.lit("").alias("bin"), F.col(target).cast("int").alias("y"))
    return df.select(F.inline(F.array(*pairs)), F.col(target).cast("int").alias("y")).where("bin is not null")


def category_bins(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    return long_form(df, columns, F.col(target).cast("int").alias("y"), to="string").where("value is not null").select("feature", F.col("value").alias("bin"), "y")


def woe(binned: DataFrame) -> DataFrame:
    """Weight of evidence of every observed bin; shares are held above 1e-8."""
    per = binned.groupBy("feature", "bin").agg(F.count("*").alias("count"), F.sum("y").alias("events"))
    totals = per.groupBy("feature").agg(F.sum("events").alias("__e"), F.sum(F.col("count") - F.col("events")).alias("__o"))
    per = per.join(F.broadcast(totals), "feature")  # one row per column
    events, non = F.col("__e"), F.col("__o")
    per = per.withColumn("de", F.greatest(F.col("events") / F.greatest(events, F.lit(S.EPSILON)), F.lit(S.EPSILON)))
    per = per.withColumn("dn", F.greatest((F.col("count") - F.col("events")) / F.greatest(non, F.lit(S.EPSILON)), F.lit(S.EPSILON)))
    per = per.withColumn("w", F.log(F.col("de") / F.col("dn")))
    return per.select("feature", "bin", "count", "events", r6(F.col("events") / F.col("count")).alias("event_rate"), F.col("w").alias("woe"), ((F.col("de") - F.col("dn")) * F.col("w")).alias("iv_contrib"))


def power(iv: Column) -> Column:
    return F.when(iv < 0.02, "Useless").when(iv < 0.1, "Weak").when(iv < 0.3, "Medium").when(iv < 0.5, "Strong").otherwise("Very Strong")


def iv_table(bins: DataFrame) -> DataFrame:
    per = bins.groupBy("feature").agg(F.sum("iv_contrib").alias("v"), F.count("*").alias("n_bins"))
    return per.select("feature", r6(F.col("v")).alias("iv"), "n_bins", power(F.col("v")).alias("predictive_power"))


def pearson(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) for every pair of columns, over the rows that have both, by one aggregation."""
    pairs = list(combinations(columns, 2))

    def r(a: str, b: str) -> Column:
        ok = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(ok, F.col(a).cast("double")), F.when(ok, F.col(b).cast("double"))
        return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))

    one = df.agg(*[r(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r6(F.col(f"r{i}")).alias("r")) for i, (a, b) in enumerate(pairs)])))


def high_correlation(df: DataFrame, columns: list[str], limit: float = S.HIGH_CORRELATION) -> DataFrame:
    return pearson(df, columns).where(F.abs("r") > limit).select("a", "b", F.round("r", 2).alias("r"))


def cells_of(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n, e, total) of the cells that hold rows; e is the expected count."""
    t = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("n"))
    rows, columns = t.groupBy("a").agg(F.sum("n").alias("na")), t.groupBy("b").agg(F.sum("n").alias("nb"))
    total = F.broadcast(t.agg(F.sum("n").alias("total")))  # one row
    return t.join(rows, "a").join(columns, "b").join(total).select("a", "b", "n", (F.col("na") * F.col("nb") / F.col("total")).alias("e"), "total")


def crosstab(df: DataFrame, a: str, b: str, most: int = MOST_CELLS) -> DataFrame:
    """(a, b, n, e) of all cells, also empty ones; e is the expected count. More than ``most`` cells are an error."""
    full = checkpoint(cells_of(df, a, b))
    levels = full.agg(F.countDistinct("a"), F.countDistinct("b")).first()
    if levels[0] * levels[1] > most:
        raise ValueError(f"a table of {levels[0]} by {levels[1]} levels has more than {most} cells")
    rows, columns = full.groupBy("a").agg(F.sum("n").alias("na")), full.groupBy("b").agg(F.sum("n").alias("nb"))
    total = full.agg(F.max("total").alias("total"))
    # bounded by ``most``: levels of one column by levels of the other
    cells = rows.join(F.broadcast(columns)).join(F.broadcast(total))
    joined = cells.join(full.select("a", "b", "n"), ["a", "b"], "left").fillna(0, ["n"])
    return joined.select("a", "b", "n", (F.col("na") * F.col("nb") / F.col("total")).alias("e"), "total")


def cramers_v(df: DataFrame, a: str, b: str, correction: bool = False) -> DataFrame:
    """Cramer's V; with ``correction`` Yates' on tables of 2 by 2.

    Only cells that hold rows are made: the sum over all cells of (n - e)^2 / e is the sum over those of n^2 / e, less the total.
    """
    t = checkpoint(cells_of(df, a, b))
    kinds = t.agg(F.countDistinct("a"), F.countDistinct("b")).first()
    k = min(kinds) - 1
    if correction and kinds[0] == kinds[1] == 2:
        t = crosstab(df, a, b)
        gap = F.abs(F.col("n") - F.col("e"))
        chi2 = F.sum(F.pow(gap - F.least(F.lit(0.5), gap), F.lit(2)) / F.col("e"))
    else:
        chi2 = F.greatest(F.sum(F.col("n") * F.col("n") / F.col("e")) - F.max("total"), F.lit(0.0))
    return t.agg(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.round(F.sqrt(chi2 / F.max("total") / F.lit(k or None)), 2 if correction else 4).alias("cramers_v"))


def residuals(df: DataFrame, a: str, b: str) -> DataFrame:
    t = checkpoint(crosstab(df, a, b))
    low = t.agg(F.avg((F.col("e") < 5).cast("int")).alias("low"))
    return t.join(F.broadcast(low)).select("a", "b", "n", r6((F.col("n") - F.col("e")) / F.sqrt("e")).alias("residual"), (F.col("low") > 0.2).alias("unreliable"))  # one row


def crosstab_sorted(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cells of a bounded table in falling order of their row's and column's totals, ties by level."""
    t = crosstab(df, a, b)
    rows, columns = t.groupBy("a").agg(F.sum("n").alias("row_total")), t.groupBy("b").agg(F.sum("n").alias("column_total"))
    joined = t.join(F.broadcast(rows), "a").join(F.broadcast(columns), "b")
    return joined.select("a", "b", "n", "row_total", "column_total").orderBy(F.desc("row_total"), "a", F.desc("column_total"), "b")


def ranked(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as their ranks, ties at the average; null stays null. Rows keep no other column."""
    out = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    for i, c in enumerate(columns):
        freq = out.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("__v")).agg(F.count("*").alias("n"))
        ranks = running(freq, "__v", ["n"]).select("__v", (F.col("n_before") + (F.col("n") + 1) / 2).alias(f"__r{i}"))
        out = out.join(ranks, out[c] == ranks["__v"], "left").drop("__v")
    return out.select(*[F.col(f"__r{i}").alias(c) for i, c in enumerate(columns)])


def spearman(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r): Pearson correlation of ranks over the rows that have both values."""
    parts = []
    for a, b in combinations(columns, 2):
        parts.append(pearson(ranked(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), [a, b]), [a, b]))
    return reduce(DataFrame.unionByName, parts)


def kendall(df: DataFrame, a: str, b: str, most: int = MOST_CELLS) -> DataFrame:
    """Kendall's tau-b from counts of value pairs; more than ``most`` comparisons of such pairs are an error.

    It compares distinct pairs of values, not rows; columns of many values are binned first (``into_bins``).
    """
    t = checkpoint(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")).agg(F.count("*").alias("n")))
    kinds = t.count()
    if kinds * kinds > most * 100:
        raise ValueError(f"{kinds} distinct pairs of values are too many to compare; bin the columns")
    other = t.select(F.col("x").alias("u"), F.col("y").alias("v"), F.col("n").alias("m"))
    weight, sign = F.col("n") * F.col("m"), F.signum(F.col("x") - F.col("u")) * F.signum(F.col("y") - F.col("v"))
    both = t.join(F.broadcast(other)).agg(  # bounded by the check above
        F.sum(sign * weight).alias("s"), F.sum(F.when(F.col("x") != F.col("u"), weight).otherwise(0)).alias("p"), F.sum(F.when(F.col("y") != F.col("v"), weight).otherwise(0)).alias("q")
    )
    return both.select(F.lit(a).alias("a"), F.lit(b).alias("b"), r6(F.col("s") / F.nullif(F.sqrt(F.col("p").cast("double")) * F.sqrt(F.col("q").cast("double")), F.lit(0.0))).alias("tau"))


def mean_sem(df: DataFrame, category: str, value: str) -> DataFrame:
    v = F.col(value)
    ok = df.where(F.col(category).isNotNull() & v.isNotNull())
    return ok.groupBy(F.col(category).alias("category")).agg(F.count(v).alias("n"), r6(F.avg(v)).alias("mean"), r6(F.stddev_samp(v) / F.sqrt(F.count(v))).alias("sem"))


def trend(df: DataFrame, y: str, x: str) -> DataFrame:
    return df.agg(r6(F.regr_slope(y, x)).alias("slope"), r6(F.regr_intercept(y, x)).alias("intercept"), r6(F.regr_r2(y, x)).alias("r2"))


def gram(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums of products, sums and rows of the complete rows: columns squared numbers on the driver."""
    d = df.dropna(how="any", subset=columns)
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    c = [F.col(x).cast("double") for x in columns]
    row = d.agg(F.count("*"), *[F.sum(x) for x in c], *[F.sum(c[i] * c[j]) for i, j in pairs]).first()
    k = len(columns)
    g = np.zeros((k, k))
    for (i, j), v in zip(pairs, row[k + 1 :], strict=True):
        g[i, j] = g[j, i] = v or 0.0
    return g, np.array([v or 0.0 for v in row[1 : k + 1]]), row[0]


def vif(df: DataFrame, columns: list[str]) -> DataFrame:
    """Variance inflation without an added intercept, from the inverse Gram matrix; of exact copies it is infinite.

    A Gram matrix of near copies holds little but rounding where they differ. So columns are turned to nearly
    orthogonal ones by the first, and the inverse is that of a second Gram matrix, of the turned columns.
    """
    g, _, _ = gram(df, columns)
    size = np.sqrt(np.diag(g))
    size[size == 0] = 1
    values, turn = np.linalg.eigh(g / np.outer(size, size))
    turn = turn / np.sqrt(np.maximum(values, 1e-14 * max(values.max(), 1e-300))) / size[:, None]
    k = range(len(columns))
    turned = df.dropna(how="any", subset=columns).select(*[sum((F.col(columns[i]).cast("double") * float(turn[i, j]) for i in k), F.lit(0.0)).alias(f"x{j}") for j in k])
    h, _, _ = gram(turned, turned.columns)
    values, vectors = np.linalg.eigh(h)
    part = (size[:, None] * (turn @ vectors)) ** 2
    with np.errstate(divide="ignore", invalid="ignore"):
        found = np.where(part > 0, part / np.maximum(values, 0), 0).sum(axis=1) * np.diag(g) / size**2
    rows = [(c, float(round(v, 2)), bool(v > S.HIGH_VIF)) for c, v in zip(columns, found.tolist(), strict=True)]
    return df.sparkSession.createDataFrame(rows, "feature string, vif double, high boolean")


def pca_variance(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share and running share of variance of the principal components of standardised columns."""
    g, s, n = gram(df, columns)
    cov = g / n - np.outer(s / n, s / n)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    sd[sd == 0] = 1
    values = np.sort(np.linalg.eigvalsh(cov / np.outer(sd, sd)))[::-1]
    share = np.maximum(values, 0) / max(values.sum(), 1e-12)
    rows = [(i + 1, float(x), float(y)) for i, (x, y) in enumerate(zip(share, np.cumsum(share), strict=True))]
    return df.sparkSession.createDataFrame(rows, "component int, ratio double, cumulative double")
