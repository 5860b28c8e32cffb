"""Profiling: exact statistics of all rows, one row per feature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.core import settings as S
from basalt.core.lineage import checkpoint
from basalt.core.schema import buckets, long_form, numeric
from basalt.operators.order import counted, quantiles

LEVELS = {"p1": 0.01, "p2": 0.02, "p3": 0.03, "p4": 0.04, "p5": 0.05, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p96": 0.96, "p97": 0.97, "p98": 0.98, "p99": 0.99}


def r6(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


def stable(c: Column) -> Column:
    """Six digits of a sum over many rows, by way of ten: the order in which tasks add up shows in neither."""
    return F.round(c.cast("decimal(38,10)"), 6).cast("double")


def skewness(c: str | Column) -> Column:
    """Adjusted Fisher-Pearson G1; null below three values or without spread."""
    c = F.col(c) if isinstance(c, str) else c
    n = F.count(c)
    return F.when((n > 2) & (F.stddev_pop(c) > 0), F.skewness(c) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0)))


def kurtosis(c: str | Column) -> Column:
    """Bias-corrected excess G2; null below four values or without spread."""
    c = F.col(c) if isinstance(c, str) else c
    n = F.count(c)
    return F.when((n > 3) & (F.stddev_pop(c) > 0), ((n + 1) * F.kurtosis(c) + 6) * (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0)))


def numeric_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Thirty statistics of every numeric column: one pass for the moments, one for value counts, one for outliers."""
    columns = columns or numeric(df)
    cells = long_form(df, columns)
    v = F.col("value")
    rows = F.count("*")
    first = cells.groupBy("feature").agg(
        rows.alias("rows"), F.count(v).alias("count"), (F.sum(v.isNull().cast("int")) / rows).alias("missing_pct"), (F.sum(F.when(v == 0, 1).otherwise(0)) / rows).alias("zero_pct"),
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.stddev_pop(v).alias("sd0"), F.min(v).alias("min"), F.max(v).alias("max"),
        skewness(v).alias("skewness"), kurtosis(v).alias("kurtosis"),
    )
    levels = quantiles(cells, list(LEVELS.values())).select(F.col("feature").alias("__f"), "q")
    first = checkpoint(first.join(F.broadcast(levels), F.col("feature") == F.col("__f"), "left").drop("__f"))  # one row per column
    at = {k: F.col("q")[i] for i, k in enumerate(LEVELS)}
    spread = at["p75"] - at["p25"]
    bounds = first.select("feature", "mean", "sd0", (at["p25"] - S.IQR_FACTOR * spread).alias("lo"), (at["p75"] + S.IQR_FACTOR * spread).alias("hi"))
    joined = cells.join(F.broadcast(bounds), "feature")  # one row per column
    far = F.when(F.col("sd0") > 0, F.abs(v - F.col("mean")) / F.nullif("sd0", F.lit(0.0)) > S.Z_LIMIT)
    second = joined.groupBy("feature").agg(
        (F.sum(F.when((v < F.col("lo")) | (v > F.col("hi")), 1).otherwise(0)) / F.count("*")).alias("outlier_pct_iqr"), (F.sum(F.when(far, 1).otherwise(0)) / F.nullif(F.count(v), F.lit(0))).alias("outlier_pct_zscore")
    )
    out = first.join(second, "feature")
    constant = F.coalesce(F.col("std") == 0, F.lit(True))
    variance = F.col("std") * F.col("std")
    return out.select(
        "feature", "count", *[r6(F.col(c)).alias(c) for c in ("missing_pct", "zero_pct")], *[stable(F.col(c)).alias(c) for c in ("mean", "std")],
        stable(F.try_divide(F.col("std"), F.abs("mean"))).alias("cv"), r6(F.col("min")).alias("min"), *[r6(c).alias(k) for k, c in at.items()], r6(F.col("max")).alias("max"),
        *[stable(F.col(c)).alias(c) for c in ("skewness", "kurtosis")], *[r6(F.col(c)).alias(c) for c in ("outlier_pct_iqr", "outlier_pct_zscore")],
        constant.alias("constant_flag"), F.coalesce(variance < S.NEAR_ZERO_VARIANCE, F.lit(True)).alias("near_zero_variance_flag"),
    )


def spread_flags(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, constant_flag, near_zero_variance_flag) as in ``numeric_summary``, by one aggregate."""
    v = {i: F.col(c).cast("double") for i, c in enumerate(columns)}
    one = df.agg(*[F.stddev_samp(x).alias(f"s{i}") for i, x in v.items()])
    flags = [F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(f"s{i}") == 0, F.lit(True)).alias("constant_flag"), F.coalesce(F.col(f"s{i}") * F.col(f"s{i}") < S.NEAR_ZERO_VARIANCE, F.lit(True)).alias("near_zero_variance_flag")) for i, c in enumerate(columns)]
    return one.select(F.inline(F.array(*flags)))


def frequencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, value, n) of the non-null values of categorical columns."""
    return long_form(df, columns, to="string").where("value is not null").groupBy("feature", "value").agg(F.count("*").alias("n"))


def with_total(freq: DataFrame) -> DataFrame:
    """``total``: the sum of n of each feature; one row per feature is joined, so no task holds all values of one."""
    total = freq.groupBy("feature").agg(F.sum("n").alias("total"))
    return freq.join(F.broadcast(total), "feature")


def imbalance_score(df: DataFrame, columns: list[str]) -> DataFrame:
    """1 - H / log2(k), to 4 digits; 1 for a single level."""
    freq = with_total(frequencies(df, columns)).withColumn("p", F.col("n") / F.col("total"))
    h, k = -F.sum(F.col("p") * F.log2("p")), F.count("*")
    return freq.groupBy("feature").agg(k.alias("levels"), F.round(F.when(k == 1, 1.0).otherwise(1 - h / F.nullif(F.log2(k.cast("double")), F.lit(0.0))), 4).alias("imbalance"))


def categorical_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    base = long_form(df, columns, to="string").groupBy("feature").agg(F.count("value").alias("count"), F.avg(F.col("value").isNull().cast("int")).alias("missing_pct"))
    freq = frequencies(df, columns)
    top = freq.groupBy("feature").agg(F.count("*").alias("n_unique"), F.min(F.struct((-F.col("n")).alias("m"), "value")).alias("top"), F.sum("n").alias("all"))
    joined = base.join(top, "feature", "left").join(imbalance_score(df, columns), "feature", "left")
    return joined.select("feature", "count", r6(F.col("missing_pct")).alias("missing_pct"), F.coalesce("n_unique", F.lit(0)).alias("n_unique"), F.col("top.value").alias("top_value"), r6(-F.col("top.m") / F.col("all")).alias("top_freq"), (F.coalesce("n_unique", F.lit(0)) > S.HIGH_CARDINALITY).alias("cardinality_flag"), "imbalance")


def datetime_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    cells = long_form(df, columns, to="timestamp_ntz")
    return cells.groupBy("feature").agg(F.count("value").alias("count"), r6(F.avg(F.col("value").isNull().cast("int"))).alias("missing_pct"), F.countDistinct("value").alias("n_unique"), F.min("value").cast("string").alias("min"), F.max("value").cast("string").alias("max"))


def boolean_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    cells, v = long_form(df, columns, to="boolean"), F.col("value")
    return cells.groupBy("feature").agg(F.count(v).alias("count"), r6(F.avg(v.isNull().cast("int"))).alias("missing_pct"), F.count_if(v).alias("n_true"), F.count_if(~v).alias("n_false"), r6(F.avg(v.cast("int"))).alias("pct_true"))


def overview(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells and duplicate rows, by one aggregation over distinct rows."""
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("__n"))
    missing = sum((F.col(c).isNull().cast("long") for c in df.columns), F.lit(0))
    total = groups.agg(F.sum("__n").alias("rows"), F.sum(missing * F.col("__n")).alias("missing_cells"), F.sum(F.col("__n") - 1).alias("duplicate_rows"))
    return total.select("rows", F.lit(len(df.columns)).alias("columns"), "missing_cells", r6(F.col("missing_cells") / (F.col("rows") * len(df.columns))).alias("missing_pct"), "duplicate_rows", r6(F.col("duplicate_rows") / F.col("rows")).alias("duplicate_pct"))


def duplicate_groups(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("group_size")).where("group_size > 1")


def value_counts(df: DataFrame, columns: list[str], top: int) -> DataFrame:
    """The ``top`` values of each column with their share; ties by value."""
    freq = with_total(frequencies(df, columns)).withColumn("pct", r6(F.col("n") / F.col("total"))).drop("total")
    # the rank's limit is pushed below the exchange: each task keeps ``top`` rows a feature
    order = Window.partitionBy("feature").orderBy(F.desc("n"), "value")
    return freq.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def extreme_values(df: DataFrame, columns: list[str], top: int = 5) -> DataFrame:
    """The ``top`` smallest and largest values of each column; repeated values count each."""
    freq = counted(long_form(df, columns))
    low, high = Window.partitionBy("feature").orderBy("value"), Window.partitionBy("feature").orderBy(F.desc("value"))
    sides = []
    for name, order in (("low", low), ("high", high)):
        few = freq.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= top)  # top rows a task, then a feature
        copies = few.withColumn("__c", F.explode(F.sequence(F.lit(1).cast("long"), F.least("n", F.lit(top)))))
        ranked = copies.select("feature", "value", F.row_number().over(order).alias("rank"))
        sides.append(ranked.where(F.col("rank") <= top).withColumn("side", F.lit(name)))
    return sides[0].unionByName(sides[1])


def threshold_guide(df: DataFrame, columns: list[str]) -> DataFrame:
    """p10 to p99 of null rate, variance and cv across features."""
    v = F.col("value")
    per = long_form(df, columns).groupBy("feature").agg(F.avg(v.isNull().cast("int")).alias("null_rate"), F.var_samp(v).alias("variance"), F.try_divide(F.stddev_samp(v), F.abs(F.avg(v))).alias("cv"))
    long = long_form(per, ["null_rate", "variance", "cv"]).withColumnRenamed("feature", "metric")
    return long.groupBy("metric").agg(*[r6(F.percentile("value", F.lit(x))).alias(f"p{round(100 * x)}") for x in (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)])


def word_frequency(df: DataFrame, column: str) -> DataFrame:
    words = df.select(F.explode(F.split(F.lower(column), r"[ \t\n\r\f\x0b]+")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("n"))


def char_frequency(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.explode(F.split(column, "")).alias("char")).where("char <> ''").groupBy("char").agg(F.count("*").alias("n"))


def missing_summary(df: DataFrame) -> DataFrame:
    return long_form(df, df.columns, to="string").groupBy("feature").agg(r6(F.avg(F.col("value").isNull().cast("int"))).alias("missing_pct"))


def nullity_correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of the null flags of columns that vary."""
    from basalt.operators.relation import pearson

    flags = df.select(*[F.col(c).isNull().cast("double").alias(c) for c in columns])
    return pearson(flags, columns).where("r is not null")


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins over the range, the last one closed."""
    lo, hi = df.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    width = ((hi - lo) / bins) or 1.0
    b = F.least(F.floor((F.col(column).cast("double") - lo) / width), F.lit(bins - 1)).cast("int")
    return df.where(F.col(column).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def profile(df: DataFrame) -> dict[str, DataFrame]:
    """All summaries of a table by type bucket."""
    b = buckets(df)
    makers = {"numeric": numeric_summary, "categorical": categorical_summary, "datetime": datetime_summary, "boolean": boolean_summary}
    return {"overview": overview(df)} | {k: makers[k](df, c) for k, c in b.items() if c}
