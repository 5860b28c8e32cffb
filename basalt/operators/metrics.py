"""Metrics of scores, drift and calibration, exact on all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.core import settings as S
from basalt.core.lineage import checkpoint
from basalt.core.schema import long_form
from basalt.operators.order import column_quantiles, quantiles, ranged, running
from basalt.operators.profile import r6


def roc(df: DataFrame, score: str, label: str) -> DataFrame:
    """(score, p, n, tp, fp): labels by distinct score, with running sums from the highest."""
    per = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.sum(F.col(label).cast("int")).alias("p"), F.sum(1 - F.col(label).cast("int")).alias("n"))
    falling = running(per.withColumn("down", -F.col("score")), "down", ["p", "n"])
    return falling.select("score", "p", "n", (F.col("p_before") + F.col("p")).alias("tp"), (F.col("n_before") + F.col("n")).alias("fp"))


def ranking_metrics(df: DataFrame, score: str, label: str) -> DataFrame:
    """AUC with ties at their average rank, Gini and KS."""
    t = checkpoint(roc(df, score, label))
    area = F.sum(F.col("n").cast("double") * (F.col("tp") - F.col("p") / 2))
    both = F.nullif(F.sum("p").cast("double") * F.sum("n"), F.lit(0.0))
    one = t.agg((area / both).alias("auc"), F.sum("p").alias("pos"), F.sum("n").alias("neg"))
    ks = t.join(F.broadcast(one)).agg(F.max(F.abs(F.col("tp") / F.col("pos") - F.col("fp") / F.col("neg"))).alias("ks"))  # one row
    return one.join(ks).select(r6(F.col("auc")).alias("auc"), r6(2 * F.col("auc") - 1).alias("gini"), r6(F.col("ks")).alias("ks"))


def log_loss(df: DataFrame, score: str, label: str) -> DataFrame:
    p = F.greatest(F.least(F.col(score), F.lit(1 - 1e-15)), F.lit(1e-15))
    y = F.col(label).cast("int")
    return df.agg(r6(-F.avg(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"))


def confusion(df: DataFrame, score: str, label: str, threshold: float = 0.5) -> DataFrame:
    hit, y = (F.col(score) >= threshold).cast("int"), F.col(label).cast("int")
    c = df.agg(F.sum(hit * y).alias("tp"), F.sum(hit * (1 - y)).alias("fp"), F.sum((1 - hit) * y).alias("fn"), F.sum((1 - hit) * (1 - y)).alias("tn"))

    def ratio(a: Column, b: Column) -> Column:
        return r6(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)))

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def decile_table(df: DataFrame, score: str, label: str, key: str, q: int = 10) -> DataFrame:
    """Rows by falling score (ties by key) in q groups of the size that quantile cuts of their places give."""
    per = df.select(F.col(score).alias("s"), F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    by_score = per.groupBy((-F.col("s")).alias("down")).agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    placed = checkpoint(running(by_score, "down", ["n"]))
    rows = placed.agg(F.sum("n")).first()[0] or 0

    def group(place: Column) -> Column:
        return F.coalesce(F.greatest(F.lit(1), F.ceil(place * F.lit(q) / F.nullif(F.lit(rows) - 1, F.lit(0)))), F.lit(1)).cast("int")

    ends = placed.select("*", group(F.col("n_before")).alias("first"), group(F.col("n_before") + F.col("n") - 1).alias("last"))
    whole = ends.where("first = last").select(F.col("first").alias("decile"), F.col("n").alias("c"), F.col("y").alias("e"))
    # at most q - 1 scores lie across a border; the rows of each are ordered by key, in ranges
    split = []
    for r in ends.where("first < last").select("down", "n", "n_before").collect():
        tied = ranged(per.where(F.col("s") == -r["down"]).select("k", "y"), "k", r["n"])
        sizes = tied.groupBy("__part").agg(F.count("*").alias("c"))
        starts = sizes.select("__part", F.coalesce(F.sum("c").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("c0"))  # one row per range
        place = F.lit(r["n_before"]) + F.col("c0") + F.row_number().over(Window.partitionBy("__part").orderBy("k")) - 1
        split.append(tied.join(F.broadcast(starts), "__part").select(group(place).alias("decile"), F.lit(1).cast("long").alias("c"), F.col("y").cast("long").alias("e")))
    t = reduce(DataFrame.unionByName, split, whole).groupBy("decile").agg(F.sum("c").alias("count"), F.sum("e").alias("events"))
    run, every = Window.orderBy("decile").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()  # q rows
    rate, total = F.col("events") / F.col("count"), F.sum("events").over(every)
    return t.select("decile", "count", "events", r6(rate).alias("event_rate"), F.sum("count").over(run).alias("cum_count"), F.sum("events").over(run).alias("cum_events"), r6(F.sum("events").over(run) / total).alias("capture_rate"), r6(rate / (total / F.sum("count").over(every))).alias("lift"))


def calibration_bins(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """Bins [lo, hi) over the literal edges i * (1 / bins); a score of 1.0 is in no bin."""
    p, out = F.col(score), F.lit(None).cast("int")
    for i in range(bins):
        out = F.when((p >= i * (1 / bins)) & (p < ((i + 1) * (1 / bins) if i + 1 < bins else 1.0)), i).otherwise(out)
    return df.withColumn("bin", out).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"), F.avg(p).alias("predicted"), F.avg(F.col(label).cast("double")).alias("observed"))


def ece(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    t, rows = calibration_bins(df, score, label, bins), df.agg(F.count("*").alias("rows"))
    return t.join(F.broadcast(rows)).agg(r6(F.sum(F.col("n") * F.abs(F.col("predicted") - F.col("observed"))) / F.max("rows")).alias("ece"))  # one row


def r6_of(x: float | None) -> float | None:
    return None if x is None else round(x, 6)


def regression(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    e, y = F.col(actual).cast("double") - F.col(predicted).cast("double"), F.col(actual).cast("double")
    median = column_quantiles(df.select(F.abs(e).alias("gap")), ["gap"], [0.5]).get("gap", [None])[0]
    return df.agg(r6(F.sqrt(F.avg(e * e))).alias("rmse"), r6(F.avg(F.abs(e))).alias("mae"), r6(1 - F.sum(e * e) / (F.var_pop(y) * F.count(y))).alias("r2"), r6(F.avg(F.when(y != 0, F.abs(e / F.nullif(y, F.lit(0.0)))))).alias("mape"), F.lit(r6_of(median)).alias("median_ae"))


def _psi(e: Column, a: Column) -> Column:
    e, a = F.greatest(e, F.lit(S.EPSILON)), F.greatest(a, F.lit(S.EPSILON))
    return (a - e) * F.log(a / e)


def psi_numeric(expected: DataFrame, actual: DataFrame, columns: list[str], bins: int = S.PSI_BINS) -> DataFrame:
    """Deciles of expected; values of actual outside them count in the total only; the last bin is closed."""
    e, a = long_form(expected, columns).where("value is not null"), long_form(actual, columns).where("value is not null")
    edges = checkpoint(quantiles(e, [i / bins for i in range(bins + 1)]).select("feature", F.array_sort(F.array_distinct("q")).alias("edges")))

    def shares(cells: DataFrame, name: str) -> DataFrame:
        v, k = F.col("value"), F.size("edges")
        below = F.size(F.filter("edges", lambda x: x <= v))
        at = F.when((v == F.element_at("edges", -1)) & (k > 1), k - 1).when((below >= 1) & (below < k), below)
        t = cells.join(F.broadcast(edges), "feature").select("feature", at.alias("bin")).groupBy("feature", "bin").agg(F.count("*").alias("n"))  # one row per column
        return t.select("feature", "bin", (F.col("n") / F.sum("n").over(Window.partitionBy("feature"))).alias(name)).where("bin is not null")

    grid = edges.select("feature", F.explode(F.when(F.size("edges") > 1, F.sequence(F.lit(1), F.size("edges") - 1))).alias("bin"))
    both = grid.join(shares(e, "e"), ["feature", "bin"], "left").join(shares(a, "a"), ["feature", "bin"], "left").fillna(0.0)
    per = edges.select("feature").join(both, "feature", "left").groupBy("feature").agg(F.coalesce(F.sum(_psi(F.col("e"), F.col("a"))), F.lit(0.0)).alias("v"))
    return per.select("feature", F.round("v", 4).alias("psi"), (F.col("v") > S.PSI_FLAG).alias("flag"))


def psi_categorical(expected: DataFrame, actual: DataFrame, columns: list[str]) -> DataFrame:
    def shares(d: DataFrame, name: str) -> DataFrame:
        t = long_form(d, columns, to="string").where("value is not null").groupBy("feature", "value").agg(F.count("*").alias("n"))
        return t.select("feature", "value", (F.col("n") / F.sum("n").over(Window.partitionBy("feature"))).alias(name))

    both = shares(expected, "e").join(shares(actual, "a"), ["feature", "value"], "full").fillna(0.0, ["e", "a"])
    return both.groupBy("feature").agg(F.sum(_psi(F.col("e"), F.col("a"))).alias("v")).select("feature", F.round("v", 4).alias("psi"), (F.col("v") > S.PSI_FLAG).alias("flag"))


def freeze(df: DataFrame, columns: list[str], bins: int = S.PSI_BINS) -> DataFrame:
    """(feature, bin, lo, hi, proportion): a reference with open ends, to compare later data with."""
    cells = long_form(df, columns).where("value is not null")
    edges = quantiles(cells, [i / bins for i in range(1, bins)]).select("feature", F.array_sort(F.array_distinct("q")).alias("edges"), "rows")
    inf = float("inf")
    full = edges.select("feature", "rows", F.concat(F.array(F.lit(-inf)), "edges", F.array(F.lit(inf))).alias("edges"))
    ranges = full.select("feature", "rows", F.explode(F.sequence(F.lit(1), F.size("edges") - 1)).alias("bin"), "edges").select("feature", "rows", "bin", F.element_at("edges", F.col("bin")).alias("lo"), F.element_at("edges", F.col("bin") + 1).alias("hi"))
    n = placed(cells, ranges).groupBy("feature", "bin").agg(F.count("*").alias("n"))
    return ranges.join(n, ["feature", "bin"], "left").select("feature", "bin", "lo", "hi", (F.coalesce("n", F.lit(0)) / F.col("rows")).alias("proportion"))


def placed(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """(feature, bin) of every cell: smallest of the upper edges that is not below it."""
    uppers = ranges.groupBy("feature").agg(F.array_sort(F.collect_list("hi")).alias("uppers"))
    at = F.size(F.filter("uppers", lambda u: u < F.col("value"))) + 1
    return cells.join(F.broadcast(uppers), "feature").select("feature", at.alias("bin"))  # one row per column


def csi(reference: DataFrame, actual: DataFrame) -> DataFrame:
    columns = [r[0] for r in reference.select("feature").distinct().collect()]
    cells = long_form(actual, columns).where("value is not null")
    t = placed(cells, reference).groupBy("feature", "bin").agg(F.count("*").alias("n"))
    t = t.select("feature", "bin", (F.col("n") / F.sum("n").over(Window.partitionBy("feature"))).alias("a"))
    both = reference.join(t, ["feature", "bin"], "left").fillna(0.0, ["a"])
    return both.groupBy("feature").agg(F.sum(_psi(F.col("proportion"), F.col("a"))).alias("v")).select("feature", F.round("v", 4).alias("csi"), (F.col("v") > S.CSI_FLAG).alias("flag"))


def scored_with_actuals(scored: DataFrame, actuals: DataFrame, ids: list[str]) -> DataFrame:
    """Inner join on ids; columns of actuals that clash get the suffix ``_actual``."""
    clash = [c for c in actuals.columns if c in scored.columns and c not in ids]
    return scored.join(actuals.select(*[F.col(c).alias(f"{c}_actual") if c in clash else F.col(c) for c in actuals.columns]), ids, "inner")


def unmatched(scored: DataFrame, actuals: DataFrame, ids: list[str]) -> DataFrame:
    a, b = scored.join(actuals, ids, "left_anti").agg(F.count("*").alias("scored_only")), actuals.join(scored, ids, "left_anti").agg(F.count("*").alias("actuals_only"))
    return a.join(b)


def performance_report(scored: DataFrame, actuals: DataFrame, ids: list[str], score: str, label: str) -> DataFrame:
    """One row of metrics of the rows that have an actual; none at all is an error."""
    d = scored_with_actuals(scored, actuals, ids)
    n = d.count()
    if not n:
        raise ValueError("no scored row has an actual")
    measured = ranking_metrics(d, score, label).join(log_loss(d, score, label))  # one row each
    return measured.select(F.lit("monitoring").alias("split"), F.lit(n).cast("long").alias("n_rows"), "auc", "gini", "ks", "log_loss")


def feature_drift(reference: DataFrame, raw: DataFrame, actuals: DataFrame, ids: list[str]) -> DataFrame:
    """CSI of the raw rows that have an actual, against a frozen reference."""
    return csi(reference, raw.join(actuals.select(*ids).distinct(), ids, "left_semi"))
