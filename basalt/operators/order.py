"""Order statistics of all rows: ranges, running totals and exact quantiles without a sort in one task.

Ranges are derived from the value by bounds that are computed once, so a task that is run again after a
lost executor puts every row where it was. Bounds only balance the work; results don't depend on them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basalt.core.lineage import checkpoint
from basalt.core.schema import long_form

#: Distinct values that one task orders.
PART_ROWS = 1_000_000
#: Parts of a histogram, and rows of a part that come to the driver.
HISTOGRAM, FEW_ROWS = 2048, 2000
#: Ranges that a value is searched in by comparison, where it is no number.
MOST_PARTS = 256


def ranged(df: DataFrame, column: str, rows: int | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """df with ``__part``, ascending with ``column``, of about ``part_rows`` rows each. Numbers must not be null."""
    parts = math.ceil((df.count() if rows is None else rows) / part_rows)
    if parts <= 1:
        return df.withColumn("__part", F.lit(0.0))
    if isinstance(df.schema[column].dataType, T.NumericType):
        found = df.approxQuantile(column, [i / parts for i in range(1, parts)], 0.2 / parts)
        splits = [-math.inf, *sorted(set(found)), math.inf]
        return Bucketizer(splits=splits, inputCol="__at", outputCol="__part").transform(df.withColumn("__at", F.col(column).cast("double"))).drop("__at")
    parts = min(parts, MOST_PARTS)
    some = df.select(column).sample(min(1.0, 100 * parts / max(1, rows or df.count())), seed=1).limit(1000 * parts)
    bounds = sorted({r[0] for r in some.collect() if r[0] is not None})
    cuts = bounds[:: max(1, len(bounds) // parts)]
    return df.withColumn("__part", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda b: b <= F.col(column))).cast("double"))


def running(df: DataFrame, column: str, sums: Sequence[str], part_rows: int = PART_ROWS) -> DataFrame:
    """df, whose values of ``column`` are distinct and not null, with ``<c>_before``: the sum of c over smaller values."""
    df = checkpoint(df)
    d = ranged(df, column, part_rows=part_rows)
    totals = d.groupBy("__part").agg(*[F.sum(c).alias(f"__{c}") for c in sums])
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = totals.select("__part", *[F.coalesce(F.sum(f"__{c}").over(ahead), F.lit(0)).alias(f"__{c}") for c in sums])
    inside = Window.partitionBy("__part").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    joined = d.join(F.broadcast(starts), "__part")
    return joined.select(*df.columns, *[(F.col(f"__{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"{c}_before") for c in sums])


def counted(cells: DataFrame) -> DataFrame:
    """(feature, value, n) of the values of cells that are not null."""
    return cells.where(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count("*").alias("n"))


def quantiles(cells: DataFrame, levels: Sequence[float], part_rows: int = PART_ROWS) -> DataFrame:
    """(feature, rows, q): exact quantiles, linear between neighbours, of the values (doubles) of every feature.

    Histograms narrow the ranges that hold a wanted place (``_quantiles``). Where a range overflows, values are counted,
    features of more than ``part_rows`` distinct values are cut in ranges, again and again, and only the ranges that
    hold a wanted place are kept, so that no task orders more than that.
    """
    found = _quantiles(cells, levels, part_rows)
    return cells.sparkSession.createDataFrame([(f, n, q) for f, (n, q) in found.items()], "feature string, rows long, q array<double>")


def _quantiles(cells: DataFrame, levels: Sequence[float], part_rows: int = PART_ROWS) -> dict[str, tuple[int, list[float]]]:
    """Rows and quantiles of every feature, by histograms: no row is shuffled.

    Ranges are cut in even parts, counted with their ends, and those that hold a wanted place cut again, until one
    value or few rows are left. Values whose range overflows are counted and ordered instead.
    """
    own = cells.where(F.col("value").isNotNull() & ~F.isnan("value")).select("feature", "value")
    ends = {r["feature"]: r for r in own.groupBy("feature").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).collect()}
    far = [f for f, r in ends.items() if not math.isfinite(r["hi"] - r["lo"])]
    out = _counted_quantiles(own.where(F.col("feature").isin(*far)), levels, part_rows) if far else {}
    wanted = {f: sorted({k for p in levels for k in (math.floor(p * (r["n"] - 1)), math.ceil(p * (r["n"] - 1)))}) for f, r in ends.items() if f not in far}
    at = {(f, k): ends[f]["lo"] for f, places in wanted.items() if ends[f]["lo"] == ends[f]["hi"] for k in places}
    # ranges by number: (feature, rows before, places wanted)
    ranges = {i: (f, 0, places) for i, (f, places) in enumerate(wanted.items()) if ends[f]["lo"] < ends[f]["hi"]}
    law = [(f, i, ends[f]["lo"], ends[f]["hi"] - ends[f]["lo"]) for i, (f, _, _) in ranges.items()]
    spark, few = cells.sparkSession, min(part_rows, FEW_ROWS)
    now = own.join(F.broadcast(spark.createDataFrame(law, "feature string, id int, lo double, width double")), "feature") if law else own
    while ranges:
        parts = max(16, min(HISTOGRAM, 500_000 // len(ranges)))
        now = now.select("id", F.floor((F.col("value") - F.col("lo")) / F.col("width") * (parts - 1)).cast("int").alias("part"), "value")
        cells_of: dict[int, list] = {}
        for r in now.groupBy("id", "part").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).collect():
            cells_of.setdefault(r["id"], []).append(r)
        more, small = {}, {}
        law, direct = [], []
        for i, (f, before, places) in ranges.items():
            for r in sorted(cells_of[i], key=lambda r: r["part"]):
                mine = [k for k in places if before <= k < before + r["n"]]
                if mine and r["lo"] == r["hi"]:
                    at |= {(f, k): r["lo"] for k in mine}
                elif mine and r["n"] <= few:
                    small[len(small)] = (f, before, mine)
                    direct.append((i, r["part"], len(direct)))
                elif mine:
                    law.append((i, r["part"], len(law), r["lo"], r["hi"] - r["lo"]))
                    more[len(more)] = (f, before, mine)
                before += r["n"]
        if direct:
            values: dict[int, list] = {}
            picked = now.join(F.broadcast(spark.createDataFrame(direct, "id int, part int, at int")), ["id", "part"])
            for r in picked.groupBy("at", "value").agg(F.count("*").alias("n")).collect():
                values.setdefault(r["at"], []).append((r["value"], r["n"]))
            for i, (f, before, places) in small.items():
                for v, n in sorted(values[i]):
                    at |= {(f, k): v for k in places if before <= k < before + n}
                    before += n
        if more:
            inner = spark.createDataFrame(law, "id int, part int, next int, lo double, width double")
            now = now.join(F.broadcast(inner), ["id", "part"]).select(F.col("next").alias("id"), "value", "lo", "width")
        ranges = more
    for f in wanted:
        places = [p * (ends[f]["n"] - 1) for p in levels]
        out[f] = (ends[f]["n"], [at[f, math.floor(x)] + (at[f, math.ceil(x)] - at[f, math.floor(x)]) * (x - math.floor(x)) for x in places])
    return out


def _counted_quantiles(cells: DataFrame, levels: Sequence[float], part_rows: int = PART_ROWS) -> dict[str, tuple[int, list[float]]]:
    """Rows and quantiles of every feature by counted values: two values for each level come to the driver."""
    freq = checkpoint(counted(cells.where(~F.isnan("value"))))
    sizes = {r["feature"]: (r["kinds"], r["rows"]) for r in freq.groupBy("feature").agg(F.count("*").alias("kinds"), F.sum("n").alias("rows")).collect()}
    spark = freq.sparkSession
    if not sizes:
        return {}
    # places wanted of each feature, from 0
    wanted = {f: sorted({k for p in levels for k in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))}) for f, (_, n) in sizes.items()}
    wide = {f: k for f, (k, _) in sizes.items() if k > part_rows}
    start = F.lit(0).cast("long")
    pieces = [freq.where(~F.col("feature").isin(*wide)) if wide else freq]
    pieces = [pieces[0].withColumn("start", start).withColumn("group", F.lit(0))]
    for f, kinds in wide.items():
        pieces += _narrowed(freq.where(F.col("feature") == f).withColumn("start", start), kinds, wanted[f], part_rows, len(pieces))
    inside = Window.partitionBy("feature", "group").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    placed = reduce(DataFrame.unionByName, pieces).withColumn("first", F.col("start") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    law = spark.createDataFrame(list(wanted.items()), "feature string, places array<long>")
    hit = placed.join(F.broadcast(law), "feature").withColumn("mine", F.filter("places", lambda k: (k >= F.col("first")) & (k < F.col("first") + F.col("n"))))
    at = {(r["feature"], k): r["value"] for r in hit.where(F.size("mine") > 0).select("feature", "value", "mine").collect() for k in r["mine"]}
    out = {}
    for f, (_, n) in sizes.items():
        q = []
        for p in levels:
            place = p * (n - 1)
            low, high = at[f, math.floor(place)], at[f, math.ceil(place)]
            q.append(low + (high - low) * (place - math.floor(place)))
        out[f] = (n, q)
    return out


def _narrowed(rows: DataFrame, kinds: int, places: list[int], part_rows: int, group: int) -> list[DataFrame]:
    """The ranges of one feature's counts that hold a wanted place, each with the rows before it as ``start``."""
    parted = ranged(rows, "value", kinds, max(part_rows, kinds // MOST_PARTS))
    sizes = sorted((r["__part"], r["kinds"], r["rows"], r["start"]) for r in parted.groupBy("__part").agg(F.count("*").alias("kinds"), F.sum("n").alias("rows"), F.max("start").alias("start")).collect())
    out, before = [], sizes[0][3] if sizes else 0
    for part, k, n, _ in sizes:
        own = [p for p in places if before <= p < before + n]
        if own:
            piece = parted.where(F.col("__part") == part).drop("__part").withColumn("start", F.lit(before).cast("long"))
            if k > part_rows and k < kinds:
                out += _narrowed(checkpoint(piece), k, own, part_rows, group + len(out))
            else:
                out.append(piece.withColumn("group", F.lit(group + len(out))))
        before += n
    return out


def column_quantiles(df: DataFrame, columns: Sequence[str], levels: Sequence[float]) -> dict[str, list[float]]:
    """Quantiles of every column that has values."""
    return {f: q for f, (_, q) in _quantiles(long_form(df, list(columns)), levels).items()}


def mode(df: DataFrame, column: str) -> object:
    """The most frequent value of a column, the smallest of several; None without any."""
    freq = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg((-F.count("*")).alias("k"))
    best = freq.agg(F.min(F.struct("k", "value")).alias("m")).first()["m"]
    return best["value"] if best else None
