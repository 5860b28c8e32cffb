"""Splits, targets and resampling: exact sizes in the order of a hash of the key, so any engine agrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.core import settings as S
from basalt.operators.order import column_quantiles


def key_order(key: str, seed: int = S.SEED) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def _numbered(df: DataFrame, key: str, by: list[str], seed: int) -> DataFrame:
    """``__i`` from 1 within ``by`` in hash order, and ``__n`` rows.

    Hashes are uniform: their first three digits make 4096 even buckets of every group, each ordered on its own.
    """
    d = df.withColumn("__h", key_order(key, seed)).withColumn("__b", F.substring("__h", 1, 3))
    sizes = d.groupBy(*by, "__b").agg(F.count("*").alias("__c"))
    ahead, every = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)  # at most 4096 rows a group
    starts = sizes.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__b").alias("__b2"), F.coalesce(F.sum("__c").over(ahead), F.lit(0)).alias("__s"), F.sum("__c").over(every).alias("__n"))
    same = d["__b"] == starts["__b2"]
    for c in by:
        same = same & d[c].eqNullSafe(starts[f"__{c}"])
    inside = Window.partitionBy(*by, "__b").orderBy("__h", key)
    joined = d.join(F.broadcast(starts) if not by else starts, same)
    return joined.withColumn("__i", F.col("__s") + F.row_number().over(inside)).drop("__b", "__b2", "__s", *[f"__{c}" for c in by])


def _roles(i: Column, n: Column, test: float, val: float) -> Column:
    n_test = F.greatest(F.lit(1), F.floor(n * test))
    n_val = F.greatest(F.lit(1), F.floor((n - n_test) * val))
    return F.when(i <= n_test, "test").when(i <= n_test + n_val, "val").otherwise("train")


def random_split(df: DataFrame, key: str, test: float = S.TEST_SIZE, val: float = S.VAL_SIZE, seed: int = S.SEED, by: list[str] | None = None) -> DataFrame:
    """``split`` column; the validation share is of what test leaves. ``by`` makes it stratified."""
    d = _numbered(df, key, by or [], seed)
    return d.withColumn("split", _roles(F.col("__i"), F.col("__n"), test, val)).drop("__i", "__n", "__h", "__c")


def stratified_split(df: DataFrame, key: str, target: str, test: float = S.TEST_SIZE, val: float = S.VAL_SIZE, seed: int = S.SEED, most: int = S.MAX_CLASSES) -> DataFrame:
    """Shares by class; a target of more than ``most`` values is split at random."""
    classes = df.select(target).distinct().limit(most + 1).count()
    return random_split(df, key, test, val, seed, [target] if classes <= most else None)


def grouped_split(df: DataFrame, group: str, date: str | None = None, cutoff: str | None = None, test: float = S.TEST_SIZE, val: float = S.VAL_SIZE, seed: int = S.SEED, test_groups: list | None = None, key: str | None = None, target: str | None = None) -> DataFrame:
    """Whole groups go to one split; rows from the cut-off on are ``oot`` first.

    With ``test_groups`` these are the test split, and the validation rows are drawn from the others by ``key``, by class
    of ``target`` if one is named.
    """
    late = F.coalesce(F.col(date) >= F.lit(cutoff).cast("timestamp_ntz"), F.lit(False)) if date and cutoff else F.lit(False)
    d = df.withColumn("__late", late)
    if test_groups is not None:
        known = {r[0] for r in d.where(F.col(group).isin(*test_groups)).select(group).distinct().collect()} if test_groups else set()
        if unknown := sorted(set(test_groups) - known, key=str):
            raise ValueError(f"no such groups: {unknown}")
        if key is None:
            raise ValueError("rows are drawn by a key; name one")
        role = d.withColumn("__role", F.when(F.col("__late"), "oot").when(F.col(group).isin(*test_groups), "test"))
        rest = _numbered(role.where("__role is null"), key, [target] if target else [], seed)
        drawn = rest.withColumn("split", F.when(F.col("__i") <= F.greatest(F.lit(1), F.floor(F.col("__n") * val)), "val").otherwise("train")).drop("__i", "__n", "__h", "__late", "__role", "__c")
        fixed = role.where("__role is not null").withColumn("split", F.col("__role")).drop("__late", "__role")
        return fixed.unionByName(drawn)
    groups = random_split(d.where(~F.col("__late")).select(group).distinct(), group, test, val, seed)
    joined = d.join(groups, group, "left")
    return joined.withColumn("split", F.when(F.col("__late"), "oot").otherwise(F.col("split"))).drop("__late")


def temporal_split(df: DataFrame, column: str | Column, key: str, roles: dict[str, str] | None = None, seed: int = S.SEED) -> DataFrame:
    """Roles by snapshot value: given, or by age for 2 to 4 values (newest is oot)."""
    c = F.col(column) if isinstance(column, str) else column
    d = df.withColumn("__v", c.cast("string"))
    values = sorted(r[0] for r in d.where("__v is not null").select("__v").distinct().limit(1001).collect())
    if roles is not None:
        validate_roles(roles, [v for v in values if v in roles])
    else:
        if not 2 <= len(values) <= 4:
            raise ValueError("automatic temporal splits need 2 to 4 snapshot values")
        roles = {4: dict(zip(values, ["train", "test", "val", "oot"], strict=False)), 3: dict(zip(values, ["pool", "val", "oot"], strict=False)), 2: dict(zip(values, ["pool", "oot"], strict=False))}[len(values)]
    role = F.lit(None).cast("string")
    for v, name in roles.items():
        role = F.when(F.col("__v") == v, name).otherwise(role)
    d = d.withColumn("split", role).where("split is not null").drop("__v")
    if "pool" not in roles.values():
        return d
    pool = random_split(d.where("split = 'pool'").drop("split"), key, val=S.VAL_SIZE if len(values) == 2 else 0.0, seed=seed)
    if len(values) == 3:
        pool = pool.withColumn("split", F.when(F.col("split") == "val", "train").otherwise(F.col("split")))
    return d.where("split <> 'pool'").unionByName(pool)


def class_distribution(split: DataFrame, target: str) -> DataFrame:
    t = split.groupBy("split", F.col(target).alias("class")).agg(F.count("*").alias("n"))
    return t.withColumn("rate", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("split")), 6))


def date_ranges(split: DataFrame, date: str) -> DataFrame:
    return split.groupBy("split").agg(F.min(date).cast("string").alias("first"), F.max(date).cast("string").alias("last"), F.count("*").alias("n"))


def validate(split: DataFrame, target: str | None = None, task: str = "classification", least_oot: int = S.MIN_OOT) -> None:
    """Errors: no rows to train on, fewer out-of-time rows than ``least_oot``, a class that train lacks, unknown splits."""
    sizes = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    if unknown := sorted(set(map(str, sizes)) - {"train", "val", "test", "oot"}):
        raise ValueError(f"no such splits: {unknown}")
    if not sizes.get("train"):
        raise ValueError("there are no rows to train on")
    if 0 < sizes.get("oot", 0) < least_oot:
        raise ValueError(f"only {sizes['oot']} rows are out of time; {least_oot} are needed")
    if target and task == "classification":
        seen = {r[0] for r in split.where("split = 'train'").select(target).distinct().limit(1001).collect()} - {None}
        if len(seen) < 2:
            raise ValueError("train needs two classes")


def validate_roles(roles: dict[str, str], values: list[str]) -> None:
    """Errors: roles of values that there are not, values without a role, unknown roles."""
    if unknown := sorted(set(roles) - set(values)):
        raise ValueError(f"no such snapshots: {unknown}")
    if left := sorted(set(values) - set(roles)):
        raise ValueError(f"snapshots without a role: {left}")
    if wrong := sorted(set(roles.values()) - {"train", "val", "test", "oot", "pool"}):
        raise ValueError(f"no such roles: {wrong}")


def class_gap(split: DataFrame, target: str, most: float = S.MAX_RATE_GAP) -> DataFrame:
    """(split, rate, gap, warning): the rate of class 1 against train's; a warning above ``most``."""
    rates = split.groupBy("split").agg(F.avg(F.col(target).cast("double")).alias("rate"))
    base = rates.where("split = 'train'").select(F.col("rate").alias("__r"))
    return rates.join(F.broadcast(base)).select("split", F.round("rate", 6).alias("rate"), F.round(F.col("rate") - F.col("__r"), 6).alias("gap"), (F.abs(F.col("rate") - F.col("__r")) > most).alias("warning"))  # one row


def relabel(df: DataFrame, column: str, positive: object) -> DataFrame:
    """1 where the column has the positive label, else 0, also for null."""
    return df.withColumn("target", F.coalesce((F.col(column) == F.lit(positive)).cast("int"), F.lit(0)))


def unbinarise(df: DataFrame, column: str, low: object, high: object) -> DataFrame:
    """A value for each class; what lay between them is lost."""
    return df.withColumn(column, F.when(F.col(column) == 1, F.lit(high)).otherwise(F.lit(low)))


def check_binary(df: DataFrame, target: str) -> None:
    """Errors: no rows, no such column, or other than two values."""
    if target not in df.columns:
        raise ValueError(f"there is no column {target}")
    values = [r[0] for r in df.where(F.col(target).isNotNull()).select(target).distinct().limit(3).collect()]
    if len(values) != 2:
        raise ValueError(f"{target} has {'more than two values' if len(values) > 2 else f'{len(values)} values'}, not two")


def binarise(df: DataFrame, column: str, method: str = "median", value: float | None = None) -> DataFrame:
    """1 strictly above the threshold, else 0, also for null."""
    t = value if method == "threshold" else column_quantiles(df, [column], [0.5 if method == "median" else value]).get(column, [None])[0]
    return df.withColumn("target", F.coalesce((F.col(column) > F.lit(t)).cast("int"), F.lit(0)))


def class_weights(df: DataFrame, target: str) -> DataFrame:
    t = df.where(F.col(target).isNotNull()).groupBy(F.col(target).alias("class")).agg(F.count("*").alias("n"))
    every = Window.partitionBy()  # one row per class
    return t.select("class", "n", F.round(F.sum("n").over(every) / (F.count("*").over(every) * F.col("n")), 6).alias("weight"))


def undersample(df: DataFrame, key: str, target: str, seed: int = S.SEED, ratio: float | None = None) -> DataFrame:
    """As many rows of each class as the smallest has, in hash order; with ``ratio`` (two classes) the larger keeps smaller / ratio."""
    sizes = {r[0]: r[1] for r in df.groupBy(target).count().collect()}
    least = min(sizes.values(), default=0)
    if ratio is not None:
        if len(sizes) != 2:
            raise ValueError("a ratio needs two classes")
        least = int(least / ratio)
    return _numbered(df, key, [target], seed).where(F.col("__i") <= F.lit(least)).drop("__i", "__n", "__h", "__c")


def oversample(df: DataFrame, key: str, target: str, seed: int = S.SEED) -> DataFrame:
    """Every row, and repeats of the smaller classes in hash order until each has as many as the largest; ``copy`` numbers them."""
    sizes = {r[0]: r[1] for r in df.where(F.col(target).isNotNull()).groupBy(target).count().collect()}
    most = max(sizes.values(), default=0)
    d = _numbered(df.where(F.col(target).isNotNull()), key, [target], seed)
    copies = F.floor(F.lit(most) / F.col("__n")) + (F.col("__i") <= F.lit(most) % F.col("__n")).cast("long")
    return d.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), copies))).drop("__i", "__n", "__h", "__c")


def resample_audit(before: DataFrame, after: DataFrame, target: str) -> DataFrame:
    def shares(d: DataFrame, name: str) -> DataFrame:
        t = d.groupBy(F.col(target).alias("class")).agg(F.count("*").alias(f"count_{name}"))
        return t.withColumn(f"pct_{name}", F.round(F.col(f"count_{name}") / F.sum(f"count_{name}").over(Window.partitionBy()), 4))

    return shares(before, "before").join(shares(after, "after"), "class", "full")
