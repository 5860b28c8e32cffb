"""Made-up tables with the faults that profiles and selectors look for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of columns, dealt in turn.
NUMERIC = ("normal", "high_null", "low_variance", "constant")
CATEGORICAL = ("normal", "single", "high_card", "dominant", "high_null")


def generate(spark: SparkSession, rows: int = 10_000, numeric: int = 8, categorical: int = 5, seed: int = 42, nulls: float = 0.6) -> DataFrame:
    """``id``, ``num_<i>_<kind>`` and ``cat_<i>_<kind>`` columns, and a 0/1 ``target`` that follows the first normal one.

    Values are drawn by the hash of seed, column and id, so they don't depend on partitioning.
    """

    def u(name: str, draw: int = 0) -> Column:
        return (F.pmod(F.xxhash64(F.lit(seed), F.lit(name), F.lit(draw), F.col("id")), F.lit(1 << 40)) + 0.5) / F.lit(float(1 << 40))

    def normal(name: str) -> Column:
        return F.sqrt(-2 * F.log(u(name))) * F.cos(F.lit(6.283185307179586) * u(name, 1))

    new: dict[str, Column] = {}
    for i in range(numeric):
        kind = NUMERIC[i % len(NUMERIC)]
        name = f"num_{i}_{kind}"
        z = normal(name)
        new[name] = {"normal": z, "high_null": F.when(u(name, 2) >= nulls, z), "low_variance": 1 + z * 1e-4, "constant": F.lit(1.0)}[kind]
    for i in range(categorical):
        kind = CATEGORICAL[i % len(CATEGORICAL)]
        name = f"cat_{i}_{kind}"
        few = F.concat(F.lit("level_"), F.floor(u(name) * 5).cast("string"))
        new[name] = {
            "normal": few, "single": F.lit("only"), "high_card": F.concat(F.lit("v"), F.floor(u(name) * max(rows // 2, 51)).cast("string")),
            "dominant": F.when(u(name, 1) < 0.995, "main").otherwise(few), "high_null": F.when(u(name, 2) >= nulls, few),
        }[kind]
    first = next((c for c in new if c.endswith("normal") and c.startswith("num")), None)
    new["target"] = (F.coalesce(F.col(first), F.lit(0.0)) + normal("target") > 0).cast("int") if first else (u("target") < 0.5).cast("int")
    df = spark.range(rows)
    target = new.pop("target")
    return df.withColumns(new).withColumn("target", target)
