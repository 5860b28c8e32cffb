"""Type buckets of columns, and the normalisation of missing values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric(df: DataFrame) -> list[str]:
    """Numeric columns; a boolean is none."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def non_numeric(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in set(numeric(df))]


def buckets(df: DataFrame) -> dict[str, list[str]]:
    """Profiling buckets: boolean, datetime, numeric, categorical."""
    out: dict[str, list[str]] = {"boolean": [], "datetime": [], "numeric": [], "categorical": []}
    for f in df.schema.fields:
        kind = "boolean" if isinstance(f.dataType, T.BooleanType) else "datetime" if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "numeric" if isinstance(f.dataType, T.NumericType) else "categorical"
        out[kind].append(f.name)
    return out


def scoring_bucket(data_type: T.DataType) -> str:
    """Bucket of a scoring schema, where a boolean counts as numeric."""
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "numeric" if isinstance(data_type, (T.NumericType, T.BooleanType)) else "categorical"


def missing_as_null(df: DataFrame) -> DataFrame:
    """NaN becomes null: one notion of missing."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[F.nanvl(c, F.lit(None)).alias(c) if c in floats else F.col(c) for c in df.columns])


def long_form(df: DataFrame, columns: list[str], *keep: str, to: str = "double") -> DataFrame:
    """(keep, feature, value): one row per cell, by one pass over the table."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast(to).alias("value")) for c in columns])
    return df.select(*keep, F.inline(pairs))
