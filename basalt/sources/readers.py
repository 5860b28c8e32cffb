"""Sources: one entry for files, with exact-size sampling and header repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, path: str, fmt: str | None = None, rows: int | None = None, fraction: float | None = None, seed: int = 42, columns: list[str] | None = None, **options) -> DataFrame:
    """Read parquet, csv, json, orc or delta; ``rows`` wins over ``fraction``. A failure names the path."""
    fmt = fmt or {"csv": "csv", "json": "json", "orc": "orc", "xlsx": "excel", "xls": "excel", "pq": "parquet"}.get(path.rstrip("/").rpartition(".")[2].lower(), "parquet")
    if fmt == "excel":
        return load_excel(spark, path, **options)
    if fmt == "csv":
        options = {"header": True, "inferSchema": True} | options
    try:
        df = spark.read.format(fmt).options(**options).load(path)
    except Exception as e:
        raise RuntimeError(f"Failed to load data from {path}: {e}") from e
    df = df.select(*columns) if columns else df
    return sample(df, rows, fraction, seed)


def sample(df: DataFrame, rows: int | None = None, fraction: float | None = None, seed: int = 42) -> DataFrame:
    """At most ``rows`` rows by a Bernoulli draw a little above the share, or a fraction."""
    if rows is not None:
        total = df.count()
        return df if rows >= total else df.sample(fraction=min(1.0, rows / total * 1.1), seed=seed).limit(rows)
    return df.sample(fraction=fraction, seed=seed) if fraction is not None and fraction < 1 else df


def load_excel(spark: SparkSession, path: str, sheets: list[str] | str | int = 0) -> DataFrame:
    """Sheets of a workbook, united by name; needs pandas with an excel engine on the driver."""
    import pandas as pd

    frames = [spark.createDataFrame(pd.read_excel(path, sheet_name=s)) for s in (sheets if isinstance(sheets, list) else [sheets])]
    out = frames[0]
    for f in frames[1:]:
        if set(f.columns) != set(out.columns):
            raise ValueError("sheets have different columns")
        out = out.unionByName(f)
    return out


def repeated_columns(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """Positions of the names that the header of a csv repeats."""
    head = spark.read.csv(path, header=False).first()
    at: dict[str, list[int]] = {}
    for i, x in enumerate(head or []):
        at.setdefault(str(x), []).append(i)
    return {k: v for k, v in at.items() if len(v) > 1}


def load_row_groups(spark: SparkSession, path: str, rows: int, seed: int = 42) -> DataFrame:
    """At least ``rows`` rows (all if there are fewer) of whole parquet row groups in a random order, then exactly so many of them.

    Row groups are found from the files' footers on the executors' file system; only the chosen ones are read.
    """
    import random

    files = spark.read.parquet(path).inputFiles()
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    groups = []
    for name in files:
        where = jvm.org.apache.hadoop.fs.Path(name)
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(where, conf))
        try:
            start = 0
            for block in reader.getFooter().getBlocks():
                groups.append((name, start, block.getRowCount()))
                start += block.getRowCount()
        finally:
            reader.close()
    random.Random(seed).shuffle(groups)
    chosen, total = [], 0
    for g in groups:
        if total >= rows:
            break
        chosen.append(g)
        total += g[2]
    df = spark.read.parquet(path)
    if len(chosen) == len(groups):
        return df.orderBy(F.rand(seed)).limit(rows)
    # the last part of a path is enough: schemes are written in several ways, and Spark names files uniquely
    at, index = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), F.col("_metadata.row_index")
    keep = F.lit(False)
    for name, start, n in chosen:
        keep = keep | ((at == name.rpartition("/")[2]) & index.between(start, start + n - 1))
    return df.where(keep).limit(rows)


def profile_and_sample(spark: SparkSession, path: str, folder: str, fmt: str | None = None, rows: int = 100_000) -> DataFrame:
    """Profile the whole table to profile.html and profile.json of a folder, and return a sample of it."""
    import json
    import os

    from basalt.jobs.report import profile_html

    df = load(spark, path, fmt)
    tables = profile_html(df, os.path.join(folder, "profile.html"))
    with open(os.path.join(folder, "profile.json"), "w", encoding="utf-8") as out:
        json.dump({k: [r.asDict() for r in t.limit(1000).collect()] for k, t in tables.items()}, out, default=str)
    return sample(df, rows)


def load_csv_resolving(spark: SparkSession, path: str, resolve: dict[int, str]) -> DataFrame:
    """A csv whose header repeats names: by position, ``drop`` or ``rename:NEW``."""
    raw = spark.read.csv(path, header=False)
    head = [str(x) for x in raw.first()]
    names = [resolve[i].removeprefix("rename:") if resolve.get(i, "drop") != "drop" else f"__drop{i}" if i in resolve else x for i, x in enumerate(head)]
    kept = [x for x in names if not x.startswith("__drop")]
    if len(set(kept)) < len(kept):
        raise ValueError(f"columns repeat: {sorted({x for x in kept if kept.count(x) > 1})}")
    df = spark.read.csv(path, header=True, inferSchema=True, enforceSchema=True).toDF(*names)
    return df.select(*kept)


def restrict(df: DataFrame, allow: list[str] | None = None, deny: list[str] | None = None, always: list[str] = ()) -> DataFrame:
    """Allow- or deny-list of columns, both checked against the schema."""
    if unknown := (set(allow or ()) | set(deny or ())) - set(df.columns):
        raise ValueError(f"no such columns: {sorted(unknown)}")
    kept = sorted(set(allow) | set(always)) if allow else df.columns
    return df.select(*[c for c in kept if c not in set(deny or ())])


def require(df: DataFrame, columns: list[str]) -> None:
    """Errors: no rows, or missing columns."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns are missing: {missing}")
    if df.isEmpty():
        raise ValueError("the table has no rows")


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", rows: int = 1_000_000) -> None:
    """Write in any of Spark's formats; ``excel`` goes through the driver, ``rows`` rows at most (more are an error)."""
    if fmt == "excel":
        if df.count() > rows:
            raise ValueError(f"a workbook can't hold more than {rows} rows")
        df.toPandas().to_excel(path, index=False)
        return
    df.write.format(fmt).options(**({"header": True} if fmt == "csv" else {})).mode(mode).save(path)
