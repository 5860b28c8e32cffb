"""A scoring bundle: features, model, calibration, the schema it needs and the distributions it was trained on."""

from __future__ import annotations

import json
import os
import pickle
from collections.abc import Callable


from pyspark import cloudpickle
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.core.schema import numeric, scoring_bucket
from basalt.models.calibrate import Calibrator
from basalt.models.factory import Model
from basalt.operators import metrics as M
from basalt.sources.readers import load, write

VERSION = 1
Stage = Callable[[DataFrame], DataFrame]


class _Writer(cloudpickle.Pickler):
    """Pickles code and numbers; tables that fitted stages hold are written beside, as parquet."""

    def __init__(self, out, folder: str) -> None:
        super().__init__(out)
        self.folder, self.tables = folder, 0

    def persistent_id(self, obj):
        if not isinstance(obj, DataFrame):
            return None
        name = f"state_{self.tables}"
        self.tables += 1
        write(obj, os.path.join(self.folder, name), "parquet", "overwrite")
        return name


class _Reader(pickle.Unpickler):
    def __init__(self, raw, folder: str) -> None:
        super().__init__(raw)
        self.folder = folder

    def persistent_load(self, name):
        return SparkSession.active().read.parquet(os.path.join(self.folder, name))


class Bundle:
    """``predict`` validates, transforms and scores; drift is measured against frozen training data."""

    def __init__(self, model: Model, stage: Stage | None = None, calibrator: Calibrator | None = None, ids: list[str] = ()) -> None:
        self.model, self.stage, self.calibrator, self.ids = model, stage, calibrator, list(ids)
        self.schema: dict[str, str] = {}
        self.scores: list[tuple] = []
        self.features: list[tuple] = []

    def freeze(self, raw: DataFrame) -> Bundle:
        """Keep the raw columns' buckets, the scores' distribution and those of the raw numeric columns."""
        skip = {*self.ids, self.model.target, "split"}
        self.schema = {f.name: scoring_bucket(f.dataType) for f in raw.schema.fields if f.name not in skip}
        nums = [c for c in numeric(raw) if c not in skip]
        self.scores = [tuple(r) for r in M.freeze(self.predict(raw).select(F.col("probability").alias("__score__")), ["__score__"]).collect()]
        self.features = [tuple(r) for r in M.freeze(raw, nums).collect()] if nums else []
        return self

    def validate(self, df: DataFrame) -> None:
        """An empty table, missing columns or another bucket is an error; other columns are left out."""
        if missing := sorted(set(self.schema) - set(df.columns)):
            raise ValueError(f"columns are missing: {missing}")
        kinds = {f.name: scoring_bucket(f.dataType) for f in df.schema.fields}
        if wrong := sorted(c for c, b in self.schema.items() if kinds[c] != b):
            raise ValueError(f"columns are of another kind: {', '.join(f'{c} ({kinds[c]}, not {self.schema[c]})' for c in wrong)}")
        if df.isEmpty():
            raise ValueError("there are no rows to score")

    def predict(self, df: DataFrame) -> DataFrame:
        """(ids, prediction, probability)."""
        if self.schema:
            self.validate(df)
        d = df.select(*self.ids, *[c for c in df.columns if c in self.schema]) if self.schema else df
        scored = self.model.predict(self.stage(d) if self.stage else d)
        if self.calibrator is not None:
            scored = self.calibrator.transform(scored, "score", "score").withColumn("prediction", (F.col("score") >= 0.5).cast("int"))
        return scored.select(*self.ids, "prediction", F.col("score").alias("probability"))

    def predict_one(self, spark: SparkSession, row: dict) -> dict:
        found = self.predict(spark.createDataFrame([row])).first()
        if found is None:
            raise ValueError("the row has nulls that the features don't fill")
        return found.asDict()

    def _reference(self, spark: SparkSession, rows: list[tuple]) -> DataFrame:
        return spark.createDataFrame(rows, "feature string, bin int, lo double, hi double, proportion double")

    def drift(self, df: DataFrame) -> DataFrame:
        """One row, ``__score__``: PSI of the scores of df against those of training."""
        if not self.scores:
            raise ValueError("the bundle has no frozen scores")
        scored = self.predict(df).select(F.col("probability").alias("__score__"))
        return M.csi(self._reference(df.sparkSession, self.scores), scored).withColumnRenamed("csi", "psi")

    def feature_drift(self, df: DataFrame) -> DataFrame:
        """CSI of the raw numeric columns, the greatest first."""
        if not self.features:
            raise ValueError("the bundle has no frozen features")
        return M.csi(self._reference(df.sparkSession, self.features), df).orderBy(F.desc("csi"), "feature")

    def save(self, folder: str) -> None:
        """A folder with the fitted pipeline in MLlib's format, tables of categories, the rest as a pickle, and a manifest to read.

        Boosted trees of our own can't be saved.
        """
        os.makedirs(folder, exist_ok=True)
        if self.model.fitted is not None:
            self.model.fitted.write().overwrite().save(os.path.join(folder, "model"))
        fitted, self.model.fitted = self.model.fitted, None
        try:
            with open(os.path.join(folder, "bundle.pkl"), "wb") as out:
                _Writer(out, folder).dump({"model": self.model, "stage": self.stage, "calibrator": self.calibrator and self.calibrator.state(), "scores": self.scores, "features": self.features})
        finally:
            self.model.fitted = fitted
        manifest = {"version": VERSION, "algorithm": self.model.algorithm, "task": self.model.task, "features": self.model.features, "target": self.model.target, "ids": self.ids, "schema": self.schema, "fitted": fitted is not None}
        with open(os.path.join(folder, "manifest.json"), "w") as out:
            json.dump(manifest, out, indent=1)

    @classmethod
    def load(cls, folder: str) -> Bundle:
        """Only load bundles that you trust: stages are pickled code."""
        with open(os.path.join(folder, "manifest.json")) as lines:
            manifest = json.load(lines)
        if manifest["version"] != VERSION:
            raise ValueError(f"the bundle is of version {manifest['version']}, not {VERSION}")
        with open(os.path.join(folder, "bundle.pkl"), "rb") as raw:
            state = _Reader(raw, folder).load()
        model = state["model"]
        if manifest["fitted"]:
            model.fitted = PipelineModel.load(os.path.join(folder, "model"))
        b = cls(model, state["stage"], Calibrator.from_state(state["calibrator"]) if state["calibrator"] else None, manifest["ids"])
        b.schema, b.scores, b.features = manifest["schema"], state["scores"], state["features"]
        return b


def score_job(spark: SparkSession, bundle: Bundle, source: str, target: str, fmt: str = "parquet", out_fmt: str = "parquet", drift: str | None = None, **options) -> DataFrame:
    """Read, score and write ``target``; with ``drift`` also write the drift of scores and features there as csv."""
    df = load(spark, source, fmt, **options)
    scored = bundle.predict(df)
    write(scored, target, out_fmt)
    if drift:
        both = bundle.drift(df).select("feature", F.col("psi").alias("value"), "flag").unionByName(bundle.feature_drift(df).select("feature", F.col("csi").alias("value"), "flag"))
        write(both.coalesce(1), drift, "csv")
    return scored


def monitor_job(scored: DataFrame, actuals: DataFrame, ids: list[str], score: str, label: str, task: str = "classification", raw: DataFrame | None = None, bundle: Bundle | None = None, folder: str | None = None) -> dict[str, DataFrame]:
    """performance (split, metric, value) of the rows that have an actual, and feature drift of their raw rows; written if a folder is named."""
    if task == "clustering":
        raise ValueError("clusters have no actuals to compare with")
    spark = scored.sparkSession
    d = M.scored_with_actuals(scored, actuals, ids)
    if d.isEmpty():
        raise ValueError("no scored row has an actual")
    if task == "classification":
        found = M.performance_report(scored, actuals, ids, score, label).drop("split").first().asDict()
        c = M.confusion(d, score, label).first()
        found |= {k: c[k] for k in ("precision", "recall", "f1")}
    else:
        found = M.regression(d, score, label).first().asDict()
    rows = [("monitoring", k, None if v is None else float(v)) for k, v in found.items()]
    out = {"performance": spark.createDataFrame(rows, "split string, metric string, value double"), "unmatched": M.unmatched(scored.select(*ids), actuals.select(*ids), ids)}
    if raw is not None and bundle is not None:
        out["feature_drift"] = bundle.feature_drift(raw.join(actuals.select(*ids).distinct(), ids, "left_semi"))
    if folder:
        for name, t in out.items():
            write(t.coalesce(1), os.path.join(folder, name), "parquet", "overwrite")
    return out
