"""Whole runs from a configuration: load, split, explore, binarise, features, selection, imbalance, train, tune, evaluate, calibrate, explain, report."""

from __future__ import annotations

import dataclasses
import json
import logging
import os
from dataclasses import dataclass, field

import yaml
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.core import settings as S
from basalt.jobs.bundle import Bundle
from basalt.jobs.report import ModelCard, Tracker, export_shap, logged, profile_html, run_folder
from basalt.models import factory
from basalt.models.calibrate import Calibrator
from basalt.models.explain import mean_shap, shap_values
from basalt.models.own import smote
from basalt.operators import select as C
from basalt.operators import split as L
from basalt.operators.stages import FeaturePipeline
from basalt.sources.readers import load, restrict

log = logging.getLogger("basalt.jobs")


@dataclass
class Config:
    """Settings of a run; unknown keys are errors. ``deviations`` lists what differs from the defaults."""

    source: str = ""
    key: str = ""
    target: str = ""
    name: str = "run"
    format: str = "parquet"
    task: str = "classification"
    allow: list[str] | None = None
    deny: list[str] | None = None
    ids: list[str] = field(default_factory=list)
    split: dict = field(default_factory=lambda: {"strategy": "random"})
    binarise: dict | None = None
    explore: bool = False
    encoder: str = "woe"
    scaler: str = "robust"
    distribution: str = "none"
    selection: bool = True
    imbalance: str = "none"
    algorithm: str = "logistic"
    params: dict = field(default_factory=dict)
    leaderboard: list[str] | None = None
    trials: int = 0
    calibration: str | None = "isotonic"
    explain: bool = False
    folder: str = "runs"

    @classmethod
    def of(cls, values: dict) -> Config:
        known = {f.name for f in dataclasses.fields(cls)}
        if unknown := sorted(set(values) - known):
            raise ValueError(f"unknown settings: {unknown}; there are {sorted(known)}")
        c = cls(**values)
        if missing := [k for k in ("source", "key", "target") if not getattr(c, k)]:
            raise ValueError(f"settings are missing: {missing}")
        if c.task not in ("classification", "regression"):
            raise ValueError(f"no task is called {c.task}")
        if c.algorithm not in factory.algorithms(c.task):
            raise ValueError(f"no {c.task} algorithm is called {c.algorithm}")
        if c.imbalance not in ("none", "weights", "undersample", "oversample", "smote"):
            raise ValueError(f"no strategy for imbalance is called {c.imbalance}")
        return c

    @classmethod
    def read(cls, path: str) -> Config:
        with open(path, encoding="utf-8") as lines:
            return cls.of(yaml.safe_load(lines) or {})

    def write(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as out:
            yaml.safe_dump(dataclasses.asdict(self), out, sort_keys=False)

    def deviations(self) -> list[dict]:
        default = dataclasses.asdict(Config())
        return [{"setting": k, "default": default[k], "value": v} for k, v in dataclasses.asdict(self).items() if v != default[k]]

    def prepared(self) -> Config:
        """A logistic model needs scaled features: without a scaler the standard one is set."""
        if self.algorithm == "logistic" and self.scaler == "none":
            return dataclasses.replace(self, scaler="standard")
        return self


def split_by(df: DataFrame, c: Config) -> DataFrame:
    how = dict(c.split)
    strategy = how.pop("strategy", "random")
    if strategy == "random":
        return L.random_split(df, c.key, **how)
    if strategy == "stratified":
        return L.stratified_split(df, c.key, c.target, **how)
    if strategy == "grouped":
        return L.grouped_split(df, key=c.key, **how)
    if strategy == "temporal":
        return L.temporal_split(df, key=c.key, **how)
    raise ValueError(f"no split is called {strategy}")


def resampled(train: DataFrame, features: list[str], c: Config) -> tuple[DataFrame, str | None]:
    """Training rows after the strategy for imbalance, and the column of weights if there is one."""
    if c.imbalance == "undersample":
        return L.undersample(train, c.key, c.target), None
    if c.imbalance == "oversample":
        return L.oversample(train, c.key, c.target), None
    if c.imbalance == "smote":
        return smote(train, features, c.target, c.key), None
    if c.imbalance == "weights":
        w = L.class_weights(train, c.target).select(F.col("class").alias(c.target), F.col("weight").alias("__w"))
        return train.join(F.broadcast(w), c.target), "__w"  # a row a class
    return train, None


class Run:
    """One run; ``results`` holds what each stage made. Exploring, calibrating and explaining may fail without ending it."""

    def __init__(self, config: Config) -> None:
        self.asked, self.config = config, config.prepared()
        self.results: dict[str, object] = {}
        self.skipped: dict[str, str] = {}

    def _optional(self, name: str, work) -> object | None:
        try:
            return work()
        except (ValueError, RuntimeError, PySparkException) as e:
            log.warning("%s failed: %s", name, e)
            self.skipped[name] = str(e)[:300]
            return None

    def start(self, spark: SparkSession) -> Run:
        c = self.config
        folder = run_folder(c.folder, c.name)
        self.results["folder"] = folder
        tracker = Tracker(folder, c.name)
        tracker.params(**dataclasses.asdict(c))
        c.write(os.path.join(folder, "config.yaml"))
        try:
            with logged(folder):
                self._stages(spark, c, folder, tracker)
        except BaseException:
            tracker.close("failed")
            raise
        tracker.close()
        return self

    def _stages(self, spark: SparkSession, c: Config, folder: str, tracker: Tracker) -> None:
        r = self.results
        raw = load(spark, c.source, c.format)
        raw = restrict(raw, c.allow, c.deny, always=[c.key, c.target, *c.ids])
        if c.binarise and c.task == "classification":
            made = L.binarise(raw, c.target, **c.binarise)
            raw = made.drop(c.target).withColumnRenamed("target", c.target)
        data = split_by(raw, c)
        log.info("rows by split: %s", {x["split"]: x["count"] for x in data.groupBy("split").count().collect()})
        L.validate(data, c.target, c.task)
        r["gap"] = L.class_gap(data, c.target) if c.task == "classification" else None
        train = data.where("split = 'train'")
        if c.explore:
            r["profile"] = self._optional("explore", lambda: profile_html(train.drop("split", c.key, *c.ids), os.path.join(folder, "profile.html"), c.target if c.task == "classification" else None))
        keep = [c.key, *c.ids, "split"]
        stages = FeaturePipeline(c.target if c.task == "classification" else None, c.encoder, c.scaler, c.distribution, keep=[*keep, *([c.target] if c.task != "classification" else [])]).fit(train)
        ready = stages.transform(data)
        features = stages.outputs
        r["stages"] = stages
        if c.selection:
            selectors = [make() for make in (C.RUN if c.task == "classification" else C.RUN[:-1])]
            chosen = C.Selection(selectors).fit(ready.where("split = 'train'"), features, c.target if c.task == "classification" else None)
            r["selection"] = chosen
            if chosen.kept:
                features = chosen.kept
        rows, weight = resampled(ready.where("split = 'train'"), features, c)
        algorithm = c.algorithm
        if c.leaderboard:
            board = factory.leaderboard(ready, features, c.target, c.leaderboard, c.task)
            r["leaderboard"] = board
            algorithm = board.orderBy("rank").first()["algorithm"]
        params = dict(c.params)
        if c.trials:
            _, trials = factory.tune(ready, features, c.target, algorithm, c.task, c.trials)
            r["trials"] = trials
            best = trials.where("value is not null").orderBy(F.desc("value") if c.task == "classification" else F.asc("value")).first()
            params |= {k: _parsed(v) for k, v in best["params"].items()}
        model = factory.Model(algorithm, features, c.target, c.task, params).fit(rows, weight)
        r["model"] = model
        metrics = model.metric_rows(ready)
        r["metrics"] = metrics
        tracker.metrics(**{f"{s}.{m}": v for s, m, v in metrics})
        calibrator = None
        if c.calibration and c.task == "classification":
            val = model.predict(ready.where("split = 'val'"))
            calibrator = self._optional("calibrate", lambda: Calibrator(c.calibration).fit(val, "score", c.target))
            calibrator = calibrator if calibrator and calibrator.recommended() else None
        bundle = Bundle(model, stages.transform, calibrator, [c.key, *c.ids])
        bundle.freeze(train.drop("split"))
        r["bundle"] = os.path.join(folder, "bundle")
        bundle.save(r["bundle"])
        tracker.artifact(r["bundle"])
        shap = None
        if c.explain:
            values = self._optional("explain", lambda: shap_values(model, ready.where("split = 'train'"), c.key))
            if values is not None:
                shap = mean_shap(values)
                export_shap(values, os.path.join(folder, "shap"))
        card = ModelCard(model, ready, dataclasses.asdict(c), calibrator, shap, r.get("trials"), r.get("leaderboard"), c.key, [f"{k} was skipped: {v}" for k, v in self.skipped.items()])
        r["card"] = card.save(folder)
        with open(os.path.join(folder, "deviations.json"), "w", encoding="utf-8") as out:
            json.dump(self.asked.deviations(), out, indent=1, default=str)


def _parsed(x: str) -> object:
    for kind in (int, float):
        try:
            return kind(x)
        except ValueError:
            continue
    return x


def run(spark: SparkSession, path: str) -> Run:
    """A run from a YAML file."""
    return Run(Config.read(path)).start(spark)


#: Band of the share of the rarer class in which nothing need be done.
LOW, HIGH = S.BALANCED
