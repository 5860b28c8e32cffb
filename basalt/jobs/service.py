"""Operations of a service or an assistant: each previews or confirms one step and returns plain values.

A confirmed step drops the results of the later ones. Long steps run in the background: ``start`` gives a
number, ``poll`` its state. Nothing here computes what the operators don't; rows that are shown are bounded.
"""

from __future__ import annotations

import hmac
import os
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.core import settings as S
from basalt.core.lineage import checkpoint
from basalt.core.schema import buckets
from basalt.jobs.report import ModelCard
from basalt.models import factory
from basalt.models.calibrate import Calibrator
from basalt.models.explain import mean_shap, shap_values
from basalt.operators import explore as E
from basalt.operators import profile as P
from basalt.operators import relation as R
from basalt.operators import select as C
from basalt.operators import split as L
from basalt.operators.stages import Recipes, recommend_recipes
from basalt.sources.readers import load, load_csv_resolving, repeated_columns

STEPS = ("load", "target", "split", "explore", "features", "selection", "imbalance", "train", "tune", "evaluate", "calibrate", "explain")
SHOWN = 20
#: What each metric says, in a few words.
GLOSS = {"roc_auc": "chance that a positive scores above a negative", "gini": "twice the AUC less one", "ks": "greatest gap of the two score distributions", "f1": "balance of precision and recall", "precision": "share of alarms that are right", "recall": "share of positives found", "log_loss": "mean surprise, lower is better", "psi": "shift of scores against training, lower is better"}


def rows_of(df: DataFrame, n: int = SHOWN) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.limit(n).collect()]


class Denied(PermissionError):
    pass


def authorise(given: str | None, wanted: str | None) -> None:
    """Compare keys in constant time; without a wanted key nobody is let in."""
    if not wanted or not given or not hmac.compare_digest(given.encode(), wanted.encode()):
        raise Denied("the key is missing or wrong")


class Session:
    """The steps of one user over one table."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, os.path.realpath(base)
        self.state: dict[str, object] = {}
        self.jobs: dict[str, dict] = {}
        self._lock = threading.Lock()

    def _path(self, path: str) -> str:
        full = os.path.realpath(os.path.join(self.base, path))
        if os.path.commonpath([full, self.base]) != self.base:
            raise ValueError("the path lies outside of the data folder")
        return full

    def _confirm(self, step: str, **values) -> None:
        at = STEPS.index(step)
        for later in STEPS[at + 1 :]:
            self.state.pop(later, None)
        self.state[step] = values

    def _need(self, step: str) -> dict:
        if step not in self.state:
            raise ValueError(f"confirm the step {step} first")
        return self.state[step]

    # load

    def preview_load(self, path: str) -> dict:
        full = self._path(path)
        if full.endswith(".csv"):
            twice = repeated_columns(self.spark, full)
            if twice:
                return {"repeated": twice, "rows": []}
        df = load(self.spark, full)
        return {"repeated": {}, "columns": dict(df.dtypes), "rows": rows_of(df)}

    def confirm_load(self, path: str, resolve: dict[int, str] | None = None) -> dict:
        full = self._path(path)
        df = load_csv_resolving(self.spark, full, resolve) if resolve else load(self.spark, full)
        self._confirm("load", df=df)
        return {"rows": df.count(), "columns": dict(df.dtypes)}

    # target

    def preview_target(self, target: str) -> dict:
        df = self._need("load")["df"]
        counts = {r[0]: r[1] for r in df.groupBy(target).count().orderBy(F.desc("count")).limit(SHOWN).collect()}
        problems = []
        if None in counts:
            problems.append("values are missing")
        if set(counts) - {None} != {0, 1}:
            problems.append("values must be 0 and 1")
        elif counts[1] > counts[0]:
            problems.append("1 must be the rarer class")
        return {"counts": counts, "problems": problems}

    def confirm_target(self, target: str, key: str) -> dict:
        found = self.preview_target(target)
        if found["problems"]:
            raise ValueError("; ".join(found["problems"]))
        self._confirm("target", target=target, key=key)
        return found

    # split

    def preview_split(self, strategy: str = "random", **how) -> dict:
        return self._split(strategy, how)[1]

    def _split(self, strategy: str, how: dict) -> tuple[DataFrame, dict]:
        from basalt.jobs.run import Config, split_by

        t = self._need("target")
        df = split_by(self._need("load")["df"], Config(key=t["key"], target=t["target"], split={"strategy": strategy, **how}))
        per = {r["split"]: {"rows": r["n"], "rate": r["rate"]} for r in df.groupBy("split").agg(F.count("*").alias("n"), F.avg(F.col(t["target"]).cast("double")).alias("rate")).collect()}
        if not per.get("train", {}).get("rows"):
            raise ValueError("the split leaves no rows to train on")
        return df, per

    def confirm_split(self, strategy: str = "random", **how) -> dict:
        df, per = self._split(strategy, how)
        self._confirm("split", df=df)
        return per

    # explore

    def _train(self) -> DataFrame:
        return self._need("split")["df"].where("split = 'train'").drop("split")

    def preview_explore(self, identifiers: list[str] = ()) -> dict:
        t = self._need("target")
        report = E.Report(self._train(), t["target"], [t["key"], *identifiers])
        return {k: rows_of(v) for k, v in report.run_all().items()}

    def column_chart(self, column: str) -> dict:
        t, df = self._need("target"), self._train()
        kind = next(k for k, cs in buckets(df).items() if column in cs)
        if kind == "numeric":
            hist, curve = E.density(df, column)
            return {"kind": "histogram", "bars": rows_of(hist, 100), "curve": rows_of(curve, 200), "rates": rows_of(R.woe(R.quantile_bins(df, [column], t["target"])))}
        return {"kind": "bars", "bars": rows_of(P.value_counts(df, [column], SHOWN).orderBy("rank"))}

    def confirm_explore(self, drop: list[str] = ()) -> dict:
        self._confirm("explore", drop=list(drop))
        return {"drop": list(drop)}

    # features

    def _columns(self) -> list[str]:
        t = self._need("target")
        gone = {t["target"], t["key"], "split", *self.state.get("explore", {}).get("drop", [])}
        return [c for c in self._need("split")["df"].columns if c not in gone]

    def preview_features(self, recipes: dict | None = None) -> dict:
        t, train = self._need("target"), self._train()
        recipes = recipes if recipes is not None else recommend_recipes(train, self._columns())
        made = Recipes(recipes, t["target"]).fit(train.select(t["key"], t["target"], *self._columns())).transform(train.select(t["key"], t["target"], *self._columns()))
        return {"recipes": recipes, "rows": rows_of(made), "columns": dict(made.dtypes)}

    def confirm_features(self, recipes: dict | None = None) -> dict:
        t, df = self._need("target"), self._need("split")["df"]
        train = df.where("split = 'train'")
        recipes = recipes if recipes is not None else recommend_recipes(train, self._columns())
        keep = [t["key"], t["target"], "split", *self._columns()]
        fitted = Recipes(recipes, t["target"]).fit(train.select(*keep))
        out = checkpoint(fitted.transform(df.select(*keep)))
        numeric = [c for c in buckets(out)["numeric"] if c not in (t["key"], t["target"])]
        self._confirm("features", df=out, columns=numeric, recipes=recipes)
        return {"columns": numeric}

    # selection

    def confirm_selection(self, selectors: list[C.Selector] | None = None) -> dict:
        t, f = self._need("target"), self._need("features")
        chosen = C.Selection(selectors).fit(f["df"].where("split = 'train'"), f["columns"], t["target"])
        self._confirm("selection", columns=chosen.kept or f["columns"])
        return {"kept": chosen.kept, "audit": rows_of(chosen.audit(f["df"]), 1000)}

    def _features(self) -> list[str]:
        return self.state["selection"]["columns"] if "selection" in self.state else self._need("features")["columns"]

    # imbalance

    def preview_imbalance(self) -> dict:
        t, f = self._need("target"), self._need("features")
        n = {r[0]: r[1] for r in f["df"].where("split = 'train'").groupBy(t["target"]).count().collect()}
        rare, common = min(n.values()), max(n.values())
        share = rare / (rare + common)
        return {"share": share, "balanced": S.BALANCED[0] <= share <= S.BALANCED[1], "rows": {"none": rare + common, "weights": rare + common, "undersample": 2 * rare, "oversample": 2 * common, "smote": 2 * common}}

    def confirm_imbalance(self, strategy: str = "none") -> dict:
        if strategy not in self.preview_imbalance()["rows"]:
            raise ValueError(f"no strategy is called {strategy}")
        self._confirm("imbalance", strategy=strategy)
        return {"strategy": strategy}

    # train, tune, evaluate, calibrate, explain

    def train(self, algorithm: str = "logistic", **params) -> dict:
        from basalt.jobs.run import Config, resampled

        t, f = self._need("target"), self._need("features")
        c = Config(key=t["key"], target=t["target"], imbalance=self.state.get("imbalance", {}).get("strategy", "none"))
        rows, weight = resampled(f["df"].where("split = 'train'"), self._features(), c)
        model = factory.Model(algorithm, self._features(), t["target"], params=params).fit(rows, weight)
        self._confirm("train", model=model)
        return {"algorithm": algorithm, "importance": model.importance()[:SHOWN]}

    def leaderboard(self, names: list[str] | None = None) -> list[dict]:
        t, f = self._need("target"), self._need("features")
        return rows_of(factory.leaderboard(f["df"], self._features(), t["target"], names), 50)

    def tune(self, algorithm: str = "logistic", trials: int = 10) -> dict:
        t, f = self._need("target"), self._need("features")
        model, table = factory.tune(f["df"], self._features(), t["target"], algorithm, trials=trials)
        self._confirm("tune", model=model)
        self.state["train"] = {"model": model}
        default = factory.CLASSIFIERS.get(algorithm, (None, {}))[1]
        return {"parameters": [{"parameter": k, "default": default.get(k), "tuned": v} for k, v in model.params.items()], "trials": rows_of(table.orderBy("trial"), 1000)}

    def evaluate(self) -> dict:
        model, f = self._need("train")["model"], self._need("features")
        rows = model.metric_rows(f["df"])
        checks = factory.readiness(rows)
        self._confirm("evaluate", rows=rows)
        return {"metrics": [{"split": s, "metric": m, "gloss": GLOSS.get(m, ""), "value": v} for s, m, v in rows], "flags": [c for c in checks if c["status"] != "pass"], "verdict": factory.verdict(checks)}

    def calibrate(self, method: str = "isotonic") -> dict:
        t, f, model = self._need("target"), self._need("features"), self._need("train")["model"]
        there = {r[0] for r in f["df"].select("split").distinct().collect()}
        on = next(s for s in ("val", "test", "train") if s in there)
        c = Calibrator(method).fit(model.predict(f["df"].where(F.col("split") == on)), "score", t["target"])
        self._confirm("calibrate", calibrator=c)
        return {"split": on, "before": c.before, "after": c.after, "recommended": c.recommended()}

    def explain(self, rows: int = 500) -> list[dict]:
        t, f, model = self._need("target"), self._need("features"), self._need("train")["model"]
        if "explain" not in self.state:
            self._confirm("explain", table=rows_of(mean_shap(shap_values(model, f["df"].where("split = 'train'"), t["key"], rows=rows)), 1000))
        return self.state["explain"]["table"]

    # background work

    def start(self, work: Callable[[], object]) -> str:
        number = uuid.uuid4().hex
        with self._lock:
            self.jobs[number] = {"status": "running"}

        def go() -> None:
            try:
                done = {"status": "done", "result": work()}
            except Exception as e:  # noqa: BLE001  whatever ends the work is its result, for the one who polls
                done = {"status": "failed", "error": str(e)[:500]}
            with self._lock:
                self.jobs[number] = done

        threading.Thread(target=go, daemon=True).start()
        return number

    def poll(self, number: str) -> dict:
        with self._lock:
            if number not in self.jobs:
                raise KeyError(number)
            return dict(self.jobs[number])


# Tools of an assistant: one call each


def _prepared(spark: SparkSession, path: str, target: str, key: str | None) -> tuple[DataFrame, list[str], str]:
    df = load(spark, path)
    if key is None:
        key = "__key"
        df = df.withColumn(key, F.xxhash64(*df.columns))
    split = L.random_split(df, key)
    return split, [c for c in buckets(split)["numeric"] if c not in (target, key)], key


def analyze_dataset(spark: SparkSession, path: str, target: str | None = None) -> dict:
    """Overview, alerts, and red flags: columns of which over half is missing."""
    df = load(spark, path)
    b = buckets(df)
    numeric, categorical = ([c for c in b[k] if c != target] for k in ("numeric", "categorical"))
    missing = rows_of(P.missing_summary(df), 1000)
    return {"overview": rows_of(P.overview(df))[0], "alerts": rows_of(E.alerts(df, numeric, categorical, target), 1000), "red_flags": [r["feature"] for r in missing if r["missing_pct"] > S.RED_MISSING]}


def train_and_compare_models(spark: SparkSession, path: str, target: str, key: str | None = None, names: list[str] | None = None) -> list[dict]:
    split, features, _ = _prepared(spark, path, target, key)
    return rows_of(factory.leaderboard(split, features, target, names), 50)


def check_model_readiness(spark: SparkSession, path: str, target: str, key: str | None = None, algorithm: str = "logistic") -> dict:
    split, features, _ = _prepared(spark, path, target, key)
    checks = factory.readiness(factory.Model(algorithm, features, target).fit(split.where("split = 'train'")).metric_rows(split))
    return {"checks": checks, "verdict": factory.verdict(checks)}


def explain_model(spark: SparkSession, path: str, target: str, key: str | None = None, algorithm: str = "logistic") -> list[dict]:
    split, features, key = _prepared(spark, path, target, key)
    train = split.where("split = 'train'")
    return rows_of(mean_shap(shap_values(factory.Model(algorithm, features, target).fit(train), train, key)), 1000)


def generate_report(spark: SparkSession, path: str, target: str, folder: str, key: str | None = None, algorithm: str = "logistic") -> dict[str, str]:
    split, features, key = _prepared(spark, path, target, key)
    model = factory.Model(algorithm, features, target).fit(split.where("split = 'train'"))
    return ModelCard(model, split, {"source": path, "target": target}, key=key).save(folder)
