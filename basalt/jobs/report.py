"""Reports as files: small result tables collected and rendered."""

from __future__ import annotations

import html
import json
import logging
import os
import time
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.models.factory import Model, readiness, verdict, wide
from basalt.operators import metrics as M
from basalt.operators import relation as R
from basalt.operators.explore import Report, density
from basalt.operators.profile import value_counts
from basalt.sources.readers import write

log = logging.getLogger("basalt.jobs")
#: Rows of a table that a page shows (a report, not a result).
SHOWN = 200


def table_html(df: DataFrame, rows: int = SHOWN) -> str:
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in df.limit(rows).collect())
    return f"<table><tr>{head}</tr>{body}</table>"


def bars_html(rows: list[tuple[str, float]], width: int = 300) -> str:
    """Labelled bars as an svg."""
    most = max((v for _, v in rows), default=0) or 1
    parts = [f'<text x="0" y="{18 * i + 13}">{html.escape(str(k))}</text><rect x="160" y="{18 * i + 3}" width="{width * v / most:.1f}" height="12"/><text x="{165 + width * v / most:.1f}" y="{18 * i + 13}">{v:g}</text>' for i, (k, v) in enumerate(rows)]
    return f'<svg width="{width + 260}" height="{18 * len(rows) + 6}" font-size="11">{"".join(parts)}</svg>'


def histogram_html(df: DataFrame, column: str, width: int = 400, height: int = 120) -> str:
    """Density histogram and kernel estimate of a column as an svg."""
    hist, curve = (t.collect() for t in density(df, column))
    if not hist:
        return "<p>no values</p>"
    top = max([r["density"] for r in hist] + [r["density"] for r in curve]) or 1
    lo, span = hist[0]["lo"], (hist[-1]["hi"] - hist[0]["lo"]) or 1
    bars = "".join(f'<rect x="{width * (r["lo"] - lo) / span:.1f}" y="{height * (1 - r["density"] / top):.1f}" width="{width / len(hist):.1f}" height="{height * r["density"] / top:.1f}" opacity="0.4"/>' for r in hist)
    line = " ".join(f"{width * (r['x'] - lo) / span:.1f},{height * (1 - r['density'] / top):.1f}" for r in curve)
    return f'<svg width="{width}" height="{height}">{bars}<polyline points="{line}" fill="none" stroke="black"/></svg>'


def combo_html(bins: list[tuple[str, int, float]], width: int = 400, height: int = 120) -> str:
    """Counts as bars and rates as a line over the bins of a feature."""
    most = max((n for _, n, _ in bins), default=0) or 1
    step = width / max(len(bins), 1)
    bars = "".join(f'<rect x="{step * i:.1f}" y="{height * (1 - n / most):.1f}" width="{step * 0.8:.1f}" height="{height * n / most:.1f}" opacity="0.4"><title>{html.escape(k)}</title></rect>' for i, (k, n, _) in enumerate(bins))
    line = " ".join(f"{step * (i + 0.4):.1f},{height * (1 - r):.1f}" for i, (_, _, r) in enumerate(bins))
    return f'<svg width="{width}" height="{height}">{bars}<polyline points="{line}" fill="none" stroke="black"/></svg>'


def page(title: str, sections: dict[str, str]) -> str:
    body = "".join(f"<h2>{html.escape(k)}</h2>{v}" for k, v in sections.items())
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>table{{border-collapse:collapse}}td,th{{border:1px solid #ccc;padding:2px 6px}}</style></head><body><h1>{html.escape(title)}</h1>{body}</body></html>"


def profile_html(df: DataFrame, path: str, target: str | None = None, title: str = "Profile") -> dict[str, DataFrame]:
    """Every table of the report of df, histograms of numeric and frequencies of other columns, as one page."""
    report = Report(df, target)
    tables = report.run_all()
    sections = {k: table_html(t) for k, t in tables.items()}
    for c in report.numeric[:20]:
        sections[f"distribution of {c}"] = histogram_html(report.df, c)
    for c in report.categorical[:20]:
        sections[f"values of {c}"] = bars_html([(r["value"], r["n"]) for r in value_counts(report.df, [c], 10).orderBy("rank").collect()])
    if target is not None:
        for c in report.numeric[:10]:
            bins = R.woe(R.quantile_bins(report.df, [c], target)).collect()
            sections[f"{target} by {c}"] = combo_html([(r["bin"], r["count"], r["event_rate"]) for r in sorted(bins, key=lambda r: float(r["bin"]))])
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        out.write(page(title, sections))
    return tables


def crosstabs(df: DataFrame, pairs: list[tuple[str, str]], folder: str) -> list[str]:
    """A csv of the sorted cells of every pair of columns."""
    out = []
    for a, b in pairs:
        path = os.path.join(folder, f"{a}__{b}")
        write(R.crosstab_sorted(df, a, b).coalesce(1), path, "csv", "overwrite")
        out.append(path)
    return out


def export_shap(values: DataFrame, path: str) -> None:
    """Contributions, one row for each row and feature, as parquet."""
    write(values, path, "parquet", "overwrite")


class ModelCard:
    """What a model is, where its data come from and how it does, by section; as a dict, json or a page."""

    def __init__(self, model: Model, split: DataFrame, config: dict | None = None, calibrator=None, shap: DataFrame | None = None, trials: DataFrame | None = None, board: DataFrame | None = None, key: str | None = None, limitations: list[str] = ()) -> None:
        self.model, self.split, self.config, self.calibrator = model, split, config or {}, calibrator
        self.shap, self.trials, self.board, self.key, self.limitations = shap, trials, board, key, list(limitations)

    def tables(self) -> dict[str, DataFrame]:
        m, spark = self.model, self.split.sparkSession
        rows = m.metric_rows(self.split)
        out = {"performance_metrics": wide(spark.createDataFrame(rows, "split string, metric string, value double"))}
        if m.task == "classification":
            scored = m.predict(self.split.where("split = 'train'"))
            if self.key:
                out["decile_table"] = M.decile_table(scored, "score", m.target, self.key)
            out["calibration"] = M.calibration_bins(scored, "score", m.target)
            self.checks = readiness(rows)
        out["stability"] = spark.createDataFrame([(s, v) for s, k, v in rows if k == "psi"], "split string, psi double")
        for name, t in (("explainability", self.shap), ("tuning", self.trials), ("leaderboard", self.board)):
            if t is not None:
                out[name] = t
        return out

    def to_dict(self) -> dict:
        m = self.model
        sizes = {r["split"]: r["count"] for r in self.split.groupBy("split").count().collect()}
        tables = {k: [r.asDict(recursive=True) for r in t.limit(SHOWN).collect()] for k, t in self.tables().items()}
        checks = getattr(self, "checks", [])
        return {
            "config_summary": {k: v for k, v in self.config.items() if not isinstance(v, (dict, list))}, "model_summary": {"algorithm": m.algorithm, "task": m.task, "params": m.params},
            "data_lineage": {"rows": sizes, "source": self.config.get("source")}, "feature_inventory": [{"feature": f} for f in m.features], **tables,
            "calibration_state": self.calibrator.state() if self.calibrator else None, "limitations": self.limitations,
            "governance": {"checks": checks, "verdict": verdict(checks) if checks else None, "made": datetime.now(timezone.utc).isoformat(timespec="seconds")}, "full_config": self.config,
        }

    def save(self, folder: str) -> dict[str, str]:
        """card.json and card.html; card.xlsx too where pandas has an engine for it."""
        os.makedirs(folder, exist_ok=True)
        d = self.to_dict()
        out = {"json": os.path.join(folder, "card.json"), "html": os.path.join(folder, "card.html")}
        with open(out["json"], "w", encoding="utf-8") as f:
            json.dump(d, f, indent=1, default=str)

        def block(v) -> str:
            if isinstance(v, list) and v and isinstance(v[0], dict):
                head = "".join(f"<th>{html.escape(str(k))}</th>" for k in v[0])
                return f"<table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{html.escape(str(x))}</td>" for x in r.values()) + "</tr>" for r in v) + "</table>"
            return f"<pre>{html.escape(json.dumps(v, indent=1, default=str))}</pre>"

        with open(out["html"], "w", encoding="utf-8") as f:
            f.write(page(f"Model card: {self.model.algorithm}", {k: block(v) for k, v in d.items()}))
        try:
            import openpyxl  # noqa: F401
            import pandas as pd
        except ModuleNotFoundError:
            return out
        out["xlsx"] = os.path.join(folder, "card.xlsx")
        with pd.ExcelWriter(out["xlsx"]) as book:
            for k, v in d.items():
                pd.DataFrame(v if isinstance(v, list) and v else [{"value": json.dumps(v, default=str)}]).to_excel(book, sheet_name=k[:31], index=False)
        return out


def profiles_by_split(split: DataFrame, numeric: list[str]) -> DataFrame:
    """``numeric_summary`` of every split, with its name."""
    from basalt.operators.profile import numeric_summary

    parts = [numeric_summary(split.where(F.col("split") == r[0]), numeric).withColumn("split", F.lit(r[0])) for r in split.select("split").distinct().orderBy("split").collect()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def run_folder(base: str, name: str, at: datetime | None = None) -> str:
    """A new folder <name>_<time>, with a number behind it if there is one already."""
    stem = os.path.join(base, f"{name}_{(at or datetime.now()).strftime('%Y%m%d_%H%M%S')}")
    for i in range(10_000):
        path = stem if i == 0 else f"{stem}_{i}"
        try:
            os.makedirs(path)
            return path
        except FileExistsError:
            continue
    raise RuntimeError(f"no free folder beside {stem}")


@contextmanager
def logged(folder: str) -> Iterator[None]:
    """Messages of this package go to run.log of the folder as well."""
    handler = logging.FileHandler(os.path.join(folder, "run.log"), encoding="utf-8")
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
    root = logging.getLogger("basalt")
    level = root.level
    root.addHandler(handler)
    root.setLevel(min(level or logging.INFO, logging.INFO))
    try:
        yield
    finally:
        root.removeHandler(handler)
        root.setLevel(level)
        handler.close()


class Tracker:
    """Parameters, metrics and artifacts of a run as lines of json; a failure to write is logged and no more."""

    def __init__(self, folder: str, name: str) -> None:
        self.path, self.name, self.began = os.path.join(folder, "tracking.jsonl"), name, time.time()
        self._line("start", {})

    def _line(self, kind: str, what: dict) -> None:
        try:
            with open(self.path, "a", encoding="utf-8") as out:
                out.write(json.dumps({"run": self.name, "kind": kind, "at": time.time(), **what}, default=str) + "\n")
        except OSError as e:
            log.warning("tracking failed: %s", e)

    def params(self, **values) -> None:
        self._line("params", {"values": values})

    def metrics(self, **values) -> None:
        self._line("metrics", {"values": values})

    def artifact(self, path: str) -> None:
        self._line("artifact", {"path": path})

    def close(self, status: str = "done") -> None:
        self._line("end", {"status": status, "seconds": time.time() - self.began})
