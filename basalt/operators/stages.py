"""Feature pipelines: a fixed order of stages for whole tables, and recipes by column."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.core import settings as S
from basalt.core.schema import numeric
from basalt.operators import features as X

#: Names that mark a date, looked for before types.
DATES = re.compile(r"date|_dt|_ts", re.I)
ENCODERS = ("woe", "target", "frequency", "ordinal", "onehot", "binary", "hash")


class FeaturePipeline:
    """dates, winsorising, imputing, leakage check, encoding of few and of many categories, shapes, scaling; fitted on train.

    Date columns are those whose name says so, whatever their type. ``audit`` tells what became of each column;
    ``inverse`` undoes the scaling only.
    """

    def __init__(self, target: str | None = None, encoder: str = "woe", scaler: str = "robust", distribution: str = "none", winsorise: bool = True, check_leakage: bool = True, threshold: int = S.HIGH_CARDINALITY, reference: str | None = None, keep: list[str] = ()) -> None:
        if encoder not in ENCODERS:
            raise ValueError(f"no encoder is called {encoder}; there are {', '.join(ENCODERS)}")
        self.target, self.encoder, self.scaler, self.distribution = target, encoder, scaler, distribution
        self.winsorise, self.check_leakage, self.threshold, self.reference = winsorise, check_leakage, threshold, reference
        self.keep = [*keep, *([target] if target else [])]
        self.stages: list[X.Stage] = []
        self.log: list[tuple[str, str]] = []
        self.outputs: list[str] = []
        self._inverse: X.Stage = lambda df: df

    def _add(self, now: DataFrame, stage: X.Stage, name: str, columns: list[str]) -> DataFrame:
        self.stages.append(stage)
        self.log += [(c, name) for c in columns]
        return stage(now)

    def fit(self, train: DataFrame) -> FeaturePipeline:
        self.stages, self.log = [], [(c, "input") for c in train.columns if c not in self.keep]
        now = train
        features = [c for c in train.columns if c not in self.keep]
        for c in [c for c in features if DATES.search(c)]:
            kind = dict(train.dtypes)[c]
            if kind == "string":
                parse = lambda df, c=c: df.withColumn(c, F.try_to_timestamp(F.col(c)))
                now = self._add(now, parse, "parse_date", [c])
            elif kind not in ("date", "timestamp", "timestamp_ntz"):
                continue  # a number by a date's name can't be one
            now = self._add(now, X.date_parts(now, c, self.reference), "date_parts", [c])
        features = [c for c in now.columns if c not in self.keep]
        nums = [c for c in numeric(now) if c in features]
        texts = [c for c in features if c not in nums]
        if self.winsorise and nums:
            now = self._add(now, X.clip(now, nums), "winsorise", nums)
        now = self._add(now, X.impute(now, features), "impute", [c for c in features])
        if self.check_leakage and self.target and nums:
            X.leakage(now, nums, self.target, strict=True)
        kinds = dict(zip(texts, now.agg(*[F.countDistinct(c) for c in texts]).first(), strict=True)) if texts else {}
        for c in texts:
            how = self.encoder if kinds[c] <= self.threshold else ("target" if self.target else "frequency")
            if how in ("woe", "target") and not self.target:
                how = "frequency"
            stage = {
                "woe": lambda c=c, d=now: X.woe_encode(d, c, self.target), "target": lambda c=c, d=now: X.target_encode(d, c, self.target), "frequency": lambda c=c, d=now: X.frequency_encode(d, c),
                "ordinal": lambda c=c, d=now: X.ordinal(d, c), "onehot": lambda c=c, d=now: X.one_hot(d, c), "binary": lambda c=c, d=now: X.binary_bits(d, c), "hash": lambda c=c: X.hash_encode(c),
            }[how]()
            now = self._add(now, lambda df, s=stage, c=c: s(df).drop(c), f"{how}_encode", [c])
        outputs = [c for c in numeric(now) if c not in self.keep]
        if self.distribution != "none" and nums:
            now = self._add(now, X.reshape(now, nums, self.distribution), self.distribution, nums)
        if self.scaler != "none" and outputs:
            if self.scaler == "l2_norm":
                stage = X.scale(now, outputs, "l2_norm")
            else:
                parameters = X.scale_parameters(now, outputs, self.scaler)
                stage = X.scaled(parameters)
                self._inverse = lambda df: df.withColumns({c: F.col(c) * F.lit(w) + F.lit(m) for c, (m, w) in parameters.items()})
            now = self._add(now, stage, f"scale_{self.scaler}", outputs)
        self.outputs = outputs
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        for stage in self.stages:
            df = stage(df)
        return df.select(*[c for c in self.keep if c in df.columns], *self.outputs)

    def inverse(self, df: DataFrame) -> DataFrame:
        if self.scaler == "l2_norm":
            raise NotImplementedError("the norm of a row is not kept")
        return self._inverse(df)

    def audit(self, df: DataFrame) -> DataFrame:
        """(column, position, step): every step that a column went through, in order."""
        count: dict[str, int] = {}
        rows = []
        for c, step in self.log:
            rows.append((c, count.setdefault(c, 0), step))
            count[c] += 1
        return df.sparkSession.createDataFrame(rows, "column string, position int, step string")


class Recipes:
    """Steps by column, from the registry of stages; columns without a recipe pass through.

    A recipe is a list of (name, parameters). Each is fitted on train after those before; new columns of a step stand
    where the column stood, and the last step of an encoder takes the column's place.
    """

    def __init__(self, recipes: dict[str, list[tuple[str, dict]]], target: str | None = None) -> None:
        self.recipes, self.target = recipes, target
        self.done: list[tuple[str, X.Stage, list[str]]] = []

    def fit(self, train: DataFrame) -> Recipes:
        if missing := [c for c in self.recipes if c not in train.columns]:
            raise ValueError(f"no such columns: {missing}")
        self.done, now = [], train
        for column, steps in self.recipes.items():
            at = column
            for name, how in steps:
                stage = X.registry(name, at, self.target, **how)(now)
                before = now.columns
                after = stage(now)
                made = [c for c in after.columns if c not in before]
                flags = [c for c in made if c.endswith("_was_missing")]
                encoded = [c for c in made if c not in flags]
                self.done.append((at, stage, encoded))
                now = self._replace(after, at, encoded)
                if len(encoded) > 1:
                    break  # several columns can't be the input of one more step
        return self

    @staticmethod
    def _replace(df: DataFrame, column: str, made: list[str]) -> DataFrame:
        if len(made) == 1:
            return df.drop(column).withColumnRenamed(made[0], column)
        return df.drop(column) if made and column in df.columns else df

    def transform(self, df: DataFrame) -> DataFrame:
        for column, stage, made in self.done:
            df = self._replace(stage(df), column, made)
        return df


def recommend_recipes(df: DataFrame, columns: list[str]) -> dict[str, list[tuple[str, dict]]]:
    """A recipe for each column from its profile."""
    from basalt.operators import profile as P

    nums = [c for c in columns if c in set(numeric(df))]
    texts = [c for c in columns if c not in nums]
    out: dict[str, list[tuple[str, dict]]] = {}
    if nums:
        for r in P.numeric_summary(df, nums).collect():
            out[r["feature"]] = [(s, {}) for s in X.recommend({"kind": "numeric", "constant": r["constant_flag"], "missing_pct": r["missing_pct"], "skewness": r["skewness"], "min": r["min"]})]
    if texts:
        for r in P.categorical_summary(df, texts).collect():
            out[r["feature"]] = [(s, {}) for s in X.recommend({"kind": "categorical", "constant": r["n_unique"] <= 1, "missing_pct": r["missing_pct"], "n_unique": r["n_unique"]})]
    return {c: out[c] for c in columns}
