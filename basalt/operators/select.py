"""Feature selection: statistics in Spark, rules on one row per feature."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basalt.core import settings as S
from basalt.core.schema import long_form, non_numeric
from basalt.core.schema import numeric as numeric_columns
from basalt.operators.profile import r6
from basalt.operators.relation import category_bins, iv_table, pearson, quantile_bins, woe


def _shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, nulls, share, kinds): share of nulls, of the most frequent value among the others, and distinct values.

    Numbers are counted as numbers, not as text.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    kinds: dict[str, list[str]] = {}
    for c in columns:
        kind = "long" if isinstance(types[c], T.IntegralType) else "double" if isinstance(types[c], T.FractionalType) and not isinstance(types[c], T.DecimalType) else "string"
        kinds.setdefault(kind, []).append(c)
    known, v = F.when(F.col("value").isNotNull(), F.col("n")), F.col("value")
    out = []
    for kind, some in kinds.items():
        per = long_form(df, some, to=kind).groupBy("feature", "value").agg(F.count("*").alias("n"))
        out.append(per.groupBy("feature").agg((F.sum(F.when(v.isNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("nulls"), (F.max(known) / F.sum(known)).alias("share"), F.count("value").alias("kinds")))
    return reduce(DataFrame.unionByName, out)


def basic(df: DataFrame, columns: list[str], max_null: float = S.MAX_NULL_RATE, quasi: float = S.QUASI_CONSTANT, most: int = S.HIGH_CARDINALITY, shares: DataFrame | None = None) -> DataFrame:
    """Null-rate, constant and cardinality rules from value counts; the last also drops non-numeric columns of over ``most`` values.

    ``shares`` are counts of before (``_shares``), of these columns at least.
    """
    t = _shares(df, columns) if shares is None else shares.where(F.col("feature").isin(*columns))
    constant = F.coalesce((F.col("kinds") <= 1) | (F.col("share") >= quasi), F.lit(True))
    texts = [c for c in columns if c in set(non_numeric(df))]
    wide = F.col("feature").isin(*texts) & (F.col("kinds") > most) if texts else F.lit(False)
    return t.select("feature", r6(F.col("nulls")).alias("null_rate"), (F.col("nulls") > max_null).alias("drop_null"), constant.alias("drop_constant"), F.col("kinds").alias("n_unique"), ((F.col("kinds") <= 1) | wide).alias("drop_cardinality"))


def information_values(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    nums = [c for c in columns if c in set(numeric_columns(df))]
    texts = [c for c in columns if c not in nums]
    tables = ([quantile_bins(df, nums, target)] if nums else []) + ([category_bins(df, texts, target)] if texts else [])
    return iv_table(woe(tables[0] if len(tables) == 1 else tables[0].unionByName(tables[1])))


def low_iv(df: DataFrame, columns: list[str], target: str, least: float = S.LOW_IV) -> DataFrame:
    return information_values(df, columns, target).where(F.col("iv") < least).select("feature", "iv", F.lit(f"iv below {least}").alias("reason"))


def correlated(df: DataFrame, columns: list[str], limit: float = S.HIGH_CORRELATION, iv: dict[str, float] | None = None) -> DataFrame:
    """Greedy scan of the pairs in column order; of a pair above the limit the one of lower information value goes, or variance if one has none."""
    r = {(x["a"], x["b"]): x["r"] for x in pearson(df, columns).collect()}
    variance = df.agg(*[F.var_samp(c).alias(c) for c in columns]).first()
    gone: dict[str, str] = {}
    for (a, b), v in r.items():
        if v is not None and abs(v) > limit and a not in gone and b not in gone:
            x, y = (iv[a], iv[b]) if iv and a in iv and b in iv else (variance[a] or 0, variance[b] or 0)
            loser, other = (a, b) if x < y else (b, a)
            gone[loser] = other
    return df.sparkSession.createDataFrame([(c, o) for c, o in gone.items()], "feature string, correlated_with string")


class Selector(ABC):
    """A rule that removes features: the extension point of ``Selection``."""

    name = "custom"

    @abstractmethod
    def removed(self, df: DataFrame, columns: list[str], target: str | None) -> dict[str, str]:
        """Reason by feature that goes."""


class Flag(Selector):
    """One of the flags of ``basic``."""

    def __init__(self, name: str, flag: str, reason: str, **limits) -> None:
        self.name, self.flag, self.reason, self.limits = name, flag, reason, limits
        self.shares: DataFrame | None = None

    def removed(self, df, columns, target):
        return {r["feature"]: self.reason.format(**r.asDict()) for r in basic(df, columns, **self.limits, shares=self.shares).collect() if r[self.flag]}


class Correlation(Selector):
    name = "correlation"

    def __init__(self, limit: float = S.HIGH_CORRELATION, iv: dict[str, float] | None = None) -> None:
        self.limit, self.iv = limit, iv

    def removed(self, df, columns, target):
        nums = [c for c in columns if c in set(numeric_columns(df))]
        if len(nums) < 2:
            return {}
        return {r["feature"]: f"correlated with {r['correlated_with']}" for r in correlated(df, nums, self.limit, self.iv).collect()}


class LowInformation(Selector):
    name = "iv"

    def __init__(self, least: float = S.LOW_IV, table: DataFrame | None = None) -> None:
        self.least, self.table = least, table

    def removed(self, df, columns, target):
        if target is None:
            return {}
        t = self.table if self.table is not None else information_values(df, columns, target)
        return {r["feature"]: f"iv {r['iv']:.4f} below {self.least}" for r in t.where(F.col("iv") < self.least).collect() if r["feature"] in columns}


class LowShap(Selector):
    """Features whose mean absolute contribution to a model lies below a threshold; 0 removes none."""

    name = "shap"

    def __init__(self, threshold: float = 0.0, algorithm: str = "logistic") -> None:
        self.threshold, self.algorithm = threshold, algorithm

    def removed(self, df, columns, target):
        from basalt.models.explain import shap_table

        rows = shap_table(df, columns, target, self.algorithm).collect()
        return {r["feature"]: f"shap {r['mean_abs_shap']:.6f} below {self.threshold}" for r in rows if r["mean_abs_shap"] < self.threshold}


class Elimination(Selector):
    """Recursive elimination: the weakest feature goes while the cross-validated AUC of the rest is not lower by more than ``slack``."""

    name = "rfe"

    def __init__(self, keep: int | None = None, folds: int = 3, slack: float = 0.0, algorithm: str = "logistic", key: str | None = None) -> None:
        self.keep, self.folds, self.slack, self.algorithm, self.key = keep, folds, slack, algorithm, key

    def removed(self, df, columns, target):
        from basalt.models.explain import shap_table
        from basalt.models.factory import cross_validated

        left, gone = list(columns), {}
        best = cross_validated(df, left, target, self.algorithm, self.folds, self.key) if self.keep is None else 0.0
        while len(left) > max(1, self.keep or 1):
            weakest = min(shap_table(df, left, target, self.algorithm).collect(), key=lambda r: (r["mean_abs_shap"], r["feature"]))["feature"]
            rest = [c for c in left if c != weakest]
            if self.keep is None:
                now = cross_validated(df, rest, target, self.algorithm, self.folds, self.key)
                if now < best - self.slack:
                    break
                best = max(best, now)
            gone[weakest] = f"eliminated at {len(left)} features"
            left = rest
        return gone


def null_rate(limit: float = S.MAX_NULL_RATE) -> Selector:
    return Flag("null_rate", "drop_null", "null rate {null_rate} above " + str(limit), max_null=limit)


def constant(share: float = S.QUASI_CONSTANT) -> Selector:
    return Flag("constant", "drop_constant", f"one value in {share} or more of the rows", quasi=share)


def cardinality(most: int = S.HIGH_CARDINALITY) -> Selector:
    return Flag("cardinality", "drop_cardinality", "{n_unique} values", most=most)


#: The default chain, and that of runs.
DEFAULT: tuple[Callable[[], Selector], ...] = (constant, cardinality, Correlation, LowInformation)
RUN: tuple[Callable[[], Selector], ...] = (null_rate, *DEFAULT)


class Selection:
    """Selectors one after the other, each on what those before left."""

    def __init__(self, selectors: list[Selector] | None = None) -> None:
        self.selectors = selectors if selectors is not None else [make() for make in DEFAULT]
        self.columns: list[str] = []
        self.kept: list[str] = []
        self.log: list[tuple[str, str, str]] = []

    def fit(self, df: DataFrame, columns: list[str], target: str | None = None) -> Selection:
        self.columns, self.kept, self.log = list(columns), list(columns), []
        flags = [s for s in self.selectors if isinstance(s, Flag)]
        # values are counted once for all flags; one row a column
        shares = df.sparkSession.createDataFrame(_shares(df, self.columns).collect(), "feature string, nulls double, share double, kinds long") if len(flags) > 1 and self.columns else None
        for s in flags:
            s.shares = shares
        for s in self.selectors:
            gone = s.removed(df, self.kept, target) if self.kept else {}
            self.log += [(c, s.name, gone[c]) for c in self.kept if c in gone]
            self.kept = [c for c in self.kept if c not in gone]
        for s in flags:
            s.shares = None
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """df without the removed features; features that df lacks are no error."""
        return df.drop(*[c for c in self.columns if c not in self.kept])

    def audit(self, df: DataFrame) -> DataFrame:
        """(feature, removed_by, reason, original_position)."""
        by = {c: (name, reason) for c, name, reason in self.log}
        rows = [(c, *by.get(c, ("kept", "")), i) for i, c in enumerate(self.columns)]
        return df.sparkSession.createDataFrame(rows, "feature string, removed_by string, reason string, original_position int")

    def waterfall(self, df: DataFrame) -> DataFrame:
        """(step, selector, removed, remaining), step 0 being the start."""
        rows, left = [(0, "start", 0, len(self.columns))], len(self.columns)
        for i, s in enumerate(self.selectors):
            n = sum(name == s.name for _, name, _ in self.log)
            left -= n
            rows.append((i + 1, s.name, n, left))
        return df.sparkSession.createDataFrame(rows, "step int, selector string, removed int, remaining int")


def audit(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(feature, removed_by, original_position) of the chain constant, cardinality, correlation, IV."""
    return Selection().fit(df, columns, target).audit(df).select("feature", "removed_by", "original_position")


def numeric_alerts(summary: DataFrame) -> DataFrame:
    """(feature, alert) from a numeric summary, in one projection."""
    rules = {
        "HIGH_MISSING": F.col("missing_pct") > S.HIGH_MISSING, "CONSTANT": F.col("constant_flag"), "NEAR_ZERO_VARIANCE": F.col("near_zero_variance_flag") & ~F.col("constant_flag"),
        "SKEWED": F.abs("skewness") > S.SKEW_ALERT, "ZEROS": F.col("zero_pct") > S.ZEROS_ALERT,
    }
    named = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))
    return summary.select("feature", F.explode(named).alias("alert"))
