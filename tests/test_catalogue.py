import math

import duckdb
import pytest

from basalt.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def key(row):
    return tuple("~" if v is None else f"{float(v):.4f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in row)


def same(a, b):
    if isinstance(a, bool) or isinstance(b, bool) or not isinstance(a, (int, float)):
        return str(a) == str(b) or a == b
    return b is not None and math.isclose(float(a), float(b), rel_tol=1e-9, abs_tol=2e-6)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    ours = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    o = duck.sql(catalogue.ORACLE_SQL[name])
    at = [o.columns.index(c) for c in columns]
    assert sorted(o.columns) == columns
    theirs = sorted((tuple(float(v) if type(v).__name__ == "Decimal" else v for v in (r[i] for i in at)) for r in o.fetchall()), key=key)
    assert len(ours) == len(theirs)
    assert all(same(x, y) for a, b in zip(ours, theirs, strict=True) for x, y in zip(a, b, strict=True))


def test_shapes_by_their_properties(spark, sf):
    rows = catalogue.QUERIES["spline"](spark, sf).collect()
    known = [r for r in rows if r["gap_sp_0"] is not None]
    assert len(known) < len(rows) and all(-1e-9 <= sum(r[f"gap_sp_{k}"] for k in range(6)) <= 1 + 1e-5 for r in known)
    z = [r["gap"] for r in catalogue.QUERIES["quantile_normal"](spark, sf).collect() if r["gap"] is not None]
    assert abs(sum(z) / len(z)) < 0.02 and abs(sum(x * x for x in z) / len(z) - 1) < 0.05
    p = catalogue.QUERIES["pca"](spark, sf).collect()
    assert abs(sum(r["pc1"] * r["pc2"] for r in p)) / len(p) < 1e-3 and sum(r["pc1"] ** 2 for r in p) >= sum(r["pc2"] ** 2 for r in p)


def test_chained_imputation_recovers_a_plane(spark):
    from basalt.operators.shape import impute_iterative

    rows = [(float(i), float(i * i % 17), 3.0 * i - 2.0 * (i * i % 17) + 1) for i in range(200)]
    gone = [(a, None if i % 9 == 0 else b, None if i % 7 == 0 and i % 9 else c, None) for i, (a, b, c) in enumerate(rows)]
    d = spark.createDataFrame(gone, "a double, b double, c double, d double")
    got = {r["a"]: r for r in impute_iterative(d, ["a", "b", "c", "d"])(d).collect()}
    assert all(abs(got[a]["b"] - b) < 0.01 and abs(got[a]["c"] - c) < 0.05 and got[a]["d"] is None for a, b, c in rows)


def test_tree_bins_part_the_classes(spark, sf):
    from basalt.operators.learn import tree_edges

    d = spark.createDataFrame([(float(i), int(i >= 60), i / 3) for i in range(100)] + [(None, 1, 0.0)], "a double, y int, z double")
    edges = tree_edges(d, "a", "y")
    assert (edges[0], edges[-1]) == (-1.0, 100.0) and any(59 <= e < 60 for e in edges)
    assert len(tree_edges(d, "a", "z")) > 3 and tree_edges(d.limit(0), "a", "y") == []
    bins = {}
    for r in catalogue.QUERIES["bin_tree"](spark, sf).collect():
        bins.setdefault(r["l_extendedprice_bin"], []).append(r["l_extendedprice"])
    assert len(bins) >= 2 and all(max(bins[k]) <= min(bins[k + 1]) for k in range(max(bins)))


def test_permutation_importance_ranks_the_cause_first(spark, sf):
    r = catalogue.QUERIES["permutation_importance"](spark, sf).collect()
    assert r[0]["feature"] == "o_totalprice" and r[0]["importance"] > 0.2 > abs(r[1]["importance"])


def test_unknown_stage():
    from basalt.operators.features import registry

    with pytest.raises(KeyError):
        registry("no_such_stage", "a")


def test_vif_and_pca(spark, sf):
    v = catalogue.QUERIES["vif"](spark, sf).collect()
    assert all(r["vif"] >= 1 for r in v)
    p = catalogue.QUERIES["pca_variance"](spark, sf).collect()
    assert abs(sum(r["ratio"] for r in p) - 1) < 1e-9


def test_readers(spark, tmp_path):
    from basalt.sources import readers

    spark.range(100).withColumnRenamed("id", "a").write.parquet(str(tmp_path / "x.parquet"))
    assert readers.load(spark, str(tmp_path / "x.parquet"), rows=10).count() <= 10
    with pytest.raises(RuntimeError):
        readers.load(spark, str(tmp_path / "none.parquet"))
    (tmp_path / "d.csv").write_text("a,a,b\n1,2,3\n")
    assert readers.load_csv_resolving(spark, str(tmp_path / "d.csv"), {1: "rename:c"}).columns == ["a", "c", "b"]


def test_quantiles_in_ranges(spark):
    """Cut into ranges of a few values, quantiles are those of numpy; nulls, ties, NaN and empty features included."""
    import numpy as np

    from basalt.operators.order import column_quantiles, quantiles

    draw = np.random.default_rng(0)
    rows = [("a", float(x)) for x in draw.normal(size=700)] + [("b", float(x)) for x in draw.integers(0, 5, 300)] + [("c", None), ("b", None), ("d", 7.0), ("d", float("nan"))]
    cells, levels = spark.createDataFrame(rows, "feature string, value double"), [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
    for part_rows in (20, 10**6):
        got = {r["feature"]: r["q"] for r in quantiles(cells, levels, part_rows).collect()}
        assert set(got) == {"a", "b", "d"}
        for f, q in got.items():
            assert np.allclose(q, np.quantile([v for k, v in rows if k == f and v is not None and v == v], levels), rtol=1e-12)
    assert column_quantiles(spark.createDataFrame([], "x double"), ["x"], [0.5]) == {}


def test_running_totals_in_ranges(spark):
    from basalt.operators.order import running

    for values, kind in ((range(0, 500, 3), "long"), ([f"k{i:03d}" for i in range(200)], "string")):
        d = spark.createDataFrame([(v, i % 4) for i, v in enumerate(values)], f"v {kind}, n long").repartition(7)
        got = sorted((r["v"], r["n_before"]) for r in running(d, "v", ["n"], part_rows=15).collect())
        assert got == [(v, sum(j % 4 for j in range(i))) for i, v in enumerate(values)]


def test_ranks_of_values_that_train_lacks(spark):
    from basalt.operators.features import rank_on_train

    train = spark.createDataFrame([(float(x),) for x in (1, 2, 2, 3, 4, 5)] + [(None,)], "x double")
    new = spark.createDataFrame([(x,) for x in (0.5, 1.0, 2.0, 2.5, 5.0, 10.0, 10.0, None)], "x double")
    want = {"percentile": [0, 0, 1 / 6, 3 / 6, 5 / 6, 1, 1, None], "global": [0, 1, 3, 3, 6, 6, 6, None], "dense": [0, 0, 1, 2, 4, 5, 5, None]}
    for method, ranks in want.items():
        got = {r["x"]: r["x_rank"] for r in rank_on_train(train, "x", method)(new).collect()}
        assert all(got[x] == r or math.isclose(got[x], r) for x, r in zip((0.5, 1.0, 2.0, 2.5, 5.0, 10.0, 10.0, None), ranks, strict=True))


def test_numeric_weight_of_evidence_is_by_bin(spark):
    from basalt.operators.features import woe_encode

    d = spark.createDataFrame([(float(i), int(i % 10 < (2 if i < 50 else 8))) for i in range(100)], "x double, y int")
    got = {r["x"]: r["x_woe"] for r in woe_encode(d, "x", "y", bins=2)(d.unionByName(spark.createDataFrame([(24.5, 0), (-9.0, 0), (999.0, 0), (None, 0)], "x double, y int"))).collect()}
    low, high = math.log((10 / 50) / (40 / 50)), math.log((40 / 50) / (10 / 50))
    assert math.isclose(got[24.5], low) and math.isclose(got[-9.0], low) and math.isclose(got[999.0], high) and got[None] == 0


def test_vif_and_components_equal_numpy(spark, sf):
    import numpy as np

    rows = catalogue.lines(lambda t: spark.read.parquet(f"{sf}/{t}.parquet")).select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "price2").collect()
    x = np.array([list(r) for r in rows])
    got = {r["feature"]: r["vif"] for r in catalogue.QUERIES["vif"](spark, sf).collect()}
    for i, c in enumerate(("l_quantity", "l_extendedprice", "l_discount", "l_tax")):
        others = np.delete(x[:, :4], i, axis=1)
        rest = x[:, i] - others @ np.linalg.lstsq(others, x[:, i], rcond=None)[0]
        assert got[c] == round(float((x[:, i] ** 2).sum() / (rest**2).sum()), 2)
    z = (x - x.mean(0)) / x.std(0)
    values = np.sort(np.linalg.eigvalsh(z.T @ z / len(z)))[::-1]
    assert np.allclose([r["ratio"] for r in catalogue.QUERIES["pca_variance"](spark, sf).collect()], values / values.sum(), atol=1e-9)


def test_yeo_johnson_is_the_best_lambda(spark, sf):
    import numpy as np

    from basalt.operators.features import yeo_johnson_lambda

    x = np.random.default_rng(1).lognormal(size=400)
    lam = yeo_johnson_lambda(spark.createDataFrame([(float(v),) for v in x], "x double"), "x")

    def loss(g):
        y = np.log1p(x) if abs(g) < 1e-9 else ((x + 1) ** g - 1) / g
        return 0.5 * len(x) * math.log(y.var()) - (g - 1) * np.log1p(x).sum()

    assert all(loss(lam) <= loss(lam + d) + 1e-6 for d in (-0.05, -0.005, 0.005, 0.05))


def test_shapes_at_zero_are_those_of_sql(spark, duck):
    """log, log1p and reciprocal reach their limits where the queries' SQL does; the stages stay strict."""
    from basalt.operators.features import reshape

    rows = [(i, v) for i, v in enumerate((0.0, 2.5, -1.0, -3.0, None, float("nan")))]
    d = spark.createDataFrame(rows, "event_id int, value double")
    for name in ("log", "log1p", "reciprocal"):
        with pytest.raises(ValueError):
            reshape(d.where("value <= 0"), ["value"], name)(d)
        got = {r["event_id"]: r["value"] for r in catalogue.out(reshape(d, ["value"], name, strict=False)(d), "value").collect()}
        values = ", ".join(f"({i}, {'NULL' if v is None else repr(str(v))}::DOUBLE)" for i, v in rows)
        want = dict(duck.sql(catalogue.ORACLE_SQL[f"shape_{name}"].replace("FROM events", f"FROM (VALUES {values}) e(event_id, value)")).fetchall())
        assert all(str(got[i]) == str(want[i]) for i, _ in rows)


def _queried(spark, tmp_path, name, **tables):
    """A query over tables of its own, and the same by its SQL: rows as sorted texts."""
    c = duckdb.connect()
    for t, d in tables.items():
        d.write.parquet(str(tmp_path / f"{t}.parquet"))
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df, o = catalogue.QUERIES[name](spark, str(tmp_path)), c.sql(catalogue.ORACLE_SQL[name])
    columns = sorted(df.columns)
    return sorted(str([r[x] for x in columns]) for r in df.collect()), sorted(str([r[o.columns.index(x)] for x in columns]) for r in o.fetchall())


def _events(spark, values):
    return spark.createDataFrame([(i, i % 3, "view", v) for i, v in enumerate(values)], "event_id long, user_id long, event_type string, value double").selectExpr("*", "timestamp_ntz'2024-01-02 00:00:00' AS ts")


@pytest.mark.parametrize("name", ["shape_log", "shape_reciprocal", "scale_l2"])
def test_queries_of_events_without_value_equal_their_sql(spark, tmp_path, name):
    ours, theirs = _queried(spark, tmp_path, name, events=_events(spark, [0.0, 1.5, 0.0, 7.25, 3.0, 2.0, 9.5, 0.0]))
    assert ours == theirs and any("inf" in x or "nan" in x for x in ours)


def test_uniform_bins_end_at_the_greatest_value(spark, tmp_path):
    """lo + (hi - lo) * 5 / 5 may lie just below hi."""
    hi = next(h / 100 for h in range(40000, 90000) if 0.01 + (h / 100 - 0.01) * 5 / 5 < h / 100)
    ours, theirs = _queried(spark, tmp_path, "bin_uniform", events=_events(spark, [0.01, hi, hi / 2]))
    assert ours == theirs and "[1, 4]" in ours


def test_inflation_of_near_and_exact_copies(spark):
    """The inverse of one Gram matrix loses a copy that differs by little; exact copies are infinite."""
    from basalt.operators.relation import vif

    d = spark.range(0, 20000, 1, 4).selectExpr("CAST(900 + id * 7919 % 104729 AS DOUBLE) AS a", "(900 + id * 7919 % 104729) * 1.05D + id % 9 * 0.01D AS b", "CAST(id % 13 AS DOUBLE) AS c", "CAST(id % 13 AS DOUBLE) * 2 AS e")
    near = {r["feature"]: r for r in vif(d, ["a", "b", "c"]).collect()}
    assert near["a"]["high"] and near["b"]["high"] and not near["c"]["high"]
    x = [(r["a"], r["b"] - 1.05 * r["a"], r["c"]) for r in d.collect()]
    import numpy as np

    m = np.array(x)
    rest = m[:, 1] - m[:, [0, 2]] @ np.linalg.lstsq(m[:, [0, 2]], m[:, 1], rcond=None)[0]
    b = 1.05 * m[:, 0] + m[:, 1]
    assert math.isclose(near["b"]["vif"], (b**2).sum() / (rest**2).sum(), rel_tol=1e-3)
    copies = {r["feature"]: r for r in vif(d, ["a", "c", "e"]).collect()}
    assert copies["c"]["high"] and copies["e"]["high"] and not copies["a"]["high"]


def test_recommended_drops_follow_the_alerts(spark):
    from basalt.operators import explore as E

    d = spark.range(400).selectExpr("id % 2 AS y", "id % 2 * 5.0D + id % 7 AS good", "0.001D * (id % 3) AS near", "CAST(NULL AS DOUBLE) AS empty", "7 AS flat", "'a' AS one", "CAST(NULL AS STRING) AS none", "CAST(id % 3 AS STRING) AS three", "CAST(id % 2 AS STRING) AS tells")
    numeric, categorical = ["good", "near", "empty", "flat"], ["one", "none", "three", "tells"]
    want = {}
    for r in E.alerts(d, numeric, categorical, "y").collect():
        if r["type"] in ("CONSTANT", "NEAR_ZERO_VARIANCE", "LOW_IV"):
            want.setdefault(r["feature"], set()).add(r["type"].lower())
    got = {r["feature"]: r["reasons"] for r in E.recommended_drops(d, numeric, categorical, "y").collect()}
    assert got == {k: ",".join(sorted(v)) for k, v in want.items()} and "near" in got and "good" not in got


def test_imputation_by_patterns_equals_rounds(spark, monkeypatch):
    """Sums by pattern give what filling every row once a round gives; no round reads the rows again."""
    import random

    from basalt.operators import shape

    rng = random.Random(3)
    rows = []
    for i in range(600):
        a, b = rng.gauss(0, 1), rng.gauss(5, 2)
        x = [a, b, a + b + rng.gauss(0, 0.3), a - 2 * b + rng.gauss(0, 0.5)]
        rows.append((i, *[v if j == 0 or rng.random() > 0.2 else None for j, v in enumerate(x)]))
    d = spark.createDataFrame(rows, "i int, a double, b double, c double, e double")
    columns = ["a", "b", "c", "e"]

    def filled():
        return {r["i"]: [r[c] for c in columns] for r in shape.impute_iterative(d, columns)(d).collect()}

    monkeypatch.setattr(shape, "EXPRESSED", 0)
    monkeypatch.setattr(shape, "MOST_PATTERNS", 1)
    slow = filled()
    monkeypatch.undo()
    monkeypatch.setattr(shape, "checkpoint", lambda df: pytest.fail("rows are filled in a round"))
    fast = filled()
    assert all(math.isclose(x, y, rel_tol=1e-8, abs_tol=1e-8) for i in slow for x, y in zip(slow[i], fast[i], strict=True))


def test_values_are_counted_once_for_all_flags(spark, monkeypatch):
    from basalt.operators import select as C

    calls, shares = [], C._shares
    monkeypatch.setattr(C, "_shares", lambda df, columns: calls.append(columns) or shares(df, columns))
    d = spark.range(200).selectExpr("id AS k", "CAST(id % 2 AS DOUBLE) AS x", "1 AS flat", "CAST(id AS STRING) AS text", "id % 2 AS y")
    audit = {r["feature"]: r["removed_by"] for r in C.audit(d, ["x", "flat", "text"], "y").collect()}
    assert audit == {"x": "kept", "flat": "constant", "text": "cardinality"} and len(calls) == 1
    plan = C._shares(d.select("k", "x").where("k >= 0"), ["k", "x"])._jdf.queryExecution().optimizedPlan().toString()
    assert "as string" not in plan


def test_boards_measure_one_split(spark, monkeypatch):
    from basalt.models import factory
    from basalt.operators import metrics as M

    seen, regression = [], M.regression
    monkeypatch.setattr(M, "regression", lambda d, *a: seen.append(d.count()) or regression(d, *a))
    d = spark.range(300).selectExpr("CAST(id % 17 AS DOUBLE) AS x", "CAST(id % 17 * 2 + id % 3 AS DOUBLE) AS z", "CASE WHEN id % 5 = 0 THEN 'val' WHEN id % 5 = 1 THEN 'test' ELSE 'train' END AS split")
    board = factory.leaderboard(d, ["x"], "z", ["linear"], "regression").collect()
    assert seen == [60] and "psi" in board[0]["metrics"]


@pytest.mark.parametrize("part_rows", [30, 10**6])
def test_permuted_area_is_that_of_the_md5_orders(spark, monkeypatch, part_rows):
    """In ranges or not, the loss of AUC is that of rows paired by the two orders of the key's md5, also for scores near 1."""
    import hashlib

    from basalt.operators import learn

    class Sigmoid:
        def __init__(self, *a):
            pass

        fit = lambda self, d: self
        predict = lambda self, d: d.selectExpr("*", "1 / (1 + exp(-4 * a - b / 9)) AS score", "1 AS prediction")

    monkeypatch.setattr(learn, "Model", Sigmoid)
    monkeypatch.setattr(learn, "PART_ROWS", part_rows)
    rows = [(i, i * 37 % 41 / 4.0, float(i % 9), int(i * 37 % 41 + i % 7 > 22)) for i in range(300)]
    got = {r["feature"]: r["importance"] for r in learn.permutation_importance(spark.createDataFrame(rows, "k long, a double, b double, y int"), ["a", "b"], "y", "k", 2).collect()}

    def auc(xs):
        s = [(1 / (1 + math.exp(-4 * a - b / 9)), y) for a, b, y in xs]
        p, n = [v for v, y in s if y], [v for v, y in s if not y]
        return sum((u > v) + (u == v) / 2 for u in p for v in n) / len(p) / len(n)

    def order(seed):
        return sorted(rows, key=lambda r: (hashlib.md5(f"{r[0]}:{seed}".encode()).hexdigest(), r[0]))

    for j, f in enumerate("ab"):
        drops = []
        for r in range(2):
            pairs = zip(order(2 * r + 1), order(2 * r + 2), strict=True)
            drops.append(auc([(v[1] if j == 0 else u[1], v[2] if j == 1 else u[2], u[3]) for u, v in pairs]))
        assert abs(got[f] - (auc([x[1:] for x in rows]) - sum(drops) / 2)) < 2e-6
