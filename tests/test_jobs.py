import json
import os

import pytest
import yaml
from pyspark.sql import functions as F

from basalt.jobs import report, service
from basalt.jobs.bundle import Bundle, monitor_job, score_job
from basalt.jobs.run import Config, Run, run
from basalt.models.factory import Model
from basalt.operators import explore as E
from basalt.operators import select as C
from basalt.operators import split as L
from basalt.operators.features import registry, reshape
from basalt.operators.stages import FeaturePipeline, Recipes, recommend_recipes
from basalt.sources import readers
from basalt.sources.synthetic import generate


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("data") / "t.parquet")
    generate(spark, 600, numeric=4, categorical=5).write.parquet(path)
    return path


@pytest.fixture(scope="module")
def table(spark, made):
    return spark.read.parquet(made)


def test_generator(spark, table):
    r = table.agg(F.count("*").alias("n"), F.avg(F.col("num_1_high_null").isNull().cast("int")).alias("gone"), F.countDistinct("num_3_constant").alias("one"), F.variance("num_2_low_variance").alias("v"), F.countDistinct("cat_2_high_card").alias("many"), F.countDistinct("cat_1_single").alias("single"), F.corr("num_0_normal", "target").alias("r")).first()
    assert r["n"] == 600 and 0.5 < r["gone"] < 0.7 and r["one"] == r["single"] == 1 and r["v"] < 1e-6 and r["many"] > 100 and r["r"] > 0.3
    assert sorted(generate(spark, 600, 4, 5).repartition(3).collect(), key=lambda x: x["id"]) == sorted(table.collect(), key=lambda x: x["id"])


def test_alerts_of_made_up_faults(table):
    numeric = [c for c in table.columns if c.startswith("num")]
    found = {(r["feature"], r["type"]) for r in E.alerts(table, numeric, [c for c in table.columns if c.startswith("cat")], "target").collect()}
    assert {("num_1_high_null", "HIGH_MISSING"), ("num_3_constant", "CONSTANT"), ("num_2_low_variance", "NEAR_ZERO_VARIANCE"), ("cat_2_high_card", "HIGH_CARDINALITY"), ("cat_1_single", "CONSTANT"), ("cat_3_dominant", "IMBALANCED"), ("cat_4_high_null", "HIGH_MISSING")} <= found
    assert {t for _, t in found} <= set(E.ALERTS) and ("num_0_normal", "LOW_IV") not in found
    drops = {r["feature"]: r["reasons"] for r in E.recommended_drops(table, numeric, [], "target").collect()}
    assert "constant" in drops["num_3_constant"] and "near_zero_variance" in drops["num_2_low_variance"]
    flags = {(r["flag"], r["feature"]) for r in E.flagged(table, numeric, [], "target").collect()}
    assert ("high_missing", "num_1_high_null") in flags and E.interactions(table, numeric, "target")[0] == "num_0_normal"


def test_selection_chain(table):
    numeric = [c for c in table.columns if c.startswith("num")]
    cat = [c for c in table.columns if c.startswith("cat")]
    s = C.Selection([C.null_rate(0.5), C.constant(), C.cardinality(), C.Correlation(), C.LowInformation()]).fit(table, numeric + cat, "target")
    by = {r["feature"]: r["removed_by"] for r in s.audit(table).collect()}
    assert by["num_1_high_null"] == by["cat_4_high_null"] == "null_rate" and by["num_3_constant"] == by["cat_1_single"] == by["cat_3_dominant"] == "constant" and by["cat_2_high_card"] == "cardinality" and by["num_0_normal"] == "kept"
    fall = s.waterfall(table).orderBy("step").collect()
    assert fall[0]["remaining"] == 9 and fall[-1]["remaining"] == len(s.kept) and set(s.transform(table).columns) >= set(s.kept)
    copy = table.withColumn("twin", F.col("num_0_normal") * 2)
    assert "num_0_normal" in C.Correlation(iv={"num_0_normal": 0.1, "twin": 0.5}).removed(copy, ["num_0_normal", "twin"], None)
    assert "num_0_normal" in C.Correlation().removed(copy, ["num_0_normal", "twin"], None)


def test_model_based_selectors(table):
    d = table.select("num_0_normal", (F.col("num_2_low_variance") * 1000).alias("b"), "target", "id")
    assert C.LowShap(0.3).removed(d, ["num_0_normal", "b"], "target").keys() == {"b"} and C.LowShap().removed(d, ["num_0_normal", "b"], "target") == {}
    assert set(C.Elimination(keep=1).removed(d, ["num_0_normal", "b"], "target")) == {"b"}


def test_feature_pipeline(spark, table):
    d = table.withColumn("seen_date", F.concat(F.lit("2024-01-"), F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0"))).withColumn("update_count", F.col("id") % 7)
    train, other = d.where("id < 400"), d.where("id >= 400")
    p = FeaturePipeline("target", keep=["id"]).fit(train)
    out = p.transform(other)
    assert out.count() == 200 and all(t in ("int", "bigint", "double") for _, t in out.dtypes) and not {"seen_date", "cat_0_normal"} & set(out.columns)
    assert {"seen_date_month", "cat_0_normal_woe", "cat_2_high_card_target", "num_1_high_null_was_missing", "update_count"} <= set(out.columns)
    assert out.select(*[F.count_if(F.col(c).isNull()).alias(c) for c in out.columns]).first() == tuple([0] * len(out.columns))
    steps = [r["step"] for r in p.audit(d).where("column = 'num_0_normal'").orderBy("position").collect()]
    assert steps == ["input", "winsorise", "impute", "scale_robust"]
    back = p.inverse(out).select("id", "num_0_normal").join(other.select("id", F.col("num_0_normal").alias("x")), "id")
    lo, hi = train.agg(F.percentile("num_0_normal", F.lit(0.01)), F.percentile("num_0_normal", F.lit(0.99))).first()
    assert all(abs(r["num_0_normal"] - min(max(r["x"], lo), hi)) < 1e-9 for r in back.collect())
    leak = train.withColumn("gives_away", F.col("target") + 0.001 * F.col("num_0_normal"))
    with pytest.raises(ValueError, match="gives_away"):
        FeaturePipeline("target", keep=["id"]).fit(leak)
    with pytest.raises(ValueError):
        FeaturePipeline("target", encoder="none such")


def test_recipes(table):
    found = recommend_recipes(table, ["num_1_high_null", "num_3_constant", "cat_0_normal", "cat_2_high_card"])
    assert found["num_1_high_null"][0][0] == "impute" and found["num_3_constant"] == [] and found["cat_0_normal"][-1][0] == "onehot_encode" and [s for s, _ in found["cat_2_high_card"]] == ["rare_group", "target_encode"]
    out = Recipes({"num_1_high_null": [("impute", {}), ("scale", {"strategy": "minmax"})], "cat_0_normal": [("onehot_encode", {})]}, "target").fit(table).transform(table)
    lo, hi = out.agg(F.min("num_1_high_null"), F.max("num_1_high_null")).first()
    assert (lo, hi) == (0.0, 1.0) and "cat_0_normal_level_0" in out.columns and "cat_0_normal" not in out.columns and "cat_2_high_card" in out.columns
    with pytest.raises(ValueError):
        Recipes({"no such": []}).fit(table)


def test_shapes_with_overrides(spark):
    d = spark.createDataFrame([(1.0, 4.0), (2.0, 9.0), (None, None)], "a double, b double")
    assert [r["b"] for r in reshape(d, ["a", "b"], "log", {"b": "sqrt"})(d).collect()] == [2.0, 3.0, None]
    with pytest.raises(ValueError):
        reshape(spark.createDataFrame([(0.0,)], "a double"), ["a"], "reciprocal")
    for name in ("impute", "clip_lower", "clip_iqr", "log1p", "yeo_johnson", "quantile_normal", "bucket_uniform", "bucket_kmeans", "dense_rank", "scale", "polynomial", "spline"):
        assert registry(name, "a")(d)(d).count() == 3


def test_splits(spark, table):
    s = L.stratified_split(table, "id", "target")
    rates = {r["split"]: r["rate"] for r in L.class_gap(s, "target").collect()}
    assert max(rates.values()) - min(rates.values()) < 0.03 and L.stratified_split(table, "id", "num_0_normal").groupBy("split").count().count() == 3
    L.validate(s, "target")
    with pytest.raises(ValueError, match="train"):
        L.validate(s.where("split <> 'train'"), "target")
    with pytest.raises(ValueError, match="out of time"):
        L.validate(s.withColumn("split", F.when(F.col("id") < 10, "oot").otherwise(F.col("split"))), "target")
    g = L.grouped_split(table.withColumn("g", F.col("id") % 10), "g", test_groups=[1, 2], key="id", target="target")
    assert {r["g"] for r in g.where("split = 'test'").select("g").distinct().collect()} == {1, 2} and g.count() == 600 and g.where("split = 'val'").count() in range(46, 50)
    with pytest.raises(ValueError):
        L.grouped_split(table.withColumn("g", F.col("id") % 10), "g", test_groups=[77], key="id")
    with pytest.raises(ValueError):
        L.validate_roles({"a": "train"}, ["a", "b"])
    L.check_binary(table, "target")
    for wrong in ("id", "num_3_constant", "no such"):
        with pytest.raises(ValueError):
            L.check_binary(table, wrong)
    assert L.relabel(table, "cat_0_normal", "level_0").agg(F.sum("target")).first()[0] == table.where("cat_0_normal = 'level_0'").count()


def test_readers_and_writers(spark, made, tmp_path):
    assert readers.load_row_groups(spark, made, 50).count() == 50 and readers.load_row_groups(spark, made, 10_000).count() == 600
    spark.range(0, 4000, 1, 8).write.option("parquet.block.size", 1024).parquet(str(tmp_path / "g"))
    some = readers.load_row_groups(spark, str(tmp_path / "g"), 700)
    assert some.count() == 700 and some.distinct().count() == 700
    (tmp_path / "d.csv").write_text("a,a,b\n1,2,3\n")
    assert readers.repeated_columns(spark, str(tmp_path / "d.csv")) == {"a": [0, 1]}
    assert readers.restrict(spark.read.parquet(made), allow=["num_0_normal"], always=["id"]).columns == ["id", "num_0_normal"]
    with pytest.raises(ValueError):
        readers.restrict(spark.read.parquet(made), deny=["no such"])
    readers.write(spark.range(3), str(tmp_path / "o"), "csv")
    assert readers.load(spark, str(tmp_path / "o"), "csv").count() == 3
    for columns, rows in ((["x"], 3), (["id"], 0)):
        with pytest.raises(ValueError):
            readers.require(spark.range(rows), columns)
    assert readers.profile_and_sample(spark, made, str(tmp_path / "p"), rows=100).count() <= 100 and set(os.listdir(tmp_path / "p")) == {"profile.html", "profile.json"}


def test_bundle(spark, table, tmp_path):
    d = L.random_split(table, "id")
    train = d.where("split = 'train'").drop("split")
    p = FeaturePipeline("target", keep=["id"]).fit(train)
    b = Bundle(Model("logistic", p.outputs, "target").fit(p.transform(train)), p.transform, None, ["id"]).freeze(train)
    b.save(str(tmp_path / "b"))
    loaded = Bundle.load(str(tmp_path / "b"))
    rest = d.where("split = 'test'").drop("split", "target")
    assert sorted(loaded.predict(rest).collect()) == sorted(b.predict(rest).collect()) and loaded.predict(rest).columns == ["id", "prediction", "probability"]
    one = rest.where("num_1_high_null is not null and cat_4_high_null is not null").first().asDict()
    assert loaded.predict_one(spark, one)["id"] == one["id"]
    with pytest.raises(ValueError, match="missing"):
        loaded.predict(rest.drop("num_0_normal"))
    with pytest.raises(ValueError, match="another kind"):
        loaded.predict(rest.withColumn("num_0_normal", F.lit("x")))
    with pytest.raises(ValueError, match="no rows"):
        loaded.predict(rest.limit(0))
    moved = rest.withColumn("num_0_normal", F.col("num_0_normal") + 3)
    assert loaded.drift(moved).first()["psi"] > 0.25 > loaded.drift(train).first()["psi"]
    top = loaded.feature_drift(moved).first()
    assert top["feature"] == "num_0_normal" and top["flag"]
    rest.write.parquet(str(tmp_path / "in"))
    score_job(spark, loaded, str(tmp_path / "in"), str(tmp_path / "out"), drift=str(tmp_path / "drift"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == rest.count() and spark.read.csv(str(tmp_path / "drift"), header=True).count() > 1
    scored, actuals = loaded.predict(rest), d.select("id", "target").where("id % 2 = 0")
    out = monitor_job(scored, actuals, ["id"], "probability", "target", raw=rest, bundle=loaded, folder=str(tmp_path / "m"))
    values = {r["metric"]: r["value"] for r in out["performance"].collect()}
    assert values["auc"] > 0.6 and values["n_rows"] == rest.where("id % 2 = 0").count() and out["feature_drift"].count() > 0 and sorted(os.listdir(tmp_path / "m")) == ["feature_drift", "performance", "unmatched"]
    with pytest.raises(ValueError):
        monitor_job(scored, actuals.limit(0), ["id"], "probability", "target")


def test_run_from_yaml(spark, made, tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text(yaml.safe_dump({"source": made, "key": "id", "target": "target", "scaler": "none", "leaderboard": ["logistic", "lda"], "trials": 2, "imbalance": "weights", "explain": True, "split": {"strategy": "stratified"}, "folder": str(tmp_path / "runs"), "deny": ["cat_2_high_card"]}))
    r = run(spark, str(path))
    folder = r.results["folder"]
    assert {"config.yaml", "run.log", "tracking.jsonl", "bundle", "card.json", "card.html", "shap", "deviations.json"} <= set(os.listdir(folder))
    card = json.load(open(os.path.join(folder, "card.json")))
    assert {"performance_metrics", "decile_table", "leaderboard", "tuning", "governance", "limitations"} <= set(card) and card["governance"]["verdict"]
    assert "scaler" in {d["setting"] for d in json.load(open(os.path.join(folder, "deviations.json")))}
    kinds = [json.loads(x)["kind"] for x in open(os.path.join(folder, "tracking.jsonl"))]
    assert kinds[0] == "start" and kinds[-1] == "end"
    assert Config.read(os.path.join(folder, "config.yaml")).scaler in ("none", "standard")
    for wrong in ({"no": 1}, {"source": "x"}, {"source": "x", "key": "k", "target": "t", "algorithm": "none"}):
        with pytest.raises(ValueError):
            Config.of(wrong)


def test_regression_run(spark, made, tmp_path):
    c = Config.of({"source": made, "key": "id", "target": "num_0_normal", "task": "regression", "algorithm": "linear", "folder": str(tmp_path), "deny": ["cat_2_high_card"]})
    r = Run(c).start(spark)
    assert {m for s, m, _ in r.results["metrics"] if s == "test"} >= {"rmse", "mae", "r2"}


def test_reports(spark, table, tmp_path):
    tables = report.profile_html(table.drop("id"), str(tmp_path / "p.html"), "target")
    assert {"overview", "numeric", "categorical", "alerts", "iv", "drops", "text"} <= set(tables) and "<svg" in (tmp_path / "p.html").read_text()
    assert report.run_folder(str(tmp_path), "a").endswith(tuple("0123456789")) and report.run_folder(str(tmp_path), "b") != report.run_folder(str(tmp_path), "b")
    assert report.crosstabs(table, [("cat_0_normal", "cat_3_dominant")], str(tmp_path))[0].endswith("cat_0_normal__cat_3_dominant")
    per = report.profiles_by_split(L.random_split(table, "id"), ["num_0_normal"])
    assert per.count() == 3


def test_findings(spark, table):
    import numpy as np

    x = np.array([r[0] for r in table.select("num_0_normal").collect()])
    hist, curve = E.density(table, "num_0_normal")
    rows = curve.collect()
    h = x.std(ddof=1) * len(x) ** -0.2
    want = [np.exp(-0.5 * ((r["x"] - x) / h) ** 2).mean() / (h * np.sqrt(2 * np.pi)) for r in rows]
    assert np.allclose([r["density"] for r in rows], want, rtol=0.01, atol=1e-3)
    assert abs(sum(r["density"] * (r["hi"] - r["lo"]) for r in hist.collect()) - 1) < 1e-9 and E.density(table, "num_0_normal", trim=True)[0].agg(F.max("hi")).first()[0] < x.max()
    text = spark.createDataFrame([("Ab ab",), ("é1",), (None,)], "t string")
    got = {(r["kind"], r["key"]): r["n"] for r in E.text_analysis(text, ["t"]).collect()}
    assert got["word", "ab"] == 2 and got["char", "b"] == 2 and got["category", "Ll"] == 4 and got["category", "Lu"] == got["category", "Nd"] == 1 and got["mean_length", ""] == 3.5
    line = spark.createDataFrame([(float(i), 2.0 * i + 1, float(i * i)) for i in range(50)], "x double, y double, z double")
    assert all(abs(r["y"] - 2 * r["x"] - 1) < 1e-6 for r in E.trend_lines(line, "y", "x").collect())
    assert all(abs(r["y"] - r["x"] ** 2) < 1e-4 for r in E.trend_lines(line, "z", "x", "poly").collect())
    assert all(abs(r["y"] - 2 * r["x"] - 1) < 1e-6 for r in E.trend_lines(line, "y", "x", "loess").collect())
    twins = table.select("num_0_normal", (F.col("num_2_low_variance") * 1.0).alias("b"), (F.col("num_0_normal") * 3).alias("c"))
    order = E.correlation_order(twins, ["num_0_normal", "b", "c"])
    assert abs(order.index("num_0_normal") - order.index("c")) == 1
    assert E.chart_style(table, "num_0_normal", "cat_0_normal") == "box" and E.duplicate_rows(spark.createDataFrame([(1,), (1,), (2,)], "a int")).collect() == [(1, 2)]


def test_service(spark, made, tmp_path):
    s = service.Session(spark, os.path.dirname(made))
    with pytest.raises(ValueError):
        s.preview_load("../../etc/passwd")
    with pytest.raises(ValueError, match="first"):
        s.preview_target("target")
    assert s.preview_load("t.parquet")["columns"]["target"] == "int" and s.confirm_load("t.parquet")["rows"] == 600
    if s.preview_target("target")["problems"]:
        s.state["load"]["df"] = s.state["load"]["df"].withColumn("target", 1 - F.col("target"))
    s.confirm_target("target", "id")
    assert s.preview_split()["train"]["rows"] and s.confirm_split("stratified")["test"]["rows"]
    s.confirm_explore(["cat_2_high_card"])
    assert s.column_chart("num_0_normal")["kind"] == "histogram" and s.column_chart("cat_0_normal")["kind"] == "bars"
    s.confirm_features()
    assert s.confirm_selection()["kept"] and "share" in s.preview_imbalance() and s.confirm_imbalance("weights")
    s.train("logistic")
    assert s.evaluate()["verdict"] in ("ready", "needs_review", "not_ready") and s.calibrate()["split"] == "val" and s.explain()
    number = s.start(lambda: s.leaderboard(["lda"]))
    import time

    for _ in range(600):
        if s.poll(number)["status"] != "running":
            break
        time.sleep(0.2)
    assert s.poll(number)["status"] == "done" and s.poll(s.start(lambda: 1 / 0)).keys()
    s.confirm_split()
    assert "features" not in s.state and "train" not in s.state
    service.authorise("a", "a")
    for given, wanted in (("a", "b"), (None, "b"), ("a", None)):
        with pytest.raises(service.Denied):
            service.authorise(given, wanted)
    assert "num_1_high_null" in service.analyze_dataset(spark, made, "target")["red_flags"]
    flat = str(tmp_path / "flat.parquet")
    spark.read.parquet(made).select("id", "num_0_normal", "num_2_low_variance", "target").write.parquet(flat)
    assert service.check_model_readiness(spark, flat, "target", "id")["verdict"] and service.explain_model(spark, flat, "target", "id")[0]["feature"] == "num_0_normal"
    assert service.train_and_compare_models(spark, flat, "target", "id", ["lda"])[0]["algorithm"] == "lda" and os.path.exists(service.generate_report(spark, flat, "target", str(tmp_path / "card"), "id")["html"])
