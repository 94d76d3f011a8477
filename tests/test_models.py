import random
import threading
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from actilens.models import autoencoder as ae
from actilens.models import classifiers, isolation_forest, training
from actilens.models.isolation_forest import IsolationForest, average_path
from actilens.operators import features, metrics

NOW = datetime(2026, 3, 1)
AS_OF = "2026-03-01 00:00:00"


@pytest.fixture
def training_logs(make_logs):
    calm = [{"id": f"n{i}", "ts": NOW - timedelta(hours=i), "user_name": "user1", "description": "Normal login"} for i in range(50)]
    bad = [{"id": f"x{i}", "ts": NOW - timedelta(hours=i), "user_name": "attacker", "activity_type": "EXFILTRATION", "risk_level": "CRITICAL", "description": "Data exfiltration"} for i in range(5)]
    return make_logs(calm + bad)


def test_feature_frame_shape_and_scaling(training_logs):
    fitted = features.fit_features(training_logs, AS_OF)
    frame = fitted.transform(training_logs)
    assert frame.count() == 55 and set(features.FEATURES) <= set(frame.columns)
    stats = frame.agg(*[F.avg(c).alias(f"m_{c}") for c in features.SCALED], *[F.stddev_pop(c).alias(f"s_{c}") for c in features.SCALED]).first()
    for c in features.SCALED:
        # Both descriptions have two words: a constant column is centred and divided by 1.
        spread = 0 if c == "description_token_count" else 1
        assert stats[f"m_{c}"] == pytest.approx(0, abs=1e-9) and stats[f"s_{c}"] == pytest.approx(spread, abs=1e-9)
    codes = {r["user_name"]: r["user_encoded"] for r in frame.select("user_name", "user_encoded").distinct().collect()}
    assert codes == {"attacker": 0, "user1": 1}


def test_inference_without_description_and_unseen_values(training_logs, make_logs):
    fitted = features.fit_features(training_logs, AS_OF)
    new = make_logs([{"user_name": "stranger"}, {"user_name": None, "activity_type": None}]).drop("description")
    rows = fitted.transform(new).collect()
    assert len(rows) == 2 and all(r["user_encoded"] == 0 for r in rows)
    assert all(isinstance(r[c], (int, float)) for r in rows for c in features.FEATURES)


def test_artifacts_round_trip(training_logs, tmp_path, spark):
    assert features.FittedFeatures.load(spark, str(tmp_path / "none")) is None
    fitted = features.fit_features(training_logs, AS_OF)
    fitted.save(str(tmp_path / "f"))
    again = features.FittedFeatures.load(spark, str(tmp_path / "f"))
    a, b = (x.transform(training_logs).select("id", *features.FEATURES) for x in (fitted, again))
    assert a.exceptAll(b).isEmpty() and again.as_of == AS_OF


def test_balancing(make_logs):
    logs = make_logs([{"risk_level": "HIGH"}] * 10 + [{"risk_level": "LOW"}] * 100 + [{"risk_level": "MEDIUM"}] * 5)
    got = {r["label"]: r["n"] for r in features.balanced_training_set(logs).groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert got == {1: 10, 0: 30}
    with pytest.raises(features.TooFewRows):
        features.balanced_training_set(logs.limit(99))


@pytest.fixture(scope="module")
def blob(spark):
    rng = np.random.default_rng(0)
    rows = [(f"{i:04d}", *map(float, rng.normal(0, 1, 3))) for i in range(1500)] + [(f"out{i}", 9.0 + i, -9.0, 9.0) for i in range(5)]
    return spark.createDataFrame(rows, "id string, a double, b double, c double").cache()


def test_forest_finds_outliers(blob):
    forest = IsolationForest.fit(blob, ["a", "b", "c"], n_trees=60, contamination=0.05)
    out = forest.transform(blob).toPandas().set_index("id")
    assert (out.loc[[f"out{i}" for i in range(5)], "if_pred"] == -1).all()
    assert 0.03 < (out["if_pred"] == -1).mean() < 0.06
    sizes = forest.trees.filter("node = 0").select("tree", "size").collect()
    assert len(sizes) == 60 and all(r["size"] == 256 for r in sizes)


def test_forest_is_repeatable_and_saved(blob, spark, tmp_path):
    one = IsolationForest.fit(blob, ["a", "b", "c"], n_trees=10)
    two = IsolationForest.fit(blob.repartition(5), ["a", "b", "c"], n_trees=10)
    assert one.offset == pytest.approx(two.offset)
    one.save(str(tmp_path / "m"))
    again = IsolationForest.load(spark, str(tmp_path / "m"))
    diff = one.transform(blob).select("id", "if_score").join(again.transform(blob).select("id", F.col("if_score").alias("s")), "id")
    assert diff.filter(F.abs(F.col("if_score") - F.col("s")) > 1e-12).isEmpty()
    assert IsolationForest.load(spark, str(tmp_path / "none")) is None


def test_small_table_uses_all_rows(spark):
    df = spark.createDataFrame([(str(i), float(i % 7)) for i in range(40)], "id string, a double")
    forest = IsolationForest.fit(df, ["a"], n_trees=5, contamination=0.9)
    assert forest.sample_size == 40 and {r["size"] for r in forest.trees.filter("node = 0").collect()} == {40}


def test_average_path_values():
    assert list(average_path(np.array([0, 1, 2]))) == [0, 0, 1]
    assert average_path(256) == pytest.approx(10.244, abs=1e-3)


def test_explanations_add_up(blob):
    forest = IsolationForest.fit(blob, ["a", "b", "c"], n_trees=20)
    rows = forest.explain(blob.filter("id like 'out%' or id = '0001'")).collect()
    by_log = {}
    for r in rows:
        by_log.setdefault(r["log_id"], {})[r["feature"]] = r["contribution"]
    norm = float(average_path(256))
    root = np.mean([t["value"][0] for t in forest._packed])
    for parts in by_log.values():
        assert set(parts) == {"a", "b", "c", "__anomaly_score__", "__prediction__"}
        raw = forest.offset - parts["__anomaly_score__"]
        length = -np.log2(-raw) * norm
        assert parts["a"] + parts["b"] + parts["c"] == pytest.approx(length - root, abs=1e-6)
    assert by_log["out4"]["a"] < 0


def test_gradient_matches_differences():
    rng = np.random.default_rng(1)
    x, w = rng.normal(size=(8, 5)), ae._initial(5, 3)
    _, g = ae._gradient(w, x)
    for i in rng.choice(len(w), 25, replace=False):
        up, down = w.copy(), w.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        assert g[i] == pytest.approx((ae._gradient(up, x)[0] - ae._gradient(down, x)[0]) / 2e-6, abs=1e-5)


def test_autoencoder(blob, spark, tmp_path):
    model = ae.AutoEncoder.fit(blob, ["a", "b", "c"], epochs=4, batch_size=32, learning_rate=0.01)
    assert model.history[-1] < model.history[0]
    out = model.transform(blob)
    assert out.filter("ae_pred = -1").count() == pytest.approx(0.05 * 1505, abs=2)
    latent = model.with_latent(out)
    assert len(latent.first()["latent"]) == 4
    assert ae.latent_projection(latent).filter("pc1 is null").count() == 0
    model.save(spark, str(tmp_path / "ae"))
    again = ae.AutoEncoder.load(spark, str(tmp_path / "ae"))
    assert np.allclose(again.weights, model.weights) and again.threshold == model.threshold
    assert ae.AutoEncoder.load(spark, str(tmp_path / "none")) is None


def test_three_rows_give_three_labels(spark):
    df = spark.createDataFrame([tuple(float(i + j) for j in range(10)) for i in range(3)], ", ".join(f"f{j} double" for j in range(10)))
    model = ae.AutoEncoder.fit(df, df.columns, epochs=1)
    assert {r["ae_pred"] for r in model.transform(df).collect()} <= {-1, 1} and model.transform(df).count() == 3


def test_classifiers(spark):
    rng = random.Random(4)
    rows = [(i, rng.random(), rng.random()) for i in range(300)]
    df = spark.createDataFrame([(i, a, b, float(int(a * 3))) for i, a, b in rows], "id int, a double, b double, y double")
    boosted = classifiers.fit_boosted(df, ["a", "b"], "y", rounds=3)
    out = classifiers.apply_boosted(boosted, df, ["a", "b"])
    assert out.filter(F.col("xgb_pred") == F.col("y")).count() > 285
    assert out.filter(F.abs(F.aggregate("xgb_probabilities", F.lit(0.0), lambda x, y: x + y) - 1) > 1e-9).isEmpty()
    forest = classifiers.fit_random_forest(df, ["a", "b"], "y", trees=10)
    assert classifiers.apply_random_forest(forest, df, ["a", "b"]).filter(F.col("rf_pred") == F.col("y")).count() > 285
    ranked = metrics.ranked_importance(classifiers.importances(forest, ["a", "b"], spark)).collect()
    assert ranked[0]["feature"] == "a"


def test_train_all_and_predict(training_logs, spark, tmp_path):
    folder = str(tmp_path / "run")
    unfitted = training.AnomalyPredictor.load(spark, folder)
    assert {r["prediction"] for r in unfitted.transform(training_logs).collect()} == {1}
    config = training.TrainConfig(iforest_trees=20, autoencoder_epochs=2, boost_rounds=2)
    result = training.train_all(training_logs, folder, config, AS_OF)
    assert {r["model_name"] for r in result.reports.collect()} == {"isolation_forest", "autoencoder", "xgboost"}
    assert len(result.loss) == 2 and result.importance.count() >= 1
    out = training.AnomalyPredictor.load(spark, folder).transform(training_logs)
    assert {r["prediction"] for r in out.collect()} <= {-1, 1} and out.columns == [*training_logs.columns, "prediction"]


def preds(spark, rows):
    return spark.createDataFrame([("m", *r) for r in rows], "model_name string, y_true int, y_pred int, score double, latency_ms double")


def test_report_numbers(spark):
    p = preds(spark, [(0, 0, 0.1, 1.0), (1, 1, 0.9, 2.0), (0, 0, 0.4, 3.0), (1, 0, 0.4, 4.0)])
    r = metrics.overall_report(p).first()
    assert r["accuracy"] == 0.75 and r["precision"] == pytest.approx(5 / 6) and r["f1_score"] == pytest.approx((0.8 + 2 / 3) / 2)
    cm = {(c["y_true"], c["y_pred"]): c["n"] for c in metrics.confusion_matrix(p).collect()}
    assert cm == {(0, 0): 2, (0, 1): 0, (1, 0): 1, (1, 1): 1}
    assert metrics.roc_auc(p).first()["roc_auc"] == pytest.approx(0.875)
    assert metrics.latency_percentiles(p).first()["p50"] == 2.5
    first, last = metrics.roc_points(p).orderBy("fpr", "tpr").collect()[0], metrics.roc_points(p).orderBy("fpr", "tpr").collect()[-1]
    assert (first["threshold"], first["fpr"], first["tpr"]) == (None, 0.0, 0.0) and (last["fpr"], last["tpr"]) == (1.0, 1.0)


def test_one_class_is_reported(spark):
    r = metrics.roc_auc(preds(spark, [(1, 1, 0.5, 1.0), (1, 0, 0.2, 1.0)])).first()
    assert r["roc_auc"] is None and "Only one class" in r["roc_auc_error"]


def test_unpredicted_class_scores_zero(spark):
    r = {x["label"]: x for x in metrics.class_report(preds(spark, [(0, 0, 0.5, 1.0), (2, 0, 0.2, 1.0)])).collect()}
    assert (r[2]["precision"], r[2]["recall"], r[2]["f1_score"], r[2]["support"]) == (0.0, 0.0, 0.0, 1)


def test_calibration_edges(spark):
    got = {r["bin"]: r["fraction_positive"] for r in metrics.calibration(preds(spark, [(1, 1, 0.1, 1.0), (0, 1, 0.11, 1.0), (1, 1, 1.0, 1.0)])).collect()}
    assert got == {0: 1.0, 1: 0.0, 9: 1.0}


def test_recommendation_and_claims(spark):
    slow = spark.createDataFrame([("a", 3000.0)], "model_name string, avg_latency_ms double")
    assert metrics.recommended_model(slow, "base").first()["model_name"] == "base"
    two = spark.createDataFrame([("a", 1500.0), ("b", 900.0)], "model_name string, avg_latency_ms double")
    assert metrics.recommended_model(two, "base").first()["model_name"] == "b"
    reports = spark.createDataFrame([("hybrid", 0.95), ("random_forest", 0.85)], "model_name string, f1_score double")
    latency = spark.createDataFrame([("hybrid", 1.0), ("random_forest", 600.0)], "model_name string, p50 double")
    r = metrics.claim_check(reports, latency, ["random_forest", "hybrid"]).first()
    assert (r["model_name"], r["f1_passed"], r["latency_passed"]) == ("random_forest", False, False)


def test_hybrid_vote(spark):
    df = spark.createDataFrame([(-1, -1, 0), (-1, 1, 1), (-1, 1, 0), (1, 1, 1)], "if_pred int, ae_pred int, rf_pred int")
    assert [(r["hybrid"], r["both_unsupervised"]) for r in metrics.hybrid_vote(df).collect()] == [(1, 1), (1, 0), (0, 0), (0, 0)]


#: Path lengths down the stored tree table, level by level, and the score of each row.
STORED_FOREST_SQL = """
with recursive walk(id, x, tree, node, goes_on) as (
  select r.id, r.x, n.tree, n.node, n.feature >= 0 from points r cross join (select * from nodes where node = 0) n
  union all
  select w.id, w.x, w.tree, c.node, c.feature >= 0 from walk w join nodes p on p.tree = w.tree and p.node = w.node
  join nodes c on c.tree = w.tree and c.node = case when w.x[p.feature + 1] <= p.threshold then p."left" else p."right" end where w.goes_on),
leaves as (select id, n.depth + case when n.size <= 1 then 0 when n.size <= 2 then 1
    else 2 * (ln(n.size - 1) + 0.5772156649015329) - 2 * (n.size - 1) / n.size end as length
  from walk w join nodes n using (tree, node) where not w.goes_on)
select id, -pow(2, -sum(length) / (count(*) * {norm})) - {offset} from leaves group by id"""


def test_scores_follow_from_the_stored_trees(spark, tmp_path):
    import duckdb

    rng = np.random.default_rng(4)
    rows = [(f"{k:03d}", *map(float, rng.normal(0, 1 + 3 * (k % 17 == 0), 3))) for k in range(260)]
    df = spark.createDataFrame(rows, "id string, a double, b double, c double")
    IsolationForest.fit(df, ["a", "b", "c"], n_trees=25, max_samples=64).save(str(tmp_path))
    forest = IsolationForest.load(spark, str(tmp_path))
    scores = {r.id: r.if_score for r in forest.transform(df).collect()}
    joined = {r.id: r.joined_score for r in forest.joined_scores(df).collect()}
    con = duckdb.connect()
    con.execute(f"create view nodes as select * from read_parquet('{tmp_path}/trees/*.parquet')")
    con.execute("create table points(id varchar, x double[])")
    con.executemany("insert into points values (?, ?)", [(r[0], list(r[1:])) for r in rows])
    recomputed = dict(con.execute(STORED_FOREST_SQL.format(norm=float(average_path(forest.sample_size)), offset=forest.offset)).fetchall())
    assert scores.keys() == joined.keys() == recomputed.keys()
    for k, score in scores.items():
        assert joined[k] == pytest.approx(score, abs=1e-12) and recomputed[k] == pytest.approx(score, abs=1e-12)


def _all_subsets(nodes, x, features):
    """Shapley values by their definition: every coalition, each tree walked with the features of the coalition known."""
    from itertools import combinations
    from math import factorial

    def walk(node, known):
        n = nodes[node]
        if n.feature < 0:
            return n.depth + float(average_path(n.size))
        if n.feature in known:
            return walk(n.left if x[n.feature] <= n.threshold else n.right, known)
        return sum(nodes[c].size / n.size * walk(c, known) for c in (n.left, n.right))

    value = {frozenset(s): walk(0, s) for k in range(features + 1) for s in combinations(range(features), k)}
    weight = lambda s: factorial(len(s)) * factorial(features - len(s) - 1) / factorial(features)
    return [sum(weight(s) * (value[s | {i}] - v) for s, v in value.items() if i not in s) for i in range(features)]


@pytest.mark.parametrize("features", [1, 2, 6, 10])
def test_explanations_are_shapley_values(spark, features):
    rng = np.random.default_rng(features)
    names = [f"f{k}" for k in range(features)]
    points = rng.normal(size=(120, features)).round(1)
    df = spark.createDataFrame([(str(k), *map(float, p)) for k, p in enumerate(points)], "id string, " + ", ".join(f"{n} double" for n in names))
    forest = IsolationForest.fit(df, names, n_trees=4, max_samples=64)
    trees = {}
    for r in forest.trees.collect():
        trees.setdefault(r.tree, {})[r.node] = r
    found = {}
    for r in forest.explain(df.where("id in ('0', '7', '33')")).collect():
        found.setdefault(r.log_id, {})[r.feature] = r.contribution
    assert set(found) == {"0", "7", "33"}
    for log_id, parts in found.items():
        plain = np.mean([_all_subsets(nodes, points[int(log_id)], features) for nodes in trees.values()], axis=0)
        assert [parts[n] for n in names] == pytest.approx(plain, abs=1e-9)


def test_classes_fitted_side_by_side_have_the_trees_of_one_after_the_other(spark, monkeypatch):
    df = spark.range(200).selectExpr("cast(id % 7 as double) as a", "cast(id % 11 as double) as b", "cast(id % 3 as int) as y").repartition(3).localCheckpoint()
    asked, fit = [], classifiers.OneVsRest.fit
    monkeypatch.setattr(classifiers.OneVsRest, "fit", lambda self, data: asked.append(self.getParallelism()) or fit(self, data))
    trees = []
    for side in (1, classifiers.SIDE_BY_SIDE):
        monkeypatch.setattr(classifiers, "SIDE_BY_SIDE", side)
        fitted = classifiers.fit_boosted(df, ["a", "b"], "y", rounds=3).models
        trees.append([binary.toDebugString.split("\n", 1)[1] for binary in fitted])
    assert asked == [1, 4] and trees[0] == trees[1] and len(trees[0]) == 3


def test_fits_run_at_the_same_time(spark):
    """Each fit waits for the others to have begun; the results come in the order asked for."""
    begun = threading.Barrier(3, timeout=30)
    fits = [lambda k=k: (begun.wait(), spark.range(k).count())[1] for k in (3, 1, 2)]
    assert training.side_by_side(spark, *fits) == [3, 1, 2]


def test_an_epoch_of_the_auto_encoder_is_one_stage_and_averages_by_rows(spark):
    rng = np.random.default_rng(5)
    parts = [rng.normal(size=(n, 3)) for n in (40, 7)]
    rows = spark.createDataFrame(spark.sparkContext.parallelize([[list(map(float, r)) for r in p] for p in parts], 2).flatMap(lambda p: p), "a double, b double, c double")
    model, start = ae.AutoEncoder(["a", "b", "c"], ae._initial(3, 1)), ae._initial(3, 1)
    stages = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("one epoch", "one epoch")
    try:
        model._epoch(rows, 0.01, 8)
        jobs = stages.getJobIdsForGroup("one epoch")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [len(stages.getJobInfo(j).stageIds) for j in jobs] == [1]
    local = [ae._local_epoch(iter([pd.DataFrame(p)]), start, 0.01, 8) for p in parts]
    assert np.allclose(model.weights, sum(w * n for w, _, n in local) / 47, atol=1e-12)
    assert model.history == [pytest.approx(sum(loss for _, loss, _ in local) / 47)]


def _small_tree(features, n=200, seed=3):
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(n, features)).round(1)
    nodes = pd.DataFrame(isolation_forest._grow(points, rng, 8), columns=["feature", "threshold", "left", "right", "size", "depth", "value"])
    nodes.insert(0, "node", np.arange(len(nodes)))
    nodes.insert(0, "tree", 0)
    return isolation_forest._pack(nodes)[0], points


def test_outcomes_of_a_path_are_worked_out_once_and_not_for_each_row(monkeypatch):
    tree, points = _small_tree(6)
    asked, values = [], isolation_forest.LeafGroup.values
    monkeypatch.setattr(isolation_forest.LeafGroup, "values", lambda self, outcome: asked.append(len(outcome)) or values(self, outcome))
    found = {}
    for n, tabled in ((200, 10), (3000, 10), (3000, 2), (3000, 0)):
        monkeypatch.setattr(isolation_forest.LeafPaths, "TABLED", tabled)
        paths, total = isolation_forest.LeafPaths(tree, 6), np.zeros((n, 6))
        asked.clear()
        paths.add_shapley(np.resize(points, (n, 6)), total)
        found[n, tabled] = sum(asked), total
    assert found[200, 10][0] == found[3000, 10][0] == sum(2**g.k for g in paths.groups) < found[3000, 0][0]
    for total in (found[3000, 2][1], found[3000, 0][1]):
        assert np.allclose(total, found[3000, 10][1], atol=1e-12)
    assert np.allclose(found[3000, 10][1][:200], found[200, 10][1], atol=1e-12)


def test_rows_without_a_finite_value_are_explained_by_the_leaf_they_reach():
    tree, points = _small_tree(3)
    x = points[:6].copy()
    x[0, 0], x[1, 1], x[2, 2], x[3] = -np.inf, np.inf, np.nan, -np.inf
    total = np.zeros((6, 3))
    isolation_forest.LeafPaths(tree, 3).add_shapley(x, total)
    assert total.sum(axis=1) == pytest.approx(tree["length"][isolation_forest._leaf(tree, x)] - tree["value"][0], abs=1e-9)


def test_one_more_fit_runs_beside_those_of_train_all(training_logs, spark, tmp_path, monkeypatch):
    """It waits for the boosting to have begun and the boosting for it, and it gives the model it gives afterwards."""
    from actilens.plans import training_queries

    begun, boost = threading.Barrier(2, timeout=60), classifiers.fit_boosted
    forest = classifiers.fit_random_forest
    monkeypatch.setattr(classifiers, "fit_boosted", lambda *a, **k: (begun.wait(), boost(*a, **k))[1])
    monkeypatch.setattr(classifiers, "fit_random_forest", lambda *a: forest(*a, trees=4))
    config = training.TrainConfig(iforest_trees=5, autoencoder_epochs=1, boost_rounds=1)
    result = training.train_all(training_logs, str(tmp_path), config, AS_OF, lambda frame: (begun.wait(), training_queries._fit_attacks(frame))[1])
    after = training_queries._fit_attacks(spark.read.parquet(f"{tmp_path}/frame"))
    assert [t.toDebugString.split("\n", 1)[1] for t in result.beside.trees] == [t.toDebugString.split("\n", 1)[1] for t in after.trees]
    assert len(after.trees) == 4 and result.reports.count() == 3


def _mixed(spark, n=2500, parts=3):
    """Rows with ties, constant and rare values, in some partitions."""
    return spark.range(n).selectExpr(
        "cast(id * 7919 % 101 as double) / 7 as a", "cast(id * 31 % 57 as double) as b", "cast(id * id % 13 as double) as c", "1.0d as same",
        "cast(id % 40 = 3 as int) * 2 + cast((id * 7 % 101 + id * 3 % 57) > 90 as int) as y",
    ).repartition(parts).localCheckpoint()


@pytest.mark.parametrize("parts", [1, 3])
def test_trees_of_one_task_are_those_of_the_library(spark, monkeypatch, parts):
    from actilens.models import boosting

    df, x = _mixed(spark, parts=parts), ["a", "b", "c", "same"]
    fitted = []
    for cells in (boosting.CELLS, 0):
        monkeypatch.setattr(boosting, "CELLS", cells)
        fitted.append(classifiers.fit_boosted(df, x, "y", rounds=8, column_sample=0.7))
    here, library = ([[(t.numNodes, t.depth) for t in m.trees] for m in f.models] for f in fitted)
    assert here == library and len(here) == 4 and max(d for m in here for _, d in m) == 6
    assert [m.treeWeights for m in fitted[0].models] == [m.treeWeights for m in fitted[1].models]
    cut = [[[line.split("<=")[0].split(">")[0] for line in m.toDebugString.splitlines()[1:] if "Predict" not in line] for m in f.models] for f in fitted]
    assert cut[0] == cut[1]
    scores = [classifiers.apply_boosted(f, df, x).select("xgb_probabilities").collect() for f in fitted]
    assert np.allclose([r[0] for r in scores[0]], [r[0] for r in scores[1]], atol=1e-12)


def test_jobs_of_the_boosting_do_not_grow_with_its_rounds(spark):
    df, jobs = _mixed(spark, 300), []
    for rounds in (2, 9):
        spark.sparkContext.setJobGroup(f"{rounds} rounds", "boosting")
        try:
            assert [m.getNumTrees for m in classifiers.fit_boosted(df, ["a", "b", "c"], "y", rounds=rounds).models] == [rounds] * 4
            jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"{rounds} rounds")))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] > 0 and abs(jobs[1] - jobs[0]) <= 4  # before, some 24 more for each round


def test_random_numbers_and_powers_are_those_of_the_jvm(spark):
    from actilens.models import boosting

    jvm = spark._jvm
    library = getattr(getattr(jvm.org.apache.spark.util.random, "XORShiftRandom$"), "MODULE$")
    for seed in (0, 42, -5, 2**40 + 7):
        assert boosting._hashed(seed) == library.hashSeed(seed) & 2**64 - 1
        theirs, ours = jvm.java.util.Random(seed), boosting._JavaRandom(seed)
        assert [ours.long() for _ in range(3)] == [theirs.nextLong() & 2**64 - 1 for _ in range(3)]
    draws = jvm.org.apache.spark.util.random.XORShiftRandom(43)
    assert list(np.unpackbits(boosting._draws(42, 2, 20, 0.9)[1], count=20)) == [draws.nextDouble() < 0.9 for _ in range(20)]
    x = np.concatenate([np.linspace(-30, 30, 300), [0.0, 1e-12, 650.0]])
    assert np.allclose(boosting._exp(x), np.exp(x), rtol=4e-16, atol=0) and boosting._exp(np.array([800.0, -800.0])).tolist() == [np.inf, 0.0]


def test_rows_go_down_the_levels_to_the_leaf_of_the_walk(spark):
    trees, x = [_small_tree(4, n, seed)[0] for n, seed in ((200, 3), (7, 4), (1, 5))], np.random.default_rng(6).normal(size=(300, 4)).round(1)
    x[0, 0], x[1, 1], x[2], x[3] = np.nan, np.inf, -np.inf, np.nan
    assert all(len(levels) <= 8 and len(found) == 2 ** len(levels) for levels, found in map(isolation_forest._levels, trees))
    lengths = np.zeros(len(x))
    isolation_forest._add_lengths([isolation_forest._levels(t) for t in trees], x, lengths)
    plain = np.zeros(len(x))
    for tree in trees:
        plain += tree["length"][isolation_forest._leaf(tree, x)]
    assert (lengths == plain).all() and len(set(lengths)) > 10
