import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from conftest import rows_of
from ratingml.operators import encoders, features, metrics, models, splits, tuning
from ratingml.plans.evaluate import evaluate_holdout
from ratingml.sources import models as model_files

PAIR = ["user_id", "item_id"]


@pytest.fixture(scope="module")
def stages():
    return lambda: features.feature_stages(text=None)


@pytest.fixture(scope="module")
def matrix(spark, signal_rows):
    named = signal_rows.select(*PAIR, "web_rating", "members", "episodes", F.col("rating").alias("label"))
    vectors = features.assemble(["web_rating", "members", "episodes"], "feature").transform(named)
    parts = splits.hash_split(vectors.select(*PAIR, "feature", "label"), 0.8, PAIR)
    for p in parts:
        p.persist().count()
    return parts


def _majority(rows):
    counts = [r["count"] for r in rows.groupBy("label").count().collect()]
    return max(counts) / sum(counts)


@pytest.mark.parametrize("algo, params", [("mlp", {"maxIter": 60}), ("rf", {"numTrees": 20})])
def test_classifiers_beat_the_majority_class(signal_rows, stages, algo, params):
    model = models.Classifier(algo)
    model.train(signal_rows, stages=stages(), **params)
    scored = model.transform(signal_rows)
    assert metrics.accuracy(scored).first()[0] > _majority(signal_rows) + 0.1
    assert scored.filter(~F.col("pred").isin(0.0, 1.0, 2.0)).count() == 0
    total = scored.select(F.aggregate(vector_to_array("prob"), F.lit(0.0), lambda a, x: a + x).alias("s"))
    assert total.filter(F.abs(F.col("s") - 1) > 1e-9).count() == 0


@pytest.mark.parametrize("algo", ["gbdt", "glr"])
def test_regressors_beat_the_mean(signal_rows, stages, algo):
    model = models.Regressor(algo)
    model.train(signal_rows, stages=stages())
    deviation = signal_rows.agg(F.stddev_pop("rating")).first()[0]
    assert metrics.rmse(model.transform(signal_rows)).first()[0] < deviation * 0.95


def test_whole_feature_vector_with_text_trains(signal_rows):
    fitted = models.train(signal_rows, "glr", stages=features.feature_stages(text_partitions=2))
    assert fitted.transform(signal_rows).filter("pred is null").count() == 0


def test_unknown_names_are_rejected():
    with pytest.raises(ValueError, match="unknown algorithm"):
        models.Classifier("svm")
    with pytest.raises(ValueError, match="unknown algorithm"):
        models.Regressor("mlp")


def test_perceptron_input_size_and_seed(signal_rows, stages):
    a = models.train(signal_rows, "mlp", stages=stages(), maxIter=3, seed=7)
    n_types = signal_rows.select("type").distinct().count()
    assert a.stages[-1].getLayers() == [n_types - 1 + 3, 40, 10, 3]
    b = models.train(signal_rows, "mlp", stages=stages(), maxIter=3, seed=7)
    assert a.stages[-1].weights == b.stages[-1].weights


def test_metric_per_round_equals_the_builtin_error(matrix):
    train_rows, test_rows = matrix
    fitted = models.boosted_small().fit(train_rows)
    table = models.round_metrics(fitted, {"train": train_rows, "eval": test_rows}, "label")
    assert table.count() == 10
    expected = fitted.evaluateEachIteration(test_rows, "squared")
    got = [r["rmse"] ** 2 for r in table.filter("set = 'eval'").orderBy("round").collect()]
    assert got == pytest.approx(expected)
    final = metrics.rmsle(fitted.transform(test_rows), "label").first()[0]
    assert table.filter("set = 'eval' and round = 5").first()["rmsle"] == pytest.approx(final)


def test_stopping_round():
    assert models.stopping_round([5, 4, 3, 3.5, 3.2, 1], 2) == 3
    assert models.stopping_round([5, 4, 3, 3.5, 2], 2) == 5
    assert models.stopping_round([3, 2, 1], 1) == 3


def test_patience_keeps_the_first_trees(matrix):
    train_rows, test_rows = matrix
    estimator = models.boosted_rounds(maxDepth=4, maxIter=6, stepSize=1.0, minInstancesPerNode=1)
    fitted, table = models.fit_with_patience(estimator, train_rows, test_rows, patience=1)
    scores = [r["rmse"] for r in table.filter("set = 'validation'").orderBy("round").collect()]
    keep = models.stopping_round(scores, 1)
    assert len(fitted.treeWeights) == keep
    assert metrics.rmse(fitted.transform(test_rows), "label").first()[0] == pytest.approx(scores[keep - 1])
    with pytest.raises(ValueError):
        models.fit_with_patience(estimator, train_rows, None, 1)


def test_tolerance_stops_early(matrix):
    train_rows, test_rows = matrix
    fitted = models.fit_with_validation(models.boosted_small(maxIter=8), train_rows, test_rows, tolerance=10.0)
    assert len(fitted.treeWeights) < 8


def test_leafwise_settings_and_categories(spark, signal_rows):
    rows = signal_rows.select(*PAIR, "type", "web_rating", "rating")
    n_types = rows.select("type").distinct().count()
    indexed = encoders.mark_categorical(encoders.index_in_place(rows, [*PAIR, "type"]), {"type": n_types})
    vectors = features.assemble_all_but(indexed, "rating")
    estimator = models.boosted_leafwise(n_types, maxIter=2)
    assert (estimator.getMaxDepth(), estimator.getMinInstancesPerNode(), estimator.getStepSize()) == (7, 5, 1.0)
    sampled = models.boosted_leafwise(300, sampled=True)
    assert (sampled.getMaxIter(), sampled.getSubsamplingRate(), sampled.getMaxBins()) == (100, 0.8, 300)
    assert sampled.getFeatureSubsetStrategy() == "0.7"
    fitted = estimator.fit(vectors)
    assert "in {" in fitted.toDebugString  # a split on categories
    deviation = rows.agg(F.stddev_pop("rating")).first()[0]
    assert metrics.rmse(fitted.transform(vectors)).first()[0] < deviation


def test_tree_dump(spark, matrix, tmp_path):
    fitted = models.boosted_small().fit(matrix.train)
    dump = model_files.tree_dump(spark, fitted)
    assert [r["tree"] for r in dump.select("tree").distinct().orderBy("tree").collect()] == [0, 1, 2, 3, 4]
    assert dump.filter("line_no = 0").count() == 5
    path = str(tmp_path / "dump")
    model_files.save_tree_dump(spark, fitted, path)
    lines = spark.read.text(path)
    assert lines.count() == dump.count()
    assert lines.filter("value like 'tree[0] %'").count() == dump.filter("tree = 0").count()


def test_grid_sizes():
    sizes = {"rf": 72, "gbdt": 96, "glr": 6}
    builders = {"rf": models.random_forest, "gbdt": models.boosted, "glr": models.linear}
    for algo, n in sizes.items():
        assert len(tuning.default_grid(algo, builders[algo]())) == n
    grid = tuning.default_grid("mlp", models.mlp(29), size=29)
    assert len(grid) == 18
    layers = {tuple(v) for g in grid for p, v in g.items() if p.name == "layers"}
    assert layers == {(29, 20, 10, 3), (29, 50, 30, 10, 3)}
    with pytest.raises(ValueError):
        tuning.default_grid("mlp", models.mlp(29))


def test_holdout_of_a_regressor_ranks_the_smallest_error_first(signal_rows, stages):
    report = evaluate_holdout(signal_rows, "glr", stages=stages())
    ranked = report.ranked.collect()
    assert [r["rank"] for r in ranked] == [1, 2, 3, 4, 5, 6]
    assert [r["metric"] for r in ranked] == sorted(r["metric"] for r in ranked)
    summary = report.summary.first()
    assert summary["best_validation"] == ranked[0]["metric"]
    assert summary["holdout"] < signal_rows.agg(F.stddev_pop("rating")).first()[0]
    assert "pred" in report.model.transform(signal_rows).columns


def test_holdout_of_a_classifier_through_train(signal_rows, stages):
    model = models.Classifier("rf")
    model.train(signal_rows, evaluate=True, holdout={"grid": {"maxDepth": [2, 5]}}, numTrees=10, stages=stages())
    ranked = model.report.ranked.collect()
    assert ranked[0]["metric"] >= ranked[1]["metric"]
    assert model.report.summary.first()["metric"] == "accuracy"
    assert model.transform(signal_rows).filter("pred is null").count() == 0


def test_holdout_of_a_perceptron_with_its_layer_grid(signal_rows, stages):
    size = signal_rows.select("type").distinct().count() - 1 + 3
    grid = {"layers": [[size, 5, 3], [size, 8, 4, 3]], "maxIter": [5]}
    report = evaluate_holdout(signal_rows, "mlp", grid=grid, stages=stages(), parallelism=2)
    assert report.ranked.count() == 2


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0)], "rating double, pred double")
    assert metrics.rmse(df).first()[0] == pytest.approx(0.5**0.5)
    assert metrics.regression_evaluator().evaluate(df) == pytest.approx(0.5**0.5)
    labelled = df.toDF("label", "pred")
    assert metrics.accuracy(labelled).first()[0] == 0.5
    assert metrics.classification_evaluator().evaluate(labelled) == 0.5
    result, row = metrics.timed(spark, df.count, "count")
    assert result == 2 and row.first()["seconds"] > 0
    assert rows_of(row.select("info")) == [("count",)]


def test_first_trees_are_the_model_of_fewer_rounds(spark, signal_rows, tmp_path):
    rows = features.assemble(["web_rating", "members"], "feature", invalid="skip").transform(signal_rows)
    rows = rows.select("feature", F.col("rating").cast("double").alias("label"))
    full = models.boosted_small(maxIter=4).fit(rows)
    short, direct = models.first_trees(full, 2), models.boosted_small(maxIter=2).fit(rows)
    assert len(short.treeWeights) == 2
    a, b = [[r[0] for r in m.transform(rows).select(m.getPredictionCol()).limit(50).collect()] for m in (short, direct)]
    assert a == pytest.approx(b)
    short.write().overwrite().save(str(tmp_path / "m"))
