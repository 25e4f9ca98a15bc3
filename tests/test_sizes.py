"""Work that is done once, and tasks that stay bounded while tables grow."""

import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import Word2Vec
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

from ratingml import storage
from ratingml.operators import features, metrics, models, splits, tuning
from ratingml.plans import fixtures, jobs
from tests.conftest import rows_of

PAIR = ["user_id", "item_id"]


def counted(monkeypatch, kind):
    fits, fit = [], kind._fit
    monkeypatch.setattr(kind, "_fit", lambda self, df: fits.append(self.extractParamMap()) or fit(self, df))
    return fits


@pytest.fixture
def tables(spark, tmp_path):
    """Lines, orders and parts of 2,000 pairs."""
    lines = spark.range(2000).select(
        F.floor(F.col("id") / 4).alias("l_orderkey"),
        (F.col("id") % 50).alias("l_partkey"),
        (F.col("id") % 9 + 1).cast("double").alias("l_quantity"),
        F.lit(0.01).alias("l_discount"),
    )
    orders = spark.range(500).select(F.col("id").alias("o_orderkey"), (F.col("id") % 30).alias("o_custkey"), F.current_date().alias("o_orderdate"))
    parts = spark.range(50).select(
        F.col("id").alias("p_partkey"),
        F.concat(F.lit("hot part "), F.col("id")).alias("p_name"),
        F.lit("SMALL").alias("p_type"),
        (F.col("id") % 7 + 1).cast("int").alias("p_size"),
        (F.col("id") * 3.0 + 900).alias("p_retailprice"),
    )
    for name, df in (("lineitem", lines), ("orders", orders), ("part", parts)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_joined_rows_are_dealt_by_their_number(spark, tables, monkeypatch):
    usual = rows_of(fixtures.joined(spark, tables))
    assert len(usual) > 500
    monkeypatch.setattr(fixtures, "keyed", lambda df, rows, *keys: storage.keyed(df, rows, *keys, most=100))
    dealt = fixtures.joined(spark, tables)
    assert rows_of(dealt) == usual
    assert dealt.rdd.getNumPartitions() == 20
    parts = splits.random_split(dealt.select(*PAIR), 0.8, seed=0)
    assert sum(p.count() for p in parts) == len(usual)


def test_small_tables_are_not_dealt(spark):
    df = spark.range(10)
    assert storage.keyed(df, 4000, "id", most=1000) is df
    assert storage.keyed(df, 4001, "id", most=1000).rdd.getNumPartitions() == 5
    assert storage.dealt(df, 1000) is df
    assert storage.dealt(spark.range(1000), 50).rdd.getNumPartitions() == 20


@pytest.fixture(scope="module")
def vectors(signal_rows):
    rows = features.assemble(["web_rating", "members", "episodes"], features.FEATURES, invalid="skip").transform(signal_rows)
    rows = rows.select(*PAIR, features.FEATURES, F.col("label").cast("double").alias("label"), F.col("rating").cast("double").alias("rating")).persist()
    rows.count()
    return rows


def test_sets_that_spark_fits_alike_are_fitted_once(spark, vectors, monkeypatch):
    fits = counted(monkeypatch, MultilayerPerceptronClassifier)
    estimator, scorer = models.mlp(3, hidden=(4,)), metrics.classification_evaluator()
    grid = tuning.build_grid(estimator, {"stepSize": [0.01, 0.03, 0.05], "maxIter": [2, 9]})
    found = tuning.search(vectors, estimator, scorer, grid, keys=PAIR)
    assert len(fits) == 2 + 1  # one per number of iterations, and the best set on all rows
    rows, held = tuning.fold(vectors, 0.8, PAIR, 2020)
    assert found.metrics == pytest.approx([scorer.evaluate(estimator.fit(rows, p).transform(held)) for p in grid])
    assert tuning.ranking(spark, found, scorer).select("params").distinct().count() == 6
    grid = tuning.build_grid(estimator, {"stepSize": [0.01, 0.03]})
    assert len({tuning.params_text(tuning._read_params(models.mlp(3, solver="gd"), p)) for p in grid}) == 2


def test_a_linear_grid_fits_each_penalty_once(vectors, monkeypatch):
    fits = counted(monkeypatch, GeneralizedLinearRegression)
    estimator, scorer = models.linear(), metrics.regression_evaluator()
    found = tuning.search(vectors, estimator, scorer, tuning.default_grid("glr", estimator), keys=PAIR)
    assert len(fits) == 3 + 1 and len(found.metrics) == 6
    rows, held = tuning.fold(vectors, 0.8, PAIR, 2020)
    assert found.metrics == pytest.approx([scorer.evaluate(estimator.fit(rows, p).transform(held)) for p in found.grid])
    by_steps = [{estimator.maxIter: n} for n in (20, 50)]
    for own in (models.linear(family="poisson"), models.linear(link="log")):
        assert len({tuning.params_text(tuning._read_params(own, p)) for p in by_steps}) == 2


def test_models_of_the_same_rows_share_their_features(signal_rows, monkeypatch):
    fits = counted(monkeypatch, Word2Vec)
    found = {}
    with models.prepared_rows(signal_rows, [models.CLASS_LABEL, models.RATING]) as prepared:
        for kind, name, own in ((models.Classifier, "rf", {"numTrees": 2}), (models.Regressor, "glr", {})):
            learner = kind(name)
            learner.train(signal_rows, prepared=prepared, **own)
            found[name] = learner.transform(signal_rows).select(*PAIR, "pred")
    assert len(fits) == 1
    alone = models.train(signal_rows, "glr").transform(signal_rows).agg(F.sum("pred")).first()[0]
    assert found["glr"].agg(F.sum("pred")).first()[0] == pytest.approx(alone)
    assert found["rf"].count() == signal_rows.count()


def test_the_training_job_reads_its_files_once(spark, tmp_path):
    ratings = spark.range(200).select((F.col("id") % 20).alias("user_id"), (F.col("id") % 10).alias("item_id"), (F.col("id") % 10 + 1).alias("rating"))
    items = spark.range(10).select(
        F.col("id").alias("item_id"), F.concat(F.lit("old part "), F.col("id")).alias("name"), F.lit("a").alias("genre"),
        F.when(F.col("id") % 2 == 0, "TV").otherwise("Movie").alias("type"), (F.col("id") + 1).alias("episodes"), (F.col("id") * 0.5).alias("rating"),
        F.col("id").alias("members"),
    )
    paths = [f"{tmp_path}/{n}" for n in ("ratings", "items", "model")]
    for df, path in zip((ratings, items), paths):
        df.write.option("header", True).csv(path)
    result = jobs.train_and_save(spark, *paths, algo="glr")
    read = [f for t in ("profile", "predictions") for f in result.tables[t].inputFiles()]
    assert read and all(f.endswith(".parquet") for f in read)
    assert result.tables["profile"].first()["n_rows"] == 200
