import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from ratingml import schemas
from ratingml.operators import features, models, scoring
from ratingml.sources import models as model_files
from ratingml.streaming import scoring as streams

REQUESTS = [
    ("green walnut shelf", "PROMO", 3, 6.25, 812),
    ("Lamp/No. 4", "SMALL", 41, 9.5, 77001),
    ("x", "PROMO", 1, 1.0, 1),
]


@pytest.fixture(scope="module")
def fitted(spark, signal_rows):
    stages = features.feature_stages(vector_size=5, text_partitions=2)
    return models.train(signal_rows, "rf", stages=stages, numTrees=10)


@pytest.fixture(scope="module")
def saved(fitted, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("model") / "rf")
    model_files.save_model(fitted, path)
    return path


def test_input_fields(fitted):
    assert sorted(scoring.input_fields(fitted)) == ["episodes", "members", "name", "type", "web_rating"]


def test_reloaded_model_gives_the_same_rows(fitted, saved, signal_rows):
    wanted = ["user_id", "item_id", "pred"]
    again = model_files.load_model(saved)
    assert scoring.differing_rows(fitted.transform(signal_rows).select(*wanted), again.transform(signal_rows).select(*wanted)) == 0
    assert scoring.differing_rows(signal_rows.select("user_id"), signal_rows.select("item_id")) > 0


def test_score_requests_from_a_saved_model(spark, saved):
    requests = spark.createDataFrame(REQUESTS, schemas.REQUESTS)
    got = scoring.class_output(scoring.score_saved(spark, saved, requests), ["name"])
    assert got.columns == ["name", "pred", "prob_0", "prob_1", "prob_2"]
    for row in got.collect():
        probabilities = [row["prob_0"], row["prob_1"], row["prob_2"]]
        assert sum(probabilities) == pytest.approx(1.0)
        assert row["pred"] == probabilities.index(max(probabilities))


def test_lacking_or_mistyped_field(spark, fitted, saved):
    requests = spark.createDataFrame(REQUESTS, schemas.REQUESTS)
    with pytest.raises(ValueError, match="missing input columns: name"):
        scoring.score_saved(spark, saved, requests.drop("name"))
    with pytest.raises(ValueError, match="wrong type of feature: episodes"):
        scoring.check_requests(fitted, requests.withColumn("episodes", F.col("episodes").cast("string")))


def test_null_fields_go_to_the_rejects(spark, fitted):
    rows = [*REQUESTS, ("x", None, 1, None, 5)]
    accepted, rejected = scoring.check_requests(fitted, spark.createDataFrame(rows, schemas.REQUESTS))
    assert accepted.count() == 3
    reason = rejected.first()["reason"]
    assert reason.startswith("null feature: ") and "type" in reason and "web_rating" in reason


def test_one_vector_equals_the_table(fitted, signal_rows):
    row = fitted.transform(signal_rows).select(features.FEATURES, "pred").first()
    assert scoring.predict_vector(fitted.stages[-1], row[features.FEATURES]) == row["pred"]


def test_stream_equals_batch(spark, fitted, signal_rows, tmp_path):
    wanted = ["user_id", "item_id", "pred"]
    requests = signal_rows.drop("label", "rating").withColumn(
        "type", F.when(F.col("item_id") % 10 != 0, F.col("type"))
    )
    source, target, state = [str(tmp_path / n) for n in ("in", "out", "state")]
    requests.repartition(3).write.parquet(source)
    arriving = streams.read_requests(spark, source, requests.schema, files_per_batch=1)
    query = streams.start_scoring(streams.scored_stream(fitted, arriving, wanted), target, state, available_now=True)
    query.awaitTermination()
    batch = fitted.transform(requests.filter("type is not null")).select(*wanted)
    assert rows_of(spark.read.parquet(target)) == rows_of(batch)

    # more files arrive: only they are scored, after the same checkpoint
    requests.limit(5).coalesce(1).write.mode("append").parquet(source)
    arriving = streams.read_requests(spark, source, requests.schema)
    streams.start_scoring(streams.scored_stream(fitted, arriving, wanted), target, state, available_now=True).awaitTermination()
    extra = requests.limit(5).filter("type is not null").count()
    assert spark.read.parquet(target).count() == batch.count() + extra


def test_stream_of_rejects(spark, fitted, tmp_path):
    rows = spark.createDataFrame([*REQUESTS, (None, "PROMO", 1, 2.0, 5)], schemas.REQUESTS)
    source = str(tmp_path / "in")
    rows.write.parquet(source)
    rejected = streams.rejected_stream(fitted, streams.read_requests(spark, source, schemas.REQUESTS))
    query = streams.start_scoring(rejected, str(tmp_path / "out"), str(tmp_path / "state"), available_now=True)
    query.awaitTermination()
    assert [r["reason"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["null feature: name"]


def test_every_request_comes_out_once(spark, fitted):
    broken = [(name, kind, None, rating, members) for name, kind, _, rating, members in REQUESTS]
    requests = spark.createDataFrame(REQUESTS + broken, schemas.REQUESTS)
    found = scoring.score_all(fitted, requests, ["name", "episodes"]).collect()
    assert len(found) == 6 and sum(r["pred"] is None for r in found) == 3
    assert all((r["pred"] is None) == (r["reason"] == "null feature: episodes") for r in found)
