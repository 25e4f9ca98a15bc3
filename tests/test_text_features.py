import math

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from conftest import rows_of
from ratingml.operators import features, text
from ratingml.plans.fixtures import items, ratings


def _names(spark):
    return spark.createDataFrame([(1, "!!Über Fate/Zero"), (2, ""), (3, "one TWO  three_3")], "id int, name string")


def test_split_tokens(spark):
    got = dict(rows_of(text.split_tokenizer().transform(_names(spark)).select("id", "words")))
    # the letter Ü separates as well
    assert got == {1: ["ber", "fate", "zero"], 2: [], 3: ["one", "two", "three_3"]}
    keep = dict(rows_of(text.split_tokenizer(min_length=0).transform(_names(spark)).select("id", "words")))
    assert keep[1] == ["", "ber", "fate", "zero"]


def test_match_tokens_keep_case_and_letters(spark):
    expected = {1: ["Über", "Fate", "Zero"], 2: [], 3: ["one", "TWO", "three_3"]}
    assert dict(rows_of(text.match_tokenizer().transform(_names(spark)).select("id", "words"))) == expected
    assert dict(rows_of(text.match_words(_names(spark)).select("id", "words"))) == expected


def test_document_vectors_are_columns(spark):
    found = text.document_vectors(_names(spark), size=4)
    assert found.columns == ["id", "name"] + [f"name_vectors_{i}" for i in range(1, 5)]
    again = text.document_vectors(_names(spark), size=4)
    assert rows_of(found) == rows_of(again)
    assert found.filter("id = 2").first()["name_vectors_1"] == 0.0


def test_transform_text(spark):
    found = text.transform_text(_names(spark), size=16, partitions=2)
    assert found.columns == ["name", "words", "word_vectors"]
    assert all(r["word_vectors"].size == 16 for r in found.collect())


def test_scaling_and_a_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "a double, b double")
    stages = [features.assemble(["a", "b"], "v"), features.scaler("v", "s")]
    got = Pipeline(stages=stages).fit(df).transform(df).select("a", vector_to_array("s").alias("s")).collect()
    mean, std = 7 / 3, math.sqrt(((1 - 7 / 3) ** 2 + (2 - 7 / 3) ** 2 + (4 - 7 / 3) ** 2) / 2)
    for row in got:
        assert row["s"][0] == pytest.approx((row["a"] - mean) / std)
        assert row["s"][1] == 0.0


def test_assemble_all_but_the_label_skips_null_rows(spark):
    df = spark.createDataFrame([(1, 2.0, 3), (4, None, 6)], "a int, b double, rating int")
    found = features.assemble_all_but(df, "rating")
    assert [r["feature"].toArray().tolist() for r in found.collect()] == [[1.0, 2.0]]
    with pytest.raises(Exception):
        features.assemble_all_but(df, "rating", invalid="error").collect()


def test_feature_vector_size_from_metadata(spark, signal_rows):
    model = Pipeline(stages=features.feature_stages(text_partitions=2)).fit(signal_rows)
    n_types = signal_rows.select("type").distinct().count()
    assert features.transformed_size(model, signal_rows) == (n_types - 1) + 3 + 20
    plain = spark.createDataFrame(model.transform(signal_rows).select(features.FEATURES).limit(1).collect())
    assert features.vector_size(plain) == (n_types - 1) + 3 + 20


def test_merge_puts_the_label_first(spark, sf_dir):
    prepared = features.prepared_items(items(spark, sf_dir), 5.0)
    vectors = prepared.select("item_id", F.lit(0.5).alias("name_vectors_1"))
    wide = features.expand_items(prepared, vectors)
    merged = features.merge_item_features(ratings(spark, sf_dir).drop("ts"), wide)
    assert merged.columns[0] == "rating"
    assert not {"user_id", "item_id", "name", "genre", "type"} & set(merged.columns)
    assert "name_vectors_1" in merged.columns and "type_Missing" in merged.columns
    assert merged.count() == ratings(spark, sf_dir).count()
    assert all(kind in ("int", "bigint", "double") for _, kind in merged.dtypes)
