import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from conftest import rows_of
from ratingml.operators import encoders, profile


def _genres(spark):
    data = [(1, "Sci-Fi, Slice of  Life"), (2, "ACTION,"), (3, ""), (4, None), (5, "Action, Sci-Fi,,Drama")]
    return spark.createDataFrame(data, "id int, genre string")


def test_vocabulary_is_sorted_and_bounded(spark):
    assert profile.vocabulary(_genres(spark), "genre") == ["action", "drama", "sci-fi", "sliceoflife"]
    with pytest.raises(ValueError):
        profile.vocabulary(_genres(spark), "genre", max_values=3)
    assert profile.vocabulary(_genres(spark).limit(0), "genre") == []


def test_multi_hot_flags_and_nulls(spark):
    hot = encoders.MultiHotEncoder(inputCol="genre", values=["action", "sci-fi"]).transform(_genres(spark))
    assert hot.columns == ["id", "genre", "genre_action", "genre_sci-fi"]
    got = {r["id"]: (r["genre_action"], r["genre_sci-fi"]) for r in hot.collect()}
    assert got == {1: (0, 1), 2: (1, 0), 3: (0, 0), 4: (None, None), 5: (1, 1)}


def test_multi_hot_schema_equals_output(spark):
    encoder = encoders.MultiHotEncoder(inputCol="genre", values=["action"], prefix="is_")
    df = _genres(spark)
    assert encoder.transformSchema(df.schema).names == encoder.transform(df).columns


def test_multi_hot_learned_with_fill(spark):
    hot = encoders.multi_hot(_genres(spark), fill="Missing")
    assert "genre_missing" in hot.columns
    assert hot.filter("id = 4").first()["genre_missing"] == 1


words = st.lists(st.sampled_from(["a", "B b", "c", "D"]), min_size=1, max_size=5)


@settings(max_examples=10, deadline=None)
@given(st.lists(words, min_size=1, max_size=8))
def test_multi_hot_row_sum_is_the_number_of_distinct_values(spark, data):
    df = spark.createDataFrame([(i, ", ".join(row)) for i, row in enumerate(data)], "id int, genre string")
    hot = encoders.multi_hot(df)
    flags = [F.col(c) for c in hot.columns if c.startswith("genre_")]
    got = {r["id"]: r["s"] for r in hot.select("id", sum(flags).alias("s")).collect()}
    assert got == {i: len(set(row)) for i, row in enumerate(data)}


def test_custom_stages_survive_saving(spark, tmp_path):
    df = _genres(spark).withColumn("user", F.col("id") * 10)
    stages = [
        encoders.MultiHotLearner(inputCol="genre"),
        encoders.KeyIndexer(inputCols=["user"], outputCols=["user_index"], order="value", handleInvalid="keep"),
    ]
    fitted = Pipeline(stages=stages).fit(df)
    fitted.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert rows_of(again.transform(df)) == rows_of(fitted.transform(df))
    Pipeline(stages=stages).write().overwrite().save(str(tmp_path / "p"))
    assert rows_of(Pipeline.load(str(tmp_path / "p")).fit(df).transform(df)) == rows_of(fitted.transform(df))


def test_key_index_equals_the_builtin_indexer(spark):
    df = spark.range(200).select((F.col("id") % 7 * F.col("id") % 11).cast("string").alias("k"), F.col("id"))
    ours = encoders.KeyIndexer(inputCols=["k"], outputCols=["i"]).fit(df).transform(df)
    theirs = StringIndexer(inputCol="k", outputCol="i").fit(df).transform(df)
    assert rows_of(ours.select("id", "i")) == rows_of(theirs.select("id", F.col("i").cast("int")))


def test_key_index_by_value_is_numeric_and_keeps_nulls(spark):
    df = spark.createDataFrame([(10, "b"), (9, None), (100, "a"), (None, "b")], "n int, t string")
    model = encoders.KeyIndexer(inputCols=["n", "t"], outputCols=["ni", "ti"], order="value", handleInvalid="keep").fit(df)
    got = rows_of(model.transform(df).select("n", "ni", "t", "ti"))
    assert got == [(10, 1, "b", 1), (100, 2, "a", 0), (9, 0, None, None), (None, None, "b", 1)]


def test_key_index_of_unseen_keys(spark):
    df = spark.createDataFrame([("a",), ("b",)], "t string")
    new = spark.createDataFrame([("a",), ("z",), (None,)], "t string")
    model = encoders.KeyIndexer(inputCols=["t"], outputCols=["i"]).fit(df)
    assert model.copy({model.handleInvalid: "skip"}).transform(new).count() == 1
    assert model.copy({model.handleInvalid: "keep"}).transform(new).filter("i is null").count() == 2
    with pytest.raises(Exception, match="no index for t"):
        model.transform(new).collect()


@settings(max_examples=6, deadline=None)
@given(st.lists(st.sampled_from("abcde"), min_size=1, max_size=30), st.integers(1, 5))
def test_index_does_not_depend_on_row_order_or_heavy_keys(spark, keys, hot):
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id int, k string")
    mixed = df.orderBy(F.col("id").desc()).repartition(3)
    a = encoders.KeyIndexer(inputCols=["k"], outputCols=["i"]).fit(df).transform(df)
    b = encoders.KeyIndexer(inputCols=["k"], outputCols=["i"], hotRows=hot).fit(mixed).transform(df)
    assert rows_of(a.select("id", "i")) == rows_of(b.select("id", "i"))


def test_index_in_place_drops_null_rows(spark):
    df = spark.createDataFrame([(1, "x", 5), (2, None, 6), (2, "x", 7)], "u int, t string, r int")
    got = encoders.index_in_place(df, ["u", "t"])
    assert got.columns == ["u", "t", "r"]
    # user 2 is the most frequent, counted with its row of unknown type
    assert rows_of(got) == [(0, 0, 7), (1, 0, 5)]


def test_one_hot(spark):
    df = spark.createDataFrame([(1, "TV"), (2, "OVA"), (3, None)], "id int, type string")
    cols = encoders.one_hot_columns(df, "type", prefix="type_")
    assert rows_of(cols.select("id", "type_OVA", "type_TV")) == [(1, 0, 1), (2, 1, 0), (3, 0, 0)]
    known = df.filter("type is not null")
    stages = [encoders.frequency_indexer(["type"], ["i"]), encoders.one_hot_vectors(["i"], ["v"])]
    fitted = Pipeline(stages=stages).fit(known)
    assert rows_of(fitted.transform(known).select("id", vector_to_array("v"))) == [(1, [0.0]), (2, [1.0])]
    with pytest.raises(Exception):
        fitted.transform(df).select("v").collect()


def test_profile_tables(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 2)], "user_id int, item_id int")
    assert profile.profile(df).first().asDict() == {"n_rows": 3, "n_users": 2, "n_items": 2}
    assert profile.profile(df, approximate=True).first()["n_users"] == 2
    assert profile.shape(df).first().asDict() == {"n_rows": 3, "n_columns": 2}
    assert profile.categories(df, "item_id") == [1, 2]
    assert [r["item_id"] for r in profile.first_rows(df, 1, [F.col("item_id").desc(), F.col("user_id").desc()]).collect()] == [2]


def test_sparse_multi_hot(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b"]), (2, ["c"]), (3, []), (4, None), (5, [None, "a"])], "id int, v array<string>")
    found = {r["id"]: r["slots"] for r in encoders.sparse_multi_hot(df, "v", ["id"]).collect()}
    assert found == {1: [0, 1], 2: [2], 3: [], 4: [], 5: [0]}
