import statistics

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import rows_of
from ratingml.functions import compact, multi_values, number_or_null, rating_label, words
from ratingml.operators import clean
from ratingml.operators.quantiles import exact_median, exact_rank


def test_drop_unrated_drops_null_too(spark):
    df = spark.createDataFrame([(1, -1), (2, 5), (3, None)], "k int, rating int")
    assert rows_of(clean.drop_unrated(df)) == [(2, 5)]


def test_label_bounds(spark):
    df = spark.createDataFrame([(r,) for r in (1, 5, 6, 8, 9, 10, None)], "rating int")
    got = {r["rating"]: r["label"] for r in clean.add_label(df).collect()}
    assert got == {1: 0, 5: 0, 6: 1, 8: 1, 9: 2, 10: 2, None: None}


def test_label_is_visible_to_the_optimizer(spark):
    plan = spark.range(3).select(rating_label(F.col("id")).alias("x"))._jdf.queryExecution().toString()
    assert "UDF" not in plan


def test_complete_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (None, "b")], "`a.b` int, c string")
    assert rows_of(clean.complete_rows(df)) == [(1, "a")]
    assert clean.complete_rows(df.limit(0)).count() == 0


def test_null_counts(spark):
    df = spark.createDataFrame([(None, "a"), (None, None), (1, "x")], "n int, t string")
    assert rows_of(clean.null_counts(df)) == [("n", 2), ("t", 1)]


def test_impute_truncates_mean_and_uses_reference(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 3), (4, None)], "k int, episodes int")
    assert clean.impute(df, mean_cols=["episodes"]).filter("k = 4").first()["episodes"] == 2
    items = spark.createDataFrame([(10,), (11,)], "episodes int")
    filled = clean.impute(df, mean_cols=["episodes"], reference_frame=items)
    assert filled.filter("k = 4").first()["episodes"] == 10


def test_impute_column_without_values_stays_null(spark):
    df = spark.createDataFrame([(1, None)], "k int, x double")
    assert clean.impute(df, mean_cols=["x"], median_cols=[]).first()["x"] is None
    assert clean.impute(df, median_cols=["x"], exact=True).first()["x"] is None


def test_sentinel_field_and_whole_row(spark):
    df = spark.createDataFrame([(1, "Unknown", "TV", 7), (2, "12", None, 8), (3, "x", "TV", 9)], "id int, e string, t string, y int")
    assert rows_of(clean.sentinel_to_number(df, "e")) == [(1, 0, "TV", 7), (2, 12, None, 8), (3, None, "TV", 9)]
    whole = clean.sentinel_to_number(df, "e", whole_row=True, keep=["y"])
    assert rows_of(whole)[0] == (0, 0, "0", 7)
    assert rows_of(clean.sentinel_to_number(df, "e", value=None))[0] == (1, None, "TV", 7)


def test_samples(spark):
    df = spark.range(20000).select(F.col("id").alias("k"))
    a = clean.sample_by_hash(df, 0.1, ["k"], seed=1)
    b = clean.sample_by_hash(df.repartition(7), 0.1, ["k"], seed=1)
    assert rows_of(a) == rows_of(b)
    assert 1700 < a.count() < 2300
    assert clean.sample_rows(df, 0.1, 222).count() == clean.sample_rows(df, 0.1, 222).count()
    assert clean.sample_by_hash(df, 0.1, ["k"], seed=2).exceptAll(a).count() > 0


def test_process_returns_the_cleaned_frame(spark):
    schema = "user_id int, rating int, genre string, type string, episodes int, web_rating double"
    df = spark.createDataFrame([(1, 9, None, None, None, None), (2, 3, "A", "TV", 4, 7.0)], schema)
    assert clean.process(df, filter_na=True).count() == 1
    filled = clean.process(df).filter("user_id = 1").first()
    assert (filled["genre"], filled["type"], filled["episodes"], filled["web_rating"]) == ("Missing", "Missing", 4, 7.0)
    assert "label" not in clean.process(df, convert_label=False).columns


def test_text_functions(spark):
    df = spark.createDataFrame([("  A,  B c ,d,",), ("",), (None,)], "g string")
    assert [r[0] for r in df.select(compact("g")).collect()] == ["a,bc,d,", "", None]
    assert [r[0] for r in df.select(multi_values("g")).collect()] == [["a", "bc", "d", ""], [""], None]
    names = spark.createDataFrame([("Über-Größe no_1",)], "n string")
    assert names.select(words("n")).first()[0] == ["Über", "Größe", "no_1"]
    dirty = spark.createDataFrame([("12",), ("Unknown",)], "e string")
    assert [r[0] for r in dirty.select(number_or_null("e")).collect()] == [12, None]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(-5, 5) | st.integers(-1000, 1000), min_size=1, max_size=60))
def test_exact_median_matches_a_sorted_list(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    assert exact_median(df, "x", small=3) == statistics.median(values)


def test_exact_rank_on_many_rows(spark):
    df = spark.range(30000).select((F.col("id") * 7919 % 30000).alias("x"))
    assert exact_rank(df, "x", 12345, small=10) == 12344
    with pytest.raises(ValueError):
        exact_rank(df, "x", 30001)
