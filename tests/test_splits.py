import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import rows_of
from ratingml.operators import splits

rows = st.lists(
    st.tuples(st.integers(0, 4), st.integers(0, 8), st.none() | st.integers(0, 5)), min_size=1, max_size=40
)


def _frame(spark, data):
    return spark.createDataFrame(data, "user_id int, item_id int, ts int")


@settings(max_examples=8, deadline=None)
@given(rows)
def test_per_user_sizes_and_cover(spark, data):
    """Copies included: train has the k with k/n <= f, test the rest, nothing is lost."""
    df = _frame(spark, data)
    train, test = splits.stratified_split(df, 0.8)
    assert rows_of(train.unionByName(test).select(*df.columns)) == rows_of(df)
    sizes = {r["user_id"]: r["n"] for r in train.groupBy("user_id").agg(F.count("*").alias("n")).collect()}
    for user in {u for u, _, _ in data}:
        n = sum(1 for u, _, _ in data if u == user)
        assert sizes.get(user, 0) == sum(1 for k in range(1, n + 1) if k / n <= 0.8)


@settings(max_examples=8, deadline=None)
@given(rows)
def test_heavy_users_get_the_same_split(spark, data):
    df = _frame(spark, data)
    usual = splits.stratified_parts(df, 0.7)
    heavy = splits.stratified_parts(df, 0.7, max_group_rows=2)
    assert heavy.columns == usual.columns
    assert rows_of(heavy) == rows_of(usual)
    usual = splits.chronological_parts(df, 0.7)
    heavy = splits.chronological_parts(df, 0.7, max_group_rows=2)
    assert rows_of(heavy) == rows_of(usual)


def test_rows_without_time_are_in_neither_part(spark):
    data = [(1, i, None if i < 6 else i) for i in range(30)] + [(2, 1, None), (2, 2, None)]
    train, test = splits.chronological_split(_frame(spark, data), 0.75)
    assert (train.count(), test.count()) == (18, 6)
    assert train.filter("ts is null").count() + test.filter("ts is null").count() == 0
    assert train.agg(F.max("ts")).first()[0] < test.agg(F.min("ts")).first()[0]


def test_user_with_one_row_is_in_test(spark):
    train, test = splits.stratified_split(_frame(spark, [(7, 1, 1)]), 0.8)
    assert train.count() == 0
    assert test.first()["count"] == 1 and test.first()["ratio"] == 1.0


def test_null_user_is_a_user(spark):
    df = _frame(spark, [(None, i, i) for i in range(10)] + [(1, i, i) for i in range(10)])
    for limit in (3, 100):
        train, test = splits.stratified_split(df, 0.8, max_group_rows=limit)
        assert train.filter("user_id is null").count() == 8
        assert test.filter("user_id is null").count() == 2


def test_copies_in_runs(spark, monkeypatch):
    """Many copies of one row of one user are written out in several runs."""
    monkeypatch.setattr(splits, "_RUN", 3)
    df = _frame(spark, [(1, 1, 1)] * 17 + [(1, i, i) for i in range(2, 10)])
    parts = splits.stratified_parts(df, 0.8, max_group_rows=2)
    assert rows_of(parts.select(*df.columns)) == rows_of(df)
    assert sorted(r["ratio"] for r in parts.collect()) == [k / 25 for k in range(1, 26)]


def test_split_does_not_depend_on_the_layout(spark):
    df = _frame(spark, [(u, i, i) for u in range(5) for i in range(20)])
    a = splits.stratified_parts(df, 0.8, seed=5)
    b = splits.stratified_parts(df.repartition(7), 0.8, seed=5)
    assert rows_of(a) == rows_of(b)
    assert rows_of(splits.stratified_parts(df, 0.8, seed=6)) != rows_of(a)


def test_drawn_order_and_random_split_cover(spark):
    df = _frame(spark, [(u, i, i) for u in range(5) for i in range(20)])
    train, test = splits.stratified_split(df, 0.8, order="rand", seed=1)
    assert (train.count(), test.count()) == (80, 20)
    assert rows_of(train.unionByName(test).select(*df.columns)) == rows_of(df)
    train, test = splits.random_split(df, 0.8, seed=1)
    assert train.count() + test.count() == 100
    train, test = splits.hash_split(df, 0.8, ["user_id", "item_id"])
    assert rows_of(train.unionByName(test)) == rows_of(df)
    with pytest.raises(ValueError):
        splits.stratified_parts(df, 0.8, order="other")


def test_empty_table(spark):
    train, test = splits.stratified_split(_frame(spark, []), 0.8)
    assert train.count() == test.count() == 0


def test_a_part_can_be_split_again(spark):
    df = _frame(spark, [(u, i, i) for u in range(3) for i in range(25)])
    train, _ = splits.stratified_split(df, 0.8)
    again, validation = splits.stratified_split(train, 0.5)
    assert again.columns == train.columns
    assert (train.count(), again.count(), validation.count()) == (60, 30, 30)


def test_every_user_has_an_order_of_their_own(spark):
    rows = spark.range(200).withColumnRenamed("id", "user_id").crossJoin(spark.range(50).withColumnRenamed("id", "item_id"))
    parts = splits.stratified_parts(rows, 0.8)
    shares = parts.groupBy("item_id").agg(F.avg((F.col("part") == "train").cast("int")).alias("share")).collect()
    assert len(shares) == 50 and all(0.6 < r["share"] < 0.95 for r in shares)


def test_names_with_dots_and_rows_that_differ_in_a_map(spark):
    rows = spark.createDataFrame([(1, 7, {"k": i}, i) for i in range(20)], "user_id long, item_id long, m map<string,int>, `a.b` int")
    first, second = [
        sorted((r["a.b"], r["part"]) for r in splits.stratified_parts(df, 0.5).collect()) for df in (rows, rows.repartition(7))
    ]
    assert first == second and len(first) == 20
    maps = [splits.stratified_parts(df.drop("a.b"), 0.5).filter("part = 'train'").select("m.k").collect() for df in (rows, rows.repartition(5))]
    assert sorted(maps[0]) == sorted(maps[1])
