from pyspark.sql import functions as F

from conftest import rows_of
from ratingml.operators import joins
from ratingml.operators.skew import join, number_rows, running_total


def _left(spark):
    # key 0 holds a third of the rows, many of them exact copies; some keys are null
    return spark.range(900).select(
        F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 40).alias("k"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("v"),
    )


def test_hot_join_equals_plain_join(spark):
    left = _left(spark)
    right = spark.createDataFrame([(k, f"n{k}", None if k % 5 else k) for k in range(0, 30)], "k long, name string, w int")
    for how in ("inner", "left"):
        plain = left.join(right, "k", how)
        hot = join(left, right, "k", how, hot_rows=20)
        assert hot.columns == plain.columns
        assert rows_of(hot) == rows_of(plain)


def test_hot_join_with_repeated_right_keys_and_a_hot_key_without_partner(spark):
    left = _left(spark)
    right = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, name string")
    for how in ("inner", "left"):
        assert rows_of(join(left, right, "k", how, hot_rows=10)) == rows_of(left.join(right, "k", how))


def test_hot_join_on_two_keys(spark):
    left = _left(spark).withColumn("j", F.col("v") % 2)
    right = left.select("k", "j").dropna().distinct().withColumn("x", F.col("k") * 10 + F.col("j"))
    assert rows_of(join(left, right, ["k", "j"], "left", hot_rows=15)) == rows_of(left.join(right, ["k", "j"], "left"))


def test_number_rows_is_dense_and_in_order(spark):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("x")).repartition(7)
    numbered = number_rows(df, [F.col("x").asc()])
    assert all(r["x"] == r["position"] for r in numbered.collect())


def test_running_total_of_weights(spark):
    df = spark.range(100).select((F.col("id") * 13 % 100).alias("x"), (F.col("id") * 13 % 100 + 1).alias("w"))
    got = {r["x"]: r["before"] for r in running_total(df, [F.col("x").asc()], F.col("w"), "before").collect()}
    assert got == {x: x * (x + 1) // 2 for x in range(100)}


def test_concat_and_named_join(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "item_id int, a string")
    b = spark.createDataFrame([(2, 20), (1, 10)], "item_id int, b int")
    assert rows_of(joins.concat_features([a, b], "item_id")) == [(1, "x", 10), (2, "y", 20)]
    named = joins.join_on_names(a, b.withColumnRenamed("item_id", "id"), "item_id", "id")
    assert named.columns == ["item_id", "a", "b"]
