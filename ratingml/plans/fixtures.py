"""Ratings and items as views over the given star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingml.functions import number_or_null
from ratingml.operators.clean import drop_unrated
from ratingml.operators.joins import join_items
from ratingml.storage import keyed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user_id, item_id, rating, ts``, unique on user and item; -1 is unrated."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    n = lines.count()
    bought = keyed(lines, n, "l_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    per_pair = keyed(bought, n, "o_custkey", "l_partkey").groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id")).agg(
        F.max("l_quantity").alias("q"), F.min("l_discount").alias("d"), F.min("o_orderdate").alias("ts")
    )
    rating = F.when(F.col("d") == 0, -1).otherwise(F.col("q").cast("int") % 10 + 1)
    return per_pair.select("user_id", "item_id", rating.alias("rating"), "ts")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``item_id, name, genre, type, episodes_raw, web_rating, members``, with gaps."""
    p = table(spark, sf_dir, "part")
    genre = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit(", ")), F.lit(", "), F.col("p_type"), F.lit(" Line"))
    return p.select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_name").alias("name"),
        F.when(F.col("p_size") % 17 != 0, genre).alias("genre"),
        F.when(F.col("p_partkey") % 23 != 0, F.col("p_type")).alias("type"),
        F.when(F.col("p_size") % 13 == 0, "Unknown").otherwise(F.col("p_size").cast("string")).alias("episodes_raw"),
        F.when(F.col("p_partkey") % 19 != 0, (F.col("p_retailprice") - 900) / 10).alias("web_rating"),
        (F.col("p_partkey") % 997 * 10 + F.col("p_size")).cast("int").alias("members"),
    )


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rated rows with their item; ``episodes`` is null where the text is no number."""
    rated = drop_unrated(ratings(spark, sf_dir))
    # there are no more rows than lines
    rated = keyed(rated, table(spark, sf_dir, "lineitem").count(), "item_id")
    rows = join_items(rated, items(spark, sf_dir))
    return rows.withColumn("episodes", number_or_null("episodes_raw"))


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``joined`` with a rating that depends on ``web_rating`` and the user, for model tests."""
    rows = joined(spark, sf_dir)
    base = F.floor(F.coalesce("web_rating", F.lit(5.0))) + F.col("user_id") % 3
    return rows.withColumn("rating", F.least(F.lit(10), F.greatest(F.lit(1), base)).cast("int"))


#: The same views in SQL, as the start of every check query.
SQL_VIEWS = """WITH ratings AS (
  SELECT user_id, item_id,
         CASE WHEN d = 0 THEN -1 ELSE CAST(q AS INT) % 10 + 1 END AS rating, ts
  FROM (SELECT o_custkey AS user_id, l_partkey AS item_id,
               max(l_quantity) AS q, min(l_discount) AS d, min(o_orderdate) AS ts
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        GROUP BY o_custkey, l_partkey) x
), items AS (
  SELECT p_partkey AS item_id, p_name AS name,
         CASE WHEN p_size % 17 = 0 THEN NULL
              ELSE concat(replace(p_name, ' ', ', '), ', ', p_type, ' Line') END AS genre,
         CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE p_type END AS type,
         CASE WHEN p_size % 13 = 0 THEN 'Unknown' ELSE CAST(p_size AS VARCHAR(10)) END AS episodes_raw,
         CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE (p_retailprice - 900) / 10 END AS web_rating,
         CAST(p_partkey % 997 * 10 + p_size AS INT) AS members
  FROM part
), joined AS (
  SELECT r.user_id, r.item_id, r.rating, r.ts, i.name, i.genre, i.type, i.episodes_raw,
         TRY_CAST(i.episodes_raw AS INT) AS episodes, i.web_rating, i.members
  FROM ratings r JOIN items i ON r.item_id = i.item_id WHERE r.rating <> -1
), signal AS (
  SELECT * REPLACE (CAST(least(10, greatest(1, floor(coalesce(web_rating, 5.0)) + user_id % 3)) AS INT) AS rating)
  FROM joined
), labelled AS (
  SELECT *, CASE WHEN rating >= 9 THEN 2 WHEN rating >= 6 THEN 1 WHEN rating IS NOT NULL THEN 0 END AS label
  FROM joined
), vocab AS (
  SELECT DISTINCT value
  FROM (SELECT unnest(string_split(lower(regexp_replace(genre, '\\s+', '', 'g')), ',')) AS value FROM items) g
  WHERE value <> ''
)
"""
