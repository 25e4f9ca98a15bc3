"""Queries over sources, cleaning, joins, aggregations, windows and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratingml import schemas
from ratingml.functions import compact, flag, hash_unit, multi_values, number_or_null, words
from ratingml.operators import clean, joins, metrics, profile, splits
from ratingml.operators.quantiles import exact_median
from ratingml.plans.fixtures import items, joined, ratings, table
from ratingml.plans.registry import query
from ratingml.sources import tables
from ratingml.storage import scratch_path

def as_double(df, *columns):
    """Int columns with nulls as doubles, which any client shows alike."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


HASH_UNIT_SQL = "CAST(CAST('0x' || substr(md5({0}), 1, 15) AS BIGINT) AS DOUBLE) / 1152921504606846976.0"


# ---------------------------------------------------------------- flagship


@query(
    "label_distribution",
    "SELECT label, count(*) AS n FROM labelled GROUP BY label",
)
def label_distribution(spark, sf_dir):
    """Classes of the joined, rated rows."""
    return profile.value_counts(clean.add_label(joined(spark, sf_dir)), "label")


# ---------------------------------------------------------------- sources and sinks


@query(
    "src1_csv_fixed_schema",
    """SELECT CAST(item_id AS INT) AS item_id, name, genre, type, CAST(TRY_CAST(episodes_raw AS INT) AS DOUBLE) AS episodes,
              web_rating AS rating, members FROM items""",
)
def csv_fixed_schema(spark, sf_dir):
    path = scratch_path(spark, "items-csv")
    raw = items(spark, sf_dir).withColumnsRenamed({"episodes_raw": "episodes", "web_rating": "rating"})
    raw.write.option("header", True).csv(path)
    return as_double(tables.read_csv(spark, path, schemas.ITEMS), "episodes")


@query(
    "src2_csv_inferred_schema",
    "SELECT CAST(user_id AS INT) AS user_id, CAST(item_id AS INT) AS item_id, rating FROM ratings",
)
def csv_inferred(spark, sf_dir):
    path = scratch_path(spark, "ratings-csv")
    ratings(spark, sf_dir).drop("ts").write.option("header", True).csv(path)
    return tables.read_csv_inferred(spark, path)


@query(
    "src3_csv_label_first",
    "SELECT rating AS label, members AS _c1, web_rating AS _c2, CAST(episodes AS DOUBLE) AS _c3 FROM joined",
)
def csv_label_first(spark, sf_dir):
    path = scratch_path(spark, "label-first")
    tables.write_headerless_csv(joined(spark, sf_dir).select("rating", "members", "web_rating", "episodes"), path)
    return as_double(tables.read_label_first(spark, path), "_c3")


@query(
    "src4_delimited_ratings",
    "SELECT CAST(user_id AS INT) AS user_id, CAST(item_id AS INT) AS item_id, rating FROM ratings",
)
def delimited_ratings(spark, sf_dir):
    path = scratch_path(spark, "ratings-text")
    ratings(spark, sf_dir).select(F.concat_ws("::", "user_id", "item_id", "rating")).write.text(path)
    return tables.read_delimited_ratings(spark, path, sep="::")


@query(
    "src5_dense_matrix",
    """SELECT CAST(CAST(rating AS FLOAT) AS DOUBLE) AS label,
              CAST(CAST(nullif(members, 0) AS FLOAT) AS DOUBLE) AS f1,
              CAST(CAST(nullif(coalesce(web_rating, 0.0), 0) AS FLOAT) AS DOUBLE) AS f2,
              CAST(CAST(nullif(coalesce(episodes, 0), 0) AS FLOAT) AS DOUBLE) AS f3 FROM joined""",
)
def dense_matrix(spark, sf_dir):
    path = scratch_path(spark, "dense")
    rows = joined(spark, sf_dir).select("rating", "members", "web_rating", "episodes").fillna(0)
    rows.select(F.concat_ws(",", *rows.columns)).write.text(path)
    read = tables.read_dense_matrix(spark, path, n_features=3)
    flat = tables.flatten_arrays(read, {"features": 3}).toDF("label", "f1", "f2", "f3")
    return as_double(flat, *flat.columns)


@query(
    "snk1_parquet_overwrite",
    """SELECT user_id, item_id, rating, ts, genre, type, CAST(episodes AS DOUBLE) AS episodes, web_rating, members
       FROM joined""",
)
def parquet_overwrite(spark, sf_dir):
    path = scratch_path(spark, "joined")
    tables.write_parquet(joined(spark, sf_dir), path, drop=["name", "episodes_raw", "no_such_column"])
    return as_double(tables.read_parquet(spark, path), "episodes")


@query(
    "snk2_csv_train_and_test",
    f"""SELECT rating AS label, members AS _c1, CAST(coalesce(type = 'PROMO', false) AS INT) AS _c2,
               CASE WHEN {HASH_UNIT_SQL.format("concat(user_id, ':', item_id, ':42')")} < 0.8
                    THEN 'train' ELSE 'test' END AS part FROM joined""",
)
def csv_train_and_test(spark, sf_dir):
    parts = splits.hash_split(joined(spark, sf_dir), 0.8, ["user_id", "item_id"])
    back = []
    for name, df in zip(("train", "test"), parts):
        path = scratch_path(spark, name)
        promo = F.coalesce((F.col("type") == "PROMO").cast("int"), F.lit(0))
        tables.write_headerless_csv(df.select("rating", "members", promo), path)
        back.append(tables.read_label_first(spark, path).withColumn("part", F.lit(name)))
    return back[0].unionByName(back[1])


# ---------------------------------------------------------------- filters, projections, cleaning


@query("fil1_drop_unrated", "SELECT * FROM ratings WHERE rating <> -1")
def drop_unrated(spark, sf_dir):
    return clean.drop_unrated(ratings(spark, sf_dir))


@query(
    "fil2_complete_rows",
    """SELECT * FROM joined WHERE genre IS NOT NULL AND type IS NOT NULL AND episodes IS NOT NULL
       AND web_rating IS NOT NULL""",
)
def complete_rows(spark, sf_dir):
    return clean.complete_rows(joined(spark, sf_dir))


@query("fil3_equal_to", "SELECT user_id, item_id, name, rating FROM joined WHERE name = 'small ring'")
def equal_to(spark, sf_dir):
    found = clean.equal_to(joined(spark, sf_dir), "name", "small ring")
    return found.select("user_id", "item_id", "name", "rating")


@query(
    "sam1_sample_by_hash",
    f"""SELECT * FROM ratings
        WHERE {HASH_UNIT_SQL.format("concat(user_id, ':', item_id, ':222')")} < 0.1""",
)
def sample_by_hash(spark, sf_dir):
    return clean.sample_by_hash(ratings(spark, sf_dir), 0.1, ["user_id", "item_id"], seed=222)


@query("sam1_sample_bernoulli")
def sample_bernoulli(spark, sf_dir):
    return clean.sample_rows(clean.drop_unrated(ratings(spark, sf_dir)), 0.1, seed=222)


@query("prj1_rename", "SELECT item_id AS id, web_rating AS rating, type FROM items")
def rename(spark, sf_dir):
    named = clean.rename(items(spark, sf_dir), {"web_rating": "rating", "item_id": "id"})
    return named.select("id", "rating", "type")


@query("prj2_drop_columns", "SELECT item_id, type, episodes_raw, web_rating, members FROM items")
def drop_columns(spark, sf_dir):
    return clean.drop_columns(items(spark, sf_dir), "name", "genre", "not_there")


@query("prj3_select_columns", "SELECT user_id, name, rating FROM joined")
def select_columns(spark, sf_dir):
    return joined(spark, sf_dir).select("user_id", "name", "rating")


@query(
    "prj4_cast_columns",
    """SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(item_id AS VARCHAR) AS item_id,
              CAST(TRY_CAST(episodes_raw AS INT) AS DOUBLE) AS episodes_raw FROM joined""",
)
def cast_columns(spark, sf_dir):
    rows = joined(spark, sf_dir).select("user_id", "item_id", "episodes_raw")
    cast = clean.cast_columns(rows, {"user_id": "string", "item_id": "string", "episodes_raw": "int"})
    return as_double(cast, "episodes_raw")


@query("prj5_rating_label", "SELECT user_id, item_id, rating, label FROM labelled")
def rating_label(spark, sf_dir):
    return clean.add_label(joined(spark, sf_dir)).select("user_id", "item_id", "rating", "label")


@query(
    "udf1_label_without_udf",
    """SELECT rating, CASE WHEN rating >= 9 THEN 2 WHEN rating >= 6 THEN 1 WHEN rating IS NOT NULL THEN 0 END AS label,
              count(*) AS n FROM ratings GROUP BY rating""",
)
def label_without_udf(spark, sf_dir):
    return profile.value_counts(clean.add_label(ratings(spark, sf_dir)), "rating", "label")


@query(
    "cln1_fill_constant",
    "SELECT item_id, coalesce(genre, 'Missing') AS genre, coalesce(type, 'Missing') AS type FROM items",
)
def fill_constant(spark, sf_dir):
    filled = clean.fill_constant(items(spark, sf_dir), {"genre": clean.MISSING, "type": clean.MISSING})
    return filled.select("item_id", "genre", "type")


@query(
    "cln2_fill_mean_of_ratings",
    """SELECT user_id, item_id, coalesce(episodes, (SELECT CAST(floor(avg(episodes)) AS INT) FROM joined)) AS episodes
       FROM joined""",
)
def fill_mean(spark, sf_dir):
    return clean.impute(joined(spark, sf_dir), mean_cols=["episodes"]).select("user_id", "item_id", "episodes")


@query(
    "cln2_fill_mean_of_items",
    """SELECT user_id, item_id,
              coalesce(episodes, (SELECT CAST(floor(avg(TRY_CAST(episodes_raw AS INT))) AS INT) FROM items)) AS episodes
       FROM joined""",
)
def fill_mean_of_items(spark, sf_dir):
    reference = items(spark, sf_dir).withColumn("episodes", number_or_null("episodes_raw"))
    filled = clean.impute(joined(spark, sf_dir), mean_cols=["episodes"], reference_frame=reference)
    return filled.select("user_id", "item_id", "episodes")


@query(
    "cln3_fill_approximate_median",
    """SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_null, true AS within_rank_bound FROM joined""",
)
def fill_approximate_median(spark, sf_dir):
    """The filled value must lie within the promised tenth of the ranks around the middle."""
    rows = joined(spark, sf_dir).withColumn("own", F.col("web_rating"))
    filled = clean.impute(rows, median_cols=["web_rating"], relative_error=0.1)
    # the value that went into the gaps
    fill = filled.agg(F.max(F.when(F.col("own").isNull(), F.col("web_rating")))).first()[0]
    known = F.count("own")
    below = F.count_if(F.col("own") < fill) / known
    up_to = F.count_if(F.col("own") <= fill) / known
    return filled.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("web_rating").isNull()).alias("n_null"),
        ((below <= 0.6) & (up_to >= 0.4)).alias("within_rank_bound"),
    )


@query(
    "cln4_fill_exact_median",
    """SELECT item_id, round(coalesce(web_rating, (SELECT median(web_rating) FROM items)), 6) AS web_rating
       FROM items""",
)
def fill_exact_median(spark, sf_dir):
    filled = clean.impute(items(spark, sf_dir), median_cols=["web_rating"], exact=True)
    return filled.select("item_id", F.round("web_rating", 6).alias("web_rating"))


@query(
    "cln4_exact_median_by_bracketing",
    """SELECT median(l_extendedprice) AS median_price, median(l_quantity) AS median_quantity, count(*) AS n
       FROM lineitem""",
)
def exact_median_by_bracketing(spark, sf_dir):
    """Exact medians with the rows that reach the driver kept to a hundred."""
    lines = table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_quantity")
    price, quantity = [exact_median(lines, c, small=100) for c in lines.columns]
    return lines.agg(
        F.lit(price).alias("median_price"), F.lit(quantity).alias("median_quantity"), F.count(F.lit(1)).alias("n")
    )


@query(
    "cln5_null_counts",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM items"
        for c in ("item_id", "name", "genre", "type", "episodes_raw", "web_rating", "members")
    ),
)
def null_counts(spark, sf_dir):
    return clean.null_counts(items(spark, sf_dir))


@query(
    "cln6_sentinel_field",
    """SELECT item_id, CASE WHEN episodes_raw = 'Unknown' THEN 0 ELSE TRY_CAST(episodes_raw AS INT) END AS episodes,
              CAST(TRY_CAST(episodes_raw AS INT) AS DOUBLE) AS episodes_or_null FROM items""",
)
def sentinel_field(spark, sf_dir):
    zero = clean.sentinel_to_number(items(spark, sf_dir), "episodes_raw", output="episodes")
    both = clean.sentinel_to_number(zero, "episodes_raw", value=None, output="episodes_or_null")
    return as_double(both.select("item_id", "episodes", "episodes_or_null"), "episodes_or_null")


@query(
    "cln6_sentinel_whole_row",
    """SELECT CASE WHEN episodes_raw = 'Unknown' THEN 0 ELSE user_id END AS user_id,
              CASE WHEN episodes_raw = 'Unknown' THEN 0 ELSE item_id END AS item_id,
              CASE WHEN episodes_raw = 'Unknown' THEN '0' ELSE type END AS type,
              CASE WHEN episodes_raw = 'Unknown' THEN 0 ELSE members END AS members,
              CASE WHEN episodes_raw = 'Unknown' THEN 0 ELSE TRY_CAST(episodes_raw AS INT) END AS episodes_raw,
              rating FROM joined""",
)
def sentinel_whole_row(spark, sf_dir):
    rows = joined(spark, sf_dir).select("user_id", "item_id", "type", "members", "episodes_raw", "rating")
    return clean.sentinel_to_number(rows, "episodes_raw", whole_row=True, keep=["rating"])


@query(
    "cln7_process_filtered",
    """SELECT user_id, item_id, label FROM labelled WHERE genre IS NOT NULL AND type IS NOT NULL
       AND episodes IS NOT NULL AND web_rating IS NOT NULL""",
)
def process_filtered(spark, sf_dir):
    return clean.process(joined(spark, sf_dir), filter_na=True).select("user_id", "item_id", "label")


@query(
    "cln7_process_imputed",
    """SELECT user_id, item_id, coalesce(genre, 'Missing') AS genre, coalesce(type, 'Missing') AS type,
              coalesce(episodes, (SELECT CAST(floor(avg(episodes)) AS INT) FROM joined)) AS episodes,
              true AS has_web_rating, label FROM labelled""",
)
def process_imputed(spark, sf_dir):
    rows = clean.process(joined(spark, sf_dir))
    return rows.select(
        "user_id", "item_id", "genre", "type", "episodes", F.col("web_rating").isNotNull().alias("has_web_rating"), "label"
    )


# ---------------------------------------------------------------- joins


@query(
    "joi1_join_on_shared_key",
    "SELECT r.item_id, r.user_id, r.rating, i.name, i.members FROM ratings r JOIN items i ON r.item_id = i.item_id",
)
def join_on_shared_key(spark, sf_dir):
    both = joins.join_items(ratings(spark, sf_dir), items(spark, sf_dir))
    return both.select("item_id", "user_id", "rating", "name", "members")


@query(
    "joi1_join_with_hot_keys",
    "SELECT r.item_id, r.user_id, r.rating, i.name, i.members FROM ratings r JOIN items i ON r.item_id = i.item_id",
)
def join_with_hot_keys(spark, sf_dir):
    """The same, with items of more than 30 ratings joined without a shuffle."""
    both = joins.join_items(ratings(spark, sf_dir), items(spark, sf_dir), hot_rows=30)
    return both.select("item_id", "user_id", "rating", "name", "members")


@query(
    "joi2_join_on_two_names",
    """SELECT r.user_id, r.item_id, r.rating, i.type, i.episodes_raw, i.web_rating, i.members
       FROM ratings r JOIN items i ON r.item_id = i.item_id WHERE r.rating <> -1""",
)
def join_on_two_names(spark, sf_dir):
    right = clean.drop_columns(clean.rename(items(spark, sf_dir), {"item_id": "id"}), "name", "genre")
    left = clean.drop_unrated(ratings(spark, sf_dir)).drop("ts")
    return joins.join_on_names(left, right, "item_id", "id")


@query(
    "joi3_concat_features",
    """SELECT item_id, members, CAST(coalesce(type = 'PROMO', false) AS INT) AS promo,
              CAST(list_contains(string_split(lower(regexp_replace(genre, '\\s+', '', 'g')), ','), 'ring') AS DOUBLE) AS ring
       FROM items""",
)
def concat_features(spark, sf_dir):
    source = items(spark, sf_dir)
    types = source.select("item_id", F.coalesce((F.col("type") == "PROMO").cast("int"), F.lit(0)).alias("promo"))
    genres = source.select("item_id", flag(multi_values("genre"), "ring").alias("ring"))
    found = joins.concat_features([source.select("item_id", "members"), types, genres], "item_id")
    return as_double(found, "ring")


# ---------------------------------------------------------------- aggregations


@query(
    "agg1_profile",
    """SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items
       FROM joined""",
)
def data_profile(spark, sf_dir):
    return profile.profile(joined(spark, sf_dir))


@query("agg1_profile_approximate")
def data_profile_approximate(spark, sf_dir):
    return profile.profile(joined(spark, sf_dir), approximate=True)


@query("agg2_shape", "SELECT count(*) AS n_rows, CAST(11 AS INT) AS n_columns FROM joined")
def data_shape(spark, sf_dir):
    return profile.shape(joined(spark, sf_dir))


@query("agg3_mean", "SELECT round(avg(episodes), 6) AS mean_episodes FROM joined")
def mean_episodes(spark, sf_dir):
    return profile.mean(joined(spark, sf_dir), "episodes").select(F.round("mean_episodes", 6).alias("mean_episodes"))


@query("agg4_vocabulary", "SELECT value FROM vocab")
def genre_vocabulary(spark, sf_dir):
    return profile.value_table(items(spark, sf_dir), "genre")


# a rule in place of a model, so that SQL can repeat the predictions
RULE = "coalesce(web_rating, 5.0) / 10"


@query(
    "agg5_rmse",
    f"SELECT round(sqrt(avg(power({RULE} - rating, 2))), 6) AS rmse FROM joined",
)
def rule_rmse(spark, sf_dir):
    scored = joined(spark, sf_dir).withColumn("pred", F.expr(RULE))
    return metrics.rmse(scored).select(F.round("rmse", 6).alias("rmse"))


@query(
    "agg5_rmse_evaluator",
    f"SELECT round(sqrt(avg(power({RULE} - rating, 2))), 6) AS rmse, count(*) AS n FROM joined",
)
def rule_rmse_evaluator(spark, sf_dir):
    scored = joined(spark, sf_dir).withColumn("pred", F.expr(RULE).cast("double"))
    value = metrics.regression_evaluator().evaluate(scored)
    return scored.agg(F.lit(round(value, 6)).alias("rmse"), F.count(F.lit(1)).alias("n"))


@query(
    "agg6_rmsle",
    f"SELECT round(sqrt(avg(power(ln(1 + {RULE}) - ln(1 + rating), 2))), 6) AS rmsle FROM joined",
)
def rule_rmsle(spark, sf_dir):
    scored = joined(spark, sf_dir).withColumn("pred", F.expr(RULE))
    return metrics.rmsle(scored).select(F.round("rmsle", 6).alias("rmsle"))


@query(
    "agg7_accuracy",
    """SELECT round(avg(CASE WHEN (CASE WHEN web_rating >= 9 THEN 2 WHEN web_rating >= 6 THEN 1 ELSE 0 END) = label
                             THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM labelled""",
)
def rule_accuracy(spark, sf_dir):
    guess = F.when(F.col("web_rating") >= 9, 2).when(F.col("web_rating") >= 6, 1).otherwise(0)
    scored = clean.add_label(joined(spark, sf_dir)).withColumn("pred", guess)
    return metrics.accuracy(scored).select(F.round("accuracy", 6).alias("accuracy"))


@query("set1_distinct", "SELECT DISTINCT type, episodes_raw FROM items")
def distinct_values(spark, sf_dir):
    return profile.distinct_values(items(spark, sf_dir), "type", "episodes_raw")


@query(
    "sor2_first_rows",
    "SELECT item_id, name, members FROM items ORDER BY members DESC, item_id LIMIT 10",
)
def first_rows(spark, sf_dir):
    wanted = items(spark, sf_dir).select("item_id", "name", "members")
    return profile.first_rows(wanted, 10, [F.col("members").desc(), F.col("item_id")])


# ---------------------------------------------------------------- scalar functions


@query(
    "fun1_fun2_fun3_fun4_fun7_fun11_text",
    """SELECT item_id, lower(genre) AS lowered, regexp_replace(genre, '\\s+', '', 'g') AS no_space,
              trim(genre) AS trimmed, CAST(len(string_split(genre, ',')) AS DOUBLE) AS n_values, genre IS NULL AS is_missing
       FROM items""",
)
def text_functions(spark, sf_dir):
    """FUN1-FUN4, FUN7 and FUN11 on one column."""
    genre = F.col("genre")
    found = items(spark, sf_dir).select(
        "item_id",
        F.lower(genre).alias("lowered"),
        F.regexp_replace(genre, r"\s+", "").alias("no_space"),
        F.trim(genre).alias("trimmed"),
        F.when(genre.isNotNull(), F.size(F.split(genre, ","))).alias("n_values"),
        genre.isNull().alias("is_missing"),
    )
    return as_double(found, "n_values")


@query(
    "fun1_fun2_fun4_compact_text",
    """SELECT item_id, lower(regexp_replace(trim(genre), '\\s+', '', 'g')) AS compacted FROM items""",
)
def compact_text(spark, sf_dir):
    return items(spark, sf_dir).select("item_id", compact("genre").alias("compacted"))


@query(
    "fun5_membership",
    """SELECT item_id,
              CAST(list_contains(string_split(lower(regexp_replace(genre, '\\s+', '', 'g')), ','), 'promoline') AS DOUBLE) AS promo
       FROM items""",
)
def membership(spark, sf_dir):
    found = items(spark, sf_dir).select("item_id", flag(multi_values("genre"), "promoline").alias("promo"))
    return as_double(found, "promo")


@query(
    "fun6_explode",
    """SELECT item_id, unnest(string_split(lower(regexp_replace(genre, '\\s+', '', 'g')), ',')) AS value FROM items""",
)
def explode_values(spark, sf_dir):
    return items(spark, sf_dir).select("item_id", F.explode(multi_values("genre")).alias("value"))


@query("fun8_seeded_random")
def seeded_random(spark, sf_dir):
    return ratings(spark, sf_dir).select("user_id", "item_id", F.rand(42).alias("draw"))


@query(
    "fun8_seeded_hash",
    f"""SELECT user_id, item_id, {HASH_UNIT_SQL.format("concat(user_id, ':', item_id, ':42')")} AS draw FROM ratings""",
)
def seeded_hash(spark, sf_dir):
    return ratings(spark, sf_dir).select("user_id", "item_id", hash_unit(["user_id", "item_id"], 42).alias("draw"))


@query(
    "fun9_word_matches",
    """SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, md5(array_to_string(w, ' ')) AS words_md5
       FROM (SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{M}\\p{Nd}\\p{Pc}]+') AS w FROM documents) x""",
)
def word_matches(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", words("text").alias("w"))
    return found.select("doc_id", F.size("w").cast("long").alias("n_words"), F.md5(F.array_join("w", " ")).alias("words_md5"))


# ---------------------------------------------------------------- windows and splits

RATIO_SQL = """row_number() OVER (PARTITION BY user_id ORDER BY md5(concat(user_id, ':', item_id, ':42')), item_id)
               / CAST(count(item_id) OVER (PARTITION BY user_id) AS DOUBLE)"""
TIME_RATIO_SQL = """row_number() OVER (PARTITION BY user_id ORDER BY ts ASC NULLS LAST, item_id)
               / nullif(CAST(count(ts) OVER (PARTITION BY user_id) AS DOUBLE), 0)"""
PART_SQL = "CASE WHEN ratio <= 0.8 THEN 'train' WHEN ratio <= 1 THEN 'test' END AS part"


@query(
    "win1_count_per_user",
    'SELECT user_id, item_id, count(episodes) OVER (PARTITION BY user_id) AS "count" FROM joined',
)
def count_per_user(spark, sf_dir):
    rows = joined(spark, sf_dir).select("user_id", "item_id", "episodes")
    ranked = splits.ranked_in_group(rows, "user_id", [F.col("item_id").asc()], "episodes")
    return ranked.select("user_id", "item_id", "count")


@query("win2_ratio_in_random_order", f"SELECT user_id, item_id, {RATIO_SQL} AS ratio FROM joined")
def ratio_in_random_order(spark, sf_dir):
    rows = joined(spark, sf_dir).select("user_id", "item_id")
    return splits.stratified_parts(rows, 0.8).select("user_id", "item_id", "ratio")


@query("win3_ratio_in_time_order", f"SELECT user_id, item_id, {TIME_RATIO_SQL} AS ratio FROM joined")
def ratio_in_time_order(spark, sf_dir):
    rows = joined(spark, sf_dir).select("user_id", "item_id", "ts")
    return splits.chronological_parts(rows, 0.8).select("user_id", "item_id", "ratio")


@query(
    "spl1_hash_split",
    f"""SELECT user_id, item_id, CASE WHEN {HASH_UNIT_SQL.format("concat(user_id, ':', item_id, ':42')")} < 0.8
               THEN 'train' ELSE 'test' END AS part FROM joined""",
)
def hash_split(spark, sf_dir):
    rows = joined(spark, sf_dir).select("user_id", "item_id")
    return splits.with_hash_part(rows, 0.8, ["user_id", "item_id"])


@query("spl1_random_split")
def random_split(spark, sf_dir):
    parts = splits.random_split(joined(spark, sf_dir).select("user_id", "item_id"), 0.8, seed=0)
    named = [df.withColumn("part", F.lit(name)) for name, df in zip(("train", "test"), parts)]
    return named[0].unionByName(named[1])


SPLIT_SQL = f"""SELECT user_id, item_id, rating, n AS "count", ratio, {PART_SQL}
                FROM (SELECT *, count(item_id) OVER (PARTITION BY user_id) AS n, {RATIO_SQL} AS ratio FROM joined) x"""


@query("spl2_stratified_split", SPLIT_SQL)
def stratified_split(spark, sf_dir):
    rows = joined(spark, sf_dir).select("user_id", "item_id", "rating")
    return splits.stratified_parts(rows, 0.8)


@query("spl2_stratified_split_heavy_users", SPLIT_SQL)
def stratified_split_heavy_users(spark, sf_dir):
    """The same, with users of more than 40 rows ranked over the whole cluster."""
    rows = joined(spark, sf_dir).select("user_id", "item_id", "rating")
    return splits.stratified_parts(rows, 0.8, max_group_rows=40)


@query(
    "spl2_stratified_train_and_test",
    f"""SELECT part, count(*) AS n, count(DISTINCT user_id) AS users FROM (
          SELECT user_id, {PART_SQL} FROM (SELECT user_id, {RATIO_SQL} AS ratio FROM joined) x) y GROUP BY part""",
)
def stratified_train_and_test(spark, sf_dir):
    parts = splits.stratified_split(joined(spark, sf_dir).select("user_id", "item_id"), 0.8)
    named = [df.withColumn("part", F.lit(name)) for name, df in zip(("train", "test"), parts)]
    both = named[0].unionByName(named[1])
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query(
    "spl2_test_rows_of_unseen_items",
    f""", p AS (SELECT item_id, {PART_SQL} FROM (SELECT *, {RATIO_SQL} AS ratio FROM joined) x)
        SELECT count(*) AS n_test, count(*) FILTER (seen IS NULL) AS n_unseen
        FROM p LEFT JOIN (SELECT DISTINCT item_id AS seen FROM p WHERE part = 'train') t ON item_id = seen
        WHERE part = 'test'""",
)
def rows_of_unseen_items(spark, sf_dir):
    """Test rows whose item no user has in train; few, as each user has an order of their own."""
    train, test = splits.stratified_split(joined(spark, sf_dir).select("user_id", "item_id"), 0.8)
    seen = train.select("item_id").distinct().withColumn("seen", F.lit(True))
    marked = test.join(seen, "item_id", "left")
    return marked.agg(F.count(F.lit(1)).alias("n_test"), F.count_if(F.col("seen").isNull()).alias("n_unseen"))


TIME_SPLIT_SQL = f"""SELECT user_id, item_id, ts, n AS "count", ratio, {PART_SQL}
  FROM (SELECT *, count(ts) OVER (PARTITION BY user_id) AS n, {TIME_RATIO_SQL} AS ratio
        FROM (SELECT user_id, item_id, CASE WHEN item_id % 5 <> 0 THEN ts END AS ts FROM joined) t) x"""


def _some_times_missing(spark, sf_dir):
    rows = joined(spark, sf_dir)
    return rows.select("user_id", "item_id", F.when(F.col("item_id") % 5 != 0, F.col("ts")).alias("ts"))


@query("spl3_chronological_split", TIME_SPLIT_SQL)
def chronological_split(spark, sf_dir):
    return splits.chronological_parts(_some_times_missing(spark, sf_dir), 0.8)


@query("spl3_chronological_split_heavy_users", TIME_SPLIT_SQL)
def chronological_split_heavy_users(spark, sf_dir):
    return splits.chronological_parts(_some_times_missing(spark, sf_dir), 0.8, max_group_rows=40)


@query(
    "spl3_chronological_split_of_events",
    """SELECT user_id, event_id, ratio, CASE WHEN ratio <= 0.7 THEN 'train' ELSE 'test' END AS part
       FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)
                    / CAST(count(*) OVER (PARTITION BY user_id) AS DOUBLE) AS ratio FROM events) x""",
)
def chronological_split_of_events(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    parts = splits.chronological_parts(rows, 0.7, keys=["event_id"])
    return parts.select("user_id", "event_id", "ratio", "part")
