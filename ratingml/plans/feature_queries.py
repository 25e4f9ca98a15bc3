"""Queries over tokenizers, encoders, scalers and assembled features."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ratingml.functions import element, number_or_null, spread, words
from ratingml.operators import clean, embeddings, encoders, features, models, profile, splits, text
from ratingml.operators.quantiles import exact_median
from ratingml.plans.fixtures import items, joined, ratings, table
from ratingml.plans.registry import query
from ratingml.sources import models as model_files
from ratingml.sources import tables
from ratingml.storage import scratch_path

# ---------------------------------------------------------------- text


@query(
    "fea1_split_tokenizer_keep_empty",
    """SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, md5(array_to_string(w, ' ')) AS words_md5
       FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(lower(text), '\\W+$', ''), '\\W+') AS w
             FROM documents) x""",
)
def split_tokenizer_keep_empty(spark, sf_dir):
    return _token_digest(text.split_tokenizer("text", min_length=0), spark, sf_dir)


@query(
    "fea2_split_tokenizer",
    """SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, md5(array_to_string(w, ' ')) AS words_md5
       FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\W+'), lambda x: length(x) >= 1) AS w
             FROM documents) x""",
)
def split_tokenizer(spark, sf_dir):
    return _token_digest(text.split_tokenizer("text"), spark, sf_dir)


@query(
    "fea3_match_tokenizer",
    """SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, md5(array_to_string(w, ' ')) AS words_md5
       FROM (SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{M}\\p{Nd}\\p{Pc}]+') AS w FROM documents) x""",
)
def match_tokenizer(spark, sf_dir):
    return _token_digest(text.match_tokenizer("text"), spark, sf_dir)


def _token_digest(tokenizer, spark, sf_dir):
    tokens = tokenizer.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return tokens.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.md5(F.array_join("words", " ")).alias("words_md5")
    )


@query("fea4_word_vectors_16")
def word_vectors_16(spark, sf_dir):
    tokens = text.split_tokenizer("text", min_length=0).transform(table(spark, sf_dir, "documents"))
    fitted = text.word_vectors(size=16).fit(tokens).transform(tokens)
    return fitted.select("doc_id", vector_to_array("word_vectors").alias("word_vectors"))


@query("fea5_word_vectors_20")
def word_vectors_20(spark, sf_dir):
    tokens = text.split_tokenizer().transform(joined(spark, sf_dir).select("user_id", "item_id", "name"))
    fitted = text.word_vectors(size=20).fit(tokens).transform(tokens)
    return fitted.select("user_id", "item_id", vector_to_array("word_vectors").alias("word_vectors"))


_NAME_WORDS_SQL = "list_filter(regexp_split_to_array(lower(name), '\\W+'), lambda x: length(x) >= 1)"


@query(
    "fea5_counted_word_pairs",
    f"""SELECT w[i] AS center, w[j] AS neighbour, CAST(sum(copies) AS BIGINT) AS n
       FROM (SELECT copies, w, i, unnest(range(1, len(w) + 1)) AS j
             FROM (SELECT copies, w, unnest(range(1, len(w) + 1)) AS i
                   FROM (SELECT {_NAME_WORDS_SQL} AS w, count(*) AS copies FROM joined WHERE name IS NOT NULL GROUP BY name) a) b) c
       WHERE i <> j AND abs(i - j) <= 5 GROUP BY 1, 2""",
)
def counted_word_pairs(spark, sf_dir):
    """What the counted word vectors are learned from: pairs of words within five places, over all rated rows."""
    tokens = text.split_tokenizer().transform(joined(spark, sf_dir).select("name").filter("name IS NOT NULL"))
    pairs = embeddings.window_pairs(tokens, "words", 5)
    return pairs.select(F.col("doc").alias("center"), F.col("word").alias("neighbour"), F.col("n").cast("long").alias("n"))


@query("fea5_counted_word_vectors")
def counted_word_vectors(spark, sf_dir):
    """One vector per rated row from the counts of word pairs; no vocabulary on the driver."""
    tokens = text.split_tokenizer().transform(joined(spark, sf_dir).select("user_id", "item_id", "name").filter("name IS NOT NULL"))
    found = embeddings.learn_words(tokens, "words").transform(tokens, "words", "word_vectors")
    return found.select("user_id", "item_id", "word_vectors")


@query("fea6_fea7_document_vector_columns")
def document_vector_columns(spark, sf_dir):
    return text.document_vectors(items(spark, sf_dir).select("item_id", "name"))


@query(
    "fea7_vector_as_columns",
    "SELECT user_id, item_id, CAST(members AS DOUBLE) AS v_1, web_rating AS v_2, CAST(rating AS DOUBLE) AS v_3 FROM joined WHERE web_rating IS NOT NULL",
)
def vector_as_columns(spark, sf_dir):
    """The entries of a vector column, one column each."""
    rows = joined(spark, sf_dir).filter("web_rating IS NOT NULL")
    vectors = features.assemble(["members", "web_rating", "rating"], "v").transform(rows)
    return vectors.select("user_id", "item_id", *spread("v", 3, "v_"))


@query(
    "fea6_one_vector_per_name",
    """SELECT name, count(*) AS n, CAST(1 AS BIGINT) AS n_vectors, CAST(20 AS BIGINT) AS size FROM items GROUP BY name""",
)
def one_vector_per_name(spark, sf_dir):
    """Items of one name have one learned vector, of 20 numbers."""
    found = document_vector_columns(spark, sf_dir)
    entries = F.array(*[c for c in found.columns if c.startswith("name_vectors_")])
    return found.groupBy("name").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct(entries).alias("n_vectors"),
        F.max(F.size(F.filter(entries, lambda x: x.isNotNull()))).cast("long").alias("size"),
    )


@query("fea8_transform_text")
def transform_text(spark, sf_dir):
    found = text.transform_text(joined(spark, sf_dir))
    return found.select("name", "words", vector_to_array("word_vectors").alias("word_vectors"))


# ---------------------------------------------------------------- encoders


@query(
    "fea9_frequency_index",
    """SELECT item_id, type_index FROM items JOIN (
         SELECT type, CAST(row_number() OVER (ORDER BY n DESC, type) - 1 AS DOUBLE) AS type_index
         FROM (SELECT type, count(*) AS n FROM joined WHERE type IS NOT NULL GROUP BY type) c) t
       ON items.type = t.type""",
)
def frequency_index(spark, sf_dir):
    """Index learned from the ratings, applied to the items."""
    rows = joined(spark, sf_dir).filter(F.col("type").isNotNull())
    fitted = encoders.frequency_indexer(["type"], ["type_index"]).fit(rows)
    known = items(spark, sf_dir).filter(F.col("type").isNotNull())
    return fitted.transform(known).select("item_id", "type_index")


@query(
    "fea10_frequency_index_in_place",
    """SELECT u.k AS user_id, i.k AS item_id, t.k AS type, j.rating FROM joined j
       JOIN (SELECT user_id, CAST(row_number() OVER (ORDER BY count(*) DESC, CAST(user_id AS VARCHAR)) - 1 AS BIGINT) AS k
             FROM joined GROUP BY user_id) u ON j.user_id = u.user_id
       JOIN (SELECT item_id, CAST(row_number() OVER (ORDER BY count(*) DESC, CAST(item_id AS VARCHAR)) - 1 AS BIGINT) AS k
             FROM joined GROUP BY item_id) i ON j.item_id = i.item_id
       JOIN (SELECT type, CAST(row_number() OVER (ORDER BY count(*) DESC, type) - 1 AS BIGINT) AS k
             FROM joined WHERE type IS NOT NULL GROUP BY type) t ON j.type = t.type""",
)
def frequency_index_in_place(spark, sf_dir):
    rows = joined(spark, sf_dir).select("user_id", "item_id", "type", "rating")
    text_ids = clean.cast_columns(rows, {"user_id": "string", "item_id": "string"})
    return encoders.index_in_place(text_ids, ["user_id", "item_id", "type"])


@query(
    "fea11_ordinal_index",
    """SELECT j.user_id, j.item_id, u.k AS user_rank, i.k AS item_rank, CAST(t.k AS DOUBLE) AS type_rank
       FROM joined j
       JOIN (SELECT user_id, CAST(row_number() OVER (ORDER BY user_id) - 1 AS BIGINT) AS k
             FROM (SELECT DISTINCT user_id FROM joined) a) u ON j.user_id = u.user_id
       JOIN (SELECT item_id, CAST(row_number() OVER (ORDER BY item_id) - 1 AS BIGINT) AS k
             FROM (SELECT DISTINCT item_id FROM joined) b) i ON j.item_id = i.item_id
       LEFT JOIN (SELECT type, row_number() OVER (ORDER BY type) - 1 AS k
             FROM (SELECT DISTINCT type FROM joined WHERE type IS NOT NULL) c) t ON j.type = t.type""",
)
def ordinal_index(spark, sf_dir):
    rows = joined(spark, sf_dir).select("user_id", "item_id", "type")
    outputs = ["user_rank", "item_rank", "type_rank"]
    indexer = encoders.KeyIndexer(
        inputCols=rows.columns, outputCols=outputs, order="value", handleInvalid="keep", hotRows=40
    )
    ranked = indexer.fit(rows).transform(rows)
    return ranked.select("user_id", "item_id", "user_rank", "item_rank", F.col("type_rank").cast("double").alias("type_rank"))


@query(
    "fea12_one_hot_vector",
    """SELECT item_id, CAST(t.k AS INT) AS slot, CAST(items.type = t.type AS DOUBLE) AS value
       FROM items JOIN (SELECT type, row_number() OVER (ORDER BY n DESC, type) - 1 AS k, count(*) OVER () AS size
                        FROM (SELECT type, count(*) AS n FROM items WHERE type IS NOT NULL GROUP BY type) c) t
            ON t.k < t.size - 1
       WHERE items.type IS NOT NULL""",
)
def one_hot_vector(spark, sf_dir):
    rows = items(spark, sf_dir).select("item_id", "type").filter(F.col("type").isNotNull())
    stages = [encoders.frequency_indexer(["type"], ["k"]), encoders.one_hot_vectors(["k"], ["hot"])]
    hot = Pipeline(stages=stages).fit(rows).transform(rows)
    return hot.select("item_id", F.posexplode(vector_to_array("hot")).alias("slot", "value"))


# the type names, in the order their columns are made
TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query(
    "fea13_one_hot_columns",
    "SELECT item_id, "
    + ", ".join(f"CAST(coalesce(type = '{t}', false) AS INT) AS \"type_{t}\"" for t in TYPES)
    + " FROM items",
)
def one_hot_columns(spark, sf_dir):
    return encoders.one_hot_columns(items(spark, sf_dir).select("item_id", "type"), "type", prefix="type_").drop("type")


GENRES_SQL = "string_split(lower(regexp_replace(genre, '\\s+', '', 'g')), ',')"


@query(
    "fea14_multi_hot",
    f"""SELECT user_id, item_id, CAST(list_contains({GENRES_SQL}, 'ring') AS DOUBLE) AS genre_ring,
               CAST(list_contains({GENRES_SQL}, 'smallline') AS DOUBLE) AS genre_smallline,
               CAST(list_contains({GENRES_SQL}, 'nowhere') AS DOUBLE) AS genre_nowhere FROM joined""",
)
def multi_hot(spark, sf_dir):
    encoder = encoders.MultiHotEncoder(inputCol="genre", values=["ring", "smallline", "nowhere"])
    found = encoder.transform(joined(spark, sf_dir).select("user_id", "item_id", "genre")).drop("genre")
    return found.select("user_id", "item_id", *[F.col(c).cast("double").alias(c) for c in encoder.getOutputCols()])


@query(
    "fea14_agg4_sparse_words",
    """, w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[\\p{L}\\p{M}\\p{Nd}\\p{Pc}]+'))) AS value FROM documents),
         v AS (SELECT value, row_number() OVER (ORDER BY encode(value)) - 1 AS slot FROM (SELECT DISTINCT value FROM w) x)
       SELECT doc_id, count(slot) AS n_values, md5(coalesce(string_agg(slot::VARCHAR, ',' ORDER BY slot), '')) AS slots_md5
       FROM (SELECT doc_id FROM documents) d LEFT JOIN (SELECT * FROM w JOIN v USING (value)) f USING (doc_id) GROUP BY doc_id""",
)
def sparse_words(spark, sf_dir):
    """A flag per word of all documents, as slots: the vocabulary is a table of any size."""
    docs = table(spark, sf_dir, "documents").select("doc_id", words("text").alias("words"))
    found = encoders.sparse_multi_hot(docs, "words", ["doc_id"])
    return found.select(
        "doc_id", F.size("slots").cast("long").alias("n_values"), F.md5(F.array_join(F.col("slots").cast("array<string>"), ",")).alias("slots_md5")
    )


@query(
    "fea15_multi_hot_learned",
    f"""SELECT item_id, 'genre_' || value AS flag, CAST(list_contains({GENRES_SQL}, value) AS DOUBLE) AS hot
        FROM (SELECT item_id, coalesce(genre, 'Missing') AS genre FROM items) x,
             (SELECT value FROM vocab UNION SELECT 'missing') v""",
)
def multi_hot_learned(spark, sf_dir):
    hot = encoders.multi_hot(items(spark, sf_dir).select("item_id", "genre"), fill=clean.MISSING).drop("genre")
    flags = [F.col(f"`{c}`") for c in hot.columns if c != "item_id"]
    long = hot.unpivot(["item_id"], flags, "flag", "hot")
    return long.withColumn("hot", F.col("hot").cast("double"))


@query(
    "udf2_custom_stage_reloaded",
    f"""SELECT item_id, CAST(list_contains({GENRES_SQL}, 'ring') AS DOUBLE) AS has_ring FROM items""",
)
def custom_stage_reloaded(spark, sf_dir):
    """The custom stages go through save and load inside a pipeline."""
    path = scratch_path(spark, "multi-hot")
    rows = items(spark, sf_dir).select("item_id", "genre")
    model_files.save_model(Pipeline(stages=[encoders.MultiHotLearner(inputCol="genre", prefix="has_")]).fit(rows), path)
    found = PipelineModel.load(path).transform(rows)
    return found.select("item_id", F.col("has_ring").cast("double").alias("has_ring"))


# ---------------------------------------------------------------- vectors


def _numeric_items(spark, sf_dir):
    rows = items(spark, sf_dir).withColumn("episodes", number_or_null("episodes_raw"))
    return clean.complete_rows(rows.select("item_id", *features.NUMERIC))


NUMERIC_SQL = """SELECT item_id, CAST(TRY_CAST(episodes_raw AS INT) AS DOUBLE) AS x0, web_rating AS x1,
                        CAST(members AS DOUBLE) AS x2 FROM items
                 WHERE TRY_CAST(episodes_raw AS INT) IS NOT NULL AND web_rating IS NOT NULL"""


@query("fea16_assemble", NUMERIC_SQL)
def assemble(spark, sf_dir):
    vectors = features.assemble(features.NUMERIC, "v").transform(_numeric_items(spark, sf_dir))
    return vectors.select("item_id", *[element("v", i).alias(f"x{i}") for i in range(3)])


@query(
    "fea17_standard_scaling",
    "SELECT item_id, "
    + ", ".join(f"round((x{i} - avg(x{i}) OVER ()) / stddev_samp(x{i}) OVER (), 6) AS x{i}" for i in range(3))
    + f" FROM ({NUMERIC_SQL}) n",
)
def standard_scaling(spark, sf_dir):
    rows = _numeric_items(spark, sf_dir)
    stages = [features.assemble(features.NUMERIC, "v"), features.scaler("v", "scaled")]
    scaled = Pipeline(stages=stages).fit(rows).transform(rows)
    return scaled.select("item_id", *[F.round(element("scaled", i), 6).alias(f"x{i}") for i in range(3)])


@query("fea18_fea21_feature_vector")
def feature_vector(spark, sf_dir):
    rows = clean.process(joined(spark, sf_dir))
    stages = features.feature_stages()
    # each stage is fitted on the rows anew, so they are stored meanwhile
    with models.kept(rows.select("user_id", "item_id", *models.raw_inputs(stages))) as source:
        vectors = Pipeline(stages=stages).fit(source).transform(rows)
    return vectors.select("user_id", "item_id", vector_to_array(features.FEATURES).alias("features"))


@query(
    "fea19_assemble_all_but_label",
    """SELECT rating, count(*) AS n, CAST(sum(user_id) AS DOUBLE) AS sum_users, round(sum(web_rating), 4) AS sum_web
       FROM joined WHERE web_rating IS NOT NULL AND episodes IS NOT NULL GROUP BY rating""",
)
def assemble_all_but_label(spark, sf_dir):
    rows = joined(spark, sf_dir).select("user_id", "rating", "web_rating", "episodes")
    vectors = features.assemble_all_but(rows, "rating")
    return vectors.groupBy("rating").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(element("feature", 0)).alias("sum_users"),
        F.round(F.sum(element("feature", 1)), 4).alias("sum_web"),
    )


@query(
    "fea20_assemble_positional",
    """SELECT rating AS label, CAST(members AS DOUBLE) AS x0, coalesce(web_rating, 0.0) AS x1,
              CAST(coalesce(episodes, 0) AS DOUBLE) AS x2 FROM joined""",
)
def assemble_positional(spark, sf_dir):
    path = scratch_path(spark, "matrix")
    rows = joined(spark, sf_dir).select("rating", "members", "web_rating", "episodes").fillna(0)
    tables.write_headerless_csv(rows, path)
    vectors = features.assemble_positional(tables.read_label_first(spark, path))
    return vectors.select("label", *[element("feature", i).alias(f"x{i}") for i in range(3)])


@query(
    "fea22_merge_item_features",
    f"""SELECT r.rating, i.members, round(coalesce(i.web_rating, (SELECT median(web_rating) FROM items)), 6) AS web_rating,
               CASE WHEN episodes_raw = 'Unknown' THEN 0 ELSE TRY_CAST(episodes_raw AS INT) END AS episodes,
               CAST(coalesce(i.type, 'Missing') = 'PROMO' AS INT) AS "type_PROMO",
               CAST(coalesce(i.type, 'Missing') = 'Missing' AS INT) AS "type_Missing",
               CAST(list_contains({GENRES_SQL}, 'ring') AS INT) AS genre_ring,
               CAST(list_contains({GENRES_SQL}, 'missing') AS INT) AS genre_missing
        FROM ratings r JOIN (SELECT * REPLACE (coalesce(genre, 'Missing') AS genre) FROM items) i
             ON r.item_id = i.item_id WHERE r.rating <> -1""",
)
def merge_item_features(spark, sf_dir):
    source = items(spark, sf_dir)
    prepared = features.prepared_items(source, exact_median(source, "web_rating"))
    merged = features.merge_item_features(
        clean.drop_unrated(ratings(spark, sf_dir)).drop("ts"), features.expand_items(prepared)
    )
    return merged.select(
        "rating", "members", F.round("web_rating", 6).alias("web_rating"), "episodes",
        "type_PROMO", "type_Missing", "genre_ring", "genre_missing",
    )


def _ordinal_sql(source: str) -> str:
    return f"""SELECT CAST(dense_rank() OVER (ORDER BY user_id) - 1 AS INT) AS user_id,
                      CAST(dense_rank() OVER (ORDER BY item_id) - 1 AS INT) AS item_id,
                      CASE WHEN type IS NOT NULL
                           THEN CAST(dense_rank() OVER (ORDER BY type ASC NULLS LAST) - 1 AS DOUBLE) END AS type,
                      episodes, members, rating
               FROM ({source}) x"""


@query(
    "fea23_ordinal_rows",
    _ordinal_sql(
        "SELECT *, CASE WHEN episodes_raw = 'Unknown' THEN 0 ELSE TRY_CAST(episodes_raw AS INT) END AS episodes "
        "FROM (SELECT * EXCLUDE (episodes) FROM joined) j"
    ),
)
def ordinal_rows(spark, sf_dir):
    rows = features.ordinal_rows(ratings(spark, sf_dir), items(spark, sf_dir))
    return rows.select("user_id", "item_id", F.col("type").cast("double").alias("type"), "episodes", "members", "rating")


@query(
    "fea23_ordinal_rows_whole_row_zeroed",
    _ordinal_sql(
        """SELECT CASE WHEN u THEN 0 ELSE user_id END AS user_id, CASE WHEN u THEN 0 ELSE item_id END AS item_id,
                  CASE WHEN u THEN '0' ELSE type END AS type, CASE WHEN u THEN 0 ELSE members END AS members,
                  CASE WHEN u THEN 0 ELSE episodes END AS episodes, rating
           FROM (SELECT *, episodes_raw = 'Unknown' AS u FROM joined) j"""
    ),
)
def ordinal_rows_whole_row_zeroed(spark, sf_dir):
    rows = features.ordinal_rows(ratings(spark, sf_dir), items(spark, sf_dir), whole_row=True)
    return rows.select("user_id", "item_id", F.col("type").cast("double").alias("type"), "episodes", "members", "rating")


# ---------------------------------------------------------------- the same steps on other tables


@query(
    "fea17_scaled_event_values",
    """SELECT event_id, round((value - avg(value) OVER ()) / stddev_samp(value) OVER (), 6) AS scaled FROM events""",
)
def scaled_event_values(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "value")
    stages = [features.assemble(["value"], "v"), features.scaler("v", "s")]
    scaled = Pipeline(stages=stages).fit(rows).transform(rows)
    return scaled.select("event_id", F.round(element("s", 0), 6).alias("scaled"))


@query(
    "snk4_feature_table_reread",
    """SELECT part, count(*) AS n, round(sum(members), 2) AS sum_members
       FROM (SELECT members, CASE WHEN CAST(CAST('0x' || substr(md5(concat(user_id, ':', item_id, ':42')), 1, 15) AS BIGINT)
                    AS DOUBLE) / 1152921504606846976.0 < 0.8 THEN 'train' ELSE 'test' END AS part FROM joined) x
       GROUP BY part""",
)
def feature_table_reread(spark, sf_dir):
    """Assembled vectors survive Parquet."""
    path = scratch_path(spark, "features")
    rows = splits.with_hash_part(joined(spark, sf_dir).select("user_id", "item_id", "members"), 0.8, ["user_id", "item_id"])
    tables.write_parquet(features.assemble(["members"], "v").transform(rows), path, drop=["members"])
    back = tables.read_parquet(spark, path)
    return back.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(element("v", 0)), 2).alias("sum_members")
    )


@query(
    "agg4_vocabulary_on_driver",
    "SELECT count(*) AS n_values, min(value) AS first, max(value) AS last FROM vocab",
)
def vocabulary_on_driver(spark, sf_dir):
    """The bounded list that multi-hot columns are made from."""
    words = profile.vocabulary(items(spark, sf_dir), "genre")
    found = profile.value_table(items(spark, sf_dir), "genre")
    return found.filter(F.col("value").isin(words)).agg(
        F.count(F.lit(1)).alias("n_values"), F.min("value").alias("first"), F.max("value").alias("last")
    )
