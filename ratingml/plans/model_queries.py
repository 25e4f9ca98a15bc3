"""Queries over models, tuning, evaluation, saving and scoring."""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingml.operators import boosting, clean, encoders, features, metrics, models, perceptron, scoring, splits, text, tuning
from ratingml.plans.evaluate import evaluate_holdout
from ratingml.plans.fixtures import items, joined, signal
from ratingml.plans.registry import query
from ratingml.plans.table_queries import HASH_UNIT_SQL, RATIO_SQL
from ratingml.sources import models as model_files
from ratingml.sources import tables
from ratingml.storage import dealt, durable, scratch_path, spread
from ratingml.streaming import scoring as streams

PAIR = ["user_id", "item_id"]


def _labelled(spark, sf_dir) -> DataFrame:
    """Cleaned rows whose rating depends on the item, with the class label.

    The joined rows are stored once: the fills, the fit and the answers all read them.
    """
    return clean.process(durable(signal(spark, sf_dir)))


def _matrix(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Train and test rows ``(user_id, item_id, feature, label)`` for boosted trees."""
    rows = spread(_labelled(spark, sf_dir).select(*PAIR, "rating", "episodes", "web_rating", "members", "type"))
    wide = encoders.one_hot_columns(rows, "type", prefix="type_").drop("type", "label")
    named = wide.withColumnRenamed("rating", "label")
    inputs = [c for c in named.columns if c not in (*PAIR, "label")]
    vectors = features.assemble(inputs, "feature").transform(named).select(*PAIR, "feature", "label")
    return splits.hash_split(vectors, 0.8, PAIR)


# ---------------------------------------------------------------- models


@query("mod1_perceptron")
def perceptron_of_all_features(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    return models.train(rows, "mlp").transform(rows).select(*PAIR, "label", "pred")


@query("mod2_random_forest")
def random_forest(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    return models.train(rows, "rf").transform(rows).select(*PAIR, "label", "pred")


@query("mod3_boosted_trees")
def boosted_trees(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    return models.train(rows, "gbdt").transform(rows).select(*PAIR, "rating", "pred")


def _one_feature(rows: DataFrame) -> PipelineModel:
    stages = [features.assemble(["web_rating"], features.FEATURES, invalid="skip")]
    return models.train(clean.complete_rows(rows, ["web_rating", "rating"]), "glr", stages=stages)


@query(
    "mod4_linear_coefficients",
    """SELECT round(regr_slope(rating, web_rating), 6) AS slope, round(regr_intercept(rating, web_rating), 6) AS intercept,
              count(*) AS n FROM signal WHERE web_rating IS NOT NULL""",
)
def linear_coefficients(spark, sf_dir):
    rows = signal(spark, sf_dir)
    fitted = _one_feature(rows).stages[-1]
    return clean.complete_rows(rows, ["web_rating"]).agg(
        F.round(F.lit(float(fitted.coefficients[0])), 6).alias("slope"),
        F.round(F.lit(float(fitted.intercept)), 6).alias("intercept"),
        F.count(F.lit(1)).alias("n"),
    )


@query("mod5_mod8_boosted_with_tolerance")
def boosted_with_tolerance(spark, sf_dir):
    """20 rounds at depth 5, stopped when the validation rows gain too little."""
    train_rows, test_rows = _matrix(spark, sf_dir)
    fitted = models.fit_with_validation(models.boosted_rounds(), train_rows, test_rows)
    return fitted.transform(test_rows).select(*PAIR, "label", "pred")


def _numbers(rows: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Train and test rows with their numbers, gaps left open, and the names of the columns."""
    names = ["episodes", "web_rating", "members"]
    return *splits.hash_split(rows.select(*PAIR, *names, F.col("rating").alias("label")), 0.8, PAIR), names


@query("mod6_boosted_small")
def boosted_small(spark, sf_dir):
    """Five second-order rounds of depth 3; missing entries take the side that each cut learned."""
    train_rows, test_rows, names = _numbers(signal(spark, sf_dir))
    fitted = boosting.fit(train_rows, names, "label", boosting.DEPTH_THREE)
    return fitted.model.transform(test_rows).select(*PAIR, "label", "pred")


@query("mod7_boosted_on_categories")
def boosted_on_categories(spark, sf_dir):
    """Ids and type as indexes, type cut as a category; leaf-wise trees of 77 leaves."""
    rows = signal(spark, sf_dir).select(*PAIR, "type", "episodes", "web_rating", "members", "rating")
    indexed = durable(encoders.index_in_place(rows, [*PAIR, "type"]))
    train_rows, test_rows = splits.hash_split(indexed, 0.8, PAIR)
    names = [c for c in indexed.columns if c != "rating"]
    fitted = boosting.fit(train_rows, names, "rating", boosting.LEAF_WISE, ["type"], validation=test_rows, patience=5)
    return fitted.model.transform(test_rows).select(*PAIR, "rating", "pred")


@query("mod8_patience")
def patience(spark, sf_dir):
    """Metrics of the fitted rounds, and how many were fitted and kept with patience 2."""
    train_rows, test_rows, names = _numbers(signal(spark, sf_dir))
    fitted = boosting.fit(train_rows, names, "label", boosting.DEPTH_THREE, validation=test_rows, patience=2)
    return fitted.metrics.withColumns({"fitted_rounds": F.lit(fitted.fitted_rounds), "kept_rounds": F.lit(fitted.kept_rounds)})


@query("mod9_metric_per_round")
def metric_per_round(spark, sf_dir):
    train_rows, test_rows = _matrix(spark, sf_dir)
    fitted = models.boosted_small().fit(train_rows)
    return models.round_metrics(fitted, {"train": train_rows, "eval": test_rows}, "label")


@query("mod10_mod11_train_by_name")
def train_by_name(spark, sf_dir):
    """One predictor chosen by name after another, on one feature definition."""
    rows = _labelled(spark, sf_dir)
    found = None
    with models.prepared_rows(rows, [models.RATING]) as prepared:
        for name in models.REGRESSORS:
            trained = models.Regressor(name)
            trained.train(rows, prepared=prepared)
            scored = trained.transform(rows).select(*PAIR, F.lit(name).alias("algorithm"), "rating", "pred")
            found = scored if found is None else found.unionByName(scored)
    return found


# ---------------------------------------------------------------- tuning and evaluation


@query("tun1_tun5_sor1_ranked_search")
def ranked_search(spark, sf_dir):
    """The six linear models of the grid on all features, best first."""
    return _ranked_grid(spark, sf_dir, "glr", metrics.regression_evaluator(), "rating")


@query("eva1_eva2_holdout_regressor")
def holdout_regressor(spark, sf_dir):
    return evaluate_holdout(_labelled(spark, sf_dir), "glr").summary


@query("eva1_eva2_holdout_classifier")
def holdout_classifier(spark, sf_dir):
    """All 72 parameter sets of the forest's grid, ranked on the train part."""
    return evaluate_holdout(_labelled(spark, sf_dir), "rf").ranked


PART_SQL = f"""CASE WHEN {HASH_UNIT_SQL.format("concat(user_id, ':', item_id, ':42')")} < 0.8
                    THEN 'train' ELSE 'test' END"""


@query(
    "eva3_train_and_test_rmse",
    f"""SELECT part AS "set", round(sqrt(avg(power(a + b * web_rating - rating, 2))), 6) AS rmse
        FROM (SELECT *, {PART_SQL} AS part FROM signal WHERE web_rating IS NOT NULL) s,
             (SELECT regr_intercept(rating, web_rating) AS a, regr_slope(rating, web_rating) AS b
              FROM (SELECT *, {PART_SQL} AS part FROM signal WHERE web_rating IS NOT NULL) t WHERE part = 'train') m
        GROUP BY part""",
)
def train_and_test_rmse(spark, sf_dir):
    rows = clean.complete_rows(signal(spark, sf_dir).select(*PAIR, "rating", "web_rating"))
    train_rows, test_rows = splits.hash_split(rows, 0.8, PAIR)
    fitted = _one_feature(train_rows)
    report = metrics.fit_report(fitted, {"train": train_rows, "test": test_rows})
    return report.select("set", F.round("rmse", 6).alias("rmse"))


@query("udf3_timed_action")
def timed_action(spark, sf_dir):
    rows = joined(spark, sf_dir)
    count, seconds = metrics.timed(spark, rows.count, "count of joined rows")
    return seconds.withColumn("n_rows", F.lit(count))


# ---------------------------------------------------------------- saving and scoring

LINE_SQL = """(SELECT regr_intercept(rating, web_rating) AS a, regr_slope(rating, web_rating) AS b
               FROM signal WHERE web_rating IS NOT NULL) m"""
SCORED_SQL = f"""SELECT user_id, item_id, CASE WHEN web_rating IS NOT NULL THEN round(a + b * web_rating, 6) END AS pred,
                        CASE WHEN web_rating IS NULL THEN 'null feature: web_rating' END AS reason
                 FROM signal, {LINE_SQL}"""


@query("sco1_score_table", SCORED_SQL)
def score_table(spark, sf_dir):
    rows = signal(spark, sf_dir).select(*PAIR, "rating", "web_rating")
    found = scoring.score_all(_one_feature(rows), rows, PAIR)
    return found.select(*PAIR, F.round("pred", 6).alias("pred"), "reason")


@query(
    "snk3_src6_sco2_score_with_saved_model",
    f"""SELECT item_id, CASE WHEN web_rating IS NOT NULL THEN round(a + b * web_rating, 6) END AS pred,
               CASE WHEN web_rating IS NULL THEN 'null feature: web_rating' END AS reason FROM items, {LINE_SQL}""",
)
def score_with_saved_model(spark, sf_dir):
    path = scratch_path(spark, "model")
    model_files.save_model(_one_feature(signal(spark, sf_dir)), path)
    requests = items(spark, sf_dir).select("item_id", "name", "type", "web_rating", "members")
    found = scoring.score_all(model_files.load_model(path), requests, ["item_id"])
    return found.select("item_id", F.round("pred", 6).alias("pred"), "reason")


@query(
    "sco3_rejected_requests",
    """SELECT item_id, 'null feature: ' || concat_ws(', ', CASE WHEN TRY_CAST(episodes_raw AS INT) IS NULL THEN 'episodes' END,
              CASE WHEN web_rating IS NULL THEN 'web_rating' END, CASE WHEN type IS NULL THEN 'type' END) AS reason
       FROM items WHERE TRY_CAST(episodes_raw AS INT) IS NULL OR web_rating IS NULL OR type IS NULL""",
)
def rejected_requests(spark, sf_dir):
    fitted = models.train(_labelled(spark, sf_dir), "glr")
    requests = clean.sentinel_to_number(items(spark, sf_dir), "episodes_raw", value=None, output="episodes")
    return scoring.check_requests(fitted, requests).rejected.select("item_id", "reason")


@query(
    "sco4_reloaded_model_agrees",
    "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_differ FROM signal",
)
def reloaded_model_agrees(spark, sf_dir):
    """Predictions of a boosted model before and after saving, row by row."""
    path = scratch_path(spark, "boosted")
    rows = _labelled(spark, sf_dir)
    fitted = models.train(rows, "gbdt")
    model_files.save_model(fitted, path)
    again = model_files.load_model(path)
    both = again.transform(
        fitted.transform(rows).select(*rows.columns, F.col("pred").alias("first"))
    )
    return both.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col("first").eqNullSafe(F.col("pred"))).alias("n_differ")
    )


@query("sco5_fun10_class_probabilities")
def class_probabilities(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    fitted = models.train(rows, "rf")
    return scoring.class_output(fitted.transform(rows), PAIR)


@query(
    "sco6_predict_one_vector",
    f"""SELECT user_id, item_id, round(a + b * web_rating, 6) AS pred FROM signal, {LINE_SQL}
        WHERE web_rating IS NOT NULL ORDER BY user_id, item_id LIMIT 1""",
)
def predict_one_vector(spark, sf_dir):
    """The model's answer for the vector of the first row."""
    fitted = _one_feature(signal(spark, sf_dir))
    vectors = PipelineModel(fitted.stages[:-1]).transform(signal(spark, sf_dir))
    first = vectors.orderBy(*PAIR).limit(1).select(*PAIR, features.FEATURES)
    value = scoring.predict_vector(fitted.stages[-1], first.first()[features.FEATURES])
    return first.select(*PAIR, F.round(F.lit(value), 6).alias("pred"))


@query("sco7_score_stream", SCORED_SQL)
def score_stream(spark, sf_dir):
    """Rows that arrive as files, scored by a stream and read back."""
    source, target, state, rejects, reject_state = [
        scratch_path(spark, n) for n in ("requests", "scored", "state", "rejects", "reject-state")
    ]
    rows = signal(spark, sf_dir).select(*PAIR, "rating", "web_rating")
    fitted = _one_feature(rows)
    tables.write_parquet(rows.drop("rating"), source)
    arriving = streams.read_requests(spark, source, rows.drop("rating").schema)
    scored = streams.scored_stream(fitted, arriving, output=[*PAIR, F.round("pred", 6).alias("pred")])
    rejected = streams.rejected_stream(fitted, arriving).select(*PAIR, "reason")
    running = [
        streams.start_scoring(scored, target, state, available_now=True),
        streams.start_scoring(rejected, rejects, reject_state, available_now=True),
    ]
    for stream in running:
        stream.awaitTermination()
    return tables.read_parquet(spark, target).unionByName(tables.read_parquet(spark, rejects), allowMissingColumns=True)


@query("snk5_tree_dump")
def tree_dump(spark, sf_dir):
    train_rows, _ = _matrix(spark, sf_dir)
    return model_files.tree_dump(spark, models.boosted_small().fit(train_rows))


# ---------------------------------------------------------------- models that SQL can repeat


def _promo_rows(rows: DataFrame) -> DataFrame:
    """One 0/1 feature, so that a one-split tree has the group means as its answers."""
    flagged = rows.withColumn("promo", F.coalesce((F.col("type") == "PROMO").cast("double"), F.lit(0.0)))
    return features.assemble(["promo"], features.FEATURES).transform(flagged)


PROMO_SQL = "CAST(coalesce(type = 'PROMO', false) AS INT)"


@query(
    "mod3_boosted_stump",
    f"""SELECT user_id, item_id, round(avg(rating) OVER (PARTITION BY {PROMO_SQL}), 6) AS pred FROM joined""",
)
def boosted_stump(spark, sf_dir):
    """Boosted trees of one round and one split predict the mean of each side."""
    rows = _promo_rows(joined(spark, sf_dir)).select(*PAIR, "rating", features.FEATURES)
    fitted = models.boosted(maxDepth=1, maxIter=1, subsamplingRate=1.0).fit(rows)
    return fitted.transform(rows).select(*PAIR, F.round("pred", 6).alias("pred"))


@query(
    "mod9_rounds_of_boosted_stump",
    f"""SELECT round(sqrt(avg(power(p - rating, 2))), 6) AS rmse,
               round(sqrt(avg(power(ln(1 + p) - ln(1 + rating), 2))), 6) AS rmsle
        FROM (SELECT rating, avg(rating) OVER (PARTITION BY {PROMO_SQL}) AS p FROM joined) x""",
)
def rounds_of_boosted_stump(spark, sf_dir):
    rows = _promo_rows(joined(spark, sf_dir)).select("rating", features.FEATURES)
    fitted = models.boosted(maxDepth=1, maxIter=1, subsamplingRate=1.0).fit(rows)
    found = models.round_metrics(fitted, {"train": rows}, "rating")
    return found.select(F.round("rmse", 6).alias("rmse"), F.round("rmsle", 6).alias("rmsle"))


@query(
    "mod2_sco5_single_tree_probabilities",
    "SELECT user_id, item_id, "
    + ", ".join(
        f"round(avg(CASE WHEN label = {i} THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY high), 6) AS prob_{i}" for i in range(3)
    )
    + """ FROM (SELECT user_id, item_id, coalesce(web_rating >= 8, false) AS high,
                      CASE WHEN rating >= 9 THEN 2 WHEN rating >= 6 THEN 1 ELSE 0 END AS label FROM signal) s""",
)
def single_tree_probabilities(spark, sf_dir):
    """A forest of one tree with one split, on all rows, gives the class shares of each side.

    (Sides with the same class would be merged, so the flag must tell classes apart.)
    """
    rows = clean.add_label(signal(spark, sf_dir))
    rows = rows.withColumn("high", F.coalesce((F.col("web_rating") >= 8).cast("double"), F.lit(0.0)))
    rows = features.assemble(["high"], features.FEATURES).transform(rows)
    fitted = models.random_forest(numTrees=1, maxDepth=1, bootstrap=False).fit(rows.select(features.FEATURES, "label"))
    scored = scoring.class_output(fitted.transform(rows), PAIR)
    return scored.select(*PAIR, *[F.round(f"prob_{i}", 6).alias(f"prob_{i}") for i in range(3)])


@query(
    "mod1_perceptron_on_one_flag",
    """SELECT user_id, item_id, CAST(mode(label) OVER (PARTITION BY high) AS DOUBLE) AS pred
       FROM (SELECT user_id, item_id, coalesce(web_rating >= 8, false) AS high,
                    CASE WHEN rating >= 9 THEN 2 WHEN rating >= 6 THEN 1 ELSE 0 END AS label FROM signal) s""",
)
def perceptron_on_one_flag(spark, sf_dir):
    """A perceptron of the usual layers on one flag answers each side with its most frequent class."""
    rows = clean.add_label(signal(spark, sf_dir))
    rows = rows.withColumn("high", F.coalesce((F.col("web_rating") >= 8).cast("double"), F.lit(0.0)))
    rows = features.assemble(["high"], features.FEATURES).transform(rows)
    learned = rows.select(features.FEATURES, F.col("label").cast("double").alias("label"))
    fitted = perceptron.fit(models.mlp(1, maxIter=100), learned)
    return fitted.transform(rows).select(*PAIR, "pred")


@query(
    "eva1_holdout_score_of_one_feature",
    f""", parts AS (
          SELECT *, {RATIO_SQL} AS ratio FROM signal WHERE web_rating IS NOT NULL)
        SELECT count(*) AS n_test, round(sqrt(avg(power(a + b * web_rating - rating, 2))), 6) AS holdout
        FROM (SELECT regr_intercept(rating, web_rating) AS a, regr_slope(rating, web_rating) AS b
              FROM parts WHERE ratio <= 0.8) m, parts
        WHERE ratio > 0.8""",
)
def holdout_score_of_one_feature(spark, sf_dir):
    """Split per user, fit on train, score on test: the whole evaluation, with a model that SQL can fit."""
    rows = clean.complete_rows(signal(spark, sf_dir).select(*PAIR, "rating", "web_rating"))
    stages = [features.assemble(["web_rating"], features.FEATURES)]
    report = evaluate_holdout(rows, "glr", grid={"regParam": [0.0]}, stages=stages, seed=42)
    n_test = splits.stratified_parts(rows, 0.8, seed=42).agg(F.count_if(F.col("part") == "test").alias("n_test"))
    score = report.summary.first()["holdout"]
    return n_test.withColumn("holdout", F.round(F.lit(score), 6))


@query(
    "fea21_feature_vector_without_text",
    """SELECT user_id, item_id, """
    + ", ".join(f"CAST(slot = {i} AS DOUBLE) AS f{i}" for i in range(5))
    + ", "
    + ", ".join(
        f"round(({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER (), 6) AS f{5 + i}"
        for i, c in enumerate(features.NUMERIC)
    )
    + """ FROM (SELECT * FROM joined WHERE genre IS NOT NULL AND type IS NOT NULL AND episodes IS NOT NULL
                AND web_rating IS NOT NULL) j
          JOIN (SELECT type, row_number() OVER (ORDER BY n DESC, type) - 1 AS slot
                FROM (SELECT type, count(*) AS n FROM joined WHERE genre IS NOT NULL AND type IS NOT NULL
                      AND episodes IS NOT NULL AND web_rating IS NOT NULL GROUP BY type) c) t
          ON j.type = t.type""",
)
def feature_vector_without_text(spark, sf_dir):
    """One-hot type and scaled numbers in one vector, from complete rows."""
    rows = clean.process(joined(spark, sf_dir), filter_na=True)
    fitted = Pipeline(stages=features.feature_stages(text=None)).fit(rows)
    values = vector_to_array(features.FEATURES)
    vectors = fitted.transform(rows)
    return vectors.select(*PAIR, *[F.round(values[i], 6).alias(f"f{i}") for i in range(8)])


def _ranked_grid(spark, sf_dir, algo, evaluator, label) -> DataFrame:
    """Every parameter set of the grid, with the model's own settings and all features, text too."""
    rows, stages = _labelled(spark, sf_dir), features.feature_stages()
    # the joined rows are stored, so they are read again and not kept once more
    source = rows.select(*dict.fromkeys([*PAIR, *models.raw_inputs(stages), label]))
    pipeline = Pipeline(stages=stages).fit(source)
    vectors = pipeline.transform(source)
    estimator = models.make_model(algo, vectors)
    grid = tuning.default_grid(algo, estimator, features.vector_size(vectors))
    if tuning.learns_copies(estimator):
        fitted = tuning.search(vectors, estimator, evaluator, grid, keys=PAIR, made_by=pipeline)
    else:
        with models.kept(pipeline.transform(dealt(source)).select(*PAIR, features.FEATURES, label)) as stored:
            fitted = tuning.search(stored, estimator, evaluator, grid, keys=PAIR)
    return tuning.ranking(spark, fitted, evaluator)


@query("tun2_perceptron_search")
def perceptron_search(spark, sf_dir):
    """All 18 parameter sets of the perceptron's grid on all features."""
    return _ranked_grid(spark, sf_dir, "mlp", metrics.classification_evaluator(), "label")


@query("tun3_forest_search")
def forest_search(spark, sf_dir):
    """All 72 parameter sets of the forest's grid."""
    return _ranked_grid(spark, sf_dir, "rf", metrics.classification_evaluator(), "label")


@query("tun4_boosted_search")
def boosted_search(spark, sf_dir):
    """All 96 parameter sets of the boosted trees' grid."""
    return _ranked_grid(spark, sf_dir, "gbdt", metrics.regression_evaluator(), "rating")


@query(
    "mod5_mod6_boosted_on_one_flag",
    f"""SELECT user_id, item_id, round(avg(rating) OVER (PARTITION BY {PROMO_SQL}), 6) AS pred_20_rounds,
               round(avg(rating) OVER (PARTITION BY {PROMO_SQL}), 6) AS pred_5_rounds FROM joined""",
)
def boosted_on_one_flag(spark, sf_dir):
    """With one flag the first round finds the means of both sides, and later rounds add nothing."""
    rows = _promo_rows(joined(spark, sf_dir)).select(*PAIR, "rating", F.col(features.FEATURES).alias("feature"))
    labelled = rows.withColumnRenamed("rating", "label")
    with models.kept(labelled) as stored:
        large = models.boosted_rounds(predictionCol="pred_20_rounds").fit(stored)
        small = models.boosted_small(predictionCol="pred_5_rounds").fit(stored)
    scored = small.transform(large.transform(labelled))
    return scored.select(*PAIR, *[F.round(c, 6).alias(c) for c in ("pred_20_rounds", "pred_5_rounds")])


@query(
    "mod9_rounds_on_one_flag",
    f"""SELECT r AS "round", rmse, rmsle FROM (
          SELECT round(sqrt(avg(power(p - rating, 2))), 6) AS rmse,
                 round(sqrt(avg(power(ln(1 + p) - ln(1 + rating), 2))), 6) AS rmsle
          FROM (SELECT rating, avg(rating) OVER (PARTITION BY {PROMO_SQL}) AS p FROM joined) x) m,
          (VALUES (1), (2), (3), (4), (5)) v(r)""",
)
def rounds_on_one_flag(spark, sf_dir):
    rows = _promo_rows(joined(spark, sf_dir))
    rows = rows.select(F.col("rating").alias("label"), F.col(features.FEATURES).alias("feature"))
    with models.kept(rows) as stored:
        fitted = models.boosted_small().fit(stored)
        found = models.round_metrics(fitted, {"train": stored}, "label")
        return found.select("round", F.round("rmse", 6).alias("rmse"), F.round("rmsle", 6).alias("rmsle"))


@query(
    "mod7_boosted_on_one_category",
    """SELECT user_id, item_id, round(avg(rating) OVER (PARTITION BY type), 6) AS pred FROM joined
       WHERE type IS NOT NULL""",
)
def boosted_on_one_category(spark, sf_dir):
    """Deep enough trees on the type alone predict the mean of each type."""
    rows = joined(spark, sf_dir).filter("type IS NOT NULL").select(*PAIR, "type", "rating")
    indexed = durable(encoders.index_in_place(rows, ["type"]))
    fitted = boosting.fit(indexed, ["type"], "rating", boosting.LEAF_WISE, ["type"])
    return fitted.model.transform(indexed).select(*PAIR, F.round("pred", 6).alias("pred"))


def _cell(before: str) -> str:
    """One second-order step for all rows of a cell: step 0.2, l2 1."""
    return f"({before} + 0.2 * (s - n * {before}) / (n + 1))"


@query(
    "mod5_second_order_on_two_flags",
    f"""SELECT user_id, item_id, round({_cell(_cell(_cell("0.5::DOUBLE")))}, 6) AS pred FROM (
          SELECT user_id, item_id, sum(rating) OVER cell AS s, count(*) OVER cell AS n FROM signal
          WINDOW cell AS (PARTITION BY {PROMO_SQL}, CAST(coalesce(web_rating >= 8, false) AS INT))) x""",
)
def second_order_on_two_flags(spark, sf_dir):
    """Trees of depth 2 tell the four cells of two flags apart; every leaf is a shrunk Newton step."""
    high = F.coalesce((F.col("web_rating") >= 8).cast("double"), F.lit(0.0)).alias("high")
    promo = F.coalesce((F.col("type") == "PROMO").cast("double"), F.lit(0.0)).alias("promo")
    rows = signal(spark, sf_dir).select(*PAIR, "rating", promo, high)
    fitted = boosting.fit(rows, ["promo", "high"], "rating", replace(boosting.DEPTH_FIVE, rounds=3, depth=2))
    return fitted.model.transform(rows).select(*PAIR, F.round("pred", 6).alias("pred"))


@query(
    "mod6_side_of_missing_entries",
    """, planted AS (
          SELECT user_id, item_id, episodes AS x,
                 rating + CASE WHEN episodes IS NULL OR episodes > 30 THEN 3 ELSE 0 END AS y FROM signal),
        whole AS (SELECT sum(y - m) AS g, count(*) AS n, any_value(m) AS m FROM planted, (SELECT avg(y) AS m FROM planted) b),
        sums AS (SELECT x, sum(y - m) AS g, count(*) AS n FROM planted, (SELECT avg(y) AS m FROM planted) b GROUP BY x),
        upto AS (
          SELECT x, sum(g) OVER (ORDER BY x) AS g, sum(n) OVER (ORDER BY x) AS n FROM sums WHERE x IS NOT NULL),
        cuts AS (
          SELECT u.x, side, u.g + CASE WHEN side THEN coalesce(k.g, 0) ELSE 0 END AS lg,
                 u.n + CASE WHEN side THEN coalesce(k.n, 0) ELSE 0 END AS ln
          FROM upto u CROSS JOIN (VALUES (true), (false)) v(side) LEFT JOIN sums k ON k.x IS NULL),
        best AS (
          SELECT c.x AS cut, side, m, lg / (ln + 1) AS low, (g - lg) / (n - ln + 1) AS high FROM cuts c, whole WHERE n > ln
          ORDER BY round(lg * lg / (ln + 1) + (g - lg) * (g - lg) / (n - ln + 1) - g * g / (n + 1), 9) DESC, c.x, side DESC LIMIT 1)
        SELECT user_id, item_id, round(m + CASE WHEN coalesce(x <= cut, side) THEN low ELSE high END, 6) AS pred
        FROM planted, best""",
)
def side_of_missing_entries(spark, sf_dir):
    """One cut, with the side of the missing entries learned: here they go with the large values, 0 does not."""
    rows = signal(spark, sf_dir).select(
        *PAIR, "episodes", (F.col("rating") + F.when(F.col("episodes").isNull() | (F.col("episodes") > 30), 3).otherwise(0)).alias("y")
    )
    own = boosting.Settings(rounds=1, depth=1, step=1.0, l2=1.0)
    fitted = boosting.fit(rows, ["episodes"], "y", own)
    return fitted.model.transform(rows).select(*PAIR, F.round("pred", 6).alias("pred"))


@query(
    "mod8_no_round_after_patience",
    f"""SELECT CAST(1 AS INT) AS kept_rounds, CAST(3 AS INT) AS fitted_rounds, round(sqrt(avg(power(p - rating, 2))), 6) AS rmse
        FROM (SELECT *, {PART_SQL} AS part, {PROMO_SQL} AS promo FROM joined) j
        JOIN (SELECT promo, avg(rating) AS p FROM (SELECT *, {PART_SQL} AS part, {PROMO_SQL} AS promo FROM joined) x
              WHERE part = 'train' GROUP BY promo) m USING (promo)
        WHERE part = 'test'""",
)
def no_round_after_patience(spark, sf_dir):
    """The first round reaches the means of one flag; two more show no gain, and the other 17 are not fitted."""
    promo = F.coalesce((F.col("type") == "PROMO").cast("double"), F.lit(0.0)).alias("promo")
    train_rows, test_rows = splits.hash_split(joined(spark, sf_dir).select(*PAIR, "rating", promo), 0.8, PAIR)
    own = replace(boosting.DEPTH_FIVE, step=1.0, l2=0.0)
    fitted = boosting.fit(train_rows, ["promo"], "rating", own, validation=test_rows, patience=2)
    first = fitted.metrics.filter((F.col("set") == "validation") & (F.col("round") == 1))
    return first.select(
        F.lit(fitted.kept_rounds).alias("kept_rounds"), F.lit(fitted.fitted_rounds).alias("fitted_rounds"), F.round("rmse", 6).alias("rmse")
    )


@query(
    "fea5_one_vector_per_name",
    """SELECT name, count(*) AS n, CAST(1 AS BIGINT) AS n_vectors, CAST(20 AS INT) AS size FROM joined GROUP BY name""",
)
def one_vector_per_name(spark, sf_dir):
    """Rows of one name get one vector of 20 numbers, in whatever task they are."""
    tokens = text.split_tokenizer().transform(joined(spark, sf_dir).select("name"))
    vectors = text.word_vectors().fit(tokens).transform(tokens).select("name", vector_to_array("word_vectors").alias("v"))
    return vectors.groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("v").alias("n_vectors"), F.max(F.size("v")).alias("size")
    )


# ---------------------------------------------------------------- facts of learned results that SQL can derive


@query(
    "tun1_tun5_sor1_facts_of_the_ranking",
    """SELECT CAST(6 AS BIGINT) AS n_sets, CAST(6 AS BIGINT) AS n_different, true AS best_first,
              CAST(count(*) AS BIGINT) AS n_rows FROM signal WHERE rating IS NOT NULL""",
)
def facts_of_the_ranking(spark, sf_dir):
    """The search covers its whole grid and ranks it from the lowest error on."""
    rows, stages = _labelled(spark, sf_dir), features.feature_stages()
    estimator, evaluator = models.linear(), metrics.regression_evaluator()
    source = rows.select(*dict.fromkeys([*PAIR, *models.raw_inputs(stages), "rating"]))
    pipeline = Pipeline(stages=stages).fit(source)
    grid = tuning.default_grid("glr", estimator)
    fitted = tuning.search(pipeline.transform(source), estimator, evaluator, grid, keys=PAIR, made_by=pipeline)
    n_rows = source.count()
    ranked = tuning.ranking(spark, fitted, evaluator).collect()
    errors = [r["metric"] for r in ranked]
    facts = (len(ranked), len({r["params"] for r in ranked}), errors == sorted(errors), n_rows)
    return spark.createDataFrame([facts], "n_sets long, n_different long, best_first boolean, n_rows long")


@query(
    "mod10_mod11_rows_by_algorithm",
    """SELECT algorithm, count(*) AS n_rows, count(*) AS n_predicted
       FROM signal, (VALUES ('mlp'), ('rf'), ('gbdt'), ('glr')) v(algorithm) GROUP BY algorithm""",
)
def rows_by_algorithm(spark, sf_dir):
    """Every predictor of both kinds, trained by name, answers every row."""
    rows = _labelled(spark, sf_dir)
    found = None
    with models.prepared_rows(rows, [models.CLASS_LABEL, models.RATING]) as prepared:
        for kind in (models.Classifier, models.Regressor):
            for name in kind.registry:
                learner = kind(name)
                learner.train(rows, prepared=prepared)
                counts = learner.transform(rows).agg(F.count(F.lit(1)).alias("n_rows"), F.count("pred").alias("n_predicted"))
                counts = counts.select(F.lit(name).alias("algorithm"), "n_rows", "n_predicted")
                found = counts if found is None else found.unionByName(counts)
    return found


@query(
    "snk5_leaves_of_a_stump",
    f"""SELECT CAST(0 AS INT) AS tree, round(avg(rating), 6) AS leaf FROM joined GROUP BY {PROMO_SQL}""",
)
def leaves_of_a_stump(spark, sf_dir):
    """The dump of one tree of one split holds the mean of each side."""
    rows = _promo_rows(joined(spark, sf_dir)).select(F.col("rating").cast("double").alias("label"), F.col(features.FEATURES).alias("feature"))
    with models.kept(rows) as stored:
        fitted = models.boosted_small(maxIter=1, maxDepth=1).fit(stored)
    leaf = F.regexp_extract("text", r"Predict: ([-0-9.Ee]+)", 1)
    lines = model_files.tree_dump(spark, fitted).filter(leaf != "")
    return lines.select("tree", F.round(leaf.cast("double"), 6).alias("leaf"))


@query("udf3_timed_rows", "SELECT count(*) AS n_rows, true AS took_time FROM joined")
def timed_rows(spark, sf_dir):
    count, seconds = metrics.timed(spark, joined(spark, sf_dir).count, "count of joined rows")
    return seconds.select(F.lit(count).cast("long").alias("n_rows"), (F.col("seconds") > 0).alias("took_time"))


@query(
    "eva2_facts_of_the_holdout",
    "SELECT 'glr' AS algo, CAST(6 AS BIGINT) AS n_sets, true AS best_is_first, true AS has_holdout FROM (SELECT count(*) AS n FROM signal) s WHERE n > 0",
)
def facts_of_the_holdout(spark, sf_dir):
    report = evaluate_holdout(_labelled(spark, sf_dir), "glr")
    first, summary = report.ranked.first(), report.summary
    return summary.select(
        "algo",
        F.lit(report.ranked.count()).cast("long").alias("n_sets"),
        ((F.col("best_params") == first["params"]) & (F.col("best_validation") == first["metric"])).alias("best_is_first"),
        (F.col("holdout") > 0).alias("has_holdout"),
    )
