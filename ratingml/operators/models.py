"""Classifiers and regressors, by name, and training of features plus model.

Seeds are parameters with defaults everywhere. Spark ML has no native twin of
two outside boosting libraries: ``boosted_rounds`` and ``boosted_leafwise`` give
boosted trees with the matching settings, grown by depth.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark import SparkContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.base import Estimator, Model
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ratingml.operators.features import FEATURES, Stage, feature_stages, vector_size
from ratingml.storage import dealt

CLASS_LABEL = "label"
RATING = "rating"
PREDICTION = "pred"
PROBABILITY = "prob"
SEED = 2020

_CLASS_COLUMNS = dict(
    featuresCol=FEATURES, labelCol=CLASS_LABEL, predictionCol=PREDICTION, probabilityCol=PROBABILITY
)
_RATING_COLUMNS = dict(featuresCol=FEATURES, labelCol=RATING, predictionCol=PREDICTION)


def mlp(size: int, hidden: Sequence[int] = (40, 10), classes: int = 3, seed: int = SEED, **params):
    """Perceptron. The step size acts with ``solver="gd"`` only, not with the default solver."""
    settings = dict(**_CLASS_COLUMNS, layers=[size, *hidden, classes], stepSize=0.01, maxIter=10)
    return MultilayerPerceptronClassifier(seed=seed, **{**settings, **params})


def random_forest(seed: int = SEED, **params):
    settings = dict(**_CLASS_COLUMNS, featureSubsetStrategy="auto", maxDepth=3, numTrees=100, subsamplingRate=1.0)
    return RandomForestClassifier(seed=seed, **{**settings, **params})


def boosted(seed: int = SEED, **params):
    settings = dict(
        **_RATING_COLUMNS, featureSubsetStrategy="auto", maxDepth=3, maxIter=5, stepSize=0.1, subsamplingRate=0.8
    )
    return GBTRegressor(seed=seed, **{**settings, **params})


def linear(**params):
    settings = dict(**_RATING_COLUMNS, family="gaussian", link="identity", regParam=0.0)
    return GeneralizedLinearRegression(**{**settings, **params})


def boosted_rounds(seed: int = SEED, **params):
    """Boosted trees of depth 5, 20 rounds at step .2, on an assembled label-first table."""
    settings = dict(
        featuresCol="feature", labelCol="label", maxDepth=5, maxIter=20, stepSize=0.2, minInstancesPerNode=1, subsamplingRate=1.0
    )
    return boosted(seed, **{**settings, **params})


def boosted_small(seed: int = SEED, **params):
    """The same at depth 3 with 5 rounds."""
    return boosted_rounds(seed, **{**dict(maxDepth=3, maxIter=5), **params})


def boosted_leafwise(max_categories: int, leaves: int = 77, sampled: bool = False, seed: int = 0, **params):
    """Boosted trees for indexed categorical columns.

    Growth is by depth, so ``leaves`` becomes the depth of a full tree with at
    least that many leaves. ``maxBins`` must reach the categories of the widest
    column that is marked categorical. ``sampled`` adds row and column sampling
    and 100 rounds.
    """
    settings = dict(
        featuresCol="feature",
        labelCol=RATING,
        stepSize=1.0,
        maxIter=10,
        minInstancesPerNode=5,
        maxDepth=max(1, (leaves - 1).bit_length()),
        maxBins=max(32, max_categories),
        subsamplingRate=1.0,
    )
    if sampled:
        settings.update(
            maxIter=100, subsamplingRate=0.8, featureSubsetStrategy="0.7", maxBins=max(255, max_categories)
        )
    return boosted(seed, **{**settings, **params})


CLASSIFIERS: dict[str, Callable] = {"mlp": mlp, "rf": random_forest}
REGRESSORS: dict[str, Callable] = {"gbdt": boosted, "glr": linear}


def choose(registry: dict[str, Callable], name: str) -> Callable:
    if name not in registry:
        raise ValueError(f"unknown algorithm {name!r}; use one of {sorted(registry)}")
    return registry[name]


def make_model(name: str, features: DataFrame, **params) -> Estimator:
    """Estimator by name; a perceptron takes its input size from the feature column."""
    build = choose({**CLASSIFIERS, **REGRESSORS}, name)
    if name == "mlp" and "layers" not in params:
        return build(vector_size(features), **params)
    return build(**params)


@contextmanager
def kept(df: DataFrame, keep: bool = True):
    """``df`` stored in memory, then on disk, for as long as it is read again and again."""
    if keep:
        df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        if keep:
            df.unpersist()


def raw_inputs(stages: Sequence[Stage]) -> list[str]:
    """Columns that the stages read and none of them makes."""
    made: set[str] = set()
    wanted: list[str] = []
    for stage in stages:
        for name in stage_columns(stage, "inputCol", "inputCols", "featuresCol"):
            if name not in made and name not in wanted:
                wanted.append(name)
        made.update(stage_columns(stage, "outputCol", "outputCols"))
    return wanted


def stage_columns(stage: Stage, *params: str) -> list[str]:
    """Column names that the given parameters of a stage hold, if it has them."""
    found: list[str] = []
    for name in params:
        if stage.hasParam(name) and stage.isDefined(stage.getParam(name)):
            value = stage.getOrDefault(stage.getParam(name))
            found += [value] if isinstance(value, str) else value
    return found


@dataclass
class Prepared:
    """Fitted feature stages, and the vectors and labels that they made of the training rows."""

    pipeline: PipelineModel
    vectors: DataFrame


@contextmanager
def prepared_rows(df: DataFrame, labels: Sequence[str], stages: Sequence[Stage] | None = None, keep: bool = True):
    """Features of ``df`` for one model, or for several that learn from the same rows, fitted once.

    ``keep`` stores the few columns in use while the feature stages are fitted,
    and the vectors, in parts of some 500,000 rows, while models read them again and again.
    """
    stages = list(stages or feature_stages())
    columns = dict.fromkeys([*raw_inputs(stages), *labels])
    with kept(df.select(*columns), keep) as source:
        pipeline = Pipeline(stages=stages).fit(source)
        vectors = pipeline.transform(dealt(source) if keep else source)
        vectors = vectors.select(FEATURES, *[F.col(label).cast("double").alias(label) for label in labels])
        with kept(vectors, keep) as rows:
            yield Prepared(pipeline, rows)


def train(
    df: DataFrame,
    algo: str,
    stages: Sequence[Stage] | None = None,
    keep: bool = True,
    prepared: Prepared | None = None,
    **params,
) -> PipelineModel:
    """Features and model as one fitted pipeline; the features are fitted once.

    ``keep`` is that of ``prepared_rows``. ``prepared`` are the features of the same rows by the
    same stages, where several models share them.
    """
    choose({**CLASSIFIERS, **REGRESSORS}, algo)
    label = CLASS_LABEL if algo in CLASSIFIERS else RATING
    if prepared is None:
        with prepared_rows(df, [label], stages, keep) as own:
            return train(df, algo, prepared=own, **params)
    rows = prepared.vectors.select(FEATURES, label)
    fitted = make_model(algo, rows, **params).fit(rows)
    return PipelineModel([*prepared.pipeline.stages, fitted])


class _Learner:
    """Trains by algorithm name and keeps the fitted pipeline."""

    registry: dict[str, Callable] = {}

    def __init__(self, algo: str):
        choose(self.registry, algo)
        self.algo = algo
        self.pipeline_model: PipelineModel | None = None
        self.report = None

    def train(
        self, df: DataFrame, evaluate: bool = False, debug: bool = False, holdout: dict | None = None, **params
    ) -> PipelineModel:
        """Fit; with ``evaluate`` tune on a per-user hold-out and keep the best model.

        ``debug`` prints a few transformed rows. ``holdout`` holds the options of
        ``evaluate_holdout``. ``params`` are settings of the model; when tuning, each is a
        grid of one value. ``stages`` serves both; ``prepared`` is for the plain fit only.
        """
        if evaluate:
            from ratingml.plans.evaluate import evaluate_holdout

            options = dict(holdout or {})
            own = dict(params)
            if "stages" in own:
                options["stages"] = own.pop("stages")
            if own:
                options["grid"] = {**{k: [v] for k, v in own.items()}, **(options.get("grid") or {})}
            self.report = evaluate_holdout(df, self.algo, **options)
            self.pipeline_model = self.report.model
        else:
            self.pipeline_model = train(df, self.algo, **params)
        if debug:
            self.transform(df).show(4, truncate=False)
        return self.pipeline_model

    def transform(self, df: DataFrame) -> DataFrame:
        if self.pipeline_model is None:
            raise RuntimeError("train first")
        return self.pipeline_model.transform(df)


class Classifier(_Learner):
    registry = CLASSIFIERS

    def __init__(self, algo: str = "mlp"):
        super().__init__(algo)


class Regressor(_Learner):
    registry = REGRESSORS

    def __init__(self, algo: str = "gbdt"):
        super().__init__(algo)


def round_metrics(model: GBTRegressionModel, sets: dict[str, DataFrame], label: str) -> DataFrame:
    """RMSE and RMSLE after each boosting round, for each named data set.

    ``(set, round, rmse, rmsle)``. Each set is read once: the trees give one
    column each, and running sums of the weighted columns are the predictions of
    the rounds. RMSLE takes negative predictions as 0.
    """
    weights = model.treeWeights
    rounds = len(weights)
    tables = []
    for name, df in sets.items():
        scored = df.select(F.col(model.getFeaturesCol()), F.col(label).cast("double").alias("__y"))
        for i, tree in enumerate(model.trees):
            own = {tree.featuresCol: model.getFeaturesCol(), tree.predictionCol: f"__t{i}"}
            scored = tree.copy(own).transform(scored)
        parts = F.array(*[F.col(f"__t{i}") * F.lit(weight) for i, weight in enumerate(weights)])
        # one running sum over the trees; an array keeps the plan as long as the model, not its square
        sums = F.aggregate(
            parts,
            F.array().cast("array<double>"),
            lambda done, part: F.concat(done, F.array(part + F.coalesce(F.element_at(F.concat(F.array(F.lit(0.0)), done), -1), F.lit(0.0)))),
        )
        each = scored.select("__y", F.posexplode(sums).alias("__i", "__p"))
        y, p = F.col("__y"), F.col("__p")
        logs = F.log1p(F.greatest(p, F.lit(0.0))) - F.log1p(y)
        found = each.groupBy((F.col("__i") + 1).alias("round")).agg(
            F.sqrt(F.avg((p - y) * (p - y))).alias("rmse"), F.sqrt(F.avg(logs * logs)).alias("rmsle")
        )
        tables.append(found.select(F.lit(name).alias("set"), "round", "rmse", "rmsle"))
    if not rounds:
        raise ValueError("the model has no trees")
    return reduce(DataFrame.unionByName, tables)


def stopping_round(scores: Sequence[float], patience: int) -> int:
    """1-based round to keep: the best before ``patience`` rounds bring no gain (lower is better)."""
    best, best_round = float("inf"), 0
    for i, score in enumerate(scores, start=1):
        if score < best:
            best, best_round = score, i
        elif i - best_round >= patience:
            break
    return best_round


def fit_with_validation(
    estimator: GBTRegressor, train_rows: DataFrame, validation: DataFrame, tolerance: float = 0.01
) -> Model:
    """Stop when a round gains less than ``tolerance`` on the validation rows (Spark's own rule)."""
    marked = train_rows.withColumn("__validation", F.lit(False)).unionByName(
        validation.withColumn("__validation", F.lit(True))
    )
    own = estimator.copy(
        {estimator.validationIndicatorCol: "__validation", estimator.validationTol: tolerance}
    )
    return own.fit(marked)


def fit_with_patience(
    estimator: GBTRegressor, train_rows: DataFrame, validation: DataFrame, patience: int
) -> tuple[Model, DataFrame]:
    """Stop after ``patience`` rounds without gain on the validation rows.

    Spark's rule is a tolerance, not a count. So all rounds are fitted and scored
    once, and the trees up to the best round are kept. Returns the model and the
    metric table of the full run.
    """
    if validation is None:
        raise ValueError("early stopping needs validation rows")
    full = estimator.fit(train_rows)
    label = estimator.getLabelCol()
    metrics = round_metrics(full, {"train": train_rows, "validation": validation}, label)
    scores = metrics.filter(F.col("set") == "validation").orderBy("round").select("rmse").collect()
    keep = stopping_round([row[0] for row in scores], patience)
    return first_trees(full, keep), metrics


def first_trees(model: GBTRegressionModel, count: int) -> GBTRegressionModel:
    """The boosted model of the first ``count`` trees; it can be saved like any other."""
    whole = model._java_obj
    gateway = SparkContext._active_spark_context._gateway
    names = gateway.jvm.org.apache.spark.ml.regression
    trees = gateway.new_array(names.DecisionTreeRegressionModel, count)
    weights = gateway.new_array(gateway.jvm.double, count)
    for i in range(count):
        trees[i], weights[i] = whole.trees()[i], whole.treeWeights()[i]
    kept_model = GBTRegressionModel(names.GBTRegressionModel(model.uid, trees, weights))
    kept_model._resetUid(model.uid)
    model._copyValues(kept_model)
    kept_model._transfer_params_to_java()
    return kept_model
