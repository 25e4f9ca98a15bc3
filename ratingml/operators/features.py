"""Feature vectors from cleaned rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.base import Estimator, Transformer
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingml.operators.clean import drop_unrated, fill_constant, sentinel_to_number
from ratingml.operators.encoders import (
    MultiHotLearner,
    frequency_indexer,
    index_in_place,
    one_hot_columns,
    one_hot_vectors,
)
from ratingml.operators.joins import join_items
from ratingml.operators.text import split_tokenizer, word_vectors

NUMERIC = ("episodes", "web_rating", "members")
CATEGORICAL = ("type",)
TEXT = "name"
FEATURES = "featureVector"

Stage = Estimator | Transformer


def assemble(inputs: Sequence[str], output: str, invalid: str = "error") -> VectorAssembler:
    return VectorAssembler(inputCols=list(inputs), outputCol=output, handleInvalid=invalid)


def assemble_all_but(df: DataFrame, label: str, output: str = "feature", invalid: str = "skip") -> DataFrame:
    """Vector of every column but the label; rows with a null are skipped by default."""
    return assemble([c for c in df.columns if c != label], output, invalid).transform(df)


def assemble_positional(df: DataFrame, label: str = "label", output: str = "feature") -> DataFrame:
    """``(feature, label)`` from a label-first file; the label is not a feature."""
    return assemble_all_but(df, label, output, "error").select(output, label)


def scaler(inputs: str = "numbers", output: str = "scaled_numbers") -> StandardScaler:
    """Mean 0 and sample standard deviation 1; a constant column becomes 0."""
    return StandardScaler(inputCol=inputs, outputCol=output, withMean=True, withStd=True)


def feature_stages(
    numeric: Sequence[str] = NUMERIC,
    categorical: Sequence[str] = CATEGORICAL,
    text: str | None = TEXT,
    vector_size: int = 20,
    text_partitions: int | None = None,
    output: str = FEATURES,
    seed: int = 2020,
) -> list[Stage]:
    """Stages from cleaned columns to one vector: one-hot, scaled numbers, word vectors."""
    stages: list[Stage] = []
    parts = []
    if numeric:
        stages += [assemble(numeric, "numbers"), scaler()]
    if categorical:
        indexes = [f"{c}_index" for c in categorical]
        vectors = [f"{c}_one_hot" for c in categorical]
        stages += [frequency_indexer(categorical, indexes), one_hot_vectors(indexes, vectors)]
        parts += vectors
    if numeric:
        parts.append("scaled_numbers")
    if text:
        stages += [
            split_tokenizer(text),
            word_vectors(size=vector_size, seed=seed, partitions=text_partitions),
        ]
        parts.append("word_vectors")
    return [*stages, assemble(parts, output)]


def vector_size(df: DataFrame, column: str = FEATURES) -> int:
    """Length of a vector column, from its metadata; from one row only where that is missing."""
    attributes = df.schema[column].metadata.get("ml_attr", {})
    if "num_attrs" in attributes:
        return attributes["num_attrs"]
    if "attrs" in attributes:
        return sum(len(group) for group in attributes["attrs"].values())
    return df.select(column).first()[0].size


def transformed_size(model: PipelineModel, df: DataFrame, column: str = FEATURES) -> int:
    return vector_size(model.transform(df), column)


def expand_items(items: DataFrame, name_vectors: DataFrame | None = None, key: str = "item_id") -> DataFrame:
    """Items with one-hot type, multi-hot genre and (given) name vectors in place of raw text.

    All flags come from the same row, so no join is needed for them.
    """
    out = MultiHotLearner(inputCol="genre", prefix="genre_").fit(items).transform(items)
    out = one_hot_columns(out, "type", prefix="type_")
    if name_vectors is not None:
        out = out.join(name_vectors, key, "inner")
    return out.drop("name", "genre", "type")


def merge_item_features(
    ratings: DataFrame,
    item_features: DataFrame,
    key: str = "item_id",
    user: str = "user_id",
    hot_rows: int | None = None,
) -> DataFrame:
    """Ratings with their item's features; ids dropped and the label first."""
    merged = join_items(ratings, item_features, key, hot_rows)
    rest = [F.col(f"`{c}`") for c in merged.columns if c not in (key, user, "rating")]
    return merged.select("rating", *rest)


def ordinal_rows(
    ratings: DataFrame,
    items: DataFrame,
    whole_row: bool = False,
    indexed: Sequence[str] = ("user_id", "item_id", "type"),
    hot_rows: int | None = None,
) -> DataFrame:
    """Rated rows with item columns, text ``episodes`` made a number and ids made sorted ranks.

    Null types stay null. The user's ``rating`` is the label and is kept as it
    was, also for rows that ``whole_row=True`` sets to zero.
    """
    joined = join_items(drop_unrated(ratings), items.drop("name", "genre"), hot_rows=hot_rows)
    numbers = sentinel_to_number(
        joined, "episodes_raw", whole_row=whole_row, keep=["rating"], output="episodes"
    ).drop("episodes_raw")
    return index_in_place(numbers, indexed, order="value", invalid="keep")


def prepared_items(items: DataFrame, median: float | None) -> DataFrame:
    """Items with text gaps named, the rating gap filled and ``episodes`` numeric."""
    fills = {"genre": "Missing", "type": "Missing"}
    if median is not None:
        fills["web_rating"] = median
    named = fill_constant(items, fills)
    return sentinel_to_number(named, "episodes_raw", output="episodes").drop("episodes_raw")
