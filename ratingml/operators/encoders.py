"""Category encoders: multi-hot, one-hot columns and dense indexes.

Value lists of low-cardinality columns are read to the driver behind a bound.
Indexes of user or item ids are never collected: the key table is numbered and
joined back by Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Transformer
from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasInputCols, HasOutputCols
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ratingml.functions import flag, multi_values
from ratingml.operators.profile import MAX_VALUES, categories, vocabulary
from ratingml.operators.skew import MAX_GROUP_ROWS, number_rows
from ratingml.operators.skew import join as join_keys


class _MultiHotParams(HasInputCol):
    prefix = Param(Params._dummy(), "prefix", "start of each output column name", TypeConverters.toString)
    sep = Param(Params._dummy(), "sep", "separator of the values", TypeConverters.toString)

    def getPrefix(self) -> str:
        if self.isSet(self.prefix):
            return self.getOrDefault(self.prefix)
        return self.getInputCol() + "_"

    def getSep(self) -> str:
        return self.getOrDefault(self.sep)


class MultiHotEncoder(Transformer, _MultiHotParams, DefaultParamsReadable, DefaultParamsWritable):
    """One 0/1 column for each given value of a multi-valued text column.

    A null text gives null flags. Fill it first to give it a value of its own.
    """

    values = Param(Params._dummy(), "values", "vocabulary, one column each", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, inputCol=None, values=None, prefix=None, sep=","):
        super().__init__()
        self._setDefault(sep=",")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def getValues(self) -> list[str]:
        return self.getOrDefault(self.values)

    def getOutputCols(self) -> list[str]:
        return [self.getPrefix() + v for v in self.getValues()]

    def transformSchema(self, schema: StructType) -> StructType:
        return StructType(schema.fields + [StructField(c, IntegerType()) for c in self.getOutputCols()])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        split = multi_values(self.getInputCol(), self.getSep())
        flags = [flag(split, v).alias(c) for v, c in zip(self.getValues(), self.getOutputCols())]
        return dataset.select("*", *flags)


class MultiHotLearner(Estimator, _MultiHotParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the vocabulary for a ``MultiHotEncoder``, up to ``maxValues`` values."""

    maxValues = Param(Params._dummy(), "maxValues", "most values allowed", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, prefix=None, sep=",", maxValues=MAX_VALUES):
        super().__init__()
        self._setDefault(sep=",", maxValues=MAX_VALUES)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> MultiHotEncoder:
        column, sep = self.getInputCol(), self.getSep()
        found = vocabulary(dataset, column, sep, self.getOrDefault(self.maxValues))
        return MultiHotEncoder(inputCol=column, values=found, prefix=self.getPrefix(), sep=sep)


def multi_hot(df: DataFrame, column: str = "genre", fill: str | None = None) -> DataFrame:
    """Learn and apply in one call; ``fill`` first replaces nulls (for example ``MISSING``)."""
    source = df if fill is None else df.fillna({column: fill})
    return MultiHotLearner(inputCol=column).fit(source).transform(source)


def one_hot_columns(
    df: DataFrame, column: str, values: Sequence | None = None, prefix: str = ""
) -> DataFrame:
    """One 0/1 column per category, none left out; null gives all zeros."""
    found = categories(df, column) if values is None else list(values)
    flags = [F.coalesce((F.col(column) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{prefix}{v}") for v in found]
    return df.select("*", *flags)


def frequency_indexer(inputs: Sequence[str], outputs: Sequence[str], invalid: str = "error") -> StringIndexer:
    """Spark's indexer for low-cardinality categories: most frequent first, ties by name."""
    return StringIndexer(
        inputCols=list(inputs), outputCols=list(outputs), handleInvalid=invalid, stringOrderType="frequencyDesc"
    )


def one_hot_vectors(inputs: Sequence[str], outputs: Sequence[str], drop_last: bool = True) -> OneHotEncoder:
    return OneHotEncoder(
        inputCols=list(inputs), outputCols=list(outputs), handleInvalid="error", dropLast=drop_last
    )


class _KeyIndexParams(HasInputCols, HasOutputCols):
    order = Param(
        Params._dummy(), "order", "frequency (most rows first, ties by text) or value", TypeConverters.toString
    )
    handleInvalid = Param(
        Params._dummy(), "handleInvalid", "null or unseen: error, skip (the row) or keep (null)", TypeConverters.toString
    )
    hotRows = Param(
        Params._dummy(), "hotRows", "join keys with more rows than this without a shuffle", TypeConverters.toInt
    )


class KeyIndexer(Estimator, _KeyIndexParams, DefaultParamsReadable, DefaultParamsWritable):
    """Dense 0-based index of keys of any cardinality, for several columns in one pass.

    The key table is counted, sorted and numbered by Spark; nothing of it reaches
    the driver.
    """

    @keyword_only
    def __init__(
        self, *, inputCols=None, outputCols=None, order="frequency", handleInvalid="error", hotRows=MAX_GROUP_ROWS
    ):
        super().__init__()
        self._setDefault(order="frequency", handleInvalid="error", hotRows=MAX_GROUP_ROWS)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> "KeyIndexModel":
        columns = self.getInputCols()
        order = self.getOrDefault(self.order)
        if order not in ("frequency", "value"):
            raise ValueError("order must be 'frequency' or 'value'")
        # one scan counts all columns: one grouping set for each
        counts = (
            dataset.groupingSets([[F.col(c)] for c in columns], *[F.col(c) for c in columns])
            .agg(F.grouping_id().alias("__set"), F.count(F.lit(1)).alias("__n"))
            .filter(F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull())
        )
        text = F.coalesce(*[F.col(c).cast("string") for c in columns])
        if order == "frequency":
            ranks = [F.col("__n").desc(), text.asc()]
        else:
            ranks = [F.col(c).asc() for c in columns]
        numbered = number_rows(counts, [F.col("__set").asc(), *ranks], "__number")
        # one first number per column
        firsts = numbered.groupBy("__set").agg(F.min("__number")).collect()
        first = F.lit(0).cast("long")
        for key_set, number in firsts:
            first = F.when(F.col("__set") == key_set, F.lit(number)).otherwise(first)
        table = numbered.withColumn("__index", F.col("__number") - first).drop("__number")
        return self._copyValues(KeyIndexModel(table))


class KeyIndexModel(Transformer, _KeyIndexParams, MLReadable, MLWritable):
    """Joins the index of each key; see ``KeyIndexer``."""

    def __init__(self, table: DataFrame | None = None):
        super().__init__()
        self._setDefault(order="frequency", handleInvalid="error", hotRows=MAX_GROUP_ROWS)
        self.table = table

    def keys_of(self, column: str) -> DataFrame:
        """``(column, __n, __index)``: the keys of one input column, their rows and numbers."""
        # grouping_id has a 0 bit for the column of the grouping set, the first column highest
        columns = self.getInputCols()
        key_set = ((1 << len(columns)) - 1) ^ (1 << (len(columns) - 1 - columns.index(column)))
        return self.table.filter(F.col("__set") == key_set).select(column, "__n", "__index")

    def _hot_columns(self, hot_rows: int) -> set[str]:
        heavy = [F.max(F.when(F.col(c).isNotNull(), F.col("__n"))) for c in self.getInputCols()]
        most = self.table.agg(*heavy).first()
        return {c for c, n in zip(self.getInputCols(), most) if n is not None and n > hot_rows}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        invalid = self.getOrDefault(self.handleInvalid)
        hot_rows = self.getOrDefault(self.hotRows)
        hot_columns = self._hot_columns(hot_rows)
        out = dataset
        for source, target in zip(self.getInputCols(), self.getOutputCols()):
            keys = self.keys_of(source)
            how = "inner" if invalid == "skip" else "left"
            hot = keys.filter(F.col("__n") > hot_rows).select(source) if source in hot_columns else None
            out = join_keys(out, keys.drop("__n"), source, how, known_hot=hot)
            index = F.col("__index")
            if invalid == "error":
                text = F.coalesce(F.col(source).cast("string"), F.lit("null"))
                bad = F.raise_error(F.concat(F.lit(f"no index for {source}: "), text))
                index = F.when(index.isNotNull(), index).otherwise(bad.cast("long"))
            rest = [c for c in out.columns if c not in ("__index", target)]
            out = out.select(*rest, index.cast("long").alias(target))
        return out

    def write(self) -> MLWriter:
        return _KeyIndexWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _KeyIndexReader(cls)


class _KeyIndexWriter(MLWriter):
    def __init__(self, instance: KeyIndexModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.table.write.parquet(path + "/keys")


class _KeyIndexReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> KeyIndexModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls(self.sparkSession.read.parquet(path + "/keys"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


def sparse_multi_hot(df: DataFrame, values: str, keys: Sequence[str]) -> DataFrame:
    """``keys, slots``: per row the sorted slots of its distinct values; no bound on the vocabulary.

    Values are numbered in their order over the whole cluster and joined back, so no
    value list reaches the driver and no column exists per value. Keys tell rows
    apart. Rows without a value (null or empty array, or nulls only) have no slot.
    """
    present = F.filter(F.array_distinct(values), lambda v: v.isNotNull())
    each = df.select(*keys, F.explode(present).alias("__value"))
    numbered = number_rows(each.select("__value").distinct(), [F.col("__value").asc()], "__slot")
    found = each.join(numbered, "__value").groupBy(*keys).agg(F.sort_array(F.collect_list("__slot")).alias("slots"))
    # apart, so that rows without a value need no shuffle
    bare = df.filter(F.coalesce(F.size(present), F.lit(0)) <= 0).select(*keys, F.array().cast("array<bigint>").alias("slots"))
    return found.unionByName(bare)


def index_in_place(df: DataFrame, columns: Sequence[str], order: str = "frequency", invalid: str = "skip") -> DataFrame:
    """Replace each column by its int index."""
    temporary = [f"__{c}_index" for c in columns]
    model = KeyIndexer(inputCols=list(columns), outputCols=temporary, order=order, handleInvalid=invalid).fit(df)
    indexed = model.transform(df)
    names = dict(zip(columns, temporary))
    return indexed.select(*[F.col(names[c]).alias(c) if c in names else F.col(c) for c in df.columns])


def mark_categorical(df: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Tell tree models that index columns are categories, with this many values each.

    The columns become doubles: the assembler reads the marks of doubles only.
    """
    marked = {
        c: F.col(c).cast("double").alias(c, metadata={"ml_attr": {"type": "nominal", "name": c, "num_vals": n}})
        for c, n in sizes.items()
    }
    return df.select(*[marked.get(c, F.col(c)) for c in df.columns])
