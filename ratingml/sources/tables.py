"""Tables in delimited files and Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ratingml.schemas import RATINGS


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV with a header and a known schema; a bad field becomes null, the row stays."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; types come from one more pass over the file."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def read_label_first(spark: SparkSession, path: str, label: str = "label", schema: StructType | str | None = None) -> DataFrame:
    """Headerless CSV whose first column is the label; the rest keep ``_c<i>``.

    With a ``schema`` (names ``_c0``, ``_c1``, ...) two files get the same types and
    are read once; without one the types come from one more pass over the file.
    """
    reader = spark.read.option("header", False)
    reader = reader.option("inferSchema", True) if schema is None else reader.schema(schema)
    return reader.csv(path).withColumnRenamed("_c0", label)


def numbers_schema(spark: SparkSession, path: str, label: str = "int") -> str:
    """Schema of a label-first file of numbers, from its first line, so that no pass is spent on types."""
    names = spark.read.option("header", False).csv(path).columns
    return ", ".join([f"_c0 {label}", *[f"{n} double" for n in names[1:]]])


def read_delimited_ratings(
    spark: SparkSession,
    path: str,
    sep: str = ",",
    schema: StructType = RATINGS,
    bad_rows: str = "fail",
) -> DataFrame:
    """Rating lines of exactly the fields of ``schema``, at any separator.

    ``bad_rows="fail"`` stops at a malformed line. ``"keep"`` adds the raw text
    of such lines as ``_bad_line`` (null for good lines).
    """
    if bad_rows not in ("fail", "keep"):
        raise ValueError("bad_rows must be 'fail' or 'keep'")
    lines = spark.read.text(path).filter(F.trim("value") != "")
    fields = F.split("value", "\\Q" + sep + "\\E", -1)
    typed = [F.trim(F.get(fields, F.lit(i))).try_cast(f.dataType) for i, f in enumerate(schema.fields)]
    bad = F.size(fields) != len(schema.fields)
    for value in typed:
        bad = bad | value.isNull()
    if bad_rows == "fail":
        # a filter, so that a count or a read of one column meets the bad lines, too
        stop = F.raise_error(F.concat(F.lit("malformed line: "), F.col("value"))).cast("boolean")
        lines = lines.filter(F.when(bad, stop).otherwise(F.lit(True)))
        return lines.select(*[v.alias(f.name) for v, f in zip(typed, schema.fields)])
    columns = [F.when(~bad, v).alias(f.name) for v, f in zip(typed, schema.fields)]
    return lines.select(*columns, F.when(bad, F.col("value")).alias("_bad_line"))


def read_dense_matrix(
    spark: SparkSession, path: str, n_features: int | None = None, missing: float | None = 0.0
) -> DataFrame:
    """Label-first numeric file as ``label float, features array<float>``.

    Empty lines are skipped and entries equal to ``missing`` become null. Give
    ``n_features`` to spare the look at the first line.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    if n_features is None:
        first = lines.first()
        if first is None:
            n_features = 0
        else:
            n_features = len(first["value"].split(",")) - 1
    fields = F.split(F.trim("value"), ",")
    parsed = lines.select(
        F.when(F.size(fields) == n_features + 1, fields)
        .otherwise(F.raise_error(F.concat(F.lit("wrong number of fields: "), F.col("value"))))
        .alias("f")
    )
    values = F.slice("f", 2, n_features)

    def entry(x):
        number = F.trim(x).cast("float")
        return number if missing is None else F.nullif(number, F.lit(missing).cast("float"))

    return parsed.select(
        F.trim(F.col("f")[0]).cast("float").alias("label"), F.transform(values, entry).alias("features")
    )


def write_parquet(
    df: DataFrame, path: str, drop: Sequence[str] = (), single_file: bool = False
) -> None:
    """Overwrite ``path``; one output file only when asked, as one task then writes all."""
    out = df.drop(*drop)
    (out.coalesce(1) if single_file else out).write.mode("overwrite").parquet(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def flatten_arrays(df: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Replace array columns by ``<name>_1`` .. ``<name>_n``, as text files need."""
    wanted = []
    for field in df.schema.fields:
        if isinstance(field.dataType, ArrayType):
            wanted += [F.col(field.name)[i].alias(f"{field.name}_{i + 1}") for i in range(sizes[field.name])]
        else:
            wanted.append(F.col(field.name))
    return df.select(*wanted)


def write_headerless_csv(df: DataFrame, path: str) -> None:
    """Plain CSV without a header; the first column is the label by convention."""
    df.write.mode("overwrite").option("header", False).csv(path)


def write_label_first(df: DataFrame, label: str, fields: str, path: str) -> None:
    """The same kind of file from a number and the other fields of its line, joined already (see ``to_csv``)."""
    line = F.concat(F.coalesce(F.col(label).cast("string"), F.lit("")), F.lit(","), F.coalesce(F.col(fields), F.lit("")))
    df.select(line.alias("value")).write.mode("overwrite").text(path)
