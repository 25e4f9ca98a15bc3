import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ratingml.session import build_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[8]",
        "tests",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__driver__memory="8g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def signal_rows(spark, sf_dir):
    """Cleaned rows whose rating depends on item, type and user, with a class label, stored once."""
    from pyspark.sql import functions as F

    from ratingml.operators.clean import process
    from ratingml.plans.fixtures import joined

    rows = joined(spark, sf_dir).withColumn("web_rating", F.col("web_rating") * 5)
    base = F.floor(F.coalesce("web_rating", F.lit(5.0))) + F.col("user_id") % 3 - 1
    planted = base + F.when(F.col("type") == "PROMO", 3).otherwise(0)
    rows = rows.withColumn("rating", F.least(F.lit(10), F.greatest(F.lit(1), planted)).cast("int"))
    rows = process(rows).persist()
    rows.count()
    return rows


def rows_of(df):
    """Rows as plain tuples, in a fixed order."""
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((v is None, str(v)) for v in t))
