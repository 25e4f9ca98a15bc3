import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from ratingml import schemas, storage
from ratingml.sources import tables
from ratingml.storage import scratch_path, shared_dir


def _write(path, text):
    path.write_text(text)
    return str(path)


def test_fixed_schema_keeps_a_row_with_a_bad_field(spark, tmp_path):
    path = _write(
        tmp_path / "items.csv",
        "item_id,name,genre,type,episodes,rating,members\n"
        '1,"A, b","X, Y",TV,Unknown,7.5,10\n2,C,,,12,,20\n',
    )
    got = rows_of(tables.read_csv(spark, path, schemas.ITEMS))
    assert got == [(1, "A, b", "X, Y", "TV", None, 7.5, 10), (2, "C", None, None, 12, None, 20)]


def test_inferred_schema(spark, tmp_path):
    path = _write(tmp_path / "r.csv", "user_id,item_id,rating\n1,2,-1\n3,4,10\n")
    found = tables.read_csv_inferred(spark, path)
    assert found.dtypes == [("user_id", "int"), ("item_id", "int"), ("rating", "int")]


def test_label_first(spark, tmp_path):
    path = _write(tmp_path / "m.csv", "5,1.5,0\n7,,1\n")
    found = tables.read_label_first(spark, path)
    assert found.columns == ["label", "_c1", "_c2"]
    assert rows_of(found) == [(5, 1.5, 0), (7, None, 1)]


def test_delimited_ratings(spark, tmp_path):
    good = _write(tmp_path / "good", "1::2::3\n4::5::6\n")
    assert rows_of(tables.read_delimited_ratings(spark, good, "::")) == [(1, 2, 3), (4, 5, 6)]
    bad = _write(tmp_path / "bad", "1::2::3\n4::5\nx::1::2\n1::2::3::4\n")
    with pytest.raises(Exception):
        tables.read_delimited_ratings(spark, bad, "::").collect()
    kept = tables.read_delimited_ratings(spark, bad, "::", bad_rows="keep")
    assert rows_of(kept.filter("_bad_line is null").drop("_bad_line")) == [(1, 2, 3)]
    assert kept.filter("_bad_line is not null").count() == 3
    for i, line in enumerate(["1::2", "1::2::3::4", "1::2::x", "1::::3"]):
        one = tables.read_delimited_ratings(spark, _write(tmp_path / f"bad{i}", f"1::2::3\n{line}\n"), "::")
        for read in (one.count, one.select("user_id").collect):
            with pytest.raises(Exception, match="malformed line"):
                read()
    with pytest.raises(ValueError):
        tables.read_delimited_ratings(spark, good, "::", bad_rows="ignore")


def test_dense_matrix(spark, tmp_path):
    path = _write(tmp_path / "d.csv", "3,1.5,0\n\n   \n4,0.0,2\n")
    for n in (None, 2):
        got = rows_of(tables.read_dense_matrix(spark, path, n_features=n))
        assert got == [(3.0, [1.5, None]), (4.0, [None, 2.0])]
    assert rows_of(tables.read_dense_matrix(spark, path, missing=None))[0] == (3.0, [1.5, 0.0])
    uneven = _write(tmp_path / "u.csv", "3,1.5,0\n4,2\n")
    with pytest.raises(Exception, match="wrong number of fields"):
        tables.read_dense_matrix(spark, uneven).collect()


def test_parquet_overwrite_and_single_file(spark, tmp_path):
    df = spark.range(100).repartition(5).withColumn("helper", F.lit(1))
    path = str(tmp_path / "t.parquet")
    tables.write_parquet(df, path)
    tables.write_parquet(df, path, drop=["helper", "absent"], single_file=True)
    back = tables.read_parquet(spark, path)
    assert back.columns == ["id"] and back.count() == 100
    assert len(list((tmp_path / "t.parquet").glob("part-*"))) == 1


def test_headerless_csv_of_flattened_arrays(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.5, 2.0])], "label int, v array<double>")
    path = str(tmp_path / "flat")
    tables.write_headerless_csv(tables.flatten_arrays(df, {"v": 2}), path)
    assert rows_of(tables.read_label_first(spark, path)) == [(1, 0.5, 2.0)]


def test_shared_dir_is_the_configured_one(spark):
    assert spark.conf.get("spark.checkpoint.dir") in shared_dir(spark)
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_stored_tables_are_in_one_folder_per_run(spark, monkeypatch, tmp_path):
    import os

    from ratingml import storage

    monkeypatch.setattr(storage, "shared_dir", lambda session: str(tmp_path))
    kept = storage.durable(spark.range(3))
    assert kept.count() == 3 and len(os.listdir(tmp_path)) == 1
    assert storage.remove_run(spark) and os.listdir(tmp_path) == [] and not storage.remove_run(spark)


def test_rows_of_a_learner_are_dealt_over_many_tasks(spark):
    one = spark.range(0, 5000, 1, 1)
    parts = storage.spread(one, rows=300)
    sizes = [r["count"] for r in parts.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 17 and max(sizes) <= 400
    assert parts.agg(F.count("id"), F.sum("id")).first()[:] == (5000, 12497500)
    # few rows stay as they are
    assert storage.spread(one).rdd.getNumPartitions() == 1
