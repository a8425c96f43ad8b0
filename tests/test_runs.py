"""Sources run one by one: failures in planning and in tasks are rows, the others complete."""

import pytest
from pyspark.sql import functions as F

from undertone.sources.runs import run_sources


def test_failing_sources_leave_rows(spark):
    good = spark.range(10).withColumn("source", F.lit("good"))
    broken = F.when(F.col("id") == 7, F.raise_error(F.lit("closed at 7")).cast("string")).otherwise("late")
    readers = {
        "good": lambda: good,
        "wide": lambda: good.withColumn("more", F.lit(1)),
        "late": lambda: spark.range(0, 1000, 1, 5).withColumn("source", broken),
        "missing": lambda: spark.read.parquet("/tmp/no_such_folder_of_rows"),
        "empty": lambda: good.filter("false"),
    }
    rows, errors = run_sources(spark, readers)
    assert rows.count() == 20 and set(rows.columns) == {"id", "source", "more"}
    found = {r["source"]: r for r in errors.collect()}
    assert set(found) == {"late", "missing"}
    assert "closed at 7" in found["late"]["message"] and found["late"]["error_class"]
    assert "no_such_folder" in found["missing"]["message"]


def test_all_and_none_fail(spark):
    rows, errors = run_sources(spark, {"missing": lambda: spark.read.parquet("/tmp/no_such_folder_of_rows")})
    assert rows is None and errors.count() == 1
    rows, errors = run_sources(spark, {})
    assert rows is None and errors.count() == 0
    rows, errors = run_sources(spark, {"one": lambda: spark.range(3)})
    assert rows.count() == 3 and errors.count() == 0


def test_mistakes_of_a_reader_are_raised(spark):
    with pytest.raises(KeyError):
        run_sources(spark, {"bad": lambda: {}["nothing"]})
