"""What stored tables take on disk, and what is gone when they stand."""

import os

from pyspark.sql import functions as F

from flowspark.operators.ordinal import with_ordinal
from flowspark.plans import inputs
from flowspark.session import _checkpoint_folder, passing_tables, stored


def _files(spark):
    top = _checkpoint_folder(spark).removeprefix("file:")
    return {f"{d}/{n}": os.path.getsize(f"{d}/{n}") for d, _, names in os.walk(top) for n in names}


def _bytes_since(spark, before):
    return sum(size for path, size in _files(spark).items() if path not in before)


def _wide(spark, rows):
    return spark.range(rows).select("id", *[(F.col("id") % (i + 2)).cast("double").alias(f"c{i}") for i in range(40)])


def test_a_derived_table_is_all_that_stays_on_disk(spark, tmp_path):
    """20,000 rows of 41 numbers are 6.6 MB one by one; numbering and keeping them took a checkpoint each."""
    before = set(_files(spark))
    df = inputs.once("numbered", spark, str(tmp_path), lambda: with_ordinal(_wide(spark, 20_000), [], ["id"], "n"))
    assert _bytes_since(spark, before) < 2_000_000
    assert df.filter("id <> n").count() == 0 and df.count() == 20_000
    left = {path.split("/table-")[1].split("/")[0] for path in set(_files(spark)) - before if "/table-" in path}
    assert len(left) == 1


def test_passing_tables_go_and_kept_ones_stay(spark):
    with passing_tables(spark):
        first = stored(spark.range(5))
        with passing_tables(spark):
            kept = stored(first.selectExpr("id * 2 as id"), keep=True)
        assert first.count() == 5
    assert sorted(r["id"] for r in kept.collect()) == [0, 2, 4, 6, 8]
    assert not os.path.exists(first.inputFiles()[0].removeprefix("file:"))


def test_the_setting_for_shuffles_is_put_back(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    spark.conf.set(name, "false")
    stored(spark.range(3))
    assert spark.conf.get(name) == "false"
    spark.conf.unset(name)
