"""How many tasks a fit runs in."""

from flowspark.operators import training as M
from flowspark.session import stored


def test_a_fit_has_no_more_tasks_than_cores_take_in_two_turns(spark):
    cores = spark.sparkContext.defaultParallelism
    many = spark.range(0, 100 * 2 * cores, numPartitions=4 * cores)
    assert M.packed(many, 100).rdd.getNumPartitions() == 2 * cores
    assert M.packed(many, 10).rdd.getNumPartitions() == 2 * cores  # a tenth of the rows a task, as many tasks
    assert M.packed(many.limit(150), 100).rdd.getNumPartitions() <= 2
    assert M.packed(many.limit(0), 100).rdd.getNumPartitions() <= 1


def test_rows_of_a_task_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(M, "MOST_TASK_ROWS", 50)
    cores = spark.sparkContext.defaultParallelism
    many = spark.range(0, 50 * 3 * cores, numPartitions=8 * cores)
    assert M.fit_tasks(many, 10) == 3 * cores


def test_a_stored_table_of_few_files_is_dealt_out(spark):
    cores = spark.sparkContext.defaultParallelism
    table = stored(spark.range(0, cores * M.TASK_ROWS, numPartitions=1))
    rows = M.spread(table)
    assert rows.rdd.getNumPartitions() == cores and rows.count() == rows.distinct().count() == cores * M.TASK_ROWS
