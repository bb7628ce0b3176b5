"""Reading the given tables and keeping intermediate ones."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.session import scratch_folder

#: Sides of at most this many narrow rows (an id and a few numbers) are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back, so later jobs see one fixed result."""
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores appended until no column of ``df`` bears it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def sized(df: DataFrame) -> DataFrame:
    """A stored table with a broadcast hint if its counted rows allow it; the join gives the same rows without."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
