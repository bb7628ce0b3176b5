"""Connection-history counts of a flow stream, a capture spread over many tasks.

Every micro-batch counts the flows that the watermark has passed with the batch operator, which cuts each capture into
blocks that carry the flows before them. From batch to batch go the flows that still wait and, of each capture, the last
``window - 1`` flows counted so far. Both are tables of their batch id, written anew when a batch is run again.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.contracts import HISTORY_FLOWS
from flowspark.operators.history import BLOCK_FLOWS, add_history
from flowspark.session import cut_lineage
from flowspark.sources.sinks import write_batch_once

NO_TIME = -(1 << 62)


@dataclass
class HistoryPath:
    """Counts over the last ``window`` flows of a ``group`` by ``order``, which is dense in it and follows ``time``.

    Flows wait until the watermark, the latest ``time`` less ``delay_us``, has passed them; flows behind it go to the
    table ``late``, those without a time or order too.
    """

    out: str
    order: str = "emit_no"
    time: str = "emit_us"
    delay_us: int = 10_000_000
    window: int = HISTORY_FLOWS
    block: int = BLOCK_FLOWS
    group: str = "capture_id"

    def _before(self, spark: SparkSession, name: str, batch_id: int, schema: str) -> DataFrame:
        if batch_id == 0:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{self.out}/{name}/batch_id={batch_id - 1}")

    def __call__(self, flows: DataFrame, batch_id: int) -> None:
        """One micro-batch."""
        spark = flows.sparkSession
        last = self._before(spark, "progress", batch_id, "watermark_us bigint, late bigint").first()
        before = NO_TIME if last is None else last[0]
        held = flows.persist()
        try:
            timed = F.coalesce((F.col(self.time) >= before) & F.col(self.order).isNotNull(), F.lit(False))
            write_batch_once(held.filter(~timed), batch_id, f"{self.out}/late")
            top, late = held.agg(F.max(self.time), F.count_if(~timed)).first()
            watermark = max(before, NO_TIME if top is None else top - self.delay_us)
            self._count(spark, held.filter(timed), batch_id, watermark)
            # Written last: with it the batch is finished.
            progress = spark.createDataFrame([(watermark, late)], "watermark_us bigint, late bigint")
            write_batch_once(progress.coalesce(1), batch_id, f"{self.out}/progress")
        finally:
            held.unpersist()

    def _count(self, spark: SparkSession, new: DataFrame, batch_id: int, watermark: int) -> None:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema)
        pool = self._before(spark, "waiting", batch_id, schema).unionByName(new)
        write_batch_once(pool.filter(F.col(self.time) >= watermark), batch_id, f"{self.out}/waiting")
        carried = self._before(spark, "carried", batch_id, schema).withColumn("_new", F.lit(False))
        every = cut_lineage(carried.unionByName(pool.filter(F.col(self.time) < watermark).withColumn("_new", F.lit(True))))
        ends = every.groupBy(self.group).agg(F.max(self.order).alias("_end"))
        tail = every.join(ends, self.group).filter(F.col(self.order) > F.col("_end") - (self.window - 1)).drop("_end", "_new")
        write_batch_once(tail, batch_id, f"{self.out}/carried")
        counted = add_history(every, self.order, self.window, self.block, self.group)
        write_batch_once(counted.filter("_new").drop("_new"), batch_id, f"{self.out}/counted")

    def run(self, flows: DataFrame, checkpoint: str) -> None:
        """Take what is available, from where the last run with this checkpoint ended; waits for the end."""
        writer = flows.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)
        writer.trigger(availableNow=True).start().awaitTermination()

    def finish(self, spark: SparkSession) -> None:
        """Count the flows that still wait, when nothing more will come."""
        found = self.table(spark, "progress").agg(F.max("batch_id")).first()[0]
        if found is not None:
            self._count(spark, self.table(spark, "waiting").drop("batch_id").limit(0), found + 1, 1 << 62)

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        """``counted``, ``late`` or ``progress`` of all batches so far, with ``batch_id``."""
        return spark.read.parquet(f"{self.out}/{name}")
