"""The live path as one stream: messages, rejects, scores, late rows, alerts with a cooldown, deliveries.

Each micro-batch is a chain of batch operators in ``foreachBatch``. What it carries over (rows that the watermark has not
passed, the last alert of each key, the watermark itself) is a small table per batch id, read from the batch before and
written anew, so a batch that is run again gives the same tables and a restart goes on from the last finished one. State
is rows in shared storage, not objects of a key: a busy key is handled by the batch rule's hot path, what is written
grows with the rows that wait, and keys silent for the cooldown leave.

Rows wait for the watermark (the latest time seen less ``delay_us``) and are judged in order of time, then ``order``, so
flags equal those of one batch job over all rows in time, however they arrived. Rows behind the watermark go to a table of
their own and are counted.
"""

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.contracts import ALERT_TTL_US
from flowspark.operators.alerts import ALERT_KEY, alert_stream, deliver
from flowspark.operators.cooldown import with_cooldown
from flowspark.session import cut_lineage
from flowspark.sources.messages import decode_json
from flowspark.sources.sinks import write_batch_once

PROGRESS = ("messages bigint, rejects bigint, late bigint, scored bigint, alerts bigint, deliveries bigint, "
            "watermark_us bigint, latency_us bigint, batch_us bigint")
NO_TIME = -(1 << 62)


@dataclass
class LivePath:
    """The path of one stream. ``score`` gets decoded rows and adds ``attack_prob`` and ``label``; rows need ``ts_us``, the
    alert key and the ``order`` columns. Tables are folders under ``out``, one subfolder per batch id."""

    schema: str
    score: Callable[[DataFrame], DataFrame]
    out: str
    subscribers: DataFrame
    order: list[str]
    delay_us: int
    ttl_us: int = ALERT_TTL_US
    defaults: dict = field(default_factory=dict)

    def _before(self, spark: SparkSession, name: str, batch_id: int, schema: str) -> DataFrame:
        if batch_id == 0:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{self.out}/{name}/batch_id={batch_id - 1}")

    def __call__(self, messages: DataFrame, batch_id: int) -> None:
        """One micro-batch."""
        spark, began = messages.sparkSession, time.time()
        held = messages.persist()
        try:
            self._batch(spark, held, batch_id, began)
        finally:
            held.unpersist()

    def _batch(self, spark: SparkSession, messages: DataFrame, batch_id: int, began: float) -> None:
        rows, rejects = decode_json(messages, self.schema, self.defaults)
        write_batch_once(rejects, batch_id, f"{self.out}/rejects")
        last = self._before(spark, "progress", batch_id, PROGRESS).select("watermark_us").first()
        before = NO_TIME if last is None else last[0]
        start = time.time()
        scored = cut_lineage(self.score(rows))  # scored once, read by every table below
        timed = F.coalesce(F.col("ts_us") >= before, F.lit(False))  # a row without a time is late
        counted = scored.agg(F.count("*").alias("n"), F.max("ts_us").alias("top")).first()
        latency = round((time.time() - start) * 1e6 / counted["n"]) if counted["n"] else 0
        watermark = max(before, NO_TIME if counted["top"] is None else counted["top"] - self.delay_us)
        late = scored.filter(~timed)
        write_batch_once(late, batch_id, f"{self.out}/late")
        kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scored.schema)
        pool = self._before(spark, "waiting", batch_id, kind).unionByName(scored.filter(timed))
        totals = self._judge(spark, pool, batch_id, watermark, kind)
        numbers = (messages.count(), rejects.count(), late.count(), counted["n"], *totals, watermark, latency,
                   round((time.time() - began) * 1e6))
        # The batch is finished once its progress row is there; it is written last.
        write_batch_once(spark.createDataFrame([numbers], PROGRESS).coalesce(1), batch_id, f"{self.out}/progress")

    def _judge(self, spark: SparkSession, pool: DataFrame, batch_id: int, watermark: int, kind: str) -> tuple[int, int]:
        """Flag the rows that the watermark has passed and deliver their alerts; the rest waits."""
        write_batch_once(pool.filter(F.col("ts_us") >= watermark), batch_id, f"{self.out}/waiting")
        ripe = pool.filter(F.col("ts_us") < watermark)
        keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pool.schema if f.name in ALERT_KEY)
        fired = self._before(spark, "fired", batch_id, f"{keys}, ts_us bigint")
        attack = F.coalesce(F.col("label") == 1, F.lit(False))
        # An earlier alert stands first in its key: it fires again, and what follows is judged from it.
        judged = fired.withColumn("_old", F.lit(True)).unionByName(
            ripe.filter(attack).withColumn("_old", F.lit(False)), allowMissingColumns=True).withColumn("_new", (~F.col("_old")).cast("int"))
        flagged = cut_lineage(with_cooldown(judged, ALERT_KEY, "ts_us", ["_new", *self.order], self.ttl_us, "alert"))
        alive = flagged.filter("alert").groupBy(*ALERT_KEY).agg(F.max("ts_us").alias("ts_us")).filter(
            F.col("ts_us") + self.ttl_us > watermark)
        write_batch_once(alive, batch_id, f"{self.out}/fired")
        new = flagged.filter(~F.col("_old")).drop("_old", "_new").unionByName(
            ripe.filter(~attack).withColumn("alert", F.lit(False)))
        write_batch_once(new, batch_id, f"{self.out}/scored")
        alerts = alert_stream(flagged.filter(~F.col("_old")))
        write_batch_once(deliver(alerts, self.subscribers), batch_id, f"{self.out}/delivered")
        sent = spark.read.parquet(f"{self.out}/delivered/batch_id={batch_id}").count()
        return alerts.count(), sent

    def run(self, messages: DataFrame, checkpoint: str) -> None:
        """Take what is available, from where the last run with this checkpoint ended; waits for the end."""
        writer = messages.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)
        writer.trigger(availableNow=True).start().awaitTermination()

    def finish(self, spark: SparkSession) -> None:
        """Judge the rows that still wait, when nothing more will come."""
        last = self.table(spark, "progress").agg(F.max("batch_id")).first()[0]
        if last is None:
            return
        kind = self.table(spark, "waiting").drop("batch_id")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind.schema)
        pool = self._before(spark, "waiting", last + 1, schema)
        totals = self._judge(spark, pool, last + 1, 1 << 62, schema)
        row = (0, 0, 0, 0, *totals, 1 << 62, 0, 0)
        write_batch_once(spark.createDataFrame([row], PROGRESS).coalesce(1), last + 1, f"{self.out}/progress")

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        """``rejects``, ``late``, ``scored``, ``delivered`` or ``progress`` of all batches so far, with ``batch_id``."""
        return spark.read.parquet(f"{self.out}/{name}")
