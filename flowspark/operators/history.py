"""Connection-history counts over the last 100 flows of a capture."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowspark.contracts import HISTORY_COUNTS, HISTORY_FLOWS

BLOCK_FLOWS = 16_384


def add_history(flows: DataFrame, order: str = "emit_no", window: int = HISTORY_FLOWS,
                block: int = BLOCK_FLOWS, group: str = "capture_id") -> DataFrame:
    """Add the seven ``ct_*`` counts: how many of the last ``window`` flows (this one included) agree.

    ``order`` is dense within ``group``. The window is bounded, so a capture is cut into blocks of
    consecutive flows and each block also gets the last ``window - 1`` flows of the one before it.
    One shuffle on (group, block) serves all seven windows, and no task ever holds more than a block,
    whatever the size of a capture or of one address.
    """
    if block < window:
        raise ValueError("a block must hold a whole window")
    n, reach = F.col(order), window - 1
    own = F.expr(f"{order} div {block}")
    near_end = n % block >= block - reach
    blocks = F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))
    spread = flows.withColumn("_own", own).withColumn("_block", F.explode(blocks))
    spread = spread.repartition(group, "_block")
    counts = {
        name: F.count("*").over(
            W.partitionBy(group, "_block", *keys).orderBy(order).rangeBetween(-reach, 0)
        ).cast("int")
        for name, keys in HISTORY_COUNTS.items()
    }
    return spread.withColumns(counts).filter(F.col("_block") == F.col("_own")).drop("_own", "_block")
