"""Keeping a pair index current: new left rows of a stream are joined with a static right table and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import semjoin


def append_pairs(stream: DataFrame, key: str, vec: str, right: DataFrame, right_key: str, right_vec: str, path: str, checkpoint: str, tau: float, metric: str = "l2", width: float = 0.1, available_now: bool = True) -> StreamingQuery:
    """Append the pairs of each micro-batch to the index at `path` (see semjoin.write_index).

    A batch is written under its own `batch` partition in overwrite mode, so a batch that is run
    again after a failure replaces itself.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        p = semjoin.pairs(batch, key, vec, right, right_key, right_vec, tau, metric)
        p.withColumn("dis_bucket", F.floor(F.col("dis") / width).cast("int")).write.partitionBy("dis_bucket").mode("overwrite").parquet(f"{path}/batch={batch_id}")

    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()
