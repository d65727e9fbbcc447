"""A running comparison: each micro-batch of a stream against what is expected of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sqlverdict.operators import bagdiff


def watch(stream: DataFrame, expected: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, names: list[str] | None = None) -> StreamingQuery:
    """Write one row (batch, expected_rows, actual_rows, missing, extra) for each micro-batch to out, once each.

    expected gives, for a batch, the rows that it should have. A batch that is run again overwrites its own row.
    """

    def compare(batch: DataFrame, number: int) -> None:
        found = bagdiff.bag_diff(expected(batch), batch, names or batch.columns)
        found.select(F.lit(number).alias("batch"), "*").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(compare).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
