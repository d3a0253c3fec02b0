"""New rows of a stream go to fixed centers as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.assign import nearest_center


def assign_stream(rows: DataFrame, centers: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append (id, center_id, d, is_self, label_name) of streamed rows (id, embedding, label_name) to Parquet. A batch
    that is run again replaces what it wrote, as it has a folder of its own."""

    def write(batch: DataFrame, number: int) -> None:
        nearest_center(batch, centers).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
