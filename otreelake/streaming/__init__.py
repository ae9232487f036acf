"""Tables as the target of Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..table import OTreeTable


def ingest(stream: DataFrame, path: str, app_id: str, checkpoint: str, trigger: dict | None = None, stage: bool = False, **options) -> StreamingQuery:
    """Appends every micro-batch to the table, each once: a batch that is run again after a failure finds its version committed. stage: without indexing, for many small batches; optimize(0) indexes them later."""

    def write(batch: DataFrame, version: int) -> None:
        table = OTreeTable(batch.sparkSession, path)
        if stage and table.exists():
            table.stage(batch, txn=(app_id, version))
        else:
            table.append(batch, txn=(app_id, version), **options)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
