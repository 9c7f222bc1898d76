"""Background refresh as a file stream: each trigger refreshes the store for the files that came."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store

LISTING = "path string, modificationTime timestamp, length long, content binary"


def refresh_stream(store: Store, projects_root: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Watch projects_root/*/*.jsonl. once: take what is there and stop; else go on in micro-batches.

    The stream only tells that something came; what has to be read the manifest decides, so a repeated
    micro-batch changes nothing.
    """

    def on_batch(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.refresh(projects_root)

    files = store.spark.readStream.format("binaryFile").schema(LISTING).load(f"{projects_root.rstrip('/')}/*/*.jsonl").select("path", "modificationTime")
    out = files.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime="30 seconds")).start()
