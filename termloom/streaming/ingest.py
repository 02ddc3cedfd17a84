"""Near-real-time indexing: a stream of documents, committed batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..index.store import Conflict, Index

#: Times that a batch is tried again when another writer has committed.
RETRIES = 5


def ingest(docs: DataFrame, root: str, checkpoint: str, interval: str | None = "", compact: bool = False, config: Config | None = None) -> StreamingQuery:
    """Adds a stream of documents (text, and doc_id or ext_id) to the index in ``root``, which is made if it isn't there.

    Each batch is a generation. The index keeps the number of the last one of each stream, which is known by the query id that its
    checkpoint holds, so that a batch that is run again is added once, and several streams can feed one index; where two
    commit at the same time, one of them repeats. ``interval``: time between commits, ``Config.flush_interval`` by default; None
    takes what there is and stops. ``compact``: generations are merged when they are worth it.
    """
    spark = docs.sparkSession
    config = config or Config.from_session(spark)
    if interval == "":
        interval = f"{config.flush_interval} seconds" if config.auto_flush else None

    def add(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        for again in range(RETRIES, -1, -1):
            index = Index.open(batch.sparkSession, root, create=True, config=config)
            try:
                index.add(batch, batch=(stream, number))
                if compact and (own := index.candidates()):
                    index.compact(own)
                return
            except Conflict:
                if not again:
                    raise

    writer = docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)).start()
