"""Search over a stream of queries: each micro-batch is a batch of queries against a fixed engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from tesselar.operators.search import Engine


def search_stream(engine: Engine, queries: DataFrame, path: str, checkpoint: str, *, once: bool = False, **how) -> StreamingQuery:
    """Hits of a stream of queries (qid, text), written as Parquet to path under a column `batch`.

    Scoring keeps no state between queries, so a batch that is repeated after a failure writes the same rows to its
    own folder again.
    """

    def write(batch: DataFrame, number: int) -> None:
        engine.search(batch.persist(), **how).write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.unpersist()

    writer = queries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
