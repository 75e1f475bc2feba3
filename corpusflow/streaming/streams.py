"""Pipelines on Structured Streaming.

Row-local stages compile to the same columns as in batch.  Stages that look at all
documents run in ``foreachBatch`` against their key table: each micro-batch writes a
part named by its number, so a repeated batch gives the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusflow.operators.dedup import KeyTableDeduplicator
from corpusflow.plans.pipeline import Pipeline
from corpusflow.plans.stage import GlobalStage


def start(pipeline: Pipeline, stream: DataFrame, out: str, checkpoint: str, everything: bool = False, **trigger: object) -> StreamingQuery:
    """The stream's documents through row-local stages, appended to a Parquet folder exactly once."""
    if any(isinstance(s, GlobalStage) for s in pipeline.stages):
        raise ValueError("use start_batches for pipelines with stages that look at all documents")
    done = pipeline.transform(stream)
    rows = done if everything else done.filter(~F.col("is_rejected"))
    return rows.select(*stream.columns, *([] if not everything else ["is_rejected", "reject_reason"])).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def start_batches(pipeline: Pipeline, stream: DataFrame, out: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Like start, batch by batch, also for stages with a key table; the stream has a doc_id.  Each batch has a folder of its own, which a repeat overwrites."""
    if any(isinstance(s, GlobalStage) and not isinstance(s, KeyTableDeduplicator) for s in pipeline.stages):
        raise ValueError("a stage without a key table would look at each batch alone: use KeyTableDeduplicator or BloomDeduplicator")

    def each(batch: DataFrame, number: int) -> None:
        for s in pipeline.stages:
            if isinstance(s, KeyTableDeduplicator):
                s._batch = f"{number:012d}"
        pipeline.survivors(batch).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
