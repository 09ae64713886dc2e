"""Queries and inserts as streams over the same operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from nearsieve.config import KnnConfig
from nearsieve.operators.doph import addressed
from nearsieve.operators.index import merge_index, reservoirs
from nearsieve.operators.query import probe, top_by_count


def answer_stream(queries: DataFrame, index: DataFrame, cfg: KnnConfig, out: str, checkpoint: str, own: bool = True) -> StreamingQuery:
    """Answer each micro-batch of ``queries(id, idx)`` against a fixed index; results are appended to ``out``.

    All features of a query must arrive in one batch. A batch is written under
    its own number, so one that is replayed after a failure replaces itself.
    """

    def one(batch: DataFrame, number: int) -> None:
        found = top_by_count(probe(addressed(batch, cfg), index, own), cfg.top_k)
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return queries.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def insert_stream(vectors: DataFrame, cfg: KnnConfig, folder: str, checkpoint: str) -> StreamingQuery:
    """Insert each micro-batch of ``vectors(id, idx)``; version n of the index is ``folder/n``."""

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = addressed(batch, cfg)
        index = reservoirs(new, cfg) if number == 0 else merge_index(spark.read.parquet(f"{folder}/{number - 1}"), new, cfg)
        index.write.mode("overwrite").parquet(f"{folder}/{number}")

    return vectors.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
