"""Retrieval for a stream of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from nearwise.session import working_tables


def search_stream(
    queries: DataFrame,
    search: Callable[[DataFrame], DataFrame],
    output_path: str,
    checkpoint_path: str,
    **trigger,
) -> StreamingQuery:
    """Answer each micro-batch of a streaming query table with a batch search, and store the hits.

    A batch writes its own folder and replaces it when the batch is run again, so a restart neither loses
    nor repeats hits. No state is kept between batches, and a batch's working tables end with it. ``trigger`` is passed
    to the stream, for example ``availableNow=True``.
    """

    def answer(batch: DataFrame, batch_id: int) -> None:
        with working_tables(batch.sparkSession):
            search(batch).write.mode("overwrite").parquet(f"{output_path}/batch_id={batch_id}")

    return (
        queries.writeStream.foreachBatch(answer)
        .option("checkpointLocation", checkpoint_path)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
