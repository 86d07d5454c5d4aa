"""One stream written to several places."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.relabel import relabel

Sink = Callable[[DataFrame, int], None]


def fan_out(samples: DataFrame, sinks: dict[str, Sink], checkpoint: str, rules: dict[str, list[dict]] | None = None, trigger: str = "10 seconds") -> StreamingQuery:
    """Write every micro-batch of samples to all sinks, each after its own relabeling rules.

    The batch is kept while it is written, so that its sources are read once; a sink gets the batch's
    number and can skip one it has already written, as a batch is repeated after a failure.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for name, sink in sinks.items():
                own = (rules or {}).get(name)
                sink(relabel(batch, own) if own else batch, number)
        finally:
            batch.unpersist()

    return samples.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()


def parquet_sink(path: str) -> Sink:
    """Appends each batch to its own folder, which a repeated batch overwrites."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
