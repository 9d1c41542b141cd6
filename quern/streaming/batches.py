"""Records that arrive as a stream: each micro-batch is coerced and validated as a batch is, its exceptions set aside."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quern.config import Config
from quern.operators import rules


def checked_stream(stream: DataFrame, config: Config, headings: dict[str, str]) -> DataFrame:
    """A stream of raw text rows with _source_file and _row, typed, with _v. No state is kept, so nothing can be late."""
    columns, bad = rules.coerced(config, headings, pin=False)
    frame = stream.select("_source_file", "_row", *columns, bad.alias("_v"))
    return rules.validate(frame, config, pin=False)


def start(stream: DataFrame, config: Config, headings: dict[str, str], governed: str, exceptions: str, checkpoint: str) -> StreamingQuery:
    """Writes clean rows and exception records as Parquet, batch by batch, with all that is available now.

    A batch that runs again after a failure overwrites its own folders, so each row is written once.
    """

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            rules.clean_rows(kept).write.mode("overwrite").parquet(f"{governed}/batch={number}")
            rules.records(kept).write.mode("overwrite").parquet(f"{exceptions}/batch={number}")
        finally:
            kept.unpersist()

    return checked_stream(stream, config, headings).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
