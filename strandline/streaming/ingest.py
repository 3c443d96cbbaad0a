"""Continuous ingest of mutations, and the newest versions as state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandline.sources.log import LOG_COLUMNS

SCHEMA = "k string, seq long, op int, v string, exp long"


def read_mutations(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of log records from Parquet files; the number of files bounds a
    batch."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest(stream: DataFrame, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append a stream of records to a log table.  Each batch is committed with
    its checkpoint, so a restart goes on where it stopped."""
    writer = stream.select(*LOG_COLUMNS).writeStream.format("parquet").option("path", table)
    writer = writer.option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest_state(stream: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keep the newest version of every key as state and write, after each
    batch, the versions that changed to ``out``/batch_id.

    Replayed records change nothing: a (k, seq) that was seen is not newer.
    Expiry is a test on reading, against a given time, never on the clock.
    """
    rest = [c for c in LOG_COLUMNS if c not in ("k", "seq")]
    best = stream.groupBy("k").agg(F.max(F.struct("seq", *rest)).alias("best"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.select("k", "best.*").select(*LOG_COLUMNS).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = best.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def without_replays(log: DataFrame) -> DataFrame:
    """Records that arrived twice, once."""
    return log.dropDuplicates(["k", "seq"])
