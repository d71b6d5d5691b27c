"""Change feed: versioned events become re-ingested chunks, batch after batch.

Each micro-batch is worked off in ``foreachBatch`` with the batch number in the paths it
writes, so that a batch that runs again after a failure replaces what it wrote. Version
state is kept as the changes of each batch, merged now and then; a hot document is cut
into blocks of its sequence.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.operators.state import above_all_earlier


def stream_table(spark: SparkSession, folder: str, name: str, files_a_trigger: int | None = None) -> DataFrame:
    """``name.parquet`` of a data directory (a file or a directory of files) as a stream."""
    path = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_a_trigger:
        reader = reader.option("maxFilesPerTrigger", files_a_trigger)
    if os.path.isdir(path) or "://" in path:
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


#: After so many batches the changes of the version state are merged into one table.
MERGE_BATCHES = 16


def accept(batch: DataFrame, state: DataFrame | None) -> DataFrame:
    """Events whose version is above that in ``state`` and all earlier ones of the batch, in the order of ``seq``."""
    return above_all_earlier(batch, state)


def known_versions(spark: SparkSession, states: str, number: int) -> DataFrame | None:
    """Version of each document before batch ``number``: the last merged table and the changes of the batches since."""
    if not number:
        return None
    merged = number // MERGE_BATCHES * MERGE_BATCHES
    paths = [f"{states}/merged/{merged}"] if merged else []
    paths += [f"{states}/changes/{n}" for n in range(merged, number)]
    rows = spark.read.schema("document_id string, version bigint").parquet(*paths)
    return rows.groupBy("document_id").agg(F.max("version").alias("version"))


def run_version_guard(
    events: DataFrame, folder: str, tenant: str | None = None, sink: Callable[[DataFrame, int], None] | None = None
) -> DataFrame:
    """Run the stream to its end; accepted events are written under ``folder`` and returned.

    The version of an event is recorded only after ``sink`` has worked it off; a failure
    ends the batch, which comes again. ``folder`` must be shared by all executors.
    """
    spark = events.sparkSession
    accepted, states = f"{folder}/accepted", f"{folder}/state"
    schema = T.StructType([f for f in events.schema.fields])

    def work(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        rows = batch if tenant is None else batch.where(F.col("tenant_id") == tenant)
        rows = accept(rows, known_versions(session, states, number))
        rows.write.mode("overwrite").parquet(f"{accepted}/batch={number}")
        done = session.read.schema(schema).parquet(f"{accepted}/batch={number}")
        if sink is not None:
            sink(done, number)
        fresh = done.groupBy("document_id").agg(F.max("version").alias("version"))
        fresh.write.mode("overwrite").parquet(f"{states}/changes/{number}")
        if (number + 1) % MERGE_BATCHES == 0:
            # all before this batch, and this one; what is merged is read no more
            both = fresh if not number else known_versions(session, states, number).unionByName(fresh)
            both.groupBy("document_id").agg(F.max("version").alias("version")).write.mode("overwrite").parquet(f"{states}/merged/{number + 1}")

    query = events.writeStream.foreachBatch(work).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if not spark._jvm.org.apache.hadoop.fs.Path(accepted).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(accepted)):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{accepted}/batch=*")


def windowed_counts(events: DataFrame, width: str, slide: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """Events and value sums by time window and type; late rows beyond ``lateness`` are dropped by a running stream."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    rows = events.withWatermark("ts", lateness) if events.isStreaming else events
    return rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 6).alias("total"))


def sessions(events: DataFrame, gap: str, lateness: str = "1 hour") -> DataFrame:
    """Sessions of each user: runs of events without a pause of ``gap``."""
    rows = events.withWatermark("ts", lateness) if events.isStreaming else events
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
