"""A run that takes up new pairs as files arrive and never does one twice."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codegrain.operators import enrichment as E
from codegrain.session import file_system

BEFORE = -1  # stands for what the sink held before the first batch


def resumed(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], available_now: bool = True) -> StreamingQuery:
    """Stream JSON lines from ``source`` through ``work`` into ``sink``, minus what was done before.

    The state is a table of fingerprints, 16 bytes each, beside the checkpoint; what the sink held before is read once, before
    the first batch, and moved into a folder ``batch=-1``. Batch n writes the folder ``batch=n`` of the sink and of the state anew, and leaves its own
    part of the state out of what was done, so a batch that is run again after a failure replaces
    itself. Pairs that repeat within a batch are all done. Both folders may be on any Hadoop file system.
    """
    state = f"{checkpoint.rstrip('/')}/fingerprints"
    mark = F.unhex(E.fingerprint("cve", "func_before")).alias("fp")

    def exists(path: str) -> bool:
        files, at = file_system(spark, path)
        return files.exists(at)

    def settle() -> str | None:
        """What the sink held before, moved into a batch folder of its own, as loose files beside such folders are not read."""
        files, at = file_system(spark, sink)
        held = f"{sink.rstrip('/')}/batch={BEFORE}"
        loose = [f.getPath() for f in files.listStatus(at) if f.isFile()] if files.exists(at) else []
        for f in loose:
            files.mkdirs(file_system(spark, held)[1])
            files.rename(f, file_system(spark, f"{held}/{f.getName()}")[1])
        return held if exists(held) else None

    def keep(df: DataFrame, number: int) -> None:
        df.select(mark).distinct().write.mode("overwrite").parquet(f"{state}/batch={number}")

    def batch(df: DataFrame, number: int) -> None:
        if not exists(f"{state}/batch={BEFORE}/_SUCCESS"):
            held = settle()
            keep(spark.read.schema(schema).json(held) if held else df.limit(0), BEFORE)
        done = spark.read.schema("fp binary, batch long").parquet(state).where(F.col("batch") != number).select("fp").distinct()
        todo = df.withColumn("fp", mark).join(done, "fp", "left_anti").drop("fp")
        work(todo).write.mode("overwrite").json(f"{sink.rstrip('/')}/batch={number}")
        keep(df, number)

    writer = spark.readStream.schema(schema).json(source).writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stop_on_signal(query: StreamingQuery, signal_file: str, poll_seconds: float = 1.0) -> bool:
    """Wait for the query; stop it when the file appears, on whatever file system it is. True if it was stopped."""
    spark = SparkSession.getActiveSession()
    while query.isActive:
        if signalled(spark, signal_file):
            query.stop()
            return True
        query.awaitTermination(poll_seconds)
    return False


def signalled(spark: SparkSession | None, path: str) -> bool:
    if spark is None or "://" not in path:
        return os.path.exists(path)
    files, at = file_system(spark, path)
    return files.exists(at)
