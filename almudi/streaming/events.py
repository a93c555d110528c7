"""Structured Streaming: windowed counts and a per-key state machine.

The batch reference has no streams; late rows are dropped by the watermark here, which is
an addition, not parity.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from almudi.core.runtime import scratch

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, table: str = "events.parquet") -> DataFrame:
    """The table ``table`` of ``folder`` - one file or a folder of files - as a stream."""
    names = [f.rsplit("/", 1)[-1] for f in spark.read.schema(SCHEMA).parquet(f"{folder}/{table}").inputFiles()]
    read = spark.readStream.schema(SCHEMA)
    one = read.option("pathGlobFilter", table).parquet(folder) if names == [table] else read.parquet(f"{folder}/{table}")
    return one.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    w = F.window("ts", window)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def user_switches(events: DataFrame) -> DataFrame:
    """Per user: events, and how often the type differs from the event before (state: last
    event's order and type, counts). Events of a batch are taken in time order."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, switches, last = state.get if state.exists else (0, 0, "")
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for kind in rows.event_type:
            switches += int(n > 0 and kind != last)
            n, last = n + 1, kind
        state.update((n, switches, last))
        yield pd.DataFrame({"user_id": [key[0]], "n_events": [n], "n_switches": [switches], "last_type": [last]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, n_events long, n_switches long, last_type string", "n long, switches long, last string", "update", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, mode: str, keep: str | None = None) -> DataFrame:
    """Processes what is there and returns the result table.

    Complete mode: the last batch is the result. Update mode: the latest row per ``keep``.
    """
    spark = stream.sparkSession
    root = scratch(spark, "stream")

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{root}/out/b={batch_id}")

    stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{root}/out").drop("b")
    if keep is None:
        last = out.agg(F.max("batch_id").alias("m")).first().m
        return out.where(F.col("batch_id") == last).drop("batch_id")
    cols = [c for c in out.columns if c not in (keep, "batch_id")]
    return out.groupBy(keep).agg(F.max_by(F.struct(*cols), "batch_id").alias("s")).select(keep, "s.*")
