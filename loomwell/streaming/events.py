"""Event-time operators that take a batch or a stream alike."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def watermarked(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """Streams need times with a zone; times without one are taken in the session's zone."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay) if df.isStreaming else df


def tumbling(df: DataFrame, ts: str, width: str, keys: list[str], value: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """window_start, keys, n, total by fixed, or with a slide sliding, windows."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    g = watermarked(df, ts, delay).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("window.start").alias("window_start"), *keys, "n", "total")


def sessions(df: DataFrame, ts: str, gap: str, key: str, delay: str = "10 minutes") -> DataFrame:
    """key, session_start, session_end, n."""
    g = watermarked(df, ts, delay).groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def unique_events(df: DataFrame, key: str, ts: str, delay: str = "10 minutes") -> DataFrame:
    """First row of each key; in a stream, among those within the delay."""
    return watermarked(df, ts, delay).dropDuplicatesWithinWatermark([key]) if df.isStreaming else df.dropDuplicates([key])


def running_totals(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, n, total after each micro-batch, by state of a fixed size for each key."""
    def step(k: tuple, frames, state):
        n, total = state.get if state.exists else (0, 0.0)
        for f in frames:
            n, total = n + len(f), total + float(f[value].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total]})

    kind = df.schema[key].dataType.simpleString()
    return df.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, total double", "n long, total double", "update", "NoTimeout")


def drained(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that is there into Parquet, and ends; a rerun with the same checkpoint adds only what is new."""
    df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def rebuilt(spark, path: str) -> DataFrame:
    """One row from a ledger: batches, n_rows, and the last batch; what a lost total is made of again."""
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("batches"), F.sum("n_rows").alias("n_rows"), F.max("batch").alias("last_batch"))


def ledger(df: DataFrame, path: str, checkpoint: str, key: str) -> None:
    """A ledger of batches: batch, rows and keys of each micro-batch, written once a batch even if it is run again."""
    def write(batch: DataFrame, number: int) -> None:
        row = batch.agg(F.lit(number).cast("long").alias("batch"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_keys"))
        row.write.mode("overwrite").parquet(f"{path}/batch={number}")

    df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
