"""Structured Streaming: windows, late data, running records, landing with idempotent ids."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F


def events(spark: SparkSession, path: str, schema, glob: str = "*.parquet", per_trigger: int = 1) -> DataFrame:
    """The event files of a folder as a stream, with an event time that watermarks accept."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", glob).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(df: DataFrame, width: str, late: str) -> DataFrame:
    return df.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding(df: DataFrame, width: str, slide: str, late: str) -> DataFrame:
    return df.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def daily_counts(df: DataFrame, late: str) -> DataFrame:
    return df.withWatermark("ts", late).groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n"))


def sessions(df: DataFrame, gap: str, late: str) -> DataFrame:
    return df.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def distinct_landings(df: DataFrame, key: str, late: str) -> DataFrame:
    return df.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def running_best(df: DataFrame) -> DataFrame:
    """Each event that beats its user's best so far: state is one number per user."""

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        best = state.get[0] if state.exists else float("-inf")
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"], ignore_index=True)
        before = rows["value"].cummax().shift(fill_value=float("-inf")).clip(lower=best)
        state.update((max(best, rows["value"].max()),))
        yield rows.loc[rows["value"] > before, ["user_id", "event_id", "value"]]

    keyed = df.where("value is not null and user_id is not null").select("user_id", "event_id", "ts", "value")
    return keyed.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, value double", "best double", "append", "NoTimeout")


def row_function(df: DataFrame, run, schema: str, state: str, out: str) -> None:
    """Applies a batch function (an iterator of pandas frames to frames, as in mapInPandas) to a stream of rows, each micro-batch once: its output
    is the folder ``out``/batch=<number>, which a repeated batch overwrites."""

    def write(batch: DataFrame, number: int) -> None:
        batch.mapInPandas(run, schema).write.mode("overwrite").parquet(f"{out}/batch={number}")

    df.writeStream.option("checkpointLocation", state).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()


def priced(df: DataFrame, difficulty: DataFrame, key: str) -> DataFrame:
    """New rows against the last solved table: a stream-static join."""
    return df.join(difficulty, key, "left")


def drain(df: DataFrame, folder: str, mode: str = "append") -> None:
    """Run a stream over what is there and stop; results as Parquet in ``folder``/out. Complete mode keeps the last batch."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{folder}/out")

    query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()


def promote(df: DataFrame, table: str, state: str, key: str, order: str, fail_after: int | None = None) -> None:
    """Promotes a stream of landed rows into a table of the newest row per key, each batch as an idempotent upsert.

    A batch is written as the folder ``table``/batch=<number>, which overwrites itself when Spark runs the batch again after a failure, and the
    table is the newest row per key over all batches (:func:`promoted`). So a batch that was written but not committed counts once. ``order``
    says which row of a key is newest; of equals the larger batch wins. ``fail_after``: for replay tests, raises after that batch is written.
    """

    def write(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), F.struct(order, F.hash(*batch.columns))).alias("row")).select("row.*")
        newest.write.mode("overwrite").parquet(f"{table}/batch={number}")
        if number == fail_after:
            raise RuntimeError(f"stopped after writing batch {number}")

    df.writeStream.option("checkpointLocation", state).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()


def promoted(spark: SparkSession, table: str, key: str, order: str) -> DataFrame:
    """The promoted table: the newest row of each key."""
    rows = spark.read.parquet(table)
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != "batch"]), F.struct(order, "batch")).alias("row")).select("row.*")


def drain_updates(df: DataFrame, folder: str) -> None:
    """Like :func:`drain` in update mode: each batch's updated rows are appended with their batch number."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{folder}/out")

    df.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
