"""Structured Streaming over step and event records.

A stream is a folder of parquet files. Every query here takes what is there (``availableNow``) and writes to
a folder with a checkpoint beside it; called again with the same folder it goes on with the files that have
arrived since. Results don't depend on how rows fall into batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from viewmill.session import scratch_path


def file_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A table of the data folder (one file, or a folder of files) as a stream; zoneless times become UTC ones."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet" if folder else f"{name}.parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    stream = reader.parquet(path if folder else sf_dir)
    zoneless = [f.name for f in schema.fields if f.dataType == T.TimestampNTZType()]
    return stream.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})


def drained(stream: DataFrame, name: str, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Run the stream over what has arrived and read all its output so far.

    ``folder`` holds output and checkpoint; the same folder continues the stream, none makes a new one.
    """
    spark = stream.sparkSession
    base = folder or scratch_path(spark, name)
    out = f"{base}/output"

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")  # idempotent: a repeated epoch replaces itself

    query = stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).option("basePath", out).parquet(out).select(*stream.columns)


def windowed_counts(events: DataFrame, watermark: str = "1 hour", window: str = "30 minutes") -> DataFrame:
    """Count and total of each event type in tumbling event-time windows; late rows beyond the watermark are left out."""
    w = F.window("ts", window)
    return (
        events.withWatermark("ts", watermark)
        .groupBy(w.alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )


def first_deliveries(steps: DataFrame, watermark: str = "60 days") -> DataFrame:
    """The first delivery of each step (run, start view, step): keyed state, dropped behind the watermark."""
    keyed = steps.withWatermark("ingested_at", watermark)
    return keyed.dropDuplicatesWithinWatermark(["run_id", "start_view_id", "step_id"])


STATE = "steps array<long>, sizes array<long>"
RESULT = "run_id long, start_view_id int, stable_at long, n_steps long, ended boolean"


def stable_step(steps: list[int], sizes: list[int], tau: float, patience: int) -> int:
    """The first step after ``patience`` relative gains in a row below ``tau``; -1 if there is none."""
    run = 0
    for i in range(1, len(steps)):
        run = run + 1 if (sizes[i] - sizes[i - 1]) / max(sizes[i - 1], 1) < tau else 0
        if run >= patience:
            return steps[i]
    return -1


def _stabilise(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, tau: float, patience: int, idle_ms: int | None) -> Iterator[pd.DataFrame]:
    seen = dict(zip(*state.get, strict=True)) if state.exists else {}
    ended = state.hasTimedOut
    if not ended:
        rows = pd.concat(list(frames)).sort_values(["step_id", "row_id"])
        for step, n in zip(rows["step_id"], rows["covered_voxel_count"], strict=True):
            seen.setdefault(int(step), int(n))  # a step delivered again counts as it first came
        steps = sorted(seen)
        state.update((steps, [seen[s] for s in steps]))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
    else:
        state.remove()
    steps = sorted(seen)
    stable = stable_step(steps, [seen[s] for s in steps], tau, patience)
    yield pd.DataFrame({"run_id": [key[0]], "start_view_id": [key[1]], "stable_at": [stable], "n_steps": [len(steps)], "ended": [ended]})


def stabilisation(steps: DataFrame, tau: float = 0.05, patience: int = 2, idle_ms: int | None = None) -> DataFrame:
    """Running stabilisation of each run from each start view.

    The state is the run's steps and their sizes, as many as a run has views; late steps take their place in
    step order. With ``idle_ms`` a run without a new step for so long is closed: it comes out once more, with
    ``ended``, and its state is dropped.
    """
    usable = steps.where("covered_voxel_count is not null").select("row_id", "run_id", "start_view_id", "step_id", "covered_voxel_count")

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return _stabilise(key, frames, state, tau, patience, idle_ms)

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return usable.groupBy("run_id", "start_view_id").applyInPandasWithState(update, RESULT, STATE, "update", timeout)
