"""W1 streaming twin: run progress per file from a stream of stage events.

Each file has keyed state (the stages done, its last event) that ends: when the watermark passes the file's last
event by ``idle``, the state is emitted once more as expired and dropped, so the store holds the files in work and
not all there ever were. A file that comes back starts anew. Events older than the watermark do not touch the state;
they leave as rows of their own (kind late). Rows of all kinds carry the stages, and a stage counts once per file
whatever kind of row reports it, so that ``latest`` gives what the batch operator gives on all events, replays included.

Event time must be TIMESTAMP (not TIMESTAMP_NTZ) for watermarking. Events without a file id, stage or time are ignored."""

from __future__ import annotations

import re
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from quarry.operators.insight import STAGE_WEIGHTS
from quarry.session import checkpoint_dir


def stage_events_stream(spark: SparkSession, events_dir: str, glob: str = "events.parquet") -> DataFrame:
    """Events table as a file stream mapped to stage events (same mapping as the batch fixture)."""
    schema = spark.read.parquet(f"{events_dir}/{glob}").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(events_dir)
    et = F.col("event_type")
    stage = (F.when(et.isin("view", "click"), F.lit("file_structure"))
             .when(et.isin("purchase", "signup"), F.lit("eda")).otherwise(F.lit("full_analysis")))
    return raw.select(F.col("user_id").alias("file_id"), stage.alias("stage"),
                      F.when(et == "error", F.lit("failed")).otherwise(F.lit("completed")).alias("status"),
                      F.col("ts").cast("timestamp").alias("ts"), "event_id")


STAGES = list(STAGE_WEIGHTS)
_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def _millis(span: str) -> int:
    """Milliseconds of a span such as '2 hours'."""
    m = re.fullmatch(r"\s*(\d+)\s+([a-z]+?)s?\s*", span.lower())
    if not m or m.group(2) not in _UNITS:
        raise ValueError(f"not a span: {span!r}")
    return int(m.group(1)) * _UNITS[m.group(2)] * 1000


def _tracker(idle: int):
    """State of one file: a flag per stage, then the time of its last event, in milliseconds."""
    columns = ["file_id", "kind", *STAGES, "last_ms"]

    def row(key, kind, flags, last):
        return pd.DataFrame([[key[0], kind, *[int(f) for f in flags], int(last)]], columns=columns)

    def track(key, frames, state):
        if state.hasTimedOut:
            *flags, last = state.get
            state.remove()
            yield row(key, "expired", flags, last)
            return
        old = state.getCurrentWatermarkMs()
        flags, last = [0] * len(STAGES), None
        if state.exists:
            *flags, last = state.get
        behind, behind_at = [0] * len(STAGES), None
        for frame in frames:
            late = frame["ms"] < old
            for part, is_late in ((frame[~late], False), (frame[late], True)):
                if not len(part):
                    continue
                done = set(part["stage"][part["status"] == "completed"])
                at = int(part["ms"].max())
                if is_late:
                    behind, behind_at = [int(f or s in done) for f, s in zip(behind, STAGES)], max(at, behind_at or at)
                else:
                    flags, last = [int(f or s in done) for f, s in zip(flags, STAGES)], max(at, last or at)
        if behind_at is not None:
            yield row(key, "late", behind, behind_at)
        if last is not None:
            state.update((*flags, last))
            state.setTimeoutTimestamp(max(last + idle, old + 1))
            yield row(key, "update", flags, last)
    return track


def progress_stream(events: DataFrame, watermark: str = "1 day", idle: str = "7 days") -> DataFrame:
    """Rows (file_id, kind, one 0/1 column per stage, last_ms): ``update`` with the state after a micro-batch,
    ``late`` with the stages of events behind the watermark only, ``expired`` with the state that has ended."""
    kind = events.schema["file_id"].dataType.simpleString()
    marked = events.withWatermark("ts", watermark)
    # Spark drops rows whose time column is behind the watermark before the state sees them; a time column without
    # values keeps the watermark and drops nothing, so the tracker can tell late events apart by ``ms``
    clock = F.lit(None).cast("timestamp").alias("clock", metadata=marked.schema["ts"].metadata)
    slim = (marked.filter("file_id is not null and stage is not null and ts is not null")
            .select("file_id", "stage", "status", F.unix_millis("ts").alias("ms"), clock))
    flags = ", ".join(f"{s} int" for s in STAGES)
    return slim.groupBy("file_id").applyInPandasWithState(
        _tracker(_millis(idle)), f"file_id {kind}, kind string, {flags}, last_ms long", f"{flags}, last_ms long", "update",
        GroupStateTimeout.EventTimeTimeout)


def latest(rows: DataFrame) -> DataFrame:
    """W1's table of all rows that ``progress_stream`` gave: a stage is done if any row says so."""
    done = rows.groupBy("file_id").agg(*[F.max(s).alias(s) for s in STAGES])
    return done.select("file_id", *[(F.col(s) == 1).alias(f"{s}_completed") for s in STAGES],
                       sum(F.col(s) * w for s, w in STAGE_WEIGHTS.items()).cast("long").alias("progress"))


def drain(events: DataFrame, watermark: str = "1 day", idle: str = "7 days") -> DataFrame:
    """Run the stream over the available files and return all rows it gave, with their ``epoch`` and ``kind``.
    Each epoch's rows are a Parquet folder in the shared folder, overwritten if the epoch is replayed; nothing is
    held in the driver."""
    spark = events.sparkSession
    base = f"{checkpoint_dir(spark)}/run_progress_{uuid.uuid4().hex[:8]}"
    rows = progress_stream(events, watermark, idle)

    def batch(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/state/epoch={epoch}")

    q = (rows.writeStream.outputMode("update").foreachBatch(batch)
         .option("checkpointLocation", f"{base}/_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    if not any(p["batchId"] >= 0 for p in q.recentProgress):
        return spark.createDataFrame([], rows.schema).withColumn("epoch", F.lit(0))
    return spark.read.schema(rows.schema.add("epoch", T.IntegerType())).parquet(f"{base}/state")


def run_progress_now(spark: SparkSession, events_dir: str) -> DataFrame:
    """The latest state per file of all events in ``events_dir``."""
    return latest(drain(stage_events_stream(spark, events_dir)))
