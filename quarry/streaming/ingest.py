"""File-arrival ingest. Every new file in a landing folder is one micro-batch of its own schema: the stream
carries paths only, and the batch reads its file with the header, separator and encoding that this file has (S1),
cleans it (P1-P5, P12; sparse columns go, as at an upload) and profiles it. Clean rows, profile and the
record of the file (its path, rows and removed columns) land as Parquet in folders of the batch's own, which
a replay after a failure overwrites. trigger(availableNow) processes what has arrived and stops; the checkpoint
makes a restart resume after the last committed batch, so each file counts once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.clean import drop_empty_columns, nonfinite_to_null, null_tokens_to_null, smart_clean
from quarry.operators.profile import missing_profile
from quarry.session import checkpoint_dir
from quarry.sources.delimited import read_delimited, read_tsv

_FILE = "path string, modificationTime timestamp, length long, content binary"
_RECORD = "path string, rows long, columns array<string>, removed array<string>"


def arrivals(spark: SparkSession, landing_dir: str, glob: str = "*") -> DataFrame:
    """The paths of the files of a folder as a stream, one file a batch. Contents are not read here."""
    return (spark.readStream.format("binaryFile").schema(_FILE).option("pathGlobFilter", glob).option("maxFilesPerTrigger", 1)
            .load(landing_dir).select("path"))


def read_one(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One file by its own header or schema."""
    return {"csv": read_delimited, "tsv": read_tsv}.get(kind, lambda s, p: s.read.format(kind).load(p))(spark, path)


def ingest_available(spark: SparkSession, landing_dir: str, glob: str = "*.csv", out_dir: str | None = None, kind: str = "csv",
                     aggressive: bool = True) -> str:
    """Process the files present now; returns the output folder (clean/batch=N, profile/batch=N, files/batch=N)."""
    base = out_dir or f"{checkpoint_dir(spark)}/ingest_{uuid.uuid4().hex[:8]}"

    def batch(paths: DataFrame, epoch: int) -> None:
        session = paths.sparkSession
        for row in paths.collect():  # one, by maxFilesPerTrigger
            df = read_one(session, row["path"], kind)
            rows, gone = 0, []
            if df.columns:
                raw = nonfinite_to_null(null_tokens_to_null(df)).persist()
                rows = raw.count()
                kept, _ = drop_empty_columns(raw)
                clean = smart_clean(kept, aggressive=aggressive)[0] if kept.columns else kept
                if clean.columns:
                    clean.write.mode("overwrite").parquet(f"{base}/clean/batch={epoch}")
                missing_profile(raw).write.mode("overwrite").parquet(f"{base}/profile/batch={epoch}")
                gone = [c for c in df.columns if c not in clean.columns]
                raw.unpersist()
            session.createDataFrame([(row["path"], rows, df.columns, gone)], _RECORD).write.mode("overwrite").parquet(f"{base}/files/batch={epoch}")

    q = (arrivals(spark, landing_dir, glob).writeStream.foreachBatch(batch).option("checkpointLocation", f"{base}/_checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return base


def ingested(spark: SparkSession, base: str, part: str) -> DataFrame:
    """The clean rows, profiles or file records of all batches; columns that a file lacks are null."""
    return spark.read.option("mergeSchema", True).parquet(f"{base}/{part}").withColumn("batch", F.col("batch").cast("long"))
