"""Incremental payment summary over arriving payment files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from orderlens.operators import cleaning
from orderlens.plans import analyses
from orderlens.session import ensure_checkpoint_dir


def read_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming scan of files arriving in ``path`` (declared schema, no inference)."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(path)


def stream_checkpoint(spark: SparkSession, name: str) -> str:
    """Checkpoint folder for stream ``name`` inside the shared ``spark.checkpoint.dir``."""
    return ensure_checkpoint_dir(spark).rstrip("/") + f"/streams/{name}"


def payment_summary_stream(payments: DataFrame, undefined: str = "not_defined") -> DataFrame:
    """Q6 on a stream: installments zeroed for the undefined type, then summed per type.

    The running aggregate keeps one state row per payment type; run it in
    ``complete`` output mode.
    """
    return analyses.payment_summary(cleaning.zero_undefined_installments(payments, undefined=undefined))


def start(df: DataFrame, spark: SparkSession, name: str, sink: str, output_mode: str = "append",
          path: str | None = None) -> StreamingQuery:
    """Start ``df`` with its checkpoint in the shared checkpoint folder.

    ``sink`` must be chosen: files (``parquet`` with ``path``) are written by
    the executors; ``memory`` brings the whole result to the driver and is
    for small aggregates and tests only.
    """
    writer = (df.writeStream.outputMode(output_mode).format(sink)
              .option("checkpointLocation", stream_checkpoint(spark, name)))
    if sink == "memory":
        writer = writer.queryName(name)
    return writer.start(path) if path else writer.start()
