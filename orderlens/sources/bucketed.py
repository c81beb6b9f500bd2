"""Tables bucketed and sorted by a join key: they meet each other there without a shuffle.

A bucket is one task's work in such a join, so a key with a large share of
the rows makes one bucket, and its task, large; AQE cannot split it, as
nothing is shuffled.  ``bucket_load`` tells before the table is written.
For a key like that join the plain tables instead: their shuffle is split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str | None = None,
                   sort_by: Sequence[str] = (), mode: str = "errorifexists") -> DataFrame:
    """Save ``df`` as the catalog table ``table`` in ``buckets`` buckets of ``key`` and return it read back.

    Rows are sorted within a bucket by ``key``, then ``sort_by``.  They are
    dealt out by the buckets' own hash first, so that each bucket is one
    file.  With ``path`` the table is external.
    """
    writer = df.repartition(buckets, F.col(key)).write.mode(mode).format("parquet").bucketBy(buckets, key).sortBy(key, *sort_by)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return df.sparkSession.table(table)


def read_bucketed(spark: SparkSession, table: str, key: str, buckets: int | None = None) -> DataFrame:
    """The table, which must be bucketed by ``key`` alone (into ``buckets``, when given): else a join would shuffle it silently."""
    described = {r["col_name"].strip().lower(): r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()}
    found = described.get("num buckets"), described.get("bucket columns")
    if found[1] != f"[`{key}`]" or (buckets is not None and found[0] != str(buckets)):
        raise ValueError(f"{table} is not bucketed by {key}{'' if buckets is None else f' into {buckets}'}: {found[0]} buckets of {found[1]}")
    return spark.table(table)


def bucket_load(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """bucket, rows, keys and rows_of_largest_key of ``buckets`` buckets of ``key``; a hot key is folded map-side."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    return (per_key.groupBy(F.pmod(F.hash(key), F.lit(buckets)).alias("bucket"))
            .agg(F.sum("_rows").alias("rows"), F.count(F.lit(1)).alias("keys"), F.max("_rows").alias("rows_of_largest_key")))
