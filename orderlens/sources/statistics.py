"""Catalog tables with column statistics, from which Spark orders joins by cost.

Without statistics a chain of inner joins runs in the order it is written.
With row counts and the numbers of distinct values of every table in the
chain, and ``spark.sql.cbo.enabled`` and ``spark.sql.cbo.joinReorder.enabled``
(set by the recommended session), the joins that shrink the rows come first,
in whatever order the text names them.  The result is the same.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def analyze(spark: SparkSession, table: str, columns: Iterable[str] | None = None) -> None:
    """Count the rows of a catalog table and describe ``columns`` (default: all): one pass over them, to be repeated as the table grows."""
    named = f"FOR COLUMNS {', '.join(f'`{c}`' for c in columns)}" if columns is not None else "FOR ALL COLUMNS"
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS {named}")


def save_analyzed(df: DataFrame, table: str, path: str | None = None, columns: Iterable[str] | None = None, mode: str = "errorifexists") -> DataFrame:
    """Save ``df`` as the catalog table ``table`` (external with ``path``), analyse it and return it read back."""
    writer = df.write.mode(mode).format("parquet")
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    analyze(df.sparkSession, table, columns)
    return df.sparkSession.table(table)


def statistics_of(spark: SparkSession, table: str, column: str) -> dict[str, str]:
    """What the catalog knows of a column: distinct_count, num_nulls, min, max and so on."""
    return {r["info_name"]: r["info_value"] for r in spark.sql(f"DESCRIBE EXTENDED {table} `{column}`").collect()}
