"""Named relations and SQL text as a source."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from orderlens.functions import classify, scalar


def publish(frames: dict[str, DataFrame], prefix: str = "") -> list[str]:
    """Register each frame as a session temp view; returns the view names."""
    names = []
    for name, df in frames.items():
        df.createOrReplaceTempView(prefix + name)
        names.append(prefix + name)
    return names


def run_sql(spark: SparkSession, query: str, **frames: DataFrame) -> DataFrame:
    """Run SQL text.

    Frames passed as keywords are referenced as ``{name}`` in the text, so a
    query can run on DataFrames without touching the session catalog.
    """
    return spark.sql(query, **frames) if frames else spark.sql(query)


def publish_function(spark: SparkSession, name: str, parameters: Mapping[str, str], body: Callable[..., Column]) -> None:
    """Make a column function callable from SQL text, as a temporary function of this session.

    ``parameters`` maps each parameter, in order, to its SQL type; ``body``
    takes as many columns.  The function's text is the expression that
    ``body`` builds, so both forms are one definition, and a call is planned
    in place of its text: no Python worker, no boundary for the optimizer.
    """
    listed = ", ".join(f"{p} {t}" for p, t in parameters.items())
    empty = spark.createDataFrame([], listed)
    expression = empty.select(body(*[F.col(p) for p in parameters]).alias("result"))._jdf.queryExecution().analyzed().expressions().head()
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({listed}) RETURNS {expression.dataType().sql()} RETURN {expression.child().sql()}")


def publish_classifiers(spark: SparkSession, prefix: str = "") -> list[str]:
    """The classifiers, white-space collapse and month key as SQL functions; returns their names."""
    sizes = {"length": "double", "width": "double", "height": "double", "weight": "double"}
    functions = {
        "margin_category": ({"margin": "double"}, classify.margin_category),
        "product_size_class": (sizes, classify.product_size_class),
        "collapse_whitespace": ({"text": "string"}, scalar.one_blank),
        "month_key": ({"ts": "timestamp_ntz"}, scalar.month_key),
    }
    for name, (parameters, body) in functions.items():
        publish_function(spark, prefix + name, parameters, body)
    return [prefix + name for name in functions]
