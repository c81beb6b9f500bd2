"""Session settings the library is designed and tested for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def recommended_conf(shuffle_partitions: int | None = None) -> dict[str, str]:
    """Settings for running the analyses.

    Without ``shuffle_partitions`` the cluster's own setting stays; it should
    be a few times the total core count.  AQE coalesces small partitions, splits skewed
    ones and picks broadcast joins from measured sizes at run time.
    """
    partitions = {} if shuffle_partitions is None else {"spark.sql.shuffle.partitions": str(shuffle_partitions)}
    return partitions | {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Split a skewed join partition even where the split needs a further
        # shuffle downstream (Q4 de-duplicates on the join's order-key
        # partitioning); it only happens when skew is measured.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        # Order joins by cost where every table has statistics (sources.statistics); elsewhere nothing changes.
        "spark.sql.cbo.enabled": "true",
        "spark.sql.cbo.joinReorder.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.caseSensitive": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }


def build_session(master: str | None = None, app_name: str = "orderlens",
                  shuffle_partitions: int | None = None, extra: dict[str, str] | None = None) -> SparkSession:
    """A session with the recommended settings; the master is left to spark-submit unless given."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    conf = recommended_conf(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder that the session names; a missing one is an error, never a machine-local path."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        return configured
    raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
