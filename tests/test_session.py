import pytest

from orderlens.session import ensure_checkpoint_dir, recommended_conf


def test_recommended_conf_guarantees():
    conf = recommended_conf(16)
    assert conf["spark.sql.shuffle.partitions"] == "16"
    assert conf["spark.sql.adaptive.enabled"] == "true"
    assert conf["spark.sql.adaptive.skewJoin.enabled"] == "true"
    assert conf["spark.sql.adaptive.forceOptimizeSkewedJoin"] == "true"
    assert conf["spark.ui.enabled"] == "false"
    assert "spark.sql.autoBroadcastJoinThreshold" not in conf     # Spark's own size check stays


def test_checkpoint_dir_is_set_for_local_sessions(spark):
    path = ensure_checkpoint_dir(spark)
    assert path and spark.sparkContext.getCheckpointDir()


def test_checkpoint_dir_never_local_on_a_cluster():
    class FakeContext:
        master = "spark://cluster:7077"

        def getCheckpointDir(self):
            return None

    class FakeConf:
        def get(self, key, default=None):
            return default

    class FakeSession:
        sparkContext = FakeContext()
        conf = FakeConf()

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(FakeSession())
