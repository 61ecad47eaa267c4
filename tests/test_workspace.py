"""Shared tables: written once, read back, and where they may go."""

import pytest

from millrace import workspace


class Session:
    """A stand-in with a master and settings."""

    def __init__(self, master, **conf):
        self.conf, self.sparkContext = conf, type("Context", (), {"master": master, "applicationId": "app"})()


def test_folder_comes_from_the_session():
    assert workspace.shared_dir(Session("spark://x", **{"spark.checkpoint.dir": "hdfs://a/b/"})) == "hdfs://a/b"
    local = workspace.shared_dir(Session("local[2]"))
    assert local.startswith("file://") and workspace.shared_dir(Session("local[2]")) == local
    for master in ("spark://x", "yarn", "local-cluster[1,1,1024]"):
        with pytest.raises(RuntimeError):
            workspace.shared_dir(Session(master))


def test_materialized_tables_keep_their_rows(spark):
    df = spark.createDataFrame([(1, None), (2, "b")], "a int, b string")
    back = workspace.materialize(df)
    assert back.schema == df.schema and sorted(back.collect()) == sorted(df.collect())


def test_settings_are_put_back(spark):
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    with workspace.settings(spark, spark__sql__shuffle__partitions="7"):
        assert spark.conf.get(key) == "7"
    assert spark.conf.get(key) == before
