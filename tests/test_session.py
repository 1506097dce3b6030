"""Shared folders: named or refused, never a folder of the driver alone."""

import pytest

from brightloom import session


class Conf:
    def get(self, key, default=None):
        return default


class Cluster:
    """As much of a session on a cluster without the setting as is asked."""

    conf = Conf()
    sparkContext = type("Context", (), {"master": "spark://host:7077"})()


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(ValueError, match="shared folder"):
        session.scratch_path(Cluster(), "x")
    assert session.scratch_path(Cluster(), "x", "hdfs://a/b/").startswith("hdfs://a/b/x-")


def test_a_local_session_has_one(spark):
    class Local(Cluster):
        sparkContext = spark.sparkContext

    assert session.shared_folder(Local()) == session.shared_folder(Local())
    assert session.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_materialised_tables_read_back(spark, tmp_path):
    df = spark.range(5).withColumnRenamed("id", "n")
    again = session.materialised(df, "numbers", str(tmp_path))
    assert again.dtypes == df.dtypes and again.count() == 5
    assert any(p.name.startswith("numbers-") for p in tmp_path.iterdir())
    assert session.checkpoint(df).count() == 5
