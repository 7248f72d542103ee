"""Settled tables: in the shared folder, read back as written, deleted in the end."""

import os

import pytest

from vecloom import session


def test_settle_and_release(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "_settled", {})
    monkeypatch.setattr(session, "shared_dir", lambda spark: f"file://{tmp_path}/shared")
    df = session.settle(spark.range(10))
    assert df.count() == 10 and len(os.listdir(tmp_path / "shared")) == 1
    session.release()
    assert os.listdir(tmp_path) == []


def test_the_folder_is_that_of_the_application(spark):
    assert session.shared_dir(spark).endswith(spark.sparkContext.applicationId)


def test_a_cluster_has_to_name_the_folder():
    class Conf:
        def get(self, key, default):
            return default

    class Cluster:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master, applicationId = "local-cluster[2,1,1024]", "app"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Cluster())
