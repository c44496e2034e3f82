from types import SimpleNamespace

import pytest

from sqlgauge.session import materialise, shared_dir


def session(setting, master, application="app-test"):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: setting),
        sparkContext=SimpleNamespace(master=master, applicationId=application),
    )


def test_the_setting_wins():
    assert shared_dir(session("hdfs://x/ck/", "yarn")) == "hdfs://x/ck"
    assert shared_dir(session("/ck", "local[2]")) == "/ck"


def test_a_cluster_needs_the_setting():
    with pytest.raises(ValueError):
        shared_dir(session(None, "yarn"))


def test_local_master_gets_one_folder_per_application():
    first = shared_dir(session(None, "local[2]", "app-1"))
    assert first == shared_dir(session(None, "local[2]", "app-1"))
    assert first != shared_dir(session(None, "local[2]", "app-2"))


def test_bare_nulls_are_kept(spark):
    kept = materialise(spark.sql("SELECT 1 AS a, NULL AS b"))
    assert tuple(kept.first()) == (1, None)
