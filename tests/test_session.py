from __future__ import annotations

from types import SimpleNamespace

import pytest

from verbarium.session import scratch_dir, scratch_path, stage, work_folder


def session(master: str, **settings: str):
    """Just enough of a session to ask for its settings."""
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: settings.get(key.split(".")[1], default)),
        sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"),
    )


def test_scratch_tables_go_where_the_cluster_says():
    assert scratch_dir(session("yarn", checkpoint="hdfs:///x/")) == "hdfs:///x/verbarium"


def test_without_a_shared_folder_there_is_none():
    for master in ("spark://host:7077", "local[2]"):
        with pytest.raises(RuntimeError):
            scratch_dir(session(master))


def test_paths(spark):
    assert scratch_path(spark, "a") != scratch_path(spark, "a")
    assert work_folder(spark, "store") == work_folder(spark, "store") != work_folder(spark, "other")


def test_staged_tables_replace_each_other(spark, tmp_path):
    path = str(tmp_path / "t")
    stage(spark.range(5), path)
    assert sorted(row.id for row in stage(spark.range(3), path).collect()) == [0, 1, 2]
