"""Where cut lineage goes."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from answerframe.session import name_local_folder, new_folder, shared_folder, written


def _session(master, folder):
    settings = {"spark.checkpoint.dir": folder} if folder else {}
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda name, default=None: settings.get(name, default), set=settings.__setitem__),
        sparkContext=SimpleNamespace(master=master, applicationId="app-1"),
    )


def test_the_named_folder_is_used():
    cluster = _session("yarn", "hdfs://shared/checkpoints/")
    assert shared_folder(cluster) == "hdfs://shared/checkpoints"
    first, second = new_folder(cluster, "x"), new_folder(cluster, "x")
    assert first != second and first.startswith("hdfs://shared/checkpoints/answerframe/app-1/x-")


@pytest.mark.parametrize("master", ["yarn", "local-cluster[2,1,1024]"])
def test_a_cluster_must_name_a_folder(master):
    cluster = _session(master, None)
    name_local_folder(cluster)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(cluster)


def test_a_local_session_gets_a_folder_once():
    local = _session("local[2]", None)
    with pytest.raises(ValueError):
        shared_folder(local)
    name_local_folder(local)
    first = shared_folder(local)
    name_local_folder(local)
    assert shared_folder(local) == first


def test_written_rows_no_longer_change(spark):
    random_rows = written(spark.range(50).withColumn("x", F.rand()).withColumn("v", F.to_variant_object(F.array("id"))), "t")
    first = sorted(r.x for r in random_rows.collect())
    assert first == sorted(r.x for r in random_rows.collect()) and random_rows.schema["v"].dataType.simpleString() == "variant"
