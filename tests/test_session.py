from types import SimpleNamespace

import pytest

from nearfield import session


def fake(master, conf=None, app="app-1"):
    settings = dict(conf or {})
    plain = SimpleNamespace(get=lambda key, default=None: settings.get(key, default))
    context = SimpleNamespace(master=master, applicationId=app, getConf=lambda: plain, defaultParallelism=8)
    return SimpleNamespace(conf=plain, sparkContext=context)


def test_the_named_folder_is_used():
    assert session.scratch_root(fake("spark://x:7077", {"spark.checkpoint.dir": "/shared/c/"})) == "/shared/c"


def test_a_cluster_without_a_folder_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_root(fake("yarn"))


def test_a_local_session_keeps_one_temporary_folder():
    first = session.scratch_root(fake("local[2]"))
    assert session.scratch_root(fake("local[2]")) == first != session.scratch_root(fake("local[2]", app="app-2"))


def test_task_counts():
    shuffle = {"spark.sql.shuffle.partitions": "8"}
    assert session.parallelism(fake("local[8]", shuffle)) == 16
    dynamic = {"spark.sql.shuffle.partitions": "200", "spark.dynamicAllocation.maxExecutors": "1000", "spark.executor.cores": "8"}
    assert session.parallelism(fake("yarn", dynamic)) == 16000
    endless = {"spark.sql.shuffle.partitions": "4000", "spark.dynamicAllocation.maxExecutors": "infinity"}
    assert session.parallelism(fake("yarn", endless)) == 4000


def test_discarded_tables_leave_the_shared_folder(spark):
    import os

    kept, gone = session.materialize(spark.range(5), "kept"), session.materialize(spark.range(7), "gone")
    session.discard(gone)
    assert os.path.exists(kept._stored_at) and not os.path.exists(gone._stored_at) and kept.count() == 5
