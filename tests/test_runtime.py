import os

import pytest

from tidemark import runtime


class FakeContext:
    def __init__(self, master):
        self.master = master

    def getCheckpointDir(self):
        return None


class FakeSession:
    def __init__(self, master):
        self.sparkContext = FakeContext(master)
        self.conf = {}


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"])
def test_no_local_folder_on_a_cluster(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.checkpoint_root(FakeSession(master))


def test_local_masters():
    assert runtime.is_local("local") and runtime.is_local("local[8]") and runtime.is_local("local[*]")
    assert not runtime.is_local("local-cluster[2,1,1024]")


def test_staged_tables_can_be_dropped(spark):
    table = runtime.stage(spark.range(5), "drop")
    path = table.staged_path.removeprefix("file:")
    assert os.path.isdir(path) and table.count() == 5
    runtime.unstage(table)
    assert not os.path.exists(path)
    runtime.unstage(table)
    runtime.unstage(spark.range(1))


def test_staging_block_drops_its_tables(spark):
    with runtime.staging() as keep:
        path = keep(spark.range(3), "block").staged_path.removeprefix("file:")
        assert os.path.isdir(path)
    assert not os.path.exists(path)


def test_working_block_drops_all_but_what_is_kept(spark):
    with runtime.working() as outer:
        with runtime.working() as keep:
            dropped, kept = runtime.stage(spark.range(3), "a"), keep(runtime.stage(spark.range(4), "b"))
            paths = [t.staged_path.removeprefix("file:") for t in (dropped, kept)]
        assert not os.path.exists(paths[0]) and os.path.exists(paths[1]) and kept.count() == 4
        last = outer(runtime.stage(spark.range(5), "c"))
    assert not os.path.exists(paths[1]) and last.count() == 5  # handed to the block around, which drops it
    with pytest.raises(ZeroDivisionError), runtime.working():
        path = runtime.stage(spark.range(1), "d").staged_path.removeprefix("file:")
        raise ZeroDivisionError
    assert not os.path.exists(path)
