import pytest

from gridlens.session import checkpoint_root, scratch_path


def test_checkpoint_dir_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    root = checkpoint_root(spark)
    if configured:
        assert root == configured.rstrip("/")
    assert scratch_path(spark, "live").startswith(root + "/live-")
    assert spark.sparkContext.getCheckpointDir()


class _Conf(dict):
    def get(self, k, default=None):
        return super().get(k, default)


class _Ctx:
    def __init__(self):
        self.dir, self.master = None, "local[4]"

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, d):
        self.dir = d + "/uuid"


class _Session:
    def __init__(self, conf):
        self.conf, self.sparkContext = _Conf(conf), _Ctx()


def test_unset_checkpoint_dir_gets_a_scratch_folder_without_touching_the_setting():
    s = _Session({})
    first = checkpoint_root(s)
    assert "gridlens-ckpt-" in first and s.conf == {}
    assert checkpoint_root(s) == first + "/uuid"  # later calls reuse the registered folder
    shared = _Session({"spark.checkpoint.dir": "hdfs://nn/ckpt/"})
    assert checkpoint_root(shared) == "hdfs://nn/ckpt" and shared.sparkContext.dir.startswith("hdfs://nn/ckpt/")


def test_unset_checkpoint_dir_is_an_error_on_a_cluster():
    for master in ("yarn", "local-cluster[3,2,1024]"):
        s = _Session({})
        s.sparkContext.master = master
        with pytest.raises(RuntimeError):
            checkpoint_root(s)
