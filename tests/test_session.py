"""Shared folders and the currency of built tables."""

import os
import shutil
import tempfile

import pytest

from postlens.plans import gold
from postlens.session import ensure_checkpoint_dir


class FakeContext:
    def __init__(self, master):
        self.master, self.dir = master, None

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, d):
        self.dir = d


class FakeSession:
    def __init__(self, master, folder=None):
        self.sparkContext, self.folder = FakeContext(master), folder
        self.conf = self

    def get(self, key, default=None):
        return self.folder or default

    def set(self, key, value):
        self.folder = value


def test_a_cluster_must_name_its_folder():
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(RuntimeError):
            ensure_checkpoint_dir(FakeSession(master))
    for master in ("local", "local[4]", "local[*]", "local[2,3]"):
        assert os.path.isdir(ensure_checkpoint_dir(FakeSession(master)))


def test_a_named_folder_keeps_its_scheme():
    assert ensure_checkpoint_dir(FakeSession("yarn", "hdfs://nn/ck")) == "hdfs://nn/ck"
    assert ensure_checkpoint_dir(FakeSession("yarn", "file:///mnt/ck")) == "file:///mnt/ck"


def test_new_input_files_get_new_built_tables(spark, sf_small):
    d = tempfile.mkdtemp(prefix="postlens-in-")
    shutil.copy(f"{sf_small}/orders.parquet", d)
    one = gold.gold_path(spark, d, "x")
    assert gold.gold_path(spark, d, "x") == one
    os.utime(f"{d}/orders.parquet", (5, 5))
    assert gold.gold_path(spark, d, "x") != one


def test_unfinished_tables_are_built_again(spark, sf_small):
    made = []

    def build():
        made.append(1)
        return spark.range(3)

    name = f"t{os.getpid()}"
    assert gold.materialize(spark, sf_small, name, build).count() == 3
    assert gold.materialize(spark, sf_small, name, build).count() == 3 and len(made) == 1
    os.remove(gold.gold_path(spark, sf_small, name).removeprefix("file:") + "/_SUCCESS")
    assert gold.materialize(spark, sf_small, name, build).count() == 3 and len(made) == 2
