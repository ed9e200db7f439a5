"""Session helpers: shared checkpoint folder, fresh scratch paths, filesystem checks."""

import os

from pitchside.session import checkpoint_root, path_exists, scratch_path


def test_scratch_paths_live_under_the_checkpoint_root(spark):
    root = checkpoint_root(spark)
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b and a.startswith(root) and b.startswith(root)


def test_path_exists_through_hadoop_fs(spark, tmp_path):
    assert path_exists(spark, str(tmp_path))
    assert not path_exists(spark, os.path.join(str(tmp_path), "missing"))
