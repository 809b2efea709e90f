"""Where intermediate tables go."""

import os

import pytest

from shelfwise import session


def test_a_cluster_has_to_name_the_shared_folder():
    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session._local_folder(master)
    for master in ("local", "local[4]", "local[*]"):
        assert os.path.isdir(session._local_folder(master))


def test_scratch_is_shared_unique_and_can_be_cleared(spark):
    a, b = session.scratch_path(spark, "x"), session.scratch_path(spark, "x")
    assert a != b and a.startswith(session.ensure_checkpoint_dir(spark))
    df = session.checkpoint_table(spark.range(100), "numbers")
    assert df.count() == 100 and "persist" not in df._jdf.queryExecution().toString().lower()
    root = session._scratch_root(spark).removeprefix("file:")
    assert os.listdir(root)
    session.clear_scratch(spark)
    assert not os.path.exists(root)
