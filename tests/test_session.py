import pytest

from starlens.session import checkpoint_dir


class _Unset:
    """A session on a cluster without a checkpoint folder."""

    class conf:
        get = staticmethod(lambda key, default=None: default)

    class sparkContext:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: _Unset.conf)


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(_Unset)


def test_the_named_folder_wins(spark):
    assert checkpoint_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
