import os

import pytest

from gridloom.plans import storage


def test_staged_tables_go_when_nothing_reads_them(spark):
    paths = []
    with storage.collected(paths):
        a, b = storage.staged(spark.range(3), "a"), storage.staged(spark.range(4), "b")
    storage.staged(spark.range(2), "c")
    here = [p.removeprefix("file://") for p in paths]
    assert len(paths) == 2 and all(map(os.path.isdir, here))
    storage.discard(spark, paths, b.filter("id > 1"))
    assert len(paths) == 1 and not os.path.exists(here[0]) and b.count() == 4
    storage.discard(spark, paths)
    assert not paths and not os.path.exists(here[1])
    with pytest.raises(Exception):  # noqa: B017
        a.count()


def test_clusters_need_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError, match="share"):
        storage.shared_dir(Session())
