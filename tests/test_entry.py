"""The driver contract and the shared folder."""

from types import SimpleNamespace

import pytest

import __spark_entry__
from gridweave.sources import shared


def test_a_missing_module_is_told_from_a_failing_one(tmp_path, monkeypatch):
    (tmp_path / "broken_module.py").write_text("import no_such_package_anywhere\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    assert __spark_entry__._present("broken_module") and __spark_entry__._present("gridweave.api")
    assert not __spark_entry__._present("gridweave.nowhere.queries") and not __spark_entry__._present("no_such_module")


def test_queries_and_sql_have_the_same_names():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and "splat_trilinear" in queries


def test_a_cluster_needs_a_shared_folder():
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default=None: default))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_folder(session, "x")


def test_tables_of_an_iteration_go(spark):
    first = shared.written(spark.range(10).toDF("n"))
    second = shared.written(first.where("n > 4"), first)
    assert second.count() == 5
    with pytest.raises(Exception, match="(?i)not exist|not found"):
        first.count()
