import os
from types import SimpleNamespace

import pytest
from oracle import FOLDER, differences

import __spark_entry__
from tidemark.plans import data_problems, reference
from tidemark.session import prepare, shared_folder

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
SQL = data_problems.SQL | reference.SQL
QUERIES = data_problems.QUERIES | reference.QUERIES


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    assert differences(spark, QUERIES[name], SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "reaction_car" in df.columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_queries_without_the_text_subpackage(monkeypatch):
    def refuse(name):
        raise ImportError(name)

    monkeypatch.setattr(__spark_entry__.importlib, "import_module", refuse)
    assert "p1_found" in __spark_entry__.queries() and "p8_ids" not in __spark_entry__.queries()


def test_a_cluster_without_shared_folder_fails_clearly():
    context = SimpleNamespace(master="spark://somewhere", getCheckpointDir=lambda: None, setCheckpointDir=lambda f: pytest.fail("a folder of one machine"))
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(set=lambda *a: None, get=lambda *a: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(prepare(session))
