import os

import pytest
from oracle import FOLDER, differences

from tidemark.llm import queries

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    assert differences(spark, queries.QUERIES[name], queries.SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_runs(spark, name):
    assert queries.QUERIES[name](spark, FOLDER).count() > 0


def test_no_vote_in_queries_that_trust_decides(spark):
    held = {name: "MapInArrow" in queries.QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString() for name in ("p4_found", "p4_survivors", "p4_consensus")}
    assert held == {"p4_found": False, "p4_survivors": False, "p4_consensus": True}


def test_labelled_texts_get_their_type(spark):
    found = queries.p10_types(spark, FOLDER)
    labels = spark.read.parquet(f"{FOLDER}/doc_labels.parquet")
    assert labels.join(found.withColumnRenamed("kind", "got"), "doc_id").where("kind <> got").count() == 0


def test_containers_hold_every_token_once(spark):
    got = queries.p9_containers(spark, FOLDER).toPandas()
    sizes = {r.doc_id: len(r.ids) for r in queries.p8_ids(spark, FOLDER).collect()}
    assert got.groupby("container_id").n_tokens.sum().max() <= 2048
    assert got.groupby("doc_id").n_tokens.sum().to_dict() == {k: v for k, v in sizes.items() if v}
    split = got[got.duplicated("doc_id", keep=False)].doc_id.unique()
    assert all(sizes[d] > 2048 for d in split)
