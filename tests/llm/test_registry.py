"""Registered queries against their oracles, and what they must read."""

import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from millrace.llm import registry

SF = "/root/testdata/sf0.01"


def test_one_query_of_each_operator_and_the_pipeline():
    names = __spark_entry__.queries()
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.queries()) == list(range(1, 11))
    assert "pipeline" in names and set(registry.queries()) <= set(names)


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_query(spark, name):
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    frame, oracle = registry.queries()[name](spark, SF), c.execute(registry.oracle_sql()[name])
    told, columns = [d[0] for d in oracle.description], sorted(frame.columns)
    assert columns == sorted(told)
    a = sorted(tuple(repr(r[x]) for x in columns) for r in frame.collect())
    assert a == sorted(tuple(repr(dict(zip(told, r))[x]) for x in columns) for r in oracle.fetchall())


@pytest.mark.parametrize("name", [n for n in registry.queries() if n not in registry.oracle_sql()])
def test_queries_without_oracle_give_a_row_for_each_row(spark, name):
    table = {"op7_url_filter": "pages", "op9_chat_format": "conversations"}.get(name, "documents")
    assert registry.queries()[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
