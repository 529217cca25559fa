"""Every query runs; those with SQL give what DuckDB gives."""

import pytest

from palimpsest.plans.queries import QUERIES, SQL

from .compare import same
from .conftest import DATA


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    df = QUERIES[name](spark, f"{DATA}/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"))  # no pairs of all rows, no row-at-a-time Python
    if name in SQL:
        same(df, duck.sql(SQL[name]))
    else:
        assert df.collect()


def test_entry_and_registries(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


def test_flagship_reads_what_it_needs_once(spark):
    plan = QUERIES["document_summary"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
