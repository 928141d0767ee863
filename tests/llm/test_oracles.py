import pytest
from tests.oracle import same_rows

from strandloom.llm import queries

SQL, QUERIES = queries.oracle_sql(), queries.queries()
NATIVE = ("op3_decontaminate", "op5_exact_dedup", "op8_license_scan")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    plan = same_rows(spark, QUERIES[name], SQL[name])
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", NATIVE)
def test_native_plans_have_no_python(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"))
