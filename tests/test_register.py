import pyarrow as pa
import pytest

from strandloom.plans import register

FIRST = "spark.sql.adaptive.coalescePartitions.parallelismFirst"


@pytest.fixture
def conf(spark):
    keys = [*register.BOUNDS, register._INITIAL, FIRST]
    before = {k: spark.conf.get(k, None) for k in keys}
    yield spark.conf
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_partitions_joined_stay_small(spark, conf, tmp_path):
    """Reading a table bounds what adaptive execution joins for a task, so that its memory doesn't grow with the table."""
    spark.range(1 << 21).selectExpr("id", "xxhash64(id) h").write.parquet(f"{tmp_path}/t.parquet")
    conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64m")
    conf.set(FIRST, "false")
    rows = register.table(spark, str(tmp_path), "t")
    read = rows.repartition("h").select("id").mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [sum(b.num_rows for b in batches)]}) for _ in "1"), "n long")
    assert max(r["n"] for r in read.collect()) < 1 << 20
    assert int(conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == 8 << 20
    conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    register.table(spark, str(tmp_path), "t")
    assert conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "1m"
