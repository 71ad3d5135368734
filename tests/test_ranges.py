"""Positions and running sums over keys that are many partitions."""

import pytest
from compare import duck, duck_rows, spark_rows
from pyspark.sql import functions as F

from siftline.operators import packing, selection
from siftline.plans import registry


@pytest.fixture
def uncoalesced(spark):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield spark
    spark.conf.unset(name)


def test_positions_and_running_sums_of_many_partitions(uncoalesced):
    ids = uncoalesced.range(0, 60_000, 1, 12).select((F.col("id") * 7 % 60_000).alias("id"), (F.col("id") % 5).alias("size"))
    assert selection.positions(ids, "id").where("position <> id").count() == 0
    placed = packing.running_start(ids, "id", "size").orderBy("id").collect()
    at = 0
    for r in placed:
        assert r.start == at
        at += r.size
    assert len(placed) == 60_000
    text = ids.select(F.lpad(F.col("id").cast("string"), 6, "0").alias("id"))
    assert selection.positions(text, "id").where("position <> int(id)").count() == 0


def test_stream_blocks_of_many_partitions(uncoalesced, tmp_path):
    uncoalesced.range(0, 40_000, 1, 12).selectExpr("if(id = 9, null, id) as doc_id", "if(id % 11 = 0, null, repeat('x', int(id * 37 % 900))) as text").write.parquet(f"{tmp_path}/d")
    duck(tmp_path).execute(f"COPY (SELECT * FROM '{tmp_path}/d/*.parquet') TO '{tmp_path}/documents.parquet'")
    got = spark_rows(registry.queries()["stream_blocks"](uncoalesced, str(tmp_path)))
    assert got == duck_rows(duck(tmp_path), registry.oracle_sql()["stream_blocks"])


@pytest.mark.parametrize("n", [0, 1, 10, 60_002])
def test_replay_mix_rounds_as_its_sql(uncoalesced, tmp_path, n):
    con = duck(tmp_path)
    con.execute(f"COPY (SELECT CASE WHEN i = 3 THEN NULL ELSE i * 3 END::BIGINT AS doc_id, 'en' AS lang, 's' AS source FROM range({n}) t(i)) TO '{tmp_path}/documents.parquet' (ROW_GROUP_SIZE 10000)")
    got = spark_rows(registry.queries()["replay_mix"](uncoalesced, str(tmp_path)))
    assert got == duck_rows(duck(tmp_path), registry.oracle_sql()["replay_mix"])
