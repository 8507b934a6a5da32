"""How the message table is made, staged and validated: what is moved and sorted."""

import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import fixtures as fx
from flamelake.operators import normalize
from flamelake.sources import pprof

MESSAGES = "profile_id string, kind string, pos long, string string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def staged(spark, tmp_path, rows):
    narrow = spark.createDataFrame(rows, MESSAGES)
    columns = [F.col(f.name) if f.name in narrow.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in pprof.MESSAGES]
    pprof.write_messages(narrow.select(*columns), path := str(tmp_path / "messages"))
    return path


def test_a_task_writes_all_kinds_without_a_sort(spark, tmp_path):
    before = spark.conf.get(pprof._OPEN_FILES)
    rows = [("p", kind, i, "x") for i in range(3) for kind in ("string", "reject", "sample")]
    path = staged(spark, tmp_path, rows)
    assert spark.conf.get(pprof._OPEN_FILES) == before
    assert sorted(map(tuple, pprof.read_messages(spark, path).select("profile_id", "kind", "pos", "string").collect())) == sorted(rows)
    files = [os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")]
    assert {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files} == {"ZSTD"}


@pytest.fixture
def tables(spark, tmp_path):
    """Order 1 has three line items, one of a part that comes twice and one without part; order 2 has none."""
    day = "timestamp_ntz'1995-01-02 00:00:00'"
    spark.sql(
        f"""select * from values (1L, 7L, 'O', 1D, {day}, '1-URGENT'), (2L, 8L, 'F', 1D, {day}, '5-LOW')
        as t(o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority)"""
    ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql(
        f"""select * from values (1L, 3L, 1L, 1, 5D, 9D, 0.1D, 0D, 'N', 'O', {day}), (1L, 4L, 1L, 2, 6D, 9D, 0.1D, 0D, 'N', 'O', {day}),
        (1L, 99L, 1L, 3, 7D, 9D, 0.1D, 0D, 'N', 'O', {day})
        as t(l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)"""
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql(
        """select * from values (3L, 'a', 'b', 'T', 1, 1D), (4L, 'c', 'b', 'T', 1, 1D), (4L, 'd', 'b', 'T', 1, 1D)
        as t(p_partkey, p_name, p_brand, p_type, p_size, p_retailprice)"""
    ).write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_derived_messages_read_line_items_once(spark, tables):
    rows = fx.derived_messages(spark, tables)
    text = plan(rows)
    assert text.count("FileScan parquet") == 3 and text.count("Window ") >= 1
    assert "RoundRobin" not in text


def test_derived_messages_of_repeated_and_missing_rows(spark, tables):
    rows = fx.derived_messages(spark, tables)
    samples = [(r["profile_id"], r["pos"]) for r in rows.where("kind = 'sample'").collect()]
    assert sorted(samples) == [("p1", 0), ("p1", 1), ("p1", 1)]
    assert sorted(r["profile_id"] for r in rows.where("kind = 'header'").collect()) == ["p1", "p2"]
    assert rows.where("kind = 'string' and profile_id = 'p2'").count() == 13


def test_validation_does_not_sort_messages(spark, tmp_path):
    messages = pprof.read_messages(spark, staged(spark, tmp_path, [("p", "reject", 0, "b"), ("p", "reject", 0, "a"), ("q", "string", 0, "")]))
    text = plan(normalize._statistics(messages))
    assert "SortAggregate" not in text and "HashAggregate" in text
    series = spark.createDataFrame([("p", [("__name__", "x")]), ("q", [("__name__", "x")])], "profile_id string, labels array<struct<name:string,value:string>>")
    assert [tuple(r) for r in normalize.rejects(messages, series).collect()] == [("p", "blob", "unreadable", "a")]
