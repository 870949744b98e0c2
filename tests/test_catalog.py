"""Every registered core query against the SQL that states its result."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from rowframe import catalog
from rowframe.frame import Frame

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def _plain(rows):
    return sorted(tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in rows)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, tables, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    expected = tables.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in expected.description]
    assert sorted(names) == columns
    assert _plain(tuple(r[c] for c in columns) for r in df.collect()) == _plain(tuple(r[names.index(c)] for c in columns) for r in expected.fetchall())


def test_plans_stay_in_the_jvm(spark):
    for name in ("add_columns", "cast_to_number", "dedup_segment_nation", "join_outer", "unpivot_orders", "headermap_to_array", "validate_filter"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas")), name
    pruned = catalog.QUERIES["filter_orders"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice)" in pruned and "o_custkey" not in pruned


def test_shuffles_carry_little(spark):
    """Deduplication keeps a group's first row before its shuffle; head is a top-k, not a sort; groups are summed first."""
    plan = lambda name: catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    dedup = plan("dedup_segment_nation")
    assert dedup.index("Final") < dedup.index("Exchange") < dedup.index("Partial") and "WindowGroupLimit" in dedup
    assert "TakeOrderedAndProject" in plan("tail_events") and "Exchange rangepartitioning" not in plan("tail_events")
    assert "partial_count" in plan("group_by_role") and "partial_max_by" in plan("pivot_status")


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_joins_take_whole_tables(spark, how):
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    orders, customers = ({r[0] for r in read(t).select(c).collect()} for t, c in (("orders", "o_orderkey"), ("customer", "c_custkey")))
    rows = catalog.QUERIES[f"join_{how}"](spark, SF).collect()
    met = [r for r in rows if r["o_orderkey"] is not None and r["c_custkey"] is not None]
    assert any(r["o_orderkey"] % 3 for r in met) and any(r["c_custkey"] % 2 for r in met)
    assert how not in ("left", "outer") or {r["o_orderkey"] for r in rows} - {None} == orders
    assert how not in ("right", "outer") or {r["c_custkey"] for r in rows} - {None} == customers


def test_merge_takes_whole_tables(spark):
    customers = {r[0] for r in spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey").collect()}
    assert {r["k"] for r in catalog.QUERIES["merge_customers"](spark, SF).collect()} == customers | {-k for k in customers if k % 3 == 0}


@pytest.mark.parametrize("name, table", [("sort_numbers_descending", "customer"), ("sort_texts", "part"), ("sort_nulls_first", "events"), ("sort_by_key_callback", "customer"), ("similar_parts", "part")])
def test_sorts_rank_whole_tables(spark, name, table):
    ranks = sorted(r["index"] for r in catalog.QUERIES[name](spark, SF).collect())
    assert ranks == list(range(spark.read.parquet(f"{SF}/{table}.parquet").count()))


def test_row_index_of_many_rows(spark, tmp_path):
    """So many that a second run of the sort gives other partitions."""
    rows = 4000000
    spark.range(rows).select("id", F.xxhash64("id").alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("pad")).write.parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        df = Frame.from_parquet(spark, str(tmp_path / "t"), "id").sort_by("v").with_row_index().df
        got = df.agg(F.countDistinct("index").alias("n"), F.min("index").alias("lo"), F.max("index").alias("hi"), F.max("pad")).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert (got["n"], got["lo"], got["hi"]) == (rows, 0, rows - 1)
