"""The registered queries of the core library, each with the SQL that states its result.

Tables get their order from unique keys, so ordered operators have one right answer. Sums are rounded, since their order
of addition is not fixed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowframe.durable import shared_folder
from rowframe.frame import Frame
from rowframe.functions import dyn_number, get_path, normalize
from rowframe.operators.base import python
from rowframe.plans.casting import Caster, CustomCasts, apply_casts
from rowframe.plans.headermap import FromArray, ToArray, map_rows, unmap_rows
from rowframe.plans.validate import Check, Field, RowSchema, SchemaConfig, validate
from rowframe.sources.dialect import Dialect
from rowframe.sources.reader import from_file
from rowframe.sources.writer import to_string, write_folder
from rowframe.streaming.pipeline import Pipeline

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The unique key of each table.
KEYS = {"orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey", "events": "event_id", "supplier": "s_suppkey", "nation": "n_nationkey", "documents": "doc_id", "labels": "doc_id", "conversations": ["conv_id", "turn"]}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def put(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return put


def _t(spark: SparkSession, sf_dir: str, name: str) -> Frame:
    return Frame.from_parquet(spark, f"{sf_dir}/{name}.parquet", KEYS[name])


def _scratch(spark: SparkSession) -> str:
    """A folder of its own that all executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"


def _one(spark: SparkSession, **cells) -> DataFrame:
    return spark.range(1).select(*[(F.lit(v).cast("long") if type(v) is int else F.lit(v)).alias(k) for k, v in cells.items()])


# ------------------------------------------------------------------------------------------------------------ flagship


@query("""
SELECT c_mktsegment, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o,
       round(sum(net), 1) AS net
FROM (SELECT *, o_totalprice * 0.9 AS net FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000)
GROUP BY 1 ORDER BY net DESC LIMIT 4
""")
def flagship_segment_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "customer"), "o_custkey", "c_custkey")
    priced = joined.filter(lambda r: r.o_totalprice > 1000).add_column("net", lambda r: r.o_totalprice * 0.9)
    status = lambda s: F.count(F.when(F.col("o_orderstatus") == s, 1))
    segments = priced.group_by("c_mktsegment").agg(f=status("F"), o=status("O"), net=F.round(F.sum("net"), 1))
    return Frame.from_df(segments, "c_mktsegment").sort_by("net", "desc").head(4).df


# ---------------------------------------------------------------------------------------------------------- aggregates


@query("SELECT round(sum(o_totalprice), 1) AS s, round(avg(o_totalprice), 4) AS a, min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(o_totalprice) AS n FROM orders")
def aggregate_orders(spark, sf_dir):
    f = _t(spark, sf_dir, "orders")
    v = f.number("o_totalprice")
    return f._df.agg(F.round(F.sum(v), 1).alias("s"), F.round(F.avg(v), 4).alias("a"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(v).alias("n"))


@query("SELECT 'sum' AS op, round(sum(o_totalprice) / 1000, 2) AS v FROM orders UNION ALL SELECT 'avg', round(avg(o_totalprice) / 1000, 2) FROM orders UNION ALL SELECT 'min', min(o_totalprice) FROM orders UNION ALL SELECT 'max', max(o_totalprice) FROM orders UNION ALL SELECT 'count', count(*) FROM orders")
def aggregate_each_operation(spark, sf_dir):
    f = _t(spark, sf_dir, "orders")
    got = spark.createDataFrame([(op, float(f.aggregate("o_totalprice", op))) for op in ("sum", "avg", "min", "max", "count")], "op string, v double")
    return got.select("op", F.when(F.col("op").isin("sum", "avg"), F.round(F.col("v") / 1000, 2)).otherwise(F.col("v")).alias("v"))


@query("SELECT sum(try_cast(props->>'$.k' AS DOUBLE)) AS s, count(props->>'$.k') AS n FROM events")
def aggregate_json_numeric(spark, sf_dir):
    f = _t(spark, sf_dir, "events").add_column("k", lambda r: F.get_json_object(r.props, "$.k")).filter("k IS NOT NULL")
    k = dyn_number(F.col("k"))
    return f._df.agg(F.sum(k).alias("s"), F.count(k).alias("n"))


@query("SELECT count(*) AS n FROM lineitem")
def count_rows(spark, sf_dir):
    return Frame.from_parquet(spark, f"{sf_dir}/lineitem.parquet")._df.agg(F.count("*").alias("n"))


@query("SELECT role, count(*) AS count FROM conversations GROUP BY role")
def group_by_role(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").group_by("role").counts()


@query("SELECT c_mktsegment, count(*) AS n, min(c_custkey) AS first, max(c_custkey) AS last FROM customer GROUP BY 1")
def group_rows(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").group_by("c_mktsegment").rows()
    return rows.select("c_mktsegment", F.size("rows").cast("long").alias("n"), F.get("rows", F.lit(0))["c_custkey"].alias("first"), F.element_at("rows", -1)["c_custkey"].alias("last"))


@query("SELECT coalesce(p.b, 'undefined') AS key, count(*) AS count FROM (SELECT struct_pack(b := CASE WHEN p_size > 25 THEN p_brand END) AS p FROM part) GROUP BY 1")
def group_by_nested_field(spark, sf_dir):
    nested = _t(spark, sf_dir, "part").transform(lambda r: {"p": F.struct(F.when(r.p_size > 25, r.p_brand).alias("b"))})
    return nested.group_by_field("p.b").counts()


@query("SELECT p_brand, row_number() OVER (ORDER BY min(p_partkey)) - 1 AS index FROM part GROUP BY p_brand")
def distinct_by_first_appearance(spark, sf_dir):
    return _t(spark, sf_dir, "part").distinct("p_brand").with_row_index().df


@query("""
SELECT CAST(o_custkey AS VARCHAR) AS o_custkey, arg_max(o_totalprice, o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS f, arg_max(o_totalprice, o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS o,
       arg_max(o_totalprice, o_orderkey) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1
""")
def pivot_status(spark, sf_dir):
    wide = _t(spark, sf_dir, "orders").pivot("o_custkey", "o_orderstatus", "o_totalprice", ["F", "O", "P"]).df
    return wide.select("o_custkey", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


@query("SELECT string_agg(n_name, '>' ORDER BY n_nationkey) AS names FROM nation")
def reduce_in_order(spark, sf_dir):
    folded = _t(spark, sf_dir, "nation").reduce_column(lambda acc, r: F.concat(acc, F.when(acc != "", ">").otherwise(""), r["n_name"]), "")
    return _one(spark, names=folded)


@query("SELECT CAST(sum(n_regionkey) AS BIGINT) AS s, count(*) AS n FROM nation")
def reduce_in_partitions(spark, sf_dir):
    s, n = _t(spark, sf_dir, "nation").reduce_parallel(lambda a, r: (a[0] + r["n_regionkey"], a[1] + 1), lambda a, b: (a[0] + b[0], a[1] + b[1]), (0, 0))
    return _one(spark, s=s, n=n)


# ------------------------------------------------------------------------------------------------------------- columns


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, 'x' AS tag FROM lineitem WHERE l_quantity > 45")
def add_columns(spark, sf_dir):
    f = Frame.from_parquet(spark, f"{sf_dir}/lineitem.parquet").filter("l_quantity > 45")
    return f.add_column("net", lambda r: F.round(r.l_extendedprice * (1 - r.l_discount), 4)).add_column("tag", "x").df.select("l_orderkey", "l_linenumber", "net", "tag")


@query("SELECT p_partkey, p_name, p_size FROM part")
def remove_columns(spark, sf_dir):
    return _t(spark, sf_dir, "part").remove_column(["p_brand", "p_type", "p_retailprice", "nothing"]).df


@query("SELECT p_partkey, p_brand AS brand, p_size FROM part")
def rename_column(spark, sf_dir):
    return _t(spark, sf_dir, "part").rename_column("p_brand", "brand").df.select("p_partkey", "brand", "p_size")


@query("SELECT n_name, n_nationkey, n_regionkey, 'n_name,n_nationkey,n_regionkey' AS names FROM nation")
def reorder_columns(spark, sf_dir):
    f = _t(spark, sf_dir, "nation").reorder_columns(["n_name", "n_name", "missing"])
    return f.add_column("names", ",".join(f.columns)).df


@query("SELECT event_id, CASE WHEN regexp_full_match(t, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)') THEN try_cast(t AS DOUBLE) END AS t FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN ' ' || CAST(user_id AS VARCHAR) WHEN event_id % 3 = 1 THEN 'n/a' END AS raw, trim(raw) AS t FROM events)")
def cast_to_number(spark, sf_dir):
    f = _t(spark, sf_dir, "events").transform(lambda r: {"event_id": r.event_id, "t": F.when(r.event_id % 3 == 0, F.concat(F.lit("\t "), r.user_id.cast("string"))).when(r.event_id % 3 == 1, "n/a")})
    return f.cast_column_type("t", "number").df


@query("SELECT event_id, CASE event_type WHEN 'click' THEN true WHEN 'view' THEN false END AS flag FROM events")
def cast_to_boolean(spark, sf_dir):
    f = _t(spark, sf_dir, "events").transform(lambda r: {"event_id": r.event_id, "flag": F.when(r.event_type == "click", " On ").when(r.event_type == "view", "NO").otherwise("maybe")})
    return f.cast_column_type("flag", "boolean").df


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def cast_to_date(spark, sf_dir):
    f = _t(spark, sf_dir, "orders").transform(lambda r: {"o_orderkey": r.o_orderkey, "day": F.when(r.o_orderkey % 2 == 0, F.date_format(r.o_orderdate, "yyyy-MM-dd")).otherwise(F.date_format(r.o_orderdate, "MM/dd/yyyy"))})
    return f.cast_column_type("day", "date").df.select("o_orderkey", F.to_date("day").alias("day"))


@query("SELECT p_partkey, coalesce(CAST(CASE WHEN p_size % 2 = 0 THEN p_size END AS VARCHAR), '') AS size FROM part")
def cast_to_string(spark, sf_dir):
    f = _t(spark, sf_dir, "part").transform(lambda r: {"p_partkey": r.p_partkey, "size": F.when(r.p_size % 2 == 0, r.p_size.cast("double"))})
    return f.cast_column_type("size", "string").df


@query("SELECT c_custkey, 'ACTIVE' AS c_mktsegment, c_acctbal + 1 AS c_acctbal FROM customer")
def update_all(spark, sf_dir):
    return _t(spark, sf_dir, "customer").update(lambda r: {"c_mktsegment": F.lit("ACTIVE"), "c_acctbal": r.c_acctbal + 1}).df.select("c_custkey", "c_mktsegment", "c_acctbal")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_acctbal < 0 THEN true END AS flag FROM customer")
def update_where(spark, sf_dir):
    return _t(spark, sf_dir, "customer").update_where(lambda r: r.c_acctbal < 0, {"c_mktsegment": "debt", "flag": True}).df.select("c_custkey", "c_mktsegment", "flag")


@query("SELECT p_partkey, '$' || p_brand AS p_brand FROM part")
def update_column(spark, sf_dir):
    return _t(spark, sf_dir, "part").update_column("p_brand", lambda current, row: F.concat(F.lit("$"), current)).df.select("p_partkey", "p_brand")


@query("SELECT s_suppkey AS key, s_name || ' (' || CAST(s_nationkey AS VARCHAR) || ')' AS label FROM supplier")
def transform_rows(spark, sf_dir):
    return _t(spark, sf_dir, "supplier").transform(lambda r: {"key": r.s_suppkey, "label": F.concat(r.s_name, F.lit(" ("), r.s_nationkey.cast("string"), F.lit(")"))}).df


@query("SELECT s_suppkey AS key, length(s_name) * 2 AS size FROM supplier")
def transform_in_python(spark, sf_dir):
    double = python("key long, size long")(lambda r: {"key": r["s_suppkey"], "size": len(r["s_name"]) * 2})
    return _t(spark, sf_dir, "supplier").transform(double).df


@query("SELECT upper(r_name) AS value FROM region")
def map_values(spark, sf_dir):
    return Frame.from_parquet(spark, f"{sf_dir}/region.parquet", "r_regionkey").map(lambda r: F.upper(r.r_name)).df


@query("SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN value END, -1.0) AS v FROM events")
def fill_missing(spark, sf_dir):
    f = _t(spark, sf_dir, "events").transform(lambda r: {"event_id": r.event_id, "v": F.when(r.event_id % 2 == 0, r.value)})
    return f.fill_missing_values("v", -1.0).df


@query("SELECT o_orderkey, 'o_orderstatus' AS field, o_orderstatus AS text FROM orders UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM orders")
def unpivot_orders(spark, sf_dir):
    return _t(spark, sf_dir, "orders").unpivot("o_orderkey", ["o_orderstatus", "o_orderpriority"], "field", "text").df


@query("SELECT n_nationkey, lower(n_name) AS lo, upper(n_name) AS up, array_to_string(list_transform(string_split(lower(n_name) || ' of x', ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS cap FROM nation")
def normalize_names(spark, sf_dir):
    f = _t(spark, sf_dir, "nation").transform(lambda r: {"n_nationkey": r.n_nationkey, "lo": normalize(r.n_name, "lowercase"), "up": r.n_name, "cap": F.concat(F.lower(r.n_name), F.lit(" of x"))})
    return f.normalize_text("up", "uppercase").normalize_text("cap", "capitalize").df


@query("SELECT p_partkey, p_brand AS padded FROM part")
def trim_padding(spark, sf_dir):
    f = _t(spark, sf_dir, "part").transform(lambda r: {"p_partkey": r.p_partkey, "padded": F.concat(F.lit(" \t "), r.p_brand, F.lit(" ﻿\n"))})
    return f.trim_whitespace().df


@query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def nested_path(spark, sf_dir):
    f = _t(spark, sf_dir, "events").transform(lambda r: {"event_id": r.event_id, "p": F.from_json(r.props, "k long")})
    return f.df.select("event_id", get_path("p.k").alias("k"))


# ---------------------------------------------------------------------------------------------------------------- rows


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'F'")
def filter_orders(spark, sf_dir):
    return _t(spark, sf_dir, "orders").filter(lambda r: (r.o_totalprice > 200000) & (r.o_orderstatus == "F")).df.select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 1")
def first_row_where(spark, sf_dir):
    return _one(spark, o_orderkey=_t(spark, sf_dir, "orders").find_row_where("o_orderstatus = 'O'")["o_orderkey"])


@query("SELECT c_name FROM customer WHERE c_custkey = 7")
def find_row_by_text(spark, sf_dir):
    return _one(spark, c_name=_t(spark, sf_dir, "customer").find_row(" 7 ", "c_custkey")["c_name"])


@query("SELECT p_partkey FROM part WHERE regexp_matches(lower(p_brand), '#[12]') ORDER BY p_partkey LIMIT 1")
def find_row_by_pattern(spark, sf_dir):
    row = _t(spark, sf_dir, "part").find_row_by_regex("(?i)#[12]", "p_brand")
    return spark.createDataFrame([(row["p_partkey"],)] if row else [], "p_partkey long")


@query("SELECT o_orderkey FROM orders WHERE contains(CAST(o_orderkey AS VARCHAR), '77')")
def find_rows_by_part_of_text(spark, sf_dir):
    return _t(spark, sf_dir, "orders").find_rows(77, "o_orderkey").df.select("o_orderkey")


@query("SELECT p_partkey, CAST(levenshtein(p_name, 'red widget') AS INTEGER) AS dist, row_number() OVER (ORDER BY dist, p_partkey) - 1 AS index FROM part")
def similar_parts(spark, sf_dir):
    found = _t(spark, sf_dir, "part").find_similar_rows("red widget", "p_name").with_row_index().df
    return found.select(F.col("row.p_partkey").alias("p_partkey"), "dist", "index")


@query("SELECT p_partkey FROM part ORDER BY levenshtein(p_name, 'blue bolt'), p_partkey LIMIT 1")
def most_similar_part(spark, sf_dir):
    return _one(spark, p_partkey=_t(spark, sf_dir, "part").find_most_similar_row("blue bolt", "p_name")["row"]["p_partkey"])


@query("SELECT event_id FROM events WHERE NOT coalesce(CASE WHEN event_id % 3 > 0 THEN value END > 50, false)")
def remove_where_unknown(spark, sf_dir):
    return _t(spark, sf_dir, "events").remove_where(lambda r: F.when(r.event_id % 3 > 0, r.value) > 50).df.select("event_id")


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'pass' ELSE 'fail' END AS side FROM customer")
def split_customers(spark, sf_dir):
    parts = _t(spark, sf_dir, "customer").split(lambda r: r.c_acctbal > 0)
    return parts.passed.add_column("side", "pass").append(parts.failed.add_column("side", "fail")).df.select("c_custkey", "side")


@query("SELECT c_custkey, c_mktsegment, c_nationkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS n FROM customer) WHERE n = 1")
def dedup_segment_nation(spark, sf_dir):
    return _t(spark, sf_dir, "customer").deduplicate(["c_mktsegment", "c_nationkey"]).df.select("c_custkey", "c_mktsegment", "c_nationkey")


@query("SELECT n_nationkey AS key, n_name AS name, NULL::VARCHAR AS extra FROM nation UNION ALL SELECT r_regionkey + 100, r_name, 'region' FROM region UNION ALL SELECT 999, 'x', NULL")
def append_rows(spark, sf_dir):
    nations = _t(spark, sf_dir, "nation").transform(lambda r: {"key": r.n_nationkey, "name": r.n_name})
    regions = Frame.from_parquet(spark, f"{sf_dir}/region.parquet", "r_regionkey").transform(lambda r: {"key": r.r_regionkey + 100, "name": r.r_name, "extra": F.lit("region")})
    return nations.append(regions).append({"key": 999, "name": "x"}).df


# --------------------------------------------------------------------------------------------------------------- joins

@query("SELECT a.n_nationkey AS k, CASE WHEN b.n_nationkey IS NOT NULL THEN b.v ELSE a.n_name END AS v FROM nation a LEFT JOIN (SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'b' END AS v FROM nation WHERE n_nationkey % 2 = 0) b USING (n_nationkey)")
def join_right_side_wins(spark, sf_dir):
    a = _t(spark, sf_dir, "nation").transform(lambda r: {"k": r.n_nationkey, "v": r.n_name})
    b = _t(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0").transform(lambda r: {"k": r.n_nationkey, "v": F.when(r.n_nationkey % 4 == 0, "b")})
    return a.join(b, "k", "k", "left").df


_JOIN_SQL = (
    "SELECT o_orderkey, c_custkey, {} FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN -o_custkey ELSE o_custkey END AS buyer FROM orders) "
    "{} JOIN (SELECT *, CASE WHEN c_custkey % 5 = 0 THEN c_custkey + 1000000000 ELSE c_custkey END AS account FROM customer) ON buyer = account"
)


def _sides(spark, sf_dir):
    """Every order and every customer; some keys of either side are moved away from all of the other's."""
    orders = _t(spark, sf_dir, "orders").add_column("buyer", lambda r: F.when(r.o_orderkey % 3 == 0, -r.o_custkey).otherwise(r.o_custkey))
    return orders, _t(spark, sf_dir, "customer").add_column("account", lambda r: F.when(r.c_custkey % 5 == 0, r.c_custkey + 1000000000).otherwise(r.c_custkey))


def _join(how: str) -> Query:
    def run(spark, sf_dir):
        orders, customers = _sides(spark, sf_dir)
        return orders.join(customers, "buyer", "account", how).df.select("o_orderkey", "c_custkey", "o_totalprice")

    run.__name__ = f"join_{how}"
    return run


for _how in ("inner", "left", "right", "outer"):
    query(_JOIN_SQL.format("o_totalprice", "FULL" if _how == "outer" else _how.upper()))(_join(_how))


@query(_JOIN_SQL.format("coalesce(c_name, 'nobody') AS who", "LEFT"))
def join_with_selection(spark, sf_dir):
    orders, customers = _sides(spark, sf_dir)
    return orders.join(customers, "buyer", "account", "left", lambda left, right: {"o_orderkey": left.o_orderkey, "c_custkey": right.c_custkey, "who": F.coalesce(right.c_name, F.lit("nobody"))}).df


@query("SELECT coalesce(a.c_custkey, b.k) AS k, a.c_acctbal AS bal, b.c_nationkey AS nation FROM customer a FULL JOIN (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN -c_custkey ELSE c_custkey END AS k FROM customer) b ON a.c_custkey = b.k")
def merge_customers(spark, sf_dir):
    f = _t(spark, sf_dir, "customer")
    a = f.transform(lambda r: {"k": r.c_custkey, "bal": r.c_acctbal})
    b = f.transform(lambda r: {"k": F.when(r.c_custkey % 3 == 0, -r.c_custkey).otherwise(r.c_custkey), "nation": r.c_nationkey})
    return a.merge_with(b, "k").df


@query("""
WITH a AS (SELECT c_nationkey AS k, c_custkey AS x, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer),
     b AS (SELECT s_nationkey AS k, s_suppkey AS y, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier)
SELECT coalesce(a.k, b.k) AS k, x, y FROM a FULL JOIN b ON a.k = b.k AND a.n = b.n
""")
def merge_one_to_one(spark, sf_dir):
    a = _t(spark, sf_dir, "customer").transform(lambda r: {"k": r.c_nationkey, "x": r.c_custkey})
    b = _t(spark, sf_dir, "supplier").transform(lambda r: {"k": r.s_nationkey, "y": r.s_suppkey})
    return a.merge_with(b, "k").df


@query("""
WITH a AS (SELECT c_nationkey AS k, c_custkey AS x FROM customer), b AS (SELECT s_nationkey AS k, s_suppkey AS y FROM supplier)
SELECT coalesce(a.k, b.k) AS k, x, y FROM a FULL JOIN b ON a.k = b.k AND a.x = b.y
""")
def merge_by_a_test_within_groups(spark, sf_dir):
    a = _t(spark, sf_dir, "customer").transform(lambda r: {"k": r.c_nationkey, "x": r.c_custkey})
    b = _t(spark, sf_dir, "supplier").transform(lambda r: {"k": r.s_nationkey, "y": r.s_suppkey})
    return a.merge_with(b, lambda left, right: left["x"] == right["y"], within="k").df.select("k", "x", "y")


@query("SELECT o_orderkey, c_custkey FROM orders FULL JOIN customer ON false")
def join_of_unlike_keys(spark, sf_dir):
    return _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "customer"), "o_orderkey", "c_name", "outer").df.select("o_orderkey", "c_custkey")


# ------------------------------------------------------------------------------------------------------------ ordering


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS index FROM customer")
def sort_numbers_descending(spark, sf_dir):
    return _t(spark, sf_dir, "customer").sort_by("c_acctbal", "desc").with_row_index().df.select("c_custkey", "index")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS index FROM part")
def sort_texts(spark, sf_dir):
    return _t(spark, sf_dir, "part").sort_by("p_name").with_row_index().df.select("p_partkey", "index")


@query("SELECT event_id, row_number() OVER (ORDER BY v NULLS FIRST, event_id) - 1 AS index FROM (SELECT event_id, CASE WHEN event_id % 500 <> 0 THEN value END AS v FROM events)")
def sort_nulls_first(spark, sf_dir):
    f = _t(spark, sf_dir, "events").transform(lambda r: {"event_id": r.event_id, "v": F.when(r.event_id % 500 != 0, r.value)})
    return f.sort_by_async("v").with_row_index().df.select("event_id", "index")


@query("SELECT c_custkey, row_number() OVER (ORDER BY abs(c_acctbal), c_custkey) - 1 AS index FROM customer")
def sort_by_key_callback(spark, sf_dir):
    return _t(spark, sf_dir, "customer").sort_by_async(lambda r: F.abs(r.c_acctbal)).with_row_index().df.select("c_custkey", "index")


@query("SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 25")
def head_events(spark, sf_dir):
    return _t(spark, sf_dir, "events").head(25).df.select("event_id", "event_type")


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 25")
def tail_events(spark, sf_dir):
    return _t(spark, sf_dir, "events").tail(25).df.select("event_id", "event_type")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS index FROM orders")
def row_index(spark, sf_dir):
    return _t(spark, sf_dir, "orders").with_row_index().df.select("o_orderkey", "index")


@query("SELECT 40 AS n, true AS subset")
def sample_rows(spark, sf_dir):
    f = _t(spark, sf_dir, "nation").append(*[{"n_nationkey": 100 + k, "n_name": "x", "n_regionkey": 0} for k in range(75)])
    taken = f.sample(40, seed=3).df
    return taken.agg(F.count("*").cast("int").alias("n"), F.bool_and((F.col("n_nationkey") >= 0) & (F.col("n_nationkey") < 175)).alias("subset"))


# ---------------------------------------------------------------------------------------------- mapping and validation


@query("SELECT s_suppkey AS id, s_name AS name, s_nationkey AS nation FROM supplier")
def headermap_nested(spark, sf_dir):
    nested = map_rows(_t(spark, sf_dir, "supplier"), {"s_suppkey": "id", "s_name": "profile.name", "s_nationkey": "profile.place.nation"})
    return nested.df.select("id", "profile.name", "profile.place.nation")


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN p_brand || '|' || p_type ELSE p_brand END AS joined FROM part")
def headermap_to_array(spark, sf_dir):
    f = _t(spark, sf_dir, "part").transform(lambda r: {"p_partkey": r.p_partkey, "tag_2": F.when(r.p_size > 25, r.p_type).otherwise(" "), "tag_1": r.p_brand})
    mapped = map_rows(f, {"p_partkey": "p_partkey", "tags": ToArray("tags", pattern=r"^tag_\d$", sort_by=lambda n: int(n[-1]))})
    return mapped.df.select("p_partkey", F.array_join("tags", "|").alias("joined"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_brand AS tag_1, CASE WHEN p_size > 25 THEN p_type ELSE '-' END AS tag_2, '-' AS tag_3 FROM part")
def headermap_from_array(spark, sf_dir):
    f = _t(spark, sf_dir, "part").transform(lambda r: {"p_partkey": r.p_partkey, "tags": F.when(r.p_size > 25, F.array(r.p_brand, r.p_type)).otherwise(F.array(r.p_brand))})
    return unmap_rows(f, {"p_partkey": "id", "tags": FromArray(prefix="tag_", max_columns=3, empty_cell="-")}).df


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN value END AS v FROM events")
def custom_casts(spark, sf_dir):
    f = _t(spark, sf_dir, "events").transform(lambda r: {"event_id": r.event_id, "v": F.when(r.event_id % 4 == 0, F.concat(F.lit("$"), r.value.cast("string"))).otherwise("free")})
    dollars = Caster(lambda c: c.startswith("$"), lambda c: F.substring(c, 2, 99).try_cast("double"))
    return apply_casts(f, CustomCasts(definitions={"dollars": dollars}, columns={"v": ["dollars", "number"]}, on_error="null")).df


_BALANCE = SchemaConfig(columns={"c_acctbal": Field([Check(lambda c: c > 0, "must be positive")])}, row=RowSchema(checks=[(lambda r: r.c_mktsegment != "BUILDING", "wrong segment", "c_mktsegment")]))


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_mktsegment <> 'BUILDING'")
def validate_filter(spark, sf_dir):
    return validate(_t(spark, sf_dir, "customer"), SchemaConfig(_BALANCE.row, _BALANCE.columns, "filter")).df.select("c_custkey")


@query("SELECT c_custkey, c_acctbal > 0 AND c_mktsegment <> 'BUILDING' AS valid, CAST(c_acctbal <= 0 AS BIGINT) AS by_column, CAST(c_mktsegment = 'BUILDING' AS BIGINT) AS by_row FROM customer")
def validate_keep(spark, sf_dir):
    found = validate(_t(spark, sf_dir, "customer"), SchemaConfig(_BALANCE.row, _BALANCE.columns, "keep")).validation_results
    return found.select("original_row.c_custkey", "valid", F.size("column_issues").cast("long").alias("by_column"), F.size("row_issues").cast("long").alias("by_row"))


# ------------------------------------------------------------------------------------------ files, streams, parallelism


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, props FROM events")
def csv_round_trip(spark, sf_dir):
    f = _t(spark, sf_dir, "events").transform(lambda r: {"event_id": r.event_id, "event_type": r.event_type, "props": r.props})
    return from_file(spark, write_folder(f, _scratch(spark), Dialect(nulls=True)), Dialect(nulls=True)).df


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents")
def csv_round_trip_of_texts(spark, sf_dir):
    f = _t(spark, sf_dir, "documents").transform(lambda r: {"doc_id": r.doc_id, "text": r.text})
    return from_file(spark, write_folder(f, _scratch(spark), Dialect(nulls=True)), Dialect(multiline=True, nulls=True)).df


@query("SELECT n_nationkey || ',' || n_name AS line FROM nation")
def text_lines(spark, sf_dir):
    text = to_string(_t(spark, sf_dir, "nation").remove_column("n_regionkey"), header=False)
    return spark.createDataFrame([(x,) for x in text.splitlines()], "line string")


@query("SELECT event_id, value * 2 AS twice FROM events WHERE event_type = 'click'")
def pipeline_over_a_file(spark, sf_dir):
    p = Pipeline.from_frame(_t(spark, sf_dir, "events")).filter("event_type = 'click'").add_column("twice", lambda r: r.value * 2)
    return p.map(lambda r: {"event_id": r.event_id, "twice": r.twice}).prepare_collect().run().df


@query("SELECT CAST(event_id AS BIGINT) AS event_id, value + 1 AS more FROM events WHERE event_type = 'view'")
def stream_over_a_folder(spark, sf_dir):
    folder = _scratch(spark)
    f = _t(spark, sf_dir, "events").transform(lambda r: {"event_id": r.event_id, "event_type": r.event_type, "value": r.value})
    f.df.write.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{folder}/in")
    p = Pipeline.watch(spark, f"{folder}/in", "event_id long, event_type string, value double").filter("event_type = 'view'").map(lambda r: {"event_id": r.event_id, "more": r.value + 1})
    p.run_to_folder(f"{folder}/out", f"{folder}/checkpoint", "parquet")
    return spark.read.parquet(f"{folder}/out")


# the rest of the catalogue registers itself here
from rowframe import catalog_io  # noqa: E402, F401
