"""Registered queries over sources, sinks, iteration and the functional surface, with the SQL that states their results."""

from __future__ import annotations

import io

from pyspark.sql import functions as F

from rowframe import functional as fn
from rowframe import parallel
from rowframe.catalog import _one, _scratch, _t, query
from rowframe.errors import RowFrameError
from rowframe.frame import Frame
from rowframe.functions.text import set_path, to_json_text
from rowframe.operators.base import python
from rowframe.plans import headermap
from rowframe.plans.casting import Caster, CustomCasts, apply_casts, python_caster
from rowframe.plans.validate import Check, Field, RowSchema, SchemaConfig, validate
from rowframe.sources import reader, writer
from rowframe.sources.dialect import Dialect, Retry, is_valid_csv
from rowframe.streaming.pipeline import Pipeline, transformer


def _customers(spark, sf_dir):
    return _t(spark, sf_dir, "customer").transform(lambda r: {"c_custkey": r.c_custkey, "c_name": r.c_name, "c_mktsegment": r.c_mktsegment})


_CUSTOMERS = "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer"
_NATIONS = "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation"


def _nation_text(spark, sf_dir, **options):
    return writer.to_string(_t(spark, sf_dir, "nation").reorder_columns(["n_nationkey", "n_name", "n_regionkey"]), **options)


# ------------------------------------------------------------------------------------------------------------- sources


@query(_NATIONS)
def text_to_frame(spark, sf_dir):
    return reader.from_string(spark, _nation_text(spark, sf_dir)).df


@query(_NATIONS)
def stream_to_frame(spark, sf_dir):
    text = _nation_text(spark, sf_dir).encode()
    return reader.from_stream(spark, (text[k : k + 64] for k in range(0, len(text), 64))).df


@query(_CUSTOMERS)
def file_of_customers(spark, sf_dir):
    return reader.from_file(spark, writer.write_file(_customers(spark, sf_dir), _scratch(spark))).df


@query("SELECT count(*) AS n, sum(c_custkey) AS s, arg_min(c_name, c_custkey) AS first FROM customer")
def rows_of_a_file(spark, sf_dir):
    path = writer.write_file(_customers(spark, sf_dir), _scratch(spark))
    n = s = 0
    first = None
    for row in reader.rows_of(spark, path):
        n, s, first = n + 1, s + int(row["c_custkey"]), first or row["c_name"]
    return _one(spark, n=n, s=s, first=first)


@query("SELECT CAST(ceil(count(*) / 100.0) AS BIGINT) AS batches, count(*) AS n FROM customer")
def batches_of_a_file(spark, sf_dir):
    path = writer.write_file(_customers(spark, sf_dir), _scratch(spark))
    sizes = [len(b) for b in reader.batches_of(spark, path, 100)]
    return _one(spark, batches=len(sizes), n=sum(sizes))


@query("SELECT 'made by hand' || chr(10) || 'two lines' AS preamble, count(*) AS n, CAST(min(c_custkey) AS BIGINT) AS least FROM customer")
def preamble_of_a_file(spark, sf_dir):
    path = writer.write_file(_customers(spark, sf_dir), _scratch(spark), preamble="made by hand\ntwo lines\n")
    f = reader.from_file(spark, path, Dialect(from_line=3, multiline=False), save_additional_header=True)
    return f.df.agg(F.lit(f.preamble).alias("preamble"), F.count("*").alias("n"), F.min(F.col("c_custkey").cast("long")).alias("least"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name FROM customer")
def line_window_over_a_folder(spark, sf_dir):
    """Every file of the folder has two lines before its header; files of unlike size share partitions."""
    folder = _scratch(spark)
    f = _t(spark, sf_dir, "customer").transform(lambda r: {"c_custkey": r.c_custkey, "c_name": r.c_name})
    for k, part in enumerate(("c_custkey % 7 = 0", "c_custkey % 7 = 1", "c_custkey % 7 > 1")):
        writer.write_rows(f"{folder}-{k}.csv", f.filter(part), preamble="note\nc_custkey,c_name\n", header=["c_custkey", "c_name"])
    return reader.from_file(spark, f"{folder}-[0-2].csv", Dialect(from_line=3, multiline=False)).df


@query(_CUSTOMERS)
def file_in_another_dialect(spark, sf_dir):
    d = Dialect(delimiter=";", quote="'", encoding="iso-8859-1")
    path = writer.write_file(_customers(spark, sf_dir), _scratch(spark), dialect=d, encoding="iso-8859-1")
    return reader.from_file(spark, path, d).df


@query("SELECT n_nationkey, lower(n_name) AS n_name, n_regionkey FROM (" + _NATIONS + ")")
def raw_text_hook(spark, sf_dir):
    path = writer.write_file(_t(spark, sf_dir, "nation"), _scratch(spark), header=["N_NATIONKEY", "N_NAME", "N_REGIONKEY"])
    return reader.from_file(spark, path, transform=str.lower).df


@query("SELECT true AS whole, false AS uneven, false AS with_gaps")
def structure_checks(spark, sf_dir):
    def passes(text, **options):
        folder = f"{_scratch(spark)}.csv"
        with writer._open(spark, folder) as out:
            out.write(text.encode())
        try:
            reader.from_file(spark, folder, **options).count()
            return True
        except RowFrameError:
            return False

    text = _nation_text(spark, sf_dir)
    return _one(spark, whole=passes(text, validate_data=True), uneven=passes(text + "1,2\n", validate_data=True), with_gaps=passes(text + "98,,7\n", allow_empty_values=False))


@query("SELECT 3 AS tries, count(*) AS n FROM nation")
def retried_read(spark, sf_dir):
    text, tries = _nation_text(spark, sf_dir), [0]

    def read():
        tries[0] += 1
        if tries[0] < 3:
            raise OSError("not yet")
        return reader.from_string(spark, text)

    f = Retry(max_retries=5, base_delay=0.001).run(read, "reading")
    return f.df.agg(F.lit(tries[0]).alias("tries"), F.count("*").alias("n"))


@query("SELECT true AS good, false AS bad")
def valid_text(spark, sf_dir):
    text = _nation_text(spark, sf_dir)
    return _one(spark, good=is_valid_csv(text), bad=is_valid_csv('a,b\n1,2,3\n'))


# --------------------------------------------------------------------------------------------------------------- sinks


@query(_CUSTOMERS.replace("c_custkey, c_name", "id, c_name AS name") .replace("c_mktsegment FROM", "'-' AS segment FROM"))
def file_by_header_map(spark, sf_dir):
    f = _t(spark, sf_dir, "customer").transform(lambda r: {"key": r.c_custkey, "who": F.struct(r.c_name.alias("name"), F.lit("-").alias("segment"))})
    path = writer.write_file(f, _scratch(spark), header_map={"key": "id", "who.name": "name", "who.segment": "segment"})
    return reader.from_file(spark, path).df


@query("SELECT n_nationkey, n_name FROM nation")
def rows_as_dicts(spark, sf_dir):
    rows = _t(spark, sf_dir, "nation").remove_column("n_regionkey").to_array()
    return spark.createDataFrame([(r["n_nationkey"], r["n_name"]) for r in rows], "n_nationkey long, n_name string").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, upper(c_name) AS c_name FROM customer")
def file_from_a_generator(spark, sf_dir):
    path = f"{_scratch(spark)}.csv"
    f = _t(spark, sf_dir, "customer").transform(lambda r: {"c_custkey": r.c_custkey, "c_name": r.c_name})
    writer.write_rows(path, iter(f), transform=lambda r: {**r, "c_name": r["c_name"].upper()})
    return reader.from_file(spark, path).df


@query("SELECT s_suppkey, '{\"name\":\"' || s_name || '\",\"nation\":' || CAST(s_nationkey AS VARCHAR) || '}' AS body FROM supplier")
def nested_cells_as_json(spark, sf_dir):
    f = _t(spark, sf_dir, "supplier").transform(lambda r: {"s_suppkey": r.s_suppkey, "body": F.struct(r.s_name.alias("name"), r.s_nationkey.alias("nation"))})
    return f.df.select("s_suppkey", to_json_text(F.col("body")).alias("body"))


@query("SELECT event_id, event_type AS kind FROM (SELECT CAST(event_id AS VARCHAR) AS event_id, event_type FROM events WHERE event_type <> 'view')")
def pipeline_from_file_to_file(spark, sf_dir):
    source = writer.write_file(_t(spark, sf_dir, "events").transform(lambda r: {"event_id": r.event_id, "event_type": r.event_type}), _scratch(spark))
    target = f"{_scratch(spark)}.csv"
    p = Pipeline.from_file(spark, source).filter("event_type <> 'view'").map(lambda r: {"event_id": r.event_id, "kind": r.event_type})
    p.prepare_to_file(target).run()
    return reader.from_file(spark, target).df


@query("SELECT count(*) AS n, CAST(sum(n_regionkey) AS BIGINT) AS s, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation")
def pipeline_for_each_row(spark, sf_dir):
    seen = []
    Pipeline.from_frame(_t(spark, sf_dir, "nation")).prepare_for_each(seen.append).run()
    return _one(spark, n=len(seen), s=sum(r["n_regionkey"] for r in seen), names=",".join(r["n_name"] for r in seen))


@query("SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey, r_name FROM region")
def pipeline_into_a_stream(spark, sf_dir):
    out = io.StringIO()
    Pipeline.from_frame(Frame.from_parquet(spark, f"{sf_dir}/region.parquet", "r_regionkey").reorder_columns(["r_regionkey", "r_name"])).prepare_pipe_to(out).run()
    return reader.from_string(spark, out.getvalue()).df.select("r_regionkey", "r_name")


@query("SELECT event_id, value + 1 AS more FROM events")
def transformer_of_rows(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").transform(transformer(lambda f: f.transform(lambda r: {"event_id": r.event_id, "more": r.value + 1})))


@query("SELECT count(*) AS n, CAST(sum(event_id) AS BIGINT) AS s FROM events WHERE event_type = 'click'")
def stream_collected(spark, sf_dir):
    folder = _scratch(spark)
    spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type").repartition(4).write.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(folder)
    out = Pipeline.watch(spark, folder, "event_id long, event_type string", files_per_trigger=2).filter("event_type = 'click'").prepare_collect().run()
    return out.df.agg(F.count("*").alias("n"), F.sum("event_id").alias("s"))


# ----------------------------------------------------------------------------------------------- mapping, casts, checks


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation")
def headermap_by_place(spark, sf_dir):
    rows = [(r["n_nationkey"], r["n_name"]) for r in _t(spark, sf_dir, "nation").to_array()]
    return headermap.rows_to_objects(Frame, spark, rows, {0: "id", 1: "who.name"}).df.select(F.col("id").cast("long").alias("id"), "who.name")


@query("SELECT p_partkey, p_brand AS maker, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS size FROM part")
def headermap_by_function(spark, sf_dir):
    mapped = headermap.map_rows(_t(spark, sf_dir, "part"), {"p_partkey": "p_partkey", "p_size": lambda c, r: {"facts.size": F.when(c > 25, "big").otherwise("small"), "facts.maker": r.p_brand}})
    return mapped.df.select("p_partkey", "facts.maker", "facts.size")


@query("SELECT s_suppkey, 'name:' || upper(s_name) AS name FROM supplier")
def headermap_with_merge(spark, sf_dir):
    f = _t(spark, sf_dir, "supplier").transform(lambda r: {"s_suppkey": r.s_suppkey, "s_name": r.s_name})
    mapped = headermap.map_rows(f, {"s_suppkey": "id", "s_name": "profile.name"}, merge=lambda path, c: F.concat(F.lit("name:"), F.upper(c)) if path.endswith("name") else c)
    return mapped.df.select(F.col("id").alias("s_suppkey"), "profile.name")


@query("SELECT CAST(r_regionkey AS VARCHAR) AS id, r_name AS name FROM region")
def objects_to_arrays_and_back(spark, sf_dir):
    f = Frame.from_parquet(spark, f"{sf_dir}/region.parquet", "r_regionkey").transform(lambda r: {"id": r.r_regionkey, "place": F.struct(r.r_name.alias("name"))})
    head, *rows = fn.array_transformations.objects_to_array(f, {"id": "id", "place.name": "name"}, include_headers=True)
    return fn.array_transformations.array_to_objects(spark, rows, {"id": "id", "name": "name"}, head).df


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN 'event_type:1' ELSE event_type END AS event_type FROM events")
def casts_with_context(spark, sf_dir):
    f = _t(spark, sf_dir, "events").transform(lambda r: {"event_id": r.event_id, "event_type": r.event_type})
    caster = Caster(lambda c: c == "click", lambda c, context: F.lit(f"{context.column}:{context.index}"))
    return apply_casts(f, CustomCasts(columns={"event_type": [caster]}, on_error="original")).df


@query("SELECT s_suppkey, length(s_name) AS size FROM supplier")
def casts_in_python(spark, sf_dir):
    f = _t(spark, sf_dir, "supplier").transform(lambda r: {"s_suppkey": r.s_suppkey, "size": r.s_name})
    return apply_casts(f, CustomCasts(columns={"size": [python_caster(lambda v: v is not None, len, "long")]}, on_error="null")).df


@query("SELECT c_custkey, c_acctbal FROM customer WHERE false UNION ALL SELECT count(*), 0.0 FROM customer")
def validate_or_raise(spark, sf_dir):
    f = _t(spark, sf_dir, "customer")
    good = validate(f, SchemaConfig(columns={"c_custkey": Field([Check(lambda c: c >= 0, "must not be negative")])}))
    try:
        validate(f, SchemaConfig(columns={"c_custkey": Field([Check(lambda c: c > 5, "must be more than five")])}))
    except RowFrameError as e:
        assert "must be more than five" in str(e)
        return good.df.agg(F.count("*").alias("c_custkey"), F.lit(0.0).alias("c_acctbal"))
    raise RowFrameError("an invalid row passed")


class _Even:
    def validate(self, value):
        return {"value": value * 10} if value % 2 == 0 else {"issues": [{"message": "odd"}]}


@query("SELECT s_suppkey * 10 AS s_suppkey, s_name FROM supplier WHERE s_suppkey % 2 = 0")
def validate_by_object(spark, sf_dir):
    f = _t(spark, sf_dir, "supplier").transform(lambda r: {"s_suppkey": r.s_suppkey.cast("long"), "s_name": r.s_name})
    return validate(f, SchemaConfig(RowSchema({"s_suppkey": Field(validator=_Even(), returns="long")}), mode="filter")).df


# ---------------------------------------------------------------------------------------------------- rows and iteration


@query("SELECT 'n_nationkey,n_name,n_regionkey' AS names, NULL::VARCHAR AS n_name, 7 AS n_regionkey")
def base_and_new_rows(spark, sf_dir):
    f = _t(spark, sf_dir, "nation").reorder_columns(["n_nationkey", "n_name", "n_regionkey"])
    made = f.create_row({"n_regionkey": 7})
    return spark.createDataFrame([(",".join(f.base_row()), made["n_name"], made["n_regionkey"])], "names string, n_name string, n_regionkey int")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS index FROM orders")
def merge_of_sorted(spark, sf_dir):
    f = _t(spark, sf_dir, "orders").transform(lambda r: {"o_orderkey": r.o_orderkey, "o_totalprice": r.o_totalprice})
    parts = [f.filter(f"o_orderkey % 3 = {s}").sort_by("o_totalprice") for s in range(3)]
    return parts[0].merge_sorted(parts[1:], "o_totalprice").sort_by("o_orderkey").sort_by("o_totalprice").with_row_index().df.select("o_orderkey", "index")


@query("SELECT string_agg(n_name, '|' ORDER BY n_name DESC) AS names, count(*) AS n FROM nation")
def iteration_in_order(spark, sf_dir):
    f, names, n = _t(spark, sf_dir, "nation").sort_by("n_name", "desc"), [], [0]
    f.for_each(lambda r: n.__setitem__(0, n[0] + 1))
    for row in f:
        names.append(row["n_name"])
    return _one(spark, names="|".join(names), n=n[0])


@query("SELECT count(*) AS n, sum(s_suppkey) AS s FROM supplier")
def side_effects_on_executors(spark, sf_dir):
    count, total = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def visit(row):
        count.add(1)
        total.add(int(row["s_suppkey"]))

    _t(spark, sf_dir, "supplier").for_each_async(visit, 3)
    return _one(spark, n=count.value, s=total.value)


@query("SELECT length(s_name) AS size, s_suppkey FROM supplier")
def map_async_in_order(spark, sf_dir):
    f = _t(spark, sf_dir, "supplier")
    sizes = f.map_async(python("struct<size: long, s_suppkey: long>")(lambda r: {"size": len(r["s_name"]), "s_suppkey": r["s_suppkey"]}))
    return sizes.df.select("value.size", "value.s_suppkey")


@query("SELECT DISTINCT n_regionkey, dense_rank() OVER (ORDER BY first DESC) - 1 AS index FROM (SELECT n_regionkey, max(n_name) AS first FROM nation GROUP BY 1)")
def distinct_after_a_descending_text(spark, sf_dir):
    return _t(spark, sf_dir, "nation").sort_by("n_name", "desc").distinct("n_regionkey").with_row_index().df


# ---------------------------------------------------------------------------------------------------- parallel, functions


@query("SELECT n_nationkey AS n, n_nationkey * n_nationkey AS square FROM nation")
def work_in_parallel(spark, sf_dir):
    items = [r["n_nationkey"] for r in _t(spark, sf_dir, "nation").to_array()]
    squares = parallel.process_in_parallel(spark, items, lambda x: x * x, chunk_size=4)
    return spark.createDataFrame(list(zip(map(int, items), map(int, squares), strict=True)), "n long, square long")


@query("SELECT count(*) AS n FROM nation")
def work_in_a_worker(spark, sf_dir):
    return _one(spark, n=parallel.process_in_worker(spark, len, _t(spark, sf_dir, "nation").to_array()))


@query("SELECT c_mktsegment AS segment, c_custkey, round(c_acctbal * 2, 4) AS twice FROM customer WHERE c_acctbal > 0")
def functional_chain(spark, sf_dir):
    f = fn.filter_data(_t(spark, sf_dir, "customer"), "c_acctbal > 0")
    f = fn.add_column(f, "twice", lambda r: F.round(r.c_acctbal * 2, 4))
    return fn.rename_column(f, "c_mktsegment", "segment").df.select("segment", "c_custkey", "twice")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def functional_join(spark, sf_dir):
    return fn.join(_t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer"), {"left": "o_custkey", "right": "c_custkey", "type": "inner"}).df.select("o_orderkey", "c_name")


@query("SELECT sum(n_regionkey)::DOUBLE AS s, count(*) AS n, string_agg(n_name, ',' ORDER BY n_nationkey) AS names, true AS apart FROM nation")
def functional_folds(spark, sf_dir):
    rows = _t(spark, sf_dir, "nation").to_array()
    copy = fn.clone(rows)
    copy[0]["n_name"] = "changed"
    names = fn.reduce_data(rows, lambda acc, r: [*acc, r["n_name"]], [])
    return _one(spark, s=float(fn.aggregate(rows, "n_regionkey", "sum")), n=fn.count(rows), names=",".join(names), apart=rows[0]["n_name"] != "changed")


@query("SELECT p_partkey, p_brand AS maker, p_size + 1 AS size FROM part")
def nested_path_set(spark, sf_dir):
    f = _t(spark, sf_dir, "part").transform(lambda r: {"p_partkey": r.p_partkey, "facts": F.struct(r.p_brand.alias("maker"), r.p_size.alias("size"))})
    return f.df.select("p_partkey", set_path(F.col("facts"), "size", F.col("facts.size") + 1).alias("facts")).select("p_partkey", "facts.maker", "facts.size")
