"""Operators of the frame on small tables whose results are plain to see."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowframe import Frame, RowFrameError, python
from rowframe import functional as fn

CATEGORIES = [
    {"id": "1", "category": "Electronics", "price": "100", "inStock": "true"},
    {"id": "2", "category": "Clothing", "price": "50", "inStock": "true"},
    {"id": "3", "category": "Electronics", "price": "200", "inStock": "false"},
    {"id": "4", "category": "Books", "price": "30", "inStock": "true"},
]
NUMBERS = [{"id": "1", "value": 10.0, "category": "A"}, {"id": "2", "value": 20.0, "category": "B"}, {"id": "3", "value": 30.0, "category": "A"}, {"id": "4", "value": 40.0, "category": "C"}]


@pytest.fixture
def shop(spark):
    return Frame.from_data(spark, CATEGORIES)


@pytest.fixture
def numbers(spark):
    return Frame.from_data(spark, NUMBERS)


def ids(frame):
    return [r["id"] for r in frame.to_array()]


def test_lookups(shop):
    assert shop.find_row("2")["category"] == "Clothing"
    assert shop.find_row(" 2 ")["id"] == "2"
    assert shop.find_row("x") is None
    assert shop.find_row_by_regex("^[12]$")["id"] == "1"
    assert ids(shop.find_rows("Electronics", "category")) == ["1", "3"]
    assert ids(shop.find_rows("o", "category")) == ["1", "2", "3", "4"]
    assert shop.find_row_where(lambda r: r.price == "200")["id"] == "3"
    assert ids(shop.find_rows_where("price = '50' or price = '30'")) == ["2", "4"]


def test_updates(shop):
    got = shop.update_where(lambda r: r.inStock == "true", {"status": "Available"}).to_array()
    assert [r["status"] for r in got] == ["Available", "Available", None, "Available"]
    assert [r["price"] for r in shop.update_column("price", lambda c, r: F.concat(F.lit("$"), c)).to_array()] == ["$100", "$50", "$200", "$30"]
    assert ids(shop.remove_where(lambda r: r.inStock == "false")) == ["1", "2", "4"]
    assert shop.transform(lambda r: {"productId": r.id, "label": F.concat(r.category, F.lit("!"))}).to_array()[0] == {"productId": "1", "label": "Electronics!"}
    assert ids(shop.append({"id": "5", "extra": 1})) == ["1", "2", "3", "4", "5"]
    assert shop.update({"price": "1"}).to_array()[3]["price"] == "1"


def test_removal_keeps_rows_of_unknown_condition(spark):
    f = Frame.from_data(spark, [{"a": 1}, {"a": None}, {"a": 2}])
    assert [r["a"] for r in f.remove_where("a = 1").to_array()] == [None, 2]
    passed, failed = f.split("a = 1")
    assert passed.count() == 1 and failed.count() == 2


def test_sorting(shop, spark):
    assert ids(shop.sort_by("price", "desc")) == ["2", "4", "3", "1"]
    f = Frame.from_data(spark, [{"v": "b"}, {"v": "A"}, {"v": None}, {"v": "a"}, {"v": "_"}, {"v": "é"}, {"v": "10"}, {"v": "2"}])
    assert [r["v"] for r in f.sort_by("v").to_array()] == ["_", "10", "2", "a", "A", "b", "é", None]
    g = Frame.from_data(spark, [{"v": 3}, {"v": None}, {"v": 1}, {"v": 3}])
    assert [r["v"] for r in g.sort_by("v").to_array()] == [1, 3, 3, None]
    assert [r["v"] for r in g.sort_by("v", "desc").to_array()] == [None, 3, 3, 1]
    assert [r["v"] for r in g.sort_by_async("v").to_array()] == [None, 1, 3, 3]
    assert [r["v"] for r in g.sort_by_async("v", "desc").to_array()] == [3, 3, 1, None]


def test_sort_is_stable(spark):
    f = Frame.from_data(spark, [{"k": k % 3, "n": k} for k in range(30)])
    got = [(r["k"], r["n"]) for r in f.sort_by("k", "desc").to_array()]
    assert got == sorted(((k % 3, k) for k in range(30)), key=lambda x: -x[0])


def test_merging_sorted_frames(spark):
    parts = [Frame.from_data(spark, [{"k": k} for k in own]) for own in ([1, 4], [2, 2, 9], [3])]
    assert [r["k"] for r in parts[0].merge_sorted(parts[1:], "k").to_array()] == [1, 2, 2, 3, 4, 9]


def test_slices(shop):
    assert ids(shop.head(2)) == ["1", "2"]
    assert ids(shop.take(2)) == ["1", "2"]
    assert ids(shop.tail(2)) == ["3", "4"]
    assert ids(shop.head(-1)) == ["1", "2", "3"]
    assert shop.tail(0).count() == 0
    assert shop.sample(2, seed=1).count() == 2 and shop.sample(0).count() == 0 and shop.sample(9).count() == 4
    assert ids(shop.sort_by("price").tail(1)) == ["2"]


def test_aggregates(numbers, spark):
    assert [numbers.aggregate("value", op) for op in ("sum", "avg", "min", "max", "count")] == [100, 25, 10, 40, 4]
    assert [r["category"] for r in numbers.distinct("category").to_array()] == ["A", "B", "C"]
    text = Frame.from_data(spark, [{"v": "5"}, {"v": "x"}, {"v": ""}, {"v": None}])
    assert text.aggregate("v") == 5 and text.aggregate("v", "count") == 3
    with pytest.raises(RowFrameError):
        Frame.from_data(spark, [{"v": "x"}]).aggregate("v")
    assert Frame.from_data(spark, [{"v": "x"}]).aggregate("v", "count") == 0


def test_groups(shop, spark):
    groups = shop.group_by("category")
    assert groups.keys() == ["Electronics", "Clothing", "Books"]
    assert {k: len(v) for k, v in groups.to_dict().items()} == {"Electronics": 2, "Clothing": 1, "Books": 1}
    assert ids(groups.group("Electronics")) == ["1", "3"]
    assert {r["category"]: [x["id"] for x in r["rows"]] for r in groups.rows().collect()}["Electronics"] == ["1", "3"]
    nested = Frame.from_data(spark, [{"m": {"c": "A"}}, {"m": {"c": None}}, {"m": {"c": "A"}}], "m struct<c: string>")
    assert {k: len(v) for k, v in nested.group_by_field("m.c").to_dict().items()} == {"A": 2, "undefined": 1}


def test_pivot_takes_the_last_value(spark):
    f = Frame.from_data(spark, [{"p": "A", "m": "Jan", "s": 1}, {"p": "A", "m": "Feb", "s": 120}, {"p": "B", "m": "Jan", "s": 200}, {"p": "A", "m": "Jan", "s": 100}, {"p": "B", "m": "Feb", "s": None}])
    assert f.pivot("p", "m", "s", ["Jan", "Feb"]).to_array() == [{"p": "A", "Jan": 100, "Feb": 120}, {"p": "B", "Jan": 200, "Feb": None}]


def test_unpivot(spark):
    f = Frame.from_data(spark, [{"product": "A", "q1": 1, "q2": None}, {"product": "B", "q1": 3, "q2": 4}])
    assert f.unpivot("product", ["q1", "q2"], "quarter", "sales").to_array() == [
        {"product": "A", "quarter": "q1", "sales": 1},
        {"product": "A", "quarter": "q2", "sales": None},
        {"product": "B", "quarter": "q1", "sales": 3},
        {"product": "B", "quarter": "q2", "sales": 4},
    ]
    assert f.unpivot([], []) is f
    assert f.unpivot("product", []).columns == ["product"]


def test_columns(spark):
    f = Frame.from_data(spark, [{"a": 1, "b": "x", "c": True}])
    assert f.add_column("d", lambda r: r.a + 1).to_array() == [{"a": 1, "b": "x", "c": True, "d": 2}]
    assert f.add_column("e", python("int")(lambda r: r["a"] * 10)).to_array()[0]["e"] == 10
    assert f.remove_column(["a", "zzz"]).columns == ["b", "c"]
    assert f.rename_column("a", "z").columns == ["b", "c", "z"]
    assert f.rename_column("a", "b").to_array() == [{"b": 1, "c": True}]
    assert f.rename_column("nope", "n").to_array()[0]["n"] is None
    assert f.reorder_columns(["c", "c", "q", "a"]).columns == ["c", "a", "b"]
    with pytest.warns(UserWarning):
        assert f.add_column("a", 5).columns == ["a", "b", "c"]


def test_cleaning(spark):
    f = Frame.from_data(spark, [{"n": "  Alice ", "c": "new york city", "z": 10001}, {"n": None, "c": "LONDON", "z": None}])
    assert f.trim_whitespace().to_array()[0] == {"n": "Alice", "c": "new york city", "z": 10001}
    assert [r["c"] for r in f.normalize_text("c", "capitalize").to_array()] == ["New York City", "London"]
    assert f.normalize_text("z", "uppercase").to_array() == f.to_array()
    assert [r["z"] for r in f.fill_missing_values("z", 0).to_array()] == [10001, 0]
    assert f.fill_missing_values("new", "v").to_array()[0]["new"] == "v"


@pytest.mark.parametrize(("kind", "given", "expected"), [("number", ["19.99", " N/A ", "", "0x10", "1d", None], [19.99, None, None, 16.0, None, None]), ("boolean", ["true", "0", "Yes", "maybe", "", None], [True, False, True, None, False, None]), ("string", ["a", None, "b", "", "c", "d"], ["a", "", "b", "", "c", "d"])])
def test_casts(spark, kind, given, expected):
    f = Frame.from_data(spark, [{"v": v} for v in given], "v string")
    assert [r["v"] for r in f.cast_column_type("v", kind).to_array()] == expected


def test_date_cast(spark):
    f = Frame.from_data(spark, [{"v": v} for v in ("2024-01-02", "01/02/2024", "nope", "", None)], "v string")
    assert [None if r["v"] is None else r["v"].day for r in f.cast_column_type("v", "date").to_array()] == [2, 2, None, None, None]


USERS = [{"id": 1, "cityId": 101}, {"id": 2, "cityId": 102}, {"id": 3, "cityId": 103}]
CITIES = [{"cid": 101, "city": "A"}, {"cid": 102, "city": "B"}, {"cid": 104, "city": "C"}]


@pytest.mark.parametrize(("how", "expected"), [("inner", [(1, "A"), (2, "B")]), ("left", [(1, "A"), (2, "B"), (3, None)]), ("right", [(1, "A"), (2, "B"), (None, "C")]), ("outer", [(1, "A"), (2, "B"), (3, None), (None, "C")])])
def test_joins(spark, how, expected):
    got = Frame.from_data(spark, USERS).join(Frame.from_data(spark, CITIES), "cityId", "cid", how)
    assert [(r["id"], r["city"]) for r in got.to_array()] == expected


def test_join_collisions_and_keys(spark):
    a = Frame.from_data(spark, [{"k": 1, "v": "l1"}, {"k": None, "v": "l2"}, {"k": 3, "v": "l3"}])
    b = Frame.from_data(spark, [{"k": 1, "v": None}, {"k": None, "v": "r2"}])
    assert [r["v"] for r in a.join(b, "k", "k", "left").to_array()] == [None, "r2", "l3"]
    text = Frame.from_data(spark, [{"k": "1", "w": 5}])
    assert a.join(text, "k", "k").count() == 0
    picked = a.join(b, "k", "k", "left", lambda x, y: {"left": x.v, "right": y.v}).to_array()
    assert picked[0] == {"left": "l1", "right": None} and picked[2] == {"left": "l3", "right": None}


@pytest.mark.parametrize("on", ["id", lambda a, b: a["id"] == b["id"]])
def test_merge(spark, on):
    a = Frame.from_data(spark, [{"id": "1", "name": "A", "stock": 10}, {"id": "2", "name": "B", "stock": 20}, {"id": "2", "name": "B2", "stock": 21}])
    b = Frame.from_data(spark, [{"id": "2", "name": "B", "price": 200}, {"id": "3", "name": "C", "price": 300}])
    got = [(r["id"], r["name"], r.get("stock"), r.get("price")) for r in a.merge_with(b, on).to_array()]
    assert got == [("1", "A", 10, None), ("2", "B", 20, 200), ("2", "B2", 21, None), ("3", "C", None, 300)]


def test_deduplicate(spark):
    rows = [{"id": 1, "c": "A", "v": 10}, {"id": 2, "c": "B", "v": 20}, {"id": 1, "c": "A", "v": 10}, {"id": 3, "c": "A", "v": 30}, {"id": 4, "c": "B", "v": 20}]
    f = Frame.from_data(spark, rows)
    assert [r["id"] for r in f.deduplicate().to_array()] == [1, 2, 3, 4]
    assert [r["id"] for r in f.deduplicate(["c", "v"]).to_array()] == [1, 2, 3]


def test_similarity(shop):
    got = shop.find_similar_rows("Book", "category").to_array()
    assert got[0]["row"]["id"] == "4" and got[0]["dist"] == 1 and len(got) == 4
    assert shop.find_most_similar_row("Cloth", "category")["row"]["id"] == "2"


def test_folds_and_iteration(shop, numbers):
    assert shop.reduce(lambda acc, r: acc + r["id"], "") == "1234"
    assert shop.reduce_column(lambda acc, r: F.concat(acc, r["id"]), "") == "1234"
    assert numbers.reduce_parallel(lambda acc, r: acc + r["value"], lambda a, b: a + b, 0.0) == 100
    seen = []
    shop.for_each(lambda r: seen.append(r["id"]))
    assert seen == ["1", "2", "3", "4"] == [r["id"] for r in shop]
    assert [r["index"] for r in shop.sort_by("price").with_row_index().to_array()] == [0, 1, 2, 3]
    assert [r["value"] for r in shop.map(lambda r: F.upper(r.category)).to_array()][1] == "CLOTHING"


def test_folds_of_many_rows_go_by_chunks(spark, monkeypatch):
    monkeypatch.setattr("rowframe.operators.grouping.FOLD_ROWS", 4)
    frame = Frame.from_data(spark, [{"id": k, "name": chr(97 + k)} for k in range(10)])
    join = lambda acc, r: F.concat(acc, r["name"])
    assert frame.reduce_column(join, "") == "abcdefghij"
    assert frame.sort_by("name", "desc").reduce_column(join, ">") == ">jihgfedcba"
    assert frame.head(8).reduce_column(lambda acc, r: acc * 2 + r["id"], F.lit(1).cast("long")) == 256 + sum(k << (7 - k) for k in range(8))


def test_base_rows(shop, spark):
    assert shop.base_row({"price": "0"}) == {"id": None, "category": None, "price": "0", "inStock": None}
    assert shop.create_row({"id": "9"})["id"] == "9"
    with pytest.raises(RowFrameError):
        Frame.from_data(spark, []).base_row()


def test_functions_mirror_methods(spark):
    assert fn.count(CATEGORIES) == 4
    assert [r["id"] for r in fn.sort_by(CATEGORIES, "id", "desc").to_array()] == ["4", "3", "2", "1"]
    assert fn.join(USERS, CITIES, {"left": "cityId", "right": "cid"}).count() == 2
    assert fn.to_string([{"a": 1, "b": None}]) == "a,b\n1,\n"


def test_no_python_in_built_in_operators(shop):
    from contextlib import redirect_stdout
    from io import StringIO

    plan = StringIO()
    with redirect_stdout(plan):
        shop.filter("price > 10").add_column("x", lambda r: r.price).cast_column_type("price", "number").sort_by("id").head(2).explain()
    assert "PythonUDF" not in plan.getvalue() and "Arrow" not in plan.getvalue() and "InPandas" not in plan.getvalue()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 5), st.sampled_from(["a", "b", None])), max_size=12))
def test_invariants(spark, rows):
    f = Frame.from_data(spark, [{"k": k, "v": v, "n": n} for n, (k, v) in enumerate(rows)], "k int, v string, n int")
    passed, failed = f.split("v = 'a'")
    assert sorted(r["n"] for r in passed.to_array() + failed.to_array()) == list(range(len(rows)))
    once = f.deduplicate(["k"])
    assert once.to_array() == once.deduplicate(["k"]).to_array()
    assert f.append(f).count() == 2 * len(rows)
