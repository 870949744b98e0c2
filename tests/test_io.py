"""Reading, mapping, casting, validating, writing and streaming of delimited text."""

import csv
import io
import itertools
import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowframe import (
    Caster, Check, CustomCasts, Dialect, Field, Frame, FromArray, Pipeline, Retry, RowFrameError, RowSchema, SchemaConfig, ToArray, batches_of, dialect, from_file, from_stream,
    from_string, invert, is_valid_csv, map_rows, python_caster, rows_of, to_string, unmap_rows, validate, write_file, write_folder, write_rows,
)
from rowframe import catalog
from rowframe.functional import array_transformations
from rowframe.parallel import process_in_parallel, process_in_worker

PRODUCTS = "id,name,price,inStock\n1,Product A,100,true\n2,Product B,200,false\n3,Product C,300,true\n"


@pytest.fixture
def products(tmp_path):
    path = tmp_path / "products.csv"
    path.write_text(PRODUCTS)
    return str(path)


def test_sources_agree(spark, products):
    expected = [{"id": "1", "name": "Product A", "price": "100", "inStock": "true"}, {"id": "2", "name": "Product B", "price": "200", "inStock": "false"}, {"id": "3", "name": "Product C", "price": "300", "inStock": "true"}]
    assert from_file(spark, products).to_array() == expected
    assert from_string(spark, PRODUCTS).to_array() == expected
    assert from_stream(spark, io.StringIO(PRODUCTS)).to_array() == expected
    assert from_stream(spark, [PRODUCTS.encode()[:10], PRODUCTS.encode()[10:]]).to_array() == expected
    assert list(rows_of(spark, products)) == expected
    assert [len(b) for b in batches_of(spark, products, 2)] == [2, 1]


def test_quoting_and_empty_cells(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('a,b\n"x, ""y""\nz",\n"",2\n')
    assert from_file(spark, str(path)).to_array() == [{"a": 'x, "y"\nz', "b": ""}, {"a": "", "b": "2"}]
    assert from_string(spark, path.read_text()).to_array() == from_file(spark, str(path)).to_array()


@pytest.mark.parametrize("multiline", [True, False])
def test_preamble(spark, tmp_path, multiline):
    path = tmp_path / "p.csv"
    path.write_text("# made by\n# someone\n# today\nid,v\n1,a\n2,b\n")
    f = from_file(spark, str(path), Dialect(from_line=4, multiline=multiline), save_additional_header=True)
    assert f.preamble == "# made by\n# someone\n# today"
    assert f.to_array() == [{"id": "1", "v": "a"}, {"id": "2", "v": "b"}]
    assert from_file(spark, str(path), Dialect(multiline=multiline), save_additional_header=3).count() == 2
    out = write_file(f.filter("id = '2'"), str(tmp_path / "out"))
    assert open(out).read() == "# made by\n# someone\n# today\nid,v\n2,b\n"


@pytest.mark.parametrize("before", [0, 70, 900])
def test_header_after_many_lines(spark, tmp_path, before):
    path = tmp_path / "late.csv"
    path.write_text("# note, of no use\n" * before + "id,name\n1,a\n2,b\n")
    assert from_file(spark, str(path), Dialect(comment="#")).to_array() == [{"id": "1", "name": "a"}, {"id": "2", "name": "b"}]
    path.write_text('id,"' + "long\n" * before + 'name"\n1,a\n')
    assert from_file(spark, str(path), Dialect()).to_array() == [{"id": "1", "long\n" * before + "name": "a"}]


def test_dialects(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text("%c\na;b\n 1 ;2\n\n3;4\n5;6\n")
    d = dialect(delimiter=";", comment="%", trim=True, to=2)
    assert from_file(spark, str(path), d).to_array() == [{"a": "1", "b": "2"}, {"a": "3", "b": "4"}]
    assert from_string(spark, path.read_text(), d).to_array() == [{"a": "1", "b": "2"}, {"a": "3", "b": "4"}]
    named = dialect(delimiter=";", comment="%", columns=lambda names: [n.upper() for n in names])
    assert from_file(spark, str(path), named).columns == ["A", "B"]
    assert from_string(spark, "1,2\n3,4\n", dialect(columns=False)).to_array() == [{"0": "1", "1": "2"}, {"0": "3", "1": "4"}]
    assert from_file(spark, str(path), dialect(delimiter=";", comment="%"), transform=lambda t: t.replace("3", "9")).to_array()[1]["a"] == "9"


def test_malformed(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("id,name,price\n1,A\n2,B,3\n")
    with pytest.raises(RowFrameError, match="inconsistent column count"):
        from_file(spark, str(path), validate_data=True)
    with pytest.raises(RowFrameError, match="inconsistent column count"):
        from_string(spark, path.read_text())
    assert from_file(spark, str(path), Dialect(relax_column_count=True)).count() == 2
    blank = tmp_path / "b.csv"
    blank.write_text("id,name\n1,\n")
    with pytest.raises(RowFrameError, match="empty values"):
        from_file(spark, str(blank), allow_empty_values=False)
    with pytest.raises(RowFrameError):
        from_file(spark, str(tmp_path / "none.csv"))
    assert is_valid_csv("a,b\n1,2") and is_valid_csv("words") and not is_valid_csv("a,b\n1")


def test_retry(spark, tmp_path):
    said = []
    with pytest.raises(RowFrameError, match="after 3 attempts"):
        from_file(spark, str(tmp_path / "none.csv"), retry=Retry(2, 0.001, said.append))
    assert len(said) == 2
    tries = []

    def shaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("later")
        return "done"

    assert Retry(3, 0.001).run(shaky, "it") == "done" and len(tries) == 3


def test_header_maps(spark):
    names = {"id": "productId", "name": "info.name", "price": "info.price"}
    f = from_string(spark, PRODUCTS, header_map=names)
    assert f.to_array()[0] == {"productId": "1", "info": {"name": "Product A", "price": "100"}}
    back = unmap_rows(f, invert(names))
    assert back.to_array()[0] == {"id": "1", "name": "Product A", "price": "100"}
    assert "inStock" in from_string(spark, PRODUCTS, header_map=names, keep_unmapped=True).columns
    deep = map_rows(Frame.from_data(spark, [{"v": 1}]), {"v": "a.b.c"})
    assert deep.to_array() == [{"a": {"b": {"c": 1}}}]
    with pytest.raises(RowFrameError):
        map_rows(f, {})
    called = map_rows(Frame.from_data(spark, [{"v": 1, "w": 2}]), {"v": lambda c, row: {"x.sum": c + row.w}})
    assert called.to_array() == [{"x": {"sum": 3}}]
    merged = map_rows(Frame.from_data(spark, [{"v": "q"}]), {"v": "x"}, merge=lambda path, c: F.concat(F.lit(path), c))
    assert merged.to_array() == [{"x": "xq"}]


def test_arrays_in_header_maps(spark):
    wide = Frame.from_data(spark, [{"id": "1", "image_2": "b.jpg", "image_1": "a.jpg", "image_3": "", "image_10": None}])
    pattern = {"id": "id", "im": ToArray("images", pattern=r"^image_\d+$", sort_by=lambda n: int(n.split("_")[1]))}
    assert map_rows(wide, pattern).to_array() == [{"id": "1", "images": ["a.jpg", "b.jpg"]}]
    kept = {"im": ToArray("images", columns=["image_2", "image_3"], empty="keep")}
    assert map_rows(wide, kept).to_array() == [{"images": ["b.jpg", None]}]
    only = {"im": ToArray("images", pattern="^image", keep=lambda c: c.startswith("a"), value=F.upper)}
    assert map_rows(wide, only).to_array() == [{"images": ["A.JPG"]}]
    nested = Frame.from_data(spark, [{"id": 1, "images": ["x", "y", "z"]}, {"id": 2, "images": ["w"]}])
    assert unmap_rows(nested, {"id": "ID", "images": FromArray(prefix="image_")}).to_array()[1] == {"ID": "2", "image_1": "w", "image_2": "", "image_3": ""}
    assert unmap_rows(nested, {"images": FromArray(columns=["a", "b"], empty_cell="[NO IMAGE]")}).to_array()[1] == {"a": "w", "b": "[NO IMAGE]"}
    assert unmap_rows(nested, {"images": FromArray(prefix="i", max_columns=2)}).columns == ["i1", "i2"]


def test_arrays_of_rows(spark):
    t = array_transformations
    f = t.array_to_objects(spark, [["P001", "Laptop", 999.5]], {0: "id", 1: "name", 2: "details.price"})
    assert f.to_array() == [{"id": "P001", "name": "Laptop", "details": {"price": 999.5}}]
    g = t.array_to_objects(spark, [["A1", "x"]], {"SKU": "id", "NAME": "name"}, ["SKU", "NAME"])
    assert g.to_array() == [{"id": "A1", "name": "x"}]
    with pytest.raises(RowFrameError):
        t.array_to_objects(spark, [["A1"]], {"SKU": "id"})
    assert t.objects_to_array(g, {"id": "SKU", "name": "NAME"}, ["NAME", "SKU"], include_headers=True) == [["NAME", "SKU"], ["x", "A1"]]
    assert t.objects_to_array(g, {"id": 1, "name": 0}) == [["x", "A1"]]


def test_casts(spark):
    price = CustomCasts(columns={"price": "number", "inStock": "boolean"})
    assert from_string(spark, PRODUCTS, casts=price).to_array()[0] == {"id": "1", "name": "Product A", "price": 100.0, "inStock": True}
    dollars = Caster(lambda c: c.startswith("$"), lambda c: F.substring(c, 2, 99).try_cast("double"))
    mixed = Frame.from_data(spark, [{"p": "$100"}, {"p": "200"}, {"p": "free"}])
    from rowframe.plans.casting import apply_casts

    assert [r["p"] for r in apply_casts(mixed, CustomCasts(columns={"p": [dollars, "number"]}, on_error="null")).to_array()] == [100.0, 200.0, None]
    assert [r["p"] for r in apply_casts(mixed, CustomCasts(columns={"p": [dollars, "number"]}, on_error="original")).to_array()] == ["100.0", "200.0", "free"]
    with pytest.raises(Exception, match="cannot be cast"):
        apply_casts(mixed, CustomCasts(columns={"p": "number"})).to_array()
    everywhere = CustomCasts(definitions={"number": Caster(lambda c: c.rlike("^[0-9]+$"), lambda c: c.cast("int"))})
    assert from_string(spark, PRODUCTS, casts=everywhere).to_array()[1] == {"id": 2, "name": "Product B", "price": 200, "inStock": "false"}
    slow = CustomCasts(columns={"price": python_caster(lambda v: True, lambda v: int(v) + 1, "int")})
    assert from_string(spark, PRODUCTS, casts=slow).to_array()[2]["price"] == 301
    nested = map_rows(Frame.from_data(spark, [{"a": "5"}]), {"a": "m.a"})
    assert apply_casts(nested, CustomCasts(columns={"m.a": "number"})).to_array() == [{"m": {"a": 5.0}}]


SKU = Field([Check(lambda c: c.startswith("SKU-") & (F.length(c) >= 5), "bad SKU")], coerce=F.upper)
QUANTITY = Field([Check(lambda c: c > 0, "must be positive")], coerce=lambda c: c.try_cast("double"))


def test_validation_modes(spark):
    f = Frame.from_data(spark, [{"sku": "SKU-A", "quantity": "10"}, {"sku": "INVALID", "quantity": "5"}, {"sku": "SKU-B", "quantity": "-2"}, {"sku": "SKU-c", "quantity": "20"}])
    config = SchemaConfig(columns={"sku": SKU, "quantity": QUANTITY}, mode="filter")
    assert validate(f, config).to_array() == [{"sku": "SKU-A", "quantity": 10.0}, {"sku": "SKU-C", "quantity": 20.0}]
    with pytest.raises(RowFrameError, match="bad SKU"):
        validate(f, SchemaConfig(columns={"sku": SKU}))
    kept = validate(f, SchemaConfig(columns={"sku": SKU}, row=RowSchema(checks=[(lambda r: r.quantity.cast("int") > 0, "no stock", "quantity")]), mode="keep"))
    assert kept.count() == 4 and kept.to_array()[1]["sku"] == "INVALID" and kept.to_array()[3]["sku"] == "SKU-C"
    results = kept.validation_results.collect()
    assert [r["valid"] for r in results] == [True, False, False, True]
    assert results[1]["column_issues"]["sku"][0]["message"] == "bad SKU" and results[2]["row_issues"][0]["path"] == "quantity"
    assert results[1]["validated_row"] is None and results[1]["original_row"]["sku"] == "INVALID"


def test_python_validators(spark):
    class NotBlank:
        def validate(self, value):
            return {"value": value.strip()} if value and value.strip() else {"issues": [{"message": "blank"}]}

    f = Frame.from_data(spark, [{"n": "Test"}, {"n": "  "}, {"n": " Valid "}])
    assert [r["n"] for r in validate(f, SchemaConfig(columns={"n": Field(validator=NotBlank())}, mode="filter")).to_array()] == ["Test", "Valid"]
    assert validate(Frame.from_data(spark, []), SchemaConfig(columns={"n": SKU})).count() == 0
    assert from_string(spark, "id,name\n", schema=SchemaConfig(columns={"name": SKU})).count() == 0


def test_writing(spark, tmp_path):
    f = Frame.from_data(spark, [{"a": 'x,"y"', "b": True, "c": 1.0, "d": [1, 2]}, {"a": None, "b": False, "c": 2.5, "d": None}])
    text = 'a,b,c,d\n"x,""y""",1,1,"[1,2]"\n,,2.5,\n'
    assert to_string(f) == text
    assert open(write_file(f, str(tmp_path / "o"))).read() == text
    assert open(write_file(f, str(tmp_path / "bom.csv"), bom=True), "rb").read()[:3] == b"\xef\xbb\xbf"
    mapped = write_file(from_string(spark, PRODUCTS), str(tmp_path / "m"), header_map={"id": "Product ID", "name": "Product Name"})
    assert open(mapped).read().splitlines()[:2] == ["Product ID,Product Name", "1,Product A"]
    assert open(write_file(f, f"file://{tmp_path}/h.csv").removeprefix("file://")).read() == text
    folder = write_folder(from_string(spark, PRODUCTS).sort_by("id", "desc"), str(tmp_path / "folder"))
    assert sorted(r["id"] for r in from_file(spark, folder).to_array()) == ["1", "2", "3"]
    assert write_rows(str(tmp_path / "g.csv"), ({"a": k} for k in range(3))) == 3
    assert (tmp_path / "g.csv").read_text() == "a\n0\n1\n2\n"


def test_a_file_is_written_by_executors(spark, tmp_path):
    """No task sends rows to the driver, and parts stand in the frame's order."""
    rows = 30000
    f = Frame.from_df(spark.range(rows).repartition(7).select("id", F.repeat(F.sha2(F.col("id").cast("string"), 256), 8).alias("pad")), "id").sort_by("id", "desc")
    iterate, calls = type(f.df).toLocalIterator, []
    type(f.df).toLocalIterator = lambda *a, **b: calls.append(a) or iterate(*a, **b)
    try:
        path = write_file(f, str(tmp_path / "o"), bom=True, preamble="note")
    finally:
        type(f.df).toLocalIterator = iterate
    note, header, *lines = open(path, encoding="utf-8-sig", newline="").read().split("\n")
    assert (note, header, lines[-1]) == ("note", "id,pad", "") and [int(x.split(",")[0]) for x in lines[:-1]] == list(range(rows - 1, -1, -1))
    assert not calls and os.listdir(tmp_path) == ["o.csv"]


@pytest.mark.parametrize("d", [Dialect(), Dialect(delimiter=";", quote="'", escape="'"), Dialect(escape="\\"), Dialect(delimiter="|", escape="\\")])
@pytest.mark.parametrize("columns", [1, 2])
def test_lines_are_those_of_a_csv_writer(spark, d, columns):
    cells = ["", *("".join(x) for n in (1, 2, 3) for x in itertools.product("a\"',;|\\\n\r ", repeat=n))]
    table = [(c, cells[-k])[:columns] for k, c in enumerate(cells)]
    f = Frame.from_data(spark, [dict(zip("ab", r, strict=False)) for r in table], ", ".join(f"{n} string" for n in "ab"[:columns]))
    out = io.StringIO()
    own = {} if d.escape == d.quote else {"doublequote": False, "escapechar": d.escape}
    csv.writer(out, delimiter=d.delimiter, quotechar=d.quote, lineterminator="\n", **own).writerows(table)
    assert to_string(f, dialect=d, header=False) == out.getvalue()


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "iso-8859-1", "cp1252", "utf-16-le", "utf-16", "utf-32-be"])
def test_encodings_of_a_file(spark, tmp_path, encoding):
    f = Frame.from_data(spark, [{"a": "café", "b": 'x\n"y"'}, {"a": "ÿþ", "b": ""}]).sort_by("a", "desc")
    text = f.to_string()
    assert "café" in text and open(write_file(f, str(tmp_path / "o"), encoding=encoding), "rb").read() == text.encode(encoding)


def test_pipelines(spark, products, tmp_path):
    p = Pipeline.from_file(spark, products).filter("inStock = 'true'").add_column("twice", lambda r: r.price.cast("int") * 2)
    assert [r["twice"] for r in p.prepare_collect().run().to_array()] == [200, 600]
    assert [r["id"] for r in p] == ["1", "3"]
    p.map(lambda r: {"only": r.id}).prepare_to_file(str(tmp_path / "o.csv")).run()
    assert (tmp_path / "o.csv").read_text() == "﻿only\n1\n3\n"
    seen, pipe = [], io.StringIO()
    p.prepare_for_each(lambda r: seen.append(r["id"])).run()
    p.prepare_pipe_to(pipe).run()
    assert seen == ["1", "3"] and pipe.getvalue().startswith("id,")
    assert p.run() is None


def test_watched_folder(spark, tmp_path):
    drop = tmp_path / "drop"
    drop.mkdir()
    for k in range(3):
        (drop / f"{k}.csv").write_text(f"id,v\n{k},{k * 10}\n")
    p = Pipeline.watch(spark, str(drop), "id string, v int", files_per_trigger=1).filter("v > 0").add_column("w", lambda r: r.v + 1)
    assert sorted(r["w"] for r in p.prepare_collect().run().to_array()) == [11, 21]
    p.run_to_folder(str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    (drop / "9.csv").write_text("id,v\n9,90\n")
    p.run_to_folder(str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert sorted(r["id"] for r in from_file(spark, str(tmp_path / "out")).to_array()) == ["1", "2", "9"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(*[st.text(st.characters(codec="utf-8", exclude_characters="\r\x00\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029\ufeff"), max_size=8)] * 2), min_size=1, max_size=6))
def test_text_round_trip(spark, rows):
    f = Frame.from_data(spark, [{"a": f"x{a}", "b": b} for a, b in rows], "a string, b string")
    assert from_string(spark, to_string(f)).to_array() == f.to_array()


ODD_TEXTS = [" lead", "trail ", "\t \n", "\n", "\r", "x\r\n", "", None, '""', ' "a" ', 'a"\0', '\0"', "\0", "\x1fx\x1f", 'a,"\n"', "\\", "null"]


def test_folder_keeps_odd_texts(spark, tmp_path):
    """White space at the ends, NULL beside empty texts, NUL beside quotes."""
    f, d = Frame.from_data(spark, [{"id": str(k), "text": t} for k, t in enumerate(ODD_TEXTS)], "id string, text string"), Dialect(nulls=True)
    assert [r["text"] for r in from_file(spark, write_folder(f, str(tmp_path / "f"), d), d).to_array()] == ODD_TEXTS
    assert [r["text"] for r in from_file(spark, write_folder(f, str(tmp_path / "g"))).to_array()] == [t or "" for t in ODD_TEXTS]
    assert from_string(spark, to_string(f.filter("id < 4"), dialect=d), d).to_array() == f.filter("id < 4").to_array()
    one = Frame.from_data(spark, [{"text": ""}, {"text": " x"}])
    assert from_file(spark, write_folder(one, str(tmp_path / "one"))).to_array() == one.to_array()
    with pytest.raises(RowFrameError, match="one column"):
        write_folder(one, str(tmp_path / "none"), d)


def test_round_trip_query_keeps_odd_texts(spark, tmp_path):
    rows = list(enumerate(ODD_TEXTS))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {int(r["doc_id"]): r["text"] for r in catalog.QUERIES["csv_round_trip_of_texts"](spark, str(tmp_path)).collect()}
    assert got == dict(rows)


def test_folder_with_an_empty_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    (tmp_path / "b c.csv").write_text("id,v\n1,x\n")
    assert from_file(spark, str(tmp_path)).to_array() == [{"id": "1", "v": "x"}]


def test_executor_work(spark):
    assert process_in_worker(spark, lambda x: x * 2, 21) == 42
    assert process_in_parallel(spark, range(30), lambda x: x + 1, chunk_size=7) == list(range(1, 31))
    assert process_in_parallel(spark, [1], lambda x: -x) == [-1]
