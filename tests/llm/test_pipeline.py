"""The registered queries against their SQL, and the pipeline's stages on planted documents."""

import os
import random

import duckdb
import pytest

import corpus_pipeline
from rowframe.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_against_sql(spark, tables, name):
    df = queries.QUERIES[name](spark, SF)
    expected = tables.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in expected.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(str(tuple(r[c] for c in names)) for r in df.collect()) == sorted(str(tuple(r)) for r in expected.fetchall())


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _through(spark, docs, folder, sf_dir=SF):
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out[name] = docs
    return out


def test_stages_on_planted_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.orderBy("doc_id").limit(1).first()
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    clean = " ".join(f"Thand{k} eren{k % 7} of the{k % 11} tion" for k in range(80))
    planted = [
        (10001, None, None, None, None),
        (10002, "12345 !!", "en", "s", 8),
        (10003, first["text"], first["lang"], "copy", first["n_chars"]),
        (10004, f"{clean} {item} end of it", "en", "s", 0),
        (10005, f"The of and with reach bob@mail.example.com now. {clean[::-1]}", "en", "s", 0),
    ]
    out = _through(spark, docs.unionByName(spark.createDataFrame(planted, COLUMNS)), str(tmp_path))
    for name in list(out)[:-1]:
        assert out[name].columns == docs.columns
    ids = {n: {r["doc_id"] for r in d.select("doc_id").distinct().collect()} for n, d in out.items()}
    assert not {10001, 10002} & ids["language_id"] and {10003, 10004, 10005} <= ids["language_id"]
    assert 10003 not in ids["near_duplicates"] and first["doc_id"] in ids["near_duplicates"]
    text = lambda stage, i: out[stage].where(f"doc_id = {i}").first()["text"]
    assert item not in text("decontamination", 10004) and "end of it" in text("decontamination", 10004)
    assert "[EMAIL]" in text("personal_data", 10005) and "bob@" not in text("personal_data", 10005)
    assert ids["best_fit_packing"] == ids["personal_data"]


def test_language_stage_drops_noise_and_keeps_clean_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(3)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    noise = [draw("abcdefghijklmnopqrstuvwxyz", 300), " ".join(draw("abcdefghijklmnopqrstuvwxyz", 7) for _ in range(60)), draw("0123456789abcdef", 400), draw("ABCDEFGHIJKLMNOPabcdefghijklm0123456789+/", 400), "x 12 999 31 4.5 " * 30, "Это простой текст на русском языке. " * 3, "这是一个简单的中文文本。" * 5]
    planted = spark.createDataFrame([(1000000 + k, t, None, "s", len(t)) for k, t in enumerate(noise)], COLUMNS)
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs.unionByName(planted), SF).select("doc_id").collect()}
    every = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert kept == every


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, n_words string, n_hit string, item_ids string, hit_spans string, spans string, base_spans string, score string, lang_pred string, rest string, `a.b` string, __doc string, piece string, shard string"


def test_stages_on_clashing_columns_repeats_and_long_texts(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    text = docs.where("lang = 'en' AND length(text) > 500").orderBy("doc_id").first()["text"]
    names = [c.strip().split()[0].strip("`") for c in CLASHING.split(",")]
    own = lambda i, t: (i, t, "en", "s", len(t or ""), *[f"my {n}" for n in names[5:]])
    long = " ".join(f"the{k} of and ther{k % 13} with that" for k in range(40000))
    rows = [own(1, f"{text} mail bob@mail.example.com {item} and more"), own(2, None), own(3, long), own(4, text[::-1] + " the and of with that " * 9), own(4, text[::-1] + " the and of with that " * 9), own(5, "")]
    train = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 3 = 0").collect()
    rows += [own(1000 + r["doc_id"], r["text"]) for r in train]
    out = _through(spark, spark.createDataFrame(rows, CLASHING), str(tmp_path))
    for name in list(out)[:-1]:
        assert out[name].columns == names
        assert all(r[n] == f"my {n}" for r in out[name].collect() for n in names[5:])
    last = out["personal_data"].where("doc_id < 10").collect()
    assert sorted(r["doc_id"] for r in last) == [1, 3, 4]
    by_id = {r["doc_id"]: r["text"] for r in last}
    assert "[EMAIL]" in by_id[1] and item not in by_id[1] and by_id[3] == long


def test_empty_table_and_whole_run(spark, tmp_path):
    out = _through(spark, spark.createDataFrame([], COLUMNS), str(tmp_path))
    assert all(d.count() == 0 for d in out.values())
    assert corpus_pipeline.run(spark, SF).count() > 0
