"""Each training-data operator against brute force, exact round trips or held-out accuracy, with the odd cases."""

import hashlib
import math
import pickle
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowframe.llm import ann, chat, components, decontam, hmm, html_crf, jaccard, langid, packing, pii, substring

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
CLASHING = "doc_id long, text string, n_words string, score string, spans string, block int"


def docs_of(spark, rows, extra=False):
    if extra:
        return spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], CLASHING)
    return spark.createDataFrame(rows, "doc_id long, text string")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ------------------------------------------------------------------------------------------------- 1 nearest neighbours


def test_neighbours_recall_and_order(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    found = defaultdict(list)
    for r in ann.op1_nearest_neighbours(spark, SF).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"], r["rank"]))
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    hits = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((ids, d))[:10]
        own = found[ids[q]]
        hits += len({v for v, _, _ in own} & set(ids[best].tolist()))
        total += 10
        assert [k for _, _, k in own] == list(range(1, len(own) + 1)) and sorted((s, v) for v, s, _ in own) == [(s, v) for v, s, _ in own]
        assert all(abs(s - d[ids == v][0]) < 1e-9 for v, s, _ in own)
    assert hits / total >= 0.9


def test_probing_prunes_clustered_vectors():
    rng = np.random.default_rng(7)
    x = rng.standard_normal((200, 64))[rng.integers(0, 200, 20000)] + 0.15 * rng.standard_normal((20000, 64))
    codes = ann.Codes.fitted(x[: ann.SAMPLE], 10)
    admitted, ranked = codes.shares(x)
    assert ranked <= admitted < 0.1
    for radius in (0, 5, 17, 40):
        reach, own = codes.reach(radius), ann.Directories(codes.code(x[:3000]))
        for q in range(5):
            within = np.flatnonzero(np.bitwise_count(own.codes ^ own.codes[q]).sum(axis=1) <= radius)
            assert np.isin(within, own.probe(own.codes[q], reach)).all()


def test_recall_of_neighbours_on_the_tables(spark):
    sf = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toArrow()
    ids, x = table["vec_id"].to_numpy(), np.array(table["embedding"].to_pylist(), float)
    found = defaultdict(set)
    for r in ann.op1_nearest_neighbours(spark, sf).collect():
        found[r["query_id"]].add(r["vec_id"])
    hits = 0
    asked = np.flatnonzero(ids % 100 == 0)
    for q in asked:
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(found[ids[q]] & set(ids[np.argsort(d)[:10]].tolist()))
    assert hits / (10 * len(asked)) >= 0.95


def test_neighbours_odd_cases(spark):
    rows = [(k, [float(k % 7), 1.0, 0.5 * k]) for k in range(60)]
    rows += [(200 + k, [1.0, 1.0, 1.0]) for k in range(15)] + [(100, [1.0, 1.0, 1.0])]
    rows += [(300, None), (301, [0.0, 0.0, 0.0]), (302, [float("nan"), 1.0, 1.0]), (303, [None, 1.0, 1.0]), (304, [1.0, 2.0]), (305, []), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(*r, "q") for r in rows], "vec_id long, embedding array<float>, rank string")
    got = ann.nearest(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    assert {r["query_id"] for r in got} == {0, 100, 200}
    assert [r["vec_id"] for r in got if r["query_id"] == 100] == list(range(200, 210)) and all(r["score"] == 0 for r in got if r["query_id"] == 100)
    assert [r["vec_id"] for r in got if r["query_id"] == 200] == [100, *range(201, 210)]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert ann.nearest(df.where("vec_id = 100"), F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("sigma", [0.1, 0.3])
def test_neighbours_of_isolated_queries(spark, sigma):
    rng = np.random.default_rng(5)
    middles = rng.standard_normal((200, 64))
    x = np.vstack([middles[np.arange(19900) % 200] + sigma * rng.standard_normal((19900, 64)), rng.standard_normal((100, 64))])
    ids = np.arange(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    alone = ids[-50:].tolist()
    found = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id").isin(alone + list(range(0, 19900, 100)))).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == {*alone, *range(0, 19900, 100)}
    hits = 0
    for q, own in found.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        assert [k for k, _, _ in own] == list(range(1, 11)) and all(abs(s - d[v]) < 1e-9 for _, v, s in own)
        hits += len({v for _, v, _ in own} & set(np.argsort(d)[:10].tolist())) if q in alone else 0
    assert hits / 500 >= 0.9


def test_neighbours_beyond_the_radius_are_searched_again(spark):
    x = np.random.default_rng(6).standard_normal((500, 24))
    base = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = ann._ranked(base, {24: ann.Codes(x, 10, 64)}, {24: (np.arange(3), x[:3], np.zeros(3, np.int64))}, 10)
    assert len(found) == 2 and Counter(r["query_id"] for f in found for r in f.collect()) == {0: 10, 1: 10, 2: 10}


# ------------------------------------------------------------------------------------------------ 2 substring dedup


def brute_repeats(rows, width=13):
    words = [(i, WORDS.findall(t or "")) for i, t in rows]
    first = {}
    far = 1 << 63
    for i, w in words:
        for k in range(len(w) - width + 1):
            g = tuple(w[k : k + width])
            first[g] = min(first.get(g, far), far - 1 if i is None else i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < (far - 1 if i is None else i):
                gone[k : k + width] = [True] * width
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=str)


def test_repeats_against_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, rows = text(60), []
    for k in range(120):
        w = text(rng.randint(0, 120))
        if k % 3 == 0:
            at, lo = rng.randint(0, len(w)), rng.randint(0, 40)
            w[at:at] = passage[lo : lo + rng.randint(8, 30)]
        rows.append((rng.randrange(90), rng.choice([" ", "  ", "\n"]).join(w)))
    rows += [(900, "a " * 40), (901, "a " * 13), (902, "b " + "a " * 30 + "c"), (903, None), (904, ""), (905, " \t\n"), (None, " ".join(passage)), (1, rows[5][1]), (1, rows[5][1]), (906, "é漢 " * 20), (907, "é漢 " * 13), (908, " ".join(text(30000)))]
    got = substring.remove_repeats(docs_of(spark, rows, extra=True)).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got), key=str) == brute_repeats(rows)
    assert substring.remove_repeats(docs_of(spark, [])).count() == 0


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(3)
    for vocabulary in (1, 2, 3, 50):
        words = rng.integers(0, 1 << 62, vocabulary).astype(np.uint64)[rng.integers(0, vocabulary, 3000)]
        words[2000:2100] = words[100:200]
        keys = substring.anchors(words, np.zeros(3000, np.int64))
        seen = {}
        for k in range(len(keys)):
            assert seen.setdefault(words[k : k + 13].tobytes(), keys[k]) == keys[k]


def test_windows_are_anchored_by_phrases(spark):
    """Most windows of ordinary text have a phrase of recompression inside; rounds end by themselves."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    total = np.zeros(32, np.int64)
    for r in rows:
        data = np.frombuffer((r["text"] or "").encode(), np.uint8)
        starts, ends, doc = substring.X.word_bounds(data, np.array([0, len(data)]), substring.X.SPACE_BYTES)
        levels = substring.anchored_by_level(substring.X.word_hashes(data, starts, ends), doc)
        total[: len(levels)] += levels
    assert total[0] < 0.05 * total.sum() and total[3:].sum() > 0


# ------------------------------------------------------------------------------------------------- 3 decontamination


def brute_leaks(rows, items):
    pattern, low = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    windows = defaultdict(set)
    for name, t in items:
        w = pattern.findall((t or "").translate(low))
        for k in range(max(1, len(w) - 7) if w else 0):
            windows[tuple(w[k : k + 8])].add(str(name))
    out = []
    for i, t in rows:
        w, names = pattern.findall((t or "").translate(low)), set()
        hit = [False] * len(w)
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                found = windows.get(tuple(w[k : k + size]))
                if found:
                    hit[k : k + size] = [True] * size
                    names |= found
        out.append((i, len(w), sum(hit), sorted(names)))
    return sorted(out, key=str)


def test_leaks_against_brute_force(spark):
    rng = random.Random(11)
    vocabulary = ["The", "a", "é1", "cat", "DOG", "x9", "ÄB", "of"]
    text = lambda n: rng.choice([" ", ", ", "-"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.randint(0, 25))) for k in range(25)] + [(40, "cat"), (41, "of DOG"), (42, None), (43, "..."), (None, "a cat"), (40, "x9 x9 x9")]
    rows = [(k, text(rng.randint(0, 60))) for k in range(150)] + [(900, None), (901, ""), (902, "!!"), (903, text(20000)), (904, items[3][1]), (904, items[3][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.find_leaks(docs_of(spark, rows, extra=True), bench)
    assert "score" in got.columns
    expected = brute_leaks(rows, [x for x in items if x[0] is not None])
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in got.collect()), key=str) == expected
    assert decontam.find_leaks(docs_of(spark, []), bench).count() == 0
    assert decontam.find_leaks(docs_of(spark, rows), bench.limit(0)).where("n_hit > 0").count() == 0


def test_leaks_over_several_automata(spark, monkeypatch):
    monkeypatch.setattr(decontam, "SHARD_BYTES", 300)
    monkeypatch.setattr(decontam, "AT_ONCE", 2)
    items = [(k, " ".join(f"i{k}w{n}" for n in range(12))) for k in range(12)]
    rows = [(k, f"x {items[k % 12][1]} y {items[(k + 5) % 12][1][:40]} z") for k in range(24)]
    got = decontam.find_leaks(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in got), key=str) == brute_leaks(rows, items)


def test_an_automaton_takes_little_memory():
    rng = random.Random(6)
    vocabulary = [f"word{k}" for k in range(20000)]
    items = [(str(k), [rng.choice(vocabulary).encode() for _ in range(60)]) for k in range(2500)]
    size = sum(len(w) + 1 for _, ws in items for w in ws)
    automaton = decontam.SuffixAutomaton(items)
    assert automaton.__sizeof__() < 12 * size + (1 << 21) and len(pickle.dumps(automaton)) < 14 * size + (1 << 21)


def test_cutting_leaks_out(spark):
    item = " ".join(f"secret{k}" for k in range(20))
    rows = [(1, f"Before é, {item.upper()}! after " + "word " * 60), (2, "clean text stays  as it is"), (3, item), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: r for r in decontam.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert set(out) == {1, 2, 4} and out[1]["text"] == "Before é, ! after " + "word " * 60 and out[1]["n_chars"] == len(out[1]["text"])
    assert out[2]["text"] == rows[1][1]


def test_cutting_short_items_out(spark):
    item = "alpha beta gamma delta"
    rows = [(1, f"Before {item.title()}! after " + "word " * 40), (2, "alpha beta gamma stays " * 3), (3, item)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    out = {r["doc_id"]: r for r in decontam.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert set(out) == {1, 2} and out[1]["text"] == "Before ! after " + "word " * 40 and out[1]["n_chars"] == len(out[1]["text"])
    assert out[2]["text"] == rows[1][1]


# ------------------------------------------------------------------------------------------------------------- 4 PII

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_of(text):
    def luhn(d):
        return sum(v if k % 2 == 0 else 2 * v - 9 * (2 * v > 9) for k, v in enumerate(map(int, reversed(d)))) % 10 == 0

    def valid(kind, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]

    return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if valid(kind, m[0]))


def test_base_spans_against_plain_patterns(spark):
    rng = random.Random(5)
    rows = [(k, "".join(rng.choice("01 9.-+()a@._%b5é😀\n") for _ in range(rng.randint(0, 100)))) for k in range(700)]
    rows += [(k, "".join(rng.choice("0123456789 -") for _ in range(60))) for k in range(1000, 1150)]
    rows += [(5000, None), (5001, ""), (5002, "1 2 " * 30000), (5003, "a@b" + ".c" * 20000), (5004, "9" * 30000), (5005, "x@y.z_q@w.e"), (5006, "1.2.3.4" * 3000), (5007, "4111 1111 1111 1111 and +1 (319) 555-5132")]
    found = {r["doc_id"]: [(s["start"], s["rank"], s["end"]) for s in r["base_spans"]] for r in pii.find_pii(docs_of(spark, rows, extra=True)).collect()}
    assert found == {i: base_of(t) for i, t in rows}
    assert pii.find_pii(docs_of(spark, [])).count() == 0


def test_candidates_are_selected_by_format_and_context(spark):
    yes = {"joe (at) site (dot) com or": "joe (at) site (dot) com", "ring (555) 123-4567 y": "(555) 123-4567", "at +1 (319) 555-5132 4524132264652876": ["+1 (319) 555-5132", "4524132264652876"]}
    no = ["v1 id=555-123-4567", "order 1234-5678-9012-3456", "2020-01-02 03:04:05", "Look at this @ home. And then", "555-123-4567-8901"]
    got = {r["text"]: [s["text"] for s in r["spans"]] for r in pii.find_pii(docs_of(spark, list(enumerate([*yes, *no])))).collect()}
    assert got == {**{k: v if isinstance(v, list) else [v] for k, v in yes.items()}, **{k: [] for k in no}}


def test_candidates_of_another_generator(spark):
    texts = pii.held_out_texts(400, seed=5)
    right = found = true = 0
    for r in pii.find_pii(docs_of(spark, [(k, t) for k, (t, _) in enumerate(texts)])).select("doc_id", "spans").collect():
        own, truth = Counter(s["text"] for s in r["spans"]), Counter(texts[r["doc_id"]][1])
        right, found, true = right + sum((own & truth).values()), found + sum(own.values()), true + sum(truth.values())
    assert right / found >= 0.97 and right / true >= 0.9


def test_personal_data_in_one_very_long_text(spark):
    n = 64000
    began = time.perf_counter()
    out = pii.redact(spark.createDataFrame([(1, "x@y.com, " * n), (2, "x@y.com")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert out[0]["text"] == "[EMAIL], " * n and out[1]["text"] == "[EMAIL]" and time.perf_counter() - began < 60
    rows = [(k, "reach bob@mail.example.com or 10.1.2.3 now") for k in (1, 1, 1, 2)]
    got = pii.find_pii(docs_of(spark, rows, extra=True)).select("doc_id", F.size("base_spans").alias("n")).collect()
    assert sorted((r["doc_id"], r["n"]) for r in got) == [(1, 2), (1, 2), (1, 2), (2, 2)]


def test_cutting_by_blocks(spark):
    rng = random.Random(9)
    text = "".join(rng.choice("ab é😀\n") for _ in range(5000))
    places = [(a, min(5000, a + rng.choice([0, 1, 5, 1024, 1025, 2500]))) for a in [0, 1, 1023, 1024, 2047, 4999, 5000, *(rng.randrange(5000) for _ in range(40))]]
    df = spark.createDataFrame([(a, b, text) for a, b in places], "a int, b int, t string").withColumn("k", pii.blocks_of(F.col("t")))
    assert [r["c"] for r in df.select(pii.cut(F.col("k"), F.col("a"), F.col("b")).alias("c")).collect()] == [text[a:b] for a, b in places]


def test_redaction(spark):
    rows = [(1, "mail bob@x.com, +1 (319) 555-5132 é", "en", "s", 9), (2, None, None, None, None), (3, "nothing", "en", "s", 7)]
    out = pii.redact(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).orderBy("doc_id").collect()
    assert [r["text"] for r in out] == ["mail [EMAIL], [PHONE] é", None, "nothing"] and [r["n_chars"] for r in out] == [23, None, 7]


def test_pii_runs_in_the_jvm(spark):
    plan = pii.op4_pii(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# ------------------------------------------------------------------------------------------------------------- 5 chat


def test_chat_round_trip(spark):
    odd = ["<|im_end|>", "a<|b", "back\\slash <\\| <\\\\|", "", None, "<|turn|>", "<\\_", "ends <", "| starts", "\n<|im_start|>user\nhi<|im_end|>\n", "😀é"]
    rows = [(1, k, ["user", "assistant", "assistant", None, "we\nird<\\_|"][k % 5], t, 9) for k, t in enumerate(odd)]
    rows += [(2, None, "assistant", "x", 9), (2, 1, "assistant", "x", 9), (2, 1, "assistant", "x", 9), (None, 0, "user", "lost", 9)]
    made = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int"))
    got = {r["conv_id"]: r for r in made.withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("loss", F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: chat.unescape(s["text"])), "\0")).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [(r or "", t or "") for _, _, r, t, _ in rows[: len(odd)]]
    assert got[1]["loss"] == "\0".join(t or "" for _, _, r, t, _ in rows[: len(odd)] if r == "assistant")
    assert got[2]["formatted"] == "<|im_start|>assistant\nx<|turn|>x<|turn|>x<|im_end|>\n" and len(got[None]["turns"]) == 1
    assert "".join(s["text"] for s in got[1]["segments"]) == got[1]["formatted"]
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_runs_in_the_jvm(spark):
    plan = chat.op5_chat_format(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_one_very_long_conversation(spark):
    rows = [(1, k, ("user", "assistant")[k // 2 % 2], f"turn {k} <|im_end|>") for k in range(20000)]
    made = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    turns = made.select(chat.read_back(F.col("formatted")).alias("t")).first()["t"]
    assert [t["text"] for t in turns] == [r[3] for r in rows] and [t["role"] for t in turns] == [r[2] for r in rows]


# -------------------------------------------------------------------------------------------------------- 6 languages


def test_gradients_through_time():
    rng = np.random.default_rng(0)
    net = langid.Network(["a", "b", "c"], hidden=3)
    codes, labels = rng.integers(0, 256, (7, 4)).astype(np.uint8), rng.integers(0, 3, 4)
    _, grads = net.gradients(codes, labels)
    for p, g in zip(net.parameters(), grads, strict=True):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        keep, step = p[at], 1e-5
        p[at] = keep + step
        up, _ = net.gradients(codes, labels)
        p[at] = keep - step
        down, _ = net.gradients(codes, labels)
        p[at] = keep
        assert abs((up - down) / (2 * step) - g[at]) < 1e-6


def test_reader_agrees_with_the_network():
    net = langid.Network(["a", "b", "c"], hidden=4)
    text = np.frombuffer(b"some bytes to read", np.uint8)
    a, _ = langid.run_forward(net.left, text[:, None])
    b, _ = langid.run_forward(net.right, text[::-1, None])
    logits = np.concatenate((a, b[::-1]), axis=2)[:, 0] @ net.out + net.bias
    p = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    data = np.concatenate((text, text[:5]))
    got = net.reader()(data, np.array([0, len(text), len(text), len(data)]))
    assert np.allclose(got[0], p.mean(0), atol=1e-5) and (got[1] == 0).all() and abs(got[2].sum() - 1) < 1e-5


def test_language_accuracy_and_odd_cases(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    found = langid.op6_language_id(spark, "/root/testdata/sf0.01")
    held = [(r["lang"], r["lang_pred"]) for r in found.join(docs, "doc_id").where("held_out").collect()]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in found.collect())
    net = langid.fit(docs, langid.remainder(F.col("doc_id"), 5) != 0)
    odd = [(1, None), (2, ""), (3, "12 34 !!"), (4, "é"), (5, "漢"), (6, "the and of " * 20000), (None, "x")]
    got = {r["doc_id"]: r for r in langid.identify(docs_of(spark, odd, extra=True), net).collect()}
    assert [got[k]["lang_pred"] for k in (1, 2, 3)] == ["und"] * 3 and got[4]["lang_pred"] != "und" and got[5]["lang_pred"] != "und" and got[6]["lang_pred"] == "en"
    assert langid.identify_documents(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.identify_documents(docs.withColumn("lang", F.lit(None).cast("string")).limit(3)).collect()} == {"und"}


# ------------------------------------------------------------------------------------------------------------- 7 HTML


def test_field_on_unseen_layouts():
    field, rng = html_crf.trained_field(), random.Random(999)
    wrong = total = 0
    for _ in range(150):
        page, labels = html_crf.labelled_page(rng)
        got = field.decode(html_crf.block_features(html_crf.leaf_blocks(page)))
        assert len(got) == len(labels)
        wrong += sum(a != b for a, b in zip(got, labels, strict=True))
        total += len(labels)
    assert wrong / total < 0.02


def test_viterbi_is_exact():
    field = html_crf.Field({f: k for k, f in enumerate("abcd")})
    rng = np.random.default_rng(2)
    field.weights, field.pairs = rng.normal(size=(4, 2)), rng.normal(size=(2, 2))
    for _ in range(20):
        features = [[c for c in "abcd" if rng.random() < 0.5] for _ in range(6)]
        scores = field.scores(features)
        value = lambda y: sum(scores[k, y[k]] for k in range(6)) + sum(field.pairs[y[k], y[k + 1]] for k in range(5))
        best = max(([n >> k & 1 for k in range(6)] for n in range(64)), key=value)
        assert abs(value(field.decode(features)) - value(best)) < 1e-12


#: Layouts written by hand: page, and its main text.
LAYOUTS = [
    ("<html><body><nav><a href=/>Home</a> <a href=/b>Blog</a></nav><main><h1>A title</h1><p>One long paragraph that says a good many things about it all.</p></main><footer>&copy; 2020 Us</footer></body></html>", "A title\n\nOne long paragraph that says a good many things about it all."),
    ("<body><div class='menu'><ul><li><a href='/'>Start</a></li><li><a href='/x'>More</a></li></ul></div><div class=post-body><h2>Heading</h2><p>Text of the post, with <b>bold</b> and <a href=x>a link</a> inside of it, ends here.</p><ul><li>first point of the list</li><li>second point of the list</li></ul></div></body>", "Heading\n\nText of the post, with bold and a link inside of it, ends here.\n\nfirst point of the list\n\nsecond point of the list"),
    ("<article><h1>Formula</h1><p>Let <math><mi>a</mi><mo>=</mo><mi>b</mi></math> be true for all of the numbers that we look at here.</p></article>", "Formula\n\nLet a=b be true for all of the numbers that we look at here."),
    ("<article><h1>Ampersands</h1><p>AT&<b>lt;</b> is not a tag, and &lt;p&gt; is none either, as one can see in here.</p></article>", "Ampersands\n\nAT&lt; is not a tag, and <p> is none either, as one can see in here."),
    ("<article><h1>Drawn</h1><p>A picture <svg><text>of 3 bars</text></svg> stands in the middle of this very sentence, as text.</p></article><aside class='related'><h3>Related</h3><ul><li><a href=1>Another story to read</a></li><li><a href=2>A second story to read</a></li></ul></aside>", "Drawn\n\nA picture of 3 bars stands in the middle of this very sentence, as text."),
    ("<main><article><h1>Long one</h1><p>The first paragraph of this article has some words in it, not only a few.</p><p>Readers may search and share and accept what they like in a longer sentence such as this one.</p></article></main><section class='comments'><h3>Comments</h3><div class='comment'><p>I liked this one very much, thank you.</p></div></section>", "Long one\n\nThe first paragraph of this article has some words in it, not only a few.\n\nReaders may search and share and accept what they like in a longer sentence such as this one."),
    ("<div class='cookie-banner'><p>We use cookies. Accept</p></div><article><h1>News</h1><p>Something happened today in the town that nobody had thought of before.</p><blockquote>I had not thought of it, said one of the people.</blockquote></article><form class='search'><label>Search</label><input type=text><button>Go</button></form>", "News\n\nSomething happened today in the town that nobody had thought of before.\n\nI had not thought of it, said one of the people."),
    ("<header class=site-header><div>The Site</div></header><div id=content><h1>Table</h1><p>What follows after this sentence is the text of an article in a div.</p><pre>some code = 1</pre></div><div class=footer><p>&copy; The Site 2021</p></div>", "Table\n\nWhat follows after this sentence is the text of an article in a div.\n\nsome code = 1"),
    ("<article><h1>Broken <p>A paragraph that has no end tag and a heading without one, it goes on.<p>The next one comes right after it and ends the page as well.", "Broken\n\nA paragraph that has no end tag and a heading without one, it goes on.\n\nThe next one comes right after it and ends the page as well."),
    ("<article><h1 title='a > b'>Quoted</h1><p data-x=\"1 > 0\">The sign in an attribute does not end the tag in which it stands.</p></article>", "Quoted\n\nThe sign in an attribute does not end the tag in which it stands."),
]


@pytest.mark.parametrize("k", range(len(LAYOUTS)))
def test_layouts_written_by_hand(k):
    assert html_crf.main_text(LAYOUTS[k][0], html_crf.trained_field()) == LAYOUTS[k][1]


@pytest.mark.parametrize("piece", ['<a "', "<!", "<div><p>x", "</p>", "<a b='", "<", "<!-- ", "&lt", "<b>x</i>", "<script>"])
def test_pages_of_any_make_take_time_by_length(piece):
    page = piece * (800_000 // len(piece))
    began = time.perf_counter()
    html_crf.leaf_blocks(page)
    html_crf.leaf_blocks(page + ">")
    assert time.perf_counter() - began < 20


def test_extraction_odd_cases(spark):
    page = "<html><head><title>T</title><script>var a='</p><p>';</script></head><body><nav><a href='/'>Home</a></nav><article><h1>A &amp; B</h1><p>First  para&nbsp;graph\nof text here, long enough.<p>Second one<br>goes on &lt;b&gt; and on, it ends.</article><footer>&copy; me</footer></body></html>"
    rows = [(1, "u", page, "t"), (2, None, None, "t"), (3, "u", "", "t"), (4, "u", "<p>unclosed <b", "t"), (5, "u", "<!-- never closed <p>x</p>", "t"), (None, "u", "<script>", "t"), (6, "u", "<div>" * 3000 + "deep" + "<p>x" * 3000, "t")]
    got = {r["page_id"]: r for r in html_crf.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert got[1]["text"] == "A & B\n\nFirst para graph of text here, long enough.\n\nSecond one goes on <b> and on, it ends." and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == got[3]["text"] == got[5]["text"] == got[None]["text"] == "" and len(got) == 7
    assert html_crf.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ------------------------------------------------------------------------------------------------ 8 near duplicates


def brute_links(rows, listed=False):
    """All links by comparing every two texts, or (listed) every two texts that share a shingle."""
    texts = defaultdict(list)
    for i, t in rows:
        texts[t or ""].append((1 << 63) - 1 if i is None else i)
    sets = {}
    for t in texts:
        w = WORDS.findall(t)
        sets[t] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links, root = Counter(), {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    names = list(texts)
    holders = defaultdict(list)
    for k, a in enumerate(names):
        common = Counter(b for g in sets[a] for b in holders[g]) if listed else None
        for g in sets[a] if listed else ():
            holders[g].append(a)
        for b in common if listed else names[:k]:
            both = len(sets[a] & sets[b])
            if both and Fraction(both, len(sets[a] | sets[b])) >= Fraction(4, 5):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for t, own in texts.items():
        least[find(t)] = min(least.get(find(t), 1 << 63), *own)
    return sorted(((i, least[find(t or "")] if sets[t or ""] else i, links[t or ""], len(texts[t or ""]) - 1 if sets[t or ""] else 0) for i, t in rows), key=str)


@pytest.mark.parametrize("tile", [5, 128])
def test_near_duplicates_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(3000)]
    base, rows = [rng.choice(vocabulary) for _ in range(150)], []
    for k in range(40):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(150)] = rng.choice(vocabulary)
        rows.append((k * 3, " ".join(w)))
    rows += [(1000 + k, " ".join(base)) for k in range(10)] + [(700 + k, " ".join(rng.choice(vocabulary) for _ in range(60))) for k in range(40)]
    rows += [(500, None), (501, ""), (502, "a b"), (503, "a b"), (504, "a  b"), (505, " "), (None, " ".join(base)), (700, rows[55][1])]
    got = jaccard.near_duplicates(docs_of(spark, rows, extra=True)).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"], r["n_copies"]) for r in got), key=str) == brute_links(rows)
    kept = [r["doc_id"] for r in jaccard.keep_one(docs_of(spark, rows)).collect()]
    assert len(kept) == len(set(kept)) and {0, 500, 501, 502, 505} <= set(kept) and 1000 not in kept and 503 not in kept
    assert jaccard.near_duplicates(docs_of(spark, [])).count() == 0


def test_near_duplicates_of_shared_ids(spark):
    rng = random.Random(8)
    words = [[f"w{rng.randrange(3000)}" for _ in range(60)] for _ in range(4)]
    a, b, c, d = (" ".join(w) for w in words)
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (7, c), (20, a + " end"), (21, b + " end"), (22, d + " end")]
    got = jaccard.near_duplicates(docs_of(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"], r["n_copies"]) for r in got), key=str) == brute_links(rows)
    kept = [(r["doc_id"], r["text"]) for r in jaccard.keep_one(docs_of(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted([(7, c), (22, d + " end"), (20, a + " end"), (21, b + " end")], key=str)



def test_near_duplicates_of_very_long_texts(spark):
    rng = random.Random(21)
    words = [f"w{rng.randrange(40000)}" for _ in range(30000)]
    near = [w if k % 900 else "changed" for k, w in enumerate(words)]
    far = [f"w{rng.randrange(40000)}" for _ in range(30000)]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(far)), (4, " ".join(far)), (5, "w1 w2")]
    got = jaccard.near_duplicates(docs_of(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"], r["n_copies"]) for r in got), key=str) == brute_links(rows)


def test_depth_meets_the_recall():
    d = jaccard.cut_depth()
    assert jaccard.met(0.8, d) >= jaccard.RECALL > jaccard.met(0.8, d + 1)
    near, far = np.zeros(jaccard.BINS), np.zeros(jaccard.BINS)
    near[-1] = far[0] = 1000
    assert jaccard.next_depth(near, jaccard.DEEPEST, Fraction(4, 5)) == jaccard.DEEPEST
    assert jaccard.next_depth(far, jaccard.DEEPEST, Fraction(4, 5)) == d == jaccard.next_depth(far * 0, jaccard.DEEPEST, Fraction(4, 5))


def test_large_groups_count_their_links_through_the_centre(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 16)
    monkeypatch.setattr(jaccard, "TILE_BYTES", 4096)
    rng = random.Random(13)
    vocabulary = [f"w{k}" for k in range(5000)]
    base, rows = [rng.choice(vocabulary) for _ in range(120)], []
    for k in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 3 if k % 3 else 9)):
            w[rng.randrange(120)] = rng.choice(vocabulary)
        rows.append((k, " ".join(w)))
    got = jaccard.near_duplicates(docs_of(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"], r["n_copies"]) for r in got), key=str) == brute_links(rows)


def test_recall_of_links_on_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    expected = brute_links([(r["doc_id"], r["text"]) for r in docs.collect()], listed=True)
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["n_copies"]) for r in jaccard.op8_jaccard_join(spark, "/root/testdata/sf0.01").collect()}
    assert sum(got[i][1] for i, _, _, _ in expected) >= 0.99 * sum(n for _, _, n, _ in expected) > 0
    assert sum(got[i][0] == c for i, c, _, _ in expected) >= 0.99 * len(expected)
    assert all(got[i][1] <= n and got[i][2] == k for i, _, n, k in expected)


def test_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (7, 7), (200, 150), (200, 160), (160, 170)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), 100).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, **dict.fromkeys((150, 160, 170, 200), 150)}


# ---------------------------------------------------------------------------------------------------------- 9 packing


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(2)
    rows = [(k, " ".join("word%d é漢" % rng.randrange(999) for _ in range(rng.randint(0, 700)))) for k in range(60)]
    rows += [(900, None), (901, ""), (902, "x <|endoftext|> y"), (903, "   \x1c a\r\n\t b"), (None, "none"), (1, "again"), (1, "again")]
    got = packing.pack(docs_of(spark, rows, extra=True), keep_ids=True).collect()
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = []
    for i, t in rows:
        ids, at, k = [*whole.encode(t or "", add_special_tokens=False).ids, 2], 0, 0
        while at < len(ids):
            part = ids[at : at + (len(ids) % 1024 or 1024 if k == 0 else 1024)]
            expected.append((i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), part))
            at, k = at + len(part), k + 1
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], r["ids"]) for r in got), key=str) == sorted(expected, key=str)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= -(-sum(r["length"] for r in got) // 1024) + 2
    assert packing.pack(docs_of(spark, [])).count() == 0


def test_best_fit_against_a_plain_search():
    rng = random.Random(4)
    for _ in range(20):
        size = rng.choice([1, 7, 64, 100])
        lengths = [rng.randint(1, size) for _ in range(rng.randint(0, 120))]
        sequence, offset = packing.best_fit(lengths, size)
        room, used = [], []
        for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
            fits = [r for r in room if r >= lengths[k]]
            used.append(min(fits) if fits else size)
            if fits:
                room.remove(min(fits))
            room.append(used[-1] - lengths[k])
        assert sorted(size - o for o in offset) == sorted(used) and len(set(sequence)) == len(room)


# ---------------------------------------------------------------------------------------------------------- 10 scoring


def test_counts_and_base_scores(spark):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = [(k, f"The cat {k % 5} sat É{k % 3} on " + "mat " * (k % 40)) for k in range(150)] + [(900, None), (901, ""), (902, "word " * 5000), (5, "again"), (5, "again")]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    words = [(i, [*WORDS.findall((t or "").translate(low)), None]) for i, t in rows]
    c = Counter(w for i, ws in words if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    expected = sorted((i, held(i), len(ws), sum(w in c for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 5)) for i, ws in words)
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
    got = hmm.score_texts(docs_of(spark, rows, extra=True), train).collect()
    assert sorted((r["doc_id"], not r["train"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == expected
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert hmm.score_texts(docs_of(spark, []), train).count() == 0
    assert hmm.score_texts(docs_of(spark, [(None, "a b")]), train).first()["n_known"] == 0


def test_forward_is_exact_and_training_helps():
    rng = np.random.default_rng(8)
    sizes = [1, 63, 64, 65, 130, 400]
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    classes = rng.integers(0, hmm.CLASSES, bounds[-1])
    soft = lambda *s: (lambda x: x / x.sum(-1, keepdims=True))(rng.random(s) + 0.01)
    model = hmm.Model(soft(3), soft(3, 3), soft(3, hmm.CLASSES))
    got = hmm.sequence_log10(model, classes, bounds)
    for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        at, total = model.start * model.emit[:, classes[a]], 0.0
        for c in classes[a + 1 : b]:
            total += np.log10(at.sum())
            at = (at / at.sum()) @ model.move * model.emit[:, c]
        assert abs(total + np.log10(at.sum()) - got[k]) < 1e-8
    chain = np.tile([3, 9, 4, 9, 9], 200)
    before = hmm.sequence_log10(model, chain, np.array([0, len(chain)]))[0]
    for _ in range(4):
        model = hmm.Model.from_counts(hmm.expected_counts(model, chain, np.array([0, len(chain)]))[:-2], 3)
        after = hmm.sequence_log10(model, chain, np.array([0, len(chain)]))[0]
        assert after > before - 1e-6
        before = after


@pytest.mark.parametrize("row", [1, 16, 64, 512])
def test_expected_counts_are_those_of_whole_documents(monkeypatch, row):
    monkeypatch.setattr(hmm, "ROW", row)
    rng = np.random.default_rng(4)
    sizes = [1, 130, 64, 2, 65, 1300]
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    classes = rng.integers(0, hmm.CLASSES, bounds[-1])
    soft = lambda *s: (lambda x: x / x.sum(-1, keepdims=True))(rng.random(s) + 0.01)
    model = hmm.Model(soft(3), soft(3, 3), soft(3, hmm.CLASSES))
    start, move, emit, likely = np.zeros(3), np.zeros((3, 3)), np.zeros((3, hmm.CLASSES)), 0.0
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        c = classes[a:b]
        f = [model.start * model.emit[:, c[0]]]
        for x in c[1:]:
            f.append(f[-1] / f[-1].sum() @ model.move * model.emit[:, x])
        likely += sum(np.log(v.sum()) for v in f)
        f = [v / v.sum() for v in f]
        g = [np.ones(3)]
        for x in c[:0:-1]:
            v = model.move @ (model.emit[:, x] * g[-1])
            g.append(v / v.sum())
        g = g[::-1]
        for t, x in enumerate(c):
            own = f[t] * g[t]
            emit[:, x] += own / own.sum()
            if t == 0:
                start += own / own.sum()
            else:
                both = f[t - 1][:, None] * model.move * (model.emit[:, x] * g[t])[None]
                move += both / both.sum()
    got = hmm.expected_counts(model, classes, bounds)
    assert np.allclose(got[:3], start, atol=1e-3) and np.allclose(got[3:12].reshape(3, 3), move, atol=1e-2) and np.allclose(got[12:-2].reshape(3, -1), emit, atol=1e-3)
    assert abs(got[-2] - likely) < 1e-2 and got[-1] == len(classes)


def test_model_beats_the_base_on_held_out_texts(spark):
    rows = hmm.op10_hmm_scoring(spark, SF).where("held_out").agg(F.sum("score").alias("m"), F.sum("base_score").alias("b")).first()
    assert rows["m"] > rows["b"]
