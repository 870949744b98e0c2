"""Benchmark decontamination by a generalised suffix automaton of the benchmark items.

The automaton of all normalised items is built on the driver and broadcast; a benchmark larger than one automaton may
hold is cut into shards, which go over the documents a few at a time, each pass adding to what was found before.
Training words stream through it; the longest matching length tells at each word whether it ends a window of an item.
Stretches without ``shortest window`` consecutive benchmark words cannot match; a table of word hashes passes over them
in numpy, and only the rest is walked word by word. Automata are flat arrays, of which a shard of 1 MB of items takes some
10 MB in a worker.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowframe.llm import text as X
from rowframe.llm.durable import durable
from rowframe.llm.rows import add_columns, brought_back, set_aside

#: Words of a window, items from which a document counts as contaminated, bytes of items in one automaton, and automata
#: that are broadcast at a time: together, a bound of the broadcast.
WINDOW, MIN_ITEMS, SHARD_BYTES, AT_ONCE = 8, 2, 1 << 20, 4

#: What separates words: [\x00-\x2F\x3A-\x60\x7B-\x7F], after A-Z became a-z.
SEPARATORS = np.zeros(256, dtype=bool)
SEPARATORS[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
SEPARATORS[0x41:0x5B] = False

_TABLE = 1 << 20


def normal_words(text: str | None) -> list[bytes]:
    data = X.LOWER_BYTES[np.frombuffer((text or "").encode(), np.uint8)]
    starts, ends, _ = X.word_bounds(data, np.array([0, len(data)]), SEPARATORS)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


class _Builder:
    """All runs of words (numbers) of all items, word by word; states are runs that end at the same places."""

    def __init__(self, items: list[list[int]]):
        self.edges: list[dict[int, int]] = [{}]
        self.longest, self.suffix = array("i", [0]), array("i", [-1])
        for words in items:
            at = 0
            for w in words:
                at = self._grow(at, w)

    def _state(self, longest: int, edges: dict[int, int], suffix: int) -> int:
        self.edges.append(edges)
        self.longest.append(longest)
        self.suffix.append(suffix)
        return len(self.edges) - 1

    def _split(self, parent: int, word: int, child: int) -> int:
        """The state of parent's longest run plus word, made out of child where child also holds longer runs."""
        if self.longest[child] == self.longest[parent] + 1:
            return child
        twin = self._state(self.longest[parent] + 1, dict(self.edges[child]), self.suffix[child])
        self.suffix[child] = twin
        while parent >= 0 and self.edges[parent].get(word) == child:
            self.edges[parent][word] = twin
            parent = self.suffix[parent]
        return twin

    def _grow(self, last: int, word: int) -> int:
        if word in self.edges[last]:
            return self._split(last, word, self.edges[last][word])
        new = self._state(self.longest[last] + 1, {}, 0)
        parent = last
        while parent >= 0 and word not in self.edges[parent]:
            self.edges[parent][word] = new
            parent = self.suffix[parent]
        if parent >= 0:
            self.suffix[new] = self._split(parent, word, self.edges[parent][word])
        return new


def _lists(n: int, pairs: list[tuple[int, int]]) -> tuple[array, array]:
    """The second numbers of sorted distinct pairs by the first: bounds of each of n, and all in a row."""
    pairs = sorted(set(pairs))
    count = np.bincount(np.array([a for a, _ in pairs], np.int64), minlength=n)
    return array("i", np.concatenate(([0], np.cumsum(count))).astype(np.int32).tobytes()), array("i", [b for _, b in pairs])


class SuffixAutomaton:
    """The automaton of all items in flat arrays of 32-bit numbers: some 50 bytes a word of the items.

    Words are known by their hashes, in whose order they are numbered.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        items = [(name, words) for name, words in items if words]
        self.window, self.names = window, sorted({name for name, _ in items})
        vocabulary = sorted({w for _, ws in items for w in ws})
        ends = np.cumsum([len(w) for w in vocabulary]).astype(np.int64)
        hashes = X.word_hashes(np.frombuffer(b"".join(vocabulary), np.uint8), np.concatenate(([0], ends[:-1])).astype(np.int64), ends) if vocabulary else np.zeros(0, np.uint64)
        self.hashes = np.unique(hashes)
        number = dict(zip(vocabulary, np.searchsorted(self.hashes, hashes).tolist(), strict=True))
        self.known = np.zeros(_TABLE, bool)
        self.known[(self.hashes & np.uint64(_TABLE - 1)).astype(np.int64)] = True
        place = {name: k for k, name in enumerate(self.names)}
        numbered = [(place[name], [number[w] for w in words]) for name, words in items]
        self._settle(_Builder([words for _, words in numbered]), numbered)

    def _settle(self, built: _Builder, items: list[tuple[int, list[int]]]) -> None:
        """Flat edges; which items hold the window that a state ends with, and which short items end there."""
        n, size = len(built.edges), self.window
        self.longest, self.suffix = built.longest, built.suffix
        by_length = sorted(range(1, n), key=self.longest.__getitem__)
        self.window_state = array("i", bytes(4 * n))
        for v in by_length:
            if self.longest[v] >= size:
                up = self.suffix[v]
                self.window_state[v] = v if self.longest[up] < size else self.window_state[up]
        held, short, lengths = [], [], {}
        for name, words in items:
            v = 0
            for k, w in enumerate(words, 1):
                v = built.edges[v][w]
                if k >= size:
                    held.append((self.window_state[v], name))
            if len(words) < size:
                lengths[v] = len(words)
                short.append((v, name))
        self.items_at, self.items = _lists(n, held)
        self.short_at, self.short_items = _lists(n, short)
        self.short_words = lengths
        self.short_state = array("i", bytes(4 * n))
        for v in by_length:
            self.short_state[v] = v if v in lengths else self.short_state[self.suffix[v]]
        self.least = min([size, *lengths.values()])
        self.edges_at, self.edge_words, self.edge_ends = array("i", [0]), array("i"), array("i")
        for edges in built.edges:
            for w in sorted(edges):
                self.edge_words.append(w)
                self.edge_ends.append(edges[w])
            self.edges_at.append(len(self.edge_words))

    def __sizeof__(self) -> int:
        """Bytes of all arrays."""
        return sum(memoryview(x).nbytes for x in vars(self).values() if isinstance(x, array | np.ndarray)) + sum(map(len, self.names)) * 2

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers of words by their hashes; -1 for those that no item has."""
        out = np.full(len(hashes), -1, np.int64)
        maybe = np.flatnonzero(self.known[(hashes & np.uint64(_TABLE - 1)).astype(np.int64)])
        if len(maybe) and len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
            same = self.hashes[at] == hashes[maybe]
            out[maybe[same]] = at[same]
        return out

    def _next(self, v: int, word: int) -> int:
        """The state after ``word``, or 0."""
        lo, hi = self.edges_at[v], self.edges_at[v + 1]
        k = lo if hi - lo == 1 else bisect_left(self.edge_words, word, lo, hi)
        return self.edge_ends[k] if k < hi and self.edge_words[k] == word else 0

    def matches(self, words: list[int]) -> list[tuple[int, int, list[str]]]:
        """(first word, word after, items) of each window occurrence; the longest match is carried from word to word."""
        found, suffix, longest, names = [], self.suffix, self.longest, self.names
        v = length = 0
        for k, w in enumerate(words, 1):
            to = self._next(v, w)
            while v and not to:
                v = suffix[v]
                length = longest[v]
                to = self._next(v, w)
            v = to
            length = length + 1 if v else 0
            if length >= self.window:
                s = self.window_state[v]
                found.append((k - self.window, k, [names[i] for i in self.items[self.items_at[s] : self.items_at[s + 1]]]))
            s = self.short_state[v]
            while s:
                m = self.short_words[s]
                if m <= length:
                    found.append((k - m, k, [names[i] for i in self.short_items[self.short_at[s] : self.short_at[s + 1]]]))
                s = self.short_state[suffix[s]]
        return found


def _scan(automata: list) -> callable:
    def scan(table: pa.Table) -> list[pa.Array]:
        data, offsets = X.utf8(table["text"])
        n_words, n_hit, items, spans = [], [], [], []
        for i, j in X.slabs(offsets):
            base = offsets[i]
            part = X.LOWER_BYTES[data[base : offsets[j]]]
            starts, ends, doc = X.word_bounds(part, offsets[i : j + 1] - base, SEPARATORS)
            hashes = X.word_hashes(part, starts, ends)
            hit, names = np.zeros(len(starts), bool), {}
            bounds = np.searchsorted(doc, np.arange(j - i + 1))
            if "hit_spans" in table.column_names:
                for d in range(i, j):
                    if found := table["item_ids"][d].as_py():
                        names[d - i] = set(found)
                        for span in table["hit_spans"][d].as_py():
                            hit[bounds[d - i] + span["first"] : bounds[d - i] + span["first"] + span["words"]] = True
            for shared in automata:
                automaton = shared.value
                numbers = automaton.numbers(hashes)
                known = numbers >= 0
                first = np.flatnonzero(known & np.concatenate(([True], ~known[:-1] | (doc[1:] != doc[:-1]))))
                after = np.flatnonzero(known & np.concatenate((~known[1:] | (doc[1:] != doc[:-1]), [True]))) + 1
                enough = after - first >= automaton.least
                for a, b in zip(first[enough].tolist(), after[enough].tolist(), strict=True):
                    for x, y, found in automaton.matches(numbers[a:b].tolist()):
                        hit[a + x : a + y] = True
                        names.setdefault(int(doc[a]), set()).update(found)
            n_words.append(np.diff(bounds))
            n_hit.append(np.diff(np.concatenate(([0], np.cumsum(hit)))[bounds]))
            for d in range(j - i):
                items.append(sorted(names.get(d, ())))
                a, b = bounds[d], bounds[d + 1]
                if d not in names:
                    spans.append([])
                    continue
                edge = np.flatnonzero(np.diff(np.concatenate(([0], hit[a:b].astype(np.int8), [0]))))
                origin = int(offsets[i + d] - base)
                spans.append([{"first": int(x), "words": int(y - x), "start": int(starts[a + x]) - origin, "end": int(ends[a + y - 1]) - origin} for x, y in edge.reshape(-1, 2)])
        none = np.zeros(0, np.int64)
        kind = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
        return [pa.array(np.concatenate([none, *n_words])), pa.array(np.concatenate([none, *n_hit])), pa.array(items, pa.list_(pa.string())), pa.array(spans, kind)]

    return scan


def _shards(items: DataFrame, item_id: str, text_column: str) -> list[DataFrame]:
    """The items (item, text) in shards of at most about SHARD_BYTES of text, dealt by a hash."""
    own = items.select(F.col(item_id).cast("string").alias("item"), F.col(text_column).cast("string").alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    n = -(-(own.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES) or 1
    return [own if n == 1 else own.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) for k in range(n)]


def _broadcast(shard: DataFrame, window: int):
    rows = sorted((r["item"], r["text"]) for r in shard.collect())
    return shard.sparkSession.sparkContext.broadcast(SuffixAutomaton([(name, normal_words(text)) for name, text in rows], window))


def find_leaks(docs: DataFrame, items: DataFrame, text_column: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) plus n_words, n_hit, item_ids (sorted as strings) and hit_spans (word position, words, byte bounds).

    A null text has no words; a null item or item id takes no part; an item without words never occurs. Texts are read
    whole, however long; rows that repeat are read each by itself; an empty table on either side finds nothing. Clashing
    columns of ``docs`` give way. Items with one id count as one item.
    """
    added = "n_words long, n_hit long, item_ids array<string>, hit_spans array<struct<first: long, words: long, start: long, end: long>>"
    shards = _shards(items, item_id, item_text)
    out = docs.withColumnRenamed(text_column, "text") if text_column != "text" else docs
    for k in range(0, len(shards), AT_ONCE):
        automata = [_broadcast(s, window) for s in shards[k : k + AT_ONCE]]
        last = k + AT_ONCE >= len(shards)
        out = add_columns(out, added, _scan(automata), ["text", "item_ids", "hit_spans"] if k else ["text"], keep if last else None)
        if not last:
            out = durable(out)
            for a in automata:
                a.unpersist()
    return out


def cut_spans(text: Column, spans: Column) -> Column:
    """The text without the spans' bytes (they start and end at whole characters)."""
    raw = text.cast("binary")
    n = F.size(spans)
    kept = F.transform(
        F.sequence(F.lit(0), n),
        lambda k: F.substring(raw, F.when(k == 0, 0).otherwise(F.get(spans, k - 1)["end"].cast("int")) + 1, F.when(k == n, F.length(raw)).otherwise(F.get(spans, k)["start"].cast("int")) - F.when(k == 0, 0).otherwise(F.get(spans, k - 1)["end"].cast("int"))).cast("string"),
    )
    return F.array_join(kept, "")


def decontaminate(docs: DataFrame, items: DataFrame, max_coverage: float = 0.5) -> DataFrame:
    """Documents without benchmark passages, with the columns they came with.

    Every span of hit words (whole windows, or whole items that are shorter) is cut out of the text (n_chars follows); a
    document whose hit words make more than ``max_coverage`` of its words is dropped. Documents without hits stay as they
    are, null and empty texts too. Rows that repeat are handled each by itself; an empty table stays empty; columns of any
    name pass unchanged.
    """
    leaks = find_leaks(set_aside(docs, "text"), items)
    kept = leaks.where((F.col("n_hit") <= max_coverage * F.col("n_words")) | (F.col("n_hit") == 0))
    changed = F.size("hit_spans") > 0
    cut = kept.withColumn("text", F.when(changed, cut_spans(F.col("text").cast("string"), F.col("hit_spans"))).otherwise(F.col("text")))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("__own.n_chars"))
    return brought_back(cut, docs.columns, **new)


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    """The contract's figures of find_leaks() for all documents against all benchmark items."""
    leaks = find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])
    n_items = F.size("item_ids").cast("long")
    return leaks.select("doc_id", "n_words", "n_hit", n_items.alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (n_items >= MIN_ITEMS).alias("contaminated"))


OP3_SQL = r"""
WITH both_ AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
ws AS (
  SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM both_),
w AS (SELECT side, id, len(ws) AS size, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM ws),
runs AS (
  SELECT side, id, size, i, [word, lead(word, 1) OVER x, lead(word, 2) OVER x, lead(word, 3) OVER x, lead(word, 4) OVER x, lead(word, 5) OVER x, lead(word, 6) OVER x, lead(word, 7) OVER x] AS run
  FROM w WINDOW x AS (PARTITION BY side, id ORDER BY i)),
items AS (SELECT DISTINCT id AS item_id, least(size, 8) AS n, array_to_string(run[1:least(size, 8)], ' ') AS seq FROM runs WHERE side = 'b' AND i + least(size, 8) - 1 <= size),
found AS (
  SELECT r.id AS doc_id, r.i, l.n, items.item_id
  FROM runs r CROSS JOIN (SELECT DISTINCT n FROM items) l JOIN items ON items.n = l.n AND items.seq = array_to_string(r.run[1:l.n], ' ')
  WHERE r.side = 'd' AND r.i + l.n - 1 <= r.size),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, i + unnest(range(0, n)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT ws.id AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM ws LEFT JOIN hit ON hit.doc_id = ws.id LEFT JOIN named ON named.doc_id = ws.id WHERE side = 'd'
"""
