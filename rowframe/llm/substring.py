"""Substring deduplication by recompression.

A word covered by a window of ``width`` words whose word sequence also starts in a document with a smaller id is removed.

*Recompression.*  Every document is parsed into ever longer phrases by rounds.  A round first names each maximal run of
one symbol, then pairs neighbouring symbols (left class, right class) under one name.  Class and name are functions of
the symbols alone, so the names are global: every executor gives equal word sequences the same interior symbols, with
no dictionary to exchange.  With each phrase its *extent* is kept: the words that settled its parse.  A window's
*anchor* is its highest-level phrase whose extent lies inside the window (ties by hash), so equal windows have equal
anchors, wherever they stand.  (A window inside one long run has no such phrase; it is its own anchor.)  Rounds go on
until no phrase fits into a window.

*Rounds over the cluster* (``blocks``): 1. blocks send their distinct anchors; buckets tell which occur in two
documents.  2. blocks send the distinct windows under such shared anchors with the smallest document of the block; buckets
answer with the windows that have a smaller document elsewhere, or several in the block, which verifies each repeat over
its whole word sequence.  3. blocks mark covered words.  A passage held by a third of all
documents costs a bucket one entry a block.

Word sequences are compared by 96-bit hashes (of 64 and 32 bits) of mixed 64-bit word hashes.  Texts cross the network once:
the exchange into blocks is reused by all three rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowframe.llm import blocks as B
from rowframe.llm import text as X
from rowframe.ship import ship

#: Words of a window.
WIDTH = 13

_FAR = np.int64(1) << np.int64(40)
_U = np.uint64
#: Upper bits of a phrase's key, for its level.
_LEVEL_BITS = _U(5)
#: What is sent of an anchor: 47 bits, with one left for a flag. Anchors that are equal by accident are verified away.
_ANCHOR_BITS = ~_U((1 << 17) - 1)


def _runs(name, doc, left, right):
    """Name maximal runs; a symbol's parse then also rests on its neighbours, which had to differ."""
    n = len(name)
    first = np.flatnonzero(np.concatenate(([True], (name[1:] != name[:-1]) | (doc[1:] != doc[:-1]))))
    last = np.append(first[1:], n) - 1
    length = (last - first + 1).astype(np.uint64)
    d = doc[first]
    named = np.where(length > 1, X.mix(name[first] + length * _U(0xA24BAED4963EE407)), name[first])
    before, after = np.maximum(first - 1, 0), np.minimum(last + 1, n - 1)
    open_left = (first == 0) | (doc[before] != d)
    open_right = (last == n - 1) | (doc[after] != d)
    lo = np.where(open_left, -_FAR, np.minimum(left[before], left[first]))
    hi = np.where(open_right, _FAR, np.maximum(right[after], right[last]))
    return named, d, lo, hi


def _pairs(name, doc, left, right, level):
    """Name pairs (left class, right class); what stays single rests on the neighbour that did not pair."""
    n = len(name)
    is_left = (X.mix(name + _U(level * 0x9FB21C651E98DF25 & (2**64 - 1))) & _U(1)) == 0
    same = doc[1:] == doc[:-1]
    starts_pair = np.zeros(n, bool)
    starts_pair[:-1] = is_left[:-1] & ~is_left[1:] & same
    head = np.ones(n, bool)
    head[1:] = ~starts_pair[:-1]
    j = np.flatnonzero(head)
    paired, lefty = starts_pair[j], is_left[j]
    other = np.where(lefty, np.minimum(j + 1, n - 1), np.maximum(j - 1, 0))
    missing = (other == j) | (doc[other] != doc[j])
    named = np.where(paired, X.mix(name[j] * _U(0xC2B2AE3D27D4EB4F) + X.mix(name[other])), name[j])
    lo = np.where(missing & ~lefty, -_FAR, np.minimum(left[j], np.where(missing, left[j], left[other])))
    hi = np.where(missing & lefty, _FAR, np.maximum(right[j], np.where(missing, right[j], right[other])))
    return named, doc[j], lo, hi


def _highest(words: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """The highest-level phrase inside the window at each word: its level in the upper bits; 0 for a window without."""
    n = len(words) - width + 1
    best = np.zeros(n, np.uint64)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * X._power_table(X._PRIME, len(words)), out=total[1:])
    undo = X._power_table(X._PRIME_INVERSE, len(words) + 1)
    at = np.arange(len(words), dtype=np.int64)
    symbols = (words, doc, at, at)
    for level in count(1):
        symbols = _pairs(*_runs(*symbols), level)
        _, _, lo, hi = symbols
        fits = (lo >= 0) & (hi < _FAR) & (hi - lo < width)
        if not fits.any():
            return best
        lo, hi = lo[fits], hi[fits]
        key = (X.mix((total[hi + 1] - total[lo]) * undo[lo] + (hi - lo).astype(np.uint64)) >> _LEVEL_BITS) | _U(level << 59)
        # a phrase serves the windows that start at most ``reach`` words before its extent
        reach = width - 1 - (hi - lo)
        most = int(reach.max())
        held = np.zeros((most + 1, len(words)), np.uint64)
        held[reach, lo] = key
        near = held[most]
        for r in range(most - 1, -1, -1):
            near[:-1] = np.maximum(near[:-1], near[1:])
            np.maximum(near, held[r], out=near)
        np.maximum(best, near[:n], out=best)


def anchors(words: np.ndarray, doc: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The anchor of the window at each word: equal for equal windows. Only windows inside one document count."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    best = _highest(words, doc, width)
    bare = best == 0
    if bare.any():
        best[bare] = X.window_hashes(words, width, 7)[bare] >> _LEVEL_BITS
    return X.mix(best) & _ANCHOR_BITS


def anchored_by_level(words: np.ndarray, doc: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """How many windows inside one document have their anchor at each level (0: windows that are their own)."""
    if len(words) < width:
        return np.zeros(1, np.int64)
    return np.bincount((_highest(words, doc, width) >> _U(59)).astype(np.int64)[X.windows_in_one_document(doc, width)])


class _Block:
    """The documents of one block in the order of their ids, with their words' hashes."""

    def __init__(self, table: pa.Table):
        ids = table["doc_id"].combine_chunks().fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        self.table, self.ids = table.take(pa.array(order)), ids[order]
        self.data, self.offsets = X.utf8(self.table["text"])
        self.slabs = list(self._slabs())
        self.anchors: list[np.ndarray] = []

    def _slabs(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """First and last document of each slab, and of each word: its hash and document."""
        for i, j in X.slabs(self.offsets):
            part = self.data[self.offsets[i] : self.offsets[j]]
            starts, ends, doc = X.word_bounds(part, self.offsets[i : j + 1] - self.offsets[i], X.SPACE_BYTES)
            yield i, j, X.word_hashes(part, starts, ends), doc + i

    def keys(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Anchors and the documents they stand in, repeats in a row left out; documents ascend."""
        keys, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        self.anchors = []
        for _, _, words, doc in self.slabs:
            inside = X.windows_in_one_document(doc, width)
            self.anchors.append(anchors(words, doc, width))
            key, d = self.anchors[-1][inside], doc[: len(inside)][inside]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (d[1:] != d[:-1])
            keys.append(key[new])
            docs.append(d[new])
        return np.concatenate(keys), np.concatenate(docs)

    def windows(self, shared: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both hashes and the documents of the windows whose anchor is in ``shared`` (sorted); keys() has found the anchors."""
        one, two, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for (_, _, words, doc), own in zip(self.slabs, self.anchors, strict=True):
            at = np.flatnonzero(X.windows_in_one_document(doc, width))
            at = at[_among(own[at], shared)]
            if len(at):
                one.append(X.window_hashes(words, width, 1)[at])
                two.append(_second(words, width)[at])
                docs.append(doc[at])
        return np.concatenate(one), np.concatenate(two), np.concatenate(docs)


def _among(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)] == values


def _distinct(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the first document of each, and whether another document has it too; docs ascend."""
    order = np.argsort(keys, kind="stable")
    keys, docs = keys[order], docs[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(keys)) - 1 if len(keys) else first
    return keys[first], docs[first], docs[last] != docs[first]


def _second(words: np.ndarray, width: int) -> np.ndarray:
    """The other 32 bits of a window's name."""
    return (X.window_hashes(words, width, 2) >> _U(32)).astype(np.uint32)


def _grouped(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal pairs stand together (others as they came), and where each group starts."""
    order = np.lexsort((two, one))
    one, two = one[order], two[order]
    return order, np.flatnonzero(np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])))) if len(one) else np.zeros(0, np.int64)


def _send_anchors(n_buckets: int, width: int):
    def send(table: pa.Table) -> pa.Table:
        keys, _, several = _distinct(*_Block(table).keys(width))
        return B.packed(table["block"][0].as_py(), *B.bucket_cuts(keys, n_buckets), (keys >> _U(32)).astype(np.uint32), (keys >> _U(16)).astype(np.uint16) | several)

    return send


_REPLY = "block int, round int, bucket int, n int, reply binary"


def _answer_anchors(rows: pa.Table) -> pa.Table:
    """Which anchors occur in two documents, of one block or of two: a bit for each that a block sent."""
    sent = rows["n"].to_pylist()
    high, low = B.unpacked(rows["payload"].to_pylist(), sent, np.uint32, np.uint16)
    _, group, n = np.unique(high.astype(np.uint64) << _U(16) | low >> np.uint16(1) << np.uint16(1), return_inverse=True, return_counts=True)
    hit = (n + np.bincount(group, low & np.uint16(1), len(n)).astype(np.int64))[group] > 1
    cuts = np.concatenate(([0], np.cumsum(sent)))
    bits = [np.packbits(hit[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.table({"block": rows["block"], "round": pa.array([1] * len(bits), pa.int32()), "bucket": rows["bucket"], "n": rows["n"], "reply": pa.array(bits, pa.binary())})


def _of_round(rows: pa.Table, which: int) -> list[tuple[int, int, bytes]]:
    return sorted((b, n, reply) for r, b, n, reply in zip(*(rows[c].to_pylist() for c in ("round", "bucket", "n", "reply")), strict=True) if r == which)


def _shared(block: _Block, replies: pa.Table, width: int) -> np.ndarray:
    """The block's anchors that occur in two documents, sorted."""
    keys, _, _ = _distinct(*block.keys(width))
    flags = [np.unpackbits(np.frombuffer(reply, np.uint8), count=n).astype(bool) for _, n, reply in _of_round(replies, 1)]
    return keys[np.concatenate(flags)] if len(keys) else keys


def _send_windows(n_buckets: int, width: int):
    def send(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return B.PACKED_ARROW.empty_table()
        block = _Block(table)
        one, two, docs = block.windows(_shared(block, replies, width), width)
        order, first = _grouped(one, two)
        docs = block.ids[docs[order]]
        last = np.append(first[1:], len(one)) - 1 if len(first) else first
        return B.packed(table["block"][0].as_py(), *B.bucket_cuts(one[order][first], n_buckets), one[order][first], two[order][first], docs[first], (docs[last] > docs[first]).astype(np.uint8))

    return send


def _answer_windows(rows: pa.Table) -> pa.Table:
    """To each block the windows of it that start in a smaller document: one of another block, or (0) one of its own."""
    sent = rows["n"].to_pylist()
    one, two, first, several = B.unpacked(rows["payload"].to_pylist(), sent, np.uint64, np.uint32, np.int64, np.uint8)
    order, starts = _grouped(one, two)
    least = np.empty(len(one), np.int64)
    if len(one):
        least[order] = np.repeat(np.minimum.reduceat(first[order], starts), np.diff(np.append(starts, len(one))))
    elsewhere, cuts, reply, n = least < first, np.concatenate(([0], np.cumsum(sent))), [], []
    told = elsewhere | (several > 0)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = np.flatnonzero(told[a:b]) + a
        n.append(len(own))
        reply.append(one[own].tobytes() + two[own].tobytes() + elsewhere[own].astype(np.uint8).tobytes())
    return pa.table({"block": rows["block"], "round": pa.array([2] * len(n), pa.int32()), "bucket": rows["bucket"], "n": pa.array(n, pa.int32()), "reply": pa.array(reply, pa.binary())})


def _cover(width: int):
    def cover(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _KEPT_ARROW.empty_table()
        block, answers = _Block(table), _of_round(replies, 2)
        known, second, elsewhere = B.unpacked([r for _, _, r in answers], [n for _, n, _ in answers], np.uint64, np.uint32, np.uint8)
        order = np.lexsort((second, known))
        known, second, elsewhere = known[order], second[order], elsewhere[order] > 0
        first = np.full(len(known), np.iinfo(np.int64).max)
        n_words, n_removed, kept = [], [], []
        for i, j, words, doc in block.slabs:
            gone = np.zeros(len(words), bool)
            if len(known) and len(words) >= width:
                hashes = X.window_hashes(words, width, 1)
                at = np.flatnonzero(X.windows_in_one_document(doc, width))
                at = at[_among(hashes[at], known)]
                hashes, other = hashes[at], _second(words, width)[at]
                slot = np.searchsorted(known, hashes)
                while True:
                    past = np.minimum(slot + 1, len(known) - 1)
                    unlike = (second[slot] != other) & (past > slot) & (known[past] == hashes)
                    if not unlike.any():
                        break
                    slot[unlike] += 1
                same = second[slot] == other
                at, slot = at[same], slot[same]
                # documents ascend from slab to slab, so the first of a window is known here
                np.minimum.at(first, slot, block.ids[doc[at]])
                at = at[elsewhere[slot] | (first[slot] < block.ids[doc[at]])]
                edge = np.zeros(len(words) + 1, np.int32)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + width, -1)
                gone = np.cumsum(edge[:-1]) > 0
            bounds = np.searchsorted(doc, np.arange(i, j + 1))
            removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[bounds])
            n_words.append(np.diff(bounds))
            n_removed.append(removed)
            for k in range(i, j):
                if removed[k - i] == bounds[k - i + 1] - bounds[k - i]:
                    kept.append("")
                    continue
                own = block.data[block.offsets[k] : block.offsets[k + 1]].tobytes().split()
                kept.append(b" ".join(compress(own, ~gone[bounds[k - i] : bounds[k - i + 1]]) if removed[k - i] else own).decode())
        return pa.table([block.table["doc_id"], pa.array(np.concatenate(n_words)), pa.array(np.concatenate(n_removed)), pa.array(kept, pa.string())], schema=_KEPT_ARROW)

    return cover


_KEPT = "doc_id long, n_words long, n_removed long, kept_text string"
_KEPT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words, joined by one space): one row for each row of ``docs``.

    A null text has no words. Rows of one id do not remove each other's words; a null id counts as larger than any
    other. Texts shorter than ``width`` words keep all; all are read whole, however long. An empty table gives an empty
    result. Extra columns of ``docs`` are left behind, whatever their names.
    """
    ship(docs.sparkSession)
    n_blocks, n_buckets = B.block_counts(docs.count())
    dealt = B.in_blocks(docs, id_column, text_column, n_blocks)
    by_block = dealt.groupBy("block")
    first = by_block.applyInArrow(_send_anchors(n_buckets, width), B.PACKED).groupBy("bucket").applyInArrow(_answer_anchors, _REPLY)
    second = by_block.cogroup(first.groupBy("block")).applyInArrow(_send_windows(n_buckets, width), B.PACKED)
    answers = second.groupBy("bucket").applyInArrow(_answer_windows, _REPLY)
    return by_block.cogroup(answers.groupBy("block")).applyInArrow(_cover(width), _KEPT)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of remove_repeats() over all documents."""
    kept = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)),
win AS (
  SELECT doc_id, i, string_agg(word, ' ') OVER x AS seq, count(*) OVER x AS n
  FROM w WINDOW x AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
least AS (SELECT seq, min(doc_id) AS first FROM win WHERE n = 13 GROUP BY seq),
gone AS (
  SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS i
  FROM (SELECT win.doc_id, win.i FROM win JOIN least USING (seq) WHERE n = 13 AND first < doc_id)),
kept AS (
  SELECT w.doc_id, count(*) AS n_words, count(gone.i) AS n_removed, string_agg(word, ' ' ORDER BY w.i) FILTER (gone.i IS NULL) AS kept
  FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id AND w.i = gone.i GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""
