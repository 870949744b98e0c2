"""A hidden Markov language model over words, and a smoothed unigram base beside it.

*Words and classes.*  The ``FREQUENT`` most counted training words (and the end of a text) are classes of their own; any
other word belongs to one of ``HASHED`` classes by its ending. A state emits a class, a class emits a word:
P(word | state) = P(class | state) * (c + 0.1) / (N_class + 0.1 (V_class + 1)), the last term being 0.1 over the same sum
for a word never seen in training. So the states stay small while counts cover every distinct word.

*Counts* of all words come from one packed exchange (``blocks``): each block sends its distinct words, a bucket sums
and answers each block with the counts of its words. *Baum-Welch* runs over all training texts, each from its first token
to its last: their classes are written once, two bytes a token, and every pass reads those; partitions add up expected
counts, which meet as packed sums (the model's size, whatever the input). Passes end when they gain less than ``GAIN`` a
token. *Scores* are exact:
the scaled forward recursion over the whole text. Stretches of a text run side by side, each from every start state,
and their transfer matrices are multiplied in the order of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowframe.llm import blocks as B
from rowframe.llm import text as X
from rowframe.llm.durable import durable
from rowframe.ship import ship

#: States, frequent words, classes of endings, passes of Baum-Welch at most, words of a stretch, smoothing of a class's
#: count.
STATES, FREQUENT, HASHED, PASSES, STRETCH, SMOOTH = 6, 1023, 1024, 4, 64, 0.1
#: Gain of a pass in log-likelihood a token below which training ends, tokens that a pass holds at a time, about, and
#: tokens of a row there.
GAIN, PASS_TOKENS, ROW = 1e-3, 1 << 19, 512
#: Added to a word's count.
ADDED = 0.1
#: Documents of a block here: larger blocks share more of their words.
BLOCK_DOCS = 512

END = np.uint64(0x5851F42D4C957F2D)
CLASSES = 1 + FREQUENT + HASHED
_SUM_SLOTS = 16


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, ending class and document of each token; each document ends with END. Bounds: documents' token offsets."""
    part = X.LOWER_BYTES[data]
    starts, ends, doc = X.word_bounds(part, offsets, X.SPACE_BYTES)
    words = X.word_hashes(part, starts, ends)
    last = part[ends - 1].astype(np.uint64)
    before = np.where(ends - starts > 1, part[ends - 2], 0).astype(np.uint64)
    ending = 1 + FREQUENT + (X.mix(last * np.uint64(256) + before + np.uint64(1)) % np.uint64(HASHED)).astype(np.int64)
    cuts = np.searchsorted(doc, np.arange(1, len(offsets)))
    words = np.insert(words, cuts, END)
    ending = np.insert(ending, cuts, 0)
    return words, ending, np.concatenate(([0], cuts + np.arange(1, len(cuts) + 1)))


def _classes(words: np.ndarray, ending: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The class of each token; ``frequent``: sorted hashes of the frequent words."""
    out = ending.copy()
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, words), len(frequent) - 1)
        own = frequent[at] == words
        out[own] = 1 + at[own]
    out[words == END] = 0
    return out


# ---------------------------------------------------------------------------------------------- counts of all words


def _block_words(table: pa.Table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    data, offsets = X.utf8(table["text"])
    for i, j in X.slabs(offsets):
        yield i, j, *_tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def _grouped(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct entries, sorted, and the place of each entry among them: hashed, so only distinct ones are sorted."""
    coded = pa.array(words).dictionary_encode()
    own = coded.dictionary.to_numpy()
    order = np.argsort(own)
    place = np.empty(len(own), np.int32)
    place[order] = np.arange(len(own), dtype=np.int32)
    return own[order], place[coded.indices.to_numpy()]


def _distinct_words(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Sorted distinct tokens of a block, their counts in training documents, their ending classes, and by slab of
    documents each token's place among the distinct ones and the documents' bounds."""
    train = table["train"].combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
    parts, slabs = [], []
    for i, _, words, ending, bounds in _block_words(table):
        counted = np.repeat(train[i : i + len(bounds) - 1], np.diff(bounds))
        own, group = _grouped(words)
        kind = np.empty(len(own), np.int64)
        kind[group] = ending
        parts.append((own, np.bincount(group, counted, len(own)).astype(np.int64), kind))
        slabs.append((group, bounds))
    words, counts, ending = (np.concatenate(x) for x in zip(*parts, strict=True))
    own, group = _grouped(words)
    kind = np.empty(len(own), np.int64)
    kind[group] = ending
    cuts = np.concatenate(([0], np.cumsum([len(p[0]) for p in parts])))
    placed = [(group[a:b][g], bounds) for a, b, (g, bounds) in zip(cuts[:-1], cuts[1:], slabs, strict=True)]
    return own, np.bincount(group, counts, len(own)).astype(np.int64), kind, placed


def _send_words(n_buckets: int):
    def send(table: pa.Table) -> pa.Table:
        words, counts, ending, _ = _distinct_words(table)
        return B.packed(table["block"][0].as_py(), *B.bucket_cuts(words, n_buckets), words, counts.astype(np.uint32), ending.astype(np.uint16))

    return send


#: kind 0: reply to a block; kind 1: a bucket's sums by class, and its most counted words.
_COUNTED = "kind int, block int, bucket int, payload binary"


def _sum_words(rows: pa.Table) -> pa.Table:
    counts_in = rows["n"].to_pylist()
    words, counts, ending = B.unpacked(rows["payload"].to_pylist(), counts_in, np.uint64, np.uint32, np.uint16)
    own, first, group = np.unique(words, return_index=True, return_inverse=True)
    total = np.bincount(group, counts, len(own)).astype(np.int64)
    cuts = np.concatenate(([0], np.cumsum(counts_in)))
    replies = [total[group[a:b]].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    kind = ending[first].astype(np.int64)
    seen = total > 0
    per_class = np.bincount(kind[seen], total[seen], CLASSES), np.bincount(kind[seen], minlength=CLASSES)
    common = np.argsort(-total, kind="stable")[: FREQUENT + 1]
    common = common[total[common] > 0]
    stats = b"".join((np.array([len(common)], np.int64).tobytes(), per_class[0].astype(np.int64).tobytes(), per_class[1].astype(np.int64).tobytes(), own[common].tobytes(), total[common].tobytes(), kind[common].tobytes()))
    n = len(replies)
    return pa.table(
        {
            "kind": pa.array([0] * n + [1], pa.int32()),
            "block": pa.array([*rows["block"].to_pylist(), None], pa.int32()),
            "bucket": pa.array([*rows["bucket"].to_pylist(), rows["bucket"][0].as_py()], pa.int32()),
            "payload": pa.array([*replies, stats], pa.binary()),
        }
    )


def _read_stats(payload: bytes):
    n = int(np.frombuffer(payload, np.int64, 1)[0])
    at = 8
    out = []
    for size, dtype in ((CLASSES, np.int64), (CLASSES, np.int64), (n, np.uint64), (n, np.int64), (n, np.int64)):
        out.append(np.frombuffer(payload, dtype, size, at))
        at += size * 8
    return out


def _merge_stats(rows: pa.Table) -> pa.Table:
    """The sum of several buckets' statistics: class sums, and the most counted words of all."""
    parts = [_read_stats(p) for p in rows["payload"].to_pylist()]
    tokens, kinds = (sum(p[k] for p in parts) for k in (0, 1))
    words, totals, classes = (np.concatenate([p[k] for p in parts]) for k in (2, 3, 4))
    keep = np.lexsort((words, -totals))[: FREQUENT + 1]
    payload = b"".join((np.array([len(keep)], np.int64).tobytes(), tokens.tobytes(), kinds.tobytes(), words[keep].tobytes(), totals[keep].tobytes(), classes[keep].tobytes()))
    return pa.table({"slot": pa.array([0], pa.int32()), "payload": pa.array([payload], pa.binary())})


class Vocabulary:
    """Frequent words and, for each class, its tokens and distinct words in training."""

    def __init__(self, payloads: list[bytes]):
        if not payloads:
            self.frequent = np.zeros(0, np.uint64)
            self.tokens, self.kinds = np.zeros(CLASSES), np.zeros(CLASSES)
        else:
            rows = pa.table({"payload": pa.array(payloads, pa.binary())})
            tokens, kinds, words, totals, classes = _read_stats(_merge_stats(rows)["payload"][0].as_py())
            self.tokens, self.kinds = tokens.astype(float), kinds.astype(float)
            chosen = np.flatnonzero(words != END)[:FREQUENT]
            order = chosen[np.argsort(words[chosen])]
            self.frequent = words[order].copy()
            np.subtract.at(self.tokens, classes[order], totals[order])
            np.subtract.at(self.kinds, classes[order], 1)
            own = np.arange(1, 1 + len(order))
            self.tokens[own], self.kinds[own] = totals[order], 1
        self.n_tokens, self.n_kinds = int(self.tokens.sum()), int(self.kinds.sum())

    def log10_word(self, counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """log10 P(word | class); a class of one word and no other emits that word."""
        sums = self.tokens + ADDED * (self.kinds + 1)
        out = np.log10((counts + ADDED) / sums[classes])
        single = (classes >= 0) & (classes <= FREQUENT)
        out[single] = 0.0
        return out


# ------------------------------------------------------------------------------------------------------- Baum-Welch


class Model:
    """Start, transition and class probabilities of the states."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, vocabulary: Vocabulary, states: int, seed: int = 1) -> Model:
        rng = np.random.default_rng(seed)
        emit = (vocabulary.tokens + SMOOTH) * (0.5 + rng.random((states, CLASSES)))
        move = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
        return cls(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    @classmethod
    def from_counts(cls, counts: np.ndarray, states: int) -> Model:
        start = counts[:states] + SMOOTH
        move = counts[states : states + states * states].reshape(states, states) + SMOOTH
        emit = counts[states + states * states :].reshape(states, CLASSES) + SMOOTH
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def _stretches(classes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each document in rows of STRETCH (the rest of a row: CLASSES, a token every state emits surely);
    the document of each row; whether the row starts a document."""
    sizes = np.diff(bounds)
    rows = -(-sizes // STRETCH)
    doc = np.repeat(np.arange(len(sizes)), rows)
    first = np.concatenate(([0], np.cumsum(rows)))
    out = np.full((int(rows.sum()), STRETCH), CLASSES, dtype=np.int64)
    place = np.arange(len(classes)) - np.repeat(bounds[:-1], sizes) + np.repeat(first[:-1] * STRETCH, sizes)
    out.ravel()[place] = classes
    starts = np.zeros(len(doc), bool)
    starts[first[:-1][sizes > 0]] = True
    return out, doc, starts


def _across(model: Model, emit: np.ndarray, cuts: np.ndarray, rank: np.ndarray, sizes: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a document: the states' shares before it, and how well each state at its end explains the rest.

    Both are exact but for their scale: the rows' transfer matrices are multiplied in the order of the document.
    """
    k = len(model.start)
    before, after = np.ones((len(sizes), k), np.float32), np.ones((len(sizes), k), np.float32)
    tail = np.append(head[1:], True)
    rows = np.flatnonzero(~(head & tail))
    if not len(rows):
        return before, after
    rows = rows[np.argsort(rank[rows])]
    places, starts, move = rank[rows], head[rows], model.move.astype(np.float32)
    running = np.searchsorted(-sizes[rows], -np.arange(int(sizes[rows].max())), side="left")
    lanes = np.where(starts[:, None, None], np.eye(k, dtype=np.float32), move)
    for t, n in enumerate(running.tolist()):
        e = emit[cuts[t] + places[:n]]
        own = lanes[:n]
        if t:
            own = (own.reshape(n * k, k) @ move).reshape(n, k, k)
        own *= (e / e.max(axis=1, keepdims=True))[:, None, :]
        if t % 2:
            own /= own.max(axis=(1, 2), keepdims=True)
        lanes[:n] = own
    matrix = np.empty_like(lanes)
    matrix[np.argsort(np.argsort(rows))] = lanes
    at = np.full(len(sizes), -1)
    at[np.sort(rows)] = np.arange(len(rows))
    first = np.flatnonzero(head & ~tail)
    count = np.flatnonzero(tail & ~head) - first + 1
    state, rest = np.broadcast_to(model.start.astype(np.float32), (len(first), k)).copy(), np.ones((len(first), k), np.float32)
    for r in range(int(count.max())):
        here = np.flatnonzero(count > r)
        front, back = first[here] + r, first[here] + count[here] - 1 - r
        before[front], after[back] = state[here], rest[here]
        moved = np.einsum("nk,nkj->nj", state[here], matrix[at[front]])
        state[here] = moved / moved.sum(axis=1, keepdims=True)
        moved = np.einsum("nkj,nj->nk", matrix[at[back]], rest[here])
        rest[here] = moved / moved.max(axis=1, keepdims=True)
    return before, after


def expected_counts(model: Model, classes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Expected start, transition and emission counts of whole documents, by scaled forward-backward; then their
    log-likelihood and tokens.

    Documents run side by side in rows of at most ``ROW`` tokens, longest first, so those still running at a step are the
    first ones. A row of a longer document starts and ends with the messages of the rows before and after it.
    """
    k = len(model.start)
    per_doc = -(-np.diff(bounds) // ROW)
    within = np.arange(int(per_doc.sum())) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    bounds = np.append(np.repeat(bounds[:-1], per_doc) + within * ROW, len(classes))
    head, sizes = within == 0, np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    rank = np.empty(len(sizes), np.int64)
    rank[order] = np.arange(len(sizes))
    most = int(sizes.max(initial=0))
    running = np.searchsorted(-sizes[order], -np.arange(most), side="left")
    at_step = np.concatenate(([0], np.cumsum(running)))
    step = np.arange(len(classes)) - np.repeat(bounds[:-1], sizes)
    tokens = np.empty(len(classes), np.int64)
    tokens[at_step[step] + np.repeat(rank, sizes)] = classes
    emit = model.emit.T.astype(np.float32)[tokens]
    move = model.move.astype(np.float32)
    before, after_row = (x[order] for x in _across(model, emit, at_step, rank, sizes, head))
    forward, scale = np.empty((len(tokens), k), np.float32), np.empty((len(tokens), 1), np.float32)
    at = np.where(head[order][:, None], model.start.astype(np.float32), before @ move)
    cuts = at_step.tolist()
    for t in range(most):
        here = slice(cuts[t], cuts[t + 1])
        at = (at[: cuts[t + 1] - cuts[t]] @ move if t else at) * emit[here]
        scale[here] = at.sum(axis=1, keepdims=True)
        at /= scale[here]
        forward[here] = at
    ended = forward[at_step[sizes[order] - 1] + np.arange(len(sizes))]
    after_row /= (ended * after_row).sum(axis=1, keepdims=True)
    moved = np.zeros((k, k))
    ahead = np.zeros((0, k), np.float32)
    for t in range(most - 1, -1, -1):
        here = slice(cuts[t], cuts[t + 1])
        own = forward[here]
        next_ = emit[here] / scale[here]
        n = len(ahead)
        if n:
            moved += own[:n].T @ ahead
            after = ahead @ move.T
            own[:n] *= after
            next_[:n] *= after
        if n < len(own):
            own[n:] *= after_row[n : len(own)]
            next_[n:] *= after_row[n : len(own)]
        ahead = next_
    later = np.flatnonzero(~head)
    moved += ended[rank[later - 1]].T @ ahead[rank[later]]
    emitted = np.stack([np.bincount(tokens, forward[:, s], CLASSES) for s in range(k)])
    started = forward[: len(sizes)][head[order]].sum(axis=0, dtype=float)
    return np.concatenate([started, (moved * move).ravel(), emitted.ravel(), [np.log(scale, dtype=float).sum(), len(tokens)]])


def _to_classes(frequent_words):
    """A text's classes, two bytes each."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = frequent_words.value
        for batch in batches:
            data, offsets = X.utf8(batch.column(0))
            out: list[bytes] = []
            for i, j in X.slabs(offsets):
                words, ending, bounds = _tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                raw = _classes(words, ending, frequent).astype(np.uint16).tobytes()
                out += [raw[2 * a : 2 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["classes"])

    return convert


def _expect(shared):
    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, total, slot = shared.value, None, 0
        for batch in batches:
            data, offsets = X.utf8(batch.column(0).cast(pa.large_binary()))
            slot = (slot + batch.num_rows) % _SUM_SLOTS
            for i, j in X.slabs(offsets, 2 * PASS_TOKENS):
                classes = np.frombuffer(data[offsets[i] : offsets[j]].tobytes(), np.uint16)
                counts = expected_counts(model, classes, (offsets[i : j + 1] - offsets[i]) // 2)
                total = counts if total is None else total + counts
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slot", "payload"])

    return expect


def _add_counts(rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(p, np.float64) for p in rows["payload"].to_pylist())
    return pa.table({"slot": rows["slot"].slice(0, 1), "payload": pa.array([total.tobytes()], pa.binary())})


def train(texts: DataFrame, vocabulary: Vocabulary, states: int = STATES, passes: int = PASSES) -> Model:
    """Baum-Welch over all ``texts`` (one string column); _SUM_SLOTS packed sums of the model's size reach the driver."""
    context = texts.sparkSession.sparkContext
    frequent = context.broadcast(vocabulary.frequent)
    classes = durable(texts.mapInArrow(_to_classes(frequent), "classes binary"))
    model, before = Model.first(vocabulary, states), -np.inf
    for _ in range(passes):
        shared = context.broadcast(model)
        sums = classes.mapInArrow(_expect(shared), "slot int, payload binary").groupBy("slot").applyInArrow(_add_counts, "slot int, payload binary")
        parts = [np.frombuffer(r["payload"], np.float64) for r in sums.collect()]
        shared.unpersist()
        if not parts:
            break
        total = sum(parts)
        model = Model.from_counts(total[:-2], states)
        likely = total[-2] / total[-1]
        if likely - before < GAIN:
            break
        before = likely
    frequent.unpersist()
    return model


# ------------------------------------------------------------------------------------------------------------ scores


def sequence_log10(model: Model, classes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """log10 probability of each document's classes: the forward recursion over all of its tokens."""
    k = len(model.start)
    tokens, doc, starts = _stretches(classes, bounds)
    emit = np.vstack([model.emit.T, np.ones((1, k))])
    n = len(tokens)
    lanes = np.broadcast_to(np.eye(k), (n, k, k)).copy()
    scale = np.zeros(n)
    for t in range(STRETCH):
        e = emit[tokens[:, t]][:, None, :]
        if t == 0:
            moved = np.where(starts[:, None, None], lanes, np.broadcast_to(model.move, (n, k, k)))
        else:
            moved = (lanes.reshape(n * k, k) @ model.move).reshape(n, k, k)
            pad = tokens[:, t] == CLASSES
            if pad.any():
                moved[pad] = lanes[pad]
        lanes = moved * e
        if t % 4 == 3 or t == STRETCH - 1:
            size = lanes.max(axis=(1, 2))
            scale += np.log10(size)
            lanes /= size[:, None, None]
    out = np.zeros(len(bounds) - 1)
    state = np.broadcast_to(model.start, (len(out), k)).copy()
    first = np.searchsorted(doc, np.arange(len(out)))
    count = np.bincount(doc, minlength=len(out))
    for r in range(int(count.max(initial=0))):
        own = np.flatnonzero(count > r)
        row = first[own] + r
        at = np.einsum("nk,nkj->nj", state[own], lanes[row])
        size = at.sum(1)
        out[own] += np.log10(size) + scale[row]
        state[own] = at / size[:, None]
    return out


_SCORED = "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_SCORED_ARROW = pa.schema([("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _score(shared):
    def score(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _SCORED_ARROW.empty_table()
        vocabulary, model = shared.value
        own, _, ending, slabs = _distinct_words(table)
        answers = sorted(zip(replies["bucket"].to_pylist(), replies["payload"].to_pylist(), strict=True))
        counts = np.concatenate([np.frombuffer(p, np.int64) for _, p in answers])
        n, v = vocabulary.n_tokens, vocabulary.n_kinds
        kinds = _classes(own, ending, vocabulary.frequent)
        plain, within, known = np.log10((counts + ADDED) / (n + ADDED * (v + 1))), vocabulary.log10_word(counts, kinds), (counts > 0).astype(np.int64)
        columns = [[], [], [], []]
        for words, bounds in slabs:
            sums = [np.add.reduceat(x[words], bounds[:-1]) for x in (known, plain, within)]
            for column, values in zip(columns, (np.diff(bounds), sums[0], sums[1], sums[2] + sequence_log10(model, kinds[words], bounds)), strict=True):
                column.append(values)
        tokens, seen, base, total = (np.concatenate(c) for c in columns)
        return pa.table([table["doc_id"], table["train"], pa.array(tokens), pa.array(seen), pa.array(np.full(len(tokens), n)), pa.array(base), pa.array(total)], schema=_SCORED_ARROW)

    return score


def score_texts(docs: DataFrame, is_train: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score (log10): one row for each row of ``docs``.

    The model and the counts come from the rows that ``is_train`` selects (null: not selected). A null text is empty and
    has only the end token; texts are read whole, however long. Rows that repeat are counted and scored each by itself.
    Without any training row, every word is unknown and the model stays as it starts; an empty table gives an empty
    result. Other columns are left behind, whatever their names.
    """
    spark = docs.sparkSession
    ship(spark)
    n_blocks, n_buckets = B.block_counts(docs.count(), BLOCK_DOCS)
    trains = F.coalesce(is_train, F.lit(False))
    key = F.pmod(F.xxhash64(F.col(id_column), F.col(text_column)), F.lit(n_blocks)).cast("int")
    dealt = docs.select(key.alias("block"), F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"), trains.alias("train"))
    counted = durable(dealt.groupBy("block").applyInArrow(_send_words(n_buckets), B.PACKED).groupBy("bucket").applyInArrow(_sum_words, _COUNTED))
    merged = counted.where("kind = 1").select(F.pmod("bucket", F.lit(_SUM_SLOTS)).cast("int").alias("slot"), "payload").groupBy("slot").applyInArrow(_merge_stats, "slot int, payload binary")
    vocabulary = Vocabulary([r["payload"] for r in merged.collect()])
    model = train(docs.where(trains).select(F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text")), vocabulary)
    shared = spark.sparkContext.broadcast((vocabulary, model))
    replies = counted.where("kind = 0").select("block", "bucket", "payload")
    return dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_score(shared), _SCORED)


def op10_hmm_scoring(spark, sf_dir: str) -> DataFrame:
    """All documents scored; those whose crc32(doc_id as text) mod 10 is 0 are held out of training."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    scored = score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), ~held_out)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
