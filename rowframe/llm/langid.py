"""Language identification by a bidirectional gated recurrent network over bytes.

Two GRUs read a text's bytes from the left and from the right; at every byte a softmax over their states labels the
language, and a document's probabilities are the mean over its bytes. Training is backpropagation through time in
numpy (Adam) on a bounded, stratified sample of labelled rows. Prediction reads whole texts, in stretches of
``STRETCH`` bytes side by side; the states start anew in each. A network may also learn what is no language: a label of
its own for generated noise (random letters, codes, numbers, signs, scripts that no sample has).
"""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowframe.llm import text as X
from rowframe.llm.rows import add_columns

#: States of each direction, bytes of a stretch, stretches side by side.
HIDDEN, STRETCH, LANES = 8, 128, 2048
#: Labelled rows of a language that training sees, characters of each (from a hashed place), and its course.
SAMPLE_ROWS, SAMPLE_CHARS, STEPS, BATCH, TRAIN_BYTES, RATE = 400, 400, 160, 96, 48, 0.02
#: What is said of texts without a letter, or of noise.
UNKNOWN = "und"
#: Generated texts of noise, and the share of a text's bytes from which it counts as noise.
NOISE_TEXTS, NOISE_SHARE = 400, 0.8
#: Code points of letters of several scripts: first and number.
_SCRIPTS = ((0x0391, 57), (0x0410, 64), (0x05D0, 27), (0x0627, 36), (0x0905, 53), (0x0E01, 46), (0x3041, 83), (0x4E00, 6000), (0xAC00, 6000))


class Gru:
    """Parameters of one direction. Gate blocks: update, reset, candidate."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.table = rng.normal(0, 0.3, (256, 3 * hidden))
        self.across = rng.normal(0, 0.5 / np.sqrt(hidden), (hidden, 3 * hidden))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def run_forward(gru: Gru, codes: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """States after each byte (time, lane, hidden), and what the way back needs."""
    k = gru.across.shape[0]
    h = np.zeros((codes.shape[1], k))
    states, trace = [], []
    for x in gru.table[codes]:
        g = h @ gru.across
        update, reset = _sigmoid(x[:, :k] + g[:, :k]), _sigmoid(x[:, k : 2 * k] + g[:, k : 2 * k])
        inner = g[:, 2 * k :]
        new = np.tanh(x[:, 2 * k :] + reset * inner)
        trace.append((h, update, reset, inner, new))
        h = new + update * (h - new)
        states.append(h)
    return np.stack(states), trace


def run_back(gru: Gru, codes: np.ndarray, trace: list[tuple], grad_states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the table and of the recurrent weights, through time."""
    grad_across, inputs = np.zeros_like(gru.across), []
    carry = np.zeros_like(grad_states[0])
    for (h, update, reset, inner, new), grad in zip(reversed(trace), grad_states[::-1], strict=True):
        total = carry + grad
        d_new = total * (1 - update) * (1 - new * new)
        d_update = total * (h - new) * update * (1 - update)
        d_reset = d_new * inner * reset * (1 - reset)
        inputs.append(np.hstack((d_update, d_reset, d_new)))
        at_state = np.hstack((d_update, d_reset, d_new * reset))
        grad_across += h.T @ at_state
        carry = total * update + at_state @ gru.across.T
    read, at_input = codes[::-1].ravel(), np.concatenate(inputs)
    grad_table = np.stack([np.bincount(read, column, 256) for column in at_input.T], axis=1)
    return grad_table, grad_across


def noise_texts(samples: list[str], n: int = NOISE_TEXTS, seed: int = 17) -> list[str]:
    """Texts without a language; letters are of scripts that the samples have none of, or in no order."""
    rng = random.Random(seed)
    held = {c for s in samples for c in s}
    free = [[chr(a + k) for k in range(size)] for a, size in _SCRIPTS]
    free = [letters for letters in free if not held.intersection(letters)]
    latin = "abcdefghijklmnopqrstuvwxyz"
    word = lambda letters, lo, hi: "".join(rng.choice(letters) for _ in range(rng.randint(lo, hi)))
    kinds = [
        lambda: " ".join(word(latin, 1, 12) for _ in range(40)),
        lambda: word(latin, 200, 300),
        lambda: " ".join(word("0123456789abcdef", 8, 64) for _ in range(12)),
        lambda: word(latin + latin.upper() + "0123456789+/", 200, 300),
        lambda: " ".join(word("0123456789.,:-/", 1, 12) for _ in range(40)),
        lambda: " ".join(word("%&$#*!?=~^|@_<>(){}[];:", 1, 6) for _ in range(60)),
        lambda: " ".join(rng.choice("abcxyz") + " " + word("0123456789%&$#", 2, 8) for _ in range(40)),
    ]
    kinds += [lambda letters=letters: " ".join(word(letters, 1, 9) for _ in range(20)) for letters in free]
    return [kinds[k % len(kinds)]() for k in range(n)]


class Network:
    """The trained network; ``languages`` in sorted order, and with ``noise`` one label more at the end."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 5, noise: bool = False):
        rng = np.random.default_rng(seed)
        self.noise, languages = noise, [*languages, UNKNOWN] if noise else languages
        self.languages = languages
        self.left, self.right = Gru(rng, hidden), Gru(rng, hidden)
        self.out = rng.normal(0, 0.3, (2 * hidden, len(languages)))
        self.bias = np.zeros(len(languages))

    def parameters(self) -> list[np.ndarray]:
        return [self.left.table, self.left.across, self.right.table, self.right.across, self.out, self.bias]

    def gradients(self, codes: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over all bytes of codes (time, lane) and its gradients."""
        a, trace_a = run_forward(self.left, codes)
        b, trace_b = run_forward(self.right, codes[::-1])
        both = np.concatenate((a, b[::-1]), axis=2)
        logits = both @ self.out + self.bias
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        lanes = np.arange(codes.shape[1])
        loss = -np.log(p[:, lanes, labels] + 1e-12).mean()
        p[:, lanes, labels] -= 1
        p /= codes.size
        flat, d = both.reshape(-1, both.shape[2]), p.reshape(-1, p.shape[2])
        back = p @ self.out.T
        k = a.shape[2]
        grads_a = run_back(self.left, codes, trace_a, back[:, :, :k])
        grads_b = run_back(self.right, codes[::-1], trace_b, back[::-1, :, k:])
        return loss, [*grads_a, *grads_b, flat.T @ d, d.sum(axis=0)]

    def fit(self, samples: list[np.ndarray], labels: np.ndarray, steps: int = STEPS, seed: int = 11) -> Network:
        """Adam over random stretches of the samples (byte arrays), languages drawn evenly."""
        rng = np.random.default_rng(seed)
        by_language = [np.flatnonzero(labels == k) for k in range(len(self.languages))]
        params = self.parameters()
        mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, steps + 1):
            label = rng.integers(0, len(by_language), BATCH)
            codes = np.zeros((TRAIN_BYTES, BATCH), np.uint8)
            for lane, k in enumerate(label.tolist()):
                own = samples[by_language[k][rng.integers(len(by_language[k]))]]
                at = rng.integers(0, max(1, len(own) - TRAIN_BYTES + 1))
                part = own[at : at + TRAIN_BYTES]
                codes[:, lane] = np.resize(part, TRAIN_BYTES)
            _, grads = self.gradients(codes, label)
            rate = RATE * (1 - 0.9 * step / steps)
            for p, g, m, s in zip(params, grads, mean, square, strict=True):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
        return self

    def reader(self) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """byte buffer, offsets -> mean probabilities of each document (zeros for one without bytes)."""
        k = self.left.across.shape[0]
        halves = np.concatenate((np.full(2 * k, 0.5), np.ones(k)))
        sides = [((g.table * halves).astype(np.float32), (g.across * halves).astype(np.float32)) for g in (self.left, self.right)]
        outs = self.out[:k].astype(np.float32), self.out[k:].astype(np.float32)
        bias = self.bias.astype(np.float32)

        def side(table, across, out, codes, active, steps, logits):
            h = np.zeros((codes.shape[1], k), np.float32)
            for t in steps:
                n = active[t]
                own = h[:n]
                x = table[codes[t, :n]]
                g = own @ across
                gates = np.tanh(x[:, : 2 * k] + g[:, : 2 * k])
                gates *= np.float32(0.5)
                gates += np.float32(0.5)
                new = g[:, 2 * k :] * gates[:, k:]
                new += x[:, 2 * k :]
                np.tanh(new, out=new)
                own -= new
                own *= gates[:, :k]
                own += new
                logits[t, :n] += own @ out

        def read(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
            sizes = np.diff(offsets)
            pieces = -(-sizes // STRETCH)
            doc = np.repeat(np.arange(len(sizes)), pieces)
            within = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = offsets[:-1][doc] + within * STRETCH
            length = np.minimum(STRETCH, offsets[1:][doc] - start)
            order = np.argsort(-length, kind="stable")
            total = np.zeros((len(sizes), len(self.languages)))
            for lo in range(0, len(order), LANES):
                own = order[lo : lo + LANES]
                size = length[own]
                steps = np.arange(int(size.max()))
                codes = data[np.minimum(start[own][None] + steps[:, None], len(data) - 1)]
                active = (size[None] > steps[:, None]).sum(axis=1)
                logits = np.broadcast_to(bias, (len(steps), len(own), len(bias))).copy()
                side(*sides[0], outs[0], codes, active, steps.tolist(), logits)
                side(*sides[1], outs[1], codes, active, steps[::-1].tolist(), logits)
                logits -= logits.max(axis=2, keepdims=True)
                np.exp(logits, out=logits)
                logits /= logits.sum(axis=2, keepdims=True)
                logits *= (size[None] > steps[:, None])[:, :, None]
                np.add.at(total, doc[own], logits.sum(axis=0, dtype=np.float64))
            return total / np.maximum(sizes, 1)[:, None]

        return read


def fit(docs: DataFrame, is_train: Column, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", noise: bool = False) -> Network | None:
    """A network learned from at most SAMPLE_ROWS rows of each language, chosen by a hash of the id; None without any.

    A language's rows are thinned to about twice the sample by their hash before they are ranked, so what is shuffled
    does not grow with the corpus. With ``noise`` it also learns generated texts of no language.
    """
    text = F.col(text_column).cast("string")
    labelled = docs.where(is_train & F.col(lang_column).isNotNull() & (F.length(text) > 0)).select(F.col(lang_column).cast("string").alias("lang"), F.xxhash64(F.col(id_column), F.lit(7)).alias("h"), F.col(id_column).alias("id"), text.alias("text"))
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, 2 * SAMPLE_ROWS / n))])
    drawn = labelled.where(F.pmod("h", F.lit(1 << 40)) < F.element_at(share, F.col("lang")) * float(1 << 40))
    chosen = drawn.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))).where(F.col("n") <= SAMPLE_ROWS)
    place = F.pmod(F.col("h"), F.greatest(F.length("text") - SAMPLE_CHARS + 1, F.lit(1))).cast("int") + 1
    rows = sorted((r["lang"], r["h"], r["part"]) for r in chosen.select("lang", "h", F.substring(F.col("text"), place, F.lit(SAMPLE_CHARS)).alias("part")).collect())
    languages = sorted({r[0] for r in rows})
    labels, parts = [languages.index(r[0]) for r in rows], [r[2] for r in rows]
    if noise:
        added = noise_texts(parts)
        labels, parts = [*labels, *[len(languages)] * len(added)], [*parts, *added]
    return Network(languages, noise=noise).fit([np.frombuffer(p.encode(), np.uint8) for p in parts], np.array(labels))


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


class _Reading:
    """Predicts for Arrow batches; the network's reader is made once where it runs."""

    def __init__(self, shared):
        self.shared, self.read = shared, None

    def __getstate__(self):
        return {"shared": self.shared, "read": None}

    def __call__(self, table: pa.Table) -> list[pa.Array]:
        network = self.shared.value
        if network is None:
            return [pa.array([UNKNOWN] * table.num_rows, pa.string()), pa.array(np.zeros(table.num_rows))]
        self.read = self.read or network.reader()
        data, offsets = X.utf8(table.column(0))
        parts, letters = [np.zeros((0, len(network.languages)))], [np.zeros(0, bool)]
        for i, j in X.slabs(offsets):
            part, bounds = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            parts.append(self.read(part, bounds))
            letters.append(np.diff(np.concatenate(([0], np.cumsum(_ASCII_LETTER[part], dtype=np.int32)))[bounds]) > 0)
        p, plainly = np.concatenate(parts), np.concatenate(letters)
        noisy = np.zeros(len(p), bool)
        if network.noise:
            noisy, p = p[:, -1] > NOISE_SHARE, p[:, :-1]
        found, score = [], p.max(axis=1, initial=0)
        for k, best in enumerate(p.argmax(axis=1).tolist() if len(p) else []):
            plain = not noisy[k] and (plainly[k] or any(c.isalpha() for c in data[offsets[k] : offsets[k + 1]].tobytes().decode()))
            found.append(network.languages[best] if plain else UNKNOWN)
            if not plain:
                score[k] = 0.0
        return [pa.array(found, pa.string()), pa.array(np.clip(score, 0.0, 1.0))]


def identify(docs: DataFrame, network: Network | None, text_column: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) plus lang_pred and score (0 to 1): ``und``, 0 where the text is null or has no letter.

    So is a text that a network with a label for noise holds for noise. Only the text is read, and all of it, however
    long. Clashing columns of ``docs`` give way. Without a network every row is ``und``. Rows that repeat are read each
    by itself; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)
    return add_columns(docs, "lang_pred string, score double", _Reading(shared), [text_column], keep)


def remainder(c: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(c.cast("string").cast("binary")) % n


def identify_documents(docs: DataFrame, keep: Sequence[str] | None = None, noise: bool = False) -> DataFrame:
    """identify() with a network learned from the documents themselves, those of remainder 0 (mod 5) left out."""
    return identify(docs, fit(docs, F.coalesce(remainder(F.col("doc_id"), 5) != 0, F.lit(False)), noise=noise), keep=keep)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    """All documents; lang, source and doc_id are no inputs of a prediction."""
    found = identify_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"), keep=["doc_id"])
    return found.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
