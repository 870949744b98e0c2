"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

*Codes.*  A rotation is learned on a bounded sample (iterative quantisation: rotate, take signs, solve the orthogonal
Procrustes problem, repeat); several independently started rotations are stacked until a code has ``BITS`` bits.
*Index.*  Every row is coded. A code is split into ``parts`` substrings of 16 bits, each with its own directory from
substring value to rows. *Search.*  Let r = parts * q + a with a < parts. By the pigeonhole principle a code within Hamming
radius r of the query's has one of its first a + 1 substrings within q of the query's, or one of the others within q - 1:
those entries are probed, all codes within r kept, and the kept rows ranked by exact distance on the original vectors. The
values within the reach of a substring are enumerated and looked up; where they are more than the values that occur, those
are compared instead. r is set on the sample so that the sample's true neighbours fall inside it, and wider for a query
whose own neighbours in the sample lie farther off, as far from all clusters; of several code lengths the one is taken
that admits the fewest rows of the sample. Queries that have fewer than k rows within r are searched again with all bits,
where every row is within it.

*Distribution.*  Queries are taken in blocks of ``QUERY_BYTES`` and broadcast (a proven size); index rows stream through
their own partitions in bounded chunks, each with its own directories, so no row of the index is shuffled; each task
returns its best k of every query, and a ranked window takes the best k of all. Every block is a scan of the index and
leaves a table of k rows a query. Equal vectors are kept apart only by their ids, so a vector that a third of all rows
share costs no more than others.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowframe.llm.durable import durable
from rowframe.ship import ship

#: Bits of a code that are tried, bits of a substring, rows of the fitting sample, bytes of a broadcast's queries, rows of
#: a chunk.
BITS, SUBSTRING, SAMPLE, QUERY_BYTES, CHUNK = (64, 128), 16, 4096, 1 << 24, 1 << 15
#: Share of the sample's true neighbours that the radius has to take in.
SAMPLE_RECALL = 0.99
RANKED = "query_id long, rank int, vec_id long, score double"


def _rotation(x: np.ndarray, seed: int, rounds: int = 15) -> np.ndarray:
    """An orthogonal matrix under which the signs of x stand closest to x."""
    rng = np.random.default_rng(seed)
    turn, _ = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))
    for _ in range(rounds):
        code = np.where(x @ turn >= 0, 1.0, -1.0)
        u, _, v = np.linalg.svd(x.T @ code)
        turn = u @ v
    return turn


class Codes:
    """Learned codes for vectors of one length."""

    def __init__(self, sample: np.ndarray, k: int, bits: int, recall: float = SAMPLE_RECALL):
        dim = sample.shape[1]
        self.middle = sample.mean(axis=0)
        scale = np.abs(sample).max() or 1.0
        x = (sample - self.middle) / scale
        self.turns = np.hstack([_rotation(x, seed) for seed in range(-(-bits // dim))])[:, :bits] if len(sample) > 1 else np.eye(dim, bits)
        self.parts = -(-self.turns.shape[1] // SUBSTRING)
        self.radius = self._fit_radius(sample, k, recall)

    @classmethod
    def fitted(cls, sample: np.ndarray, k: int) -> Codes:
        """The codes of the length that admits the fewest rows of the sample by probing."""
        return min((cls(sample, k, bits) for bits in BITS), key=lambda codes: sum(codes.shares(sample)))

    def code(self, x: np.ndarray) -> np.ndarray:
        """A row of 16-bit substrings for each vector."""
        bits = np.packbits((x - self.middle) @ self.turns >= 0, axis=1)
        if bits.shape[1] % 2:
            bits = np.hstack([bits, np.zeros((len(bits), 1), np.uint8)])
        return np.ascontiguousarray(bits).view(np.uint16)

    def reach(self, radius: int) -> list[int]:
        """For each substring, how far from the query's it is probed (-1: not at all)."""
        q, a = divmod(int(radius), self.parts)
        return [q if part <= a else q - 1 for part in range(self.parts)]

    def radii(self, x: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
        """The radius for each vector: the fitted one, or wider if a neighbour of its own in the sample is not inside."""
        out, codes = np.full(len(x), self.radius), self.code(sample)
        for lo in range(0, len(x), 256):
            part = x[lo : lo + 256]
            near = np.argsort(_distances(part, sample), axis=1)[:, : k + 1]
            own = np.bitwise_count(self.code(part)[:, None, :] ^ codes[near]).sum(axis=2).max(axis=1)
            out[lo : lo + 256] = np.maximum(out[lo : lo + 256], own)
        return out

    def shares(self, x: np.ndarray, queries: int = 64) -> tuple[float, float]:
        """Shares of the rows x that probing admits and that are ranked by distance, on average over the first rows as queries."""
        directories = Directories(self.code(x))
        asked = directories.codes[:queries]
        found = [directories.probe(code, self.reach(self.radius)) for code in asked]
        kept = [int((np.bitwise_count(directories.codes[at] ^ code).sum(axis=1) <= self.radius).sum()) for at, code in zip(found, asked, strict=True)]
        total = max(1, len(x) * len(asked))
        return sum(map(len, found)) / total, sum(kept) / total

    def _fit_radius(self, sample: np.ndarray, k: int, recall: float) -> int:
        probes = sample[: min(256, len(sample))]
        far = _distances(probes, sample)
        near = np.argsort(far, axis=1)[:, 1 : k + 1]
        codes = self.code(sample)
        hamming = np.bitwise_count(codes[: len(probes), None, :] ^ codes[near]).sum(axis=2)
        return int(np.quantile(hamming, recall)) if hamming.size else self.turns.shape[1]


_balls: dict[int, np.ndarray] = {}


def _ball(reach: int) -> np.ndarray:
    """All 16-bit values with at most ``reach`` bits."""
    if reach not in _balls:
        every = np.arange(1 << SUBSTRING, dtype=np.uint16)
        _balls[reach] = every[np.bitwise_count(every) <= reach]
    return _balls[reach]


class Directories:
    """For each substring of some codes: the values that occur, and the rows of each."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.parts = codes, []
        for part in range(codes.shape[1]):
            order = np.argsort(codes[:, part], kind="stable")
            values, first = np.unique(codes[order, part], return_index=True)
            self.parts.append((values, np.append(first, len(codes)), order))

    def probe(self, code: np.ndarray, reach: list[int]) -> np.ndarray:
        """The rows with a substring within its reach of the query's, each once."""
        near = np.zeros(len(self.codes), bool)
        for (values, bounds, order), own, far in zip(self.parts, code, reach, strict=True):
            if far < 0 or not len(values):
                continue
            ball = _ball(far)
            if len(ball) < len(values):
                asked = ball ^ own
                at = np.minimum(np.searchsorted(values, asked), len(values) - 1)
                at = at[values[at] == asked]
            else:
                at = np.flatnonzero(np.bitwise_count(values ^ own) <= far)
            for a in at.tolist() if len(at) < 64 else ():
                near[order[bounds[a] : bounds[a + 1]]] = True
            if len(at) >= 64:
                held = np.zeros(len(values), bool)
                held[at] = True
                near[order[np.repeat(held, np.diff(bounds))]] = True
        return np.flatnonzero(near)


def _distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * q @ x.T, 0))


def _matrix(column: pa.Array) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """By vector length: positions and the matrix of the usable vectors (no null, zero or non-finite component)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    out = {}
    for n in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == n)
        x = values[starts[at][:, None] + np.arange(n)]
        good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        if good.any():
            out[n] = (at[good], x[good])
    return out


class _Best:
    """The k nearest so far of each query: smallest distance, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.found = k, [(np.zeros(0), np.zeros(0, np.int64))] * n

    def add(self, q: int, distance: np.ndarray, ids: np.ndarray) -> None:
        d = np.concatenate((self.found[q][0], distance))
        i = np.concatenate((self.found[q][1], ids))
        order = np.lexsort((i, d))[: self.k]
        self.found[q] = (d[order], i[order])


def _search_chunk(codes: Codes, q_ids, q_vecs, q_codes, radii, ids, x, best: _Best, offset: int) -> None:
    """Probe this chunk's directories for each query, keep codes within the radius, rank by exact distance."""
    directories = Directories(codes.code(x))
    for q in range(len(q_ids)):
        at = directories.probe(q_codes[q], codes.reach(radii[q]))
        at = at[np.bitwise_count(directories.codes[at] ^ q_codes[q]).sum(axis=1) <= radii[q]]
        at = at[ids[at] != q_ids[q]]
        if len(at):
            best.add(offset + q, np.sqrt(((x[at] - q_vecs[q]) ** 2).sum(axis=1)), ids[at])


def _searcher(shared, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, queries = shared.value
        groups, at = {}, 0
        for n, (q_ids, q_vecs, radii) in queries.items():
            groups[n] = (at, q_ids, q_vecs, models[n].code(q_vecs), radii)
            at += len(q_ids)
        best = _Best(at, k)
        for batch in batches:
            for lo in range(0, batch.num_rows, CHUNK):
                part = batch.slice(lo, CHUNK)
                all_ids = part.column(0).to_numpy(zero_copy_only=False)
                for n, (rows, x) in _matrix(part.column(1)).items():
                    if n in groups:
                        offset, q_ids, q_vecs, q_codes, radii = groups[n]
                        _search_chunk(models[n], q_ids, q_vecs, q_codes, radii, all_ids[rows], x, best, offset)
        names = np.concatenate([g[1] for g in groups.values()]) if groups else np.zeros(0, np.int64)
        for q, (d, i) in zip(names.tolist(), best.found, strict=True):
            if len(d):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), q, np.int64)), pa.array(i.astype(np.int64)), pa.array(d)], names=["query_id", "vec_id", "score"])

    return search


def nearest(vectors: DataFrame, is_query, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows found nearest to each row that ``is_query`` selects.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows with a null id; vectors
    of different lengths are not compared. A query's own id is not a candidate; other rows with an equal vector are.
    Where no query or no candidate is left, the result has no rows for it; an empty table gives an empty result. Rows that
    repeat with one id are a candidate each. Other columns are left behind.
    """
    spark = vectors.sparkSession
    ship(spark)
    base = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL)")
    rows = base.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).toArrow()
    sample = {n: x for n, (_, x) in _matrix(rows["embedding"]).items()}
    queries = base.where(is_query)
    size = queries.agg(F.sum(F.size("embedding") * 8 + 16)).first()[0] or 0
    models = {n: Codes.fitted(x, k) for n, x in sample.items()}
    n_blocks, results = max(1, -(-size // QUERY_BYTES)), []
    for block in range(n_blocks):
        own = queries if n_blocks == 1 else queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == block)
        table = own.toArrow()
        ids = table["vec_id"].to_numpy()
        asked = {n: (ids[at], x) for n, (at, x) in _matrix(table["embedding"]).items()}
        # lengths that the sample happens to hold none of are fitted on the queries
        models.update({n: Codes.fitted(x[:SAMPLE], k) for n, (_, x) in asked.items() if n not in models})
        asked = {n: (own_ids, x, models[n].radii(x, sample.get(n, x[:SAMPLE]), k)) for n, (own_ids, x) in asked.items()}
        results += _ranked(base, models, asked, k)
    return reduce(DataFrame.unionAll, results) if results else spark.createDataFrame([], RANKED)


def _ranked(base: DataFrame, models: dict[int, Codes], asked: dict, k: int) -> list[DataFrame]:
    """The ranked rows of a block's queries; those that have fewer than k are searched with all bits instead."""
    spark, out = base.sparkSession, []
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    while asked:
        shared = spark.sparkContext.broadcast(({n: models[n] for n in asked}, asked))
        found = base.mapInArrow(_searcher(shared, k), "query_id long, vec_id long, score double")
        found = durable(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
        shared.unpersist()
        full = found.where(F.col("rank") == k).select("query_id").toArrow()["query_id"].to_numpy()
        short = {}
        for n, (ids, x, radii) in asked.items():
            bits = models[n].turns.shape[1]
            left = ~np.isin(ids, full) & (radii < bits)
            if left.any():
                short[n] = (ids[left], x[left], np.full(left.sum(), bits))
        asked = short
        if asked:
            again = spark.createDataFrame(pa.table({"query_id": np.concatenate([ids for ids, _, _ in asked.values()])}))
            found = found.join(F.broadcast(again), "query_id", "left_anti").select(found.columns)
        out.append(found)
    return out


def op1_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    """Queries: rows whose vec_id is divisible by 100; against every row."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
