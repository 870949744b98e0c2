"""Best-fit-decreasing packing of token sequences.

Documents become token ids plus an end id; longer ones are cut into pieces of ``SIZE`` tokens. Pieces are dealt to shards
of bounded size by a hash, and each shard packs its pieces longest first, each into the open sequence with the least
room that still holds it. Room is at most SIZE, so the open sequences are kept by room and a segment tree over the
SIZE + 1 rooms finds the tightest in logarithmic time. A shard can waste room only in its last few sequences.
"""

from __future__ import annotations

import base64
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowframe.llm.rows import add_columns

#: Tokens of a sequence, the id that ends a document, documents whose pieces one shard packs.
SIZE, END_ID, SHARD_DOCS = 1024, 2, 16384


class Encoder:
    """Ids of texts, as little-endian uint32 bytes.

    ``vocabulary`` names a file for the tokenizers library, whose ids are meant. ``ranks`` names the same vocabulary for
    tiktoken, which gives the same ids several times faster; only a text that holds a special token's string, which
    tokenizers reads as that token, is left to tokenizers.
    """

    def __init__(self, vocabulary: str, ranks: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(public_tokenizers.path(ranks), "rb") as lines:
            pairs = dict(line.split() for line in lines)
        self.by_rank = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(k): int(v) for k, v in pairs.items()}, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            ids = self.whole.encode(text, add_special_tokens=False).ids
        else:
            ids = self.by_rank.encode_ordinary(text)
        return array("I", ids).tobytes()


_encoders: dict[tuple[str, str], Encoder] = {}


def _cut(vocabulary: str, ranks: str, size: int, end_id: int, keep_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def cut(table: pa.Table) -> list[pa.Array]:
        key = (vocabulary, ranks)
        if key not in _encoders:
            _encoders[key] = Encoder(*key)
        encode = _encoders[key]
        counts, piece, start, length, crc, ids = [0], [], [], [], [], []
        seen: dict[str | None, bytes] = {}
        for text in table["text"].to_pylist():
            raw = seen.get(text)
            if raw is None:
                raw = seen[text] = encode(text or "") + end
            n = len(raw) // 4
            at, k = 0, 0
            step = n % size or size
            while at < n:
                part = raw[at * 4 : (at + step) * 4]
                piece.append(k)
                start.append(at)
                length.append(step)
                crc.append(zlib.crc32(part))
                if keep_ids:
                    ids.append(np.frombuffer(part, "<i4"))
                at, k, step = at + step, k + 1, size
            counts.append(len(piece))
        columns = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
        names = ["piece", "start", "length", "ids_crc32"]
        if keep_ids:
            columns.append(pa.array(ids, pa.list_(pa.int32())))
            names.append("ids")
        return [pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.StructArray.from_arrays(columns, names))]

    return cut


def token_pieces(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SIZE, end_id: int = END_ID, vocabulary: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken", keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): a row for each piece; a null text is empty and so one end id."""
    own = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    kind = "array<struct<piece: int, start: long, length: long, ids_crc32: long" + (", ids: array<int>>>" if keep_ids else ">>")
    cut = add_columns(own, f"pieces {kind}", _cut(vocabulary, ranks, size, end_id, keep_ids), ["text"], ["doc_id"])
    return cut.select("doc_id", F.inline("pieces"))


class OpenSequences:
    """Sequences by the room left in them, with a segment tree that finds the least room of at least so much."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.filled = [0] * (2 * self.leaves)
        self.by_room: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, sequence: int, room: int) -> None:
        self.by_room[room].append(sequence)
        if len(self.by_room[room]) == 1:
            node = self.leaves + room
            while node:
                self.filled[node] += 1
                node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """A sequence with the least room >= least and that room, taken out; None if there is none."""
        node = self.leaves + least
        if not self.filled[node]:
            while node > 1 and (node & 1 or not self.filled[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.filled[2 * node] else 2 * node + 1
        room = node - self.leaves
        sequence = self.by_room[room].pop()
        if not self.by_room[room]:
            while node:
                self.filled[node] -= 1
                node >>= 1
        return sequence, room


def best_fit(lengths: list[int], size: int) -> tuple[list[int], list[int]]:
    """Sequence and offset of each piece, longest first."""
    sequence, offset = [0] * len(lengths), [0] * len(lengths)
    open_, n = OpenSequences(size), 0
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        found = open_.take(lengths[k])
        if found is None:
            found = (n, size)
            n += 1
        sequence[k], offset[k] = found[0], size - found[1]
        if found[1] > lengths[k]:
            open_.put(found[0], found[1] - lengths[k])
    return sequence, offset


def _pack_shard(size: int):
    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        sequence, offset = best_fit(table["length"].to_pylist(), size)
        base = table["shard"][0].as_py() << 32
        return table.drop_columns(["shard"]).append_column("sequence_id", pa.array([base + s for s in sequence], pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    return pack


def pack(docs: DataFrame, size: int = SIZE, **options) -> DataFrame:
    """token_pieces() of ``docs`` with sequence_id and offset: gapless sequences of at most ``size`` tokens.

    Rows that repeat are packed as often as they stand there, and rows without an id are dealt by their partitions, so
    that many equal ones do not meet in one shard. Texts are read whole, however long; an empty table gives an empty
    result; other columns are left behind.
    """
    shards = max(1, docs.count() // SHARD_DOCS)
    pieces = token_pieces(docs, size=size, **options)
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.when(F.col("doc_id").isNull(), F.spark_partition_id())), F.lit(shards)).cast("int"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.groupBy("shard").applyInArrow(_pack_shard(size), f"{schema}, sequence_id long, offset long")


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of 1024 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
