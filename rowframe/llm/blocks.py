"""Exchanges of packed keys between blocks of documents and buckets of keys.

Corpus-wide facts about short keys (word counts, which windows occur elsewhere) need every key of every document to meet
its equals.  One Spark row a key would be a shuffle of many times the corpus.  Here a *block* is a bounded set of whole
documents chosen by a hash of their ids; each block sends, to every *bucket* of the key space, one row holding its
distinct keys as packed integers.  A key that a third of all documents hold so contributes at most one entry a block
(it is pre-aggregated before the shuffle), and a bucket answers each block with one row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents of a block, at least; a block's texts are held in one task, so it is bounded above as well.
BLOCK_DOCS, BLOCK_DOCS_MOST = 256, 16384
#: Documents whose keys one bucket serves, about, and buckets at most: beyond, buckets grow, so that a row stays packed.
BUCKET_DOCS, BUCKETS_MOST = 1024, 1 << 16


def block_counts(n_docs: int, block_docs: int = BLOCK_DOCS) -> tuple[int, int]:
    """How many blocks and buckets serve so many documents.

    A block has one row for each bucket. With all of 1e10 documents, a block of 16,384 of them shares out its keys (a
    hundred or more a document) to 65,536 rows, some dozens a row.
    """
    per_block = int(min(BLOCK_DOCS_MOST, max(block_docs, n_docs // (1 << 20))))
    return max(1, -(-n_docs // per_block)), min(BUCKETS_MOST, max(16, -(-n_docs // BUCKET_DOCS)))


def in_blocks(docs: DataFrame, id_column: str, text_column: str, n_blocks: int) -> DataFrame:
    """block, doc_id, text: the documents dealt to blocks by a hash of id and text. Other columns are left behind."""
    key = F.pmod(F.xxhash64(F.col(id_column), F.col(text_column)), F.lit(n_blocks)).cast("int")
    return docs.select(key.alias("block"), F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))


def bucket_of(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """The bucket of each uint64 key, from its high 32 bits; it grows with the key, so sorted keys stay in bucket order."""
    return ((keys >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)


def bucket_cuts(sorted_keys: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that occur and the bounds of each in sorted_keys (one more bound than buckets)."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    buckets = bucket_of(sorted_keys, n_buckets).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1])))
    return buckets[first], np.append(first, len(sorted_keys))


def packed(block: int, buckets: np.ndarray, cuts: np.ndarray, *columns: np.ndarray) -> pa.Table:
    """A row for each bucket: bucket, block, n, payload; the payload holds each column's slice, one after another."""
    n = len(buckets)
    payload = [b"".join(c[a:b].tobytes() for c in columns) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.table({"bucket": pa.array(buckets, pa.int32()), "block": pa.array(np.full(n, block), pa.int32()), "n": pa.array(np.diff(cuts), pa.int32()), "payload": pa.array(payload, pa.binary())})


#: The schema of packed().
PACKED = "bucket int, block int, n int, payload binary"
PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("n", pa.int32()), ("payload", pa.binary())])


def unpacked(payloads: list[bytes], counts: list[int], *dtypes: type) -> list[np.ndarray]:
    """The columns of several payloads, each concatenated in row order."""
    columns: list[list[np.ndarray]] = [[] for _ in dtypes]
    for payload, n in zip(payloads, counts, strict=True):
        at = 0
        for k, dtype in enumerate(dtypes):
            columns[k].append(np.frombuffer(payload, dtype=dtype, count=n, offset=at))
            at += n * np.dtype(dtype).itemsize
    return [np.concatenate(c) if c else np.zeros(0, d) for c, d in zip(columns, dtypes, strict=True)]
