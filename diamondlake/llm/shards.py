"""Documents in shards of bounded size, and packed keys that travel between shards and buckets.

Both repeat removers work in rounds: every shard sends the keys it holds to buckets (a key has
one bucket, and a shard sends a key once, so a passage that a third of all documents share is one
entry per shard); a bucket answers each shard with one bit per key sent. A shard derives its key
list again from its documents, so answers need no keys. Keys have 32 bits within a bucket; as the
number of buckets grows with the corpus, the share of chance meetings does not.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diamondlake.llm.common import text_of

SHARD_BYTES = 6 << 20
DOCUMENTS = "shard int, id long, has_id boolean, text string"
PACKED = "bucket int, shard int, n long, data binary"


@dataclass(frozen=True)
class Sharded:
    docs: DataFrame         # DOCUMENTS
    n: int                  # shards, and buckets


def sharded(docs: DataFrame, doc_id: str, text: str, shard_bytes: int = SHARD_BYTES) -> Sharded:
    """Deal the documents by the hash of their id; rows of one id meet in one shard."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // shard_bytes))
    # a salt of its own for rows without an id: they have no order, so they need no company
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    dealt = rows.select(F.pmod(key, F.lit(n)).cast("int").alias("shard"),
                        F.coalesce("doc_id", F.lit(0)).alias("id"),
                        F.col("doc_id").isNotNull().alias("has_id"), "text")
    return Sharded(dealt, n)


def bucketed(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    """Keys of 32 bits with their bucket above, so that a sort puts buckets together."""
    high, low = hashes >> np.uint64(32), hashes & np.uint64(0xFFFFFFFF)
    return (high % np.uint64(n_buckets)) << np.uint64(32) | low


def bucket_bounds(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """Where each bucket begins in sorted keys."""
    return np.searchsorted(keys, np.arange(n_buckets + 1, dtype=np.uint64) << np.uint64(32))


def planes(values: np.ndarray) -> bytes:
    """The bytes of sorted numbers by significance: the upper ones compress to next to nothing."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def unplanes(data: bytes, dtype, n: int) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    flat = np.frombuffer(data, np.uint8, n * width).reshape(width, n)
    return np.ascontiguousarray(flat.T).reshape(-1).view(dtype)


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unbits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def answered(replies, bounds: np.ndarray) -> np.ndarray:
    """One flag per sorted key from the answers (bucket, data) of the buckets."""
    flags = np.zeros(int(bounds[-1]), bool)
    for bucket, data in zip(replies["bucket"].tolist(), replies["data"].tolist()):
        lo, hi = int(bounds[bucket]), int(bounds[bucket + 1])
        flags[lo:hi] = unbits(data, hi - lo)
    return flags


def spread(total: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Flags of the places that some run of `width` from `starts` covers; `total` is their number."""
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return np.cumsum(edge[:-1]) > 0
