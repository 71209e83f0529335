"""Exact k-means on whole-numbered vectors of 64 components, by bit planes and popcounts.

Bit b of all 64 components of a vector is one 64-bit word, its plane b; planes carry the weights of two's
complement (2**b, the topmost -2**b). The dot product of two vectors is the weighted sum of the popcounts of
their planes' conjunctions, so distances are exact whole numbers. Planes are written once; a round is one
pass that sends at most one row of sums per task and cluster, and the k centroids are all that the driver
and the tasks hold besides a slice of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diamondlake.llm.common import ship_package
from diamondlake.session import Stage

WIDTH = 64              # components, one bit of a word each
K, ROUNDS, SCALE = 40, 5, 256
MOST_BITS = 28          # 64 squared differences of 28-bit numbers stay below 2**63
SLICE = 4096            # vectors whose distances to all centroids are held at a time


def pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Whole numbers (n, 64) as planes (n, bits)."""
    planes = np.empty((len(values), bits), np.uint64)
    for b in range(bits):
        bit = ((values >> b) & 1).astype(np.uint8)
        planes[:, b] = np.packbits(bit, axis=1, bitorder="little").view("<u8").reshape(len(values))
    return planes


def unpack(planes: np.ndarray) -> np.ndarray:
    """The numbers of `pack`."""
    n, bits = planes.shape
    flat = np.unpackbits(planes.astype("<u8").view(np.uint8).reshape(n, bits, 8), axis=2, bitorder="little")
    return np.tensordot(flat, plane_weights(bits), axes=(1, 0))


def plane_weights(bits: int) -> np.ndarray:
    weights = np.int64(1) << np.arange(bits, dtype=np.int64)
    weights[-1] = -weights[-1]
    return weights


def dots(planes: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The dot product of every vector (n, bits) with every other (k, bits)."""
    weights = plane_weights(planes.shape[1])
    out = np.zeros((len(planes), len(others)), np.int64)
    for i, w in enumerate(weights):
        part = np.zeros_like(out)
        for j, v in enumerate(weights):
            part += v * np.bitwise_count(planes[:, i, None] & others[None, :, j])
        out += w * part
    return out


def squares(planes: np.ndarray) -> np.ndarray:
    """The dot product of every vector with itself."""
    weights = plane_weights(planes.shape[1])
    out = np.zeros(len(planes), np.int64)
    for i, w in enumerate(weights):
        for j, v in enumerate(weights):
            out += w * v * np.bitwise_count(planes[:, i] & planes[:, j])
    return out


def nearest(planes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, the smaller number in ties, and the squared distance."""
    distance = squares(planes)[:, None] + squares(centroids)[None, :] - 2 * dots(planes, centroids)
    label = distance.argmin(axis=1)
    return label, distance[np.arange(len(planes)), label]


def _slices(batches: Iterator[pd.DataFrame], bits: int) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for batch in batches:
        for lo in range(0, len(batch), SLICE):
            rows = batch.iloc[lo:lo + SLICE]
            yield rows, np.frombuffer(b"".join(rows["planes"]), "<u8").reshape(-1, bits).astype(np.uint64)


def _pack_rows(scale: int, bits: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch["embedding"].to_numpy()).astype(np.float64)
                planes = pack(np.floor(x * scale).astype(np.int64), bits)
                yield pd.DataFrame({"vec_id": batch["vec_id"], "planes": [p.tobytes() for p in planes.astype("<u8")]})
    return rows


def _sum_rows(centroids: np.ndarray):
    k, bits = centroids.shape

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, counts = np.zeros((k, WIDTH), np.int64), np.zeros(k, np.int64)
        for _, planes in _slices(batches, bits):
            label, _ = nearest(planes, centroids)
            order = np.argsort(label, kind="stable")
            there, at = np.unique(label[order], return_index=True)
            sums[there] += np.add.reduceat(unpack(planes[order]), at, axis=0)
            counts += np.bincount(label, minlength=k)
        met = np.flatnonzero(counts)
        yield pd.DataFrame({"cluster": met, "n": counts[met],
                            **{f"s{c}": sums[met, c] for c in range(WIDTH)}})
    return rows


def _label_rows(centroids: np.ndarray):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, planes in _slices(batches, centroids.shape[1]):
            label, distance = nearest(planes, centroids)
            yield pd.DataFrame({"vec_id": batch["vec_id"].to_numpy(), "cluster": label, "distance": distance})
    return rows


def _usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    x = F.col(embedding)
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.filter(F.coalesce((F.size(x) == WIDTH) & whole, F.lit(False))).select(
        F.col(vec_id).cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding"))


def cluster_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K,
                    rounds: int = ROUNDS, scale: int = SCALE, salt: str = "2") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every usable vector.

    Usable are arrays of exactly 64 components, none NULL or non-finite; others are left out. A component
    x counts as floor(scale * x). The first centroids are the k vectors with the smallest sha256 of
    `<salt>:<vec_id>`; `rounds` times every vector goes to the nearest centroid (ties: the smaller
    number) and every centroid with vectors moves to the floor of their mean; then vectors are assigned
    once more. All sums and distances are exact and do not depend on the order of rows.

    Rows that repeat an id count each; of equal ids the smaller components start first. NULL ids come
    last among the first centroids. With fewer vectors than k there are that many clusters. Extra
    columns are ignored. A table without usable vectors gives no rows. Numbers of more than MOST_BITS
    bits, whose squared distances exceed a long, raise a ValueError. k bounds what is held per task.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    stage = Stage(spark)
    usable = _usable(vectors, vec_id, embedding)
    low, high = usable.agg(F.min(F.array_min("embedding")), F.max(F.array_max("embedding"))).first()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if low is None:
        return spark.createDataFrame([], schema)
    bits = 1 + max(int(np.floor(low * scale)), ~int(np.floor(low * scale)),
                   int(np.floor(high * scale)), ~int(np.floor(high * scale))).bit_length()
    if bits > MOST_BITS:
        raise ValueError(f"components of {bits} bits: squared distances would exceed a long")

    first = usable.select("embedding", F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256).alias("h"))
    start = [r["embedding"] for r in first.orderBy(F.asc_nulls_last("h"), "embedding").limit(k).collect()]
    values = np.floor(np.array(start, np.float64) * scale).astype(np.int64)
    planes = stage.put("planes", usable.mapInPandas(_pack_rows(scale, bits), "vec_id long, planes binary"))

    names = [f"s{c}" for c in range(WIDTH)]
    for _ in range(rounds):
        sums = planes.mapInPandas(_sum_rows(pack(values, bits)),
                                  f"cluster int, n long, {', '.join(f'{c} long' for c in names)}")
        # at most k rows come back
        for r in sums.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]).collect():
            values[r["cluster"]] = [r[c] // r["n"] for c in names]

    placed = stage.put("placed", planes.mapInPandas(_label_rows(pack(values, bits)),
                                                    "vec_id long, cluster int, distance long"))
    inertia = {r["cluster"]: r["inertia"] for r in placed.groupBy("cluster").agg(
        F.sum("distance").alias("inertia")).collect()}
    digest = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in values.tolist()]
    clusters = spark.createDataFrame(
        [(c, i, sum(inertia.values()), digest[c]) for c, i in inertia.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(clusters), "cluster").select(*[c.split()[0] for c in schema.split(", ")])
