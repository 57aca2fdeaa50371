"""Centroid clustering of integer vectors with Hamerly's bounds: one upper and one second-nearest lower bound a vector, kept between rounds."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skygraph.llm.common import Scratch, bounded_batches

#: Differences of components below this are squared and summed in 64 bits; beyond it in whole numbers of any size.
SAFE = 1 << 26
#: Bounds are doubles: each is moved outward by more than any rounding.
OUT = 1e-12
STATE = "id bigint, q binary, cluster int, upper double, lower double, distance bigint, scans int"


def packed(vectors: np.ndarray) -> list[bytes]:
    """Rows of whole numbers as bytes of the smallest width that holds a row; rows beyond 64 bits as text."""
    if vectors.dtype == object:
        return [packed(np.array([r.tolist()], dtype=np.int64))[0] if max(map(abs, r)) < 1 << 62 else b"," + ",".join(map(str, r)).encode() for r in vectors]
    most = np.abs(vectors).max(axis=1, initial=0)
    out: list[bytes] = [b""] * len(vectors)
    for low, high, kind in ((-1, 127, "<i1"), (127, 32_767, "<i2"), (32_767, 2**31 - 1, "<i4"), (2**31 - 1, 2**63 - 1, "<i8")):
        if (own := np.flatnonzero((most > low) & (most <= high))).size:
            data, width = vectors[own].astype(kind).tobytes(), vectors.shape[1] * int(kind[-1])
            for k, i in enumerate(own.tolist()):
                out[i] = data[k * width : (k + 1) * width]
    return out


def unpacked(rows: list[bytes], width: int) -> np.ndarray:
    """The vectors of ``packed``, as 64-bit integers, or as whole numbers of any size if one needs them."""
    if any(r[:1] == b"," and len(r) not in (width, 2 * width, 4 * width, 8 * width) for r in rows):
        return np.array([list(map(int, r[1:].split(b","))) if r[:1] == b"," and len(r) not in (width, 2 * width, 4 * width, 8 * width) else unpacked([r], width)[0].tolist() for r in rows], dtype=object)
    out = np.zeros((len(rows), width), dtype=np.int64)
    sizes = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
    for kind in ("<i1", "<i2", "<i4", "<i8"):
        if (own := np.flatnonzero(sizes == width * int(kind[-1]))).size:
            out[own] = np.frombuffer(b"".join(rows[i] for i in own.tolist()), dtype=kind).reshape(len(own), width)
    return out


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles, exactly as doubles give it."""
    scaled = np.floor(values * float(scale))
    if np.abs(scaled).max(initial=0) < SAFE:
        return scaled.astype(np.int64)
    return np.array([[int(x) for x in row] for row in scaled.tolist()], dtype=object)


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of vectors to centroids, broadcast over the leading axes."""
    if vectors.dtype == object or centroids.dtype == object or max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)) >= SAFE:
        d = vectors.astype(object) - centroids.astype(object)
        return (d * d).sum(axis=-1)
    d = vectors - centroids
    return np.einsum("...i,...i->...", d, d)


def all_distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(vectors, centroids): exact squared distances; one centroid at a time, so that memory is that of the vectors."""
    each = [distances(vectors, c) for c in centroids]
    return np.stack(each, axis=1) if each else np.zeros((len(vectors), 0), dtype=np.int64)


def _roots(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64))


class Round:
    """What a round of assignments knows of its centroids: half the way to the nearest other one, and how far each has moved."""

    def __init__(self, centroids: np.ndarray, last: np.ndarray | None):
        self.centroids = centroids
        apart = all_distances(centroids, centroids).astype(np.float64)
        np.fill_diagonal(apart, np.inf)
        self.half = np.sqrt(apart.min(axis=1, initial=np.inf)) / 2 * (1 - OUT)
        moved = _roots(distances(centroids, last)) * (1 + OUT) if last is not None else np.zeros(len(centroids))
        self.moved = moved
        # of the other centroids the farthest move: the second largest for the one that moved most
        far = int(moved.argmax())
        others = np.delete(moved, far).max(initial=0.0)
        self.others = np.where(np.arange(len(moved)) == far, others, moved[far])

    def scan(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Full exact scan: (nearest centroid, the smaller number of equals; its squared distance; bounds)."""
        d = all_distances(vectors, self.centroids)
        best = d.argmin(axis=1)
        rows = np.arange(len(d))
        own = d[rows, best]
        rest = d.astype(np.float64)
        rest[rows, best] = np.inf
        return best.astype(np.int32), own, _roots(own) * (1 + OUT), np.sqrt(rest.min(axis=1)) * (1 - OUT)

    def assign(self, vectors, cluster, upper, lower, scans):
        """Assignments after the centroids moved: bounds are loosened by the moves, and only vectors whose bounds leave it open are scanned.

        A vector stays without a look if its upper bound is below the lower one, or below half the way to the nearest other centroid;
        strictly, so that no equal distance with a smaller number is missed. Where that fails the own distance makes the upper bound
        exact first.
        """
        upper = (upper + self.moved[cluster]) * (1 + OUT)
        lower = np.maximum(lower - self.others[cluster], 0) * (1 - OUT)
        bound = np.maximum(lower, self.half[cluster])
        open_ = np.flatnonzero(~(upper < bound))
        if open_.size:
            upper[open_] = _roots(distances(vectors[open_], self.centroids[cluster[open_]])) * (1 + OUT)
            open_ = open_[~(upper[open_] < bound[open_])]
        if open_.size:
            cluster = cluster.copy()
            cluster[open_], _, upper[open_], lower[open_] = self.scan(vectors[open_])
            scans = scans.copy()
            scans[open_] += 1
        return cluster, upper, lower, scans


def _longs(values: np.ndarray) -> pa.Array:
    """As longs; null beyond 64 bits."""
    return pa.array([x if x < 1 << 63 else None for x in map(int, values)] if values.dtype == object else values, type=pa.int64())


def _mapped(df: DataFrame, apply: Callable[[pa.RecordBatch], list], schema: str) -> DataFrame:
    bounded_batches(df.sparkSession)
    fields = df.sparkSession.createDataFrame([], schema).schema
    names = fields.names

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 16_384):
                yield pa.RecordBatch.from_arrays(apply(batch.slice(at, 16_384)), names=names)

    return df.mapInArrow(run, fields)


def _state(batch: pa.RecordBatch, width: int):
    vectors = unpacked(batch.column("q").to_pylist(), width)
    return vectors, *(batch.column(c).to_numpy().copy() for c in ("cluster", "upper", "lower", "scans"))


def _means(state: DataFrame, width: int, centroids: np.ndarray) -> np.ndarray:
    """floor(sum / count) of each cluster's vectors, component by component; an empty cluster keeps its centroid.

    Each task adds its own vectors up first, so a cluster of any size costs a row of sums from each task.
    """

    def run(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            vectors, clusters = unpacked(batch.column("q").to_pylist(), width), batch.column("cluster").to_numpy()
            for c in np.unique(clusters).tolist():
                own = vectors[clusters == c]
                n, s = sums.get(c, (0, [0] * width))
                sums[c] = n + len(own), [a + int(b) for a, b in zip(s, own.sum(axis=0).tolist())]
        rows = [(c, i, n, str(x)) for c, (n, s) in sums.items() for i, x in enumerate(s)]
        yield pa.RecordBatch.from_pydict({k: [r[j] for r in rows] for j, k in enumerate(("cluster", "i", "n", "s"))}, schema=pa.schema([("cluster", pa.int32()), ("i", pa.int32()), ("n", pa.int64()), ("s", pa.string())]))

    part = state.select("cluster", "q").mapInArrow(run, "cluster int, i int, n bigint, s string")
    total = part.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out = [c.tolist() for c in centroids]
    for r in total.collect():  # clusters times components
        out[r["cluster"]][r["i"]] = int(r["s"]) // r["n"]
    return _array(out, width)


def _array(rows: list[list[int]], width: int) -> np.ndarray:
    fits = all(abs(x) < 1 << 62 for r in rows for x in r)
    return np.array(rows, dtype=np.int64 if fits else object).reshape(len(rows), width)


def cluster(df: DataFrame, *, k: int = 16, rounds: int = 3, width: int = 64, scale: int = 64, start: Callable[[Column], Column] | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per vector of exactly ``width`` finite components: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, scans.

    Components become floor(scale * x). The first centroids are the ``k`` vectors with the smallest ``start`` of the key (sha256 of "1:" and the
    key by default). A round assigns every vector to the nearest centroid and moves the centroids to the floors of the means;
    after ``rounds`` rounds vectors are assigned once more. Each round writes the vectors with their bounds and drops the table before it;
    the driver holds the centroids alone. ``scans`` counts a vector's full scans of all centroids (rounds + 1 without bounds).

    Vectors that are null, of another length, or hold null or non-finite components are left out. Equal vectors and repeated keys are
    vectors each; equal starts go by the vector; a null key comes last among the starts. Fewer vectors than ``k`` make fewer
    clusters, an empty table gives an empty one, other columns are ignored. Distances beyond 64 bits are computed exactly and given as null.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    start = start or (lambda c: F.sha2(F.concat(F.lit("1:"), c.cast("string")), 256))
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.coalesce((F.size("v") == width) & finite, F.lit(False)))

    def to_integers(batch):
        v = batch.column("v")
        values = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), width)
        return [batch.column("id"), pa.array(packed(integers(values, scale)), type=pa.binary())]

    kept = scratch.save(_mapped(rows, to_integers, "id bigint, q binary"))
    first = kept.select(start(F.col("id")).alias("order"), "q").orderBy(F.col("order").asc_nulls_last(), "q").limit(k).collect()
    centroids = _array([unpacked([bytes(r["q"])], width)[0].tolist() for r in first], width)
    if not first:
        scratch.drop(kept)
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string, scans int")

    state, last = kept, None
    for step in range(rounds + 1):
        shared = spark.sparkContext.broadcast(Round(centroids, last))  # at most k centroids
        final = step == rounds

        def apply(batch, shared=shared, first=step == 0, final=final):
            now = shared.value
            if first:
                vectors = unpacked(batch.column("q").to_pylist(), width)
                own, d, upper, lower = now.scan(vectors)
                scans = np.ones(len(own), dtype=np.int32)
            else:
                vectors, *held = _state(batch, width)
                own, upper, lower, scans = now.assign(vectors, *held)
            exact = _longs(distances(vectors, now.centroids[own])) if final else pa.nulls(len(own), pa.int64())
            q = pa.nulls(len(own), pa.binary()) if final else batch.column("q")
            return [batch.column("id"), q, pa.array(own, type=pa.int32()), pa.array(upper), pa.array(lower), exact, pa.array(scans, type=pa.int32())]

        new = scratch.save(_mapped(state, apply, STATE))
        scratch.drop(state)
        state = new
        if not final:
            last, centroids = centroids, _means(state, width, centroids)

    inertia = {r["cluster"]: r["d"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # at most k rows
    told = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    of = lambda values, kind: F.element_at(F.lit(values).cast(f"array<{kind}>"), F.col("cluster") + 1)
    by_cluster = [int(inertia.get(c) or 0) for c in range(len(told))]
    return state.select(F.col("id").alias("vec_id"), "cluster", "distance", of(by_cluster, "bigint").alias("cluster_inertia"), F.lit(sum(by_cluster)).cast("bigint").alias("inertia"), of(told, "string").alias("centroid_sha256"), "scans")
