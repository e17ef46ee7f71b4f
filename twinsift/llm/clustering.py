"""Centroid clustering of integer vectors, with block-norm screening.

A vector's components become whole numbers. Each vector is also kept compressed, in a byte a component and a scale, with
the norms of what the compression leaves out, segment by segment. The product of a vector and a centroid is that of the
compressed vector and the centroid plus that of the rest, which by Cauchy-Schwarz is at most the sum over segments of the
rest's norm times the centroid's; so compressed vectors bound every distance from below. The centroid with the least bound
gets its exact distance first; a centroid whose bound is above that can't be nearest, and only the others get exact
distances, in whole numbers. Centroids and their sums have a size that parameters bound; each round adds up the sums of
tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.llm._util import PARTIAL, materialise, partial_blocks, sum_blocks

SCALE = 1024
LARGEST = 1 << 27  # whole-number components below this give exact distances in 64 bits


def whole_components(vector: Column) -> Column:
    """floor(1024 * x) of each component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(SCALE))).cast("long"))


def is_kept(vector: Column, dims: int) -> Column:
    """Whether a vector has exactly `dims` components, each finite and small enough for exact distances; false for a null one."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float(LARGEST // SCALE))))
    return F.coalesce((F.size(vector) == dims) & good, F.lit(False))


def _norms(x: np.ndarray, segments: int) -> np.ndarray:
    parts = x.reshape(len(x), segments, -1)
    return np.sqrt(np.einsum("ijk,ijk->ij", parts, parts))


def compressed(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of whole numbers in a byte a component, and for each row its squared norm, its scale and the norms of the segments of what is left out."""
    x = x.astype(np.float64)
    scale = np.maximum(np.abs(x).max(1, initial=0.0) / 127, 1e-9)
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, np.hstack([np.einsum("ij,ij->i", x, x)[:, None], scale[:, None], _norms(x - q * scale[:, None], segments)])


def nearest(x: np.ndarray, q: np.ndarray, marks: np.ndarray, centroids: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Each vector's nearest centroid (ties: the smaller number), its squared distance, and how many exact distances were worked out; q and marks are what compressed() gives."""
    c = centroids.astype(np.float64)
    squares = np.einsum("ij,ij->i", c, c)
    most = (q.astype(np.float64) @ c.T) * marks[:, 1:2] + marks[:, 2:] @ _norms(c, segments).T  # of the products
    least = marks[:, :1] + squares - 2 * most
    least -= 1e-9 * (marks[:, :1] + squares + 1)  # more than rounding can do

    def exact(rows, k):
        d = x[rows] - centroids[k]
        return np.einsum("ij,ij->i", d, d)

    first = least.argmin(1)
    best, at, done = np.empty(len(x), np.int64), first.copy(), len(x)
    for k in range(len(centroids)):
        mine = np.flatnonzero(first == k)
        best[mine] = exact(mine, k)
    for k in range(len(centroids)):
        rows = np.flatnonzero((first != k) & (least[:, k] <= best))
        done += len(rows)
        d = exact(rows, k)
        better = (d < best[rows]) | ((d == best[rows]) & (k < at[rows]))
        best[rows[better]], at[rows[better]] = d[better], k
    return at, best, done


_SHORT = "vec_id long, x binary, q binary, marks binary"


def _batches(batches: Iterator[pa.RecordBatch], dims: int, segments: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    for b in batches:
        if b.num_rows:
            raw = [np.frombuffer(b"".join(b.column(k).to_pylist()), t).reshape(b.num_rows, -1) for k, t in ((1, "<i8"), (2, "i1"), (3, "<f8"))]
            yield b.column(0), *raw


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, segments: int = 8, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that is kept.

    Vectors of another length, null, or with a null or non-finite component are left out, and so are those with a
    component of 131,072 or more, whose distances would not fit. The first centroids are the k kept vectors with the
    smallest hash of their id (ties: the smaller components; a null id is an empty one); fewer vectors, fewer
    centroids. A centroid without vectors stays. Repeated rows count each; an empty table gives no rows; other columns
    are not read.
    """
    if dims % segments:
        raise ValueError("segments must divide the number of components")
    spark, vector = vectors.sparkSession, F.col(vector_col)
    kept = vectors.filter(is_kept(vector, dims)).select(F.col(id_col).cast("long").alias("vec_id"), whole_components(vector).alias("x"))

    def shorten(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(-1, dims)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r.tobytes() for r in rows], pa.binary()) for rows in (x, *compressed(x, segments)))], names=["vec_id", "x", "q", "marks"])

    table = materialise(kept.mapInArrow(shorten, _SHORT), "vectors")
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    start = table.select("x", named.alias("h")).orderBy("h", "x").limit(k).collect()
    centroids = np.array([np.frombuffer(r["x"], "<i8") for r in start], np.int64).reshape(-1, dims)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")

    for _ in range(rounds):
        told = spark.sparkContext.broadcast(centroids)

        def sums(batches, told=told):
            total = np.zeros((len(told.value), dims + 1), np.int64)
            for _, x, *short in _batches(batches, dims, segments):
                at = nearest(x, *short, told.value, segments)[0]
                for c in np.unique(at):
                    total[c, :dims] += x[at == c].sum(0)
                    total[c, dims] += np.count_nonzero(at == c)
            yield from partial_blocks(total, 1)

        total = sum_blocks(table.mapInArrow(sums, PARTIAL), (len(centroids), dims + 1), 1)
        some = total[:, dims] > 0
        moved = centroids.copy()
        moved[some] = total[some, :dims] // total[some, dims :]
        if np.array_equal(moved, centroids):
            break  # later rounds would give the same
        centroids = moved
    told = spark.sparkContext.broadcast(centroids)

    def assign(batches):
        for ids, x, *short in _batches(batches, dims, segments):
            at, distance, _ = nearest(x, *short, told.value, segments)
            yield pa.RecordBatch.from_arrays([ids, pa.array(at, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    placed = materialise(table.mapInArrow(assign, "vec_id long, cluster int, distance long"), "clusters")
    inertia = {r["cluster"]: r["d"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows
    whole = sum(inertia.values())
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    by_cluster = lambda values, kind: F.element_at(F.lit(values).cast(f"array<{kind}>"), F.col("cluster") + 1)
    return placed.select(
        "vec_id", "cluster", "distance", by_cluster([inertia.get(c, 0) for c in range(len(names))], "bigint").alias("cluster_inertia"), F.lit(whole).cast("long").alias("inertia"), by_cluster(names, "string").alias("centroid_sha256")
    )


def oracle(k: int = 8, rounds: int = 10, dims: int = 64, seed: int = 3) -> str:
    """DuckDB SQL for cluster() over embeddings: every distance of every round, in long form."""
    ctes = [
        f"kept AS MATERIALIZED (SELECT vec_id, embedding AS e FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = {dims})",
        f"v AS MATERIALIZED (SELECT vec_id, i, CAST(floor({SCALE} * CAST(e[i] AS DOUBLE)) AS BIGINT) AS x FROM kept, (SELECT unnest(range(1, {dims + 1})) AS i))",
        f"c0 AS MATERIALIZED (SELECT c, i, x AS m FROM v JOIN (SELECT vec_id, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c FROM kept QUALIFY c < {k}) USING (vec_id))",
    ]
    assign = "a{0} AS MATERIALIZED (SELECT vec_id, c, d FROM (SELECT vec_id, c, CAST(sum((x - m) * (x - m)) AS BIGINT) AS d FROM v JOIN c{0} USING (i) GROUP BY vec_id, c) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)"
    move = (
        "c{1} AS MATERIALIZED (SELECT c, i, coalesce(CAST((s - ((s % n) + n) % n) // n AS BIGINT), m) AS m FROM c{0} "
        "LEFT JOIN (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM v JOIN a{0} USING (vec_id) GROUP BY c, i) USING (c, i))"
    )
    for r in range(rounds):
        ctes += [assign.format(r), move.format(r, r + 1)]
    ctes += [assign.format(rounds), f"names AS (SELECT c, sha256(string_agg(m, ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c)"]
    return f"""
    WITH {", ".join(ctes)}
    SELECT vec_id, CAST(c AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256 FROM a{rounds} JOIN names USING (c)
    """
