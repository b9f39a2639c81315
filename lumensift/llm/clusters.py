"""Centroid clustering: plain Lloyd in whole numbers.

Vectors with exactly ``DIMENSIONS`` components, all of them finite, become
integers, floor(1024 * x), packed into one binary value a row (4 bytes a component) and written once.
Every round broadcasts the centroids; ``mapInPandas`` takes integer squared
differences per centroid, the least wins (argmin: the lowest index among equals),
and each partition emits one sum for each centroid and component, which a groupBy
merges. What reaches the driver is CLUSTERS x (DIMENSIONS + 2) numbers a round,
whatever the input. Sums and their floors are exact, so the result doesn't depend
on partitions, order or lost tasks.

Defined results: null vectors, and those with other lengths, null or non-finite
components, have no row; integers beyond +-LARGEST (components beyond 131,072) are cut to it, since
squared distances beyond would not fit a long; among equal hashes (repeated ids) the start takes the vector whose
packed value is smaller; a null id hashes like an empty one and is assigned like
any other; repeated rows count as often as they stand; with fewer vectors than
clusters, each vector starts one; an empty table gives no rows; other columns
aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.durable import written

DIMENSIONS = 64
CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
SEED = 3

#: Of an integer's size; sums of DIMENSIONS squared differences then stay below 2^62.
LARGEST = 1 << 27

#: Vectors compared at once.
ROWS = 4096

#: Kinds of sums besides those of components.
COUNT, INERTIA = -1, -2


def packed(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS) -> DataFrame:
    """key and v, the integers of each vector that is kept as little-endian 4-byte numbers."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    kept = vectors.select(F.col(key).alias("key"), x.alias("x")).where((F.size(x) == dimensions) & F.coalesce(finite, F.lit(False)))
    kept = kept.withColumn("x", F.col("x").cast("array<double>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = np.floor(SCALE * batch.column(1).flatten().to_numpy(zero_copy_only=False))
            data = np.clip(whole, -LARGEST, LARGEST).astype("<i4").tobytes()
            cuts = np.arange(batch.num_rows + 1, dtype=np.int32) * (4 * dimensions)
            v = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(cuts), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([batch.column(0), v], ["key", "v"])

    return kept.mapInArrow(run, f"key {kept.schema['key'].dataType.simpleString()}, v binary").withColumnRenamed("key", key)


def unpacked(values: list[bytes] | pd.Series, dimensions: int = DIMENSIONS) -> np.ndarray:
    return np.frombuffer(b"".join(values), "<i4").reshape(-1, dimensions).astype(np.int64)


def start(points: DataFrame, key: str = "vec_id", clusters: int = CLUSTERS, seed: int = SEED, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The first centroids: the vectors with the smallest hashes of seed and id, in their order."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return unpacked([bytes(r["v"]) for r in points.select(mark.alias("mark"), "v").orderBy("mark", "v").limit(clusters).collect()], dimensions)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid of each row, the smallest of equals, and its squared distance."""
    distances = np.empty((len(x), len(centroids)), np.int64)
    for j, c in enumerate(centroids):
        d = x - c
        distances[:, j] = np.einsum("ij,ij->i", d, d)
    at = distances.argmin(1)
    return at, distances[np.arange(len(x)), at]


def sums(points: DataFrame, centroids: np.ndarray) -> dict[tuple[int, int], int]:
    """(cluster, component): total over the vectors nearest to the cluster; component COUNT has their number, INERTIA their squared distances."""
    shared = points.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        totals, counts, inertia = np.zeros(c.shape, np.int64), np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                x = unpacked(batch["v"].iloc[a : a + ROWS], c.shape[1])
                at, distance = nearest(x, c)
                for j in np.unique(at):
                    mine = at == j
                    totals[j] += x[mine].sum(0)
                    counts[j] += mine.sum()
                    inertia[j] += distance[mine].sum()
        seen = np.flatnonzero(counts)
        if len(seen):
            made = np.column_stack([totals[seen], counts[seen], inertia[seen]])
            parts = [*range(c.shape[1]), COUNT, INERTIA]
            yield pd.DataFrame({"cluster": np.repeat(seen, len(parts)), "component": np.tile(parts, len(seen)), "total": made.ravel()})

    merged = points.select("v").mapInPandas(run, "cluster long, component long, total long").groupBy("cluster", "component").agg(F.sum("total").alias("total"))
    return {(r["cluster"], r["component"]): r["total"] for r in merged.collect()}


def moved(centroids: np.ndarray, found: dict[tuple[int, int], int]) -> np.ndarray:
    """Every centroid with vectors, replaced by the floor of their mean; the others stay."""
    out = centroids.copy()
    for j in range(len(centroids)):
        if n := found.get((j, COUNT), 0):
            out[j] = [found[j, d] // n for d in range(centroids.shape[1])]
    return out


def lloyd(points: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The centroids after rounds of assignment and replacement."""
    for _ in range(rounds if len(centroids) else 0):
        after = moved(centroids, sums(points, centroids))
        if (after == centroids).all():
            break  # every further round gives the same
        centroids = after
    return centroids


def assigned(points: DataFrame, centroids: np.ndarray, key: str = "vec_id") -> DataFrame:
    """key, cluster and distance (squared) of every vector of points."""
    shared = points.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                part = batch.iloc[a : a + ROWS]
                at, distance = nearest(unpacked(part["v"], shared.value.shape[1]), shared.value)
                yield pd.DataFrame({"key": part["key"], "cluster": at.astype(np.int32), "distance": distance})

    kind = points.schema[key].dataType.simpleString()
    return points.select(F.col(key).alias("key"), "v").mapInPandas(run, f"key {kind}, cluster int, distance long").withColumnRenamed("key", key)


def cluster(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS) -> tuple[DataFrame, np.ndarray]:
    """key, cluster, distance and cluster_inertia and inertia (over the cluster, over all) of every vector that is kept; and the last centroids."""
    points = written(packed(vectors, key, vector, dimensions))
    centroids = lloyd(points, start(points, key, clusters, seed, dimensions), rounds)
    found = sums(points, centroids) if len(centroids) else {}
    by_cluster = [found.get((j, INERTIA), 0) for j in range(len(centroids))]
    each = F.array(*(F.lit(n).cast("long") for n in by_cluster)) if by_cluster else F.array().cast("array<long>")
    out = assigned(points, centroids, key).withColumn("cluster_inertia", F.get(each, F.col("cluster"))).withColumn("inertia", F.lit(sum(by_cluster)).cast("long"))
    return out, centroids


def centroid_digest(centroid: np.ndarray) -> str:
    """SHA-256 of the components as decimal numbers, joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digests = F.array(*(F.lit(centroid_digest(c)) for c in centroids)).cast("array<string>")
    return out.withColumn("centroid_sha256", F.get(digests, F.col("cluster")))


def _op12_sql() -> str:
    """All rounds written out, vectors as lists of numbers."""
    steps = []
    for r in range(10):
        steps.append(f"""
, d{r} AS MATERIALIZED (
  SELECT k.n, k.v, c.cluster, list_sum(list_transform(list_zip(k.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance FROM kept k, c{r} c
), a{r} AS MATERIALIZED (
  SELECT n, v, cluster FROM d{r} QUALIFY row_number() OVER (PARTITION BY n ORDER BY distance, cluster) = 1
), s{r} AS (
  SELECT cluster, i, sum(x) AS s, count(*) AS m FROM (SELECT cluster, unnest(v) AS x, unnest(range(64)) AS i FROM a{r}) GROUP BY ALL
), m{r} AS (
  SELECT cluster, list(((s - ((s % m) + m) % m) // m)::BIGINT ORDER BY i) AS c FROM s{r} GROUP BY cluster
), c{r + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.c, c.c) AS c FROM c{r} c LEFT JOIN m{r} m USING (cluster)
)""")
    return (
        """
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR)) - 1)::INT AS cluster, v AS c FROM kept QUALIFY cluster < 8
)"""
        + "".join(steps)
        + """
, last AS (
  SELECT k.vec_id, k.n, c.cluster, c.c, list_sum(list_transform(list_zip(k.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance FROM kept k, c10 c
  QUALIFY row_number() OVER (PARTITION BY k.n ORDER BY distance, c.cluster) = 1
)
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM last
"""
    )


OP12_SQL = _op12_sql()
