"""Plain Lloyd clustering in whole numbers: the same clusters on any number of machines.

Vectors become whole numbers, floor(scale * x), so that sums don't depend on their order. The centroids, k of them and so
of a size that is known before, are broadcast. In each round mapInPandas works out each vector's squared differences to
every centroid and takes the least (the lowest number among equals), and gives one row of sums a cluster for its whole
partition. groupBy adds these up; the driver sees k rows a round. Nothing of a round is kept but the centroids: each
round reads its input again, so a lost executor costs its own tasks only. Hand over a table or something as cheap to read.

Cases: vectors of another length, null vectors, and vectors with a null, NaN or infinite component are left out; repeated
rows are vectors of their own and weigh each; a null id is hashed as the text without digits; ties between starts go by
components; fewer vectors than k give as many centroids; a cluster that runs empty keeps its place; an empty table gives
an empty table; other columns are not read. Components beyond LIMIT after scaling raise ValueError: their squared
distances could pass 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import cut

CLUSTERS, ROUNDS, DIM, SCALE, SEED = 40, 5, 64, 256, 2
LIMIT = 1 << 27
ROWS_AT_ONCE = 2048


def kept(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """id and v (array of bigint) of the vectors that take part."""
    found = vectors.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("x"))
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    fits = F.coalesce((F.size("x") == dim) & ~F.exists("x", odd), F.lit(False))
    return found.where(fits).select("id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


def starts(rows: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The k vectors with the least hashes of seed and id, in that order: k rows, taken from each task's least ones."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = rows.orderBy(name, "v").limit(k).collect()
    return np.array([r.v for r in first], np.int64)


def matrix(arrays: pd.Series) -> np.ndarray:
    x = np.concatenate(arrays.to_list()).astype(np.int64, copy=False).reshape(len(arrays), -1)
    if np.abs(x).max() > LIMIT:
        raise ValueError(f"a scaled component lies beyond {LIMIT}")
    return x


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid, the lowest among equals, and the squared distance to it."""
    far = np.empty((len(x), len(centroids)), np.int64)
    for at in range(0, len(x), ROWS_AT_ONCE):
        part = x[at : at + ROWS_AT_ONCE]
        for j, c in enumerate(centroids):
            apart = part - c
            far[at : at + ROWS_AT_ONCE, j] = np.einsum("ij,ij->i", apart, apart)
    best = far.argmin(axis=1)
    return best, far[np.arange(len(x)), best]


def summed(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cluster, n, s0, s1, ...: count and sums of the components of each cluster that has vectors."""
    shared, (k, dim) = rows.sparkSession.sparkContext.broadcast(centroids), centroids.shape
    names = [f"s{i}" for i in range(dim)]

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if len(batch):
                x = matrix(batch["v"])
                best, _ = nearest(x, shared.value)
                counts += np.bincount(best, minlength=k)
                np.add.at(sums, best, x)
        yield pd.DataFrame(sums, columns=names).assign(cluster=np.arange(k, dtype=np.int32), n=counts)[counts > 0][["cluster", "n", *names]]

    parts = rows.select("v").mapInPandas(add, "cluster int, n bigint, " + ", ".join(f"{s} bigint" for s in names))
    exact = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)  # noqa: E731  past 64 bits
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), *map(exact, names))


def fit(rows: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Centroids after that many rounds, over the rows of kept()."""
    centroids = starts(rows, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = centroids.copy()
        for r in summed(rows, centroids).collect():  # k rows at most
            centroids[r.cluster] = [int(s) // r.n for s in r[2:]]
    return centroids


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id, cluster, distance (squared) of every row of kept(). Ids go through pandas as text, which keeps null and 64 bits."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                best, far = nearest(matrix(batch["v"]), shared.value)
                yield pd.DataFrame({"id": batch["id"], "cluster": best.astype(np.int32), "distance": far})

    found = rows.withColumn("id", F.col("id").cast("string")).mapInPandas(assign, "id string, cluster int, distance bigint")
    return found.withColumn("id", F.col("id").cast(rows.schema["id"].dataType))


def named(centroids: np.ndarray) -> Column:
    """Digests of the centroids' components, by cluster."""
    return F.sha2(F.get(F.array(*[F.lit(",".join(map(str, c))) for c in centroids.tolist()], F.lit(None).cast("string")), F.col("cluster")), 256)


def report(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """Per vector that takes part: key, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    rows = kept(vectors, key, vector, dim, scale)
    centroids = fit(rows, k, rounds)
    found = cut(assigned(rows, centroids))
    total = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    inertia = found.groupBy("cluster").agg(total("distance").alias("in_cluster"))  # k rows
    every = inertia.agg(F.sum("in_cluster").alias("in_all"))
    both = found.join(F.broadcast(inertia.join(F.broadcast(every))), "cluster")
    return both.select(F.col("id").alias(key), "cluster", "distance", F.col("in_cluster").cast("bigint").alias("cluster_inertia"), F.col("in_all").cast("bigint").alias("inertia"), named(centroids).alias("centroid_sha256"))


def _sql(k: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """The same rows in SQL, a few tables a round."""
    parts = [
        f"kept AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM})",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS cluster, v AS c FROM kept QUALIFY cluster < {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"d{i} AS MATERIALIZED (SELECT rid, any_value(vec_id) AS vec_id, any_value(v) AS v, min_by(cluster, far * 1000 + cluster) AS cluster, min(far) AS far FROM (SELECT rid, vec_id, v, cluster, CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS far FROM kept, c{i}) GROUP BY rid)")
        if i < rounds:
            parts.append(f"s{i} AS (SELECT cluster, place, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range({DIM})) AS place FROM d{i}) GROUP BY cluster, place)")
            parts.append(f"m{i} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY place) AS c FROM s{i} GROUP BY cluster)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster))")
    return f"""WITH {', '.join(parts)}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, far AS distance, CAST(sum(far) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(far) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM d{rounds} JOIN c{rounds} USING (cluster)"""


SQL = _sql()
