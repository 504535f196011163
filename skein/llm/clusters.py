"""Operator 13: centroid clustering (Lloyd's rounds) in integers, by JVM expressions alone.

Vectors become arrays of whole numbers, stored once.  In each round the current
centroids are literal arrays: ``zip_with`` and ``aggregate`` make a squared distance for
each, ``array_min`` of (distance, number) structs chooses the nearest, ties to the smaller
number, and a sum for each component and cluster, with partial sums before the shuffle,
makes the next centroids.  A round moves one row for each cluster and partition; a cluster
with most vectors is no task of its own.  The driver gets ``k`` rows a round and keeps
nothing but the centroids, so a lost executor costs a reread of the stored table.  Rounds
that change nothing end the search, as all later ones would be the same.

Defined results: vectors that are null, of another length, or hold a null or non-finite
component are left out.  A null ``vec_id`` hashes as the empty text.  Repeated rows are
vectors of their own; equal hashes start in the order of their components.  With fewer
than ``k`` vectors each is a centroid; an empty table gives an empty result.  A squared
distance or sum beyond 64 bits (components over 2**27) fails the run.  Further columns
are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

DIMS, SCALE, K, ROUNDS, SEED = 64, 1024, 8, 10, 3


def whole_vectors(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id, v (array of bigint) for every vector that is kept."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.where((F.size("embedding") == dims) & ~bad)
    return kept.select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint")).alias("v"))


def literal(centroid: list[int]) -> Column:
    """One literal array; said as text because a call for each number takes longer than a round."""
    return F.expr("array(" + ", ".join(f"{x}L" for x in centroid) + ")")


def distance(v: str | Column, centroid: list[int]) -> Column:
    squares = F.zip_with(v, literal(centroid), lambda a, b: (a - b) * (a - b))
    return F.aggregate(squares, F.lit(0).cast("bigint"), lambda s, x: s + x)


def nearest(v: str | Column, centroids: list[list[int]]) -> Column:
    """STRUCT<distance, cluster> of the nearest centroid."""
    return F.array_min(F.array(*(F.struct(distance(v, c).alias("distance"), F.lit(k).alias("cluster")) for k, c in enumerate(centroids))))


def first_centroids(whole: DataFrame, k: int = K, seed: int = SEED) -> list[list[int]]:
    """The ``k`` vectors of smallest hash, in its order."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r["v"]) for r in whole.select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()]


def moved(whole: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: floor(sum / count) of each one's vectors, computed
    from ``k`` rows of sums; one without vectors stays."""
    sums = [F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(len(centroids[0]))]
    near = whole.select(nearest("v", centroids)["cluster"].alias("cluster"), "v")
    out = list(centroids)
    for r in near.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(len(centroids[0]))]
    return out


def fit(whole: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> list[list[int]]:
    centroids = first_centroids(whole, k, seed)
    for _ in range(rounds if centroids else 0):
        now, centroids = centroids, moved(whole, centroids)
        if now == centroids:
            break
    return centroids


def assigned(whole: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vec_id, cluster, distance."""
    near = whole.select("vec_id", nearest("v", centroids).alias("near"))
    return near.select("vec_id", F.col("near.cluster").alias("cluster"), F.col("near.distance").alias("distance"))


def cluster_vectors(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, and the cluster's inertia, that of all and the digest of
    the cluster's centroid."""
    whole = stored(whole_vectors(vectors, dims, scale), "vectors")
    centroids = fit(whole, k, rounds, seed)
    if not centroids:
        none = F.lit(None).cast("bigint")
        return whole.select("vec_id", none.cast("int").alias("cluster"), *(none.alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256"))
    found = assigned(whole, centroids)
    inertia = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows at most
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    own = F.element_at(F.array(*(F.lit(inertia.get(c, 0)).cast("bigint") for c in range(len(centroids)))), F.col("cluster") + 1)
    digest = F.element_at(F.array(*map(F.lit, digests)), F.col("cluster") + 1)
    total = F.lit(sum(inertia.values())).cast("bigint")
    return found.select("vec_id", "cluster", "distance", own.alias("cluster_inertia"), total.alias("inertia"), digest.alias("centroid_sha256"))


def clusters_sql(dims: int = DIMS, scale: int = SCALE, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> str:
    """The same as one statement, a pair of common tables for each round."""
    square = f"list_sum([(v[i] - c[i]) * (v[i] - c[i]) FOR i IN range(1, {dims + 1})])::BIGINT"
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [floor({scale} * x::DOUBLE)::BIGINT FOR x IN embedding] AS v
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS k, v AS c FROM v
  ORDER BY k LIMIT {k})""",
    ]
    for n in range(rounds + 1):
        parts.append(f"""a{n} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min((d, k)) AS near FROM (SELECT r, vec_id, v, k, {square} AS d FROM v, c{n}) GROUP BY r)""")
        if n < rounds:
            parts.append(f"""s{n} AS (SELECT near[2] AS k, i, sum(v[i]) AS s, count(*) AS n FROM a{n}, (SELECT unnest(range(1, {dims + 1})) AS i) GROUP BY ALL)""")
            parts.append(f"""m{n} AS (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM s{n} GROUP BY k)""")
            parts.append(f"""c{n + 1} AS MATERIALIZED (SELECT c{n}.k, coalesce(m{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN m{n} USING (k))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, near[2]::INT AS cluster, near[1]::BIGINT AS distance, (sum(near[1]) OVER (PARTITION BY near[2]))::BIGINT AS cluster_inertia,
       (sum(near[1]) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON k = near[2]"""


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op13_clusters": op13_clusters}
ORACLE_SQL = {"op13_clusters": clusters_sql()}
