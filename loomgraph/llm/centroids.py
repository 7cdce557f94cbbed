"""Exact clustering by Lloyd's rounds, with bounds that are loosened by geometry instead of by full drift.

Vectors are integers, so sums, means and squared distances are exact. Each vector has its cluster and a lower bound of its
distance to every other centroid. After the centroids moved, the vectors of a cluster lie in a sphere around its old
centroid whose radius is the greatest distance of its vectors. How much nearer to a vector of the sphere can another
centroid have come? In the plane through the sphere's centre and the centroid's old and new place, a point seen from the
middle of the move at an angle t to it has come nearer by at most drift * cos(t), since the point's distances to the two
places sum to at least twice its distance to the middle. The sphere's least such angle is that of its centre less
arcsin(radius / distance of the centre). So the bound is loosened by drift * cos(least angle): by nothing if the whole
sphere lies behind the move, by the full drift only if the sphere lies ahead or holds the middle. Of all other centroids
the largest such number counts (`loosened`).

A round measures each vector's distance to its own centroid. Where that is below the loosened bound the cluster cannot
have changed; the vector is ambiguous otherwise, and is compared with all centroids exactly. Bounds are doubles with a
margin of MARGIN, which is far above their rounding; decisions that they leave are integers.

A round is one pass over the vectors, written to the shared folder as the next round's input, and one sum by cluster with
a map side. Only centroids, counts and radii (k rows) reach the driver.

Defined cases: vectors that are null, of another length than `width`, or hold null or non-finite components take no part.
Each other row counts, also where rows repeat; a null vec_id is no first centroid unless there are too few others. Rows
that tie as first centroids are ordered by their vectors. With fewer rows than k there are fewer centroids; equal
centroids leave those of greater numbers empty, and these stay. Components beyond +-LARGEST after scaling count as that,
so that distances fit 64 bits. Columns other than vec_id and embedding are not read. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import scratch

K = 40
ROUNDS = 5
WIDTH = 64
SCALE = 256
SALT = 2
LARGEST = 1 << 27
#: Components up to this have squared distances that a double holds exactly.
EXACT = 1 << 21
MARGIN = 1e-9

STATE = "vec_id long, x array<int>, cluster int, distance long, lower double, scanned boolean"


def scaled(vectors: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """vec_id and x of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce((x == x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    rows = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") == width)).where(finite)
    whole = lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x, F.lit(1e15)), F.lit(-1e15)) * scale), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int")
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, whole).alias("x"))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to rows."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - one) ** 2).sum(1) for one in c], axis=1)


def scan(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number), squared distance, and a bound of the distance to all others."""
    d = squared(x, c)
    best = d.argmin(1)
    rows = np.arange(len(x))
    own = d[rows, best]
    d[rows, best] = np.iinfo(np.int64).max
    return best, own, np.sqrt(d.min(1).astype(np.float64)) * (1 - MARGIN)


def loosened(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster, by how much the lower bounds of its vectors are loosened when the centroids move."""
    a, b = old.astype(np.float64), new.astype(np.float64)
    move, middle = b - a, (a + b) / 2
    drift = np.sqrt((move**2).sum(1))
    out = np.zeros(len(a))
    for i in range(len(a)):
        to = a[i] - middle  # from each move's middle to the sphere's centre
        far = np.sqrt((to**2).sum(1))
        inside = far <= radius[i] * (1 + MARGIN)
        with np.errstate(divide="ignore", invalid="ignore"):
            angle = np.arccos(np.clip((to * move).sum(1) / (far * drift), -1, 1)) - np.arcsin(np.clip(radius[i] * (1 + MARGIN) / far, 0, 1))
            nearer = drift * np.where(inside, 1, np.maximum(np.cos(np.maximum(angle, 0)), 0))
        nearer = np.where(drift == 0, 0, nearer * (1 + MARGIN) + MARGIN)
        nearer[i] = 0
        out[i] = nearer.max(initial=0)
    return out


def _assigned(c: np.ndarray, loose: np.ndarray | None):
    """A round over (vec_id, x) or, with bounds, over the rows of the round before."""

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("x")
            x = flat.flatten().to_numpy().astype(np.int64).reshape(-1, c.shape[1])
            if loose is None:
                ask = np.ones(len(x), np.bool_)
                best, own, lower = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), np.zeros(len(x))
            else:
                best = batch.column("cluster").to_numpy().astype(np.int64)
                lower = batch.column("lower").to_numpy() - loose[best]
                own = ((x - c[best]) ** 2).sum(1)
                ask = ~(np.sqrt(own.astype(np.float64)) * (1 + MARGIN) < lower)
            if ask.any():
                best, own, lower = best.copy(), own.copy(), lower.copy()
                best[ask], own[ask], lower[ask] = scan(x[ask], c)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), flat, pa.array(best, pa.int32()), pa.array(own, pa.int64()), pa.array(lower, pa.float64()), pa.array(ask)],
                ["vec_id", "x", "cluster", "distance", "lower", "scanned"],
            )

    return assigned


def _round(rows: DataFrame, c: np.ndarray, loose: np.ndarray | None) -> tuple[DataFrame, str]:
    spark, path = rows.sparkSession, scratch(rows.sparkSession, "clusters")
    rows.mapInArrow(_assigned(c, loose), STATE).write.parquet(path)
    return spark.read.schema(STATE).parquet(path), path


def _moved(state: DataFrame, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The centroids after a round, floor(sum / count), and the radii of the clusters around the old ones."""
    sums = [F.sum(F.col("x")[i].cast("long")).alias(f"s{i}") for i in range(c.shape[1])]
    new, radius = c.copy(), np.zeros(len(c))
    for r in state.groupBy("cluster").agg(F.count("*").alias("n"), F.max("distance").alias("far"), *sums).collect():  # k rows
        new[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(c.shape[1])]
        radius[r["cluster"]] = np.sqrt(float(r["far"]))
    return new, radius


def _dropped(df: DataFrame, path: str) -> None:
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clustered(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, salt: int = SALT) -> tuple[DataFrame | None, np.ndarray]:
    """The rows of STATE after the last assignment, None without vectors, and the centroids. scanned: whether the last
    assignment had to compare the vector with all centroids."""
    rows = scaled(vectors, width, scale)
    mark = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(mark.asc_nulls_last(), "x").limit(k).collect()
    c = np.array([r["x"] for r in first], np.int64).reshape(-1, width)
    if not len(c):
        return None, c
    state, path = _round(rows, c, None)
    for _ in range(rounds):
        new, radius = _moved(state, c)
        after, next_path = _round(state, new, loosened(c, new, radius))
        _dropped(state, path)
        c, state, path = new, after, next_path
    return state, c


def cluster_report(vectors: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector that takes part."""
    spark = vectors.sparkSession
    state, c = clustered(vectors)
    if state is None:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    sums = {r["cluster"]: r["s"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    total = sum(sums.values())
    known = [(j, sums[j], total, hashlib.sha256(",".join(map(str, c[j].tolist())).encode()).hexdigest()) for j in sorted(sums)]
    per_cluster = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(per_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def _oracle() -> str:
    square = "list_sum(list_transform(list_zip(v.x, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS x FROM embeddings"
        f" WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e::DOUBLE))) = {WIDTH})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SALT}:' || vec_id), x) - 1 AS j, x AS c FROM v ORDER BY sha256('{SALT}:' || vec_id), x LIMIT {K})",
    ]
    for n in range(ROUNDS + 1):
        parts.append(f"a{n} AS MATERIALIZED (SELECT r, min({{'d': {square}, 'j': c.j}}) AS m FROM v, c{n} c GROUP BY r)")
        if n < ROUNDS:
            sums = f"SELECT m.j AS j, i, sum(x[i]) AS s, count(*) AS n FROM a{n} JOIN v USING (r), (SELECT unnest(range(1, {WIDTH + 1})) AS i) GROUP BY ALL"
            means = f"SELECT j, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM ({sums}) GROUP BY j"
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT o.j, coalesce(m.c, o.c) AS c FROM c{n} o LEFT JOIN ({means}) m ON o.j = m.j)")
    return f"""WITH {', '.join(parts)}
SELECT vec_id, m.j::INT AS cluster, m.d AS distance, sum(m.d) OVER (PARTITION BY m.j)::BIGINT AS cluster_inertia, sum(m.d) OVER ()::BIGINT AS inertia,
sha256(array_to_string(list_transform(c.c, lambda e: e::VARCHAR), ',')) AS centroid_sha256 FROM a{ROUNDS} a JOIN v USING (r) JOIN c{ROUNDS} c ON c.j = a.m.j"""


#: The same in DuckDB's SQL, each vector against each centroid in every round.
ORACLE_SQL = _oracle()
