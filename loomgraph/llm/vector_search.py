"""Approximate nearest neighbours by vantage-point trees, one a shard.

A small tree over a bounded sample (at most SAMPLE vectors) divides the space: at each of its nodes a vector goes inside
or outside by its distance to the vantage point, so every vector has one region and every region a lower bound of its
distance from any query, by the triangle inequality. Regions of more than `shard_rows` vectors are salted, so no shard
grows with the table. Each task builds the trees of its shards from the vectors dealt to it, one shard at a time, and
streams the queries of a shard past its tree:

* A node keeps its vantage point and the least and greatest distance to it on either side. A query at distance d from the
  vantage point is at least max(d - greatest, least - d) from all vectors of a side. A side is left out if that bound
  times `factor` exceeds the query's k-th best distance so far. With factor 1 the search is exact; a greater factor leaves
  out more, and neighbours behind a boundary may be missed.
* A query is first searched in a shard of its own region, which gives it a k-th best distance, and then in the shards of
  the regions that the same rule leaves, starting from that distance.

Leaves are compared by a matrix product; what may be among the best is then measured exactly, as the root of the sum of
squared differences in double precision, so scores and their order are exact for all that is found.

A vector that very many rows hold is no hot group: of equal vectors only the k + 1 with the smallest ids can be among
anyone's k nearest, so the others are dropped by a limit that Spark applies before the shuffle, and equal queries are
searched once. Queries of a shard beyond `query_block` are dealt to several tasks.

Defined cases: vectors that are null, zero or hold a null or non-finite component take no part, nor do those of another
length than most (of equally frequent lengths the smaller one counts), nor rows without vec_id. Rows that repeat vec_id
and vector are one; rows that share vec_id and not the vector are different candidates, and each is a query. Columns other
than vec_id and embedding are not read. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import written

BEST = 10
#: A lower bound is multiplied by this before it is compared; 1 is exact.
FACTOR = 5.0
SHARD_ROWS = 16_384
LEAF = 64
#: The sample that the regions are fitted on, and their greatest number; larger regions are salted.
SAMPLE = 20_000
MOST_REGIONS = 4_096
QUERY_BLOCK = 50_000
#: Queries that are searched together, and the share by which approximate distances may be off.
TOGETHER = 512
SLACK = 1e-9


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean, row by row, in double precision."""
    return np.sqrt(((a - b) ** 2).sum(-1))


class Tree:
    """Vectors ordered by a vantage-point tree; node: (first, last, vantage, middle, inside's and outside's least and
    greatest distance, inside, outside), a leaf without vantage."""

    def __init__(self, x: np.ndarray, leaf: int):
        self.order, self.nodes = np.arange(len(x)), []
        self.x, self.leaf = x, leaf
        self.root = self._built(0, len(x), len(x) > leaf)
        self.x = x[self.order]
        self.norms = (self.x**2).sum(1)

    def _built(self, first: int, last: int, divided: bool) -> int:
        own = len(self.nodes)
        self.nodes.append(None)
        if not divided:
            self.nodes[own] = (first, last, None)
            return own
        part = self.x[self.order[first:last]]
        vantage = part[distances(part, part.mean(0)).argmax()]
        d = distances(part, vantage)
        by = np.argsort(d, kind="stable")
        self.order[first:last] = self.order[first:last][by]
        d, half = d[by], (last - first) // 2
        bounds = (d[0], d[half - 1], d[half], d[-1])
        middle = first + half
        inside = self._built(first, middle, half > self.leaf)
        self.nodes[own] = (first, last, vantage, bounds, inside, self._built(middle, last, last - middle > self.leaf))
        return own


class Found:
    """The k best of each query of a batch, by distance and id; limit: a distance that is known to be enough."""

    def __init__(self, q: np.ndarray, limit: np.ndarray, k: int):
        self.q, self.limit, self.k = q, limit.copy(), k
        self.norms = (q**2).sum(1)
        self.row, self.d, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def add(self, which: np.ndarray, x: np.ndarray, norms: np.ndarray, ids: np.ndarray) -> None:
        """Compares the queries `which` with vectors."""
        scale = self.norms[which][:, None] + norms
        square = scale - 2 * (self.q[which] @ x.T)
        a, b = np.nonzero(~(square > self.limit[which][:, None] ** 2 + SLACK * scale))  # what is not a number stays
        if not len(a):
            return
        row = which[a]
        d = distances(self.q[row], x[b])
        touched = np.zeros(len(self.q), np.bool_)
        touched[row] = True
        again = touched[self.row]
        row, d, i = np.concatenate([self.row[again], row]), np.concatenate([self.d[again], d]), np.concatenate([self.id[again], ids[b]])
        by = np.lexsort((i, d, row))
        row, d, i = row[by], d[by], i[by]
        first = np.flatnonzero(np.diff(row, prepend=-1))
        place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        last = place == self.k - 1
        self.limit[row[last]] = np.minimum(self.limit[row[last]], d[last])
        kept = place < self.k
        self.row, self.d, self.id = (np.concatenate([old[~again], new[kept]]) for old, new in ((self.row, row), (self.d, d), (self.id, i)))


def _side_bound(d: np.ndarray, least: float, most: float) -> np.ndarray:
    return np.maximum(np.maximum(d - most, least - d), 0)


def search_tree(tree: Tree, ids: np.ndarray, found: Found, factor: float) -> int:
    """Searches all queries of found; ids: of the vectors in the tree's order. Returns the comparisons made."""
    home, compared = np.full(len(found.q), -1), 0

    def leaf(node: int, which: np.ndarray) -> int:
        first, last = tree.nodes[node][:2]
        found.add(which, tree.x[first:last], tree.norms[first:last], ids[first:last])
        return len(which) * (last - first)

    stack = [(tree.root, np.arange(len(found.q)))]
    while stack:  # each query down to its nearest leaf
        node, which = stack.pop()
        if not len(which):
            continue
        if tree.nodes[node][2] is None:
            home[which] = node
            compared += leaf(node, which)
            continue
        _, _, vantage, (_, inner, outer, _), inside, outside = tree.nodes[node]
        near = distances(found.q[which], vantage) <= (inner + outer) / 2
        stack += [(outside, which[~near]), (inside, which[near])]
    stack = [(tree.root, np.arange(len(found.q)), np.zeros(len(found.q)))]
    while stack:  # and to all that the bounds leave
        node, which, bound = stack.pop()
        alive = bound * factor <= found.limit[which]
        which = which[alive]
        if tree.nodes[node][2] is None:
            which = which[home[which] != node]
            if len(which):
                compared += leaf(node, which)
        elif len(which):
            _, _, vantage, (least, inner, outer, most), inside, outside = tree.nodes[node]
            d = distances(found.q[which], vantage)
            stack += [(outside, which, _side_bound(d, outer, most)), (inside, which, _side_bound(d, least, inner))]
    return compared


class Regions:
    """Division of the space fitted on a sample: the leaves of a vantage-point tree, by thresholds that hold for any
    vector."""

    def __init__(self, sample: np.ndarray, wanted: int):
        """A vantage point and a radius for each node of each level; where there was nothing to divide, all go inside."""
        self.depth = min(max(0, math.ceil(math.log2(max(1, wanted)))), int(math.log2(MOST_REGIONS)))
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        parts = [sample]
        for _ in range(self.depth):
            vantages, radii, halves = np.zeros((len(parts), sample.shape[1])), np.full(len(parts), np.inf), []
            for i, part in enumerate(parts):
                if len(part) < 2:
                    halves += [part, part[:0]]
                    continue
                vantages[i] = part[distances(part, part.mean(0)).argmax()]
                d = distances(part, vantages[i])
                radii[i] = np.median(d)
                halves += [part[d < radii[i]], part[d >= radii[i]]]
            self.levels.append((vantages, radii))
            parts = halves

    def home(self, x: np.ndarray) -> np.ndarray:
        """The region of each vector."""
        at = np.zeros(len(x), np.int64)
        for vantages, radii in self.levels:
            at = 2 * at + (distances(x, vantages[at]) >= radii[at])
        return at

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """Lower bounds of each vector's distance from all vectors of every region."""
        bound = np.zeros((len(x), 1))
        for vantages, radii in self.levels:
            d = np.stack([distances(x, v) for v in vantages], axis=1)
            sides = np.maximum(bound, d - radii), np.maximum(bound, radii - d)
            bound = np.stack(sides, axis=2).reshape(len(x), -1)
        return bound


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column whose lists all have `width` numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _region_of(regions: Regions, width: int):
    @F.arrow_udf(T.IntegerType())
    def region(v: pa.Array) -> pa.Array:
        return pa.array(regions.home(_matrix(v, width)) if len(v) else [], pa.int32())

    return region


def _regions_left(regions: Regions, width: int, factor: float):
    """The regions that a query has to be searched in, given a distance that is known to be enough."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def left(v: pa.Array, limit: pa.Array) -> pa.Array:
        x, most, out = _matrix(v, width), limit.to_numpy(zero_copy_only=False), []
        for at in range(0, len(x), TOGETHER):
            bound = regions.bounds(x[at : at + TOGETHER])
            out += [np.flatnonzero(b * factor <= m) for b, m in zip(bound, most[at : at + TOGETHER], strict=True)]
        return pa.array(out, pa.list_(pa.int32()))

    return left


def _searched(width: int, k: int, factor: float):
    """Rows by shard, vectors before queries: each query's k best of the shard."""

    def build(held: list[pa.RecordBatch]) -> tuple[Tree, np.ndarray] | None:
        if not held:
            return None
        tree = Tree(np.concatenate([_matrix(b.column("v"), width) for b in held]), LEAF)
        return tree, np.concatenate([b.column("id").to_numpy() for b in held])[tree.order]

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, tree = None, [], None
        for batch in batches:
            part, kind = batch.column("part").to_numpy(), batch.column("is_query").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (kind[1:] != kind[:-1]), [True]]))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if part[a] != shard:
                    shard, held, tree = part[a], [], None
                rows = batch.slice(a, b - a)
                if not kind[a]:
                    held.append(rows)
                    continue
                tree = tree or build(held)
                if tree is None:
                    continue
                held = []
                q, limit, names = _matrix(rows.column("v"), width), rows.column("limit").to_numpy(), rows.column("q").to_numpy(zero_copy_only=False)
                for at in range(0, len(q), TOGETHER):
                    found = Found(q[at : at + TOGETHER], limit[at : at + TOGETHER], k)
                    search_tree(tree[0], tree[1], found, factor)
                    yield pa.RecordBatch.from_arrays([pa.array(names[at + found.row], pa.string()), pa.array(found.id, pa.int64()), pa.array(found.d, pa.float64())], ["q", "vec_id", "score"])

    return searched


def _best(rows: DataFrame, key: list[str], k: int) -> DataFrame:
    """The k nearest of each key, with rank; Spark applies the limit before it shuffles."""
    order = Window.partitionBy(*key).orderBy("score", "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v of the rows that take part, each once."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: F.coalesce((x == x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    rows = vectors.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(finite & F.exists(v, lambda x: x != 0))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    most = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    return rows.where(F.size("v") == most[0]["width"]).distinct() if most else rows


def nearest(vectors: DataFrame, is_query: Column, k: int = BEST, factor: float = FACTOR, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of the k vectors found nearest to each row that is_query (a condition on vec_id)
    holds for; its own row is no candidate."""
    spark = vectors.sparkSession
    name = F.concat(F.hex(F.xxhash64("v")), F.hex(F.xxhash64(F.lit(1), "v")))  # equal vectors are one query
    rows = written(_usable(vectors).withColumn("q", name), "vectors")
    few = Window.partitionBy("v").orderBy("vec_id")
    points = rows.withColumn("copy", F.row_number().over(few)).where(F.col("copy") <= k + 1).select("vec_id", "v")
    asked = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "q")
    queries = rows.where(is_query).groupBy("q").agg(F.first("v").alias("v"))
    head = rows.select(F.size("v").alias("width")).limit(1).collect()
    empty = "query_id long, rank int, vec_id long, score double"
    if not head:
        return spark.createDataFrame([], empty)
    width, n, n_queries = head[0]["width"], rows.count(), queries.count()
    sample = rows.orderBy("q").select("v").limit(SAMPLE).collect() if n > shard_rows else []
    regions = Regions(np.array([r["v"] for r in sample], np.float64).reshape(-1, width), -(-n // shard_rows))
    dealt = written(points.withColumn("region", _region_of(regions, width)("v")), "dealt")
    sizes = {r["region"]: -(-r["count"] // shard_rows) for r in dealt.groupBy("region").count().collect()}  # at most MOST_REGIONS rows
    salts = [sizes.get(r, 0) for r in range(1 << regions.depth)]
    starts = [0, *np.cumsum(salts).tolist()]
    count = F.array(*[F.lit(s) for s in salts])
    start = F.array(*[F.lit(s) for s in starts])
    blocks = max(1, -(-n_queries // query_block))
    shard = start[F.col("region")] + F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)).cast("int") % count[F.col("region")]
    block = F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")
    side = dealt.select((shard * blocks).alias("part"), F.lit(False).alias("is_query"), F.col("vec_id").alias("id"), "v", F.lit(None).cast("string").alias("q"), F.lit(0.0).alias("limit"))
    if blocks > 1:
        side = side.withColumn("part", F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: F.col("part") + b)))

    def search(some: DataFrame) -> DataFrame:
        """some: q, v, shard and limit."""
        other = some.select((F.col("shard") * blocks + block).alias("part"), F.lit(True).alias("is_query"), F.lit(0).cast("long").alias("id"), "v", "q", "limit")
        both = side.unionByName(other).repartition("part").sortWithinPartitions("part", "is_query")
        return written(both.mapInArrow(_searched(width, k + 1, factor), "q string, vec_id long, score double"), "found")

    # a shard of the query's own region; where that has none, all shards follow
    at_home = queries.withColumn("region", _region_of(regions, width)("v")).where(count[F.col("region")] > 0)
    at_home = written(at_home.withColumn("shard", start[F.col("region")] + F.pmod(F.xxhash64("q"), F.lit(1 << 30)).cast("int") % count[F.col("region")]).withColumn("limit", F.lit(float("inf"))), "home")
    first = search(at_home)
    if len(starts) == 2 and starts[-1] == 1:
        found = first
    else:
        known = _best(first, ["q"], k + 1).groupBy("q").agg(F.max("score").alias("limit"), F.count("*").alias("n")).where(F.col("n") == k + 1).select("q", "limit")
        limited = queries.join(known, "q", "left").join(at_home.select("q", F.col("shard").alias("home")), "q", "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf"))))
        left = limited.withColumn("region", F.explode(_regions_left(regions, width, factor)("v", "limit")))
        shards = left.where(count[F.col("region")] > 0).withColumn("shard", F.explode(F.sequence(start[F.col("region")], start[F.col("region") + 1] - 1))).where(~F.col("shard").eqNullSafe(F.col("home")))
        found = first.unionByName(search(shards.select("q", "v", "shard", "limit")))
    near = _best(found, ["q"], k + 1).drop("rank")
    pairs = asked.join(near, "q").where((F.col("vec_id") != F.col("query_id")) | (F.col("score") > 0))
    return _best(pairs, ["query_id", "q"], k).select("query_id", "rank", "vec_id", "score")


def hundredth_search(vectors: DataFrame) -> DataFrame:
    """Rows whose vec_id is divisible by 100 against all rows."""
    return nearest(vectors, F.col("vec_id") % 100 == 0)
