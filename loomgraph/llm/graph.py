"""Connected components of links between documents, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from loomgraph.llm.common import FILE_ROWS, written


def _either(*pairs: tuple[str, str]) -> list:
    """A row for each of the pairs, as u and v."""
    return [F.explode(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs])).alias("e")]


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over (u, v), v < u.

    No step makes more partitions, so that a table of one partition is done in one task without a shuffle.
    """
    both = edges.select(*_either(("u", "v"), ("v", "u"))).select("e.*")
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumnRenamed("u", "x")
    large = both.join(low, F.col("u") == F.col("x")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "x")
    moved = large.join(least, F.col("u") == F.col("x")).select(*_either(("u", "m"), ("v", "m")))
    return moved.select("e.*").where("u > v").distinct()


def _settled(edges: DataFrame, most: int | None) -> tuple[DataFrame, tuple]:
    """The table, written, and what tells it from any other: its number of rows and two sums of 64-bit hashes.

    most: a bound on the rows, for the number of files.
    """
    seen = Observation()
    total = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(20,0)"))
    marked = edges.observe(seen, F.count("*").alias("n"), total("u", "v").alias("a"), total("v", "u", F.lit(1)).alias("b"))
    out = written(marked, "edges", None if most is None else 1 + most // FILE_ROWS)
    return out, tuple(seen.get[k] for k in ("n", "a", "b"))


def components(edges: DataFrame, most_rounds: int = 60, most: int | None = None) -> DataFrame | None:
    """edges: u, v, of any type that can be ordered. node, label of each node that has an edge, None without edges;
    label is the least node of its component. most: a bound on the edges, for the number of files.

    Rounds double the reach, so their number grows with the logarithm of the longest path. A round is one job.
    """
    now, sign = _settled(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), most)
    if not sign[0]:
        return None
    for _ in range(most_rounds):
        now, after = _settled(_stars(now.coalesce(1 + sign[0] // FILE_ROWS)), sign[0] * 2)
        if after == sign:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        sign = after
    raise RuntimeError("components did not settle")
