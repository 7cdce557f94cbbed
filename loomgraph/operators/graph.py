"""Graph operators over edges (source, target), as joins; loops settle a table each round.

Nodes are of any type that can be ordered. Edges are a simple digraph: `digraph` drops repeats and self loops.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.constants import ENTRY_STEMS
from loomgraph.operators.storage import numbered, settled

#: A graph with more nodes or edges is not sent to tasks; numbers that a task searches at once.
EDGES_IN_TASK = 2_000_000
CELLS = 4_000_000
#: Edges of a graph whose components one task finds.
SMALL_GRAPH = 100_000
#: Open paths dealt to a task, the most tasks of a component, and nodes looked at that count as a step of a walk.
PATHS_IN_TASK = 50
MOST_DEALT = 256
REACH_STEP = 100


def digraph(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target").where("source <> target").distinct()


def last_wins(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """One value for each key: that of the last row in order."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def resolve(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports: rel_path, pos, name; files: rel_path, stem, scan_ordinal. Local edges in order of the imports.

    A name stands for the last file with that stem; a relative name that is no stem itself is looked up by its own
    stem. Files do not depend on themselves; a target counts once, at its first import.
    """
    stems = last_wins(files, "stem", "rel_path", "scan_ordinal")
    direct = stems.select(F.col("stem").alias("s1"), F.col("rel_path").alias("t1"))
    other = stems.select(F.col("stem").alias("s2"), F.col("rel_path").alias("t2"))
    own_name = F.substring_index("name", "/", -1)
    own_stem = F.when(F.col("name").startswith("."), F.regexp_replace(own_name, r"(?<=.)\.[^.]+$", ""))
    joined = imports.join(direct, (F.col("name") == F.col("s1")) & (F.col("t1") != F.col("rel_path")), "left").join(
        other, (own_stem == F.col("s2")) & F.col("t1").isNull() & (F.col("t2") != F.col("rel_path")), "left"
    )
    found = joined.select(F.col("rel_path").alias("source"), F.coalesce("t1", "t2").alias("target"), "pos").where("target is not null")
    return found.groupBy("source", "target").agg(F.min("pos").alias("pos"))


def degrees(nodes: DataFrame, edges: DataFrame, key: str = "node") -> DataFrame:
    """in_degree and out_degree of each node, 0 without edges."""
    incoming = edges.groupBy("target").agg(F.count("*").cast("int").alias("in_degree"))
    outgoing = edges.groupBy("source").agg(F.count("*").cast("int").alias("out_degree"))
    joined = nodes.join(incoming, F.col(key) == F.col("target"), "left").join(outgoing, F.col(key) == F.col("source"), "left")
    return joined.drop("source", "target").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("in_degree", "out_degree")})


def role(stem: Column | None = None) -> Column:
    """entry, dead or null, from in_degree and out_degree; the first rule that fits. Stems are told in any case."""
    named = F.lower(stem).isin(ENTRY_STEMS) if stem is not None else F.lit(False)
    return F.when((F.col("in_degree") == 0) & (F.col("out_degree") > 0), "entry").when(F.col("in_degree") == 0, "dead").when(named, "entry")


def induced(edges: DataFrame, nodes: DataFrame, key: str = "node") -> DataFrame:
    """Edges with both ends among the nodes."""
    first = edges.join(nodes.select(F.col(key).alias("source")), "source", "left_semi")
    return first.join(nodes.select(F.col(key).alias("target")), "target", "left_semi").select(*edges.columns)


def ego_network(edges: DataFrame, node) -> DataFrame:
    return edges.where((F.col("source") == node) | (F.col("target") == node)).distinct()


def neighbours(nodes: DataFrame, edges: DataFrame, key: str = "node") -> DataFrame:
    """dependents and dependencies of each node, sorted."""
    dependents = edges.groupBy("target").agg(F.sort_array(F.collect_set("source")).alias("dependents"))
    dependencies = edges.groupBy("source").agg(F.sort_array(F.collect_set("target")).alias("dependencies"))
    joined = nodes.join(dependents, F.col(key) == F.col("target"), "left").join(dependencies, F.col(key) == F.col("source"), "left")
    kind = f"array<{dict(edges.dtypes)['source']}>"
    empty = F.array().cast(kind)
    return joined.drop("source", "target").withColumns({c: F.coalesce(c, empty) for c in ("dependents", "dependencies")})


def _unwound(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, bool]:
    """Edges (source, target, steps) drawn in towards the start of the graph until they can be no more, and whether all are.

    A node without incoming edges gets one from null, of 0 steps. In each round an edge whose source has only one way in
    is drawn back over it: all edges at once, so a chain is halved by each round, and a node whose ways in all come from
    null has its longest way from a start in steps. Of equal edges the longest counts. What lies behind a cycle is never
    drawn in; a round that frees no node ends the loop. A hub's edges meet its one way in through a plain join.
    """
    ends = nodes.select(F.col("node").alias("target")).distinct()
    inner = edges.join(ends, "target", "left_semi").join(ends.select(F.col("target").alias("source")), "source", "left_semi").select("source", "target")
    inner = settled(inner, "edges")
    starts = ends.join(inner.select("target"), "target", "left_anti")
    kind = dict(ends.dtypes)["target"]
    now = settled(inner.select("source", "target", F.lit(1).alias("steps")).unionByName(starts.select(F.lit(None).cast(kind).alias("source"), "target", F.lit(0).alias("steps"))), "ways")
    freed, wanted = 0, ends.count()
    while True:
        ways = now.groupBy("target").agg(F.count("*").alias("n"), F.min("source").alias("before"), F.max("steps").alias("more")).where("n = 1")
        single = settled(ways.select(F.col("target").alias("at"), "before", "more"), "level")
        n = single.where("before is null").count()
        if n == wanted or n == freed:
            return now, n == wanted
        freed = n
        drawn = now.join(single, F.col("source") == F.col("at"), "left")
        moved = drawn.select(F.when(F.col("at").isNull(), F.col("source")).otherwise(F.col("before")).alias("source"), "target", (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))
        now = settled(moved.groupBy("source", "target").agg(F.max("steps").alias("steps")), "ways")


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()


def on_cycles_only(edges: DataFrame) -> DataFrame:
    """Edges that lie on a cycle or between two: those whose ends neither start nor finish outside of cycles."""
    now = settled(digraph(edges), "edges")
    for turn in (False, True):
        way = now.select(F.col("target").alias("source"), F.col("source").alias("target")) if turn else now
        ways, done = _unwound(_ends(way), way)
        if done:
            return now.limit(0)
        caught = settled(ways.where("source is not null").select(F.col("target").alias("node")).distinct(), "caught")
        now = settled(induced(now, caught).select("source", "target"), "edges")
    return now


def _explored(budget: int):
    """Walks the open paths of a component in a task, depth first, until `budget` cycles and steps; what is open then
    comes back and is dealt out anew."""

    def explored(paths: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        after, before = defaultdict(list), defaultdict(list)
        for u, v in zip(edges["source"].tolist(), edges["target"].tolist(), strict=True):
            after[u].append(v)
            before[v].append(u)
        stack = [list(m) for m in paths["members"]]
        done, spent = [], 0
        while stack and spent < budget:
            path = stack.pop()
            start, taken = path[0], set(path)
            # the nodes from which the start can still be reached beside the path
            back, reach = [start], set()
            while back:
                for u in before[back.pop()]:
                    if u > start and u not in taken and u not in reach:
                        reach.add(u)
                        back.append(u)
            for v in after[path[-1]]:
                if v == start:
                    done.append(path)
                elif v in reach:
                    stack.append([*path, v])
            spent += 1 + len(reach) // REACH_STEP
        component = paths["component"].iloc[0] if len(paths) else None
        rows = [(component, True, m) for m in done] + [(component, False, m) for m in stack]
        return pd.DataFrame(rows, columns=["component", "is_cycle", "members"])

    return explored


def cycles(edges: DataFrame, most_paths: int = 1_000_000, budget: int = 20_000) -> DataFrame:
    """All elementary cycles: members (from the least on) and length.

    Only edges within a strongly connected component count. From each node as the least one, paths grow through greater
    nodes, and only to nodes from which the start can still be reached beside the path: every open path ends in a cycle
    at least, so the work is bound by the cycles and not by the paths. A task walks the paths dealt to it depth first
    and hands back what is open after `budget` steps; these are dealt out anew, so a component with very many cycles is
    spread over all tasks. A task holds the edges of one component and at most as many open paths as its steps.

    Their number can be exponential in the edges: beyond most_paths closed paths this raises rather than leave any out.
    """
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["source"]
    parts = settled(strong_components(edges), "components")
    first = parts.select(F.col("node").alias("source"), "component")
    last = parts.select(F.col("node").alias("target"), F.col("component").alias("other"))
    inner = settled(digraph(edges).join(first, "source").join(last, "target").where("component = other").select("component", "source", "target"), "inner")
    rows = parts.select("component", F.lit(False).alias("is_cycle"), F.array("node").alias("members"))
    schema, found, total = f"component {kind}, is_cycle boolean, members array<{kind}>", [], 0
    while (n := rows.where("not is_cycle").count()):
        deal = min(MOST_DEALT, 1 + n // PATHS_IN_TASK)
        paths = rows.where("not is_cycle").withColumn("part", F.pmod(F.xxhash64("members"), F.lit(deal)))
        graphs = inner.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deal - 1).cast("long"))))
        rows = settled(paths.groupBy("component", "part").cogroup(graphs.groupBy("component", "part")).applyInPandas(_explored(budget), schema), "paths")
        found.append(rows.where("is_cycle").select("members"))
        total += found[-1].count()
        if total > most_paths:
            raise RuntimeError(f"{total} cycles and more; the limit is {most_paths}")
    none = spark.createDataFrame([], f"members array<{kind}>")
    return settled(reduce(DataFrame.unionAll, found, none), "cycles").withColumn("length", F.size("members"))


def ancestors(edges: DataFrame, roots: DataFrame, key: str = "root") -> DataFrame:
    """root and ancestor: all nodes from which a root is reached, itself left out.

    Roots are numbered, and a node has one row of 64 bits for each 64 roots; a round hands the bits that a node has just
    gained to the nodes before it, in one aggregate with a map side. Pairs of root and node are made once, at the end.
    """
    back = settled(digraph(edges).select(F.col("target").alias("at"), F.col("source").alias("next")), "back")
    placed = settled(numbered(roots.select(F.col(key).alias("root")).where("root is not null").distinct(), ["root"]).select("root", F.floor(F.col("place") / 64).alias("word"), (F.col("place") % 64).cast("int").alias("bit")), "roots")
    one = F.expr("shiftleft(1L, bit)")
    now = settled(placed.select(F.col("root").alias("node"), "word", one.alias("bits"), one.alias("gained")), "bits")
    while not now.where("gained <> 0").isEmpty():
        sent = now.where("gained <> 0").select("node", F.col("word").alias("w"), F.col("gained").alias("bits"))
        come = sent.join(back, F.col("node") == F.col("at")).groupBy(F.col("next").alias("n"), "w").agg(F.bit_or("bits").alias("come"))
        both = now.join(come, (F.col("node") == F.col("n")) & (F.col("word") == F.col("w")), "full")
        have, more = F.coalesce("bits", F.lit(0).cast("long")), F.coalesce("come", F.lit(0).cast("long"))
        now = settled(both.select(F.coalesce("node", "n").alias("node"), F.coalesce("word", "w").alias("word"), have.bitwiseOR(more).alias("bits"), more.bitwiseAND(F.bitwise_not(have)).alias("gained")), "bits")
    pairs = now.select(F.col("node").alias("ancestor"), "word", F.explode(F.expr("filter(sequence(0, 63), b -> getbit(bits, b) = 1)")).alias("bit"))
    return pairs.join(placed, ["word", "bit"]).where("root <> ancestor").select("root", "ancestor")


def _onward(at: np.ndarray, first: np.ndarray, degree: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For nodes `at`: which of them each of their edges is of, and the edge, one after the other."""
    many = degree[at]
    of = np.repeat(np.arange(len(at)), many)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + first[at][of]


def _dependencies(src: np.ndarray, dst: np.ndarray, n: int, most_cells: int):
    """Sums of the dependencies of all starts dealt to a task, over a graph of numbered nodes that fits it.

    Only what a start reaches is looked at. A level is the sorted numbers start * n + node and their shortest paths.
    """

    def dependencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heads = dst[np.argsort(src, kind="stable")].astype(np.int64)
        degree = np.bincount(src, minlength=n)
        first = np.cumsum(degree) - degree
        total = np.zeros(n)
        at_once = max(1, most_cells // max(n, len(src)))
        for batch in batches:
            for i in range(0, len(batch), at_once):
                starts = batch["start"].to_numpy()[i : i + at_once].astype(np.int64)
                row = np.arange(len(starts)) * n
                levels, seen = [(row + starts, np.ones(len(starts)))], row + starts
                while True:
                    keys, paths = levels[-1]
                    of, edge = _onward(keys % n, first, degree)
                    reached, place = np.unique(keys[of] - keys[of] % n + heads[edge], return_inverse=True)
                    if not len(reached):
                        break
                    paths = np.bincount(place, weights=paths[of], minlength=len(reached))
                    new = seen[np.minimum(np.searchsorted(seen, reached), len(seen) - 1)] != reached
                    if not new.any():
                        break
                    levels.append((reached[new], paths[new]))
                    # two sorted runs
                    seen = np.sort(np.concatenate([seen, reached[new]]), kind="stable")
                below, more, share = *levels[-1], np.zeros(len(levels[-1][0]))
                for keys, paths in reversed(levels[1:-1]):
                    of, edge = _onward(keys % n, first, degree)
                    ahead = keys[of] - keys[of] % n + heads[edge]
                    at = np.minimum(np.searchsorted(below, ahead), len(below) - 1)
                    part = np.where(below[at] == ahead, (1 + share[at]) / more[at], 0.0)
                    below, more, share = keys, paths, paths * np.bincount(of, weights=part, minlength=len(keys))
                    total += np.bincount(keys % n, weights=share, minlength=n)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"place": some, "s": total[some]})

    return dependencies


def betweenness(nodes: DataFrame, edges: DataFrame, key: str = "node", most_edges: int = EDGES_IN_TASK, most_rows: int = 10**9, most_pairs: int = 10**13) -> DataFrame:
    """node and centrality: the share of shortest paths that pass through it, directed, over (n - 1)(n - 2).

    A graph of at most most_edges nodes and edges goes to all tasks as two arrays of numbers; the starts are dealt out,
    and each task searches several at once, looks only at what they reach, and keeps one running sum a node. Larger graphs stay tables
    (`betweenness_by_joins`). Both give the same numbers, up to the order of sums. The work
    grows with the edges that each node reaches; beyond most_pairs pairs of nodes this raises.
    """
    spark = nodes.sparkSession
    step = settled(digraph(edges), "steps")
    everyone = settled(numbered(nodes.select(F.col(key).alias("node")).distinct(), ["node"]).select("node", "place"), "numbered")
    n = everyone.count()
    if n * n > most_pairs:
        raise RuntimeError(f"{n} nodes have more than {most_pairs} pairs")
    if not 0 < n <= most_edges or step.count() > most_edges:
        return betweenness_by_joins(everyone, step, n, most_rows)
    ends = step
    for end in ("source", "target"):
        ends = ends.join(everyone.select(F.col("node").alias(end), F.col("place").cast("int").alias(f"{end}_place")), end)
    pairs = ends.select("source_place", "target_place").toPandas()  # at most most_edges rows
    if not len(pairs):
        return everyone.select("node", F.lit(0.0).alias("centrality"))
    tasks = min(n, 4 * spark.sparkContext.defaultParallelism)
    search = _dependencies(pairs["source_place"].to_numpy(), pairs["target_place"].to_numpy(), n, CELLS)
    sums = spark.range(0, n, 1, tasks).select(F.col("id").alias("start")).mapInPandas(search, "place long, s double").groupBy("place").agg(F.sum("s").alias("s"))
    scale = (n - 1) * (n - 2) if n > 2 else 1
    return everyone.join(sums, "place", "left").select("node", (F.coalesce("s", F.lit(0.0)) / scale).alias("centrality"))


def betweenness_by_joins(everyone: DataFrame, edges: DataFrame, n: int, most_rows: int = 10**9) -> DataFrame:
    """betweenness without the graph in any task. everyone: node and place from 0.

    Breadth-first search from a batch of starts at once, a level a round, then the dependencies back, a level a round:
    rows of (start, node) are shuffled. A batch has at most most_rows such rows; after it only its sums by node stay,
    settled, so rows alive do not grow with the square of the nodes.
    """
    step = edges.select(F.col("source").alias("from"), F.col("target").alias("to"))
    batch, sums = max(1, most_rows // max(n, 1)), None
    for first in range(0, n, batch):
        starts = everyone.where((F.col("place") >= first) & (F.col("place") < first + batch))
        front = settled(starts.select(F.col("node").alias("start"), "node", F.lit(1.0).alias("paths")), "level")
        levels, seen = [front], front.select("start", "node")
        while True:
            reached = front.join(step, F.col("node") == F.col("from")).groupBy("start", F.col("to").alias("node")).agg(F.sum("paths").alias("paths"))
            front = settled(reached.join(seen, ["start", "node"], "left_anti"), "level")
            if front.isEmpty():
                break
            levels.append(front)
            seen = seen.unionAll(front.select("start", "node"))
        share, parts = None, [] if sums is None else [sums.select("node", F.col("s").alias("share"))]
        for level, before in zip(reversed(levels[1:]), reversed(levels[:-1]), strict=True):
            below = level.withColumn("share", F.lit(0.0)) if share is None else level.join(share, ["start", "node"], "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
            parts.append(below.select("node", "share"))
            up = below.select("start", F.col("node").alias("to"), F.col("paths").alias("p"), "share")
            share = settled(
                before.join(step, F.col("node") == F.col("from")).join(up, ["start", "to"])
                .groupBy("start", "node").agg(F.sum(F.col("paths") / F.col("p") * (1 + F.col("share"))).alias("share")),
                "share",
            )
        if parts:
            sums = settled(reduce(DataFrame.unionAll, parts).groupBy("node").agg(F.sum("share").alias("s")), "sums")
    if sums is None:
        return everyone.select("node", F.lit(0.0).alias("centrality"))
    scale = (n - 1) * (n - 2) if n > 2 else 1
    return everyone.select("node").join(sums, "node", "left").select("node", (F.coalesce("s", F.lit(0.0)) / scale).alias("centrality"))


def most_central(metrics: DataFrame, key: str = "node", order: str = "node") -> DataFrame:
    """The node of the greatest centrality, ties to the first in order."""
    best = F.max_by(F.struct(key, "centrality"), F.struct("centrality", -F.col(order)))
    return metrics.agg(best.alias("x")).select("x.*")


def topo_levels(nodes: DataFrame, edges: DataFrame, key: str = "node") -> DataFrame | None:
    """node and level, the longest path from a node without incoming edges; None if the graph has a cycle.

    Edges with an end that is no node do not count. Chains and trees take rounds by the logarithm of their depth; any
    other graph takes as many as it has levels at most.
    """
    ways, done = _unwound(nodes.select(F.col(key).alias("node")), digraph(edges))
    return ways.select(F.col("target").alias("node"), F.col("steps").alias("level")) if done else None


def level_layout(levels: DataFrame) -> DataFrame:
    """x and y of each node by its place in its level."""
    top = levels.agg(F.greatest(F.max("level"), F.lit(1)).alias("top"))
    placed = numbered(levels.select("node", "level"), ["node"], ["level"]).crossJoin(F.broadcast(top))  # one row
    return placed.select("node", "level", ((F.col("place") - F.col("size") / 2) * 2 / F.greatest("size", F.lit(1))).alias("x"), (1 - F.col("level") / F.col("top")).alias("y"))


def circular_layout(nodes: DataFrame, key: str = "node") -> DataFrame:
    angle = 2 * F.pi() * F.col("place") / F.col("size")
    placed = numbered(nodes.select(F.col(key).alias("node"), F.lit(0).alias("all")), ["node"], ["all"])
    return placed.select("node", F.cos(angle).alias("x"), F.sin(angle).alias("y"))


def _least(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """The least node that reaches each node."""
    least = np.arange(n)
    while True:
        after = least.copy()
        np.minimum.at(after, dst, least[src])
        if (after == least).all():
            return least
        least = after


def _components_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """strong_components of a small graph."""
    held = list(frames)
    if not held:
        return  # no edges
    edges = pd.concat(held)
    names, places = np.unique(np.concatenate([edges["source"], edges["target"]]), return_inverse=True)
    src, dst = places[: len(edges)], places[len(edges) :]
    found = np.full(len(names), -1)
    while len(src):
        first, last = _least(src, dst, len(names)), _least(dst, src, len(names))
        own = (first == last) & (found < 0)
        found[own] = first[own]
        inside = (first[src] == first[dst]) & (last[src] == last[dst]) & (first[src] != last[src])
        src, dst = src[inside], dst[inside]
    more = np.bincount(found[found >= 0], minlength=len(names)) > 1
    kept = np.flatnonzero((found >= 0) & more[found])
    yield pd.DataFrame({"node": names[kept], "component": names[found[kept]]})


def _colored(edges: DataFrame) -> DataFrame:
    """node, first and last: the least node that reaches it and the least that it reaches."""
    step = settled(edges.select(F.col("source").alias("from"), F.col("target").alias("to")), "edges")
    state = settled(_ends(edges).select("node", F.col("node").alias("first"), F.col("node").alias("last")), "colors")
    none = F.lit(None).cast(dict(state.dtypes)["node"])
    while True:
        down = state.join(step, F.col("node") == F.col("from")).select(F.col("to").alias("at"), "first", none.alias("last"))
        up = state.join(step, F.col("node") == F.col("to")).select(F.col("from").alias("at"), none.alias("first"), "last")
        come = down.unionAll(up).groupBy("at").agg(F.min("first").alias("f"), F.min("last").alias("l"))
        both = state.join(come, F.col("node") == F.col("at"), "left")
        changed = (F.col("f") < F.col("first")) | (F.col("l") < F.col("last"))
        after = settled(both.select("node", F.least("first", "f").alias("first"), F.least("last", "l").alias("last"), F.coalesce(changed, F.lit(False)).alias("changed")), "colors")
        state = after.select("node", "first", "last")
        if after.where("changed").isEmpty():
            return state


def strong_components(edges: DataFrame, small: int = SMALL_GRAPH) -> DataFrame:
    """node and component (its least node) of the nodes in strongly connected components of two nodes and more.

    Each node gets the least node that reaches it and the least that it reaches. Where both are the same node, that is
    its component's name; all others go on with the edges whose ends agree in both, since a component's nodes do. No
    cycle is listed, so the work does not grow with their number. A graph of at most `small` edges is done by one task.
    """
    rest, found = settled(digraph(edges), "edges"), []
    kind = dict(edges.dtypes)["source"]
    if rest.count() <= small:
        return rest.repartition(1).mapInPandas(_components_of, f"node {kind}, component {kind}")
    rest = on_cycles_only(rest)
    while not rest.isEmpty():
        colors = settled(_colored(rest), "colors")
        own = colors.where("first = last").select("node", F.col("first").alias("component"))
        alone = own.groupBy("component").agg(F.count("*").alias("n")).where("n = 1")
        found.append(settled(own.join(alone, "component", "left_anti").select("node", "component"), "component"))
        ends = [colors.where("first <> last").select(F.col("node").alias(end), F.struct("first", "last").alias(f"of_{end}")) for end in ("source", "target")]
        rest = settled(rest.join(ends[0], "source").join(ends[1], "target").where("of_source = of_target").select("source", "target"), "edges")
    return reduce(DataFrame.unionAll, found) if found else edges.sparkSession.createDataFrame([], f"node {kind}, component {kind}")


def on_a_cycle(edges: DataFrame) -> DataFrame:
    """node: those on some cycle."""
    return strong_components(edges).select("node")


def in_cycle(cycle_rows: DataFrame) -> DataFrame:
    return cycle_rows.select(F.explode("members").alias("node")).distinct()


def edge_class(edges: DataFrame, on_cycle: DataFrame, highlighted=None) -> DataFrame:
    """class: highlight if either end is the highlighted node, circular if either end is on a cycle, else regular."""
    flagged = edges
    for end in ("source", "target"):
        flagged = flagged.join(on_cycle.select(F.col("node").alias(end), F.lit(True).alias(f"{end}_on")), end, "left")
    either = F.coalesce("source_on", F.lit(False)) | F.coalesce("target_on", F.lit(False))
    kind = F.when(either, "circular").otherwise("regular")
    if highlighted is not None:
        kind = F.when((F.col("source") == highlighted) | (F.col("target") == highlighted), "highlight").otherwise(kind)
    return flagged.select("source", "target", kind.alias("class"))


def trimmed(metrics: DataFrame, edges: DataFrame, most: int = 120, key: str = "node", highlighted: list | None = None) -> tuple[DataFrame, DataFrame]:
    """The top nodes by 10 * centrality + in_degree + 5 * entry + 20 * highlighted, and the edges among them."""
    entry = F.when(F.col("is_entry"), 5).otherwise(0)
    light = F.when(F.col(key).isin(highlighted), 20).otherwise(0) if highlighted else F.lit(0)
    score = 10 * F.col("centrality") + F.col("in_degree") + entry + light
    kept = metrics.withColumn("score", score).orderBy(F.desc("score"), key).limit(most)
    return kept, induced(edges, kept, key)
