"""Lexical search, vector search and clustering against brute force, and on the odd cases that their docstrings define."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import centroids, lexical_search, vector_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def ranked(docs, items, k=10):
    """Every document against every item."""
    bags = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    bags = [(i, Counter(b), len(b)) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(TERM.findall((t or "").translate(LOWER)))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, b, n in bags:
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * m)) for t in terms if t in b)
            scores.append((-s, i is None, i or 0))
        best = sorted(x for x in scores if x[0] < 0)[:k]
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(best, 1)]
    return sorted(out, key=repr)


def corpus():
    draw = random.Random(3)
    vocabulary = ["the", "Of", "naïve", "日本", "x1", *(f"w{i}" for i in range(200))]
    weights = [400, 300, 100, 50, 50, *(200 / (i + 1) for i in range(200))]
    texts = [" ".join(draw.choices(vocabulary, weights, k=draw.randrange(1, 60))) for _ in range(400)]
    texts += texts[:30] + [texts[5]] * 200 + ["the " * 5000 + "W7", "A-b_c\x00d", "", "...", None]
    docs = list(enumerate(texts)) + [(None, "W7 the the"), (None, "w7 the the"), (7, texts[9]), (8, texts[8])]
    items = [(i, " ".join(draw.choices(vocabulary, k=12))) for i in range(25)] + [(25, ""), (26, None), (27, "unseen"), (28, "THE the"), (3, "w7 w8"), (None, "w7 Naïve"), (29, texts[5])]
    return docs, items


@pytest.fixture(scope="module")
def search_tables(spark):
    docs, items = corpus()
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_ranking_equals_a_full_scan(spark, search_tables):
    """Many small shards in few tasks, so that heaps are carried, and several blocks of queries."""
    docs, items = corpus()
    want = ranked(docs, items)
    for shard_terms, query_block in ((300, 7), (10**6, 512)):
        index = lexical_search.build_index(search_tables[0], shard_terms)
        got = lexical_search.search(index, search_tables[1], query_block=query_block)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and rows(got) == want


def test_lists_keep_all_postings(search_tables):
    """Packed blocks give back every frequency, and their bests are the greatest scores."""
    docs, _ = corpus()
    want = Counter()
    for i, t in docs:
        want.update({w: c for w, c in Counter(TERM.findall((t or "").translate(LOWER))).items()})
    index = lexical_search.build_index(search_tables[0], 4000).collect()
    shards = {r["shard"]: r for r in index if r["term"] == b""}
    assert sum(r["total"] for r in shards.values()) == sum(want.values())
    got, totals = Counter(), (600, 20_000)
    for r in index:
        if r["term"]:
            row = {c: np.array(r[c]) for c in ("last", "start", "widths", "best_block", "best_tf", "best_n")} | {"df": r["df"], "data": bytes(r["data"]), "weight": 3}
            lengths = np.array(shards[r["shard"]]["lengths"], np.int64)
            m = 10 + 90 * lengths * totals[0] // totals[1]
            one = lexical_search.Postings(row, m, totals)
            for b in range(len(one.last)):
                docs_, scores = one.block(b)
                assert scores.max() == one.tops[b] and docs_[-1] == one.last[b] and (np.diff(docs_) > 0).all()
            assert len(one.blocks(range(len(one.last)))[0]) == r["df"]
            got[r["term"].decode()] += r["total"]
    assert got == want


def test_blocks_are_rejected_before_they_are_unpacked():
    """A strong rare term and a weak common one: only the common list's blocks near candidates are unpacked."""
    n = 128 * 40
    strong = {"last": np.array([5000]), "start": np.array([0]), "widths": np.array([4 * 8]), "best_block": np.array([0]), "best_tf": np.array([1]), "best_n": np.array([50]), "df": 2, "weight": 9000}
    strong["data"] = np.array([70, 4930], "<u4").tobytes()
    gaps = np.ones(n, np.uint8)
    gaps[0] = 0
    weak = {"last": np.arange(40) * 128 + 127, "start": np.arange(40) * 128, "widths": np.full(40, 8), "best_block": np.arange(40), "best_tf": np.ones(40, int), "best_n": np.full(40, 50), "df": n, "weight": 10, "data": gaps.tobytes()}
    m = np.full(n, 100, np.int64)
    lists = [lexical_search.Postings(x, m, (100, 5000)) for x in (strong, weak)]
    found, scores = lexical_search.candidates(lists, lists[1].bound + 1, n)
    assert found.tolist() == [70, 5000] and len(set(scores.tolist())) == 1 and set(lists[1].seen) == {0, 39}
    lists = [lexical_search.Postings(x, m, (100, 5000)) for x in (strong, weak)]
    assert not len(lexical_search.candidates(lists, lists[0].bound + lists[1].bound + 1, n)[0]) and not lists[1].seen


def test_search_of_nothing(spark, search_tables):
    none = search_tables[0].where("false")
    assert lexical_search.rank(none, search_tables[1]).count() == 0
    assert lexical_search.rank(search_tables[0], search_tables[1].where("false")).count() == 0
    blank = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    assert lexical_search.rank(blank, search_tables[1]).count() == 0


def test_search_ignores_other_columns(spark, search_tables):
    names = ["score", "rank", "term", "block", "shard", "item_id", "weight", "lengths"]
    docs = search_tables[0].withColumns({c: F.lit("x") for c in names})
    items = search_tables[1].withColumns({c: F.lit("x") for c in ["doc_id", "score", "df", "items", "block"]})
    assert rows(lexical_search.rank(docs, items)) == ranked(*corpus())


# vectors


def brute(vectors, is_query, k=10):
    kept = sorted({(i, tuple(v)) for i, v in vectors if i is not None})
    ids, x = np.array([i for i, _ in kept]), np.array([v for _, v in kept], np.float64)
    out = []
    for a in range(len(ids)):
        if is_query(ids[a]):
            d = np.sqrt(((x - x[a]) ** 2).sum(1))
            best = [b for b in np.lexsort((ids, d)) if b != a][:k]
            out += [(int(ids[a]), r, int(ids[b]), float(d[b])) for r, b in enumerate(best, 1)]
    return sorted(out)


def cloud(n, seed, size=8):
    draw = np.random.default_rng(seed)
    return (draw.normal(size=(n, size)) + 4 * draw.integers(0, 3, (n, 1))).astype(np.float32)


def near(got, want):
    got = sorted(got)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], rel=1e-12)


def test_factor_one_is_exact(spark):
    """Regions, salted shards, blocks of queries, and a vector that a third of the rows hold."""
    x = cloud(900, 1)
    data = [(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(900 + i, [1.0] * 8) for i in range(450)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(3)
    want = brute(data, lambda i: i % 50 == 0)
    for shard_rows, query_block in ((100, 5), (10**6, 10**6)):
        near(rows(vector_search.nearest(table, F.col("vec_id") % 50 == 0, factor=1.0, shard_rows=shard_rows, query_block=query_block)), want)


def test_recall_of_the_default_factor(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    data = [(r.vec_id, r.embedding) for r in table.collect()]
    want = brute(data, lambda i: i % 100 == 0)
    for shard_rows in (vector_search.SHARD_ROWS, 250):
        got = rows(vector_search.nearest(table, F.col("vec_id") % 100 == 0, shard_rows=shard_rows))
        assert len(got) == len(want)
        assert len({(g[0], g[2]) for g in got} & {(w[0], w[2]) for w in want}) >= 0.95 * len(want)


def test_factor_saves_comparisons():
    x = cloud(4000, 2)
    tree = vector_search.Tree(x.astype(np.float64), 64)
    compared = []
    for factor in (1.0, 3.0):
        found = vector_search.Found(x[:50].astype(np.float64), np.full(50, np.inf), 5)
        compared.append(vector_search.search_tree(tree, np.arange(4000)[tree.order], found, factor))
    assert compared[1] < compared[0] < 50 * 4000


def test_regions_hold_their_bounds():
    """Every vector is in one region, and no vector of a region is nearer to a query than the region's bound."""
    x = cloud(600, 4).astype(np.float64)
    regions = vector_search.Regions(x[:50], 16)
    home, bound = regions.home(x), regions.bounds(x[:40])
    assert bound.shape == (40, 16) and set(home.tolist()) <= set(range(16)) and len(set(home.tolist())) > 8
    for q in range(40):
        assert (vector_search.distances(x, x[q]) >= bound[q, home] - 1e-9).all() and bound[q, home[q]] == 0
    same = vector_search.Regions(np.ones((5, 3)), 4)
    assert set(same.home(np.ones((3, 3))).tolist()) <= set(range(4)) and same.bounds(np.zeros((1, 3))).shape == (1, 4)
    assert vector_search.Regions(np.zeros((0, 3)), 1).home(np.ones((2, 3))).tolist() == [0, 0]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [
        (0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [1.0, None]), (6, [inf, 0.0]), (7, []),
        (8, [1.0, 2.0, 3.0]), (None, [1.0, 0.1]), (9, [0.0, -2.0]), (10, [3.0, 0.0]), (10, [0.5, 0.0]), (11, [1.0, 0.0]),
    ]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("q", "v", "limit", "score", "rank", "query_id", "region", "part")})
    valid = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (9, [0.0, -2.0]), (10, [3.0, 0.0]), (10, [0.5, 0.0]), (11, [1.0, 0.0])]
    got = vector_search.nearest(table, F.col("vec_id") % 5 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    near(rows(got), brute(valid, lambda i: i % 5 == 0))
    assert rows(got)[0] == (0, 1, 1, 0.0) and rows(got)[1] == (0, 2, 11, 0.0)
    assert vector_search.hundredth_search(table.where("false")).count() == 0
    assert vector_search.hundredth_search(table.where("vec_id in (2, 3)")).count() == 0
    assert vector_search.hundredth_search(table.where("vec_id = 1")).count() == 0


# clustering


def lloyd(data, k, rounds, width):
    kept = [(i, [math.floor(256 * float(a)) for a in v]) for i, v in data if v is not None and len(v) == width and all(a is not None and math.isfinite(a) for a in v)]
    mark = lambda i: (i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest())
    c = [v for _, v in sorted(kept, key=lambda r: (mark(r[0]), r[1]))[:k]]
    square = lambda v, o: sum((a - b) ** 2 for a, b in zip(v, o, strict=True))
    for turn in range(rounds + 1):
        own = [min((square(v, o), j) for j, o in enumerate(c)) for _, v in kept]
        if turn < rounds:
            for j in range(len(c)):
                mine = [v for (_, v), (_, h) in zip(kept, own, strict=True) if h == j]
                if mine:
                    c[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    return sorted(((i, j, d) for (i, _), (d, j) in zip(kept, own, strict=True)), key=repr), c


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_equal_plain_rounds(spark, seed):
    x = cloud(400, seed, 6)
    nan = float("nan")
    data = [(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(400 + i, [0.25] * 6) for i in range(150)]
    data += [(None, [9.0] * 6), (3, [float(a) for a in x[3]]), (700, None), (701, [1.0]), (702, [nan] * 6), (703, [1.0, None] * 3), (704, [-0.001] * 6)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(3).withColumns({c: F.lit(1) for c in ("cluster", "distance", "lower", "x")})
    want, c = lloyd([(i, None if v is None else [None if a is None else float(np.float32(a)) for a in v]) for i, v in data], 9, 5, 6)
    state, got_c = centroids.clustered(table, k=9, width=6)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in state.collect()), key=repr) == want and got_c.tolist() == c
    assert state.where("not scanned").count() > 50  # the bounds decide for some


def test_geometry_bounds_what_a_move_can_do():
    """No vector of a sphere comes nearer than the bound says, and the bound is below the full drift where it can be."""
    draw = np.random.default_rng(5)
    tight = 0
    for _ in range(300):
        old = draw.integers(-500, 500, (2, 3))
        new = old.copy()
        new[1] += draw.integers(-200, 200, 3)
        radius = np.array([float(draw.uniform(0, 300)), 0.0])
        bound = centroids.loosened(old, new, radius)[0]
        to = draw.normal(size=(2000, 3))
        x = old[0] + to / np.sqrt((to**2).sum(1))[:, None] * radius[0] * draw.uniform(0.9, 1, (2000, 1))
        nearer = np.sqrt(((x - old[1]) ** 2).sum(1)) - np.sqrt(((x - new[1]) ** 2).sum(1))
        drift = math.sqrt(((new[1] - old[1]) ** 2).sum())
        assert nearer.max() <= bound + 1e-6 and bound <= drift * (1 + 1e-6) + 1e-6
        tight += bound < 0.9 * drift
    assert tight > 100


def test_clusters_of_little(spark):
    table = spark.createDataFrame([(1, [0.5] * 64), (2, [0.5] * 64), (3, [1e30] * 64), (4, [-1e30] * 64)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in centroids.cluster_report(table).collect()}
    assert len(got) == 4 and got[1].cluster == got[2].cluster and got[1].inertia == 0
    assert got[1].centroid_sha256 == hashlib.sha256(",".join(["128"] * 64).encode()).hexdigest()
    none = centroids.cluster_report(table.where("false"))
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
