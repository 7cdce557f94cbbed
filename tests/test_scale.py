"""Operators whose work must not grow with paths, pairs, levels or the driver: against brute force, both ways each."""

from __future__ import annotations

import json
import os
import random
import sys
import time
import zipfile
from datetime import datetime, timedelta
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.functions.python_source import Checker
from loomgraph.operators import graph, issues
from loomgraph.plans import analyze as plans
from loomgraph.plans.golden import written
from loomgraph.sources import codetree, jsondoc
from loomgraph.streaming import events


def edges_of(spark, pairs):
    return spark.createDataFrame(sorted(pairs), "source long, target long")


def nodes_of(spark, n):
    return spark.range(n).withColumnRenamed("id", "node")


def random_pairs(seed, n, m, down=False):
    draw = random.Random(seed)
    pairs = {(draw.randrange(n), draw.randrange(n)) for _ in range(m)}
    return {(min(p), max(p)) if down else p for p in pairs if p[0] != p[1]}


def closure(pairs, n):
    reach = {a: {b for x, b in pairs if x == a} for a in range(n)}
    for _ in range(n):
        reach = {a: out | {c for b in out for c in reach[b]} for a, out in reach.items()}
    return reach


def test_cycles_behind_many_paths(spark):
    """Two cycles joined by layers: 2**12 open paths lead from one to the other."""
    layers = [[1], *[[10 * i + 10, 10 * i + 11] for i in range(12)], [900]]
    pairs = {(0, 1), (1, 0), (900, 901), (901, 900)} | {(x, y) for a, b in zip(layers, layers[1:], strict=False) for x in a for y in b}
    assert {tuple(r.members) for r in graph.cycles(edges_of(spark, pairs), most_paths=2).collect()} == {(0, 1), (900, 901)}


def test_cycles_in_many_rounds(spark):
    pairs = {(a, b) for a in range(5) for b in range(5) if a != b} | {(7, 8), (8, 7)}
    want = {p for k in range(2, 6) for p in permutations(range(5), k) if p[0] == min(p)} | {(7, 8)}
    assert {tuple(r.members) for r in graph.cycles(edges_of(spark, pairs), budget=20).collect()} == want
    with pytest.raises(RuntimeError):
        graph.cycles(edges_of(spark, pairs), most_paths=len(want) - 1)


def test_cycles_of_names(spark):
    pairs = spark.createDataFrame([("é", "b"), ("b", "é"), ("b", "c"), ("c", "é"), ("x", "b")], "source string, target string")
    assert {tuple(r.members) for r in graph.cycles(pairs).collect()} == {("b", "é"), ("b", "c", "é")}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    pairs = random_pairs(seed, 24, 34)
    reach = closure(pairs, 24)
    want = {(a, min(b for b in reach[a] if a in reach[b])) for a in reach if a in reach[a]}
    for small in (1000, 0):
        assert {(r.node, r.component) for r in graph.strong_components(edges_of(spark, pairs), small).collect()} == want


def test_betweenness_by_joins_in_batches(spark):
    nodes, edges = nodes_of(spark, 20), edges_of(spark, random_pairs(3, 20, 50))
    one = {r.node: r.centrality for r in graph.betweenness(nodes, edges).collect()}
    other = {r.node: r.centrality for r in graph.betweenness(nodes, edges, most_edges=1, most_rows=160).collect()}
    assert one == pytest.approx(other) and sum(one.values()) > 0
    none = graph.betweenness(nodes, edges.where("false")).collect()
    assert len(none) == 20 and not any(r.centrality for r in none)


def test_levels_of_a_long_chain(spark, monkeypatch):
    rounds, settle = [], graph.settled
    monkeypatch.setattr(graph, "settled", lambda df, name="step": rounds.append(name) or settle(df, name))
    found = {r.node: r.level for r in graph.topo_levels(nodes_of(spark, 1001), edges_of(spark, {(i, i + 1) for i in range(1000)})).collect()}
    assert found == {i: i for i in range(1001)} and rounds.count("level") <= 12


@pytest.mark.parametrize("seed", [4, 5])
def test_levels_of_random_graphs(spark, seed):
    pairs = random_pairs(seed, 30, 60, down=True)
    level = {}
    for n in range(30):
        level[n] = max((level[a] + 1 for a, b in pairs if b == n), default=0)
    assert {r.node: r.level for r in graph.topo_levels(nodes_of(spark, 30), edges_of(spark, pairs)).collect()} == level
    assert graph.topo_levels(nodes_of(spark, 31), edges_of(spark, pairs | {(29, 30), (30, 29)})) is None


def test_ancestors_of_many_roots(spark):
    """Over 64 roots take several rows of bits."""
    pairs = random_pairs(6, 90, 130)
    reach = closure(pairs, 90)
    up = graph.ancestors(edges_of(spark, pairs), nodes_of(spark, 90), "node").collect()
    assert {(r.root, r.ancestor) for r in up} == {(b, a) for a in reach for b in reach[a] if a != b} and len(up) == len({tuple(r) for r in up})


def test_graphs_without_edges(spark):
    nodes, none = nodes_of(spark, 3), edges_of(spark, {(0, 1)}).where("false")
    assert graph.cycles(none).count() == 0 and graph.on_a_cycle(none).count() == 0 and graph.strong_components(none, 0).count() == 0
    assert graph.ancestors(none, nodes, "node").count() == 0 and graph.ancestors(none, nodes.where("false"), "node").count() == 0
    assert {r.level for r in graph.topo_levels(nodes, none).collect()} == {0} and graph.topo_levels(nodes.where("false"), none).count() == 0
    assert graph.betweenness(nodes.where("false"), none).count() == 0


def test_words_by_grams(spark):
    draw = random.Random(7)
    letters = "abé "
    texts = [(i if i else None, "".join(draw.choices(letters, k=draw.randrange(60)))) for i in range(60)] + [(99, None)]
    words = {"".join(draw.choices(letters, k=draw.randrange(1, 12))) for _ in range(200)} | {t[10:25] for _, t in texts[:20]} | {"😀", "zz"}
    want = sorted((str(k), w) for k, t in texts for w in words if w and t and w in t)
    frame = spark.createDataFrame(texts, "key long, text string").repartition(3)
    listed = spark.createDataFrame([(w,) for w in sorted(words)] * 2, "word string")
    for most in (10**6, 0):
        assert sorted((str(r.key), r.word) for r in issues.containing(frame, listed, most_shared=most).collect()) == want


def tree(top, names):
    for name in names:
        path = os.path.join(top, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(name)


def test_many_roots_in_one_read(spark, tmp_path):
    first, second, packed = str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "c.zip")
    tree(first, ["x.py", "d/y.py", "d/e/z.js", "node_modules/q.js", ".git/q.py", "b-d/y.py", "B.py", "t.txt"])
    tree(second, [f"d{i}/f{j}.py" for i in range(7) for j in range(40)])
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(300):
            z.writestr(f"top/d{i % 7}/f{i}.py", f"x = {i}\n" * (i + 1))
        z.writestr("top/stored.py", "s", zipfile.ZIP_STORED)
        z.writestr("top/b.py", "b" * 99, zipfile.ZIP_BZIP2)
        z.writestr("top/l.py", "l" * 99, zipfile.ZIP_LZMA)
    rows = codetree.scan_all(spark.createDataFrame([(first,), (second,), (packed,)], "root string")).collect()
    for root in (first, second):
        got = sorted((r.scan_ordinal, r.rel_path) for r in rows if r.root == root)
        assert [g[1] for g in got] == [r for r, _ in codetree.list_tree(root)] and [g[0] for g in got] == list(range(len(got)))
    inside = {r.rel_path: r for r in rows if r.root == packed}
    assert len(inside) == 303 and inside["d1/f8.py"].content == b"x = 8\n" * 9 and inside["l.py"].content == b"l" * 99 and inside["b.py"].size == 99
    assert [m.relative for m in codetree.list_archive(packed)] == [r.rel_path for r in sorted(inside.values(), key=lambda r: r.scan_ordinal)]


def test_local_headers_are_checked(spark, tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("t/a.py", "a" * 20)
        z.writestr("t/b.py", "b" * 20)
    data = bytearray(path.read_bytes())
    data[data.index(b"PK\x03\x04", 4) + 22] = 7  # the second member's size, in its local header only
    path.write_bytes(bytes(data))
    rows = codetree.scan(spark, str(path))
    bad = codetree.scan_errors(rows).collect()
    assert [r.rel_path for r in bad] == ["b.py"] and "differ" in bad[0].error and codetree.files(rows).count() == 1


def test_roots_that_are_none(spark, tmp_path):
    for path in (tmp_path, tmp_path / "missing", tmp_path / "missing.zip"):
        with pytest.raises(ValueError):
            codetree.scan(spark, str(path))


def test_document_in_parts(spark, tmp_path):
    found = plans.analyze(spark, written(str(tmp_path / "golden")))
    whole = plans.document(found).select(F.to_json(F.struct("*")).alias("j")).first().j
    out = str(tmp_path / "out")
    plans.write_document(found, out, rows_in_part=3)
    read = lambda: b"".join(open(p, "rb").read() for p in jsondoc.parts(out)).decode()
    assert read() == whole and len(jsondoc.parts(out)) > 3 and "_SUCCESS" in os.listdir(out)
    with pytest.raises(Exception, match="has a document"):
        plans.write_document(found, out)
    plans.write_document(found, out, overwrite=True)
    assert read() == whole and len(jsondoc.parts(out)) == 1 and json.loads(read())["summary"]["total_files"] == 9


def test_a_failed_document_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(jsondoc.TextPartsSource)
    bad = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")).alias("text"))
    with pytest.raises(Exception, match="no"):
        bad.write.format("textparts").mode("append").option("path", str(tmp_path)).save()
    assert os.listdir(tmp_path) == []


def bodies():
    for i in range(9):
        said = "".join(f"data: {json.dumps({'content': f'wörd{i}-{k} ', **({'confidence': k / 10} if k % 3 == 0 else {})}, ensure_ascii=False)}\n\n" for k in range(i))
        yield f"a{i}", said + "data: no json\n: a comment\ndata: [DONE]\n\ndata: {\"content\": \"late\"}\n"


def test_answers_cut_anywhere(spark, tmp_path):
    """Pieces of bytes in any order, over several batches and a restart, give what the whole bodies give."""
    draw, start, pieces = random.Random(8), datetime(2024, 1, 1), []
    for name, body in bodies():
        raw = body.encode()
        cuts = [0, *sorted(draw.sample(range(1, len(raw)), 5)), len(raw)]
        pieces += [(name, i, start + timedelta(seconds=len(pieces)), raw[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    pieces += [("cut", 0, start, b'data: {"content": "half"}\ndata: {"con'), pieces[3]]
    draw.shuffle(pieces)
    schema = "answer string, pos long, ts timestamp, body binary"
    place, out = tmp_path / "in", str(tmp_path / "out")

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(place))

    def run():
        stream = events.streamed_answers(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(place)), patience_s=30)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)

    add(pieces[:20])
    add(pieces[20:40])
    run()
    add(pieces[40:])
    run()  # from the checkpoint
    add([("other", 0, start + timedelta(hours=1), b"")])
    add([("other", 1, start + timedelta(hours=2), b"")])
    run()
    got = {r.answer: r for r in spark.read.parquet(out).collect()}
    whole = spark.createDataFrame(list(bodies()), "answer string, body string").select("answer", T.streamed_answer(F.col("body")).alias("x")).select("answer", "x.*")
    assert {(r.answer, r.content, r.confidence) for r in whole.collect()} == {(r.answer, r.content, r.confidence) for r in got.values() if r.status == "done"}
    assert (got["cut"].content, got["cut"].status) == ("half", "broken")


CHILD = """
import os, sys, time
from loomgraph.functions import python_source as p
real = p.compiled
def compiled(source):
    if 'hang' in source: time.sleep(60)
    if 'crash' in source: os.abort()
    return real(source)
p.compiled = compiled
p.serve()
"""


def test_hanging_and_crashing_sources(spark):
    with Checker(0.5, [sys.executable, "-c", CHILD]) as c:
        rows = [c.check(s) for s in ("import a", "import b  # hang", "import c  # crash", "def f(:", "x = 1\n" * 20_000, "import d")]
        assert c.started == 3
    assert [r[0] for r in rows] == [["a"], ["b"], ["c"], [], [], ["d"]]
    assert [r[6] for r in rows] == [False, True, False, False, False, False]
    assert rows[1][4] is None and "parser ended" in rows[2][4] and rows[2][3] is None and rows[3][3] and rows[5][4] is None
    with Checker() as c:
        deep = c.check("(" * 100_000 + ")" * 100_000)
        assert deep[3] and deep[4] and c.check("y = 2")[3:] == (None, None, None, False)


def test_betweenness_looks_at_what_is_reached():
    """A tree of 60,000 nodes, of which each start reaches at most 16: no work for the others."""
    import numpy as np
    import pandas as pd

    src = np.arange(1, 60_000)
    starts = np.arange(0, 60_000, 500)
    began = time.monotonic()
    got = next(graph._dependencies(src, src // 2, 60_000, graph.CELLS)(iter([pd.DataFrame({"start": starts})])))
    assert time.monotonic() - began < 3
    true = {}
    for k in starts.tolist():
        while k and k // 2:
            k //= 2
            true[k] = true.get(k, 0) + k.bit_length()  # the nodes after it, down to 0
    assert dict(zip(got["place"].tolist(), got["s"].tolist(), strict=True)) == true


def test_both_steps_at_once(spark):
    """A child that sends both lines in one piece; no time goes by until the deadline."""
    child = CHILD.split("p.compiled")[0].split("real")[0] + (
        "from json import dumps\nread = sys.stdin.buffer.read\nwhile head := read(4):\n    source = read(int.from_bytes(head, 'big')).decode()\n"
        "    os.write(1, b''.join(dumps(step(source)).encode() + b'\\n' for step in (p.defined, p.compiled)))\n"
    )
    with Checker(20, [sys.executable, "-c", child]) as c:
        began = time.monotonic()
        rows = [c.check(s) for s in ("import a", "return 1", "def f(:", "import d")]
        assert c.started == 1 and time.monotonic() - began < 15
    assert [r[0] for r in rows] == [["a"], [], [], ["d"]]
    assert [r[4] is None for r in rows] == [True, False, False, True] and not any(r[6] for r in rows)


def test_settings_as_tables(spark, tmp_path):
    """A language, its keywords and a package that the library does not know, given as tables."""
    from loomgraph.functions.settings import Settings

    tree(str(tmp_path), ["a.zig", "b.py"])
    (tmp_path / "a.zig").write_text("loop (x) loop (y) if for")
    (tmp_path / "b.py").write_text("import mine\nimport other\n")
    table = spark.createDataFrame
    given = Settings.from_tables(table([(".ZIG", "Zig")], "ext string, language string"), table([("Zig", "loop (")], "language string, keyword string"), table([("mine",)], "name string"))
    found = plans.analyze(spark, str(tmp_path), given)
    assert {(r.rel_path, r.language, r.complexity) for r in found.risk.collect()} == {("a.zig", "Zig", 2), ("b.py", "Python", 0)}
    assert [r.message for r in found.issues.where("issue_type = 'missing_import'").collect()] == ["Import 'other' not found locally or in known packages"]
    assert {r.rel_path for r in codetree.scan(spark, str(tmp_path)).collect()} == {"b.py"}
