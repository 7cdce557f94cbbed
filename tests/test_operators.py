"""Operators on small tables, with the traps that their docstrings name, and graphs against plain algorithms."""

import math
import random
import zipfile
from collections import deque
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import context, graph, issues, parse, risk
from loomgraph.sources import codetree


def one(spark, expr, **columns):
    row = spark.createDataFrame([tuple(columns.values())], list(columns)) if columns else spark.range(1)
    return row.select(expr.alias("x")).first().x


@pytest.mark.parametrize(("text", "n"), [("", 0), ("x", 1), ("x\n", 1), ("x=1\r\ny=2\rz=3", 3), ("a\n\nb", 3)])
def test_line_count(spark, text, n):
    assert one(spark, T.line_count(F.col("t")), t=text) == n


def test_substrings_count_as_python_does(spark):
    draw = random.Random(1)
    for _ in range(20):
        text = "".join(draw.choice("ab ") for _ in range(40))
        for part in ("a", "ab", "aa", "b a"):
            assert one(spark, T.count_substring(F.col("t"), part), t=text) == text.count(part)


def test_complexity_counts_overlaps(spark):
    assert one(spark, T.complexity_score(F.col("t"), F.lit("Python")), t="if a:\nelif b:\nfor c in d:") == 4
    assert one(spark, T.complexity_score(F.col("t"), F.lit("JavaScript")), t="else if (a) {}") == 2
    assert one(spark, T.complexity_score(F.col("t"), F.lit("Go")), t="if x for y whilez") == 3


@pytest.mark.parametrize(("name", "ext", "stem"), [("a.py", ".py", "a"), (".eslintrc.json", ".json", ".eslintrc"), (".env", "", ".env"), ("a.tar.gz", ".gz", "a.tar"), ("a.", "", "a."), ("plain", "", "plain")])
def test_path_parts(spark, name, ext, stem):
    assert one(spark, T.suffix(F.col("n")), n=name) == ext and one(spark, T.stem(F.col("n")), n=name) == stem


def test_prefixes(spark):
    assert one(spark, T.path_prefixes(F.col("p")), p="a/b/c.py") == ["a", "a/b"] and one(spark, T.path_prefixes(F.col("p")), p="c.py") == []


def test_intents(spark):
    ask = lambda q: one(spark, T.intents(F.col("q")), q=q)
    assert ask("Why does it CRASH on start?") == ["error", "entry"] and ask("errors imports maintainable") == ["general"]


def test_confidence(spark):
    assert one(spark, T.confidence(F.col("t")), t="x\nConfidence: 150 %") == 100
    assert one(spark, T.confidence(F.col("t")), t="none") is None
    assert one(spark, T.without_confidence(F.col("t")), t="yes.  \nConfidence: 85%\n") == "yes."


def test_javascript_and_java(spark):
    source = "import React from 'react'\nimport './x.css'\nconst p = require('@scope/pkg/y')\nimport('z')\nfunction été() {}\nconst go = async (a) => a\n"
    assert one(spark, T.js_imports(F.col("s")), s=source) == ["react", "./x.css", "scope", "z"]
    assert one(spark, T.js_functions(F.col("s")), s=source) == ["été", "go"]
    java = "import java.util.List;\nimport static a.B;\nclass X { public int f(int a) { return 1; } }"
    assert one(spark, T.java_imports(F.col("s")), s=java) == ["java"] and one(spark, T.java_functions(F.col("s")), s=java) == ["f"]


def test_error_class_and_bytes(spark):
    kinds = [("AuthenticationError", "", "auth"), ("X", "429", "rate_limit"), ("X", "no Model", "model"), ("APITimeout", "", "connection"), ("X", "", "other")]
    assert all(one(spark, T.error_class(F.col("n"), F.col("m")), n=n, m=m) == k for n, m, k in kinds)
    assert [one(spark, T.humanised_bytes(F.lit(n))) for n in (0, 12, 2048, 5 << 20)] == ["0 B", "12.0 B", "2.0 KB", "5.0 MB"]


def test_event_stream(spark):
    assert one(spark, T.sse_tokens(F.col("b")), b='data: {"a": 1}\n\nnoise\ndata: {"b": 2}\ndata: [DONE]\ndata: late') == ['{"a": 1}', '{"b": 2}']


def test_python_facts():
    found = parse.python_facts("import a.b, c\nfrom . import x\nfrom .foo import bar\nclass K:\n    async def m(self): pass\n")
    assert found[:4] == (["a", "c", "foo"], ["m"], ["K"], None)
    assert parse.python_facts("return 1")[3] is None and parse.python_facts("return 1")[4] is not None
    assert parse.python_facts("def (:")[3].startswith("Line 1:")


def test_tree(spark, tmp_path):
    for name, data in {"__init__.py": b"", ".eslintrc.json": b"{}", "C.PY": b"x", "b.txt": b"x", "latin.md": b"caf\xe9\n", "big.py": b"x" * (5 * 1024 * 1024), "huge.py": b"x" * (5 * 1024 * 1024 + 1), "z/a.py": b"1", "venv/q.py": b"1"}.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(data)
    rows = {r.rel_path: r for r in codetree.files(codetree.scan(spark, str(tmp_path))).collect()}
    assert set(rows) == {"__init__.py", ".eslintrc.json", "C.PY", "latin.md", "big.py", "z/a.py"}
    assert rows["C.PY"].ext == ".py" and rows["__init__.py"].lines == 0 and rows["latin.md"].lines == 1
    assert max(rows.values(), key=lambda r: r.scan_ordinal).rel_path == "z/a.py"
    assert codetree.scan(spark, str(tmp_path), content=False).where("content is not null").count() == 0


def test_resolve_last_stem_wins(spark):
    files = spark.createDataFrame([("a/util.py", "util", 0), ("b/util.py", "util", 1), ("helper.js", "helper", 2), ("m.py", "m", 3)], "rel_path string, stem string, scan_ordinal long")
    imports = spark.createDataFrame([("m.py", 0, "util"), ("m.py", 1, "./helper"), ("m.py", 2, "m"), ("m.py", 3, "util"), ("b/util.py", 0, "util")], "rel_path string, pos int, name string")
    assert {(r.source, r.target) for r in graph.resolve(imports, files).collect()} == {("m.py", "b/util.py"), ("m.py", "helper.js")}


def random_graph(seed, n=7, m=13):
    draw = random.Random(seed)
    return sorted({(a, b) for a, b in ((draw.randrange(n), draw.randrange(n)) for _ in range(m)) if a != b})


def frames(spark, edges, n=7):
    return spark.createDataFrame([(i,) for i in range(n)], "node long"), spark.createDataFrame(edges, "source long, target long")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cycles(spark, seed):
    edges = random_graph(seed)
    have = set(edges)
    want = {p for k in range(2, 8) for p in permutations(range(7), k) if p[0] == min(p) and all(e in have for e in zip(p, p[1:] + p[:1], strict=True))}
    assert {tuple(r.members) for r in graph.cycles(frames(spark, edges)[1]).collect()} == want
    if len(want) > 2:
        with pytest.raises(RuntimeError):
            graph.cycles(frames(spark, edges)[1], most_paths=1)


@pytest.mark.parametrize("seed", [1, 2])
def test_betweenness_and_ancestors(spark, seed):
    edges, n = random_graph(seed), 7
    out = {i: [b for a, b in edges if a == i] for i in range(n)}
    score, reach = dict.fromkeys(range(n), 0.0), {}
    for s in range(n):
        dist, paths, order, before = {s: 0}, dict.fromkeys(range(n), 0), [], {i: [] for i in range(n)}
        paths[s], queue = 1, deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in out[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        reach[s], delta = set(dist) - {s}, dict.fromkeys(range(n), 0.0)
        for w in reversed(order):
            for v in before[w]:
                delta[v] += paths[v] / paths[w] * (1 + delta[w])
            if w != s:
                score[w] += delta[w]
    nodes, df = frames(spark, edges)
    got = {r.node: r.centrality for r in graph.betweenness(nodes, df).collect()}
    assert got == pytest.approx({k: v / 30 for k, v in score.items()})
    up = graph.ancestors(df, nodes, "node").collect()
    assert {(r.root, r.ancestor) for r in up} == {(w, s) for s in reach for w in reach[s]}


def test_levels(spark):
    nodes, edges = frames(spark, [(0, 1), (1, 2), (0, 2), (2, 3)], 5)
    assert {r.node: r.level for r in graph.topo_levels(nodes, edges).collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0}
    assert graph.topo_levels(*frames(spark, [(0, 1), (1, 0)], 3)) is None
    assert graph.circular_layout(nodes).count() == 5


def test_roles(spark):
    rows = spark.createDataFrame([("main", 0, 0), ("x", 0, 1), ("Main", 1, 0), ("y", 1, 0)], "stem string, in_degree int, out_degree int")
    assert [r.role for r in rows.withColumn("role", graph.role(F.col("stem"))).collect()] == ["dead", "entry", "entry", None]


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_nodes_on_cycles(spark, seed):
    """Against reachability: a node is on a cycle if an edge leads from it to a node that reaches it."""
    edges = random_graph(seed, 9, 13)
    reach = {a: {b for x, b in edges if x == a} for a in range(9)}
    for _ in range(9):
        reach = {a: out | {c for b in out for c in reach[b]} for a, out in reach.items()}
    assert {r.node for r in graph.on_a_cycle(frames(spark, edges, 9)[1]).collect()} == {a for a in reach if a in reach[a]}


def test_cyclic_levels_end_early(spark, monkeypatch):
    ring = [(i, (i + 1) % 40) for i in range(40)]
    rounds = []
    settle = graph.settled
    monkeypatch.setattr(graph, "settled", lambda df, name="step": rounds.append(name) or settle(df, name))
    assert graph.topo_levels(*frames(spark, ring, 40)) is None and rounds.count("level") == 1


def test_layouts(spark, monkeypatch):
    from loomgraph.operators import storage

    monkeypatch.setattr(storage, "RANGE_ROWS", 5)  # several ranges
    levels = [(i, i % 3) for i in range(40)]
    got = {r.node: (r.x, r.y) for r in graph.level_layout(spark.createDataFrame(levels, "node long, level int")).collect()}
    for k in range(3):
        own = [n for n, level in levels if level == k]
        for i, n in enumerate(own):
            assert got[n] == pytest.approx(((i - len(own) / 2) * 2 / len(own), 1 - k / 2))
    circle = {r.node: (r.x, r.y) for r in graph.circular_layout(spark.range(12).withColumnRenamed("id", "node")).collect()}
    assert all(circle[i] == pytest.approx((math.cos(2 * math.pi * i / 12), math.sin(2 * math.pi * i / 12)), abs=1e-9) for i in range(12))


def test_betweenness_has_a_bound(spark):
    with pytest.raises(RuntimeError):
        graph.betweenness(*frames(spark, [(0, 1)]), most_pairs=10)


def test_damaged_archives_and_pushed_filters(spark, tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("top/good.py", "x = 1\n")
        z.writestr("top/bad.py", "y" * 5000)
        z.writestr("top/c.js", "z")
    data = bytearray(path.read_bytes())
    at = data.index(b"top/bad.py") + len("top/bad.py")
    data[at : at + 8] = b"\xff" * 8
    path.write_bytes(bytes(data))
    rows = codetree.scan(spark, str(path))
    assert [r.rel_path for r in codetree.scan_errors(rows).collect()] == ["bad.py"] and codetree.files(rows).count() == 2
    assert {r.rel_path for r in rows.where("ext = '.py' and size <= 100").collect()} == {"good.py"}
    reader = codetree.TreeReader({"path": str(path)})
    assert len(list(reader.pushFilters([codetree.In(("ext",), (".js", ".py")), codetree.EqualTo(("ext",), ".js"), codetree.LessThanOrEqual(("size",), 7)]))) == 3
    assert [x[1] for p in reader.partitions() for x in p.entries] == ["c.js"] and reader.most_bytes == 7


def test_stores_are_read_as_folders(tmp_path):
    """A store that pyarrow knows against the local walk, files and archives; in one process."""
    from pyarrow.fs import LocalFileSystem

    for name in ("__init__.py", "b.py", "a/c.py", "a/.x/d.py", "node_modules/e.js", "z/y/f.md", ".eslintrc.json", "g.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("top/q.py", "q")
    assert codetree.list_store(LocalFileSystem(), str(tmp_path)) == codetree.list_tree(str(tmp_path))
    for path in (str(tmp_path), str(tmp_path / "t.zip")):
        local, other = codetree.TreeReader({"path": path}), codetree.TreeReader({"path": path})
        other.store = LocalFileSystem()
        assert [r for p in other.partitions() for r in other.read(p)] == [r for p in local.partitions() for r in local.read(p)] != []


def test_front_end_rows(spark):
    from loomgraph.operators import views

    files = spark.createDataFrame([("a\\b.py", "Python", None, "medium", 3), ("c.py", "Python", None, None, None)], "rel_path string, language string, risk_level string, complexity_level string, lines int")
    found = spark.createDataFrame([("circular_dependency", "c.py")], "issue_type string, file string")
    got = {r.id: r for r in views.file_nodes(files, found, files.limit(1).select("rel_path")).collect()}
    assert (got["a/b.py"].risk, got["a/b.py"].is_entry, got["c.py"].risk, got["c.py"].is_circular, got["c.py"].lines) == ("medium", True, "low", True, 0)
    assert {r.language for r in views.legend(files).collect()} == {"Python"}
    assert tuple(views.complexity_counts(files).first()) == (0, 1, 0)
    body = 'data: {"content": "a"}\nnoise\ndata: {bad\ndata: {"content": "b", "confidence": 40}\ndata: {"confidence": 70}\ndata: [DONE]'
    assert tuple(one(spark, T.streamed_answer(F.col("b")), b=body)) == ("ab", 70.0)


def test_issue_detectors(spark):
    cyc = spark.createDataFrame([(["a", "b"], 2), (["a", "c"], 2)], "members array<string>, length int")
    assert issues.circular(cyc).where("file = 'a'").count() == 2
    many = spark.createDataFrame([("a", 10), ("b", 9)], "rel_path string, out_degree int")
    assert [r.file for r in issues.excessive(many).collect()] == ["a"]
    texts = spark.createDataFrame([("a", "alpha beta"), ("b", "alphabet")], "key string, text string")
    words = spark.createDataFrame([("alpha",), ("beta",), ("gamma",), ("",)], "word string")
    want = {("a", "alpha"), ("a", "beta"), ("b", "alpha")}
    assert all({tuple(r) for r in issues.containing(texts, words, most_shared=n).collect()} == want for n in (100, 1))
    none = issues.circular(cyc.limit(0))
    assert {r.severity: r.n for r in issues.by_severity(none).collect()} == {"high": 0, "medium": 0, "low": 0}
    assert issues.console(issues.circular(cyc)).first().level == "ERROR"


def test_risk_stays_in_bounds(spark):
    draw = random.Random(4)
    rows = [(draw.random(), draw.randrange(9), draw.randrange(9), draw.random() < 0.5, draw.randrange(30)) for _ in range(50)]
    df = spark.createDataFrame(rows, "centrality double, in_degree int, weight int, failed boolean, complexity int")
    got = risk.score(df).collect()
    assert all(0 <= r.risk_score <= 1 for r in got)
    zero = risk.score(df.limit(1).selectExpr("0D as centrality", "0 as in_degree", "0 as weight", "false as failed", "0 as complexity"))
    assert zero.first().risk_score == 0 and risk.counts(zero).first().low == 1


def test_forced_files_come_first_in_reverse(spark):
    rows = [(i, float(10 - i) if i < 9 else 0.0, i in (10, 11), i == 12) for i in range(13)]
    df = spark.createDataFrame(rows, "o long, score double, is_mentioned boolean, is_focus boolean")
    got = [r.o for r in context.select_top(df, "o").orderBy("rank").collect()]
    assert got == [11, 10, 12, 0, 1, 2, 3, 4]


def test_last_turns(spark):
    df = spark.createDataFrame([(1, t) for t in range(9)] + [(2, 0)], "conv_id long, turn long")
    assert sorted(tuple(r) for r in context.last_turns(df, 3).collect()) == [(1, 6), (1, 7), (1, 8), (2, 0)]


def test_views(spark):
    from loomgraph.operators import views

    files = spark.createDataFrame([("a/b/c.py",), ("a/d.py",), ("e.py",)], "rel_path string")
    nodes = views.tree_nodes(files, collapsed=["a/b"])
    assert {(r.id, r.type) for r in nodes.collect()} == {("__root__", "root"), ("a", "folder"), ("a/b", "folder"), ("a/d.py", "file"), ("e.py", "file")}
    edges = views.structure_edges(nodes)
    assert {(r.source, r.target) for r in edges.collect()} == {("__root__", "a"), ("a", "a/b"), ("a", "a/d.py"), ("__root__", "e.py")}
    kept, left = views.capped(nodes, edges, 4)
    assert {r.id for r in kept.collect()} == {"__root__", "a", "a/b", "a/d.py"} and left.count() == 3
    rows = spark.createDataFrame([("a.py", True, None, None, False, True), ("b.py", False, "bad", 3, False, None), ("c.py", True, None, None, True, None)], "rel_path string, compile_ok boolean, compile_error string, compile_line int, timed_out boolean, runtime_ok boolean")
    assert [(r.level, r.line) for r in views.execution_entries(rows).collect()] == [("INFO", None), ("ERROR", 3), ("WARNING", None)]
    assert views.search(files, "D.P").count() == 1 and views.search(files, "").count() == 3
    assert tuple(views.visible_of(files, F.col("rel_path") == "e.py").first()) == (1, 3)
    said = spark.createDataFrame([(i, "user", str(i)) for i in range(10)], "turn int, role string, content string")
    asked = spark.createDataFrame([("q", "p")], "question string, prompt string")
    assert [m.content for m in views.messages(asked, said, "s").first().messages] == ["s", *map(str, range(2, 10)), "p"]
    metrics = spark.createDataFrame([("m.py", "Python", True, False, False)], "rel_path string, language string, is_entry boolean, is_circular boolean, is_dead boolean")
    out = spark.createDataFrame([("m.py", f"x/{i}.py") for i in range(6)], "source string, target string")
    assert views.graph_lines(metrics, out).first().line == "  ▶ m.py (Python)  → 0.py, 1.py, 2.py, 3.py +2"
