"""The golden project: nine files whose results were derived by hand."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from loomgraph.plans import analyze as plans
from loomgraph.plans import golden
from loomgraph.plans.golden import FILES

RISK = {
    "main.py": (0.0333, "low"), "core.py": (0.7167, "high"), "store.py": (0.4167, "medium"), "util.py": (0.2, "low"),
    "broken.py": (0.35, "medium"), "orphan.py": (0.05, "low"), "web/app.js": (0.0, "low"), "web/helper.js": (0.2, "low"), "conf/settings.json": (0.0, "low"),
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("golden")
    golden.written(str(root))
    (root / "node_modules").mkdir()
    (root / "node_modules" / "n.js").write_text("x")
    (root / ".hidden").mkdir()
    (root / ".hidden" / "x.py").write_text("x")
    return root


@pytest.fixture(scope="module")
def analysis(spark, tree):
    return plans.analyze(spark, str(tree))


def test_files(analysis):
    assert {r.rel_path for r in analysis.files.collect()} == set(FILES)


def test_edges_and_cycles(analysis):
    edges = {(r.source, r.target) for r in analysis.edges.collect()}
    assert edges == {("main.py", "core.py"), ("main.py", "util.py"), ("core.py", "util.py"), ("core.py", "store.py"), ("store.py", "core.py"), ("web/app.js", "web/helper.js")}
    assert [r.members for r in analysis.cycles.collect()] == [["core.py", "store.py"]]


def test_metrics(analysis):
    rows = {r.rel_path: r for r in analysis.metrics.collect()}
    assert {p for p, r in rows.items() if r.is_entry} == {"main.py", "web/app.js"}
    assert {p for p, r in rows.items() if r.is_dead} == {"broken.py", "orphan.py", "conf/settings.json"}
    assert rows["core.py"].centrality == pytest.approx(2 / 56)
    assert sum(r.centrality for r in rows.values()) == pytest.approx(2 / 56)


def test_issues_in_order(analysis):
    rows = analysis.issues.orderBy("detector", "file").collect()
    assert [(r.issue_type, r.file) for r in rows] == [
        ("syntax_error", "broken.py"), ("circular_dependency", "core.py"), ("circular_dependency", "store.py"), ("isolated_file", "broken.py"),
        ("isolated_file", "orphan.py"), ("unused_function", "store.py"), ("missing_import", "store.py"),
    ]
    assert rows[0].line == 2 and rows[0].message == "Syntax error — Line 2: invalid syntax"
    assert "never_called" in rows[5].message and "requests_x" in rows[6].message
    assert rows[1].message == "Circular dependency: core.py → store.py → core.py"


def test_risk(analysis):
    rows = {r.rel_path: r for r in analysis.risk.collect()}
    for path, (score, level) in RISK.items():
        assert rows[path].risk_score == pytest.approx(score, abs=1e-4), path
        assert rows[path].risk_level == level
    assert rows["orphan.py"].reasoning == ["Low overall risk — low dependency footprint"]


def test_executions_and_impact(analysis):
    rows = {r.rel_path: r for r in analysis.executions.collect()}
    assert [p for p, r in rows.items() if r.failed] == ["broken.py"] and rows["broken.py"].runtime_ok is None
    assert analysis.failures.count() == 0
    one = analysis.impact("core.py").first()
    assert (one.dependents, one.dependencies, one.is_circular) == (["main.py", "store.py"], ["store.py", "util.py"], True)


def test_document(analysis):
    row = plans.document(analysis).select(F.to_json(F.struct("*")).alias("j")).first()
    found = json.loads(row.j)
    assert found["summary"]["total_files"] == 9 and found["summary"]["most_central_file"] == "core.py"
    assert found["folder_tree"] == ["conf", "web"] and found["summary"]["high_risk_files"] == ["core.py"]
    assert len(found["dependencies"]) == 6 and len(found["issues"]) == 7


def test_context(analysis):
    row = plans.build_context(analysis, "which error makes store.py fail?", "orphan.py").first()
    assert row.intents == ["error"]
    paths = [f.rel_path for f in row.files]
    assert {"store.py", "orphan.py"} <= set(paths) and len(paths) <= 8
    assert row.prompt.startswith("# Question\nwhich error") and "File store.py (Python, medium risk, 11 lines)" in row.prompt
    assert "languages: Python 67 %, JavaScript 22 %, JSON 11 %" in row.prompt and "high risk: core.py" in row.prompt
    assert f"# Files that matter ({len(paths)} selected)" in row.prompt and "# File in focus\norphan.py" in row.prompt and "* Circular dependency: core.py" in row.prompt


def test_failures_reach_the_prompt(spark, tmp_path):
    for name, text in {"bad.py": "import x\nreturn 1\n", "user.py": "import bad\n\nif __name__ == '__main__':\n    pass\n", "x.py": "X = 1\n", "lone.py": "if __name__ == '__main__':\n    pass\n"}.items():
        (tmp_path / name).write_text(text)
    found = plans.analyze(spark, str(tmp_path))
    rows = {r.rel_path: r for r in found.executions.collect()}
    assert {p for p, r in rows.items() if r.is_entry_point} == {"user.py", "lone.py"}
    row = plans.build_context(found, "what fails?").first()
    assert "# Failures and what they affect\n* bad.py fails: SyntaxError: 'return' outside function (line 2); affects: user.py" in row.prompt
    assert set(plans.sections(found)) == {"files", "folder_tree", "dependencies", "issues", "errors"}


def test_archive(spark, tree, tmp_path):
    path = tmp_path / "golden.zip"
    with zipfile.ZipFile(path, "w") as z:
        for name, text in FILES.items():
            z.writestr(f"top/{name}", text)
    from loomgraph.sources import codetree

    assert {r.rel_path for r in codetree.scan(spark, str(path)).collect()} == set(FILES)
    with zipfile.ZipFile(path, "a") as z:
        z.writestr("../x.py", "x")
    assert all(".." not in r.rel_path for r in codetree.scan(spark, str(path)).collect())
