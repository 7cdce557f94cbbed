"""Source trees made from tables, written as files by tasks and read back by the scan.

Documents become files of folders that the scan keeps, prunes or leaves out by suffix. Suppliers become Python modules: each
imports that of half its number and one package that is not there, and calls the other's function; some have an error of
syntax, some do not compile.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.plans.analyze import analyze
from loomgraph.plans.tables import table
from loomgraph.session import scratch
from loomgraph.sources import codetree


def write_tree(rows: DataFrame, folder: str) -> int:
    """rows: rel_path, text. Writes a file for each, in tasks; a task that is run again writes the same. The number."""

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = codetree.store_of(folder)
        made = set()
        for frame in frames:
            for path, text in zip(frame["rel_path"], frame["text"], strict=True):
                codetree.write_file(store, f"{top}/{path}", text.encode(), made)
            yield pd.DataFrame({"n": [len(frame)]})

    return rows.select("rel_path", "text").mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: English as Markdown, French in folders that begin with a dot, German as plain text, others as
    HTML one folder further down."""
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    source = F.coalesce("source", F.lit("none"))
    path = (
        F.when(F.col("lang") == "en", F.concat(source, F.lit("/"), name, F.lit(".md"))).when(F.col("lang") == "fr", F.concat(source, F.lit("/.fr/"), name, F.lit(".md")))
        .when(F.col("lang") == "de", F.concat(source, F.lit("/"), name, F.lit(".txt"))).otherwise(F.concat(source, F.lit("/es/"), name, F.lit(".html")))
    )
    folder = scratch(spark, "documents-tree")
    write_tree(table(spark, sf_dir, "documents").select(path.alias("rel_path"), F.coalesce("text", F.lit("")).alias("text")), folder)
    return codetree.files(codetree.scan(spark, folder)).select("rel_path", "name", "ext", "language", "category", "size", "lines", "scan_ordinal")


def supplier_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rel_path and text."""
    k, up = F.col("s_suppkey"), F.floor(F.col("s_suppkey") / 2)
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    number = lambda c: c.cast("string")
    lines = F.concat_ws(
        "\n", F.lit("import os"), F.when(k >= 1, text("import s", number(up))), text("import pkg", number(F.col("s_nationkey"))),
        text("class C", number(k), ":"), F.lit("    def area(self):"), F.lit("        return 0"), text("def fun", number(k), "x(v):"), F.lit("    if v:"),
        text("        return fun", number(up), "x(v)"), F.when(k % 3 == 0, F.lit("    for w in v:\n        pass")), F.lit("    return os"),
        F.when(k % 11 == 5, F.lit("return 1")), F.when(k % 7 == 3, F.lit("def (:")), F.lit(""),
    )
    return table(spark, sf_dir, "supplier").select(text("n", number(F.col("s_nationkey")), "/s", number(k), ".py").alias("rel_path"), lines.alias("text"))


def code_tree_analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole analysis of a tree with a module for each supplier: a row for each file."""
    folder = scratch(spark, "supplier-tree")
    write_tree(supplier_modules(spark, sf_dir), folder)
    found = analyze(spark, folder)
    facts = found.analyses.select("rel_path", *[F.array_join(c, ",").alias(c) for c in ("imports", "functions", "classes")], "syntax_ok", "compile_ok")
    return found.risk.join(facts, "rel_path").select(
        "rel_path", "language", "lines", "imports", "functions", "classes", "syntax_ok", "compile_ok", "in_degree", "out_degree", F.round("centrality", 6).alias("centrality"),
        "is_entry", "is_dead", "is_circular", "high", "low", "weight", "complexity", F.round("risk_score", 6).alias("risk_score"), "risk_level",
    )


LINES = r"regexp_replace(t, '\r\n?', chr(10), 'g')"

ORACLE_SQL = {
    "tree_scan": f"""WITH d AS (SELECT coalesce(source, 'none') AS folder, coalesce(lang, '') NOT IN ('en', 'fr', 'de') AS deep, coalesce(text, '') AS t, doc_id FROM documents WHERE coalesce(lang, '') NOT IN ('fr', 'de')),
p AS (SELECT *, CASE WHEN deep THEN 'd' || doc_id || '.html' ELSE 'd' || doc_id || '.md' END AS name FROM d),
o AS (SELECT *, row_number() OVER (ORDER BY folder, deep, name) - 1 AS scan_ordinal, octet_length(encode(t)) AS size FROM p)
SELECT folder || CASE WHEN deep THEN '/es/' ELSE '/' END || name AS rel_path, name, CASE WHEN deep THEN '.html' ELSE '.md' END AS ext, CASE WHEN deep THEN 'HTML' ELSE 'Markdown' END AS language,
'assets' AS category, size, (len(string_split({LINES}, chr(10))) - CASE WHEN t = '' OR {LINES} LIKE '%' || chr(10) THEN 1 ELSE 0 END)::INT AS lines, scan_ordinal FROM o WHERE size <= 5242880""",
    "code_tree_analyze": """WITH RECURSIVE s AS (SELECT s_suppkey AS k, s_nationkey AS n, s_suppkey % 7 = 3 AS bad, s_suppkey % 11 = 5 AS late, s_suppkey // 2 AS up FROM supplier),
e AS (SELECT a.k AS src, b.k AS dst FROM s a JOIN s b ON b.k = a.up AND a.k <> b.k WHERE NOT a.bad AND a.k >= 1),
r AS (SELECT src, dst FROM e UNION ALL SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src),
f AS (SELECT s.*, (SELECT count(*) FROM e WHERE dst = k)::INT AS ins, (SELECT count(*) FROM e WHERE src = k)::INT AS outs,
  (SELECT count(*) FROM r WHERE dst = k) * (SELECT count(*) FROM r WHERE src = k) / ((SELECT count(*) FROM s) - 1)::DOUBLE / ((SELECT count(*) FROM s) - 2) AS c,
  (NOT bad AND NOT EXISTS (SELECT 1 FROM s x WHERE x.up = s.k AND x.k <> s.k))::INT AS unused,
  CASE WHEN bad THEN 0 ELSE 1 + (k >= 1 AND NOT EXISTS (SELECT 1 FROM s x WHERE x.k = s.up))::INT END AS missing, 1 + (k % 3 = 0)::INT AS cx FROM s),
g AS (SELECT *, bad::INT AS high, ((ins = 0 AND outs = 0)::INT + unused + missing)::INT AS low FROM f),
w AS (SELECT *, 3 * high + low AS weight, (bad OR late) AS failed FROM g),
m AS (SELECT coalesce(nullif(max(c), 0), 1) AS mc, coalesce(nullif(max(ins), 0), 1)::DOUBLE AS mi, coalesce(nullif(max(weight), 0), 1)::DOUBLE AS mw, max(cx)::DOUBLE AS mx FROM w),
z AS (SELECT *, least(1.0, greatest(0.0, 0.3 * (c / mc) + 0.2 * (ins / mi) + 0.25 * (weight / mw) + 0.15 * failed::INT + 0.1 * (cx / mx))) AS score FROM w, m)
SELECT 'n' || n || '/s' || k || '.py' AS rel_path, 'Python' AS language, (9 + (k >= 1)::INT + 2 * (k % 3 = 0)::INT + late::INT + bad::INT)::INT AS lines,
CASE WHEN bad THEN '' ELSE 'os,' || CASE WHEN k >= 1 THEN 's' || up || ',' ELSE '' END || 'pkg' || n END AS imports, CASE WHEN bad THEN '' ELSE 'fun' || k || 'x,area' END AS functions,
CASE WHEN bad THEN '' ELSE 'C' || k END AS classes, NOT bad AS syntax_ok, NOT failed AS compile_ok, ins AS in_degree, outs AS out_degree, round(c, 6) AS centrality,
ins = 0 AND outs > 0 AS is_entry, ins = 0 AND outs = 0 AS is_dead, FALSE AS is_circular, high, low, weight, cx AS complexity, round(score, 6) AS risk_score,
CASE WHEN score >= 0.55 THEN 'high' WHEN score >= 0.25 THEN 'medium' ELSE 'low' END AS risk_level FROM z""",
}
