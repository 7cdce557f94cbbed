"""Tables that a front end shows: graph nodes and edges, console entries, searches, legends and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import banded, base_name, normal_path, path_prefixes
from loomgraph.operators.graph import induced

ROOT = "__root__"
VISIBLE_NODES = 300


def node_size(rows: DataFrame, highlighted: str | None = None, key: str = "node") -> DataFrame:
    """350 and up to 1800 more by centrality over its greatest value; 1.6 times that for the highlighted node."""
    top = rows.agg(F.coalesce(F.nullif(F.max("centrality"), F.lit(0.0)), F.lit(1.0)).alias("top"))
    size = F.lit(350.0) + F.col("centrality") / F.col("top") * 1800
    sized = rows.crossJoin(F.broadcast(top))  # one row
    return sized.withColumn("size", F.when(F.col(key).eqNullSafe(F.lit(highlighted)), size * 1.6).otherwise(size)).drop("top")


def node_group() -> Column:
    """Group of a node by its flags."""
    return F.when(F.col("is_entry"), "entry").when(F.col("is_circular"), "circular").when(F.col("is_dead"), "dead").otherwise("normal")


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence.isNotNull(), banded(confidence, (50, 80), "red", "yellow", "green", inclusive=True))


def execution_entries(executions: DataFrame, timeout_s: int = 3) -> DataFrame:
    """level, file, message and line of each execution: compile error, then timeout, then runtime error, then passed."""
    failed, late, broken = ~F.col("compile_ok"), F.col("timed_out"), F.col("runtime_ok").eqNullSafe(False)
    error = F.col("runtime_error") if "runtime_error" in executions.columns else F.lit(None).cast("string")
    message = (
        F.when(failed, F.concat(F.lit("Compile failed — "), F.coalesce("compile_error", F.lit("None"))))
        .when(late, f"Execution timed out after {timeout_s}s")
        .when(broken, F.concat(F.lit("Runtime error — "), F.left(F.coalesce(error, F.lit("")), F.lit(120)))).otherwise("Compile check passed")
    )
    level = F.when(failed, "ERROR").when(late, "WARNING").when(broken, "ERROR").otherwise("INFO")
    return executions.select(level.alias("level"), F.col("rel_path").alias("file"), message.alias("message"), F.when(failed, F.col("compile_line")).alias("line"))


def search(rows: DataFrame, text: str, column: str = "rel_path") -> DataFrame:
    """Rows whose column has the text, whatever the case; all rows for no text."""
    return rows.where(F.lower(column).contains(text.lower())) if text else rows


def visible_of(rows: DataFrame, shown: Column) -> DataFrame:
    """n_visible and n_total."""
    return rows.agg(F.count_if(shown).alias("n_visible"), F.count("*").alias("n_total"))


def not_collapsed(rows: DataFrame, collapsed: list[str], column: str = "rel_path") -> DataFrame:
    """Files none of whose folders is collapsed."""
    if not collapsed:
        return rows
    return rows.where(~F.arrays_overlap(path_prefixes(F.col(column)), F.array(*[F.lit(x) for x in collapsed])))


def tree_nodes(files: DataFrame, column: str = "rel_path", collapsed: list[str] | None = None) -> DataFrame:
    """id, type and label of the root, all folders and the files that are shown."""
    folders = files.select(F.explode(path_prefixes(F.col(column))).alias("id")).distinct().select("id", F.lit("folder").alias("type"))
    shown = not_collapsed(files, collapsed or [], column).select(F.col(column).alias("id"), F.lit("file").alias("type"))
    root = files.sparkSession.createDataFrame([(ROOT, "root")], "id string, type string")
    return root.unionByName(folders).unionByName(shown).withColumn("label", base_name(F.col("id")))


def structure_edges(nodes: DataFrame) -> DataFrame:
    """Edges from each folder to what is in it; what has no folder hangs on the root."""
    parts = F.split("id", "/")
    parent = F.when(F.size(parts) == 1, F.lit(ROOT)).otherwise(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/"))
    edges = nodes.where(F.col("id") != ROOT).select(parent.alias("source"), F.col("id").alias("target"))
    return edges.join(nodes.select(F.col("id").alias("source")), "source", "left_semi").select("source", "target", F.lit("structure").alias("type"))


def capped(nodes: DataFrame, edges: DataFrame, most: int = VISIBLE_NODES) -> tuple[DataFrame, DataFrame]:
    """All nodes that are not files and the files with most incoming edges, `most` in all, and the edges among them.

    A table within the limit is left whole; ties go by id.
    """
    incoming = edges.groupBy("target").agg(F.count("*").alias("n_in"))
    counted = nodes.join(incoming, F.col("id") == F.col("target"), "left").drop("target").withColumn("n_in", F.coalesce("n_in", F.lit(0)))
    total, others = nodes.agg(F.count("*"), F.count_if(F.col("type") != "file")).first()
    if total <= most:
        return counted, induced(edges, nodes, "id")
    files = counted.where("type = 'file'").orderBy(F.desc("n_in"), "id").limit(max(0, most - others))
    kept = counted.where("type <> 'file'").unionByName(files)
    return kept, induced(edges, kept, "id")


def dashboard(counts: DataFrame, severities: dict[str, str]) -> DataFrame:
    """counts: issue_type and n. category, count (0 included) and severity of each type of severities, in one pass."""
    wide = counts.agg(*[F.coalesce(F.sum(F.when(F.col("issue_type") == k, F.col("n"))), F.lit(0)).alias(k) for k in severities])
    each = F.array(*[F.struct(F.lit(k).alias("category"), F.col(k).alias("count"), F.lit(s).alias("severity")) for k, s in severities.items()])
    return wide.select(F.explode(each).alias("x")).select("x.*")


def legend(rows: DataFrame, column: str = "language") -> DataFrame:
    return rows.select(column).where(F.col(column).isNotNull()).distinct()


def complexity_shares(rows: DataFrame) -> DataFrame:
    """score as a percentage of the greatest, at least 1."""
    top = rows.agg(F.greatest(F.max("complexity"), F.lit(1)).alias("top"))
    return rows.crossJoin(F.broadcast(top)).withColumn("share", F.round(F.col("complexity") * 100 / F.col("top"), 1)).drop("top")  # one row


def complexity_counts(rows: DataFrame, column: str = "complexity_level") -> DataFrame:
    """high, medium and low: how many rows have each level."""
    return rows.agg(*[F.count_if(F.col(column) == x).alias(x) for x in ("high", "medium", "low")])


def file_nodes(files: DataFrame, issues: DataFrame, entry_points: DataFrame) -> DataFrame:
    """files: rel_path, language, risk_level, complexity_level, lines. id, language, risk (else the complexity's level,
    else low), lines, complexity_level, is_entry (in entry_points: rel_path) and is_circular (has such an issue)."""
    entries = entry_points.select("rel_path", F.lit(True).alias("entry")).distinct()
    loops = issues.where("issue_type = 'circular_dependency'").select(F.col("file").alias("rel_path"), F.lit(True).alias("loop")).distinct()
    flagged = files.join(entries, "rel_path", "left").join(loops, "rel_path", "left")
    no = F.lit(False)
    return flagged.select(
        normal_path(F.col("rel_path")).alias("id"), "language", F.coalesce("risk_level", "complexity_level", F.lit("low")).alias("risk"),
        F.coalesce("lines", F.lit(0)).alias("lines"), "complexity_level", F.coalesce("entry", no).alias("is_entry"), F.coalesce("loop", no).alias("is_circular"),
    )


def file_totals(files: DataFrame) -> DataFrame:
    """One row: languages (files of each), total_files, total_size and language_distribution (shares in percent)."""
    counted = files.groupBy("language").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    totals = counted.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("language", "n")))).alias("languages"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_files"), F.sum("size").alias("total_size"))
    share = lambda k, v: F.round(v * 100 / F.greatest("total_files", F.lit(1)), 1)
    return totals.withColumn("language_distribution", F.transform_values("languages", share))


def node_summary() -> Column:
    """A node in one line: language, risk, roles and degrees."""
    role = lambda flag, text: F.when(F.col(flag), text)
    return F.concat_ws(
        "  ", F.concat(F.lit("["), "language", F.lit("]")), F.concat(F.lit("risk="), "risk_level"), role("is_entry", "entry-point"), role("is_dead", "dead-file"),
        role("is_circular", "circular-dep"), F.format_string("in=%d out=%d", "in_degree", "out_degree"),
    )


def graph_lines(metrics: DataFrame, edges: DataFrame, key: str = "rel_path", shown: int = 4) -> DataFrame:
    """A line of text for each node: its mark, name and language and the first of what it depends on, with the number of
    the others. Only the first targets of a source are gathered; Spark applies their limit before it shuffles."""
    first = edges.withColumn("turn", F.row_number().over(Window.partitionBy("source").orderBy("target"))).where(F.col("turn") <= shown)
    names = first.groupBy("source").agg(F.transform(F.array_sort(F.collect_list("target")), lambda x: base_name(x)).alias("deps"))
    counted = edges.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("n"))
    joined = metrics.join(names, F.col(key) == F.col("source"), "left").join(counted, F.col(key) == F.col("s"), "left")
    mark = F.when(F.col("is_entry"), "▶").when(F.col("is_circular"), "↺").when(F.col("is_dead"), "◌").otherwise("·")
    more = F.when(F.col("n") > shown, F.concat(F.lit(" +"), (F.col("n") - shown).cast("string"))).otherwise("")
    deps = F.when(F.col("n") > 0, F.concat(F.lit("  → "), F.array_join("deps", ", "), more)).otherwise("")
    return joined.select(key, F.concat(F.lit("  "), mark, F.lit(" "), base_name(F.col(key)), F.lit(" ("), F.col("language"), F.lit(")"), deps).alias("line")).orderBy(key)


def messages(contexts: DataFrame, history: DataFrame, system: str, turns: int = 8) -> DataFrame:
    """messages: the system's text, the last turns (turn, role, content) and the prompt, as role and content."""
    last = history.orderBy(F.desc("turn")).limit(turns).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("said"))
    one = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return contexts.crossJoin(last).select("question", F.concat(F.array(one("system", F.lit(system))), "said", F.array(one("user", F.col("prompt")))).alias("messages"))
