"""The whole analysis of a source tree: scan, parse, resolve, graph, issues, risk, and one nested row of results."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.constants import ENTRY_FILES, INTENTS
from loomgraph.functions.python_source import DEADLINE_S
from loomgraph.functions.settings import Settings
from loomgraph.functions.text import complexity_level, complexity_score, intents, path_prefixes, stem
from loomgraph.operators import context, graph, issues, risk, views
from loomgraph.operators.parse import exploded, parse
from loomgraph.operators.storage import numbered, settled
from loomgraph.sources import codetree
from loomgraph.sources.jsondoc import TextPartsSource


@dataclass
class Analysis:
    """Tables of one project, each settled; keyed by rel_path, in order of scan_ordinal."""

    root: str
    files: DataFrame
    analyses: DataFrame
    edges: DataFrame
    cycles: DataFrame
    metrics: DataFrame
    issues: DataFrame
    executions: DataFrame
    failures: DataFrame
    risk: DataFrame

    def impact(self, file: str) -> DataFrame:
        """What a file depends on and what depends on it, directly, and whether it is on a cycle."""
        one = self.metrics.where(F.col("rel_path") == file)
        return graph.neighbours(one.select("rel_path", "is_circular"), self.edges, "rel_path")


def analyze(spark: SparkSession, path: str, settings: Settings | None = None) -> Analysis:
    """The analysis of a tree or archive; settings: languages, keywords and packages beside the library's own."""
    settings = settings or Settings()
    rows = settled(codetree.scan(spark, path, languages=settings.languages), "scan")
    files = settled(codetree.files(rows, settings.languages).withColumn("stem", stem(F.col("name"))), "files")
    analyses = settled(parse(files), "analyses")
    imports = exploded(analyses, "imports")
    edges = settled(graph.resolve(imports, files), "edges")
    cycles = graph.cycles(edges)
    nodes = files.select("rel_path", "language", "lines", "scan_ordinal", "stem", "name", "size", "category")
    between = graph.betweenness(nodes.select(F.col("rel_path").alias("node")), edges)
    on_cycle = graph.on_a_cycle(edges).select(F.col("node").alias("rel_path"), F.lit(True).alias("is_circular"))
    role = graph.role(F.col("stem"))
    metrics = settled(
        graph.degrees(nodes, edges, "rel_path").withColumn("role", role)
        .join(between.withColumnRenamed("node", "rel_path"), "rel_path").join(on_cycle, "rel_path", "left")
        .withColumns({"is_circular": F.coalesce("is_circular", F.lit(False)), "is_entry": F.coalesce(F.col("role") == "entry", F.lit(False)), "is_dead": F.coalesce(F.col("role") == "dead", F.lit(False))}),
        "metrics",
    )
    functions = exploded(analyses, "functions")
    found = settled(
        issues.union(
            issues.syntax_errors(analyses), issues.circular(cycles), issues.isolated(metrics), issues.excessive(metrics),
            issues.unused_functions(functions, analyses), issues.missing_imports(imports, files, settings.packages),
        ).join(files.select(F.col("rel_path").alias("file"), "scan_ordinal"), "file", "left"),
        "issues",
    )
    executions = settled(
        analyses.where("language = 'Python'").join(metrics.select("rel_path", "in_degree"), "rel_path").select(
            "rel_path", "scan_ordinal", "compile_ok", "compile_error", "compile_line",
            F.when(F.col("timed_out"), False).when(F.col("compile_ok"), True).alias("runtime_ok"), "timed_out",
            (F.col("name").isin(ENTRY_FILES) | (F.col("source").contains("__name__") & F.col("source").contains("__main__") & (F.col("in_degree") == 0))).alias("is_entry_point"),
        ).withColumn("failed", risk.failed(F.col("compile_ok"), F.col("runtime_ok"))),
        "executions",
    )
    failed = executions.where("failed").select(F.col("rel_path").alias("root"))
    failures = settled(
        graph.ancestors(edges, failed).groupBy("root").agg(F.sort_array(F.collect_list("ancestor")).alias("impacts"))
        .join(executions.select(F.col("rel_path").alias("root"), F.coalesce("compile_error", F.when(F.col("timed_out"), f"Execution timed out after {DEADLINE_S:g}s")).alias("error")), "root"),
        "failures",
    )
    weights = issues.pivot(found)
    base = (
        metrics.join(analyses.select("rel_path", complexity_score(F.col("source"), F.col("language"), settings.keywords).alias("complexity")), "rel_path")
        .join(weights.withColumnRenamed("file", "rel_path"), "rel_path", "left")
        .join(executions.select("rel_path", "failed"), "rel_path", "left")
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("high", "medium", "low", "weight")} | {"failed": F.coalesce("failed", F.lit(False))})
    )
    scored = risk.score(base).withColumn("complexity_level", complexity_level(F.col("complexity")))
    scored = settled(scored.withColumn("reasoning", risk.reasons(F.col("high"), F.col("medium"))), "risk")
    return Analysis(path, files, analyses, edges, cycles, metrics, found, executions, failures, scored)


def first_rows(rows: DataFrame, n: int, name: str, *order: Column) -> DataFrame:
    """One row: the rel_paths of the first n rows in order."""
    keyed = rows.select(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], "scan_ordinal", "rel_path").alias("x")).orderBy("x").limit(n)
    return keyed.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["rel_path"]).alias(name))


def summary(a: Analysis) -> DataFrame:
    """One row: counts, languages, top files."""
    levels = a.risk.agg(
        *[F.count_if(F.col("risk_level") == x).alias(f"{x}_risk") for x in ("high", "medium", "low")],
        F.max_by("rel_path", F.struct("centrality", -F.col("scan_ordinal"))).alias("most_central_file"),
    )
    parts = [
        levels,
        first_rows(a.risk.where("risk_level = 'high'"), 5, "high_risk_files", -F.col("risk_score")),
        first_rows(a.risk.where("is_entry"), 6, "entry_points"),
        first_rows(a.risk.where("is_dead"), 6, "dead_files"),
        a.issues.agg(F.count("*").alias("total_issues"), F.count_if(F.col("issue_type") == "syntax_error").alias("syntax_errors")),
        a.cycles.agg(F.count("*").alias("circular_dependency_count")),
    ]
    return reduce(DataFrame.crossJoin, parts, views.file_totals(a.files)).withColumn("duplicate_pairs", F.lit(0))  # one row each


def sections(a: Analysis) -> dict[str, DataFrame]:
    """The result's tables; key orders the rows, row has what a reader of the document sees. Each can be written apart."""
    listed = lambda df, order, *cols: df.select(F.struct(*order).alias("key"), F.struct(*cols).alias("row"))
    per_file = a.risk.join(a.files.select("rel_path", "path", "ext"), "rel_path")
    complexity = F.struct(F.coalesce("complexity_level", F.lit("low")).alias("level"), F.col("complexity").alias("score"), F.greatest("lines", F.lit(0)).alias("lines")).alias("complexity")
    chains = a.executions.join(a.failures.select(F.col("root").alias("rel_path"), "impacts"), "rel_path", "left")
    folders = a.files.select(F.explode(path_prefixes(F.col("rel_path"))).alias("folder")).distinct()
    edges = a.edges.join(a.files.select(F.col("rel_path").alias("source"), "scan_ordinal"), "source")
    return {
        "files": listed(per_file, ["scan_ordinal"], "path", "rel_path", "name", "ext", "size", "language", "category", complexity, F.coalesce("risk_level", F.lit("low")).alias("risk"), F.round("risk_score", 3).alias("risk_score"), F.col("reasoning").alias("risk_reasoning")),
        "folder_tree": folders.select(F.struct("folder").alias("key"), F.col("folder").alias("row")),
        "dependencies": listed(edges, ["scan_ordinal", "pos"], "source", "target"),
        "issues": listed(a.issues, ["detector", "scan_ordinal", "message"], "severity", "issue_type", "file", "message", "line"),
        "errors": listed(chains, ["scan_ordinal"], F.col("rel_path").alias("file"), "compile_ok", "compile_error", "runtime_ok", "timed_out", "is_entry_point", F.coalesce("impacts", F.array().cast("array<string>")).alias("failure_chain")),
    }


def document(a: Analysis) -> DataFrame:
    """The result as one row of nested columns, for projects whose document fits one row; to_json(struct('*')) makes the
    JSON document. write_document() writes the same text without such a row."""
    out = summary(a).select(F.struct("*").alias("summary"))
    for name, df in sections(a).items():
        out = out.crossJoin(df.agg(F.transform(F.array_sort(F.collect_list(F.struct("key", "row"))), lambda x: x["row"]).alias(name)))
    return out.withColumn("meta", F.struct(F.lit(a.root).alias("root"))).withColumn("duplicates", F.array().cast("array<string>"))


def document_pieces(a: Analysis) -> DataFrame:
    """section, place and text: the JSON document in pieces of one row each, which make it when joined in order."""
    json_of = lambda c: F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
    fixed = lambda section, place, text: a.files.sparkSession.range(1).select(F.lit(section).alias("section"), F.lit(place).cast("long").alias("place"), text.alias("text"))
    whole = summary(a).select(F.lit(0).alias("section"), F.lit(0).cast("long").alias("place"), F.concat(F.lit('{"summary":'), F.to_json(F.struct("*"))).alias("text"))
    pieces, section = [whole], 0
    for section, (name, rows) in enumerate(sections(a).items(), 1):
        placed = numbered(rows, ["key", "row"])
        comma = F.when(F.col("place") > 0, ",").otherwise("")
        pieces += [
            fixed(section, -1, F.lit(f',"{name}":[')),
            placed.select(F.lit(section).alias("section"), "place", F.concat(comma, json_of("row")).alias("text")),
            fixed(section, (1 << 62), F.lit("]")),
        ]
    root = F.to_json(F.struct(F.lit(a.root).alias("root")))
    pieces.append(fixed(section + 1, 0, F.concat(F.lit(',"meta":'), root, F.lit(',"duplicates":[]}'))))
    return reduce(DataFrame.unionByName, pieces)


def write_document(a: Analysis, folder: str, overwrite: bool = False, rows_in_part: int = 100_000) -> None:
    """Writes the JSON document of a project of any size as part files, in order; all or none of them."""
    spark = a.files.sparkSession
    spark.dataSource.register(TextPartsSource)
    pieces = settled(document_pieces(a), "pieces")
    ordered = pieces.repartitionByRange(1 + pieces.count() // rows_in_part, "section", "place").sortWithinPartitions("section", "place").select("text")
    ordered.write.format("textparts").mode("overwrite" if overwrite else "append").option("path", folder).save()


def build_context(a: Analysis, question: str, focus: str | None = None) -> DataFrame:
    """One row: the question, its intents, the chosen files, what is wrong with the project, the prompt and its size."""
    q = F.lit(question)
    has = {name: F.array_contains(intents(q), name) for name in INTENTS}
    per_file = a.issues.groupBy(F.col("file").alias("rel_path")).agg(
        F.count("*").alias("n_issues"), F.count_if(F.col("issue_type").isin("unused_function", "isolated_file")).alias("n_unused"),
        F.slice(F.transform(F.array_sort(F.collect_list(F.struct("detector", "message"))), lambda x: x["message"]), F.lit(1), F.lit(6)).alias("issues"),
    )
    none = F.array().cast("array<string>")
    rows = (
        a.risk.join(per_file, "rel_path", "left")
        .withColumns({"n_issues": F.coalesce("n_issues", F.lit(0)), "n_unused": F.coalesce("n_unused", F.lit(0)), "issues": F.coalesce("issues", none)})
        .withColumn("is_mentioned", context.mentioned(q, F.col("name"), F.col("rel_path")))
        .withColumn("is_focus", F.col("rel_path").eqNullSafe(F.lit(focus)))
    )
    chosen = context.select_top(rows.withColumn("score", context.relevance(has)), "scan_ordinal")
    chosen = chosen.join(a.analyses.select("rel_path", "source", "imports"), "rel_path")
    imported_by = F.slice(F.sort_array(F.collect_set("source")), F.lit(1), F.lit(6)).alias("imported_by")
    chosen = chosen.join(a.edges.groupBy(F.col("target").alias("rel_path")).agg(imported_by), "rel_path", "left")
    block = F.struct(
        "rel_path", "language", "risk_level", "lines", context.snippet(F.col("source")).alias("snippet"), "issues",
        F.array_distinct(F.slice("imports", F.lit(1), F.lit(12))).alias("imports"), F.coalesce("imported_by", none).alias("imported_by"),
        "is_entry", F.slice("reasoning", F.lit(1), F.lit(3)).alias("reasoning"),
    )
    files = chosen.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("f")))), lambda x: x["f"]).alias("files"))
    loops = a.cycles.orderBy("members").limit(3).agg(F.transform(F.sort_array(F.collect_list("members")), lambda m: F.concat(F.lit("Circular dependency: "), issues.cycle_text(m))).alias("loops"))
    chains = a.failures.orderBy("root").limit(4).agg(F.sort_array(F.collect_list(F.struct("root", "impacts", "error"))).alias("failure_chains"))
    out = summary(a).crossJoin(files).crossJoin(loops).crossJoin(chains)
    broken = F.transform(F.slice("failure_chains", F.lit(1), F.lit(3)), lambda c: F.concat(F.lit("Execution failure in '"), c["root"], F.lit("' impacts "), F.size(c["impacts"]).cast("string"), F.lit(" downstream file(s)")))
    out = out.withColumn("global_issues", F.concat("loops", broken)).drop("loops")
    chars = F.length(q) + F.aggregate("files", F.lit(0), lambda n, f: n + F.length(f["rel_path"]) + F.length(f["snippet"]) + F.aggregate(f["issues"], F.lit(0), lambda m, i: m + F.length(i)))
    chars = chars + F.aggregate("global_issues", F.lit(0), lambda n, g: n + F.length(g))
    out = out.withColumn("question", q).withColumn("focus_file", F.lit(focus).cast("string")).withColumn("root", F.lit(a.root))
    prompt = context.prompt()
    return out.select(
        "question", intents(q).alias("intents"), "focus_file", "total_files", "total_issues", "entry_points",
        "most_central_file", "high_risk_files", "files", "global_issues", "failure_chains", context.token_estimate(chars).alias("estimated_tokens"), prompt.alias("prompt"),
    )
