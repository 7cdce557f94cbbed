"""The library's operators over ordinary tables.

A document stands for a file (lang: language, source: folder, text: source code, n_chars: size), a page for a file with
links, a conversation for a chat's history, a label for an issue. The trade graph has nations as nodes and, from each
customer nation, edges to the two other supplier nations with the most lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.functions.constants import INTENTS
from loomgraph.operators import context, graph, issues, risk, views
from loomgraph.operators.storage import settled
from loomgraph.plans.analyze import first_rows

TRIMMED_NODES = 10
LINKS = r'href="([^"]+)"'


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# graph


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_name").alias("name"), "n_regionkey")


def trade_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target and place (1 or 2)."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    buyers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("source"))
    sellers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("target"))
    flows = lines.join(orders, "l_orderkey").join(buyers, "o_custkey").join(sellers, "l_suppkey").where("source <> target").groupBy("source", "target").count()
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("count"), "target"))
    return flows.withColumn("place", place).where("place <= 2").select("source", "target", "place")


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trade_flows(spark, sf_dir).select("source", "target")


def settled_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(trade_edges(spark, sf_dir), "trade")


def trade_metrics(spark: SparkSession, sf_dir: str, edges: DataFrame) -> DataFrame:
    """node, name, in_degree, out_degree, centrality, is_entry, is_circular."""
    nodes = nations(spark, sf_dir)
    loops = graph.on_a_cycle(edges).withColumn("is_circular", F.lit(True))
    rows = graph.degrees(nodes, edges).withColumn("role", graph.role())
    rows = rows.join(graph.betweenness(nodes, edges), "node").join(loops, "node", "left")
    return rows.withColumn("is_circular", F.coalesce("is_circular", F.lit(False))).withColumn("is_entry", F.coalesce(F.col("role") == "entry", F.lit(False)))


def joined(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: x.cast("string")), ",")


def resolve_edges(spark, sf_dir):
    """Nations as files, their keys as stems: the first partner is imported by name, the second by a relative path."""
    text = lambda c: F.col(c).cast("string")
    name = F.when(F.col("place") == 2, F.concat(F.lit("./"), text("target"))).otherwise(text("target"))
    imports = trade_flows(spark, sf_dir).select(text("source").alias("rel_path"), F.col("place").alias("pos"), name.alias("name"))
    files = nations(spark, sf_dir).select(text("node").alias("rel_path"), text("node").alias("stem"), F.col("node").alias("scan_ordinal"))
    return graph.resolve(imports, files).select(F.col("source").cast("int").alias("source"), F.col("target").cast("int").alias("target"))


def degrees(spark, sf_dir):
    return graph.degrees(nations(spark, sf_dir), trade_edges(spark, sf_dir)).select("node", "in_degree", "out_degree")


def entry_dead(spark, sf_dir):
    """Nations of the first region have the stem of an entry point."""
    stem = F.when(F.col("n_regionkey") == 0, "Main").otherwise(F.col("name"))
    rows = graph.degrees(nations(spark, sf_dir), trade_edges(spark, sf_dir))
    return rows.select("node", F.coalesce(graph.role(stem), F.lit("none")).alias("role"))


def cycles(spark, sf_dir):
    return graph.cycles(settled_trade(spark, sf_dir)).select(joined(F.col("members")).alias("members"), "length")


def in_cycle_flag(spark, sf_dir):
    loops = graph.on_a_cycle(settled_trade(spark, sf_dir)).withColumn("flag", F.lit(True))
    return nations(spark, sf_dir).select("node").join(loops, "node", "left").select("node", F.coalesce("flag", F.lit(False)).alias("flag"))


def ancestors(spark, sf_dir):
    found = graph.ancestors(settled_trade(spark, sf_dir), nations(spark, sf_dir), "node")
    grouped = found.groupBy("root").agg(F.count("*").alias("n_impacts"), joined(F.sort_array(F.collect_list("ancestor"))).alias("impacts"))
    return nations(spark, sf_dir).select(F.col("node").alias("root")).join(grouped, "root", "left").select(
        "root", F.coalesce("n_impacts", F.lit(0)).alias("n_impacts"), F.coalesce("impacts", F.lit("")).alias("impacts")
    )


def betweenness(spark, sf_dir):
    found = graph.betweenness(nations(spark, sf_dir), settled_trade(spark, sf_dir))
    return found.select("node", F.round("centrality", 6).alias("centrality"))


def most_central(spark, sf_dir):
    found = graph.betweenness(nations(spark, sf_dir), settled_trade(spark, sf_dir)).withColumn("centrality", F.round("centrality", 6))
    return graph.most_central(found)


def forest(spark, sf_dir):
    """Regions, nations and customers as nodes, each with an edge from what it belongs to."""
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    nodes = region.select(name("r", "r_regionkey").alias("node")).unionAll(nation.select(name("n", "n_nationkey"))).unionAll(customer.select(name("c", "c_custkey")))
    edges = nation.select(name("r", "n_regionkey").alias("source"), name("n", "n_nationkey").alias("target")).unionAll(
        customer.select(name("n", "c_nationkey"), name("c", "c_custkey"))
    )
    return nodes, edges


def topo_levels(spark, sf_dir):
    return graph.topo_levels(*forest(spark, sf_dir))


def level_layout(spark, sf_dir):
    found = graph.level_layout(graph.topo_levels(*forest(spark, sf_dir)))
    return found.select("node", "level", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def impact_lookup(spark, sf_dir):
    found = graph.neighbours(nations(spark, sf_dir).select("node"), trade_edges(spark, sf_dir))
    return found.select("node", joined(F.col("dependents")).alias("dependents"), joined(F.col("dependencies")).alias("dependencies"))


def ego_network(spark, sf_dir):
    return graph.ego_network(trade_edges(spark, sf_dir), 0)


def edge_class(spark, sf_dir):
    edges = settled_trade(spark, sf_dir)
    return graph.edge_class(edges, graph.on_a_cycle(edges))


def edge_highlight(spark, sf_dir):
    edges = settled_trade(spark, sf_dir)
    return graph.edge_class(edges, graph.on_a_cycle(edges), 0)


def trim_topk(spark, sf_dir):
    edges = settled_trade(spark, sf_dir)
    metrics = trade_metrics(spark, sf_dir, edges).withColumn("centrality", F.round("centrality", 6))
    return graph.trimmed(metrics, edges, TRIMMED_NODES)[1]


def node_meta(spark, sf_dir):
    metrics = trade_metrics(spark, sf_dir, settled_trade(spark, sf_dir))
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    wide = metrics.join(regions, "n_regionkey", "left")
    return wide.select("node", "name", F.coalesce("r_name", F.lit("Unknown")).alias("region"), "in_degree", "out_degree", F.round("centrality", 6).alias("centrality"), F.coalesce("role", F.lit("none")).alias("role"), "is_circular")


def node_summaries(spark, sf_dir):
    """Nations as files in a line each: the region for the language, the degree's band for the risk."""
    rows = graph.degrees(nations(spark, sf_dir), trade_edges(spark, sf_dir)).withColumn("role", F.coalesce(graph.role(), F.lit("none")))
    told = rows.select(
        "node", F.col("n_regionkey").cast("string").alias("language"), F.when(F.col("in_degree") >= 5, "high").otherwise("low").alias("risk_level"),
        (F.col("role") == "entry").alias("is_entry"), (F.col("role") == "dead").alias("is_dead"), (F.col("in_degree") >= 8).alias("is_circular"), "in_degree", "out_degree",
    )
    return told.select("node", views.node_summary().alias("line"))


# files


def lang_distribution(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    total = F.greatest(F.sum("n").over(Window.partitionBy()), F.lit(1))
    return counts.select("lang", "n", F.round(F.col("n") * 100 / total, 1).alias("pct"))


#: The first word of p_type stands for an extension.
EXTENSIONS = {"STANDARD": ".py", "SMALL": ".JS", "MEDIUM": ".json", "LARGE": ".ini", "ECONOMY": ".md"}


def category_counts(spark, sf_dir):
    ext = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])[F.substring_index("p_type", " ", 1)]
    return table(spark, sf_dir, "part").groupBy(T.category_of(F.coalesce(ext, F.lit(".bin"))).alias("bucket")).agg(F.count("*").alias("n"))


def size_filter_scan(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("n_chars <= 5000").select("doc_id", "n_chars")


def line_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.line_count(F.col("text")).alias("lines"))


def scan_summary(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.col("lang").alias("language"), F.col("n_chars").alias("size"))
    return views.file_totals(files).select(F.col("total_files").alias("total"), "total_size", F.size("languages").cast("long").alias("n_langs"))


def _url_path(url: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[a-z]+://", "")
    return F.regexp_replace(bare, r"/+$", "")


def folder_tree(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.explode(T.path_prefixes(_url_path(F.col("url")))).alias("folder")).distinct()


def path_parts(spark, sf_dir):
    path = T.normal_path(_url_path(F.col("url")))
    named = table(spark, sf_dir, "pages").select("page_id", path.alias("path"), T.base_name(path).alias("name"))
    return named.select("page_id", "name", T.suffix(F.col("name")).alias("ext"), T.stem(F.col("name")).alias("stem"), T.depth(F.col("path")).alias("depth"))


def _links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract_all("html", F.lit(LINKS), F.lit(1)).alias("links"))


def link_extract(spark, sf_dir):
    return _links(spark, sf_dir).select("page_id", F.posexplode("links").alias("pos", "href"))


def js_import_names(spark, sf_dir):
    """Links as lines of a script: every other one a relative import, the rest packages that are required."""
    line = lambda x, i: F.when(i % 2 == 0, F.concat(F.lit("import x from '."), x, F.lit("'"))).otherwise(F.concat(F.lit("const y = require('@pkg"), x, F.lit("')")))
    scripts = _links(spark, sf_dir).select("page_id", T.js_imports(F.array_join(F.transform("links", line), "\n")).alias("names"))
    relative = F.filter("names", lambda x: x.startswith("."))
    return scripts.select("page_id", F.array_join(relative, ",").alias("relative"), F.size(F.filter("names", lambda x: x == "pkg")).alias("n_packages"))


def link_dedup(spark, sf_dir):
    return _links(spark, sf_dir).select("page_id", F.size("links").alias("n_links"), F.size(F.array_distinct("links")).alias("n_distinct"))


def stem_last_wins(spark, sf_dir):
    return graph.last_wins(table(spark, sf_dir, "part"), "p_name", "p_partkey", "p_partkey")


# issues


def document_issues(spark, sf_dir):
    """Labels and texts as issues: low quality high, toxic medium, short low, in that order of detectors."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").join(docs.select("doc_id"), "doc_id", "left_semi")
    made = lambda rows, n, severity, kind: rows.select(F.col("doc_id").alias("file"), F.lit(severity).alias("severity"), F.lit(kind).alias("issue_type"), F.lit(n).alias("detector"))
    return issues.union(
        made(labels.where("quality = 0"), 0, "high", "low_quality"), made(labels.where("toxic = 1"), 1, "medium", "toxic"), made(docs.where("n_chars < 200"), 2, "low", "too_short")
    )


def issue_union(spark, sf_dir):
    return document_issues(spark, sf_dir)


def issue_detectors(spark, sf_dir):
    """The detectors, each over a table that stands for files: labels for syntax, trade for cycles, customers without
    orders, orders of many suppliers, and links to unknown words."""
    labels = table(spark, sf_dir, "labels").where("doc_id is not null")
    analyses = labels.select(F.col("doc_id").cast("string").alias("rel_path"), (F.col("quality") == 1).alias("syntax_ok"), F.format_string("Line %d: bad", F.col("toxic") + 1).alias("syntax_error"))
    bought = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    idle = table(spark, sf_dir, "customer").join(bought, "c_custkey", "left_anti").select(F.col("c_custkey").cast("string").alias("rel_path"), F.lit("Python").alias("language"), F.lit(True).alias("is_dead"))
    cycles = graph.cycles(settled_trade(spark, sf_dir)).select(F.col("members").cast("array<string>").alias("members"))
    found = issues.union(
        issues.syntax_errors(analyses), issues.circular(cycles), issues.isolated(idle), issues.excessive(_order_suppliers(spark, sf_dir, "string"), SUPPLIERS),
        issues.missing_imports(*_link_imports(spark, sf_dir), KNOWN_WORDS).withColumn("file", F.col("file.page_id").cast("string")),
    )
    return found.select("severity", "issue_type", "file", "line", "detector")


def severity_counts(spark, sf_dir):
    return issues.by_severity(document_issues(spark, sf_dir))


def issue_pivot(spark, sf_dir):
    return issues.pivot(document_issues(spark, sf_dir))


def unpivot_dashboard(spark, sf_dir):
    counts = document_issues(spark, sf_dir).groupBy("issue_type", "severity").agg(F.count("*").alias("n"))
    return views.dashboard(counts, {"low_quality": "high", "toxic": "medium", "too_short": "low"})


#: Suppliers of an order that are many.
SUPPLIERS = 7


def _order_suppliers(spark, sf_dir, kind):
    counted = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_suppkey").alias("out_degree"))
    return counted.select(F.col("l_orderkey").cast(kind).alias("rel_path"), "out_degree")


def excessive_deps(spark, sf_dir):
    found = issues.excessive(_order_suppliers(spark, sf_dir, "long"), SUPPLIERS)
    return found.select(F.col("file").alias("l_orderkey"), F.regexp_extract("message", r"has (\d+)", 1).cast("long").alias("n_suppliers"))


def _last_segments(spark, sf_dir):
    segment = F.element_at(F.split("href", "/"), -1)
    return link_extract(spark, sf_dir).select("page_id", "pos", "href", segment.alias("word"))


def unused_anti_contains(spark, sf_dir):
    words = _last_segments(spark, sf_dir).where(F.length("word") > 2).select("word").distinct()
    held = issues.containing(table(spark, sf_dir, "documents"), words, "doc_id", "text").select("word").distinct()
    return words.join(held, "word", "left_anti")


KNOWN_WORDS = ("the", "The", "of", "and", "de", "la", "le", "der", "die", "el")
FREQUENT = 100


def _link_imports(spark, sf_dir):
    """Links as imports of their words, and words of at least FREQUENT documents as stems."""
    words = F.explode(F.array_distinct(F.split("text", r"[ \t\n\r\f\x0B]+")))
    frequent = table(spark, sf_dir, "documents").select(words.alias("stem")).groupBy("stem").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    links = _last_segments(spark, sf_dir).select(F.struct("page_id", "href").alias("rel_path"), F.lit("Python").alias("language"), F.col("word").alias("name"))
    return links, frequent.select("stem")


def missing_import_anti(spark, sf_dir):
    """Links to words that are neither known nor stand in at least FREQUENT documents; a row for each link."""
    found = issues.missing_imports(*_link_imports(spark, sf_dir), KNOWN_WORDS)
    return found.select("file.page_id", "file.href")


def failed_files(spark, sf_dir):
    """Three-valued: runtime_ok is null where it was not run."""
    events = table(spark, sf_dir, "events").select(
        "event_id", (F.col("event_type") != "error").alias("compile_ok"),
        F.when(F.col("user_id") % 3 == 0, F.lit(None).cast("boolean")).otherwise(F.col("value") >= 1.0).alias("runtime_ok"),
    )
    return events.where(risk.failed(F.col("compile_ok"), F.col("runtime_ok"))).select("event_id")


#: Keywords that stand for a language's own, by lang.
LANG_KEYWORDS = {"en": ["the ", "and "], "fr": ["le ", "de "], "de": ["der ", "die "], "default": ["el", "la"]}


def keyword_complexity(spark, sf_dir):
    score = T.complexity_score(F.col("text"), F.col("lang"), LANG_KEYWORDS)
    scored = table(spark, sf_dir, "documents").select("doc_id", score.alias("score"))
    return scored.withColumn("level", T.complexity_level(F.col("score")))


# risk


def supplier_risk(spark, sf_dir):
    """Suppliers as files: centrality is revenue, in_degree orders, weight returned lines, failed a negative balance,
    complexity distinct parts."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("centrality"),
        F.count_distinct("l_orderkey").alias("in_degree"), F.count_if(F.col("l_returnflag") == "R").alias("weight"), F.count_distinct("l_partkey").alias("complexity"),
    )
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") < 0).alias("failed")).join(lines, "s_suppkey", "left")
    return risk.score(rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("centrality", "in_degree", "weight", "complexity")}))


def risk_score(spark, sf_dir):
    scored = supplier_risk(spark, sf_dir).withColumn("risk_score", F.round("risk_score", 6))
    return scored.select("s_suppkey", "risk_score", T.risk_level(F.col("risk_score")).alias("level"))


def risk_reasons(spark, sf_dir):
    scored = supplier_risk(spark, sf_dir).withColumn("risk_level", T.risk_level(F.round("risk_score", 6))).withColumn("factor_centrality", F.round("factor_centrality", 6))
    return scored.select("s_suppkey", F.array_join(risk.reasons(F.col("weight"), F.lit(0)), "; ").alias("reasons"))


def high_risk_top5(spark, sf_dir):
    scored = supplier_risk(spark, sf_dir).withColumn("risk_score", F.round("risk_score", 6)).withColumn("risk_level", T.risk_level(F.col("risk_score")))
    return risk.highest(scored, 5, "s_suppkey").select("s_suppkey", "risk_score")


def risk_counts(spark, sf_dir):
    scored = supplier_risk(spark, sf_dir).withColumn("risk_level", T.risk_level(F.round("risk_score", 6)))
    return risk.counts(scored)


# context

QUESTIONS = ("why does it crash", "which part is critical", "show every import cycle", "where is the main entry", "is it complex", "tell me about errors")
FOCUS = 7


def relevance_topk(spark, sf_dir):
    """Documents for a question that mentions src3/doc23 and src5/doc25, with document FOCUS in focus."""
    question = F.lit("what is wrong with SRC3/DOC23 and src5/doc25?")
    path = F.concat("source", F.lit("/doc"), F.col("doc_id").cast("string"))
    counted = issues.pivot(document_issues(spark, sf_dir)).select(F.col("file").alias("doc_id"), "weight")
    none = {c: F.lit(0) for c in ("risk_score", "in_degree", "out_degree", "complexity", "n_unused", "centrality")} | {c: F.lit(False) for c in ("failed", "is_circular", "is_entry")}
    rows = table(spark, sf_dir, "documents").join(counted, "doc_id", "left").select(
        "doc_id", context.mentioned(question, path, path).alias("is_mentioned"), (F.col("doc_id") == FOCUS).alias("is_focus"), F.coalesce("weight", F.lit(0)).alias("n_issues"),
    ).withColumns(none)
    has = {name: F.lit(name == "error") for name in INTENTS}
    return context.select_top(rows.withColumn("score", context.relevance(has)), "doc_id").select("doc_id", "score")


def _question(turn: Column) -> Column:
    return F.element_at(F.array(*[F.lit(q) for q in QUESTIONS]), (turn % len(QUESTIONS) + 1).cast("int"))


def intents(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", F.array_join(T.intents(_question(F.col("turn"))), ",").alias("intents"))


def last_n_history(spark, sf_dir):
    return context.last_turns(table(spark, sf_dir, "conversations"), 6).select("conv_id", "turn", "role", "text")


def confidence_parse(spark, sf_dir):
    answer = F.concat("text", F.lit("\nConfidence: "), (F.col("turn") * 40).cast("string"), F.when(F.col("turn") % 3 == 2, "").otherwise("%"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", answer.alias("answer"))
    return turns.select("conv_id", "turn", T.confidence(F.col("answer")).alias("confidence"), F.length(T.without_confidence(F.col("answer"))).alias("stripped"))


def token_estimate(spark, sf_dir):
    chars = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("chars"))
    return chars.select("conv_id", context.token_estimate(F.col("chars")).alias("tokens"))


def snippet_truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.truncated(F.col("text"), 800, "\n… (truncated)").alias("snippet"))


def bytes_humanised(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.humanised_bytes(F.col("n_chars")).alias("size"))


def _pages_as_files(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(_url_path(F.col("url")).alias("rel_path")).distinct()


def structure_edges(spark, sf_dir):
    return views.structure_edges(views.tree_nodes(_pages_as_files(spark, sf_dir)))


def capped_nodes(spark, sf_dir):
    """At most 120 nodes over the folders: the root, all folders, and files by their incoming edges, then by id."""
    nodes = views.tree_nodes(_pages_as_files(spark, sf_dir))
    folders = nodes.where("type <> 'file'").count()
    return views.capped(nodes, views.structure_edges(nodes), folders + 20)[0].select("id", "type", "n_in")


def collapsed_hidden(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(_url_path(F.col("url")), "^[^/]+/", "").alias("rel_path"))
    return views.not_collapsed(found, ["en", "de"]).select("page_id")


def path_search(spark, sf_dir):
    return views.search(table(spark, sf_dir, "pages"), "EXAMPLE.ORG/EN", "url").select("page_id")


def execution_console(spark, sf_dir):
    """Events as executions: errors do not compile, every third user is not run."""
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("rel_path"), (F.col("event_type") != "error").alias("compile_ok"), F.col("event_type").alias("compile_error"), F.lit(1).alias("compile_line"),
        (F.col("user_id") % 7 == 0).alias("timed_out"), F.when(F.col("user_id") % 3 != 0, F.col("value") >= 1.0).alias("runtime_ok"), F.col("event_type").alias("runtime_error"),
    )
    return views.execution_entries(rows)


def node_sizes(spark, sf_dir):
    metrics = graph.betweenness(nations(spark, sf_dir), settled_trade(spark, sf_dir)).withColumn("centrality", F.round("centrality", 6))
    return views.node_size(metrics).select("node", F.round("size", 3).alias("size"))


def confidence_bands(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", views.confidence_band((F.col("turn") * 15).cast("int")).alias("band"))


def complexity_shares(spark, sf_dir):
    rows = keyword_complexity(spark, sf_dir).withColumnRenamed("score", "complexity")
    return views.complexity_shares(rows).select("doc_id", "share")


def complexity_counts(spark, sf_dir):
    return views.complexity_counts(keyword_complexity(spark, sf_dir), "level")


def file_nodes(spark, sf_dir):
    """Documents as files: long ones have a risk, French ones no level, labelled toxic ones are on a cycle."""
    docs = table(spark, sf_dir, "documents")
    files = docs.select(
        F.concat("source", F.lit("\\"), F.col("doc_id").cast("string")).alias("rel_path"), F.col("lang").alias("language"), F.when(F.col("n_chars") > 3000, "high").alias("risk_level"),
        F.when(F.col("lang") != "fr", "medium").alias("complexity_level"), T.line_count(F.col("text")).alias("lines"), "doc_id",
    )
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").join(files, "doc_id").select(F.lit("circular_dependency").alias("issue_type"), F.col("rel_path").alias("file"))
    return views.file_nodes(files, toxic, files.where("language = 'de'").select("rel_path"))


def script_facts(spark, sf_dir):
    """Parts as a script and a class each: what is imported and defined."""
    k = F.col("p_partkey").cast("string")
    text = lambda *parts: F.concat(*[k if p is None else F.lit(p) for p in parts])
    script = text("import { a } from '@scope", None, "/lib'\nimport './p", None, "'\nconst r = require('lib/x')\nfunction f", None, "(a) { return import('dyn') }\nconst g", None, " = async (b) => b\n")
    java = text("import com.acme.P", None, ";\nimport static org.x.Y;\npublic class P", None, " {\n  public static int m", None, "(int a) { return a; }\n}\n")
    made = {"js_imports": T.js_imports(script), "js_functions": T.js_functions(script), "java_imports": T.java_imports(java), "java_functions": T.java_functions(java)}
    return table(spark, sf_dir, "part").select("p_partkey", *[F.array_join(v, ",").alias(n) for n, v in made.items()])


def error_classes(spark, sf_dir):
    """Events as failed requests: the kind of each by its error's name and message."""
    names = F.array(*[F.lit(x) for x in ("RateLimitError", "NotFoundError", "APIError", "ValueError", "AuthenticationError")])
    name = names[(F.col("user_id") % 5).cast("int")]
    message = F.concat(F.lit("HTTP "), (400 + F.col("event_id") % 30).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", T.error_class(name, message).alias("kind"))


def language_shares(spark, sf_dir):
    """Files of each language and their share of all, from the summary's totals."""
    files = table(spark, sf_dir, "documents").select(F.col("lang").alias("language"), F.col("n_chars").alias("size"))
    totals = views.file_totals(files)
    return totals.select("total_files", "total_size", F.explode("languages").alias("language", "n"), "language_distribution").select("language", "n", F.col("language_distribution")[F.col("language")].alias("share"), "total_files", "total_size")


def answer_parts(spark, sf_dir):
    """Turns as bodies of an event stream, a piece for each word of the first line: the answer and its confidence."""
    line = F.split(F.split_part("text", F.lit("\n"), F.lit(1)), " ")
    piece = F.transform(line, lambda w: F.concat(F.lit("data: "), F.to_json(F.struct(F.concat(w, F.lit(" ")).alias("content"))), F.lit("\n\n")))
    sure = F.concat(F.lit('data: {"confidence": '), (F.col("turn") / 8).cast("string"), F.lit("}\ndata: broken\ndata: [DONE]\n"))
    body = F.concat(F.array_join(piece, ""), sure)
    turns = table(spark, sf_dir, "conversations").where("text is not null")
    return turns.select("conv_id", "turn", T.streamed_answer(body).alias("x")).select("conv_id", "turn", "x.content", "x.confidence")


def relevance_by_intent(spark, sf_dir):
    """Each document's score for a question of each intent, and of none."""
    counted = issues.pivot(document_issues(spark, sf_dir)).select(F.col("file").alias("doc_id"), F.col("weight").alias("n_issues"))
    is_lang = lambda x: F.coalesce(F.col("lang") == x, F.lit(False))
    rows = table(spark, sf_dir, "documents").join(counted, "doc_id", "left").select(
        "doc_id", F.coalesce("n_issues", F.lit(0)).alias("n_issues"), is_lang("de").alias("failed"), (F.least("n_chars", F.lit(20000)) / 20000).alias("risk_score"), is_lang("fr").alias("is_circular"),
        (F.col("doc_id") % 5).alias("in_degree"), (F.col("doc_id") % 3).alias("out_degree"), is_lang("es").alias("is_entry"), (F.col("n_chars") % 100).alias("complexity"),
        (F.col("doc_id") % 2).alias("n_unused"), (F.col("doc_id") % 10 / 10).alias("centrality"), F.lit(False).alias("is_mentioned"), F.lit(False).alias("is_focus"),
    )
    scores = [F.struct(F.lit(i).alias("intent"), F.round(context.relevance({name: F.lit(name == i) for name in INTENTS}), 6).alias("score")) for i in (*INTENTS, "general")]
    return rows.select("doc_id", F.explode(F.array(*scores)).alias("x")).select("doc_id", "x.*")


def legend(spark, sf_dir):
    return views.legend(table(spark, sf_dir, "documents"), "lang")


def graph_counts(spark, sf_dir):
    """One row: nodes, edges, cycles and nodes on cycles of the trade graph."""
    edges = settled_trade(spark, sf_dir)
    count = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [count(edges, "n_edges"), count(graph.cycles(edges), "n_cycles"), count(graph.on_a_cycle(edges), "n_on_cycles")]
    return reduce(DataFrame.crossJoin, parts, count(nations(spark, sf_dir), "n_nodes"))  # one row each


def cycle_texts(spark, sf_dir):
    """The message of each issue that a cycle gives each of its members."""
    cycles = graph.cycles(settled_trade(spark, sf_dir)).select(F.col("members").cast("array<string>").alias("members"))
    return issues.circular(cycles).select("file", "message", "severity", F.size("cycle").alias("length"))


def partner_lines(spark, sf_dir):
    """A line of text for each supplier nation of each region's text graph: what it sells to, the first four by name."""
    names = nations(spark, sf_dir).select("node", "name")
    lines, orders = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    buyers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("to"))
    sellers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("from"))
    pairs = lines.join(orders, "l_orderkey").join(buyers, "o_custkey").join(sellers, "l_suppkey").select("from", "to").distinct()
    edges = pairs.join(names.select(F.col("node").alias("from"), F.col("name").alias("source")), "from").join(names.select(F.col("node").alias("to"), F.col("name").alias("target")), "to").select("source", "target")
    no = F.lit(False)
    metrics = nations(spark, sf_dir).select(F.col("name").alias("rel_path"), F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("language"), no.alias("is_entry"), no.alias("is_dead"), (F.col("n_regionkey") == 0).alias("is_circular"))
    return views.graph_lines(metrics, edges)


def first_entries(spark, sf_dir):
    """One row: the first six parts in order of their keys whose name begins as the size says, of each of two lists."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("scan_ordinal"), F.col("p_name").alias("rel_path"), "p_size", "p_retailprice")
    small, dear = parts.where("p_size < 10"), parts.where("p_size >= 10")
    return first_rows(small, 6, "small").select(joined(F.col("small")).alias("small")).crossJoin(first_rows(dear, 5, "dear", -F.col("p_retailprice")).select(joined(F.col("dear")).alias("dear")))  # one row each
