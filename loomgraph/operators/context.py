"""Context for a question: which files matter, what to say of each, and the prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.constants import CHARS_PER_TOKEN, CONTEXT_FILES, PROMPT_CHARS, SNIPPET_CHARS
from loomgraph.functions.text import truncated


def mentioned(question: Column, name: Column, path: Column) -> Column:
    q = F.lower(question)
    return q.contains(F.lower(name)) | q.contains(F.lower(path))


def relevance(has: dict[str, Column]) -> Column:
    """Score of a file from its columns; has: whether the question has each intent.

    Columns: is_mentioned, is_focus, n_issues, failed, risk_score, is_circular, in_degree, out_degree, is_entry,
    complexity, n_unused, centrality.
    """
    flag = lambda c, w: F.when(F.col(c), w).otherwise(0.0)
    given = lambda intent, x: F.when(has[intent], x).otherwise(0.0)
    return (
        flag("is_mentioned", 20.0) + flag("is_focus", 25.0)
        + given("error", F.col("n_issues") * 5.0 + flag("failed", 8.0))
        + given("risk", F.col("risk_score") * 15.0)
        + given("dependency", flag("is_circular", 10.0) + F.col("in_degree") * 0.5 + F.col("out_degree") * 0.3)
        + given("entry", flag("is_entry", 12.0))
        + given("complexity", F.col("complexity") * 0.2)
        + given("unused", F.col("n_unused") * 4.0)
        + F.col("risk_score") * 3.0 + F.col("centrality") * 5.0
    )


def select_top(scored: DataFrame, order: str, most: int = CONTEXT_FILES) -> DataFrame:
    """scored: score, is_mentioned, is_focus and order. The chosen rows with their rank.

    The top rows by score that are above 0; forced rows (focus, then mentioned in order) that are not among them are put
    in front one by one, so the last of them is first; then the list is cut.
    """
    top = scored.orderBy(F.desc("score"), order).limit(most).where("score > 0").withColumn("rank", F.struct(F.lit(1).alias("a"), (-F.col("score")).alias("b"), F.col(order).cast("double").alias("c")))
    forced = scored.where("is_focus or is_mentioned").join(top.select(order), order, "left_anti")
    turn = F.when(F.col("is_focus"), F.lit(0.0)).otherwise(-1.0)
    forced = forced.withColumn("rank", F.struct(F.lit(0).alias("a"), turn.alias("b"), (-F.col(order)).cast("double").alias("c")))
    return forced.unionByName(top).orderBy("rank").limit(most)


def snippet(source: Column, most: int = SNIPPET_CHARS) -> Column:
    stripped = F.regexp_replace(F.coalesce(source, F.lit("")), r"^\s+|\s+$", "")
    return truncated(stripped, most, "\n… (truncated)")


def token_estimate(chars: Column) -> Column:
    return F.floor((chars + PROMPT_CHARS) / CHARS_PER_TOKEN)


def last_turns(conversations: DataFrame, most: int, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The last turns of each conversation."""
    from pyspark.sql import Window

    back = F.row_number().over(Window.partitionBy(conversation).orderBy(F.desc(turn)))
    return conversations.withColumn("back", back).where(F.col("back") <= most).drop("back")


def _listed(title: str, items: Column, most: int) -> Column:
    """Up to `most` items in a line; null without any."""
    return F.when(F.size(items) > 0, F.concat(F.lit(f"{title}: "), F.array_join(F.slice(items, F.lit(1), F.lit(most)), ", ")))


def _bullets(title: str, items: Column, most: int) -> Column:
    """Up to `most` items, one a line; null without any."""
    lines = F.transform(F.slice(items, F.lit(1), F.lit(most)), lambda x: F.concat(F.lit("* "), x))
    return F.when(F.size(items) > 0, F.concat(F.lit(f"{title}:\n"), F.array_join(lines, "\n")))


def file_block(f: Column) -> Column:
    """One file of a prompt, from a struct as analyze's context makes it: 8 imports, 5 importers, 4 issues, 3 reasons
    and 20 lines of its text at most."""
    lines = F.split(f["snippet"], "\n")
    code = F.concat(F.array_join(F.slice(lines, F.lit(1), F.lit(20)), "\n"), F.when(F.size(lines) > 20, "\n(more follows)").otherwise(""))
    facts = F.concat_ws(", ", f["language"], F.concat(f["risk_level"], F.lit(" risk")), F.concat(f["lines"].cast("string"), F.lit(" lines")), F.when(f["is_entry"], "entry point"))
    return F.concat_ws(
        "\n", F.concat(F.lit("File "), f["rel_path"], F.lit(" ("), facts, F.lit(")")), _listed("uses", f["imports"], 8), _listed("used by", f["imported_by"], 5),
        _bullets("problems", f["issues"], 4), _bullets("why this risk", f["reasoning"], 3),
        F.when(f["snippet"] != "", F.concat(F.lit("```"), F.lower(f["language"]), F.lit("\n"), code, F.lit("\n```"))),
    )


def section(title: Column | str, body: Column) -> Column:
    """A titled part of a prompt; null where the body is null."""
    return F.concat(F.lit("# "), F.lit(title) if isinstance(title, str) else title, F.lit("\n"), F.trim(body), F.lit("\n"))


def prompt() -> Column:
    """The prompt of a context row: question, project, focus, problems of the whole, failures, files, and what to answer.

    Parts without content are left out.
    """
    by_share = F.array_sort(F.transform(F.map_entries("language_distribution"), lambda e: F.struct((-e["value"]).alias("s"), e["key"].alias("k"))))
    languages = F.array_join(F.transform(by_share, lambda e: F.concat(e["k"], F.lit(" "), F.round(-e["s"]).cast("int").cast("string"), F.lit(" %"))), ", ")
    fact = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    project = F.concat_ws(
        "\n", fact("root", F.col("root")), fact("files", F.col("total_files").cast("string")), fact("languages", languages), fact("issues", F.col("total_issues").cast("string")),
        fact("cycles", F.col("circular_dependency_count").cast("string")), F.coalesce(_listed("entry points", F.col("entry_points"), 6), F.lit("entry points: none found")),
        fact("most central", F.coalesce("most_central_file", F.lit("none"))), _listed("high risk", F.col("high_risk_files"), 4),
    )
    failure = lambda c: F.concat(
        F.lit("* "), c["root"], F.coalesce(F.concat(F.lit(" fails: "), F.left(c["error"], F.lit(60))), F.lit(" fails")), F.coalesce(F.concat(F.lit("; "), _listed("affects", c["impacts"], 5)), F.lit(""))
    )
    failures = F.array_join(F.transform(F.slice("failure_chains", F.lit(1), F.lit(3)), failure), "\n")
    blocks = F.array_join(F.transform("files", file_block), "\n\n")
    return F.concat_ws(
        "\n", section("Question", F.col("question")), section("Project", project), section("File in focus", F.col("focus_file")),
        F.when(F.size("global_issues") > 0, section("Problems of the whole project", F.array_join(F.transform("global_issues", lambda g: F.concat(F.lit("* "), g)), "\n"))),
        F.when(F.size("failure_chains") > 0, section("Failures and what they affect", failures)),
        section(F.concat(F.lit("Files that matter ("), F.size("files").cast("string"), F.lit(" selected)")), F.when(F.size("files") > 0, blocks).otherwise("No file was chosen.")),
        section("Answer", F.lit("Use what is given above and nothing else. Close with a line `Confidence: n%`, n from 0 to 100.")),
    )
