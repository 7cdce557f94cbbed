"""Detectors of issues. Each returns severity, issue_type, file, message, line, cycle and detector (its place)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.constants import (
    ALWAYS_USED_FUNCTIONS,
    CONSOLE_LEVELS,
    EXCESSIVE_DEPENDENCIES,
    ISOLATION_LANGUAGES,
    KNOWN_PACKAGES,
    SEVERITY_WEIGHTS,
)
from loomgraph.operators.storage import settled

#: Words that are sent to tasks as one automaton at most.
WORDS_SHARED = 200_000
#: Characters of a gram, texts that tell which grams are rare, and bits that a task is sent at most (16 MB).
GRAM = 5
SAMPLE_TEXTS = 500
MOST_BITS = 1 << 27


def _issue(rows: DataFrame, detector: int, severity: str, kind: str, file: str, message: Column, line: Column | None = None, cycle: Column | None = None) -> DataFrame:
    return rows.select(
        F.lit(severity).alias("severity"), F.lit(kind).alias("issue_type"), F.col(file).alias("file"), message.alias("message"),
        (line if line is not None else F.lit(None)).cast("int").alias("line"),
        (cycle if cycle is not None else F.lit(None)).cast("array<string>").alias("cycle"), F.lit(detector).alias("detector"),
    )


def syntax_errors(analyses: DataFrame) -> DataFrame:
    line = F.regexp_extract("syntax_error", r"^Line (\d+):", 1).try_cast("int")
    return _issue(analyses.where("not syntax_ok and syntax_error is not null"), 0, "high", "syntax_error", "rel_path", F.concat(F.lit("Syntax error — "), "syntax_error"), line)


def cycle_text(members: Column) -> Column:
    return F.concat(F.array_join(members, " → "), F.lit(" → "), members[0])


def circular(cycle_rows: DataFrame) -> DataFrame:
    """One issue for each file of each cycle."""
    each = cycle_rows.select("members", F.explode("members").alias("member"))
    return _issue(each, 1, "high", "circular_dependency", "member", F.concat(F.lit("Circular dependency: "), cycle_text(F.col("members"))), cycle=F.col("members"))


def isolated(metrics: DataFrame) -> DataFrame:
    rows = metrics.where(F.col("is_dead") & F.col("language").isin(ISOLATION_LANGUAGES))
    return _issue(rows, 2, "low", "isolated_file", "rel_path", F.lit("File has no imports and is not imported anywhere (dead file)"))


def excessive(metrics: DataFrame, threshold: int = EXCESSIVE_DEPENDENCIES) -> DataFrame:
    message = F.format_string(f"File has %d local dependencies (threshold: {threshold})", "out_degree")
    return _issue(metrics.where(F.col("out_degree") >= threshold), 3, "medium", "excessive_dependencies", "rel_path", message)


def containing(texts: DataFrame, words: DataFrame, key: str = "key", text: str = "text", most_shared: int = WORDS_SHARED) -> DataFrame:
    """key and word of each text and each word that it contains as a substring.

    Up to most_shared distinct words are sent to the scan of the texts as one search automaton. More stay a table, and
    are joined (`containing_by_grams`) with the same rows.
    """
    distinct = settled(words.select("word").where("word <> ''").distinct(), "words")
    if distinct.count() > most_shared:
        return containing_by_grams(texts, distinct, key, text)
    chosen = [r["word"] for r in distinct.collect()]  # at most most_shared
    if not chosen:
        return texts.select(key, F.lit("").alias("word")).where("false")
    return texts.select(key, F.explode(_found_in(chosen)(text)).alias("word"))


def gram_hashes(text: str, sizes: Iterable[int]) -> np.ndarray:
    """64-bit hashes of all runs of `sizes` characters; runs of different sizes are told apart."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    out = []
    for size in sizes:
        if len(codes) >= size:
            h = np.full(len(codes) - size + 1, size, np.uint64)
            for i in range(size):
                h = (h ^ codes[i : len(codes) - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            out.append(h)
    return np.unique(np.concatenate(out)).view(np.int64) if out else np.zeros(0, np.int64)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _word_grams(words: pd.Series) -> pd.Series:
    """A word's own hash if it is short, else those of its grams."""
    return words.map(lambda w: gram_hashes(w, [min(len(w), GRAM)]))


def _text_grams(sizes: list[int], bits: np.ndarray | None):
    """Hashes of a text's grams; with bits, of those whose bit is set."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def grams(texts: pd.Series) -> pd.Series:
        def of(t: str | None) -> np.ndarray:
            h = gram_hashes(t or "", sizes)
            if bits is None:
                return h
            at = h.view(np.uint64) % np.uint64(64 * len(bits))
            return h[(bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1]

        return texts.map(of)

    return grams


def containing_by_grams(texts: DataFrame, words: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """As containing, for any number of distinct words: an inverted index of grams, verified.

    A word is looked up by one gram of GRAM characters, the one that is rarest in SAMPLE_TEXTS of the texts (which one
    decides the work only, not the rows); a shorter word is its own gram. The grams of the texts pass a table of bits of
    the words' grams first (at most MOST_BITS bits, whatever the words), so only texts that may hold a word are joined;
    both sides of that join are plain tables, which Spark splits where a gram is in very many texts. Pairs that meet are
    verified in the text. Texts are read twice, for their grams and for the proof, and no word passes the driver.
    """
    grams = settled(words.select("word", F.explode(_word_grams("word")).alias("gram")), "grams")
    sizes = [r["s"] for r in words.select(F.least(F.length("word"), F.lit(GRAM)).alias("s")).distinct().collect()]  # at most GRAM
    sample = texts.select(F.col(text).alias("t")).limit(SAMPLE_TEXTS).select(F.explode(_text_grams(sizes, None)("t")).alias("g"))
    common = sample.groupBy("g").agg(F.count("*").alias("n")).where("n > 1")
    rated = grams.join(common, F.col("gram") == F.col("g"), "left").select("word", "gram", F.coalesce("n", F.lit(0)).alias("n"))
    rarest = settled(rated.groupBy("word").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram")), "rarest")
    n_bits = min(MOST_BITS, max(1 << 16, 1 << (16 * rarest.count()).bit_length()))
    place = F.expr(f"gram & {n_bits - 1}L")
    packed = rarest.select(F.shiftright(place, 6).alias("at"), F.expr("shiftleft(1L, cast(gram & 63 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    bits = np.zeros(n_bits // 64, np.int64)  # at most MOST_BITS
    bits[packed["at"].to_numpy(np.int64)] = packed["bits"].to_numpy(np.int64)
    held = texts.select(F.col(key).alias("k"), F.explode(_text_grams(sizes, bits.view(np.uint64))(text)).alias("g"))
    meet = settled(held.join(rarest, F.col("g") == F.col("gram")).select("k", "word").distinct(), "meet")
    proven = texts.select(key, text).join(meet, F.col(key).eqNullSafe(F.col("k"))).where(F.col(text).contains(F.col("word")))
    return proven.select(key, "word")


def _found_in(words: list[str]):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        machine = ahocorasick.Automaton()  # one for a task
        for w in words:
            machine.add_word(w, w)
        machine.make_automaton()
        for texts in batches:
            yield texts.map(lambda t: sorted({w for _, w in machine.iter(t)}) if t else [])

    return found


def unused_functions(functions: DataFrame, analyses: DataFrame) -> DataFrame:
    """functions: rel_path, name. Those whose name is in no other file's text; a row for each definition."""
    tested = functions.where(~F.col("name").startswith("_") & ~F.col("name").isin(*ALWAYS_USED_FUNCTIONS) & (F.length("name") > 2))
    holders = containing(analyses, tested.select(F.col("name").alias("word")), "rel_path", "source")
    spread = holders.groupBy("word").agg(F.min("rel_path").alias("first"), F.max("rel_path").alias("last"))
    elsewhere = (F.col("first") != F.col("rel_path")) | (F.col("last") != F.col("rel_path"))
    rows = tested.join(spread, F.col("name") == F.col("word"), "left").where(~F.coalesce(elsewhere, F.lit(False)))
    return _issue(rows, 4, "low", "unused_function", "rel_path", F.concat(F.lit("Function '"), "name", F.lit("' appears unused outside its own file")))


def missing_imports(imports: DataFrame, files: DataFrame, known: Iterable[str] | DataFrame = KNOWN_PACKAGES) -> DataFrame:
    """Python imports that are neither known packages (names, or a table with name) nor stems of files; a row for each
    occurrence."""
    stems = files.select(F.col("stem").alias("name")).distinct()
    python = imports.where("language = 'Python'")
    unknown = python.join(known.select("name").distinct(), "name", "left_anti") if isinstance(known, DataFrame) else python.where(~F.col("name").isin(*known))
    rows = unknown.join(stems, "name", "left_anti")
    return _issue(rows, 5, "low", "missing_import", "rel_path", F.concat(F.lit("Import '"), "name", F.lit("' not found locally or in known packages")))


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def by_severity(issues: DataFrame) -> DataFrame:
    """severity and n for high, medium and low, 0 included, with the console's level."""
    counted = issues.groupBy("severity").agg(F.count("*").alias("n"))
    rows = [(s, level) for s, level in CONSOLE_LEVELS.items()]
    domain = issues.sparkSession.createDataFrame(rows, "severity string, console string")
    return domain.join(counted, "severity", "left").select("severity", "console", F.coalesce("n", F.lit(0)).alias("n"))


def pivot(issues: DataFrame, key: str = "file") -> DataFrame:
    """high, medium, low and weight (3, 2 and 1 each) of each file that has issues."""
    counts = [F.count_if(F.col("severity") == s).cast("int").alias(s) for s in SEVERITY_WEIGHTS]
    weight = sum(F.col(s) * w for s, w in SEVERITY_WEIGHTS.items())
    return issues.groupBy(key).agg(*counts).withColumn("weight", weight)


def console(issues: DataFrame) -> DataFrame:
    """Entries of a console: level, file, message and line."""
    level = F.create_map(*[F.lit(x) for pair in CONSOLE_LEVELS.items() for x in pair])[F.col("severity")]
    return issues.select(F.coalesce(level, F.lit("INFO")).alias("level"), "file", "message", "line")
