"""Imports, functions and classes of source files, and compile checks.

Python goes through the standard library's parser in a child of each task; JavaScript, TypeScript and Java stay in
the JVM as regular expressions. Files of other languages keep only their text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.python_source import DEADLINE_S, Checker, compiled, defined
from loomgraph.functions.text import java_functions, java_imports, js_functions, js_imports

STRINGS = T.ArrayType(T.StringType())
PYTHON = (
    T.StructType().add("imports", STRINGS).add("functions", STRINGS).add("classes", STRINGS)
    .add("syntax_error", "string").add("compile_error", "string").add("compile_line", "integer").add("timed_out", "boolean")
)


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    """UTF-8 text with line ends unified; bad bytes are replaced."""
    text = content.map(lambda b: None if b is None else bytes(b).decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n"))
    return text


def python_facts(source: str) -> tuple:
    """imports, functions, classes, syntax_error, compile_error and compile_line of one source, found in this process."""
    return *defined(source), *compiled(source)


def _python(deadline_s: float):
    @F.pandas_udf(PYTHON)
    def facts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with Checker(deadline_s) as checker:  # one for a task
            for sources in batches:
                yield pd.DataFrame([checker.check(s or "") for s in sources], columns=PYTHON.names)

    return facts


def parse(files: DataFrame, deadline_s: float = DEADLINE_S) -> DataFrame:
    """files: rel_path, language, content. What the parser of each file's language finds, with its text as source.

    Python sources are parsed and compiled in a child process for each task. One that takes longer than deadline_s for a
    step has timed_out, one that ends the child has an error; the others of the batch go on.
    """
    none = F.array().cast("array<string>")
    text = files.withColumn("source", F.coalesce(decoded("content"), F.lit("")))
    is_python = F.col("language") == "Python"
    python = text.where(is_python).withColumn("p", _python(deadline_s)("source"))
    script = F.col("language").isin("JavaScript", "TypeScript")
    java = F.col("language") == "Java"
    rest = text.where(~is_python)
    keep = ["rel_path", "language", "scan_ordinal", "name", "source"]
    first = python.select(
        *keep, "p.imports", "p.functions", "p.classes", F.col("p.syntax_error").isNull().alias("syntax_ok"), "p.syntax_error",
        F.col("p.compile_error").isNull().alias("compile_ok"), "p.compile_error", "p.compile_line", "p.timed_out",
    )
    second = rest.select(
        *keep,
        F.when(script, js_imports(F.col("source"))).when(java, java_imports(F.col("source"))).otherwise(none).alias("imports"),
        F.when(script, js_functions(F.col("source"))).when(java, java_functions(F.col("source"))).otherwise(none).alias("functions"),
        none.alias("classes"), F.lit(True).alias("syntax_ok"), F.lit(None).cast("string").alias("syntax_error"),
        F.lit(None).cast("boolean").alias("compile_ok"), F.lit(None).cast("string").alias("compile_error"), F.lit(None).cast("int").alias("compile_line"), F.lit(False).alias("timed_out"),
    )
    return first.unionByName(second)


def exploded(analyses: DataFrame, column: str) -> DataFrame:
    """rel_path, pos and name of each import or function, in order, repeats kept."""
    return analyses.select("rel_path", "language", F.posexplode(column).alias("pos", "name"))
