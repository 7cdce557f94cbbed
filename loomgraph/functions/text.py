"""Column functions over text and paths, all within the JVM."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions.constants import (
    CATEGORIES,
    COMPLEXITY_BANDS,
    COMPLEXITY_KEYWORDS,
    ERROR_MESSAGES,
    ERROR_NAMES,
    INTENTS,
    JAVA_IMPORTS,
    JAVA_METHODS,
    JS_FUNCTIONS,
    JS_IMPORTS,
    LANGUAGES,
    RISK_BANDS,
)


def count_substring(text: Column, part: str) -> Column:
    """Non-overlapping, case-sensitive occurrences."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def line_count(text: Column) -> Column:
    """Lines with universal line ends; an unterminated last line counts, an empty text has none."""
    unified = F.regexp_replace(text, "\r\n?", "\n")
    return F.size(F.split(unified, "\n", -1)) - F.when((unified == "") | unified.endswith("\n"), 1).otherwise(0)


def banded(value: Column, bands: tuple, low: str = "low", medium: str = "medium", high: str = "high", inclusive: bool = False) -> Column:
    """low up to the first band, medium up to the second, else high; inclusive: a band's value is of the next level."""
    first, second = bands
    if inclusive:
        return F.when(value >= second, high).when(value >= first, medium).otherwise(low)
    return F.when(value <= first, low).when(value <= second, medium).otherwise(high)


def complexity_score(text: Column, language: Column, keywords: Mapping[str, list[str]] = COMPLEXITY_KEYWORDS) -> Column:
    """Sum of the counts of the language's keywords; keywords that contain each other count twice."""
    score = sum(count_substring(text, k) for k in keywords["default"])
    for name, own in keywords.items():
        if name != "default":
            score = F.when(language == name, sum(count_substring(text, k) for k in own)).otherwise(score)
    return score.cast("int")


def complexity_level(score: Column) -> Column:
    return banded(score, COMPLEXITY_BANDS)


def risk_level(score: Column) -> Column:
    return banded(score, RISK_BANDS, inclusive=True)


def normal_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(name: Column) -> Column:
    """Last extension with its dot; none for a name whose only dot leads or ends it."""
    return F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)


def stem(name: Column) -> Column:
    return F.left(name, F.length(name) - F.length(suffix(name)))


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def path_prefixes(path: Column) -> Column:
    """All proper prefixes by parts, the shortest first."""
    parts = F.split(path, "/")
    steps = F.sequence(F.lit(1), F.size(parts) - 1)
    made = F.transform(steps, lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return F.when(F.size(parts) > 1, made).otherwise(F.array().cast("array<string>"))


def language_of(ext: Column, languages: Mapping[str, str] = LANGUAGES) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in languages.items() for x in pair])[F.lower(ext)], F.lit("Unknown"))


def category_of(ext: Column) -> Column:
    out = F.lit("other")
    for name, members in reversed(list(CATEGORIES.items())):
        out = F.when(F.lower(ext).isin(members), name).otherwise(out)
    return out


def intents(question: Column) -> Column:
    """Kinds of question by whole words, in the order of the table; `general` if none."""
    found = F.array_compact(F.array(*[F.when(question.rlike(f"(?iU){pattern}"), name) for name, pattern in INTENTS.items()]))
    return F.when(F.size(found) == 0, F.array(F.lit("general"))).otherwise(found)


def truncated(text: Column, most: int, mark: str) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit(mark))).otherwise(text)


def confidence(text: Column) -> Column:
    """First `confidence: n%`, at most 100; null if there is none."""
    found = F.regexp_extract(text, r"[Cc]onfidence:\s*(\d{1,3})\s*%", 1)
    return F.when(found != "", F.least(found.try_cast("int"), F.lit(100)))


def without_confidence(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\n?[Cc]onfidence:\s*\d{1,3}\s*%\s*$", ""), r"\s+$", "")


def humanised_bytes(size: Column) -> Column:
    one = lambda x, unit: F.format_string(f"%.1f {unit}", x.cast("double"))
    return (
        F.when(F.coalesce(size, F.lit(0)) == 0, "0 B")
        .when(size < 1024, one(size, "B")).when(size < 1024 * 1024, one(size / 1024, "KB")).otherwise(one(size / (1024 * 1024), "MB"))
    )


def error_class(name: Column, message: Column) -> Column:
    """Kind of a failed model request, by the error's name and message; the first that fits."""
    kind = F.lit("other")
    for k in reversed(ERROR_NAMES):
        marks = [name.contains(x) for x in ERROR_NAMES[k]] + [F.lower(message).contains(x) for x in ERROR_MESSAGES[k]]
        kind = F.when(reduce(or_, marks), k).otherwise(kind)
    return kind


def js_imports(source: Column) -> Column:
    """Static, required and dynamic imports, one pattern after another; packages by their first part."""
    found = F.concat(*[F.regexp_extract_all(source, F.lit(p), F.lit(1)) for p in JS_IMPORTS])
    package = lambda x: F.regexp_replace(F.substring_index(x, "/", 1), "^@+", "")
    return F.transform(found, lambda x: F.when(x.startswith("."), x).otherwise(package(x)))


def js_functions(source: Column) -> Column:
    first, second, third = (F.regexp_extract_all(source, F.lit(JS_FUNCTIONS), F.lit(k)) for k in (1, 2, 3))
    both = lambda a, b: F.concat(a, b)
    joined = F.zip_with(F.zip_with(first, second, both), third, both)
    return F.filter(joined, lambda x: x != "")


def java_imports(source: Column) -> Column:
    return F.transform(F.regexp_extract_all(source, F.lit(JAVA_IMPORTS), F.lit(1)), lambda x: F.substring_index(x, ".", 1))


def java_functions(source: Column) -> Column:
    return F.regexp_extract_all(source, F.lit(JAVA_METHODS), F.lit(1))


def sse_tokens(body: Column) -> Column:
    """Payloads of the `data: ` lines of an event stream, up to [DONE]."""
    lines = F.filter(F.split(body, "\n"), lambda x: x.startswith("data: "))
    payloads = F.transform(lines, lambda x: F.trim(F.substring(x, 7, 1 << 30)))
    done = F.array_position(payloads, "[DONE]")
    return F.when(done > 0, F.slice(payloads, F.lit(1), (done - 1).cast("int"))).otherwise(payloads)


def streamed_answer(body: Column) -> Column:
    """content and confidence of an event stream of JSON objects: contents joined, the last confidence there is.

    Payloads that are no JSON are left out.
    """
    parsed = F.transform(sse_tokens(body), lambda x: F.from_json(x, "content string, confidence double"))
    content = F.array_join(F.transform(parsed, lambda x: F.coalesce(x["content"], F.lit(""))), "")
    told = F.filter(F.transform(parsed, lambda x: x["confidence"]), lambda c: c.isNotNull())
    return F.struct(content.alias("content"), F.try_element_at(told, F.lit(-1)).alias("confidence"))
