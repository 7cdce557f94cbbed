"""What a user can add without code: languages by suffix, keywords of a language, known packages."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from loomgraph.functions.constants import COMPLEXITY_KEYWORDS, KNOWN_PACKAGES, LANGUAGES

#: Rows of a table of languages or keywords, which are sent to all tasks, at most.
MOST_ROWS = 10_000


def _few(rows: DataFrame, *columns: str) -> list[tuple]:
    found = rows.select(*columns).distinct().limit(MOST_ROWS + 1).collect()
    if len(found) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} settings")
    return sorted(tuple(r) for r in found)


@dataclass(frozen=True)
class Settings:
    """languages: language by lower-case suffix; keywords: by language, `default` for all others; packages: names, or a
    table of any size with a column name."""

    languages: Mapping[str, str] = field(default_factory=lambda: LANGUAGES)
    keywords: Mapping[str, list[str]] = field(default_factory=lambda: COMPLEXITY_KEYWORDS)
    packages: Iterable[str] | DataFrame = frozenset(KNOWN_PACKAGES)

    @classmethod
    def from_tables(cls, languages: DataFrame | None = None, keywords: DataFrame | None = None, packages: DataFrame | None = None) -> Settings:
        """The library's settings with those of tables in addition: languages (ext, language), keywords (language,
        keyword; a language's rows replace its keywords), packages (name)."""
        known, words = dict(LANGUAGES), dict(COMPLEXITY_KEYWORDS)
        if languages is not None:
            known |= {ext.lower(): language for ext, language in _few(languages, "ext", "language")}
        if keywords is not None:
            own: dict[str, list[str]] = {}
            for language, keyword in _few(keywords, "language", "keyword"):
                own.setdefault(language, []).append(keyword)
            words |= own
        if packages is None:
            return cls(known, words)
        standard = packages.sparkSession.createDataFrame([(p,) for p in sorted(KNOWN_PACKAGES)], "name string")
        return cls(known, words, packages.select("name").union(standard))
