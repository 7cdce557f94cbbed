"""Streams of console entries and model answers (an extension: the batch operators over Structured Streaming).

Entries are rows of ts, level, file and message. Counts are kept by window and level with a watermark for late rows;
answers that arrive token by token are folded to one text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def level_counts(entries: DataFrame, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """start, level and n of each window; for batch and streaming tables alike."""
    watched = entries.withWatermark("ts", late) if entries.isStreaming else entries
    counts = watched.groupBy(F.window("ts", window), "level").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), "level", "n")


def visible(entries: DataFrame, levels: list[str] | None = None) -> DataFrame:
    """The entries of the chosen levels, all if none is chosen."""
    return entries.where(F.col("level").isin(levels)) if levels else entries


def answers(tokens: DataFrame) -> DataFrame:
    """tokens: answer, pos, token. One text for each answer, its tokens in order."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "token")))
    return tokens.groupBy("answer").agg(F.array_join(F.transform(ordered, lambda x: x["token"]), "").alias("text"))
