"""What several operators of this subpackage share."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.session import scratch

#: The ASCII white space that separates words, as a regular expression's class.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = [9, 10, 11, 12, 13, 32]
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of a text that are hashed at a time.
PIECE_BYTES = 1 << 16
#: Characters of all texts for each task beyond those that keep the cores busy, about, and rows of hashes in a file.
TASK_CHARS, FILE_ROWS = 8_000_000, 1_000_000


def written(df: DataFrame, name: str, tasks: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: it is computed once and outlives its executors.

    tasks: the most that compute it last, and so its files at most; more partitions than that are many small ones.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    (df.coalesce(tasks) if tasks else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks_for(spark: SparkSession, chars: int) -> int:
    """Tasks that are enough for tables made from texts of so many characters: two a core and one for each TASK_CHARS."""
    return 2 * spark.sparkContext.defaultParallelism + chars // TASK_CHARS


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def doc_key(doc_id: Column, text: Column) -> Column:
    """Orders and tells apart documents: by id, null last, then by text.

    Rows that repeat both are one document.
    """
    return F.struct(
        doc_id.isNull().cast("int").alias("n"),
        F.coalesce(doc_id.cast("long"), F.lit(0)).alias("i"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"),
    )


def text_hash(text: Column) -> Column:
    """128 bits that tell texts apart; null for a null text."""
    return F.unhex(F.md5(text.cast("binary")))


def key_id(key: Column) -> Column:
    """The doc_id within a doc_key."""
    return F.when(key["n"] == 0, key["i"])


def same_row(a: Column, b: Column) -> Column:
    """Equality of doc_keys, field by field so that Spark joins on plain columns."""
    return (a["i"] == b["i"]) & (a["h"] == b["h"]) & (a["n"] == b["n"])


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; null for a null doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def blanks(*more: int) -> np.ndarray:
    """For each byte whether it separates words."""
    out = np.zeros(256, np.bool_)
    out[[*BLANKS, *more]] = True
    return out


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, modulo 2**64."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)])) for x in (BASE, inverse))


def _pieces(raw: bytes, blank: re.Pattern = re.compile(rb"[\x20\x09-\x0D]")) -> Iterator[bytes]:
    """The bytes in pieces that end where words end, of about PIECE_BYTES."""
    at = 0
    while at < len(raw):
        found = blank.search(raw, at + PIECE_BYTES)
        end = found.start() if found else len(raw)
        yield raw[at:end]
        at = end


def hashed_words(raw: bytes, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, length and last byte of each word of a text; space: as of blanks().

    A word's hash is a mixed polynomial of its bytes, from differences of running sums, so no word is an object.
    """
    out = []
    for piece in _pieces(raw):
        data = np.frombuffer(piece, np.uint8)
        blank = space[data]
        edges = np.concatenate([[0], np.flatnonzero(blank[1:] != blank[:-1]) + 1, [len(data)]])[int(blank[0]) :]
        start, end = edges[: len(edges) // 2 * 2 : 2], edges[1::2]
        up, down = _powers(max(2 * PIECE_BYTES, 1 << len(data).bit_length()))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        h = (sums[end] - sums[start]) * down[start]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        out.append((h, end - start, data[end - 1]))
    if len(out) == 1:
        return out[0]
    return tuple(np.concatenate([x[k] for x in out]) for k in range(3)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8))
