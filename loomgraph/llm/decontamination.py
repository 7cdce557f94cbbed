"""Benchmark decontamination by greedy string tiling.

Texts are lower-cased words (letters and digits). A seed is a hash of `least` words in a row, or of all words of a
shorter item. Documents are reduced to the seeds that some item has; joined with the items' seeds on the hash they
give pairs of positions. For each document and item, the longest run of pairs along a diagonal whose places are still
free is marked, again and again, and the share of the item's words under marks is its coverage: it does not matter in
which order the passages stand. Hashes are Karp-Rabin sums over the words.

The items' seed hashes go to the scan of the documents while their number is at most `most_shared`; beyond that all
seeds of the documents are joined, with the same result.

Defined cases: null and empty texts match nothing; items that repeat are matched one by one; documents that repeat
(id and text) are one document; a null doc_id is an id of its own.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from loomgraph.llm.common import doc_key, key_id, same_row

LEAST = 5
COVERAGE = 0.5
MOST_SHARED = 2_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)
WORDS = re.compile(r"[^\W_]+")


def _words(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def _hashes(words: list[str], known: dict[str, int], n: int) -> np.ndarray:
    """Karp-Rabin hashes of all n words in a row; known keeps hashes of words."""
    own = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        x = known.get(w)
        if x is None:
            x = known[w] = xxh64_intdigest(w.encode("utf-8", "replace"))
        own[i] = x
    return _rolled(own, n)


def _rolled(own: np.ndarray, n: int) -> np.ndarray:
    if len(own) < n:
        return np.zeros(0, np.int64)
    out = np.zeros(len(own) - n + 1, np.uint64)
    for k in range(n):
        out = out * BASE + own[k : len(own) - n + 1 + k]
    return (out ^ (out >> np.uint64(29))).view(np.int64)


def item_seeds(items: DataFrame, least: int = LEAST) -> DataFrame:
    """item, n_words, width, at, seed of every item; width is the words in a seed."""

    def seeds(batches):
        for batch in batches:
            known: dict[str, int] = {}
            out = []
            for item, text in zip(batch["item"], batch["text"], strict=True):
                words = _words(text)
                width = min(least, len(words))
                if width:
                    out += [(item, len(words), width, i, int(h)) for i, h in enumerate(_hashes(words, known, width))]
            yield pd.DataFrame(out, columns=["item", "n_words", "width", "at", "seed"])

    kind = dict(items.dtypes)["item"]
    return items.mapInPandas(seeds, f"item {kind}, n_words int, width int, at int, seed long")


def _document_seeds(docs: DataFrame, widths: list[int], wanted: dict[int, np.ndarray] | None) -> DataFrame:
    """docs: d, text. d, width, place, seed of the documents' seeds, only the wanted ones if given."""

    def vocabulary_hash(word: str) -> int:
        return xxh64_intdigest(word.encode("utf-8", "replace"))

    def seeds(batches):
        known: dict[str, int] = {}
        for batch in batches:
            if len(known) > 500_000:
                known.clear()
            row, width, place, seed = [], [], [], []
            for i, text in enumerate(batch["text"]):
                words = _words(text)
                if not words:
                    continue
                for w in set(words).difference(known):
                    known[w] = vocabulary_hash(w)
                own = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                for n in widths:
                    found = _rolled(own, n)
                    if wanted is None:
                        at = np.arange(len(found))
                    else:
                        w = wanted[n]
                        at = np.flatnonzero(w[np.minimum(np.searchsorted(w, found), len(w) - 1)] == found)
                    if len(at):
                        row.append(np.full(len(at), i))
                        width.append(np.full(len(at), n, np.int32))
                        place.append(at.astype(np.int32))
                        seed.append(found[at])
            if row:
                rows = np.concatenate(row)
                out = {c: batch[c].to_numpy()[rows] for c in ("dn", "di", "dh")}
                yield pd.DataFrame(out | {"width": np.concatenate(width), "place": np.concatenate(place), "seed": np.concatenate(seed)})

    flat = docs.select(F.col("d.n").alias("dn"), F.col("d.i").alias("di"), F.col("d.h").alias("dh"), "text")
    return flat.mapInPandas(seeds, "dn int, di long, dh long, width int, place int, seed long").select(
        F.struct(F.col("dn").alias("n"), F.col("di").alias("i"), F.col("dh").alias("h")).alias("d"), "width", "place", "seed"
    )


def tile(places: list[int], ats: list[int], width: int) -> tuple[int, int]:
    """Greedy string tiling over pairs of equal seeds: words marked in the item, and number of tiles."""
    diagonals = defaultdict(list)
    for p, a in sorted(set(zip(places, ats, strict=True))):
        diagonals[p - a].append(p)
    runs = []  # (words, place, at)
    for shift, firsts in diagonals.items():
        start = last = firsts[0]
        for p in [*firsts[1:], None]:
            if p is None or p != last + 1:
                runs.append((last - start + width, start, start - shift))
                start = p
            last = p
    by_length = defaultdict(list)
    for n, p, a in runs:
        by_length[n].append((p, a))
    used_p: set[int] = set()
    used_a: set[int] = set()
    words = tiles = 0
    n = max(by_length)
    while n >= width:
        for p, a in sorted(by_length.pop(n, ())):
            free = [p + k not in used_p and a + k not in used_a for k in range(n)]
            if all(free):
                used_p.update(range(p, p + n))
                used_a.update(range(a, a + n))
                words, tiles = words + n, tiles + 1
                continue
            begin = None
            for k, ok in enumerate([*free, False]):  # what is still free is tried again in its turn
                if ok and begin is None:
                    begin = k
                elif not ok and begin is not None:
                    if k - begin >= width:
                        by_length[k - begin].append((p + begin, a + begin))
                    begin = None
        n = max(by_length, default=0)
    return words, tiles


@F.pandas_udf(T.StructType().add("words", "integer").add("tiles", "integer"))
def _tiled(pairs: pd.Series, width: pd.Series) -> pd.DataFrame:
    out = [tile([x["place"] for x in p], [x["at"] for x in p], int(w)) for p, w in zip(pairs, width, strict=True)]
    return pd.DataFrame(out, columns=["words", "tiles"])


def contamination(docs: DataFrame, items: DataFrame, least: int = LEAST, coverage: float = COVERAGE, most_shared: int = MOST_SHARED,
                  id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """d (a doc_key), item, item_words, covered_words, tiles, coverage of each pair with at least that coverage."""
    items = items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    seeds = item_seeds(items, least)
    distinct = seeds.select("width", "seed").distinct()
    per_width = {r["width"]: r["n"] for r in distinct.groupBy("width").agg(F.count("*").alias("n")).collect()}
    wanted = None
    if per_width and sum(per_width.values()) <= most_shared:
        wanted = {n: [] for n in per_width}
        for r in distinct.toLocalIterator():
            wanted[r["width"]].append(r["seed"])
        wanted = {n: np.sort(np.array(x, np.int64)) for n, x in wanted.items()}
    slim = docs.select(doc_key(F.col(id_col), F.col(text_col)).alias("d"), F.col(text_col).alias("text"))
    hits = _document_seeds(slim, sorted(per_width), wanted).distinct()
    pairs = hits.join(seeds, ["width", "seed"])
    grouped = pairs.groupBy("d", "item", "n_words", "width").agg(F.collect_list(F.struct("place", "at")).alias("pairs"))
    tiled = grouped.withColumn("t", _tiled("pairs", "width"))
    share = F.col("t.words") / F.col("n_words")
    return tiled.select(
        "d", "item", F.col("n_words").alias("item_words"), F.col("t.words").alias("covered_words"), "t.tiles", share.alias("coverage")
    ).where(F.col("coverage") >= coverage)


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, item_words, covered_words, tiles and coverage of every document that holds an item."""
    found = contamination(docs, items)
    return found.select(key_id(F.col("d")).alias("doc_id"), F.col("item").alias("item_id"), "item_words", "covered_words", "tiles", "coverage")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no item."""
    found = contamination(docs, items).select(F.col("d").alias("f")).distinct()
    rows = docs.select(F.struct("*").alias("row"), doc_key(docs["doc_id"], docs["text"]).alias("d"))
    return rows.join(found, same_row(F.col("d"), F.col("f")), "left_anti").select("row.*")
