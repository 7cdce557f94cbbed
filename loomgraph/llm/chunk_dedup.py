"""Substring deduplication by content-defined chunking.

A gear hash rolls over the UTF-8 bytes of a text (its value depends on the last 32 bytes); where it is small enough
there is a cut, on average every `spacing` bytes, moved to the end of the word if that is near and else to the next
code point. Cuts depend on the bytes just before and after them, so an insertion shifts them but changes only the
chunks that it touches. From each cut, and from a text's start, a chunk runs to the first cut (or the text's end) that
is at least `least` bytes away: chunks are variable, overlap, and start at every cut, so a passage that repeats is found
whatever stands around it once it has two cuts that far apart.

Chunks are deduplicated by digest: where a digest is in more than one document, the first (by doc_id, null last) keeps
its chunk. Chunks that touch and have the same first document at the same distance make a run. A run is compared with
the first document's bytes by a 128-bit digest and is extended on both sides, byte by byte, to the ends of what the two
texts share. Runs that touch make a passage; it is removed if it has `shortest` bytes or is a whole text. Digests are
counted with map-side sums and joined back as plain rows, which Spark can split, so a chunk that a third of all
documents share is no group of its own.

Defined cases: null text stays null, empty text empty; repeats within one document stay; rows that repeat doc_id and
text are one document; a whole text is a chunk too, so that exact copies are found whatever their length. A run is
extended by at most `CONTEXT` bytes on a side, which is more than two chunks have: what a passage has further out has
cuts of its own, so runs of its own. Where a passage repeats itself (one letter over and over), up to LEAST bytes at an end
may stay, since its runs meet the first such place of the first document. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from loomgraph.llm.common import doc_key, written

SPACING = 32
LEAST = 32
#: Bytes of a passage that is worth removing; runs that touch or overlap are one passage.
SHORTEST = 200
WINDOW = 32
#: Bytes that a cut is moved at most, to the end of a word, and those that a run is extended at most.
MOVED = 24
CONTEXT = 640
#: Bytes between two places of a cut at most, and those on either side that a place's hash is the least of, beyond that.
LARGEST = 192
NEAR = 32
#: The gear table: a random number for each byte.
GEAR = np.random.default_rng(20240607).integers(0, 1 << 32, 256, dtype=np.uint32)
#: ASCII white space, at which words end.
SPACE = np.zeros(256, np.bool_)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def gear_hash(data: np.ndarray) -> np.ndarray:
    """Rolling hash of the last WINDOW bytes at each byte: h = 2 h + gear[byte], in 32 bits.

    The sum over a window of twice the width is that of the right half plus that of the left half moved up.
    """
    h, width = GEAR[data], 1
    while width < WINDOW:
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        width *= 2
    return h


def filled(h: np.ndarray, small: np.ndarray) -> np.ndarray:
    """The places, with more where two are over LARGEST apart: those whose hash is the least of NEAR bytes on either side,
    at least LEAST apart, and where these do not do either, one each LARGEST bytes."""
    edges = np.r_[0, small, len(h)]
    more = [small]
    for k in np.flatnonzero(np.diff(edges) > LARGEST):
        a, b = edges[k] + 1, edges[k + 1]
        around = np.pad(h[a:b], NEAR, constant_values=(1 << 32) - 1)
        low = a + np.flatnonzero(h[a:b] == np.lib.stride_tricks.sliding_window_view(around, 2 * NEAR + 1).min(1))
        at, kept = edges[k], []
        while (i := np.searchsorted(low, at + LEAST)) < len(low):
            at = low[i]
            kept.append(at)
        stops = np.r_[edges[k], np.array(kept, np.int64), b]
        forced = [np.arange(x + LARGEST, y, LARGEST) for x, y in zip(stops[:-1], stops[1:], strict=True) if y - x > LARGEST]
        more += [stops[1:-1], *forced]
    return np.unique(np.concatenate(more)) if len(more) > 1 else small


def cuts(data: np.ndarray, spacing: int = SPACING) -> np.ndarray:
    """Places of cuts: each is the start of the word or the code point after a place where the hash is small."""
    h = gear_hash(data)
    small = np.flatnonzero(h < np.uint32((1 << 32) // spacing))
    small = filled(h, small[small >= WINDOW - 1])
    if not len(small):
        return small
    # what stands in for a gap beyond the end is too far away
    gaps, points = (np.r_[np.flatnonzero(x), len(data) + MOVED] for x in (SPACE[data], (data & 0xC0) != 0x80))
    word = gaps[np.searchsorted(gaps, small)] + 1
    point = points[np.searchsorted(points, small + 1)]
    at = np.unique(np.where(word - small <= MOVED, word, point))
    return at[at < len(data)]


def chunks(text: str | None, spacing: int = SPACING, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Start, end (in bytes) and digest of each chunk of a text, the whole of it first."""
    raw = text.encode("utf-8", "replace") if text else b""
    if not raw:
        return []
    at = np.r_[0, cuts(np.frombuffer(raw, np.uint8), spacing), len(raw)]
    ends = np.searchsorted(at, at + least)
    whole = ends < len(at)
    spans = zip(at[whole].tolist(), at[ends[whole]].tolist(), strict=True)
    return [(0, len(raw), _digest(raw)), *((a, b, _digest(raw[a:b])) for a, b in spans if b - a < len(raw))]


def _digest(raw: bytes) -> int:
    h = xxh64_intdigest(raw)
    return h - (1 << 64) if h >> 63 else h


def chunk_table(docs: DataFrame, spacing: int = SPACING, least: int = LEAST) -> DataFrame:
    """docs: d (a doc_key), text. d's fields as n, i, h, and digest and span of each chunk.

    span holds start and length in one number: start * 2**24 + length; a chunk over 2**24 bytes is a whole text, whose
    length is given as 0.
    """

    def table(batches):
        for batch in batches:
            row, digest, span = [], [], []
            for k, text in enumerate(batch["text"]):
                found = chunks(text, spacing, least)
                row += [k] * len(found)
                digest += [x[2] for x in found]
                span += [(a << 24) + (b - a if b - a < 1 << 24 else 0) for a, b, _ in found]
                if len(row) > 200_000:
                    yield frame(batch, row, digest, span)
                    row, digest, span = [], [], []
            yield frame(batch, row, digest, span)

    def frame(batch, row, digest, span):
        out = {c: batch[c].to_numpy()[row] for c in ("n", "i", "h")} if row else {c: [] for c in ("n", "i", "h")}
        return pd.DataFrame(out | {"digest": digest, "span": span})

    flat = docs.select("d.n", "d.i", "d.h", "text")
    return flat.mapInPandas(table, "n int, i long, h long, digest long, span long")


RUN = T.StructType().add("n", "integer").add("i", "long").add("h", "long").add("start", "long").add("size", "long").add("first_start", "long")


@F.pandas_udf(T.ArrayType(RUN))
def _runs(repeated: pd.Series) -> pd.Series:
    """Of a document's repeated chunks (span, first): the chunks that touch, by first document and distance."""
    out = []
    for own in repeated:
        by_first = {}
        for x in own:
            f, start, size = x["first"], int(x["span"]) >> 24, int(x["span"]) & 0xFFFFFF
            key = f["n"], f["i"], f["h"], (int(f["span"]) >> 24) - start
            by_first.setdefault(key, []).append((start, start + size if size else 1 << 40))
        runs = []
        for (n, i, h, shift), spans in by_first.items():
            # a whole text over 2**24 bytes has no end here
            runs += [(n, i, h, a, b - a if b < 1 << 40 else 0, a + shift) for a, b in merged(spans)]
        out.append([dict(zip(RUN.names, r, strict=True)) for r in runs])
    return pd.Series(out)


def repeats(docs: DataFrame, spacing: int = SPACING, least: int = LEAST) -> DataFrame:
    """docs: d, text. d and run (see RUN) of the runs of chunks that an earlier document has."""
    table = chunk_table(docs, spacing, least)
    held = table.groupBy("digest").agg(F.min(F.struct("n", "i", "h", "span")).alias("first"), F.count("*").alias("times")).where("times > 1")
    held = written(held.select(F.col("digest").alias("g"), "first"), "held")
    d = F.struct("n", "i", "h")
    shared = table.join(held, F.col("digest") == F.col("g")).where(d != F.struct("first.n", "first.i", "first.h"))
    return shared.groupBy(d.alias("d")).agg(F.collect_set(F.struct("span", "first")).alias("repeated")).select("d", F.explode(_runs("repeated")).alias("run"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans, those that touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


EDITED = (
    T.StructType().add("text", "string").add("n_bytes", "long").add("removed_bytes", "long")
    .add("passages", T.ArrayType(T.StructType().add("start", "long").add("end", "long"))).add("repeats_of", T.ArrayType(T.LongType()))
)


def extended(raw: bytes, a: int, b: int, before: bytes, after: bytes) -> tuple[int, int]:
    """The run from a to b, with what is equal before and after it in the first document; whole code points."""
    low = np.frombuffer(raw, np.uint8, min(len(before), a), a - min(len(before), a))[::-1]
    same = low == np.frombuffer(before, np.uint8)[::-1][: len(low)]
    start = a - (len(same) if same.all() else int(same.argmin()))
    high = np.frombuffer(raw, np.uint8, min(len(after), len(raw) - b), b)
    same = high == np.frombuffer(after, np.uint8)[: len(high)]
    end = b + (len(same) if same.all() else int(same.argmin()))
    while start < a and raw[start] & 0xC0 == 0x80:
        start += 1
    while end > b and end < len(raw) and raw[end] & 0xC0 == 0x80:
        end -= 1
    return start, end


@F.pandas_udf(EDITED)
def _without(texts: pd.Series, runs: pd.Series, shortest: pd.Series) -> pd.DataFrame:
    out = []
    for text, own, least in zip(texts, runs, shortest, strict=True):
        raw = text.encode("utf-8", "replace") if text else b""
        spans = {}
        for x in own if own is not None else ():
            a, b = int(x["start"]), int(x["start"]) + int(x["size"] or len(raw))
            if hashlib.md5(raw[a:b]).digest() == bytes(x["md5"]):
                spans.setdefault(extended(raw, a, b, bytes(x["before"]), bytes(x["after"])), []).append(x["first"])
        gone = [(a, b) for a, b in merged(list(spans)) if b - a >= least or b - a == len(raw)]
        kept, at = [], 0
        for a, b in gone:
            kept.append(raw[at:a])
            at = b
        left = b"".join([*kept, raw[at:]]).decode("utf-8") if gone else text
        whom = {int(f) for (a, _), firsts in spans.items() if any(x <= a < y for x, y in gone) for f in firsts if f is not None and f == f}
        out.append((left, len(raw), sum(b - a for a, b in gone), [{"start": a, "end": b} for a, b in gone], sorted(whom)))
    return pd.DataFrame(out, columns=EDITED.names)


def dedup(docs: DataFrame, spacing: int = SPACING, least: int = LEAST, shortest: int = SHORTEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (the document as a struct), text without repeats, n_bytes, removed_bytes, passages (start and end in bytes
    of what was removed) and repeats_of (doc_ids of the documents that keep them).

    Texts are shuffled once, by document: the join that tells runs what their first documents hold there and the join
    that brings the runs to their documents read the same shuffle, so both use the whole row.
    """
    key = doc_key(F.col(id_col), F.col(text_col))
    found = repeats(docs.select(key.alias("d"), F.col(text_col).alias("text")), spacing, least)
    rows = docs.select(F.struct("*").alias("row"), key["i"].alias("i"), key["h"].alias("h"), key["n"].alias("n"))
    wanted = found.select("d", F.col("run.i").alias("fi"), F.col("run.h").alias("fh"), F.col("run.n").alias("fn"), "run.start", "run.size", F.col("run.first_start").alias("at"))
    raw = F.col(f"row.{text_col}").cast("binary")
    size = F.when(F.col("size") > 0, F.col("size")).otherwise(F.octet_length(raw))
    before = F.least("at", F.lit(CONTEXT))
    cut = lambda start, n: F.substring(raw, (start + 1).cast("int"), n.cast("int"))
    there = rows.join(wanted, (F.col("i") == F.col("fi")) & (F.col("h") == F.col("fh")) & (F.col("n") == F.col("fn")))
    digest = F.when(F.hash("row") >= -(1 << 31), F.unhex(F.md5(cut(F.col("at"), size))))  # always so; it keeps the row whole
    told = there.select(
        "d", F.col("start"), F.col("size"), digest.alias("md5"), cut(F.col("at") - before, before).alias("before"),
        cut(F.col("at") + size, F.lit(CONTEXT)).alias("after"), F.when(F.col("n") == 0, F.col("i")).alias("first"),
    )
    own = told.groupBy("d").agg(F.collect_set(F.struct("start", "size", "md5", "before", "after", "first")).alias("runs"))
    own = own.select(F.col("d.i").alias("ri"), F.col("d.h").alias("rh"), F.col("d.n").alias("rn"), "runs")
    joined = rows.join(own, (F.col("i") == F.col("ri")) & (F.col("h") == F.col("rh")) & (F.col("n") == F.col("rn")), "left")
    return joined.select("row", _without(F.col(f"row.{text_col}"), "runs", F.lit(shortest)).alias("x")).select("row", "x.*")


def dedup_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, removed_bytes, passages, repeats_of and the text that stays, of every document."""
    out = dedup(docs.select("doc_id", "text"))
    return out.select("row.doc_id", "n_bytes", "removed_bytes", "passages", "repeats_of", "text")
