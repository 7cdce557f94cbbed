"""SimHash fingerprints and their search by permuted block tables.

The terms of a text are its shingles of five lower-cased words (all words of a shorter text), weighted by 1 + ln(count).
Each term votes with its weight for or against each of 128 bits, by the bits of its hash; the fingerprint has the bits
that won. Likeness is the cosine that the Hamming distance stands for, cos(pi * distance / 128), at least 0.

One changed word changes five shingles, so fingerprints of near copies are far apart in bits. The search therefore has
a print of its own, with single words as terms: a text with a shingle similarity of 0.8 is about 8 bits away, and hardly
one more than 14. A table for each of five blocks of the bits, which it has in front, holds every print once. Two prints
within the radius differ in at most radius // 5 bits of one block, so a query is looked up in each table with every value
of its block that is so near, and candidates are compared in full. As a stated share of the table are queries, their many
values are about as many rows as the tables themselves. Equal prints are one entry of a table.

Defined cases: a null text is an empty one; a text without words has the fingerprint of zeros; rows that repeat doc_id
and text are one document in search; in a cycle of one document it is its own next.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from loomgraph.llm.common import doc_key, key_id, same_row, written

BITS = 128
WORDS = 5
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bits that prints of near copies may differ in, and bits of the blocks of a print.
RADIUS = 14
BLOCKS = (26, 26, 26, 26, 24)
#: Every so many ids one is a query.
QUERY_EVERY = 50


class SimHash:
    """Fingerprints as 32 hexadecimal digits."""

    def __init__(self, most_words: int = 400_000):
        self.known, self.most_words = {}, most_words

    def words(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.most_words:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxh64_intdigest(w.encode("utf-8", "replace"))
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def of(self, own: np.ndarray, n: int = WORDS) -> str:
        """From the hashes of a text's words; n words are a term."""
        if not len(own):
            return "0" * (BITS // 4)
        n = min(n, len(own))
        terms = np.zeros(len(own) - n + 1, np.uint64)
        for k in range(n):
            terms = terms * BASE + own[k : len(own) - n + 1 + k]
        terms, counts = np.unique(terms, return_counts=True)
        weight = (1 + np.log(counts)).astype(np.float32)
        votes = np.zeros(BITS, np.float32)
        for at in range(0, len(terms), 1 << 15):
            part = terms[at : at + (1 << 15)]
            a = part ^ (part >> np.uint64(31))
            a *= np.uint64(0xBF58476D1CE4E5B9)
            a ^= a >> np.uint64(27)
            b = (a + BASE) * np.uint64(0x94D049BB133111EB)
            b ^= b >> np.uint64(31)
            bits = np.unpackbits(np.stack([a, b], axis=1).view(np.uint8), axis=1)
            votes += weight[at : at + (1 << 15)] @ bits
        return np.packbits(votes * 2 > weight.sum()).tobytes().hex()

    def __call__(self, text: str | None) -> str:
        return self.of(self.words(text.lower().split() if text else []))


def distance(a: Column, b: Column) -> Column:
    """Hamming distance of two fingerprints."""
    part = lambda x, k: F.conv(F.substring(x, 1 + 8 * k, 8), 16, 10).cast("long")
    return sum(F.bit_count(part(a, k).bitwiseXOR(part(b, k))) for k in range(BITS // 32))


def likeness(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.cos(distance(a, b) * float(np.pi / BITS)))


def _entries(prints: DataFrame, errors: int) -> DataFrame:
    """bits of each distinct print, and key: its blocks, each with its number and with up to so many bits turned."""
    first, keys = 0, []
    for k, width in enumerate(BLOCKS):
        start, end = first // 4, -(-(first + width) // 4)
        digits = F.conv(F.substring("print", start + 1, end - start), 16, 10).cast("long")
        value = F.shiftright(digits, 4 * end - first - width).bitwiseAND((1 << width) - 1)
        turned = [(k << max(BLOCKS)) + sum(1 << x for x in at) for n in range(errors + 1) for at in combinations(range(width), n)]
        keys.append(F.transform(F.lit(np.array(turned, np.int64)), value.bitwiseXOR))
        first += width
    return prints.select("print").distinct().select(F.unhex("print").alias("bits"), F.explode(F.concat(*keys)).alias("key"))


def within_radius(queries: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """queries and prints: print. query, print and distance of each query and each other print within the radius."""
    # queries are a share of the table, so they are shuffled at every size
    left = _entries(queries, radius // len(BLOCKS)).select("key", F.col("bits").alias("query")).hint("merge")
    far = distance(F.hex("query"), F.hex("bits"))
    pairs = left.join(_entries(prints, 0), "key").where((F.col("query") != F.col("bits")) & (far <= radius))
    return pairs.select(F.lower(F.hex("query")).alias("query"), F.lower(F.hex("bits")).alias("print"), far.alias("distance")).distinct()


RESULT = T.StructType().add("n_chars", "long").add("edited_sha256", "string").add("fingerprint", "string").add("edited_fingerprint", "string").add("word_print", "string")


@F.pandas_udf(T.BinaryType())
def _packed(texts: pd.Series) -> pd.Series:
    """Texts as they are shuffled, compressed one by one."""
    pack = zstandard.ZstdCompressor(level=3)
    return pd.Series([pack.compress((t or "").encode("utf-8", "replace")) for t in texts])


def _unpacked(packed: bytes | None) -> str:
    return zstandard.ZstdDecompressor().decompress(packed).decode("utf-8") if packed is not None else ""


@F.pandas_udf(T.BinaryType())
def _start(packed: pd.Series, take: pd.Series) -> pd.Series:
    """The first code points of packed texts, packed."""
    pack = zstandard.ZstdCompressor(level=3)
    return pd.Series([pack.compress(_unpacked(p)[: int(n)].encode("utf-8", "replace")) for p, n in zip(packed, take, strict=True)])


@F.pandas_udf(RESULT)
def _edited(packed: pd.Series, starts: pd.Series) -> pd.DataFrame:
    """Of packed texts and the packed starts of the next ones."""
    make, out = SimHash(), []
    for text, after in zip(map(_unpacked, packed), map(_unpacked, starts), strict=True):
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        words, changed = text.lower().split(), edited.lower().split()
        own = make.words(words)
        same = 0  # the words before the cut are hashed once
        if cut:
            same = max(0, len(text[: len(text) - cut].lower().split()) - 1)
            same = same if words[:same] == changed[:same] else 0
        other = np.concatenate([own[:same], make.words(changed[same:])]) if cut else own
        out.append((len(text), hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), make.of(own), make.of(other), make.of(own, 1)))
    return pd.DataFrame(out, columns=RESULT.names)


@F.pandas_udf(T.StringType())
def fingerprint(texts: pd.Series) -> pd.Series:
    """The fingerprint of each text."""
    make = SimHash()
    return pd.Series([make(t) for t in texts])


def following(keys: DataFrame) -> DataFrame:
    """keys: d (distinct doc_keys). d and next: the one after it in order, after the last the first.

    The order is dealt out by ranges and written, so that each row's range is settled; a range's last key is followed
    by the first key of the next range that has one.
    """
    ranges = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(keys.select("d").repartitionByRange(ranges, "d").withColumn("range", F.spark_partition_id()), "order")
    firsts = dealt.groupBy("range").agg(F.min("d").alias("first"))
    by_range = Window.orderBy("range")
    after = firsts.select(
        F.col("range").alias("r"), F.coalesce(F.lead("first").over(by_range), F.first("first").over(by_range)).alias("first_after")
    )
    within = dealt.withColumn("lead", F.lead("d").over(Window.partitionBy("range").orderBy("d")))
    return within.join(after, F.col("range") == F.col("r")).select("d", F.coalesce("lead", "first_after").alias("next"))


def edited_report(docs: DataFrame, radius: int = RADIUS, query_every: int = QUERY_EVERY) -> DataFrame:
    """Of every document: its fingerprint, that of its text with the last quarter replaced by the start of the next
    document's, the likeness of its fingerprint to both the edited text's and the next document's, its word_print, and,
    for queries (documents whose id is divisible by query_every), n_near, the number of other word prints of the table
    within the radius; null for the others.

    Texts are shuffled once, by document: the join that tells a text whom its start goes to and the join that brings it
    the next one's start read the same shuffle.
    """
    key = doc_key(F.col("doc_id"), F.col("text"))
    rows = docs.select(key["i"].alias("i"), key["h"].alias("h"), key["n"].alias("n"), _packed("text").alias("packed"))
    lengths = docs.select(key.alias("d"), F.coalesce(F.length("text"), F.lit(0)).alias("length")).groupBy("d").agg(F.min("length").alias("length"))
    chain = written(lengths.join(following(lengths), "d"), "chain")
    wanted = chain.select(
        F.col("next.i").alias("wi"), F.col("next.h").alias("wh"), F.col("next.n").alias("wn"), F.col("d").alias("to"), F.floor(F.col("length") / 4).cast("int").alias("take")
    )
    starts = rows.join(wanted, (F.col("i") == F.col("wi")) & (F.col("h") == F.col("wh")) & (F.col("n") == F.col("wn"))).select(
        F.col("to.i").alias("ti"), F.col("to.h").alias("th"), F.col("to.n").alias("tn"), _start("packed", "take").alias("start")
    ).dropDuplicates(["ti", "th", "tn"])
    joined = rows.join(starts, (F.col("i") == F.col("ti")) & (F.col("h") == F.col("th")) & (F.col("n") == F.col("tn")))
    made = written(joined.select(F.struct("n", "i", "h").alias("d"), _edited("packed", "start").alias("x")).select("d", "x.*"), "fingerprints")
    prints_of = made.select("d", F.col("word_print").alias("print"))
    is_query = key_id(F.col("d")) % query_every == 0
    links = within_radius(prints_of.where(is_query), prints_of, radius)
    near = links.groupBy("query").agg(F.count("*").alias("n_near"))
    prints = made.groupBy("d").agg(F.min("fingerprint").alias("next_print")).withColumnRenamed("d", "k")
    nexts = chain.join(prints, F.col("next") == F.col("k")).select(F.col("d").alias("c"), "next_print")
    out = made.join(nexts, same_row(F.col("d"), F.col("c"))).join(near, F.col("word_print") == F.col("query"), "left")
    return out.select(
        key_id(F.col("d")).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_print")).alias("near_next"),
        "word_print", F.when(is_query, F.coalesce("n_near", F.lit(0))).alias("n_near"),
    )
