"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A text is the bag of its lower-cased shingles of five words (all words of a shorter text). A shingle weighs its count
times idf = 1 + ln((1 + N) / (1 + df)), with the exact document frequencies of all shingles over all documents. Texts
are dealt by hash to chunks; of each chunk the distinct shingles and their counts go, packed, to buckets by hash, where
they are summed, and those in more than one document go back to the chunks that have them. So a common shingle is one
entry a chunk, no table of frequencies is held whole anywhere, and a text keeps the frequencies of its shared shingles.
Of a text with very many copies only the first is dealt, with their number.

Each sample of a text is a shingle and a level (Ioffe's scheme); two texts agree in a sample with the probability of
their weighted Jaccard similarity. Bands of samples make buckets. In a bucket, each text is first compared with one
other, chosen differently in each band; those verified (weighted Jaccard of the whole texts) are joined to
components. Texts of a bucket that are still in different components are compared with one another where they can be
similar at all: with shingles in order of rarity, two similar bags share one in their first parts, and what follows
the first shared one in either bag must outweigh the threshold (prefix and position filters, which lose nothing). A
group of copies thus costs comparisons in proportion to its size, many texts around one common passage cost few, and
no candidate is left out.

The copies of a group make its own shingles common and so light, the lighter the more copies there are and the more
documents the table has, while what an edit changes stays heavy. So candidates of which one is in a class of several
documents are also one class if their bags are similar by counts alone (Jaccard of the whole texts, the same
threshold), found and verified in the same way. Texts around a common passage, none of them with a copy, stay apart.

Defined cases: equal texts are one class, blank ones too; a null text is a class of its own; a text without words is
in no bucket; rows that repeat id and text are copies of each other. Equal texts are told by 128-bit hashes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import BASE, FILE_ROWS, blanks, doc_key, hashed_words, key_id, same_row, tasks_for, text_hash, written
from loomgraph.llm.graph import components

WORDS = 5
SIMILAR = 0.8
BANDS, ROWS = 12, 3
#: Characters of a chunk and shingles of a bucket, about.
CHUNK, BUCKET = 2_000_000, 2_000_000
#: Copies of a text that may be dealt one by one, and the most texts that can have more: what is sent to all tasks.
COPIES, MOST_HOT = 64, 1_000_000
#: Bits of a shingle's hash beyond those that tell all characters of the table apart, in the table of frequencies.
SPARE_BITS = 22
SLOTS = 1 << 16
#: What str.split takes for white space in ASCII.
SPACE = blanks(28, 29, 30, 31)
#: The random draws of the sampling scheme: Gamma(2, 1) twice and a uniform one, by slot of a shingle's hash.
_draw = np.random.default_rng(20240501)
GAMMA_R, GAMMA_C, SHIFT = _draw.gamma(2, 1, SLOTS), _draw.gamma(2, 1, SLOTS), _draw.random(SLOTS)
ODD = (_draw.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


class Shingler:
    """Distinct shingle hashes of a text and their counts."""

    def __init__(self, n: int = WORDS):
        self.n = n

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        lower = text.lower() if text else ""
        # other white space than ASCII's separates words, too
        raw = lower.encode() if lower.isascii() else " ".join(lower.split()).encode("utf-8", "replace")
        own, _, _ = hashed_words(raw, SPACE)
        if not len(own):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        n = min(self.n, len(own))
        out = np.zeros(len(own) - n + 1, np.uint64)
        for k in range(n):
            out = out * BASE + own[k : len(own) - n + 1 + k]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return np.unique(out, return_counts=True)


class Weights:
    """Weights of a text's shingles, from their counts and what is known of their document frequencies."""

    def __init__(self, total: int):
        self.total = total
        self.single = float(self.idf(1.0))

    def idf(self, df):
        return 1 + np.log((1 + self.total) / (1 + df))

    def __call__(self, counts: np.ndarray, shared: bytes = b"") -> np.ndarray:
        """shared: as of packed(); a shingle that is not listed is in one document."""
        out = counts * self.single
        if shared:
            at, df = unpacked(shared)
            out[at] = counts[at] * self.idf(df.astype(np.float64))
        return out


class Counts(Weights):
    """Each shingle weighs its count."""

    def __init__(self):
        super().__init__(0)

    def idf(self, df):
        return np.ones_like(df, np.float64)


def packed(at: np.ndarray, df: np.ndarray) -> bytes:
    """Places of shared shingles among a text's, and their document frequencies."""
    return at.astype(np.uint32).tobytes() + df.astype(np.uint64).tobytes()


def unpacked(shared: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(shared) // 12
    return np.frombuffer(shared, np.uint32, n), np.frombuffer(shared, np.uint64, n, 4 * n)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    keys = np.concatenate([x for x, _ in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], np.concatenate([n for _, n in parts])[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)


def _pressed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys and their counts, small: differences byte by byte, compressed."""
    steps = np.diff(keys, prepend=np.uint64(0))
    planes = [np.ascontiguousarray(x.view(np.uint8).reshape(len(x), 8).T).tobytes() for x in (steps, counts.astype(np.uint64))]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpressed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(2, 8, -1)
    steps, counts = (np.ascontiguousarray(x.T).view(np.uint64).reshape(-1) for x in planes)
    return np.cumsum(steps, dtype=np.uint64), counts


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the wanted are among the sorted keys, and where these stand."""
    if not len(keys) or not len(wanted):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = np.flatnonzero(keys[at] == wanted)
    return hit, at[hit]


def _frequencies(dealt: DataFrame, buckets: int, cut: int) -> DataFrame:
    """dealt: chunk, node, text, copies. chunk and shared: keys (hashes less `cut` bits) of a chunk's shingles that are
    in more than one document of all, and in how many."""
    width = np.uint64(-(-(1 << (64 - cut)) // buckets))

    def by_bucket(batches):
        shingler = Shingler()
        for batch in batches:
            chunks: dict[int, dict[bytes, tuple[str, int]]] = {}
            for chunk, node, text, copies in zip(batch["chunk"], batch["node"], batch["text"], batch["copies"], strict=True):
                # copies tells how many documents a row stands for, where only the first was dealt
                texts = chunks.setdefault(chunk, {})
                texts[node] = text, int(copies) if copies == copies and copies is not None else texts.get(node, ("", 0))[1] + 1
            for chunk, texts in chunks.items():
                own = []
                for text, n in texts.values():
                    keys = shingler(text)[0] >> np.uint64(cut)
                    if len(keys):
                        keys = keys[np.r_[True, keys[1:] != keys[:-1]]]
                        own.append((keys, np.full(len(keys), n, np.uint64)))
                if not own:
                    continue
                keys, n = _summed(own)
                bucket = keys // width
                starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                ends = np.r_[starts[1:], len(keys)]
                yield pd.DataFrame({"chunk": chunk, "bucket": bucket[starts].astype(np.int64), "held": [_pressed(keys[a:b], n[a:b]) for a, b in zip(starts, ends, strict=True)]})

    def known(pdf):
        parts = [_unpressed(x) for x in pdf["held"]]
        keys, n = _summed(parts)
        keys, n = keys[n > 1], n[n > 1]
        out = []
        for own, _ in parts:
            hit, at = _found(keys, own)
            out.append(_pressed(own[hit], n[at]) if len(hit) else b"")
        made = pd.DataFrame({"chunk": pdf["chunk"], "shared": out})
        return made[made["shared"].str.len() > 0]

    held = dealt.mapInPandas(by_bucket, "chunk long, bucket long, held binary")
    return held.groupBy("bucket").applyInPandas(known, "chunk long, shared binary")


def sampled(rows: DataFrame, nodes: DataFrame, total: int, chars: int) -> DataFrame:
    """rows: d, node, text; nodes: node, d, n of each text. node, shared (packed frequencies) and bands of each text.

    A text without words has no bands. Equal texts are in one chunk and come once.
    """
    weights = Weights(total)
    chunks, buckets = chars // CHUNK + 1, max(64, chars // 6 // BUCKET)
    cut = max(0, 64 - chars.bit_length() - SPARE_BITS)
    # at most MOST_HOT texts have so many copies
    hot = nodes.where(F.col("n") > max(COPIES, total // MOST_HOT)).select(F.col("node").alias("hot"), F.col("d").alias("k"), F.col("n").alias("copies"))
    kept = rows.join(F.broadcast(hot), F.col("node") == F.col("hot"), "left").where("copies is null or d = k")
    # one shuffle of the texts, for the counts and for what comes back
    dealt = kept.select(F.pmod(F.xxhash64("node"), F.lit(chunks)).alias("chunk"), "node", "text", "copies").repartition("chunk")

    def look(texts, back):
        shingler, sampler = Shingler(), sampler_of(total)
        parts = [_unpressed(x) for x in back["shared"]]
        keys, first = np.unique(np.concatenate([x for x, _ in parts]), return_index=True) if parts else (np.zeros(0, np.uint64), [])
        n = np.concatenate([x for _, x in parts])[first] if parts else keys
        out = []
        for node, text in texts.drop_duplicates("node")[["node", "text"]].itertuples(index=False):
            own, counts = shingler(text)
            hit, at = _found(keys, own >> np.uint64(cut))
            shared = packed(hit, n[at]) if len(hit) else b""
            out.append((node, shared, sampler(own, weights(counts, shared)) if len(own) else None))
        return pd.DataFrame(out, columns=["node", "shared", "bands"])

    back = _frequencies(dealt, buckets, cut)
    return dealt.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInPandas(look, "node binary, shared binary, bands array<long>")


class Sampler:
    """Consistent weighted samples of a text, as one key for each band.

    Scores of all slots are kept for the first `most_kept` weights that come, the single shingle's first.
    """

    def __init__(self, weights: Weights, most_kept: int = 48):
        self.kept, self.most_kept = {}, most_kept
        self.score, self.level = np.empty((most_kept, SLOTS), np.float32), np.empty((most_kept, SLOTS), np.int32)
        self._row(weights.single)

    def _row(self, weight: float) -> int:
        """Where the scores of a weight are kept; -1 if they are not."""
        k = self.kept.get(weight)
        if k is None:
            if len(self.kept) == self.most_kept:
                return -1
            k = self.kept[weight] = len(self.kept)
            self.score[k], self.level[k] = self._levels(np.log(weight), slice(None))
        return k

    @staticmethod
    def _levels(log_weight, slot) -> tuple[np.ndarray, np.ndarray]:
        r, c, shift = GAMMA_R[slot], GAMMA_C[slot], SHIFT[slot]
        level = np.floor(log_weight / r + shift)
        return (np.log(c) - r * (level - shift + 1)).astype(np.float32), level.astype(np.int32)

    def __call__(self, shingles: np.ndarray, weight: np.ndarray) -> np.ndarray:
        values, which = np.unique(weight, return_inverse=True)
        row = np.array([self._row(w) for w in values.tolist()])[which]
        rare = np.flatnonzero(row < 0)
        at = np.maximum(row, 0) * SLOTS
        score, kept_level = self.score.reshape(-1), self.level.reshape(-1)
        chosen, levels = np.empty(len(ODD), np.uint64), np.empty(len(ODD), np.int64)
        step = max(1, 60_000 // len(shingles))
        mixed = shingles ^ (shingles >> np.uint64(29))
        for k in range(0, len(ODD), step):
            slots = ((mixed[None, :] * ODD[k : k + step, None]) >> np.uint64(48)).astype(np.int64)
            found = score[slots + at]
            if len(rare):
                found[:, rare], _ = self._levels(np.log(weight[rare])[None, :], slots[:, rare])
            best = found.argmin(axis=1)
            slot = slots[np.arange(len(best)), best]
            chosen[k : k + step] = shingles[best]
            levels[k : k + step] = np.where(row[best] < 0, self._levels(np.log(weight[best]), slot)[1], kept_level[slot + at[best]])
        key = np.zeros(BANDS, np.uint64)
        for x, n in zip(chosen.reshape(BANDS, ROWS).T, levels.reshape(BANDS, ROWS).T, strict=True):
            key = (key ^ x ^ (n.astype(np.uint64) << np.uint64(40))) * BASE
            key ^= key >> np.uint64(32)
        return key.view(np.int64)


@lru_cache(maxsize=2)
def sampler_of(total: int) -> Sampler:
    """One for all groups that a worker has."""
    return Sampler(Weights(total))


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two bags: sorted shingles and their weights."""
    total = a[1].sum() + b[1].sum()
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][i], b[1][j]).sum() if len(common) else 0.0
    return float(least / (total - least)) if total > 0 else 0.0


def _verified(pairs: DataFrame, texts: DataFrame, weights: Weights, similar: float) -> DataFrame:
    """pairs: u, v. Those whose texts (texts: node, text, shared) are similar."""

    @F.pandas_udf(T.DoubleType())
    def likeness(left: pd.Series, left_shared: pd.Series, right: pd.Series, right_shared: pd.Series) -> pd.Series:
        shingler, kept = Shingler(), {}

        def bag(text, shared):
            if text not in kept:
                if len(kept) > 500:
                    kept.clear()
                own, counts = shingler(text)
                kept[text] = own, weights(counts, shared)
            return kept[text]

        return pd.Series([weighted_jaccard(bag(a, x), bag(b, y)) for a, x, b, y in zip(left, left_shared, right, right_shared, strict=True)])

    left = texts.select(F.col("node").alias("u"), F.col("text").alias("left"), F.col("shared").alias("left_shared"))
    right = texts.select(F.col("node").alias("v"), F.col("text").alias("right"), F.col("shared").alias("right_shared"))
    both = pairs.join(left, "u").join(right, "v")
    return both.where(likeness("left", "left_shared", "right", "right_shared") >= similar).select("u", "v")


def _first_parts(texts: DataFrame, weights: Weights, similar: float) -> DataFrame:
    """texts: node, text, shared. node, total, and shingle and rest (the weight from it on) of each node's first part.

    Shingles are in order of the number of these texts that have them, the rarest first. A shingle is in the first part
    if what comes from it on weighs similar * total at least.
    """

    def bags(batches):
        shingler, rows = Shingler(), 0
        node, shingle, weight = [], [], []
        for batch in batches:
            for key, text, shared in zip(batch["node"], batch["text"], batch["shared"], strict=True):
                own, counts = shingler(text)
                node += [key] * len(own)
                shingle.append(own.view(np.int64))
                weight.append(weights(counts, shared))
                rows += len(own)
                if rows > 200_000:
                    yield pd.DataFrame({"node": node, "shingle": np.concatenate(shingle), "weight": np.concatenate(weight)})
                    node, shingle, weight, rows = [], [], [], 0
        if node:
            yield pd.DataFrame({"node": node, "shingle": np.concatenate(shingle), "weight": np.concatenate(weight)})

    def first_parts(batches):
        for batch in batches:
            for at in range(0, len(batch), 200):
                out = []
                for key, n, shingle, weight in zip(*(batch[c].iloc[at : at + 200] for c in ("node", "n", "shingle", "weight")), strict=True):
                    rest = weight[::-1].cumsum()[::-1]
                    # what no other text has counts to the weight but finds nothing
                    keep = np.flatnonzero((rest >= similar * rest[0] - 1e-9) & (n > 1))
                    out.append(pd.DataFrame({"node": [key] * len(keep), "shingle": shingle[keep], "rest": rest[keep], "total": rest[0]}))
                yield pd.concat(out)

    each = texts.select("node", "text", "shared").mapInPandas(bags, "node binary, shingle long, weight double")
    held = each.groupBy("shingle").agg(F.count("*").alias("n")).withColumnRenamed("shingle", "s")
    shared = each.join(held, F.col("shingle") == F.col("s"))
    ordered = shared.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "shingle", "weight"))).alias("bag")).select("node", "bag.n", "bag.shingle", "bag.weight")
    return ordered.mapInPandas(first_parts, "node binary, shingle long, rest double, total double")


def _enough(similar: float) -> Column:
    """Whether two bags can be similar whose first common shingle is this one."""
    return F.least("rest", "other_rest") >= similar / (1 + similar) * (F.col("total") + F.col("other_total")) - 1e-6


def _pair(a: str, b: str) -> list[Column]:
    return [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]


def _to_plainest(first: DataFrame, parts: DataFrame, similar: float) -> DataFrame:
    """first: as of _first_parts; parts: node, part, copied. u and v: each text with, for each shingle, the text that
    has least before it, of copied ones if there are any; one of u and v is copied.

    That one has the fewest shingles of its own, and so is the most like the others if any is.
    """
    placed = first.join(parts, "node")
    plainest = placed.groupBy("shingle").agg(
        F.max(F.struct(F.col("copied").alias("other_copied"), (F.col("rest") / F.col("total")).alias("share"), F.col("node").alias("other_node"), F.col("rest").alias("other_rest"), F.col("total").alias("other_total"), F.col("part").alias("other_part"))).alias("p")
    ).select("shingle", "p.*")
    found = placed.join(plainest.where("other_copied"), "shingle").where((F.col("part") != F.col("other_part")) & _enough(similar))
    return found.select(*_pair("node", "other_node")).distinct()


def _across(first: DataFrame, parts: DataFrame, similar: float) -> DataFrame:
    """first: as of _first_parts; parts: node, part, copied. u and v of all texts in different parts that can be similar,
    one of them copied.

    Of a shingle's texts, those outside its largest part meet all; those of the largest part need not meet each other.
    """
    placed = first.join(parts, "node")
    sizes = placed.groupBy("shingle", "part").agg(F.count("*").alias("n"), F.max("copied").alias("copied"))
    sizes = sizes.groupBy("shingle").agg(F.max(F.struct("n", "part")).alias("m"), F.count("*").alias("parts"), F.max("copied").alias("copied"))
    largest = sizes.where("parts > 1 and copied").select("shingle", F.col("m.part").alias("largest"))
    mixed = placed.join(largest, "shingle")
    other = mixed.where("part <> largest").select("shingle", *[F.col(c).alias(f"other_{c}") for c in ("node", "rest", "total", "part", "copied")])
    found = mixed.join(other, "shingle").where((F.col("part") != F.col("other_part")) & (F.col("copied") | F.col("other_copied")) & _enough(similar))
    return found.select(*_pair("node", "other_node")).distinct()


def _apart(buckets: DataFrame, parts: DataFrame, texts: DataFrame) -> DataFrame:
    """The texts that are in a bucket of several parts (parts: node, part, copied), one of them copied."""
    placed = buckets.join(parts, "node").select("band", "key", "node", "part", "copied")
    mixed = placed.groupBy("band", "key").agg(F.min("part").alias("least"), F.max("part").alias("most"), F.max("copied").alias("copied")).where("least <> most and copied").select("band", "key")
    return texts.join(placed.join(mixed, ["band", "key"], "left_semi").select("node").distinct(), "node", "left_semi")


def _joined_up(parts: DataFrame, links: DataFrame, total: int) -> DataFrame:
    """parts: node, part, of so many documents. The parts after those that a link (u, v) connects have become one."""
    left = parts.select(F.col("node").alias("u"), F.col("part").alias("a"))
    right = parts.select(F.col("node").alias("v"), F.col("part").alias("b"))
    between = links.join(left, "u").join(right, "v").where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    labels = components(between, most=links.count())
    if labels is None:
        return parts
    return written(parts.join(labels.withColumnRenamed("node", "part"), "part", "left").select("node", F.coalesce("label", "part").alias("part")), "parts", 1 + total // FILE_ROWS)


def classes(docs: DataFrame, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """node (hash of a text), first (doc_key of the class's first document), class_size (documents), of each text."""
    return _classes(docs, similar, id_col, text_col)[0]


def _classes(docs: DataFrame, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """As classes(), and the tasks that are enough for these texts."""
    rows = docs.select(doc_key(F.col(id_col), F.col(text_col)).alias("d"), F.col(text_col).alias("text")).where("text is not null")
    rows = rows.withColumn("node", text_hash(F.col("text")))
    size = Observation()
    each = rows.groupBy("node").agg(F.min("d").alias("d"), F.count("*").alias("n"), F.max(F.length("text")).alias("chars"))
    nodes = written(each.observe(size, F.sum("n").alias("n"), F.sum(F.col("n") * F.col("chars")).alias("chars")), "nodes")
    total, chars = size.get["n"] or 0, size.get["chars"] or 0
    weights, tasks = Weights(total), tasks_for(docs.sparkSession, chars)
    found = written(sampled(rows, nodes, total, chars), "sampled", tasks)
    members = found.where("bands is not null").select("node", F.posexplode("bands").alias("band", "key"))
    # the one to compare with: the least in an order of the band's own
    pivots = (
        members.groupBy("band", "key")
        .agg(F.min(F.struct(F.xxhash64("node", "band").alias("o"), "node")).alias("p"), F.count("*").alias("n"))
        .where("n > 1").select("band", "key", F.col("p.node").alias("pivot"))
    )
    buckets = written(members.join(pivots, ["band", "key"]), "buckets", tasks)
    wanted = buckets.select("node").distinct()
    heads = wanted.join(nodes, "node").select(F.col("node").alias("t"), F.col("d").alias("k"))
    own = rows.select("d", "text").join(heads, same_row(F.col("d"), F.col("k"))).select(F.col("t").alias("node"), "text")
    texts = written(own.join(found.select("node", "shared"), "node").dropDuplicates(["node"]), "compared", tasks)
    stars = buckets.where("node <> pivot").select(*_pair("node", "pivot")).distinct()
    parts = _joined_up(wanted.select("node", F.col("node").alias("part")), written(_verified(stars, texts, weights, similar), "links", tasks), total)
    all_apart = F.lit(True).alias("copied")
    first = written(_first_parts(_apart(buckets, parts.select("*", all_apart), texts), weights, similar), "first-parts", tasks)
    plain = written(_to_plainest(first, parts.select("*", all_apart), similar).join(stars, ["u", "v"], "left_anti"), "pairs", tasks)
    parts = _joined_up(parts, written(_verified(plain, texts, weights, similar), "links", tasks), total)
    rest = _across(first, parts.select("*", all_apart), similar).join(stars.union(plain), ["u", "v"], "left_anti")
    parts = _joined_up(parts, written(_verified(rest, texts, weights, similar), "links", tasks), total)
    # what is apart from a class of several documents, by counts
    several = parts.join(nodes.select("node", "n"), "node").groupBy("part").agg((F.sum("n") > 1).alias("copied"))
    copied = written(parts.join(several, "part").select("node", "part", "copied"), "copied", 1 + total // FILE_ROWS)
    first = written(_first_parts(_apart(buckets, copied, texts), Counts(), similar), "first-parts", tasks)
    plain = written(_to_plainest(first, copied, similar), "pairs", tasks)
    near = written(_verified(plain, texts, Counts(), similar), "links", tasks)
    joined = _joined_up(copied.select("node", "part"), near, total).join(copied.select("node", "copied"), "node")
    rest = _across(first, joined, similar).join(plain, ["u", "v"], "left_anti")
    parts = _joined_up(joined.select("node", "part"), written(_verified(rest, texts, Counts(), similar), "links", tasks), total)
    every = nodes.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node")).select("node", "d", "n", "part")
    least = every.groupBy("part").agg(F.min("d").alias("first"), F.sum("n").alias("class_size"))
    return every.join(least, "part").select("node", "first", "class_size"), tasks


def near_classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (least doc_id of the class) and class_size of every document."""
    slim = docs.select("doc_id", "text")
    found = classes(slim).withColumnRenamed("node", "t")
    rows = slim.select("doc_id", text_hash(F.col("text")).alias("node"), F.col("text").isNull().alias("none"))
    joined = rows.join(found, F.col("node") == F.col("t"), "left")
    class_id = F.when(F.col("none"), F.col("doc_id")).otherwise(key_id(F.col("first")))
    return joined.select("doc_id", class_id.alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, of each class the first only; null texts stay."""
    found, tasks = _classes(docs)
    found = found.select(F.col("first.i").alias("fi"), F.col("first.h").alias("fh"), F.col("first.n").alias("fn")).distinct()
    key = doc_key(docs["doc_id"], docs["text"])
    rows = docs.where("text is not null").select(F.struct("*").alias("row"), key["i"].alias("i"), key["h"].alias("h"), key["n"].alias("n"))
    kept = rows.join(found, (F.col("i") == F.col("fi")) & (F.col("h") == F.col("fh")) & (F.col("n") == F.col("fn")), "left_semi")
    # rows that repeat id and text are copies
    return kept.dropDuplicates(["i", "h", "n"]).select("row.*").coalesce(tasks).unionByName(docs.where("text is null"))
