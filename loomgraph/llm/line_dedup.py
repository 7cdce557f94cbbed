"""Line deduplication by pairwise alignment of documents.

A seed is a line of at least `seed_words` words, or as few lines in a row as have so many words together; so short and
blank lines belong to the line after them, those at a document's end to the one before. Documents overlap where they
share a seed. Each document is aligned with the first document (by doc_id, null last) that has one of its seeds, for
every seed, over the seeds that this document is the first to have; so the work grows with the seeds, whatever the size
of a group or the number of partners. A seed that this leaves is one of a block that has moved. Such a document is
aligned, over all that it shares, with every other earlier holder of a seed that is left: with all at once where a seed
is rare (about `rare` documents or less), else with a share of them, chosen by hash, that grows eightfold a round until
all have been tried or nothing is left. So a line is deleted if it is aligned with its first holder or with any earlier
document, as if all pairs had been compared; only what no document has in order is compared with all holders.

A pair is aligned by patience diff: seeds that are unique on both sides are
anchors, the longest increasing run of anchors is kept, gaps between anchors are aligned in the same way, and anchors
grow over equal neighbours. In a gap without such a seed, the first occurrence on one side is paired with the first on
the other, the second with the second and so on, so that no gap is left that has a seed on both sides. Further
occurrences in the later document of what is aligned go with the same lines of the first. What is aligned in the later
document, with any partner, and makes a block of at least `block_words` words in consecutive lines is deleted. A line
stays in the first document that has it, so no content is lost from the corpus.

Defined cases: null text stays null, empty text empty; a document whose lines are all deleted keeps the empty text;
rows that repeat id and text are one document and get one result; a document of fewer than `seed_words` words has no
seed; a very long text has a row for each seed, and meets its partners' rows only where they share one; equal texts are
ordered by id, so the first keeps its lines; an empty table gives an empty table; further columns pass through whatever
their names. Seeds are told by 128-bit hashes.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_digest

from loomgraph.llm.common import doc_key, key_id, same_row, tasks_for, written

SEED_WORDS = 3
BLOCK_WORDS = 5
#: Holders of a seed left over that are tried in the first round, about, and by how much more in each further one.
RARE = 16
GROWTH = 8
EDITED = T.StructType().add("text", "string").add("removed", "integer").add("partners", T.ArrayType(T.LongType()))


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of pairs in order of their first part, a longest run in which the second part increases too (patience sorting)."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int | None] = []
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        back.append(at[k - 1] if k else None)
        tops[k : k + 1], at[k : k + 1] = [b], [i]
    out, i = [], at[-1] if at else None
    while i is not None:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(later: dict[int, int], earlier: dict[int, int]) -> list[tuple[int, int]]:
    """Aligned places (later's, earlier's). Both are place -> line hash."""
    done: list[tuple[int, int]] = []
    gaps = [(sorted(later), sorted(earlier))]
    while gaps:
        mine, theirs = gaps.pop()
        mine_at: dict[int, list[int]] = {}
        for p in mine:
            mine_at.setdefault(later[p], []).append(p)
        theirs_at: dict[int, list[int]] = {}
        for p in theirs:
            theirs_at.setdefault(earlier[p], []).append(p)
        unique = [(p[0], theirs_at[h][0]) for h, p in mine_at.items() if len(p) == 1 and len(theirs_at.get(h, ())) == 1]
        anchors = _increasing(sorted(unique))
        if not anchors:
            anchors = _increasing(sorted(x for h, p in mine_at.items() for x in zip(p, theirs_at.get(h, ()), strict=False)))
        if not anchors:
            continue
        grown: list[tuple[int, int]] = []
        for k, (a, b) in enumerate(anchors):
            next_a, next_b = anchors[k + 1] if k + 1 < len(anchors) else (None, None)
            low_a, low_b = grown[-1] if grown else (None, None)
            back = []
            x, y = a - 1, b - 1
            while later.get(x) is not None and later.get(x) == earlier.get(y) and (low_a is None or x > low_a and y > low_b) and x >= mine[0] and y >= theirs[0]:
                back.append((x, y))
                x, y = x - 1, y - 1
            grown += back[::-1]
            grown.append((a, b))
            x, y = a + 1, b + 1
            while later.get(x) is not None and later.get(x) == earlier.get(y) and (next_a is None or x < next_a and y < next_b) and x <= mine[-1] and y <= theirs[-1]:
                grown.append((x, y))
                x, y = x + 1, y + 1
        done += grown
        edges = [(mine[0] - 1, theirs[0] - 1), *grown, (mine[-1] + 1, theirs[-1] + 1)]
        for (a, b), (c, d) in zip(edges, edges[1:], strict=False):
            left, right = [p for p in mine if a < p < c] if c - a > 1 else [], [p for p in theirs if b < p < d] if d - b > 1 else []
            if left and right:
                gaps.append((left, right))
    return sorted(done)


def aligned_places(later: dict[int, int], earlier: dict[int, int]) -> list[int]:
    """The later's places that are aligned, with further occurrences of aligned lines."""
    found = {later[a] for a, _ in patience(later, earlier)}
    return sorted(p for p, line in later.items() if line in found)


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _aligned(seeds: pd.Series) -> pd.Series:
    """Of a pair's shared seeds, which are aligned."""
    out = []
    for pair in seeds:
        number: dict[bytes, int] = {}
        later, earlier = {}, {}
        for x in pair:
            k = number.setdefault(bytes(x["seed"]), len(number))
            later.update((int(p), k) for p in x["places"])
            earlier.update((int(p), k) for p in x["earlier"])
        found = {later[p] for p in aligned_places(later, earlier)}
        out.append([number[bytes(x["seed"])] in found for x in pair])
    return pd.Series(out)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def seeds_of(text: str, seed_words: int = SEED_WORDS) -> dict[bytes, tuple[int, int, list[int]]]:
    """Of each seed's hash, how many lines before and after its place it holds, and its places."""
    raw = text.encode("utf-8", "replace").split(b"\n")
    words = [len(x.split()) for x in raw]
    out: dict[bytes, tuple[int, int, list[int]]] = {}
    last, last_line = len(raw), b""
    # from the end on: where the seed ends that begins in the next line
    ends, end, have = [0] * len(raw), len(raw) - 1, 0
    for p in range(len(raw) - 1, -1, -1):
        have += words[p]
        while have - words[end] >= seed_words and end > p:
            have -= words[end]
            end -= 1
        ends[p] = end if have >= seed_words else -1
        if ends[p] >= 0 and last == len(raw):
            last, last_line = p, b"\n".join(raw[p:])  # the last line that begins a seed
    if last == len(raw):
        return out
    for p in range(len(raw)):
        if ends[p] >= 0:
            before, after, content = 0, ends[p] - p, raw[p] if ends[p] == p else b"\n".join(raw[p : ends[p] + 1])
        else:
            before, after, content = p - last, len(raw) - 1 - p, b"%d from the end\n%s" % (len(raw) - p, last_line)
        out.setdefault(xxh3_128_digest(content), (before, after, []))[2].append(p)
    return out


def seed_table(docs: DataFrame, seed_words: int = SEED_WORDS) -> DataFrame:
    """docs: d (a doc_key), text. d, seed, before, after and places: a row for each document and seed."""

    def table(batches):
        for batch in batches:
            row, seed, before, after, size, places = [], [], [], [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                for h, (b, a, at) in (seeds_of(text, seed_words) if text else {}).items():
                    row.append(k)
                    seed.append(h)
                    before.append(b)
                    after.append(a)
                    size.append(len(at))
                    places += at
            taken = pa.array(row, pa.int64())
            ends = pa.array(np.concatenate([[0], np.cumsum(size, dtype=np.int32)]).astype(np.int32), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(places, pa.int32()))
            keys = [batch.column(c).take(taken) for c in ("n", "i", "h")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(seed, pa.binary()), pa.array(before, pa.int32()), pa.array(after, pa.int32()), lists], ["n", "i", "h", "seed", "before", "after", "places"])

    flat = docs.select("d.n", "d.i", "d.h", "text").mapInArrow(table, "n int, i long, h long, seed binary, before int, after int, places array<int>")
    return flat.select(F.struct("n", "i", "h").alias("d"), "seed", "before", "after", "places")


def _marked(shared: DataFrame) -> DataFrame:
    """shared: d, e, seed, before, after, places, earlier (e's places), n. The same rows with aligned, less earlier."""
    whole = shared.groupBy("d", "e").agg(F.collect_list(F.struct("seed", "before", "after", "places", "earlier", "n")).alias("seeds"))
    slim = F.transform("seeds", lambda x: F.struct(x["seed"].alias("seed"), x["places"].alias("places"), x["earlier"].alias("earlier")))
    each = whole.withColumn("aligned", _aligned(slim)).select("d", "e", F.explode(F.arrays_zip("seeds", "aligned")).alias("x"))
    return each.select("d", "e", *[f"x.seeds.{c}" for c in ("seed", "before", "after", "places", "n")], "x.aligned")


def with_first(seeds: DataFrame, tasks: int | None = None) -> DataFrame:
    """seeds: as of seed_table, written; tasks: as of written(). Of each seed of d that an earlier document has: e, the first that has it, n, the
    number of documents with it, and whether both are aligned there."""
    held = seeds.groupBy("seed").agg(F.min(F.struct("d", "places")).alias("low"), F.max("d").alias("last"), F.count("*").alias("n")).where("low.d <> last")
    holders = written(held.select(F.col("seed").alias("s"), F.col("low.d").alias("e"), F.col("low.places").alias("earlier"), "n"), "holders", tasks)
    return _marked(seeds.join(holders, F.col("seed") == F.col("s")).where("d <> e"))


def with_others(first: DataFrame, seeds: DataFrame, rare: int = RARE, tasks: int | None = None) -> list[DataFrame]:
    """first: as of with_first, written. What is aligned of the seeds that it leaves, a table for each round."""
    left = written(first.where(~F.col("aligned")).select("d", "seed", "n").distinct(), "left", tasks)
    share = F.pmod(F.xxhash64("d.n", "d.i", "d.h"), F.lit(1 << 30)) / float(1 << 30)
    mine = first.select(F.col("d").alias("own"), "seed", "before", "after", "places", "n")
    theirs = seeds.select(F.col("d").alias("other"), F.col("seed").alias("t"), F.col("places").alias("earlier"))
    tried, upto, found = 0, rare, []
    while tried < (left.agg(F.max("n")).first()[0] or 0):
        # few holders of each seed, before they meet those that want them
        wanted = left.groupBy("seed").agg(F.max("n").alias("n")).withColumnRenamed("seed", "s")
        turn = (F.col("share") * F.col("n") >= tried) & (F.col("share") * F.col("n") < upto)
        some = seeds.select(F.col("d").alias("e"), F.col("seed").alias("t"), share.alias("share")).join(wanted, F.col("t") == F.col("s")).where(turn).select("t", "e")
        pairs = written(left.join(some, F.col("seed") == F.col("t")).where("e < d").select("d", "e").distinct(), "pairs", tasks)
        both = pairs.join(mine, same_row(F.col("d"), F.col("own"))).join(theirs, (F.col("seed") == F.col("t")) & same_row(F.col("e"), F.col("other")))
        found.append(written(_marked(both).where("aligned"), "aligned", tasks))
        done = found[-1].select(F.col("d").alias("own"), F.col("seed").alias("t")).distinct()
        left = written(left.join(done, (F.col("seed") == F.col("t")) & same_row(F.col("d"), F.col("own")), "left_anti"), "left", tasks)
        tried, upto = upto, upto * GROWTH
    return found


def aligned_lines(seeds: DataFrame, tasks: int, rare: int = RARE) -> DataFrame:
    """seeds: as of seed_table, written. d, place and partner of lines that are aligned with an earlier document."""
    first = written(with_first(seeds, tasks), "first", tasks)
    whole = reduce(DataFrame.unionByName, with_others(first, seeds, rare, tasks), first.where("aligned"))
    lines = F.flatten(F.transform("places", lambda p: F.sequence(p - F.col("before"), p + F.col("after"))))
    return whole.select("d", F.col("e").alias("partner"), F.explode(lines).alias("place"))


@F.pandas_udf(EDITED)
def _without(texts: pd.Series, aligned: pd.Series, block_words: pd.Series) -> pd.DataFrame:
    out = []
    for text, rows, least in zip(texts, aligned, block_words, strict=True):
        if text is None or rows is None or not len(rows):
            out.append((text, 0, []))
            continue
        partner = {}
        for x in rows:
            partner.setdefault(x["place"], []).append(x["partner"])
        lines, gone, run = text.split("\n"), set(), []
        for p in [*sorted(partner), None]:
            if run and p != run[-1] + 1:
                # a block: consecutive aligned lines, with the blank lines around counted to it
                if sum(len(lines[k].split()) for k in run) >= least:
                    gone.update(run)
                run = []
            run.append(p)
        with_whom = sorted({x for p in gone for x in partner[p] if x is not None and x == x})
        out.append(("\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else text, len(gone), [int(x) for x in with_whom]))
    return pd.DataFrame(out, columns=["text", "removed", "partners"])


def dedup(docs: DataFrame, seed_words: int = SEED_WORDS, block_words: int = BLOCK_WORDS, rare: int = RARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (the document as a struct, its text as before), text without the blocks, n_removed, partners."""
    key = doc_key(F.col(id_col), F.col(text_col))
    slim = docs.select(key.alias("d"), F.col(text_col).alias("text"))
    size = Observation()
    seeds = written(seed_table(slim.observe(size, F.sum(F.length("text")).alias("chars")), seed_words), "seeds")
    tasks = tasks_for(docs.sparkSession, size.get["chars"] or 0)
    found = aligned_lines(seeds, tasks, rare)
    blocks = found.groupBy("d").agg(F.collect_set(F.struct("place", key_id(F.col("partner")).alias("partner"))).alias("aligned"))
    rows = docs.select(F.struct("*").alias("row"), key.alias("k"))
    joined = rows.join(blocks, same_row(F.col("k"), F.col("d")), "left")
    edited = joined.withColumn("x", _without(F.col(f"row.{text_col}"), "aligned", F.lit(block_words)))
    return edited.select("row", "x.text", F.col("x.removed").alias("n_removed"), "x.partners").coalesce(tasks)


def dedup_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, partners (doc_ids of the earlier documents) and the text that stays."""
    out = dedup(docs.select("doc_id", "text"))
    return out.select("row.doc_id", F.coalesce(F.size(_lines(F.col("row.text"))), F.lit(0)).alias("n_lines"), "n_removed", "partners", "text")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents with their blocks deleted and n_chars, where there is one, counted again."""
    out = dedup(docs)
    changed = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        changed = changed.withField("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(changed.alias("row")).select("row.*")
