"""Ranked lexical search: sharded inverted lists with block maxima, searched by Block-Max MaxScore.

`build_index` writes inverted lists. A task reads whole texts and closes a shard every `shard_terms` terms, so a shard is
bounded however large the corpus is (a longer text is a shard of its own). A list is cut into blocks of BLOCK postings;
a block keeps its last document, the byte widths of its packed gaps and frequencies, and its best (frequency, document
length) pairs, those that no other pair of the block beats in both. So the blocks do not depend on totals of the corpus:
shards can be added later, and a block's greatest score is exact under whatever totals hold at the time of the search.

`search` gives each query the `k` best documents of all shards. Totals and document frequencies are sums over the shards.
The lists of the queries' terms are dealt by (block of queries, shard) and streamed through each task a shard at a time:

* A list's bound is its greatest block score. Lists whose bounds, from the weakest on, stay below the k-th best score so
  far are not essential: only documents of the other, essential lists are candidates.
* A candidate's upper bound is what the essential lists give it plus the block scores of the others at its place. Those
  that stay below the k-th best score go before any block of those lists is unpacked; then the lists are looked up from
  the strongest on, unpacking only blocks that still have a candidate, with the same test after each.
* The k best of a query are carried from shard to shard in a task, and the tasks' heaps are merged by a window whose limit
  Spark applies before the shuffle, so k rows a query and task are shuffled.

Bounds are exact integers and a candidate goes only if it is strictly below, so the result is that of a full scan.

Defined cases: a null or termless text is in no list and does not count; a query without terms, or with terms that no
document has, has no rows. Each row of docs is a document, also where rows repeat; a null doc_id stays and is last among
equal scores. Query rows that share item_id (null too) are one query with the terms of all. Columns other than doc_id and
text, and item_id and text, are not read. Empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import written

#: Postings of a block, terms of a shard, queries of a block (about).
BLOCK = 128
SHARD_TERMS = 2_000_000
QUERY_BLOCK = 512
BEST = 10
#: 1000000000 * tf div (1000 * tf + 8 * (100 - 90 + 90 * n * N div L)).
GAIN, SLOPE, SPAN, FLOOR, REST = 1_000_000_000, 1000, 8, 100, 90
#: The term of a shard's own row, which no text has.
SHARD_ROW = b""
ROWS = 4096
#: Stands for a null item_id within the search.
NO_ITEM = -(1 << 63)

INDEX = (
    "shard string, term binary, df int, total long, last array<int>, start array<int>, widths array<int>, "
    "best_block array<int>, best_tf array<int>, best_n array<int>, data binary, docs array<long>, lengths array<int>"
)
ARROW_INDEX = pa.schema(
    [("shard", pa.string()), ("term", pa.binary()), ("df", pa.int32()), ("total", pa.int64())]
    + [(c, pa.list_(pa.int32())) for c in ("last", "start", "widths", "best_block", "best_tf", "best_n")]
    + [("data", pa.binary()), ("docs", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32()))]
)


def _fold() -> bytes:
    """Bytes that separate terms become blanks, A-Z become a-z, all others stay."""
    table = bytearray(range(256))
    for first, last in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
        table[first : last + 1] = b" " * (last + 1 - first)
    for c in range(ord("A"), ord("Z") + 1):
        table[c] = c + 32
    return bytes(table)


FOLD = _fold()


def terms_of(raw: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, in order, repeats kept."""
    return raw.translate(FOLD).split()


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a posting's weight is multiplied by; m: the document's length against the mean."""
    return (GAIN * tf) // (SLOPE * tf + SPAN * m)


# index


def _width(most: np.ndarray) -> np.ndarray:
    """Bytes that a block's greatest number needs: 0, 1, 2 or 4."""
    return np.select([most == 0, most < 1 << 8, most < 1 << 16], [0, 1, 2], 4)


def _packed(values: np.ndarray, width: np.ndarray, at: np.ndarray, out: np.ndarray) -> None:
    """Writes each value at its place, little end first."""
    for b in range(4):
        use = width > b
        out[at[use] + b] = (values[use] >> (8 * b)) & 255


def _offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)


def _rows(shard: str, names: list[bytes], term: np.ndarray, doc: np.ndarray, tf: np.ndarray, ids: list, lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The shard's own row, and a row for each list. term, doc and tf are the postings, documents ascending."""
    own = [[shard], [SHARD_ROW], [len(ids)], [int(lengths.sum())], *[[None]] * 7, [ids], [lengths]]
    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(own, ARROW_INDEX, strict=True)], schema=ARROW_INDEX)
    order = np.argsort(term, kind="stable")
    term, doc, tf = term[order], doc[order], tf[order]
    df = np.bincount(term, minlength=len(names))
    first = _offsets(df)[:-1]
    place = np.arange(len(term)) - first[term]
    opens = np.flatnonzero(place % BLOCK == 0)  # of blocks
    size = np.diff(np.append(opens, len(term)))
    block = np.repeat(np.arange(len(opens)), size)
    gap = np.diff(doc, prepend=0)
    gap[first] = doc[first]
    wide, narrow = _width(np.maximum.reduceat(gap, opens)), _width(np.maximum.reduceat(tf - 1, opens))
    starts = np.concatenate([[0], np.cumsum((wide + narrow) * size)])
    data = np.zeros(starts[-1], np.uint8)
    inside = np.arange(len(term)) - opens[block]
    _packed(gap, wide[block], starts[block] + inside * wide[block], data)
    _packed(tf - 1, narrow[block], starts[block] + size[block] * wide[block] + inside * narrow[block], data)
    # pairs that no other of the block beats: by frequency from the greatest on, each shorter than all before it
    n = lengths[doc].astype(np.int64)
    down = np.lexsort((n, -tf, block))
    step = np.int64(n.max()) + 1
    key = n[down] - block[down] * step
    floor = np.minimum.accumulate(key)
    best = down[np.concatenate([[True], key[1:] < floor[:-1]])]
    blocks = np.bincount(term[opens], minlength=len(names))
    b0, p0 = _offsets(blocks), _offsets(np.bincount(term[best], minlength=len(names)))
    base = starts[opens.searchsorted(first)]  # where each list's bytes begin
    lists = {
        "last": (b0, doc[np.append(opens[1:], len(term)) - 1]), "start": (b0, starts[:-1] - base[term[opens]]), "widths": (b0, wide * 8 + narrow),
        "best_block": (p0, block[best] - block[first][term[best]]), "best_tf": (p0, tf[best]), "best_n": (p0, n[best]),
    }
    total = np.bincount(term, weights=tf, minlength=len(names))
    column = {k: pa.ListArray.from_arrays(o, pa.array(v, pa.int32())) for k, (o, v) in lists.items()}
    ends = np.append(base, len(data)).astype(np.int32)
    column |= {
        "shard": pa.array([shard] * len(names)), "term": pa.array(names, pa.binary()), "df": pa.array(df, pa.int32()), "total": pa.array(total.astype(np.int64)),
        "data": pa.BinaryArray.from_buffers(pa.binary(), len(names), [None, pa.py_buffer(ends), pa.py_buffer(data)]),
        "docs": pa.nulls(len(names), ARROW_INDEX.field("docs").type), "lengths": pa.nulls(len(names), ARROW_INDEX.field("lengths").type),
    }
    whole = pa.RecordBatch.from_arrays([column[f.name] for f in ARROW_INDEX], schema=ARROW_INDEX)
    for at in range(0, len(names), ROWS):
        yield whole.slice(at, ROWS)


def _shards(shard_terms: int):
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        known: defaultdict[bytes, int] = defaultdict()
        known.default_factory = known.__len__
        term, tf, each, ids, lengths, held = [], [], [], [], [], 0
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for i in range(batch.num_rows):
                found = terms_of(texts[i].as_py() or b"")
                if not found:
                    continue
                counts = Counter(found)
                term.append(np.fromiter(map(known.__getitem__, counts), np.int64, len(counts)))
                tf.append(np.fromiter(counts.values(), np.int64, len(counts)))
                each.append(len(counts))
                ids.append(batch.column(0)[i].as_py())
                lengths.append(len(found))
                held += len(found)
                if held >= shard_terms:
                    yield from _rows(f"{task}-{number}", list(known), np.concatenate(term), np.repeat(np.arange(len(ids)), each), np.concatenate(tf), ids, np.array(lengths))
                    number += 1
                    known.clear()
                    term, tf, each, ids, lengths, held = [], [], [], [], [], 0
        if ids:
            yield from _rows(f"{task}-{number}", list(known), np.concatenate(term), np.repeat(np.arange(len(ids)), each), np.concatenate(tf), ids, np.array(lengths))

    return shards


def build_index(docs: DataFrame, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """The inverted lists of all texts, written: a row for each shard and term, and one for each shard itself, with its
    documents and their lengths."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(_shards(shard_terms), INDEX), "lists")


# search


class Postings:
    """One list of a shard under given totals. Blocks are unpacked when they are first asked for."""

    def __init__(self, row: dict, m: np.ndarray, totals: tuple[int, int]):
        self.weight, self.df = int(row["weight"]), int(row["df"])
        self.last, self.start, self.widths, self.data, self.m = row["last"], row["start"], row["widths"], row["data"], m
        n_docs, n_terms = totals
        lengths = row["best_n"].astype(np.int64)
        scores = self.weight * impact(row["best_tf"].astype(np.int64), FLOOR - REST + REST * lengths * n_docs // n_terms)
        self.tops = np.zeros(len(self.last), np.int64)
        np.maximum.at(self.tops, row["best_block"], scores)
        self.bound = int(self.tops.max())
        self.seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of a block."""
        if b not in self.seen:
            size = min(BLOCK, self.df - b * BLOCK)
            wide, narrow = divmod(int(self.widths[b]), 8)
            at, parts = int(self.start[b]), []
            for width in (wide, narrow):
                parts.append(np.frombuffer(self.data, f"<u{width}", size, at).astype(np.int64) if width else np.zeros(size, np.int64))
                at += width * size
            docs = np.cumsum(parts[0]) + (int(self.last[b - 1]) if b else 0)
            self.seen[b] = docs, self.weight * impact(parts[1] + 1, self.m[docs])
        return self.seen[b]

    def blocks(self, which) -> tuple[np.ndarray, np.ndarray]:
        got = [self.block(b) for b in which]
        return got[0] if len(got) == 1 else (np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]))


def candidates(lists: list[Postings], least: int, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a shard that score at least `least` (which is over 0), and their scores; some may score less."""
    lists = sorted(lists, key=lambda x: x.bound)
    reach = np.cumsum([x.bound for x in lists])
    n_rest = int(np.searchsorted(reach, least, "left"))  # lists that even together stay below
    sums = np.zeros(n_docs, np.int64)
    for x in lists[n_rest:]:
        docs, scores = x.blocks(range(len(x.last)))
        sums[docs] += scores
    found = np.flatnonzero(sums)
    rest = lists[:n_rest][::-1]
    found = found[sums[found] + (int(reach[n_rest - 1]) if n_rest else 0) >= least]
    exact = sums[found]
    if not rest or not len(found):
        return found, exact
    at = [np.searchsorted(x.last, found) for x in rest]
    tops = [np.append(x.tops, 0)[a] for x, a in zip(rest, at, strict=True)]
    upper = exact + sum(tops)
    alive = np.flatnonzero(upper >= least)
    for x, a, top in zip(rest, at, tops, strict=True):
        if not len(alive):
            break
        a = a[alive]
        inside = np.unique(a[a < len(x.last)])
        gain = np.zeros(len(alive), np.int64)
        if len(inside):
            docs, scores = x.blocks(inside.tolist())
            where = np.minimum(np.searchsorted(docs, found[alive]), len(docs) - 1)
            gain = np.where(docs[where] == found[alive], scores[where], 0)
        exact[alive] += gain
        upper[alive] += gain - top[alive]
        alive = alive[upper[alive] >= least]
    return found[alive], exact[alive]


class Heap:
    """The k best of a query so far: score descending, doc_id ascending, null last."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.none, self.id = np.zeros(0, np.int64), np.zeros(0, np.bool_), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """The score that a document needs at least."""
        return max(1, int(self.score[-1])) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, none: np.ndarray, ids: np.ndarray) -> None:
        score, none, ids = (np.concatenate(x) for x in ((self.score, score), (self.none, none), (self.id, ids)))
        best = np.lexsort((ids, none, -score))[: self.k]
        self.score, self.none, self.id = score[best], none[best], ids[best]


def _search_shard(rows: list[dict], heaps: dict, totals: tuple[int, int], k: int) -> None:
    """Rows of a shard, its own first."""
    own = rows[0]
    lengths = own["lengths"].astype(np.int64)
    m = FLOOR - REST + REST * lengths * totals[0] // totals[1]
    by_item: defaultdict = defaultdict(list)
    for row in rows[1:]:
        postings = Postings(row, m, totals)
        for item in row["items"]:
            by_item[item].append(postings)
    for item, lists in by_item.items():
        heap = heaps.setdefault(item, Heap(k))
        found, scores = candidates(lists, heap.least, len(lengths))
        good = scores >= heap.least
        if good.any():
            heap.add(scores[good], own["none"][found[good]], own["docs"][found[good]])


def _searched(totals: tuple[int, int], k: int):
    numbers = ("last", "start", "widths", "best_block", "best_tf", "best_n", "lengths")

    def lists(column: pa.Array) -> list[np.ndarray]:
        offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
        return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]

    def rows(batch: pa.RecordBatch) -> Iterator[tuple[tuple, dict]]:
        column = {name: batch.column(name) for name in batch.schema.names}
        got = {c: lists(column[c]) for c in numbers} | {c: column[c].to_pylist() for c in ("block", "shard", "term", "weight", "df", "data", "items")}
        for i in range(batch.num_rows):
            row = {c: got[c][i] for c in got}
            if row["term"] == SHARD_ROW:
                ids = column["docs"][i].values
                row |= {"none": ids.is_null().to_numpy(zero_copy_only=False), "docs": ids.fill_null(0).to_numpy()}
            yield (row["block"], row["shard"]), row

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict = {}
        shard, held = None, []
        for batch in batches:
            for key, row in rows(batch):
                if key != shard and held:
                    _search_shard(held, heaps, totals, k)
                    held = []
                shard = key
                held.append(row)
        if held:
            _search_shard(held, heaps, totals, k)
        for item, heap in heaps.items():
            ids = pa.array(heap.id, mask=heap.none, type=pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(ids), pa.int64()), ids, pa.array(heap.score, pa.int64())], ["item_id", "doc_id", "score"])

    return searched


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def _distinct_terms(texts):
    return texts.map(lambda t: sorted(set(terms_of((t or "").encode("utf-8", "surrogatepass")))))


def search(index: DataFrame, items: DataFrame, k: int = BEST, query_block: int = QUERY_BLOCK) -> DataFrame:
    """item_id, rank, doc_id and score of each query's k best documents, from an index."""
    own = F.col("term") == F.lit(SHARD_ROW)
    whole = index.where(own).agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("l")).first()
    totals = (int(whole["n"]), int(whole["l"]))
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(_distinct_terms(F.col("text").cast("string"))).alias("term")).distinct()
    asked = written(asked, "asked")
    blocks = max(1, -(-asked.select("item_id").distinct().count() // query_block))
    dealt = asked.withColumn("block", F.pmod(F.coalesce(F.xxhash64("item_id"), F.lit(0)), F.lit(blocks)).cast("int"))
    by_term = dealt.groupBy("block", "term").agg(F.collect_list(F.coalesce("item_id", F.lit(NO_ITEM))).alias("items"))  # at most a block of queries
    counted = index.select("term", "df").join(asked.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("df"))
    share = (F.lit(2.0) * totals[0] + 2) / (2 * F.col("df") + 1)
    weighed = counted.select("term", F.floor(1000 * F.ln(share)).cast("long").alias("weight"))
    shards = index.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block"), F.lit(SHARD_ROW).alias("term"), F.array().cast("array<bigint>").alias("items"), F.lit(0).cast("long").alias("weight"))
    wanted = written(by_term.join(weighed, "term").select("block", "term", "items", "weight").union(shards), "wanted")
    rows = index.drop("total").join(wanted, "term")
    found = rows.repartition("block", "shard").sortWithinPartitions("block", "shard", "term").mapInArrow(_searched(totals, k), "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.when(F.col("item_id") != NO_ITEM, F.col("item_id")).alias("item_id"), "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The ten best documents of each item: item_id, rank, doc_id and score."""
    return search(build_index(docs), items)


#: The same in DuckDB's SQL.
TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {TERMS} AS ts FROM documents),
p AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY ALL),
s AS (SELECT r, doc_id, len(ts)::BIGINT AS n FROM d WHERE len(ts) > 0),
t AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM s),
q AS (SELECT DISTINCT item_id, unnest({TERMS}) AS term FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term), t),
x AS (SELECT item_id, s.r, s.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN p USING (term) JOIN s ON p.r = s.r, t GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM x WHERE score > 0) WHERE rank <= 10
"""
