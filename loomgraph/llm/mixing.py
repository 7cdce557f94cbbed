"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Every source gets a target in words. Its documents are shuffled by a hash and read up to three times; a copy's
virtual finish time is the source's words up to and with that copy, divided by the source's target. All copies are
sorted by virtual finish time over ranges, and the mix is cut where its running total reaches the budget: ranges before
the one that crosses it are whole, and that one is cut at its last copy that fits.

Only ids, hashes and sizes are shuffled; texts are joined to the plan at the end, where they are wanted. Running totals
are two-level: totals of blocks first, then rows within a block. So no window holds a whole source or the whole corpus,
and a source with a third of all rows is spread over as many blocks as any other rows. The sources themselves, one row
each, are ranked in one task.

Defined cases: null text has size 0; a null source is a source of its own, last in order; documents of size 0 take
0 words; rows that repeat id, source and text stand next to each other and share one finish time, so all are taken or
none; an empty table gives an empty mix; further columns pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import WORD, tasks_for, written

#: Words that one block of a running total holds, about, and copies in a range of the sorted queue.
BLOCK_WORDS = 1_000_000
RANGE_ROWS = 500_000
#: Bits of the hash that shuffles.
ORDER_BITS = 60
#: Times that a document may be used.
MAX_EPOCHS = 3
#: Weights that the sources get in turn, by code point of their names.
WEIGHTS = (1, 2, 3)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes: source, size (a source's words). Adds weight and target.

    A target is min(max_epochs * size, level * weight); the level at which all targets add up to the total is found
    from the sources in order of the level at which each is full.
    """
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    cap = F.col("size").cast("double") * max_epochs
    by_fullness = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    everyone = Window.partitionBy()
    return (
        sizes.withColumn("weight", weight)
        .withColumn("full_at", cap / F.col("weight"))
        .withColumn("full_before", F.coalesce(F.sum(cap).over(by_fullness.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(by_fullness.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("size").over(everyone))
        # the level if this source and all that fill later were open; the first that does not fill up is right
        .withColumn("level", (F.col("total") - F.col("full_before")) / F.col("open_weight"))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(everyone)["level"])
        .withColumn("target", F.least(cap, F.col("level") * F.col("weight")))
        .select("source", "size", "weight", "target")
    )


def shuffled_place(doc_id: Column, text: Column) -> Column:
    """A document's place in the shuffle: 60 bits of a hash of its id and its text."""
    name = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, ORDER_BITS // 4), 16, 10).cast("long")


def _finish(epoch: Column) -> Column:
    return (epoch * F.col("source_size") + F.col("upto")) / F.col("target")


def queue(slim: DataFrame, max_epochs: int = MAX_EPOCHS, tasks: int | None = None) -> DataFrame:
    """slim: id, place, source, size. One row for each distinct row of these, with times (how many there are),
    source_size, target and upto: the source's words up to and with this document."""
    each = slim.groupBy("source", "place", "id", "size").agg(F.count("*").alias("times"))
    each = written(each, "sizes", tasks)
    per_source = each.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("size"))
    goal = targets(per_source, max_epochs=max_epochs).select(F.col("source").alias("goal_source"), F.col("size").alias("source_size"), "target")
    # blocks of a source by ranges of the hash
    blocks = F.greatest(F.ceil(F.col("source_size") / BLOCK_WORDS), F.lit(1)).cast("double")
    hashed = each.join(goal, F.col("source").eqNullSafe(F.col("goal_source"))).withColumn("block", F.floor(F.col("place") / float(1 << ORDER_BITS) * blocks))
    ahead = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        hashed.groupBy("source", "block").agg(F.sum(F.col("size") * F.col("times")).alias("words"))
        .withColumn("start", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
        .select(F.col("source").alias("s"), F.col("block").alias("b"), "start")
    )
    # documents with one place are peers
    within = Window.partitionBy("source", "block").orderBy("place").rangeBetween(Window.unboundedPreceding, 0)
    made = hashed.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    made = made.withColumn("upto", F.col("start") + F.sum(F.col("size") * F.col("times")).over(within))
    return made.select("id", "place", "source", "size", "times", "source_size", "target", "upto")


def _last_copy(queued: DataFrame, max_epochs: int) -> tuple[float, int] | None:
    """Finish time and place of the last copy within the budget, from all copies sorted over ranges; None if all fit."""
    total, rows = queued.agg(F.coalesce(F.sum(F.col("size") * F.col("times")), F.lit(0)), F.count("*")).first()
    copies = queued.where("size > 0 and target > 0").select(
        (F.col("size") * F.col("times")).alias("words"), "place", F.explode(F.transform(F.sequence(F.lit(0), F.lit(max_epochs - 1)), _finish)).alias("finish")
    )
    ranges = max(1, -(-rows * max_epochs // RANGE_ROWS))
    queue_of = written(copies.repartitionByRange(ranges, "finish", "place").withColumn("range", F.spark_partition_id()), "queue")
    running = F.sum("words").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0))
    crossing = (
        queue_of.groupBy("range").agg(F.sum("words").alias("words")).withColumn("running", running).where(F.col("running") > total)
        .agg(F.min(F.struct("range", (F.col("running") - F.col("words")).alias("ahead"))).alias("x")).select("x.*").first()
    )
    if crossing is None or crossing["range"] is None:
        return None
    # one range; its rows are about RANGE_ROWS
    upto = F.sum("words").over(Window.orderBy("finish", "place"))
    last = (
        queue_of.where(F.col("range") == crossing["range"]).withColumn("upto", upto + crossing["ahead"]).where(F.col("upto") <= total)
        .agg(F.max(F.struct("finish", "place")).alias("x")).select("x.*").first()
    )
    if last is not None and last["finish"] is not None:
        return last["finish"], last["place"]
    before = queue_of.where(F.col("range") < crossing["range"]).agg(F.max(F.struct("finish", "place")).alias("x")).select("x.*").first()
    return (before["finish"], before["place"]) if before is not None and before["finish"] is not None else (-1.0, 0)


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """id, place, source, size, times, source_size, target and n_copies, without texts; a row as of queue()."""
    slim = docs.select(
        F.col(id_col).cast("long").alias("id"), shuffled_place(F.col(id_col), F.col(text_col)).alias("place"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")
    )
    tasks = tasks_for(docs.sparkSession, 0) + docs.count() // RANGE_ROWS
    queued = written(queue(slim, max_epochs, tasks), "queued", tasks)
    last = _last_copy(queued, max_epochs)
    in_mix = lambda e: F.lit(True) if last is None else (_finish(e) < last[0]) | ((_finish(e) == last[0]) & (F.col("place") <= last[1]))
    copies = sum(F.when(in_mix(F.lit(e)), 1).otherwise(0) for e in range(max_epochs))
    used = F.when((F.col("size") > 0) & (F.col("target") > 0), copies).otherwise(0)
    return queued.select("id", "place", "source", "size", "times", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), used.alias("n_copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per document: row (the document as a struct), size, source_size, target, taken.

    taken: the words that the mix takes from the document, a whole number of copies.
    """
    planned = plan(docs, id_col, text_col, source_col, max_epochs).withColumnRenamed("source", "of").withColumnRenamed("place", "at").drop("times")
    rows = docs.select(F.struct("*").alias("row"), shuffled_place(F.col(id_col), F.col(text_col)).alias("place"))
    same = (F.col("place") == F.col("at")) & F.col(f"row.{source_col}").eqNullSafe(F.col("of")) & F.col(f"row.{id_col}").cast("long").eqNullSafe(F.col("id"))
    return rows.join(planned, same).select("row", "size", "source_size", "target", (F.col("n_copies") * F.col("size")).cast("long").alias("taken"))


def mix_digest(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    planned = plan(docs.select("doc_id", "source", "text"))
    each = planned.withColumn("one", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return each.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("n_copies") * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, with their columns and n_copies, the times each is used."""
    names = set(docs.columns)
    extra = next(x for x in ("n_copies", *(f"n_copies_{i}" for i in range(1, 99))) if x not in names)
    return mix(docs).where("taken > 0").select("row.*", F.expr("cast(taken / size as int)").alias(extra))


#: The same rows in one piece, for DuckDB.
ORACLE_SQL = r"""WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || left(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 15))::BIGINT AS place FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY 1),
weighed AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, source_size::DOUBLE * 3 AS cap FROM sources),
filled AS (
  SELECT *, cap / weight AS full_at, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
    sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight, sum(source_size) OVER ()::BIGINT AS total FROM weighed),
levels AS (SELECT arg_min(level, full_at) AS level FROM (SELECT full_at, (total - full_before) / open_weight AS level FROM filled) WHERE level <= full_at),
targets AS (SELECT source, source_size, total, least(cap, level * weight) AS target FROM filled, levels),
placed AS (
  SELECT s.*, source_size, target, total, sum(size) OVER (PARTITION BY s.source ORDER BY place)::BIGINT AS upto FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (SELECT *, (e * source_size + upto) / target AS finish FROM placed, (SELECT unnest([0, 1, 2]) AS e) WHERE size > 0 AND target > 0),
queue AS (SELECT doc_id, place, size, sum(size) OVER (ORDER BY finish, place) AS running, total FROM copies),
used AS (SELECT doc_id, place, sum(size)::BIGINT AS taken FROM queue WHERE running <= total GROUP BY 1, 2)
SELECT p.doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM placed p LEFT JOIN used u ON p.place = u.place AND p.doc_id IS NOT DISTINCT FROM u.doc_id"""
