"""Token counts as a delta-maintained rollup.

A change says that a document came (insert), went (delete) or has a new count (revise) under a tokenizer version. Each
is a signed delta of documents and tokens; a batch of changes is summed by source, language and tokenizer version and
committed as a small table of its own, named by the batch. A batch that is committed already is left as it is, and one
that was broken off is written anew: so a batch may be replayed any number of times. One writer at a time commits. Totals are the sums over the
committed batches.

Defined cases: a null text has 0 tokens; null sources and languages are groups of their own; groups whose documents and
tokens add up to 0 are not listed; a change with a null count counts 0; an empty batch commits and changes nothing.
"""

from __future__ import annotations

import base64
import unicodedata

import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import doc_key, text_hash, written
from loomgraph.session import scratch

TOKENIZERS = "/opt/tokenizers"
#: Tokenizer versions that are counted, by the names of their rank files.
VERSIONS = ("byte_bpe_50k", "byte_bpe_multi_50k")
#: Fixed value: the pattern that belongs to these rank files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
GROUPS = ("source", "lang", "tokenizer")
TOTALS = "source string, lang string, tokenizer string, docs long, tokens long"


def load_encoding(folder: str, version: str) -> tiktoken.Encoding:
    with open(f"{folder}/{version}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(version, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def revised(text: str) -> str:
    """The text as a later cleaning leaves it: composed characters, single blanks, none at the ends of lines."""
    lines = unicodedata.normalize("NFC", text).split("\n")
    return "\n".join(" ".join(x for x in line.split(" ") if x) for line in lines)


def count_tokens(docs: DataFrame, versions: tuple[str, ...] = VERSIONS, folder: str = TOKENIZERS) -> DataFrame:
    """docs: d, source, lang, text. Adds, in place of text, its 128-bit hash t (a null text is an empty one), tokenizer,
    n_tokens and revised_tokens (of the text as revised() leaves it), a row for each version.

    The rank files are the driver's; Spark takes them to the executors.
    """
    for v in versions:
        docs.sparkSession.sparkContext.addFile(f"{folder}/{v}.tiktoken")

    def counts(batches):
        encodings = [(v, load_encoding(SparkFiles.getRootDirectory(), v)) for v in versions]
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            later = [revised(t) for t in texts]
            for version, encoding in encodings:
                n = [len(encoding.encode_ordinary(t)) for t in texts]
                m = [k if a == b else len(encoding.encode_ordinary(b)) for a, b, k in zip(texts, later, n, strict=True)]
                yield batch.drop(columns="text").assign(tokenizer=version, n_tokens=n, revised_tokens=m)

    flat = docs.select("d.n", "d.i", "d.h", text_hash(F.coalesce("text", F.lit(""))).alias("t"), "source", "lang", "text")
    made = flat.mapInPandas(counts, "n int, i long, h long, t binary, source string, lang string, tokenizer string, n_tokens long, revised_tokens long")
    return made.select(F.struct("n", "i", "h").alias("d"), "t", *GROUPS, "n_tokens", "revised_tokens")


def deltas(changes: DataFrame) -> DataFrame:
    """changes: kind, source, lang, tokenizer, n_tokens, old_tokens (revise only). Signed sums by group."""
    new, old = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    docs = F.when(F.col("kind") == "insert", 1).when(F.col("kind") == "delete", -1).otherwise(0)
    tokens = F.when(F.col("kind") == "insert", new).when(F.col("kind") == "delete", -new).when(F.col("kind") == "revise", new - old).otherwise(0)
    return changes.groupBy(*GROUPS).agg(F.sum(docs).cast("long").alias("docs"), F.sum(tokens).cast("long").alias("tokens"))


class Rollup:
    """Totals in a folder that all executors share, one sub-folder for each committed batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, path: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def _folders(self) -> list[str]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [x.getPath().toString() for x in system.listStatus(root)] if system.exists(root) else []
        return [x for x in found if x.rpartition("/")[2].startswith("batch=")]

    def committed(self, batch: int | str) -> bool:
        return self._exists(f"{self.path}/batch={batch}/_SUCCESS")

    def commit(self, changes: DataFrame, batch: int | str) -> bool:
        """True if the batch was committed now, False if it was before. Fits DataStreamWriter.foreachBatch."""
        if self.committed(batch):
            return False
        deltas(changes).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs and tokens over the committed batches."""
        done = [x for x in self._folders() if self._exists(f"{x}/_SUCCESS")]
        if not done:
            return self.spark.createDataFrame([], TOTALS)
        sums = self.spark.read.schema(TOTALS).parquet(*done).groupBy(*GROUPS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs <> 0 or tokens <> 0")


def token_report(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """Totals after three batches over all documents: all come; counts are revised where cleaning changes a text;
    later copies of a text go. The first batch is then replayed. source, lang, tokenizer, n_docs, n_tokens."""
    spark = docs.sparkSession
    key = doc_key(F.col("doc_id"), F.col("text"))
    rows = docs.select(key.alias("d"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "text")
    ledger = written(count_tokens(rows, folder=folder), "ledger")
    rollup = Rollup(spark, scratch(spark, "rollup"))
    came = ledger.select(F.lit("insert").alias("kind"), *GROUPS, "n_tokens", F.lit(0).alias("old_tokens"))
    changed = ledger.where("revised_tokens <> n_tokens").select(
        F.lit("revise").alias("kind"), *GROUPS, F.col("revised_tokens").alias("n_tokens"), F.col("n_tokens").alias("old_tokens")
    )
    held = ledger.groupBy("t").agg(F.min("d").alias("first"), F.max("d").alias("last")).where("first <> last")
    # a table of its own, so that Spark can split the rows of a text with very many copies
    held = written(held.select(F.col("t").alias("text"), "first"), "copied")
    copies = ledger.join(held, F.col("t") == F.col("text")).where("d <> first")
    went = copies.select(F.lit("delete").alias("kind"), *GROUPS, F.col("revised_tokens").alias("n_tokens"), F.lit(0).alias("old_tokens"))
    for batch, changes in enumerate((came, changed, went)):
        rollup.commit(changes, batch)
    rollup.commit(came, 0)
    return rollup.totals().select(*GROUPS, F.col("docs").alias("n_docs"), F.col("tokens").alias("n_tokens"))
