"""Language identification with a string kernel.

The kernel is the blended spectrum of n-gram presence: the number of distinct character n-grams (n = 1 to 4) that two
lower-cased texts share, over the root of the product of their numbers. Nystroem landmarks span the kernel's space;
one-versus-rest ridge regression in it is solved from sums over the training rows. A batch of texts is scored by one
product of its presence matrix and the folded weights.

The model is fitted on a bounded sample of labelled rows (`landmarks_per_class`, `rows_per_class`), chosen by a hash
of the row among rows that the caller names; landmarks are texts of at most `LANDMARK_CHARS` characters. More labels
than `MOST_LABELS` raise. Prediction reads every text whole.

Defined cases: a text that is null or has no letter is `und` with score 0; without any labelled row all texts are
`und`; repeated rows get equal predictions; ties go to the first label in order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import fold

UNDETERMINED = "und"
#: Bounds of what the driver gets: labels, and characters of a landmark.
MOST_LABELS, LANDMARK_CHARS = 200, 20_000
BITS = 18
GRAMS = (1, 2, 3, 4)
MULTIPLIER = np.uint32(0x9E3779B1)
SCHEMA = "lang_pred string, score double"


@dataclass
class LanguageModel:
    labels: list[str]
    features: np.ndarray  # hashed n-grams that some landmark has
    weights: np.ndarray  # features x labels


def _codes(text: str) -> np.ndarray:
    """Hashes of all n-grams of a lower-cased text, repeats included."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    rolling, out = np.zeros(len(points), np.uint32), []
    for n in GRAMS:
        if len(points) < n:
            break
        rolling = (rolling[: len(points) - n + 1] + np.uint32(1)) * MULTIPLIER
        rolling = rolling ^ (points[n - 1 :] * np.uint32(0x85EBCA6B))
        mixed = rolling * np.uint32(0xC2B2AE35)
        out.append(mixed >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _presence(texts: list[str], features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which features each text has, and the root of its number of distinct n-grams."""
    seen = np.zeros(1 << BITS, np.bool_)
    has, root = np.zeros((len(texts), len(features)), np.float32), np.ones(len(texts), np.float32)
    for i, text in enumerate(texts):
        codes = _codes(text)
        seen[codes] = True
        has[i] = seen[features]
        root[i] = np.sqrt(max(1, np.count_nonzero(seen)))
        seen[codes] = False
    return has, root


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _sample(labelled: DataFrame, per_class: int) -> DataFrame:
    """About per_class rows of each label, by a hash; all rows of a label that has no more."""
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col("label") == label, min(1.0, per_class / n)).otherwise(share)
    return labelled.where(F.pmod(F.xxhash64("key", F.lit(8)), F.lit(1 << 30)) < share * (1 << 30))


def fit(labelled: DataFrame, landmarks_per_class: int = 60, rows_per_class: int = 2000, ridge: float = 1e-3) -> LanguageModel:
    """labelled: key, text, label. The numbers of landmarks and of rows are bounds of the sample, per label."""
    labelled = labelled.where(F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}"))
    if labelled.select("label").distinct().limit(MOST_LABELS + 1).count() > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    short = labelled.where(F.length("text") <= LANDMARK_CHARS)
    chosen = [(r["label"], r["text"]) for r in _sample(short, landmarks_per_class).select("label", "text").collect()]
    labels = sorted({x for x, _ in chosen})
    if not labels:
        return LanguageModel([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32))
    landmarks = [t for _, t in sorted(chosen)]
    features = np.unique(np.concatenate([_codes(t) for t in landmarks])).astype(np.int64)
    has, root = _presence(landmarks, features)
    base = has / root[:, None]
    place = {x: i for i, x in enumerate(labels)}

    def sums(batches):
        m, c = len(landmarks), len(labels)
        gram, target, rows = np.zeros((m, m)), np.zeros((m, c)), 0
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                part = part[part["label"].isin(place)]
                if len(part):
                    own, norm = _presence(part["text"].tolist(), features)
                    kernel = ((own / norm[:, None]) @ base.T).astype(np.float64)
                    wanted = np.zeros((len(part), c))
                    wanted[np.arange(len(part)), part["label"].map(place)] = 1
                    gram, target, rows = gram + kernel.T @ kernel, target + kernel.T @ wanted, rows + len(part)
        if rows:
            yield pd.DataFrame({"gram": [gram.ravel().tolist()], "target": [target.ravel().tolist()], "n": [rows]})

    sample = _sample(labelled, rows_per_class).select("text", "label").repartition(6)
    parts = sample.mapInPandas(sums, "gram array<double>, target array<double>, n long").collect()
    m, c = len(landmarks), len(labels)
    gram = sum(np.array(p["gram"]) for p in parts).reshape(m, m)
    target = sum(np.array(p["target"]) for p in parts).reshape(m, c)
    n = sum(p["n"] for p in parts)
    inner = (base @ base.T).astype(np.float64)
    alpha = np.linalg.solve(gram + ridge * n * inner + 1e-8 * n * np.eye(m), target)
    return LanguageModel(labels, features, (base.T @ alpha).astype(np.float32))


def predictor(model: LanguageModel):
    """A function of a text column: struct of lang_pred and score (the winner's regression value, cut to 0..1)."""

    @F.pandas_udf(SCHEMA)
    def predict(texts: pd.Series) -> pd.DataFrame:
        label, score = np.full(len(texts), UNDETERMINED, dtype=object), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if _has_letter(t)] if model.labels else []
        for at in range(0, len(known), 256):
            rows = known[at : at + 256]
            has, root = _presence([texts.iloc[i] for i in rows], model.features)
            value = (has @ model.weights) / root[:, None]
            best = value.argmax(axis=1)
            label[rows] = np.array(model.labels, dtype=object)[best]
            score[rows] = np.clip(value[np.arange(len(rows)), best], 0, 1)
        return pd.DataFrame({"lang_pred": label, "score": score})

    return predict


def training_rows(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """Labelled rows outside the held-out fold of crc32(doc_id as text)."""
    learn = docs.where(fold(F.col("doc_id"), folds) != held)
    return learn.select(F.col("doc_id").alias("key"), "text", F.col("lang").alias("label"))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    predict = predictor(fit(training_rows(docs)))
    held: Column = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    return docs.select("doc_id", held, predict(F.col("text")).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, least: float = 0.2) -> DataFrame:
    """The documents, less those that are undetermined or score under least."""
    predict = predictor(fit(training_rows(docs)))
    row = docs.select(F.struct("*").alias("row"), predict(F.col("text")).alias("p"))
    return row.where((F.col("p.lang_pred") != UNDETERMINED) & (F.col("p.score") >= least)).select("row.*")
