"""Language-model scoring with a gated recurrent network.

Counts of all words are taken over all training documents. The `head` most frequent words are the network's own
vocabulary, in classes of neighbouring frequency; its output is factored, P(class) * P(word in class), both softmax.
Every other word is in one of eight classes by its shape, where it has its share of the class's counts; a word that no
training document has counts as one token there, one event a class. So the events are those of the base score (known
words, and a word that is not known), their probabilities add up to 1, and an unseen word costs about what it costs in
the base score. A text's score is the log10 probability of all its tokens.

Training is truncated backpropagation through time in numpy, one pass over all training documents: these are dealt by
hash to `rounds` disjoint slices; in a round each partition trains on all its documents of one slice, from the same
weights, and the weights are averaged by tokens, block by block in two steps; so the weights depend on how the table is
partitioned. Texts become places in the vocabulary once, for training and scoring.
Scoring carries the state across windows, so a document is scored whole.

Defined cases: a null text is empty and has one token, its end; a null doc_id is in no fold and so neither held out nor
learned from; rows that repeat are scored one by one; with no training rows every word is unknown.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import blanks, fold, hashed_words, written

END = b"\n"
#: Hash and shape of the end, which is no word.
END_HASH, END_SHAPE = -1, 4
SPACE = blanks()
SHAPES = 8
#: Bins of counts per e-fold, to find the frequent words without sorting all.
COUNT_BINS = 32
#: Weights of a block, partitions that train at most, and those that are summed in a step.
BLOCK, MOST_SHARDS, SUMMED = 8192, 1024, 32
#: Tokens that are trained on at a time; what a task holds does not grow with its partition.
PIECE = 1 << 20
#: Windows of a piece at least: a short one is cut into fewer parallel streams.
WINDOWS = 64
#: The largest logit, so that its exponential is a float32.
LARGEST = np.float32(80)
#: Texts that are looked up together.
READ = 128
#: How places are stored; the head has to fit.
PLACE = np.dtype("<u2")


@dataclass(frozen=True)
class Settings:
    head: int = 8192
    known: int = 65536
    in_class: int = 128
    embedding: int = 16
    hidden: int = 24
    window: int = 32
    streams: int = 256
    rate: float = 0.2
    rounds: int = 2
    seed: int = 7


def tokens(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hash and shape of each word with A-Z lowered; ASCII white space separates words."""
    hashes, n, last = hashed_words(text.encode("utf-8", "replace").lower() if text else b"", SPACE)
    long = n > 8
    shapes = np.where(last == 0x2E, long, np.where(last == 0x2C, 2 + long, 4 + (n > 5) + long + (n > 11)))
    return hashes.view(np.int64), shapes.astype(np.int64)


def word_hash(word: bytes) -> int:
    return END_HASH if word == END else int(tokens(word.decode("utf-8", "replace"))[0][0])


def count_words(train: DataFrame) -> DataFrame:
    """train: text. hash, shape and count of every token, the end among them."""

    def counts(batches):
        # hash, shape and count of what is counted, then of single tokens
        held, size, docs = [np.zeros((3, 0), np.int64)], 0, 0

        def summed():
            hashes, shapes, n = np.concatenate(held, axis=1)
            order = np.argsort(hashes, kind="stable")
            hashes = hashes[order]
            first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]]) if len(hashes) else np.zeros(0, np.int64)
            return np.stack([hashes[first], shapes[order][first], np.add.reduceat(n[order], first) if len(first) else n])

        for batch in batches:
            for text in batch["text"]:
                hashes, shapes = tokens(text)
                held.append(np.stack([hashes, shapes, np.ones(len(hashes), np.int64)]))
                size, docs = size + len(hashes), docs + 1
                if size > PIECE:
                    held, size = [summed()], 0
                    if held[0].shape[1] > PIECE:
                        yield pd.DataFrame(dict(zip(("hash", "shape", "count"), held.pop(), strict=True)))
                        held.append(np.zeros((3, 0), np.int64))
        if docs:
            held.append(np.array([[END_HASH], [END_SHAPE], [docs]]))
            yield pd.DataFrame(dict(zip(("hash", "shape", "count"), summed(), strict=True)))

    return train.select("text").mapInPandas(counts, "hash long, shape int, count long").groupBy("hash", "shape").agg(F.sum("count").alias("count"))


def _frequent(counts: DataFrame, most: int) -> list[tuple[int, int]]:
    """hash and count of the most frequent words, at most that many; words of one count bin come all or not."""
    bins = counts.groupBy(F.floor(F.log("count") * COUNT_BINS).alias("bin")).agg(F.count("*").alias("n")).collect()
    least, room = None, most
    for r in sorted(bins, key=lambda r: -r["bin"]):
        if r["n"] > room:
            break
        least, room = r["bin"], room - r["n"]
    if least is None:
        return []
    rows = counts.where(F.floor(F.log("count") * COUNT_BINS) >= least).select("hash", "count").toLocalIterator()
    return sorted(((r["hash"], r["count"]) for r in rows), key=lambda x: (-x[1], x[0]))


@dataclass
class Vocabulary:
    """Head words by place (the end is 0), counts of all frequent words, and the shapes' shares."""

    head: dict[int, int]
    counts: dict[int, int]
    log_share: np.ndarray  # by shape: log10 of the share that one token has of its class's words outside the head
    total: int
    distinct: int


class Reader:
    """Looks the words of texts up in a vocabulary."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.n_head = vocab, len(vocab.head)
        known = {h: c for h, c in vocab.counts.items() if h != END_HASH} or {0: 0}
        self.hash = np.array(sorted(known), np.int64)
        count = np.array([known[h] for h in self.hash.tolist()], np.float64)
        self.place = np.array([vocab.head.get(h, -1) for h in self.hash.tolist()], np.int64)
        self.base, self.log_count = np.log10(count + 1), np.log10(np.maximum(count, 1))
        self.present = count > 0

    def __call__(self, texts: list[str | None]) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, list, list]:
        """For each text: places of its words and its end; of the words known here their number and their sums for the
        base score and for the share in their classes; hashes of the others, and their number times SHAPES and shape."""
        each = [tokens(t) for t in texts]
        size = np.array([len(h) for h, _ in each], np.int64)
        hashes, shapes = (np.concatenate([x[k] for x in each]) for k in range(2))
        doc = np.repeat(np.arange(len(texts)), size)
        at = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        here = (self.hash[at] == hashes) & self.present[at]
        place = np.where(here, self.place[at], -1)
        outside = np.flatnonzero(here & (place < 0))
        places = np.zeros(len(hashes) + len(texts), PLACE)  # the end is 0
        places[np.arange(len(hashes)) + doc] = np.where(place < 0, self.n_head + shapes, place)
        sums = lambda x, of: np.bincount(of, weights=x, minlength=len(texts))
        share = sums(self.vocab.log_share[shapes[outside]] + self.log_count[at[outside]], doc[outside])
        rest = np.flatnonzero(~here)
        rest = rest[np.lexsort((hashes[rest], doc[rest]))]
        first = np.flatnonzero(np.r_[True, (hashes[rest[1:]] != hashes[rest[:-1]]) | (doc[rest[1:]] != doc[rest[:-1]])]) if len(rest) else rest
        many, found = np.diff(first, append=len(rest)), rest[first]
        cut = np.searchsorted(doc[found], np.arange(1, len(texts)))
        return (
            np.split(places, np.cumsum(size + 1)[:-1]), sums(here, doc).astype(np.int64), sums(np.where(here, self.base[at], 0.0), doc), share,
            np.split(hashes[found], cut), np.split(many * SHAPES + shapes[found], cut),
        )


def vocabulary(counts: DataFrame, settings: Settings) -> Vocabulary:
    """counts: as of count_words, written."""
    sums = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    frequent = _frequent(counts, settings.known)
    end = word_hash(END)
    head = {end: 0}
    for h, _ in frequent:
        if len(head) < settings.head:
            head.setdefault(h, len(head))
    known = dict(frequent)
    if end not in known:
        known[end] = sum(r["count"] for r in counts.where(F.col("hash") == end).select("count").collect())
    # counts of the words outside the head, by shape
    total = np.zeros(SHAPES)
    for r in counts.groupBy("shape").agg(F.sum("count").alias("n")).collect():
        total[r["shape"]] = r["n"]
    places = counts.sparkSession.createDataFrame([(h,) for h in head], "h long")
    for r in counts.join(F.broadcast(places), F.col("hash") == F.col("h")).groupBy("shape").agg(F.sum("count").alias("n")).collect():
        total[r["shape"]] -= r["n"]
    share = -np.log10(total + 1)
    return Vocabulary(head, known, share, sums["n"], sums["v"])


class Network:
    """Weights of the gated recurrent unit and the class-factored output."""

    def __init__(self, vocab: Vocabulary, settings: Settings, flat: np.ndarray | None = None):
        self.s, self.n = settings, len(vocab.head)
        e, h = settings.embedding, settings.hidden
        self.n_classes = -(-self.n // settings.in_class)
        c = self.n_classes + SHAPES
        self.shapes = {"E": (self.n + SHAPES, e), "Wx": (e, 3 * h), "Wh": (h, 3 * h), "b": (3 * h,), "Wc": (h, c), "bc": (c,), "Wo": (self.n, h), "bo": (self.n,)}
        size = sum(int(np.prod(x)) for x in self.shapes.values())
        self.flat = np.zeros(size, np.float32) if flat is None else flat.astype(np.float32)
        self.past = None  # sums of squared gradients
        for name, part in self._parts(self.flat).items():
            setattr(self, name, part)
        if flat is None:
            draw = np.random.default_rng(settings.seed)
            self.E[:] = draw.normal(0, 0.3, self.E.shape)
            self.Wx[:] = draw.normal(0, 0.3, self.Wx.shape)
            self.Wh[:] = draw.normal(0, 0.2, self.Wh.shape)
            self.Wc[:] = draw.normal(0, 0.05, self.Wc.shape)
            # the start is the words' own frequencies
            count = np.zeros(self.n)
            for w, i in vocab.head.items():
                count[i] = max(1, vocab.counts.get(w, 1))
            mass = [count[i : i + settings.in_class].sum() for i in range(0, self.n, settings.in_class)]
            self.bo[:] = np.log(count / np.repeat(mass, settings.in_class)[: self.n])
            rest = np.maximum(1, 10**-vocab.log_share)
            self.bc[:] = np.log(np.concatenate([mass, rest]) / (sum(mass) + rest.sum()))

    def _parts(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """Views of one flat array, by weight."""
        out, at = {}, 0
        for name, form in self.shapes.items():
            n = int(np.prod(form))
            out[name] = flat[at : at + n].reshape(form)
            at += n
        return out

    def words_of(self, c: int) -> slice:
        return slice(c * self.s.in_class, min(self.n, (c + 1) * self.s.in_class))

    def step(self, x: np.ndarray, h: np.ndarray):
        """x: inputs' share of the gates. New state and what the way back needs."""
        k = self.s.hidden
        g = h @ self.Wh
        gates = np.tanh((x[:, : 2 * k] + g[:, : 2 * k]) * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)
        r, z = gates[:, :k], gates[:, k:]
        new = np.tanh(x[:, 2 * k :] + r * g[:, 2 * k :])
        return new + z * (h - new), (h, r, z, new, g[:, 2 * k :])

    def log_probability(self, states: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Natural log of each place's probability; of a shape's class as a whole for what is outside the head."""
        cls = np.where(place < self.n, place // self.s.in_class, place - self.n + self.n_classes)
        order = np.argsort(cls.astype(np.uint16), kind="stable")
        cls, place, states = cls[order], place[order], states[order]
        out = np.empty(len(place), np.float32)
        for at in range(0, len(place), 4096):
            out[at : at + 4096] = self._of(states[at : at + 4096] @ self.Wc + self.bc, cls[at : at + 4096])
        edges = np.searchsorted(cls, np.arange(self.n_classes + 1))
        for c in range(self.n_classes):
            words = self.words_of(c)
            for at in range(edges[c], edges[c + 1], 4096):
                own = slice(at, min(at + 4096, edges[c + 1]))
                out[own] += self._of(states[own] @ self.Wo[words].T + self.bo[words], place[own] - words.start)
        back = np.empty_like(out)
        back[order] = out
        return back

    @staticmethod
    def _of(logits: np.ndarray, column: np.ndarray) -> np.ndarray:
        """Log softmax at one column of each row; logits are overwritten.

        Biases are logs of shares, so logits stay far below LARGEST and one of a row stays far above its negative.
        """
        np.minimum(logits, LARGEST, out=logits)
        own = logits[np.arange(len(logits)), column]
        np.exp(logits, out=logits)
        return own - np.log(logits @ np.ones(logits.shape[1], np.float32))

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of each document's places (the end among them), many documents at a time."""
        if not docs:
            return np.zeros(0)
        self.gates_of = self.E @ self.Wx + self.b  # an input's share of the gates, by place
        total = np.zeros(len(docs))
        length_of = np.array([len(x) for x in docs], np.int64)
        flat = np.concatenate([*docs, np.zeros(1, np.int64)])
        start_of = np.cumsum(length_of) - length_of
        order = np.argsort(-length_of, kind="stable")
        t = self.s.window
        for first in range(0, len(order), 2048):
            group = order[first : first + 2048]
            length, start = length_of[group], start_of[group]
            state = np.zeros((len(group), self.s.hidden), np.float32)
            before = np.zeros(len(group), np.int64)  # the end stands before the first word
            for at in range(0, int(length[0]), t):
                live = int(np.searchsorted(-length, -at, side="left"))
                width = min(t, int(length[0]) - at)
                real = np.arange(at, at + width)[None, :] < length[:live, None]
                place = flat[np.where(real, start[:live, None] + np.arange(at, at + width), len(flat) - 1)]
                inputs = np.concatenate([before[:live, None], place[:, :-1]], axis=1)
                x = self.gates_of[inputs.T]  # step by step
                states = np.empty((width, live, self.s.hidden), np.float32)
                h = state[:live]
                for k in range(width):
                    h, _ = self.step(x[k], h)
                    states[k] = h
                state, before = h, place[:, -1]
                real = real.T
                part = np.zeros((width, live), np.float32)
                part[real] = self.log_probability(states[real], place.T[real])
                total[group[:live]] += part.sum(axis=0, dtype=np.float64)
        return total

    def train(self, stream: np.ndarray) -> None:
        """One pass over a stream of places, cut into parallel streams; Adagrad on sums over a window.

        Each place but the first is learned once, from the one before. Further calls go on with Adagrad's sums.
        """
        s, k = self.s, self.s.hidden
        lanes = max(1, min(s.streams, len(stream) // (s.window * WINDOWS)))
        n = (len(stream) - 1) // lanes
        if n < 1:
            return
        if self.past is None:
            self.past = np.ones_like(self.flat)
        rows = stream[(np.arange(lanes) * n)[None, :] + np.arange(n + 1)[:, None]].astype(np.int64)
        grad, work = np.empty_like(self.flat), np.empty_like(self.flat)
        of = self._parts(grad)
        h = np.zeros((lanes, k), np.float32)
        for at in range(0, n, s.window):
            width = min(s.window, n - at)
            inputs, place = rows[at : at + width], rows[at + 1 : at + 1 + width].reshape(-1)
            goes_on = (inputs != 0)[:, :, None].astype(np.float32)  # else a document begins
            embedded = self.E[inputs.reshape(-1)]
            x = (embedded @ self.Wx + self.b).reshape(width, lanes, 3 * k)
            states, kept = np.empty((width, lanes, k), np.float32), []
            for t in range(width):
                h, mid = self.step(x[t], h * goes_on[t])
                kept.append(mid)
                states[t] = h
            grad.fill(0)
            flat_states = states.reshape(-1, k)
            cls = np.where(place < self.n, place // s.in_class, place - self.n + self.n_classes)
            p = self._off(flat_states @ self.Wc + self.bc, cls)
            of["Wc"][:], of["bc"][:] = flat_states.T @ p, p.sum(axis=0)
            back = p @ self.Wc.T
            # the words of a class, class by class; the softmax of all at once
            order = np.argsort(cls.astype(np.uint16), kind="stable")
            edges = np.searchsorted(cls[order], np.arange(self.n_classes + 1))
            order = order[: edges[-1]]
            own, place = flat_states[order], place[order]
            z = np.full((len(order), s.in_class), -1e30, np.float32)
            found = [(self.words_of(c), slice(edges[c], edges[c + 1])) for c in range(self.n_classes) if edges[c] < edges[c + 1]]
            for words, here in found:
                z[here, : words.stop - words.start] = own[here] @ self.Wo[words].T + self.bo[words]
            q = self._off(z, place % s.in_class) if len(z) else z
            back_own = np.empty_like(own)
            for words, here in found:
                part = q[here, : words.stop - words.start]
                back_own[here] = part @ self.Wo[words]
                of["Wo"][words], of["bo"][words] = part.T @ own[here], part.sum(axis=0)
            back[order] += back_own
            back = back.reshape(states.shape)
            before, r, z, new, gn = (np.stack(m) for m in zip(*kept, strict=True))
            to_new, to_z, to_r = (1 - z) * (1 - new * new), (before - new) * z * (1 - z), gn * r * (1 - r)
            dx, dh, wh = np.empty_like(x), np.zeros_like(h), self.Wh.T.copy()
            dg = np.empty_like(x)
            for t in range(width - 1, -1, -1):
                dh += back[t]
                d_new = dh * to_new[t]
                dx[t, :, :k], dx[t, :, k : 2 * k], dx[t, :, 2 * k :] = d_new * to_r[t], dh * to_z[t], d_new
                dg[t, :, : 2 * k], dg[t, :, 2 * k :] = dx[t, :, : 2 * k], d_new * r[t]
                dh = (dh * z[t] + dg[t] @ wh) * goes_on[t]
            flat_dx = dx.reshape(-1, 3 * k)
            of["Wh"][:] = before.reshape(-1, k).T @ dg.reshape(-1, 3 * k)
            of["Wx"][:], of["b"][:] = embedded.T @ flat_dx, flat_dx.sum(axis=0)
            by_input = np.argsort(inputs.reshape(-1), kind="stable")
            used, start = np.unique(inputs.reshape(-1)[by_input], return_index=True)
            of["E"][used] = np.add.reduceat((flat_dx @ self.Wx.T)[by_input], start, axis=0)
            np.clip(grad, -5, 5, out=grad)
            self.past += np.multiply(grad, grad, out=work)
            grad /= np.sqrt(self.past, out=work)
            grad *= np.float32(s.rate)
            self.flat -= grad
        self.train(stream[lanes * n :])  # fewer than there are parallel streams

    @staticmethod
    def _off(logits: np.ndarray, column: np.ndarray) -> np.ndarray:
        """Softmax less one at one column of each row; logits are overwritten."""
        np.minimum(logits, LARGEST, out=logits)
        np.exp(logits, out=logits)
        logits *= (1 / (logits @ np.ones(logits.shape[1], np.float32)))[:, None]
        logits[np.arange(len(logits)), column] -= 1
        return logits


SHARD = "part int, block int, weights array<double>, n long"


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of weights of one block; of a bounded number of rows."""
    return pd.DataFrame({"part": [0], "block": rows["block"].iloc[:1], "weights": [np.sum(list(rows["weights"]), axis=0)], "n": [rows["n"].sum()]})


def train(encoded: DataFrame, vocab: Vocabulary, settings: Settings) -> tuple[np.ndarray, int]:
    """encoded: key, places. The averaged weights and the number of tokens learned."""
    flat, learned = Network(vocab, settings).flat, 0
    sent = encoded.sparkSession.sparkContext.broadcast(vocab)
    for turn in range(settings.rounds):
        start = encoded.sparkSession.sparkContext.broadcast(flat)

        def shard(batches, start=start):
            net, n = Network(sent.value, settings, start.value), 0
            # the end stands before the first word
            parts, size = [np.zeros(1, PLACE)], 1
            for batch in batches:
                for places in batch["places"]:
                    parts.append(np.frombuffer(places, PLACE))
                    size, n = size + len(parts[-1]), n + len(parts[-1])
                    if size > PIECE:
                        stream = np.concatenate(parts)
                        net.train(stream)
                        parts, size = [stream[-1:]], 1
            net.train(np.concatenate(parts))
            if n:
                blocks = range(0, len(net.flat), BLOCK)
                yield pd.DataFrame({"part": TaskContext.get().partitionId() // SUMMED, "block": list(blocks), "weights": [net.flat[k : k + BLOCK] * np.float64(n) for k in blocks], "n": n})

        chosen = F.pmod(F.xxhash64("key"), F.lit(settings.rounds)) == turn
        shards = encoded.where(chosen).select("places").coalesce(MOST_SHARDS).mapInPandas(shard, SHARD)
        mean = shards.groupBy("block", "part").applyInPandas(_added, SHARD).groupBy("block").applyInPandas(_added, SHARD).collect()
        if mean:
            flat = np.concatenate([np.array(r["weights"]) / r["n"] for r in sorted(mean, key=lambda r: r["block"])]).astype(np.float32)
            learned += mean[0]["n"]
    return flat, learned


def encode(slim: DataFrame, vocab: Vocabulary) -> DataFrame:
    """slim: doc_id, text, fold. Of each document its tokens' places and what its score needs besides the network.

    base and flat are sums over the words known here; tail has the hashes of the others, times their number and shape.
    """
    if len(vocab.head) + SHAPES > 1 << 16:
        raise ValueError("the network's vocabulary has more words than places can tell")
    sent = slim.sparkSession.sparkContext.broadcast(vocab)

    def encoded(batches):
        vocab = sent.value
        read = Reader(vocab)
        end = vocab.counts.get(END_HASH, 0)
        for batch in batches:
            for at in range(0, len(batch), READ):
                part = batch.iloc[at : at + READ]
                docs, known, base, flat, tails, times = read(part["text"].tolist())
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].array, "fold": part["fold"].array, "n_tokens": [len(x) for x in docs], "known": known + (end > 0), "base": base + np.log10(end + 1),
                    "flat": flat, "tail": tails, "times": times, "places": [x.tobytes() for x in docs],
                })

    made = slim.mapInPandas(encoded, "doc_id long, fold long, n_tokens long, known long, base double, flat double, tail array<long>, times array<long>, places binary")
    return made.withColumn("row", F.monotonically_increasing_id())


def score(docs: DataFrame, folds: int = 7, held: int = 2, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), fold(F.col(id_col), folds).alias("fold"))
    learn = slim.where(F.col("fold") != held)
    counts = written(count_words(learn), "counts")
    vocab = vocabulary(counts, settings)
    encoded = written(encode(slim, vocab), "encoded")
    flat, _ = train(encoded.where(F.col("fold") != held).select(F.col("doc_id").alias("key"), "places"), vocab, settings)
    vocab_sent, weights = spark.sparkContext.broadcast(vocab), spark.sparkContext.broadcast(flat)

    @F.pandas_udf("double")
    def likely(places: pd.Series) -> pd.Series:
        net = Network(vocab_sent.value, settings, weights.value)
        return pd.Series(net.score([np.frombuffer(x, PLACE).astype(np.int64) for x in places]) / np.log(10))

    made = written(encoded.withColumn("flat", F.col("flat") + likely("places")).drop("tail", "times", "places"), "scored")
    rest = encoded.select("row", F.explode(F.arrays_zip("tail", "times")).alias("x")).select("row", F.col("x.tail").alias("hash"), F.floor(F.col("x.times") / SHAPES).alias("many"), (F.col("x.times") % SHAPES).alias("shape"))
    pick = lambda xs: F.element_at(F.array(*[F.lit(float(x)) for x in xs]), F.col("shape").cast("int") + 1)
    c = F.col("count")
    looked = rest.join(counts.select("hash", "count"), "hash", "left").groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("many")).otherwise(0)).alias("more_known"),
        F.sum(F.col("many") * F.log10(F.coalesce(c, F.lit(0)) + 1)).alias("more_base"),
        F.sum(F.col("many") * (pick(vocab.log_share) + F.log10(F.coalesce(c, F.lit(1))))).alias("more"),
    )
    out = made.join(looked, "row", "left")
    zero = lambda x: F.coalesce(x, F.lit(0))
    return out.select(
        "doc_id", F.coalesce(F.col("fold") == held, F.lit(False)).alias("held_out"), "n_tokens",
        (F.col("known") + zero(F.col("more_known"))).alias("n_known"), F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("base") + zero(F.col("more_base")) - F.col("n_tokens") * float(np.log10(vocab.total + vocab.distinct + 1))).alias("base_score"),
        (F.col("flat") + zero(F.col("more"))).alias("score"),
    )
