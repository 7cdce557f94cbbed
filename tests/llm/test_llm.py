"""Each operator against a plain form of itself on small tables, and on the odd cases that its docstring defines."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import (
    chunk_dedup,
    common,
    decontamination,
    fingerprints,
    graph,
    language_id,
    line_dedup,
    lm_score,
    mixing,
    near_dedup,
    token_rollup,
    warc,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def words(n, seed, size=4000):
    draw = random.Random(seed)
    return [f"w{draw.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Texts with copies, near copies, shared passages, and the odd cases."""
    rows, n = [], 0

    def add(text, lang="en", source="a"):
        nonlocal n
        rows.append((n, text, lang, source, len(text or "")))
        n += 1

    shared = "\n".join(" ".join(words(12, f"s{i}")) for i in range(6))
    for i in range(30):
        add("\n".join(" ".join(words(15, f"{i}-{k}")) for k in range(8)), source="a" if i % 3 else "b")
    for i in range(0, 12, 3):
        add(rows[i][1], source="c")  # exact copies
    for i in range(1, 12, 3):
        t = rows[i][1].split(" ")
        t[5] = "changed"
        add(" ".join(t), source="c")  # near copies
    for i in range(4):
        add(" ".join(words(40, f"x{i}")) + "\n" + shared + "\n" + " ".join(words(40, f"y{i}")), source=None)
    add("")
    add(None)
    add("one")
    add("12 34 !!")
    add(" ".join(words(20000, "long")))
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(3).cache()


def odd(spark):
    """Nulls in every column, repeated rows, one id twice."""
    rows = [(1, None, None, None, None), (None, "a b c d e f", "en", "a", 3), (None, "a b c d e f", "en", "a", 3), (2, "x y", None, "b", 3), (2, "x y z", "fr", "b", 5), (3, "", "fr", None, 0), (3, "", "fr", None, 0)]
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    """The table with columns named as an operator's own are."""
    for c in ("row", "d", "k", "i", "h", "n", "size", "target", "order", "block", "node", "label", "f", "x", "p"):
        df = df.withColumn(c, F.lit("own"))
    return df


# 1


def test_patience_is_an_alignment():
    draw = random.Random(3)
    for _ in range(200):
        a = {i: draw.randrange(12) for i in range(draw.randrange(1, 15))}
        b = {i: draw.randrange(12) for i in range(draw.randrange(1, 15))}
        pairs = line_dedup.patience(a, b)
        assert all(a[x] == b[y] for x, y in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    same = {i: i for i in range(20)}
    assert line_dedup.patience(same, dict(same)) == [(i, i) for i in range(20)]


def plain_line_dedup(rows):
    """Every document aligned with every earlier one, over all that they share, and with the first holders of its seeds
    over what they are the first to have; what stays of each text."""
    rows = sorted((i, t) for i, t in rows if t)
    seeds = {i: line_dedup.seeds_of(t) for i, t in rows}
    holders = defaultdict(list)
    for i, _ in rows:
        for h in seeds[i]:
            holders[h].append(i)
    out = {}
    for i, t in rows:
        gone = set()
        earlier_ones = [e for e in seeds if e < i]
        sets = [(e, [h for h in seeds[i] if h in seeds[e]]) for e in earlier_ones]
        sets += [(e, [h for h in seeds[i] if holders[h][0] == e]) for e in earlier_ones]
        for e, shared in sets:
            later, earlier = ({p: h for h in shared for p in seeds[k][h][2]} for k in (i, e))
            for p in line_dedup.aligned_places(later, earlier):
                before, after, _ = seeds[i][later[p]]
                gone.update(range(p - before, p + after + 1))
        lines, kept, run = t.split("\n"), [], []
        for k, line in enumerate([*lines, None]):
            if k in gone:
                run.append(line)
                continue
            if len(" ".join(run).split()) < line_dedup.BLOCK_WORDS:
                kept += run
            run = []
            if line is not None:
                kept.append(line)
        out[i] = kept
    return out


@pytest.mark.parametrize("rare", [100, 1])
def test_line_dedup(docs, corpus, rare):
    want = plain_line_dedup([(i, t) for i, t, *_ in corpus])
    out = {r.row.doc_id: r for r in line_dedup.dedup(docs, rare=rare).collect()}
    assert len(out) == len(corpus)
    for i, t, *_ in corpus:
        assert out[i].text == ("\n".join(want[i]) if t else t)
        assert out[i].n_removed == (len(t.split("\n")) - len(want[i]) if t else 0)
    assert out[30].partners == [0] and sum(r.n_removed > 0 for r in out.values()) > 10


def test_turned_copies_and_short_lines(spark):
    x, y = ([" ".join(words(7, f"{c}{i}")) for i in range(3)] for c in "xy")
    verse = "\n".join(f"a{i} b" for i in range(40))
    rows = [(1, "\n".join(y + x)), (2, "\n".join(x + y)), (3, "\n".join(x + y)), (4, "zz\n\n" + "\n\n".join(y + x) + "\nend"), (5, "\n\n".join(y + x) + "\nend"), (6, verse), (7, "own line of text\n" + verse)]
    out = {r.doc_id: r.text for r in line_dedup.dedup_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1] == rows[0][1] and out[3] == "" and out[5] == "" and out[6] == verse and out[7] == "own line of text"


def test_moved_blocks_find_the_document_that_has_them_in_order(spark):
    x, y = ("\n".join(" ".join(words(7, f"{c}{i}")) for i in range(3)) for c in "xy")
    rows = list(enumerate([f"{y}\n{x}", f"{x}\n{y}", f"{y}\n{x}", f"{x}\n{y}"], 1))
    out = {r.doc_id: r for r in line_dedup.dedup_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].n_removed == 0 and out[2].n_removed == 3
    assert (out[3].text, out[4].text) == ("", "") and 2 in out[4].partners


@pytest.mark.parametrize("rare", [100, 1])
def test_permuted_blocks_against_all_pairs(spark, rare):
    """Blocks in any order between lines of one's own: as if all pairs had been aligned, however few are tried a round."""
    draw = random.Random(8)
    blocks = ["\n".join(" ".join(words(5, f"block{b}.{i}")) for i in range(2 + b % 3)) for b in range(5)]
    rows = []
    for i in range(60):
        parts = draw.sample(blocks[:3], 3) if i < 30 else draw.sample(blocks, draw.randrange(1, 6))
        rows.append((i, "\n".join(y for x in parts for y in ((x, f"own line {i} {draw.random()}") if draw.random() < 0.3 else (x,)))))
    want = plain_line_dedup(rows)
    out = {r.row.doc_id: r for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), rare=rare).collect()}
    assert {i: out[i].text for i, _ in rows} == {i: "\n".join(want[i]) for i, _ in rows}
    assert 30 < sum(r.n_removed > 0 for r in out.values()) < 60


def test_many_partners_of_a_long_document(spark):
    """A line from each of 3,000 documents: as many pairs, each of one seed."""
    lines = [" ".join(words(6, f"one{i}")) for i in range(3000)]
    rows = [(i, x) for i, x in enumerate(lines)] + [(5000, "\n".join(lines)), (5001, "\n".join(lines[::-1]))]
    out = line_dedup.dedup_report(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id >= 5000").collect()
    assert [r.text for r in out] == ["", ""]


def test_repeated_passages_align():
    once, twice = {0: 1, 1: 2}, {0: 1, 1: 2, 5: 1, 6: 2}
    assert line_dedup.aligned_places(twice, once) == [0, 1, 5, 6]
    assert line_dedup.aligned_places(once, twice) == [0, 1]
    assert line_dedup.aligned_places({**twice, 3: 9}, {7: 9, **twice}) == [0, 1, 3, 5, 6]
    draw = random.Random(4)
    for _ in range(200):
        a, b = ({i: draw.randrange(6) for i in range(draw.randrange(1, 15))} for _ in range(2))
        pairs = [(-1, -1), *line_dedup.patience(a, b), (99, 99)]
        for (x, y), (u, v) in zip(pairs, pairs[1:], strict=False):
            assert not {a[k] for k in a if x < k < u} & {b[k] for k in b if y < k < v}


def test_line_dedup_of_repeated_passages(spark):
    p = [" ".join(words(7, f"p{i}")) for i in range(2)]
    own = [" ".join(words(7, f"own{i}")) for i in range(4)]
    rows = [(1, "\n".join([*p, own[0], *p])), (2, "\n".join([*p, own[1]])), (3, "\n".join([*p, own[2], *p, own[3]]))]
    out = {r.doc_id: r.text for r in line_dedup.dedup_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: rows[0][1], 2: own[1], 3: "\n".join(own[2:])}


def test_line_dedup_odd(spark):
    out = line_dedup.deduplicated(clashing(odd(spark)))
    assert out.count() == 7 and out.columns == clashing(odd(spark)).columns
    assert line_dedup.dedup_report(odd(spark).limit(0)).count() == 0


# 2


def plain_mix(rows):
    """Targets by filling up; copies in the order that the operator defines."""
    size = {}
    for _, t, _, s, _ in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    total, capped = sum(size.values()), set()
    while True:
        rest = total - sum(3 * size[s] for s in capped)
        open_ = sum(weight[s] for s in order if s not in capped)
        target = {s: 3 * size[s] if s in capped else rest * weight[s] / open_ for s in order}
        over = {s for s in order if target[s] > 3 * size[s] + 1e-9}
        if not over - capped:
            return size, target
        capped |= over


def plain_taken(rows):
    """Copies of all documents in one sorted list, cut at the budget."""
    size, target = plain_mix(rows)
    place = lambda i, t: int(hashlib.md5(f"{'' if i is None else i}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()[:15], 16)
    copies = []
    for s in size:
        upto = 0
        for p, i, n in sorted((place(i, t), i, len((t or "").split())) for i, t, _, of, _ in rows if of == s):
            upto += n
            copies += [((e * size[s] + upto) / target[s], p, i, n) for e in range(3)] if n else []
    taken, running = defaultdict(int), 0
    for _, _, i, n in sorted(copies):
        running += n
        if running > sum(size.values()):
            break
        taken[i] += n
    return size, target, taken


def test_mixing(docs, corpus, spark):
    out = {r.doc_id: r for r in mixing.mix_digest(docs).collect()}
    size, target, taken = plain_taken(corpus)
    assert len(out) == len(corpus)
    for i, t, _, s, _ in corpus:
        n = len((t or "").split())
        assert (out[i].size, out[i].source_size, out[i].taken) == (n, size[s], taken[i]) and out[i].target == pytest.approx(target[s])
    again = {r.doc_id: r.taken for r in mixing.mix_digest(docs.repartition(5)).collect()}
    assert again == {i: r.taken for i, r in out.items()}
    assert {r.row.doc_id: r.taken for r in mixing.mix(docs).collect()} == again
    both = mixing.mix_digest(docs.union(docs))
    assert both.count() == 2 * len(corpus) and both.groupBy("doc_id").agg(F.count_distinct("taken").alias("n")).where("n > 1").count() == 0


@pytest.mark.parametrize("rows", [7, 50])
def test_mixing_over_blocks_and_ranges(docs, monkeypatch, rows):
    whole = {r.doc_id: r.taken for r in mixing.mix_digest(docs).collect()}
    monkeypatch.setattr(mixing, "RANGE_ROWS", rows)
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 100 * rows)
    assert {r.doc_id: r.taken for r in mixing.mix_digest(docs).collect()} == whole


@pytest.mark.parametrize("name", ["op2_mixing", "op5_warc_revisits"])
def test_matches_oracle(spark, name):
    from compare import connect, same

    from loomgraph.llm import queries

    assert not same(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLE_SQL[name])


def test_mixing_is_in_proportion(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), "en", f"s{0 if i % 2 else i % 10}", 0) for i in range(6000)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix_digest(df).join(df.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r.t - r.g) <= 30 for r in got)


def test_mixing_odd(spark):
    out = mixing.mix(clashing(odd(spark)))
    assert out.count() == 7
    assert mixing.mix(odd(spark).limit(0)).count() == 0
    assert mixing.mixed(odd(spark)).columns[-1] == "n_copies"


# 3


def test_tokens_are_words(monkeypatch):
    import numpy as np

    draw = random.Random(11)
    texts = ["", " ", "one", "A b. C,\n\td ", "é É x", "w" * 70_000 + " end", *(" ".join(words(draw.randrange(1, 400), i)) for i in range(20))]
    for size in (1 << 16, 50):
        monkeypatch.setattr(common, "PIECE_BYTES", size)
        seen = {}
        for t in texts:
            own = t.encode().lower().split()
            hashes, shapes = lm_score.tokens(t)
            assert len(hashes) == len(own)
            for w, h, s in zip(own, hashes.tolist(), shapes.tolist(), strict=True):
                n, last = len(w), w[-1:]
                assert s == (n > 8 if last == b"." else 2 + (n > 8) if last == b"," else 4 + (n > 5) + (n > 8) + (n > 11))
                assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)
    assert np.array_equal(lm_score.tokens("x y")[0][1:], lm_score.tokens("y")[0])


def test_base_score_and_counts(docs, corpus):
    out = {r.doc_id: r for r in lm_score.score(docs, settings=lm_score.Settings(head=64, known=200, in_class=16)).collect()}
    tokens = lambda t: [*(t or "").lower().split(), "\n"]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(w for i, t, *_ in corpus if not held(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    for i, t, *_ in corpus:
        r, own = out[i], tokens(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(own), sum(count[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own))
        assert r.score < 0


def test_probabilities_add_up(docs):
    settings = lm_score.Settings(head=50, known=100, in_class=8)
    counts = docs.sparkSession.createDataFrame(lm_score.count_words(docs.limit(20)).collect())
    vocab = lm_score.vocabulary(counts, settings)
    net = lm_score.Network(vocab, settings)
    import numpy as np

    state = np.ones((1, settings.hidden), np.float32)
    everything = np.arange(net.n + lm_score.SHAPES)
    p = np.exp(net.log_probability(np.repeat(state, len(everything), 0), everything))
    assert p.sum() == pytest.approx(1, abs=1e-4)
    places = [np.random.default_rng(i).integers(0, net.n, 5 + 40 * i) for i in range(4)]
    together, alone = net.score(places), [net.score([p])[0] for p in places]
    assert together == pytest.approx(alone, rel=1e-4)


def test_gradient_learns():
    import numpy as np

    settings = lm_score.Settings(head=20, known=20, in_class=5, streams=4)
    end = lm_score.word_hash(lm_score.END)
    vocab = lm_score.Vocabulary({end: 0} | {k: k for k in range(1, 20)}, {end: 1} | {k: 10 for k in range(1, 20)}, np.full(8, -2.0), 200, 20)
    net = lm_score.Network(vocab, settings)
    text = np.tile(np.arange(1, 20), 400)
    before = net.score([text[:190]])[0]
    net.train(text)
    assert net.score([text[:190]])[0] > before / 3


def test_gradient_is_the_slope(monkeypatch):
    """Against differences of the loss, for some weights of each kind; without Adagrad's steps."""
    import numpy as np

    settings = lm_score.Settings(head=12, known=12, in_class=4, embedding=3, hidden=4, window=6, streams=2, rate=1e-3)
    end = lm_score.word_hash(lm_score.END)
    vocab = lm_score.Vocabulary({end: 0} | {k: k for k in range(1, 12)}, {end: 1} | {k: 5 for k in range(1, 12)}, np.full(8, -2.0), 200, 12)
    stream = np.random.default_rng(3).integers(1, 20, 7)
    start = lm_score.Network(vocab, settings).flat.astype(np.float64)

    def loss(flat):
        net = lm_score.Network(vocab, settings, flat)
        h, total = np.zeros((1, 4), np.float32), 0.0
        for t in range(6):
            h, _ = net.step(net.E[stream[t : t + 1]] @ net.Wx + net.b, h)
            total -= float(net.log_probability(h, stream[t + 1 : t + 2])[0])
        return total

    net = lm_score.Network(vocab, settings)
    net.past = np.full_like(net.flat, 1e12)  # a step is the gradient over 1e6, nearly
    net.s = lm_score.Settings(**{**settings.__dict__, "rate": 1e6})
    net.train(stream)
    slope = start - net.flat
    for name, part in net._parts(np.arange(len(start), dtype=np.float32)).items():
        for k in part.reshape(-1)[:: max(1, part.size // 6)].astype(int):
            up, down = start.copy(), start.copy()
            up[k], down[k] = up[k] + 0.02, down[k] - 0.02
            assert slope[k] == pytest.approx((loss(up) - loss(down)) / 0.04, abs=0.02, rel=0.05), name


def test_scores_tell_texts_apart(spark):
    """Held-out texts beat the base score, training ones score higher, gibberish is the least likely."""
    draw = random.Random(7)
    chain = {w: [draw.randrange(60) for _ in range(3)] for w in range(60)}

    def text():
        w, out = draw.randrange(60), []
        for _ in range(80):
            out.append(f"word{w}")
            w = draw.choice(chain[w])
        return " ".join(out)

    rows = [(i, text()) for i in range(1500)]
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2]
    junk = {i: " ".join("".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(80)) for i in held[:20]}
    df = spark.createDataFrame([(i, junk.get(i, t)) for i, t in rows], "doc_id long, text string")
    out = lm_score.score(df, settings=lm_score.Settings(head=64, known=100, in_class=16, streams=8, rounds=2)).collect()
    mean = lambda rs: sum(r.score for r in rs) / sum(r.n_tokens for r in rs)
    real = [r for r in out if r.held_out and r.doc_id not in junk]
    assert sum(r.score > r.base_score for r in real) > 0.95 * len(real)
    assert mean([r for r in out if r.doc_id in junk]) < mean(real) - 0.5 and mean(real) <= mean([r for r in out if not r.held_out]) + 0.02


def test_all_training_documents_are_learned(spark):
    import numpy as np

    rows = [(i, " ".join(words(i % 4, i, 30))) for i in range(9000)]
    small = lm_score.Settings(head=16, known=32, in_class=8)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fold", F.lit(0))
    vocab = lm_score.vocabulary(spark.createDataFrame(lm_score.count_words(df).collect()), small)
    encoded = lm_score.encode(df, vocab).select(F.col("doc_id").alias("key"), "places")
    flat, learned = lm_score.train(encoded, vocab, small)
    assert learned == sum(len(t.split()) + 1 for _, t in rows) and np.isfinite(flat).all()


def test_each_place_is_learned_once(monkeypatch):
    import numpy as np

    settings = lm_score.Settings(head=20, known=20, in_class=5, streams=4)
    end = lm_score.word_hash(lm_score.END)
    vocab = lm_score.Vocabulary({end: 0} | {k: k for k in range(1, 20)}, {end: 1} | {k: 10 for k in range(1, 20)}, np.full(8, -2.0), 200, 20)
    for n in (1, 2, 7, 9, 60, 301):
        net, seen = lm_score.Network(vocab, settings), []
        step = net.step
        monkeypatch.setattr(net, "step", lambda x, h, step=step, seen=seen: seen.append(len(x)) or step(x, h))
        net.train(np.arange(n) % 20)
        assert sum(seen) == n - 1


def test_scoring_odd(spark):
    small = lm_score.Settings(head=16, known=32, in_class=8)
    out = lm_score.score(odd(spark), settings=small).collect()
    assert len(out) == 7 and all(r.n_tokens >= 1 for r in out)
    assert lm_score.score(odd(spark).limit(0), settings=small).count() == 0


# 4


def test_rollup(spark, tmp_path):
    kind = "kind string, source string, lang string, tokenizer string, n_tokens long, old_tokens long"
    roll = token_rollup.Rollup(spark, str(tmp_path / "r"))
    assert roll.totals().count() == 0
    came = spark.createDataFrame([("insert", "a", "en", "t", 10, None), ("insert", "a", "en", "t", 5, None), ("insert", None, None, "t", None, None)], kind)
    assert roll.commit(came, 0) and not roll.commit(came, 0)
    roll.commit(spark.createDataFrame([("revise", "a", "en", "t", 7, 5), ("delete", None, None, "t", 0, None)], kind), 1)
    assert [tuple(r) for r in roll.totals().collect()] == [("a", "en", "t", 2, 17)]
    roll.commit(came.limit(0), 2)
    broken = tmp_path / "r" / "batch=3"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"half")
    assert roll.totals().count() == 1 and roll.commit(spark.createDataFrame([("delete", "a", "en", "t", 17, None)], kind), 3)
    assert [tuple(r) for r in roll.totals().collect()] == [("a", "en", "t", 1, 0)]


def test_token_report(docs, corpus):
    pytest.importorskip("tiktoken")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in token_rollup.token_report(docs).collect()}
    first, want = {}, defaultdict(lambda: [0, 0])
    codes = {v: token_rollup.load_encoding(token_rollup.TOKENIZERS, v) for v in token_rollup.VERSIONS}
    for i, t, lang, s, _ in corpus:
        if first.setdefault(t or "", i) == i:
            for v, e in codes.items():
                want[s, lang, v][0] += 1
                want[s, lang, v][1] += len(e.encode_ordinary(token_rollup.revised(t or "")))
    assert got == {k: tuple(x) for k, x in want.items() if any(x)}


def test_token_report_odd(spark):
    pytest.importorskip("tiktoken")
    got = token_rollup.token_report(odd(spark)).collect()
    # equal rows are one document that is counted twice; later copies of a text under other ids go
    assert all(r.n_docs >= 0 and r.n_tokens >= 0 for r in got)
    assert token_rollup.token_report(odd(spark).limit(0)).count() == 0


# 5


def test_archives(spark, tmp_path):
    html = ["<p>é</p>\r\n\r\nWARC/1.1\r\n", "b" * 5000, None, "", "<p>é</p>\r\n\r\nWARC/1.1\r\n", "b" * 5000, "c", "b" * 5000]
    rows = [(i, None if i == 6 else f"http://x/{i}\r\nEvil: 1", h) for i, h in enumerate(html)] + [(None, "u", "c"), (3, f"http://x/{3}\r\nEvil: 1", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write_archives(pages, path, records_per_file=3)
    got = sorted(warc.read_archives(spark, path).collect(), key=lambda r: (r.page_id is None, r.page_id))
    assert len(got) == len(rows)
    for r in got:
        body = ("c" if r.page_id is None else html[r.page_id] or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == body
    fate = [(r.page_id, r.record_type, r.refers_to) for r in got]
    assert fate == [(0, "response", None), (1, "response", None), (2, "response", None), (3, "revisit", 2), (3, "revisit", 2), (4, "revisit", 0), (5, "revisit", 1), (6, "response", None), (7, "revisit", 1), (None, "revisit", 6)]
    whole = {r.page_id: bytes(r.payload) for r in warc.with_payloads(warc.read_archives(spark, path)).collect()}
    assert whole == {i: ("c" if i is None else html[i] or "").encode() for i in [*range(8), None]}
    warc.write_archives(pages, path, least_bytes=100)
    assert Counter(r.record_type for r in warc.read_archives(spark, path).collect()) == {"response": 8, "revisit": 2}


def test_archives_of_long_pages(spark, tmp_path):
    page = "é<p>" * 700_000
    pages = spark.createDataFrame([(1, "u", page), (2, "v", page)], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"))
    got = {r.page_id: (r.payload_bytes, r.record_type) for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert got == {1: (len(page.encode()), "response"), 2: (len(page.encode()), "revisit")}


def test_archives_empty(spark):
    assert warc.archive_report(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# 6


def test_cuts_shift_with_insertions():
    import numpy as np

    text = " ".join(words(600, "cdc"))
    for at in (0, 700, 2000):
        changed = text[:at] + " inserted words " + text[at:]
        a = {x[2] for x in chunk_dedup.chunks(text)[1:]}
        b = {x[2] for x in chunk_dedup.chunks(changed)[1:]}
        assert len(a & b) > 0.9 * len(a)
    data = np.frombuffer(text.encode(), np.uint8)
    h = 0
    rolled = chunk_dedup.gear_hash(data)
    for i, byte in enumerate(data):
        h = (2 * h + int(chunk_dedup.GEAR[byte])) % (1 << 32)
        assert rolled[i] == h


def plain_chunk_dedup(rows):
    """Removed byte spans: every repeated chunk is grown in place against the first document that has it."""
    rows = sorted((i, (t or "").encode()) for i, t in rows)
    first = {}
    for i, raw in rows:
        for a, _, g in chunk_dedup.chunks(raw.decode()):
            first.setdefault(g, (i, a))
    texts, out = dict(rows), {}
    for i, raw in rows:
        spans = []
        for a, b, g in chunk_dedup.chunks(raw.decode()):
            j, c = first[g]
            if j == i:
                continue
            other, d = texts[j], c + b - a
            assert raw[a:b] == other[c:d]
            while a and c and raw[a - 1] == other[c - 1]:
                a, c = a - 1, c - 1
            while b < len(raw) and d < len(other) and raw[b] == other[d]:
                b, d = b + 1, d + 1
            while raw[a] & 0xC0 == 0x80:
                a += 1
            while b < len(raw) and raw[b] & 0xC0 == 0x80:
                b -= 1
            spans.append((a, b))
        out[i] = [(a, b) for a, b in chunk_dedup.merged(spans) if b - a >= chunk_dedup.SHORTEST or b - a == len(raw)]
    return out


def test_chunk_dedup(docs, corpus):
    out = {r.doc_id: r for r in chunk_dedup.dedup_report(docs).collect()}
    assert len(out) == len(corpus)
    want = plain_chunk_dedup([(i, t) for i, t, *_ in corpus])
    for i, t, *_ in corpus:
        assert [(p.start, p.end) for p in out[i].passages] == want[i]
        assert out[i].removed_bytes == sum(b - a for a, b in want[i]) and len((out[i].text or "").encode()) == len((t or "").encode()) - out[i].removed_bytes
    copies = [i for i, t, *_ in corpus if t and any(u == t and j < i for j, u, *_ in corpus)]
    assert copies and all(out[i].text == "" for i in copies)
    passages = [38, 39, 40, 41]
    assert out[38].removed_bytes == 0 and all(out[i].removed_bytes > 200 and 38 in out[i].repeats_of for i in passages[1:])


def test_passages_are_found_whole(spark):
    """Passages of 55 words, and of a script without blanks, each in two otherwise different documents."""
    draw, rows, want = random.Random(9), [], 0
    for k in range(120):
        if k % 3:
            passage, own = " ".join(words(55, f"p{k}", 90000)), lambda: " ".join(words(60, draw.random(), 90000))
        else:
            passage, own = ("".join(chr(draw.randrange(0x4E00, 0x9000)) for _ in range(120)) for _ in range(2)), None
            passage, own = next(passage), lambda: "".join(chr(draw.randrange(0x4E00, 0x9000)) for _ in range(90))
        rows += [(2 * k, own() + " " + passage + " " + own()), (2 * k + 1, own() + " " + passage + " " + own())]
        want += len(passage.encode())
    out = chunk_dedup.dedup_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.removed_bytes == 0 for r in out if r.doc_id % 2 == 0)
    assert sum(r.removed_bytes > 0 for r in out if r.doc_id % 2) >= 0.98 * 120
    assert 0.98 * want <= sum(r.removed_bytes for r in out) <= 1.02 * want


def test_passages_without_small_hashes(spark):
    """Equal letters, short periods, text without blanks: what two documents share goes whole, whatever stands around."""
    draw = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    shared = {
        "letters": "q" * 3000, "letters and words": "z" * 3000 + " " + " ".join(words(80, "sh")), "words and letters": " ".join(words(80, "hs")) + " " + "y" * 3000,
        "period": "abcdefg" * 700, "long period": "".join(draw.choices(letters, k=45)) * 90, "no blanks": "".join(draw.choices(letters, k=3500)), "dashes": "-=" * 2000,
    }
    rows = []
    for k, passage in enumerate(shared.values()):
        for side in range(2):
            around = [" ".join(words(60 + 7 * side, f"{k}-{side}-{end}")) for end in range(2)]
            rows.append((2 * k + side, f"{around[0]} {passage} {around[1]}"))
    found = {r.doc_id: r for r in chunk_dedup.dedup_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (name, passage) in enumerate(shared.items()):
        assert found[2 * k].removed_bytes == 0, name
        kept = 0 if name == "no blanks" else chunk_dedup.LEAST  # at an end of what repeats itself
        assert len(passage) - kept <= found[2 * k + 1].removed_bytes <= len(passage) + 8, name  # letters around that happen to be equal
        assert passage[100:200] not in found[2 * k + 1].text, name


def test_chunk_dedup_odd(spark):
    out = chunk_dedup.dedup(clashing(odd(spark)))
    assert out.count() == 7 and chunk_dedup.dedup(odd(spark).limit(0)).count() == 0


# 7


def test_edited_report(docs, corpus):
    out = {r.doc_id: r for r in fingerprints.edited_report(docs).collect()}
    make = fingerprints.SimHash()
    for k, (i, t, *_) in enumerate(corpus):
        t, after = t or "", corpus[(k + 1) % len(corpus)][1] or ""
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        assert (out[i].n_chars, out[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (out[i].fingerprint, out[i].edited_fingerprint) == (make(t), make(edited))
        d = bin(int(make(t), 16) ^ int(make(edited), 16)).count("1")
        assert out[i].near_edited == pytest.approx(max(0, math.cos(math.pi * d / 128)), abs=1e-9)
    assert out[30].fingerprint == out[0].fingerprint


def test_radius_search_finds_all(spark):
    draw = random.Random(5)
    base = [draw.getrandbits(128) for _ in range(40)]
    near = [b ^ sum(1 << k for k in draw.sample(range(128), n)) for b in base for n in (1, 2, 3, 4, 6, 7, 8, 11, 13, 14, 15)]
    prints = [f"{x:032x}" for x in {*base, *near}]
    df = spark.createDataFrame([(x,) for x in prints], "print string")
    queries = prints[::3]
    far = {(a, b): bin(int(a, 16) ^ int(b, 16)).count("1") for a in queries for b in prints if a != b}
    for radius in (1, 4, 7, 14):
        got = {(r.query, r.print): r.distance for r in fingerprints.within_radius(spark.createDataFrame([(x,) for x in queries], "print string"), df, radius).collect()}
        assert got == {k: v for k, v in far.items() if v <= radius}


def test_near_copies_are_near(spark, docs, corpus):
    """n_near of queries against all documents, and word prints of texts with a word changed."""
    make = fingerprints.SimHash()
    of = lambda t: make.of(make.words((t or "").lower().split()), 1)
    bits = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
    out = {r.doc_id: r for r in fingerprints.edited_report(docs, query_every=4).collect()}
    prints = {i: of(t) for i, t, *_ in corpus}
    for i, p in prints.items():
        assert out[i].word_print == p
        assert out[i].n_near == (sum(0 < bits(p, q) <= fingerprints.RADIUS for q in set(prints.values())) if i % 4 == 0 else None)
    caught = similar = 0
    draw = random.Random(12)
    shingles = lambda t: {tuple(t[k : k + 5]) for k in range(len(t) - 4)}
    while similar < 300:
        text = words(draw.randrange(50, 600), f"near{draw.random()}", 3000)
        other = list(text)
        for _ in range(draw.randrange(1, 2 + len(text) // 40)):
            other[draw.randrange(len(other))] = f"changed{draw.randrange(1000)}"
        x, y = shingles(text), shingles(other)
        if len(x & y) >= 0.8 * len(x | y):
            similar += 1
            caught += bits(of(" ".join(text)), of(" ".join(other))) <= fingerprints.RADIUS
    assert caught >= 0.95 * similar


def test_edited_report_odd(spark):
    assert fingerprints.edited_report(odd(spark)).count() == 7
    assert fingerprints.edited_report(odd(spark).limit(0)).count() == 0


# 8


def test_language_accuracy(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.identify(table).join(table.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'").collect()
    assert sum(r.lang == r.lang_pred for r in out) > 0.95 * len(out) and all(0 <= r.score <= 1 for r in out)


def test_language_against_plain_kernel(spark):
    """Sets of n-grams, every labelled row a landmark, ridge regression over them in one piece."""
    import numpy as np

    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    grams = lambda t: {t.lower()[i : i + n] for n in (1, 2, 3, 4) for i in range(len(t) - n + 1)}
    sets = {r.doc_id: grams(r.text) for r in rows}
    learn = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and any(map(str.isalpha, r.text))]
    labels = sorted({r.lang for r in learn})
    kernel = lambda a, b: len(a & b) / math.sqrt(max(1, len(a)) * max(1, len(b)))
    gram = np.array([[kernel(sets[a.doc_id], sets[b.doc_id]) for b in learn] for a in learn])
    target = np.array([[float(r.lang == x) for x in labels] for r in learn])
    n = len(learn)
    alpha = np.linalg.solve(gram.T @ gram + 1e-3 * n * gram + 1e-8 * n * np.eye(n), gram.T @ target)
    df = spark.createDataFrame([(r.doc_id, r.text, r.lang) for r in rows], "doc_id long, text string, lang string")
    predict = language_id.predictor(language_id.fit(language_id.training_rows(df), 10**6, 10**6))
    for r in df.select("doc_id", predict("text").alias("p")).select("doc_id", "p.*").collect():
        if r.lang_pred != "und":
            value = np.array([kernel(sets[r.doc_id], sets[b.doc_id]) for b in learn]) @ alpha
            top = np.sort(value)
            assert r.lang_pred == labels[int(value.argmax())] or top[-1] - top[-2] < 0.05
            assert abs(r.score - min(1, max(0, top[-1]))) < 0.05


def test_language_ties_long_and_empty(spark):
    rows = [(1, "aaa", "en", "a", 0), (3, "aaa", "fr", "a", 0), (5, "aaa " * 50000, "fr", "a", 0), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r.lang_pred for r in language_id.identify(df).collect()}
    assert got[1] == got[3] == got[5] == "en" and got[None] == "und"
    assert {r.doc_id for r in language_id.keep_identified(clashing(df)).collect()} <= {1, 3, 5}
    assert language_id.keep_identified(df.limit(0)).count() == 0


def test_language_odd(spark):
    rows = [(1, None, "en", "a", 0), (2, "123 !?", "en", "a", 0), (3, "the cat and the dog", "en", "a", 0), (5, "le chat et le chien", "fr", "a", 0), (None, "the", None, None, None)]
    got = language_id.identify(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (1, 2)} == {1: "und", 2: "und"} and len(got) == 5
    empty = spark.createDataFrame([], DOCS)
    assert language_id.identify(empty).count() == 0
    unlabelled = spark.createDataFrame([(1, "abc", None, None, None)], DOCS)
    assert language_id.identify(unlabelled).first().lang_pred == "und"


# 9


def plain_tiles(a, b, least):
    """Greedy string tiling as it is defined: the longest common run of free words, again and again."""
    used_a, used_b, covered = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used_a and j + n not in used_b:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return covered
        used_a.update(range(i, i + n))
        used_b.update(range(j, j + n))
        covered += n


def test_tiling():
    draw = random.Random(1)
    for _ in range(150):
        a = [draw.choice("abcd") for _ in range(draw.randrange(4, 25))]
        b = [draw.choice("abcd") for _ in range(draw.randrange(4, 25))]
        pairs = [(i, j) for i in range(len(a) - 2) for j in range(len(b) - 2) if a[i : i + 3] == b[j : j + 3]]
        if pairs:
            got, tiles = decontamination.tile([i for i, _ in pairs], [j for _, j in pairs], 3)
            assert got == plain_tiles(a, b, 3) and tiles >= 1


def test_contamination(spark, corpus):
    item = words(40, "bench")
    turned = [*item[20:30], *words(5, "q"), *item[:20], "and", *item[30:]]
    extra = [(100, " ".join([*words(50, "p"), *item, *words(50, "r")]), "en", "a", 0), (101, " ".join(turned).upper() + ".", "en", "a", 0), (102, " ".join(item[:12]), "en", "a", 0), (103, "say one two, now", "en", "a", 0)]
    df = spark.createDataFrame(corpus + extra, DOCS)
    items = spark.createDataFrame([(7, " ".join(item)), (8, "one two"), (9, ""), (10, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.coverage for r in decontamination.leaks(df, items).collect()}
    assert got == {(100, 7): 1.0, (101, 7): 1.0, (103, 8): 1.0}
    found = decontamination.contamination(df, items, most_shared=0)
    assert {(r.i, r.item): r.coverage for r in found.select("d.i", "item", "coverage").collect()} == got
    kept = {r.doc_id for r in decontamination.clean(clashing(df), items).collect()}
    assert kept == {r[0] for r in corpus + extra} - {100, 101, 103}


def test_contamination_odd(spark):
    items = spark.createDataFrame([(1, "a b c d e f"), (None, "x y")], "item_id long, text string")
    got = decontamination.leaks(odd(spark), items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(None, 1), (2, None)}
    assert decontamination.leaks(odd(spark).limit(0), items).count() == 0
    assert decontamination.clean(odd(spark), items.limit(0)).count() == 7


# 10


def bag(text):
    w = text.lower().split()
    n = min(5, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter()


def test_near_classes(docs, corpus):
    got = {r.doc_id: r for r in near_dedup.near_classes(docs).collect()}
    assert len(got) == len(corpus)
    bags = {i: bag(t) for i, t, *_ in corpus if t is not None}
    total = len(bags)
    df = Counter(s for b in bags.values() for s in b)
    weight = lambda s, n: n * (1 + math.log((1 + total) / (1 + df[s])))
    parent = {i: i for i, *_ in corpus}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(bags, 2):
        x, y = ({s: weight(s, n) for s, n in bags[k].items()} for k in (a, b))
        low = sum(min(x[s], y[s]) for s in x.keys() & y.keys())
        rest = sum(x.values()) + sum(y.values()) - low
        if rest and low / rest >= 0.8 or dict(zip([r[0] for r in corpus], [r[1] for r in corpus], strict=True))[a] == corpus[b][1]:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {i: r.class_id for i, r in got.items()} == {i: root(i) for i, *_ in corpus}


def test_shingles_are_of_words():
    shingler = near_dedup.Shingler()
    same = ["A b\u00a0c d e F", "a B c D\x1ce\u3000f", " a b  c\nd e f "]
    assert len({shingler(t)[0].tobytes() for t in same}) == 1
    draw = random.Random(12)
    for k in (1, 4, 5, 6, 300, 20000):
        own = [draw.choice(["é", "x", "yy", "Z"]) for _ in range(k)]
        assert sorted(shingler(" ".join(own))[1].tolist()) == sorted(bag(" ".join(own)).values())


def test_common_passages_alone_do_not_join(spark):
    passage = words(34, "passage")
    rows = [(i, " ".join(words(60, f"far{i}"))) for i in range(400)]
    rows += [(1000 + i, " ".join([*passage, *words(3, f"own{i}", 100000)])) for i in range(15)]
    bags = [bag(t) for _, t in rows]
    df = Counter(s for b in bags for s in b)

    def likeness(least):
        weight = lambda s: 1 + math.log((1 + len(rows)) / (1 + max(df[s], least)))
        return sum(weight(s) for s in bags[-1].keys() & bags[-2].keys()) / sum(weight(s) for s in bags[-1].keys() | bags[-2].keys())

    assert likeness(0.05 * len(rows)) > 0.8 > likeness(0)
    got = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.class_size == 1 for r in got)


def test_archives_read_payloads_twice(spark, tmp_path):
    """Once for all headers, once for the records."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def html(i):
        seen.add(1)
        return f"page {i % 3}"

    pages = spark.range(30).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), html.asNondeterministic()("id").alias("html"))
    warc.write_archives(pages, str(tmp_path / "archives"))
    assert seen.value == 60
    got = {r.page_id: r.refers_to for r in warc.read_archives(spark, str(tmp_path / "archives")).collect()}
    assert got == {i: i % 3 if i > 2 else None for i in range(30)}


def test_near_copies_in_a_group_of_copies(spark):
    base = words(200, "copied")
    edited = [[w if k % 50 != i % 50 else f"edit{i}x{k}" for k, w in enumerate(base)] for i in range(12)]
    far = [[w if k % 20 != i % 20 else f"more{i}x{k}" for k, w in enumerate(base)] for i in range(3)]
    rows = [(i, " ".join(base)) for i in range(150)] + [(200 + i, " ".join(e)) for i, e in enumerate(edited)] + [(300 + i, " ".join(e)) for i, e in enumerate(far)]
    rows += [(1000 + i, " ".join(words(60, f"far{i}"))) for i in range(400)]
    bags = {i: bag(t) for i, t in rows}
    df = Counter(s for b in bags.values() for s in b)

    def likeness(a, b, weight):
        low, high = bags[a] & bags[b], bags[a] | bags[b]
        return sum(n * weight(s) for s, n in low.items()) / sum(n * weight(s) for s, n in high.items())

    idf = lambda s: 1 + math.log((1 + len(rows)) / (1 + df[s]))
    assert all(likeness(0, 200 + i, idf) < 0.8 < likeness(0, 200 + i, lambda s: 1) for i in range(12))
    assert all(likeness(0, 300 + i, lambda s: 1) < 0.8 for i in range(3))
    got = {r.doc_id: (r.class_id, r.class_size) for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, c in got.items() if c == (0, 162)} == {i for i in got if i < 300}
    assert all(c == (i, 1) for i, c in got.items() if i >= 300)


def test_sampling_agrees_with_similarity():
    import numpy as np

    weights = near_dedup.Weights(100)
    shingler = near_dedup.Shingler()
    base = words(3000, "icws", 100000)
    rates = []
    for cut in (2900, 2500, 2000):
        a, b = " ".join(base[:cut]), " ".join(base[3000 - cut :])
        x, y = shingler(a), shingler(b)
        x, y = (x[0], weights(x[1])), (y[0], weights(y[1]))
        true = near_dedup.weighted_jaccard(x, y)
        sampler = near_dedup.Sampler(weights)
        same = np.mean(sampler(*x) == sampler(*y))
        rates.append((true, same))
    assert rates[0][1] > rates[1][1] >= rates[2][1] and rates[0][1] > 0.5


def test_components(spark):
    draw = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(draw.randrange(100, 200), draw.randrange(100, 200)) for _ in range(60)] + [(500, k) for k in range(501, 540)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {x: x for e in edges for x in e}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert got == {x: root(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


def test_near_dedup_odd(spark):
    assert near_dedup.near_classes(odd(spark)).count() == 7
    kept = near_dedup.one_of_each(clashing(odd(spark)))
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in kept.collect() if r.text) == [(False, 2, "x y"), (False, 2, "x y z"), (True, None, "a b c d e f")]
    assert near_dedup.near_classes(odd(spark).limit(0)).count() == 0


# the pipeline


def test_pipeline(spark):
    import corpus_pipeline

    table = spark.read.parquet(f"{SF}/documents.parquet")
    docs = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == table.columns, name
        docs = out.cache()
    final = corpus_pipeline.run(spark, SF)
    assert final.columns == [*table.columns, "n_copies"]
    assert set(r.doc_id for r in final.collect()) <= set(r.doc_id for r in docs.collect())


def test_small_tables_are_few_files(spark, docs):
    import corpus_pipeline
    from pathlib import Path

    from loomgraph.session import shared_dir

    put = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    were = {k: spark.conf.get(k) for k in put}
    folder, enough = Path(shared_dir(spark).removeprefix("file:")), 2 * spark.sparkContext.defaultParallelism
    seen = set(folder.iterdir())
    try:
        for k, v in put.items():
            spark.conf.set(k, v)
        stages = dict(corpus_pipeline.STAGES)
        lines = stages["line_dedup"](spark, docs, SF)
        near = stages["near_dedup"](spark, docs, SF)
        stages["mixing"](spark, docs, SF)
        assert lines.rdd.getNumPartitions() <= enough and near.rdd.getNumPartitions() <= enough + docs.rdd.getNumPartitions()
    finally:
        for k, v in were.items():
            spark.conf.set(k, v)
    files = {p.name: len(list(p.glob("part-*"))) for p in set(folder.iterdir()) - seen}
    assert len(files) > 15
    # the two that are written before the size of the texts is known
    assert not {k: n for k, n in files.items() if n > enough and not k.startswith(("nodes-", "seeds-"))}
    print(len(files), "tables,", sum(files.values()), "files")


def test_pipeline_of_odd_tables(spark):
    import corpus_pipeline

    for table in (clashing(odd(spark)), odd(spark).limit(0)):
        docs = table
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF).cache()
        assert docs.columns[: len(table.columns)] == table.columns and docs.count() <= 7
