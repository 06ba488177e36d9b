import math
import zlib
from collections import Counter

import numpy as np
import pytest

from conftest import CHECKED
from logmill.llm import class_lm as lm
from odd import TEXTS, documents, folder

END = object()


def tokens(text):
    return [*bytes(text or "", "utf-8").lower().split(), END]


def out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def check_counts(rows, found):
    counts = Counter(t for i, text in rows if not out(i) for t in tokens(text))
    total, types = sum(counts.values()), len(counts)
    want = []
    for i, text in rows:
        own = tokens(text)
        base = sum(math.log10((counts[t] + 1) / (total + types + 1)) for t in own)
        want.append((i, out(i), len(own), sum(counts[t] > 0 for t in own), total, round(base, 5) + 0.0))
    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")
    got = [tuple(r[n] if n != "base_score" else round(r[n], 5) + 0.0 for n in names) for r in found]
    assert sorted(map(str, got)) == sorted(map(str, want))


@pytest.mark.parametrize("known", [lm.KNOWN_WORDS, 30])
def test_odd_rows(spark, tmp_path, monkeypatch, known):
    monkeypatch.setattr(lm, "KNOWN_WORDS", known)
    monkeypatch.setattr(lm, "EXCHANGE_WORDS", 10)
    found = lm.op10_class_lm(spark, folder(tmp_path, documents=documents(spark, clashing=True))).collect()
    check_counts([r[:2] for r in TEXTS], found)
    assert all(r["score"] < 0 and r["perplexity"] > 1 for r in found)


def test_empty_tables(spark, tmp_path):
    assert lm.op10_class_lm(spark, folder(tmp_path / "a", documents=documents(spark, []))).collect() == []
    held = next(i for i in range(100) if out(i))
    rows = [(held, "never seen", None, None, None)]
    found = lm.op10_class_lm(spark, folder(tmp_path / "b", documents=documents(spark, rows))).collect()
    check_counts([r[:2] for r in rows], found)
    assert found[0]["score"] < 0


def test_all_documents(spark, monkeypatch):
    # Few known words, so that the rest is looked up in a join.
    monkeypatch.setattr(lm, "KNOWN_WORDS", 3000)
    found = lm.op10_class_lm(spark, CHECKED).collect()
    rows = spark.read.parquet(f"{CHECKED}/documents.parquet").select("doc_id", "text").collect()
    check_counts([tuple(r) for r in rows], found)
    for held in (True, False):
        part = [r for r in found if r["held_out"] == held]
        assert sum(r["score"] for r in part) > sum(r["base_score"] for r in part)


def small_model(spark, monkeypatch):
    monkeypatch.setattr(lm, "EXCHANGE_WORDS", 12)
    monkeypatch.setattr(lm, "CLASSES", 4)
    docs = spark.read.parquet(f"{CHECKED}/documents.parquet").orderBy("doc_id").limit(60)
    return docs, *lm.train(docs)


def test_score_by_brute_force(spark, monkeypatch):
    docs, model, counts = small_model(spark, monkeypatch)
    known = {bytes(r["word"]): r["n"] for r in counts.collect() if r["shape"] < lm.SHAPES}
    head = {w: i for w, i in model.known.words.items() if i < 12}
    own = lambda t: lm.CLASSES + lm.SHAPES if t is END else int(model.classes[head[t]]) if t in head else lm.CLASSES + lm.shape(t)
    matrix, size = model.matrix, len(model.matrix)
    pairs = Counter()
    texts = [r["text"] for r in docs.collect()]
    for text in texts:
        line = [END, *tokens(text)]
        pairs.update((own(a), own(b)) for a, b in zip(line, line[1:]))
    assert {(a, b): n for a, b in pairs for n in [matrix[a, b]]} == dict(pairs) and matrix.sum() == sum(pairs.values())
    of_class, rest = Counter(), Counter()
    for word, n in known.items():
        (of_class if word in head else rest)[own(word)] += n
    types = Counter(own(w) for w in known if w not in head)
    share = (matrix.sum(0) + 1) / (matrix.sum() + size)

    def emission(t):
        if t is END:
            return 1.0
        return known[t] / of_class[own(t)] if t in head else (known.get(t, 0) + 1) / (rest[own(t)] + types[own(t)] + 1)

    probe = documents(spark, [(1, f"{texts[0]} unseen-word 77", None, None, None)])
    line = [END, *tokens(f"{texts[0]} unseen-word 77")]
    want = 0.0
    for a, b in zip(line, line[1:]):
        step = (matrix[own(a), own(b)] + lm.PRIOR * share[own(b)]) / (matrix[own(a)].sum() + lm.PRIOR)
        want += math.log10(step * emission(b))
    row = lm.score(probe, model, counts, ["doc_id"]).first()
    assert row["score"] == pytest.approx(want) and row["perplexity"] == pytest.approx(10 ** (-want / len(line[1:])))


def test_probabilities_sum_to_one(spark, monkeypatch):
    _, model, counts = small_model(spark, monkeypatch)
    tables = model.tables()
    assert (10 ** tables["steps"]).sum(axis=1) == pytest.approx(1)
    known = model.known
    classes = model.classes[: known.exchanged]
    emitted = np.bincount(classes, 10 ** tables["emission"][: known.exchanged], minlength=lm.CLASSES)
    assert emitted[np.unique(classes)] == pytest.approx(1)
    for shape in range(lm.SHAPES):
        words = [r for r in counts.filter(f"shape = {shape}").collect() if known.words[bytes(r["word"])] >= known.exchanged]
        seen = sum(r["n"] + 1 for r in words)
        assert (seen + 1) * 10 ** tables["emission"][len(known.words) + shape] == pytest.approx(1)


def test_exchange_raises_the_likelihood(spark, monkeypatch):
    docs, model, _ = small_model(spark, monkeypatch)
    pairs = lm.pair_counts(docs, model.known)
    start = np.concatenate([np.arange(12) % lm.CLASSES, lm.CLASSES + np.arange(lm.SHAPES + 1)])
    before, after = lm.class_matrix(pairs, start), lm.class_matrix(pairs, model.classes)
    assert lm.likelihood(after) > lm.likelihood(before) and (after == model.matrix).all()


def test_gain_of_a_move_is_the_rise_of_the_likelihood(monkeypatch):
    monkeypatch.setattr(lm, "CLASSES", 3)
    draw = np.random.default_rng(5)
    size, units = lm.CLASSES + lm.SHAPES + 1, 8
    counts = draw.integers(0, 9, (units, units)).astype(float)
    classes = draw.integers(0, 3, units)

    def matrix(classes):
        made = np.zeros((size, size))
        np.add.at(made, (classes[:, None], classes[None]), counts)
        return made

    for word in range(units):
        after, before = np.bincount(classes, counts[word], size), np.bincount(classes, counts[:, word], size)
        best, gain = lm.best_move(matrix(classes), classes[word], after, before, counts[word, word])
        rises = []
        for new in range(3):
            moved = classes.copy()
            moved[word] = new
            rises.append(lm.likelihood(matrix(moved)) - lm.likelihood(matrix(classes)))
        assert gain == pytest.approx(max(rises), abs=1e-8) and rises[best] == pytest.approx(max(rises), abs=1e-8)


def test_gains_of_many_words_are_those_of_one(monkeypatch):
    draw = np.random.default_rng(6)
    units, learnt = 40, 5
    size = learnt + lm.SHAPES + 1
    counts = draw.integers(0, 12, (units, units)) * draw.integers(0, 2, (units, units))
    classes = draw.integers(0, learnt, units)
    matrix = np.zeros((size, size))
    np.add.at(matrix, (classes[:, None], classes[None]), counts)
    after = np.array([np.bincount(classes, counts[w], size) for w in range(units)])
    before = np.array([np.bincount(classes, counts[:, w], size) for w in range(units)])
    own = counts.diagonal().astype(float)
    best, gain = lm.Gains(matrix).best(classes, after, before, own)
    want = [lm.best_move(matrix, classes[w], after[w], before[w], own[w]) for w in range(units)]
    assert gain == pytest.approx([g for _, g in want], abs=1e-8) and list(best) == [c for c, _ in want]


def test_all_words_seen_twice_are_clustered(spark, monkeypatch):
    # 3000 such words, more than are known, so that most are numbered by a join.
    monkeypatch.setattr(lm, "KNOWN_WORDS", 500)
    words = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(words[i::10] + [f"once{i}"]), None, None, None) for i in range(10)] * 2
    docs = documents(spark, [(i, r[1].replace("once", f"o{i}x"), None, None, None) for i, r in enumerate(rows)])
    model, counts = lm.train(docs)
    assert len(model.known.words) == 500 and model.known.exchanged == 3000
    learnt = len(model.matrix) - lm.SHAPES - 1
    assert learnt == lm.class_count(3000) > lm.class_count(1000) == 64
    # Tokens within learnt classes: all but the 20 words seen once and the ends.
    assert model.matrix[:, :learnt].sum() == 6000 and model.known.shape_tokens.sum() == 20
    units = {r["unit"] for r in counts.filter("unit is not null").collect()}
    assert units == set(range(500, 3000))
    found = lm.score(docs, model, counts, ["doc_id"]).collect()
    assert all(r["n_known"] == r["n_tokens"] == 302 for r in found)


def test_pairs_come_in_blocks_not_a_row_each(spark, monkeypatch):
    # Many words in few rows; some known, some met in the join, some without a class of their own.
    monkeypatch.setattr(lm, "KNOWN_WORDS", 20)
    draw = np.random.default_rng(7)
    texts = [" ".join(f"w{k}" for k in draw.zipf(1.4, 300) % 500) for _ in range(20)]
    docs = documents(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])
    known, counts = lm.learn_words(docs)
    pairs = lm.pair_counts(docs, known, counts=counts)
    units = {bytes(r["word"]): r["unit"] for r in counts.filter("unit is not null").collect()} | known.words
    number = lambda t: known.boundary if t is END else units[t] if units.get(t, known.exchanged) < known.exchanged else known.exchanged + int(lm.shape(t))
    want = Counter()
    for text in texts:
        line = [END, *tokens(text)]
        want.update((number(a), number(b)) for a, b in zip(line, line[1:]))
    rows, found, before = pairs.collect(), Counter(), Counter()
    for row in rows:
        word = np.frombuffer(row["word"], "<i4").tolist()
        for names, into in ((("ends", "other", "n"), found), (("ends_before", "before", "n_before"), before)):
            ends, beside = (np.frombuffer(row[c], "<i4") for c in names[:2])
            n = np.frombuffer(row[names[2]], f"<u{len(row[names[2]]) // max(len(beside), 1) or 1}")
            for own, other, k in zip(np.repeat(word, np.diff(ends, prepend=0)).tolist(), beside.tolist(), n.tolist()):
                into[(own, other) if into is found else (other, own)] += k
    assert found == want and before == {p: n for p, n in want.items() if p[1] < known.exchanged}
    assert len(rows) <= lm.BLOCKS < len(want) / 10
