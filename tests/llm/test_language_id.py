import zlib

import numpy as np
import pytest

from conftest import CHECKED
from logmill.llm import language_id as lid
from odd import TEXTS, documents, folder


def test_held_out_accuracy(spark):
    lang = spark.read.parquet(f"{CHECKED}/documents.parquet").select("doc_id", "lang")
    found = lid.op1_language_id(spark, CHECKED).join(lang, "doc_id").collect()
    assert len(found) == lang.count()
    for row in found:
        assert row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 4 == 2)
        assert 0 <= row["score"] <= 1
    for held in (True, False):
        part = [r["lang"] == r["lang_pred"] for r in found if r["held_out"] == held]
        assert sum(part) / len(part) > 0.98


def test_only_the_text_tells(spark):
    docs = spark.read.parquet(f"{CHECKED}/documents.parquet")
    model = lid.train(docs.filter(~lid.held_out(docs["doc_id"])))
    changed = docs.selectExpr("-doc_id AS doc_id", "text", "'xx' AS lang", "'yy' AS source")
    as_is, other = ({r["text"]: r["lang_pred"] for r in lid.predict(d, model, ["text"]).collect()} for d in (docs, changed))
    assert as_is == other


def test_odd_rows(spark, tmp_path):
    found = lid.op1_language_id(spark, folder(tmp_path, documents=documents(spark, clashing=True))).collect()
    assert len(found) == len(TEXTS)
    by_id = {r["doc_id"]: r for r in found}
    for doc_id in (2, 3, 4, -4):
        assert (by_id[doc_id]["lang_pred"], by_id[doc_id]["score"], by_id[doc_id]["ambiguous"]) == ("und", 0.0, False)
    assert by_id[5]["lang_pred"] in {"en", "de", "fr"} and by_id[None]["held_out"] is False


def test_nothing_to_learn_from(spark, tmp_path):
    rows = [(1, "some text", None, None, None), (2, None, "en", None, None), (3, "...", "en", None, None)]
    found = lid.op1_language_id(spark, folder(tmp_path, documents=documents(spark, rows))).collect()
    assert {(r["lang_pred"], r["score"]) for r in found} == {("und", 0.0)}
    assert lid.op1_language_id(spark, folder(tmp_path / "e", documents=documents(spark, []))).collect() == []


def test_one_language_and_two(spark):
    rows = [(i, "some words here", "en", None, None) for i in range(3)]
    model = lid.train(documents(spark, rows))
    assert [r["lang_pred"] for r in lid.predict(documents(spark, rows), model, ["doc_id"]).collect()] == ["en"] * 3
    rows += [(i, "ganz andere Wörter", "de", None, None) for i in range(3, 6)]
    model = lid.train(documents(spark, rows))
    assert [r["lang_pred"] for r in lid.predict(documents(spark, rows), model, ["doc_id"]).collect()] == ["en"] * 3 + ["de"] * 3


def test_a_wrong_bit_is_corrected():
    code = lid.codewords(4)
    model = lid.LanguageModel(list("abcd"), code, np.eye(7), np.zeros(7), np.ones(7) / 7, 6.0)
    for word, bits in enumerate(code):
        for wrong in range(7):
            told = bits.copy()
            told[wrong] *= -1
            assert model.shares(told[None])[0].argmax() == word


def test_a_text_between_two_codewords_is_ambiguous(spark):
    rows = [(1, "aaa aaa", "x", None, None), (2, "bbb bbb", "y", None, None)]
    model = lid.train(documents(spark, rows))
    found = lid.predict(documents(spark, [*rows, (3, "aaa bbb", None, None, None)]), model, ["doc_id"]).collect()
    assert [r["ambiguous"] for r in found] == [False, False, True]


@pytest.mark.parametrize("languages", range(1, 41))
def test_codewords_differ(languages):
    code = lid.codewords(languages)
    assert len({tuple(row) for row in code}) == len(code) == languages
    if languages > 2:
        assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= 2


def test_features_do_not_depend_on_slices(monkeypatch):
    text = "Wörter und mehr, words and more. " * 40
    whole = lid.features(text)
    monkeypatch.setattr(lid, "_SLICE", 17)
    assert (lid.features(text) == whole).all()


def test_the_sample_is_bounded_and_even(spark, monkeypatch):
    monkeypatch.setattr(lid, "SAMPLE_ROWS", 40)
    seen = []
    monkeypatch.setattr(lid, "fit", lambda rows, labels: seen.extend(labels))
    lid.train(spark.read.parquet(f"{CHECKED}/documents.parquet"))
    assert len(seen) <= 40 and all(seen.count(x) <= 10 for x in seen) and len(set(seen)) == 4


def test_signs_that_are_no_letters(spark):
    rows = [(k, f"some words of number {k}", "en", None, None) for k in range(9)] + [(k, f"des mots et {k}", "fr", None, None) for k in range(9, 19)]
    model = lid.train(documents(spark, rows))
    odd = ["½ ②", "² ① Ⅷ", "①", "_9_", "ª", "中"]
    found = lid.predict(documents(spark, [(k, t, None, None, None) for k, t in enumerate(odd)]), model, ["doc_id"]).collect()
    told = {odd[r["doc_id"]]: r["lang_pred"] for r in found}
    assert [t for t in odd if told[t] == "und"] == odd[:4]


def test_the_model_does_not_depend_on_ids_or_copies(spark):
    docs = spark.read.parquet(f"{CHECKED}/documents.parquet")
    one = lid.train(docs)
    other = lid.train(docs.selectExpr("doc_id * 7 - 5 AS doc_id", "text", "lang", "'z' AS source").repartition(5))
    copies = lid.train(docs.unionByName(docs.filter("doc_id < 40")).unionByName(docs.filter("doc_id < 40")))
    for model in (other, copies):
        assert model.languages == one.languages and np.array_equal(model.weights, one.weights)


def test_decoding_by_plain_loops(spark):
    docs = spark.read.parquet(f"{CHECKED}/documents.parquet").limit(200)
    model = lid.train(docs)
    for row in lid.predict(docs, model, ["text"]).collect():
        if row["lang_pred"] == "und":
            continue
        grams = lid.features(row["text"])
        losses = []
        for word in model.code:
            loss = 0.0
            for bit, want in enumerate(word):
                margin = float(grams @ model.weights[:, bit] + model.offsets[bit])
                loss += model.bit_weights[bit] * max(0.0, 1 - want * min(1.5, max(-1.5, margin)))
            losses.append(loss)
        near = [np.exp(-model.sharpness * (loss - min(losses))) for loss in losses]
        best = min(range(len(losses)), key=lambda k: (losses[k], k))
        assert row["lang_pred"] == model.languages[best]
        assert row["score"] == pytest.approx(near[best] / sum(near), abs=1e-6)
