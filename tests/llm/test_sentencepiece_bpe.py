import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from logmill.llm import sentencepiece_bpe as bpe
from odd import CLASHING, LONG, TEXTS, documents, folder

MODEL = public_tokenizers.path(bpe.MODEL)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
ODD = " ▁\n\tabethingofABé日本😀\x00　<s>0x().,;'\"$%²Ⅷ_"


def ids_of(text):
    return np.frombuffer(bpe.load_model(MODEL).encode([text])[0], "<i4").tolist()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(ODD), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_text_is_encoded_and_decoded_as_by_the_library(text):
    assert ids_of(text) == LIBRARY.encode(text)
    assert bpe.load_model(MODEL).decode(ids_of(text)) == LIBRARY.decode(LIBRARY.encode(text))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 258), st.integers(0, 31999), st.just(28705)), max_size=12))
def test_any_ids_are_decoded_as_by_the_library(ids):
    assert bpe.load_model(MODEL).decode(ids) == LIBRARY.decode(ids)


@pytest.mark.parametrize("text", ["a" * 5000, " " * 999, "the" * 400, "日" * 300, "(" * 77, "x" + " " * 40 + "y"])
def test_long_chunks_go_by_the_heap(text):
    assert ids_of(text) == LIBRARY.encode(text)


def test_a_full_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    model = bpe.PieceModel(MODEL)
    for words in ("one two three four five", "six seven eight", "one two nine ten"):
        assert np.frombuffer(model.encode([words])[0], "<i4").tolist() == LIBRARY.encode(words)


def test_odd_rows(spark):
    docs = documents(spark, clashing=True)
    rows = bpe.encode_decode(docs, MODEL, docs.columns).collect()
    assert len(rows) == len(TEXTS) and set(CLASHING) <= set(rows[0].asDict())
    for row in rows:
        text = row["text"] or ""
        assert row["ids"] == LIBRARY.encode(text) and row["decoded"] == LIBRARY.decode(row["ids"])
    assert any(row["text"] == LONG for row in rows)
    assert bpe.encode_decode(documents(spark, []), MODEL, ["doc_id"]).collect() == []


def test_all_documents_agree_with_the_library(spark):
    from conftest import CHECKED

    docs = spark.read.parquet(f"{CHECKED}/documents.parquet")
    assert tuple(bpe.agrees_with_library(docs, MODEL).first()) == (docs.count(), 0)


def test_query(spark, tmp_path):
    found = bpe.op7_sentencepiece(spark, folder(tmp_path, documents=documents(spark)))
    want = []
    for doc_id, text, *_ in TEXTS:
        ids = LIBRARY.encode(text or "")
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), LIBRARY.decode(ids))]
        want.append(str((doc_id, len(ids), *digest)))
    assert sorted(str(tuple(r)) for r in found.collect()) == sorted(want)
