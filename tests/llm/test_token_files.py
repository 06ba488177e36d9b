import json
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logmill.llm import files
from logmill.llm import token_files as tf
from conftest import CHECKED
from odd import TEXTS, documents, folder

FILE = public_tokenizers.path(tf.TOKENIZER)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=50))
def test_round_trip_of_the_coding(ranks):
    control, data = tf.encode_lengths(np.array(ranks, "<u4"))
    assert len(control) == -(-len(ranks) // 4)
    assert tf.decode_lengths(control, data, len(ranks)).tolist() == ranks


def test_known_bytes():
    control, data = tf.encode_lengths(np.array([5, 256, 65536, 1 << 24, 7], "<u4"))
    assert control == bytes([0b11100100, 0]) and data == b"\5\0\1\0\0\1\0\0\0\1\7"


ODD = " \n\tabc'st.,1é日\x1c\x85\xa0  ​²Ⅷʰ_"


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(ODD), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_chunks_are_encoded_as_whole_texts_by_the_library(text):
    encoder = tf.load_encoder(FILE)
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == encoder.library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a <|endoftext|>  b\n\n<|endoftext|>", "<|endoftext|>", "x" * 9000, "\n" * 50])
def test_added_tokens_and_long_chunks(text):
    encoder = tf.load_encoder(FILE)
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == encoder.library.encode(text, add_special_tokens=False).ids


def other_tokenizer(tmp_path, **changes):
    parts = json.loads(open(FILE, encoding="utf-8").read()) | changes
    path = tmp_path / "other.json"
    path.write_text(json.dumps(parts), encoding="utf-8")
    return str(path)


@pytest.mark.parametrize(
    "changes",
    [
        {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}},
        {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}},
        {"normalizer": {"type": "Lowercase"}},
        {"normalizer": {"type": "Replace", "pattern": {"String": " "}, "content": "_"}},
    ],
)
def test_tokenizers_that_split_in_another_way(tmp_path, changes):
    encoder = tf.ChunkEncoder(other_tokenizer(tmp_path, **changes))
    assert not encoder.by_chunks and tf.load_encoder(FILE).by_chunks
    texts = ["The cat sat.  On the MAT, 42 times!", "", " the the", "a\n\nb"]
    want = [encoder.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode(texts)] == want


def test_every_public_tokenizer_file_gives_the_library_s_ids():
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        encoder = tf.ChunkEncoder(public_tokenizers.path(name))
        texts = [t for _, t, *_ in TEXTS if t]
        want = [encoder.library.encode(t, add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode(texts)] == want


def test_all_documents_are_encoded_as_by_the_library(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{CHECKED}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, tf.op8_token_files(spark, CHECKED).collect())) == sorted(expected(rows))


def expected(rows):
    library, start, found = tf.load_encoder(FILE).library, 0, []
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(text or "", add_special_tokens=False).ids + [tf.END_ID]
        found.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return found


@pytest.mark.parametrize("shard, block", [(8_000_000, 1 << 20), (50, 7)])
def test_query_on_odd_rows(spark, tmp_path, monkeypatch, shard, block):
    monkeypatch.setattr(tf, "SHARD_IDS", shard)
    monkeypatch.setattr(tf, "BLOCK_IDS", block)
    rows = [r for r in TEXTS if r[0] is not None]
    got = tf.op8_token_files(spark, folder(tmp_path, documents=documents(spark, rows, clashing=True)))
    assert sorted(map(tuple, got.collect())) == sorted(expected(rows))


def test_missing_ids_come_first(spark, tmp_path):
    got = tf.op8_token_files(spark, folder(tmp_path, documents=documents(spark))).collect()
    missing = [r for r in got if r["doc_id"] is None]
    assert len(got) == len(TEXTS) and sum(r["n_tokens"] for r in missing) == min(
        r["start"] for r in got if r["doc_id"] is not None
    )


def test_empty_table(spark, tmp_path):
    assert tf.op8_token_files(spark, folder(tmp_path, documents=documents(spark, []))).collect() == []


def test_most_frequent_ids_rank_first():
    assert tf.ids_by_rank({3: 5, 1: 5, 2: 9}, 5).tolist() == [2, 1, 3, 0, 4]


def test_files_of_another_attempt_do_not_count(spark, tmp_path):
    docs = documents(spark, TEXTS[:1])
    shards = tf.write_token_files(docs, f"file://{tmp_path}", FILE)
    files.write_bytes(f"file://{tmp_path}", "shard-000000", b"left over")
    assert tf.read_token_files(shards).count() == 1


def test_other_files_are_refused(tmp_path):
    path = files.write_bytes(f"file://{tmp_path}", "x", b"0" * 64)
    with files.open_input(path) as stream, pytest.raises(ValueError, match="not a token file"):
        list(tf.read_blocks(stream))


def test_a_call_that_fails_leaves_no_chunk_without_ids(monkeypatch):
    encoder = tf.ChunkEncoder(FILE)
    encoder.encode(["the cat"])
    with monkeypatch.context() as patch, pytest.raises(RuntimeError):
        patch.setattr(encoder, "_chunk_ids", lambda chunks: (_ for _ in ()).throw(RuntimeError("broken")))
        encoder.encode(["the dog"])
    want = encoder.library.encode("the dog", add_special_tokens=False).ids
    assert np.frombuffer(encoder.encode(["the dog"])[0], "<u4").tolist() == want


def test_full_memory_keeps_what_came_first(monkeypatch):
    monkeypatch.setattr(tf, "REMEMBERED", 4)
    encoder = tf.ChunkEncoder(FILE)
    for text in ("a b c d e", "a b c x a b", "k l m n o", "a b k l m"):
        want = encoder.library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == want
    assert set(encoder.memory) == {"a", " b", " k"} and all(encoder.memory.values())


def test_decoding_a_block_takes_little_memory():
    ranks = (np.arange(1 << 20) % 40_000).astype("<u4")
    control, data = tf.encode_lengths(ranks)
    tracemalloc.start()
    assert (tf.decode_lengths(control, data, len(ranks)) == ranks).all()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 36 * len(ranks)
