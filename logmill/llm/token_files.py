"""Token ids in files: frequency-ranked, byte-aligned variable-length coding.

Ids are replaced by their rank among all ids of the corpus, most frequent first, and
each rank takes 1 to 4 bytes. Lengths stand apart from the data: two bits an id, four to
a control byte, so a reader turns control bytes into lengths, offsets and values with
table look-ups and no branch per id.

A data set is a rank table and shards in ascending document order. A shard is a sequence
of blocks; a block is a header, document ids, document lengths, control bytes and data
bytes of whole documents. Readers and writers hold one block at a time.
"""

import json
import re
import struct
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from operator import attrgetter

import numpy as np
import pyarrow as pa
import public_tokenizers
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logmill.llm import files
from logmill.llm.common import pieces, read_table, remember, stored
from logmill.sources.shared import shared_folder

TOKENIZER, END_ID = "byte_bpe_50k.json", 2
# Ids of a shard (a few ten MB) and of a block; a longer document has a block of its own.
SHARD_IDS, BLOCK_IDS = 8_000_000, 1 << 20
# Remembered chunks per Python worker.
REMEMBERED = 300_000
# magic, documents, ids, data bytes
_HEADER = struct.Struct("<8sQQQ")
_MAGIC = b"LMTOKEN1"
_NO_DOC = np.iinfo(np.int64).min
# White space by Unicode's property.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Letters of the Latin blocks, a part of all letters.
_LATIN = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f"
# Cuts only where the vocabulary's own splitting always cuts: at white space, and between
# a whole run of letters and an ASCII sign or digit.
_chunks = re.compile(
    rf" ?[{_LATIN}]++(?![^\x00-\x7f])| ?[^{_SPACE}]++|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]"
).findall

# Whole chunks that any such splitting leaves in one part.
_is_word = re.compile(rf" ?[{_LATIN}]+").fullmatch


def _splits_like_chunks(library) -> bool:
    """Whether a tokenizer cuts wherever ``_chunks`` does: byte-level splitting by its own
    pattern, nothing put in front, and texts not changed before."""
    # Only the splitter's own state: the whole tokenizer's has the vocabulary.
    cut = json.loads(library.pre_tokenizer.__getstate__()) if library.pre_tokenizer else {}
    byte_level = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
    return byte_level and library.normalizer is None and not library.truncation and not library.padding


_id_of = attrgetter("id")


@lru_cache(maxsize=1024)
def _ids_struct(count: int) -> struct.Struct:
    return struct.Struct(f"<{count}I")


class _ByteSigns(dict):
    """By character: its bytes in the signs of byte-level vocabularies, as the library writes them."""

    def __init__(self, splitter):
        super().__init__()
        self.splitter = splitter

    def __missing__(self, code: int) -> str:
        self[code] = signs = "".join(part for part, _ in self.splitter.pre_tokenize_str(chr(code)))
        return signs


class ChunkEncoder:
    """The tokenizers library, with the ids of blank-led chunks remembered.

    Texts for tokenizers that split in another way go to the library whole.
    """

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_file)
        # Added tokens cut a text before anything else does.
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # Ids by chunk. One that is not there gets an empty place, filled once its ids are known,
        # without a step in Python for each.
        self.places: defaultdict[str, bytearray] = defaultdict(bytearray)
        self.kind = type("Memory", (dict,), {"__missing__": self.places.__getitem__})
        self.memory: dict[str, bytes] = self.kind()
        self.by_chunks = _splits_like_chunks(self.library)
        self.model, self.signs = self.library.model, _ByteSigns(self.library.pre_tokenizer)

    @property
    def size(self) -> int:
        return self.library.get_vocab_size(with_added_tokens=True)

    def _library_ids(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _chunk_ids(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks: words straight from the library's model, the others many in one
        call, in which each is cut by itself."""
        found: dict[str, bytes] = {}
        tokenize, signs, rest = self.model.tokenize, self.signs, []
        blank = signs[ord(" ")]
        for chunk in chunks:
            # ASCII letters are their own signs.
            if chunk.isascii() and chunk.removeprefix(" ").isalpha():
                word = chunk.replace(" ", blank)
            elif _is_word(chunk):
                word = chunk.translate(signs)
            else:
                rest.append(chunk)
                continue
            ids = list(map(_id_of, tokenize(word)))
            found[chunk] = _ids_struct(len(ids)).pack(*ids)
        for start in range(0, len(rest), 4096):
            part = rest[start : start + 4096]
            (joined,) = self.library.encode_batch([part], is_pretokenized=True, add_special_tokens=False)
            data = np.array(joined.ids, "<u4").tobytes()
            chunk_of = np.array(joined.word_ids, np.int64)
            ends = (4 * np.searchsorted(chunk_of, np.arange(len(part)), "right")).tolist()
            found.update((c, data[a:b]) for c, a, b in zip(part, [0, *ends], ends))
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        if not self.by_chunks:
            return self._library_ids(texts)
        memory, places, rows, whole, asked = self.memory, self.places, [], [], 0
        places.clear()
        for text in texts:
            if any(token in text for token in self.added):
                whole.append(len(rows))
                rows.append([])
                continue
            found = list(map(memory.__getitem__, _chunks(text)))
            asked += len(found)
            rows.append(found)
        fresh = self._chunk_ids(list(places))
        for chunk, ids in fresh.items():
            places[chunk] += ids
        for row, ids in zip(whole, self._library_ids([texts[r] for r in whole]), strict=True):
            rows[row] = [ids]
        # Few different ones cost little, however often they come.
        absent = len(places)
        if 8 * absent > asked:
            absent = sum(type(ids) is bytearray for found in rows for ids in found)
        kept = remember(memory, fresh, asked, absent, REMEMBERED)
        self.memory = memory if kept is memory else self.kind(kept)
        return [b"".join(found) for found in rows]


@lru_cache(maxsize=2)
def load_encoder(tokenizer_file: str) -> ChunkEncoder:
    return ChunkEncoder(tokenizer_file)


def encode_lengths(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit ranks."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    most = int(ranks.max(initial=0))
    extra = (ranks > 0xFF).astype(np.uint8)
    if most > 0xFFFF:
        extra += ranks > 0xFFFF
        extra += ranks > 0xFFFFFF
    lanes = np.zeros((-(-len(ranks) // 4), 4), np.uint8)
    lanes.reshape(-1)[: len(ranks)] = extra
    control = lanes[:, 0] | lanes[:, 1] << 2 | lanes[:, 2] << 4 | lanes[:, 3] << 6
    # Columns that no rank needs are left out before bytes are chosen.
    cells = ranks if most > 0xFFFF else ranks.astype("<u2")
    needed = np.empty((len(ranks), cells.itemsize), bool)
    for byte in range(cells.itemsize):
        needed[:, byte] = extra >= byte
    data = cells.view(np.uint8)[needed.reshape(-1)]
    return control.tobytes(), data.tobytes()


_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1).astype(np.uint8)


def decode_lengths(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The ranks that ``encode_lengths`` was given."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    starts = np.cumsum(lengths, dtype=np.int64)
    starts -= lengths
    source = np.frombuffer(data, np.uint8)
    ranks = source[starts].astype(np.uint32)
    for byte in range(1, int(lengths.max(initial=1))):
        has = np.flatnonzero(lengths > byte)
        ranks[has] |= source[starts[has] + byte].astype(np.uint32) << np.uint32(8 * byte)
    return ranks


def encode_documents(docs: DataFrame, tokenizer_file: str, end_id: int | None) -> DataFrame:
    """Documents with ``doc_id``, ``n_tokens``, ``ids`` (compressed little-endian 32-bit
    integers); then, from each task, rows with ``id`` and ``n`` only: how often its
    documents have each id, at most one row per vocabulary id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(3).compress
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        encoder = load_encoder(tokenizer_file)
        counts = np.zeros(encoder.size, np.int64)
        for batch in batches:
            for piece in pieces(batch):
                texts = [text or "" for text in piece.column("text").to_pylist()]
                found = [ids + end for ids in encoder.encode(texts)]
                counts += np.bincount(np.frombuffer(b"".join(found), "<u4"), minlength=len(counts))
                yield rows(
                    doc_id=piece.column("doc_id"),
                    n_tokens=[len(ids) // 4 for ids in found],
                    ids=[pack(_planes(ids)) for ids in found],
                )
        seen = np.flatnonzero(counts)
        yield rows(id=seen, n=counts[seen])

    def rows(**given) -> pa.RecordBatch:
        length = len(next(iter(given.values())))
        columns = [pa.array(given[c], kind) if c in given else pa.nulls(length, kind) for c, kind in kinds.items()]
        return pa.RecordBatch.from_arrays(columns, list(kinds))

    kinds = dict(doc_id=pa.int64(), n_tokens=pa.int64(), ids=pa.binary(), id=pa.int64(), n=pa.int64())
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return texts.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary, id bigint, n bigint")


def _planes(ids: bytes) -> bytes:
    """Low halves, then high halves: the high ones are nearly all zero."""
    return np.frombuffer(ids, "<u2").reshape(-1, 2).T.tobytes()


def _from_planes(planes: bytes) -> np.ndarray:
    halves = np.frombuffer(planes, "<u2").reshape(2, -1)
    return np.ascontiguousarray(halves.T).view("<u4").reshape(-1)


def count_ids(encoded: DataFrame) -> dict[int, int]:
    """How often each id occurs in all documents; at most one entry per vocabulary id."""
    counts = encoded.filter(F.col("id").isNotNull()).groupBy("id").agg(F.sum("n").alias("n"))
    return {r["id"]: r["n"] for r in counts.collect()}


def ids_by_rank(counts: dict[int, int], size: int) -> np.ndarray:
    """Every id of the vocabulary, the most frequent first, ties by id."""
    return np.array(sorted(range(size), key=lambda i: (-counts.get(i, 0), i)), "<u4")


def _block(doc_ids: list, lengths: list[int], ranks: np.ndarray) -> bytes:
    control, data = encode_lengths(ranks)
    head = _HEADER.pack(_MAGIC, len(doc_ids), len(ranks), len(data))
    keys = np.array([_NO_DOC if d is None else d for d in doc_ids], "<i8")
    return b"".join([head, keys.tobytes(), np.array(lengths, "<u8").tobytes(), control, data])


def read_blocks(stream) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document ids, lengths, ranks) of each block of a shard."""
    while head := stream.read(_HEADER.size):
        magic, n_docs, n_ids, n_data = _HEADER.unpack(head)
        if magic != _MAGIC:
            raise ValueError("not a token file")
        keys = np.frombuffer(stream.read(8 * n_docs), "<i8")
        lengths = np.frombuffer(stream.read(8 * n_docs), "<u8").astype(np.int64)
        control = stream.read(-(-n_ids // 4))
        yield keys, lengths, decode_lengths(control, stream.read(n_data), n_ids)


def write_token_files(
    docs: DataFrame, folder: str, tokenizer_file: str, end_id: int | None = None
) -> DataFrame:
    """Write ``doc_id``, ``text`` rows as a data set; returns its shards.

    Each shard row has ``shard`` (order), ``path``, ``ranks`` (path of the rank table),
    ``n_docs`` and ``n_ids``. NULL and empty texts have no ids but the end id. Rows with
    equal ids stand next to each other, NULL ids first. An empty table has no shards.
    """
    spark = docs.sparkSession
    encoded = stored(encode_documents(docs, tokenizer_file, end_id), "token-ids")
    size = load_encoder(tokenizer_file).size
    counts = count_ids(encoded)
    order = ids_by_rank(counts, size)
    ranks = files.write_bytes(folder, "ranks", order.tobytes())
    ordered = encoded.filter(F.col("id").isNull()).repartitionByRange(
        max(1, -(-sum(counts.values()) // SHARD_IDS)), "doc_id", F.crc32("ids")
    ).sortWithinPartitions("doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank_of = np.empty(size, np.uint32)
        rank_of[order] = np.arange(size, dtype=np.uint32)
        shard, unpack = TaskContext.get().partitionId(), zstandard.ZstdDecompressor().decompress
        path, stream = files.open_output(folder, f"shard-{shard:06d}")
        n_docs = n_ids = waiting = 0
        keys, parts = [], []
        with stream:

            def flush() -> None:
                if keys:
                    ranks_of_block = rank_of[np.concatenate(parts)]
                    stream.write(_block(keys, [len(p) for p in parts], ranks_of_block))

            for batch in batches:
                for key, blob in zip(
                    batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True
                ):
                    ids = _from_planes(unpack(blob))
                    if waiting + len(ids) > BLOCK_IDS:
                        flush()
                        keys, parts, waiting = [], [], 0
                    keys.append(key)
                    parts.append(ids)
                    n_docs, n_ids, waiting = n_docs + 1, n_ids + len(ids), waiting + len(ids)
            flush()
        if n_docs:
            yield pa.RecordBatch.from_pydict(
                {"shard": [shard], "path": [path], "ranks": [ranks], "n_docs": [n_docs], "n_ids": [n_ids]}
            )

    schema = "shard bigint, path string, ranks string, n_docs bigint, n_ids bigint"
    return stored(ordered.select("doc_id", "ids").mapInArrow(run, schema), "token-shards")


def read_token_files(shards: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids`` (little-endian 32-bit) of every document.

    ``start`` counts the ids of all documents before it in the data set. The shard list,
    one row per some ten MB, passes through the driver, as a file listing does.
    """
    spark = shards.sparkSession
    before, rows = 0, []
    for row in shards.orderBy("shard").collect():
        rows.append((row["path"], row["ranks"], before))
        before += row["n_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                order = np.frombuffer(files.read_bytes(shard["ranks"]), "<u4")
                start = shard["start"]
                with files.open_input(shard["path"]) as stream:
                    for keys, lengths, ranks in read_blocks(stream):
                        ids = order[ranks]
                        ends = np.cumsum(lengths)
                        blobs = [ids[e - n : e].tobytes() for e, n in zip(ends, lengths, strict=True)]
                        yield pa.RecordBatch.from_pydict(
                            {
                                "doc_id": pa.array(keys, mask=keys == _NO_DOC),
                                "start": pa.array(start + ends - lengths),
                                "n_tokens": pa.array(lengths),
                                "ids": pa.array(blobs, pa.binary()),
                            }
                        )
                        start += len(ids)

    listed = spark.createDataFrame(rows, "path string, ranks string, start bigint")
    spread = listed.repartition(max(1, len(rows)), "path")
    return spread.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position, length and checksum of every document's ids, read back from the files."""
    docs = read_table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "token-files")
    shards = write_token_files(docs, folder, public_tokenizers.path(TOKENIZER), END_ID)
    return read_token_files(shards).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )
