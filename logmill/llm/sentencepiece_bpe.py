"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text becomes characters; an agenda of adjacent symbol pairs, ordered by the score of
the piece that a pair makes and then from left to right, is worked off until no pair
makes a piece. No piece has a blank after another character, nor joins characters of certain
groups (letters and commas, say), so the agenda of a whole text falls apart, exactly,
into one agenda per chunk; chunks are remembered.
Many short chunks are worked off together as rows of a matrix, the best pair of each row
per round; long ones one by one with a heap. ``agrees_with_library`` compares with the
sentencepiece library in the same Arrow batches.
"""

import codecs
import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logmill.llm.common import map_batches, read_table, remember

MODEL = "piece_bpe_32k.model"
BLANK = "▁"
# Chunks of up to this many characters are worked off together.
SHORT = 32
# Remembered chunks per Python worker.
REMEMBERED = 200_000
_NO_PAIR = np.iinfo(np.int32).max
_CODE_POINTS = 0x110000

# Field numbers of the public model format (sentencepiece_model.proto).
_TRAINER, _NORMALIZER = 2, 3
_MODEL_TYPE, _SUFFIX_BLANK, _BPE = 3, 24, 2
_CHARSMAP, _DUMMY_PREFIX, _REMOVE_EXTRA, _ESCAPE = 2, 3, 4, 5


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("logmill_each_byte", _each_byte)


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = number() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
            yield key >> 3, message[at : at + size]
            at += size


def _chunk_pattern(pieces: Iterable[str]) -> str:
    """Cuts a text where no piece can reach across.

    Characters that follow each other in some piece belong together; two that do not
    belong together never share a piece. Those that no piece joins make one more group.
    """
    group: dict[str, set[str]] = {}
    for piece in pieces:
        inside = piece.lstrip(BLANK)
        for pair in zip(inside, inside[1:]):
            first, second = (group.setdefault(c, {c}) for c in pair)
            if first is not second:
                small, large = sorted((first, second), key=len)
                large |= small
                group.update((c, large) for c in small)
    groups = {id(g): g for g in group.values()}.values()
    classes = ["".join(map(re.escape, sorted(g))) for g in groups]
    runs = [f"[{c}]+" for c in classes] + [f"[^ {''.join(classes)}]+"]
    return f" *(?:{'|'.join(runs)})| +"


class PieceModel:
    """Encoder and decoder of one BPE model file."""

    def __init__(self, model_file: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self._require_supported(dict(_fields(library.serialized_model_proto())))
        self.size = library.get_piece_size()
        ids = range(self.size)
        pieces = [library.id_to_piece(i) for i in ids]
        self.byte_ids = np.zeros(256, np.int64)
        self.surface: list[bytes] = []
        self.control = set()
        self.led = set()
        normal: dict[str, int] = {}
        for i, piece in enumerate(pieces):
            if library.is_byte(i):
                byte = int(piece[3:-1], 16)
                self.byte_ids[byte] = i
                self.surface.append(bytes([byte]))
            elif library.is_control(i):
                self.control.add(i)
                self.surface.append(b"")
            elif library.is_unknown(i):
                self.surface.append(" ⁇ ".encode())
            else:
                normal[piece] = i
                self.surface.append(piece.replace(BLANK, " ").encode())
                if piece.startswith(BLANK):
                    self.led.add(i)
        if any(library.is_unused(i) for i in ids) or not self.byte_ids.any():
            raise ValueError("models with unused pieces or without byte fallback are not supported")
        if any(BLANK in piece.lstrip(BLANK) for piece in normal):
            raise ValueError("models with pieces across blanks are not supported")
        self._symbol = np.arange(_CODE_POINTS, dtype=np.int64) + self.size
        for piece, i in normal.items():
            if len(piece) == 1:
                self._symbol[ord(piece)] = i
        self._build_pairs(normal, library)
        self._chunks = re.compile(_chunk_pattern(normal)).findall
        self._memory: dict[str, bytes] = {}

    @staticmethod
    def _require_supported(model: dict) -> None:
        trainer = dict(_fields(model[_TRAINER]))
        normalizer = dict(_fields(model[_NORMALIZER]))
        plain = not normalizer.get(_CHARSMAP) and normalizer.get(_DUMMY_PREFIX, 1)
        plain = plain and not normalizer.get(_REMOVE_EXTRA, 1) and normalizer.get(_ESCAPE, 1)
        if trainer.get(_MODEL_TYPE) != _BPE or trainer.get(_SUFFIX_BLANK) or not plain:
            raise ValueError("only BPE models with identity normalisation and a blank prefix")

    def _build_pairs(self, normal: dict[str, int], library) -> None:
        """Every pair of symbols that makes a piece, with the piece and its score's rank."""
        one = {c: int(self._symbol[ord(c)]) for piece in normal for c in piece}
        symbol = normal | {c: s for c, s in one.items() if c not in normal}
        scores = {i: library.get_score(i) for i in normal.values()}
        ranks = {score: rank for rank, score in enumerate(sorted(set(scores.values()), reverse=True))}
        found = {}
        for piece, i in normal.items():
            for cut in range(1, len(piece)):
                left, right = symbol.get(piece[:cut]), symbol.get(piece[cut:])
                if left is not None and right is not None:
                    found[self._key(left, right)] = (i, ranks[scores[i]])
        self._pair = found
        keys = sorted(found) or [-1]
        self._keys = np.array(keys, np.int64)
        self._merged = np.array([found.get(k, (0, 0))[0] for k in keys], np.int64)
        self._ranks = np.array([found.get(k, (0, _NO_PAIR))[1] for k in keys], np.int32)

    def _key(self, left, right):
        return left * (self.size + _CODE_POINTS) + right

    def _find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self._key(left, right)
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return at, np.where(self._keys[at] == keys, self._ranks[at], _NO_PAIR)

    def _agenda(self, chunk: str) -> list[int]:
        """One chunk's symbols by a heap of (rank, position) over a linked list."""
        symbols = self._symbol[np.frombuffer(chunk.encode("utf-32-le"), np.uint32)].tolist()
        count = len(symbols)
        after, before = list(range(1, count + 1)), list(range(-1, count - 1))
        agenda: list[tuple[int, int, int, int]] = []

        def offer(left: int) -> None:
            if left >= 0 and after[left] < count:
                pair = self._pair.get(self._key(symbols[left], symbols[after[left]]))
                if pair:
                    heapq.heappush(agenda, (pair[1], left, symbols[left], symbols[after[left]]))

        for left in range(count - 1):
            offer(left)
        while agenda:
            _, left, first, second = heapq.heappop(agenda)
            right = after[left]
            if symbols[left] != first or right >= count or symbols[right] != second:
                continue  # one of the two has merged since
            symbols[left] = self._pair[self._key(first, second)][0]
            symbols[right] = -1
            after[left] = after[right]
            if after[right] < count:
                before[after[right]] = left
            offer(before[left])
            offer(left)
        return [s for s in symbols if s >= 0]

    def _rounds(self, symbols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row numbers, final symbols) for rows of equally many characters.

        Each round merges the best pair of every row that has one, so the rows still
        at work always have equal lengths.
        """
        rows = np.arange(len(symbols))
        rank = self._find(symbols[:, :-1], symbols[:, 1:])[1]
        while rank.shape[1]:
            at = rank.argmin(axis=1)
            works = rank[np.arange(len(rank)), at] < _NO_PAIR
            if not works.all():
                yield rows[~works], symbols[~works]
                rows, symbols, rank, at = rows[works], symbols[works], rank[works], at[works]
            if not len(rows):
                return
            line = np.arange(len(rows))
            found, _ = self._find(symbols[line, at], symbols[line, at + 1])
            columns = np.arange(symbols.shape[1] - 1)
            symbols = np.take_along_axis(symbols, columns + (columns > at[:, None]), axis=1)
            symbols[line, at] = self._merged[found]
            columns = columns[:-1]
            rank = np.take_along_axis(rank, columns + (columns >= at[:, None]), axis=1)
            has = at > 0
            line, spot = np.flatnonzero(has), at[has]
            rank[line, spot - 1] = self._find(symbols[line, spot - 1], symbols[line, spot])[1]
            has = at < rank.shape[1]
            line, spot = np.flatnonzero(has), at[has]
            rank[line, spot] = self._find(symbols[line, spot], symbols[line, spot + 1])[1]
        yield rows, symbols

    def _as_bytes(self, symbols) -> bytes:
        """Ids as little-endian 32-bit integers; characters without a piece as bytes."""
        ids = np.asarray(symbols, np.int64)
        if (ids >= self.size).any():
            ids = np.concatenate(
                [[s] if s < self.size else self.byte_ids[list(chr(s - self.size).encode())] for s in ids]
            )
        return ids.astype("<i4").tobytes()

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk; blanks already are BLANK."""
        found = [b""] * len(chunks)
        by_length: dict[int, list[int]] = {}
        for place, chunk in enumerate(chunks):
            if len(chunk) > SHORT:
                found[place] = self._as_bytes(self._agenda(chunk))
            else:
                by_length.setdefault(len(chunk), []).append(place)
        for length, places in by_length.items():
            codes = np.frombuffer("".join([chunks[p] for p in places]).encode("utf-32-le"), np.uint32)
            for rows, symbols in self._rounds(self._symbol[codes].reshape(-1, length)):
                if symbols.size and symbols.max() >= self.size:
                    for row, line in zip(rows.tolist(), symbols, strict=True):
                        found[places[row]] = self._as_bytes(line)
                else:
                    flat, step = symbols.astype("<i4").tobytes(), symbols.shape[1] * 4
                    for k, row in enumerate(rows.tolist()):
                        found[places[row]] = flat[k * step : (k + 1) * step]
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers."""
        rows, gaps, new, asked, absent = [], [], {}, 0, 0
        look_up = self._memory.get
        for text in texts:
            chunks = self._chunks(" " + text.replace(BLANK, " ")) if text else []
            found = list(map(look_up, chunks))
            asked += len(found)
            if None in found:
                missing = [(k, chunks[k]) for k, ids in enumerate(found) if ids is None]
                absent += len(missing)
                gaps.append((found, missing))
                new.update((chunk, None) for _, chunk in missing)
            rows.append(found)
        fresh = dict(zip(new, self.encode_chunks([chunk.replace(" ", BLANK) for chunk in new]), strict=True))
        for found, missing in gaps:
            for k, chunk in missing:
                found[k] = fresh[chunk]
        self._memory = remember(self._memory, fresh, asked, absent, REMEMBERED)
        return [b"".join(found) for found in rows]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: byte pieces joined to characters, the blank prefix removed."""
        if not self.control.isdisjoint(ids):  # control ids end a run of byte pieces
            runs = groupby(ids, key=self.control.__contains__)
            parts = [list(run) for control, run in runs if not control]
        else:
            parts = [ids]
        surface = self.surface.__getitem__
        text = "".join(b"".join(map(surface, p)).decode("utf-8", "logmill_each_byte") for p in parts)
        return text[1:] if parts and parts[0] and parts[0][0] in self.led else text


@lru_cache(maxsize=2)
def load_model(model_file: str) -> PieceModel:
    return PieceModel(model_file)


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [text or "" for text in batch.column("text").to_pylist()]


def _id_lists(encoded: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(ids) // 4 for ids in encoded)], dtype=np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(encoded), "<i4")))


def encode_decode(docs: DataFrame, model_file: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, ``ids`` (array of int) and ``decoded`` of every whole text.

    NULL and empty texts have no ids and decode to the empty text. ``text`` itself may be
    kept; kept columns named ``ids`` or ``decoded`` give way to the results. Repeated
    rows stay.
    """
    kept = [c for c in keep if c not in ("ids", "decoded")]
    rows = docs.select(F.struct(*kept).alias("row"), F.col(text).cast("string").alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = load_model(model_file)
        encoded = model.encode(_texts(batch))
        decoded = [model.decode(np.frombuffer(ids, "<i4").tolist()) for ids in encoded]
        return pa.RecordBatch.from_arrays(
            [batch.column("row"), _id_lists(encoded), pa.array(decoded, pa.string())],
            ["row", "ids", "decoded"],
        )

    schema = f"row {rows.schema['row'].dataType.simpleString()}, ids array<int>, decoded string"
    return map_batches(rows, run, schema).select("row.*", "ids", "decoded")


def agrees_with_library(docs: DataFrame, model_file: str, text: str = "text") -> DataFrame:
    """``texts`` and ``differing``: how many texts the library encodes or decodes otherwise."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        import sentencepiece

        model = load_model(model_file)
        library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        texts = _texts(batch)
        own = [np.frombuffer(ids, "<i4").tolist() for ids in model.encode(texts)]
        want = library.encode(texts, num_threads=1)
        differing = sum(
            a != b or model.decode(a) != library.decode(b) for a, b in zip(own, want, strict=True)
        )
        return pa.RecordBatch.from_pydict({"texts": [len(texts)], "differing": [differing]})

    rows = docs.select(F.col(text).cast("string").alias("text"))
    return map_batches(rows, run, "texts bigint, differing bigint").agg(
        F.coalesce(F.sum("texts"), F.lit(0)).alias("texts"),
        F.coalesce(F.sum("differing"), F.lit(0)).alias("differing"),
    )


def ids_text(ids: Column) -> Column:
    """Decimal ids joined by commas."""
    return F.array_join(ids.cast("array<string>"), ",")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    docs = read_table(spark, sf_dir, "documents")
    found = encode_decode(docs, public_tokenizers.path(MODEL), ["doc_id"])
    return found.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(ids_text(F.col("ids")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
