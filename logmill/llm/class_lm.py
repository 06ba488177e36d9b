"""Language-model scores from Brown class-based bigrams.

The probability of a token is that of its class after the class before, times that of
the token within its class. Exchange clustering assigns all words that occur at least
``MIN_COUNT`` times to classes, whose number grows with theirs: word by word, the class is
sought that raises the likelihood of the class bigrams most; moves are made for a share of the words at a time and kept only if the
likelihood rises. Words seen once stand for those never seen: both share classes by their
shape, so every word has one. Class transitions and word counts come from all training
texts. A text ends with an end token, which also stands before its first word.

Texts are read twice: words are counted, then texts are written as numbers of their words,
of which pairs of neighbours are counted and scores are made. What frequent words need is
sent to the tasks (``KNOWN_WORDS`` entries at most); the counts and numbers of all other
words meet the texts in one join, once for each chunk of texts. Pairs are counted in sorted
arrays, a block of words at a time, and stay in them for the exchange. The classes are sent
out as one integer for each clustered word.
"""

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logmill.llm.common import crc_fold, free, pieces, read_table, stored

FOLDS, HELD_OUT = 7, 2
# Occurrences of a word with a class of its own choice.
MIN_COUNT = 2
# Bounds of such words and learnt classes, for small models; None: all, and ``class_count``.
EXCHANGE_WORDS: int | None = None
CLASSES: int | None = None
# Words whose counts are sent out.
KNOWN_WORDS = 1 << 18
ROUNDS = 6
# Weight of the class's own frequency in a transition.
PRIOR = 5.0
# Distinct words that a task holds before it passes counts on.
HELD_WORDS = 400_000
# Pairs that a task holds before it passes counts on; words whose moves are weighed at once.
HELD_PAIRS, BLOCK = 1 << 20, 256
# Text whose words are looked up together; tokens for each two blocks of words, and so many
# blocks at least; neighbours in a row of a block.
CHUNK_BYTES, BLOCK_TOKENS, BLOCKS, ROW_PAIRS = 1 << 19, 1 << 22, 64, 1 << 16
# Counts up to this have their gains in a table.
SMALL = 8
# Cells whose gains are added up at once.
_CELLS = 256
# Smaller shares of a round's moves that are tried in one reading of the pairs.
TRIALS = 4
# Columns of the pairs.
AFTER, BEFORE = ("word", "ends", "other", "n"), ("ends_before", "before", "n_before")
# White space, so never a word.
END = b"\n"
SHAPES = 16
BOUNDARY = SHAPES
_PUNCTUATION = frozenset(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_DIGITS = frozenset(b"0123456789")


def shape(word: bytes) -> int:
    """The class of a word without a class of its own, by its form."""
    return (
        (not _DIGITS.isdisjoint(word))
        | (not word.isascii()) << 1
        | (word[-1] in _PUNCTUATION) << 2
        | (len(word) > 9) << 3
    )


def words_of(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space."""
    return (text or b"").lower().split()


def _texts(docs: DataFrame, text: str, *more: Column) -> DataFrame:
    return docs.select(*more, F.col(text).cast("string").cast("binary").alias("text"))


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word``, ``shape``, ``n`` over all texts; the end token once per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            words = list(counts)
            shapes = [BOUNDARY if word == END else int(shape(word)) for word in words]
            return pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array(shapes, pa.int32()), pa.array(counts.values(), pa.int64())],
                ["word", "shape", "n"],
            )

        for batch in batches:
            for piece in pieces(batch):
                for value in piece.column("text").to_pylist():
                    counts.update(words_of(value))
                counts[END] += piece.num_rows
                if len(counts) > HELD_WORDS:
                    yield flush()
                    counts.clear()
        yield flush()

    found = _texts(docs, text).mapInArrow(run, "word binary, shape int, n bigint")
    return found.groupBy("word", "shape").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Vocabulary:
    """Totals over all training words, and the known ones, most frequent first."""

    words: dict[bytes, int]
    counts: np.ndarray
    shapes: np.ndarray
    tokens: int
    types: int
    # Of the words of each shape without a class of their own: tokens and distinct words.
    shape_tokens: np.ndarray
    shape_types: np.ndarray
    # So many of the words have a class of their own.
    exchanged: int
    # Numbers fall with the count: each different count, and the first number that has it.
    levels: np.ndarray
    starts: np.ndarray

    def units(self) -> np.ndarray:
        """What is counted in pairs, by known word: itself or its shape."""
        own = np.arange(len(self.words))
        return np.where(own < self.exchanged, own, self.exchanged + self.shapes)

    @property
    def boundary(self) -> int:
        return self.exchanged + BOUNDARY


def class_count(words: int) -> int:
    """Learnt classes: 64, from 1000 words on growing with the fourth root of their number."""
    return CLASSES or max(64, round(64 * (words / 1000) ** 0.25))


def vocabulary(counts: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """(vocabulary, ``counts`` with ``unit``), from ``word_counts``.

    The known words are the ``KNOWN_WORDS`` most frequent, of equal counts the first ones.
    ``unit`` numbers the other words with classes of their own, after the known ones.
    To the driver come the known words, and how many words each count has: as many rows
    as there are different counts, fewer than the root of twice the tokens.
    """
    words = counts.filter(F.col("shape") < SHAPES)
    by_count = sorted(words.groupBy("n").agg(F.count("*").alias("types")).collect(), reverse=True)
    clustered = sum(row["types"] for row in by_count if row["n"] >= MIN_COUNT)
    exchanged = clustered if EXCHANGE_WORDS is None else min(EXCHANGE_WORDS, clustered)
    least, cut, room = None, None, KNOWN_WORDS
    for row in by_count:
        if row["types"] > room:
            cut = row["n"]
            break
        room -= row["types"]
        least = row["n"]
    known = [] if least is None else words.filter(F.col("n") >= least).collect()
    known.sort(key=lambda row: (-row["n"], row["word"]))
    ties = words.filter(F.col("n") == cut).orderBy("word").limit(room).collect() if cut and room else []
    known += ties
    shape_tokens, shape_types = np.zeros(SHAPES), np.zeros(SHAPES)
    by_shape = counts.groupBy("shape").agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect()
    for row in by_shape:
        if row["shape"] < SHAPES:
            shape_tokens[row["shape"]], shape_types[row["shape"]] = row["n"], row["types"]
    for row in known[:exchanged]:
        shape_tokens[row["shape"]] -= row["n"]
        shape_types[row["shape"]] -= 1
    units = counts.withColumn("unit", F.lit(None).cast("int"))
    if exchanged > len(known):
        rest = F.col("n") < cut
        if ties:
            rest = rest | ((F.col("n") == cut) & (F.col("word") > F.lit(bytes(ties[-1]["word"]))))
        elif cut:
            rest = F.col("n") <= cut
        tail = words.filter(rest & (F.col("n") >= MIN_COUNT)).orderBy(F.desc("n"), "word")
        tail = written = stored(tail.select("word", "shape", "n", F.monotonically_increasing_id().alias("id")), "lm-tail")
        part = F.shiftright("id", 33)
        start, starts = len(known), {}
        for row in sorted(tail.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):
            starts[row["part"]] = start
            start += row["n"]
        first = F.create_map(*[F.lit(v) for pair in starts.items() for v in pair])[part]
        unit = (first + F.col("id").bitwiseAND((1 << 33) - 1)).cast("int").alias("unit")
        tail = tail.select("word", "shape", "n", unit).filter(F.col("unit") < exchanged)
        for row in tail.groupBy("shape").agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect():
            shape_tokens[row["shape"]] -= row["n"]
            shape_types[row["shape"]] -= row["types"]
        numbers = tail.select(F.col("word").alias("numbered"), "unit")
        units = stored(counts.join(numbers, F.col("word") == F.col("numbered"), "left").drop("numbered"), "lm-units")
        free(written)
    return Vocabulary(
        {bytes(row["word"]): i for i, row in enumerate(known)},
        np.array([row["n"] for row in known], np.int64),
        np.array([row["shape"] for row in known], np.int64),
        sum(row["n"] for row in by_shape),
        sum(row["types"] for row in by_shape),
        shape_tokens,
        shape_types,
        exchanged,
        np.array([row["n"] for row in by_count], np.int64),
        np.cumsum([0, *[row["types"] for row in by_count]])[:-1],
    ), units


class _Numbers(dict):
    """Known words' numbers; other words are numbered as they come, after the known ones."""

    def __init__(self, words: dict[bytes, int]):
        super().__init__(words)
        self.known, self.others = len(words), []

    def __missing__(self, word: bytes) -> int:
        self[word] = number = self.known + len(self.others)
        self.others.append(word)
        return number

    def forget(self) -> None:
        for word in self.others:
            del self[word]
        self.others = []


def coded(docs: DataFrame, known: Vocabulary, counts: DataFrame | None, row: Column, trained: Column, text: str = "text") -> DataFrame:
    """The texts as numbers of their words, a row for each chunk of texts, stored.

    ``row`` and ``trained`` are lists of what was asked for, ``ends`` says where each text
    ends in ``line``, both int32 as bytes. A word is its number, as in ``vocabulary``; one
    without a number is -1 - shape - SHAPES * count. Without ``counts``, words that are not
    known are taken for unseen ones.
    """
    size = len(known.words)
    shared = docs.sparkSession.sparkContext.broadcast(known.words)
    rows = _texts(docs, text, F.monotonically_increasing_id().alias("chunk"), row.alias("row"), trained.alias("trained"))
    kinds = ", ".join(f"{c} array<{rows.schema[c].dataType.simpleString()}>" for c in ("row", "trained"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Numbers(shared.value)
        for batch in batches:
            for piece in pieces(batch, most=CHUNK_BYTES):
                lines, ends = [], np.zeros(piece.num_rows, "<i4")
                for place, value in enumerate(piece.column("text").to_pylist()):
                    words = words_of(value)
                    lines.append(np.fromiter(map(numbers.__getitem__, words), "<i4", len(words)))
                    ends[place] = len(words)
                whole = pa.array([0, piece.num_rows], pa.int32())
                lists = [pa.ListArray.from_arrays(whole, piece.column(c)) for c in ("row", "trained")]
                columns = [
                    piece.column("chunk").slice(0, 1),
                    *lists,
                    pa.array([ends.cumsum(dtype="<i4").tobytes()], pa.binary()),
                    pa.array([np.concatenate(lines).tobytes()], pa.binary()),
                    pa.array([numbers.others], pa.list_(pa.binary())),
                ]
                numbers.forget()
                yield pa.RecordBatch.from_arrays(columns, ["chunk", "row", "trained", "ends", "line", "others"])

    lines = stored(rows.mapInArrow(encode, f"chunk bigint, {kinds}, ends binary, line binary, others array<binary>"), "lm-lines")
    if counts is None:
        whole = lines.withColumn("met", F.lit(None).cast("array<bigint>"))
    else:
        # A count that does not fit would be that of a word rarer than all known ones.
        code = F.coalesce("unit", (F.lit(-1) - F.col("shape") - SHAPES * F.col("n")).cast("int"))
        seen = counts.filter(F.col("shape") < SHAPES).select("word", code.cast("bigint").alias("code"))
        rare = lines.select("chunk", F.posexplode("others").alias("place", "other")).join(seen, F.col("word") == F.col("other"))
        entry = F.shiftleft(F.col("place").cast("bigint"), 32).bitwiseOR(F.col("code").bitwiseAND((1 << 32) - 1))
        met = rare.groupBy(F.col("chunk").alias("of")).agg(F.collect_list(entry).alias("met"))
        whole = lines.join(met, F.col("chunk") == F.col("of"), "left")

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = []
            for line, others, met in zip(*(batch.column(c) for c in ("line", "others", "met")), strict=True):
                line, codes = np.frombuffer(line.as_buffer(), "<i4").copy(), np.zeros(len(others), "<i4")
                entries = met.values.to_numpy() if met.is_valid else np.zeros(0, np.int64)
                codes[entries >> 32] = entries.astype("<i4")
                absent = np.ones(len(codes), bool)
                absent[entries >> 32] = False
                for place in np.flatnonzero(absent).tolist():
                    codes[place] = -1 - shape(others[place].as_py())
                other = line >= size
                line[other] = codes[line[other] - size]
                lines.append(line.tobytes())
            columns = [*(batch.column(c) for c in ("row", "trained", "ends")), pa.array(lines, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "trained", "ends", "line"])

    whole = whole.select("row", "trained", "ends", "line", "others", "met")
    found = stored(whole.mapInArrow(resolve, f"{kinds}, ends binary, line binary"), "lm-coded")
    free(lines)
    return found


def _units_of(line: np.ndarray, exchanged: int, shapes: np.ndarray) -> np.ndarray:
    """What is counted in pairs, by word: itself or its shape."""
    units = line.astype(np.int64)
    if (some := np.flatnonzero(line < 0)).size:
        units[some] = exchanged + ((-1 - line[some]) & (SHAPES - 1))
    if (some := np.flatnonzero(line >= exchanged)).size:
        units[some] = shapes[line[some]] + np.int64(exchanged)
    return units


def _between_ends(units: np.ndarray, ends: np.ndarray, end: int) -> np.ndarray:
    """The texts one after the other, with the end before the first and after each."""
    found = np.full(len(units) + len(ends) + 1, end, np.int64)
    found[np.arange(1, len(units) + 1) + np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))] = units
    return found


@dataclass(frozen=True)
class Blocks:
    """Which block of pairs a pair is in, and where: all of a clustered word are in one.

    Blocks of even number hold even words. A key orders by block, word and neighbour; what
    stands before the word is numbered after all units. Pairs with other units first are
    dealt out by the second.
    """

    exchanged: int
    blocks: int

    @property
    def units(self) -> int:
        return self.exchanged + SHAPES + 1

    @property
    def most(self) -> int:
        """Clustered words in a block."""
        return -(-self.exchanged // self.blocks)

    @property
    def width(self) -> int:
        """Keys of a block."""
        return (self.most + SHAPES + 1) * 2 * self.units

    def keys(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        size = 2 * self.units
        own = np.where(first < self.exchanged, first, second)
        place = np.where(first < self.exchanged, first // self.blocks, self.most + first - self.exchanged)
        after = own % self.blocks * self.width + place * size + second
        some = second < self.exchanged
        first, second = first[some], second[some]
        before = second % self.blocks * self.width + second // self.blocks * size + self.units + first
        return np.concatenate([after, before])

    def words(self, block: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, neighbour) by key of a block."""
        place, other = np.divmod(keys - block * self.width, 2 * self.units)
        return np.where(place < self.most, place * self.blocks + block, self.exchanged + place - self.most), other


def _planes(values: np.ndarray) -> bytes:
    """First bytes of all values, then second ones: mostly zero, so that they compress."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _from_planes(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(width, -1).T.copy().view(kind).ravel()


def _sums(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(different keys in order, sums of ``n``; how often each occurs)."""
    if n is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[starts], np.diff(np.append(starts, len(keys))) if n is None else np.add.reduceat(n, starts)


def pair_counts(docs: DataFrame, known: Vocabulary, text: str = "text", counts: DataFrame | None = None) -> DataFrame:
    """``pairs_of`` all texts; without ``counts``, words that are not known are of their shape's unit."""
    lines = coded(docs, known, counts, F.lit(0), F.lit(True), text)
    pairs = pairs_of(lines, known)
    free(lines)
    return pairs


def pairs_of(lines: DataFrame, known: Vocabulary) -> DataFrame:
    """Neighbouring units in the texts to learn from, counted by blocks of words, stored.

    ``block``, then as bytes ``word`` and, of the units after it, ``ends`` (where a word's
    end), ``other`` and ``n``, as wide as the row's largest; for clustered words the same of
    the units before it.
    """
    deal = Blocks(known.exchanged, max(BLOCKS, 2 * -(-known.tokens // BLOCK_TOKENS)))
    exchanged, end = known.exchanged, known.boundary
    shared = lines.sparkSession.sparkContext.broadcast(known.shapes.astype(np.int8))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            found, n = _sums(np.concatenate(keys))
            cuts = np.searchsorted(found, np.arange(deal.blocks + 1) * deal.width).tolist()
            for block in range(deal.blocks):
                if (part := slice(cuts[block], cuts[block + 1])).start < part.stop:
                    data = [_planes(np.diff(found[part], prepend=0)), _planes(n[part].astype("<i4"))]
                    columns = [pa.array([block], pa.int32()), *(pa.array([d], pa.binary()) for d in data)]
                    yield pa.RecordBatch.from_arrays(columns, ["block", "keys", "n"])

        for batch in batches:
            for trained, ends, line in zip(*(batch.column(c) for c in ("trained", "ends", "line")), strict=True):
                ends = np.frombuffer(ends.as_buffer(), "<i4").astype(np.int64)
                units = _units_of(np.frombuffer(line.as_buffer(), "<i4"), exchanged, shared.value)
                whole = _between_ends(units, ends, end)
                used = np.repeat(trained.values.to_numpy(zero_copy_only=False), np.diff(ends, prepend=0) + 1)
                keys.append(deal.keys(whole[:-1][used], whole[1:][used]))
                held += len(used)
                if held > HELD_PAIRS:
                    yield from flush()
                    keys, held = [], 0
        if keys:
            yield from flush()

    def merge(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        keys = np.concatenate([np.cumsum(_from_planes(d.as_py(), "<i8")) for d in table.column("keys")])
        keys, n = _sums(keys, np.concatenate([_from_planes(d.as_py(), "<i4") for d in table.column("n")]).astype(np.int64))
        word, other = deal.words(block, keys)
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        # Where each word's neighbours end, by side.
        before = other >= deal.units
        stops = np.append(starts[1:], len(word))
        stops_before = np.cumsum(before)[stops - 1]
        sides = (
            (np.append(0, stops - stops_before), other[~before], n[~before]),
            (np.append(0, stops_before), other[before] - deal.units, n[before]),
        )
        # Rows of whole words, by where those begin.
        cuts = np.append(np.flatnonzero(np.diff(starts // ROW_PAIRS, prepend=-1)), len(starts)).tolist()
        found = []
        for low, high in zip(cuts, cuts[1:]):
            row = [block, word[starts[low:high]].astype("<i4").tobytes()]
            for bounds, beside, often in sides:
                part = slice(bounds[low], bounds[high])
                kind = np.min_scalar_type(often[part].max(initial=0))
                row += [(bounds[low + 1 : high + 1] - bounds[low]).astype("<i4").tobytes(), beside[part].astype("<i4").tobytes()]
                row.append(often[part].astype(kind).tobytes())
            found.append(row)
        columns = [pa.array(c, k) for c, k in zip(zip(*found), (pa.int32(), *[pa.binary()] * 7), strict=True)]
        return pa.Table.from_arrays(columns, ["block", *AFTER, *BEFORE])

    found = lines.select("trained", "ends", "line").mapInArrow(count, "block int, keys binary, n binary")
    columns = ", ".join(f"{c} binary" for c in (*AFTER, *BEFORE))
    return stored(found.groupBy("block").applyInArrow(merge, f"block int, {columns}"), "lm-pairs")


def _beside(ends: pa.Scalar, other: pa.Scalar, n: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where each word's neighbours end, neighbours, their counts) on one side, in a row of ``pairs_of``."""
    ends, other = (np.frombuffer(part.as_buffer(), "<i4") for part in (ends, other))
    width = len(n.as_buffer()) // max(len(other), 1)
    return ends, other, np.frombuffer(n.as_buffer(), f"<u{width or 1}")


def _xlogx(values: np.ndarray) -> np.ndarray:
    return values * np.log(np.maximum(values, 1.0))


def likelihood(matrix: np.ndarray) -> float:
    """Log-likelihood of class bigrams, up to what no exchange changes."""
    return float(_xlogx(matrix).sum() - _xlogx(matrix.sum(1)).sum() - _xlogx(matrix.sum(0)).sum())


def best_move(matrix: np.ndarray, own: int, after: np.ndarray, before: np.ndarray, self_pairs: float) -> tuple[int, float]:
    """(class, gain) of a word's best class among the learnt ones.

    ``after`` and ``before`` count the classes next to the word, its own included;
    ``self_pairs`` how often it stands next to itself.
    """
    without = matrix.copy()
    without[own] -= after
    without[:, own] -= before
    without[own, own] += self_pairs
    after, before = after.copy(), before.copy()
    after[own] -= self_pairs
    before[own] -= self_pairs
    # Pairs with the word count in their other class's sum wherever the word goes.
    rows, columns = without.sum(1) + before, without.sum(0) + after
    here = np.arange(len(matrix) - SHAPES - 1)
    # Joining class b changes row b and column b; their crossing holds both and the pairs
    # of the word with itself.
    total_after, total_before = after.sum() + self_pairs, before.sum() + self_pairs
    row_gain = _xlogx(without[here] + after) - _xlogx(without[here])
    column_gain = _xlogx(without[:, here].T + before) - _xlogx(without[:, here].T)
    crossing = without[here, here]
    gain = row_gain.sum(1) + column_gain.sum(1)
    gain -= row_gain[here, here] + column_gain[here, here]
    gain += _xlogx(crossing + after[here] + before[here] + self_pairs) - _xlogx(crossing)
    gain -= _xlogx(rows[here] + total_after) - _xlogx(rows[here])
    gain -= _xlogx(columns[here] + total_before) - _xlogx(columns[here])
    best = int(gain.argmax())
    return best, float(gain[best] - gain[own])


def class_matrix(pairs: DataFrame, classes: np.ndarray) -> np.ndarray:
    """Counts of neighbouring classes; ``classes`` is by unit, the end's is the last."""
    return _matrices(pairs, classes, np.zeros(0, np.int32), np.zeros(0, np.int32), [0])[0]


def _moved(classes: np.ndarray, words: np.ndarray, new: np.ndarray) -> np.ndarray:
    classes = classes.copy()
    classes[words] = new
    return classes


def _matrices(pairs: DataFrame, classes: np.ndarray, words: np.ndarray, new: np.ndarray, firsts: list[int]) -> list[np.ndarray]:
    """The class matrix after so many first moves, for each number of them in one reading."""
    size, many = int(classes[-1]) + 1, len(firsts)
    shared = pairs.sparkSession.sparkContext.broadcast((classes, words, new))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, words, new = shared.value
        trials = [_moved(classes, words[:k], new[:k]) for k in firsts]
        cells = np.zeros((many, size * size))
        for batch in batches:
            for word, *side in zip(*(batch.column(c) for c in AFTER), strict=True):
                word, (ends, other, n) = np.frombuffer(word.as_buffer(), "<i4"), _beside(*side)
                times, often = np.diff(ends, prepend=0), n.astype(np.float64)
                for trial, counts in zip(trials, cells):
                    first = np.repeat(trial[word].astype(np.int64) * size, times)
                    counts += np.bincount(first + trial[other], often, size * size)
        cells = cells.astype("<i8").reshape(many * size, size)
        seen = np.flatnonzero(cells.any(1))
        columns = [pa.array(seen.astype(np.int32)), pa.array([cells[c].tobytes() for c in seen], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["first", "cells"])

    def add(table: pa.Table) -> pa.Table:
        cells = sum(np.frombuffer(c.as_buffer(), "<i8") for c in table.column("cells"))
        return pa.Table.from_arrays([table.column("first").slice(0, 1), pa.array([cells.tobytes()], pa.binary())], ["first", "cells"])

    schema = "first int, cells binary"
    found = pairs.select(*AFTER).mapInArrow(run, schema).groupBy("first").applyInArrow(add, schema).toArrow()
    matrices = np.zeros((many * size, size))
    for first, cells in zip(found["first"].to_pylist(), found["cells"].to_pylist()):
        matrices[first] = np.frombuffer(cells, "<i8")
    return list(matrices.reshape(many, size, size))


def _rise(values: np.ndarray, more: np.ndarray) -> np.ndarray:
    return _xlogx(values + more) - _xlogx(values)


def _cells(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of what is not zero."""
    return np.divmod(np.flatnonzero(counts), counts.shape[1])


class Gains:
    """What ``best_move`` finds, for many words at once.

    A word meets few classes, and most words are rare: logarithms are taken of the cells
    that a word changes, and for small counts looked up.
    """

    def __init__(self, matrix: np.ndarray):
        self.matrix, self.size = matrix, len(matrix)
        self.learnt = self.size - SHAPES - 1
        # By side, count and class beside the word: what learnt classes gain by small counts.
        self.sides = np.concatenate([matrix[: self.learnt].T, matrix[:, : self.learnt]])
        self.logs = _xlogx(self.sides)
        rises = [_xlogx(self.sides + k) - self.logs for k in range(1, SMALL + 1)]
        self.small = np.stack(rises).reshape(SMALL, 2, self.size, self.learnt).swapaxes(0, 1).reshape(-1, self.learnt)
        self.rows, self.columns = matrix.sum(1), matrix.sum(0)

    def _spread(self, row: np.ndarray, side: np.ndarray, beside: np.ndarray, n: np.ndarray, words: int) -> np.ndarray:
        """Gains by the classes beside the words, a cell for each word, side and class."""
        few = n <= SMALL
        of, place = row[few], (side[few] * SMALL + n[few].astype(np.int64) - 1) * self.size + beside[few]
        # The first cells of all words, then the second ones; words with most cells first.
        often = np.bincount(of, minlength=words)
        order = np.argsort(-often, kind="stable")
        rank = np.empty(words, np.int64)
        rank[order] = np.arange(words)
        by_row = np.argsort(of, kind="stable")
        turn = np.empty(len(of), np.int64)
        turn[by_row] = np.arange(len(of)) - np.repeat(np.cumsum(often) - often, often)
        place = place[np.argsort(turn * words + rank[of], kind="stable")]
        ranked, rises, start = np.zeros((words, self.learnt)), np.empty((words, self.learnt)), 0
        for many in np.bincount(turn).tolist():
            np.take(self.small, place[start : start + many], axis=0, out=rises[:many], mode="clip")
            ranked[:many] += rises[:many]
            start += many
        gain = ranked[rank]
        rest = np.flatnonzero(~few)
        rest = rest[np.argsort(row[rest], kind="stable")]
        for start in range(0, len(rest), _CELLS):
            part = rest[start : start + _CELLS]
            at, own = side[part] * self.size + beside[part], row[part]
            rises = _xlogx(self.sides[at] + n[part, None]) - self.logs[at]
            begins = np.flatnonzero(np.diff(own, prepend=-1))
            gain[own[begins]] += np.add.reduceat(rises, begins)
        return gain

    def _totals(self, sums: np.ndarray, totals: np.ndarray) -> np.ndarray:
        """Rises of the learnt classes' sums, computed once for each total."""
        found, place = np.unique(totals, return_inverse=True)
        return _rise(sums[: self.learnt], found[:, None])[place]

    def best(self, own: np.ndarray, after: np.ndarray, before: np.ndarray, self_pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, gain) by word; counts have a row for each word."""
        matrix, learnt, at = self.matrix, self.learnt, np.arange(len(own))
        s, total_a, total_b = self_pairs, after.sum(1), before.sum(1)
        own_a, own_b = after[at, own], before[at, own]
        (row_a, side_a), (row_b, side_b) = _cells(after), _cells(before)
        n_a, n_b = after[row_a, side_a], before[row_b, side_b]
        both = [np.concatenate(c) for c in ((row_a, row_b), (side_a, side_b), (n_a, n_b))]
        gain = self._spread(both[0], np.repeat([0, 1], [len(row_a), len(row_b)]), both[1], both[2], len(own))
        # Pairs with the word's own class do not hold the word itself.
        for counts, other, to in ((own_a, before, matrix.T), (own_b, after, matrix)):
            if (some := np.flatnonzero(counts)).size:
                cells, n = to[own[some], :learnt], counts[some, None]
                gain[some] += _rise(cells - other[some, :learnt], n - s[some, None]) - _rise(cells, n)
        # Crossings, where the word meets the class itself.
        with_itself = (np.flatnonzero(s)[:, None] * self.size + np.arange(learnt)).ravel()
        met = np.unique(np.concatenate([row_a * self.size + side_a, row_b * self.size + side_b, with_itself]))
        met_row, met = np.divmod(met, self.size)
        met_row, met = met_row[met < learnt], met[met < learnt]
        a, b, cross = after[met_row, met], before[met_row, met], matrix[met, met]
        gain[met_row, met] += _rise(cross, a + b + s[met_row]) - _rise(cross, a) - _rise(cross, b)
        gain -= self._totals(self.rows, total_a) + self._totals(self.columns, total_b)
        # The gain of going back.
        stay = np.zeros(len(own))
        for row, side, n, cells in ((row_a, side_a, n_a, matrix), (row_b, side_b, n_b, matrix.T)):
            cell = cells[own[row], side]
            lost = np.where(side == own[row], 0.0, _xlogx(cell) - _xlogx(cell - n))
            stay += np.bincount(row, lost, len(own))
        stay -= _rise(self.rows[own] - total_a, total_a) + _rise(self.columns[own] - total_b, total_b)
        both = own_a + own_b - s
        stay += _rise(matrix[own, own] - both, both)
        gain[at, own] = stay
        best = gain.argmax(1)
        return best, gain[at, best] - stay


def _proposals(pairs: DataFrame, classes: np.ndarray, matrix: np.ndarray, exchanged: int, part: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, classes) of every second word that gains by a move, the greatest gain first."""
    shared = pairs.sparkSession.sparkContext.broadcast((classes, matrix))
    size = len(matrix)

    def counts(side: tuple[np.ndarray, ...], start: int, stop: int, classes: np.ndarray) -> tuple[np.ndarray, ...]:
        """(counts by word and class beside it, words of the neighbours, neighbours, their counts)."""
        ends, other, n = side
        low = ends[start - 1] if start else 0
        row = np.repeat(np.arange(stop - start), np.diff(ends[start:stop], prepend=low))
        beside, often = other[low : ends[stop - 1]], n[low : ends[stop - 1]]
        found = np.bincount(row * size + classes[beside], often, (stop - start) * size)
        return found.reshape(-1, size), row, beside, often

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (classes, matrix), gains = shared.value, None
        for batch in batches:
            for word, *sides in zip(*(batch.column(c) for c in (*AFTER, *BEFORE)), strict=True):
                gains = gains or Gains(matrix)
                word, sides = np.frombuffer(word.as_buffer(), "<i4"), (_beside(*sides[:3]), _beside(*sides[3:]))
                # Units without a choice come last.
                last = int(np.searchsorted(word, exchanged))
                for start in range(0, last, BLOCK):
                    stop = min(start + BLOCK, last)
                    some = word[start:stop]
                    after, row, beside, often = counts(sides[0], start, stop, classes)
                    self_pairs = np.bincount(row, often * (beside == some[row]), len(some))
                    best, gain = gains.best(classes[some], after, counts(sides[1], start, stop, classes)[0], self_pairs)
                    good = (best != classes[some]) & (gain > 1e-6)
                    columns = [pa.array(gain[good]), pa.array(some[good]), pa.array(best[good].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, ["gain", "word", "class"])

    half = pairs.filter(F.col("block") % 2 == part).select(*AFTER, *BEFORE)
    found = half.mapInArrow(run, "gain double, word int, class int").toArrow()
    gain, word, new = (found[c].to_numpy() for c in ("gain", "word", "class"))
    order = np.lexsort((word, -gain))
    return word[order], new[order]


def exchange(pairs: DataFrame, known: Vocabulary, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(class by unit, class matrix) after clustering; the likelihood never falls.

    The driver holds an integer for each clustered word and the class matrix.
    """
    learnt = class_count(known.exchanged)
    classes = np.concatenate([np.arange(known.exchanged) % learnt, learnt + np.arange(SHAPES + 1)]).astype(np.int32)
    matrix = class_matrix(pairs, classes)
    idle = 0
    for number in range(rounds):
        words, new = _proposals(pairs, classes, matrix, known.exchanged, number % 2)
        # Moves that are good one by one may spoil each other; then a quarter is made, the best
        # ones. The best one alone gains what was foretold.
        tries, kept = [len(words)] if len(words) else [], False
        while tries and tries[-1] > 1:
            tries.append(max(tries[-1] // 4, 1))
        at, step = 0, 1
        while at < len(tries) and not kept:
            firsts = tries[at : at + step]
            for moves, then in zip(firsts, _matrices(pairs, classes, words, new, firsts)):
                if likelihood(then) > likelihood(matrix):
                    classes, matrix, kept = _moved(classes, words[:moves], new[:moves]), then, True
                    break
            at, step = at + step, TRIALS
        idle = 0 if kept else idle + 1
        if idle == 2:
            break
    return classes, matrix


@dataclass(frozen=True)
class ClassModel:
    known: Vocabulary
    classes: np.ndarray
    matrix: np.ndarray

    def tables(self) -> dict[str, np.ndarray]:
        """log10 tables by class pair and by word number (known, then shapes, then the end)."""
        known, size = self.known, len(self.matrix)
        own = self.matrix.sum(0)
        share = (own + 1) / (own.sum() + size)
        steps = (self.matrix + PRIOR * share) / (self.matrix.sum(1, keepdims=True) + PRIOR)
        unit = np.concatenate([known.units(), known.exchanged + np.arange(SHAPES + 1)])
        class_of = self.classes[unit]
        head = np.arange(min(known.exchanged, len(known.words)))
        # Every token is the second of one pair.
        class_tokens = self.matrix.sum(0)
        emission = np.zeros(len(unit))
        emission[head] = np.log10(known.counts[head] / class_tokens[self.classes[head]])
        # Within a shape: (count + 1) of all its seen words and one unseen.
        rest = -np.log10(known.shape_tokens + known.shape_types + 1)
        seen = np.log10(known.counts + 1.0)
        tail = np.arange(len(head), len(known.words))
        emission[tail] = seen[tail] + rest[known.shapes[tail]]
        shapes = len(known.words) + np.arange(SHAPES)
        emission[shapes] = rest
        count = np.zeros(len(unit))
        count[: len(known.words)] = seen
        return {
            "steps": np.log10(steps),
            "class": class_of,
            "emission": emission,
            "count": count,
            "tokens": np.log10(np.maximum(class_tokens, 1.0)),
        }


def learn_words(docs: DataFrame, text: str = "text") -> tuple[Vocabulary, DataFrame]:
    """(vocabulary, all word counts)."""
    words = stored(word_counts(docs, text), "lm-words")
    known, counts = vocabulary(words)
    if hasattr(counts, "_stored_at"):
        free(words)
    return known, counts


def learn_classes(lines: DataFrame, known: Vocabulary) -> ClassModel:
    """The model of the texts to learn from, as ``coded``."""
    pairs = pairs_of(lines, known)
    model = ClassModel(known, *exchange(pairs, known))
    free(pairs)
    return model


def train(docs: DataFrame, text: str = "text") -> tuple[ClassModel, DataFrame]:
    """(model, all word counts). An empty table gives a model that has seen nothing."""
    known, counts = learn_words(docs, text)
    lines = coded(docs, known, counts, F.lit(0), F.lit(True), text)
    model = learn_classes(lines, known)
    free(lines)
    return model, counts


# What ``score`` adds to kept columns.
RESULTS = ("n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def _kept(keep: list[str]) -> Column:
    return F.struct(*[c for c in keep if c not in RESULTS])


def score(docs: DataFrame, model: ClassModel, counts: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Kept columns, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``, ``perplexity``.

    Scores are log10 probabilities of whole texts with their end token; ``base_score`` is
    the add-one unigram model's. NULL and empty texts are the end token alone. Repeated
    rows stay; kept columns named like a result give way to it.
    """
    return scores_of(coded(docs, model.known, counts, _kept(keep), F.lit(True), text), model)


def scores_of(lines: DataFrame, model: ClassModel) -> DataFrame:
    """What ``score`` returns, of texts as ``coded``."""
    known, tables, exchanged = model.known, model.tables(), model.known.exchanged
    rest = tables["emission"][len(known.words) : len(known.words) + SHAPES]
    shared = lines.sparkSession.sparkContext.broadcast(
        (known.shapes.astype(np.int8), known.levels, known.starts, model.classes, tables["steps"], tables["tokens"], rest)
    )
    ends_seen, boundary = 1 if known.tokens else 0, known.boundary
    # The end token is counted in every training text.
    end_count = math.log10(model.matrix[:, -1].sum() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes, levels, starts, classes, steps, tokens, rest = shared.value
        for batch in batches:
            for row, ends, line in zip(*(batch.column(c) for c in ("row", "ends", "line")), strict=True):
                ends = np.frombuffer(ends.as_buffer(), "<i4").astype(np.int64)
                line = np.frombuffer(line.as_buffer(), "<i4")
                units = _units_of(line, exchanged, shapes)
                n = -1 - line.astype(np.int64) >> 4
                numbered = np.flatnonzero(line >= 0)
                if numbered.size:
                    n[numbered] = levels[np.searchsorted(starts, line[numbered], "right") - 1]
                count = np.log10(n + 1.0)
                # Within a shape: (count + 1) of all its seen words and one unseen.
                emitted, own = np.empty(len(line)), units < exchanged
                emitted[own] = np.log10(n[own]) - tokens[classes[units[own]]]
                emitted[~own] = count[~own] + rest[units[~own] - exchanged]
                whole = classes[_between_ends(units, ends, boundary)]
                step = steps[whole[:-1], whole[1:]]
                begins = np.append(0, ends[:-1])
                of = np.repeat(np.arange(len(ends)), ends - begins)
                total = np.add.reduceat(step, begins + np.arange(len(ends))) + np.bincount(of, emitted, len(ends))
                columns = [
                    row.values,
                    pa.array(ends - begins + 1),
                    pa.array(np.bincount(of, n > 0, len(ends)).astype(np.int64) + ends_seen),
                    pa.array(np.bincount(of, count, len(ends)) + end_count),
                    pa.array(total),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["row", "n_tokens", "n_known", "base", "total"])

    row_type = lines.schema["row"].dataType.elementType.simpleString()
    schema = f"row {row_type}, n_tokens bigint, n_known bigint, base double, total double"
    total = F.col("total")
    return lines.select("row", "ends", "line").mapInArrow(run, schema).select(
        "row.*",
        "n_tokens",
        "n_known",
        F.lit(known.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * math.log10(known.tokens + known.types + 1)).alias("base_score"),
        total.alias("score"),
        F.pow(F.lit(10.0), -total / F.col("n_tokens")).alias("perplexity"),
    )


def held_out(key: Column) -> Column:
    """Whether a document is kept from training; one without an id is not."""
    return F.coalesce(crc_fold(key, FOLDS) == HELD_OUT, F.lit(False))


def op10_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    trained = ~held_out(F.col("doc_id"))
    known, counts = learn_words(docs.filter(trained))
    lines = coded(docs, known, counts, _kept(["doc_id"]), trained)
    found = scores_of(lines, learn_classes(lines, known))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), *found.columns[1:])
