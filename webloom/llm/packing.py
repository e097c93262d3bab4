"""Best-fit packing with large-item matching.

Documents become token ids; only those longer than the capacity are cut. The packing
needs nothing but the number of pieces of each length, a histogram of at most
``capacity`` entries whatever the size of the corpus. On it ``plan`` computes a
best-fit-decreasing packing of runs of equal pieces: pieces over a third of the
capacity are matched greedily, each bin taking at most two of them (the largest with
the largest that still fits); smaller ones, largest first, go to the tightest gap that
takes them. Each step of the plan covers a range of ranks among the pieces of one
length, so a piece finds its place from (length, rank) alone, without a shuffle of
bins. Ranks come from counts per (length, salt) and a rank inside of each salt; a length
has as many salts as its pieces need, so that no task gets all pieces of one length.

Defined results: a null or empty text is its end token alone; repeated rows get pieces
of their own; ties are broken by id and piece; an empty table gives no pieces.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.common import checkpointed, mixed, tidy

PIECES = "id {id}, piece int, start long, length long, ids_crc32 long"
#: Characters that the pattern of the tokenizer keeps together and that no contraction or letter touches.
_MARKS = b".,;:!?*&%$#|<>()[]{}-_=+/\\\"@~^`"


#: Bytes of a word that its key holds, and masks of the first 0 to 8 bytes of a little-endian number.
_SHORT = 15
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_LETTER = np.array([bytes([c]).isalpha() for c in range(256)])
#: Latin-1 letters beyond ASCII, each C3 and another byte in UTF-8; what the normaliser and the byte-level step make of them.
_LATIN = "".join(c for c in map(chr, range(0xC0, 0x100)) if c.isalpha())
_SECOND = np.isin(np.arange(256), [c.encode()[1] for c in _LATIN])
_LATIN_WORD = re.compile(rb"(?:[a-z]|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF])+")


def _byte_level() -> dict[int, str]:
    """Bytes as the characters by which byte-level vocabularies name them: printable Latin-1 ones themselves, the others from U+0100 on."""
    named = {b: chr(b) for b in range(256) if 33 <= b < 127 or 161 <= b < 256 and b != 173}
    named |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in named)}
    return str.maketrans({c: "".join(named[b] for b in c.lower().encode()) for c in _LATIN})


_BYTE_LEVEL = _byte_level()


def _ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``values[start : start + length]`` of each start and length, one after the other."""
    ends = np.cumsum(lengths, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(values)) < 2**31 else np.int64
    at = np.repeat((starts - ends + lengths).astype(kind), lengths)
    at += np.arange(total, dtype=kind)
    return values[at]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists one after the other, and their lengths."""
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), "<u4", int(lengths.sum())), lengths


class _Words:
    """The words of a buffer, each by its start and length; ``low`` and ``high`` are a key that tells words of at most 15 bytes apart."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        self.raw, self.starts, self.lengths = raw, starts, lengths
        padded = np.zeros(len(raw) + 16, np.uint8)
        padded[: len(raw)] = raw
        eight = np.ndarray(len(raw) + 9, "<u8", padded, strides=(1,))  # the eight bytes from each place on
        self.low = eight[starts] & _FIRST[np.minimum(lengths, 8)]
        self.high = eight[starts + 8] & _FIRST[np.clip(lengths - 8, 0, 7)] | lengths.astype(np.uint64) << np.uint64(56)
        self.long = np.flatnonzero(lengths > _SHORT)

    def bytes(self, at: np.ndarray) -> list[bytes]:
        raw, starts = self.raw.tobytes(), self.starts[at]
        return [raw[a:b] for a, b in zip(starts.tolist(), (starts + self.lengths[at]).tolist(), strict=True)]


class _Table:
    """Ids of words, in arrays: an open hash table of rows by key, a dict for the few words that a key does not hold.

    Row 0 is the empty word, without ids. ``weight`` is the number of rows, where longer words count for more.
    """

    def __init__(self) -> None:
        self.slots = np.full(1 << 12, -1, np.int32)
        self.low, self.high, self.starts, self.lengths = (np.zeros(1, t) for t in (np.uint64, np.uint64, np.int64, np.int32))
        self.ids = np.zeros(0, "<u4")
        self.rows, self.used, self.long_bytes = 1, 0, 0
        self.long: dict[bytes, int] = {}
        self._place(0, 1)

    @property
    def weight(self) -> int:
        return self.rows + self.used // 16 + self.long_bytes // 64

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (mixed(low ^ high * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def _place(self, first: int, stop: int) -> None:
        """Put rows, of keys that are not there, into free slots."""
        rows = first + np.flatnonzero(self.high[first:stop] >> np.uint64(56) <= np.uint64(_SHORT)).astype(np.int32)
        slot = self._slot(self.low[rows], self.high[rows])
        while len(rows):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = rows[free]  # of several rows one stays
            lost = self.slots[slot] != rows
            rows, slot = rows[lost], slot[lost] + 1 & len(self.slots) - 1

    def find(self, words: _Words, at: np.ndarray | None = None) -> np.ndarray:
        """The row of each word (of those ``at``), -1 where there is none."""
        low, high = (words.low, words.high) if at is None else (words.low[at], words.high[at])
        out = np.full(len(low), -1, np.int64)
        is_long = words.lengths > _SHORT if at is None else words.lengths[at] > _SHORT
        todo = np.flatnonzero(~is_long)
        slot = self._slot(low[todo], high[todo])
        while len(todo):
            row = self.slots[slot]
            same = (self.low[row] == low[todo]) & (self.high[row] == high[todo]) & (row >= 0)
            out[todo[same]] = row[same]
            on = ~same & (row >= 0)
            todo, slot = todo[on], slot[on] + 1 & len(self.slots) - 1
        some = np.flatnonzero(is_long)
        if len(some):
            out[some] = [self.long.get(w, -1) for w in words.bytes(some if at is None else at[some])]
        return out

    def add(self, words: _Words, at: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Distinct words, not there yet, with their ids one after the other."""
        first, stop, used = self.rows, self.rows + len(at), self.used + len(ids)
        if stop > len(self.low):
            for name in ("low", "high", "starts", "lengths"):
                setattr(self, name, np.resize(getattr(self, name), stop + stop // 4))
        if used > len(self.ids):
            self.ids = np.resize(self.ids, used + used // 4)
        self.low[first:stop], self.high[first:stop], self.lengths[first:stop] = words.low[at], words.high[at], lengths
        self.starts[first:stop] = self.used + np.cumsum(lengths) - lengths
        self.ids[self.used : used] = ids
        self.rows, self.used = stop, used
        some = np.flatnonzero(words.lengths[at] > _SHORT)
        self.high[first + some] = np.uint64(255 << 56)
        self.long.update(zip(words.bytes(at[some]), (first + some).tolist(), strict=True))
        self.long_bytes += int(words.lengths[at[some]].sum())
        if 2 * stop > len(self.slots):
            self.slots = np.full(1 << (3 * stop).bit_length(), -1, np.int32)
            first = 0
        for a in range(first, stop, 50_000):
            self._place(a, min(a + 50_000, stop))

    def ids_of(self, rows: np.ndarray) -> np.ndarray:
        return _ragged(self.ids, self.starts[rows], self.lengths[rows])


class Encoder:
    """Token ids by a cache of words.

    The tokenizer's normaliser folds white space and its pattern never crosses it, so a text's ids are those of its
    white-space separated chunks in order; ASCII lower-casing before is what the normaliser does anyway. A chunk of
    letters followed by marks is two words, as the pattern splits it there; many words of letters are encoded in one
    call, as the token that ends each is one with the word-end suffix. Latin-1 letters need no pattern and a normaliser
    that is a table; they go to the bare model, if that agrees with the tokenizer on a probe. Words are looked up by NumPy
    for a slice of texts at once; only those that are new become Python objects.

    The cache has two generations: when the young one would hold more than ``keep`` words it becomes the old one, whose
    words come back as they are met again.
    """

    def __init__(self, path: str, keep: int = 350_000, slice_bytes: int = 2_000_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.keep, self.slice_bytes = Tokenizer.from_file(path), keep, slice_bytes
        self.young, self.old = _Table(), None
        self.model = self.tokenizer.model
        probe = f"the quick unbelievably s t re ve m ll d xqzvkjw a internationalisation école größe español {_LATIN} {' '.join(_LATIN)}".split(" ")
        self.bare = next(self._bare([w.encode() for w in probe]))[0].tolist() == self.tokenizer.encode(" ".join(probe), add_special_tokens=False).ids
        vocabulary = self.tokenizer.get_vocab()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = bool(suffix) and token.endswith(suffix)

    def _each(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        return _flat(ids)

    def _bare(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, len(words), 2000):
            joined = b" ".join(words[at : at + 2000]).decode()
            named = (joined if joined.isascii() else joined.translate(_BYTE_LEVEL)).split(" ")
            yield _flat([[t.id for t in self.model.tokenize(w)] for w in named])

    def _letters(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, len(words), 2000):
            some = words[at : at + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            yield (ids, np.diff(ends, prepend=0)) if len(ends) == len(some) else self._each(some)  # a vocabulary without word ends

    def _learn(self, words: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """An order of the words, their ids in this order, and how many each has."""
        plain, latin, letters, other = [], [], [], []
        for i, w in enumerate(words):
            if w.isalpha():  # bytes: of ASCII letters
                (plain if self.bare else letters).append(i)
            elif self.bare and _LATIN_WORD.fullmatch(w):
                latin.append(i)
            else:
                (letters if not w.isascii() and w.decode().lower().isalpha() else other).append(i)
        found = [*self._bare([words[i] for i in plain]), *self._bare([words[i] for i in latin])]
        found += [*self._letters([words[i] for i in letters]), self._each([words[i] for i in other])]
        return plain + latin + letters + other, np.concatenate([ids for ids, _ in found]), np.concatenate([n for _, n in found])

    def _rows(self, words: _Words) -> np.ndarray:
        """Rows of the words in the young generation, learnt where they are not known."""
        rows = self.young.find(words)
        missing = np.flatnonzero(rows < 0)
        if not len(missing):
            return rows
        first: dict[bytes, int] = {}
        for i, w in zip(missing.tolist(), words.bytes(missing), strict=True):
            first.setdefault(w, i)
        if self.young.weight + len(first) > self.keep and self.young.rows > 1:
            self.old, self.young = self.young, _Table()
            return self._rows(words)
        at, new = np.fromiter(first.values(), np.int64, len(first)), list(first)
        if self.old is not None:
            again = self.old.find(words, at)
            known = again >= 0
            self.young.add(words, at[known], self.old.ids_of(again[known]), self.old.lengths[again[known]])
            at, new = at[~known], [new[i] for i in np.flatnonzero(~known).tolist()]
        if new:
            order, ids, lengths = self._learn(new)
            self.young.add(words, at[order], ids, lengths)
        rows[missing] = self.young.find(words, missing)
        return rows

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks, one after the other, and how many each has."""
        if not len(chunks):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        _, edges, raw = chunks.buffers()
        edges = np.frombuffer(edges, np.int32)[chunks.offset : chunks.offset + len(chunks) + 1].astype(np.int64)
        raw = np.frombuffer(raw, np.uint8)[: edges[-1]] if edges[-1] else np.zeros(0, np.uint8)
        cores = pc.ascii_rtrim(chunks, _MARKS.decode())
        starts, size = edges[:-1], np.diff(edges)
        core = pc.binary_length(cores).to_numpy(zero_copy_only=False).astype(np.int64)
        letter = _LETTER[raw]
        latin = np.flatnonzero((raw[:-1] == 0xC3) & _SECOND[raw[1:]])
        letter[latin] = letter[latin + 1] = True
        other, high = (np.r_[0, np.cumsum(x, dtype=np.int64)] for x in (~letter, ~letter & (raw >= 128)))
        letters = (core > 0) & (other[starts + core] == other[starts])
        beyond = np.flatnonzero(high[starts + core] > high[starts])  # Latin-1
        letters[beyond] = [c.lower().isalpha() for c in cores.take(pa.array(beyond)).to_numpy(zero_copy_only=False)]
        head = np.where(letters, core, size)
        two = np.flatnonzero(head < size)
        rows = np.zeros((len(chunks), 2), np.int64)  # the second one: of the empty word
        found = self._rows(_Words(raw, np.r_[starts, (starts + head)[two]], np.r_[head, (size - head)[two]]))
        rows[:, 0], rows[two, 1] = found[: len(chunks)], found[len(chunks) :]
        return self.young.ids_of(rows.ravel()), self.young.lengths[rows].sum(1, dtype=np.int64)

    def encode(self, texts: pa.Array, end: int | None) -> Iterator[np.ndarray]:
        """Ids of each text (a string array; null: empty), with the id ``end`` after."""
        tail = np.array([] if end is None else [end], "<u4")
        size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(texts):  # a slice at a time; its distinct chunks are looked up once
            stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + self.slice_bytes)))
            lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(at, stop - at)))
            coded = lists.flatten().dictionary_encode()
            flat, lengths = self._chunks(coded.dictionary)
            starts = np.cumsum(lengths) - lengths
            codes = coded.indices.to_numpy()
            n = lengths[codes]
            ids = _ragged(flat, starts[codes], n)
            of_text = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            edges = np.r_[0, np.cumsum(n)][np.r_[0, of_text]].tolist()
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                yield np.concatenate([ids[a:b], tail])
            at = stop


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process, so that tasks share its cache."""
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(encoder(tokenizer).encode(b.column(1).cast(pa.string()), end)):
                for k, s in enumerate(range(0, len(ids), capacity)):
                    part = ids[s : s + capacity]
                    at.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(len(part))
                    crc.append(zlib.crc32(part))
            arrays = [b.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "piece", "start", "length", "ids_crc32"])
        encoder(tokenizer).old = None  # what the next task begins with is the young generation

    return rows.mapInArrow(tidy(run), PIECES.format(id=rows.schema["id"].dataType.simpleString()))


class Step(NamedTuple):
    """Pieces ``rank`` to ``rank + count`` (exclusive) of a length: ``per`` in each bin from ``bin`` on, from ``offset`` on."""

    length: int
    rank: int
    count: int
    bin: int
    per: int
    offset: int


class _Gaps:
    """Runs of equal bins (first bin, number) by their free room."""

    def __init__(self) -> None:
        self.rooms: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def put(self, room: int, first: int, n: int) -> None:
        if n and room:
            if room not in self.runs:
                insort(self.rooms, room)
                self.runs[room] = []
            self.runs[room].append((first, n))

    def tightest(self, length: int) -> tuple[int, int, int] | None:
        """Take out a run of bins with the least room that holds ``length``."""
        i = bisect_left(self.rooms, length)
        if i == len(self.rooms):
            return None
        room = self.rooms[i]
        first, n = self.runs[room].pop()
        if not self.runs[room]:
            del self.runs[room], self.rooms[i]
        return room, first, n


def plan(counts: dict[int, int], capacity: int) -> tuple[list[Step], int]:
    """Steps that place ``counts[length]`` pieces of each length, and the number of bins."""
    steps: list[Step] = []
    gaps, bins = _Gaps(), 0
    done = dict.fromkeys(counts, 0)

    def place(length: int, count: int, first: int, per: int, offset: int) -> None:
        steps.append(Step(length, done[length], count, first, per, offset))
        done[length] += count

    large = sorted((n for n in counts if 3 * n > capacity and counts[n]), reverse=True)
    left = {n: counts[n] for n in large}
    ascending = large[::-1]
    for a in large:
        while left[a]:
            i = bisect_left(ascending, capacity - a + 1) - 1
            while i >= 0 and left[ascending[i]] <= (ascending[i] == a):
                if not left[ascending[i]]:  # used up: fits no one later either
                    del ascending[i]
                i -= 1
            b = ascending[i] if i >= 0 else None
            if b is None:
                n = left[a]
                place(a, n, bins, 1, 0)
                gaps.put(capacity - a, bins, n)
                left[a] = 0
            elif b == a:
                n = left[a] // 2
                place(a, 2 * n, bins, 2, 0)
                gaps.put(capacity - 2 * a, bins, n)
                left[a] -= 2 * n
            else:
                n = min(left[a], left[b])
                place(a, n, bins, 1, 0)
                place(b, n, bins, 1, a)
                gaps.put(capacity - a - b, bins, n)
                left[a] -= n
                left[b] -= n
            bins += n
    for length in sorted((n for n in counts if 3 * n <= capacity and counts[n]), reverse=True):
        todo = counts[length]
        while todo:
            found = gaps.tightest(length)
            if found is None:
                room, first = capacity, bins
                n = -(-todo // (room // length))
                bins += n
            else:
                room, first, n = found
            per, offset = room // length, capacity - room
            full = min(n, todo // per)
            if full:
                place(length, full * per, first, per, offset)
                gaps.put(room - per * length, first, full)
                todo -= full * per
            rest = 0
            if full < n and todo:
                rest = 1
                place(length, todo, first + full, todo, offset)
                gaps.put(room - todo * length, first + full, 1)
                todo = 0
            gaps.put(room, first + full + rest, n - full - rest)
    return steps, bins


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end: int | None = 1, id_col: str = "doc_id", text_col: str = "text", per_salt: int = 50_000) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset. About ``per_salt`` pieces of one length are ranked together."""
    spark = docs.sparkSession
    unsalted = checkpointed(pieces(docs, tokenizer, capacity, end, id_col, text_col))
    n = F.count("*")
    salts = F.greatest(F.ceil(n / per_salt), F.least(F.lit(64), F.ceil(n / 100))).cast("int")  # up to 64 for the spread, more by count
    by_length = unsalted.groupBy("length").agg(salts.alias("salts"))  # at most capacity rows
    rows = unsalted.join(F.broadcast(by_length), "length").withColumn("salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.col("salts"))).select(*unsalted.columns, "salt")
    histogram = rows.groupBy("length", "salt").agg(F.count("*").alias("n"))
    h = histogram.toArrow()  # at most 64 * capacity + pieces / per_salt rows
    length, salt, n = (h.column(c).to_numpy().astype(np.int64) for c in ("length", "salt", "n"))
    order = np.lexsort((salt, length))
    length, salt, n = length[order], salt[order], n[order]
    lengths, first = np.unique(length, return_index=True)
    total = np.cumsum(n)
    ends = np.r_[first[1:], len(n)] - 1 if len(n) else first
    upto = np.r_[0, total[ends]] if len(n) else np.zeros(1, np.int64)
    counts = dict(zip(lengths.tolist(), np.diff(upto).tolist(), strict=True))
    before = pa.table({"length": length, "salt": salt, "before": total - n - np.repeat(upto[:-1], np.diff(np.r_[first, len(n)]))})
    steps, _ = plan(counts, capacity)
    steps.sort()
    offsets = F.broadcast(spark.createDataFrame(before, "length long, salt long, before long"))
    inside = F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32", "start"))
    ranked = rows.withColumn("inside", inside).join(offsets, ["length", "salt"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("inside") - 1).alias("rank"))
    shared = spark.sparkContext.broadcast(np.array(steps, np.int64).reshape(len(steps), len(Step._fields)))  # a few steps for each length

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        step_key = (s[:, 0] << 48) | s[:, 1] if len(s) else s[:, 0]
        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            x = s[np.searchsorted(step_key, (length << 48) | rank, side="right") - 1]
            r = rank - x[:, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(x[:, 3] + r // x[:, 4]), pa.array(x[:, 5] + (r % x[:, 4]) * length)], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    schema = T.StructType([*ranked.schema.fields[:5], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(tidy(place), schema).withColumnRenamed("id", id_col)
