"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are partitioned by their number of shingles into classes whose sizes
differ by at most half. MinHash cannot see a short item in a whole long document (their
Jaccard similarity is next to nothing), so for each class the documents are cut into
overlapping windows in the class's own size, such that every stretch as long as an item
of the class lies in one window as a whole; a stretch that holds the threshold of an
item then has a similarity of 0.3 or more to its window, and with 32 permutations a
pair is missed with a probability of about 1e-5 at most. Each pair found is verified by
exact containment: the share of the item's distinct shingles that the whole document
holds.

The items are the query set. They are read in blocks of a bounded number of characters;
the index of a block is built once, on the driver, and broadcast, and the documents are
scanned once for each block; nothing of the documents is shuffled or gathered.

Defined results: null and empty texts hold nothing and are contained in nothing; an item
with fewer words than a shingle is contained only in a document of the same words;
repeated documents and items each get their own rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.common import WordHashes, shingles, text_bytes, tidy
from webloom.llm.licenses import license_words

#: Shingles of documents that are worked on at once.
CHUNK = 1_000_000


@dataclass
class Minima:
    """Sorted minima of items under one permutation, the items, and which leading bits occur among them."""

    values: np.ndarray
    items: np.ndarray
    shift: np.uint64
    known: np.ndarray

    @classmethod
    def of(cls, low: np.ndarray, members: np.ndarray) -> Minima:
        order = np.argsort(low)
        bits = min(18, max(12, len(low).bit_length() + 6))
        shift = np.uint64(64 - bits)
        known = np.zeros(1 << bits, bool)
        known[low >> shift] = True
        return cls(low[order], members[order], shift, known)

    def find(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, item) of the windows whose minimum is an item's."""
        place = np.flatnonzero(self.known[windows >> self.shift])  # few are left to be looked up
        left, right = np.searchsorted(self.values, windows[place], "left"), np.searchsorted(self.values, windows[place], "right")
        counts = right - left
        at = np.repeat(left - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        return np.repeat(place, counts), self.items[at]


@dataclass
class SizeClass:
    """Items of similar size: window stride and width in shingles, and their minima under each permutation."""

    stride: int  # a multiple of the least stride of all classes
    blocks: int  # strides in a window
    minima: list[Minima]


def permutations(n: int) -> np.ndarray:
    """Odd multipliers of the n permutations of 64-bit hashes."""
    return np.random.default_rng(20).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def size_classes(sets: list[np.ndarray], n_permutations: int) -> list[SizeClass]:
    """Partition item sets by size, and index the minima of each class."""
    by: dict[int, list[int]] = {}
    for i, s in enumerate(sets):
        if len(s):
            by.setdefault(int(np.log(len(s)) / np.log(1.5)), []).append(i)
    out = []
    least = min((max(1, min(len(sets[i]) for i in members) // 2) for members in by.values()), default=1)
    for members in by.values():
        sizes = [len(sets[i]) for i in members]
        stride = max(1, min(sizes) // 2 // least) * least
        minima = [Minima.of(np.array([(sets[i] * a).min() for i in members], np.uint64), np.array(members)) for a in permutations(n_permutations)]
        out.append(SizeClass(stride, -(-(max(sizes) + stride - 1) // stride), minima))
    return out


def candidates(low: np.ndarray, least: int, c: SizeClass, permutation: int) -> tuple[np.ndarray, np.ndarray]:
    """(window start, item) pairs of which the window's and the item's minimum agree; ``low`` holds the minima of the least strides."""
    if c.stride > least:
        low = np.minimum.reduceat(low, np.arange(0, len(low), c.stride // least))
    windows = low.copy()
    for step in range(1, c.blocks):
        if step < len(low):
            np.minimum(windows[:-step], low[step:], out=windows[:-step])
    place, items = c.minima[permutation].find(windows)
    return place * c.stride, items


class ItemIndex:
    """Item sets with their size classes; ``search`` finds the items that documents contain."""

    def __init__(self, words: list[list[bytes]], k: int, percent: int, n_permutations: int) -> None:
        hashes = WordHashes()
        self.k, self.percent, self.multipliers = k, percent, permutations(n_permutations)
        self.sets = [np.unique(shingles(hashes.array(w), k)) for w in words]
        self.classes = size_classes(self.sets, n_permutations)

    def search(self, documents: list[np.ndarray]) -> list[tuple[int, int, int]]:
        """(document, item, shared shingles) for documents given as shingles in text order."""
        flat = np.concatenate(documents) if documents else np.zeros(0, np.uint64)
        if not len(flat) or not self.classes:
            return []
        ends = np.cumsum([len(d) for d in documents])
        least = min(c.stride for c in self.classes)
        edges = np.arange(0, len(flat), least)
        found: set[tuple[int, int]] = set()
        for p, a in enumerate(self.multipliers):
            low = np.minimum.reduceat(flat * a, edges)
            for c in self.classes:
                starts, items = candidates(low, least, c, p)
                first = np.searchsorted(ends, starts, "right")
                last = np.searchsorted(ends, np.minimum(starts + c.stride * c.blocks, len(flat)) - 1, "right")
                for f, z, i in zip(first.tolist(), last.tolist(), items.tolist(), strict=True):
                    found.update((d, i) for d in range(f, z + 1))
        out = []
        for d, i in sorted(found):
            item = self.sets[i]
            shared = int(np.isin(item, documents[d]).sum())
            if shared and 100 * shared >= self.percent * len(item):
                out.append((d, i, shared))
        return out


def _search_block(docs: DataFrame, index_words: list[list[bytes]], item_ids: list, item_type: T.StructField, k: int, percent: int, n_permutations: int) -> DataFrame:
    shared_items = docs.sparkSession.sparkContext.broadcast((ItemIndex(index_words, k, percent, n_permutations), item_ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, ids = shared_items.value
        hashes = WordHashes()
        arrow_id = None

        def flush(held: list, documents: list[np.ndarray]) -> pa.RecordBatch:
            found = index.search(documents)
            doc = pa.array([held[d] for d, _, _ in found], arrow_id)
            item = pa.array([ids[i] for _, i, _ in found])
            sizes = np.array([len(index.sets[i]) for _, i, _ in found], np.int64)
            n = np.array([s for _, _, s in found], np.int64)
            return pa.RecordBatch.from_arrays([doc, item, pa.array(sizes), pa.array(n)], names=["id", "item", "n_shingles", "n_shared"])

        held, documents, size = [], [], 0
        for b in batches:
            arrow_id = b.column(0).type
            for key, text in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), strict=True):
                s = shingles(hashes.array(license_words(text)), k)
                if len(s):
                    held.append(key)
                    documents.append(s)
                    size += len(s)
                if size >= CHUNK:
                    if (out := flush(held, documents)).num_rows:
                        yield out
                    held, documents, size = [], [], 0
        if documents and (out := flush(held, documents)).num_rows:
            yield out

    schema = T.StructType([docs.schema["id"], T.StructField("item", item_type.dataType), T.StructField("n_shingles", T.LongType()), T.StructField("n_shared", T.LongType())])
    return docs.mapInArrow(tidy(run), schema)


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    k: int = 5,
    percent: int = 80,
    n_permutations: int = 32,
    block_chars: int = 20_000_000,
) -> DataFrame:
    """(id, item id, n_shingles, n_shared, containment) of the items of which a document holds ``percent`` per cent of the shingles or more.

    ``block_chars`` bounds what of the items is held at once, in characters; more items take more scans.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    wanted = items.select(F.col(item_id_col).alias("item"), F.col(item_text_col).alias("text"))
    total = wanted.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    parts = []
    for b in range(blocks):
        held = wanted.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()
        parts.append(_search_block(rows, [license_words(r["text"].encode()) if r["text"] else [] for r in held], [r["item"] for r in held], wanted.schema["item"], k, percent, n_permutations))
    out = reduce(DataFrame.unionAll, parts)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_id_col), "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))
