"""N-gram Jaccard join by set relations, with connected components of its links.

Documents are sets of word shingles; two link when their Jaccard similarity reaches a
percentage. The join is exact:

1. Equal sets are joined by a 128-bit digest first; one representative of each goes on.
2. Index. All tokens are ordered: those that are frequent in the corpus last, by their
   count, the others by hash. Sets that link share at least ``shared_least(n)`` tokens,
   n being the smaller size, among the first n - ceil(p n) + shared_least(n) of each, so
   only those prefixes are put into inverted lists, each entry with the set's size and
   the token's position. Lists of frequent tokens are split into bands of sizes; sets of
   one band meet those of the next in it.
3. Block-skipping. A list is sorted by size and position. An entry's cursor runs over
   the later ones; where a position leaves too little room for the needed overlap, it
   skips the rest of the block of that size; where sizes are too far apart, it ends. In
   short lists each pair is passed on, and only pairs that meet often enough stay. In
   long lists what hangs together becomes a block, without its pairs.
4. Sifting. A bitmap as long as the set (parity of hashed tokens) bounds the difference
   of two sets from below. Pairs, and the members of a block, that it leaves over are
   edges; their components are groups, and a set is in one group at most.
5. Answers from similar sets. The whole sets of a group are fetched and indexed. The
   overlaps of the first set with all others are computed from the index; those of a
   set similar to one already answered are derived from its answers by looking up only
   the tokens in which the two differ. A group ends early once it is one component.
   Groups beyond ``CELL`` tokens are cut into cells of two chunks each, so that memory
   stays bounded and no pair is lost.
6. Links become components by star contraction.

Defined results: null and empty texts have the empty set and link with nothing; fewer
words than a shingle make one shingle; repeated rows are equal sets; extra columns are
ignored; an empty table gives an empty result; a null id is treated as no document's.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.common import WordHashes, broadcast_if_small, checkpointed, shingles, text_bytes, tidy, word_bytes
from webloom.llm.components import connected_components

#: Words (64 bits) of the largest bitmap.
MAP_WORDS = 512
#: Most entries of a list whose pairs are passed on one by one, and most members of a block.
SHORT, BLOCK = 16, 1500
#: Tokens of one cell's chunk.
CELL = 1_500_000
#: Tokens that a task counts before it passes its counts on, and the least count it passes on.
COUNT_CHUNK, COUNT_LEAST = 2_000_000, 4
#: Frequent tokens are at most so many, and stand in at least so many sets.
MOST_FREQUENT, FREQUENT_LEAST = 1_000_000, 16
#: Rows that a task holds before it passes them on.
ROWS = 100_000


def token_set(words: list[bytes], hashes: WordHashes, k: int) -> np.ndarray:
    return np.unique(shingles(hashes.array(words), k))


def digest(tokens: np.ndarray) -> tuple[int, int]:
    """128-bit digest of a set as two signed 64-bit numbers; (0, 0) for the empty set."""
    if not len(tokens):
        return 0, 0
    d = xxhash.xxh3_128_intdigest(tokens.tobytes())
    return (d >> 64) - 2**63, (d & 2**64 - 1) - 2**63


def needed(percent: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least overlap of sets of sizes a and b with 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def shared_least(n):
    """Tokens that the prefixes of two linked sets share at least, where n is the smaller size."""
    return 1 + n // 40


def prefix_length(percent: int, n: int) -> int:
    return min(n, n - -(-percent * n // 100) + shared_least(n))


def bitmap(tokens: np.ndarray) -> bytes:
    """Parity of the tokens in each of n to 2 n places (a power of two). Two sets differ in at least as many tokens as their bitmaps, folded to one length, in places."""
    bits = 64
    while bits < min(len(tokens), 64 * MAP_WORDS):
        bits *= 2
    odd = np.bincount((tokens >> np.uint64(17)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Rows of bitmaps brought down to so many 64-bit words."""
    while maps.shape[1] > words:
        half = maps.shape[1] // 2
        maps = maps[:, :half] ^ maps[:, half:]
    return maps


def _profile(docs: DataFrame, k: int) -> DataFrame:
    """kind 0: a document's id, digest (a, b), n and bitmap. kind 1: a token (a) with its count n among the sets of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        held: list[np.ndarray] = []
        size, seen, id_type = 0, set(), None

        def counted() -> pa.RecordBatch:
            token, n = np.unique(np.concatenate(held), return_counts=True)
            token, n = token[n >= COUNT_LEAST], n[n >= COUNT_LEAST]
            m = len(token)
            return pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int8)), pa.nulls(m, id_type), pa.array(token.view(np.int64)), pa.array(np.zeros(m, np.int64)), pa.array(n), pa.nulls(m, pa.binary())], names=["kind", "id", "a", "b", "n", "map"])

        for batch in batches:
            id_type = batch.column(0).type
            a, b, n, maps = [], [], [], []
            for text in text_bytes(batch.column(1)):
                tokens = token_set(word_bytes(text), hashes, k)
                d = digest(tokens)
                a.append(d[0])
                b.append(d[1])
                n.append(len(tokens))
                maps.append(bitmap(tokens) if len(tokens) else None)
                if len(tokens) and d[0] not in seen:
                    seen.add(d[0])
                    held.append(tokens)
                    size += len(tokens)
                    if size > COUNT_CHUNK:
                        yield counted()
                        held, size = [], 0
            m = len(a)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int8)), batch.column(0), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64()), pa.array(maps, pa.binary())], names=["kind", "id", "a", "b", "n", "map"])
        if held:
            yield counted()

    long = T.LongType()
    schema = T.StructType([T.StructField("kind", T.ByteType()), docs.schema["id"], T.StructField("a", long), T.StructField("b", long), T.StructField("n", long), T.StructField("map", T.BinaryType())])
    return docs.mapInArrow(tidy(run), schema)


def _frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The frequent tokens in order of hash, and their ranks by ascending count. counts: a (token), n."""
    level = (4 * F.log2("n")).cast("int")
    levels = {r["level"]: r["tokens"] for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("tokens")).collect()}
    least, total = None, 0
    for x in sorted(levels, reverse=True):
        total += levels[x]
        if total > MOST_FREQUENT:
            break
        least = x
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    found = counts.where(level >= least).toArrow()  # at most MOST_FREQUENT
    token, n = found.column("a").to_numpy().view(np.uint64), found.column("n").to_numpy()
    rank = np.empty(len(token), np.int32)
    rank[np.lexsort((token, n))] = np.arange(len(token), dtype=np.int32)
    by_hash = np.argsort(token)
    return token[by_hash], rank[by_hash]


def _entries(docs: DataFrame, k: int, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Inverted list entries of the prefixes: key, a (of the set's digest) and place: size, position and whether it visits the band, in one number."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        known, ranks = shared.value
        width = log(100 / percent) * (1 + 1e-9) if percent < 100 else 1.0  # sizes of linked sets are in one band or in neighbours
        keys, places, of = [], [], []
        size = 0

        def ordered(tokens: np.ndarray, p: int) -> tuple[np.ndarray, int]:
            """The first p tokens in the total order, and how many of them are not frequent."""
            if not len(known):
                return tokens[:p], p
            at = np.searchsorted(known, tokens)
            at[at == len(known)] = 0
            is_frequent = known[at] == tokens
            rare = tokens[~is_frequent]
            if len(rare) >= p:
                return rare[:p], p
            rest = tokens[is_frequent][np.argsort(ranks[at[is_frequent]])][: p - len(rare)]
            return np.concatenate([rare, rest]), len(rare)

        def taken() -> pa.RecordBatch:
            nonlocal keys, places, of, size
            arrays = [np.concatenate(x) for x in (keys, places, of)]
            keys, places, of, size = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(arrays[0].view(np.int64)), pa.array(arrays[1]), pa.array(arrays[2])], names=["key", "place", "a"])

        for batch in batches:
            for text in text_bytes(batch.column(1)):
                tokens = token_set(word_bytes(text), hashes, k)
                n = len(tokens)
                d = digest(tokens)
                if not n or d[0] in seen:
                    continue
                seen.add(d[0])
                key, rare = ordered(tokens, prefix_length(percent, n))
                place = (n << 32) + 2 * np.arange(len(key), dtype=np.int64)
                if rare < len(key):  # by size band: its own, and as a visitor the next
                    band = int(log(n) / width)
                    salt = lambda x: np.uint64((x + 1) * 0x9E3779B97F4A7C15 % 2**64)
                    hot = key[rare:]
                    key = np.concatenate([key[:rare], hot ^ salt(band), hot ^ salt(band + 1)])
                    place = np.concatenate([place, place[rare:] + 1])
                keys.append(key)
                places.append(place)
                of.append(np.full(len(key), d[0]))
                size += len(key)
                if size >= ROWS:
                    yield taken()
        if keys:
            yield taken()

    return docs.mapInArrow(tidy(run), "key long, place long, a long")


def _merge(parent: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, bool]:
    """``parent`` (each row's least known fellow, itself a root) after joining the rows x and y, and whether that changed it."""
    changed = False
    while True:
        x, y = parent[x], parent[y]
        apart = x != y
        if not apart.any():
            return parent, changed
        changed = True
        x, y = x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up


def list_candidates(key: np.ndarray, n: np.ndarray, pos: np.ndarray, visitor: np.ndarray, percent: int, short: int = SHORT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of entries sorted by key, n, pos: index pairs in lists of at most ``short`` entries that block-skipping leaves over, and for longer lists the first fellow of each entry's block."""
    rows = len(key)
    index = np.arange(rows)
    parent = index.copy()
    none = np.zeros(0, np.int64)
    if rows < 2:
        return none, none, parent

    def ends(change: np.ndarray) -> np.ndarray:
        """For each row the first later row at which a change is marked."""
        at = np.r_[np.flatnonzero(change), rows]
        return at[np.searchsorted(at, index, "right")]

    new_list = np.r_[True, key[1:] != key[:-1]]
    starts = np.flatnonzero(new_list)
    number = np.cumsum(new_list) - 1
    list_end = ends(new_list)
    block_end = ends(new_list | np.r_[True, n[1:] != n[:-1]])
    is_long = (np.diff(np.r_[starts, rows]) > short)[number]
    i = index[index + 1 < list_end]
    cursor = i + 1
    left, right, one = [none], [none], np.zeros(rows, bool)
    while len(i):
        alive = 100 * n[i] >= percent * n[cursor]
        i, cursor = i[alive], cursor[alive]
        ni, nc, pi, pc = n[i], n[cursor], pos[i], pos[cursor]
        # Common tokens: at most those before both places, this one, and those after.
        room = np.minimum(pi, pc) + np.minimum(ni - pi, nc - pc) >= needed(percent, ni, nc)
        hit = room & ~(visitor[i] & visitor[cursor])
        apart = hit & ~is_long[i]
        left.append(i[apart])
        right.append(cursor[apart])
        together = hit & is_long[i]
        parent, changed = _merge(parent, i[together], cursor[together])
        if changed:  # lists that are one block now need no more
            one |= (np.add.reduceat((parent == index).astype(np.int64), starts) == 1)[number]
        cursor = np.where(room | (pc < pi), cursor + 1, block_end[cursor])
        go = (cursor < list_end[i]) & ~(one[i] & is_long[i])
        i, cursor = i[go], cursor[go]
    return np.concatenate(left), np.concatenate(right), parent


def chunked(members: np.ndarray, sizes: np.ndarray, percent: int, most: int = BLOCK) -> Iterator[np.ndarray]:
    """The block itself, or pairs of chunks of it by size, so that every pair of compatible sizes is in one of them. ``sizes`` ascend."""
    if len(members) <= most:
        yield members
        return
    cuts = [(at, min(at + most // 2, len(members))) for at in range(0, len(members), most // 2)]
    for x, (a, b) in enumerate(cuts):
        for c, d in cuts[x + 1 :] or [(b, b)]:
            if c == b or 100 * sizes[b - 1] >= percent * sizes[c]:
                yield np.concatenate([members[a:b], members[c:d]])


def grouped(batches: Iterator[pa.RecordBatch], rows: int = 1) -> Iterator[pa.Table]:
    """Tables of whole groups, of so many rows or more where there are: rows are sorted by their first column, and each table ends where a group does."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1], "left"))  # where the last group begins
        if size + cut >= rows and (cut or held and held[-1].column(0)[-1].as_py() != key[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held, size = [], 0
            batch = batch.slice(cut)
        held.append(batch)
        size += batch.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def slices(table: pa.Table) -> Iterator[pa.Table]:
    """The groups of two rows or more, one by one."""
    key = table.column(0).to_numpy()
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a > 1:
            yield table.slice(a, b - a)


def _candidates(entries: DataFrame, percent: int) -> DataFrame:
    """kind 0: a pair of sets (x, y) that meet often enough. kind 1: a block x with its member y."""

    def batch(kind: int, x: np.ndarray, y: np.ndarray, least: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int8)), pa.array(x), pa.array(y), pa.array(least)], names=["kind", "x", "y", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for table in grouped(batches, ROWS):
            key, place, a = (table.column(c).to_numpy() for c in ("key", "place", "a"))
            same = key[1:] == key[:-1]
            fresh = np.r_[True, ~(same & (place[1:] == place[:-1]) & (a[1:] == a[:-1]))]  # equal sets of several tasks
            key, place, a = key[fresh], place[fresh], a[fresh]
            same = key[1:] == key[:-1]
            twin = np.r_[same, False] | np.r_[False, same]  # most lists have one entry
            if not twin.any():
                continue
            key, place, a = key[twin], place[twin], a[twin]
            n = place >> 32
            left, right, first = list_candidates(key, n, (place & 0xFFFFFFFF) >> 1, (place & 1).astype(bool), percent)
            other = a[left] != a[right]
            left, right = left[other], right[other]
            if len(left):
                yield batch(0, np.minimum(a[left], a[right]), np.maximum(a[left], a[right]), shared_least(np.minimum(n[left], n[right])))
            order = np.argsort(first, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(first[order]) > 0, True])
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if e - s < 2:
                    continue
                members, at = np.unique(a[order[s:e]], return_index=True)
                by_size = np.argsort(n[order[s:e]][at], kind="stable")
                for block in chunked(members[by_size], n[order[s:e]][at][by_size], percent):
                    block = np.sort(block)
                    name = xxhash.xxh3_64_intdigest(block.tobytes()) - 2**63
                    if len(block) > 1 and name not in seen:
                        seen.add(name)
                        yield batch(1, np.full(len(block), name), block, np.ones(len(block), np.int64))

    rows = entries.repartition(F.col("key")).sortWithinPartitions("key", "place", "a").mapInArrow(tidy(run), "kind byte, x long, y long, least long")
    return rows.groupBy("kind", "x", "y").agg(F.count("*").alias("n"), F.max("least").alias("least")).where("kind = 1 OR n >= least").select("kind", "x", "y")


def sift(n: np.ndarray, maps: list[bytes], percent: int) -> np.ndarray:
    """For each set its group: the least fellow that bitmaps leave it linked with. ``n`` ascends."""
    m = len(n)
    label = np.arange(m)
    words = np.array([len(x) // 8 for x in maps])
    levels = {}  # words -> first row and bitmaps
    for w in np.unique(words).tolist():
        at = np.flatnonzero(words == w)
        levels[w] = (int(at[0]), np.frombuffer(b"".join([maps[i] for i in at.tolist()]), np.uint64).reshape(len(at), w))
    last = np.searchsorted(percent * n, 100 * n, "right")
    at_level = {(w, x): folded(levels[x][1], w) for w in levels for x in levels if w <= x}
    for i in range(m - 1):
        own = maps[i]
        w = len(own) // 8
        row = np.frombuffer(own, np.uint64)
        for x, (first, _) in levels.items():
            if x < w:
                continue
            s, e = max(i + 1, first) - first, min(int(last[i]) - first, len(levels[x][1]))
            if s >= e:
                continue
            differ = np.bitwise_count(at_level[w, x][s:e] ^ row).sum(axis=1, dtype=np.int64)
            nj = n[first + s : first + e]
            js = np.flatnonzero(differ <= n[i] + nj - 2 * needed(percent, n[i], nj)) + first + s
            if len(js):
                found = np.unique(np.r_[label[js], label[i]])
                if len(found) > 1:
                    label[np.isin(label, found)] = found[0]
    return label


def _kept_pairs(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs that the bitmaps leave over."""
    names = ["a", "n", "m", "b", "n2", "m2"]
    x, y = maps.toDF("a", "n", "m"), maps.toDF("b", "n2", "m2")
    joined = pairs.select(F.col("x").alias("a"), F.col("y").alias("b")).join(x, "a").join(y, "b").select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, n2 = b.column(1).to_numpy(), b.column(4).to_numpy()
            most = n + n2 - 2 * needed(percent, n, n2)
            keep = np.zeros(b.num_rows, bool)
            for i, (p, q) in enumerate(zip(b.column(2).to_pylist(), b.column(5).to_pylist(), strict=True)):
                w = min(len(p), len(q)) // 8
                p, q = (folded(np.frombuffer(z, np.uint64)[None, :], w) for z in (p, q))
                keep[i] = np.bitwise_count(p ^ q).sum(dtype=np.int64) <= most[i]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3)], names=["a", "b"]).filter(pa.array(keep))

    return joined.mapInArrow(tidy(run), "a long, b long")


def _kept_blocks(blocks: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """(a, b): edges from each member of what is left of a block to one of it."""
    members = blocks.select(F.col("x").alias("block"), F.col("y").alias("a")).join(maps.toDF("a", "n", "map"), "a").select("block", "n", "a", "map")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches):
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for g in slices(table):
                a = g.column("a").to_numpy()
                label = sift(g.column("n").to_numpy(), g.column("map").to_pylist(), percent)
                own = label != np.arange(len(a))
                found.append((a[own], a[label[own]]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["a", "b"])

    return members.repartition(F.col("block")).sortWithinPartitions("block", "n", "a").mapInArrow(tidy(run), "a long, b long").distinct()


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """(a, b, tokens) of documents; tokens as bytes of sorted 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            held, size = [], 0
            for text in text_bytes(batch.column(1)):
                tokens = token_set(word_bytes(text), hashes, k)
                held.append((*digest(tokens), tokens.tobytes()))
                size += len(tokens)
                if size >= ROWS:
                    yield _columns(held)
                    held, size = [], 0
            if held:
                yield _columns(held)

    def _columns(held: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["a", "b", "tokens"])

    return docs.mapInArrow(tidy(run), "a long, b long, tokens binary")


def _find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def block_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges that connect the components of the sets' exact links (a spanning forest)."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    tokens, owner = flat[order], np.repeat(np.arange(m, dtype=np.int32), sizes)[order]
    del flat, order

    def overlaps(some: np.ndarray) -> np.ndarray:
        """How many of the tokens each set holds, by the index of the group."""
        out = np.zeros(m, np.int64)
        for part in np.array_split(some, max(1, len(some) * m // 4_000_000)):  # bounds what is looked up at once
            lo, hi = np.searchsorted(tokens, part, "left"), np.searchsorted(tokens, part, "right")
            n = hi - lo
            at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            out += np.bincount(owner[at], minlength=m)
        return out

    parent, out, components = list(range(m)), [], m
    leader, answers = None, None
    for i in range(m):
        s = sets[i]
        if leader is not None:
            gone, new = np.setdiff1d(leader, s, assume_unique=True), np.setdiff1d(s, leader, assume_unique=True)
        if leader is not None and 2 * (len(gone) + len(new)) < len(s):
            own = answers - overlaps(gone) + overlaps(new)  # derived from the similar set's answers
        else:
            leader, answers = s, overlaps(s)
            own = answers
        union = sizes[i] + sizes - own
        for j in (np.flatnonzero((100 * own >= percent * union)[i + 1 :]) + i + 1).tolist():
            x, y = _find(parent, i), _find(parent, j)
            if x != y:
                parent[max(x, y)] = min(x, y)
                components -= 1
                out.append((i, j))
        if components == 1:
            break
    return out


def _links(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): representatives that a spanning forest of each cell's links joins. members: cell, rep, tokens."""
    rep = members.schema["rep"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches):
            for g in slices(table):
                reps = g.column("rep").combine_chunks()
                found = block_links([np.frombuffer(t, np.uint64) for t in g.column("tokens").to_pylist()], percent)
                if found:
                    yield pa.RecordBatch.from_arrays([reps.take(pa.array([f[i] for f in found], pa.int64())) for i in (0, 1)], names=["a", "b"])

    rows = members.repartition(F.col("cell")).sortWithinPartitions("cell", "rep").select("cell", "rep", "tokens")
    return rows.mapInArrow(tidy(run), T.StructType([T.StructField("a", rep), T.StructField("b", rep)]))


def _cells(groups: DataFrame, reps: DataFrame) -> DataFrame:
    """(cell, a, b, rep): each group's sets; a group of more than ``CELL`` tokens in chunks, of which each two meet in a cell."""
    least = groups.select(F.col("component").alias("node"), "component").distinct()  # no row of their own
    all_nodes = groups.unionByName(least).select(F.col("node").alias("a"), F.col("component").alias("group"))
    members = checkpointed(all_nodes.join(reps, "a").select("group", "a", "b", "rep", "n"))
    large = members.groupBy("group").agg(F.ceil(F.sum("n") / CELL).cast("int").alias("parts")).where("parts > 1")
    chunk = F.pmod(F.xxhash64("a", "b"), F.col("parts"))
    cut = members.join(large, "group", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return cut.select(F.xxhash64("group", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("cell"), "a", "b", "rep")


def linked_documents(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles and component_id, the least id that links reach (its own where none do)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    profile = checkpointed(_profile(rows, k))
    documents = profile.where("kind = 0")
    reps = checkpointed(documents.where("n > 0").groupBy("a", "b").agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.first("map").alias("map")).where("rep IS NOT NULL"))
    counts = checkpointed(profile.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT_LEAST))
    found = checkpointed(_candidates(_entries(rows, k, percent, _frequent(counts)), percent))
    maps = reps.select("a", "n", "map")
    edges = _kept_pairs(found.where("kind = 0"), maps, percent).unionByName(_kept_blocks(found.where("kind = 1"), maps, percent))
    cells = checkpointed(_cells(connected_components(edges), reps.drop("map")))
    # Their documents are read again; an id with several texts gives sets that no member has.
    wanted = broadcast_if_small(checkpointed(cells.select(F.col("rep").alias("id")).distinct()), 1_000_000)
    sets = _sets(rows.join(wanted, "id", "left_semi"), k).dropDuplicates(["a", "b"])
    linked = connected_components(_links(cells.join(sets, ["a", "b"]).select("cell", "rep", "tokens"), percent))
    best = reps.join(linked, F.col("rep") == F.col("node"), "left").select("a", "b", F.coalesce("component", "rep").alias("component"))
    with_words = documents.where("n > 0").select("id", "a", "b", "n").join(best, ["a", "b"], "left").select("id", "n", "component")
    out = with_words.unionByName(documents.where("n = 0").select("id", "n", F.col("id").alias("component")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
