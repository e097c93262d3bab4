"""Operators over many documents, and the pipeline, against brute force and edge cases."""

import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from hashlib import md5
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.llm import contain, jaccard, quality, secrets, warc
from webloom.llm.common import shingles
from webloom.llm.components import connected_components

corpus_pipeline = pytest.importorskip("corpus_pipeline")

ODD = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "x" * 30_000 + " y", None), (5, "Same words here again.", "a"), (5, "Same words here again.", "a"), (None, "No id.", "b")]


@pytest.fixture(scope="module")
def odd(spark):
    names = "doc_id long, text string, source string"
    return spark.createDataFrame(ODD, names).withColumns({c: F.lit(c) for c in ("id", "host", "row", "lines", "a", "b", "n", "block", "item", "lang")}).withColumn("n_chars", F.length("text").cast("bigint"))


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# --- Links --------------------------------------------------------------------------------------------------------


def word_sets(rows, k):
    out = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        out[d] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    return out


def brute_components(sets, percent):
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (2, 50)])
def test_links_equal_brute_force(documents, k, percent):
    sets = word_sets([(r.doc_id, r.text) for r in documents.collect()], k)
    expected = brute_components(sets, percent)
    got = jaccard.linked_documents(documents, k, percent).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(d, len(sets[d]), expected[d]) for d in sets}


@pytest.mark.parametrize("cell", [100, 10**6])
def test_chains_and_frequent_tokens(spark, monkeypatch, cell):
    """Families of variants that link in chains, all of frequent tokens, with groups whole and in small cells."""
    monkeypatch.setattr(jaccard, "CELL", cell)
    monkeypatch.setattr(jaccard, "FREQUENT_LEAST", 3)
    monkeypatch.setattr(jaccard, "COUNT_LEAST", 1)
    r = np.random.default_rng(3)
    rows, words = [], [f"w{i}" for i in range(60)]
    for family in range(4):
        text = list(r.choice(words, 40))
        for i in range(40):
            text = list(text)
            text[int(r.integers(40))] = str(r.choice(words))
            rows.append((family * 100 + i, " ".join(text)))
    sets = word_sets(rows, 1)
    expected = brute_components(sets, 80)
    got = {x.doc_id: x.component_id for x in jaccard.linked_documents(spark.createDataFrame(rows, "doc_id long, text string"), 1, 80).collect()}
    assert got == expected and len(set(expected.values())) < len(expected)


def test_block_answers_are_derived_exactly():
    r = np.random.default_rng(5)
    base = np.unique(r.integers(0, 2**63, 200).astype(np.uint64))
    sets = []
    for _ in range(60):
        s = np.concatenate([np.delete(base, r.integers(0, len(base), int(r.integers(0, 25)))), r.integers(0, 2**63, int(r.integers(0, 25))).astype(np.uint64)])
        sets.append(np.unique(s))
    for percent in (75, 85, 95):
        link = lambda a, b: 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b))  # noqa: B023, E731
        expected = brute_components({i: frozenset(s.tolist()) for i, s in enumerate(sets)}, percent)
        forest = jaccard.block_links(sets, percent)
        assert all(link(sets[i], sets[j]) for i, j in forest)
        parent = {i: i for i in range(60)}
        for i, j in forest:
            a, b = parent[i], parent[j]
            parent = {x: min(a, b) if p in (a, b) else p for x, p in parent.items()}
        assert parent == expected


def test_chunks_cover_all_compatible_pairs():
    r = np.random.default_rng(7)
    sizes = np.sort(r.integers(50, 80, 37))
    covered = {p for block in jaccard.chunked(np.arange(37), sizes, 90, most=10) for p in combinations(sorted(block.tolist()), 2)}
    assert {(i, j) for i, j in combinations(range(37), 2) if 10 * sizes[i] >= 9 * sizes[j]} <= covered


def test_prefixes_share_enough_tokens():
    """What the index relies on: linked sets meet so often in their prefixes, and the bitmaps do not part them."""
    r = np.random.default_rng(9)
    for percent in (50, 80, 90):
        for _ in range(300):
            common = r.integers(0, 2**63, int(r.integers(1, 400))).astype(np.uint64)
            x, y = (np.unique(np.concatenate([common, r.integers(0, 2**63, int(r.integers(0, 1 + len(common) // 4))).astype(np.uint64)])) for _ in range(2))
            if 100 * len(np.intersect1d(x, y)) < percent * len(np.union1d(x, y)):
                continue
            px, py = (s[: jaccard.prefix_length(percent, len(s))] for s in (x, y))
            assert len(np.intersect1d(px, py)) >= jaccard.shared_least(min(len(x), len(y)))
            x, y = sorted((x, y), key=len)
            assert jaccard.sift(np.array([len(x), len(y)]), [jaccard.bitmap(x), jaccard.bitmap(y)], percent).tolist() == [0, 0]


def test_lists_give_all_compatible_pairs():
    """Pairs of short lists, and blocks of long ones, against all pairs of entries."""
    r = np.random.default_rng(12)
    for short in (0, 10**6):
        key = np.sort(r.integers(0, 30, 600))
        n = r.integers(5, 60, 600)
        pos = (r.random(600) * n * 0.4).astype(np.int64)
        order = np.lexsort((pos, n, key))
        key, n, pos, visitor = key[order], n[order], pos[order], r.random(600) < 0.2
        left, right, first = jaccard.list_candidates(key, n, pos, visitor, 80, short)
        room = lambda i, j: min(pos[i], pos[j]) + min(n[i] - pos[i], n[j] - pos[j])  # noqa: B023, E731
        pairs = {(i, j) for i, j in combinations(range(600), 2) if key[i] == key[j] and 100 * n[i] >= 80 * n[j] and room(i, j) >= jaccard.needed(80, n[i], n[j]) and not (visitor[i] and visitor[j])}
        if short:
            assert set(zip(left.tolist(), right.tolist(), strict=True)) == pairs
        else:
            expected = brute_groups(600, pairs)
            assert not len(left) and first.tolist() == [expected[i] for i in range(600)]


def brute_groups(n, pairs):
    parent = list(range(n))
    for i, j in pairs:
        a, b = parent[i], parent[j]
        parent = [min(a, b) if p in (a, b) else p for p in parent]
    return parent


def test_a_long_list_takes_no_square_memory():
    """10,000 near copies in one list: no pairs are kept."""
    n = np.sort(np.random.default_rng(1).integers(500, 520, 10_000))
    tracemalloc.start()
    left, right, first = jaccard.list_candidates(np.zeros(10_000, np.int64), n, np.zeros(10_000, np.int64), np.zeros(10_000, bool), 80)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not len(left) and not first.any() and peak < 20_000_000


def test_link_tables(odd):
    rows = jaccard.linked_documents(odd, 3, 90).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in rows) == Counter([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 2, 5), (5, 2, 5), (None, 1, None)])
    assert jaccard.linked_documents(odd.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, 101), (102, 101), (7, 7), (50, 50)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(2, 31)} | {101: 100, 102: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- Containment --------------------------------------------------------------------------------------------------


def test_containment_equals_brute_force(spark, sf_dir, documents):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    grams = lambda t: {int(x) for x in shingles(contain.WordHashes().array(contain.license_words(t.encode())), 5)}
    of_items = {r.item_id: grams(r.text) for r in items.collect()}
    expected = set()
    for r in documents.collect():
        have = grams(r.text)
        expected |= {(r.doc_id, i, len(s & have)) for i, s in of_items.items() if s and 100 * len(s & have) >= 80 * len(s)}
    got = contain.contained_items(documents, items)
    assert {(r.doc_id, r.item_id, r.n_shared) for r in got.collect()} == expected and expected
    blocks = contain.contained_items(documents, items, block_chars=2000)
    assert {(r.doc_id, r.item_id, r.n_shared) for r in blocks.collect()} == expected


def test_passages_in_long_documents(spark):
    r = np.random.default_rng(11)
    word = lambda n: [f"v{int(x)}" for x in r.integers(0, 10**6, n)]
    passages = [word(int(n)) for n in r.integers(6, 120, 60)]
    docs, expected = [], set()
    for d in range(60):
        p = passages[d]
        if d % 3 == 1:  # a part of it: 90 per cent of the shingles
            p = p[: 4 + -(-9 * (len(p) - 4) // 10)]
        docs.append((d, " ".join(word(int(r.integers(0, 4000))) + (p if d % 3 < 2 else p[: len(p) // 2]) + word(int(r.integers(0, 4000))))))
        if d % 3 < 2:
            expected.add((d, d))
    items = spark.createDataFrame([(i, " ".join(p)) for i, p in enumerate(passages)], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in contain.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert got == expected


def test_containment_tables(odd, spark):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "same WORDS here, again"), (3, "same words here again")], "item_id long, text string").withColumn("doc_id", F.lit(9))
    assert sorted((r.doc_id, r.item_id) for r in contain.contained_items(odd, items).collect()) == [(5, 3)] * 4
    assert contain.contained_items(odd, items.limit(0)).count() == contain.contained_items(odd.limit(0), items).count() == 0


# --- Quality ------------------------------------------------------------------------------------------------------


def test_measures_equal_brute_force(documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in quality.line_quality(documents).collect():
        t = texts[r.doc_id]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {i + j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(5)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))


def line(x):
    return " ".join(re.findall(r"[^\x20\x09-\x0D]+", x)).lower()


def base_failed(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    repeated = {i + j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(5)}
    return len(w) < 10 or 100 * len(repeated) > 20 * len(w)


def bad_lines(rows, min_docs=10, max_share=0.1, enough_docs=100, enough_words=8):
    """(host, line) above the limits, from plain counts of distinct documents -> the text that keeps it."""
    key = lambda t: int(md5(t.encode()).hexdigest()[:15], 16)
    holders, host = defaultdict(set), defaultdict(set)
    for _, t, h in rows:
        host[h].add(t or "")
        for x in filter(None, map(line, (t or "").split("\n"))):
            holders[h, x].add(t)
    return {
        (h, x): min((t for t in texts if not base_failed(t)), key=key, default=None)
        for (h, x), texts in holders.items()
        if len(texts) >= min_docs and (len(texts) > max_share * len(host[h]) or (len(texts) >= enough_docs and len(x.split()) >= enough_words))
    }


def brute_quality(rows, **limits):
    """doc_id -> (removed_words, kept)."""
    bad, out = bad_lines(rows, **limits), {}
    for d, t, h in rows:
        counts = [(x, len(x.split())) for x in map(line, (t or "").split("\n"))]
        n, removed = sum(c for _, c in counts), sum(c for x, c in counts if (h, x) in bad and bad[h, x] != t)
        out[d] = (removed, not base_failed(t) and not (removed and (n - removed < 5 or n - removed < 0.2 * n)))
    return out


def body(i, n=12):
    return " ".join(f"word{i}x{j}" for j in range(n))


def quality_of(spark, rows, **limits):
    out = quality.line_quality(spark.createDataFrame(rows, "doc_id long, text string, source string"), **limits).collect()
    got = {r.doc_id: (r.removed_words, r.kept) for r in out}
    assert got == brute_quality(rows, **limits)
    return got


def test_quality_equals_brute_force(spark, documents):
    rows = [(r.doc_id, r.text, r.source) for r in documents.select("doc_id", "text", "source").collect()]
    assert any(n for n, _ in quality_of(spark, rows, min_docs=2, max_share=0.05, enough_docs=3).values())


def test_line_frequency(spark):
    rows = [(i, f"Read  MORE here\n{body(i)}", "h") for i in range(30)] + [(i, body(i), "h") for i in range(30, 60)]
    rows += [(101, "read more here\n" * 3 + "ok a b", "h"), (102, None, "h"), (103, "", None)]
    rows += [(300 + i, f"{body(500 + i)}\nread more here", f"k{i}") for i in range(40)]  # once on each of many hosts
    got = quality_of(spark, rows)
    assert Counter(got[i] for i in range(30)) == {(3, True): 29, (0, True): 1} and not any(got[300 + i][0] for i in range(40))


@pytest.mark.parametrize("shared", [1, 2, 5, 10, 20])
def test_blocks_of_shared_lines(spark, shared):
    """A template is counted whole, however many lines it has and however little stands beside it."""
    template = "\n".join(body(f"t{i}", 6) for i in range(shared))
    got = quality_of(spark, [(i, f"{template}\n{body(i, 5)}", "h") for i in range(40)])
    assert Counter(n for n, _ in got.values()) == {6 * shared: 39, 0: 1}
    assert sum(kept for _, kept in got.values()) == (40 if 5 >= 0.2 * (5 + 6 * shared) and 5 + 6 * shared >= 10 else 1)


def test_near_copies_leave_one_whole(spark):
    rows = [(i, f"{body(999, 30)}\n{body(998, 30)}\n{body(997, 30)} {i}", "k") for i in range(40)] + [(100 + i, body(i, 30), "k") for i in range(60)]
    got = quality_of(spark, rows)
    assert Counter(got[i] for i in range(40)) == {(60, True): 39, (0, True): 1} and all(got[100 + i] == (0, True) for i in range(60))
    rows = [(i, f"{body(999, 30)}\n{body(998, 30)}\nno {i}", "k") for i in range(40)]
    assert sum(kept for _, kept in quality_of(spark, rows).values()) == 1


def test_long_line_of_a_large_host(spark):
    """40 of 800 documents are under a tenth of the host; enough_docs suffices for lines of some length."""
    rows = [(i, f"all rights reserved by us\nok\n{body(i)}" if i < 40 else body(i), "h") for i in range(800)]
    assert Counter(n for n, _ in quality_of(spark, rows, enough_docs=30, enough_words=4).values()) == {5: 39, 0: 761}
    assert not any(n for n, _ in quality_of(spark, rows).values())


def test_removed_lines(spark):
    df = spark.createDataFrame([(1, "Read  MORE here\nrest\n\nread more here"), (2, None)], "doc_id long, text string")
    rows = [(i, f"read more here\n{'a' * (i + 1)} b c d e f g h", "h") for i in range(12)]
    h = next(r.bad_lines for r in quality.line_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect() if r.bad_lines)
    out = df.withColumn("bad", F.array(*[F.lit(x) for x in h])).select("doc_id", quality.without_lines(F.col("text"), F.col("bad")).alias("t")).collect()
    assert [(r.doc_id, r.t) for r in out] == [(1, "rest\n"), (2, None)]


def test_quality_tables(odd):
    rows = quality.line_quality(odd).collect()
    assert Counter((r.doc_id, r.n_words, r.base_failed, r.kept) for r in rows) == Counter([(1, 0, True, False), (2, 0, True, False), (3, 0, True, False), (4, 2, True, False), (5, 4, True, False), (5, 4, True, False), (None, 2, True, False)])
    assert quality.line_quality(odd.limit(0)).count() == 0


def test_quality_runs_no_python(documents):
    rows = quality.measured(documents).withColumn("base_failed", F.lit(False))
    for df in (rows, quality.frequent_lines(rows, 10, 0.1), quality.line_quality(documents)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())


# --- Revisits -----------------------------------------------------------------------------------------------------

RECORDS = "record_id long, url string, ts long, type string, headers map<string,string>"


def test_revisits(spark):
    rows = [
        (1, "http://www.a.org/x/?utm_source=q#f", 10, "response", {"ETag": '"1"', "Content-Type": "t", "X": "old"}), (2, "https://a.org:443/x", 20, "response", {"ETag": '"2"'}), (3, "https://a.org/x", 20, "response", {"ETag": '"3"'}),
        (4, "https://m.A.org/x", 15, "revisit", {"etag": 'W/"1"', "Content-Type": "new", "x": "new", "Date": "d"}), (5, "https://a.org/x", 20, "revisit", {"ETag": '"2"'}), (6, "https://a.org/x", 21, "revisit", {"Last-Modified": "z"}),
        (7, "https://a.org/x", 5, "revisit", None), (8, None, 30, "revisit", {}), (9, "https://a.org/x", None, "revisit", {}), (10, "https://b.org/?b=1&ref=2", 1, "response", None), (11, "https://b.org?b=1", 2, "revisit", None), (12, "https://a.org/x", 99, "metadata", None), (6, "https://a.org/x", 21, "revisit", {"Last-Modified": "z"}),
    ]
    for hot in (1, 3, 100_000):
        out = warc.resolve_revisits(spark.createDataFrame(rows, RECORDS).withColumn("key", F.lit(1)), hot_rows=hot).collect()
        by = {r.record_id: r for r in out}
        assert {i: (r.status, r.refers_to) for i, r in by.items()} == {4: ("resolved", 1), 5: ("mismatch", 1), 6: ("unvalidated", 3), 7: ("no_response", None), 8: ("no_response", None), 9: ("no_response", None), 11: ("unvalidated", 10)}
        assert len(out) == 8
        assert by[4].headers == {"etag": 'W/"1"', "content-type": "t", "x": "new", "date": "d"} and by[5].headers is None
    assert warc.resolve_revisits(spark.createDataFrame([], RECORDS)).count() == 0


def test_revisits_of_a_burst(spark):
    """One URL with a burst and a long tail, and many records without a URL, against brute force."""
    r = np.random.default_rng(4)
    times = [*r.integers(0, 40, 300).tolist(), *r.integers(0, 100_000, 100).tolist()]
    rows = [(i, "http://a.org/" if r.random() < 0.8 else None, int(t), "response" if r.random() < 0.3 else "revisit", {}) for i, t in enumerate(times)]
    kept = [(t, i) for i, u, t, kind, _ in rows if u and kind == "response"]
    expected = {i: max((x for x in kept if x[0] < t), default=(None, None))[1] if u else None for i, u, t, kind, _ in rows if kind == "revisit"}
    df = spark.createDataFrame(rows, RECORDS)
    for hot in (20, 100_000):
        assert {x.record_id: x.refers_to for x in warc.resolve_revisits(df, hot_rows=hot).collect()} == expected
    sizes = [x["n"] for x in warc._with_buckets(df.where("url is not null").select(F.col("url").alias("key"), "ts"), 20).groupBy("bucket").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) <= 60 and len(sizes) > 8


# --- The pipeline -------------------------------------------------------------------------------------------------


def test_stages_equal_brute_force(spark, sf_dir, documents, tmp_path):
    """Each stage on all that the one before kept: ids, columns, marks."""
    docs, seen = documents, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen.append((name, docs, now))
        docs = now
    (_, d0, d1), (_, _, d2), (_, _, d3), (_, _, d4), (_, _, packed) = seen
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert all(x.columns == documents.columns for x in (d1, d2, d3, d4))
    assert ids(d1) == {r.doc_id for r in quality.line_quality(d0).collect() if r.kept}
    components = brute_components(word_sets([(r.doc_id, r.text) for r in d1.collect()], 5), 80)
    assert ids(d2) == {d for d, c in components.items() if d == c}
    assert ids(d3) == ids(d2) - ids(contain.contained_items(d2, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    assert ids(d4) == ids(d3) == ids(packed)
    assert not [r for r in d4.collect() if re.search(r"token\s*=\s*\"[0-9a-f]{16}", r.text) or r.n_chars != len(r.text)]


def test_odd_rows_go_through(spark, odd, sf_dir):
    for rows in (odd, odd.limit(0)):
        docs = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns
            docs = out
    deduped = corpus_pipeline.near_duplicate_stage(spark, odd, sf_dir)
    assert Counter(r.doc_id for r in deduped.collect()) == Counter([1, 2, 3, 4, 5, None])


def test_run(spark, sf_dir, documents):
    """run() from documents to sequences against plain loops."""
    from tokenizers import Tokenizer

    rows = documents.collect()
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    bad = bad_lines([(r.doc_id, r.text, r.source) for r in rows])
    texts = {}
    for r in rows:
        if not base_failed(r.text):
            stay = [x for x in r.text.split("\n") if bad.get((r.source, line(x)), r.text) == r.text]
            n, left = len(line(r.text).split()), len(line(" ".join(stay)).split())
            if left == n or left >= max(5, 0.2 * n):
                texts[r.doc_id] = "\n".join(stay)
    components = brute_components(word_sets(list(texts.items()), 5), 80)
    texts = {d: t for d, t in texts.items() if components[d] == d}
    grams = lambda t: {tuple(w[i : i + 5]) for w in [contain.license_words(t.encode())] for i in range(max(1, len(w) - 4))}
    items = [grams(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    texts = {d: t for d, t in texts.items() if not any(100 * len(s & grams(t)) >= 80 * len(s) for s in items)}
    tokenizer = Tokenizer.from_file(corpus_pipeline.tokenizer_path())
    expected = set()
    for d, t in texts.items():
        ids = [*tokenizer.encode(secrets.redacted(t), add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            expected.add((d, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed} == expected and len(packed) == len(expected)
    sequences = defaultdict(list)
    for r in packed:
        sequences[r.sequence_id].append((r.offset, r.length))
    for content in sequences.values():
        ends = np.cumsum([n for _, n in sorted(content)])
        assert [o for o, _ in sorted(content)] == [0, *ends[:-1]] and ends[-1] <= 4096
