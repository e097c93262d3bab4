"""Operators that treat one document at a time, against brute force and edge cases."""

import hashlib
import math
import re
import struct
import time
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webloom.llm import extract, language, licenses, packing, secrets, toxicity
from webloom.llm.queries import tokenizer_path

ODD = [(1, None, "x"), (2, "", "x"), (3, " \n\t ", "x"), (4, "a" * 50_000 + " b", "x"), (5, "Same words here.", "x"), (5, "Same words here.", "x"), (None, "No id.", "x")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and extra columns whose names the operators use."""
    return spark.createDataFrame(ODD, "doc_id long, text string, source string").withColumn("id", F.lit("extra")).withColumn("score", F.lit(0)).withColumn("words", F.lit(1)).withColumn("text_hash", F.lit(2))


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


# --- Secrets ------------------------------------------------------------------------------------------------------


def brute_spans(text):
    out = [("assign", m.start(), m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A) if len(m[2]) >= 12]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 18]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 16]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("AKIA0f9 =:\"'tokenSECRET_pawd-é"), max_size=90))
def test_base_spans_equal_plain_patterns(text):
    assert secrets.scan_text(text)[0] == brute_spans(text)


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("abcdef0123456789"), max_size=60))
def test_entropy_counts_equal_recomputation(run):
    marked = set()
    for i in range(len(run) - 19):
        c = Counter(run[i : i + 20])
        if -sum(n / 20 * math.log2(n / 20) for n in c.values()) >= 2.8 - 1e-9:
            marked.update(range(i, i + 20))
    assert {p for a, b in secrets.high_entropy(run, 20, 2.8) for p in range(a, b)} == marked


def test_entropy_kind_and_allow_list():
    found = lambda t: [s[0] for s in secrets.scan_text(t)[1]]
    assert found("key 9233A8ECF7C5B09FE5949719B6B82BC439E9329B end") == ["entropy"]
    assert found("id 123e4567-e89b-42d3-a456-426614174000") == []
    assert found("use EXAMPLE9233A8ECF7C5B09FE5949719B6B82BC4") == []
    assert found("averyveryverylongwordwithoutanydigits") == []
    assert secrets.redacted("a token = abcdefghijkl1 b") == "a [SECRET] b"


def test_secret_tables(odd, empty):
    rows = secrets.digest(secrets.scan(odd)).collect()
    assert len(rows) == len(ODD) and {r.base_sha256 for r in rows} == {hashlib.sha256(b"").hexdigest(), secrets.base_digest([("hex", 0, 50_000)])}
    assert secrets.digest(secrets.scan(empty)).count() == 0
    assert sorted(secrets.redact(odd).columns) == sorted(odd.columns) and secrets.redact(odd).count() == len(ODD)


def test_secrets_of_documents(spark, sf_dir, documents):
    rows = {r.doc_id: r for r in secrets.digest(secrets.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))).collect()}
    for d, t in documents:
        assert rows[d].base_sha256 == secrets.base_digest(brute_spans(t))


# --- Licenses -----------------------------------------------------------------------------------------------------


def machines():
    return licenses.automata(licenses.TEMPLATES + licenses.file_templates())


def scanned(t):
    return licenses.scan_words(licenses.license_words(t.encode()), machines())


def test_license_words_and_phrases(odd, empty):
    t = "MIT License, the Apache\nLICENSE é1 general PUBLIC license: mit license"
    w = licenses.license_words(t.encode())
    assert [x.decode() for x in w] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    f = licenses.scan_words(w, machines())
    assert (f["n_base"], f["first_word"], f["last_word"], f["base_labels"]) == (4, 0, 9, ["apache", "gpl", "mit"])
    rows = licenses.digest(licenses.scan(odd)).collect()
    assert len(rows) == len(ODD) and {(r.labels, r.score) for r in rows} == {("", 0.0)}
    assert licenses.digest(licenses.scan(empty)).count() == 0


def test_templates():
    a = licenses.compile_template("x", "one [[or [[even]] two]] three <<2>> four")
    match = lambda t: a.match(t.encode().split(), 0)
    assert [match(t) for t in ("one three four", "one or two three four", "one or even two three a b four", "one three a b c four", "one two three four", "one three a")] == [3, 5, 8, None, None, None]
    labels = lambda t: {s[0] for s in scanned(t)["spans"]}
    assert labels("Licensed under the Apache License, Version 2.0.") == {"apache-2.0"}
    assert labels("This work is licensed under the GNU General Public License, version 3.") == {"gpl-3.0"}
    assert labels("Licensed under CC BY-NC 4.0.") == {"cc-by-nc-4.0"}
    assert labels("Licensed under the Apache Licence, Version 2.0.") == set()


def test_replaceable_patterns():
    a = licenses.compile_template("x", "<<1:ab?>> one <<2:[0-9]+>> two")
    match = lambda t: a.match(t.encode().split(), 0)
    assert [match(t) for t in ("one two", "a one 1 22 two", "ab one two", "c one two", "one x two", "one 1 2 3 two")] == [2, 5, 3, None, None, None]
    for wrong in ("[[a]]", "<<2>> a", "[[a b", "a ]]"):
        with pytest.raises(ValueError, match="template|region"):
            licenses.compile_template("x", wrong)


def test_whole_licenses():
    whole = lambda t: {(s[0], s[1]) for s in scanned(t)["spans"]}
    mit = re.sub("<<12>>", "THE AUTHORS OR COPYRIGHT HOLDERS", re.sub(r"\[\[.*?\]\]", "", next(t for label, kind, t in licenses.TEMPLATES if (label, kind) == ("mit", "text")).split("]]", 2)[2]))
    for before in ("", "Copyright (c) 2024 A. Holder\n\n", "MIT License\n\nCopyright 1999-2001, 2020 Some Company & Co. KG "):
        assert whole(f"x y {before}{mit}. and more") == {("mit", "text")} and scanned(before + mit)["score"] == 1.0
    words = mit.split()
    for i in range(0, len(words), 7):  # one mandatory word changed or left out
        assert ("mit", "text") not in whole(" ".join([*words[:i], words[i] + "x", *words[i + 1 :]])) | whole(" ".join(words[:i] + words[i + 1 :]))
    for label, name, tail in licenses.FILES:
        t = (Path(licenses.__file__).parent / "license_texts" / name).read_text()
        body = t.partition(tail)[0] if tail else t
        assert (label, "text") in whole(t.upper()) & whole(f"see: {body}")
        assert (label, "text") not in whole(t.replace(" shall ", " should ").replace(" must ", " might ").replace(" may ", " can "))


def test_base_columns_of_the_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in licenses.digest(licenses.scan(docs)).collect()}
    for r in docs.collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        at = {label: [i for i in range(len(w)) if w[i : i + len(p.split())] == p.split()] for p, label in licenses.PHRASES}
        places = sorted(x for v in at.values() for x in v)
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word) == (len(w), len(places), min(places, default=None), max(places, default=None))
        assert g.base_labels == ",".join(sorted(k for k, v in at.items() if v)) and set(filter(None, g.base_labels.split(","))) <= set(g.labels.split(","))


# --- Extraction ---------------------------------------------------------------------------------------------------

CASES = [
    (None, ""), ("", ""), ("<p>", ""), ("<!-- never closed <p>x</p>", ""), ("<script>var a = '<p>x</p>'", ""), ("plain &amp; text", "plain & text"),
    ('<nav><p>menu</p></nav><article><h1>T&eacute;</h1><p><b>One, two<br><p>three  four</p></article><footer>f</footer>', "Té One, two three four"),
    ('<div class="wrap"><div id="sidebar"><p>side, bar, text that is long</p></div><main><p>a</p><div class="comments"><p>c, c, c</p></div><form>f</form></main></div>', "a"),
    ('<body class="has-sidebar"><div><p>Body, text.</p><aside>x</aside></div></body>', "Body, text."),
    ("<article><p>a<i>b</i>c</p><ul><li>x<li>y</ul><table><tr><td>1<td>2</table></article>", "abc x y 1 2"),
]


@pytest.mark.parametrize("opening", ["<div>", "<b>", "<header>", "<table><tr><td>", "<p><object><div>", "<ul><li>", "<x-y>"])
def test_deep_nesting_takes_linear_time(opening):
    """100,000 open elements; climbing the tree for each would take minutes."""
    start = time.process_time()
    text = extract.main_text(opening * 100_000 + "some text, here")
    assert time.process_time() - start < 60 and text in ("some text, here", "")


@pytest.mark.parametrize(("html", "text"), CASES)
def test_main_text(html, text):
    assert extract.main_text(html) == text


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<b>", "</b>", "<ul>", "<li>", "<a href=x>", "</a>", "text, more", "<!--", "-->", "<script>", "</script>", "<td>", '<x y="', "&amp;"]), max_size=30))
def test_any_markup_gives_a_text(parts):
    assert isinstance(extract.main_text("".join(parts)), str)


def test_extract_table(spark):
    pages = spark.createDataFrame([(1, "u", CASES[6][0]), (2, None, None), (2, None, None)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert [(r.page_id, r.text, r.n_chars) for r in extract.extract(pages).orderBy("page_id").collect()] == [(1, "Té One, two three four", 22), (2, "", 0), (2, "", 0)]
    assert extract.extract(pages.limit(0)).count() == 0


def test_pages_give_their_article(spark, sf_dir):
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        plain = re.sub(r"<[^>]+>", "", re.sub(r"</?(?:br|p|h1)>", " ", body)).replace("&quot;", '"').replace("&lt;", "<").replace("&amp;", "&")
        assert extract.main_text(r.html) == " ".join(plain.split())


# --- Packing ------------------------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=25))
def test_plan_places_every_piece_once(counts):
    steps, bins = packing.plan(counts, 64)
    content = defaultdict(list)
    ranks = Counter()
    for s in steps:
        assert s.rank == ranks[s.length]
        ranks[s.length] += s.count
        for i in range(s.count):
            content[s.bin + i // s.per].append((s.offset + i % s.per * s.length, s.length))
    assert ranks == Counter(counts) and set(content) == set(range(bins))
    for pieces in content.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64 and sum(3 * n > 64 for _, n in pieces) <= 2
    assert bins <= greedy_bins(counts, 64)


def greedy_bins(counts, capacity):
    """Bins by plain matching of one piece after the other, and best fit for the small ones."""
    pool = sorted(n for n, c in counts.items() for _ in range(c) if 3 * n > capacity)
    rooms = []
    while pool:
        a = pool.pop()
        i = bisect_right(pool, capacity - a) - 1
        insort(rooms, capacity - a - (pool.pop(i) if i >= 0 else 0))
    for n in sorted((n for n, c in counts.items() for _ in range(c) if 3 * n <= capacity), reverse=True):
        i = bisect_left(rooms, n)
        insort(rooms, (rooms.pop(i) if i < len(rooms) else capacity) - n)
    return len(rooms)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1366, 4096), st.integers(1, 5), max_size=30))
def test_large_pieces_are_matched(counts):
    """Pieces over a third: as few bins as matching one by one, which is the least possible for them."""
    assert packing.plan(counts, 4096)[1] == greedy_bins(counts, 4096)


def test_last_piece_of_a_length_is_matched():
    assert packing.plan({2000: 1, 1900: 1}, 4096)[1] == 1 and packing.plan({n: 1 for n in range(1366, 1966)}, 4096)[1] == 300


def test_packed_documents(spark, sf_dir, documents):
    from tokenizers import Tokenizer

    rows = packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path()).collect()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    by, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for d, t in documents:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        pieces = sorted(by[d], key=lambda r: r.piece)
        assert [p.start for p in pieces] == list(range(0, len(ids), 4096))
        for p in pieces:
            part = ids[p.start : p.start + 4096]
            assert (p.length, p.ids_crc32) == (len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
    for content in sequences.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= 1.02 * sum(r.length for r in rows) / 4096 + 1


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    texts = ["Don't stop, it's 5.30 o'clock!!", "é È ALİ. ǅ ﬁ", "á. x y z", "'s 's't", "", "\x1c\x1d tab\tnew\n\nline", "|||| a | b |", "日本語。テスト 123", "école, ÉCOLE"]
    texts += ["  lead and trail  ", " ", "\u00a0no-break\u2003wide", "word " * 50]
    for slice_bytes in (1, 30, 10**6):
        got = list(packing.Encoder(tokenizer_path(), keep=10, slice_bytes=slice_bytes).encode(pa.array([*texts, None]), None))
        assert [g.tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts] + [[]]
    assert [g.tolist() for g in packing.Encoder(tokenizer_path()).encode(pa.array([None, ""], pa.string()), 1)] == [[1], [1]]


WORDS = st.text(st.sampled_from("abzEÉéßÀ×÷ÿńŁжЖİſKÅ日\u0301\u0338\u200d\x00\x1c\u00a0'.,=0٣-"), max_size=20) | st.sampled_from(["a" * 15, "a" * 16, "é" * 7 + "a", "é" * 8, "a" * 300, "a\x00", "don't,", "x=\u0338"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(WORDS, max_size=12).map(" ".join), max_size=5), st.integers(1, 40), st.integers(1, 200))
def test_encoder_on_odd_words(texts, keep, slice_bytes):
    """Words of all alphabets and lengths, and a cache that forgets: as the tokenizer alone, by the bare model and without it."""
    by = coders()
    for name in ("bare", "full"):
        by[name].keep, by[name].slice_bytes = keep, slice_bytes
        got = [g.tolist() for g in by[name].encode(pa.array([*texts, None], pa.string()), None)]
        assert got == [by["full"].tokenizer.encode(t, add_special_tokens=False).ids for t in texts] + [[]]


@lru_cache
def coders():
    by = {name: packing.Encoder(tokenizer_path()) for name in ("bare", "full")}
    assert by["bare"].bare
    by["full"].bare = False
    return by


SYLLABLES = [x + y for x in "bcdfghjklm" for y in "aeiouy"]


def test_words_are_learnt_once(monkeypatch):
    """Over 230,000 words in turn, with and without marks, stay in the cache: each goes to the tokenizer once."""
    words = [f"{a}{b}{c}{d}e" for a in "bcdfghjklmn" for b in "aeiouy" for c in SYLLABLES for d in SYLLABLES]
    texts = pa.array([" ".join(words[i : i + 5000]) for i in range(0, len(words), 5000)] + [", ".join(words[i : i + 5000]) for i in range(0, len(words), 5000)])
    encoder, learnt = packing.Encoder(tokenizer_path()), Counter()
    learn = encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda new: (learnt.update(new), learn(new))[1])
    assert sum(1 for _ in encoder.encode(texts, 1)) == len(texts) and len(words) > 230_000
    assert sum(n for w, n in learnt.items() if w not in (b",", b"")) == len(words)


def test_packing_tables(odd, empty):
    rows = packing.pack(odd, tokenizer_path(), per_salt=1).collect()
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(d for d, _, _ in ODD)
    assert [r.length for r in rows if r.doc_id in (1, 2, 3)] == [1, 1, 1]
    assert packing.pack(empty, tokenizer_path()).count() == 0


# --- Toxicity -----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def restorer(documents):
    return toxicity.Restorer(toxicity.smoothed(toxicity.trigram_counts([t for _, t in documents] + ["you stupid idiot moron scum pathetic trash clown"] * 30).reshape((toxicity.SYMBOLS,) * 3)))


@pytest.mark.parametrize(("token", "word"), [("1d10t", "idiot"), ("m0r0n!!", "moron"), ("stuuupid", "stupid"), ("p4th3tic", "pathetic"), ("$cum", "scum"), ("s.t.u.p.i.d", "stupid"), ("tr@sh,", "trash"), ("he%%%", "he"), ("école", "école"), ("108.51.216.133", "108.51.216.133"), ("", ""), ("іdiоt", "idiot"), ("ѕtuріd", "stupid")])
def test_restored_words(restorer, token, word):
    assert restorer.word(token) == word


def test_letters_apart(restorer):
    assert {"stupid", "moron"} <= restorer.words("s t u p i d and m-o-r-o-n")


def test_features_are_those_of_the_restored_words(restorer, documents):
    """The quick way over plain tokens gives what the words give, also when caches are emptied."""
    weights = {g: float(len(w)) for w in ("stupid", "moron", "ation", "idiot") for g in toxicity.grams(w)}
    texts = [t for _, t in documents[:60]] + [None, "", "s t u p i d", "a b 1d10t", "x\ny z\nmoron moron m o r o n", "m. o. r. o. n!"]
    for keep in (10, 300_000):
        telling = toxicity.Telling(toxicity.Restorer(np.array(restorer.costs), keep), weights, keep)
        for t in texts * 2:
            assert telling.features(t) == toxicity.features(restorer.words(t), telling.weight)


def test_long_tokens_and_repeated_rows(spark, restorer):
    assert restorer.word("s.t.u.p.i.d" + "x0" * 30_000)[:6] == "stupid"  # linear in the token's length
    rows = [(i, f"word{i} {'you idiot' if i % 4 == 0 else 'friend'}") for i in range(400)] + [(500, "you 1d10t " + "word " * 200_000), (501, "you 1d10t"), (501, "you 1d10t")]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    out = toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), labels).where("doc_id >= 500").collect()
    assert sorted(r.doc_id for r in out) == [500, 501, 501] and len({r.score for r in out}) == 1 and out[0].predicted == 1


def test_viterbi_equals_all_readings(restorer):
    import itertools

    costs = restorer.costs
    for token in ("1d0t", "c1@", "aaa3", "t.0"):
        best = None
        for path in itertools.product(*toxicity.lattice(token)):
            a = b = 0
            cost = sum(c for _, c in path)
            for ch in "".join(t for t, _ in path):
                z = toxicity._symbol(ch)
                cost += costs[a][b][z] if z else toxicity.OTHER_COST
                a, b = b, z
            best = min(best or (9e9, ""), (cost + costs[a][b][0], "".join(t for t, _ in path)))
        assert toxicity.decode(token, costs) == best[1]


def test_toxicity_learns_and_holds_out(spark):
    clean = "the cat sat on a mat and then it ran"
    rows = [(i, f"{clean} {'you idiot' if i % 4 == 0 else 'friend'} {i}") for i in range(400)] + [(1000, "you 1d10t here"), (1001, None), (1002, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(1, 0), (None, 1)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(out) == len(rows)
    for i in range(400):
        assert out[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and out[i].predicted == int(i % 4 == 0)
    assert out[1000].predicted == 1 and out[1001].score == out[1002].score < 0.5
    assert toxicity.toxicity(docs.limit(0), labels.limit(0)).count() == 0
    assert {r.predicted for r in toxicity.toxicity(docs, labels.where("toxic = 0")).collect()} == {0}


# --- Language -----------------------------------------------------------------------------------------------------


def brute_languages(pages, docs):
    """page_id -> (lang, prob), by plain loops over the evidence."""
    counts = defaultdict(Counter)
    for lang, t in docs:
        counts[lang].update(language.gram_buckets(t).tolist())
    langs = sorted(counts)
    size = {x: sum(counts[x].values()) + 0.5 * language.BUCKETS for x in langs}
    share = lambda w: [x / sum(w) for x in w]
    rows = []
    for i, url, html in pages:
        grams = language.gram_buckets(extract.main_text(html)).tolist()
        ll = [0.05 * sum(math.log((counts[x][g] + 0.5) / size[x]) for g in grams) for x in langs]
        ll = [max(x - max(ll), -30.0) for x in ll]
        host, path = re.match(r"https?://([^/?#:]*)[^/?#]*([^?#]*)", url.lower()).groups()
        rows.append((i, host, ".".join(host.split(".")[-2:]), language.declared_language(html), language.address_language(host, path), ll, share([math.exp(x) for x in ll])))
    k = range(len(langs))
    total = [sum(r[6][j] for r in rows) for j in k]
    everywhere = [(t + 1) / (sum(total) + len(langs)) for t in total]

    def likelihood(c, value, j):
        return math.log((sum(r[6][j] for r in rows if r[c] == value) + 0.5) / (total[j] + 0.5 * (len({r[c] for r in rows}) + 1)))

    out = {}
    for r in rows:
        others = lambda c: [max(sum(x[6][j] for x in rows if x[c] == r[c]) - r[6][j], 0.0) for j in k]  # noqa: B023, E731
        domain, host = others(2), others(1)
        domain = [(d + 20 * e) / (sum(domain) + 20) for d, e in zip(domain, everywhere, strict=True)]
        host = [(h + 5 * d) / (sum(host) + 5) for h, d in zip(host, domain, strict=True)]
        fused = [r[5][j] + likelihood(3, r[3], j) + likelihood(4, r[4], j) + math.log(host[j]) for j in k]
        post = share([math.exp(x - max(fused)) for x in fused])
        out[r[0]] = (langs[post.index(max(post))], max(post))
    return out


def test_languages_equal_brute_force(spark, sf_dir):
    pages, docs = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "documents"))
    expected = brute_languages([(r.page_id, r.url, r.html) for r in pages.collect()], [(r.lang, r.text) for r in docs.collect()])
    got = {r.page_id: (r.lang, r.prob) for r in language.identify(pages, docs).collect()}
    assert {i: x[0] for i, x in got.items()} == {i: x[0] for i, x in expected.items()} and len({x[0] for x in got.values()}) > 1
    assert all(math.isclose(got[i][1], expected[i][1], rel_tol=1e-6) for i in got)


def test_long_and_repeated_pages(spark):
    docs = spark.createDataFrame([(i, "the house and the garden" if i % 2 else "das haus und der garten", "en" if i % 2 else "de") for i in range(20)], "doc_id long, text string, lang string")
    rows = [(1, "https://a.org/", f"<p>{'the garden and the house ' * 40_000}</p>"), (2, "https://b.org/", "<p>der garten</p>"), (2, "https://b.org/", "<p>der garten</p>")]
    out = language.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect()
    assert sorted((r.page_id, r.lang) for r in out) == [(1, "en"), (2, "de"), (2, "de")]


def test_language_fusion(spark):
    docs = spark.createDataFrame([(i, "the house and the garden with a tree" if i % 2 else "das haus und der garten mit einem baum", "en" if i % 2 else "de") for i in range(40)], "doc_id long, text string, lang string")
    page = lambda lang, t: f'<html lang="{lang}"><article><p>{t}</p></article></html>'
    english, german = "the tree and the house in a garden", "der baum und das haus mit dem garten"
    rows = [(i, f"https://h{i % 2}.example.com/{'en' if i % 2 else 'de'}/{i}", page("en" if i % 2 else "de", english if i % 2 else german)) for i in range(30)]
    rows += [(100, "https://h1.example.com/en/x", None), (101, None, None), (102, "https://h0.example.com/de/y", page("de", "")), (103, "https://h1.example.com/en/z", page("de", english))]
    out = {r.page_id: r for r in language.identify(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")), docs).collect()}
    assert len(out) == len(rows) and all(out[i].lang == ("en" if i % 2 else "de") for i in range(30))
    assert (out[100].lang, out[100].text_lang, out[102].lang, out[103].lang) == ("en", None, "de", "en")
    assert 0 < out[101].prob <= 1
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert language.identify(none, docs).count() == 0
    assert language.identify(none, docs.limit(0)).count() == 0
