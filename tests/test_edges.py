"""Sources with a caller's functions, images, orders and searches by their parts."""

import struct
import zlib
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.functions import dates, stem, text
from webloom.operators import images, paragraphs, relevance, similarity
from webloom.plans.edges import jpeg_head, png
from webloom.sources import fetch, search


def filtered_png(pixels: np.ndarray) -> bytes:
    """A PNG whose lines use all five filters in turn."""
    height, width, step = pixels.shape
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    flat = pixels.reshape(height, -1).astype(int)
    raw = b""
    for y in range(height):
        now, up = flat[y], flat[y - 1] if y else np.zeros(width * step, int)
        left, corner = np.r_[np.zeros(step, int), now[:-step]], np.r_[np.zeros(step, int), up[:-step]]
        p = left + up - corner
        paeth = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        guess = [np.zeros_like(now), left, up, (left + up) // 2, paeth][y % 5]
        raw += bytes([y % 5]) + ((now - guess) % 256).astype(np.uint8).tobytes()
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[step]
    return images.PNG_START + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("step", [1, 2, 3, 4])
def test_png_filters(step):
    pixels = np.random.default_rng(step).integers(0, 256, (11, 7, step)).astype(np.uint8)
    im = images.read_png(filtered_png(pixels))
    assert im.mode == {1: "L", 2: "LA", 3: "RGB", 4: "RGBA"}[step]
    assert (im.rgb == (pixels[:, :, :3] if step >= 3 else np.repeat(pixels[:, :, :1], 3, axis=2))).all()
    assert (im.alpha is None) if step in (1, 3) else (im.alpha == pixels[:, :, -1]).all()


def test_figures():
    f = images.figures(png(30, 20, (255, 0, 0, 254)))
    assert (f["width"], f["height"], f["aspect_ratio"], f["has_transparency"], f["color_mode"], f.get("error")) == (30, 20, 1.5, True, "RGBA", None)
    assert f["dominant_colors"] == [{"r": 255, "g": 0, "b": 0, "percentage": 100.0}]
    assert not images.figures(png(3, 2, (1, 2, 3, 255)))["has_transparency"]
    assert images.exif(jpeg_head("Maker", "2024:01:02 03:04:05", 640)) == {"ImageWidth": "640", "Make": "Maker", "DateTime": "2024:01:02 03:04:05"}
    assert images.exif(b"") == images.exif(b"\xff\xd8Exif\x00\x00XX") == {}
    assert [images.figures(c)["error"] for c in (None, b"")] == ["no content"] * 2 and "error" in images.figures(b"x") and images.figures(b"x" * 99, most_bytes=9)["error"] == "over 9 bytes"


def test_image_store(spark):
    store = spark.createDataFrame([("u", bytearray(png(4, 2, (255, 0, 0)))), ("v", bytearray(b"x"))], "url string, content binary")
    out = {r.url: r for r in images.of_store(store)(spark.createDataFrame([(1, "u"), (1, "v"), (2, "none")], "expression_id long, url string")).collect()}
    assert set(out) == {"u", "v"} and out["u"].websafe_colors == {"#ff0000": "100.0"} and out["v"].analysis_error and out["u"].analysis_error is None


def test_next_pages():
    more = lambda **p: search.next_start({"serpapi_pagination": p}, 10, 5)
    assert [more(), more(next_link="x", next_offset=20), more(next="https://x/?first=30"), more(next_link="https://x/?start=3"), more(next="x", next_offset="y")] == [None, 20, 30, 15, 15]
    answers = iter([{"organic_results": [1, 2], "serpapi_pagination": {"next": "x"}}, {"error": "DuckDuckGo hasn't returned any results"}])
    assert list(search.pages_of({"engine": "duckduckgo"}, lambda p: next(answers), "start")) == [1, 2]
    with pytest.raises(search.SearchError):
        list(search.pages_of({"engine": "google"}, lambda p: {"error": "quota"}, "start"))


@pytest.mark.parametrize(("engine", "start", "end"), [("bing", "2024-01-01", "2024-01-02"), ("google", "2024-01-01", None), ("google", "2024-02-01", "2024-01-01")])
def test_wrong_dates(spark, engine, start, end):
    q = spark.createDataFrame([("q", engine, "fr", start and date.fromisoformat(start), end and date.fromisoformat(end))], "query string, engine string, lang string, start date, end date")
    with pytest.raises(Exception, match="dates of query q"):
        search.requests(q).collect()


def test_metrics_retry(spark):
    def get(url):
        get.n = getattr(get, "n", 0) + 1
        return (500, "") if get.n < 3 else (200, '{"a":1}')

    pages = spark.createDataFrame([(1, "https://a.org/x y")], "id long, url string")
    assert [tuple(r) for r in search.metrics(pages, get, waits=(0, 0)).collect()] == [(1, '{"a": 1}')]
    assert [tuple(r) for r in search.metrics(pages, lambda u: (200, f'"{u}"'), waits=()).collect()] == [(1, '"https://a.org/x%20y"')]


def test_extractor_errors(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, "u", "x")], "id long, url string, html string")
    assert {r.id: r.error for r in fetch.extracted(pages, lambda u, h: {"title": h}).collect()} == {1: "no markup", 2: None}


def test_strict_date(spark):
    one = lambda t: spark.createDataFrame([(t,)], "t string").select(dates.strict_date(F.col("t"))).first()[0]
    assert one("2024-02-29") == date(2024, 2, 29)
    with pytest.raises(Exception):  # noqa: B017
        one("29/02/2024")


@pytest.mark.parametrize("k", [1, 3, 50])
def test_nearest_equals_a_plain_search(spark, k):
    r = np.random.default_rng(8)
    vectors = np.round(r.normal(size=(40, 6)), 1)
    vectors[20:30] = vectors[:10]  # ties
    df = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(vectors)], "id long, page long, embedding array<double>")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 6)
    expected = {(i, j) for i in range(40) for j in sorted((j for j in range(40) if j != i), key=lambda j: (-scores[i, j], j))[:k]}
    for blocks in (1, 3, None):
        assert {(x.source_id, x.target_id) for x in similarity.nearest(df, k, blocks).collect()} == expected


def test_neutral_end_of_the_chain():
    def broken():
        raise OSError("no model")

    with pytest.warns(UserWarning, match="no model"):
        assert similarity.first_predictor(broken)(["a"], ["b"]) == [(0, 0.5)]
    with pytest.warns(UserWarning):
        assert similarity.first_predictor(similarity.cross_encoder("none"), similarity.sequence_classifier("none")) is similarity.neutral


def test_stemmed_relevance_equals_a_plain_loop(spark, sf_dir):
    import re

    words = lambda t: re.findall("[A-Za-zÀ-ÖØ-öø-ÿ]+", (t or "").lower())
    terms = ["les enfants", "mentions", "dans", "de la"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("text").alias("readable"))
    lemmas = {" ".join(stem.stem(w) for w in words(t)) for t in terms}

    def points(t):
        s = [stem.stem(w) for w in words(t)]
        n = sum(x in lemmas for x in s)
        for lemma in (x.split() for x in lemmas if " " in x):
            i = 0
            while i + len(lemma) <= len(s):
                hit = s[i : i + len(lemma)] == lemma
                n, i = n + hit, i + (len(lemma) if hit else 1)
        return n

    got = relevance.relevance(docs, relevance.dictionary(spark.createDataFrame([(1, t) for t in terms], "land_id int, term string"))).collect()
    assert {r.id: r.relevance for r in got} == {r.id: 10 * points(r.title) + points(r.readable) for r in docs.collect()} and any(r.relevance for r in got)


def test_batches_number_all_rows(spark):
    rows = spark.range(1000).withColumn("id", F.col("id") * 7 % 1000).repartition(5)
    assert {r.id: r.batch_no for r in paragraphs.batches(rows, "id", 300).collect()} == {i: i // 300 + 1 for i in range(1000)}


def test_normalised_values(spark):
    df = spark.createDataFrame([(1, None, " Unknown ", [], {"a": 1}), (2, 3.5, " x ", ["y"], {})], "a int, b double, c string, d array<string>, e map<string,int>")
    assert [tuple(r) for r in text.normalised_columns(df).collect()] == [(1, None, "na", "na", '{"a":1}'), (2, 3.5, "x", '["y"]', "na")]
