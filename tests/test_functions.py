"""Scalars on literal inputs, sinks, fetching and streams."""

import xml.etree.ElementTree as ET
import zipfile
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.functions import html, stem, text, urls
from webloom.operators import media, similarity
from webloom.sources import fetch, sinks
from webloom.streaming import fetchlog


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("base", "url", "expected"),
    [
        ("https://example.com/path/", "../asset.png", "https://example.com/asset.png"), ("https://example.com/a/b", "/Img/X.PNG", "https://example.com/img/x.png"), ("https://example.com/a/", "c.JPG", "https://example.com/a/c.jpg"),
        ("https://example.com/", "//cdn.org/I.png", "https://cdn.org/i.png"), ("https://example.com/", "HTTPS://E.org/A", "https://e.org/a"), ("https://example.com/a", None, None),
    ],
)
def test_resolved(spark, base, url, expected):
    assert one(spark, urls.resolved(F.lit(base), F.lit(url).cast("string"))) == expected


def test_url_helpers(spark):
    assert one(spark, urls.without_anchor(F.lit("https://example.com/page#section"))) == "https://example.com/page"
    assert "example" in one(spark, urls.domain_name(F.lit("https://twitter.com/example/status/1")))
    assert one(spark, urls.split_list(F.lit("a, b ,c"))) == ["a", "b", "c"]
    assert one(spark, urls.percent_encoded(F.lit("https://e.org/à b?x=1"))) == "https://e.org/%C3%A0%20b?x=1"
    assert one(spark, urls.resolved_or_data(F.lit("https://e.org/"), F.lit("data:x"))) == "data:x"


def test_words_and_stems(spark):
    assert one(spark, text.words(F.lit("Bonjour! Les enfants jouent à l'école 123."))) == ["bonjour", "les", "enfants", "jouent", "à", "l", "école"]
    assert [stem.stem(w) for w in ("enfants", "continuellement", "chevaux", "")] == ["enfant", "continuel", "cheval", ""]


def test_readable_drops_what_is_not_read():
    root = html.parse('<script>bad()</script><nav>menu</nav><p>Hello <img src="a.png"></p><div class="menu x">m</div><p>two')
    html.clean(root)
    assert html.readable(root) == "Hello [IMAGE: a.png] two"


def test_paragraph_fallback(spark):
    assert one(spark, text.paragraphs(F.lit(" short \n text "))) == ["short text"]
    assert one(spark, text.paragraphs(F.lit("a" * 200 + "\n \n" + "b" * 10 + "\n\n" + "c" * 150))) == ["a" * 200, "c" * 150]
    assert one(spark, text.paragraphs(F.lit("x" * 7000))) == ["x" * 6000]
    assert one(spark, text.paragraphs(F.lit(None).cast("string"))) == []


def test_blocked_pairs_equal_expressions(spark):
    r = np.random.default_rng(1)
    rows = [(i, i % 4, [float(x) for x in r.normal(size=8)]) for i in range(60)]
    df = spark.createDataFrame([*rows, (60, 1, [0.0] * 8)], "id long, page long, embedding array<double>")
    plain = {tuple(x) for x in similarity.expression_pairs(df, 0.4).collect()}
    assert {tuple(x) for x in similarity.exact_pairs(df, 0.4, blocks=3).collect()} == plain
    near = {(x.source_id, x.target_id) for x in similarity.bucket_pairs(df, 0.4, bits=2, size=8).collect()}
    assert near <= {(p[0], p[1]) for p in plain}


def test_colours():
    pixels = np.array([[255, 0, 0]] * 75 + [[0, 0, 255]] * 25)
    assert media.dominant_colours(pixels) == [((255, 0, 0), 75.0), ((0, 0, 255), 25.0)]
    assert media.has_transparency("RGBA", np.array([255, 3])) and not media.has_transparency("RGB", None)


def test_graph_file(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 'a "b" <c>', 3, None), (2, None, 1, "x")], "id long, title string, relevance int, url string")
    edges = sinks.gexf_edges(spark.createDataFrame([(1, 2, 4)], "s long, t long, w int"), "s", "t", "w")
    path = str(tmp_path / "g.gexf")
    sinks.gexf(path, sinks.gexf_nodes(nodes, "title", "relevance", ["url"]), edges, [("url", "string")], datetime(2024, 1, 2))
    root = ET.parse(path).getroot()
    ns = {"g": sinks.GEXF}
    assert [n.get("label") for n in root.findall(".//g:node", ns)] == ['a "b" <c>', "na"]
    assert [(e.get("id"), e.get("weight")) for e in root.findall(".//g:edge", ns)] == [("1_2", "4")]


def test_corpus_archives(spark, tmp_path):
    pages = spark.range(1, 6).select("id", F.lit("T à").alias("title"), F.lit(None).cast("string").alias("description"), F.lit("d").alias("domain"), F.lit("u").alias("url"), F.when(F.col("id") != 2, "body").alias("readable"))
    assert sinks.save_binary(sinks.corpus(pages, "c", size=2), str(tmp_path)) == 3
    assert sorted(p.name for p in tmp_path.iterdir()) == ["c_00001.zip", "c_00002.zip", "c_00003.zip"]
    z = zipfile.ZipFile(tmp_path / "c_00001.zip")
    assert z.namelist() == ["1-t-a.txt", "2-t-a.txt"]
    assert z.read("1-t-a.txt").decode().endswith("---\nbody")


def test_file_names():
    assert sinks.file_name("land", "x", "pagecsv", datetime(2024, 1, 2, 3, 4, 5)) + sinks.extension("pagecsv") == "export_land_x_pagecsv_20240102030405.csv"
    assert (sinks.extension("pseudolinkspage"), sinks.extension("nodegexf"), sinks.extension("corpus")) == ("", ".gexf", ".zip")


def test_append_new(spark, tmp_path):
    path = str(tmp_path / "t")
    for _ in range(2):
        sinks.append_new(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string"), path, ["k"])
    assert spark.read.parquet(path).count() == 2


def test_retries_and_ladder():
    waits, calls = [], []

    def failing(url):
        calls.append(url)
        if len(calls) < 3:
            raise OSError
        return fetch.Fetched("200", "x")

    assert fetch.with_retries(failing, sleep=waits.append)("u").html == "x"
    assert waits == [1, 2]
    broken = lambda u: (_ for _ in ()).throw(fetch.ClientError())
    assert fetch.ladder(broken, lambda u: fetch.Fetched("404", None))("u").status == fetch.CLIENT_ERROR
    assert fetch.ladder(broken, lambda u: fetch.Fetched("200", "h"))("u") == ("200", "h")


def test_stream_windows(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = fetchlog.windowed(stream, late="1 hour").writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("w").collect()} == {tuple(r) for r in fetchlog.windowed(batch).collect()}
