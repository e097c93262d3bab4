"""The commands end to end on a corpus of a few pages."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from webloom import cli
from webloom.workspace import EXPORTS, Workspace

T0, T1, T2 = datetime(2024, 1, 1), datetime(2024, 1, 2), datetime(2024, 1, 3)
LONG = "Les enfants aiment la science et la lecture. " * 6
PAGES = [
    ("https://a.example/1", f'<html lang="fr"><title>Science</title><p>{LONG}</p><p><a href="https://b.example/2#x">l</a> <a href="/f.pdf">f</a> <img src="/I.png"></p></html>'),
    ("https://b.example/2", f'<html lang="fr"><title>Enfants</title><p>{LONG} Autre texte. <a href="https://a.example/1">b</a></p></html>'),
    ("https://c.example/3", '<html lang="de"><title>Science</title><p>science</p></html>'),
]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    w = Workspace(spark, str(tmp_path_factory.mktemp("corpus")))
    assert cli.dispatch(w, "db", "setup") == 1
    cli.dispatch(w, "land", "create", name="alpha", description="d", lang="fr", as_of=T0)
    assert cli.dispatch(w, "land", "addterm", name="alpha", terms=["science", "enfant", " "]) == 2
    assert cli.dispatch(w, "land", "addterm", name="alpha", terms=["science"]) == 0
    assert cli.dispatch(w, "land", "addurl", name="alpha", addresses="https://a.example/1, https://c.example/3 ,https://a.example/x.pdf,mailto:x", as_of=T0) == 2
    store = spark.createDataFrame(PAGES, "url string, html string")
    assert cli.dispatch(w, "land", "crawl", name="alpha", fetch=store, as_of=T1) == 2
    assert cli.dispatch(w, "land", "crawl", name="alpha", fetch=store, as_of=T2) == 1
    return w


def test_errors(corpus):
    for bad in (("nothing", "list"), ("land", "nothing")):
        with pytest.raises(ValueError):
            cli.dispatch(corpus, *bad)
    with pytest.raises(ValueError):
        corpus.land_id("none")
    with pytest.raises(ValueError):
        corpus.land_create("alpha")


def test_crawl(corpus):
    e = {r.url: r for r in corpus.table("expression").collect()}
    assert set(e) == {p[0] for p in PAGES}
    assert e["https://a.example/1"].relevance >= 22 and e["https://a.example/1"].approved_at == T1
    assert e["https://c.example/3"].relevance == 0 and e["https://c.example/3"].approved_at is None
    assert e["https://b.example/2"].depth == 1 and e["https://b.example/2"].domain == "b.example"
    assert corpus.table("expressionlink").count() == 2
    assert [r.url for r in corpus.table("media").collect()] == ["https://a.example/i.png"]


def test_lists(corpus):
    row = corpus.land_list().first()
    assert (row["name"], row["terms"], row["n_pages"], row["n_remaining"]) == ("alpha", "enfant,science", 3, 0)


def test_embeddings(corpus):
    n = cli.dispatch(corpus, "embedding", "generate", name="alpha", as_of=T2)
    assert n["paragraphs"] == n["embeddings"] == 3
    assert cli.dispatch(corpus, "embedding", "similarity", name="alpha", as_of=T2, threshold=0.5) >= 1
    assert cli.dispatch(corpus, "embedding", "similarity", name="alpha", as_of=T2, threshold=0.1, method="nli") >= 1
    assert corpus.embedding_check()["pairs"] >= 2


@pytest.mark.parametrize("export", EXPORTS)
def test_exports(corpus, tmp_path, export):
    path = cli.dispatch(corpus, "land", "export", name="alpha", export=export, folder=str(tmp_path), as_of=T2)
    assert list(tmp_path.iterdir()), path


def test_tag_exports(corpus, spark):
    land = corpus.land_id("alpha")
    first = corpus.table("expression").where("url = 'https://a.example/1'").first()["id"]
    corpus.write(tag=spark.createDataFrame([(1, land, None, "Theme", 1), (2, land, 1, "Air", 1)], "id long, land_id long, parent_id long, name string, sorting int"), taggedcontent=spark.createDataFrame([(2, first, "smog", 0, 2)], "tag_id long, expression_id long, text string, from_char int, to_char int"))
    assert [r.asDict() for r in corpus.tag_export("alpha", "matrix").collect()] == [{"expression_id": first, "Theme": 0, "Theme_Air": 1}]
    assert corpus.tag_export("alpha", "content").first()["slice"] == "sm"


def test_search_results_and_verdicts(corpus, spark):
    r = spark.createDataFrame([(1, "New", "https://n.example/1#a", "Apr 2, 2024"), (2, "Other", "https://a.example/1", "3 May 2020"), (3, "none", None, None)], "position int, title string, link string, date string")
    assert corpus.land_urlist("alpha", r, T2) == {"new": 1, "updated": 1, "skipped": 2}
    e = {x.url: x for x in corpus.table("expression").collect()}
    assert e["https://n.example/1"].title == "New" and e["https://a.example/1"].title == "Science" and e["https://a.example/1"].published_at == datetime(2020, 5, 3)
    yes = lambda p: p.select("id", F.lit("no").alias("answer"))
    assert corpus.land_llm_validate("alpha", yes) == 2
    assert {x.validllm for x in corpus.table("expression").where("relevance = 0 AND validllm IS NOT NULL").collect()} == {"non"}


def test_readable_and_consolidate(corpus, spark):
    first = corpus.table("expression").where("url = 'https://a.example/1'").first()["id"]
    new = spark.createDataFrame([(first, "Science et enfants", None, None, LONG + "[z](https://z.example/9)")], "id long, title string, description string, published_at timestamp_ntz, readable string")
    stats = corpus.land_readable("alpha", new, datetime(2024, 2, 1)).first()
    assert stats["readable"] == 3
    e = corpus.table("expression").where(F.col("id") == first).first()
    assert e["title"] == "Science et enfants"
    assert corpus.land_consolidate("alpha", datetime(2024, 2, 2)) >= 1
    assert corpus.land_seorank("alpha", lambda p: p.select("id", F.lit('{"k": 1}').alias("seorank")), http=None, minrel=0) >= 1
    assert corpus.land_medianalyse("alpha", lambda m: m.withColumn("width", F.lit(640)), T2) == 1
    assert corpus.heuristic_update() == 0
    assert corpus.fix_archive_domains(dryrun=True).count() == 0
    assert corpus.db_migrate() == 0
    assert corpus.domain_crawl(lambda u: __import__("webloom.sources.fetch", fromlist=["x"]).Fetched("200", "<title>t</title>"), T2, limit=2) == 2


def test_delete(corpus):
    corpus.embedding_reset("alpha")
    assert corpus.table("paragraph").count() == 0
    corpus.land_delete("alpha")
    assert corpus.table("expression").count() == corpus.table("land").count() == corpus.table("expressionlink").count() == 0


def test_appended_parts(spark, tmp_path, monkeypatch):
    """Added rows are parts of the snapshot; a failed command leaves it as it was; too many parts become one."""
    from webloom import workspace

    monkeypatch.setattr(workspace, "MOST_PARTS", 3)
    w = Workspace(spark, str(tmp_path / "w"))
    w.db_setup()
    parts = []
    for i in range(4):
        w.land_create(f"l{i}")
        parts.append(len(w._pointers()["land"]))
    assert parts == [2, 3, 1, 2] and sorted((r.id, r.name) for r in w.table("land").collect()) == [(i + 1, f"l{i}") for i in range(4)]
    with pytest.raises(Exception, match="stop"):
        w.append(land=spark.range(1).select(F.raise_error(F.lit("stop")).cast("long").alias("id")))
    assert w.table("land").count() == 4 and w.db_migrate() == 0


def test_command_line_with_tables(spark, corpus, tmp_path):
    """Payloads, answers and files come from Parquet tables."""
    from webloom.plans.edges import png

    tables = {
        "payloads": spark.createDataFrame([("https://a.example/1", '{"k":1}')], "url string, seorank string"),
        "answers": spark.range(1, 100).select("id", F.lit("oui").alias("answer")),
        "images": spark.createDataFrame([("https://a.example/i.png", bytearray(png(3, 2, (255, 0, 0))))], "url string, content binary"),
    }
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / name))
    for verb, name in (("seorank", "payloads"), ("llm validate", "answers"), ("medianalyse", "images")):
        when = ["--as-of", "2024-01-03"] if name == "images" else []
        assert cli.main(["--root", str(corpus.root), "--name", "alpha", f"--{name}", str(tmp_path / name), *when, "land", *verb.split()]) == 0
    e = {r.url: r for r in corpus.table("expression").collect()}
    assert e["https://a.example/1"].seorank == '{"k":1}' and e["https://a.example/1"].validllm == "oui"
    m = corpus.table("media").first()
    assert (m.width, m.height, m.websafe_colors, m.analyzed_at) == (3, 2, {"#ff0000": "100.0"}, T2.replace(day=3))
