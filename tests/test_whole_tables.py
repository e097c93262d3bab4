"""The reference's operators do the whole job: no rows are left out by an id or a cap."""

import pytest

from webloom.operators import relevance
from webloom.plans import registry


def test_all_documents_and_links_are_processed(spark):
    d = "/root/testdata/sf0.01"  # more than 500 documents
    docs = {r.doc_id for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id").collect()}
    run = lambda name: registry.queries()[name](spark, d)
    assert {f"https://s/{i}" for i in docs} <= {r.url for r in run("x8_search_ingestion").select("url").collect()}
    assert {(r.source_id, r.url) for r in run("x4_consolidation").collect()} == {(i, f"https://n.example/{i % 50}") for i in docs}


def test_frontier_equals_breadth_first_search(spark, sf_dir):
    from webloom.plans import relational as R

    links: dict[int, set[int]] = {}
    for a, b in R.A.links(spark, sf_dir).select("source_id", "target_id").collect():
        links.setdefault(a, set()).add(b)
    depth = {r.id: 0 for r in R.pages(spark, sf_dir).where("id % 50 = 1").select("id").collect()}
    now = set(depth)
    for i in (1, 2, 3):
        now = {b for a in now for b in links.get(a, ())} - set(depth)
        depth |= dict.fromkeys(now, i)
    assert {r.id: r.depth for r in registry.queries()["r2_frontier"](spark, sf_dir).collect()} == depth


@pytest.mark.parametrize("stemmed", [False, True])
def test_every_lemma_of_several_words_counts(spark, stemmed):
    """1,500 phrases, each on a page of its own: in the title once and in the text twice."""
    names = ["k" + str(i).translate(str.maketrans("0123456789", "bcdfgjlmnp")) + "k" for i in range(1500)]
    terms = spark.createDataFrame([(1, f"{x} zzk") for x in names] + [(1, "aak aak")], "land_id int, term string")
    rows = [(i, f"{x} zzk", f"{x} zzk, {x} zzk; {x} other") for i, x in enumerate(names)] + [(-1, None, "aak aak aak aak aak"), (-2, "none", None)]
    got = relevance.relevance(spark.createDataFrame(rows, "id int, title string, readable string"), relevance.dictionary(terms, stemmed), stemmed).collect()
    assert {r.id: r.relevance for r in got} == {i: 12 for i in range(1500)} | {-1: 2, -2: 0}
