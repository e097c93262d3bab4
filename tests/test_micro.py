"""The hand-made corpus of FIXTURES.md, section C, with its expected results."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from webloom.functions import dates
from webloom.operators import graph, reports, worklists


@pytest.fixture(scope="module")
def c(spark):
    make = lambda names, rows: spark.createDataFrame(rows, names)
    return {
        "domain": make("id long, name string, description string", [(1, "a.example", None), (2, "b.example", None), (3, "c.example", None)]),
        "page": make(
            "id long, land_id int, domain_id long, url string, relevance int, title string, depth int",
            [(1, 1, 1, "https://a.example/1", 5, "t", 0), (2, 1, 1, "https://a.example/2", 0, "t", 0), (3, 1, 2, "https://b.example/1", 3, "t", 0), (4, 1, 3, "https://c.example/1", 1, "t", 0), (5, 1, 2, "https://b.example/2", None, "t", 0), (6, 2, 2, "https://b.example/3", 7, "t", 0)],
        ),
        "link": make("source_id long, target_id long", [(1, 3), (1, 2), (3, 4), (4, 1), (3, 5), (3, 1), (1, 6)]),
        "tag": make("id long, land_id int, parent_id long, name string, sorting int", [(1, 1, None, "Theme", 1), (2, 1, 1, "Health", 1), (3, 1, 2, "Air", 1), (4, 1, None, "Law", 2)]),
        "tagged": make("tag_id long, expression_id long, text string", [(3, 1, "smog"), (3, 1, "haze"), (2, 3, "asthma"), (4, 1, "act"), (1, 2, "x")]),
        "paragraph": make("id long, expression_id long", [(1, 1), (2, 1), (3, 3), (4, 4), (5, 6)]),
        "similarity": make(
            "source_paragraph long, target_paragraph long, score double, score_raw double, method string",
            [(1, 3, 1.0, 0.9, "nli"), (2, 3, -1.0, 0.8, "nli"), (3, 1, 0.77, None, "cosine"), (1, 4, 0.0, 0.5, "nli"), (1, 5, 1.0, 0.9, "nli"), (3, 4, 1.0, 1.0, "other")],
        ),
    }


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_domain_report(c):
    report = lambda m: rows(reports.domain_report(c["page"], c["domain"], 1, m), "name", "expressions", "average_relevance")
    assert report(1) == [("a.example", 1, 5.0), ("b.example", 1, 3.0), ("c.example", 1, 1.0)]
    assert report(0) == [("a.example", 2, 2.5), ("b.example", 1, 3.0), ("c.example", 1, 1.0)]


def test_edges(c):
    kept = worklists.relevant(c["page"], 1)
    assert rows(graph.page_edges(c["link"], kept), "source_id", "target_id") == [(1, 3), (3, 1), (3, 4), (4, 1)]
    assert rows(graph.domain_edges(c["link"], c["page"], 1), "source_domain_id", "target_domain_id", "weight") == [(1, 2, 1), (2, 1, 1), (2, 3, 1), (3, 1, 1)]
    assert rows(graph.semi_linked(c["link"], kept), "source_id", "target_id") == [(1, 3), (3, 1), (3, 4), (4, 1)]


def test_tags(c, spark):
    paths = graph.tag_paths(c["tag"])
    expected = ["Law", "Theme", "Theme_Health", "Theme_Health_Air"]
    assert [r[0] for r in rows(paths, "path")] == expected
    assert [r[0] for r in rows(graph.tag_paths_recursive(spark, c["tag"]), "path")] == expected
    kept = worklists.relevant(c["page"], 1).select(F.col("id").alias("expression_id"))
    m = graph.tag_matrix(graph.tag_counts(c["tagged"].join(kept, "expression_id"), paths), paths)
    assert rows(m, "expression_id", "Law", "Theme_Health", "Theme_Health_Air") == [(1, 1, 0, 2), (3, 0, 1, 0)]
    report = reports.page_report(c["page"], c["domain"], c["tagged"], c["tag"], 1)
    assert {r.id: r.tags for r in report.collect()} == {1: "Air,Law", 3: "Health", 4: None}


def test_cyclic_tags_are_an_error(spark):
    with pytest.raises(ValueError):
        graph.tag_paths(spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (2, 2, "b")], "id long, parent_id long, name string"), most_levels=5)


def test_pseudolinks(c):
    pairs = reports.pseudolink_rows(c["similarity"], c["paragraph"], c["page"], 1)
    columns = ("source", "target", "weight", "entailments", "neutrals", "contradictions", "average_score", "average_confidence")
    assert rows(reports.pseudolink_sums(pairs, "id"), *columns) == [(1, 3, 3, 1, 0, 1, 0.256667, 0.823333), (1, 4, 1, 0, 1, 0, 0.0, 0.5)]
    assert rows(reports.pseudolink_sums(pairs, "domain"), *columns) == [(1, 2, 3, 1, 0, 1, 0.256667, 0.823333), (1, 3, 1, 0, 1, 0, 0.0, 0.5)]


def test_frontier(c, spark):
    assert rows(graph.frontier(spark.createDataFrame([(4,)], "id long"), c["link"], 2), "id", "depth") == [(1, 1), (2, 2), (3, 2), (4, 0), (6, 2)]


def test_seo_work_list(spark):
    pages = spark.createDataFrame([(1, "200", 2, None), (2, "404", 5, None), (3, "200", 0, None), (4, "200", 9, "{}")], "id int, http_status string, relevance int, seorank string")
    ids = lambda **o: [r.id for r in worklists.seo_due(pages, **o).collect()]
    assert (ids(), ids(status="all"), ids(force=True), ids(minimum=0, n=1)) == ([1], [1, 2], [1, 4], [1])


def test_strict_days(spark):
    assert dates.parse_day("2024-01-07") == date(2024, 1, 7)
    for bad in ("2024-1-7", "07/01/2024"):
        with pytest.raises(ValueError):
            dates.parse_day(bad)
    with pytest.raises(ValueError):
        dates.advanced(F.current_date(), "year")
