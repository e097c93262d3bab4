"""Queries over pages, domains, links, tags and the fetch log."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.operators import graph, merge, reports, worklists
from webloom.plans.registry import register
from webloom.sources import adapters as A

LAND = 1


def pages(s, d):
    return A.PAGE.frame(s, d)


def fetch(s, d):
    return A.FETCH.frame(s, d)


KEPT = f"(SELECT * FROM {A.PAGE.sql} WHERE land_id = 1 AND relevance >= 1)"


@register("src1_scan_land", f"SELECT id, url, relevance FROM {A.PAGE.sql} WHERE land_id = 2")
def src1(s, d):
    return pages(s, d).where("land_id = 2").select("id", "url", "relevance")


@register("f1_min_relevance", f"SELECT id, relevance FROM {A.PAGE.sql} WHERE land_id = 1 AND relevance >= 3")
def f1(s, d):
    return worklists.relevant(pages(s, d), LAND, 3).select("id", "relevance")


@register("f2_column_map", f"SELECT id AS page, upper(title) AS name, relevance * 2 AS twice FROM {A.PAGE.sql}")
def f2(s, d):
    return worklists.projected(pages(s, d), {"page": "id", "name": "upper(title)", "twice": "relevance * 2"})


@register("f3_pending", f"SELECT id, depth FROM {A.FETCH.sql} WHERE fetched_at IS NULL AND depth = 2")
def f3(s, d):
    return worklists.pending(fetch(s, d), depth=2).select("id", "depth")


@register("f3_recrawl_status", f"SELECT id, http_status FROM {A.FETCH.sql} WHERE http_status = '404'")
def f3b(s, d):
    return worklists.pending(fetch(s, d), status="404").select("id", "http_status")


@register("f4_pending_depths", f"SELECT DISTINCT depth FROM {A.FETCH.sql} WHERE fetched_at IS NULL")
def f4(s, d):
    return worklists.pending_depths(fetch(s, d))


@register("f5_readable_worklist", f"SELECT id, depth FROM {A.FETCH.sql} WHERE fetched_at IS NOT NULL AND readable_at IS NULL ORDER BY fetched_at NULLS FIRST, depth, id LIMIT 100")
def f5(s, d):
    return worklists.unread(fetch(s, d), n=100).select("id", "depth")


@register("f6_consolidation_worklist", f"SELECT id FROM {A.FETCH.sql} WHERE (approved_at IS NOT NULL OR readable_at IS NOT NULL) AND depth = 1 AND relevance >= 2")
def f6(s, d):
    return worklists.consolidatable(fetch(s, d), depth=1, minimum=2).select("id")


@register("f7_seo_worklist", f"SELECT id FROM {A.FETCH.sql} WHERE http_status = '200' AND relevance >= 1 AND seorank IS NULL ORDER BY id LIMIT 50")
def f7(s, d):
    return worklists.seo_due(fetch(s, d), n=50).select("id")


@register("f8_llm_worklist", f"SELECT id FROM {A.FETCH.sql} WHERE (validllm IS NULL OR validllm NOT IN ('oui', 'non') OR validllm = 'non') AND length(readable) >= 14")
def f8(s, d):
    return worklists.unjudged(fetch(s, d), 14, force=True).select("id")


@register("f9_delete_by_relevance", f"SELECT id FROM {A.FETCH.sql} WHERE NOT coalesce(relevance < 3 AND fetched_at IS NOT NULL, FALSE)")
def f9(s, d):
    return worklists.kept_after_delete(fetch(s, d), (F.col("relevance") < 3) & F.col("fetched_at").isNotNull()).select("id")


@register("f20_dry_run", f"SELECT id, relevance FROM {A.FETCH.sql} WHERE relevance < 3 AND fetched_at IS NOT NULL")
def f20(s, d):
    """What the deletion would take, without taking it."""
    return worklists.deletable(fetch(s, d), (F.col("relevance") < 3) & F.col("fetched_at").isNotNull()).select("id", "relevance")


@register("j1_page_domain", f"SELECT e.id, n.name FROM {A.PAGE.sql} e JOIN {A.DOMAIN.sql} n ON n.id = e.domain_id")
def j1(s, d):
    return reports.with_domain(pages(s, d), A.DOMAIN.frame(s, d)).select("id", F.col("domain_name").alias("name"))


TAGS_OF = f"(SELECT expression_id, string_agg(name, ',' ORDER BY name) AS tags FROM (SELECT DISTINCT tc.expression_id, t.name FROM {A.TAGGED.sql} tc JOIN {A.TAG_SQL} t ON t.id = tc.tag_id) GROUP BY expression_id)"


@register("j2_pages_with_tags", f"SELECT e.id, x.tags FROM {A.PAGE.sql} e LEFT JOIN {TAGS_OF} x ON x.expression_id = e.id")
def j2(s, d):
    t = reports.tag_names(A.TAGGED.frame(s, d), A.tags(s, d))
    return pages(s, d).join(t, F.col("id") == F.col("expression_id"), "left").select("id", "tags")


TERM_ROWS = [(1, "science"), (1, "enfant"), (2, "the"), (2, "science"), (9, "none")]
TERMS = "land_id int, term string"


@register(
    "j3_land_overview",
    f"""SELECT land_id, terms, coalesce(n_terms, 0) AS n_terms, coalesce(n_pages, 0) AS n_pages, coalesce(n_remaining, 0) AS n_remaining
    FROM (SELECT land_id, string_agg(DISTINCT term, ',' ORDER BY term) AS terms, count(DISTINCT term) AS n_terms FROM {A.values_sql(TERMS, TERM_ROWS)} GROUP BY land_id)
    FULL JOIN (SELECT land_id, count(DISTINCT id) AS n_pages, count(*) FILTER (WHERE fetched_at IS NULL) AS n_remaining FROM {A.FETCH.sql} GROUP BY land_id) USING (land_id)""",
)
def j3(s, d):
    return reports.land_statistics(fetch(s, d), A.values(s, TERMS, TERM_ROWS))


EDGES = f"""SELECT l.source_id, a.domain_id AS source_domain_id, l.target_id, b.domain_id AS target_domain_id
FROM {A.LINK_SQL} l JOIN {KEPT} a ON a.id = l.source_id JOIN {KEPT} b ON b.id = l.target_id WHERE a.domain_id <> b.domain_id"""


@register("j4_links_both_ends", f"SELECT l.source_id, a.title AS source_title, l.target_id, b.title AS target_title FROM {A.LINK_SQL} l JOIN {A.PAGE.sql} a ON a.id = l.source_id JOIN {A.PAGE.sql} b ON b.id = l.target_id")
def j4(s, d):
    return graph.linked_pages(A.links(s, d), pages(s, d)).select("source_id", "source_title", "target_id", "target_title")


@register("j7_semi_links", f"SELECT * FROM {A.LINK_SQL} WHERE source_id IN (SELECT id FROM {KEPT}) AND target_id IN (SELECT id FROM {KEPT})")
def j7(s, d):
    return graph.semi_linked(A.links(s, d), worklists.relevant(pages(s, d), LAND))


@register("x18_page_edges", EDGES)
def x18(s, d):
    return graph.page_edges(A.links(s, d), worklists.relevant(pages(s, d), LAND))


@register("x18_page_nodes", f"SELECT e.id, e.title, e.url, e.relevance, n.name AS domain_name FROM {KEPT} e JOIN {A.DOMAIN.sql} n ON n.id = e.domain_id")
def x18n(s, d):
    return reports.with_domain(worklists.relevant(pages(s, d), LAND), A.DOMAIN.frame(s, d)).select("id", "title", "url", "relevance", "domain_name")


@register("a5_domain_edges", f"SELECT source_domain_id, target_domain_id, count(*) AS weight FROM ({EDGES}) GROUP BY ALL")
def a5(s, d):
    return graph.domain_edges(A.links(s, d), pages(s, d), LAND)


@register(
    "a3_domain_report",
    f"SELECT e.domain_id, n.name, n.description, count(*) AS expressions, round(avg(relevance), 2) AS average_relevance FROM {A.PAGE.sql} e JOIN {A.DOMAIN.sql} n ON n.id = e.domain_id WHERE relevance >= 1 GROUP BY ALL",
)
def a3(s, d):
    return reports.domain_report(pages(s, d), A.DOMAIN.frame(s, d))


@register("a1_pages_report", f"SELECT e.id, e.url, e.title, e.relevance, e.depth, e.domain_id, n.name AS domain_name, x.tags FROM {KEPT} e JOIN {A.DOMAIN.sql} n ON n.id = e.domain_id LEFT JOIN {TAGS_OF} x ON x.expression_id = e.id")
def a1(s, d):
    return reports.page_report(pages(s, d), A.DOMAIN.frame(s, d), A.TAGGED.frame(s, d), A.tags(s, d), LAND)


@register("a2_full_pages_report", f"SELECT id, url, lang, length(readable) AS n_chars, readable FROM {A.DOCUMENT.sql} WHERE lang = 'fr'")
def a2(s, d):
    return A.DOCUMENT.frame(s, d).where("lang = 'fr'").select("id", "url", "lang", F.length("readable").alias("n_chars"), "readable")


@register("a4_media_report", f"SELECT t.expression_id, t.text AS url, e.title FROM {A.TAGGED.sql} t JOIN {KEPT} e ON e.id = t.expression_id")
def a4(s, d):
    return reports.media_of(A.TAGGED.frame(s, d), worklists.relevant(pages(s, d), LAND), ("title",)).select("expression_id", F.col("text").alias("url"), "title")


@register("j10_media_by_land", f"SELECT t.expression_id, t.text FROM {A.TAGGED.sql} t JOIN {A.PAGE.sql} e ON e.id = t.expression_id WHERE e.land_id = 2")
def j10(s, d):
    return reports.media_of(A.TAGGED.frame(s, d), pages(s, d).where("land_id = 2")).select("expression_id", "text")


PAIRS = f"""(SELECT p.source_paragraph, p.target_paragraph, a.id AS source_id, b.id AS target_id, a.domain_id AS source_domain, b.domain_id AS target_domain, p.score, coalesce(p.score_raw, p.score) AS confidence, p.method
FROM {A.SIMILARITY_SQL} p JOIN {A.PAGE.sql} a ON a.id = p.source_paragraph JOIN {A.PAGE.sql} b ON b.id = p.target_paragraph AND b.land_id = a.land_id
WHERE a.land_id = 1 AND a.relevance >= 1 AND p.method IN ('nli', 'cosine', 'cosine_lsh'))"""


def pair_rows(s, d):
    paragraphs = pages(s, d).select("id", F.col("id").alias("expression_id"))
    return reports.pseudolink_rows(A.similarity(s, d), paragraphs, pages(s, d), LAND)


@register("j5_x20_pseudolinks", f"SELECT source_paragraph, target_paragraph, source_id, target_id, score, confidence, method FROM {PAIRS}")
def x20(s, d):
    return reports.pseudolinks(pair_rows(s, d))


def _sums_sql(level: str) -> str:
    return f"""SELECT least(source_{level}, target_{level}) AS source, greatest(source_{level}, target_{level}) AS target, count(*) AS weight,
    CAST(sum(CASE WHEN score = 1 THEN 1 ELSE 0 END) AS BIGINT) AS entailments, CAST(sum(CASE WHEN score = 0 THEN 1 ELSE 0 END) AS BIGINT) AS neutrals,
    CAST(sum(CASE WHEN score = -1 THEN 1 ELSE 0 END) AS BIGINT) AS contradictions, round(avg(score), 6) + 0.0 AS average_score, round(avg(confidence), 6) + 0.0 AS average_confidence
    FROM {PAIRS} GROUP BY 1, 2"""


@register("a6_page_pseudolinks", _sums_sql("id"))
def a6(s, d):
    return reports.pseudolink_sums(pair_rows(s, d), "id")


@register("j6_a7_domain_pseudolinks", _sums_sql("domain"))
def a7(s, d):
    return reports.pseudolink_sums(pair_rows(s, d), "domain")


@register("r1_tag_paths", f"WITH RECURSIVE tag AS (SELECT * FROM {A.TAG_SQL}), p(id, path) AS (SELECT id, name FROM tag WHERE parent_id IS NULL UNION ALL SELECT c.id, p.path || '_' || c.name FROM tag c JOIN p ON c.parent_id = p.id) SELECT id, path FROM p")
def r1(s, d):
    return graph.tag_paths(A.tags(s, d))


PATHS = f"(SELECT c.id, p.name || '_' || c.name AS path FROM {A.TAG_SQL} c JOIN {A.TAG_SQL} p ON p.id = c.parent_id UNION ALL SELECT id, name FROM {A.TAG_SQL} WHERE parent_id IS NULL)"


@register("r1_recursive_cte", f"SELECT id, path FROM {PATHS}")
def r1b(s, d):
    return graph.tag_paths_recursive(s, A.tags(s, d))


@register("a8_tag_counts", f"SELECT t.expression_id % 100 AS expression_id, p.path, count(*) AS n FROM {A.TAGGED.sql} t JOIN {PATHS} p ON p.id = t.tag_id GROUP BY ALL")
def a8(s, d):
    return graph.tag_counts(A.TAGGED.frame(s, d).withColumn("expression_id", F.col("expression_id") % 100), graph.tag_paths(A.tags(s, d)))


@register(
    "a9_tag_matrix",
    f"""WITH c AS (SELECT t.expression_id % 100 AS expression_id, p.path, count(*) AS n FROM {A.TAGGED.sql} t JOIN {PATHS} p ON p.id = t.tag_id GROUP BY ALL),
    ids AS (SELECT DISTINCT expression_id FROM c), names AS (SELECT DISTINCT path FROM {PATHS})
    SELECT expression_id, string_agg(n, ',' ORDER BY path) AS counts FROM (SELECT i.expression_id, x.path, coalesce(c.n, 0) AS n FROM ids i CROSS JOIN names x LEFT JOIN c ON c.expression_id = i.expression_id AND c.path = x.path) GROUP BY expression_id""",
)
def a9(s, d):
    """The dense matrix; its columns, sorted by path, are joined to one text for the comparison."""
    tagged = A.TAGGED.frame(s, d).withColumn("expression_id", F.col("expression_id") % 100)
    paths = graph.tag_paths(A.tags(s, d))
    m = graph.tag_matrix(graph.tag_counts(tagged, paths), paths)
    return m.select("expression_id", F.concat_ws(",", *[F.col(f"`{c}`") for c in sorted(m.columns) if c != "expression_id"]).alias("counts"))


@register("x21_tag_contents", f"SELECT p.path, t.text, substr(t.text, t.from_char + 1, t.to_char - t.from_char) AS slice, t.expression_id, e.url, g.parent_id, g.sorting FROM {A.TAGGED.sql} t JOIN {PATHS} p ON p.id = t.tag_id JOIN {A.TAG_SQL} g ON g.id = t.tag_id JOIN {KEPT} e ON e.id = t.expression_id")
def x21(s, d):
    tags = A.tags(s, d)
    return graph.tag_contents(A.TAGGED.frame(s, d), graph.tag_paths(tags), tags, worklists.relevant(pages(s, d), LAND))


@register("a10_status_histogram", f"SELECT land_id, http_status, count(http_status) AS n FROM {A.FETCH.sql} GROUP BY ALL")
def a10(s, d):
    return reports.status_histogram(fetch(s, d))


@register("a15_run_statistics", f"SELECT count(*) AS total, count(fetched_at) AS fetched, count(readable_at) AS readable, round(100.0 * count(readable_at) / count(*), 2) AS success_rate FROM {A.FETCH.sql}")
def a15(s, d):
    return reports.run_statistics(fetch(s, d))


@register("a16_json_columns", f"SELECT id, coalesce(CAST(json_extract_string(seorank, '$.k') AS VARCHAR), 'na') AS k FROM {A.FETCH.sql} WHERE relevance >= 20")
def a16(s, d):
    rows = fetch(s, d).where("relevance >= 20").select("id", "seorank")
    return reports.with_json_columns(rows, "seorank").drop("seorank")


@register("js1_json_map", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS n_keys FROM events")
def js1(s, d):
    rows = A.table(s, d, "events").withColumn("payload", F.when(F.col("event_id") % 3 == 0, "not json").otherwise(F.col("props")))
    return rows.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.size(reports.json_map("payload")).alias("n_keys"))


@register("j9_semi_join_delete", f"SELECT source_paragraph, target_paragraph FROM {A.SIMILARITY_SQL} WHERE source_paragraph NOT IN (SELECT id FROM {A.PAGE.sql} WHERE land_id = 2) AND target_paragraph NOT IN (SELECT id FROM {A.PAGE.sql} WHERE land_id = 2)")
def j9(s, d):
    from webloom.operators.paragraphs import reset_embeddings

    land = pages(s, d).where("land_id = 2")
    return reset_embeddings(pages(s, d), A.similarity(s, d), land)[1].select("source_paragraph", "target_paragraph")


@register(
    "r2_frontier",
    f"""WITH RECURSIVE l AS (SELECT DISTINCT source_id, target_id FROM {A.LINK_SQL}), f(id, depth) AS (SELECT id, 0 FROM {A.PAGE.sql} WHERE id % 50 = 1 UNION SELECT l.target_id, f.depth + 1 FROM f JOIN l ON l.source_id = f.id WHERE f.depth < 3)
    SELECT id, min(depth) AS depth FROM f GROUP BY id""",
)
def r2(s, d):
    """The frontier over all links."""
    return graph.frontier(pages(s, d).where("id % 50 = 1"), A.links(s, d), 3)


@register("o6_o8_ordering", f"SELECT id, approved_at FROM {A.FETCH.sql} ORDER BY approved_at NULLS FIRST, id LIMIT 20")
def o8(s, d):
    return worklists.limited(fetch(s, d).orderBy(F.asc_nulls_first("approved_at"), "id"), 20).select("id", "approved_at")


@register("o7_paging", f"SELECT id FROM {A.FETCH.sql} ORDER BY id LIMIT 25 OFFSET 50")
def o7(s, d):
    return worklists.paged(fetch(s, d), "id", 25, 2).select("id")


@register("w5_w6_batches", f"SELECT id, CAST(floor((row_number() OVER (ORDER BY id) - 1) / 1000) AS BIGINT) + 1 AS batch_no FROM {A.FETCH.sql}")
def w5(s, d):
    from webloom.operators.paragraphs import batches

    return batches(fetch(s, d).select("id"), "id", 1000).select("id", "batch_no")


@register("src6_first_snapshot", "SELECT user_id, coalesce(min_by(event_id, ts) FILTER (WHERE event_type = 'view'), min_by(event_id, ts)) AS event_id FROM events GROUP BY user_id")
def src6(s, d):
    """The earliest snapshot, of the preferred status if there is one."""
    return merge.first_snapshot(A.table(s, d, "events"), "user_id", "event_id", "ts", F.col("event_type") == "view")


@register("st1_daily_windows", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def st1(s, d):
    """The batch form of the streaming window count."""
    from webloom.streaming.fetchlog import windowed

    return windowed(A.table(s, d, "events")).select("day", "event_type", "n", "total")
