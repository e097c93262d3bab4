"""Queries of the mutating steps: merge, plans, ingestion, consolidation, verdicts, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.functions import text
from webloom.operators import graph, media, merge, paragraphs, relevance, reports
from webloom.plans.registry import register
from webloom.sources import adapters as A

AS_OF = "2024-06-15 12:00:00"

OLD_ROWS = [(1, "abc", "same", "2024-01-01 00:00:00", "old"), (2, None, "d", None, ""), (3, "keep", "long text", "2022-01-01 00:00:00", "r"), (4, "alone", None, None, None)]
NEW_ROWS = [(1, "abcd", "mase", "2023-01-01 00:00:00", "new"), (2, "t", " ", "2023-05-05 00:00:00", "x"), (3, "k", "short", "2023-01-01 00:00:00", None)]
RECORD = "id int, title string, description string, published_at string, readable string"
RESULTS = {
    "smart_merge": [(1, "abcd", "same", "2023-01-01 00:00:00", "new"), (2, "t", "d", "2023-05-05 00:00:00", "x"), (3, "keep", "long text", "2022-01-01 00:00:00", "r"), (4, "alone", None, None, None)],
    "extractor_priority": [(1, "abcd", "mase", "2023-01-01 00:00:00", "new"), (2, "t", "d", "2023-05-05 00:00:00", "x"), (3, "k", "short", "2023-01-01 00:00:00", "r"), (4, "alone", None, None, None)],
    "preserve_existing": [(1, "abc", "same", "2024-01-01 00:00:00", "old"), (2, "t", "d", "2023-05-05 00:00:00", "x"), (3, "keep", "long text", "2022-01-01 00:00:00", "r"), (4, "alone", None, None, None)],
}


def _records(s, rows):
    return A.values(s, RECORD, rows).withColumn("published_at", F.to_timestamp("published_at"))


def _merge(strategy: str):
    def query(s, d):
        out = merge.merge_records(_records(s, OLD_ROWS), _records(s, NEW_ROWS), strategy=strategy)
        return out.withColumn("published_at", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"))

    return query


for _name, _rows in RESULTS.items():
    register(f"x5_{_name}", f"SELECT * FROM {A.values_sql(RECORD, _rows)}")(_merge(_name))


@register("x5_merge_at_scale", "SELECT id, CASE WHEN event_id IS NULL THEN title WHEN length(event_type) > length(title) THEN event_type ELSE title END AS title FROM (SELECT user_id AS id, event_type AS title, event_id AS k FROM events WHERE event_id % 2 = 0) o LEFT JOIN (SELECT event_id - 1 AS k2, event_id, event_type FROM events WHERE event_id % 2 = 1) n ON n.k2 = o.k")
def x5s(s, d):
    """Titles of even events merged with those of the odd ones after them."""
    e = A.table(s, d, "events")
    old = e.where("event_id % 2 = 0").select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("title"))
    new = e.where("event_id % 2 = 1").select((F.col("event_id") - 1).alias("id"), F.col("event_type").alias("title"))
    return merge.merge_records(old, new, fields=("title",)).select(F.col("user_id").alias("id"), "title")


CHANGES = [(1, "title", "abc", "abcd"), (1, "description", "same", "mase"), (1, "readable", "old", "new"), (2, "title", None, "t"), (2, "description", "d", " "), (2, "readable", "", "x"), (3, "title", "keep", "k"), (3, "description", "long text", "short"), (3, "readable", "r", None), (4, "title", "alone", None)]


@register("x6_update_plan", f"SELECT * FROM {A.values_sql('id int, field string, old string, new string', CHANGES)}")
def x6(s, d):
    fields = ("title", "description", "readable")
    return merge.changes(A.values(s, RECORD, OLD_ROWS), A.values(s, RECORD, NEW_ROWS), fields=fields)


@register("x7_x26_apply_updates", f"SELECT id, CASE WHEN id % 2 = 0 AND id % 4 <> 0 THEN 'new' ELSE readable END AS readable, CASE WHEN id % 2 = 0 THEN TIMESTAMP '{AS_OF}' ELSE readable_at END AS readable_at FROM {A.FETCH.sql}")
def x7(s, d):
    """Every second page was treated; every fourth gave nothing, and is stamped all the same."""
    pages = A.FETCH.frame(s, d)
    updates = pages.where("id % 2 = 0").select("id", F.when(F.col("id") % 4 != 0, "new").alias("readable"))
    return merge.applied(pages, updates, F.lit(AS_OF).cast("timestamp_ntz")).select("id", "readable", "readable_at")


@register("x2_approval", f"SELECT id, CASE WHEN relevance > 0 THEN TIMESTAMP '{AS_OF}' ELSE approved_at END AS approved_at FROM {A.FETCH.sql}")
def x2(s, d):
    return relevance.approved(A.FETCH.frame(s, d), F.lit(AS_OF).cast("timestamp_ntz")).select("id", "approved_at")


@register(
    "x15_verdicts",
    f"""SELECT id, CASE id % 3 WHEN 0 THEN 'oui' WHEN 1 THEN 'non' ELSE validllm END AS validllm, CASE WHEN id % 3 = 1 THEN 0 ELSE relevance END AS relevance FROM {A.FETCH.sql}""",
)
def x15(s, d):
    pages = A.FETCH.frame(s, d)
    answers = pages.select("id", F.when(F.col("id") % 3 == 0, " Oui.").when(F.col("id") % 3 == 1, "no").otherwise("maybe").alias("answer"))
    return relevance.judged(pages, answers).select("id", "validllm", "relevance")


@register(
    "x8_search_ingestion",
    """WITH k AS (SELECT doc_id, 'https://s/' || doc_id AS url, CASE WHEN doc_id % 2 = 0 THEN '' ELSE source END AS title, TIMESTAMP '2024-01-10' AS published_at FROM documents),
    r AS (SELECT 'https://s/' || (event_id % 700) AS url, min_by(event_type, event_id) AS r_title, min(ts) AS r_date FROM events GROUP BY 1)
    SELECT coalesce(k.url, r.url) AS url, CASE WHEN coalesce(k.title, '') = '' THEN coalesce(r.r_title, k.title) ELSE k.title END AS title, least(k.published_at, r.r_date) AS published_at,
      CASE WHEN k.url IS NULL THEN 'new' WHEN (CASE WHEN k.title = '' THEN coalesce(r.r_title, '') ELSE k.title END) = k.title AND least(k.published_at, r.r_date) = k.published_at THEN 'skipped' ELSE 'updated' END AS action
    FROM k FULL JOIN r ON r.url = k.url""",
)
def x8(s, d):
    """All documents are known pages, all events search results."""
    known = A.table(s, d, "documents").select(
        F.lit(1).alias("land_id"), F.concat(F.lit("https://s/"), "doc_id").alias("url"), F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("source")).alias("title"), F.lit("2024-01-10").cast("timestamp_ntz").alias("published_at")
    )
    results = A.table(s, d, "events").select(F.lit(1).alias("land_id"), F.concat(F.lit("https://s/"), F.col("event_id") % 700).alias("url"), F.col("event_type").alias("title"), F.col("event_id").alias("position"), F.col("ts").alias("published_at"))
    return merge.ingest(known, results).select("url", "title", "published_at", "action")


@register("j15_upsert", "SELECT DISTINCT source AS name FROM documents UNION SELECT n_name FROM nation")
def j15(s, d):
    known = A.table(s, d, "nation").select(F.col("n_name").alias("name"))
    return merge.upserted(known, A.table(s, d, "documents").select(F.col("source").alias("name")), ["name"])


@register("x23_embedding_reset", "SELECT count(*) AS left_over FROM embeddings WHERE label <> 1")
def x23(s, d):
    e = A.table(s, d, "embeddings").withColumnRenamed("vec_id", "id")
    none = s.createDataFrame([], "source_paragraph long, target_paragraph long")
    return paragraphs.reset_embeddings(e, none, e.where("label = 1"))[0].agg(F.count("*").alias("left_over"))


@register("x24_media_deletion", f"SELECT expression_id, text FROM {A.TAGGED.sql} WHERE NOT (expression_id % 5 = 0 AND text = 'BUILDING')")
def x24(s, d):
    items = A.TAGGED.frame(s, d).withColumnRenamed("text", "type")
    gone = items.where("expression_id % 5 = 0").select(F.col("expression_id").alias("id"))
    return media.without_media(items, gone, "BUILDING").select("expression_id", F.col("type").alias("text"))


@register("x22_land_delete", f"SELECT id FROM {A.FETCH.sql} WHERE NOT coalesce(land_id = 2 AND relevance < 3 AND fetched_at IS NOT NULL, FALSE)")
def x22(s, d):
    """Of one land the fetched pages of little relevance go; what is unknown stays."""
    return reports.without_land(A.FETCH.frame(s, d), 2, 3).select("id")


@register("x22_whole_land_delete", f"SELECT id FROM {A.PAGE.sql} WHERE land_id <> 2")
def x22w(s, d):
    return reports.without_land(A.PAGE.frame(s, d), 2).select("id")


@register("x4_consolidation", "SELECT doc_id AS source_id, 'https://n.example/' || (doc_id % 50) AS url FROM documents")
def x4(s, d):
    """Links rebuilt from the stored readable text of all pages; here a Markdown link is put into each."""
    docs = A.DOCUMENT.frame(s, d).withColumn("readable", F.concat(F.lit("x [y](https://n.example/"), F.col("id") % 50, F.lit(")")))
    found = docs.select(F.col("id").alias("source_id"), F.lit(1).alias("land_id"), F.lit(7).alias("depth"), F.explode(text.md_links(F.col("readable"))).alias("url"))
    return graph.discovered(found, docs.select(F.lit(1).alias("land_id"), "url"), most_depth=None)[1].select("source_id", "url")


PARSED = [(1, "live", None), (2, "", "snap"), (3, None, None), (4, "l" * 3, "snap")]


@register("src5_src7_fallbacks", f"SELECT id, CASE WHEN length(a) > 3 THEN a WHEN length(b) > 3 THEN b END AS value, CASE WHEN length(a) > 3 THEN 'live' WHEN length(b) > 3 THEN 'snapshot' END AS source FROM {A.values_sql('id int, a string, b string', PARSED)}")
def src5(s, d):
    return A.values(s, "id int, a string, b string", PARSED).select("id", *merge.first_of({"live": F.col("a"), "snapshot": F.col("b")}, 3))


ITEMS = [(1, '{"links":["https://a.org/x",{"url":"https://b.org/y"}]}'), (2, "broken"), (3, None)]


@register("x27_extractor_items", f"SELECT id, url FROM {A.values_sql('id int, url string', [(1, 'https://a.org/x'), (1, 'https://b.org/y')])}")
def x27(s, d):
    """Links of an extractor's JSON, as strings or as objects."""
    return A.values(s, "id int, j string", ITEMS).select("id", F.explode(text.extractor_urls(F.col("j"))).alias("url"))


@register("snk6_gexf_edges", f"SELECT source_id || '_' || target_id AS id, CAST(source_id AS VARCHAR) AS source, CAST(target_id AS VARCHAR) AS target, '1' AS weight FROM {A.LINK_SQL}")
def snk6(s, d):
    from webloom.sources.sinks import gexf_edges

    return gexf_edges(A.links(s, d).withColumn("weight", F.lit(1)), "source_id", "target_id", "weight")


@register("snk7_corpus_entries", "SELECT doc_id AS id, 'corpus_' || lpad(CAST(CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 300) AS INT) + 1 AS VARCHAR), 5, '0') || '.zip' AS archive, doc_id || '-' || source || '.txt' AS entry FROM documents")
def snk7(s, d):
    from webloom.sources.sinks import corpus_entries

    docs = A.DOCUMENT.frame(s, d).select("id", F.col("domain").alias("title"))
    return corpus_entries(docs, "corpus", 300).select("id", "archive", "entry")
