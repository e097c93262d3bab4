"""Queries at the edges: sources with functions that a caller gives, sinks read back, orders, images."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from webloom.functions import dates, html, text, urls
from webloom.operators import graph, images, media, reports, similarity, worklists
from webloom.operators.persist import shared_folder
from webloom.plans import relational as R
from webloom.plans.registry import register
from webloom.sources import adapters as A
from webloom.sources import fetch, search, sinks
from webloom.streaming import fetchlog


def _path(df) -> str:
    return f"{shared_folder(df)}/webloom-{uuid.uuid4().hex}"


# --- Sources ------------------------------------------------------------------------------------------------------


@register("src3_url_list", "SELECT url FROM pages")
def src3(s, d):
    """Addresses written one a line, and read back."""
    rows = A.table(s, d, "pages").select("url")
    path = _path(rows)
    rows.write.text(path)
    return fetch.url_list(s, path)


def _answer(url: str) -> fetch.Fetched:
    """A service that answers by the length of the address."""
    kind = len(url) % 3
    if kind == 0:
        raise fetch.ClientError
    if kind == 2:
        raise OSError("broken")
    return fetch.Fetched("200", f"<title>{url}</title>")


@register("src4_fetched", "SELECT page_id AS id, CASE length(url) % 3 WHEN 0 THEN '000' WHEN 1 THEN '200' ELSE 'ERR' END AS http_status, CASE length(url) % 3 WHEN 1 THEN '<title>' || url || '</title>' END AS html FROM pages")
def src4(s, d):
    return fetch.fetched(A.PAGE_HTML.frame(s, d), fetch.with_retries(_answer, waits=()))


class _Flaky:
    """Fails as often as the address's length says, then answers."""

    def __init__(self) -> None:
        self.calls: Counter[str] = Counter()

    def __call__(self, url: str) -> fetch.Fetched:
        n = self.calls[url] = self.calls[url] + 1
        fails = len(url) % 5
        if n > fails or n == 4:
            self.calls[url] = 0
        if n <= fails:
            raise OSError("try again")
        return fetch.Fetched("200", url)


@register("src8_retries", "SELECT page_id AS id, CASE WHEN length(url) % 5 = 4 THEN 'ERR' ELSE '200' END AS http_status FROM pages")
def src8(s, d):
    """Three waits are four attempts, so an address that fails four times gives an error."""
    return fetch.fetched(A.PAGE_HTML.frame(s, d), fetch.with_retries(_Flaky(), sleep=lambda _: None)).select("id", "http_status")


QUERIES = [("alpha", "google", "fr", "2024-01-01", "2024-03-10"), ("beta", "duckduckgo", "en", "2024-02-01", "2024-02-20"), ("gamma", "bing", "fr", None, None), ("delta", "google", "de", None, None)]


def _search(params: dict) -> dict:
    """A service with 7 results for each request, 3 a page, that says where the next page is in one of three ways."""
    start = int(params.get("first", params.get("start"))) - (1 if params["engine"] == "bing" else 0)
    found = [{"position": i, "title": f"{params['q']} {i}", "link": f"https://r.example/{params['q']}/{i}", "date": params.get("tbs") or params.get("df")} for i in range(start + 1, min(7, start + 3) + 1)]
    more = {"google": {"next_link": f"https://x/?start={start + 3}"}, "bing": {"next": "https://x/"}, "duckduckgo": {"next_link": "https://x/", "next_offset": start + 3}}[params["engine"]]
    return {"organic_results": found, "serpapi_pagination": more if start + 3 < 7 else {}}


@register(
    "src9_search_results",
    f"""WITH q AS (SELECT * FROM {A.values_sql('query string, engine string, lang string, a string, b string', QUERIES)}),
    w AS (SELECT query, engine, CAST(x AS DATE) AS s, least(CAST(x AS DATE) + 6, CAST(b AS DATE)) AS e FROM (SELECT *, unnest(generate_series(CAST(a AS DATE), CAST(b AS DATE), INTERVAL 7 DAY)) AS x FROM q WHERE a IS NOT NULL)
      UNION ALL SELECT query, engine, NULL, NULL FROM q WHERE a IS NULL)
    SELECT query, s AS window_start, e AS window_end, p AS position, query || ' ' || p AS title, 'https://r.example/' || query || '/' || p AS link,
      CASE WHEN s IS NULL THEN NULL WHEN engine = 'google' THEN 'cdr:1,cd_min:' || strftime(s, '%m/%d/%Y') || ',cd_max:' || strftime(e, '%m/%d/%Y') ELSE s || '..' || e END AS date
    FROM w, range(1, 8) AS r(p)""",
)
def src9(s, d):
    q = A.values(s, "query string, engine string, lang string, start string, end string", QUERIES)
    wanted = search.requests(q.withColumn("start", F.to_date("start")).withColumn("end", F.to_date("end")), "week")
    return search.results(wanted, _search)


def _metric(url: str) -> tuple[int, str]:
    n = len(url) % 3
    return (200, f'{{"chars": "{len(url)}"}}') if n == 0 else (200, "no json") if n == 1 else (500, "")


@register("src10_seo_metrics", "SELECT page_id AS id, CASE WHEN n % 3 = 0 THEN '{\"chars\": \"' || n || '\"}' END AS seorank FROM (SELECT page_id, length(replace(url, '#', '%23')) AS n FROM pages)")
def src10(s, d):
    """The payload of every second page's archived copy is that of the page itself."""
    archived = F.when(F.col("id") % 2 == 0, F.concat(F.lit("https://web.archive.org/web/20240101000000/"), "url")).otherwise(F.col("url"))
    return search.metrics(A.PAGE_HTML.frame(s, d).withColumn("url", archived), _metric, waits=())


def _extract(url: str, markup: str) -> dict | None:
    if len(url) % 4 == 0:
        return None
    if len(url) % 4 == 1:
        raise OSError("broken")
    return {"title": url, "content": f"{url} " * 3}


@register("src12_external_extractor", "SELECT page_id AS id, CASE WHEN length(url) % 4 >= 2 THEN url END AS title, CASE length(url) % 4 WHEN 0 THEN 'no answer' WHEN 1 THEN 'broken' END AS error FROM pages")
def src12(s, d):
    return fetch.extracted(A.PAGE_HTML.frame(s, d), _extract).select("id", "title", "error")


@register(
    "t29_primary_extraction",
    """SELECT page_id AS id, CASE WHEN length(url) % 4 >= 2 AND 3 * (length(url) + 1) > 100 THEN url || ' ' || url || ' ' || url || ' ' || chr(10) || '![IMAGE](' || url || '.png)' || chr(10) || '[VIDEO: v.mp4]' ELSE 'fallback' END AS readable FROM pages""",
)
def t29(s, d):
    """An extractor's text counts from 100 characters on, with its media after it; else the fallback."""
    pages = A.PAGE_HTML.frame(s, d)
    item = lambda u, t: F.struct(u.alias("url"), F.lit(t).alias("type"))
    got = fetch.extracted(pages, _extract).join(pages.select("id", "url"), "id")
    accepted = html.extracted(F.col("content"), F.lit(None).cast("string"), 100)
    whole = html.appended_media(accepted, F.array(item(F.concat("url", F.lit(".png")), "img"), item(F.lit("v.mp4"), "video")))
    return got.select("id", F.when(accepted.isNotNull(), whole).otherwise(F.lit("fallback")).alias("readable"))


@register("t24_fetched_metadata", "SELECT page_id AS id, CASE length(url) % 3 WHEN 0 THEN '000' WHEN 1 THEN '200' ELSE 'ERR' END AS http_status, CASE length(url) % 3 WHEN 1 THEN url END AS title FROM pages")
def t24(s, d):
    got = fetch.fetched(A.PAGE_HTML.frame(s, d), fetch.with_retries(_answer, waits=()))
    return html.fetched_metadata(got).select("id", "http_status", "title")


@register("u7_percent_encoded", "SELECT page_id, replace(replace(replace(replace(url || ' \"é', ' ', '%20'), '\"', '%22'), 'é', '%C3%A9'), '#', '%23') AS url FROM pages")
def u7(s, d):
    return A.table(s, d, "pages").select("page_id", urls.percent_encoded(F.concat("url", F.lit(' "é'))).alias("url"))


@register("u8_data_urls", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'data:image/png;base64,AA' ELSE regexp_extract(url, '^(https?://[^/?#]*)', 1) || '/Img.PNG' END AS url FROM pages")
def u8(s, d):
    found = F.when(F.col("page_id") % 2 == 0, "data:image/png;base64,AA").otherwise("/Img.PNG")
    return A.table(s, d, "pages").select("page_id", urls.resolved_or_data(F.col("url"), found).alias("url"))


@register("d5_strict_dates", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def d5(s, d):
    return A.table(s, d, "orders").select("o_orderkey", dates.strict_date(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"))


# --- Sinks --------------------------------------------------------------------------------------------------------

EXPORT_ROWS = [("pagecsv", ".csv"), ("nodegexf", ".gexf"), ("corpus", ".zip"), ("pseudolinks", ""), ("pseudolinksdomain", ""), ("other", "")]


@register("snk1_extensions", f"SELECT export, extension FROM {A.values_sql('export string, extension string', EXPORT_ROWS)}")
def snk1(s, d):
    return A.values(s, "export string, extension string", [(e, sinks.extension(e)) for e, _ in EXPORT_ROWS])


@register("snk2_csv", "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name || ', \"q\"' AS name FROM nation")
def snk2(s, d):
    """Rows with quotes and commas, written with all fields quoted and read back."""
    rows = A.table(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.concat("n_name", F.lit(', "q"')).alias("name"))
    path = _path(rows)
    sinks.csv(rows, path)
    return s.read.csv(path, header=True, escape='"')


@register(
    "snk3_values",
    """SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN '["' || n_name || '"]' ELSE 'na' END AS list, CASE WHEN n_nationkey % 3 = 0 THEN 'na' ELSE '{"k":' || n_regionkey || '}' END AS map,
    CASE WHEN n_nationkey % 4 = 0 THEN 'na' ELSE CAST(n_regionkey AS VARCHAR) END AS number, n_regionkey AS kept FROM nation""",
)
def snk3(s, d):
    """Lists and maps as JSON, empty ones and nulls as na, numbers as they are."""
    key, name, region = F.col("n_nationkey"), F.col("n_name"), F.col("n_regionkey")
    rows = A.table(s, d, "nation").select(
        key.alias("id"), F.when(key % 2 == 0, F.array(name)).otherwise(F.array().cast("array<string>")).alias("list"), F.when(key % 3 != 0, F.create_map(F.lit("k"), region)).alias("map"), F.when(key % 4 != 0, region).alias("number"), region.alias("kept")
    )
    typed = {f.name: f.dataType for f in rows.schema}
    return text.normalised_columns(rows).withColumn("number", text.normalised_value(F.col("number"), typed["number"]))


@register("snk5_gexf_nodes", f"SELECT CAST(id AS VARCHAR) AS id, title AS label, CAST(relevance AS VARCHAR) AS size, url || '|' || CAST(depth AS VARCHAR) AS \"values\" FROM {A.PAGE.sql}")
def snk5(s, d):
    return sinks.gexf_nodes(A.PAGE.frame(s, d), "title", "relevance", ["url", "depth"]).withColumn("values", F.array_join("values", "|"))


@register("snk10_raw_pages", "SELECT CAST(1 + page_id % 3 AS INT) AS land_id, page_id AS id, html FROM pages")
def snk10(s, d):
    """The markup of all pages, stored by land and read back."""
    rows = A.PAGE_HTML.frame(s, d).withColumn("land_id", (1 + F.col("id") % 3).cast("int"))
    path = _path(rows)
    sinks.raw_pages(rows, path)
    return s.read.parquet(path).select("land_id", "id", "html")


@register("snk12_append_new", "SELECT event_id, user_id FROM events")
def snk12(s, d):
    """Two deliveries that overlap, and one again: each key is stored once."""
    rows = A.table(s, d, "events").select("event_id", "user_id")
    path = _path(rows)
    for some in ("event_id % 3 <> 0", "event_id % 2 = 0 OR event_id % 3 = 0", "event_id % 3 <> 0", "event_id % 6 IN (1, 3, 5)"):
        sinks.append_new(rows.where(some), path, ["event_id"])
    return s.read.parquet(path)


@register("st2_progress", "SELECT 7 AS batch, count(*) AS rows, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events")
def st2(s, d):
    """The figures of a micro-batch."""
    p = fetchlog.progress(A.table(s, d, "events"), 7)
    return s.createDataFrame([(p["batch"], p["rows"], p["errors"])], "batch int, rows long, errors long")


# --- Orders: what stands first, so that the order itself is compared ----------------------------------------------


@register("o1_best_pseudolinks", f"SELECT source_paragraph, target_paragraph, score FROM {R.PAIRS} ORDER BY score DESC, source_paragraph, target_paragraph LIMIT 20")
def o1(s, d):
    return reports.pseudolinks(R.pair_rows(s, d)).limit(20).select("source_paragraph", "target_paragraph", "score")


@register("o2_heaviest_page_pairs", f"SELECT source, target, weight FROM ({R._sums_sql('domain')}) ORDER BY weight DESC, source, target LIMIT 20")
def o2(s, d):
    return reports.pseudolink_sums(R.pair_rows(s, d), "domain").limit(20).select("source", "target", "weight")


@register("o3_first_tag_counts", f"SELECT t.expression_id, p.path, count(*) AS n FROM {A.TAGGED.sql} t JOIN {R.PATHS} p ON p.id = t.tag_id JOIN {A.TAG_SQL} g ON g.id = t.tag_id GROUP BY 1, 2 ORDER BY t.expression_id, min(g.parent_id) NULLS FIRST, min(g.sorting), p.path LIMIT 20")
def o3(s, d):
    tags = A.tags(s, d)
    return graph.ordered_tag_counts(A.TAGGED.frame(s, d), graph.tag_paths(tags), tags).limit(20).select("expression_id", "path", "n")


@register("o4_first_tag_contents", f"SELECT p.path, t.expression_id, t.text FROM {A.TAGGED.sql} t JOIN {R.PATHS} p ON p.id = t.tag_id JOIN {A.TAG_SQL} g ON g.id = t.tag_id JOIN {R.KEPT} e ON e.id = t.expression_id ORDER BY g.parent_id NULLS FIRST, g.sorting, t.expression_id, t.text LIMIT 20")
def o4(s, d):
    tags = A.tags(s, d)
    return graph.tag_contents(A.TAGGED.frame(s, d), graph.tag_paths(tags), tags, worklists.relevant(R.pages(s, d), R.LAND)).limit(20).select("path", "expression_id", "text")


@register("x19_domain_graph", f"SELECT a.name AS source, b.name AS target, x.weight FROM (SELECT source_domain_id, target_domain_id, count(*) AS weight FROM ({R.EDGES}) GROUP BY ALL) x JOIN {A.DOMAIN.sql} a ON a.id = x.source_domain_id JOIN {A.DOMAIN.sql} b ON b.id = x.target_domain_id")
def x19(s, d):
    """The domain graph's edges with the names of its nodes."""
    domains = A.DOMAIN.frame(s, d)
    edges = graph.domain_edges(A.links(s, d), R.pages(s, d), R.LAND).withColumnsRenamed({"source_domain_id": "source_id", "target_domain_id": "target_id"})
    return graph.linked_pages(edges, domains, ("name",)).select(F.col("source_name").alias("source"), F.col("target_name").alias("target"), "weight")


# --- Images -------------------------------------------------------------------------------------------------------


def png(width: int, height: int, colour: tuple[int, ...]) -> bytes:
    """A PNG file of one colour (three or four channels), for queries and tests."""
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    raw = (b"\x00" + bytes(colour) * width) * height
    return images.PNG_START + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6 if len(colour) == 4 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def jpeg_head(make: str, when: str, width: int) -> bytes:
    """The head of a JPEG file with three camera fields."""
    texts = [make.encode() + b"\x00", when.encode() + b"\x00"]
    at = 8 + 2 + 3 * 12 + 4
    entries = struct.pack("<HHII", 256, 4, 1, width) + struct.pack("<HHII", 271, 2, len(texts[0]), at) + struct.pack("<HHII", 306, 2, len(texts[1]), at + len(texts[0]))
    body = b"Exif\x00\x00" + b"II*\x00" + struct.pack("<IH", 8, 3) + entries + struct.pack("<I", 0) + b"".join(texts)
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body


def image_files(s, d):
    """A picture for each nation: its size and colour from its keys, every third one with a transparent colour; every fifth file is broken."""
    rows = [(n.n_nationkey, n.n_regionkey) for n in A.table(s, d, "nation").select("n_nationkey", "n_regionkey").collect()]  # 25
    colour = lambda k, r: (10 * k, 51 * r, 255 - 10 * k) + ((100,) if k % 3 == 0 else ())
    return s.createDataFrame([(k, bytearray(b"broken" if k % 5 == 4 else png(k + 1, 2, colour(k, r)))) for k, r in rows], "path int, content binary")


@register(
    "x16_image_figures",
    """SELECT n_nationkey AS path, CASE WHEN ok THEN n_nationkey + 1 END AS width, CASE WHEN ok THEN 2 END AS height, CASE WHEN ok THEN round((n_nationkey + 1) / 2.0, 2) END AS aspect_ratio, ok AND n_nationkey % 3 = 0 AS has_transparency,
    CASE WHEN ok THEN (10 * n_nationkey) || ',' || (51 * n_regionkey) || ',' || (255 - 10 * n_nationkey) || ':100.0' ELSE '' END AS colours, NOT ok AS failed FROM (SELECT *, n_nationkey % 5 <> 4 AS ok FROM nation)""",
)
def x16(s, d):
    """Sizes, transparency and colours of image files; broken ones give an error."""
    colour = lambda c: F.concat(c["r"].cast("string"), F.lit(","), c["g"].cast("string"), F.lit(","), c["b"].cast("string"), F.lit(":"), c["percentage"].cast("string"))
    out = images.analysed(image_files(s, d))
    return out.select("path", "width", "height", "aspect_ratio", "has_transparency", F.array_join(F.transform("dominant_colors", colour), ";").alias("colours"), F.col("error").isNotNull().alias("failed"))


@register("x17_camera_data", "SELECT n_nationkey AS path, CAST(n_regionkey + 100 AS VARCHAR) AS width, n_name AS make, '2024:01:02 03:04:05' AS taken FROM nation")
def x17(s, d):
    rows = [(n.n_nationkey, bytearray(jpeg_head(n.n_name, "2024:01:02 03:04:05", n.n_regionkey + 100))) for n in A.table(s, d, "nation").collect()]  # 25
    found = images.analysed(s.createDataFrame(rows, "path int, content binary"))
    field = lambda name: F.try_element_at("exif_data", F.lit(name))
    return found.select("path", field("ImageWidth").alias("width"), field("Make").alias("make"), field("DateTime").alias("taken"))


@register(
    "a13_web_safe_colours",
    """SELECT n_nationkey AS media_id, '#' || lower(printf('%02X', CAST(round(10 * n_nationkey / 51.0) * 51 AS INT))) || lower(printf('%02X', 51 * n_regionkey)) || lower(printf('%02X', CAST(round((255 - 10 * n_nationkey) / 51.0) * 51 AS INT))) AS colour, 100.0 AS percentage
    FROM nation WHERE n_nationkey % 5 <> 4""",
)
def a13(s, d):
    """The colours of images on the web-safe palette."""
    found = images.analysed(image_files(s, d)).select(F.col("path").alias("media_id"), F.explode("dominant_colors").alias("c")).select("media_id", "c.*")
    return media.palette_shares(found)


# --- Predictors ---------------------------------------------------------------------------------------------------


def _no_library():
    raise ImportError("not installed")


def _by_length():
    """Logits of contradiction, entailment and neutral by the texts' lengths."""
    return similarity.scored_classes(lambda pairs: np.array([[float(len(a) > len(b)), float(len(a) < len(b)), 0.5] for a, b in pairs]))


@register("x13_predictor_chain", "SELECT n_nationkey AS source_id, n_regionkey AS target_id, CASE WHEN length(n_name) > length(r_name) THEN -1 WHEN length(n_name) < length(r_name) THEN 1 ELSE 0 END AS label FROM nation JOIN region ON r_regionkey = n_regionkey")
def x13(s, d):
    """The first predictor of a chain that can be loaded labels the pairs."""
    nations = A.table(s, d, "nation")
    pairs = nations.select((100 + F.col("n_nationkey")).alias("source_id"), F.col("n_regionkey").alias("target_id"), F.lit(1.0).alias("score"))
    texts = nations.select((100 + F.col("n_nationkey")).alias("id"), F.col("n_name").alias("text")).unionByName(A.table(s, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("text")))
    out = similarity.labelled(pairs, texts, similarity.first_predictor(_no_library, _by_length))
    return out.select((F.col("source_id") - 100).alias("source_id"), "target_id", "label")
