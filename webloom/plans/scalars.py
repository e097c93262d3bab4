"""Queries over single values: URLs, dates, text, JSON, vectors, colours."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.functions import dates, text, urls, vectors
from webloom.operators import media, merge, worklists
from webloom.plans.registry import register
from webloom.sources import adapters as A

# --- URLs: the pages' own, and literal ones in disguise -----------------------------------------------------------

URL_ROWS = [
    (1, "https://web.archive.org/web/20221026155732/https://example.com/p?q=1#f"), (2, "https://web.archive.org/web/20241211122618im_/https://e.org/i.png"),
    (3, "https://ghostarchive.org/archive/12345/https://example.com/p"), (4, "https://example.org/web/2020/https://x.org/"), (5, "#top"), (6, "http://a/#b"), (7, "mailto:x@y.z"),
    (8, "https://e.org/a.PDF"), (9, "https://e.org/a.pdf"), (10, "https://e.org/a.pdf?x=1"), (11, "https://e.org/a.gif"), (12, None), (13, "https://mobile.twitter.com/example/status/1"),
    (14, "https://www.youtube.com/watch?v=1"), (15, "https://www.youtube.com/@name/videos"), (16, "https://fr.linkedin.com/in-x/y"),
]
URLS = "id int, url string"
AUTHORITY = r"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)"
REST = r"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(.*)$', 1)"
UNWRAPPED = rf"""CASE WHEN {AUTHORITY} IN ('web.archive.org', 'archive.org') AND regexp_extract({REST}, '/web/\d+(?:[a-z]+_)?/(.+)$', 1) <> '' THEN regexp_extract({REST}, '/web/\d+(?:[a-z]+_)?/(.+)$', 1)
WHEN {AUTHORITY} = 'ghostarchive.org' AND regexp_extract({REST}, '/archive/[^/]+/(.+)$', 1) <> '' THEN regexp_extract({REST}, '/archive/[^/]+/(.+)$', 1) ELSE {{u}} END"""


@register("u2_without_anchor", "SELECT page_id, CASE WHEN position('#' IN url) > 1 THEN split_part(url, '#', 1) ELSE url END AS url FROM pages")
def u2(s, d):
    return A.table(s, d, "pages").select("page_id", urls.without_anchor(F.col("url")).alias("url"))


@register("u3_unwrapped", f"SELECT id, {UNWRAPPED.format(u='url')} AS url FROM {A.values_sql(URLS, URL_ROWS)}")
def u3(s, d):
    return A.values(s, URLS, URL_ROWS).select("id", urls.unwrapped(F.col("url")).alias("url"))


SHORT = {"twitter.com": r"([a-z0-9\-_]*\.?twitter\.com/[a-zA-Z0-9\.\-_]+)", "linkedin.com": r"([a-z0-9\-_]+\.linkedin\.com/[a-zA-Z0-9\.\-_]+)/?\??"}


@register(
    "u4_domain_name",
    f"""SELECT id, CASE WHEN n LIKE '%twitter.com' AND regexp_extract(u, '{SHORT['twitter.com']}', 1) <> '' THEN regexp_extract(u, '{SHORT['twitter.com']}', 1)
    WHEN n LIKE '%linkedin.com' AND regexp_extract(u, '([a-z0-9\\-_]+\\.linkedin\\.com/[a-zA-Z0-9\\.\\-_]+)', 1) <> '' THEN regexp_extract(u, '([a-z0-9\\-_]+\\.linkedin\\.com/[a-zA-Z0-9\\.\\-_]+)', 1) ELSE n END AS domain
    FROM (SELECT id, u, {AUTHORITY.format(u='u')} AS n FROM (SELECT id, {UNWRAPPED.format(u='url')} AS u FROM {A.values_sql(URLS, URL_ROWS)}))""",
)
def u4(s, d):
    return A.values(s, URLS, URL_ROWS).select("id", urls.domain_name(F.col("url"), SHORT).alias("domain"))


@register("u4_page_domains", f"SELECT domain, count(*) AS n FROM (SELECT {AUTHORITY.format(u='url')} AS domain FROM pages) GROUP BY domain")
def u4b(s, d):
    return A.table(s, d, "pages").groupBy(urls.domain_name(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))


@register("u5_u6_rederived_domains", f"SELECT page_id AS id, 'x.example' AS domain, {AUTHORITY.format(u='url')} AS new_domain FROM pages WHERE page_id % 3 = 0")
def u5(s, d):
    own = urls.domain_name(F.col("url"))
    p = A.table(s, d, "pages").select(F.col("page_id").alias("id"), "url", F.when(F.col("page_id") % 3 == 0, "x.example").otherwise(own).alias("domain"))
    return merge.rederived_domains(p, own)


@register("f10_archive_domains", f"SELECT id, {UNWRAPPED.format(u='url')} AS url FROM {A.values_sql(URLS, URL_ROWS)} WHERE {AUTHORITY.format(u='url')} IN ('web.archive.org', 'archive.org', 'ghostarchive.org')")
def f10(s, d):
    rows = A.values(s, URLS, URL_ROWS)
    return rows.where(urls.authority(F.col("url")).isin(*urls.ARCHIVE_DOMAINS)).select("id", urls.unwrapped(F.col("url")).alias("url"))


@register("u1_resolved", r"""SELECT page_id, lower(regexp_extract(url, '^(https?://[^/?#]*)', 1) || href) AS url FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="(/[^"/][^"]*)"', 1)) AS href FROM pages)""")
def u1(s, d):
    """Every root-relative link of a page against its URL."""
    rows = A.table(s, d, "pages").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('<a href="(/[^"/][^"]*)"'), F.lit(1))).alias("href"))
    return rows.select("page_id", urls.resolved(F.col("url"), F.col("href")).alias("url"))


@register("f12_crawlable", rf"SELECT id, coalesce(regexp_matches(url, '^https?://') AND NOT regexp_matches(url, '\.(jpg|jpeg|png|bmp|webp|pdf|txt|csv|xls|xlsx|doc|docx)$'), FALSE) AS ok FROM {A.values_sql(URLS, URL_ROWS)}")
def f12(s, d):
    return A.values(s, URLS, URL_ROWS).select("id", urls.is_crawlable(F.col("url")).alias("ok"))


MEDIA_ROWS = [(1, "https://a.org/x.JPG?y=1", "img"), (2, "/x.gif#f", "img"), (3, "data:image/png;base64,xx", "img"), (4, "https://a.org/x.mp4", "video"), (5, "https://a.org/x.mp4", "audio"), (6, None, "img"), (7, "x.svg", "img"), (8, "https://a.org/jpg", "img")]


@register(
    "f14_media_ending",
    rf"""SELECT id, coalesce(lower(url) LIKE 'data:%' OR CASE kind WHEN 'img' THEN regexp_matches(p, '\.(jpg|jpeg|png|gif|webp|bmp|svg)$') WHEN 'video' THEN regexp_matches(p, '\.(mp4|webm|ogg|ogv|mov|avi|mkv)$') ELSE regexp_matches(p, '\.(mp3|wav|ogg|aac|flac|m4a)$') END, FALSE) AS ok
    FROM (SELECT *, lower(regexp_replace(url, '[?#].*$', '')) AS p FROM {A.values_sql("id int, url string, kind string", MEDIA_ROWS)})""",
)
def f14(s, d):
    rows = A.values(s, "id int, url string, kind string", MEDIA_ROWS)
    kinds = [F.when(F.col("kind") == k, urls.has_media_ending(F.col("url"), k)) for k in urls.MEDIA_ENDINGS]
    return rows.select("id", F.coalesce(*kinds).alias("ok"))


SIZES = [(1, 100, 50, 1000), (2, 10, 50, 1000), (3, None, 50, 10), (4, 300, 300, 900000), (5, 200, 200, None)]


@register("f11_media_conformance", f"SELECT id, coalesce(width, 0) >= 50 AND coalesce(height, 0) >= 50 AND coalesce(file_size, 0) <= 5000 AS conforming FROM {A.values_sql('id int, width int, height int, file_size int', SIZES)}")
def f11(s, d):
    return worklists.conforming_media(A.values(s, "id int, width int, height int, file_size int", SIZES), 50, 50, 5000).select("id", "conforming")


LANGS = [(1, "fr-FR", "fr"), (2, "de", "fr,en"), (3, "", "fr"), (4, "en-US", "en,fr"), (5, ",", "fr"), (6, None, "fr"), (7, "de", None), (8, "FR , de", "it, fr-CA")]


@register(
    "f13_language_gate",
    f"""SELECT id, coalesce(trim(a), '') = '' OR coalesce(trim(b), '') = '' OR len(list_intersect(list_transform(list_filter(list_transform(string_split(a, ','), lambda x: lower(trim(x))), lambda x: x <> ''), lambda x: split_part(x, '-', 1)),
    list_transform(list_filter(list_transform(string_split(b, ','), lambda x: lower(trim(x))), lambda x: x <> ''), lambda x: split_part(x, '-', 1)))) > 0 AS ok FROM {A.values_sql('id int, a string, b string', LANGS)}""",
)
def f13(s, d):
    return A.values(s, "id int, a string, b string", LANGS).select("id", worklists.language_ok(F.col("a"), F.col("b")).alias("ok"))


@register("src2_split_list", "SELECT event_id, array_to_string(list_transform(list_filter(string_split('a, b ,,c,' || event_type, ','), lambda x: x <> ''), lambda x: trim(x)), '|') AS items FROM events")
def src2(s, d):
    return A.table(s, d, "events").select("event_id", F.array_join(urls.split_list(F.concat(F.lit("a, b ,,c,"), "event_type")), "|").alias("items"))


# --- Dates --------------------------------------------------------------------------------------------------------

RANGES = [(1, "2024-01-31", "2024-05-31"), (2, "2024-01-01", "2024-01-31"), (3, "2023-12-05", "2023-12-05")]


def ranges(s):
    return A.values(s, "id int, a string, b string", RANGES).select("id", F.to_date("a").alias("a"), F.to_date("b").alias("b"))


def _range_sql(days: int) -> str:
    return f"SELECT id, CAST(w AS DATE) AS window_start, least(CAST(w AS DATE) + {days - 1}, CAST(b AS DATE)) AS window_end FROM (SELECT id, b, unnest(generate_series(CAST(a AS DATE), CAST(b AS DATE), INTERVAL {days} DAY)) AS w FROM {A.values_sql('id int, a string, b string', RANGES)})"


@register("d3_src9_week_windows", _range_sql(7))
def d3w(s, d):
    return dates.windows(ranges(s), "a", "b", "week").select("id", "window_start", "window_end")


@register("d3_day_windows", _range_sql(1))
def d3d(s, d):
    return dates.windows(ranges(s), "a", "b", "day").select("id", "window_start", "window_end")


@register(
    "d3_d4_month_windows",
    f"""WITH RECURSIVE w(id, s, e) AS (SELECT id, CAST(a AS DATE), CAST(b AS DATE) FROM {A.values_sql('id int, a string, b string', RANGES)} UNION ALL SELECT id, CAST(s + INTERVAL 1 MONTH AS DATE), e FROM w WHERE CAST(s + INTERVAL 1 MONTH AS DATE) <= e)
    SELECT id, s AS window_start, least(CAST(s + INTERVAL 1 MONTH AS DATE) - 1, e) AS window_end FROM w""",
)
def d3m(s, d):
    return dates.windows(ranges(s), "a", "b", "month").select("id", "window_start", "window_end")


@register("d7_tbs", "SELECT o_orderkey, 'cdr:1,cd_min:' || strftime(o_orderdate, '%m/%d/%Y') || ',cd_max:' || strftime(o_orderdate + INTERVAL 6 DAY, '%m/%d/%Y') AS tbs FROM orders")
def d7(s, d):
    day = F.to_date("o_orderdate")
    return A.table(s, d, "orders").select("o_orderkey", dates.tbs(day, F.date_add(day, 6)).alias("tbs"))


@register("d2_earlier_date", "SELECT event_id, least(CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts END, CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts - INTERVAL 1 HOUR END) AS t FROM events")
def d2(s, d):
    a, b = F.expr("CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts END"), F.expr("CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts - INTERVAL 1 HOUR END")
    return A.table(s, d, "events").select("event_id", dates.earlier(a, b).alias("t"))


DATE_ROWS = [
    (1, "2024-01-07"), (2, "January 07, 2024"), (3, "Updated: Apr 2, 2024"), (4, "Publié - 3 May 2023"), (5, "2 days ago"), (6, "about 3 hours ago"), (7, "yesterday"), (8, "today"), (9, "1st"), (10, "nonsense"),
    (11, None), (12, "2024/02/03"), (13, "13/02/2024"), (14, "02.03.2024"), (15, "2024-03-04T05:06:07Z"), (16, "1 month ago"), (17, "Sept. 1"), (18, "Jan. 5, 2022"), (19, "5 years ago"),
]
DATE_RESULTS = [
    (1, "2024-01-07 00:00:00"), (2, "2024-01-07 00:00:00"), (3, "2024-04-02 00:00:00"), (4, "2023-05-03 00:00:00"), (5, "2024-06-13 12:00:00"), (6, "2024-06-15 09:00:00"), (7, "2024-06-14 12:00:00"), (8, "2024-06-15 12:00:00"),
    (9, None), (10, None), (11, None), (12, "2024-02-03 00:00:00"), (13, "2024-02-13 00:00:00"), (14, "2024-03-02 00:00:00"), (15, "2024-03-04 05:06:07"), (16, "2024-05-16 12:00:00"), (17, None), (18, "2022-01-05 00:00:00"), (19, "2019-06-17 12:00:00"),
]


@register("d1_result_dates", f"SELECT id, t FROM {A.values_sql('id int, t string', DATE_RESULTS)}")
def d1(s, d):
    """The oracle lists the expected times, worked out by hand, as of noon on 15 June 2024."""
    as_of = F.lit("2024-06-15 12:00:00").cast("timestamp")
    return A.values(s, "id int, t string", DATE_ROWS).select("id", F.date_format(dates.result_date(F.col("t"), as_of), "yyyy-MM-dd HH:mm:ss").alias("t"))


D6_ROWS = [(1, "2024-03-04T05:06:07.089Z"), (2, "2024-03-04"), (3, "2024-03-04T05:06:07Z"), (4, "04/03/2024"), (5, None)]


@register("d6_extractor_dates", f"SELECT id, strftime(coalesce(try_strptime(t, '%Y-%m-%dT%H:%M:%S.%gZ'), try_strptime(t, '%Y-%m-%d'), try_strptime(t, '%Y-%m-%dT%H:%M:%SZ')), '%Y-%m-%d %H:%M:%S') AS t FROM {A.values_sql('id int, t string', D6_ROWS)}")
def d6(s, d):
    return A.values(s, "id int, t string", D6_ROWS).select("id", F.date_format(dates.extractor_date(F.col("t")), "yyyy-MM-dd HH:mm:ss").alias("t"))


ENGINES = [(1, "google", "fr", 0, False), (2, "google", "EN", 100, True), (3, "bing", None, 50, False), (4, "duckduckgo", "de", 0, True), (5, "other", "fr", 0, False)]
ENGINE_RESULTS = [
    (1, "gl=fr;google_domain=google.fr;hl=fr;lr=lang_fr;num=100;safe=off;start=0"), (2, "gl=en;google_domain=google.com;hl=en;lr=lang_en;safe=off;start=100"), (3, "count=50;first=51;mkt=fr-FR"),
    (4, "df=2024-01-01..2024-01-07;kl=us-en;m=50;start=0"), (5, ""),
]


@register("d8_request_params", f"SELECT id, params FROM {A.values_sql('id int, params string', ENGINE_RESULTS)}")
def d8(s, d):
    rows = A.values(s, "id int, engine string, lang string, at int, dated boolean", ENGINES)
    m = dates.request_params(F.col("engine"), F.col("lang"), F.col("at"), F.lit("2024-01-01").cast("date"), F.lit("2024-01-07").cast("date"), F.col("dated"))
    return rows.select("id", F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("params"))


# --- Text and JSON ------------------------------------------------------------------------------------------------


@register("t1_words", "SELECT doc_id, len(regexp_extract_all(lower(text), '[A-Za-zÀ-ÖØ-öø-ÿ]+')) AS n, array_to_string(regexp_extract_all(lower(text), '[A-Za-zÀ-ÖØ-öø-ÿ]+')[1:5], ' ') AS head FROM documents")
def t1(s, d):
    w = text.words(F.col("text"))
    return A.table(s, d, "documents").select("doc_id", F.size(w).cast("bigint").alias("n"), F.array_join(F.slice(w, 1, 5), " ").alias("head"))


@register("t7_cleaned", r"SELECT doc_id, trim(regexp_replace(text, '[\s\x0b\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS text FROM documents")
def t7(s, d):
    return A.table(s, d, "documents").select("doc_id", text.cleaned(F.col("text")).alias("text"))


@register("t9_text_hash", "SELECT doc_id, sha256(text) AS h FROM documents")
def t9(s, d):
    return A.table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))


MD = [(1, "See [x](https://e.org/A_(b)) and (https://foo.com/path)"), (2, "[a](http://x.org/y)"), (3, "none (ftp://f.org/z) at all"), (4, None)]


@register("t18_md_links", f"SELECT id, u FROM {A.values_sql('id int, u string', [(1, 'https://e.org/A_(b'), (1, 'https://foo.com/path'), (2, 'http://x.org/y'), (3, 'ftp://f.org/z')])}")
def t18(s, d):
    return A.values(s, "id int, t string", MD).select("id", F.explode(text.md_links(F.col("t"))).alias("u"))


ANSWERS = [(1, "Non."), (2, "no"), (3, "nope"), (4, "OUI"), (5, "yes"), (6, "yes!"), (7, None), (8, " Oui, bien sûr")]


@register("t26_verdicts", f"SELECT id, CASE WHEN lower(trim(a)) LIKE 'non%' OR lower(trim(a)) = 'no' THEN 'non' WHEN lower(trim(a)) LIKE 'oui%' OR lower(trim(a)) = 'yes' THEN 'oui' ELSE '?' END AS v FROM {A.values_sql('id int, a string', ANSWERS)}")
def t26(s, d):
    return A.values(s, "id int, a string", ANSWERS).select("id", text.verdict(F.col("a")).alias("v"))


@register(
    "t27_t28_prompt",
    """SELECT doc_id, 'Is this page relevant to the project? Answer only "oui" or "non".' || chr(10) || '- project: p' || chr(10) || '- about: ' || chr(10) || '- terms: a, b' || chr(10) || '- url: ' || doc_id || chr(10) || '- title: ' || source || chr(10) || '- description: ' || chr(10) || '- text: ' || substr(text, 1, 80) AS prompt FROM documents""",
)
def t27(s, d):
    none = F.lit(None).cast("string")
    p = text.prompt(F.lit("p"), none, F.array(F.lit("a"), F.lit("b")), F.col("doc_id").cast("string"), F.col("source"), none, F.col("text"), 80)
    return A.table(s, d, "documents").select("doc_id", p.alias("prompt"))


@register("snk3_normalised", f"SELECT id, CASE WHEN description IS NULL OR lower(trim(description)) IN ('', 'unknown') THEN 'na' ELSE trim(description) END AS v FROM {A.DOMAIN.sql}")
def snk3(s, d):
    return A.DOMAIN.frame(s, d).select("id", text.normalised(F.col("description")).alias("v"))


@register(
    "snk8_dublin_core",
    """SELECT s_suppkey AS id, '---' || chr(10) || 'Title: "' || s_name || '"' || chr(10) || array_to_string(['Creator: ""', 'Contributor: ""', 'Coverage: ""', 'Date: ""', 'Description: "None"', 'Subject: ""', 'Type: ""', 'Format: ""'], chr(10)) || chr(10)
    || 'Identifier: "' || s_suppkey || '"' || chr(10) || 'Language: ""' || chr(10) || 'Publisher: "' || s_nationkey || '"' || chr(10) || 'Relation: ""' || chr(10) || 'Rights: ""' || chr(10) || 'Source: "u"' || chr(10) || '---' || chr(10) AS header FROM supplier""",
)
def snk8(s, d):
    h = text.dublin_core(title=F.col("s_name"), description=F.lit(None).cast("string"), identifier=F.col("s_suppkey"), publisher=F.col("s_nationkey"), source=F.lit("u"))
    return A.table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), h.alias("header"))


SLUGS = [(1, "Hello, Wörld!"), (2, "  --A  b--c "), (3, None), (4, "Été 2024: l'École")]


@register("snk9_slugs", f"SELECT id, slug, legacy FROM {A.values_sql('id int, slug string, legacy string', [(1, 'hello-world', 'b-hello-world'), (2, 'a-b-c', 'b-a-b-c'), (3, '', 'b'), (4, 'ete-2024-l-ecole', 'b-ete-2024-l-ecole')])}")
def snk9(s, d):
    return A.values(s, "id int, t string", SLUGS).select("id", text.slug(F.col("t")).alias("slug"), text.legacy_slug(F.col("t")).alias("legacy"))


@register("js3_nested_path", """SELECT event_id, coalesce(json_extract_string('{"a":' || props || '}', '$.a.k'), 'none') AS k, coalesce(json_extract_string(props, '$.zz'), 'none') AS z FROM events""")
def js3(s, d):
    nested = F.get_json_object(F.concat(F.lit('{"a":'), "props", F.lit("}")), "$.a.k")
    return A.table(s, d, "events").select("event_id", F.coalesce(nested, F.lit("none")).alias("k"), F.coalesce(F.get_json_object("props", "$.zz"), F.lit("none")).alias("z"))


@register("js2_c6_json_round_trip", """SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || '}' AS j FROM events""")
def js2(s, d):
    m = F.from_json("props", "map<string,int>")
    return A.table(s, d, "events").select("event_id", F.to_json(m).alias("j"))


@register("t2_c3_distinct_order", "SELECT doc_id, array_to_string(list_transform(list_sort(list_distinct(list_transform(string_split(lower(text), ' '), lambda w: length(w)))), lambda x: x), ',') AS lengths FROM documents")
def c3(s, d):
    lengths = F.array_sort(F.array_distinct(F.transform(F.split(F.lower("text"), " "), F.length)))
    return A.table(s, d, "documents").select("doc_id", F.array_join(F.transform(lengths, lambda x: x.cast("string")), ",").alias("lengths"))


# --- Vectors and colours ------------------------------------------------------------------------------------------


@register("m1_norms", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 5) AS norm FROM embeddings")
def m1(s, d):
    return A.table(s, d, "embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 5).alias("norm"))


@register("m2_c4_cosine", "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def m2(s, d):
    e = A.table(s, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("other")), 5).alias("score"))


@register("m3_unit", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: 2.0 * x)) / sqrt(list_sum(list_transform(embedding, lambda x: 4.0 * x * x))), 5) AS total FROM embeddings")
def m3(s, d):
    twice = F.transform("embedding", lambda x: 2.0 * x)
    return A.table(s, d, "embeddings").select("vec_id", F.round(F.aggregate(vectors.unit(twice), F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@register(
    "m4_offline_embedding",
    """SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS v FROM (
    SELECT doc_id, (unicode(c) * 39) % 64 AS bucket, CAST(count(*) AS DOUBLE) AS n FROM (SELECT doc_id, unnest(string_split(lower(text), '')) AS c FROM documents) WHERE c <> '' GROUP BY ALL)""",
)
def m4(s, d):
    v = A.table(s, d, "documents").select("doc_id", F.posexplode(vectors.offline_embedding(F.col("text"))).alias("bucket", "v"))
    return v.where("v > 0").select("doc_id", F.col("bucket").cast("bigint").alias("bucket"), F.round("v", 6).alias("v"))


COLOURS = [(1, 26, 25, 128, 60.5), (1, 30, 25, 130, 20.0), (1, 255, 255, 255, 19.5), (2, 0, 0, 0, 100.0)]


@register("a14_web_safe_shares", f"SELECT media_id, '#' || lpad(lower(hex(CAST(round(r / 51.0) * 51 AS INT))), 2, '0') || lpad(lower(hex(CAST(round(g / 51.0) * 51 AS INT))), 2, '0') || lpad(lower(hex(CAST(round(b / 51.0) * 51 AS INT))), 2, '0') AS colour, round(sum(percentage), 2) AS percentage FROM {A.values_sql('media_id int, r int, g int, b int, percentage double', COLOURS)} GROUP BY ALL")
def a14(s, d):
    return media.palette_shares(A.values(s, "media_id int, r int, g int, b int, percentage double", COLOURS))


@register("m6_m7_distance_and_ratio", f"SELECT media_id, (r - 51) * (r - 51) + (g - 51) * (g - 51) + (b - 51) * (b - 51) AS distance, CASE WHEN g = 0 THEN 0.0 ELSE round(CAST(r AS DOUBLE) / g, 2) END AS ratio FROM {A.values_sql('media_id int, r int, g int, b int, percentage double', COLOURS)}")
def m6(s, d):
    rows = A.values(s, "media_id int, r int, g int, b int, percentage double", COLOURS)
    grey = (F.lit(51),) * 3
    return rows.select("media_id", media.rgb_distance((F.col("r"), F.col("g"), F.col("b")), grey).alias("distance"), media.aspect_ratio(F.col("r"), F.col("g")).alias("ratio"))


@register("c9_slices", f"SELECT expression_id, substr(text, from_char + 1, to_char - from_char) AS slice FROM {A.TAGGED.sql}")
def c9(s, d):
    return A.TAGGED.frame(s, d).select("expression_id", F.expr("substring(text, from_char + 1, to_char - from_char)").alias("slice"))


@register("c5_c7_counter_maps", "SELECT user_id, sum(n) AS n, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS m FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def c7(s, d):
    counts = A.table(s, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    m = F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n"))))
    rows = counts.groupBy("user_id").agg(F.sum("n").cast("decimal(38,0)").alias("n"), m.alias("m"))
    return rows.select("user_id", F.col("n").cast("bigint").alias("n"), F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("m"))

