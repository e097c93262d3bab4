"""WARC: not-modified revisits resolved by an as-of join.

A revisit record says that a server answered "not modified": it has headers but no
payload. ``resolve_revisits`` finds for each the latest earlier full response to the
same canonical URL, checks the validators that both have (ETag by weak comparison, else
Last-Modified) and merges the headers that such an answer may update into the stored
ones. The join is a window over time. A URL of more than ``hot_rows`` records is cut into
buckets at the quantiles of its own times, so that a burst is cut as well: each
(URL, bucket) is one window group, and what a bucket starts with is the latest response
of the buckets before it. A URL with a third of all records is thus spread over many
tasks; only records of one URL and one time stay together. Payloads are not moved: the
result names the response.

Status of a revisit: ``resolved`` (a validator of both agrees), ``unvalidated`` (they
share no validator), ``mismatch`` (the shared one differs), ``no_response`` (no
earlier response). Only the first two have merged headers; ``refers_to`` names the
response for all but the last.

Defined results: records of a null URL or time resolve to nothing (no_response);
responses at the same time: the largest record id counts; a response at the revisit's
own time is not earlier; repeated revisits each get a row; null header maps are empty;
header names are compared in lower case; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import broadcast_if_small, checkpointed

#: Headers that a not-modified answer must not change, as they describe the stored body or the connection.
KEPT_HEADERS = (
    "connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade",
)
#: Query parameters that do not name a resource.
TRACKING = "utm_[a-z]+|gclid|fbclid|ref|sessionid"


def canonical_url(url: Column) -> Column:
    """Scheme, "www." and "m.", default port, fragment, tracking parameters and a trailing slash dropped; the host in lower case."""
    rest = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://|#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r"^(www|m)\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/$", "")
    query = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"\?(.*)$", 1), rf"(^|&)({TRACKING})=[^&]*", ""), "^&", "")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def _lowered(headers: Column) -> Column:
    """The map with lower-case names; of names that differ in case only, the last value."""
    rows = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.array_distinct(F.transform(rows, lambda e: e["key"]))
    last = lambda n: F.element_at(F.filter(rows, lambda e: e["key"] == n), -1)["value"]
    return F.coalesce(F.map_from_arrays(names, F.transform(names, last)), F.create_map().cast("map<string,string>"))


def _same(a: Column, b: Column, name: str) -> Column:
    """Whether both have the header with one value; null unless both have it. ETags are compared weakly."""
    x, y = F.try_element_at(a, F.lit(name)), F.try_element_at(b, F.lit(name))
    if name == "etag":
        x, y = F.regexp_replace(x, "^W/", ""), F.regexp_replace(y, "^W/", "")
    return x == y


def merged_headers(stored: Column, update: Column) -> Column:
    """The stored headers with those of the not-modified answer over them, but for KEPT_HEADERS."""
    allowed = F.map_filter(update, lambda k, _: ~k.isin(*KEPT_HEADERS))
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.map_contains_key(allowed, k)), allowed)


def _with_buckets(rows: DataFrame, hot_rows: int) -> DataFrame:
    """``rows`` (key, ts) with a bucket of time: 0, and for keys of more than ``hot_rows`` rows the number of quantiles before it."""
    hot = checkpointed(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows))
    most = hot.agg(F.max("n")).first()[0]
    if most is None:
        return rows.withColumn("bucket", F.lit(0))
    parts = min(10_000, -(-most // hot_rows))
    of_hot = rows.join(broadcast_if_small(hot.select("key")), "key").groupBy("key")
    edges = checkpointed(of_hot.agg(F.array_distinct(F.percentile_approx("ts", [i / parts for i in range(1, parts)], 10_000)).alias("edges")))
    joined = rows.join(broadcast_if_small(edges, 1_000_000 // parts), "key", "left")
    return joined.withColumn("bucket", F.coalesce(F.size(F.filter("edges", lambda e: e < F.col("ts"))), F.lit(0))).drop("edges")


def resolve_revisits(
    records: DataFrame, id_col: str = "record_id", url_col: str = "url", time_col: str = "ts", type_col: str = "type", headers_col: str = "headers", hot_rows: int = 100_000
) -> DataFrame:
    """One row per revisit: record_id, url_key, ts, status, refers_to, headers. ``type_col``: 'response' or 'revisit', other records are left out; times are whole numbers or timestamps."""
    time = F.col(time_col) if records.schema[time_col].dataType.simpleString() in ("bigint", "int") else F.unix_micros(time_col)
    every = records.where(F.col(type_col).isin("response", "revisit")).select(F.col(id_col).alias("id"), canonical_url(F.col(url_col)).alias("key"), time.cast("bigint").alias("ts"), (F.col(type_col) == "response").alias("full"), _lowered(F.col(headers_col)).alias("headers"))
    placed = F.col("key").isNotNull() & F.col("ts").isNotNull()
    rows = _with_buckets(every.where(placed), hot_rows)
    when = F.when(F.col("full"), F.struct("ts", "id"))
    response = F.when(F.col("full"), F.struct(F.col("id").alias("id"), F.col("headers").alias("headers")))
    # What each bucket of a URL ends with, and from it what the next ones start with.
    ends = rows.where("full").groupBy("key", "bucket").agg(F.max_by(response, when).alias("last"))
    earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.select("key", "bucket").distinct().join(ends, ["key", "bucket"], "left").select("key", "bucket", F.last("last", ignorenulls=True).over(earlier).alias("start"))
    before = Window.partitionBy("key", "bucket").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("found", F.max_by(response, when).over(before)).where(~F.col("full"))
    found = inside.join(starts, ["key", "bucket"], "left").withColumn("r", F.coalesce("found", "start")).select("id", "key", "ts", "headers", "r")
    alone = every.where(~placed & ~F.col("full")).withColumn("r", F.lit(None).cast(found.schema["r"].dataType)).select("id", "key", "ts", "headers", "r")
    out = found.unionByName(alone)
    same = F.coalesce(_same(F.col("r.headers"), F.col("headers"), "etag"), _same(F.col("r.headers"), F.col("headers"), "last-modified"))
    status = F.when(F.col("r").isNull(), "no_response").when(same, "resolved").when(~same, "mismatch").otherwise("unvalidated")
    return out.withColumn("status", status).select(
        F.col("id").alias(id_col),
        F.col("key").alias("url_key"),
        "ts",
        "status",
        F.col("r.id").alias("refers_to"),
        F.when(F.col("status").isin("resolved", "unvalidated"), merged_headers(F.col("r.headers"), F.col("headers"))).alias("headers"),
    )


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """Capture records of the pages table, which has none of its own: two visits to every page.

    The first visit, at time page_id, is a full response with the page's MD5 as ETag. The second, half a million later, asks with that
    ETag and is answered "not modified"; every tenth such answer has no ETag and every fifteenth a new one, as servers do.
    """
    etag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    again = F.when(F.col("page_id") % 10 == 3, F.lit(None).cast("string")).when(F.col("page_id") % 15 == 7, F.lit('"new"')).otherwise(F.concat(F.lit("W/"), etag))
    common = {"url": F.col("url"), "page_id": F.col("page_id")}
    stored = F.create_map(F.lit("ETag"), etag, F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.length(F.coalesce("html", F.lit(""))).cast("string"), F.lit("Date"), F.concat(F.lit("t"), F.col("page_id")))
    update = F.map_filter(F.create_map(F.lit("etag"), again, F.lit("content-length"), F.lit("0"), F.lit("date"), F.concat(F.lit("u"), F.col("page_id"))), lambda _, v: v.isNotNull())
    first = F.struct((2 * F.col("page_id")).alias("record_id"), common["url"].alias("url"), F.col("page_id").alias("ts"), F.lit("response").alias("type"), stored.alias("headers"))
    second = F.struct((2 * F.col("page_id") + 1).alias("record_id"), common["url"].alias("url"), (F.col("page_id") + 500_000).alias("ts"), F.lit("revisit").alias("type"), update.alias("headers"))
    return pages.select(F.explode(F.array(first, second)).alias("x")).select("x.*")
