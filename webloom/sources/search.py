"""Search results and page metrics from services: a request and an answer at a time, by functions that the caller gives.

Requests are rows, one for each query and window of dates; the executors page through
the answers of each. Nothing here needs a network.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import parse_qs, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions import dates, urls
from webloom.sources.fetch import WAITS

#: Engines that can filter by date.
DATED = ("google", "duckduckgo")

#: A search answers parameters with a JSON payload as a dictionary.
Search = Callable[[dict], dict]


class SearchError(Exception):
    """An answer that is an error."""


def requests(queries: DataFrame, step: str = "week") -> DataFrame:
    """(query, engine, lang, window_start, window_end): a row for each window of dates, and one without where there are none.

    ``queries``: query, engine, lang, start, end (dates or null). Dates for an engine that cannot filter, only one of the two, or a
    start after the end are errors.
    """
    bad = F.col("start").isNull() != F.col("end").isNull()
    bad |= F.col("start").isNotNull() & ~F.col("engine").isin(*DATED)
    bad |= F.coalesce(F.col("start") > F.col("end"), F.lit(False))
    checked = queries.withColumn("start", F.when(bad, F.raise_error(F.concat(F.lit("dates of query "), F.col("query")))).otherwise(F.col("start")))
    names = ["query", "engine", "lang", "window_start", "window_end"]
    whole = checked.where("start IS NULL").withColumn("window_start", F.lit(None).cast("date")).withColumn("window_end", F.lit(None).cast("date"))
    return dates.windows(checked.where("start IS NOT NULL"), "start", "end", step).select(*names).unionByName(whole.select(*names))


def next_start(payload: dict, start: int, found: int) -> int | None:
    """Where the next page of results starts; None after the last."""
    pages = payload.get("serpapi_pagination") or {}
    link = pages.get("next_link") or pages.get("next")
    if not link or not found:
        return None
    offset = pages.get("next_offset")
    if str(offset).isdigit() and int(offset) > start:
        return int(offset)
    if offset is None and isinstance(link, str):
        query = parse_qs(urlparse(link).query)
        for key in ("start", "first", "offset"):
            value = query.get(key, [""])[0]
            if value.isdigit() and int(value) > start:
                return int(value)
    return start + found


def pages_of(params: dict, search: Search, start_key: str, first: int = 0) -> Iterator[dict]:
    """The results of a request, page after page. ``first``: what the service calls the first place."""
    start: int | None = 0
    while start is not None:
        payload = search(params | {start_key: start + first})
        if "error" in payload:
            if params.get("engine") == "duckduckgo" and "hasn't returned any results" in str(payload["error"]).lower():
                return
            raise SearchError(str(payload["error"]))
        found = payload.get("organic_results") or []
        yield from found
        start = next_start(payload, start, len(found))


def results(wanted: DataFrame, search: Search) -> DataFrame:
    """(query, window_start, window_end, position, title, link, date) of all requests, as ``requests`` makes them."""
    start, end = F.col("window_start"), F.col("window_end")
    params = dates.request_params(F.col("engine"), F.col("lang"), F.lit(0), start, end, start.isNotNull())
    tbs = F.when((F.col("engine") == "google") & start.isNotNull(), dates.tbs(start, end))
    rows = wanted.select("query", "engine", "window_start", "window_end", F.to_json(params).alias("params"), tbs.alias("tbs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, r in enumerate(b.to_pylist()):
                given = {"engine": r["engine"], "q": r["query"], **json.loads(r["params"] or "{}"), **({"tbs": r["tbs"]} if r["tbs"] else {})}
                key = "first" if r["engine"] == "bing" else "start"
                found = list(pages_of(given, search, key, 1 if key == "first" else 0))
                one = b.slice(i, 1)
                own = [one.column(c).take(pa.array([0] * len(found), pa.int32())) for c in ("query", "window_start", "window_end")]
                cells = [pa.array([x.get("position") for x in found], pa.int64()), *(pa.array([x.get(c) for x in found], pa.string()) for c in ("title", "link", "date"))]
                yield pa.RecordBatch.from_arrays([*own, *cells], names=["query", "window_start", "window_end", "position", "title", "link", "date"])

    return rows.mapInArrow(run, "query string, window_start date, window_end date, position long, title string, link string, date string")


def metrics(pages: DataFrame, get: Callable[[str], tuple[int, str]], waits: Sequence[float] = WAITS[:2]) -> DataFrame:
    """(id, seorank): the JSON payload of each page's address, null if no attempt gave one.

    ``get`` answers an encoded address with a status and a body, or raises. Archived copies are asked for by their original address.
    """
    rows = pages.select("id", urls.percent_encoded(urls.unwrapped(F.col("url"))).alias("url"))

    def one(url: str | None) -> str | None:
        for wait in (*waits, None):
            try:
                status, body = get(url or "")
            except Exception:
                status, body = 0, ""
            if status == 200:
                try:
                    return json.dumps(json.loads(body))
                except ValueError:
                    return None
            if wait is not None:
                time.sleep(wait)
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([one(u) for u in b.column(1).to_pylist()], pa.string())], names=["id", "seorank"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, seorank string")
