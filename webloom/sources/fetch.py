"""Fetching: pluggable sources of pages, with retries and a ladder of fallbacks."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Fetched(NamedTuple):
    status: str
    html: str | None


#: A fetcher gets a URL and answers with a status and markup; it may raise.
Fetcher = Callable[[str], Fetched]
#: Waits between attempts in seconds; statuses of a client error and of any other failure.
WAITS = (1, 2, 5)
CLIENT_ERROR, OTHER_ERROR = "000", "ERR"


class ClientError(Exception):
    """A request that failed before an answer."""


def with_retries(fetch: Fetcher, waits: Sequence[float] = WAITS, sleep: Callable[[float], None] = time.sleep) -> Fetcher:
    """The fetcher, tried again after each wait; the last error counts."""

    def run(url: str) -> Fetched:
        for wait in (*waits, None):
            try:
                return fetch(url)
            except Exception as e:
                if wait is None:
                    return Fetched(CLIENT_ERROR if isinstance(e, ClientError) else OTHER_ERROR, None)
                sleep(wait)
        raise AssertionError("unreachable")

    return run


def ladder(*fetchers: Fetcher) -> Fetcher:
    """The first answer with markup; else the first answer."""

    def run(url: str) -> Fetched:
        first = None
        for f in fetchers:
            try:
                got = f(url)
            except ClientError:
                got = Fetched(CLIENT_ERROR, None)
            except Exception:
                got = Fetched(OTHER_ERROR, None)
            if got.html:
                return got
            first = first or got
        return first or Fetched(OTHER_ERROR, None)

    return run


#: An extractor gets a URL and markup and answers with a record (title, content, published_at, payload), or None; it may raise.
Extractor = Callable[[str, str], dict | None]
EXTRACTED = ("title", "content", "published_at", "payload")


def extracted(pages: DataFrame, extract: Extractor) -> DataFrame:
    """(id, title, content, published_at, payload, error) of pages (id, url, html) by an external extractor, run by the executors."""

    def one(url: str | None, html: str | None) -> dict:
        if html is None:
            return {"error": "no markup"}
        try:
            return extract(url or "", html) or {"error": "no answer"}
        except Exception as e:
            return {"error": str(e)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [one(u, h) for u, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([g.get(c) for g in got], pa.string()) for c in (*EXTRACTED, "error"))], names=["id", *EXTRACTED, "error"])

    rows = pages.select("id", "url", "html")
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {', '.join(f'{c} string' for c in (*EXTRACTED, 'error'))}")


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """(url) of a text file with one address a line; blank lines are left out."""
    return spark.read.text(path).select(F.trim("value").alias("url")).where("url <> ''")


def fetched(pages: DataFrame, fetch: Fetcher) -> DataFrame:
    """(id, http_status, html) of pages (id, url), fetched by the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [fetch(u) if u else Fetched(OTHER_ERROR, None) for u in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g.status for g in got], pa.string()), pa.array([g.html for g in got], pa.string())], names=["id", "http_status", "html"])

    return pages.select("id", "url").mapInArrow(run, "id long, http_status string, html string")


def stored(pages: DataFrame, store: DataFrame) -> DataFrame:
    """The same from a table of stored markup (url, html): pages that are not in it get status 404."""
    s = store.select("url", "html").dropDuplicates(["url"])
    return pages.select("id", "url").join(s, "url", "left").select("id", F.when(F.col("html").isNotNull(), "200").otherwise("404").alias("http_status"), "html")
