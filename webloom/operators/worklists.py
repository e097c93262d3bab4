"""Work lists: which pages a step still has to treat. Limits of 0 mean all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def limited(df: DataFrame, n: int = 0) -> DataFrame:
    return df.limit(n) if n else df


def relevant(pages: DataFrame, land: int | None, minimum: int = 1) -> DataFrame:
    """Pages of a land (any if None) with at least the minimum relevance; unknown relevance is out."""
    out = pages.where(F.col("relevance") >= minimum)
    return out if land is None else out.where(F.col("land_id") == land)


def projected(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Named expressions."""
    return df.select(*[F.expr(e).alias(n) for n, e in columns.items()])


def pending(pages: DataFrame, status: str | None = None, depth: int | None = None) -> DataFrame:
    """Pages not fetched yet, or those of a status for another try; of a depth if given."""
    out = pages.where(F.col("fetched_at").isNull() if status is None else F.col("http_status") == status)
    return out if depth is None else out.where(F.col("depth") == depth)


def pending_depths(pages: DataFrame) -> DataFrame:
    return pending(pages).select("depth").distinct().orderBy("depth")


def unread(pages: DataFrame, depth: int | None = None, n: int = 0) -> DataFrame:
    """Fetched pages without readable text, the longest waiting first."""
    out = pages.where("fetched_at IS NOT NULL AND readable_at IS NULL")
    out = out if depth is None else out.where(F.col("depth") == depth)
    return limited(out.orderBy(F.asc_nulls_first("fetched_at"), "depth", "id"), n)


def consolidatable(pages: DataFrame, depth: int | None = None, minimum: int = 0, n: int = 0) -> DataFrame:
    out = pages.where("approved_at IS NOT NULL OR readable_at IS NOT NULL")
    out = out if depth is None else out.where(F.col("depth") == depth)
    return limited((out.where(F.col("relevance") >= minimum) if minimum else out).orderBy("id"), n)


def seo_due(pages: DataFrame, status: str | None = "200", minimum: int = 1, depth: int | None = None, force: bool = False, n: int = 0) -> DataFrame:
    """Pages without an SEO payload (all when forced); ``status`` may be switched off by all, any, none or ''."""
    out = pages if status is None or status.lower() in ("", "all", "any", "none") else pages.where(F.col("http_status") == status)
    out = out.where(F.col("relevance") >= minimum)
    out = out if depth is None else out.where(F.col("depth") == depth)
    return limited((out if force else out.where("seorank IS NULL")).orderBy("id"), n)


def unjudged(pages: DataFrame, least_chars: int, force: bool = False, n: int = 0) -> DataFrame:
    """Pages with enough readable text and no verdict; when forced, those judged "non" too."""
    verdict = F.col("validllm")
    due = verdict.isNull() | ~verdict.isin("oui", "non")
    due = due | (verdict == "non") if force else due
    return limited(pages.where(due & (F.length("readable") >= least_chars)).orderBy("id"), n)


def kept_after_delete(rows: DataFrame, condition: Column) -> DataFrame:
    """Copy-on-write deletion: what is left. Rows for which the condition is unknown stay."""
    return rows.where(~F.coalesce(condition, F.lit(False)))


def deletable(rows: DataFrame, condition: Column) -> DataFrame:
    """The dry run of ``kept_after_delete``: what it would take."""
    return rows.where(F.coalesce(condition, F.lit(False)))


def paged(rows: DataFrame, order: str, size: int, page: int) -> DataFrame:
    """One page (from 0) of rows by a unique order."""
    return rows.orderBy(order).offset(size * page).limit(size)


def conforming_media(media: DataFrame, least_width: int = 0, least_height: int = 0, most_bytes: int = 0) -> DataFrame:
    """Whether each item has the least size and at most so many bytes (0: no limit); unknown figures count as 0."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    ok = (n("width") >= least_width) & (n("height") >= least_height) & ((n("file_size") <= most_bytes) if most_bytes else F.lit(True))
    return media.withColumn("conforming", ok)


def language_ok(page_lang: Column, land_langs: Column) -> Column:
    """Whether a page's languages (comma list) meet the land's; either side unknown: yes. Variants count as their base."""
    base = lambda c: F.transform(F.filter(F.transform(F.split(c, ","), lambda x: F.lower(F.trim(x))), lambda x: x != ""), lambda x: F.substring_index(x, "-", 1))
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    return F.when(blank(page_lang) | blank(land_langs), True).otherwise(F.arrays_overlap(base(page_lang), base(land_langs)))
