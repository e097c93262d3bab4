"""Reports: pages, domains, media, tags, pseudolinks and land statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.operators.worklists import kept_after_delete, relevant


def tag_names(tagged: DataFrame, tags: DataFrame) -> DataFrame:
    """(expression_id, tags): sorted distinct tag names of each page, aggregated before any join to pages."""
    names = tagged.join(tags.select(F.col("id").alias("tag_id"), "name"), "tag_id")
    return names.groupBy("expression_id").agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("tags"))


def page_report(pages: DataFrame, domains: DataFrame, tagged: DataFrame, tags: DataFrame, land: int, minimum: int = 1, readable: bool = False) -> DataFrame:
    """Relevant pages of a land with their domain and tags (null without a tag); with the readable text if asked for."""
    d = domains.select(F.col("id").alias("domain_id"), F.col("name").alias("domain_name"))
    out = relevant(pages, land, minimum).join(d, "domain_id").join(tag_names(tagged, tags), F.col("id") == F.col("expression_id"), "left")
    return out.select("id", "url", "title", "relevance", "depth", "domain_id", "domain_name", "tags", *(["readable"] if readable else []))


def with_domain(pages: DataFrame, domains: DataFrame) -> DataFrame:
    """Pages with the name of their domain; pages of an unknown domain are left out."""
    return pages.join(domains.select(F.col("id").alias("domain_id"), F.col("name").alias("domain_name")), "domain_id")


def media_of(media: DataFrame, pages: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """Media of the given pages, with columns of these."""
    return media.join(pages.select(F.col("id").alias("expression_id"), *columns), "expression_id")


def without_land(pages: DataFrame, land: int, most_relevance: int | None = None) -> DataFrame:
    """Pages that are left when a land is deleted, or only its fetched pages under a relevance."""
    gone = F.col("land_id") == land
    if most_relevance is not None:
        gone &= (F.col("relevance") < most_relevance) & F.col("fetched_at").isNotNull()
    return kept_after_delete(pages, gone)


def domain_report(pages: DataFrame, domains: DataFrame, land: int | None = None, minimum: int = 1) -> DataFrame:
    """Relevant pages and their mean relevance by domain."""
    sums = relevant(pages, land, minimum).groupBy("domain_id").agg(F.count("*").alias("expressions"), F.round(F.avg("relevance"), 2).alias("average_relevance"))
    return sums.join(domains.select(F.col("id").alias("domain_id"), "name", "description"), "domain_id").select("domain_id", "name", "description", "expressions", "average_relevance")


def canonical(a: str, b: str) -> list:
    """The two columns in ascending order."""
    return [F.least(a, b).alias("source"), F.greatest(a, b).alias("target")]


METHODS = ("nli", "cosine", "cosine_lsh")


def pseudolink_rows(similarity: DataFrame, paragraphs: DataFrame, pages: DataFrame, land: int, minimum: int = 1) -> DataFrame:
    """Scored paragraph pairs with pages and domains of both sides. The source page must be relevant, the target only of the same land."""
    p = lambda side: paragraphs.select(F.col("id").alias(f"{side}_paragraph"), F.col("expression_id").alias(f"{side}_id"))
    e = lambda side, rows: rows.select(F.col("id").alias(f"{side}_id"), F.col("domain_id").alias(f"{side}_domain"))
    out = similarity.where(F.col("method").isin(*METHODS)).join(p("source"), "source_paragraph").join(p("target"), "target_paragraph")
    out = out.join(e("source", relevant(pages, land, minimum)), "source_id").join(e("target", pages.where(F.col("land_id") == land)), "target_id")
    return out.withColumn("confidence", F.coalesce("score_raw", "score"))


def pseudolinks(rows: DataFrame) -> DataFrame:
    """The listing of paragraph pairs, best first."""
    return rows.select("source_paragraph", "target_paragraph", "source_id", "target_id", "score", "confidence", "method").orderBy(F.desc("score"), "source_paragraph", "target_paragraph")


def pseudolink_sums(rows: DataFrame, level: str) -> DataFrame:
    """Pairs by page (level 'id') or domain (level 'domain'), whichever side came first: counts by class and mean scores. Pairs within one domain stay."""
    n = lambda s: F.sum(F.when(F.col("score") == s, 1).otherwise(0))
    sums = rows.groupBy(*canonical(f"source_{level}", f"target_{level}")).agg(
        F.count("*").alias("weight"), n(1).alias("entailments"), n(0).alias("neutrals"), n(-1).alias("contradictions"), (F.round(F.avg("score"), 6) + 0.0).alias("average_score"), (F.round(F.avg("confidence"), 6) + 0.0).alias("average_confidence")
    )
    return sums.orderBy(F.desc("weight"), "source", "target")


def land_statistics(pages: DataFrame, terms: DataFrame) -> DataFrame:
    """Per land: distinct terms (sorted), pages and pages still to fetch; both sides aggregated before the join."""
    words = terms.groupBy("land_id").agg(F.array_join(F.sort_array(F.collect_set("term")), ",").alias("terms"), F.countDistinct("term").alias("n_terms"))
    counts = pages.groupBy("land_id").agg(F.countDistinct("id").alias("n_pages"), F.count_if(F.col("fetched_at").isNull()).alias("n_remaining"))
    return words.join(counts, "land_id", "full_outer").select("land_id", "terms", F.coalesce("n_terms", F.lit(0)).alias("n_terms"), F.coalesce("n_pages", F.lit(0)).alias("n_pages"), F.coalesce("n_remaining", F.lit(0)).alias("n_remaining"))


def status_histogram(pages: DataFrame) -> DataFrame:
    """Pages by status; the unknown status counts 0, as a count of the column does."""
    return pages.groupBy("land_id", "http_status").agg(F.count("http_status").alias("n"))


def run_statistics(pages: DataFrame) -> DataFrame:
    """Totals of a pipeline run, with the success rate in per cent."""
    done = F.count_if(F.col("readable_at").isNotNull())
    return pages.agg(F.count("*").alias("total"), F.count_if(F.col("fetched_at").isNotNull()).alias("fetched"), done.alias("readable"), F.round(100 * done / F.greatest(F.count("*"), F.lit(1)), 2).alias("success_rate"))


def json_map(payload: str):
    """A JSON object as a map of text; empty if it is none."""
    return F.coalesce(F.from_json(payload, "map<string,string>"), F.create_map().cast("map<string,string>"))


def json_keys(df: DataFrame, payload: str) -> list[str]:
    """Sorted union of the keys over all rows: the columns that the report will have."""
    keys = df.select(F.explode(F.map_keys(json_map(payload))).alias("k")).distinct().orderBy("k").collect()  # as many as columns
    return [r["k"] for r in keys]


def with_json_columns(df: DataFrame, payload: str, default: str = "na") -> DataFrame:
    """``df`` with one column for each key of the payloads."""
    m = json_map(payload)
    return df.select("*", *[F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(default)).alias(k) for k in json_keys(df, payload)])
