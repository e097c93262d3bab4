"""Link graphs, tag trees and frontier expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions import urls
from webloom.operators.persist import checkpointed
from webloom.operators.worklists import relevant


def page_edges(links: DataFrame, kept: DataFrame) -> DataFrame:
    """Links between two kept pages of different domains."""
    side = lambda s: kept.select(F.col("id").alias(f"{s}_id"), F.col("domain_id").alias(f"{s}_domain_id"))
    out = links.join(side("source"), "source_id").join(side("target"), "target_id")
    return out.where("source_domain_id <> target_domain_id").select("source_id", "source_domain_id", "target_id", "target_domain_id")


def linked_pages(links: DataFrame, pages: DataFrame, columns: tuple[str, ...] = ("title",)) -> DataFrame:
    """Links with columns of the pages at both ends."""
    side = lambda x: pages.select(F.col("id").alias(f"{x}_id"), *[F.col(c).alias(f"{x}_{c}") for c in columns])
    return links.join(side("source"), "source_id").join(side("target"), "target_id")


def semi_linked(links: DataFrame, kept: DataFrame) -> DataFrame:
    """Links of which both ends are kept."""
    ids = kept.select(F.col("id"))
    return links.join(ids, links.source_id == ids.id, "left_semi").join(ids, F.col("target_id") == ids.id, "left_semi")


def domain_edges(links: DataFrame, pages: DataFrame, land: int, minimum: int = 1) -> DataFrame:
    """Numbers of links between domains over relevant pages of a land."""
    e = page_edges(links, relevant(pages, land, minimum))
    return e.groupBy("source_domain_id", "target_domain_id").agg(F.count("*").alias("weight"))


def tag_paths(tags: DataFrame, most_levels: int = 100) -> DataFrame:
    """(id, path): names from the root down, joined by '_'. One join a level, until a level has no tags."""
    rows = tags.select("id", "parent_id", "name")
    level = rows.where("parent_id IS NULL").select("id", F.col("name").alias("path"))
    out = level
    for _ in range(most_levels):
        child = rows.join(level.select(F.col("id").alias("parent_id"), F.col("path").alias("above")), "parent_id").select("id", F.concat_ws("_", "above", "name").alias("path"))
        if child.isEmpty():
            return out
        out, level = out.unionByName(child), child
    raise ValueError(f"the tag tree has a cycle or over {most_levels} levels")


def tag_paths_recursive(spark, tags: DataFrame) -> DataFrame:
    """The same by a recursive common table expression, in one query (at most 100 levels)."""
    return spark.sql(
        "WITH RECURSIVE t(id, path) AS (SELECT id, CAST(name AS STRING) FROM {tags} WHERE parent_id IS NULL UNION ALL SELECT c.id, concat_ws('_', t.path, c.name) FROM {tags} c JOIN t ON c.parent_id = t.id) SELECT id, path FROM t",
        tags=tags,
    )


def tag_counts(tagged: DataFrame, paths: DataFrame) -> DataFrame:
    """Contents by page and tag path."""
    return tagged.join(paths.select(F.col("id").alias("tag_id"), "path"), "tag_id").groupBy("expression_id", "path").agg(F.count("*").alias("n"))


def ordered_tag_counts(tagged: DataFrame, paths: DataFrame, tags: DataFrame) -> DataFrame:
    """The counts by page and path, by page and the tags' order (root tags first)."""
    order = tags.select(F.col("id").alias("tag_id"), "parent_id", "sorting").join(paths.select(F.col("id").alias("tag_id"), "path"), "tag_id")
    sums = tagged.join(order, "tag_id").groupBy("expression_id", "path").agg(F.count("*").alias("n"), F.min("parent_id").alias("parent_id"), F.min("sorting").alias("sorting"))
    return sums.orderBy("expression_id", F.asc_nulls_first("parent_id"), "sorting", "path")


def tag_matrix(counts: DataFrame, paths: DataFrame) -> DataFrame:
    """Pages by tag paths, 0 where there is no content; one column for each path in use, sorted."""
    names = [r["path"] for r in paths.select("path").distinct().orderBy("path").collect()]  # as many as columns
    return counts.groupBy("expression_id").pivot("path", names).agg(F.sum("n")).na.fill(0)


def tag_contents(tagged: DataFrame, paths: DataFrame, tags: DataFrame, kept: DataFrame) -> DataFrame:
    """Tagged contents of kept pages with the tag's path, by tag order (root tags first)."""
    t = tags.select(F.col("id").alias("tag_id"), "parent_id", "sorting").join(paths.select(F.col("id").alias("tag_id"), "path"), "tag_id")
    pages = kept.select(F.col("id").alias("expression_id"), "url")
    out = tagged.join(t, "tag_id").join(pages, "expression_id")
    return out.select("path", "text", F.expr("substring(text, from_char + 1, to_char - from_char)").alias("slice"), "expression_id", "url", "parent_id", "sorting").orderBy(F.asc_nulls_first("parent_id"), "sorting", "expression_id", "text")


def discovered(found: DataFrame, known: DataFrame, most_depth: int | None = 3) -> tuple[DataFrame, DataFrame]:
    """New pages and edges of found links. ``found``: source_id, land_id, depth, url; ``known``: land_id, url.

    Anchors go, URLs that are not crawlable go, only pages above ``most_depth`` (none if None) link on; a new page's depth is one more than the least of its sources.
    """
    f = found if most_depth is None else found.where(F.coalesce("depth", F.lit(0)) < most_depth)
    f = f.withColumn("url", urls.without_anchor(F.col("url"))).where(urls.is_crawlable(F.col("url")))
    edges = f.select("source_id", "land_id", "url").distinct()
    depth = (F.min(F.coalesce("depth", F.lit(0))) + 1).alias("depth")
    new = f.groupBy("land_id", "url").agg(depth).join(known.select("land_id", "url"), ["land_id", "url"], "left_anti")
    return new.withColumn("domain", urls.domain_name(F.col("url"))), edges


def frontier(seeds: DataFrame, links: DataFrame, most_depth: int = 3) -> DataFrame:
    """(id, depth): the pages within ``most_depth`` links of the seeds, each at its least depth. Levels are checkpointed, so the plan stays short."""
    reached = seeds.select("id").distinct().withColumn("depth", F.lit(0))
    level = reached
    for depth in range(1, most_depth + 1):
        step = links.join(level.select(F.col("id").alias("source_id")), "source_id").select(F.col("target_id").alias("id")).distinct()
        level = checkpointed(step.join(reached.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)))
        reached = reached.unionByName(level)
    return reached
