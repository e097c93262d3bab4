"""Paragraphs, their deduplication and embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import text, vectors
from webloom.operators.persist import checkpointed


def split_pages(pages: DataFrame, least: int = 150, most: int = 6000) -> DataFrame:
    """(expression_id, domain, para_index from 1, text, text_hash) of every paragraph."""
    rows = pages.select(F.col("id").alias("expression_id"), "domain", F.posexplode(text.paragraphs(F.col("readable"), least, most)).alias("i", "text"))
    return rows.select("expression_id", "domain", (F.col("i") + 1).alias("para_index"), "text", F.sha2("text", 256).alias("text_hash"))


def first_by_hash(paragraphs: DataFrame) -> DataFrame:
    """One row per text hash, the first by page and place. An aggregate with partial sums, so a text that is everywhere costs no single task."""
    rest = [c for c in paragraphs.columns if c not in ("text_hash", "expression_id", "para_index")]
    first = F.min(F.struct("expression_id", "para_index", *rest)).alias("x")
    return paragraphs.groupBy("text_hash").agg(first).select("text_hash", "x.*").select(*paragraphs.columns)


def without_embedding(paragraphs: DataFrame, embedded: DataFrame) -> DataFrame:
    return paragraphs.join(embedded.select("text_hash"), "text_hash", "left_anti")


PROVIDERS: dict[str, object] = {"fake": vectors.offline_embedding}


def embed(paragraphs: DataFrame, provider: str = "fake") -> DataFrame:
    """Paragraphs with embedding, norm and model name. An unknown provider is the offline one; others are registered in PROVIDERS as pandas UDFs."""
    name = provider if provider in PROVIDERS else "fake"
    out = paragraphs.withColumn("embedding", PROVIDERS[name](F.col("text")))
    return out.withColumn("norm", vectors.norm(F.col("embedding"))).withColumn("model_name", F.lit(name))


def reset_embeddings(embedded: DataFrame, similarity: DataFrame, land_paragraphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left of embeddings and similarity rows without a land's paragraphs (column id)."""
    ids = land_paragraphs.select("id")
    left = similarity.join(ids, similarity.source_paragraph == ids.id, "left_anti").join(ids, F.col("target_paragraph") == ids.id, "left_anti")
    return embedded.join(ids, "id", "left_anti"), left


def batches(rows: DataFrame, order: str, size: int) -> DataFrame:
    """Rows with batch_no from 1, by ``order``. Ranks come from sorted ranges and their sizes, not from one window over all rows."""
    # Checkpointed: ranks and sizes must see one and the same dealing.
    ranged = checkpointed(rows.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("part", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(order))
    ranged = ranged.withColumn("inside", inside)
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.col("before") + F.col("inside")
    return ranged.join(F.broadcast(before), "part").withColumn("batch_no", F.floor((rank - 1) / size).cast("bigint") + 1).drop("part", "inside", "before")


def truncated(c: Column, most: int) -> Column:
    return F.substring(c, 1, most)
