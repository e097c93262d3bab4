"""The corpus tables over the driver's tables, as frames and as the same SQL.

The projections are written once in SQL that both engines read, so an oracle's input is
the query's input. Suppliers stand for pages, nations for domains, events for a fetch
log, regions and nations for a tag tree, customers for tagged content.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Adapter(NamedTuple):
    table: str
    columns: dict[str, str]

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, self.table).selectExpr(*[f"{e} AS {n}" for n, e in self.columns.items()])

    @property
    def sql(self) -> str:
        return f"(SELECT {', '.join(f'{e} AS {n}' for n, e in self.columns.items())} FROM {self.table})"


PAGE = Adapter(
    "supplier",
    {
        "id": "s_suppkey", "land_id": "CAST(1 + s_suppkey % 2 AS INT)", "domain_id": "s_nationkey", "title": "s_name", "depth": "CAST(s_suppkey % 4 AS INT)",
        "url": "'https://n' || s_nationkey || '.example/' || s_suppkey", "relevance": "CAST(floor(s_acctbal / 1000) AS INT)",
    },
)
DOMAIN = Adapter("nation", {"id": "n_nationkey", "name": "n_name", "description": "CASE WHEN n_nationkey % 5 = 0 THEN ' Unknown ' WHEN n_nationkey % 7 = 0 THEN NULL ELSE ' about ' || n_name END"})
TAGGED = Adapter("customer", {"tag_id": "c_nationkey", "expression_id": "c_custkey", "text": "c_mktsegment", "from_char": "CAST(c_custkey % 4 AS INT)", "to_char": "CAST(c_custkey % 4 + 3 AS INT)"})
FETCH = Adapter(
    "events",
    {
        "id": "event_id", "user_id": "user_id", "land_id": "CAST(1 + event_id % 3 AS INT)", "depth": "CAST(event_id % 4 AS INT)",
        "http_status": "CASE event_type WHEN 'error' THEN '404' WHEN 'signup' THEN 'ERR' WHEN 'view' THEN NULL ELSE '200' END",
        "fetched_at": "CASE WHEN event_type <> 'view' THEN ts END", "readable_at": "CASE WHEN event_type = 'purchase' THEN ts END", "approved_at": "CASE WHEN value > 50 THEN ts END",
        "relevance": "CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(floor(value / 10) AS INT) END", "seorank": "CASE WHEN event_type = 'click' THEN props END",
        "validllm": "CASE event_type WHEN 'signup' THEN 'oui' WHEN 'error' THEN 'non' END", "readable": "CASE WHEN event_id % 5 <> 0 THEN props || event_type END",
    },
)
DOCUMENT = Adapter("documents", {"id": "doc_id", "domain": "source", "lang": "lang", "readable": "text", "url": "'https://' || source || '.example/' || doc_id"})
PAGE_HTML = Adapter("pages", {"id": "page_id", "url": "url", "html": "html"})

#: Distinct pairs of suppliers that follow one another in an order.
LINK_SQL = """(SELECT DISTINCT source_id, target_id FROM (
  SELECT l_suppkey AS source_id, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS target_id FROM lineitem) WHERE target_id IS NOT NULL AND target_id <> source_id)"""
#: The links as scored paragraph pairs; a page has one paragraph, of the same id.
SIMILARITY_COLUMNS = {
    "source_paragraph": "source_id", "target_paragraph": "target_id", "score": "CAST((source_id * 7 + target_id * 3) % 3 - 1 AS DOUBLE)",
    "score_raw": "CASE WHEN (source_id + target_id) % 4 = 0 THEN NULL ELSE CAST((source_id * 13 + target_id) % 100 AS DOUBLE) / 100 END",
    "method": "CASE (source_id + target_id) % 5 WHEN 0 THEN 'other' WHEN 1 THEN 'cosine' ELSE 'nli' END",
}
SIMILARITY_SQL = f"(SELECT {', '.join(f'{e} AS {n}' for n, e in SIMILARITY_COLUMNS.items())} FROM {LINK_SQL})"
#: Root tags are regions (ids from 1000), child tags nations.
TAG_SQL = "(SELECT CAST(1000 + r_regionkey AS INT) AS id, CAST(NULL AS INT) AS parent_id, r_name AS name, CAST(r_regionkey AS INT) AS sorting FROM region UNION ALL SELECT n_nationkey, CAST(1000 + n_regionkey AS INT), n_name, CAST(n_nationkey AS INT) FROM nation)"


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.lead("l_suppkey").over(w).alias("target_id"))
    return pairs.where("target_id IS NOT NULL AND target_id <> source_id").distinct()


def similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(spark, sf_dir).selectExpr(*[f"{e} AS {n}" for n, e in SIMILARITY_COLUMNS.items()])


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = table(spark, sf_dir, "region").selectExpr("CAST(1000 + r_regionkey AS INT) AS id", "CAST(NULL AS INT) AS parent_id", "r_name AS name", "CAST(r_regionkey AS INT) AS sorting")
    return roots.unionByName(table(spark, sf_dir, "nation").selectExpr("n_nationkey AS id", "CAST(1000 + n_regionkey AS INT) AS parent_id", "n_name AS name", "CAST(n_nationkey AS INT) AS sorting"))


def values(spark: SparkSession, names: str, rows: list[tuple]) -> DataFrame:
    """A small literal table; ``names`` is a DDL schema."""
    return spark.createDataFrame(rows, names)


def values_sql(names: str, rows: list[tuple]) -> str:
    """The same table as SQL."""

    def lit(v) -> str:
        return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + str(v).replace("'", "''") + "'"

    columns = [c.split()[0] for c in names.split(", ")]
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS v({', '.join(columns)}))"
