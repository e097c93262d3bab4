"""A training corpus from the table ``documents``, in five stages.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of
``documents``; where a text changes, ``n_chars`` follows it.

1. quality: documents that the line-frequency rules reject go; lines above the limits
   are removed from those that stay, but for the one document that keeps each.
2. near duplicates: of each group of documents linked at 0.8 or more on 5-word shingles,
   the one with the least id stays.
3. decontamination: documents that contain a benchmark item go.
4. secrets: found secrets are replaced by a mark; all documents stay.
5. packing: the documents as pieces placed in sequences of 4096 tokens.

Decisions are joined back by id, and a null id counts as one like any other. If one id
has several rows, all go if one does, and the near-duplicate stage keeps one of them.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import contain, jaccard, packing, quality, secrets
from webloom.llm.common import broadcast_if_small, checkpointed, table
from webloom.llm.queries import tokenizer_path

_ID = "__pipeline_id"


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` whose doc_id is not among ``ids`` (one column). The ids are broadcast only if they are few."""
    gone = checkpointed(ids.toDF(_ID).distinct())
    return docs.join(broadcast_if_small(gone), F.col("doc_id").eqNullSafe(F.col(_ID)), "left_anti")


def _with_text(docs: DataFrame, text) -> DataFrame:
    """``docs`` with another text, and n_chars as long as it where there is one."""
    out = docs.withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    verdict = checkpointed(quality.line_quality(docs).select("doc_id", "kept", "bad_lines"))
    kept = _without(docs, verdict.where(~F.col("kept")).select("doc_id"))
    lines = F.array_distinct(F.flatten(F.collect_list("bad_lines")))
    bad = checkpointed(verdict.where("kept AND bad_lines IS NOT NULL").groupBy(F.col("doc_id").alias(_ID)).agg(lines.alias("__pipeline_lines")))
    joined = kept.join(broadcast_if_small(bad), F.col("doc_id").eqNullSafe(F.col(_ID)), "left")
    return _with_text(joined, quality.without_lines(F.col("text"), F.col("__pipeline_lines"))).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    linked = checkpointed(jaccard.linked_documents(docs, k=5, percent=80).select("doc_id", "component_id"))
    kept = _without(docs, linked.where("doc_id <> component_id").select("doc_id"))
    again = checkpointed(linked.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(_ID)).agg(F.count("*").alias("n")).where("n > 1").select(_ID))
    if again.isEmpty():
        return kept
    on = F.col("doc_id") == F.col(_ID)
    several = kept.join(broadcast_if_small(again), on, "left_semi")
    return _without(kept, again).unionByName(several.dropDuplicates(["doc_id"]))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, contain.contained_items(docs, table(spark, sf_dir, "benchmark")).select("doc_id"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_text(secrets.redact(docs), F.col("text"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: Token ids and the set-similarity join have no SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus. Stages are written to the shared folder of ``spark.checkpoint.dir``; to a temporary one only where none is set (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="corpus-pipeline-")
    folder = f"{shared.rstrip('/')}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
