"""Sinks: CSV, GEXF graphs, ZIP corpora, raw pages, and their file names."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime
from pathlib import Path
from xml.sax.saxutils import quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions import text
from webloom.operators.paragraphs import batches

#: Namespaces of the graph format.
GEXF = "http://www.gexf.net/1.2draft"
VIZ = "http://www.gexf.net/1.1draft/viz"


def csv(df: DataFrame, path: str, single: bool = False) -> None:
    """All fields quoted, with a header."""
    (df.coalesce(1) if single else df).write.csv(path, header=True, quoteAll=True, escape='"', emptyValue="")


def gexf_nodes(nodes: DataFrame, label: str, size: str, attributes: list[str]) -> DataFrame:
    """(id, label, size, values): texts of nodes, unknown attributes as 'na'."""
    values = F.array(*[F.coalesce(F.col(a).cast("string"), F.lit("na")) for a in attributes]) if attributes else F.array().cast("array<string>")
    return nodes.select(F.col("id").cast("string").alias("id"), F.coalesce(F.col(label).cast("string"), F.lit("na")).alias("label"), F.col(size).cast("string").alias("size"), values.alias("values"))


def gexf_edges(edges: DataFrame, source: str, target: str, weight: str) -> DataFrame:
    """(id, source, target, weight) as texts; the id is source_target."""
    a, b = F.col(source).cast("string"), F.col(target).cast("string")
    return edges.select(F.concat_ws("_", a, b).alias("id"), a.alias("source"), b.alias("target"), F.col(weight).cast("string").alias("weight"))


def gexf(path: str, nodes: DataFrame, edges: DataFrame, attributes: list[tuple[str, str]], as_of: datetime) -> None:
    """One directed graph file, streamed row by row to the driver's file system. nodes and edges as made above; attributes: (name, type)."""
    q = quoteattr
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns={q(GEXF)} xmlns:viz={q(VIZ)} version="1.2">\n<meta lastmodifieddate="{as_of:%Y-%m-%d}" creator="webloom"/>\n')
        f.write('<graph mode="static" defaultedgetype="directed">\n<attributes class="node">\n')
        f.writelines(f'<attribute id="{i}" title={q(n)} type={q(t)}/>\n' for i, (n, t) in enumerate(attributes))
        f.write("</attributes>\n<nodes>\n")
        for r in nodes.toLocalIterator():
            values = "".join(f'<attvalue for="{i}" value={q(v)}/>' for i, v in enumerate(r["values"]))
            f.write(f"<node id={q(r['id'])} label={q(r['label'])}><viz:size value={q(r['size'])}/><attvalues>{values}</attvalues></node>\n")
        f.write("</nodes>\n<edges>\n")
        f.writelines(f"<edge id={q(r['id'])} source={q(r['source'])} target={q(r['target'])} weight={q(r['weight'])}/>\n" for r in edges.toLocalIterator())
        f.write("</edges>\n</graph>\n</gexf>\n")


def corpus_entries(pages: DataFrame, base: str, size: int = 1000, legacy: bool = False) -> DataFrame:
    """Pages with the archive that each goes to and its entry's name."""
    name = (text.legacy_slug if legacy else text.slug)(F.col("title"))
    out = batches(pages, "id", size)
    archive = F.concat(F.lit(f"{base}_"), F.lpad(F.col("batch_no").cast("string"), 5, "0"), F.lit(".zip"))
    return out.withColumn("archive", archive).withColumn("entry", F.concat(F.col("id").cast("string"), F.lit("-"), name, F.lit(".txt")))


def corpus(pages: DataFrame, base: str, size: int = 1000, legacy: bool = False) -> DataFrame:
    """(archive, content, n): each batch as the bytes of a ZIP archive of texts with a Dublin Core header. Archives are made by the executors; ``save_binary`` or a binary sink stores them."""
    header = text.dublin_core(title=F.col("title"), description=F.col("description"), identifier=F.col("id"), publisher=F.col("domain"), source=F.col("url"))
    rows = corpus_entries(pages, base, size, legacy).withColumn("data", F.concat(header, F.coalesce("readable", F.lit("")))).select("archive", "id", "entry", "data")

    def zipped(t: pa.Table) -> pa.Table:
        order = t.sort_by("id")
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            for entry, data in zip(order.column("entry").to_pylist(), order.column("data").to_pylist(), strict=True):
                z.writestr(zipfile.ZipInfo(entry), data)
        return pa.table({"archive": t.column("archive").slice(0, 1), "content": pa.array([buffer.getvalue()], pa.binary()), "n": pa.array([t.num_rows], pa.int64())})

    return rows.groupBy("archive").applyInArrow(zipped, "archive string, content binary, n long")


def save_binary(files: DataFrame, folder: str) -> int:
    """Write (archive, content) rows as files of a folder that all executors share; the tasks write, and a repeated task writes the same file again. The number of files."""
    Path(folder).mkdir(parents=True, exist_ok=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = Path(folder) / f".{name}.{uuid.uuid4().hex}"
                part.write_bytes(content)
                part.replace(Path(folder) / name)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    return files.select("archive", "content").mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def raw_pages(pages: DataFrame, path: str) -> None:
    """The stored markup by land."""
    pages.select("land_id", "id", "html").write.partitionBy("land_id").parquet(path)


def file_name(kind: str, name: str, export: str, at: datetime) -> str:
    """Name of an export file: what is exported, its name, the export type and the time."""
    return f"export_{kind}_{name}_{export}_{at:%Y%m%d%H%M%S}"


def extension(export: str) -> str:
    """By the export's ending; pseudolinks have none."""
    if export.startswith("pseudolinks"):
        return ""
    return next((f".{e}" for e in ("csv", "gexf") if export.endswith(e)), ".zip" if export.endswith("corpus") else "")


SINKS: dict[str, Callable] = {"csv": csv, "gexf": gexf, "corpus": corpus}


def append_new(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose key is not in the Parquet table at ``path``, which is made if it is not there."""
    spark = rows.sparkSession
    try:
        known = spark.read.parquet(path).select(*keys)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = None
    new = rows.dropDuplicates(keys)
    (new if known is None else new.join(known, keys, "left_anti")).write.mode("append").parquet(path)
