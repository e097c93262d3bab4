"""Record merge, update planning, ingestion of search results, consolidation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("title", "description", "published_at", "readable")
STRATEGIES = ("smart_merge", "extractor_priority", "preserve_existing")


def _empty(c: Column, kind: str) -> Column:
    return c.isNull() | (F.trim(c) == "") if kind == "string" else c.isNull()


def merged(current: Column, new: Column, field: str, kind: str, strategy: str = "smart_merge") -> Column:
    """One field of two records. An empty side gives way; then by strategy. Smart: the earlier time, the longer title and description (ties: current), else the new value."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    if strategy == "preserve_existing":
        both = current
    elif strategy == "extractor_priority":
        both = new
    elif field == "published_at":
        both = F.least(current, new)
    elif field in ("title", "description"):
        both = F.when(F.length(new) > F.length(current), new).otherwise(current)
    else:
        both = new
    return F.when(_empty(new, kind), current).when(_empty(current, kind), new).otherwise(both)


def merge_records(current: DataFrame, new: DataFrame, key: str = "id", fields: tuple[str, ...] = FIELDS, strategy: str = "smart_merge") -> DataFrame:
    """Current records with the new ones merged in; records without a new one stay."""
    n = new.select(F.col(key), *[F.col(f).alias(f"new_{f}") for f in fields])
    kinds = dict(current.dtypes)
    out = current.join(n, key, "left")
    return out.select(*[merged(F.col(c), F.col(f"new_{c}"), c, kinds[c], strategy).alias(c) if c in fields else F.col(c) for c in current.columns])


def changes(old: DataFrame, new: DataFrame, key: str = "id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(key, field, old, new) of every field that differs, as text; records on one side only differ from nulls."""
    a = old.select(F.col(key), *[F.col(f).alias(f"old_{f}") for f in fields])
    b = new.select(F.col(key), *[F.col(f).alias(f"new_{f}") for f in fields])
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"old_{f}").cast("string").alias("old"), F.col(f"new_{f}").cast("string").alias("new")) for f in fields])
    return a.join(b, key, "full_outer").select(key, F.explode(rows).alias("x")).select(key, "x.*").where(~F.col("old").eqNullSafe(F.col("new")))


def applied(pages: DataFrame, updates: DataFrame, as_of: Column) -> DataFrame:
    """Pages with planned values set, readable_at stamped for each page treated, even where extraction failed."""
    u = updates.select("id", *[F.col(f).alias(f"new_{f}") for f in FIELDS if f in updates.columns], F.lit(True).alias("treated"))
    out = pages.join(u, "id", "left")
    new = lambda c: F.coalesce(F.col(f"new_{c}"), F.col(c)) if f"new_{c}" in out.columns else F.col(c)
    return out.select(*[F.when(F.col("treated"), as_of).otherwise(F.col(c)).alias(c) if c == "readable_at" else new(c).alias(c) for c in pages.columns])


def ingest(known: DataFrame, results: DataFrame) -> DataFrame:
    """Search results into known pages (land_id, url, title, published_at), with what was done: new, updated or skipped.

    Results of one URL (without anchor) count once: the first title by position, the earliest date. A known page gets a title only if it has none, and the earlier date.
    """
    r = results.where("url IS NOT NULL AND url <> ''").groupBy("land_id", "url").agg(F.min_by("title", "position").alias("r_title"), F.min("published_at").alias("r_date"))
    k = known.select("land_id", "url", "title", "published_at", F.lit(True).alias("known"))
    out = k.join(r, ["land_id", "url"], "full_outer")
    title = F.when(F.coalesce(F.trim("title"), F.lit("")) == "", F.coalesce("r_title", "title")).otherwise(F.col("title"))
    date = F.least("published_at", "r_date")
    same = title.eqNullSafe(F.col("title")) & date.eqNullSafe(F.col("published_at"))
    done = F.when(F.col("known").isNull(), "new").when(same, "skipped").otherwise("updated")
    return out.select("land_id", "url", title.alias("title"), date.alias("published_at"), done.alias("action"))


def upserted(known: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Known rows and the wanted ones whose key is new, each once."""
    new = wanted.join(known.select(*keys), keys, "left_anti").dropDuplicates(keys)
    return known.unionByName(new, allowMissingColumns=True)


def first_snapshot(snapshots: DataFrame, key: str, value: str, at: str, preferred: Column) -> DataFrame:
    """(key, value): each key's earliest snapshot among the preferred ones, else among all."""
    best = F.min_by(F.when(preferred, F.col(value)), F.when(preferred, F.col(at)))
    return snapshots.groupBy(key).agg(F.coalesce(best, F.min_by(value, at)).alias(value))


def first_of(sources: Mapping[str, Column], least_chars: int = 0) -> list[Column]:
    """(value, source) of the first source that has a text of more than ``least_chars``."""
    ok = lambda c: F.length(c) > least_chars
    value = F.coalesce(*[F.when(ok(c), c) for c in sources.values()])
    name = F.coalesce(*[F.when(ok(c), F.lit(n)) for n, c in sources.items()])
    return [value.alias("value"), name.alias("source")]


def rederived_domains(pages: DataFrame, domain_of: Column) -> DataFrame:
    """(id, domain, new_domain) of pages whose domain would change."""
    return pages.withColumn("new_domain", domain_of).where(~F.col("domain").eqNullSafe(F.col("new_domain"))).select("id", "domain", "new_domain")
