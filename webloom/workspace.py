"""A corpus in a folder: tables as Parquet snapshots, and the commands that change them.

Every command reads the current snapshots, computes new ones as DataFrames and writes
them under a new version; a pointer file is switched last, so a command that fails
leaves the corpus as it was. A command that only adds rows writes these as one more part
of the snapshot. Times are parameters (``as_of``), never the clock.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom import schema
from webloom.functions import dates, html, text, urls
from webloom.operators import graph, merge, paragraphs, relevance, reports, similarity, worklists
from webloom.sources import fetch as fetching
from webloom.sources import sinks

EXPORTS = ("pagecsv", "fullpagecsv", "nodecsv", "pagegexf", "nodegexf", "mediacsv", "corpus", "pseudolinks", "pseudolinkspage", "pseudolinksdomain")


#: Parts of a snapshot at most.
MOST_PARTS = 50


class Workspace:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, Path(root)

    # --- Snapshots ---------------------------------------------------------------------------------------------------

    def _pointers(self) -> dict[str, list[int]]:
        """The versions that make up each table's snapshot."""
        p = self.root / "tables.json"
        return json.loads(p.read_text()) if p.exists() else {}

    def _paths(self, name: str, versions: list[int]) -> list[str]:
        return [str(self.root / name / str(v)) for v in versions]

    def table(self, name: str) -> DataFrame:
        versions = self._pointers().get(name)
        if versions is None:
            return self.spark.createDataFrame([], schema.TABLES[name])
        return self.spark.read.schema(schema.TABLES[name]).parquet(*self._paths(name, versions))

    def write(self, **tables: DataFrame) -> None:
        """New snapshots of several tables, switched to at once."""
        self._store(tables, keep=False)

    def append(self, **tables: DataFrame) -> None:
        """New rows of several tables, as one more part of each; a snapshot of ``MOST_PARTS`` parts is written anew."""
        many = {n for n in tables if len(self._pointers().get(n, [])) >= MOST_PARTS}
        self._store({n: self.table(n).unionByName(self._rows(n, df)) if n in many else df for n, df in tables.items()}, keep=True, anew=many)

    @staticmethod
    def _rows(name: str, df: DataFrame) -> DataFrame:
        """The columns of the schema; those that are not there are null."""
        have = set(df.columns)
        return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.TABLES[name]])

    def _store(self, tables: dict[str, DataFrame], keep: bool, anew: set[str] = frozenset()) -> None:
        now = self._pointers()
        for name, df in tables.items():
            old = now.get(name, [])
            version = max(old, default=0) + 1
            self._rows(name, df).write.mode("overwrite").parquet(str(self.root / name / str(version)))
            now[name] = [*old, version] if keep and name not in anew else [version]
        self.root.mkdir(parents=True, exist_ok=True)
        new = self.root / "tables.json.new"
        new.write_text(json.dumps(now))
        new.replace(self.root / "tables.json")

    def _next_id(self, name: str) -> int:
        return (self.table(name).agg(F.max("id")).first()[0] or 0) + 1

    def _numbered(self, rows: DataFrame, name: str, key: str) -> DataFrame:
        """New rows with ids after the last one, in the order of a natural key."""
        start = self._next_id(name)
        ranked = paragraphs.batches(rows.drop("id"), key, 1)
        return ranked.withColumn("id", F.col("batch_no") + (start - 1)).drop("batch_no")

    # --- Database ----------------------------------------------------------------------------------------------------

    def db_setup(self) -> int:
        self.write(**{n: self.spark.createDataFrame([], s) for n, s in schema.TABLES.items()})
        return 1

    def db_migrate(self) -> int:
        """Rewrite tables whose stored columns are not those of the schema."""
        done = 0
        for name, versions in self._pointers().items():
            parts = [self.spark.read.parquet(p) for p in self._paths(name, versions)]
            if any(p.columns != schema.TABLES[name].names for p in parts):
                self.write(**{name: reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)})
                done += 1
        return done

    def fix_archive_domains(self, dryrun: bool = False, limit: int = 0) -> DataFrame:
        """File archived copies under their original domain; their SEO payload is reset. Returns (id, domain, new_domain)."""
        e = self.table("expression")
        due = worklists.limited(e.where(F.col("domain").isin(*urls.ARCHIVE_DOMAINS)).orderBy("id"), limit)
        plan = merge.rederived_domains(due, urls.domain_name(F.col("url"))).where("new_domain <> ''")
        if not dryrun:
            self.write(expression=self._with_domains(e, plan, reset_seo=True))
        return plan

    def heuristic_update(self) -> int:
        """Derive every page's domain again; the number of changes."""
        e = self.table("expression")
        plan = merge.rederived_domains(e, urls.domain_name(F.col("url")))
        n = plan.count()
        if n:
            self.write(expression=self._with_domains(e, plan))
        return n

    @staticmethod
    def _with_domains(e: DataFrame, plan: DataFrame, reset_seo: bool = False) -> DataFrame:
        out = e.join(plan.select("id", "new_domain"), "id", "left")
        if reset_seo:
            out = out.withColumn("seorank", F.when(F.col("new_domain").isNull(), F.col("seorank")))
        return out.withColumn("domain", F.coalesce("new_domain", "domain")).select(*e.columns)

    # --- Lands -------------------------------------------------------------------------------------------------------

    def land_id(self, name: str) -> int:
        row = self.table("land").where(F.col("name") == name).first()
        if row is None:
            raise ValueError(f"no land is named {name!r}")
        return row["id"]

    def land_create(self, name: str, description: str = "", lang: str = "fr", as_of: datetime | None = None) -> int:
        lands = self.table("land")
        if lands.where(F.col("name") == name).count():
            raise ValueError(f"a land named {name!r} is there already")
        n = self._next_id("land")
        self.append(land=self.spark.createDataFrame([(n, name, description, lang, as_of)], schema.TABLES["land"]))
        return n

    def land_list(self) -> DataFrame:
        lands = self.table("land").select(F.col("id").alias("land_id"), "name")
        return lands.join(reports.land_statistics(self.table("expression"), self.table("word")), "land_id", "left").orderBy("name")

    def land_delete(self, name: str, maxrel: int = 0) -> None:
        """The whole land; or with ``maxrel`` only its fetched pages below that relevance. What hangs on the pages goes too."""
        land = self.land_id(name)
        e = self.table("expression")
        of_land = F.col("land_id") == land
        gone = e.where(of_land & (F.col("relevance") < maxrel) & F.col("fetched_at").isNotNull()) if maxrel else e.where(of_land)
        ids = gone.select(F.col("id").alias("gone_id"))

        def anti(rows: DataFrame, *columns: str) -> DataFrame:
            for c in columns:
                rows = rows.join(ids, F.col(c) == F.col("gone_id"), "left_anti")
            return rows

        out = {"expression": anti(e, "id"), "expressionlink": anti(self.table("expressionlink"), "source_id", "target_id"), "media": anti(self.table("media"), "expression_id"), "paragraph": anti(self.table("paragraph"), "expression_id"), "taggedcontent": anti(self.table("taggedcontent"), "expression_id")}
        if not maxrel:
            out |= {n: self.table(n).where(F.col("land_id") != land) for n in ("word", "tag")} | {"land": self.table("land").where(F.col("id") != land)}
        self.write(**out)

    def land_addterm(self, name: str, terms: list[str]) -> int:
        """Add terms (known ones are left) and score the land's pages again."""
        land = self.land_id(name)
        wanted = self.spark.createDataFrame([(land, t.strip()) for t in terms if t.strip()], "land_id long, term string").distinct()
        new = relevance.dictionary(wanted).join(self.table("word").select("land_id", "term"), ["land_id", "term"], "left_anti")
        n = new.count()
        self.append(word=new)
        self._rescore(land)
        return n

    def _rescore(self, land: int) -> None:
        e = self.table("expression")
        due = e.where((F.col("land_id") == land) & F.col("readable").isNotNull())
        words = self.table("word").where(F.col("land_id") == land)
        lang = self.table("land").where(F.col("id") == land).first()["lang"]
        scored = relevance.gated(relevance.relevance(due, words), due, lang or "").withColumnRenamed("relevance", "new_relevance")
        self.write(expression=e.join(scored, "id", "left").withColumn("relevance", F.coalesce("new_relevance", "relevance").cast("int")).select(*e.columns))

    def _add_pages(self, rows: DataFrame, as_of: datetime | None) -> int:
        """Add crawlable pages (land_id, url, depth and more) that are not known; the number added."""
        e = self.table("expression")
        rows = rows.withColumn("url", urls.without_anchor(F.trim("url"))).where(urls.is_crawlable(F.col("url"))).dropDuplicates(["land_id", "url"])
        new = rows.join(e.select("land_id", "url"), ["land_id", "url"], "left_anti").withColumn("domain", urls.domain_name(F.col("url"))).withColumn("created_at", F.lit(as_of).cast("timestamp_ntz"))
        new = self._numbered(new, "expression", "url")
        n = new.count()
        if n:
            self.append(expression=new)
        return n

    def land_addurl(self, name: str, addresses: str | None = None, path: str | None = None, as_of: datetime | None = None) -> int:
        """Add pages from a comma list or a text file of one URL a line."""
        land = self.land_id(name)
        if path:
            rows = self.spark.read.text(path).select(F.col("value").alias("url"))
        else:
            rows = self.spark.createDataFrame([(addresses or "",)], "t string").select(F.explode(urls.split_list(F.col("t"))).alias("url"))
        return self._add_pages(rows.select(F.lit(land).cast("bigint").alias("land_id"), "url", F.lit(0).alias("depth")), as_of)

    def land_urlist(self, name: str, results: DataFrame, as_of: datetime) -> dict[str, int]:
        """Take in search results (position, title, link, date text); numbers by what was done."""
        land = self.land_id(name)
        r = results.select(F.lit(land).cast("bigint").alias("land_id"), urls.without_anchor(F.trim("link")).alias("url"), "title", "position", dates.result_date(F.col("date"), F.lit(as_of)).cast("timestamp_ntz").alias("published_at"))
        r = r.where(urls.is_crawlable(F.col("url")))
        e = self.table("expression")
        merged = merge.ingest(e.where(F.col("land_id") == land), r)
        counts = {x["action"]: x["n"] for x in merged.groupBy("action").agg(F.count("*").alias("n")).collect()}
        touched = merged.where("action = 'updated'").select("land_id", "url", F.col("title").alias("new_title"), F.col("published_at").alias("new_date"))
        new = merged.where("action = 'new'").select("land_id", "url", "title", "published_at", F.lit(0).alias("depth"))
        new_rows = self._numbered(new.withColumn("domain", urls.domain_name(F.col("url"))).withColumn("created_at", F.lit(as_of).cast("timestamp_ntz")), "expression", "url")
        kept = e.join(touched, ["land_id", "url"], "left").withColumn("title", F.coalesce("new_title", "title")).withColumn("published_at", F.coalesce("new_date", "published_at")).select(*e.columns)
        self.write(expression=kept.unionByName(new_rows, allowMissingColumns=True))
        return counts

    # --- Crawl and enrichment ----------------------------------------------------------------------------------------

    def land_crawl(self, name: str, fetch: fetching.Fetcher | DataFrame, as_of: datetime, limit: int = 0, http: str | None = None, depth: int | None = None) -> int:
        """Fetch pending pages (or those of a status), read and score them, and follow the links of relevant ones. ``fetch``: a function, or a table of stored markup."""
        land = self.land_id(name)
        e = self.table("expression")
        due = worklists.limited(worklists.pending(e.where(F.col("land_id") == land), http, depth).orderBy("id"), limit)
        got = fetching.stored(due, fetch) if isinstance(fetch, DataFrame) else fetching.fetched(due, fetch)
        page = got.select("id", "http_status", "html", html.page(F.col("html")).alias("p"))
        page = page.select("id", F.col("http_status").alias("n_status"), F.col("html").alias("n_html"), *[F.col(f"p.{c}").alias(f"n_{c}") for c in ("title", "description", "keywords", "lang", "readable")])
        out = e.join(page, "id", "left")
        now = F.lit(as_of).cast("timestamp_ntz")
        hit = F.col("n_status").isNotNull()
        out = out.withColumn("http_status", F.coalesce("n_status", "http_status")).withColumn("fetched_at", F.when(hit, now).otherwise(F.col("fetched_at"))).withColumn("html", F.coalesce("n_html", "html"))
        for c in ("description", "keywords", "lang", "readable"):
            out = out.withColumn(c, F.when(F.col("n_html").isNotNull(), F.col(f"n_{c}")).otherwise(F.col(c)))
        out = out.withColumn("title", F.when(F.col("n_html").isNotNull(), F.coalesce(F.nullif("n_title", F.lit("")), "title", "url")).otherwise(F.col("title")))
        n = due.count()
        self.write(expression=out.select(*e.columns))
        self._rescore(land)
        e = self.table("expression")
        treated = (F.col("land_id") == land) & (F.col("fetched_at") == now)
        self.write(expression=relevance.approved(e.where(treated), now).unionByName(e.where(~F.coalesce(treated, F.lit(False)))))
        self._relink(land, as_of, F.col("fetched_at") == now, most_depth=3)
        return n

    def _relink(self, land: int, as_of: datetime, which, most_depth: int | None) -> None:
        """Links and media of some relevant pages: new pages, edges, media."""
        e = self.table("expression").where((F.col("land_id") == land) & which & (F.col("relevance") > 0))
        parsed = e.select("id", "land_id", "depth", "url", "readable", html.page(F.col("html")).alias("p"))
        found = F.concat(F.coalesce("p.all_links", F.array().cast("array<string>")), F.coalesce(text.md_links(F.col("readable")), F.array().cast("array<string>")))
        rows = parsed.select(F.col("id").alias("source_id"), "land_id", "depth", F.explode(found).alias("href"), F.col("url").alias("base")).withColumn("url", urls.resolved(F.col("base"), F.col("href"), lower=False))
        new, edges = graph.discovered(rows, self.table("expression"), most_depth)
        self._add_pages(new.select("land_id", "url", "depth"), as_of)
        ids = self.table("expression").select(F.col("id").alias("target_id"), "land_id", "url")
        links = edges.join(ids, ["land_id", "url"]).select("source_id", "target_id").where("source_id <> target_id").unionByName(self.table("expressionlink")).distinct()
        items = parsed.select(F.col("id").alias("expression_id"), F.col("url").alias("base"), F.explode("p.media").alias("m"))
        items = items.where((F.col("m.type") != "img") | urls.has_media_ending(F.col("m.url"), "img")).select("expression_id", urls.resolved(F.col("base"), F.col("m.url")).alias("url"), F.col("m.type").alias("type"))
        media = merge.upserted(self.table("media"), items, ["expression_id", "url"])
        self.write(expressionlink=links, media=media)

    def land_readable(self, name: str, extracted: DataFrame, as_of: datetime, strategy: str = "smart_merge", limit: int = 0, depth: int | None = None) -> DataFrame:
        """Merge an extractor's records (id, title, description, published_at, readable) into fetched pages; every page treated is stamped. Returns run statistics."""
        land = self.land_id(name)
        e = self.table("expression")
        due = worklists.unread(e.where(F.col("land_id") == land), depth, limit).select("id")
        merged = merge.merge_records(e.join(due, "id", "left_semi"), extracted, strategy=strategy)
        self.write(expression=merge.applied(e, merged.select("id", *merge.FIELDS), F.lit(as_of).cast("timestamp_ntz")))
        self._rescore(land)
        self._relink(land, as_of, F.col("readable_at") == F.lit(as_of).cast("timestamp_ntz"), most_depth=None)
        return reports.run_statistics(self.table("expression").where(F.col("land_id") == land))

    def land_consolidate(self, name: str, as_of: datetime, limit: int = 0, depth: int | None = None, minrel: int = 0) -> int:
        """Rebuild scores, links and media of treated pages from what is stored."""
        land = self.land_id(name)
        due = worklists.consolidatable(self.table("expression").where(F.col("land_id") == land), depth, minrel, limit)
        ids = [r["id"] for r in due.select("id").collect()] if limit else None
        n = due.count()
        self._rescore(land)
        which = F.col("id").isin(ids) if ids is not None else F.col("approved_at").isNotNull() | F.col("readable_at").isNotNull()
        self._relink(land, as_of, which, most_depth=None)
        return n

    def domain_crawl(self, fetch: fetching.Fetcher, as_of: datetime, limit: int = 0, http: str | None = None) -> int:
        """Home pages of the domains in use: status and metadata."""
        known = self.table("domain")
        names = self.table("expression").select(F.col("domain").alias("name")).where("name <> ''").distinct()
        new = names.join(known.select("name"), "name", "left_anti")
        all_d = known.unionByName(self._numbered(new, "domain", "name"), allowMissingColumns=True)
        due = worklists.limited(all_d.where(F.col("fetched_at").isNull() if http is None else F.col("http_status") == http).orderBy("id"), limit)
        got = fetching.fetched(due.select("id", F.concat(F.lit("https://"), "name").alias("url")), fetch).select("id", F.col("http_status").alias("s"), html.page(F.col("html")).alias("p"))
        out = all_d.join(got, "id", "left")
        out = out.withColumn("title", F.when(F.col("s").isNotNull(), html.website_title(F.col("p.title"), F.col("name"))).otherwise(F.col("title")))
        out = out.withColumn("description", F.coalesce("p.description", "description")).withColumn("keywords", F.coalesce("p.keywords", "keywords"))
        out = out.withColumn("fetched_at", F.when(F.col("s").isNotNull(), F.lit(as_of).cast("timestamp_ntz")).otherwise(F.col("fetched_at"))).withColumn("http_status", F.coalesce("s", "http_status"))
        n = due.count()
        self.write(domain=out.select(*known.columns))
        return n

    def land_seorank(self, name: str, payloads: Callable[[DataFrame], DataFrame], limit: int = 0, depth: int | None = None, http: str | None = "200", minrel: int = 1, force: bool = False) -> int:
        """Store an SEO payload for each due page. ``payloads``: pages (id, url) -> (id, seorank)."""
        land = self.land_id(name)
        e = self.table("expression")
        due = worklists.seo_due(e.where(F.col("land_id") == land), http, minrel, depth, force, limit)
        got = payloads(due.select("id", urls.unwrapped(F.col("url")).alias("url"))).select("id", F.col("seorank").alias("s"))
        self.write(expression=e.join(got, "id", "left").withColumn("seorank", F.coalesce("s", "seorank")).select(*e.columns))
        return due.count()

    def land_llm_validate(self, name: str, answers: Callable[[DataFrame], DataFrame], least_chars: int = 140, limit: int = 0, force: bool = False, most_chars: int = 6000) -> int:
        """Ask for verdicts on pages. ``answers``: (id, prompt) -> (id, answer)."""
        land = self.land_id(name)
        row = self.table("land").where(F.col("id") == land).first()
        terms = [r["term"] for r in self.table("word").where(F.col("land_id") == land).orderBy("term").collect()]
        e = self.table("expression")
        due = worklists.unjudged(e.where(F.col("land_id") == land), least_chars, force, limit)
        t = F.array(*[F.lit(x) for x in terms]) if terms else F.array().cast("array<string>")
        prompts = due.select("id", text.prompt(F.lit(row["name"]), F.lit(row["description"]), t, F.col("url"), F.col("title"), F.col("description"), F.col("readable"), most_chars).alias("prompt"))
        self.write(expression=relevance.judged(e, answers(prompts)).select(*e.columns))
        return due.count()

    def land_medianalyse(self, name: str, analyse: Callable[[DataFrame], DataFrame], as_of: datetime, minrel: int = 0, depth: int | None = None) -> int:
        """Figures of a land's images. ``analyse``: media (expression_id, url) -> the same with figures, such as ``images.of_store`` makes from stored files."""
        land = self.land_id(name)
        pages = self.table("expression").where((F.col("land_id") == land) & (F.coalesce("relevance", F.lit(0)) >= minrel))
        pages = pages if depth is None else pages.where(F.col("depth") == depth)
        m = self.table("media")
        due = m.where("type = 'img' AND analyzed_at IS NULL").join(pages.select(F.col("id").alias("expression_id")), "expression_id", "left_semi")
        got = analyse(due.select("expression_id", "url"))
        new = [c for c in got.columns if c not in ("expression_id", "url")]
        out = m.join(got.select("expression_id", "url", *[F.col(c).alias(f"n_{c}") for c in new], F.lit(True).alias("hit")), ["expression_id", "url"], "left")
        for c in new:
            out = out.withColumn(c, F.coalesce(f"n_{c}", c))
        self.write(media=out.withColumn("analyzed_at", F.when(F.col("hit"), F.lit(as_of).cast("timestamp_ntz")).otherwise(F.col("analyzed_at"))).select(*m.columns))
        return due.count()

    # --- Embeddings --------------------------------------------------------------------------------------------------

    def embedding_generate(self, name: str, as_of: datetime, provider: str = "fake") -> dict[str, int]:
        land = self.land_id(name)
        pages = self.table("expression").where((F.col("land_id") == land) & F.col("readable").isNotNull())
        rows = paragraphs.first_by_hash(paragraphs.split_pages(pages))
        known = self.table("paragraph")
        new = self._numbered(rows.join(known.select("text_hash"), "text_hash", "left_anti").withColumn("created_at", F.lit(as_of).cast("timestamp_ntz")), "paragraph", "text_hash")
        self.append(paragraph=new)
        e = self.table("paragraph_embedding")
        made = paragraphs.embed(paragraphs.without_embedding(self.table("paragraph"), e), provider).withColumn("created_at", F.lit(as_of).cast("timestamp_ntz"))
        self.append(paragraph_embedding=made)
        return {"paragraphs": self.table("paragraph").count(), "embeddings": self.table("paragraph_embedding").count()}

    def embedding_similarity(self, name: str, as_of: datetime, threshold: float = 0.75, method: str = "cosine", topk: int = 0, lshbits: int = 16, minrel: int = 0, maxpairs: int = 0, predict: similarity.Predictor = similarity.neutral) -> int:
        """Replace a method's rows of the land. Methods: cosine, cosine_lsh, nli."""
        land = self.land_id(name)
        pages = self.table("expression").where((F.col("land_id") == land) & (F.coalesce("relevance", F.lit(0)) >= minrel)).select(F.col("id").alias("expression_id"))
        p = self.table("paragraph").join(pages, "expression_id", "left_semi")
        rows = p.join(self.table("paragraph_embedding").select("text_hash", "embedding"), "text_hash").select("id", F.col("expression_id").alias("page"), "embedding", "text")
        if method == "nli":
            near = similarity.nearest(rows, topk or 50).where(f"source_page <> target_page AND score >= {threshold}")
            found = similarity.labelled(similarity.capped(similarity.canonical_pairs(near), maxpairs), rows, predict)
            found = found.select("source_id", "target_id", F.col("label").cast("double").alias("score"), F.col("confidence").alias("score_raw"))
        else:
            pairs = similarity.exact_pairs(rows, threshold) if method == "cosine" else similarity.bucket_pairs(rows, threshold, lshbits)
            pairs = similarity.top_forward(pairs, topk) if topk else pairs
            found = similarity.capped(pairs, maxpairs).withColumn("score_raw", F.lit(None).cast("double"))
        old = self.table("paragraph_similarity")
        kept = old.where(F.col("method") != method).unionByName(old.where(F.col("method") == method).join(p.select(F.col("id").alias("source_paragraph")), "source_paragraph", "left_anti"))
        new = found.select(F.col("source_id").alias("source_paragraph"), F.col("target_id").alias("target_paragraph"), "score", "score_raw", F.lit(method).alias("method"), F.lit(as_of).cast("timestamp_ntz").alias("created_at"))
        self.write(paragraph_similarity=kept.unionByName(new))
        return self.table("paragraph_similarity").where(F.col("method") == method).count()

    def embedding_check(self) -> dict[str, object]:
        return {"providers": sorted(paragraphs.PROVIDERS), "paragraphs": self.table("paragraph").count(), "embeddings": self.table("paragraph_embedding").count(), "pairs": self.table("paragraph_similarity").count()}

    def embedding_reset(self, name: str | None = None) -> None:
        """Without a land, everything goes."""
        p = self.table("paragraph")
        if name:
            pages = self.table("expression").where(F.col("land_id") == self.land_id(name)).select(F.col("id").alias("expression_id"))
            gone = p.join(pages, "expression_id", "left_semi")
        else:
            gone = p
        pairs = paragraphs.reset_embeddings(p, self.table("paragraph_similarity"), gone)[1]
        left = p.join(gone.select("id"), "id", "left_anti")
        self.write(paragraph=left, paragraph_similarity=pairs, paragraph_embedding=self.table("paragraph_embedding").join(left.select("text_hash"), "text_hash", "left_semi"))

    # --- Exports -----------------------------------------------------------------------------------------------------

    def _pages(self) -> tuple[DataFrame, DataFrame]:
        """Pages with a domain id, and domains."""
        known = self.table("domain")
        names = self.table("expression").select(F.col("domain").alias("name")).distinct().join(known.select("name"), "name", "left_anti")
        d = known.unionByName(self._numbered(names, "domain", "name"), allowMissingColumns=True)
        return self.table("expression").join(d.select(F.col("id").alias("domain_id"), F.col("name").alias("domain")), "domain", "left"), d

    def export_frame(self, name: str, export: str, minrel: int = 1) -> DataFrame:
        """The rows of a tabular export."""
        land = self.land_id(name)
        e, d = self._pages()
        if export in ("pagecsv", "fullpagecsv"):
            out = reports.page_report(e, d, self.table("taggedcontent"), self.table("tag"), land, minrel, readable=export == "fullpagecsv")
            out = reports.with_json_columns(out.join(e.select("id", "seorank"), "id"), "seorank").drop("seorank")
            return out.select(*[text.normalised(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in out.dtypes])
        if export == "nodecsv":
            return reports.domain_report(e, d, land, minrel)
        if export == "mediacsv":
            kept = worklists.relevant(e, land, minrel).select(F.col("id").alias("expression_id"))
            return self.table("media").join(kept, "expression_id", "left_semi").select("expression_id", "url", "type", "width", "height", "file_size", "image_hash")
        rows = reports.pseudolink_rows(self.table("paragraph_similarity"), self.table("paragraph"), e, land, minrel)
        if export == "pseudolinks":
            return reports.pseudolinks(rows)
        if export in ("pseudolinkspage", "pseudolinksdomain"):
            return reports.pseudolink_sums(rows, "id" if export.endswith("page") else "domain")
        raise ValueError(f"not a tabular export: {export!r}")

    def land_export(self, name: str, export: str, folder: str, as_of: datetime, minrel: int = 1) -> str:
        """Write an export; the path written."""
        if export not in EXPORTS:
            raise ValueError(f"export must be one of {', '.join(EXPORTS)}, not {export!r}")
        Path(folder).mkdir(parents=True, exist_ok=True)
        path = str(Path(folder) / (sinks.file_name("land", name, export, as_of) + sinks.extension(export)))
        land = self.land_id(name)
        e, d = self._pages()
        kept = worklists.relevant(e, land, minrel)
        if export == "pagegexf":
            nodes = sinks.gexf_nodes(kept, "title", "relevance", ["url", "domain", "relevance", "depth"])
            edges = sinks.gexf_edges(graph.page_edges(self.table("expressionlink"), kept).withColumn("weight", F.lit(1)), "source_id", "target_id", "weight")
            sinks.gexf(path, nodes, edges, [("url", "string"), ("domain", "string"), ("relevance", "integer"), ("depth", "integer")], as_of)
        elif export == "nodegexf":
            report = reports.domain_report(e, d, land, minrel).withColumnRenamed("domain_id", "id")
            edges = sinks.gexf_edges(graph.domain_edges(self.table("expressionlink"), e, land, minrel), "source_domain_id", "target_domain_id", "weight")
            sinks.gexf(path, sinks.gexf_nodes(report, "name", "average_relevance", ["description", "expressions"]), edges, [("description", "string"), ("expressions", "integer")], as_of)
        elif export == "corpus":
            sinks.save_binary(sinks.corpus(kept, Path(path).stem), folder)
        else:
            sinks.csv(self.export_frame(name, export, minrel), path)
        return path

    def tag_export(self, name: str, export: str, minrel: int = 1) -> DataFrame:
        """The tag matrix or the tagged contents of a land."""
        land = self.land_id(name)
        tags = self.table("tag").where(F.col("land_id") == land)
        kept = worklists.relevant(self.table("expression"), land, minrel)
        paths = graph.tag_paths(tags)
        tagged = self.table("taggedcontent").join(kept.select(F.col("id").alias("expression_id")), "expression_id", "left_semi")
        if export == "matrix":
            return graph.tag_matrix(graph.tag_counts(tagged, paths), paths)
        if export == "content":
            return graph.tag_contents(tagged, paths, tags, kept)
        raise ValueError(f"tag export must be matrix or content, not {export!r}")
