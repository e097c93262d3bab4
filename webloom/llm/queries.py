"""The queries opN_<name> of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import contain, extract, jaccard, language, licenses, packing, quality, secrets, toxicity, warc
from webloom.llm.common import table


def op1_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels that are not held out."""
    return toxicity.toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op2_evidence_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page from text, markup, address and host; the text model is learnt from documents."""
    return language.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op3_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, from its whole html."""
    return extract.extract(table(spark, sf_dir, "pages"))


def op4_template_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in all documents."""
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


def op5_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def tokenizer_path() -> str:
    """The public vocabulary that the packing query uses; it is a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens, id 1 after each."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_not_modified_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not-modified revisits of all pages resolved to the latest earlier response; headers as sorted text."""
    out = warc.resolve_revisits(warc.captures_of_pages(table(spark, sf_dir, "pages")))
    text = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return out.withColumn("headers", F.when(F.col("headers").isNotNull(), text))


def op8_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items of which a document holds at least 80 per cent of the 5-word shingles."""
    return contain.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules with line frequency over all documents; the host is the source."""
    out = quality.line_quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of links of at least 0.9 on 3-word shingles over all documents."""
    return jaccard.linked_documents(table(spark, sf_dir, "documents"), k=3, percent=90)


QUERIES = (
    op1_noisy_channel_toxicity,
    op2_evidence_language,
    op3_tree_scoring,
    op4_template_licenses,
    op5_entropy_secrets,
    op6_best_fit_packing,
    op7_not_modified_revisits,
    op8_benchmark_containment,
    op9_line_quality,
    op10_jaccard_join,
)

OP7_SQL = r"""
WITH rest AS (
  SELECT page_id, coalesce(html, '') AS html, regexp_replace(trim(url, ' '), '^[A-Za-z][A-Za-z0-9+.-]*://|#.*$', '', 'g') AS r FROM pages
), parts AS (
  SELECT page_id, html,
         regexp_replace(lower(regexp_extract(r, '^([^/?]*)', 1)), '^(www|m)\.|:(80|443)$', '', 'g') AS host,
         regexp_replace(regexp_extract(r, '^[^/?]*([^?]*)', 1), '/$', '') AS path,
         regexp_replace(regexp_replace(regexp_extract(r, '\?(.*)$', 1), '(^|&)(utm_[a-z]+|gclid|fbclid|ref|sessionid)=[^&]*', '', 'g'), '^&', '') AS query
  FROM rest
), keyed AS (
  SELECT page_id, host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS key, '"' || md5(html) || '"' AS etag, length(html) AS size FROM parts
), revisit AS (
  SELECT page_id, 2 * page_id + 1 AS record_id, key, page_id + 500000 AS ts,
         CASE WHEN page_id % 10 = 3 THEN NULL WHEN page_id % 15 = 7 THEN '"new"' ELSE 'W/' || etag END AS etag
  FROM keyed
), found AS (
  SELECT v.record_id, max_by(k.page_id, k.page_id) AS page_id
  FROM revisit v JOIN keyed k ON k.key = v.key AND k.page_id < v.ts GROUP BY v.record_id
), joined AS (
  SELECT v.record_id, v.key AS url_key, v.ts, v.page_id AS own, v.etag, k.page_id AS stored, k.etag AS stored_etag, k.size,
         CASE WHEN k.page_id IS NULL THEN 'no_response' WHEN v.etag IS NULL THEN 'unvalidated'
              WHEN regexp_replace(v.etag, '^W/', '') = k.etag THEN 'resolved' ELSE 'mismatch' END AS status
  FROM revisit v LEFT JOIN found f ON f.record_id = v.record_id LEFT JOIN keyed k ON k.page_id = f.page_id
)
SELECT record_id, url_key, ts, status, 2 * stored AS refers_to,
       CASE WHEN status IN ('resolved', 'unvalidated') THEN 'content-length=' || size || ';content-type=text/html;date=u' || own || ';etag=' || coalesce(etag, stored_etag) END AS headers
FROM joined
"""


OP9_SQL = r"""
WITH words AS (
  SELECT doc_id, source, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), grams AS (
  SELECT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: struct_pack(i := i, g := list_slice(w, i, i + 4)))) AS x FROM words WHERE len(w) >= 5
), repeated AS (
  SELECT doc_id, x.i AS i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, x.g) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM repeated, range(0, 5) AS r(j) GROUP BY doc_id
), base AS (
  SELECT doc_id, source, t, CAST('0x' || left(md5(t), 15) AS BIGINT) AS text_key, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         len(w) < 10 OR 100 * coalesce(c.n, 0) > 20 * len(w) AS base_failed
  FROM words LEFT JOIN covered c USING (doc_id)
), lines AS (
  SELECT doc_id, source, text_key, base_failed, unnest(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS line FROM base
), dups AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id
), normal AS (
  SELECT doc_id, source, text_key, base_failed, CAST('0x' || left(md5(lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' '))), 15) AS BIGINT) AS h,
         len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n FROM lines
), frequent AS (
  SELECT l.source, l.h, l.keeper
  FROM (SELECT source, h, count(DISTINCT text_key) AS n_docs, max(n) AS words, min(text_key) FILTER (NOT base_failed) AS keeper FROM normal GROUP BY source, h) l
  JOIN (SELECT source, count(DISTINCT t) AS host_docs FROM words GROUP BY source) c ON c.source = l.source
  WHERE n_docs >= 10 AND (n_docs > 0.1 * host_docs OR n_docs >= 100 AND words >= 8)
), removed AS (
  SELECT doc_id, CAST(sum(n) AS BIGINT) AS n FROM normal JOIN frequent USING (source, h) WHERE text_key IS DISTINCT FROM keeper GROUP BY doc_id
), measured AS (
  SELECT doc_id, n_words, n_repeat_words, base_failed, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(d.n, 0) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS removed_words
  FROM base LEFT JOIN dups d USING (doc_id) LEFT JOIN removed r USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (removed_words > 0 AND (n_words - removed_words < 5 OR n_words - removed_words < 0.2 * n_words)) AS kept, removed_words
FROM measured
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op7_not_modified_revisits": OP7_SQL, "op9_line_quality": OP9_SQL}
