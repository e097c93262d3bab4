"""Language identification by Bayesian fusion of four kinds of evidence.

* Text: character n-grams of the page's main text under one multinomial model for each
  language, learnt from labelled documents. The log likelihood is tempered, as the
  n-grams of a text are not independent.
* Declared language of the markup (``html lang``).
* Address: a language suffix of the host (country domain) or a language step of the path.
* Host: how the other pages of the host, of its registered domain and of the whole table
  are distributed, each level smoothed by the next (leave-one-out).

How far a declaration or an address can be trusted is not assumed but learnt: grouped
aggregation of the text posteriors gives P(declared | language) and P(address |
language). Sums over hosts are partial aggregates, so that a host with a third of all
pages is no burden for one task.

Defined results: a null or empty page has no text evidence, and the other kinds decide;
without any evidence the global distribution does; ties go to the first language in
order; pages of a null URL form one host; repeated rows count as pages of their own;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.common import broadcast_if_small, checkpointed, tidy
from webloom.llm.extract import main_text

#: Buckets of hashed n-grams.
BUCKETS = 1 << 16
#: Country domains with one prevailing language.
COUNTRY = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "uk": "en", "us": "en", "ie": "en", "au": "en", "nz": "en", "se": "sv", "dk": "da", "no": "no", "fi": "fi", "cz": "cs", "hu": "hu", "ro": "ro", "gr": "el", "tr": "tr", "ru": "ru", "ua": "uk", "jp": "ja", "kr": "ko", "cn": "zh"}
HTML = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<html\b[^>]*", re.I | re.S)
LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,3})", re.I)


def gram_buckets(text: str) -> np.ndarray:
    """Buckets of the character 1- to 3-grams of a lower-cased text; runs of what is no letter count as one space."""
    t = re.sub(r"[\W\d_]+", " ", f" {text} ".lower())
    cp = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(cp) < 3:
        return np.zeros(0, np.int64)
    a, b, c = cp[:-2], cp[1:-1], cp[2:]
    mix = lambda x, seed: ((x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) >> np.uint64(48)).astype(np.int64) % BUCKETS
    return np.concatenate([mix(b, 1), mix((a << np.uint64(21)) | b, 2), mix((a << np.uint64(42)) | (b << np.uint64(21)) | c, 3)])


def text_model(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_train: int = 20_000) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log probabilities [language, bucket], from a sample by hash of at most about ``max_train`` labelled documents."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    n = known.select("lang").count()
    if n > max_train:
        known = known.where(F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(1_000_000)) < int(1_000_000 * max_train / n))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                total[lang] += np.bincount(gram_buckets(text), minlength=BUCKETS)
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], names=["lang", "bucket", "n"])

    rows = known.select("lang", "text").mapInArrow(tidy(count), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most languages * BUCKETS
    names = rows.column("lang").to_pylist()
    langs = sorted(set(names))
    table = np.full((len(langs), BUCKETS), 0.5)
    place = {x: i for i, x in enumerate(langs)}
    np.add.at(table, ([place[x] for x in names], rows.column("bucket").to_numpy()), rows.column("n").to_numpy())
    return langs, np.log(table / table.sum(axis=1, keepdims=True))


def text_likelihood(text: str, model: np.ndarray, temper: float = 0.05, most: float = 30.0) -> np.ndarray:
    """Log likelihoods less their largest, tempered, and none below -most."""
    grams = gram_buckets(text)
    if not len(grams):
        return np.zeros(len(model))
    ll = model[:, grams].sum(axis=1) * temper
    return np.maximum(ll - ll.max(), -most)


def declared_language(html: str | None) -> str:
    """The language that the first html tag outside comments declares, wherever it stands; '' without one."""
    tag = next((m[0] for m in HTML.finditer(html or "") if not m[0].startswith("<!")), "")
    found = LANG.search(tag)
    return found[1].lower() if found else ""


def address_language(host: str, path: str) -> str:
    """``tld:xx`` of a country domain, else ``path:xx`` of a language step in the path, else ''."""
    if found := COUNTRY.get(host.rpartition(".")[2]):
        return f"tld:{found}"
    m = re.match(r"/([a-z]{2})(?:-[a-z]{2})?(?:/|$)", path)
    return f"path:{m[1]}" if m else ""


def _evidence(pages: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """One narrow row per page: id, url, host, domain, declared, address, ll (array by language)."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, domains, declared, address, ll = [], [], [], [], []
            for url, html in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::\d+)?([^?#]*)", (url or "").strip().lower())
                host, path = (m[1], m[2]) if m else ("", "")
                hosts.append(host)
                domains.append(".".join(host.split(".")[-2:]))
                declared.append(declared_language(html))
                address.append(address_language(host, path))
                ll.append(text_likelihood(main_text(html), shared.value))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, pa.string()) for x in (hosts, domains, declared, address)), pa.array([x.tolist() for x in ll], pa.list_(pa.float64()))], names=["id", "url", "host", "domain", "declared", "address", "ll"])

    schema = T.StructType([pages.schema["id"], pages.schema["url"], *(T.StructField(c, T.StringType()) for c in ("host", "domain", "declared", "address")), T.StructField("ll", T.ArrayType(T.DoubleType()))])
    return pages.mapInArrow(tidy(run), schema)


def _normalised(weights: Column) -> Column:
    """An array of log weights as probabilities."""
    p = F.transform(weights, lambda x: F.exp(x - F.array_max(weights)))
    return F.transform(p, lambda x: x / F.aggregate(p, F.lit(0.0), lambda a, y: a + y))


def _sums(rows: DataFrame, key: str, n: int, name: str) -> DataFrame:
    return rows.groupBy(key).agg(F.array(*[F.sum(F.col("p")[i]) for i in range(n)]).alias(name))


def _likelihood(rows: DataFrame, key: str, totals: list[float], alpha: float = 0.5) -> DataFrame:
    """log P(value of ``key`` | language) for each value; '' (nothing said) is one of them."""
    sums = _sums(rows, key, len(totals), "s")
    values = sums.count()
    logs = F.array(*[F.log((F.col("s")[i] + alpha) / (t + alpha * (values + 1))) for i, t in enumerate(totals)])
    return sums.select(F.col(key).alias(f"{key}_value"), logs.alias(f"{key}_ll"))


def identify(pages: DataFrame, docs: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", host_strength: float = 5.0, domain_strength: float = 20.0, max_train: int = 20_000) -> DataFrame:
    """One row per page: id, url, host, declared, address, text_lang (null without text), lang, prob."""
    langs, model = text_model(docs, max_train=max_train)
    k = len(langs)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    names = F.array(*[F.lit(x) for x in langs]) if k else F.array().cast("array<string>")
    seen = checkpointed(_evidence(rows, langs, model).withColumn("p", _normalised(F.col("ll"))))
    if not k:
        return seen.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "host", "declared", "address", F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("prob"))
    total = [x or 0.0 for x in seen.agg(*[F.sum(F.col("p")[i]) for i in range(k)]).first()]
    everywhere = [(t + 1.0) / (sum(total) + k) for t in total]
    hosts = checkpointed(_sums(seen, "host", k, "host_sum"))
    domains = checkpointed(_sums(seen, "domain", k, "domain_sum"))
    declared, address = (checkpointed(_likelihood(seen, c, total)) for c in ("declared", "address"))
    joined = seen.join(broadcast_if_small(hosts), "host").join(broadcast_if_small(domains), "domain")
    joined = joined.join(broadcast_if_small(declared), F.col("declared") == F.col("declared_value")).join(broadcast_if_small(address), F.col("address") == F.col("address_value"))
    # The other pages of the host and domain: sums without the page's own posterior.
    less = lambda c, i: F.greatest(F.col(c)[i] - F.col("p")[i], F.lit(0.0))
    size = lambda c: sum((less(c, i) for i in range(k)), F.lit(0.0))
    domain_p = [(less("domain_sum", i) + domain_strength * everywhere[i]) / (size("domain_sum") + domain_strength) for i in range(k)]
    host_p = [(less("host_sum", i) + host_strength * domain_p[i]) / (size("host_sum") + host_strength) for i in range(k)]
    fused = F.array(*[F.col("ll")[i] + F.col("declared_ll")[i] + F.col("address_ll")[i] + F.log(host_p[i]) for i in range(k)])
    out = joined.withColumn("fused", fused).withColumn("post", _normalised(F.col("fused")))
    best = lambda c: F.element_at(names, F.array_position(F.col(c), F.array_max(c)).cast("int"))
    text_lang = F.when(F.array_min("ll") < F.array_max("ll"), best("p"))
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "host", "declared", "address", text_lang.alias("text_lang"), best("post").alias("lang"), F.array_max("post").alias("prob"))
