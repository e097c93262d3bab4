"""Text expressions: tokens, paragraphs, Markdown links, verdicts, slugs and headers."""

from __future__ import annotations

import re
import unicodedata
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# Letters of words, white space of texts, Markdown link pattern.
WORD = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
MD_LINK = r"\(((https?|ftp)://[^\s/$.?#].[^\s]*)\)"


def words(text: Column) -> Column:
    """Lower-case runs of Latin letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def cleaned(text: Column) -> Column:
    """White space (Unicode's) as single spaces, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def paragraphs(text: Column, least: int = 150, most: int = 6000) -> Column:
    """Cleaned blocks between blank lines, of ``least`` to ``most`` characters; without any, the whole cleaned text cut at ``most``; none for an empty text."""
    whole = F.coalesce(cleaned(text), F.lit(""))
    blocks = F.filter(F.transform(F.split(text, r"\n(?U)\s*\n+"), cleaned), lambda p: (F.length(p) >= least) & (F.length(p) <= most))
    none = F.array().cast("array<string>")
    return F.when(whole == "", none).when(F.size(blocks) > 0, blocks).otherwise(F.array(F.substring(whole, 1, most)))


def md_links(text: Column) -> Column:
    """URLs in round brackets, without one closing bracket too many at the end."""
    count = lambda u, c: F.length(u) - F.length(F.replace(u, F.lit(c), F.lit("")))
    short = lambda u: F.when(u.endswith(")") & (count(u, "(") <= count(u, ")")), F.substring(u, F.lit(1), F.length(u) - 1)).otherwise(u)
    return F.transform(F.regexp_extract_all(text, F.lit(MD_LINK), F.lit(1)), short)


def verdict(answer: Column) -> Column:
    """oui, non or ? of a free answer."""
    a = F.lower(F.trim(answer))
    return F.when(a.startswith("non") | (a == "no"), "non").when(a.startswith("oui") | (a == "yes"), "oui").otherwise("?")


def normalised(value: Column) -> Column:
    """Trimmed; null, blank and 'unknown' become 'na'."""
    v = F.trim(value)
    return F.when(v.isNull() | F.lower(v).isin("", "unknown"), F.lit("na")).otherwise(v)


def normalised_value(value: Column, kind: T.DataType) -> Column:
    """A value of any type as an export shows it: numbers as they are; lists and maps as JSON, empty ones as 'na'; the rest as ``normalised`` text."""
    if isinstance(kind, T.NumericType):
        return F.coalesce(value.cast("string"), F.lit("na"))
    if isinstance(kind, T.ArrayType | T.MapType):
        return F.when(F.size(value) > 0, F.to_json(value)).otherwise(F.lit("na"))
    if isinstance(kind, T.StructType):
        return F.coalesce(F.to_json(value), F.lit("na"))
    return normalised(value.cast("string"))


def normalised_columns(df: DataFrame) -> DataFrame:
    """All columns as an export shows them; columns of numbers keep their type and their nulls."""
    return df.select(*[F.col(f"`{f.name}`") if isinstance(f.dataType, T.NumericType) else normalised_value(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])


def extractor_urls(payload: Column, field: str = "links") -> Column:
    """The addresses of an extractor's JSON, whose items are texts or objects with a url; none if it is broken."""
    items = F.from_json(F.get_json_object(payload, f"$.{field}"), "array<string>")
    return F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.when(x.startswith("{"), F.get_json_object(x, "$.url")).otherwise(x))


def prompt(land: Column, land_text: Column, terms: Column, url: Column, title: Column, description: Column, readable: Column, most: int = 6000) -> Column:
    """A relevance question for one page with the land's terms (an array) and the readable text cut at ``most``."""
    part = lambda name, c: F.concat(F.lit(f"- {name}: "), F.coalesce(c, F.lit("")))
    return F.concat_ws(
        "\n",
        F.lit("Is this page relevant to the project? Answer only \"oui\" or \"non\"."),
        part("project", land), part("about", land_text), part("terms", F.array_join(terms, ", ")),
        part("url", url), part("title", title), part("description", description), part("text", F.substring(readable, 1, most)),
    )


@pandas_udf(T.StringType())
def slug(title: pd.Series) -> pd.Series:
    """Lower-case ASCII letters and digits, other runs as one hyphen; accents are stripped by NFKD."""

    def one(t: str | None) -> str:
        plain = unicodedata.normalize("NFKD", t or "").encode("ascii", "ignore").decode().lower()
        return re.sub(r"[^a-z0-9]+", "-", plain).strip("-")

    return title.map(one)


def legacy_slug(title: Column) -> Column:
    """The slug with the prefix that older corpora have."""
    s = slug(title)
    return F.when(s == "", "b").otherwise(F.concat(F.lit("b-"), s))


#: Fields of the Dublin Core header in order; those without a column stay empty.
DUBLIN_CORE = ("Title", "Creator", "Contributor", "Coverage", "Date", "Description", "Subject", "Type", "Format", "Identifier", "Language", "Publisher", "Relation", "Rights", "Source")


def dublin_core(**fields: Column) -> Column:
    """A Dublin Core header; ``fields`` maps lower-case names to columns."""
    lines = [F.concat(F.lit(f'{name}: "'), F.coalesce(fields[name.lower()].cast("string"), F.lit("None")), F.lit('"')) if name.lower() in fields else F.lit(f'{name}: ""') for name in DUBLIN_CORE]
    return F.concat(F.concat_ws("\n", F.lit("---"), *lines, F.lit("---")), F.lit("\n"))


_MD_ITEM = {"links": re.compile(r'\[([^\]]+)\]\(([^)\s]+)(?:\s+"([^"]*)")?\)'), "images": re.compile(r'!\[([^\]]*)\]\(([^)\s]+)(?:\s+"([^"]*)")?\)')}


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _md_items(kind: str, once: bool):
    pattern = _MD_ITEM[kind]

    @pandas_udf(T.ArrayType(_strings("url", "text", "title")))
    def items(text: pd.Series, base: pd.Series) -> pd.Series:
        def one(t: str | None, b: str | None) -> list[dict]:
            out: dict = {}
            for i, m in enumerate(pattern.finditer(t or "")):
                url = urljoin(b or "", m[2])
                out.setdefault(url if once else i, {"url": url, "text": m[1] or "", "title": m[3] or ""})
            return list(out.values())

        return pd.Series([one(t, b) for t, b in zip(text, base, strict=True)])

    return items


#: Markdown links (each URL once) and images, with text and title, resolved against a base.
md_link_items = _md_items("links", once=True)
md_image_items = _md_items("images", once=False)
