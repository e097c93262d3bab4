"""URL expressions: resolution, anchors, archive wrappers, domain names, crawlability."""

from __future__ import annotations

from collections.abc import Mapping
from urllib.parse import quote, urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# Host suffix -> pattern whose first capture names a domain there.
HEURISTICS = {
    "facebook.com": r"([a-z0-9\-_]+\.facebook\.com/(?!(?:permalink.php)|(?:notes))[a-zA-Z0-9\.\-_]+)/?\??",
    "twitter.com": r"([a-z0-9\-_]*\.?twitter\.com/(?!(?:hashtag)|(?:search)|(?:home)|(?:share))[a-zA-Z0-9\.\-_]+)",
    "linkedin.com": r"([a-z0-9\-_]+\.linkedin\.com/[a-zA-Z0-9\.\-_]+)/?\??",
    "slideshare.net": r"([a-z0-9\-_]+\.slideshare\.com/[a-zA-Z0-9\.\-_]+)/?\??",
    "instagram.com": r"([a-z0-9\-_]+\.instagram\.com/[a-zA-Z0-9\.\-_]+)/?\??",
    "youtube.com": r"([a-z0-9\-_]+\.youtube\.com/(?!watch)[a-zA-Z0-9\.\-_]+)/?\??",
    "vimeo.com": r"([a-z0-9\-_]+\.vimeo\.com/[a-zA-Z0-9\.\-_]+)/?\??",
    "dailymotion.com": r"([a-z0-9\-_]+\.dailymotion\.com/(?!video)[a-zA-Z0-9\.\-_]+)/?\??",
    "pinterest.com": r"([a-z0-9\-_]+\.pinterest\.com/(?!pin)[a-zA-Z0-9\.\-_]+)/?\??",
    "pinterest.fr": r"([a-z0-9\-_]+\.pinterest\.fr/[a-zA-Z0-9\.\-_]+)/?\??",
}
# Endings of what is not crawled, and endings of media by type.
NOT_CRAWLED = ("jpg", "jpeg", "png", "bmp", "webp", "pdf", "txt", "csv", "xls", "xlsx", "doc", "docx")
MEDIA_ENDINGS = {
    "img": ("jpg", "jpeg", "png", "gif", "webp", "bmp", "svg"),
    "video": ("mp4", "webm", "ogg", "ogv", "mov", "avi", "mkv"),
    "audio": ("mp3", "wav", "ogg", "aac", "flac", "m4a"),
}
ARCHIVE_DOMAINS = ("web.archive.org", "archive.org", "ghostarchive.org")


def split_list(text: Column) -> Column:
    """Pieces of a comma list: empty ones dropped, the others trimmed (a blank piece stays as '')."""
    return F.transform(F.filter(F.split(text, ","), lambda x: x != ""), lambda x: F.trim(x))


def without_anchor(url: Column) -> Column:
    """The URL up to '#', unless it begins with it."""
    return F.when(F.instr(url, "#") > 1, F.substring_index(url, "#", 1)).otherwise(url)


def authority(url: Column) -> Column:
    """What stands between '//' and the path, '' without it."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def after_authority(url: Column) -> Column:
    """Path, query and fragment."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(.*)$", 1)


def unwrapped(url: Column) -> Column:
    """The original URL of an archived copy, else the URL."""
    host, rest = authority(url), after_authority(url)
    web = F.regexp_extract(rest, r"/web/\d+(?:[a-z]+_)?/(.+)$", 1)
    ghost = F.regexp_extract(rest, r"/archive/[^/]+/(.+)$", 1)
    return F.when(host.isin(*ARCHIVE_DOMAINS[:2]) & (web != ""), web).when((host == ARCHIVE_DOMAINS[2]) & (ghost != ""), ghost).otherwise(url)


def domain_name(url: Column, heuristics: Mapping[str, str] = HEURISTICS) -> Column:
    """Authority of the unwrapped URL, refined by the heuristics in their order."""
    original = unwrapped(url)
    name = authority(original)
    refined = []  # an authority ends with at most one of the suffixes
    for suffix, pattern in heuristics.items():
        found = F.regexp_extract(original, pattern, 1)
        refined.append(F.when(name.endswith(suffix) & (found != ""), found))
    return F.coalesce(*refined, name)


def is_crawlable(url: Column) -> Column:
    """http(s) and none of the endings that are not pages; false for null."""
    return F.coalesce(url.rlike("^https?://") & ~url.rlike(rf"\.({'|'.join(NOT_CRAWLED)})$"), F.lit(False))


def has_media_ending(url: Column, kind: str) -> Column:
    """Whether the path ends like media of the kind; data: URLs do."""
    path = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1))
    return F.coalesce(F.lower(url).startswith("data:") | path.rlike(rf"\.({'|'.join(MEDIA_ENDINGS[kind])})$"), F.lit(False))


@pandas_udf(T.StringType())
def _joined(base: pd.Series, url: pd.Series) -> pd.Series:
    def one(b: str | None, u: str | None) -> str | None:
        if u is None:
            return None
        try:
            return urljoin(b or "", u)
        except ValueError:
            return u

    return pd.Series([one(b, u) for b, u in zip(base, url, strict=True)], dtype=object)


def resolved(base: Column, url: Column, lower: bool = True) -> Column:
    """The URL against its base. Absolute and root-relative URLs without dot steps stay in expressions; the others go through urljoin."""
    absolute = url.rlike("^https?://")
    rooted = url.rlike(r"^/[^/]") & ~url.rlike(r"/\.{1,2}(/|$)") & base.rlike("^https?://")
    joined = F.when(absolute, url).when(rooted, F.concat(F.regexp_extract(base, "^(https?://[^/?#]*)", 1), url)).otherwise(_joined(base, url))
    return F.lower(joined) if lower else joined


def resolved_or_data(base: Column, url: Column) -> Column:
    """As ``resolved`` without lower-casing; data: URLs as they are."""
    return F.when(url.startswith("data:"), url).otherwise(resolved(base, url, lower=False))


@pandas_udf(T.StringType())
def percent_encoded(url: pd.Series) -> pd.Series:
    """Percent-encoded for a path, with ':/?&=%' left as they are."""
    return url.map(lambda u: None if u is None else quote(u, safe=":/?&=%"))
