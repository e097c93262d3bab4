"""Date expressions: result dates, windows and request parameters of search engines."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Formats of result dates, in the order in which they are tried.
FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "yyyy.MM.dd", "MM/dd/yyyy", "dd/MM/yyyy", "dd.MM.yyyy", "MM.dd.yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy")
UNIT_SECONDS = {"minute": 60, "hour": 3600, "day": 86400, "week": 7 * 86400, "month": 30 * 86400, "year": 365 * 86400}


def result_date(text: Column, as_of: Column) -> Column:
    """Timestamp of the date text of a search result; relative ones count back from ``as_of``; null if unknown."""
    t = F.regexp_replace(F.trim(text), r"(?i)^(updated|publiée?)[:\s-]+", "")
    t = F.regexp_replace(t, "[·–—]", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"^[ .\-]+|[ .\-]+$", "")
    t = F.regexp_replace(t, r"(?i)\b([A-Za-z]{3,9})\.", "$1")
    t = F.regexp_replace(t, r"(?i)(?<=\d)(st|nd|rd|th)", "")
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?$"), F.try_to_timestamp(F.regexp_replace(F.regexp_replace(t, "T", " "), r"(Z|[+-]\d{2}:\d{2})$", "")))
    absolute = [F.try_to_timestamp(t, F.lit(f)) for f in FORMATS]
    low = F.lower(t)
    n = F.regexp_extract(low, r"^(?:about\s+)?(\d+)\s+(?:minute|hour|day|week|month|year)s?\s+ago$", 1)
    unit = F.regexp_extract(low, r"^(?:about\s+)?\d+\s+(minute|hour|day|week|month|year)s?\s+ago$", 1)
    seconds = F.coalesce(*[F.when(unit == u, F.lit(s)) for u, s in UNIT_SECONDS.items()])
    relative = F.when(low == "today", as_of).when(low == "yesterday", as_of - F.expr("INTERVAL 1 DAY")).when(n != "", as_of - F.make_dt_interval(secs=n.try_cast("decimal(18,6)") * seconds))
    return F.coalesce(iso, *absolute, relative)


def earlier(a: Column, b: Column) -> Column:
    """The earlier of two times; the other if one is null."""
    return F.least(a, b)


def extractor_date(text: Column) -> Column:
    """Timestamp of an extractor's date: with or without fractions of a second, or a day; else null."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss'Z'")])


def strict_date(text: Column) -> Column:
    """A day as yyyy-MM-dd; anything else is an error."""
    return F.to_date(text, "yyyy-MM-dd")


def advanced(day: Column, step: str) -> Column:
    """The day after one step (day, week or month; a month keeps the day as far as it can)."""
    if step == "month":
        return F.add_months(day, 1)
    if step not in ("day", "week"):
        raise ValueError(f"step must be day, week or month, not {step!r}")
    return F.date_add(day, 7 if step == "week" else 1)


def windows(ranges: DataFrame, start: str, end: str, step: str) -> DataFrame:
    """``ranges`` with window_start and window_end of every closed window from ``start`` to ``end``.

    Days and weeks are a sequence. Months advance from the clamped day of the window before (31 January, 29 February, 29 March), which a fold over the month numbers does.
    """
    if step == "month":
        months = F.months_between(F.trunc(F.col(end), "month"), F.trunc(F.col(start), "month")).cast("int")
        grow = lambda acc, _: F.concat(acc, F.array(F.add_months(F.element_at(acc, -1), 1)))
        starts = F.filter(F.aggregate(F.sequence(F.lit(0), months), F.array(F.col(start)), grow), lambda d: d <= F.col(end))
    else:
        starts = F.expr(f"sequence({start}, {end}, INTERVAL {7 if step == 'week' else 1} DAY)")
    out = ranges.withColumn("window_start", F.explode(F.when(F.col(start) <= F.col(end), starts)))
    last = F.date_sub(advanced(F.col("window_start"), step), 1)
    return out.withColumn("window_end", F.least(last, F.col(end)))


def tbs(start: Column, end: Column) -> Column:
    """Range filter of a closed window, MM/DD/YYYY."""
    return F.concat(F.lit("cdr:1,cd_min:"), F.date_format(start, "MM/dd/yyyy"), F.lit(",cd_max:"), F.date_format(end, "MM/dd/yyyy"))


def page_size(engine: Column) -> Column:
    return F.when(engine == "google", 100).otherwise(50)


def request_params(engine: Column, lang: Column, start: Column, window_start: Column, window_end: Column, dated: Column) -> Column:
    """Request parameters of an engine as a map of text; empty for an unknown engine."""
    code = F.coalesce(F.nullif(F.lower(F.trim(lang)), F.lit("")), F.lit("fr"))
    french = code == "fr"
    pick = lambda fr, other: F.when(french, fr).otherwise(other)
    size = page_size(engine).cast("string")
    at = start.cast("string")
    google = F.create_map(
        F.lit("google_domain"), pick("google.fr", "google.com"), F.lit("gl"), code, F.lit("hl"), code, F.lit("lr"), F.concat(F.lit("lang_"), code), F.lit("safe"), F.lit("off"), F.lit("start"), at, F.lit("num"), F.when(~dated, size)
    )
    bing = F.create_map(F.lit("mkt"), pick("fr-FR", "en-US"), F.lit("count"), size, F.lit("first"), (start + 1).cast("string"))
    between = F.concat(window_start.cast("string"), F.lit(".."), window_end.cast("string"))
    duck = F.create_map(F.lit("kl"), pick("fr-fr", "us-en"), F.lit("start"), at, F.lit("m"), size, F.lit("df"), between)
    some = lambda m: F.map_filter(m, lambda _, v: v.isNotNull())
    return F.when(engine == "google", some(google)).when(engine == "bing", bing).when(engine == "duckduckgo", some(duck)).otherwise(F.create_map().cast("map<string,string>"))


def parse_day(text: str) -> date:
    """Driver-side strict day, for command arguments."""
    return date.fromisoformat(text) if len(text) == 10 else _bad_day(text)


def _bad_day(text: str) -> date:
    raise ValueError(f"not a day as YYYY-MM-DD: {text!r}")
