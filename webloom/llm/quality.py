"""Quality rules by cross-document line frequency, in DataFrame expressions only.

``line_quality`` measures every whole text (base rules), hashes its normalised
lines, counts for each host in how many distinct documents a line stands, removes
lines above the limits and rejects documents that are depleted by it.

Documents with equal texts are one distinct document; near copies are several. A line
goes when it stands in at least ``min_docs`` distinct documents of a host and in over
``max_share`` of all of them, and a line of ``enough_words`` words also when it stands in
``enough_docs``, however large the host. Of the documents that hold such a line and pass
the base rules one, that of the least text key, keeps it: so of many near copies one is
left whole, where without it all of them would be depleted.

Defined results: a null text has no words (all zero, base_failed, not kept);
null hosts form one group; repeated rows are counted as copies; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import broadcast_if_small, checkpointed

WS = r"[\\x20\\x09-\\x0D]+"
NON_WS = r"[^\\x20\\x09-\\x0D]"
#: The white space and the symbols that the base rules count.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def _let(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``value`` once per row and binds it as ``name``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _repeat_words(words: str, width: int) -> str:
    """Words that stand in windows of ``width`` words found at least twice in the text.

    Windows are compared by 64-bit hash within one text; starts of repeated windows are
    sorted and each adds the words that the one before does not cover.
    """
    window = ", ".join(f"{words}[i + {j}]" for j in range(width))
    covered = (
        "aggregate(array_sort(transform(filter(s, (x, i) -> (i > 0 AND s[greatest(i - 1, 0)].h = x.h) OR (i < size(s) - 1 AND s[least(i + 1, size(s) - 1)].h = x.h)), x -> x.i)),"
        f" named_struct('c', 0L, 'last', -{width}), (a, p) -> named_struct('c', a.c + CAST(least({width}, p - a.last) AS BIGINT), 'last', p), a -> a.c)"
    )
    sorted_pairs = _let("sort_array(transform(g, (h, i) -> named_struct('h', h, 'i', i)))", "s", covered)
    grams = _let(f"transform(sequence(0, size({words}) - {width}), i -> xxhash64({window}))", "g", f"IF(size(array_distinct(g)) = size(g), 0L, {sorted_pairs})")
    return f"IF(size({words}) <= {width}, 0L, {grams})"


def _hash(text: str) -> str:
    """The first 60 bits of the MD5 of a text."""
    return f"CAST(conv(left(md5({text}), 15), 16, 10) AS BIGINT)"


def _line_hash(line: str) -> str:
    """The hash of a normalised line: white space folded and trimmed, lower case."""
    return _hash(f"lower(trim(regexp_replace({line}, '{WS}', ' ')))")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", width: int = 5) -> DataFrame:
    """One narrow row per document: base measures, key of the text, and its lines with a word (hash, words)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), text.alias("t"))
    words = f"filter(split(t, '{WS}'), x -> x <> '')"
    lines = f"filter(split(t, '\\n'), x -> x RLIKE '{NON_WS}')"
    by_words = _let(words, "w", f"named_struct('n', CAST(size(w) AS BIGINT), 'repeated', {_repeat_words('w', width)})")
    line_row = f"named_struct('h', {_line_hash('x')}, 'n', size(filter(split(x, '{WS}'), y -> y <> '')))"
    by_lines = _let(lines, "l", f"named_struct('dup', CAST(size(l) - size(array_distinct(l)) AS BIGINT), 'rows', transform(l, x -> {line_row}))")
    length = lambda c: F.length(c).cast("bigint")
    return d.select(
        "id",
        "host",
        F.expr(_hash("t")).alias("text_key"),
        length(F.translate("t", SPACES, "")).alias("word_chars"),
        (length(F.col("t")) - length(F.translate("t", SYMBOLS, ""))).alias("n_symbols"),
        F.expr(by_words).alias("w"),
        F.expr(by_lines).alias("l"),
    ).select("id", "host", "text_key", "word_chars", "n_symbols", F.col("w.n").alias("n_words"), F.col("w.repeated").alias("n_repeat_words"), F.col("l.dup").alias("n_dup_lines"), F.col("l.rows").alias("lines"))


def frequent_lines(rows: DataFrame, min_docs: int, max_share: float, enough_docs: int | None = None, enough_words: int = 8) -> DataFrame:
    """(host, h, n_docs, keeper) of the lines above the limits. rows: host, text_key, lines, base_failed; keeper is the text that keeps the line.

    There are at most (lines of a document / max_share) of them per host, and a part 1 / enough_docs of all lines more.
    """
    lines = rows.select("host", "text_key", "base_failed", F.explode("lines").alias("x")).select("host", "text_key", "base_failed", F.col("x.h").alias("h"), F.col("x.n").alias("words")).distinct()
    per_line = lines.groupBy("host", "h").agg(F.count("*").alias("n_docs"), F.max("words").alias("words"), F.min(F.when(~F.col("base_failed"), F.col("text_key"))).alias("keeper"))
    per_host = rows.select(F.col("host").alias("host2"), "text_key").distinct().groupBy("host2").agg(F.count("*").alias("host_docs"))
    found = per_line.where(F.col("n_docs") >= min_docs).join(per_host, F.col("host").eqNullSafe(F.col("host2")))
    above = F.col("n_docs") > max_share * F.col("host_docs")
    if enough_docs is not None:
        above |= (F.col("n_docs") >= enough_docs) & (F.col("words") >= enough_words)
    return found.where(above).select("host", "h", "n_docs", "keeper")


def line_quality(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 10,
    repeat_percent: int = 20,
    min_docs: int = 10,
    max_share: float = 0.1,
    enough_docs: int | None = 100,
    enough_words: int = 8,
    min_left: int = 5,
    min_left_share: float = 0.2,
) -> DataFrame:
    """One row per document: measures, base_failed, removed_words, bad_lines (hashes of lines to remove) and kept.

    base_failed: fewer than ``min_words`` words, or over ``repeat_percent`` per cent of them in repeated windows.
    kept: not base_failed, and not depleted. Depleted: removal took words and left fewer than ``min_left`` or under ``min_left_share`` of them.
    """
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    rows = checkpointed(measured(docs, id_col, text_col, host_col).withColumn("base_failed", base))
    bad = checkpointed(frequent_lines(rows, min_docs, max_share, enough_docs, enough_words)).select(F.col("host").alias("bad_host"), F.col("h").alias("bad_h"), "keeper")
    key = F.monotonically_increasing_id()  # of checkpointed rows; repeated ids stay apart
    rows = checkpointed(rows.withColumn("row", key))
    each = rows.select("row", "host", "text_key", F.explode("lines").alias("x")).select("row", "host", "text_key", F.col("x.h").alias("h"), F.col("x.n").alias("n"))
    hit = each.join(broadcast_if_small(bad), F.col("host").eqNullSafe(F.col("bad_host")) & (F.col("h") == F.col("bad_h")))
    gone = hit.where(~F.col("text_key").eqNullSafe(F.col("keeper")))
    removed = gone.groupBy("row").agg(F.sum("n").cast("bigint").alias("removed"), F.collect_set("h").alias("bad_lines"))
    left = F.col("n_words") - F.col("removed_words")
    depleted = (F.col("removed_words") > 0) & ((left < min_left) | (left < min_left_share * F.col("n_words")))
    return (
        rows.drop("lines", "text_key")
        .join(removed, "row", "left")
        .withColumn("removed_words", F.coalesce("removed", F.lit(0).cast("bigint")))
        .withColumn("kept", ~F.col("base_failed") & ~depleted)
        .select(F.col("id").alias(id_col), F.col("host").alias(host_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words", "bad_lines")
    )


def without_lines(text: Column, bad_lines: Column) -> Column:
    """``text`` without the lines whose normalised hash is in ``bad_lines``; unchanged where that is null or empty."""
    normal = lambda x: F.lower(F.trim(F.regexp_replace(x, r"[\x20\x09-\x0D]+", " ")))
    is_bad = lambda x: F.array_contains(bad_lines, F.conv(F.left(F.md5(normal(x)), F.lit(15)), 16, 10).cast("bigint"))
    return F.when(F.size(F.coalesce(bad_lines, F.array().cast("array<bigint>"))) == 0, text).otherwise(F.array_join(F.filter(F.split(text, "\n"), lambda x: ~is_bad(x)), "\n"))
