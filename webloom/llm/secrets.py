"""Secret scans: fixed patterns, and sliding-window Shannon entropy per character class.

``scan_text`` finds spans in one text. Base kinds are regular expressions. The
``entropy`` kind takes candidate strings, runs of the base64 alphabet, and slides a
window of ``window`` characters over each run of a character class in them (hex
digits, the whole alphabet), keeping the counts incrementally: one character leaves, one
enters. It unites the windows whose entropy reaches the class's limit. Candidates that
an allow-list pattern explains are suppressed; the allow-list never suppresses a base
kind.

Defined results: null and empty texts have no spans; repeated rows are scanned
alike; ties (spans with one start) are ordered by kind as listed; other columns are
ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.common import tidy

KINDS = ("assign", "access", "hex", "entropy")

# The patterns of the base kinds. ``access`` and ``hex`` state the least
# length in the pattern, which is the same as dropping shorter matches: both take a
# whole run, so what a shorter match leaves of the run is shorter still.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_VALUE = 12


@dataclass(frozen=True)
class EntropyRule:
    """A character class (inside of a regex class), and the entropy in bits that a window of it must reach."""

    chars: str
    bits: float
    needs: str = r"(?=.*[0-9])(?=.*[A-Za-z])"  # a run is a candidate only if it matches this


@dataclass(frozen=True)
class EntropyScan:
    window: int = 20
    rules: tuple[EntropyRule, ...] = (EntropyRule("0-9A-Fa-f", 2.8), EntropyRule("A-Za-z0-9+/_=-", 3.9))
    #: Candidates (runs of the base64 alphabet) that one of these matches as a whole are no secrets: UUIDs, the alphabet or digits in order, placeholders, one repeated unit, plain identifiers of words.
    allow: tuple[str, ...] = (
        r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
        r"(?i)[a-z0-9+/_=-]*(?:example|placeholder|sample|dummy|changeme|xxxx)[a-z0-9+/_=-]*",
        r"(?i)[a-z0-9+/_=-]*(?:abcdefghij|0123456789|1234567890)[a-z0-9+/_=-]*",
        r"(.{1,4})\1{4,}.{0,3}",
        r"[A-Za-z]+(?:[-_/][A-Za-z]+)*[-_/]?[0-9]{0,4}",
    )
    compiled: list = field(default_factory=list, compare=False, repr=False)

    def prepared(self) -> tuple[list[tuple[re.Pattern, re.Pattern, float]], re.Pattern]:
        if not self.compiled:
            rules = [(re.compile(f"[{r.chars}]{{{self.window},}}"), re.compile(r.needs), r.bits) for r in self.rules]
            self.compiled.extend((rules, [re.compile(p) for p in self.allow]))
        return self.compiled[0], self.compiled[1]


def high_entropy(run: str, window: int, bits: float) -> list[tuple[int, int]]:
    """United windows of ``run`` with at least ``bits`` of Shannon entropy.

    With counts c of the window's characters the entropy is log2(W) - sum(c log2 c) / W, so each step changes two terms of the sum.
    """
    if len(run) < window:
        return []
    term = [0.0] + [c * math.log2(c) for c in range(1, window + 2)]  # a character enters before one leaves
    most = (math.log2(window) - bits) * window + 1e-9
    counts: dict[str, int] = {}
    total, spans = 0.0, []
    for i, ch in enumerate(run):
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += term[c + 1] - term[c]
        if i >= window:
            old = run[i - window]
            c = counts[old]
            counts[old] = c - 1
            total += term[c - 1] - term[c]
        if i >= window - 1 and total <= most:
            start = i - window + 1
            if spans and start <= spans[-1][1]:
                spans[-1][1] = i + 1
            else:
                spans.append([start, i + 1])
    return [(a, b) for a, b in spans]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def entropy_spans(text: str, scan: EntropyScan) -> list[tuple[str, int, int]]:
    rules, allow = scan.prepared()
    found: list[list[int]] = []
    for candidate in re.finditer(rf"[A-Za-z0-9+/_=-]{{{scan.window},}}", text):
        if any(a.fullmatch(candidate[0]) for a in allow):
            parts = [m.span() for m in re.finditer(r"[^=/]+", candidate[0])]
            # a string that an assignment or a path joins to an explained one is judged on its own
            parts = [(a, b) for a, b in parts if len(parts) > 1 and b - a >= scan.window and not any(x.fullmatch(candidate[0], a, b) for x in allow)]
        else:
            parts = [(0, len(candidate[0]))]
        for start, end in parts:
            for pattern, needs, bits in rules:
                for m in pattern.finditer(candidate[0], start, end):
                    if needs.match(m[0]):
                        at = candidate.start() + m.start()
                        found += [[at + a, at + b] for a, b in high_entropy(m[0], scan.window, bits)]
    found.sort()
    united: list[list[int]] = []
    for a, b in found:
        if united and a <= united[-1][1]:
            united[-1][1] = max(united[-1][1], b)
        else:
            united.append([a, b])
    return [("entropy", a, b) for a, b in united]


def _ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan_text(text: str | None, scan: EntropyScan = EntropyScan()) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans) of one whole text, each (kind, start, end) in code points, end exclusive, by start and kind."""
    if not text:
        return [], []
    base = base_spans(text)
    return _ordered(base), _ordered(base + entropy_spans(text, scan))


def redacted(text: str | None, mark: str = "[SECRET]", scan: EntropyScan = EntropyScan()) -> str | None:
    """``text`` with each united stretch of spans replaced by ``mark``; for an assignment, all of it."""
    spans = scan_text(text, scan)[1]
    if not spans:
        return text
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: EntropyScan = EntropyScan()) -> DataFrame:
    """One row per document: id, base_spans, spans (arrays of kind, start, end)."""
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [scan_text(t, rules) for t in b.column(1).to_pylist()]
            arrays = [pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in f[i]] for f in found], _SPANS) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], names=["id", "base_spans", "spans"])

    schema = T.StructType([kept.schema["id"], T.StructField("base_spans", T.ArrayType(SPAN)), T.StructField("spans", T.ArrayType(SPAN))])
    return kept.mapInArrow(tidy(run), schema).withColumnRenamed("id", id_col)


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the hash of their spans and all spans as text."""
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base_spans", lambda x: x.kind == kind)).cast("bigint")
    return scanned.select(id_col, *[count(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(text("base_spans"), 256).alias("base_sha256"), text("spans").alias("spans"))


def base_digest(spans: list[tuple[str, int, int]]) -> str:
    """The same hash in Python, for tests."""
    return hashlib.sha256(joined(spans).encode()).hexdigest()


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", rules: EntropyScan = EntropyScan()) -> DataFrame:
    """``docs`` with every found secret replaced by ``mark``; all rows and columns stay, in their order."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at)
            arrays = [*b.columns]
            arrays[at] = pa.array([redacted(t, mark, rules) for t in texts.to_pylist()], texts.type)
            yield pa.RecordBatch.from_arrays(arrays, schema=b.schema)

    return docs.mapInArrow(tidy(run), docs.schema)
