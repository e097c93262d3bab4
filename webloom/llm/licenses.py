"""License scans by matching template markup.

A template is text with optional regions ``[[ ... ]]`` and replaceable regions
``<<n>>`` (any 0 to n words) or ``<<n:pattern>>`` (0 to n words that the pattern
matches). ``compile_template`` turns it into an automaton over words: states are
positions in the flattened template, optional regions add jumps over themselves and
replaceable ones add counted loops. A text matches where all mandatory words stand in
order, exactly, with nothing between them but what the regions allow. The automaton
runs from each place of the template's first word, on a set of states.

There are three kinds of templates: whole licenses (the longer ones from the files in
``license_texts``, which hold their public texts unchanged), the notices that licenses
prescribe for source files, and statements of one sentence.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased, so
punctuation, markup and line breaks do not count. Besides the templates the base
phrases are searched: their places are counted and label the text.

Defined results: a null or empty text has no words, labels '' and score 0; a text
with several licenses gets all labels, sorted; overlapping places all count; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.common import text_bytes, tidy

#: The base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: What a match of each kind is worth; a base phrase alone is worth ``BASE_SCORE``.
SCORES = {"text": 1.0, "notice": 0.9, "statement": 0.7}
BASE_SCORE = 0.5

_COPYRIGHT = "[[[[all rights reserved]] copyright <<30>>]]"
_BSD_START = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
_BSD_SOURCE = "[[<<1:1|a|i>>]] redistributions of source code must retain the [[above]] copyright notice this list of conditions and the following disclaimer"
_BSD_BINARY = "[[<<1:2|b|ii>>]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_NAMES = "[[<<1:3|c|iii>>]] neither the name of <<12>> nor the names of [[its]] <<4>> may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_END = (
    "this software is provided by <<10>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
    " in no event shall <<10>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services"
    " loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise"
    " arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_GPL_WARRANTY = (
    "this [[<<3>>]] <<1:program|library|software>> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"
    " see the gnu <<2:lesser|library|affero>> general public license for more details"
)
_GPL_START = "<<5>> is free software you can redistribute it and or modify it under the terms of the gnu"

#: Fixed values: (label, kind, template). The wording is that of the licenses, of the notices that they prescribe and of common statements.
TEMPLATES = (
    (
        "mit",
        "text",
        f"{_COPYRIGHT} permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software"
        " to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"
        " and to permit persons to whom the software is furnished to do so subject to the following conditions"
        " the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software"
        " the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
        " in no event shall <<12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise"
        " arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    (
        "mit-0",
        "text",
        f"{_COPYRIGHT} permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software"
        " to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"
        " and to permit persons to whom the software is furnished to do so"
        " the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
        " in no event shall <<12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise"
        " arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    ("bsd-2-clause", "text", f"{_COPYRIGHT} {_BSD_START} {_BSD_SOURCE} {_BSD_BINARY} {_BSD_END}"),
    ("bsd-3-clause", "text", f"{_COPYRIGHT} {_BSD_START} {_BSD_SOURCE} {_BSD_BINARY} {_BSD_NAMES} {_BSD_END}"),
    (
        "isc",
        "text",
        f"{_COPYRIGHT} permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted"
        " provided that the above copyright notice and this permission notice appear in all copies"
        " the software is provided as is and <<8>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"
        " in no event shall <<8>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits"
        " whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    (
        "zlib",
        "text",
        f"{_COPYRIGHT} this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"
        " permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"
        " [[1]] the origin of this software must not be misrepresented you must not claim that you wrote the original software"
        " if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required"
        " [[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software"
        " [[3]] this notice may not be removed or altered from any source distribution",
    ),
    (
        "unlicense",
        "text",
        "this is free and unencumbered software released into the public domain"
        " anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"
        " in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain"
        " we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors"
        " we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law"
        " the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
        " in no event shall the authors be liable for any claim damages or other liability whether in an action of contract tort or otherwise"
        " arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    (
        "apache-2.0",
        "notice",
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"
        " <<1:https?>> www apache org licenses license 2 0 [[txt]]"
        " unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"
        " see the license for the specific language governing permissions and limitations under the license",
    ),
    ("mpl-2.0", "notice", "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at <<1:https?>> mozilla org mpl 2.0"),
    ("gpl-2.0", "notice", f"this {_GPL_START} general public license [[version 2]] as published by the free software foundation [[either]] [[version 2]] [[of the license]] [[or at your option any later version]] {_GPL_WARRANTY}"),
    ("gpl-3.0", "notice", f"this {_GPL_START} general public license as published by the free software foundation either version 3 of the license [[or at your option any later version]] {_GPL_WARRANTY}"),
    ("agpl-3.0", "notice", f"this {_GPL_START} affero general public license as published by the free software foundation either version 3 of the license [[or at your option any later version]] {_GPL_WARRANTY}"),
    ("lgpl-2.1", "notice", f"this {_GPL_START} lesser general public license as published by the free software foundation either version 2.1 of the license [[or at your option any later version]] {_GPL_WARRANTY}"),
    ("mit", "statement", "[[this software is]] <<1:released|licensed|distributed|available>> under the [[terms of the]] mit license"),
    ("apache-2.0", "statement", "<<1:released|licensed|distributed|available>> under the [[terms of the]] apache license [[version]] 2.0"),
    ("gpl-2.0", "statement", "<<1:released|licensed|distributed|available>> under the [[terms of the]] gnu general public license [[as published by the free software foundation]] [[either]] version 2"),
    ("gpl-3.0", "statement", "<<1:released|licensed|distributed|available>> under the [[terms of the]] gnu general public license [[as published by the free software foundation]] [[either]] version 3"),
    ("agpl-3.0", "statement", "<<1:released|licensed|distributed|available>> under the [[terms of the]] gnu affero general public license [[version 3]]"),
    ("lgpl", "statement", "<<1:released|licensed|distributed|available>> under the [[terms of the]] gnu lesser general public license"),
    ("mpl-2.0", "statement", "<<1:released|licensed|distributed|available>> under the [[terms of the]] mozilla public license <<1:version|v>> 2.0"),
    ("bsd", "statement", "<<1:released|licensed|distributed|available>> under the [[terms of the]] [[<<2:[23]|clause>>]] bsd [[<<2:[23]|clause>>]] license"),
    ("cc-by-4.0", "statement", "licensed under [[a]] [[creative commons]] cc by 4.0"),
    ("cc-by-sa-4.0", "statement", "licensed under [[a]] [[creative commons]] cc by sa 4.0"),
    ("cc-by-nc-4.0", "statement", "licensed under [[a]] [[creative commons]] cc by nc 4.0"),
    ("cc-by-nc-sa-4.0", "statement", "licensed under [[a]] [[creative commons]] cc by nc sa 4.0"),
    ("cc-by-4.0", "statement", "licensed under a creative commons attribution 4.0 international license"),
)

#: Whole licenses in files: (label, file, where what may be left out begins: advice on how to apply the license, exhibits).
FILES = (
    ("apache-2.0", "apache-2.0.txt", "END OF TERMS AND CONDITIONS"),
    ("gpl-2.0", "gpl-2.txt", "END OF TERMS AND CONDITIONS"),
    ("gpl-3.0", "gpl-3.txt", "END OF TERMS AND CONDITIONS"),
    ("lgpl-2.1", "lgpl-2.1.txt", "END OF TERMS AND CONDITIONS"),
    ("lgpl-3.0", "lgpl-3.txt", None),
    ("mpl-2.0", "mpl-2.0.txt", "Exhibit A - Source Code Form License Notice"),
)
#: An address of the publisher that changed between printings.
_ADDRESS = re.compile(r"51\s+Franklin\s+Street,\s+Fifth\s+Floor,\s+Boston,\s+MA\s+02110-1301,?\s+USA")


def file_templates() -> tuple[tuple[str, str, str], ...]:
    """The templates of the files; read on the driver."""
    out = []
    for label, name, tail in FILES:
        text = (Path(__file__).parent / "license_texts" / name).read_text(encoding="utf-8")
        text = _ADDRESS.sub("<<12>>", re.sub(r"[\[\]<>]", " ", text))
        head, _, rest = text.partition(tail) if tail else (text, "", "")
        out.append((label, "text", f"{head} [[{tail} {rest}]]" if tail else head))
    return tuple(out)


_NOT_WORD = bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122 or 65 <= b <= 90))
_TABLE = bytes(32 if b in _NOT_WORD else b + 32 if 65 <= b <= 90 else b for b in range(256))


def license_words(text: bytes | None) -> list[bytes]:
    """The words of a text in UTF-8."""
    return text.translate(_TABLE).split() if text else []


Word = bytes | re.Pattern | None


class Automaton:
    """Word automaton: state s takes ``words[s]`` (a word, a pattern, or None for any word) to the states ``closure[s + 1]``."""

    def __init__(self, label: str, kind: str, words: list[Word], jumps: dict[int, set[int]]) -> None:
        self.label, self.kind, self.words, self.end = label, kind, words, len(words)
        self.closure = [self._close(s, jumps) for s in range(self.end + 1)]
        starts = [words[s] for s in self.closure[0] if s < self.end]
        if None in starts or self.end in self.closure[0]:
            raise ValueError("a template must not begin with any word, and needs a mandatory one")
        self.first = frozenset(w for w in starts if isinstance(w, bytes))
        self.first_patterns = [w for w in starts if isinstance(w, re.Pattern)]
        optional = {s for a, to in jumps.items() for b in to for s in range(a, b)}
        #: Words that every match holds; a text without one of them is not run.
        self.mandatory = frozenset(w for s, w in enumerate(words) if s not in optional and isinstance(w, bytes))

    def _close(self, state: int, jumps: dict[int, set[int]]) -> tuple[int, ...]:
        seen, todo = {state}, [state]
        while todo:
            for t in jumps.get(todo.pop(), ()):
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return tuple(sorted(seen))

    def starts(self, words: list[bytes], have: set[bytes]) -> list[int]:
        """The places where a match may begin."""
        first = {w for w in have if w in self.first or any(p.fullmatch(w) for p in self.first_patterns)}
        return [i for i, w in enumerate(words) if w in first] if first else []

    def match(self, text: list[bytes], at: int) -> int | None:
        """Exclusive end of the shortest match that starts at word ``at``, or None."""
        states = set(self.closure[0])
        for i in range(at, len(text)):
            word, after = text[i], set()
            for s in states:
                if s < self.end:
                    w = self.words[s]
                    if w is None or w == word or isinstance(w, re.Pattern) and w.fullmatch(word):
                        after.update(self.closure[s + 1])
            if self.end in after:
                return i + 1
            if not after:
                return None
            states = after
        return None


def compile_template(label: str, template: str, kind: str = "statement") -> Automaton:
    words: list[Word] = []
    jumps: dict[int, set[int]] = {}
    opened: list[int] = []
    for part in re.findall(r"\[\[|\]\]|<<\d+(?::.+?)?>>|[^\[\]<>]+", template):
        if part == "[[":
            opened.append(len(words))
        elif part == "]]":
            if not opened:
                raise ValueError(f"an optional region is not opened: {template[:200]}")
            jumps.setdefault(opened.pop(), set()).add(len(words))
        elif part.startswith("<<"):
            n, _, pattern = part[2:-2].partition(":")
            start, n = len(words), int(n)
            words += [re.compile(pattern.encode()) if pattern else None] * n
            for s in range(start, start + n):
                jumps.setdefault(s, set()).add(start + n)
        else:
            words += license_words(part.encode())
    if opened:
        raise ValueError(f"an optional region is not closed: {template[:200]}")
    return Automaton(label, kind, words, jumps)


@lru_cache(maxsize=4)
def automata(templates: tuple[tuple[str, str, str], ...]) -> tuple[Automaton, ...]:
    """The automata of (label, kind, template), built once for each worker."""
    return tuple(compile_template(label, t, kind) for label, kind, t in templates)


def scan_words(words: list[bytes], machines: tuple[Automaton, ...]) -> dict:
    """Base places and labels, and spans (label, kind, start, end in words) of the templates that match."""
    places, base, spans = [], set(), []
    have = set(words)
    if b"license" in have:
        for phrase, label in PHRASES:
            p = phrase.encode().split()
            found = [i for i, w in enumerate(words) if w == p[0] and words[i : i + len(p)] == p] if p[0] in have else []
            places += found
            if found:
                base.add(label)
    for a in machines:
        if a.mandatory <= have:
            done = 0  # matches of one template do not overlap
            for i in a.starts(words, have):
                if i >= done and (end := a.match(words, i)) is not None:
                    spans.append((a.label, a.kind, i, end))
                    done = end
    return {
        "n_words": len(words),
        "n_base": len(places),
        "first_word": min(places, default=None),
        "last_word": max(places, default=None),
        "base_labels": sorted(base),
        "spans": sorted(set(spans), key=lambda s: (s[2], s[3], s[0], s[1])),
        "score": max([SCORES[s[1]] for s in spans], default=BASE_SCORE if base else 0.0),
    }


SPAN = T.StructType([T.StructField("label", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
SCHEMA = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(SPAN)),
    T.StructField("score", T.DoubleType()),
]
_ARROW = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("label", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])), pa.float64()]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str, str], ...] | None = None) -> DataFrame:
    """One row per document: word count, base phrase places and labels, template spans, and the score of the best match (``SCORES``, ``BASE_SCORE``), else 0.

    ``templates``: (label, kind, template); those of this module and its files if not given.
    """
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = [f.name for f in SCHEMA]
    shared = docs.sparkSession.sparkContext.broadcast(TEMPLATES + file_templates() if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = automata(shared.value)
        for b in batches:
            found = [scan_words(license_words(t), machines) for t in text_bytes(b.column(1))]
            for f in found:
                f["spans"] = [{"label": x, "kind": kind, "start": s, "end": e} for x, kind, s, e in f["spans"]]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([f[n] for f in found], t) for n, t in zip(names, _ARROW, strict=True))], names=["id", *names])

    return kept.mapInArrow(tidy(run), T.StructType([kept.schema["id"], *SCHEMA])).withColumnRenamed("id", id_col)


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Labels as comma-joined text: the base ones, and those with the templates' labels."""
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.transform("spans", lambda x: x.label))))
    return scanned.select(id_col, "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), "score")
