"""Toxicity by noisy-channel deobfuscation.

A character trigram model is counted over all documents. Tokens that look written in
disguise (digits, signs or look-alike letters of another script for letters, letters set
apart, letters repeated) become lattices: each place offers its own character and what
it may stand for, separators may vanish and repeated letters may collapse, each at a
channel cost. Viterbi search finds the most likely reading under channel and language
model; other tokens read as they are. Single letters that follow one another are read as
one token. The restored words are scored: each character n-gram of a word carries the
confident log odds of toxic against other documents, a word takes the largest of its
n-grams, and a logistic function of the two most telling words gives the score.

What is learnt from labels uses only rows whose crc32(id as text) mod 3 is not 1, and of
them a sample of at most about ``max_train`` documents, chosen by hash. Of the n-grams of
toxic documents those count that stand in at least 3 of them and in one of 500, so that
there are at most 500 for each n-gram of a document; none of these is left out. The
language model's counts cover every document.

Defined results: null and empty texts have no words and get the score of no evidence;
repeated rows score alike; a document labelled more than once is toxic if any label is;
without labelled toxic rows every score is 0; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.common import checkpointed, tidy

#: What a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
#: Letters of other scripts that look like Latin ones.
LOOK_ALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d", "к": "k", "м": "m", "т": "t", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u"}
SEPARATORS = ".-_*~ '·"
#: Channel costs (negative log probabilities).
SIGN_COST, DROP_COST, REPEAT_COST, OTHER_COST = 1.5, 0.5, 0.2, 9.0

_STRIP = " \t\n\r\x0b\x0c.,;:?!\"'`()[]{}<>|*&%#~^=/\\-_+"
_LETTER = r"[^\W\d_]"
_ALIKE = "".join(LOOK_ALIKES)
#: A token is read as a lattice if it has a letter, and a sign or a look-alike next to a letter, or a letter three times in a row, or separators between letters.
DISGUISED = re.compile(rf"(?:{_LETTER}[0-9@$!|+(€£¡]|[0-9@$!|+(€£¡]{_LETTER}|({_LETTER})\1\1|{_LETTER}[.\-_*~'·]{_LETTER}|[a-z][{_ALIKE}]|[{_ALIKE}][a-z])")
REPEATED = re.compile(r"(.)\1\1")  # all that is left of it for ASCII letters
#: A token of single letters or signs with separators between them.
SINGLES = re.compile(rf"(?:{_LETTER}|[0-9@$!])(?:[.\-_*~·]{{1,2}}(?:{_LETTER}|[0-9@$!]))*")
#: Marks around such a token, and how many letters in a row are one word set apart.
_AROUND, APART = ".,;:?\"'`()[]{}<>|*&%#~^=/\\-_·", 4

#: Symbols of the language model: 0 for what is no letter, a-z, and 32 classes of other letters.
SYMBOLS = 59


def symbols(text: str) -> np.ndarray:
    """Symbol of each code point of lower-cased text."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ascii_letter = (cp >= 97) & (cp <= 122)
    return np.where(ascii_letter, cp - 96, np.where(cp >= 0xC0, 27 + (cp & 31), 0)).astype(np.int64)


def trigram_counts(texts: Iterable[str | None], chunk: int = 500_000) -> np.ndarray:
    """Counts of symbol trigrams; texts are set apart by spaces. So many characters are worked on at once."""
    total = np.zeros(SYMBOLS**3, np.int64)

    def add(some: list[str]) -> None:
        s = symbols("  ".join(["", *some, ""]))
        for at in range(0, len(s) - 2, chunk):
            x = s[at : at + chunk + 2]
            np.add(total, np.bincount((x[:-2] * SYMBOLS + x[1:-1]) * SYMBOLS + x[2:], minlength=SYMBOLS**3), out=total)

    held, size = [], 0
    for t in texts:
        if t:
            held.append(t.lower())
            size += len(t)
        if size >= chunk:
            add(held)
            held, size = [], 0
    if held:
        add(held)
    return total


def language_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Negative log probabilities [a, b, c] of symbol c after a and b, smoothed by bigram and unigram shares. Counted over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for b in batches:
            total += trigram_counts(b.column(0).to_pylist())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    rows = docs.select(text_col).mapInArrow(tidy(count), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()  # at most SYMBOLS ** 3
    n = np.zeros(SYMBOLS**3)
    n[rows.column("gram").to_numpy()] = rows.column("n").to_numpy()
    return smoothed(n.reshape(SYMBOLS, SYMBOLS, SYMBOLS))


def smoothed(n3: np.ndarray, weight: float = 20.0) -> np.ndarray:
    n2, n1 = n3.sum(axis=0), n3.sum(axis=(0, 1))
    p1 = (n1 + 1) / (n1.sum() + SYMBOLS)
    p2 = (n2 + weight * p1) / (n2.sum(axis=1, keepdims=True) + weight)
    p3 = (n3 + weight * p2) / (n3.sum(axis=2, keepdims=True) + weight)
    return -np.log(p3)


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Options (text, channel cost) of each place: a run of one character may collapse, a separator may vanish."""
    out: list[list[tuple[str, float]]] = []
    for m in re.finditer(r"(.)\1*", token, re.S):
        ch, n = m[1], len(m[0])
        if ch in SEPARATORS:
            out.append([("", DROP_COST)] + ([(m[0], 0.0)] if ch == "'" else []))
            continue
        options = [(ch * k, REPEAT_COST * (n - k)) for k in ({1, 2, n} if n > 2 else {n})]
        for sign in LEET.get(ch, LOOK_ALIKES.get(ch, "")):
            options += [(sign * k, SIGN_COST + REPEAT_COST * (n - k)) for k in ({1, 2} if n > 1 else {1})]
        out.append(options)
    return out


def decode(token: str, costs: list) -> str:
    """The most likely reading of a lower-case token: Viterbi search whose states are the last two symbols. ``costs``: the model as nested lists."""
    best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}  # cost, and the reading as (reading before, piece)
    for options in lattice(token):
        after: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (cost, read) in best.items():
            for piece, channel in options:
                x, y, c = a, b, cost + channel
                for ch in piece:
                    z = _symbol(ch)
                    c += costs[x][y][z] if z else OTHER_COST  # what is no letter has no place in a word
                    x, y = y, z
                if (x, y) not in after or c < after[x, y][0]:
                    after[x, y] = (c, (read, piece))
        best = after

    def text(read: tuple) -> str:
        out = []
        while read:
            read, piece = read
            out.append(piece)
        return "".join(reversed(out))

    ends = [(c + costs[a][b][0], read) for (a, b), (c, read) in best.items()]
    least = min(c for c, _ in ends)
    return min(text(read) for c, read in ends if c == least)


def _symbol(ch: str) -> int:
    cp = ord(ch)
    return cp - 96 if 97 <= cp <= 122 else 27 + (cp & 31) if cp >= 0xC0 else 0


class Restorer:
    """Restored words of texts, remembered until there are ``keep`` tokens at the start of a text."""

    def __init__(self, costs: np.ndarray, keep: int = 300_000) -> None:
        self.costs, self.keep = costs.tolist(), keep
        self.cache: dict[str, str] = {}
        self.singles: dict[str, str] = {}  # of tokens of single letters, these

    def word(self, token: str) -> str:
        """One token without the marks around it, read through the lattice if it is disguised."""
        core = token.strip(_STRIP)
        if core.isalpha() and not (REPEATED if core.isascii() else DISGUISED).search(core):
            return core
        if not any(c.isalpha() for c in token):
            return core
        read = token.rstrip(_STRIP).lstrip(re.sub(r"[|+(!]", "", _STRIP))
        read = re.sub(r"[$@]+$", "", read)  # signs at the end are marks; elsewhere they may be letters
        return decode(read, self.costs).strip(_STRIP) if DISGUISED.search(read) else core

    def tokens(self, text: str) -> list[str]:
        if len(self.cache) >= self.keep:
            self.cache.clear()
            self.singles.clear()
        return text.lower().split()

    def learn(self, tokens: Iterable[str]) -> None:
        for token in tokens:
            self.cache[token] = self.word(token)
            core = token.strip(_AROUND)
            if SINGLES.fullmatch(core):
                self.singles[token] = re.sub(r"[.\-_*~·]", "", core)

    def apart(self, tokens: list[str]) -> set[str]:
        """Words whose letters are set apart: runs of tokens of single letters, with a letter in them, read as one."""
        out = set()
        singles = self.singles
        at = [i for i, t in enumerate(tokens) if t in singles]
        start = 0
        for k in range(1, len(at) + 1):
            if k == len(at) or at[k] != at[k - 1] + 1:
                if k - start > 1:
                    joined = "".join([singles[tokens[i]] for i in at[start:k]])
                    if len(joined) >= APART and any(c.isalpha() for c in joined):
                        out.add(decode(joined, self.costs))
                start = k
        return out

    def words(self, text: str | None) -> set[str]:
        """The distinct restored words of a whole text."""
        if not text:
            return set()
        tokens = self.tokens(text)
        distinct = set(tokens)
        self.learn(distinct.difference(self.cache))
        out = set(map(self.cache.__getitem__, distinct))
        if not self.singles.keys().isdisjoint(distinct):
            out |= self.apart(tokens)
        out.discard("")
        return out


def grams(word: str) -> set[str]:
    """Character n-grams of 4 to 7 of a word between marks, and the whole of a shorter one."""
    w = f"^{word}$"
    return {w[i : i + n] for n in (4, 5, 6, 7) for i in range(len(w) - n + 1)} or {w}


def held_out(id_col: str) -> F.Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1


def _gram_counts(train: DataFrame, among: frozenset[str] | None) -> DataFrame:
    """(gram, n): documents of ``train`` (column words) that hold each n-gram, of ``among`` where given."""
    shared = train.sparkSession.sparkContext.broadcast(among)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only, total, cache = shared.value, Counter(), {}
        for b in batches:
            for words in b.column(0).to_pylist():
                have = set()
                for w in words:
                    if (g := cache.get(w)) is None:
                        g = grams(w) if only is None else grams(w) & only
                        if len(cache) > 200_000:
                            cache.clear()
                        cache[w] = g
                    have |= g
                total.update(have)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["gram", "n"])

    return train.select("words").mapInArrow(tidy(count), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def confident_odds(toxic: np.ndarray, n_toxic: int, other: np.ndarray, n_other: int) -> np.ndarray:
    """Log odds of n-grams, with each count moved by two standard deviations towards no evidence."""
    low = (np.maximum(toxic - 2 * np.sqrt(toxic), 0.0) + 0.1) / (n_toxic + 1)
    high = (other + 2 * np.sqrt(other) + 1.0) / (n_other + 1)
    return np.log(low) - np.log(high)


class Telling:
    """Weights of the words of texts. Tokens without one are remembered as such, so that most of a text is passed over at once."""

    def __init__(self, restorer: Restorer | None, weights: dict[str, float], keep: int = 300_000) -> None:
        self.restorer, self.weights, self.keep = restorer, weights, keep
        self.starts = {g[:4] for g in weights}
        self.cache: dict[str, float] = {}
        self.plain: set[str] = set()

    def weight(self, word: str) -> float:
        """The largest weight of a word's n-grams, 0 without one."""
        x = self.cache.get(word)
        if x is None:
            w = f"^{word}$"
            if len(w) >= 4 and self.starts.isdisjoint([w[i : i + 4] for i in range(len(w) - 3)]):
                x = 0.0  # each n-gram with a weight begins with one of these
            else:
                x = max((self.weights.get(g, 0.0) for g in grams(word)), default=0.0)
            if len(self.cache) >= self.keep:
                self.cache.clear()
            self.cache[word] = x
        return x

    def features(self, text: str | None) -> tuple[float, float]:
        """The weights of the two most telling words (0 if there is none)."""
        if not text:
            return 0.0, 0.0
        restorer = self.restorer
        tokens = restorer.tokens(text)
        if len(self.plain) >= self.keep:
            self.plain.clear()
        found: dict[str, float] = {}
        some_apart = False
        for t in set(tokens).difference(self.plain):
            if t not in restorer.cache:
                restorer.learn((t,))
            word = restorer.cache[t]
            x = self.weight(word) if word else 0.0
            if t in restorer.singles:
                some_apart = True
            elif not x:
                self.plain.add(t)
            if x:
                found[word] = x
        if some_apart:
            found |= {w: x for w in restorer.apart(tokens) if w and (x := self.weight(w))}
        best = sorted(found.values(), reverse=True)[:2]
        return (*best, 0.0, 0.0)[:2]


def features(words: Iterable[str], weight: Callable[[str], float]) -> tuple[float, float]:
    """The same for words that are restored already."""
    best = sorted(map(weight, words), reverse=True)[:2]
    return (*best, 0.0, 0.0)[:2]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Coefficients (bias first) by Newton's method, without a penalty on the bias."""
    a = np.c_[np.ones(len(x)), x]
    beta = np.zeros(a.shape[1])
    penalty = np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + penalty
        step = np.linalg.solve(h, a.T @ (y - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = 24_000
) -> DataFrame:
    """One row per document: id, held_out, score (0 to 1), predicted (1 if score >= 0.7), evidence (the most telling word's weight)."""
    spark = docs.sparkSession
    costs = spark.sparkContext.broadcast(language_model(docs, text_col))
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(F.max(label_col).alias("y")).where(~held_out("label_id"))
    n_known = known.count()
    if n_known > max_train:
        known = known.where(F.pmod(F.xxhash64(F.lit(1), "label_id"), F.lit(1_000_000)) < int(1_000_000 * max_train / n_known))
    known = F.broadcast(known)  # about max_train narrow rows
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(costs.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(restorer.words(t)) for t in b.column(0).to_pylist()], pa.list_(pa.string())), b.column(1)], names=["words", "y"])

    train = checkpointed(rows.join(known, F.col("id") == F.col("label_id")).select("text", F.col("y").cast("int").alias("y")).mapInArrow(tidy(restore), "words array<string>, y int"))
    sizes = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_toxic = sum(n for y, n in sizes.items() if y > 0)
    n_other = sum(n for y, n in sizes.items() if y <= 0)
    weights: dict[str, float] = {}
    beta = np.array([-30.0, 0.0, 0.0])
    if n_toxic and n_other:
        least = max(3, n_toxic // 500)
        top = _gram_counts(train.where("y > 0"), None).where(F.col("n") >= least).toArrow()
        names = top.column("gram").to_pylist()
        other = dict(zip(*(_gram_counts(train.where("y <= 0"), frozenset(names)).toArrow().to_pydict().values()), strict=True))
        odds = confident_odds(top.column("n").to_numpy().astype(float), n_toxic, np.array([other.get(g, 0) for g in names], float), n_other)
        weights = {g: float(w) for g, w in zip(names, odds, strict=True) if w > 0.5}
        model = spark.sparkContext.broadcast(weights)

        def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weight = Telling(None, model.value).weight
            for b in batches:
                f = [features(w, weight) for w in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in f], pa.float64()), pa.array([x for _, x in f], pa.float64()), b.column(1)], names=["f1", "f2", "y"])

        points = train.mapInArrow(tidy(featured), "f1 double, f2 double, y int").toArrow()  # about max_train rows of three numbers
        x = np.c_[points.column("f1").to_numpy(), points.column("f2").to_numpy()]
        beta = fit_logistic(x, (points.column("y").to_numpy() > 0).astype(float))
    model = spark.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        telling = Telling(Restorer(costs.value), model.value)
        for b in batches:
            f = np.array([telling.features(t) for t in b.column(1).to_pylist()]).reshape(b.num_rows, 2)
            s = 1 / (1 + np.exp(-np.clip(beta[0] + f @ beta[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array(f[:, 0])], names=["id", "score", "evidence"])

    scored = rows.mapInArrow(tidy(score), T.StructType([rows.schema["id"], T.StructField("score", T.DoubleType()), T.StructField("evidence", T.DoubleType())]))
    return scored.select(F.col("id").alias(id_col), F.coalesce(held_out("id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "evidence")
