"""Toxicity: a weighted lexicon matched by Aho-Corasick in folded texts.

Folding takes compatibility forms and accents off, lower-cases, removes invisible characters, maps letters of other scripts that look like Latin
ones (homoglyphs) and digits and signs that stand for letters inside words to these letters; i and l, which share stand-ins, become one. What isn't a
letter then divides words, which are joined by single spaces, with a space before and behind. A lexicon entry is a stem (" stem") or a word
(" word "), so that one automaton finds both at words' edges. Exception phrases are entries too: a match inside one doesn't count.

Weights are learned from at most `max_rows` labelled rows, those of smallest hash: stems and words are added one by one, by how much
each, standing in a row at all or densely, raises the likelihood of the labels beyond those already there, until none is worth its place; a
weight is the logarithm of how much more often the term occurs in rows of label 1. Phrases of a lexicon word and a
neighbour that stand in clean rows only become exceptions. A text's rate is the sum of its matches' weights for each hundred words (of at
least 20); the score is a logistic function of its logarithm and of that of the sum itself.

Null, empty and wordless texts have no matches and get the score of a clean text. Without labelled rows of both classes there is no lexicon and all scores are
the share of label 1 (0.5 if there are no rows). Repeated rows are scored each, of texts of one id one is learned from; empty tables give an empty result. Long texts are folded in
pieces cut at white space. Other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnweave.llm.shared import by_bytes, free, saved

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "ё": "e", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѡ": "w", "г": "r", "п": "n", "ь": "b",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "σ": "o",
    "ɑ": "a", "ɡ": "g", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ß": "ss", "æ": "ae", "œ": "oe", "ʟ": "l", "ɪ": "i", "ʀ": "r", "ɴ": "n", "օ": "o", "ս": "u", "հ": "h",
}
#: Digits and signs that stand for letters.
DIGITS = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "+": "t"}
#: A sign stands for a letter before a letter or digit, not at a word's end.
_SIGN = re.compile("[" + re.escape("".join(SIGNS)) + r"](?=[" + re.escape("".join(SIGNS)) + r"]*[^\W_])")
_INVISIBLE = dict.fromkeys(map(ord, "­͏؜​‌‍⁠⁡⁢⁣︎️﻿"))
_PLAIN = {ord(k): v for k, v in (HOMOGLYPHS | DIGITS).items()} | {ord("l"): "i"}
_LETTERS = re.compile(r"[^a-z]+")
#: Words of digits only are numbers, not disguised words.
_NUMBER = re.compile(r"(?<![^\W_])[0-9]+(?![^\W_])")

STEMS = range(3, 11)
#: Matches for each hundred words from which a term is dense in a text.
DENSE = 1.0
#: What a term must add to the log likelihood of the labels, and in how many rows of label 1 it must stand.
LEAST_GAIN, LEAST_ROWS = 9.0, 4
MAX_TERMS, MAX_CANDIDATES = 256, 2048
LEAST_WORDS = 20
PIECE = 1 << 20


class _Folded(dict):
    """For str.translate: what a character beyond ASCII folds to, worked out once."""

    def __missing__(self, code: int) -> str:
        out = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)).lower()
        self[code] = out = "".join(_PLAIN.get(ord(c), c) for c in out)
        return out


_TABLE = _Folded({k: chr(k).lower() for k in range(128)} | _INVISIBLE | _PLAIN | {ord("L"): "i"})


def folded(text: str) -> str:
    """The text's words in folded form, a space before and behind each."""
    if any(c in text for c in SIGNS):
        text = _SIGN.sub(lambda m: SIGNS[m[0]], text)
    return " " + _LETTERS.sub(" ", _NUMBER.sub(" ", text).translate(_TABLE)).strip() + " "


def pieces(text: str, limit: int = PIECE) -> Iterator[str]:
    """The text in pieces of about `limit` characters, cut at white space."""
    start = 0
    while len(text) - start > limit and (space := re.compile(r"\s").search(text, start + limit)):
        yield text[start : space.start()]
        start = space.start()
    yield text[start:]


@dataclass
class Lexicon:
    """terms: entries in folded form and their weights; exceptions: folded phrases, a space before and behind; coefficients: of 1, the rate's and the sum's logarithm."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    coefficients: tuple[float, float, float] = (0.0, 0.0, 0.0)


def entry(text: str, stem: bool = False) -> str:
    """A word or phrase as an entry; a stem is open at its end."""
    return folded(text)[: -1 if stem else None]


@lru_cache(4)
def _automaton(terms: tuple[str, ...], exceptions: frozenset[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for k, t in enumerate(terms):
        out.add_word(t, (k, len(t)))
    for x in exceptions:
        out.add_word(x, (-1, len(x)))
    if len(out):
        out.make_automaton()
    return out


def matches(text: str, terms: tuple[str, ...], exceptions: frozenset[str] = frozenset()) -> list[tuple[int, int, int]]:
    """The matches of terms in a folded text, as (number, start, end), but for those inside an exception phrase."""
    automaton, found, spared = _automaton(terms, exceptions), [], []
    if not len(automaton):
        return found
    for end, (k, size) in automaton.iter(text):
        (found if k >= 0 else spared).append((k, end + 1 - size, end + 1))
    if spared and found:
        found = [m for m in found if not any(a <= m[1] and m[2] <= b for _, a, b in spared)]
    return found


def evidence(text: str | None, lexicon: Lexicon) -> tuple[float, int, int]:
    """Of a text: the sum of its matches' weights, its matches, its words. Of several entries that begin at the same place the heaviest counts."""
    terms = tuple(lexicon.terms)
    weights = list(lexicon.terms.values())
    total, n, words = 0.0, 0, 0
    for piece in pieces(text or ""):
        found = matches(whole := folded(piece), terms, lexicon.exceptions)
        words += max(0, whole.count(" ") - 1)
        best: dict[int, float] = {}
        for k, start, _ in found:
            best[start] = max(best.get(start, 0.0), weights[k])
        total += sum(best.values())
        n += len(best)
    return total, n, words


def _inputs(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(total.size), np.log1p(100 * total / np.maximum(words, LEAST_WORDS)), np.log1p(total)], 1)


def _probability(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _newton(x: np.ndarray, y: np.ndarray, ridge: np.ndarray, rounds: int = 25) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = _probability(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _entries(word: str) -> Iterator[str]:
    yield f" {word} "
    for n in STEMS:
        if len(word) > n:
            yield f" {word[:n]}"


def _entry_counts(text: str | None) -> tuple[dict[str, int], float]:
    """How often each possible entry stands in a text, and how often that must be to be dense."""
    words: Counter[str] = Counter()
    for piece in pieces(text or ""):
        words.update(folded(piece).split())
    out: dict[str, int] = {}
    for w, n in words.items():
        if len(w) >= STEMS[0]:
            for e in _entries(w):
                out[e] = out.get(e, 0) + n
    return out, DENSE * max(LEAST_WORDS, words.total()) / 100


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (label, text) to (entry, ones, zeros, dense_ones, dense_zeros): in how many rows of either label an entry stands, and densely so, for each task's share of rows."""
    counts: dict[str, list[int]] = {}

    def out() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in range(4))], ["entry", "ones", "zeros", "dense_ones", "dense_zeros"])
        counts.clear()
        return made

    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own, dense = _entry_counts(text)
            for e, n in own.items():
                c = counts.setdefault(e, [0, 0, 0, 0])
                c[1 - label] += 1
                c[3 - label] += n >= dense
            if len(counts) > 1 << 20:
                yield out()
    yield out()


def _gain(ones: np.ndarray, zeros: np.ndarray, share: float) -> np.ndarray:
    """What a constant of their own adds to the log likelihood of such rows."""
    n = np.maximum(ones + zeros, 1e-9)
    p = np.clip(ones / n, 1e-9, 1 - 1e-9)
    return ones * np.log(p / share) + zeros * np.log((1 - p) / (1 - share))


def _select(has: np.ndarray, y: np.ndarray, names: list[str]) -> list[int]:
    """Terms one by one: that which explains most of the rows of label 1 that none of those before stands in; of equal ones the longest. Clean rows count in full."""
    open_rows, chosen = np.ones(y.size, bool), []
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    length = np.array([len(n) for n in names])
    zeros = has[y == 0].sum(0, dtype=np.int64)
    while len(chosen) < MAX_TERMS:
        ones = has[open_rows & (y == 1)].sum(0, dtype=np.int64)
        gain = np.where((ones >= LEAST_ROWS) & (ones > 4 * zeros * share), _gain(ones, zeros, share), 0)
        best = int(np.lexsort((-length, -gain.round(6)))[0])
        if gain[best] < LEAST_GAIN:
            break
        chosen.append(best)
        open_rows &= ~has[:, best]
    return chosen


def _more(has: np.ndarray, y: np.ndarray, names: list[str], chosen: list[int]) -> list[int]:
    """Chosen terms, and others that stand in rows of label 1 only (one in a hundred may be of the other), nearly as often as the most frequent chosen one, behind which they may be hidden."""
    if not chosen:
        return chosen
    ones, zeros = has[y == 1].sum(0, dtype=np.int64), has[y == 0].sum(0, dtype=np.int64)
    out = list(chosen)
    for k in np.lexsort((-np.array([len(n) for n in names]), -ones)):
        if len(out) < MAX_TERMS and ones[k] >= max(LEAST_ROWS, 0.3 * ones[chosen].max()) and zeros[k] <= 0.01 * ones[k]:
            if not any(names[k].startswith(names[c].rstrip()) or names[c].startswith(names[k].rstrip()) for c in out):
                out.append(int(k))
    return out


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", may_learn: Column | None = None, max_rows: int = 8192, exceptions: frozenset[str] | tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> Lexicon:
    """A lexicon from at most `max_rows` labelled rows; what comes to the driver is bounded by it and by MAX_CANDIDATES. `exceptions` are phrases of the caller."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    if may_learn is not None:
        known = known.where(may_learn)
    some = known.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).orderBy(F.xxhash64("id"), "id", "label").limit(max_rows)
    # At most max_rows rows, whose ids are sent to all tasks; of several texts of one id one is learned from.
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some.select("id").distinct()), "id", "left_semi")
    texts = texts.groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    texts = saved(texts.join(F.broadcast(some), "id").select("label", "text"), "toxicity-sample")
    counts = texts.mapInArrow(_counted, "entry string, ones long, zeros long, dense_ones long, dense_zeros long").groupBy("entry").agg(*(F.sum(c).alias(c) for c in ("ones", "zeros", "dense_ones", "dense_zeros")))
    kinds = [(F.col(a) >= LEAST_ROWS) & (F.col(a) > 2 * F.col(b)) for a, b in (("ones", "zeros"), ("dense_ones", "dense_zeros"))]
    value = F.greatest(*(F.when(k, F.col(a) * F.log((F.col(a) + 1) / (F.col(b) + 0.5))).otherwise(0) for k, (a, b) in zip(kinds, (("ones", "zeros"), ("dense_ones", "dense_zeros")))))
    # Frequent in one class, rare in the other; of equal ones the longest, as its stems add nothing.
    names = [r.entry for r in counts.where(kinds[0] | kinds[1]).orderBy(value.desc(), F.length("entry").desc(), "entry").limit(MAX_CANDIDATES).collect()]
    spared = frozenset(folded(x) for x in exceptions)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = []
            for text in batch.column(1).to_pylist():
                own, dense = _entry_counts(text)
                n = np.array([own.get(e, 0) for e in names])
                bits.append(np.packbits(np.concatenate([n > 0, n >= dense])).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], ["label", "bits"])

    found = texts.mapInArrow(rows_of, "label int, bits binary").toArrow()
    y = np.asarray(found.column("label"), np.int64)
    share = float((y.sum() + 1) / (y.size + 2))
    lexicon = Lexicon({}, spared, (float(np.log(share / (1 - share))), 0.0, 0.0))
    if names and 0 < y.sum() < y.size:
        # Twice as many columns as names: a term stands in a row, or stands there densely.
        has = np.stack([np.unpackbits(np.frombuffer(x, np.uint8), count=2 * len(names)) for x in found.column("bits").to_pylist()]).astype(bool)
        twice = names + names
        chosen = [twice[k] for k in _more(has, y, twice, _select(has, y, twice))]
        if chosen:
            lexicon.terms = _weights(texts, list(dict.fromkeys(chosen)), y)
            lexicon.exceptions = spared | _phrases(texts, lexicon.terms)
            sums = texts.mapInArrow(_summed(lexicon), "label int, total double, words long").toArrow().sort_by([("label", "ascending"), ("total", "ascending"), ("words", "ascending")])
            x = _inputs(np.asarray(sums.column("total")), np.asarray(sums.column("words")))
            lexicon.coefficients = tuple(map(float, _newton(x, np.asarray(sums.column("label"), np.float64), np.array([1e-3, 1e-2, 1e-2]))))
    free(texts)
    return lexicon


def _weights(texts: DataFrame, terms: list[str], y: np.ndarray) -> dict[str, float]:
    """How much more often, as a logarithm, each term occurs in a row of label 1 than in one of label 0."""
    known = tuple(terms)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(known), 2), np.int64)
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for piece in pieces(text or ""):
                    for k, _, _ in matches(folded(piece), known):
                        counts[k, label] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(known))), pa.array(counts[:, 1].copy()), pa.array(counts[:, 0].copy())], ["term", "ones", "zeros"])

    rows = texts.mapInArrow(found, "term long, ones long, zeros long").groupBy("term").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros")).orderBy("term").collect()
    n = int(y.sum())
    weight = {known[r.term]: float(np.log((r.ones + 0.5) / (n + 1)) - np.log((r.zeros + 0.5) / (y.size - n + 1))) for r in rows}
    return {t: w for t, w in weight.items() if w > 0}


def _phrases(texts: DataFrame, terms: dict[str, float]) -> frozenset[str]:
    """Two-word phrases of a whole-word term and a neighbour that stand in at least three clean rows, and in nearly no others."""
    known = tuple(t for t in terms if t.endswith(" "))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = set()
                for piece in pieces(text or ""):
                    for _, start, end in matches(whole := folded(piece), known):
                        stop = whole.index(" ", start + 1)
                        before, after = whole.rfind(" ", 0, start), whole.find(" ", stop + 1)
                        own |= {whole[a : b + 1] for a, b in ((before, stop), (start, after)) if a >= 0 and b >= 0}
                out += [(x, label) for x in own]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([y for _, y in out], pa.int32())], ["phrase", "label"])

    counts = texts.mapInArrow(found, "phrase string, label int").groupBy("phrase").agg(F.sum("label").alias("ones"), F.sum(1 - F.col("label")).alias("zeros"))
    best = counts.where("zeros >= 3 and ones <= 0.02 * zeros").orderBy(F.col("zeros").desc(), "phrase").limit(MAX_TERMS)
    return frozenset(r.phrase for r in best.collect())


def _summed(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [evidence(t, lexicon) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in got], pa.float64()), pa.array([x[2] for x in got], pa.int64())], ["label", "total", "words"])

    return run


def toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, n_words, n_matches, weight (the matches' sum), score (the probability of label 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in by_bytes(batch):
                got = [evidence(t, own) for t in part.column(1).cast(pa.large_string()).to_pylist()]
                total, n, words = (np.array([x[k] for x in got]) for k in range(3))
                score = _probability(_inputs(total, words) @ np.array(own.coefficients))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(total.astype(np.float64)), pa.array(score)], ["id", "n_words", "n_matches", "weight", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_words long, n_matches long, weight double, score double").withColumnRenamed("id", id_col)
