"""Quality rules by weak supervision.

Each rule looks at counts of a text and votes good (1), bad (-1) or abstains (0). Expectation-maximisation over the
counts of all vote patterns (at most 3 to the number of rules, whatever the corpus) estimates how often each rule is
right, without labels; a text is kept where its posterior probability of being good is at
least `least`. Texts that fail the base limits are never kept. A null or empty text has no words, so it fails the base.
Repeated rows get a row each; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnweave.llm.shared import SPACED, by_bytes, lowered, mixed, saved, strings, sums, text_bytes, words_of

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is it that for on was with as at by be this are from or an have not "
    "de la le et les des en un une du que qui dans pour pas sur par plus au aux est "
    "der die das und in den von zu mit sich auf für ist im dem nicht ein eine als auch "
    "el los las y del se por con una su para al lo como más"
).split()

STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_lower", "n_stop", "n_distinct", "n_marks")


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _MARK = _flags(b"#*$%&|<>"), _flags(b"!?")
_UPPER, _LOWER = _flags(bytes(range(65, 91))), _flags(bytes(range(97, 123)))
_CHAR = np.ones(256, bool)
_CHAR[128:192] = False


def _repeats(owner: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Marks the entries whose (owner, key) occurs twice or more."""
    key = mixed(key ^ mixed(owner.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    again = np.flatnonzero(np.diff(key[order]) == 0)
    out = np.zeros(key.size, bool)
    out[order[again]] = out[order[again + 1]] = True
    return out


def text_stats(raw: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """STATS of each text. Lines are split at line feeds; n_dup_lines counts lines with a word that equal an earlier one; n_repeat_words the words in 5-word windows found twice or more (windows are compared by 64-bit keys of exact word codes)."""
    inside = SPACED[raw]
    starts, ends, first = words_of(raw, at, SPACED)
    n_words = np.diff(first)
    words = strings(raw, starts, ends)
    coded = pc.dictionary_encode(words)
    code = coded.indices.to_numpy() if len(words) else np.zeros(0, np.int32)
    owner = np.repeat(np.arange(at.size - 1), n_words)
    out = {"n_words": n_words, "word_chars": sums((inside & _CHAR[raw]).astype(np.int8), at)}
    for name, flag in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_lower", _LOWER), ("n_marks", _MARK)):
        out[name] = sums(flag[raw].astype(np.int8), at)
    # lines that hold a word, by their first words
    breaks = np.append(np.flatnonzero(raw == 10), raw.size)
    before = np.searchsorted(breaks, starts)
    lead = np.flatnonzero(np.diff(before + owner, prepend=-1))
    of, before = owner[lead], before[lead]
    begin = np.maximum(at[of], np.where(before > 0, breaks[before - 1] + 1, 0))
    stop = np.minimum(at[of + 1], breaks[before])
    line = pc.dictionary_encode(strings(raw, begin, stop)).indices.to_numpy() if begin.size else np.zeros(0, np.int32)
    both = (of.astype(np.uint64) << np.uint64(32)) | line.astype(np.uint64)
    _, keep = np.unique(both, return_index=True)
    n_lines = np.bincount(of, minlength=at.size - 1)
    out["n_lines"], out["n_dup_lines"] = n_lines, n_lines - np.bincount(of[keep], minlength=at.size - 1)
    # windows of five words
    covered = np.zeros(code.size + 1, np.int32)
    if code.size >= 5:
        k = np.flatnonzero(owner[4:] == owner[:-4])
        key = np.zeros(k.size, np.uint64)
        for d in range(5):
            key = mixed(key * np.uint64(31) + code[k + d].astype(np.uint64) + np.uint64(1))
        k = k[_repeats(owner[k], key)]
        np.add.at(covered, k, 1)
        np.add.at(covered, k + 5, -1)
    out["n_repeat_words"] = sums((np.cumsum(covered[:-1]) > 0).astype(np.int8), first)
    # vocabulary
    if code.size:
        low = coded.dictionary
        body, where = text_bytes(low)
        small = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(low), [None, pa.py_buffer(np.ascontiguousarray(where)), pa.py_buffer(lowered(body))])
        stop_word = pc.is_in(small, pa.array([x.encode() for x in STOP_WORDS], pa.large_binary())).to_numpy(zero_copy_only=False)
        out["n_stop"] = sums(stop_word[code].astype(np.int8), first)
        pair = np.sort((owner.astype(np.uint64) << np.uint64(32)) | code.astype(np.uint64))
        pair = pair[np.diff(pair, prepend=np.uint64((1 << 64) - 1)) != 0]
        out["n_distinct"] = np.bincount((pair >> np.uint64(32)).astype(np.int64), minlength=at.size - 1)
    else:
        out["n_stop"] = out["n_distinct"] = np.zeros(at.size - 1, np.int64)
    return out


def document_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """STATS of every row, with its id."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch):
                got = text_stats(*text_bytes(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(got[x].astype(np.int64)) for x in STATS)], ["id", *STATS])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(count, f"id {kind}, " + ", ".join(f"{x} long" for x in STATS)).withColumnRenamed("id", id_col)


def _vote(bad: Column, good: Column | None = None) -> Column:
    """-1 where bad, 1 where good (most rules never say so: that a fault is missing tells little), else 0."""
    vote = F.when(bad, -1)
    return (vote if good is None else vote.when(good, 1)).otherwise(0)


def rules() -> dict[str, Column]:
    """The rules' votes over STATS."""
    c = F.col
    n = F.greatest(c("n_words"), F.lit(1))
    letters = F.greatest(c("n_upper") + c("n_lower"), F.lit(1))
    enough = c("n_words") >= 40
    return {
        "word_length": _vote((c("word_chars") < 2 * n) | (c("word_chars") > 14 * n)),
        "symbols": _vote(c("n_symbols") * 5 >= n),
        "dup_lines": _vote(c("n_dup_lines") * 2 > c("n_lines")),
        "repeats": _vote(c("n_repeat_words") * 5 > n),
        "capitals": _vote(c("n_upper") * 2 >= letters),
        "function_words": _vote(c("n_stop") * 25 < n, c("n_stop") * 12 >= n),
        "vocabulary": _vote(enough & (c("n_distinct") * 12 < n)),
        "marks": _vote(c("n_marks") * 3 >= n),
    }


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500, prior: float = 0.8, right: float = 0.85) -> tuple[float, np.ndarray]:
    """EM over vote patterns: the share of good texts, and the probability that each rule is right where it votes.

    Abstaining tells nothing. Pseudo-counts of a hundredth of the corpus (10 at least) hold the start values, so that rules that rarely vote keep theirs; a rule is taken to be right more often than not, so classes can't change places.
    """
    total = float(counts.sum())
    weight = max(10.0, 0.01 * total)
    accuracy, share = np.full(patterns.shape[1], right), prior
    voted = (patterns != 0).T @ counts
    for _ in range(rounds):
        odds = np.log(share / (1 - share)) + patterns @ np.log(accuracy / (1 - accuracy))
        good = 1 / (1 + np.exp(-odds))
        hits = ((patterns == 1).T @ (counts * good)) + ((patterns == -1).T @ (counts * (1 - good)))
        new = np.clip((hits + weight * right) / (voted + weight), 0.55, 0.99)
        moved, accuracy = abs(new - accuracy).max(), new
        share = float(np.clip((counts @ good + weight * prior) / (total + weight), 0.05, 0.95))
        if moved < 1e-7:
            break
    return share, accuracy


def judged(stats: DataFrame, least: float = 0.5) -> DataFrame:
    """stats with votes (a string of + - 0 by rule), base_failed, quality (the posterior probability) and kept."""
    votes = stats.withColumn("votes", F.concat(*(F.when(v == 1, "+").when(v == -1, "-").otherwise("0") for v in rules().values())))
    # Patterns, not rows, come to the driver: at most 3 ** len(rules()) of them.
    found = sorted((r.votes, r.n) for r in votes.groupBy("votes").agg(F.count("*").alias("n")).collect()) or [("0" * len(rules()), 1)]
    share, accuracy = fit(np.array([["-0+".index(x) - 1 for x in v] for v, _ in found]), np.array([n for _, n in found], float))
    odds = F.lit(float(np.log(share / (1 - share))))
    for k, w in enumerate(np.log(accuracy / (1 - accuracy))):
        at = F.substring("votes", k + 1, 1)
        odds = odds + F.when(at == "-", -float(w)).when(at == "+", float(w)).otherwise(0.0)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return votes.withColumn("base_failed", failed).withColumn("quality", 1 / (1 + F.exp(-odds))).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))


def quality_rules(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, STATS, votes, base_failed, quality, kept. Statistics are computed once and kept in the shared folder."""
    return judged(saved(document_stats(docs, id_col, text_col), "quality-stats"), least)
