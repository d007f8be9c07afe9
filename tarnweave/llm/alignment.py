"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes of a text.

Both tokenizers read a space and the text. Each byte gets a label: `.` (no token ends there), `a` (a token of the first vocabulary does), `b` (of
the second) or `x` (of both). A regular expression scans the labels of a text and cuts them into the spans up to each `x`; a
span's counts of `a` and `b` say how many tokens of either side form its group. A group links each of its first
tokens to each of its second ones; what a pair of ids is worth is the number of documents that hold it linked.

Texts that are null or empty, or that a tokenizer doesn't give back byte by byte (it changes or drops characters), have no tokens: zeros, and no
groups. Each row is a document, also if it repeats another. Empty tables give empty results; other columns are ignored. Texts are
cut where neither tokenizer joins anything, before most spaces; a segment that occurs often in a batch is encoded, labelled and scanned once. A group of many tokens is counted by distinct ids, so memory grows with a text and its distinct
pairs, not with its links.

Pairs are counted from each document's distinct pairs, which are kept in a table. The most frequent pairs are sent to all tasks, up to `broadcast_pairs` of them;
the others are joined by a shuffle, in which no pair has more rows than its count, which is small as it isn't among the frequent ones.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnweave.llm.shared import SPACED, by_bytes, free, offsets, saved, strings, text_bytes
from tarnweave.llm.token_counts import encoder, safe_pieces, token_bytes

#: Texts with more characters are encoded in pieces.
PIECE_CHARS = 1 << 16
#: Distinct segments that are encoded in one call.
TOGETHER = 1 << 12
#: Links of a group beyond which it is counted by distinct ids.
WIDE = 1 << 10
_BLANK = ~SPACED
_LABELS = np.frombuffer(b".abx", np.uint8)
#: Where a piece vocabulary may be cut if none of its pieces has a space behind something else.
_SPACE = re.compile(r"(?<=[^ ]) (?=[^ ])")


@dataclass
class Vocabulary:
    """encode: from a text to the ids of a space and the text; values: each id's bytes; may_split: whether no token has a space behind something that isn't white space."""

    encode: Callable[[str], np.ndarray]
    values: pa.Array
    may_split: bool

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(np.frombuffer(self.values.buffers()[1], np.int64, len(self.values) + 1))


def _pieces(text: str, limit: int) -> list[str]:
    """The text in pieces, cut before single spaces."""
    out, start = [], 0
    while len(text) - start > limit and (found := _SPACE.search(text, start + limit)):
        out.append(text[start : found.start()])
        start = found.start()
    return [*out, text[start:]]


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    """A byte-level BPE file (.json), which gets the space in front, or a sentencepiece model (.model), which adds it itself."""
    if not path.endswith(".model"):
        encode, may_split = encoder(path, plain=True)

        def encoded(text: str) -> np.ndarray:
            pieces = safe_pieces(" " + text, PIECE_CHARS) if may_split else [" " + text]
            return np.concatenate([np.array(encode(x), np.int64) for x in pieces])

        return Vocabulary(encoded, pa.array(token_bytes(path), pa.large_binary()), may_split)
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    values = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    may_split = not any("▁" in p.lstrip("▁") for p in pieces)
    space = [model.piece_to_id("▁")]

    def encoded(text: str) -> np.ndarray:
        # Of an empty text the model makes nothing, not even the space; a later piece begins with a space, which the model puts there itself.
        cut = _pieces(text, PIECE_CHARS) if may_split else [text]
        ids = model.encode([x[k > 0 :] for k, x in enumerate(cut)], num_threads=1) if text else [space]
        return np.concatenate([np.array(x, np.int64) for x in ids])

    return Vocabulary(encoded, pa.array(values, pa.large_binary()), may_split)


def _joined(values: pa.Array, ids: np.ndarray) -> np.ndarray:
    return text_bytes(values.take(pa.array(ids)))[0]


def group_sizes(ends_a: np.ndarray, ends_b: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From where tokens end in a row of texts, each of which ends both: each group's tokens of either side, and each text's groups. `at`: the n + 1 places where texts begin."""
    labels = np.zeros(at[-1], np.uint8)
    labels[ends_a - 1] = 1
    labels[ends_b - 1] += 2
    texts = pa.Array.from_buffers(pa.large_string(), at.size - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(_LABELS[labels])])
    spans = pc.split_pattern_regex(texts, "x")
    sizes = np.diff(np.asarray(spans.offsets))
    # A text's labels end in x, behind which there is nothing.
    inner = np.ones(int(sizes.sum()), bool)
    inner[np.cumsum(sizes) - 1] = False
    spans = spans.flatten().filter(pa.array(inner))
    return np.asarray(pc.count_substring(spans, "a"), np.int64) + 1, np.asarray(pc.count_substring(spans, "b"), np.int64) + 1, sizes - 1


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def pairs_of(a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct linked pairs of each text, as text, code (first id * width + second id) and how often they are linked; by text and code. in_a, in_b, text: of each group."""
    from_a, from_b, links = _starts(in_a), _starts(in_b), in_a * in_b
    few = np.flatnonzero(links <= WIDE)
    n = links[few]
    group = np.repeat(few, n)
    nth = np.arange(group.size) - np.repeat(_starts(n)[:-1], n)
    first = a[from_a[group] + nth // in_b[group]]
    second = b[from_b[group] + nth % in_b[group]]
    owner, codes, times = [text[group]], [first * width + second], [np.ones(group.size, np.int64)]
    for g in np.flatnonzero(links > WIDE):
        own_a, n_a = np.unique(a[from_a[g] : from_a[g + 1]], return_counts=True)
        own_b, n_b = np.unique(b[from_b[g] : from_b[g + 1]], return_counts=True)
        codes.append(np.add.outer(own_a * width, own_b).ravel())
        times.append(np.multiply.outer(n_a, n_b).ravel())
        owner.append(np.full(codes[-1].size, text[g]))
    owner, codes, times = map(np.concatenate, (owner, codes, times))
    order = np.lexsort((codes, owner))
    owner, codes, times = owner[order], codes[order], times[order]
    head = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (codes[1:] != codes[:-1])])) if codes.size else np.zeros(0, np.int64)
    return owner[head], codes[head], np.add.reduceat(times, head) if head.size else times


@lru_cache(2)
def _names(n_a: int, n_b: int) -> pa.Array:
    """Ids in decimal with what follows them: a comma or a bar for the first vocabulary, a comma or a semicolon for the second."""
    return pa.array([f"{k}{after}".encode() for n, after in ((n_a, ","), (n_a, "|"), (n_b, ","), (n_b, ";")) for k in range(n)], pa.large_binary())


def _cut_at(values: pa.Array, ends: np.ndarray) -> pa.Array:
    """Neighbouring binary values joined: `ends` has the n + 1 values at which the n joined ones begin and end."""
    raw, at = text_bytes(values)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), ends.size - 1, [None, pa.py_buffer(at[ends].astype(np.int64)), pa.py_buffer(raw)])


def group_texts(a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, n_groups: np.ndarray, n_a: int, n_b: int) -> pa.Array:
    """Each text's groups as `a1,a2|b1;a3|b2;`."""
    from_a, from_b = _starts(in_a), _starts(in_b)
    of_a, of_b = np.repeat(np.arange(in_a.size), in_a), np.repeat(np.arange(in_b.size), in_b)
    kind_a, kind_b = a.copy(), b + 2 * n_a
    kind_a[from_a[1:] - 1] += n_a
    kind_b[from_b[1:] - 1] += n_b
    order = np.empty(a.size + b.size, np.int64)
    order[np.arange(a.size) + from_b[of_a]] = kind_a
    order[np.arange(b.size) + from_a[of_b + 1]] = kind_b
    last = _starts(n_groups)
    return _cut_at(_names(n_a, n_b).take(pa.array(order)), from_a[last] + from_b[last])


def _ends_blank(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether the character before each place may be white space (beyond ASCII by its last bytes, and by more of them than need be)."""
    one, two, three = (raw[np.maximum(ends - d, 0)] for d in (1, 2, 3))
    wide = (two == 0xC2) & ((one == 0x85) | (one == 0xA0)) | (three == 0xE1) & (two == 0x9A) | (three == 0xE2) & ((two == 0x80) | (two == 0x81)) | (three == 0xE3) & (two == 0x80) & (one == 0x80)
    return _BLANK[one] | wide


def segment_starts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where texts, each of which begins with a space, can be cut for both tokenizers: before a space that follows a character that isn't white space."""
    spot = np.flatnonzero(raw == 32)
    return np.union1d(spot[~_ends_blank(raw, spot)], at[:-1])


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges in a row."""
    return np.repeat(starts - _starts(sizes)[:-1], sizes) + np.arange(int(sizes.sum()))


def _encoded(v: Vocabulary, raw: np.ndarray, at: np.ndarray, lo: int, hi: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The ids of segments lo to hi - 1, which follow one another: all ids, each segment's number of them, and whether they give back its bytes."""
    own = raw[at[lo] : at[hi]]
    ids = v.encode(own.tobytes().decode()[1:])
    ends = np.cumsum(v.sizes[ids])
    if ends[-1] == own.size and np.array_equal(_joined(v.values, ids), own):
        stops = np.searchsorted(ends, at[lo + 1 : hi + 1] - at[lo], side="right")
        if np.array_equal(ends[stops - 1], at[lo + 1 : hi + 1] - at[lo]):
            return [(ids, np.diff(np.concatenate([[0], stops])), np.ones(hi - lo, bool))]
    if hi - lo == 1:
        return [(ids, np.array([ids.size]), np.zeros(1, bool))]
    middle = (lo + hi) // 2
    return _encoded(v, raw, at, lo, middle) + _encoded(v, raw, at, middle, hi)


def _segments(found: pa.Array, first: Vocabulary, second: Vocabulary) -> dict[str, np.ndarray | pa.Array]:
    """Of distinct segments: whether both tokenizers give back their bytes, their tokens, groups, links, group texts and linked pairs (the segments' first pairs, codes, times).

    Segments are encoded many at a time, as they can follow one another like in a text; those that end in white space, as a text may, come last and one at a time.
    """
    n, n_a, n_b = len(found), len(first.values), len(second.values)
    raw, at = text_bytes(found)
    alone = _ends_blank(raw, at[1:])
    order = np.argsort(alone, kind="stable")
    raw, at = text_bytes(found.take(pa.array(order)))
    together = n - int(alone.sum()) if first.may_split and second.may_split else 0
    bounds = [*range(0, together, TOGETHER), *range(together, n + 1)]
    whole, parts = np.ones(n, bool), []
    for v in (first, second):
        done = [x for lo, hi in zip(bounds[:-1], bounds[1:]) for x in _encoded(v, raw, at, lo, hi)]
        ids, count, same = (np.concatenate([x[k] for x in done]) for k in range(3))
        whole &= same
        parts.append((ids, count))
    (a, count_a), (b, count_b) = ((ids[np.repeat(whole, count)], np.where(whole, count, 0)) for ids, count in parts)
    kept = np.flatnonzero(whole)
    in_a, in_b, groups = group_sizes(np.cumsum(first.sizes[a]), np.cumsum(second.sizes[b]), _starts(np.diff(at)[kept])) if kept.size else (np.zeros(0, np.int64),) * 3
    n_groups, n_links = np.zeros(n, np.int64), np.zeros(n, np.int64)
    n_groups[kept] = groups
    if kept.size:
        n_links[kept] = np.add.reduceat(in_a * in_b, _starts(groups)[:-1])
    owner, codes, times = pairs_of(a, b, in_a, in_b, np.repeat(kept, groups), n_b)
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    return {"of": back, "whole": whole, "n_a": count_a, "n_b": count_b, "n_groups": n_groups, "n_links": n_links, "groups": group_texts(a, b, in_a, in_b, n_groups, n_a, n_b), "pairs": np.searchsorted(owner, np.arange(n + 1)), "codes": codes, "times": times}


def _aligned(texts: pa.Array, first: Vocabulary, second: Vocabulary) -> dict[str, np.ndarray | list | pa.Array]:
    """A text's segments, each cut and labelled once however often it occurs, and what they add up to."""
    n = len(texts)
    used = np.flatnonzero(np.diff(offsets(texts)) > 0)
    out = {k: np.zeros(n, np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")} | {"groups": [None] * n, "pairs": np.zeros(n + 1, np.int64), "codes": np.zeros(0, np.int64), "times": np.zeros(0, np.int64)}
    if not used.size:
        return out
    raw, at = text_bytes(pc.binary_join_element_wise(pa.scalar(b"", pa.large_binary()), texts.take(pa.array(used)), pa.scalar(b" ", pa.large_binary())))
    starts = segment_starts(raw, at) if first.may_split and second.may_split else at[:-1]
    ends = np.append(starts[1:], raw.size)
    coded = strings(raw, starts, ends).dictionary_encode()
    own = _segments(coded.dictionary, first, second)
    which = own["of"][np.asarray(coded.indices, np.int64)]
    owner = np.searchsorted(at, starts, side="right") - 1
    fine = np.bincount(owner, ~own["whole"][which], used.size) == 0
    held = fine[owner]
    which, owner = which[held], np.cumsum(fine)[owner[held]] - 1
    used = used[fine]
    if not used.size:
        return out
    for k in ("n_a", "n_b", "n_groups", "n_links"):
        out[k][used] = np.bincount(owner, own[k][which], used.size).astype(np.int64)
    cut = np.searchsorted(owner, np.arange(used.size + 1))
    joined = _cut_at(own["groups"].take(pa.array(which)), cut)
    for k, x in zip(used, joined):
        out["groups"][k] = memoryview(x.as_buffer())[:-1]
    many = len(own["whole"])
    pair, times = np.unique(owner * many + which, return_counts=True)
    seg, doc = pair % many, pair // many
    size = np.diff(own["pairs"])[seg]
    place = _ranges(own["pairs"][seg], size)
    key = np.repeat(doc, size) * (len(first.values) * len(second.values)) + own["codes"][place]
    key, inverse = np.unique(key, return_inverse=True)
    doc, out["codes"] = np.divmod(key, len(first.values) * len(second.values))
    out["times"] = np.bincount(inverse, own["times"][place] * np.repeat(times, size), key.size).astype(np.int64)
    out["pairs"] = np.searchsorted(used[doc], np.arange(n + 1))
    return out


def align(docs: DataFrame, vocabulary_a: str, vocabulary_b: str, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """Per row: id_col, n_a, n_b, n_groups, n_links, groups (its SHA-256 in hexadecimal, or itself with `texts`; null without tokens), codes and times: its distinct linked
    pairs as first id * (size of the second vocabulary) + second id, and how often each is linked. Vocabularies are paths that executors can open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = vocabulary(vocabulary_a), vocabulary(vocabulary_b)
        for batch in batches:
            for part in by_bytes(batch, "text", 4 << 20):
                got = _aligned(part.column(1), first, second)
                groups = [x and (str(x, "ascii") if texts else sha256(x).hexdigest()) for x in got["groups"]]
                columns = [pa.array(got[k]) for k in ("n_a", "n_b", "n_groups", "n_links")]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns, pa.array(groups, pa.string()), *(pa.ListArray.from_arrays(pa.array(got["pairs"].astype(np.int32)), pa.array(got[k])) for k in ("codes", "times"))], ["id", "n_a", "n_b", "n_groups", "n_links", "groups", "codes", "times"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, codes array<long>, times array<long>"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def aligned(docs: DataFrame, vocabulary_a: str, vocabulary_b: str, id_col: str = "doc_id", text_col: str = "text", broadcast_pairs: int = 1 << 21) -> DataFrame:
    """Per row: id_col, n_a, n_b, n_groups, n_links, groups (SHA-256, null without tokens), n_best (links whose pair has the highest count that its first id has), count_sum (counts of its links' pairs, summed)."""
    width = len(vocabulary(vocabulary_b).values)
    rows = saved(align(docs, vocabulary_a, vocabulary_b, id_col, text_col).withColumn("row of pairs", F.monotonically_increasing_id()), "alignment")
    # Documents that hold a pair; combined before the shuffle.
    counts = saved(rows.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n")), "alignment-pairs")
    magnitude = F.length(F.bin("n")) - 1
    sizes = {r.m: r.k for r in counts.groupBy(magnitude.alias("m")).agg(F.count("*").alias("k")).collect()}
    least = max(sizes, default=-1) + 1
    while least > 0 and sum(k for m, k in sizes.items() if m >= least - 1) <= broadcast_pairs:
        least -= 1
    often = counts.where(F.col("n") >= 1 << least).toArrow().sort_by("code")
    # As many rows as the first vocabulary has ids at most.
    best = counts.groupBy(F.call_function("div", F.col("code"), F.lit(width)).alias("a")).agg(F.max("n").alias("n")).toArrow()
    top = np.zeros(len(vocabulary(vocabulary_a).values), np.int64)
    top[np.asarray(best.column("a"))] = np.asarray(best.column("n"))
    shared = docs.sparkSession.sparkContext.broadcast((np.asarray(often.column("code")), np.asarray(often.column("n")), top))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, value, top = shared.value
        for batch in batches:
            codes, times = batch.column("codes"), np.asarray(batch.column("times").flatten(), np.int64)
            at = np.asarray(codes.offsets, np.int64) - codes.offsets[0].as_py()
            codes = np.asarray(codes.flatten(), np.int64)
            place = np.minimum(np.searchsorted(known, codes), max(0, known.size - 1))
            found = known[place] == codes if known.size else np.zeros(codes.size, bool)
            n = np.where(found, value[place], 0) if known.size else np.zeros(codes.size, np.int64)
            total = lambda x: np.diff(_starts(x)[at])
            rest_at = pa.array(_starts(~found)[at].astype(np.int32))
            rest = [pa.ListArray.from_arrays(rest_at, pa.array(x[~found])) for x in (codes, times)]
            kept = [batch.column(c) for c in ("id", "n_a", "n_b", "n_groups", "n_links", "groups", "row of pairs")]
            sums = [pa.array(total(times * (found & (n == top[codes // width])))), pa.array(total(times * n))]
            yield pa.RecordBatch.from_arrays([*kept, *sums, *rest], ["id", "n_a", "n_b", "n_groups", "n_links", "groups", "row of pairs", "n_best", "count_sum", "codes", "times"])

    kind = docs.schema[id_col].dataType.simpleString()
    fields = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, `row of pairs` long, n_best long, count_sum long, codes array<long>, times array<long>"
    out = rows.withColumnRenamed(id_col, "id").select("id", "n_a", "n_b", "n_groups", "n_links", "groups", "row of pairs", "codes", "times").mapInArrow(run, fields)
    if least:
        out = saved(out, "alignment-rest")
        peak = counts.groupBy(F.call_function("div", F.col("code"), F.lit(width)).alias("of a")).agg(F.max("n").alias("top"))
        rest = out.select("row of pairs", F.explode(F.arrays_zip("codes", "times")).alias("p")).select("row of pairs", "p.codes", "p.times")
        seldom = counts.where(F.col("n") < 1 << least).withColumn("a", F.call_function("div", F.col("code"), F.lit(width))).join(F.broadcast(peak), F.col("a") == F.col("of a")).select("code", "n", (F.col("n") == F.col("top")).alias("is best"))
        more = rest.join(seldom, F.col("codes") == F.col("code")).groupBy(F.col("row of pairs").alias("row")).agg(F.sum(F.when(F.col("is best"), F.col("times")).otherwise(0)).alias("more best"), F.sum(F.col("times") * F.col("n")).alias("more sum"))
        out = out.drop("codes", "times").join(more, F.col("row of pairs") == F.col("row"), "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more sum", F.lit(0))})
    else:
        free(counts)
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum")
