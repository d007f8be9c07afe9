"""Pairs of texts whose sets of word shingles have a Jaccard similarity of at least a threshold: what simhash.near_duplicates finds beyond its fingerprints.

At a similarity of 0.8 two fingerprints of 64 bits differ in ten bits on average, which no set of positional bytes bounds. So these links come
from an exact prefix-filtered join. Of each set, ordered by (common or not, hash), the first n - ceil(t * n) + 1 shingles
are its prefix; two sets that are similar enough share one of theirs, whatever the order, at places early enough for what follows to suffice, and
their sizes are alike: what fails one of these is no candidate. Shingles that very many prefixes hold are put last in the order, by a bitmap of fixed size.

Before sets are fetched for comparison, their signatures are: of two to four places for each shingle, whether those that fall there are odd in number. Two signatures
differ in no more places than the sets in shingles, so what differs in more than the threshold allows is no pair; that loses nothing either. As places grow
with the set, sets of any size are ruled out unless they are nearly as similar as asked.

Sets that meet under a shingle are not compared in pairs: first each with the smallest of its group. Sets that prove linked are one component; only
sets of a group that are in different components then are compared, unless their distances to the smallest differ by more than the
threshold allows (Jaccard distance is a metric). So a large group of copies costs as many comparisons as it has members, and no
link between components is lost. Where many texts share a passage and are else different, each with a size and places alike, these pairs are compared.

Texts are compared in lower-case A-Z, shingles as hashes of 44 bits. Equal sets are one class; a text of fewer words than a shingle has one shingle,
all of it; texts without words are a class of their own, linked to no other. Null texts are empty, repeated rows one class; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnweave.llm.shared import SPACED, by_bytes, free, lowered, mixed, saved, text_bytes, words_of

#: Sets that hold a shingle in their prefix, beyond which it goes to the end of the order; so that sets meet under rare shingles only. More, where more than MOST_COMMON
#: shingles are such, which would fill the bitmap.
COMMON, MOST_COMMON = 64, 1 << 18
#: How often shingles are put last.
ROUNDS = 3
#: Places of the bitmap of common shingles (2 MB); a shingle that shares a place with one is put last as well.
BITS = 24
#: Rows of ids that may be broadcast.
BROADCAST_ROWS = 1 << 20
#: Bits of a shingle's number; what is left of 64 bits numbers a batch's texts, and a sort of both is one of plain numbers.
WIDTH = 44
MOST_TEXTS = 1 << 63 - WIDTH

_BYTE = mixed(np.arange(7001, 7257, dtype=np.uint64))
_PLACE = mixed(np.arange(8001, 8065, dtype=np.uint64)) | np.uint64(1)


def _sorted_by_owner(owner: np.ndarray, h: np.ndarray, late: np.ndarray | None = None) -> np.ndarray:
    """Numbers in the order of their owners, then late or not, then themselves. Owners are numbers in a row and stay where they are."""
    key = owner.astype(np.uint64) << np.uint64(WIDTH + 1) | h
    if late is not None:
        key |= late.astype(np.uint64) << np.uint64(WIDTH)
    key.sort()
    return key


def shingle_sets(raw: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles' numbers of each text, sorted, one text after another, and the n + 1 places where texts begin."""
    raw = lowered(raw)
    starts, ends, first = words_of(raw, at, SPACED)
    n = np.diff(first)
    if not starts.size:
        return np.zeros(0, np.uint64), np.zeros(at.size, np.int64)
    length = ends - starts
    place = np.concatenate([[0], np.cumsum(length)])
    nth = np.arange(place[-1]) - np.repeat(place[:-1], length)
    word = mixed(np.add.reduceat(_BYTE[raw[nth + np.repeat(starts, length)]] * _PLACE[nth & 63], place[:-1]) + length.astype(np.uint64))
    # Every place as if a shingle began there; texts of fewer words have one, of the words they have.
    padded = np.concatenate([word, np.zeros(size, np.uint64)])
    every = np.zeros(word.size, np.uint64)
    for k in range(size):
        every += padded[k : k + word.size] * _PLACE[k]
    per = np.where(n == 0, 0, np.maximum(n - size + 1, 1))
    owner = np.repeat(np.arange(n.size), per)
    begin = first[owner] + np.arange(owner.size) - np.repeat(np.cumsum(per) - per, per)
    h = every[begin]
    for t in np.flatnonzero((n > 0) & (n < size)):
        h[np.searchsorted(owner, t)] = (word[first[t] : first[t + 1]] * _PLACE[: n[t]]).sum() + np.uint64(n[t])
    key = _sorted_by_owner(owner, mixed(h) >> np.uint64(64 - WIDTH))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    owner = (key >> np.uint64(WIDTH + 1)).astype(np.int64)
    return key & np.uint64((1 << WIDTH) - 1), np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n.size))])


def classes(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(h + np.uint64(1)), dtype=np.uint64)])
    return mixed(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64)).view(np.int64)


#: Places of the signature of an empty set; others have two to four for each shingle.
LEAST_PLACES = 64


def signatures(h: np.ndarray, at: np.ndarray) -> pa.Array:
    """Of each set: its size (4 bytes), then whether the numbers of shingles at its places are odd. Places are a power of two, so that a longer signature folds to a shorter one's."""
    n = np.diff(at)
    places = np.maximum(LEAST_PLACES, 2 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    width = places // 8 + 4
    begin = np.concatenate([[0], np.cumsum(width)])
    odd = np.zeros(8 * begin[-1], np.uint8)
    np.add.at(odd, np.repeat(8 * begin[:-1] + 32, n) + (h & np.repeat(places - 1, n).astype(np.uint64)).astype(np.int64), np.uint8(1))
    data = np.packbits(odd & 1)
    data[begin[:-1, None] + np.arange(4)] = n[:, None].astype("<i4").view(np.uint8)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n.size, [None, pa.py_buffer(begin), pa.py_buffer(data)]).cast(pa.binary())


def _folded(rows: np.ndarray, width: int) -> np.ndarray:
    while rows.shape[1] > width:
        rows = rows[:, : rows.shape[1] // 2] ^ rows[:, rows.shape[1] // 2 :]
    return rows


def _differing(x: pa.Array, y: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of signatures: the sum of their sets' sizes, and in how many places they differ."""
    (raw_x, at_x), (raw_y, at_y) = (text_bytes(v.cast(pa.large_binary())) for v in (x, y))
    width_x, width_y = np.diff(at_x), np.diff(at_y)
    sizes = sum(raw[at[:-1, None] + np.arange(4)].view("<i4").ravel().astype(np.int64) for raw, at in ((raw_x, at_x), (raw_y, at_y)))
    differ = np.zeros(len(x), np.int64)
    for wx, wy in np.unique(np.stack([width_x, width_y], 1), axis=0).tolist():
        like = np.flatnonzero((width_x == wx) & (width_y == wy))
        step = max(1, (1 << 18) // max(wx, wy))
        for some in (like[lo : lo + step] for lo in range(0, like.size, step)):
            a, b = (raw[at[:-1][some, None] + np.arange(4, w)] for raw, at, w in ((raw_x, at_x, wx), (raw_y, at_y, wy)))
            narrow = min(wx, wy) - 4
            differ[some] = np.bitwise_count(_folded(a, narrow) ^ _folded(b, narrow)).sum(1, dtype=np.int64)
    return sizes, differ


def _plausible(similarity: float):
    """Pairs (a, b, x, y) whose signatures x and y don't rule them out, as (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, differ = _differing(batch.column(2), batch.column(3))
            most = sizes - 2 * np.ceil(sizes * (similarity / (1 + similarity)) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(differ <= most))

    return run


def _over(docs: DataFrame, id_col: str, text_col: str, size: int, make: Callable, schema: str) -> DataFrame:
    """For rows (id, text): what `make` gives for (ids, numbers, places, classes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text", 1 << 20):
                for lo in range(0, part.num_rows, MOST_TEXTS):
                    some = part.slice(lo, MOST_TEXTS)
                    h, at = shingle_sets(*text_bytes(some.column(1)), size)
                    yield make(some.column(0), h, at, classes(h, at))

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


ROW = "token long, class long, n int, place int"


def _prefixes(common: np.ndarray | None, similarity: float):
    def make(ids: pa.Array, h: np.ndarray, at: np.ndarray, cls: np.ndarray) -> pa.RecordBatch:
        n = np.diff(at)
        owner = np.repeat(np.arange(n.size), n)
        if common is not None:
            spot = (h & np.uint64((1 << BITS) - 1)).astype(np.int64)
            h = _sorted_by_owner(owner, h, common[spot >> 3] >> (spot & 7).astype(np.uint8) & 1) & np.uint64((1 << WIDTH) - 1)
        place = np.arange(h.size) - at[:-1][owner]
        take = np.flatnonzero(place <= (n - np.ceil(similarity * n - 1e-9).astype(np.int64))[owner])
        return pa.RecordBatch.from_arrays([pa.array(h[take].view(np.int64)), pa.array(cls[owner[take]]), pa.array(n[owner[take]].astype(np.int32)), pa.array(place[take].astype(np.int32))], ["token", "class", "n", "place"])

    return make


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token and class: those of tokens that two classes or more hold, each once, beside the token's first (columns head, m, spot). What is kept from batch to batch is a token's first row."""
    head, out_yet, last = np.full(4, -1, np.int64), True, -1
    for batch in batches:
        rows = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(4)])
        before = np.concatenate([[[head[0]], [last]], rows[:2, :-1]], 1) if rows.shape[1] else rows[:2]
        rows = rows[:, (rows[:2] != before).any(0)]  # equal sets are one class
        if not rows.shape[1]:
            continue
        lead = rows[0] != np.concatenate([[head[0]], rows[0, :-1]])
        group = np.cumsum(lead)
        heads = np.concatenate([head[:, None], rows[:, lead]], 1)
        more = np.bincount(group[~lead], minlength=heads.shape[1]) > 0
        opened = np.flatnonzero(more & (np.arange(more.size) > 0 if out_yet else True))
        kept, of = np.concatenate([heads[:, opened], rows[:, ~lead]], 1), np.concatenate([opened, group[~lead]])
        if of.size:
            yield pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip((*kept, *heads[1:, of]), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()), strict=True))], ["token", "class", "n", "place", "head", "m", "spot"])
        out_yet = bool(more[group[-1]]) or (group[-1] == 0 and out_yet)
        head, last = heads[:, group[-1]], rows[1, -1]


def _common(counts: DataFrame, before: np.ndarray | None) -> np.ndarray | None:
    """`before` with the places of shingles that more than COMMON sets hold; None if there are no new ones. The bitmap has a fixed size; how many shingles it takes decides how fast the join is and not what it finds."""
    power = F.ceil(F.log2(F.col("n_sets") / COMMON)).cast("int")
    above, least = {r.p: r.n for r in counts.where(F.col("n_sets") > COMMON).groupBy(power.alias("p")).agg(F.count("*").alias("n")).collect()}, COMMON
    while sum(n for p, n in above.items() if COMMON << p - 1 >= least) > MOST_COMMON:
        least *= 2
    spot = F.col("token").bitwiseAND(F.lit((1 << BITS) - 1))
    rows = counts.where(F.col("n_sets") > least).select(F.shiftright(spot, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), spot.bitwiseAND(F.lit(63)).cast("int")).alias("one"))
    words = rows.groupBy("word").agg(F.bit_or("one").alias("ones")).toArrow()
    out = np.zeros(1 << BITS - 6, np.uint64)
    out[words.column("word").to_numpy()] = words.column("ones").to_numpy().view(np.uint64)
    out = out.view(np.uint8)
    if before is not None:
        out = out | before
    return None if not out.any() or before is not None and (out == before).all() else out


def meeting(docs: DataFrame, size: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """Rows of prefixes (token, class, n, place), of tokens that two classes or more hold, beside the token's smallest class (head, m, spot)."""
    spark, common = docs.sparkSession, None
    for last in [False] * ROUNDS + [True]:
        shared = None if common is None else spark.sparkContext.broadcast(common)
        prefix = _prefixes(None, similarity) if shared is None else (lambda *x, s=shared: _prefixes(s.value, similarity)(*x))
        rows = _over(docs, id_col, text_col, size, prefix, ROW)
        sorted_rows = rows.repartition("token").sortWithinPartitions("token", "class")
        met = saved(sorted_rows.mapInArrow(_met, f"{ROW}, head long, m int, spot int"), "sets-met")
        more = None if last else _common(met.groupBy("token").agg(F.count("*").alias("n_sets")), common)
        if more is None:
            return met
        common = more
        free(met)
    raise AssertionError


def _distance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (batch.column(batch.schema.get_field_index(c)) for c in ("x", "y"))
        out = np.empty(batch.num_rows)
        for k, (x, y) in enumerate(zip(a, b, strict=True)):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = np.intersect1d(x, y, assume_unique=True).size
            out[k] = 1 - both / max(1, x.size + y.size - both)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], ["a", "b", "distance"])


class Sets:
    """Sets of classes, read again from one document of each where they are asked for. `known` has class, least (a document's id) and signature."""

    def __init__(self, docs: DataFrame, known: DataFrame, size: int, similarity: float, id_col: str, text_col: str):
        self.docs, self.size, self.similarity, self.id_col, self.text_col = docs, size, similarity, id_col, text_col
        self.known = known

    def distances(self, pairs: DataFrame) -> DataFrame:
        """For those pairs (a, b) of classes that signatures don't rule out: with their distance."""
        x, y = (self.known.select(F.col("class").alias(c), F.col("signature").alias(v)) for c, v in (("a", "x"), ("b", "y")))
        plausible = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_plausible(self.similarity), "a long, b long")
        pairs = saved(plausible, "sets-plausible")
        wanted = saved(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(self.known.select("class", "least"), "class"), "sets-wanted")
        n = wanted.count()
        few = lambda df: F.broadcast(df) if n <= BROADCAST_ROWS else df
        ids = wanted.select(F.col("least").alias("wanted id")).distinct()
        some = self.docs.join(few(ids), F.col(self.id_col).eqNullSafe(F.col("wanted id")), "left_semi")

        def make(_: pa.Array, h: np.ndarray, at: np.ndarray, cls: np.ndarray) -> pa.RecordBatch:
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), at.size - 1, [None, pa.py_buffer(at.astype(np.int64) * 8), pa.py_buffer(h)])
            return pa.RecordBatch.from_arrays([pa.array(cls), data.cast(pa.binary())], ["class", "shingles"])

        sets = _over(some, self.id_col, self.text_col, self.size, make, "class long, shingles binary").join(few(wanted.select("class")), "class", "left_semi")
        sets = saved(sets.groupBy("class").agg(F.first("shingles").alias("shingles")), "sets-texts")
        x, y = (sets.select(F.col("class").alias(c), F.col("shingles").alias(v)) for c, v in (("a", "x"), ("b", "y")))
        out = saved(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_distance, "a long, b long, distance double"), "sets-distances")
        free(pairs, wanted, sets)
        return out


def set_links(docs: DataFrame, known_sets: DataFrame, components: Callable[[DataFrame], DataFrame], size: int, similarity: float, id_col: str, text_col: str) -> tuple[DataFrame, list[DataFrame]]:
    """And the tables that they are read from, to be freed. Links (a, b) between classes that span the components of "similar enough". `known_sets` has a document's id (least) and the signature of each class, `components` gives (node, root) for links."""
    if not 0 < similarity <= 1:
        raise ValueError("a similarity is above 0 and at most 1")
    most = 1 - similarity + 1e-9
    met = meeting(docs, size, similarity, id_col, text_col)
    sets = Sets(docs, known_sets, size, similarity, id_col, text_col)

    def may_link(m: Column, i: Column, n: Column, j: Column) -> Column:
        """Whether sets of m and n shingles that first share those at places i and j can be similar enough."""
        enough = F.ceil((m + n) * F.lit(similarity / (1 + similarity)) - 1e-9)
        return (F.least(m, n) >= F.lit(similarity) * F.greatest(m, n) - 1e-9) & (F.least(m - i, n - j) >= enough)

    # Each set with the smallest of its group.
    star = met.where((F.col("class") != F.col("head")) & may_link(F.col("m"), F.col("spot"), F.col("n"), F.col("place")))
    stars = saved(star.select(F.col("head").alias("a"), F.col("class").alias("b")).distinct(), "sets-stars")
    known = sets.distances(stars)
    first = known.where(F.col("distance") <= most).select("a", "b")
    roots = components(first)
    # Groups that are in several components still: those outside a group's largest one with all others.
    few = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    of = met.join(few(roots), met["class"] == roots["node"], "left").select("token", "class", "n", "place", "head", F.coalesce("root", "class").alias("root"))
    of = saved(of, "sets-of")
    parts = of.groupBy("token", "root").agg(F.count("*").alias("size"))
    split = saved(parts.groupBy("token").agg(F.count("*").alias("n_parts"), F.max_by("root", F.struct("size", "root")).alias("main")).where("n_parts > 1").select("token", "main"), "sets-split")
    rest = of.join(few(split), "token").join(few(known).select(F.col("a").alias("head"), F.col("b").alias("class"), "distance"), ["head", "class"], "left")
    rest = saved(rest.withColumn("distance", F.when(F.col("head") == F.col("class"), 0.0).otherwise(F.col("distance"))), "sets-rest")
    a = rest.where("root <> main").select("token", F.col("class").alias("a"), F.col("n").alias("m"), F.col("place").alias("i"), F.col("root").alias("root_a"), F.col("distance").alias("far_a"))
    b = rest.select("token", F.col("class").alias("b"), "n", F.col("place").alias("j"), F.col("root").alias("root_b"), F.col("distance").alias("far_b"), (F.col("root") == F.col("main")).alias("in_main"))
    apart = F.coalesce(F.abs(F.col("far_a") - F.col("far_b")) > most, F.lit(False))
    open_ = (F.col("root_a") != F.col("root_b")) & (F.col("in_main") | (F.col("a") < F.col("b"))) & may_link(F.col("m"), F.col("i"), F.col("n"), F.col("j")) & ~apart
    pairs = a.join(b, "token").where(open_).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = saved(pairs.join(few(stars), ["a", "b"], "left_anti"), "sets-pairs")
    second = sets.distances(pairs)
    free(met, stars, roots, of, split, rest, pairs)
    return first.unionByName(second.where(F.col("distance") <= most).select("a", "b")), [known, second]
