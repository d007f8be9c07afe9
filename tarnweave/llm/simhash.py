"""SimHash near-duplicates: an inverted index on positional bytes with count filtering.

Fingerprints of 64 bits that differ in at most 3 share at least 5 of their 8 positional bytes. The index has an entry
for each set of `width` byte positions out of a family that meets every 5-subset of the 8 (a Turan family), so each pair
within reach meets under some key; pairs that meet have their shared positional bytes tallied, those with 5 or more are
verified by their differing bits. Keys with many fingerprints are re-keyed by 5 whole bytes, which leaves 24 free bits,
so that no group exceeds 2**24 fingerprints, and large groups look up neighbours by flipping bits instead of comparing
all pairs. A group emits a spanning forest of its links, never all pairs; components are found by alternating stars.

Texts are compared in lower-case A-Z. A text without words has fingerprint zero, linked like any other; a null text is
empty. Equal rows share a fingerprint and a component. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnweave.llm.shared import SPACED, by_bytes, free, lowered, saved, text_bytes, words_of
from tarnweave.llm.similar_sets import classes as set_classes
from tarnweave.llm.similar_sets import set_links, shingle_sets, signatures

MAX_BITS = 3
NEEDED = 8 - MAX_BITS
#: Fingerprints under one key before that key is split by further bytes.
HOT = 512


def _shingle_spans(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last word of each shingle, and its text: runs of `size` words, or the whole text if it has fewer."""
    n = np.diff(first)
    per = np.where(n == 0, 0, np.maximum(n - size + 1, 1))
    owner = np.repeat(np.arange(n.size), per)
    step = np.arange(owner.size) - np.repeat(np.cumsum(per) - per, per)
    begin = first[owner] + step
    return begin, begin + np.minimum(size, n[owner]) - 1, owner


def fingerprints_of(raw: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit SimHash of each text: a bit is set if it is set in over half of the shingles' XXH64 (seed 42)."""
    raw = lowered(raw)
    starts, ends, first = words_of(raw, at, SPACED)
    begin, last, owner = _shingle_spans(first, size)
    out = np.zeros(at.size - 1, np.uint64)
    if not begin.size:
        return out
    # All words joined by single spaces: a shingle is one slice of that.
    length = ends - starts + 1
    place = np.concatenate([[0], np.cumsum(length)])
    take = np.repeat(starts - place[:-1], length) + np.arange(place[-1])
    take[place[1:] - 1] = 0
    joined = raw[take]
    joined[place[1:] - 1] = 32
    body, digest = joined.tobytes(), xxhash.xxh64_intdigest
    h = np.array([digest(body[a:b], 42) for a, b in zip(place[begin].tolist(), (place[last + 1] - 1).tolist(), strict=True)], np.uint64)
    for lo in range(0, h.size, 1 << 16):  # bits of a block of shingles at a time
        part, of = h[lo : lo + (1 << 16)], owner[lo : lo + (1 << 16)]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        head = np.flatnonzero(np.diff(of, prepend=-1))
        ones = np.add.reduceat(bits, head, axis=0, dtype=np.int64)
        if lo == 0:
            counts = np.zeros((out.size, 64), np.int64)
        counts[of[head]] += ones
    over = 2 * counts > np.bincount(owner, minlength=out.size)[:, None]
    return np.packbits(over, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text", with_class: bool = False) -> DataFrame:
    """Per row: id and fp, the fingerprint's bits as a long; and class and signature of its set of shingles (see similar_sets), if asked for."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text", 1 << 20):
                raw, at = text_bytes(part.column(1))
                out = {"id": part.column(0), "fp": pa.array(fingerprints_of(raw, at, size).view(np.int64))}
                if with_class:
                    shingles = shingle_sets(raw, at, size)
                    out |= {"class": pa.array(set_classes(*shingles)), "signature": signatures(*shingles)}
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(make, f"id {kind}, fp long" + ", class long, signature binary" * with_class).withColumnRenamed("id", id_col)


def family(width: int) -> list[tuple[int, ...]]:
    """Sets of `width` byte positions such that every 5 of the 8 positions hold one: within halves for 3, all for 5, and for 4 a minimal family found greedily."""
    if width == 3:
        return [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
    if width == NEEDED:
        return list(combinations(range(8), NEEDED))
    missing, out = set(combinations(range(8), NEEDED)), []
    while missing:
        best = max(combinations(range(8), width), key=lambda s: sum(set(s) <= set(m) for m in missing))
        out.append(best)
        missing = {m for m in missing if not set(best) <= set(m)}
    return out


def _mask(positions: tuple[int, ...]) -> int:
    m = sum(255 << 8 * p for p in positions)
    return m - (1 << 64) if m >> 63 else m


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))


def _linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The count filter (positional bytes shared), then the verification."""
    x = a ^ b
    out = np.zeros(x.shape, bool)
    share = np.zeros(x.shape, np.int8)
    for p in range(8):
        share += (x.view(np.uint64) >> np.uint64(8 * p)) & np.uint64(255) == 0
    some = share >= NEEDED
    out[some] = _popcount(x[some]) <= MAX_BITS
    return out


def forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links among distinct sorted fingerprints of a group: fingerprints, and the smallest of the tree of each."""
    n = fps.size
    if n == 2:
        hit = _linked(fps[:1], fps[1:])
        return fps[1:][hit], fps[:1][hit]
    tree = np.arange(n)

    def merge(a: np.ndarray, b: np.ndarray) -> None:
        """Joins the trees of a[i] and b[i]: roots take the smaller neighbour until nothing changes."""
        nonlocal tree
        while True:
            ra, rb = tree[a], tree[b]
            differ = ra != rb
            if not differ.any():
                return
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(tree, np.maximum(ra, rb), np.minimum(ra, rb))
            while (tree[tree] != tree).any():
                tree = tree[tree]

    if n <= 4096:  # all pairs of a bounded group, by rows of blocks
        step = max(1, (1 << 18) // n)
        for lo in range(0, n - 1, step):
            hi = min(lo + step, n - 1)
            hit = _linked(np.repeat(fps[lo:hi, None], n, 1), np.repeat(fps[None, :], hi - lo, 0))
            i, j = np.nonzero(hit)
            keep = i + lo < j
            merge(i[keep] + lo, j[keep])
    else:  # neighbours by flipped bits among those in which the group varies: at most 24
        varying = int(np.bitwise_or.reduce(fps ^ fps[0])) & ((1 << 64) - 1)
        bits = [np.uint64(1 << k).astype(np.int64) for k in range(64) if varying >> k & 1]
        for r in range(1, MAX_BITS + 1):
            for some in combinations(bits, r):
                near = fps ^ np.bitwise_or.reduce(np.array(some))
                at = np.minimum(np.searchsorted(fps, near), n - 1)
                hit = np.flatnonzero((fps[at] == near) & (at > np.arange(n)))
                if hit.size:
                    merge(hit, at[hit])
    child = np.flatnonzero(tree != np.arange(n))
    return fps[child], fps[tree[child]]


def _groups(batches: Iterator[pa.RecordBatch], limit: int | None) -> Iterator[tuple[str, int, np.ndarray]]:
    """From rows (slot, key, fp) in that order: ("group", slot, fps) for each key with two or more; beyond `limit`, ("hot", slot, fps) in parts."""
    slot_key, held, size, hot = None, [], 0, False

    def flush() -> Iterator[tuple[str, int, np.ndarray]]:
        if size and (hot or size > 1):
            yield ("hot" if hot else "group"), slot_key[0], np.concatenate(held)

    for batch in batches:
        slot, key, fp = (batch.column(k).to_numpy() for k in range(3))
        if not fp.size:
            continue
        cut = np.flatnonzero((np.diff(slot) != 0) | (np.diff(key) != 0)) + 1
        edges = [0, *cut.tolist(), fp.size]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            now = (int(slot[a]), int(key[a]))
            if now != slot_key:
                yield from flush()
                slot_key, held, size, hot = now, [], 0, False
            held.append(fp[a:b])
            size += b - a
            if limit and size > limit:
                hot = True
                yield from flush()
                held, size = [], 0
    yield from flush()


def _forests(limit: int | None):
    """For mapInArrow: links of groups (kind 0: a is linked to b), and members of hot keys (kind 1: fingerprint a in slot b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def rows() -> pa.RecordBatch:
            kind, a, b = (np.concatenate([np.zeros(0, t), *x]) for t, x in zip((np.int32, np.int64, np.int64), zip(*held, strict=True) if held else ([], [], []), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(a), pa.array(b)], ["kind", "a", "b"])

        for what, slot, fps in _groups(batches, limit):
            a, b = (fps, np.full(fps.size, slot, np.int64)) if what == "hot" else forest(fps)
            if a.size:
                held.append((np.full(a.size, what == "hot", np.int32), a, b))
                size += a.size
            if size > 20_000:
                yield rows()
                held, size = [], 0
        yield rows()

    return run


def links(fps: DataFrame, n: int) -> DataFrame:
    """From distinct fingerprints (column fp, n of them) to links (a, b) that span the components of "differ in 3 bits at most"."""
    width = 3 if n < 1 << 22 else 4 if n < 1 << 30 else NEEDED
    sets = family(width)
    first = fps.select(F.explode(F.array(*(F.struct(F.lit(k).alias("slot"), F.col("fp").bitwiseAND(F.lit(_mask(s))).alias("key")) for k, s in enumerate(sets)))).alias("x"), "fp").select("x.slot", "x.key", "fp")
    keyed = first.repartition("slot", "key").sortWithinPartitions("slot", "key", "fp")
    limit = HOT if width < NEEDED else None
    got = saved(keyed.mapInArrow(_forests(limit), "kind int, a long, b long"), "simhash-links")
    out = got.where("kind = 0").select("a", "b")
    if limit:
        # Hot keys: each of their members under all 5 bytes that hold the key's positions.
        wide = [(k, m) for k, s in enumerate(sets) for m in combinations(range(8), NEEDED) if set(s) <= set(m)]
        ids = {m: k for k, m in enumerate(sorted({m for _, m in wide}))}
        choices = {k: F.array(*(F.struct(F.lit(ids[m]).alias("slot"), F.col("a").bitwiseAND(F.lit(_mask(m))).alias("key")) for j, m in wide if j == k)) for k in range(len(sets))}
        pick = F.when(F.col("b") == 0, choices[0])
        for k in range(1, len(sets)):
            pick = pick.when(F.col("b") == k, choices[k])
        again = got.where("kind = 1").select(F.explode(pick).alias("x"), F.col("a").alias("fp")).select("x.slot", "x.key", "fp").distinct()
        tight = again.repartition("slot", "key").sortWithinPartitions("slot", "key", "fp")
        out = out.union(tight.mapInArrow(_forests(None), "kind int, a long, b long").select("a", "b"))
    out = saved(out.distinct(), "simhash-edges")
    free(got)
    return out


def components(edges: DataFrame, spark: SparkSession) -> DataFrame:
    """From undirected edges (a, b) to (node, root), root the smallest node of the component. Alternating large and small stars; each round is written to the shared folder, so that plans stay short and survive lost executors."""
    edges, tag, written = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), None, []
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("m").alias("y")), F.struct(F.col("b").alias("x"), F.col("m").alias("y")))).alias("e")).select(F.col("e.x").alias("a"), F.col("e.y").alias("b")).where("a <> b").distinct()
        edges = saved(small, "simhash-stars")
        free(*written)
        written = [edges]
        row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 30))).alias("s")).first()
        if tag == tuple(row):
            out = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            out._saved_at = edges._saved_at
            return out
        tag = tuple(row)


def near_duplicates(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """Per row: id, fingerprint (16 hex digits) and component_id, the smallest id that links reach. With `similarity`, texts whose sets of shingles have at least that Jaccard similarity are linked as well, which fingerprints alone miss."""
    spark = docs.sparkSession
    rows = saved(fingerprints(docs, size, id_col, text_col, similarity is not None), "simhash")
    fps = saved(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-distinct")
    edges = links(fps.select("fp"), fps.count())
    node, nodes = "fp", fps
    if similarity is not None:  # nodes are classes of equal sets; a fingerprint stands for the smallest class that has it
        node, nodes = "class", saved(rows.groupBy("class").agg(F.min(id_col).alias("least"), F.first("signature").alias("signature")), "simhash-classes")
        of_fp = saved(rows.groupBy("fp").agg(F.min("class").alias("first")), "simhash-first")
        same = rows.join(of_fp, "fp").where(F.col("class") != F.col("first")).select(F.col("class").alias("a"), F.col("first").alias("b"))
        of_a, of_b = (of_fp.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}")) for c in ("a", "b"))
        near = edges.join(of_a, "a").join(of_b, "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
        alike, used = set_links(docs, nodes, lambda x: components(x, spark), size, similarity, id_col, text_col)
        fewer = saved(same.unionByName(near).unionByName(alike).distinct(), "simhash-links")
        free(edges, of_fp, *used)
        edges = fewer
    found = components(edges, spark)
    # The smallest id of each component, for its nodes; others keep their own.
    tied = nodes.join(found, nodes[node] == found["node"], "left").select(node, "least", F.coalesce("root", node).alias("root"))
    best = tied.groupBy("root").agg(F.min("least").alias("component_id"))
    of = saved(tied.join(best, "root").select(node, "component_id"), "simhash-components")
    free(edges, found, fps, *([nodes] if nodes is not fps else []))
    return rows.join(of, node).select(id_col, _hex(), "component_id")


def _hex() -> Column:
    return F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
