"""Benchmark decontamination by a prefix-filtered set join.

The benchmark's windows (`size` consecutive words of an item, or the whole item if shorter) are ordered by how rare
their words are in the documents. A window occurs only where its rarest word does, so that word is its necessary prefix:
documents are probed with prefix words alone, candidates must lie inside the document (positional and length bounds),
and what is left is verified word by word, which is exact.

The benchmark is taken in blocks of bounded text, so what is broadcast has a proven bound whatever the benchmark's size;
every block meets every document. Null texts have no words. Items without words have no windows. Repeated rows and
repeated items are handled each; empty tables on either side give no hits. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnweave.llm.shared import ALNUM, by_bytes, lowered, strings, text_bytes, words_of

#: Bytes of benchmark text in a block, and so in a broadcast.
BLOCK_BYTES = 8 << 20


@dataclass
class Block:
    """Windows over a vocabulary of their own: window w is `words[w, :length[w]]`, found in `items[item_at[w]:item_at[w + 1]]`; word v leads to windows `by_word[at[v]:at[v + 1]]`, of which it is the prefix, at `offset`."""

    vocabulary: pa.Array
    words: np.ndarray
    length: np.ndarray
    items: list[str]
    item_at: np.ndarray
    item_of: np.ndarray
    at: np.ndarray
    by_word: np.ndarray
    offset: np.ndarray


def coded(raw: np.ndarray, at: np.ndarray, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each word's place in the vocabulary (-1: none), and the n + 1 places where texts begin among them."""
    raw = lowered(raw)
    starts, ends, first = words_of(raw, at, ALNUM)
    if not starts.size:
        return np.zeros(0, np.int32), first
    return pc.fill_null(pc.index_in(strings(raw, starts, ends), vocabulary), -1).to_numpy(), first


def _texts(values: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    return text_bytes(pa.array([(x or "").encode() for x in values], pa.large_binary()))


def vocabulary_of(texts: list[str | None]) -> pa.Array:
    raw, at = _texts(texts)
    raw = lowered(raw)
    starts, ends, _ = words_of(raw, at, ALNUM)
    return pc.unique(strings(raw, starts, ends)) if starts.size else pa.array([], pa.large_binary())


def build(items: list[tuple[str, str | None]], vocabulary: pa.Array, rarity: np.ndarray, size: int) -> Block:
    """The block of these items; `rarity` has each vocabulary word's count in the documents."""
    ids, first = coded(*_texts([t for _, t in items]), vocabulary)
    found: dict[tuple[int, ...], set[int]] = {}
    for k in range(len(items)):
        own = ids[first[k] : first[k + 1]].tolist()
        for s in range(max(1, len(own) - size + 1) if own else 0):
            found.setdefault(tuple(own[s : s + size]), set()).add(k)
    windows = list(found)
    words = np.full((len(windows), size), -2, np.int32)
    length = np.array([len(w) for w in windows], np.int64)
    prefix, offset = np.zeros(len(windows), np.int64), np.zeros(len(windows), np.int64)
    for w, own in enumerate(windows):
        words[w, : len(own)] = own
        offset[w] = min(range(len(own)), key=lambda k: (rarity[own[k]], own[k], k))
        prefix[w] = own[offset[w]]
    order = np.argsort(prefix, kind="stable")
    at = np.searchsorted(prefix[order], np.arange(len(vocabulary) + 1))
    item_at = np.concatenate([[0], np.cumsum([len(found[w]) for w in windows])]).astype(np.int64)
    item_of = np.array([k for w in windows for k in sorted(found[w])], np.int64)
    return Block(vocabulary, words, length, [i for i, _ in items], item_at, item_of, at, order, offset)


def occurrences(block: Block, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows that occur in the coded texts: (start word, window)."""
    lead = np.flatnonzero(ids >= 0)
    fan = (block.at[1:] - block.at[:-1])[ids[lead]] if lead.size else np.zeros(0, np.int64)
    lead, fan = lead[fan > 0], fan[fan > 0]
    starts, windows = [], []
    step = 1 << 18  # candidates at a time
    total = np.cumsum(fan)
    lo = 0
    while lo < lead.size:
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + step, side="right")))
        p, n = lead[lo:hi], fan[lo:hi]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        w = block.by_word[np.repeat(block.at[ids[p]], n) + nth]
        s = np.repeat(p, n) - block.offset[w]
        owner = np.repeat(np.searchsorted(first, p, side="right") - 1, n)
        keep = (s >= first[owner]) & (s + block.length[w] <= first[owner + 1])
        s, w = s[keep], w[keep]
        for k in range(block.words.shape[1]):
            inside = k < block.length[w]
            same = ~inside
            same[inside] = ids[s[inside] + k] == block.words[w[inside], k]
            s, w = s[same], w[same]
            if not s.size:
                break
        starts.append(s)
        windows.append(w)
        lo = hi
    return (np.concatenate(starts), np.concatenate(windows)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _counted(docs: DataFrame, vocabulary: pa.Array) -> np.ndarray:
    """How often each vocabulary word occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        total = np.zeros(len(words), np.int64)
        for batch in batches:
            for part in by_bytes(batch):
                ids, _ = coded(*text_bytes(part.column(0)), words)
                total += np.bincount(ids[ids >= 0], minlength=len(words))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["word", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    # As many rows as the block's vocabulary has words, at most.
    for word, n in docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n")).collect():
        out[word] = n
    return out


_OUT = "id {}, text binary, n_words long, spans array<struct<start:long,stop:long>>, items array<string>"


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _probe(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            for part in by_bytes(batch):
                raw = part.column(1)
                ids, first = coded(*text_bytes(raw), block.vocabulary)
                start, window = occurrences(block, ids, first)
                spans = [[(x["start"], x["stop"]) for x in v] for v in part.column(3).to_pylist()]
                items = [set(v) for v in part.column(4).to_pylist()]
                if start.size:
                    owner = np.searchsorted(first, start, side="right") - 1
                    for k, s, w in zip(owner.tolist(), (start - first[owner]).tolist(), window.tolist(), strict=True):
                        spans[k].append((s, s + int(block.length[w])))
                        items[k].update(block.items[i] for i in block.item_of[block.item_at[w] : block.item_at[w + 1]])
                merged = [[{"start": a, "stop": b} for a, b in _merged(v)] for v in spans]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), raw.cast(pa.binary()), pa.array(np.diff(first)), pa.array(merged, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array([sorted(v) for v in items], pa.list_(pa.string()))],
                    ["id", "text", "n_words", "spans", "items"],
                )

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of docs: id, n_words, spans (hit words, merged, [start, stop)), items (ids of items with windows there, as sorted strings)."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item is not null and text <> ''").distinct()
    # Repeated and empty items don't count; each other one takes some room beside its text.
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 100), F.lit(0))).first()[0]
    n_blocks = max(1, -(-2 * total // block_bytes))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = texts.select("id", "text", F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<start:long,stop:long>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"))
    for k in range(n_blocks):
        own = [(r.item, r.text) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == k).sort("item", "text").collect()]
        vocabulary = vocabulary_of([t for _, t in own])
        block = build(own, vocabulary, _counted(texts, vocabulary), size)
        out = out.mapInArrow(_probe(spark.sparkContext.broadcast(block)), _OUT.format(kind))
    return out.select(F.col("id").alias(id_col), "n_words", "spans", "items")
