"""Quality classifier: supervised subword embeddings.

A text is the mean of learned vectors of its hashed words, of its words' repetition forms (how far back the same word
stood) and of hashed 3-, 4- and 5-byte n-grams; a softmax over two classes follows. Vectors and output weights are trained by numpy stochastic gradient descent on at most `max_rows`
labelled rows, those of smallest hash. As the output is linear in the mean, a trained model is one number for each
bucket, and scoring is a look-up. Null and empty texts have no features and get the class share of the training rows.
Without training rows of both classes every score is that share (0.5 if there are none). Repeated rows are scored each,
repeated labels are used each; empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnweave.llm.shared import SPACED, by_bytes, mixed, text_bytes, words_of

BITS = 17
DIM = 12
GRAMS = (3, 4, 5)
_T = mixed(np.arange(1, 257, dtype=np.uint64))
_P = mixed(np.arange(1001, 1065, dtype=np.uint64)) | np.uint64(1)


def features(raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature: the buckets of all texts in a row, and the n + 1 places where texts begin."""
    starts, ends, first = words_of(raw, at, SPACED)
    shift = np.uint64(64 - BITS)
    if starts.size:
        size = ends - starts
        place = np.concatenate([[0], np.cumsum(size)])
        nth = np.arange(place[-1]) - np.repeat(place[:-1], size)
        value = _T[raw[nth + np.repeat(starts, size)]] * _P[nth & 63]
        word = mixed(np.add.reduceat(value, place[:-1]))
        yield (word >> shift).astype(np.int32), first
        # Word n-grams by form: how many words back the same word stood, up to four, within the text.
        lag, owner = np.zeros(word.size, np.uint64), np.repeat(np.arange(at.size - 1), np.diff(first))
        for d in (4, 3, 2, 1):
            lag[d:][(word[d:] == word[:-d]) & (owner[d:] == owner[:-d])] = d
        yield (mixed(lag + np.uint64(0xF0F0)) >> shift).astype(np.int32), first
    for n in GRAMS:
        if raw.size < n:
            continue
        key = np.zeros(raw.size - n + 1, np.uint64)
        for d in range(n):
            key = (key << np.uint64(8)) | raw[d : raw.size - n + 1 + d]
        bucket = ((key + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> shift).astype(np.int32)
        inside = np.ones(bucket.size, bool)
        for d in range(1, n):  # windows that begin up to n - 1 bytes before a text's end
            edge = at[1:] - d
            inside[edge[(edge >= 0) & (edge < bucket.size)]] = False
        # A text shorter than n: the line above marks all its places too.
        kept = np.flatnonzero(inside)
        yield bucket[kept], np.searchsorted(kept, at)


def training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (place, label, text) to (place, label, buckets, shares): each text's distinct buckets and their shares of its features."""
    for batch in batches:
        for part in by_bytes(batch):
            raw, at = text_bytes(part.column(2))
            own: list[list[np.ndarray]] = [[] for _ in range(part.num_rows)]
            for bucket, first in features(raw, at):
                for k in range(part.num_rows):
                    own[k].append(bucket[first[k] : first[k + 1]])
            rows = []
            for x in own:
                ids, n = np.unique(np.concatenate(x), return_counts=True) if x else (np.zeros(0, np.int32), np.zeros(0))
                rows.append((ids.astype("<i4").tobytes(), (n / max(1, n.sum())).astype("<f4").tobytes()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([a for a, _ in rows], pa.binary()), pa.array([b for _, b in rows], pa.binary())], ["place", "label", "buckets", "shares"])


def train(rows: pd.DataFrame, epochs: int = 5, rate: float = 1.0, batch: int = 8, seed: int = 7) -> tuple[np.ndarray, float]:
    """Softmax over mean vectors by SGD; gives each bucket's contribution to the log odds of label 1, and the bias."""
    labels = rows["label"].to_numpy(np.int64)
    ids = [np.frombuffer(x, "<i4") for x in rows["buckets"]]
    shares = [np.frombuffer(x, "<f4") for x in rows["shares"]]
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((1 << BITS, DIM), np.float32) - 0.5) / DIM).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    share = (labels.sum() + 1) / (labels.size + 2)
    bias[:] = np.log([1 - share, share])
    if 0 < labels.sum() < labels.size:
        used = [k for k in range(labels.size) if ids[k].size]
        steps, done = max(1, epochs * len(used)), 0
        for _ in range(epochs):
            order = rng.permutation(used)
            for lo in range(0, order.size, batch):
                some = order[lo : lo + batch]
                i = np.concatenate([ids[k] for k in some])
                w = np.concatenate([shares[k] for k in some])[:, None]
                size = [ids[k].size for k in some]
                own = vectors[i]
                h = np.add.reduceat(own * w, np.concatenate([[0], np.cumsum(size)[:-1]]))
                z = h @ out + bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(some.size), labels[some]] -= 1
                step = np.float32(rate * (1 - done / steps))
                back = p @ out.T
                out -= step * (h.T @ p) / some.size
                bias -= np.float32(0.1) * step * p.mean(0) / 4
                np.add.at(vectors, i, -step * 4 * w * np.repeat(back, size, 0))
                done += some.size
    return (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", may_learn: Column | None = None, max_rows: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, float]:
    """A model from at most `max_rows` labelled rows (smallest hashes of their ids): bounded, so it is trained in one task."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    if may_learn is not None:
        known = known.where(may_learn)
    some = known.select(F.col(id_col).alias("id"), F.col(label_col).cast("long").alias("label")).orderBy(F.xxhash64("id"), "id", "label").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    joined = texts.join(F.broadcast(some), "id")  # at most max_rows rows
    # Texts stay where they are read; what comes together are their features, of bounded size.
    made = joined.select(F.xxhash64("id", "text").alias("place"), "label", "text").mapInArrow(training_rows, "place long, label long, buckets binary, shares binary")
    rows = made.orderBy("place", "label").limit(max_rows).drop("place")

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        scores, bias = train(pdf.sort_values(["buckets", "shares", "label"]))
        return pd.DataFrame({"scores": [scores.tobytes()], "bias": [bias]})

    got = rows.groupBy(F.lit(0).alias("all")).applyInPandas(learn, "scores binary, bias double").collect()
    return (np.frombuffer(got[0].scores, np.float32), got[0].bias) if got else (np.zeros(1 << BITS, np.float32), 0.0)


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and score, the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            for part in by_bytes(batch):
                raw, at = text_bytes(part.column(1))
                total, n = np.zeros(part.num_rows), np.zeros(part.num_rows)
                for bucket, first in features(raw, at):
                    run_sum = np.concatenate([[0], np.cumsum(weights[bucket], dtype=np.float64)])
                    total += run_sum[first[1:]] - run_sum[first[:-1]]
                    n += np.diff(first)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-(total / np.maximum(n, 1) + bias))))], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
