"""Language-model scoring by logistic context mixing.

Bits are predicted, most significant first, by six contexts (the last 1 to 5 bytes, or the word so far, and the
bits so far). A gate (how often the word and the last 5 bytes have been seen, and the bit's place) picks the weights that
mix the predictions in the logistic domain, and an adaptive map refines the mixed probability. Contexts don't reach before a text, which ends
with an end symbol, so a text's probability doesn't depend on its neighbours or on how rows are dealt to tasks.

Learning sees all training rows. Chunks of all rows are reduced to distinct 6-byte grams with their training counts, which
are summed in blocks of a hash of the last three bytes before. A block holds all that its contexts of three bytes and more
(and its words) have been followed by, so their bit counts are exact and grow with the corpus, and no table of them
exists; the counts of one and two bytes before, whose number the alphabet bounds, are broadcast.
Weights are learned online over the grams, a gram's own occurrence left out of the counts that predict it, twice by each block
from where the last of two rounds ended, and averaged over the blocks; then the map is learned. Blocks and their order are
given by the grams, so scores don't depend on how rows are dealt. Each distinct gram of the corpus is costed once, in its
block; the costs come back to the chunks in the order of their grams' hashes.

The base is a unigram model: tokens travel as each chunk's distinct words in blocks of a hash, and the
counts come back in the same order, so what is shuffled is each chunk's vocabulary, not its tokens. Words are numbers on the way; only two of
8 bytes and more could share one, with a probability of 2**-63 a pair.

A null text is empty: its only token is the end. Equal rows are scored (and, in training, counted) each; very many of them are
one row with their number on the way. Without
training rows the base is log10(0.5 / 0.5) a token (all counts 0, one pseudo-word) and the model predicts evenly. An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnweave.llm.shared import SPACED, by_bytes, free, lowered, mixed, saved, sums, text_bytes, words_of

REACH = 5
WORD = 6
ORDERS = (1, 2, 3, 4, REACH, WORD)
END = 255  # no byte of UTF-8
#: Grams of a block that are handled at a time; those of one context of three bytes stay together.
UNIT = 1 << 17
LEVELS = 5
GATES = 8 * LEVELS * LEVELS
STEPS = 33
CHUNK_BYTES = 8 << 20
SLICE_BYTES = 1 << 18
_DELTA = np.float32(0.25)

_T = mixed(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)
_P = mixed(np.arange(2001, 2065, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)


# -- grams ------------------------------------------------------------------


def grams(raw: np.ndarray, at: np.ndarray, words: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of each byte and end symbol of the texts: in the lower 48 bits the byte and the 5 before it, in the upper 16 a hash of what the word so far holds before those (0: nothing); and the n + 1 places where texts begin. `words` are those of words_of()."""
    starts, stops, first = words_of(raw, at, SPACED) if words is None else words
    n = np.diff(at)
    where = at[:-1] + np.arange(n.size) * (REACH + 1)  # each text is led by REACH end symbols and followed by one
    padded = np.full(raw.size + n.size * (REACH + 1) + 8, END, np.uint8)
    own = np.zeros(padded.size, bool)
    own[:-8] = True
    for d in range(REACH):
        own[where + d] = False
    own[where + REACH + n] = False
    padded[own] = raw
    # The REACH + 1 bytes from each place on, read as one big-endian number.
    out = np.ndarray(max(0, padded.size - 8 - REACH), "<u8", padded, strides=(1,)).copy().byteswap(inplace=True)
    out >>= np.uint64(8 * (7 - REACH))
    # Of a word, all but the last REACH bytes are before the reach of what follows them.
    size = stops - starts - REACH
    long = np.flatnonzero(size > 0)
    size, start = size[long], (starts + np.repeat(where + REACH - at[:-1], np.diff(first)))[long]
    place = np.cumsum(size) - size
    nth = np.arange(size.sum()) - np.repeat(place, size)
    far = nth + np.repeat(start, size)
    value = _T[padded[far]] * _P[nth & 63]
    h = np.cumsum(value, dtype=np.uint32)
    h -= np.repeat(h[place] - value[place], size)
    h += (nth + 1).astype(np.uint32)
    h *= np.uint32(0x7FEB352D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x846CA68B)
    out[far + 1] |= (h >> np.uint32(16) | np.uint32(1)).astype(np.uint64) << np.uint64(48)
    keep = np.ones(out.size, bool)
    for d in range(1, REACH + 1):  # windows that end in the next text's lead
        edge = where[1:] - d
        keep[edge[edge >= 0]] = False
    return out[keep], np.concatenate([[0], np.cumsum(n + 1)])


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if sorted_keys.size else np.zeros(0, np.int64)


#: Grams times this are their hashes: the order in which costs travel. It is odd, so no two grams share one.
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _by_hash(gram: np.ndarray, n_distinct: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of grams by their hashes, and where each of the n_distinct runs of equal ones begins. Places ride in the lower bits of the sorted hashes, which is several times as fast as an argsort; where upper bits agree, which shows in fewer runs, whole hashes decide."""
    h, bits = gram * _ODD, np.uint64(int(gram.size).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    key = h & ~low
    for lo in range(0, key.size, 1 << 16):  # in parts, which stay in the cache
        key[lo : lo + (1 << 16)] |= np.arange(lo, min(lo + (1 << 16), key.size), dtype=np.uint64)
    key.sort()
    head = _runs(key >> bits)
    key &= low
    order = key.view(np.int64)
    if head.size == n_distinct:
        return order, head
    h = h[order]
    mixed_up = np.unique(np.searchsorted(head, np.setdiff1d(_runs(h), head, assume_unique=True), side="right") - 1)
    for lo, hi in zip(head[mixed_up], np.append(head, h.size)[mixed_up + 1], strict=True):
        own = lo + np.argsort(h[lo:hi], kind="stable")
        order[lo:hi], h[lo:hi] = order[own], h[own]
    return order, _runs(h)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with their counts' sums."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, c = k[order], c[order]
    head = _runs(k)
    return k[head], (np.add.reduceat(c, head) if k.size else c)


# -- the model ---------------------------------------------------------------


def _context(order: int, gram: np.ndarray) -> np.ndarray:
    """The order's contexts as numbers."""
    context = gram >> np.uint64(8)
    if order == WORD:  # with nothing before reach, the bytes from the last white space on
        short = gram >> np.uint64(48) == 0
        for d in range(1, REACH):
            blank = short & ~SPACED[((gram >> np.uint64(8 * d)) & np.uint64(255)).astype(np.uint8)]
            context[blank] &= np.uint64((1 << 8 * d) - 1)
            short &= ~blank
    else:
        context &= np.uint64((1 << 8 * order) - 1)
    return context


def _bit_counts(key: np.ndarray, count: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each bit of the last bytes of sorted keys, the last first: where what precedes it changes, and how often a zero and a one are there. Each bit's counts are summed from those of the bit behind it."""
    head = _runs(key)
    total = np.add.reduceat(count, head)
    for j in range(7, -1, -1):
        node = key[head] >> np.uint64(7 - j)
        up = _runs(node >> np.uint64(1))
        ones = np.add.reduceat(total * (node & np.uint64(1)).astype(np.int64), up)
        head, total = head[up], np.add.reduceat(total, up)
        yield j, head, total - ones, ones


class LowOrder:
    """Bit counts after one or two bytes: a row of 256 places (the first bits of the byte behind, led by a one) for each context that occurs, and one of zeros for the others."""

    def __init__(self, order: int, key: np.ndarray, count: np.ndarray):
        key, count = _summed([key & np.uint64((1 << 8 * (order + 1)) - 1)], [count])
        contexts, row = np.unique(key >> np.uint64(8), return_inverse=True)
        self.mask = np.uint64((1 << 8 * (order + 1)) - 1)
        self.rows = np.full(1 << 8 * order, contexts.size, np.int32)
        self.rows[contexts.astype(np.int64)] = np.arange(contexts.size)
        self.n = np.zeros((2, (contexts.size + 1) * 256), np.float32)
        for j, head, zeros, ones in _bit_counts(key, count) if key.size else ():
            place = row[head] * 256 + ((key[head] & np.uint64(255) | np.uint64(256)) >> np.uint64(8 - j)).astype(np.int64)
            self.n[0, place], self.n[1, place] = zeros, ones

    def counts(self, gram: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """As _bit_counts(), of the contexts of these grams; neighbours that agree are looked up once."""
        key = gram & self.mask
        head = np.arange(key.size)
        for j in range(7, -1, -1):
            head = head[_runs(key[head] >> np.uint64(8 - j))]
            some = key[head]
            place = self.rows[(some >> np.uint64(8)).astype(np.int64)].astype(np.int64) * 256 + ((some & np.uint64(255) | np.uint64(256)) >> np.uint64(8 - j)).astype(np.int64)
            yield j, head, self.n[0, place], self.n[1, place]


def low_orders(key: np.ndarray, count: np.ndarray) -> dict[int, LowOrder]:
    """The counts of the contexts of one and two bytes, from counts of three bytes in a row."""
    return {order: LowOrder(order, key, count) for order in (1, 2)}


class Weights:
    """weights (gates, inputs) and refine (gates, steps), the adaptive map's log odds: all of the model but for its counts."""

    def __init__(self, weights: np.ndarray | None = None, refine: np.ndarray | None = None):
        self.weights, self.refine = weights, refine
        if weights is None:
            self.weights = np.full((GATES, len(ORDERS) + 1), 0.3, np.float32)
            self.weights[:, -1] = 0

    @staticmethod
    def step(z: np.ndarray) -> np.ndarray:
        return np.rint(np.clip(z, -8, 8) * 2).astype(np.int64) + STEPS // 2

    def refined(self, z: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return z if self.refine is None else 0.5 * (z + self.refine[gate, self.step(z)])


class Block:
    """What the contexts predict for each bit of given grams (sorted, distinct), which are all there are of their contexts of three bytes: bit counts are exact, none is shared with another context. With `leave_out`, a bit's own occurrence is left out of the counts that predict it."""

    def __init__(self, gram: np.ndarray, count: np.ndarray, low: dict[int, LowOrder], leave_out: bool = False):
        self.gram, self.leave_out = gram, leave_out
        self.odds = np.empty((8, len(ORDERS), gram.size), np.float32)
        self.level = np.empty((8, 2, gram.size), np.int8)
        self.bit = np.stack([(gram >> np.uint64(7 - j)).astype(np.uint8) & np.uint8(1) for j in range(8)])
        for k, order in enumerate(ORDERS):
            if order in low:
                for j, head, zeros, ones in low[order].counts(gram):
                    self._put(j, k, slice(None), gram.size, head, zeros, ones)
                continue
            key = _context(order, gram) << np.uint64(8) | gram & np.uint64(255)
            at = np.argsort(key)
            for j, head, zeros, ones in _bit_counts(key[at], count[at]):
                self._put(j, k, at, at.size, head, zeros, ones)
        # Words of which less than two bytes are there may stand in other blocks as well: they are contexts of low order.
        last, second = (~SPACED[((gram >> np.uint64(8 * d)) & np.uint64(255)).astype(np.uint8)] for d in (1, 2))
        for order, short in ((1, last), (2, second & ~last)):
            at = np.flatnonzero(short)
            for j, head, zeros, ones in low[order].counts(gram[at]):
                self._put(j, ORDERS.index(WORD), at, at.size, head, zeros, ones)

    def _put(self, j: int, k: int, at: np.ndarray | slice, n: int, head: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> None:
        """For the n grams at these places: what the counts predict, which are the same from each head to the next."""
        zeros, ones = zeros.astype(np.float32), ones.astype(np.float32)
        size = np.diff(np.append(head, n))
        if self.leave_out:  # a zero's own occurrence, or a one's
            zeros, ones = np.stack([np.maximum(zeros - 1, 0), zeros], 1).ravel(), np.stack([ones, np.maximum(ones - 1, 0)], 1).ravel()
            of = np.repeat(np.arange(0, zeros.size, 2), size)
            of += self.bit[j, at]
            spread = lambda x: x[of]
        else:
            spread = lambda x: np.repeat(x, size)
        self.odds[j, k, at] = spread(np.log(ones + _DELTA) - np.log(zeros + _DELTA))
        if k >= len(ORDERS) - 2:
            seen = zeros + ones
            self.level[j, k - len(ORDERS) + 2, at] = spread((seen >= 1).astype(np.int8) + (seen >= 2) + (seen >= 4) + (seen >= 16))

    def gate(self, j: int, at: np.ndarray) -> np.ndarray:
        return (j * LEVELS + self.level[j, 1, at].astype(np.int64)) * LEVELS + self.level[j, 0, at]

    def inputs(self, at: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each bit of the grams at these places: the predictions as log odds (n, inputs), the gate, the bit, its count. Neighbours that agree up to the bit are one row."""
        gram = self.gram[at]
        for j in range(8):
            head = _runs(gram >> np.uint64(7 - j))
            x = np.ones((head.size, len(ORDERS) + 1), np.float32)
            x[:, :-1] = self.odds[j][:, at[head]].T
            yield x, self.gate(j, at[head]), ((gram[head] >> np.uint64(7 - j)) & np.uint64(1)).astype(np.int64), np.add.reduceat(count, head)

    def mixed(self, model: Weights, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip(np.einsum("ij,ij->i", x, model.weights[gate]), -12, 12)

    def learn(self, model: Weights, count: np.ndarray, rate: float, batch: int = 16, group: int = 256) -> None:
        """Online steps over batches of groups of neighbouring grams, in an order that doesn't depend on their bytes, each gram weighed by its count."""
        some = np.flatnonzero(count)
        order = np.random.default_rng(some.size).permutation(-(-some.size // group)) * group
        for lo in range(0, order.size, batch):
            index = (order[lo : lo + batch, None] + np.arange(group)).ravel()
            index = some[index[index < some.size]]
            for x, gate, bit, w in self.inputs(index, count[index].astype(np.float64)):
                error = (bit - 1 / (1 + np.exp(-self.mixed(model, x, gate)))) * w
                place = (gate[:, None] * x.shape[1] + np.arange(x.shape[1])).ravel()
                push, bend = (np.bincount(place, v.ravel(), model.weights.size).reshape(model.weights.shape) for v in (error[:, None] * x, w[:, None] * x * x))
                size = np.bincount(gate, w, GATES)[:, None]
                model.weights += rate * (push / (0.25 * bend + 0.02 * size + 50)).astype(np.float32)

    def costs(self, model: Weights, batch: int = 1 << 14) -> np.ndarray:
        """log10 of the probability of each gram's last byte after the others."""
        weights = np.ascontiguousarray(model.weights.T)
        out = np.zeros(self.gram.size)
        for lo in range(0, self.gram.size, batch):
            part = self.gram[lo : lo + batch]
            total = np.zeros(part.size, np.float32)
            for j in range(8):
                # Neighbours that agree up to a bit share its cost: grams are sorted.
                head = _runs(part >> np.uint64(7 - j))
                gate = self.gate(j, lo + head)
                z = weights[-1][gate]
                for k in range(len(ORDERS)):
                    z += weights[k][gate] * self.odds[j, k, lo + head]
                z = model.refined(np.clip(z, -12, 12), gate)
                bit = ((part[head] >> np.uint64(7 - j)) & np.uint64(1)).astype(bool)
                total -= np.repeat(np.log1p(np.exp(np.where(bit, -z, z))), np.diff(np.append(head, part.size)))
            out[lo : lo + part.size] = total
        return out / np.log(10)


def _units(gram: np.ndarray) -> Iterator[np.ndarray]:
    """A block's grams in parts of about UNIT, as sorted places; a context of three bytes is in one part."""
    last = (gram >> np.uint64(8)) & np.uint64(0xFFFFFF)
    order = np.argsort(last, kind="stable")
    head = _runs(last[order])
    first = head[np.flatnonzero(np.diff(head // UNIT, prepend=-1))]
    for lo, hi in zip(first, np.append(first[1:], gram.size), strict=True):
        yield np.sort(order[lo:hi])


# -- words -------------------------------------------------------------------


_W = mixed(np.arange(5001, 5257, dtype=np.uint64))
_V = mixed(np.arange(6001, 6065, dtype=np.uint64)) | np.uint64(1)


def _word_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    size = ends - starts
    if not size.size:
        return np.zeros(0, np.uint64)
    place = np.concatenate([[0], np.cumsum(size)])
    nth = np.arange(place[-1]) - np.repeat(place[:-1], size)
    value = _W[raw[nth + np.repeat(starts, size)]] * _V[nth & 63]
    far = np.flatnonzero(nth > 63)
    value[far] *= mixed(nth[far] >> 6) | np.uint64(1)
    return mixed(np.add.reduceat(value, place[:-1]) + size.astype(np.uint64))


def word_codes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words as numbers: one of up to 7 bytes is its length and bytes, a longer one a hash of 63 bits, led by a one."""
    size = ends - starts
    wide = np.concatenate([raw, np.zeros(8, np.uint8)])
    out = np.ndarray(raw.size, "<u8", wide, strides=(1,))[starts] if raw.size else np.zeros(0, np.uint64)
    short = np.minimum(size, 7).astype(np.uint64)
    out &= (np.uint64(1) << np.uint64(8) * short) - np.uint64(1)
    out |= short << np.uint64(56)
    long = np.flatnonzero(size > 7)
    out[long] = _word_hash(raw, starts[long], ends[long]) | np.uint64(1 << 63)
    return out


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and the place among them of each."""
    order = np.argsort(x)
    head = _runs(x[order])
    which = np.empty(x.size, np.int64)
    which[order] = np.repeat(np.arange(head.size), np.diff(np.append(head, x.size)))
    return x[order[head]], which


def _slices(table: pa.Table) -> Iterator[pa.RecordBatch]:
    for batch in table.to_batches():
        yield from by_bytes(batch, "text", SLICE_BYTES)


def _squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _plain(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _planes(x: np.ndarray) -> bytes:
    """Unsigned numbers by planes of bytes, led by the number of planes that aren't all zero."""
    n = (int(x.max()).bit_length() + 7) // 8 if x.size else 0
    planes = np.empty((n, x.size), np.uint8)
    for k in range(n):
        planes[k] = x >> np.uint64(8 * k)  # the lowest byte of each
    return bytes([n]) + planes.tobytes()


def _pack_grams(gram: np.ndarray, count: np.ndarray) -> bytes:
    """Sorted grams as differences, by planes of bytes, which pack well."""
    return _squeezed(gram.size.to_bytes(8, "little") + _planes(np.diff(gram, prepend=np.uint64(0))) + _planes(count.astype(np.uint64)))


def _unpack_grams(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(_plain(data), np.uint8)
    size, at, out = int(data[:8].view("<u8")[0]), 8, []
    for _ in range(2):
        n, at = int(data[at]), at + 1
        x = np.zeros((size, 8), np.uint8)
        for k in range(n):
            x[:, k] = data[at + k * size : at + (k + 1) * size]
        at += n * size
        out.append(x.view("<u8").ravel())
    return np.cumsum(out[0]), out[1].view(np.int64)


def _pack_costs(cost: np.ndarray) -> bytes:
    return _squeezed(cost.astype("<f4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack_costs(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_plain(data), np.uint8).reshape(4, -1).T).view("<f4").ravel()


# -- the passes ----------------------------------------------------------------


def _blocks(key: np.ndarray, n_blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of sorted numbers by blocks of a hash of their keys, the blocks, and where each begins and the last ends."""
    block = (mixed(key) % np.uint64(n_blocks)).astype(np.uint16 if n_blocks <= 1 << 16 else np.int64)  # short numbers are sorted by radix
    order = np.argsort(block, kind="stable")
    block = block[order]
    first = _runs(block)
    return order, block[first], np.append(first, key.size)


def _gram_key(gram: np.ndarray) -> np.ndarray:
    """Blocks of grams go by the last three bytes before: what longer contexts count lies in one block then."""
    return (gram >> np.uint64(8)) & np.uint64(0xFFFFFF)


def _gathered(n_blocks: int):
    """For a chunk: all its distinct grams with their training counts (kind 0) and all its distinct words with their training counts (kind 1), by block; and its training texts' number (kind 2)."""

    def run(table: pa.Table) -> pa.Table:
        words, uses, found = [], [], []
        chunk = table.column("chunk")[0].as_py()
        weight = np.where(table.column(3).to_numpy(), 0, table.column(4).to_numpy())
        # Rows that count once, not, and (as they stand for several) more than once.
        for some in (weight == 1, weight == 0, weight > 1):
            keys, times = [], []
            for part in _slices(table.filter(pa.array(some))):
                raw, at = text_bytes(part.column(2))
                raw = lowered(raw)
                starts, stops, first = of = words_of(raw, at, SPACED)
                code, which = _distinct(word_codes(raw, starts, stops))
                train = np.where(part.column(3).to_numpy(zero_copy_only=False), 0, part.column(4).to_numpy())
                words.append(code)
                uses.append(np.bincount(which, np.repeat(train, np.diff(first)), code.size).astype(np.int64))
                gram, begin = grams(raw, at, of)
                keys.append(gram)
                if train[0] > 1:
                    times.append(np.repeat(train, np.diff(begin)))
            gram = np.concatenate([np.zeros(0, np.uint64), *keys])
            del keys
            if times:
                found.append(_summed([gram], times))
                continue
            gram.sort()
            head = _runs(gram)
            found.append((gram[head], np.diff(np.append(head, gram.size)) * int(weight[some][0]) if gram.size else head))
        ends = int(weight.sum())
        (gram, count), (more, zero), many = found
        # Those that don't count are put between those that do: both are sorted.
        place = np.searchsorted(gram, more)
        new = np.append(gram, ~more[-1:])[place] != more if more.size else np.zeros(0, bool)
        gram, count = np.insert(gram, place[new], more[new]), np.insert(count, place[new], zero[new])
        if many[0].size:
            gram, count = _summed([gram, many[0]], [count, many[1]])
        rows = []
        for kind, (number, n, key) in enumerate(((gram, count, _gram_key(gram)), (own := _summed(words, uses))[:2] + (own[0],))):
            order, which, first = _blocks(key, n_blocks)
            number, n = number[order], n[order]
            rows += [(kind, int(b), chunk, _pack_grams(number[lo:hi], n[lo:hi]), 0) for b, lo, hi in zip(which, first[:-1], first[1:], strict=True)]
        if ends:
            rows.append((2, -1, chunk, b"", ends))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else ([],) * 5, (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64()), strict=True)], ["kind", "block", "chunk", "payload", "ends"])

    return run


def _sum_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's grams from all chunks; what is held are the distinct ones and some payloads."""
    keys, counts, block = [], [], None
    for batch in batches:
        block = batch.column(batch.schema.get_field_index("block"))[0].as_py() if batch.num_rows else block
        for k, c in _held([batch]):
            keys.append(k)
            counts.append(c)
            if len(keys) == 64:
                k, c = _summed(keys, counts)
                keys, counts = [k], [c]
    k, c = _summed(keys, counts)
    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([_pack_grams(k, c)], pa.binary())], ["block", "payload"])


def _sum_words(table: pa.Table) -> pa.Table:
    """For a block: each chunk's words' counts over all chunks, and (in one row) the number of words counted and their counts' sum."""
    chunks, parts = table.column("chunk").to_pylist(), list(_held(table.to_batches()))
    code, total = _summed(*map(list, zip(*parts, strict=True)))
    out = [_squeezed(total[np.searchsorted(code, own)].astype("<i8").tobytes()) for own, _ in parts]
    zero = [0] * (len(out) - 1)
    return pa.Table.from_arrays(
        [pa.array([table.column("block")[0].as_py()] * len(out), pa.int64()), pa.array(chunks, pa.int64()), pa.array(out, pa.binary()), pa.array([int((total > 0).sum()), *zero], pa.int64()), pa.array([int(total.sum()), *zero], pa.int64())],
        ["block", "chunk", "payload", "n_words", "n_tokens"],
    )


def _triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training counts of a byte and the two before it."""
    for gram, count in _held(batches):
        k, n = _summed([gram & np.uint64(0xFFFFFF)], [count])
        yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], ["key", "n"])


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The grams of each block and their counts."""
    for b in batches:
        for data in b.column("payload"):
            yield _unpack_grams(data.as_buffer().to_pybytes())


def _collected(table: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int) -> np.ndarray:
    """The sum over all tasks of an array of that size, added up by Spark: what comes to the driver is one such array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = make(batches)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["place", "n"])

    out = np.zeros(size)
    for r in table.mapInArrow(run, "place long, n double").groupBy("place").agg(F.sum("n").alias("n")).collect():
        out[r.place] = r.n
    return out


def fit(grams_table: DataFrame, rounds: int = 2, passes: int = 2, rate: float = 1.5) -> tuple[Broadcast, Weights]:
    """The model of a table of blocks of grams: the counts of low orders, broadcast, its weights and its map. What comes to the driver has a bounded size (at most 2**24 counts of three bytes in a row).

    Each block learns from where the last round ended, and the blocks' weights are averaged by their counts: blocks are a hash of the grams, so the result doesn't depend on which task has which."""
    sc = grams_table.sparkSession.sparkContext
    triples = grams_table.mapInArrow(_triples, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 0").toArrow()
    low = low_orders(triples.column("key").to_numpy().view(np.uint64), triples.column("n").to_numpy())
    del triples
    shared, model = sc.broadcast(low), Weights()
    del low

    def weights_of(start: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            out = np.zeros(start.size + 1)
            for gram, count in _held(batches):
                now = Weights(start.copy())
                for at in _units(gram):
                    block = Block(gram[at], count[at], shared.value, True)
                    for _ in range(passes):
                        block.learn(now, count[at], rate)
                out[:-1] += now.weights.ravel().astype(np.float64) * count.sum()
                out[-1] += count.sum()
            return out

        return run

    for _ in range(rounds):
        total = _collected(grams_table, weights_of(model.weights), model.weights.size + 1)
        if total[-1]:
            model = Weights((total[:-1] / total[-1]).reshape(model.weights.shape).astype(np.float32))

    def tally(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        n = np.zeros(GATES * STEPS * 2)
        for gram, count in _held(batches):
            for unit in _units(gram):
                own, w_of = Block(gram[unit], count[unit], shared.value, True), count[unit].astype(np.float64)
                some = np.flatnonzero(w_of)
                for lo in range(0, some.size, 1 << 14):
                    at = some[lo : lo + (1 << 14)]
                    for x, gate, bit, w in own.inputs(at, w_of[at]):
                        n += np.bincount((gate * STEPS + model.step(own.mixed(model, x, gate))) * 2 + bit, w, n.size)
        return n

    n = _collected(grams_table, tally, GATES * STEPS * 2).reshape(GATES, STEPS, 2)
    mid = (np.arange(STEPS) - STEPS // 2) / 2
    p = 1 / (1 + np.exp(-mid))
    return shared, Weights(model.weights, np.log((n[..., 1] + 20 * p) / (n[..., 0] + 20 * (1 - p))).astype(np.float32))


def _costs(shared: Broadcast, model: Weights):
    """For a block: the costs of each chunk's grams, in the order of their hashes."""

    def run(summed: pa.Table, chunks: pa.Table) -> pa.Table:
        ((gram, count),) = _held(summed.to_batches())
        cost = np.zeros(gram.size, np.float32)
        for at in _units(gram):
            cost[at] = Block(gram[at], count[at], shared.value).costs(model)
        out = [_pack_costs(cost[np.searchsorted(gram, own)][np.argsort(own * _ODD)]) for own, _ in _held(chunks.to_batches())]
        return pa.Table.from_arrays([pa.array([0] * len(out), pa.int32()), chunks.column("block"), chunks.column("chunk"), pa.array(out, pa.binary())], ["kind", "block", "chunk", "payload"])

    return run


_SCORED = "id {}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, copies long"


def _scored(n_blocks: int, n: int, v: int, ends: int):
    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        log = lambda c: np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
        held, words, keys = [], [], []
        for part in _slices(docs):
            raw, at = text_bytes(part.column(2))
            raw = lowered(raw)
            starts, stops, first = of = words_of(raw, at, SPACED)
            code, which = _distinct(word_codes(raw, starts, stops))
            gram, begin = grams(raw, at, of)
            held.append((part.column(1), part.column(3), part.column(4), np.diff(at), first, which, begin))
            words.append(code)
            keys.append(gram)
        found = {(k, b): x.as_buffer() for k, b, x in zip(back.column("kind").to_pylist(), back.column("block").to_pylist(), back.column("payload"), strict=True)}

        def given(kind: int, key: np.ndarray, read: Callable[[bytes], np.ndarray], like: type) -> np.ndarray:
            """What came back for distinct numbers, which went by blocks, in the order in which they did within those."""
            order, blocks, _ = _blocks(key, n_blocks)
            back_of = np.empty(key.size, like)
            back_of[order] = np.concatenate([np.zeros(0, like), *(read(found[kind, int(b)].to_pybytes()) for b in blocks)])
            return back_of

        own = np.sort(np.concatenate(words))
        own = own[_runs(own)]
        count = given(1, own, lambda x: np.frombuffer(_plain(x), "<i8"), np.int64)
        logs, known = log(count), (count > 0).astype(np.int8)
        # The costs of the chunk's distinct grams come in the order of their hashes.
        gram = np.concatenate(keys)
        sizes = np.cumsum([k.size for k in keys])
        del keys
        order, head = _by_hash(gram, sum(int.from_bytes(x[:8], "little") // 4 for (kind, _), x in found.items() if kind == 0))
        each = given(0, _gram_key(gram[order[head]]), _unpack_costs, np.float32)
        cost = np.empty(gram.size, np.float32)
        cost[order] = np.repeat(each, np.diff(np.append(head, gram.size)))
        del gram, order
        out = []
        for (ids, tested, copies, size, first, which, begin), words_of_part, own_cost in zip(held, words, np.split(cost, sizes[:-1]), strict=True):
            code = np.searchsorted(own, words_of_part)[which]
            out.append(pa.RecordBatch.from_arrays(
                [ids, tested, pa.array(np.diff(first) + 1), pa.array(sums(known[code], first) + int(ends > 0)), pa.array(np.full(size.size, n)), pa.array(sums(logs[code], first) + log(ends)), pa.array(sums(own_cost.astype(np.float64), begin)), pa.array(size), copies],
                ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "copies"],
            ))
        return pa.Table.from_batches(out)

    return run


def _rows(docs: DataFrame, held_out: Column, id_col: str, text_col: str, chunk_bytes: int) -> tuple[DataFrame, int]:
    """Rows (id, text, held, copies) for those of docs, and their bytes. Equal rows become one with their number where they would fill much of a chunk, combined in part before they are shuffled."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    sizes = own.groupBy("id", "held", F.xxhash64("text").alias("body"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size")).agg(F.count("*").alias("n"))
    sizes = saved(sizes, "lm-copies")
    n_bytes = sizes.agg(F.coalesce(F.sum(F.col("n") * F.col("size")), F.lit(0))).first()[0]
    often = sizes.where((F.col("n") > 1) & (F.col("n") * (F.col("size") + 100) > chunk_bytes // 4)).select(F.struct("id", "held", "body").alias("often")).distinct()
    single = own.withColumn("copies", F.lit(1).cast("long"))
    if often.isEmpty():
        free(sizes)
        return single, n_bytes
    same = F.struct("id", "held", F.xxhash64("text").alias("body")).eqNullSafe(F.col("often"))
    merged = own.join(F.broadcast(often), same, "left_semi").groupBy("id", "text", "held").agg(F.count("*").alias("copies"))
    return single.join(F.broadcast(often), same, "left_anti").unionByName(merged), n_bytes


def lm_scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the model's probability of the text and its end), n_bytes, bits_per_byte (of n_bytes + 1 symbols). Where held_out is null, it is false."""
    rows, sized = _rows(docs, held_out, id_col, text_col, chunk_bytes)
    n_chunks = max(1, -(-sized // chunk_bytes))
    n_blocks = int(np.ceil(4 * n_chunks ** (2 / 3)))
    rows = rows.select(F.pmod(F.xxhash64("id", "text"), F.lit(n_chunks)).alias("chunk"), "id", "text", "held", "copies")
    gathered = saved(rows.groupBy("chunk").applyInArrow(_gathered(n_blocks), "kind int, block long, chunk long, payload binary, ends long"), "lm-gathered")
    summed = saved(gathered.where("kind = 0").select("block", "payload").groupBy("block").applyInArrow(_sum_grams, "block long, payload binary"), "lm-grams")
    counts = saved(gathered.where("kind = 1").select("block", "chunk", "payload").groupBy("block").applyInArrow(_sum_words, "block long, chunk long, payload binary, n_words long, n_tokens long"), "lm-words")
    v, n = counts.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    ends = gathered.where("kind = 2").agg(F.coalesce(F.sum("ends"), F.lit(0))).first()[0]
    n, v = n + ends, v + int(ends > 0)
    costs = summed.groupBy("block").cogroup(gathered.where("kind = 0").select("block", "chunk", "payload").groupBy("block"))
    costs = saved(costs.applyInArrow(_costs(*fit(summed)), "kind int, block long, chunk long, payload binary"), "lm-costs")
    free(gathered, summed)
    back = costs.unionByName(counts.select(F.lit(1).alias("kind"), "block", "chunk", "payload"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(_scored(n_blocks, n, v, ends), _SCORED.format(kind))
    # Rows that stood for several, in steps that no array is long for.
    step = 1 << 16
    out = out.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / step)))).withColumn("part", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(step).cast("long"), F.col("copies") - step * F.col("part")))))
    return out.drop("copies", "part").withColumnRenamed("id", id_col).withColumn("bits_per_byte", -F.col("score") * float(np.log2(10)) / (F.col("n_bytes") + 1))
