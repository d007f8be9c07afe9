from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tarnweave.llm.alignment import PIECE_CHARS, align, aligned, group_sizes, pairs_of, vocabulary

from .conftest import SCHEMA, row

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tools():
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    stand_in = {}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    for b in plain:
        stand_in[chr(b)] = b
    for k, b in enumerate(b for b in range(256) if b not in plain):
        stand_in[chr(256 + k)] = b
    names = {k: v for v, k in first.get_vocab().items()}
    second = sentencepiece.SentencePieceProcessor(model_file=B)

    def of_a(text):
        ids = first.encode(" " + text, add_special_tokens=False).ids
        return ids, [bytes(stand_in[c] for c in names[i]) for i in ids]

    def of_b(text):
        ids = second.encode(text, num_threads=1)
        return ids, [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, second.id_to_piece(i)) for i in ids)]

    return of_a, of_b


def groups_of(text, tools):
    """Token by token: groups as lists of ids of either side."""
    if not text:
        return []
    (a, xa), (b, xb) = (f(text) for f in tools)
    whole = b" " + text.encode()
    if b"".join(xa) != whole or b"".join(xb) != whole:
        return []
    ends_a, ends_b = set(np.cumsum([len(x) for x in xa])), set(np.cumsum([len(x) for x in xb]))
    out, at = [([], [])], 0
    i = j = pa = pb = 0
    for stop in sorted(ends_a & ends_b):
        while pa < stop:
            out[-1][0].append(a[i])
            pa += len(xa[i])
            i += 1
        while pb < stop:
            out[-1][1].append(b[j])
            pb += len(xb[j])
            j += 1
        out.append(([], []))
    return out[:-1]


def model(rows, tools):
    found = [(r.doc_id, groups_of(r.text, tools)) for r in rows]
    links = [Counter((x, y) for a, b in groups for x in a for y in b) for _, groups in found]
    n = Counter(p for own in links for p in own)
    best = defaultdict(int)
    for (x, _), k in n.items():
        best[x] = max(best[x], k)
    out = []
    for (doc, groups), own in zip(found, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((doc, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(own.values()), sha256(text.encode()).hexdigest() if groups else None, sum(k for p, k in own.items() if n[p] == best[p[0]]), sum(k * n[p] for p, k in own.items())))
    return sorted(out, key=repr)


def more(spark, docs):
    rows = [row(900, "a▁b"), row(901, "<s> x </s> <unk> <|endoftext|> <0x41>"), row(902, "\x00 zero"), row(903, "  two  spaces \n\t tab "), row(904, "👍🏽 x　y é"), row(None, "no id"), row(905, " "), row(906, "สวัสดีครับ ಕನ್ನಡ"), row(907, "​ end")]
    return docs.unionAll(spark.createDataFrame(rows, SCHEMA))


@pytest.mark.parametrize("broadcast_pairs", [1 << 21, 40, 0])
def test_whole_result(spark, docs, tools, broadcast_pairs):
    df = more(spark, docs)
    assert sorted(map(tuple, aligned(df, A, B, broadcast_pairs=broadcast_pairs).collect()), key=repr) == model(df.collect(), tools)


def test_groups_are_texts(spark, tools):
    texts = ["Hello world", "größer\nniño 3.14", ""]
    rows = {r.doc_id: r for r in align(spark.createDataFrame([row(k, t) for k, t in enumerate(texts)], SCHEMA), A, B, texts=True).collect()}
    for k, t in enumerate(texts):
        groups = groups_of(t, tools)
        assert rows[k].groups == (";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups) or None)


def test_nothing(no_docs):
    assert aligned(no_docs, A, B).count() == 0


@pytest.mark.parametrize("text", ["word and größer " * 9000, " " * 300_000, "x" * 200_000, ("  a" * 30_000 + " b") * 2, "\n" * 120_000 + "end", "日本語、テキスト。" * 9000])
def test_long_texts_are_cut_safely(tools, text):
    assert len(text) > PIECE_CHARS
    for path, tool in zip((A, B), tools):
        assert vocabulary(path).encode(text).tolist() == tool(text)[0]


def test_wide_groups_are_counted_by_ids():
    a, b = np.array([1, 2, 1, 1] * 30), np.array([5, 5, 6] * 30)
    owner, codes, times = pairs_of(a, b, np.array([120]), np.array([90]), np.array([0]), 10)
    assert dict(zip(codes.tolist(), times.tolist())) == {15: 90 * 60, 16: 90 * 30, 25: 30 * 60, 26: 30 * 30} and set(owner) == {0}


def test_labels():
    # Two texts of 5 and 3 bytes: tokens of 2, 3 | 3 and 1, 1, 3 | 1, 2 bytes.
    in_a, in_b, n = group_sizes(np.array([2, 5, 8]), np.array([1, 2, 5, 6, 8]), np.array([0, 5, 8]))
    assert in_a.tolist() == [1, 1, 1] and in_b.tolist() == [2, 1, 2] and n.tolist() == [2, 1]
