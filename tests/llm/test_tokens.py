import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tarnweave.llm.packing import pack, piece_lengths
from tarnweave.llm.token_counts import encoder, safe_pieces, token_counts

BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts(docs, name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        of = lambda t: len(m.encode(t, num_threads=1))
    else:
        m = Tokenizer.from_file(path)
        of = lambda t: len(m.encode(t, add_special_tokens=False))
    want = sorted((r.doc_id, len((r.text or "").encode()), of(r.text or ""), of(r.text or "") > 1024) for r in docs.collect())
    assert sorted(map(tuple, token_counts(docs, path, piece_chars=500, batch_bytes=3000).collect())) == want


def test_counts_of_nothing(no_docs):
    assert token_counts(no_docs, BPE).count() == 0


def test_pieces_join():
    text = "some words  and\nlines " * 500 + "x" * 9000
    assert "".join(safe_pieces(text, 100)) == text and max(map(len, safe_pieces(text[:11000], 100))) < 200


def test_cuts_are_safe_in_any_script(library):
    r = random.Random(6)
    parts = ["слово", "λόγος", "日本語。テキスト", "中文，句子", "！", "x", "'s", "42", "½", " ", "  ", "\n", "\t ", "\u3000", "\x1c", "\x85", "é", "👍🏽", "。。", "_", "'", "<|endoftext|>", "<|"]
    encode, _ = encoder(BPE)
    for _ in range(300):
        text = "".join(r.choice(parts) for _ in range(60))
        cut = safe_pieces(text, 5)
        assert "".join(cut) == text and len(cut) > 3
        assert [x for piece in cut for x in encode(piece)] == library.encode(text, add_special_tokens=False).ids, text
    for text in ("слово и ещё " * 9000, "日本語、テキスト。" * 9000):
        assert max(map(len, safe_pieces(text, 1 << 10))) < 1100


def test_lengths():
    for n in range(1, 5000, 7):
        out = piece_lengths(n, 2048)
        assert sum(out) == n and all(x & (x - 1) == 0 for x in out)


def test_engine_is_the_library(docs, library):
    encode, may_split = encoder(BPE)
    assert may_split
    for r in docs.collect():
        assert encode(r.text or "") == library.encode(r.text or "", add_special_tokens=False).ids


def test_pack_round_trip(docs, library):
    rows = pack(docs, BPE, window=64).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and {r.offset for r in rows} == {0}
    assert all(r.length == 1 << r.bucket and len(r.ids) == 4 * r.length for r in rows)
    got = defaultdict(dict)
    for r in rows:
        got[r.doc_id].setdefault(r.start, []).append(r)
    for r in docs.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
        parts = [got[r.doc_id][s][0] for s in sorted(got[r.doc_id])]
        assert np.frombuffer(b"".join(p.ids for p in parts), "<u4").tolist() == ids and {p.doc_tokens for p in parts} == {len(ids)}


def test_crc(docs):
    from pyspark.sql import functions as F

    for r in pack(docs, BPE).select("ids", F.crc32("ids").alias("c")).collect():
        assert r.c == zlib.crc32(r.ids)


def test_pack_nothing(no_docs):
    assert pack(no_docs, BPE).count() == 0


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000, "\t\n 　" * 250_000, "a " + " " * 1_000_000 + "word\n" * 20_000 + "\n" * 60_000 + "<|endoftext|>" + " " * 500_000, "x" * 1_000_000, "!?" * 500_000, "7" * 1_000_000])
def test_very_long_runs(spark, library, text):
    """White space on which the engine's pattern overflows its stack, in both operators and through Spark."""
    docs = spark.createDataFrame([(1, text), (2, "next")], "doc_id long, text string").repartition(1)
    ids = library.encode(text, add_special_tokens=False).ids
    assert {r.doc_id: r.n_tokens for r in token_counts(docs, BPE).collect()} == {1: len(ids), 2: len(library.encode("next").ids)}
    pieces = sorted((r.start, bytes(r.ids)) for r in pack(docs, BPE).where("doc_id = 1").collect())
    assert np.frombuffer(b"".join(x for _, x in pieces), "<u4").tolist() == [*ids, 1]
