"""Token counts: batch encoding in Arrow functions that return lengths only.

Batches are balanced by bytes, and long texts are split where the vocabulary's own pre-tokenizer always splits, so that
one long text is neither one huge call nor counted differently. Null texts count as empty (0 tokens); a text without a
safe boundary stays whole; repeated rows are counted each; an empty table gives an empty result. Columns of other
names are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnweave.llm.shared import by_bytes

#: Where byte-level pre-tokenizers end one token and begin the next whatever surrounds it: before white space that follows something else (no token has it
#: but at its beginning), and between wide punctuation and a letter or number, for scripts that are written without spaces.
_SAFE = re.compile(r"(?<=\S)(?=[ \n\t\r])|(?<=[。，、！？；：])(?=[^\W_])")


#: White space beyond which the engine's pattern overflows its stack (at some hundred thousand characters).
LONG_SPACE = 50_000
_LONG_SPACE = re.compile(r"\s{%d}" % LONG_SPACE)


def safe_pieces(text: str, limit: int) -> list[str]:
    """The text in pieces of about `limit` characters, cut at safe boundaries only; joined they give the text."""
    out, start = [], 0
    while len(text) - start > limit:
        found = _SAFE.search(text, start + limit)
        if not found:
            break
        out.append(text[start : found.start()])
        start = found.start()
    return [*out, text[start:]]


def _ranks(model: dict) -> dict[bytes, int]:
    """The byte strings of a byte-level vocabulary whose ids are the merges' ranks; the 256 bytes have visible stand-ins in the file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    return {bytes(byte_of[c] for c in token): rank for token, rank in model["vocab"].items() if all(c in byte_of for c in token)}


def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary; of added tokens, their text."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    known = {rank: token for token, rank in _ranks(spec["model"]).items()} | {x["id"]: x["content"].encode() for x in spec["added_tokens"]}
    return [known.get(k, b"") for k in range(max(known) + 1)]


@lru_cache(4)
def encoder(path: str, plain: bool = False) -> tuple[Callable[[str], list[int]], bool]:
    """From a text to its ids as the tokenizers library gives them, without added special tokens; and whether texts may be split for it (see safe_pieces).

    A byte-level BPE without normaliser, whose ids are ranks, is run by tiktoken's engine over the same file (4 times as
    fast; tests hold it against the library); special strings inside a text get their own ids, as by the library's default, or are
    text as any other if `plain`. Anything else is run by the library, and so is a piece with over LONG_SPACE characters of white space in a row.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    before = spec.get("pre_tokenizer") or {}
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    simple = all(x["special"] and not (x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"]) for x in spec["added_tokens"])
    merges = [x if isinstance(x, str) else " ".join(x) for x in spec["model"].get("merges", [])]
    vocab = spec["model"].get("vocab", {})
    ranked = isinstance(vocab, dict) and all(vocab.get(m.replace(" ", "")) == 256 + k for k, m in enumerate(merges))
    # A special string that a cut could go through would be taken apart.
    may_split = before.get("type") == "ByteLevel" and bool(before.get("use_regex")) and not spec["normalizer"] and not any(_SAFE.search(x) for x in special)

    @lru_cache(1)
    def library() -> Callable[[str], list[int]]:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.no_truncation()
        model.no_padding()
        model.encode_special_tokens = plain
        return lambda text: model.encode(text, add_special_tokens=False).ids

    if simple and ranked and spec["model"]["type"] == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not spec["normalizer"]:
        import tiktoken

        # The pre-tokenizer's fixed pattern.
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        engine = tiktoken.Encoding("byte_level", pat_str=pattern, mergeable_ranks=_ranks(spec["model"]), special_tokens=special)

        def encode(text: str) -> list[int]:
            if len(text) >= LONG_SPACE and _LONG_SPACE.search(text):
                return library()(text)
            return engine.encode(text, allowed_special="all") if not plain and any(x in text for x in special) else engine.encode_ordinary(text)

        return encode, may_split
    return library(), may_split


@lru_cache(4)
def _counter(path: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    """A function from texts to token counts; whether texts may be split for it."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], False
    encode, may_split = encoder(path)
    return lambda texts: [len(encode(x)) for x in texts], may_split


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 1 << 20, piece_chars: int = 1 << 16) -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit). `vocabulary` is a path that executors can open."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, may_split = _counter(vocabulary)
        for batch in batches:
            for part in by_bytes(batch, "text", batch_bytes):
                raw = part.column(1)
                size = np.diff(np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, raw.offset * 8))
                pieces: list[str] = []
                owner: list[int] = []
                for k, text in enumerate(raw.cast(pa.large_string()).to_pylist()):
                    cut = safe_pieces(text, piece_chars) if may_split and len(text) > piece_chars else [text]
                    pieces += cut
                    owner += [k] * len(cut)
                n = np.bincount(np.array(owner, np.int64), np.array(encode(pieces), np.float64), part.num_rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return rows.withColumnRenamed("id", id_col)
