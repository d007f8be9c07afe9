"""Chunking expressions: sliding word windows and greedy sentence packing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnweave.functions.text import col, once, strip, words

_STATE = "struct<out:array<string>,cur:string>"


def word_windows(x: Column | str, size: int = 180, overlap: int = 30) -> Column:
    """Windows of `size` words, each `overlap` words into the one before, joined by spaces, until one reaches the end. A text of one window stays as it is; a text without words has none."""
    step = size - overlap

    def windows(w: Column) -> Column:
        n = F.size(w)
        many = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int")), lambda k: F.array_join(F.slice(w, k * step + 1, F.lit(size)), " "))
        return F.when(n == 0, F.expr("cast(array() as array<string>)")).when(n <= size, F.array(col(x))).otherwise(many)

    return once(words(x), windows)


def sentences(x: Column | str) -> Column:
    parts = F.transform(F.split(F.coalesce(col(x), F.lit("")), r"(?<=[.!?])(?U)\s+"), lambda s: strip(s))
    return F.filter(parts, lambda s: s != "")


def _packed(items: Column, most: int, start: Column) -> Column:
    """Items joined by spaces as long as they fit; an item longer than `most` stands alone. The state after all."""

    def step(a: Column, w: Column) -> Column:
        joined = F.when(a["cur"] == "", w).otherwise(F.concat(a["cur"], F.lit(" "), w))
        fits = F.length(joined) <= most
        flushed = F.when(a["cur"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(a["cur"])))
        return F.struct(F.when(fits, a["out"]).otherwise(flushed).alias("out"), F.when(fits, joined).otherwise(w).alias("cur")).cast(_STATE)

    return F.aggregate(items, start, step)


def _empty() -> Column:
    return F.struct(F.expr("cast(array() as array<string>)").alias("out"), F.lit("").alias("cur")).cast(_STATE)


def _flushed(a: Column) -> Column:
    return F.when(a["cur"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(a["cur"])))


def hard_split(x: Column, most: int = 1800) -> Column:
    """Words packed up to `most` characters; a longer word stays whole."""
    return F.aggregate(F.array(_packed(words(x), most, _empty())), F.expr("cast(array() as array<string>)"), lambda _, s: _flushed(s))


def sentence_chunks(x: Column | str, target: int = 1200, most: int = 1800) -> Column:
    """Sentences packed up to `target` characters; one longer than `most` is split at words, apart from its neighbours."""

    def step(a: Column, s: Column) -> Column:
        joined = F.when(a["cur"] == "", s).otherwise(F.concat(a["cur"], F.lit(" "), s))
        long, fits = F.length(s) > most, (a["cur"] == "") | (F.length(joined) <= target)
        out = F.when(long, F.concat(_flushed(a), hard_split(s, most))).when(fits, a["out"]).otherwise(_flushed(a))
        return F.struct(out.alias("out"), F.when(long, "").when(fits, joined).otherwise(s).alias("cur")).cast(_STATE)

    return F.aggregate(sentences(x), _empty(), step, _flushed)
