"""Many lists of phrases looked for at once: one automaton (Aho-Corasick) reads a text once, however many phrases there are."""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

HIT = "struct<list:string,phrase:string,start:int,stop:int>"


def automaton(lists: dict[str, list[str]]):
    """Of all lists: each phrase once, with the lists that have it."""
    import ahocorasick

    of: dict[str, list[str]] = {}
    for name, phrases in lists.items():
        for p in dict.fromkeys(phrases):
            if p:
                of.setdefault(p, []).append(name)
    out = ahocorasick.Automaton()
    for p, names in of.items():
        out.add_word(p, (p, tuple(names)))
    if of:
        out.make_automaton()
    return out


def longest_first(hits: list[tuple[str, str, int, int]]) -> list[tuple[str, str, int, int]]:
    """Of each list's hits those that a reading from the left takes, the longest at each place; none overlaps another of its list."""
    out, end = [], {}
    for hit in sorted(hits, key=lambda h: (h[2], -h[3])):
        if hit[2] >= end.get(hit[0], 0):
            out.append(hit)
            end[hit[0]] = hit[3]
    return out


def phrase_hits(text: Column, lists: dict[str, list[str]], longest: bool = False) -> Column:
    """Array of (list, phrase, start from 0, stop) in order of start, stop, list: all occurrences, or with `longest` those of each list that a reading from the left takes. Case and characters count as they are; null is empty."""
    made = []
    pairs = sorted({(name, p) for name, ps in lists.items() for p in ps if p})
    at = {pair: n for n, pair in enumerate(pairs)}

    @F.arrow_udf(f"array<{HIT}>")
    def found(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(automaton(lists))
        # Hits are kept as numbers, as those of all texts of a batch are held at once.
        a, which, start, stop, ends = made[0], array("i"), array("i"), array("i"), array("i", [0])
        for t in texts:
            hits = [(name, p, end + 1 - len(p), end + 1) for end, (p, names) in a.iter(t.as_py() or "") for name in names] if len(a) else []
            for h in sorted(longest_first(hits) if longest else hits, key=lambda h: (h[2], h[3], h[0])):
                which.append(at[h[:2]])
                start.append(h[2])
                stop.append(h[3])
            ends.append(len(which))
        numbers = lambda x: pa.array(np.frombuffer(x, np.int32) if len(x) else np.zeros(0, np.int32))
        names, own = (pa.array([p[k] for p in pairs], pa.string()).take(numbers(which)) for k in (0, 1))
        return pa.ListArray.from_arrays(numbers(ends), pa.StructArray.from_arrays([names, own, numbers(start), numbers(stop)], ["list", "phrase", "start", "stop"]))

    return found(text)


def lists_found(hits: Column) -> Column:
    """The names of the lists that have a hit, sorted."""
    return F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["list"])))


def phrases_found(hits: Column, name: str) -> Column:
    """Those phrases of one list that were found, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(hits, lambda h: h["list"] == name), lambda h: h["phrase"])))
