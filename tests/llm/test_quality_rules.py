import re
from collections import Counter

import numpy as np

from tarnweave.llm.quality_rules import fit, quality_rules


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    n = Counter(windows)
    hit = {k + d for k, w in enumerate(windows) if n[w] > 1 for d in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_against_brute_force(docs):
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules(docs).collect())
    want = []
    for r in docs.collect():
        b = brute(r.text)
        want.append((r.doc_id, *b, b[0] < 10 or 100 * b[4] > 20 * b[0]))
    assert got == sorted(want)


def test_kept_needs_the_base(docs):
    rows = quality_rules(docs).collect()
    assert not any(r.kept and r.base_failed for r in rows) and all(0 <= r.quality <= 1 for r in rows)


def test_nothing(no_docs):
    assert quality_rules(no_docs).count() == 0


def test_em_finds_good_and_bad_rules():
    r = np.random.default_rng(0)
    truth = r.random(20000) < 0.8
    right = np.array([0.95, 0.9, 0.85, 0.7, 0.55])
    votes = np.where(r.random((20000, 5)) < right, np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None])
    votes[r.random(votes.shape) < 0.3] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    share, accuracy = fit(patterns, counts)
    assert abs(share - 0.8) < 0.05
    assert (np.diff(accuracy) < 0.03).all() and abs(accuracy - right).max() < 0.05
