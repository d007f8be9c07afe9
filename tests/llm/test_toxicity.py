import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnweave.llm import toxicity as T

from .conftest import SCHEMA, row


@pytest.mark.parametrize("text", ["you idiot.", "You IDIOT!!", "1d10t", "i​diot", "ÍDÌÖT", "іdіоt", "ｉｄｉｏｔ", "an id!ot here", "idiot$$$", "(idiot)"])
def test_disguises_fold_to_the_word(text):
    assert T.entry("idiot") in T.folded(text)


@pytest.mark.parametrize("text", ["idiots are", "idiotic", "1010 101", "an id iot", "", "x" * 50, "100% 12.5 $$$ !!!"])
def test_other_words_do_not(text):
    assert T.entry("idiot") not in T.folded(text)


def test_numbers_are_no_words():
    assert T.folded("in 2024, 3.5 or 10-20") == " in or "


def test_automaton_is_plain_search():
    r = random.Random(3)
    words = ["trash", "trashy", "bin", "can", "trasher", "loser", "lose", "the"]
    terms = tuple([T.entry("trash"), T.entry("lose", stem=True), T.entry("loser"), T.entry("the bin")])
    spared = frozenset([T.entry("trash can"), T.entry("loser the bin")])
    for _ in range(300):
        text = T.folded(" ".join(r.choice(words) for _ in range(12)))
        every = [(k, at, at + len(t)) for k, t in enumerate(terms) for at in range(len(text)) if text.startswith(t, at)]
        held = [(at, at + len(x)) for x in spared for at in range(len(text)) if text.startswith(x, at)]
        assert sorted(T.matches(text, terms, spared)) == sorted(m for m in every if not any(a <= m[1] and m[2] <= b for a, b in held))


def test_evidence_in_pieces(monkeypatch):
    lexicon = T.Lexicon({T.entry("trash"): 2.0, T.entry("lose", stem=True): 1.0, T.entry("loser"): 3.0})
    text = "one trash two loser three losing losel " * 500
    whole = T.evidence(text, lexicon)
    assert whole == (500 * (2 + 3 + 1), 1500, 3500)
    assert T.evidence(text, T.Lexicon(lexicon.terms, frozenset([T.entry("two loser")])))[1] == 1000
    assert [len(p) < 140 for p in T.pieces(text, 100)] and "".join(T.pieces(text, 100)) == text


def corpus(spark, n=400, seed=1):
    """Clean rows; rows with insults, some of them disguised; rows of a language whose insults are forms of a stem, that now and then stands in clean ones."""
    r = random.Random(seed)
    plain = ["".join(r.choice("bcdgmnprst") + r.choice("aeiou") for _ in range(3)) for _ in range(150)]
    docs, labels = [], []
    for k in range(n):
        toxic, other = k % 5 == 0, k % 10 < 2
        words = [r.choice(plain) for _ in range(r.randint(20, 120))]
        if other:
            words = [w + "eux" for w in words]
        for _ in range(max(2, len(words) // 20) if toxic else int(other and r.random() < 0.2)):
            words[r.randrange(len(words))] = "zoguf" + r.choice(["a", "en", "ist", "ung"]) if other and k % 20 > 9 else r.choice(["trash", "moron", "scum", "m0ron", "SCUM!", "trаsh", "TRASH", "tr4sh", "Trash."]) if toxic else "zogufi"
        if not toxic and k % 97 in (3, 4):
            words.insert(3, "trash can")
        docs.append(row(k, " ".join(words)))
        labels.append((k, 1, int(toxic)))
    docs += [row(900, None), row(901, ""), row(902, "!!! 12 %%%"), row(None, "moron"), row(3, docs[3][1]), row(903, "quiet words " * 30_000 + "moron " * 9000)]
    return spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame([*labels, (1, 1, 0), (None, 0, 1), (999, 0, 1), (7, 0, None)], "doc_id long, quality int, toxic int")


def test_learned_and_held_out(spark):
    docs, labels = corpus(spark)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    lexicon = T.fit(docs, labels, "toxic", ~held)
    assert {T.entry(w) for w in ("trash", "moron", "scum")} <= set(lexicon.terms) and any(t.startswith(" zoguf") for t in lexicon.terms)
    assert " trash can " in lexicon.exceptions
    got = T.toxicity(docs, lexicon).alias("s").join(labels, "doc_id").withColumn("held", held).collect()
    for part in (True, False):
        rows = [r for r in got if r.held == part and r.toxic is not None]
        assert np.mean([(r.score >= 0.5) == bool(r.toxic) for r in rows]) > 0.97
    rows = {r.doc_id: r for r in T.toxicity(docs, lexicon).collect()}
    assert rows[900].score == rows[901].score == rows[902].score < 0.5 and rows[903].score > 0.9 and rows[None].score > 0.5
    assert T.toxicity(docs, lexicon).count() == docs.count()
    # The score by the formula of the docstring.
    for r in docs.collect():
        total, n, words = T.evidence(r.text, lexicon)
        x = np.array([1, np.log1p(100 * total / max(words, 20)), np.log1p(total)]) @ np.array(lexicon.coefficients)
        if r.doc_id is not None and r.doc_id != 3:
            assert abs(rows[r.doc_id].score - 1 / (1 + np.exp(-np.clip(x, -30, 30)))) < 1e-12 and (rows[r.doc_id].n_words, rows[r.doc_id].n_matches) == (words, n)


def test_without_labels_or_rows(spark, docs, no_docs):
    labels = spark.createDataFrame([(4, 0, 0), (11, 0, 0)], "doc_id long, quality int, toxic int")
    for lexicon in (T.fit(docs, labels.limit(0)), T.fit(docs, labels), T.fit(no_docs, labels)):
        assert not lexicon.terms and len({r.score for r in T.toxicity(docs, lexicon).collect()}) == 1
        assert T.toxicity(no_docs, lexicon).count() == 0


def test_callers_exceptions(spark):
    docs, labels = corpus(spark, 200)
    lexicon = T.fit(docs, labels, exceptions=("pond scum",))
    text = "the Pond Scum of the lake " * 5
    assert T.evidence(text, lexicon)[1] == 0 and T.evidence("you scum", lexicon)[1] == 1
