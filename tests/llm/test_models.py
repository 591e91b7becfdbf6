"""Trained operators: contracts on messy rows, held-out accuracy on the sample tables, automata by brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkloom.llm import language, quality, toxicity, training
from chunkloom.llm.common import table

from .conftest import rows

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def messy_labels(spark):
    data = [(i, i % 2, int(i % 3 == 0)) for i in range(5, 30)] + [(5, None, 1), (None, 1, 1), (9, 1, 0)]
    return spark.createDataFrame(data, "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("score", [quality.quality_scores, toxicity.toxicity_scores])
def test_scores_of_messy_rows(messy, nothing, messy_labels, score):
    got = score(messy, messy_labels).collect()
    assert len(got) == len(rows()) and all(0 <= r["score"] <= 1 for r in got)
    assert score(nothing, messy_labels).collect() == []
    assert len({r["score"] for r in score(messy, messy_labels.limit(0)).collect()}) == 1


def test_languages_of_messy_rows(messy, nothing):
    got = language.language_report(messy).collect()
    assert len(got) == len(rows()) and {r["lang_pred"] for r in got} == {"en", "und"}
    letters = lambda t: any(c.isalpha() for c in t or "")
    assert sum(r["lang_pred"] == "und" for r in got) == sum(not letters(r[1]) for r in rows())
    assert language.language_report(nothing).collect() == []


@pytest.mark.parametrize(("score", "label", "least"), [(quality.quality_scores, "quality", 0.97), (toxicity.toxicity_scores, "toxic", 0.93)])
def test_held_out_accuracy(spark, score, label, least):
    got = score(table(spark, SF, "documents"), table(spark, SF, "labels")).join(table(spark, SF, "labels"), "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r[label] for r in got]) >= least


def test_held_out_languages(spark):
    got = language.language_report(table(spark, SF, "documents")).join(table(spark, SF, "documents"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) >= 0.98


def test_rare_language_is_learned(spark):
    """A sample of 60 of 3,000 rows has the twelve rows of a rare language, and rows without id are drawn apart."""
    words = {"aa": "lorem ipsum dolor sit amet", "bb": "kvik jord fjell over strand", "cc": "zuxo qexi wozu quxe zaqo"}
    rng = random.Random(2)
    langs = ["aa"] * 2400 + ["bb"] * 588 + ["cc"] * 12
    data = [(None if lang == "aa" else i, " ".join(rng.choices(words[lang].split(), k=12)) + f" {i}", lang) for i, lang in enumerate(langs)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, lang string")
    sample = training.stratified(docs, "lang", [F.col("doc_id"), F.col("text")], 60).groupBy("lang").count().collect()
    found = {r["lang"]: r["count"] for r in sample}
    assert found["cc"] == 12 and 8 <= found["aa"] <= 45 and 8 <= found["bb"] <= 45
    assert training.stratified(docs, "text", [F.col("doc_id"), F.col("text")], 60).count() == 60  # more groups than rows to draw
    got = language.language_report(docs, bound=60).groupBy("lang_pred").count().collect()
    assert {r["lang_pred"]: r["count"] for r in got} == {"aa": 2400, "bb": 588, "cc": 12}


def test_fair_level():
    assert training.fair_level([5, 100, 100], 55) == 25 and training.fair_level([3, 4], 10) >= 4 and training.fair_level([], 10) == 0
    assert training.fair_level([10, 10, 10], 15) == 5


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton():
    terms = [toxicity.Term("idiot", False, 3.0), toxicity.Term("moron", False, 2.5), toxicity.Term("abcab", False, 1.0), toxicity.Term("stem", True, 2.0), toxicity.Term("xy", False, 4.0)]
    auto = toxicity.build_automaton(terms, {0, 1, 2})
    rng = random.Random(3)
    words = ["idiot", "idio", "idiots", "idixot", "diiot", "moron", "mooron", "stem", "stemming", "ste", "xy", "xyz", "x", "abcab", "acab"]
    for t in terms:
        for _ in range(150):
            w = list(t.text)
            for _ in range(rng.randrange(3)):
                k = rng.randrange(len(w) + 1)
                w[k : k + rng.randrange(2)] = rng.choice(["", "a", "b", "i", "z"])
            words.append("".join(w) or "q")
    codes = toxicity.codes_of(" ".join(words))
    term, edit = auto.match(codes, *toxicity.word_bounds(codes))
    for w, no, e in zip(words, term, edit):
        values = [0.0]
        for k, t in enumerate(terms):
            if w == t.text or (t.stem and w.startswith(t.text)):
                values.append(t.weight)
            elif k in (0, 1, 2) and edits(w, t.text) == 1:
                values.append(t.weight * toxicity.FUZZY_WEIGHT)
        got = terms[no].weight * (toxicity.FUZZY_WEIGHT if e else 1.0) if no >= 0 else 0.0
        assert got == pytest.approx(max(values)), w


def test_misspelt_terms(spark):
    """One edit anywhere in a learned word is a hit, beside stems that cover the word and rarer words of higher odds."""
    terms = ["idiot", "stupid", "worthless", "moron", "loser", "pathetic"]
    rng = random.Random(5)
    noise = ["".join(rng.choice("bdfgkvwxz") for _ in range(9)) for _ in range(100)]
    toxic = [f"the {terms[i % 6]} and {terms[(i + 1) % 6]} here {' '.join(noise[k] for k in range(100) if (k + i) % 20 < 3)}" for i in range(60)]
    clean = [f"the table and chair here number {i}" for i in range(300)] + [f"not {t} at all" for t in terms]
    model = toxicity.fit(spark.createDataFrame([(t, 1) for t in toxic] + [(t, 0) for t in clean], "text string, label int"))
    misspelt = {"ydiot": 0, "idoit": None, "sttupid": 1, "tupid": 1, "mroron": 3, "moronn": 3, "worrthless": 2, "worthles": 2, "looser": 4, "pqthetic": 5}
    found = model.features(list(misspelt))
    for (word, no), f in zip(misspelt.items(), found):
        assert f[0] == (no is not None), word  # two letters that change places are two edits
    assert [t.text for t in model.terms if t.stem and terms[4].startswith(t.text)]  # a stem covers a term
    assert sum(t.fuzzy for t in model.terms) <= toxicity.FUZZY_TERMS


def test_stem_and_word_of_one_text():
    terms = [toxicity.Term("loser", True, 2.0), toxicity.Term("loser", False, 3.0, True)]
    auto = toxicity.build_automaton(terms, {1})
    codes = toxicity.codes_of("loser losers looser loosers lose")
    term, edit = auto.match(codes, *toxicity.word_bounds(codes))
    assert list(zip(term.tolist(), edit.tolist())) == [(1, 0), (1, 1), (1, 1), (-1, 0), (1, 1)]


def test_context_window():
    text = 'x "idiot" y'
    assert toxicity.window_factor(text, 3, 8) < toxicity.window_factor("you idiot", 4, 9)
