"""Scores and kept rows of the toxicity stage against a plain version that compares every word with every term."""

import math
from collections import Counter

import pytest

import corpus_pipeline
from chunkloom.llm import toxicity
from chunkloom.llm.common import table

from .test_models import edits

SF = "/root/testdata/sf0.001"


def plain_words(text):
    """(start, end, lower-cased word) of every run of letters."""
    start = None
    for i, ch in enumerate(text + " "):
        if ch.isalpha() and start is None:
            start = i
        elif not ch.isalpha() and start is not None:
            yield start, i, text[start:i].lower()
            start = None


def best_term(word, terms, known):
    """(number, value) of the term that counts for a word: stems, shortest first, then words, then words one edit away."""
    if word not in known:
        number, value = None, 0.0
        order = sorted(range(len(terms)), key=lambda k: (not terms[k].stem, len(terms[k].text)))
        for k in order:
            t, worth = terms[k], 0.0
            if word.startswith(t.text) if t.stem else word == t.text:
                worth = t.weight
            elif t.fuzzy and abs(len(word) - len(t.text)) < 2 and edits(word, t.text) == 1:
                worth = t.weight * toxicity.FUZZY_WEIGHT
            if worth > value:
                number, value = k, worth
        known[word] = number, value
    return known[word]


def plain_score(text, model, known):
    found = [(best_term(w, model.terms, known), s, e) for s, e, w in plain_words(text)]
    hits = [(number, value * toxicity.window_factor(text, s, e)) for (number, value), s, e in found if number is not None]
    weight, words = sum(v for _, v in hits), len(found)
    x = [
        math.log1p(len(hits)), math.log1p(len({n for n, _ in hits})), math.log1p(weight), max([v for _, v in hits], default=0.0),
        math.log1p(100 * weight / max(words, 20)), math.log1p(words) / 5, float(bool(hits)),
    ]
    return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(x, model.weights)) + model.intercept)))


def test_scores_and_kept_rows(spark, tmp_path):
    labels = table(spark, SF, "labels")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = table(spark, SF, "documents").select("doc_id", "text")
    toxic = docs.join(labels.where("toxic = 1"), "doc_id").select("text").orderBy("doc_id").first()[0]
    # Without an id, twice with one id, misspelt, in quotes, among many other words, and without words.
    more = [(None, toxic), (-1, toxic), (-1, toxic), (-2, toxic.replace("i", "y")), (-3, f'they said "{toxic}"'), (-4, toxic + " fine word" * 20_000)]
    more += [(None, None), (None, ""), (-5, " \n\t"), (-6, "123 !?"), (None, "a plain note"), (-7, "Ünïcode ẞ İ 𝒳 words")]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id bigint, text string"))
    rows = [tuple(r) for r in docs.collect()]
    model, known = toxicity.toxicity_model(docs, labels), {}
    want = {t: plain_score(t or "", model, known) for _, t in rows}
    assert any(v >= toxicity.CUT for v in want.values()) and any(v < toxicity.CUT for v in want.values())

    got = sorted(((r["doc_id"], r["score"]) for r in toxicity.toxicity_scores(docs, labels).collect()), key=str)
    plain = sorted(((d, want[t]) for d, t in rows), key=str)
    by_id = lambda pairs: {d: sorted(s for e, s in pairs if e == d) for d, _ in pairs}
    assert by_id(got).keys() == by_id(plain).keys()
    for d, scores in by_id(plain).items():
        assert by_id(got)[d] == pytest.approx(scores), d
    kept = Counter(tuple(r) for r in dict(corpus_pipeline.STAGES)["toxicity"](spark, docs, str(tmp_path)).collect())
    assert kept == Counter(r for r in rows if want[r[1]] < toxicity.CUT)
