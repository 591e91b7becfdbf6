"""Toxicity scores from a learned lexicon matched through Levenshtein automata.

The lexicon (whole words, and stems that words begin with) is learned from labelled documents and kept as a trie.
Intersecting the trie with the Levenshtein automaton of distance 1 gives one deterministic automaton that accepts a
word if it is a term, begins with a stem, or is a long term with one edit. Tasks run it over all words of a batch at
once; the few hits are weighed by the window around them, which tells quotation from abuse.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_part, identity, stored, text_of, with_results
from .training import SAMPLE_ROWS, best_cut, fit_logistic, labelled

FOLDS, HELD = 3, 1
CUT = 0.7
LEXICON_TERMS = 400  # most terms of the lexicon, without words that are there for their edits only
FUZZY_TERMS = 80  # most terms that are also found with one edit
FUZZY_LEAST = 5  # letters of the shortest of them
STEMS = range(4, 8)  # letters of stems
FUZZY_WEIGHT = 0.7
WINDOW = 48  # characters before and after a hit
QUOTES = "\"“”„«»‘’‹›"
REPORTING = ("said", "says", "called", "calls", "wrote", "quote", "quoted", "word", "term", "dit", "sagte", "dijo")
ADDRESS = ("you", "your", "youre", "u", "tu", "vous", "toi", "du", "dich", "ihr", "usted", "eres")
_CHUNK = 1_000_000  # characters matched at once

_LOWER = np.arange(65_536, dtype=np.uint32)
_LETTER = np.zeros(65_536, dtype=bool)
for _c in range(65_536):
    _s = chr(_c)
    _LETTER[_c] = _s.isalpha()
    if len(_s.lower()) == 1 and ord(_s.lower()) < 65_536:
        _LOWER[_c] = ord(_s.lower())


def codes_of(text: str) -> np.ndarray:
    """Lower-cased code points; those beyond the basic plane become one letter that no term has."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return _LOWER[np.where(c < 65_536, c, 0x3400)]


def word_bounds(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], _LETTER[codes], [False]]).astype(np.int8)))
    return edges[::2], edges[1::2]


@dataclass
class Term:
    text: str
    stem: bool
    weight: float
    fuzzy: bool = False


@dataclass
class Automaton:
    """``table[state, letter class]`` is the next state, state 0 accepts nothing any more; ``term`` and ``edits`` say
    what a word that ends in a state is (-1: nothing); ``settled`` states stay as they are until the word ends."""

    classes: np.ndarray
    table: np.ndarray
    term: np.ndarray
    edits: np.ndarray
    settled: np.ndarray

    def match(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        state = np.ones(len(starts), dtype=np.int32)
        live = np.arange(len(starts))
        j = 0
        while len(live):
            state[live] = self.table[state[live], self.classes[codes[starts[live] + j]]]
            j += 1
            live = live[(starts[live] + j < ends[live]) & ~self.settled[state[live]]]
        return self.term[state], self.edits[state]


def build_automaton(terms: list[Term], fuzzy: set[int]) -> Automaton:
    """Subset construction over (trie node, edits): an edit replaces, inserts or leaves out one letter."""
    children: list[dict[str, int]] = [{}]
    # A text can be a stem, a word and a fuzzy word at once: each has its own end.
    stems, words, near = [-1], [-1], [-1]
    loose: list[bool] = [False]  # a fuzzy term lies below
    for no, t in enumerate(terms):
        node = 0
        for ch in t.text:
            if ch not in children[node]:
                children[node][ch] = len(children)
                children.append({})
                for ends in (stems, words, near):
                    ends.append(-1)
                loose.append(False)
            loose[node] = loose[node] or no in fuzzy
            node = children[node][ch]
        loose[node] = loose[node] or no in fuzzy
        for ends in [stems] if t.stem else [words, near] if no in fuzzy else [words]:
            if ends[node] < 0 or terms[ends[node]].weight < t.weight:
                ends[node] = no

    def closed(nodes: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        out = set(nodes)
        for node, e in nodes:
            if e == 0:
                out |= {(c, 1) for c in children[node].values() if loose[c]}
        return frozenset(x for x in out if x[1] == 0 or (x[0], 0) not in out)

    alphabet = sorted({ch for t in terms for ch in t.text})
    classes = np.zeros(65_536, dtype=np.int32)
    for k, ch in enumerate(alphabet):
        classes[ord(ch)] = k + 1
    start = (closed({(0, 0)}), -1)
    numbers = {(frozenset(), -1): 0, start: 1}
    todo, rows = [start], {0: [0] * (len(alphabet) + 1)}
    while todo:
        at = todo.pop()
        nodes, stem = at
        row = []
        for ch in ["", *alphabet]:
            got: set[tuple[int, int]] = set()
            best = stem
            for node, e in nodes:
                nxt = children[node].get(ch) if ch else None
                if nxt is not None and (e == 0 or loose[nxt]):
                    got.add((nxt, e))
                    no = stems[nxt]
                    if e == 0 and no >= 0 and (best < 0 or terms[no].weight > terms[best].weight):
                        best = no
                if e == 0 and loose[node]:
                    got.add((node, 1))
                    got |= {(c, 1) for c in children[node].values() if loose[c]}
            key = (closed(got), best)
            if key not in numbers:
                numbers[key] = len(numbers)
                todo.append(key)
            row.append(numbers[key])
        rows[numbers[at]] = row
    table = np.array([rows[i] for i in range(len(numbers))], dtype=np.int32)
    term, edits = np.full(len(numbers), -1, dtype=np.int32), np.zeros(len(numbers), dtype=np.int32)
    settled = np.zeros(len(numbers), dtype=bool)
    for (nodes, stem), i in numbers.items():
        value = terms[stem].weight if stem >= 0 else 0.0
        term[i] = stem
        settled[i] = not nodes
        for node, e in nodes:
            no = near[node] if e else words[node]
            if no < 0:
                continue
            if (w := terms[no].weight * (FUZZY_WEIGHT if e else 1.0)) > value:
                value, term[i], edits[i] = w, no, e
    return Automaton(classes, table, term, edits, settled)


def window_factor(text: str, start: int, end: int) -> float:
    """Below 1 where the window looks like a quotation, above 1 where it addresses someone."""
    before, after = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
    quoted = sum(before.count(q) for q in QUOTES) % 2 == 1 and any(q in after for q in QUOTES)
    words = {"".join(ch for ch in w if ch.isalpha()).lower() for w in (before + " " + after).split()}
    factor = 1.0
    if quoted or (before[-1:] and before[-1] in QUOTES and after[:1] and after[0] in QUOTES):
        factor *= 0.5
    if words & set(REPORTING):
        factor *= 0.7
    if words & set(ADDRESS):
        factor *= 1.2
    return factor


FEATURES = ("hits", "distinct", "weight", "strongest", "words")


@dataclass
class Model:
    terms: list[Term]
    automaton: Automaton
    weights: np.ndarray = field(default_factory=lambda: np.zeros(7))
    intercept: float = 0.0

    def features(self, texts: list[str]) -> np.ndarray:
        """Per text: hits, distinct terms, weights in context, strongest, words."""
        codes = [codes_of(t) for t in texts]
        starts_of = np.concatenate([[0], np.cumsum([len(c) + 1 for c in codes])])
        flat = np.full(int(starts_of[-1]) + 1, 32, dtype=np.uint32)
        for c, s in zip(codes, starts_of):
            flat[s : s + len(c)] = c
        starts, ends = word_bounds(flat)
        term, edits = self.automaton.match(flat, starts, ends)
        doc = np.searchsorted(starts_of, starts, side="right") - 1
        out = np.zeros((len(texts), len(FEATURES)))
        out[:, 4] = np.bincount(doc, minlength=len(texts))[: len(texts)]
        seen: dict[int, set[int]] = {}
        for i in np.flatnonzero(term >= 0):
            d, no = int(doc[i]), int(term[i])
            w = self.terms[no].weight * (FUZZY_WEIGHT if edits[i] else 1.0)
            w *= window_factor(texts[d], int(starts[i] - starts_of[d]), int(ends[i] - starts_of[d]))
            seen.setdefault(d, set()).add(no)
            out[d, 0] += 1
            out[d, 2] += w
            out[d, 3] = max(out[d, 3], w)
        for d, s in seen.items():
            out[d, 1] = len(s)
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(inputs(features) @ self.weights + self.intercept, -35, 35)))


def inputs(f: np.ndarray) -> np.ndarray:
    hits, distinct, weight, strongest, words = f.T
    rate = 100 * weight / np.maximum(words, 20)
    return np.stack([np.log1p(hits), np.log1p(distinct), np.log1p(weight), strongest, np.log1p(rate), np.log1p(words) / 5, hits > 0], axis=1)


def pieces(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    start, held, size = 0, [], 0
    for i, t in enumerate(texts):
        held.append(t or "")
        size += len(held[-1])
        if size >= _CHUNK:
            yield start, held
            start, held, size = i + 1, [], 0
    if held:
        yield start, held


def learn_lexicon(sample: DataFrame) -> list[Term]:
    """Terms that far more toxic than other documents have, from (text, label), strongest first.

    Weights are log odds of document frequencies. A word that a stem stands for is kept if it is clearly stronger, or
    for its edits, which the stem does not have: the first ``FUZZY_TERMS`` long words by odds and frequency are fuzzy.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tally: dict[str, list[int]] = {}
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                codes = codes_of(text or "")
                low = codes.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
                words = {low[s:e] for s, e in zip(*word_bounds(codes)) if e - s <= 40}
                stems = {w[:k] + "*" for w in words for k in STEMS if len(w) >= k}
                for w in words | stems:
                    tally.setdefault(w, [0, 0])[label] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(tally), pa.string()), pa.array([v[0] for v in tally.values()], pa.int64()), pa.array([v[1] for v in tally.values()], pa.int64())],
                names=["term", "clean", "toxic"],
            )

    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return []
    totals = sample.mapInArrow(count, "term string, clean bigint, toxic bigint").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (n_clean + 1.0))
    least = max(3.0, 0.004 * n_toxic)
    strong = stored(totals.where(F.col("toxic") >= least).select("term", "toxic", odds.alias("odds")).where(F.col("odds") > 1.5))
    rank = F.col("odds") * F.sqrt("toxic")
    rows = strong.orderBy(F.desc(rank), "term").limit(4 * LEXICON_TERMS).collect()
    long = (~F.col("term").endswith("*")) & (F.length("term") >= FUZZY_LEAST)
    fuzzy = {r["term"]: r["odds"] for r in strong.where(long).orderBy(F.desc(rank), "term").limit(FUZZY_TERMS).collect()}
    stems: dict[str, float] = {}
    for r in rows:
        t = r["term"]
        if t.endswith("*") and not any(t[:-1].startswith(s) and r["odds"] < w + 0.7 for s, w in stems.items()):
            stems[t[:-1]] = r["odds"]
    terms = [Term(s, True, w) for s, w in stems.items()]
    for r in rows:
        t = r["term"]
        if not t.endswith("*") and not any(t.startswith(s) and r["odds"] < w + 0.7 for s, w in stems.items() if s != t):
            terms.append(Term(t, False, r["odds"]))
    terms = [t for t in sorted(terms, key=lambda x: -x.weight)[:LEXICON_TERMS] if t.stem or t.text not in fuzzy]
    return sorted(terms + [Term(t, False, w, True) for t, w in fuzzy.items()], key=lambda x: -x.weight)


def fit(sample: DataFrame) -> Model:
    """A model from (text, label); the driver gets the lexicon and numbers per document, never texts."""
    terms = learn_lexicon(sample)
    model = Model(terms, build_automaton(terms, {i for i, t in enumerate(terms) if t.fuzzy}))
    table = measured(sample.select("text", "label"), model, "label int").toPandas()
    x = inputs(table[list(FEATURES)].to_numpy(dtype=float)) if len(table) else np.zeros((0, 7))
    y = table["label"].to_numpy(dtype=float)
    mean, spread = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(7), np.ones(7))
    w, b = fit_logistic((x - mean) / spread, y, l2=1e-4, rounds=1500)
    weights, base = w / spread, b - float((w * mean / spread).sum())
    move = np.log(CUT / (1 - CUT)) - best_cut(x @ weights + base, y) if len(set(y)) > 1 else 0.0
    return Model(terms, model.automaton, weights, base + move)


def measured(rows: DataFrame, model: Model, kept: str) -> DataFrame:
    """The column ``kept`` (name and type) of (text, kept) and the features of the text."""
    sent = rows.sparkSession.sparkContext.broadcast(model)  # LEXICON_TERMS and FUZZY_TERMS bound it
    name = kept.split()[0]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in pieces(batch.column("text").to_pylist()):
                f = sent.value.features(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(name).slice(start, len(texts)), *[pa.array(c) for c in f.T], pa.array(sent.value.score(f))],
                    names=[name, *FEATURES, "score"],
                )

    return rows.mapInArrow(measure, f"{kept}, {', '.join(f + ' double' for f in FEATURES)}, score double")


def toxicity_model(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> Model:
    return fit(stored(labelled(docs, labels, "toxic", hash_part(FOLDS) != HELD, bound)))


def toxicity_scores(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``.

    A row is held out if crc32 of doc_id as text (null: empty) is 1 modulo 3; lexicon and weights come from labels of
    other rows, about ``bound`` of them. Null and empty texts have no hits. Without labels of both kinds the lexicon is
    empty and all rows score alike.
    """
    model = toxicity_model(docs, labels, bound)
    rows = measured(docs.select(text_of().alias("text"), F.col("doc_id").cast("bigint").alias("doc_id")), model, "doc_id bigint")
    return rows.select("doc_id", (hash_part(FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, unchanged."""
    model = toxicity_model(docs, labels, bound)
    scored = measured(docs.select(text_of().alias("text"), F.struct(*identity()).alias("k")), model, "k struct<k_id:bigint,k_text:bigint>")
    bad = scored.where(F.col("score") >= CUT).select("k.k_id", "k.k_text", F.lit(True).alias("toxic")).distinct()
    out, (name,) = with_results(docs, stored(bad), ["toxic"], "left")
    return out.where(F.col(name).isNull()).drop(name)
