"""Quality scores by a sparse rule ensemble compiled into column expressions.

Shallow trees on text statistics give conjunctive rules; a lasso logistic fit over the rules keeps few of them; the
kept rules become one Spark expression, so scoring all documents runs no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, hash_part, text_of
from .training import SAMPLE_ROWS, best_cut, fit_logistic, labelled

Condition = tuple[str, bool, float]  # statistic, at most (True) or above (False), threshold
FOLDS, HELD = 5, 0
CUT = 0.3


def statistics() -> dict[str, Column]:
    """Text statistics by name, over the columns ``t`` (text), ``w`` (words) of ``with_words``."""
    t, words = F.col("t"), F.size("w")
    chars = F.greatest(F.length(t), F.lit(1))
    per_char = lambda pattern: F.regexp_count(t, F.lit(pattern)) / chars
    return {
        "n_words": F.log1p(words.cast("double")),
        "word_length": chars / F.greatest(words, F.lit(1)),
        "distinct": F.size(F.array_distinct("w")) / F.greatest(words, F.lit(1)),
        "upper": per_char(r"\p{Lu}"),
        "symbols": per_char(r"[#$%&*@\\^~<>{}=|]"),
        "bars": per_char(r"\|"),
        "digits": per_char(r"[0-9]"),
        "calls": per_char(r"[!?]"),
        "stops": F.regexp_count(t, F.lit(r"[.]")) / F.greatest(words, F.lit(1)),
        "lines": F.regexp_count(t, F.lit("\n")) / F.greatest(words, F.lit(1)),
    }


def with_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    words = docs.select(*keep, text_of().alias("t")).withColumn("w", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)))
    return words.select(*keep, *[c.cast("double").alias(n) for n, c in statistics().items()])


def grow_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 40, depth: int = 3, seed: int = 7) -> list[tuple[Condition, ...]]:
    """The paths to all nodes of shallow trees, each grown on a random half of the rows and of the statistics."""
    rng = np.random.default_rng(seed)
    found: dict[tuple[Condition, ...], None] = {}

    def split(rows: np.ndarray, path: tuple[Condition, ...], columns: np.ndarray) -> None:
        if path:
            found.setdefault(tuple(sorted(path)))
        if len(path) == depth or len(rows) < 20 or y[rows].min() == y[rows].max():
            return
        best = None
        for c in columns:
            v = x[rows, c]
            for cut in np.unique(np.quantile(v, np.linspace(0.02, 0.98, 33))):
                left = v <= cut
                k = int(left.sum())
                if 5 <= k <= len(rows) - 5:
                    a, b = y[rows[left]].mean(), y[rows[~left]].mean()
                    impurity = k * a * (1 - a) + (len(rows) - k) * b * (1 - b)
                    if best is None or impurity < best[0]:
                        best = (impurity, c, float(cut), left)
        if best:
            _, c, cut, left = best
            split(rows[left], (*path, (names[c], True, cut)), columns)
            split(rows[~left], (*path, (names[c], False, cut)), columns)

    for _ in range(trees):
        rows = rng.permutation(len(y))[: max(20, len(y) // 2)]
        split(rows, (), rng.permutation(len(names))[: max(2, len(names) // 2)])
    return list(found)


@dataclass(frozen=True)
class RuleEnsemble:
    rules: list[tuple[tuple[Condition, ...], float]]
    intercept: float

    def score(self) -> Column:
        """A number in (0, 1) from columns named like the statistics."""
        total = F.lit(self.intercept)
        for path, weight in self.rules:
            hold = F.lit(True)
            for name, at_most, cut in path:
                hold = hold & ((F.col(name) <= cut) if at_most else (F.col(name) > cut))
            total = total + F.when(hold, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def fit_rules(sample: DataFrame, l1: float = 1e-3, cut: float = CUT) -> RuleEnsemble:
    """An ensemble from (text, label); the driver gets the statistics of the sample, never its texts.

    The intercept is set so that the best cut between the labels of the sample scores ``cut``.
    """
    names = list(statistics())
    table = with_statistics(sample, "label").toPandas()
    x, y = table[names].to_numpy(dtype=float), table["label"].to_numpy(dtype=float)
    rules = grow_rules(x, y, names) if len(y) else []
    hold = np.ones((len(y), len(rules)))
    for k, path in enumerate(rules):
        for name, at_most, at in path:
            v = x[:, names.index(name)]
            hold[:, k] *= (v <= at) if at_most else (v > at)
    weights, base = fit_logistic(hold, y, l1=l1)
    move = np.log(cut / (1 - cut)) - best_cut(hold @ weights + base, y) if len(set(y)) > 1 else 0.0
    return RuleEnsemble([(r, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-6], float(base + move))


def quality_scores(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``.

    A row is held out if crc32 of doc_id as text (null: empty) is 0 modulo 5; the model is fitted on labels of other
    rows, about ``bound`` of them. Null and empty texts have statistics of 0 and a score. Without labels all score 0.5.
    """
    model = fit_rules(labelled(docs, labels, "quality", hash_part(FOLDS) != HELD, bound))
    rows = with_statistics(docs, "doc_id")
    return rows.select("doc_id", (hash_part(FOLDS) == HELD).alias("held_out"), model.score().alias("score")).withColumn(
        "predicted", (F.col("score") >= CUT).cast("int")
    )
