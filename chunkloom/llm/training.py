"""Bounded samples of labelled rows, and logistic fits, for the trained operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 20_000  # labelled documents a model is fitted on, about


def sampled(rows: DataFrame, key: Column, bound: int) -> DataFrame:
    """About ``bound`` of the rows, chosen by a hash of ``key``; all rows if there are no more."""
    total = rows.count()
    share = 1_000_000 if total <= bound else int(1_000_000 * bound / total)
    return rows.where(F.pmod(F.xxhash64(key, F.lit(23)), F.lit(1_000_000)) < share)


def fair_level(sizes: list[int], bound: int) -> float:
    """The most rows a group may give so that groups of these sizes give ``bound`` in all; small groups give all."""
    left, level = float(bound), 0.0
    for done, n in enumerate(sorted(sizes)):
        level = left / (len(sizes) - done)
        if n > level:
            return level
        left -= n
    return max([level, *map(float, sizes)])


def stratified(rows: DataFrame, group: str, keys: list[Column], bound: int) -> DataFrame:
    """About ``bound`` of the rows, from each value of ``group`` equally many as far as it has them.

    Chosen by a hash of ``keys``, which must tell rows apart: rows of equal keys are taken together. With more than
    ``bound`` groups the largest count.
    """
    found = rows.groupBy(group).count().orderBy(F.desc("count"), group).limit(bound + 1).collect()
    sizes = {r[group]: r["count"] for r in found[:bound]}
    level = fair_level(list(sizes.values()), bound)
    parts = 1_000_000_000
    # Groups the map does not list give all their rows, or none where there are too many groups.
    others = parts if len(found) <= bound else 0
    shares = {g: parts if n <= level else int(parts * level / n) for g, n in sizes.items()}
    listed = [F.lit(x) for g, n in shares.items() if n != others for x in (g, n)]
    share = F.coalesce(F.create_map(*listed)[F.col(group)], F.lit(others)) if listed else F.lit(others)
    return rows.where(F.pmod(F.xxhash64(*keys, F.lit(23)), F.lit(parts)) < share)


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn: Column, bound: int = SAMPLE_ROWS) -> DataFrame:
    """(text, label) of at most about ``bound`` documents with a label that ``learn`` (over doc_id) admits.

    Labels that repeat a doc_id count once, the highest; null labels and ids are left out.
    """
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(learn)
    rows = sampled(rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")), F.col("doc_id"), bound)
    # The sample has about ``bound`` short rows.
    return docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").select("text", "label")


def fit_logistic(x: np.ndarray, y: np.ndarray, l1: float = 0.0, l2: float = 1e-3, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated proximal gradient; the intercept is not penalised."""
    n, d = x.shape
    if n == 0 or y.min() == y.max():
        p = (y.sum() + 1) / (n + 2) if n else 0.5
        return np.zeros(d), float(np.log(p / (1 - p)))
    a = np.hstack([x, np.ones((n, 1))])
    lipschitz = 0.25 * np.linalg.norm(a.T @ a / n, 2) + l2
    penal = np.full(d + 1, 1.0)
    penal[-1] = 0.0
    w = z = np.zeros(d + 1)
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ z, -35, 35)))
        step = z - (a.T @ (p - y) / n + l2 * penal * z) / lipschitz
        new = np.sign(step) * np.maximum(np.abs(step) - l1 * penal / lipschitz, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return w[:-1], float(w[-1])


def best_cut(logits: np.ndarray, y: np.ndarray) -> float:
    """The logit that separates the labels with fewest balanced errors, in the middle of the widest such gap."""
    if len(y) == 0 or y.min() == y.max():
        return 0.0
    order = np.argsort(logits)
    v, lab = logits[order], y[order]
    low = np.concatenate([[0], np.cumsum(lab)]) / lab.sum()
    high = 1 - np.concatenate([[0], np.cumsum(1 - lab)]) / (1 - lab).sum()
    cost = low + high
    gaps = np.concatenate([[0.0], np.diff(v), [0.0]])
    ok = np.flatnonzero((cost <= cost.min() + 1e-12) & (gaps > 0))
    if not len(ok):
        return 0.0
    i = ok[np.argmax(gaps[ok])]
    return float((v[i - 1] + v[i]) / 2)
