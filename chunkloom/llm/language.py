"""Language identification by nearest centroids of normalised TF-IDF vectors of byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_part
from .training import stratified

DIMENSIONS = 4096
SAMPLE_ROWS = 6_000  # documents the centroids are fitted on, about; the driver holds one short vector of each
CLUSTERS = 3
FOLDS, HELD = 4, 2
# A-Z lower-cased; other ASCII than letters is a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_CHUNK = 2_000_000  # bytes counted at once


def count_grams(texts: list[bytes], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Sublinear counts of hashed byte trigrams of whole folded texts; runs of spaces count once."""
    joined = [b" ".join([b"", *t.translate(_FOLD).split(), b""]) for t in texts]
    lengths = np.array([len(t) for t in joined], dtype=np.int64)
    b = np.frombuffer(b"".join(joined) + b"  ", dtype=np.uint8).astype(np.uint32)
    h = ((b[:-2] * np.uint32(65_599) + b[1:-1]) * np.uint32(65_599) + b[2:]) * np.uint32(2_654_435_761)
    h = (h >> np.uint32(32 - int(dimensions).bit_length() + 1)).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    inside = np.ones(len(owner), dtype=bool)
    ends = np.cumsum(lengths)
    for k in (1, 2):  # trigrams that reach into the next text
        inside[ends[lengths >= k] - k] = False
    counts = np.bincount(owner[inside] * dimensions + h[: len(owner)][inside], minlength=len(texts) * dimensions)
    return np.log1p(counts.reshape(len(texts), dimensions).astype(np.float32))


def chunks(texts: list[bytes | None]) -> Iterator[tuple[int, list[bytes]]]:
    start, held, size = 0, [], 0
    for i, t in enumerate(texts):
        held.append(t or b"")
        size += len(held[-1])
        if size >= _CHUNK or len(held) >= 256:
            yield start, held
            start, held, size = i + 1, [], 0
    if held:
        yield start, held


@dataclass(frozen=True)
class Centroids:
    languages: list[str]  # of each centroid
    idf: np.ndarray
    vectors: np.ndarray
    least: np.ndarray  # cosine below which a document is too far from the centroid

    def nearest(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        x = normalised(count_grams(texts, len(self.idf)) * self.idf)
        cosines = x @ self.vectors.T
        best = cosines.argmax(axis=1)
        return best, cosines[np.arange(len(best)), best]


def normalised(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def cluster(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Spherical k-means centroids of the rows; fewer if there are fewer rows."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        c = normalised(np.stack([x[near == j].sum(axis=0) if (near == j).any() else c[j] for j in range(len(c))]))
    return c


def fit_centroids(rows: DataFrame, clusters: int = CLUSTERS, dimensions: int = DIMENSIONS) -> Centroids:
    """Centroids from (text, lang): IDF over the rows, then clusters per language, then the distances that are usual."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for start, texts in chunks(batch.column("t").to_pylist()):
                x = count_grams(texts, dimensions).astype(np.float16)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(langs[start : start + len(texts)]), pa.array([v.tobytes() for v in x], pa.binary())], names=["lang", "v"]
                )

    table = rows.select("lang", F.col("text").cast("binary").alias("t")).mapInArrow(vectors, "lang string, v binary").toPandas()
    if table.empty:
        return Centroids([], np.ones(dimensions, np.float32), np.zeros((0, dimensions), np.float32), np.zeros(0))
    x = np.stack([np.frombuffer(v, dtype=np.float16) for v in table["v"]]).astype(np.float32)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
    x = normalised(x * idf)
    lang = table["lang"].to_numpy()
    names, found, least = [], [], []
    for name in sorted(set(lang)):
        own = x[lang == name]
        c = cluster(own, clusters)
        best = (own @ c.T).max(axis=1)
        found.append(c)
        names += [name] * len(c)
        least += [0.5 * float(np.quantile(best, 0.01))] * len(c)
    return Centroids(names, idf, np.concatenate(found), np.array(least))


def identify_languages(docs: DataFrame, model: Centroids) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row: the language of the nearest centroid, its cosine, and whether
    the text is further from it than texts of that language are. Texts without letters are ``und`` with score 0."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            letters = batch.column("letters").to_pylist()
            for start, texts in chunks(batch.column("t").to_pylist()):
                some = letters[start : start + len(texts)]
                if m.languages:
                    best, cosine = m.nearest(texts)
                    names = [m.languages[b] if ok else "und" for b, ok in zip(best, some)]
                    scores = np.where(some, np.clip(cosine, 0, 1), 0.0)
                    far = cosine < m.least[best]
                else:
                    names, scores, far = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(start, len(texts)), pa.array(names), pa.array(scores, pa.float64()),
                        pa.array(far | ~np.array(some, dtype=bool)),
                    ],
                    names=["doc_id", "lang_pred", "score", "rejected"],
                )

    letters = F.rlike(F.coalesce(F.col("text"), F.lit("")), F.lit(r"\p{L}")).alias("letters")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("t"), letters)
    return rows.mapInArrow(predict, "doc_id bigint, lang_pred string, score double, rejected boolean")


def language_report(docs: DataFrame, bound: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row of ``docs``.

    A row is held out if crc32 of doc_id as text (null: empty) is 2 modulo 4. Centroids come from about ``bound`` other
    rows with a language and a text, as many of each language as it has up to a common level, so rare ones are learned. A null text or one without letters is ``und``; without rows to learn from all are.
    """
    learn = docs.where((hash_part(FOLDS) != HELD) & F.col("lang").isNotNull() & F.rlike("text", F.lit(r"\p{L}"))).select("doc_id", "text", "lang")
    model = fit_centroids(stratified(learn, "lang", [F.col("doc_id"), F.col("text")], bound).select("text", "lang"))
    rows = identify_languages(docs, model)
    return rows.select("doc_id", (hash_part(FOLDS) == HELD).alias("held_out"), "lang_pred", "score", "rejected")
