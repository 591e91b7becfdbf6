"""Ranked lexical search reversed: the queries are indexed, the documents stream through.

An inverted index over the items' terms is sent to the tasks in blocks of bounded size. One pass over the documents
counts what the weights need; a second one scores each document against the items that share its terms and keeps a
bounded heap per item and task. The heaps of the tasks are merged at the end.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

TOP = 10
BLOCK_CHARS = 10_000_000  # characters of items indexed at once: bounds what the driver gathers and sends to the tasks
# Lower-cases A-Z; what is not 0-9, a-z or beyond ASCII separates terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class ItemIndex:
    """Terms of some items, each with the numbers of the items that have it."""

    def __init__(self, items: list[tuple[str | None, bytes | None]]):
        numbers: dict[str | None, int] = {}
        self.items: list[str | None] = []
        postings: dict[bytes, set[int]] = {}
        for item_id, text in items:
            no = numbers.setdefault(item_id, len(self.items))
            if no == len(self.items):
                self.items.append(item_id)
            for term in terms_of(text):
                postings.setdefault(term, set()).add(no)
        self.terms = sorted(postings)
        self.postings = {t: np.array(sorted(postings[t]), dtype=np.int64) for t in self.terms}
        self.weights: dict[bytes, int] = {}
        self.documents = self.words = 0

    def weigh(self, df: dict[int, int], documents: int, words: int) -> ItemIndex:
        """Set the weights from the document frequencies by term number and the sizes of the corpus."""
        self.documents, self.words = documents, words
        self.weights = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(i, 0) + 1))) for i, t in enumerate(self.terms)}
        return self

    def scores(self, words: list[bytes]) -> np.ndarray | None:
        """Scores of one document for all items; None if it has none of their terms."""
        counts = Counter(words)
        shared = self.postings.keys() & counts.keys()
        if not shared:
            return None
        m = 100 - 90 + (90 * len(words) * self.documents) // self.words
        out = np.zeros(len(self.items), dtype=np.int64)
        for t in shared:
            tf = counts[t]
            out[self.postings[t]] += self.weights[t] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
        return out


def item_blocks(items: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[str | None, bytes | None]]]:
    """The items in blocks of about ``block_chars`` characters by hash of their id; rows that share an id stay together."""
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.length("text") + 8)).first()[0] or 0
    blocks = max(1, -(-size // block_chars))
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else rows
        yield [(r["item_id"], None if r["text"] is None else r["text"].encode()) for r in part.collect()]


def corpus_counts(docs: DataFrame, index: ItemIndex) -> tuple[dict[int, int], int, int]:
    """(documents that hold each term of the index, by its number; documents with terms; terms) over all of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(index.terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = {t: i for i, t in enumerate(sent.value)}
        found = np.zeros(len(numbers) + 2, dtype=np.int64)
        for batch in batches:
            for text in batch.column("t"):
                words = terms_of(text.as_py())
                if words:
                    found[-2] += 1
                    found[-1] += len(words)
                    found[[numbers[t] for t in numbers.keys() & set(words)]] += 1
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], names=["no", "n"])

    rows = docs.select(F.col("text").cast("binary").alias("t")).mapInArrow(count, "no bigint, n bigint")
    # One row per term of the index at most.
    sums = {r["no"]: r["n"] for r in rows.groupBy("no").agg(F.sum("n").alias("n")).collect()}
    size = len(index.terms)
    return {k: v for k, v in sums.items() if k < size}, sums.get(size, 0), sums.get(size + 1, 0)


def _heaps(docs: DataFrame, index: ItemIndex, top: int) -> DataFrame:
    """(item_id, doc_id, score, task): the best ``top`` documents per item and task."""
    sent = docs.sparkSession.sparkContext.broadcast(index)
    last = 2**63  # a null id comes after all others

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        heaps: list[list[tuple[int, int]]] = [[] for _ in held.items]
        least = np.ones(len(heaps), dtype=np.int64)  # a document needs so much to enter
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("t")):
                words = terms_of(text.as_py())
                scores = held.scores(words) if words else None
                if scores is None:
                    continue
                key = -(last if doc_id is None else doc_id)
                for i in np.flatnonzero(scores >= least).tolist():
                    heap = heaps[i]
                    if len(heap) < top:
                        heapq.heappush(heap, (int(scores[i]), key))
                    else:
                        heapq.heappushpop(heap, (int(scores[i]), key))
                    if len(heap) == top:
                        least[i] = heap[0][0]
        rows = [(held.items[i], None if -key == last else -key, score) for i, heap in enumerate(heaps) for score, key in heap]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())],
            names=["item_id", "doc_id", "score"],
        )

    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("t"))
    return read.mapInArrow(search, "item_id string, doc_id bigint, score bigint").withColumn("task", F.spark_partition_id())


def _best(rows: DataFrame, top: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of each item with a score above 0, best first.

    Terms are runs of letters, digits and characters beyond ASCII, A-Z lower-cased; a null text has none. Equal scores
    rank by doc_id, a null id last. Rows that repeat an id are documents of their own, and equal ones of them rank in any
    order. Items that share an id, or have none, are one item with the terms of all. An item without terms, or whose
    terms no document has, gives no rows, as do empty tables.
    """
    parts = []
    for block in item_blocks(items, block_chars):
        index = ItemIndex(block)
        if index.terms:
            counted = corpus_counts(docs, index)
            if counted[1]:
                parts.append(_heaps(docs, index.weigh(*counted), top))
    item_type = items.schema["item_id"].dataType
    if not parts:
        return docs.sparkSession.createDataFrame([], "item_id string, rank int, doc_id bigint, score bigint").withColumn("item_id", F.col("item_id").cast(item_type))
    heaps = parts[0]
    for more in parts[1:]:
        heaps = heaps.unionByName(more)
    # Heaps of 64 groups of tasks first, then these.
    merged = _best(stored(heaps).withColumn("task", F.col("task") % 64), top, "item_id", "task").drop("rank", "task")
    return _best(merged, top, "item_id").select(F.col("item_id").cast(item_type).alias("item_id"), "rank", "doc_id", "score")
