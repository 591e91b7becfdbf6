"""Benchmark decontamination with one FM-index per training shard.

A shard is one Arrow batch of documents inside a task. Its words become symbols (words no window has are left out,
as no window can cross them), and the suffix-sorted shard is searched for all windows at once: backward search over
wavelet-matrix ranks, positions by walking to sampled suffixes. No text and no index leaves its task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import identity, stored, with_results

# Lower-cases A-Z; what is not 0-9, a-z or beyond ASCII separates words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SAMPLE = 32  # every so many positions the suffix array is kept
BLOCK_WORDS = 2_000_000  # benchmark words searched in one pass: bounds what the driver gathers and sends to the tasks


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class Windows:
    """Distinct windows of some items, as symbol arrays by length, with the items that have them."""

    def __init__(self, items: list[tuple[str, bytes | None]], size: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[str] = []
        numbers: dict[str, int] = {}
        owners: dict[tuple[int, ...], list[int]] = {}
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if not ids:
                continue
            no = numbers.setdefault(item_id, len(self.items))
            if no == len(self.items):
                self.items.append(item_id)
            for s in range(max(1, len(ids) - size + 1)):
                of = owners.setdefault(tuple(ids[s : s + size]), [])
                if no not in of:
                    of.append(no)
        lengths = sorted({len(w) for w in owners})
        self.groups = []
        for n in lengths:
            group = [(w, o) for w, o in owners.items() if len(w) == n]
            self.groups.append((n, np.array([w for w, _ in group], dtype=np.int64), [np.array(o, dtype=np.int64) for _, o in group]))
        self.shortest = lengths[0] if lengths else 0


class WaveletMatrix:
    """Occurrences of symbols before a position, for whole arrays of queries."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.levels = []
        for b in range(self.bits - 1, -1, -1):
            bit = (symbols >> b) & 1
            ones = np.zeros(len(symbols) + 1, dtype=np.int32)
            np.cumsum(bit, out=ones[1:])
            zeros = len(symbols) - int(ones[-1])
            self.levels.append((b, ones, zeros))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, before: np.ndarray) -> np.ndarray:
        low = np.zeros_like(before)
        for b, ones, zeros in self.levels:
            one = ((symbol >> b) & 1).astype(bool)
            low_ones, high_ones = ones[low], ones[before]
            low = np.where(one, zeros + low_ones, low - low_ones)
            before = np.where(one, zeros + high_ones, before - high_ones)
        return before - low


class FmIndex:
    """Full-text index of a symbol array in which 0 ends each run; runs end in a 0 of their own rank."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        ends = text == 0
        n_ends = int(ends.sum())
        rank = np.where(ends, np.cumsum(ends) - 1, text + n_ends - 1)
        step = 1
        while True:
            follow = np.zeros(n, dtype=np.int64)
            follow[:-step or n] = rank[step:] + 1
            key = rank * (int(rank.max()) + 2) + follow
            key[ends] = rank[ends] * (int(rank.max()) + 2)
            order = np.argsort(key, kind="stable")
            fresh = np.empty(n, dtype=np.int64)
            changed = np.concatenate([[0], np.diff(key[order]) != 0]).cumsum()
            fresh[order] = changed
            rank = fresh
            if changed[-1] == n - 1 or step >= n:
                break
            step *= 2
        self.n = n
        suffixes = np.argsort(rank)
        bwt = text[suffixes - 1]  # position 0 is preceded by the last end
        top = int(text.max())
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.ranks = WaveletMatrix(bwt, top)
        self.bwt = bwt
        # Starts of runs are kept too, so that no walk crosses an end.
        kept = (suffixes % SAMPLE == 0) | (bwt == 0)
        self.kept = kept
        self.kept_before = np.cumsum(kept) - 1
        self.samples = suffixes[kept]

    def find(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last row of the suffixes that begin with each window."""
        low = np.zeros(len(windows), dtype=np.int64)
        high = np.full(len(windows), self.n, dtype=np.int64)
        alive = np.flatnonzero((windows < len(self.first) - 1).all(axis=1))
        high[np.setdiff1d(np.arange(len(windows)), alive)] = 0
        for j in range(windows.shape[1] - 1, -1, -1):
            c = windows[alive, j]
            low[alive] = self.first[c] + self.ranks.rank(c, low[alive])
            high[alive] = self.first[c] + self.ranks.rank(c, high[alive])
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        rows = rows.copy()
        walked = np.zeros(len(rows), dtype=np.int64)
        todo = np.flatnonzero(~self.kept[rows])
        while len(todo):
            c = self.bwt[rows[todo]]
            rows[todo] = self.first[c] + self.ranks.rank(c, rows[todo])
            walked[todo] += 1
            todo = todo[~self.kept[rows[todo]]]
        return self.samples[self.kept_before[rows]] + walked


def _merged(marks: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])]


def search_shard(texts: list[bytes | None], windows: Windows) -> list[tuple[int, np.ndarray, list[str]]]:
    """Per document: words, a mark per word that lies in an occurrence, ids of the items found."""
    get = windows.vocabulary.get
    ids = []
    for t in texts:
        words = words_of(t)
        ids.append(np.fromiter(map(get, words, repeat(0)), dtype=np.int64, count=len(words)))
    counts = np.array([len(x) for x in ids], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(counts + 1)])
    flat = np.zeros(int(starts[-1]) + 1, dtype=np.int64)
    for x, s in zip(ids, starts):
        flat[s : s + len(x)] = x
    marks = np.zeros(len(flat) + 1, dtype=np.int64)
    found: dict[int, set[int]] = {}
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (flat != 0).astype(np.int8)])))
    run_start, run_end = edges[::2], edges[1::2]
    long = run_end - run_start >= max(1, windows.shortest)
    run_start, run_end = run_start[long], run_end[long]
    if len(run_start):
        # Each run with the 0 that ends it; position[i] is where symbol i stands in the shard.
        lengths = run_end - run_start + 1
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        position = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - run_start, lengths)
        index = FmIndex(flat[position])
        for size, group, owners in windows.groups:
            low, high = index.find(group)
            hit = np.flatnonzero(high > low)
            if not len(hit):
                continue
            many = high[hit] - low[hit]
            which = np.repeat(hit, many)
            rows = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low[hit], many)
            at = position[index.locate(rows)]
            np.add.at(marks, at, 1)
            np.add.at(marks, at + size, -1)
            pairs = np.unique(np.stack([np.searchsorted(starts, at, side="right") - 1, which]), axis=1)
            for doc, w in pairs.T:
                found.setdefault(int(doc), set()).update(owners[w].tolist())
    covered = np.cumsum(marks) > 0
    return [
        (int(n), covered[s : s + n], [windows.items[i] for i in found.get(d, ())]) for d, (n, s) in enumerate(zip(counts, starts))
    ]


_ROW = "k_id bigint, k_text bigint, n_words bigint, n_hit bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"


def find_windows(docs: DataFrame, items: list[tuple[str, bytes | None]], size: int = 13) -> DataFrame:
    """(k_id, k_text, n_words, n_hit, spans, items) per row of ``docs``; spans are merged ranges of word numbers."""
    sent = docs.sparkSession.sparkContext.broadcast(Windows(items, size))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = sent.value
        for batch in batches:
            rows = search_shard(batch.column("t").to_pylist(), windows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("k_id"),
                    batch.column("k_text"),
                    pa.array([n for n, _, _ in rows], pa.int64()),
                    pa.array([int(m.sum()) for _, m, _ in rows], pa.int64()),
                    pa.array([_merged(m) if m.any() else [] for _, m, _ in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array([i for _, _, i in rows], pa.list_(pa.string())),
                ],
                names=["k_id", "k_text", "n_words", "n_hit", "spans", "items"],
            )

    return docs.select(*identity(), F.col("text").cast("binary").alias("t")).mapInArrow(search, _ROW)


def benchmark_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, bytes | None]]]:
    """The items in blocks of about ``block_words`` words, so that a benchmark of any size takes bounded memory."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    words = rows.agg(F.sum(F.length("text") / 2)).first()[0] or 0
    blocks = max(1, int(-(-words // block_words)))
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else rows
        yield [(r["item_id"], None if r["text"] is None else r["text"].encode()) for r in part.collect()]



def contaminated(n_hit, n_words):
    return (n_hit > 0) & (20 * n_hit >= n_words)


def decontamination_report(docs: DataFrame, benchmark: DataFrame, size: int = 13, block_words: int = BLOCK_WORDS) -> DataFrame:
    """k_id, k_text, n_words, n_hit, n_items, items_sha256, contaminated, spans, items per row of ``docs``.

    Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. A window is ``size`` words of an
    item in a row; a shorter item is one window; an item without words has none. A null text has no words. Items that
    repeat a text are all found. Item ids that are null count as empty ids; items that share an id are one.
    """
    parts = [find_windows(docs, items, size) for items in benchmark_blocks(benchmark, block_words)]
    rows = parts[0]
    if len(parts) > 1:
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        # Ranges found in different blocks meet again: their words are counted once.
        numbers = F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_list("spans")), lambda s: F.sequence(s["start"], s["end"] - 1))))
        rows = every.groupBy("k_id", "k_text").agg(
            F.first("n_words").alias("n_words"), F.array_sort(numbers).alias("numbers"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
            (F.count("*") / len(parts)).cast("int").alias("times"),
        ).withColumn("row", F.explode(F.array_repeat(F.lit(1), F.col("times"))))
        opens = F.filter("numbers", lambda x: ~F.array_contains("numbers", x - 1))
        closes = F.filter("numbers", lambda x: ~F.array_contains("numbers", x + 1))
        rows = rows.select(
            "k_id", "k_text", "n_words", F.size("numbers").cast("bigint").alias("n_hit"),
            F.transform(F.arrays_zip(opens.alias("start"), closes.alias("last")), lambda x: F.struct(x["start"].alias("start"), (x["last"] + 1).alias("end"))).alias("spans"),
            "items",
        )
    return rows.select(
        "k_id",
        "k_text",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
        "spans",
        "items",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 13) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, unchanged."""
    bad = decontamination_report(docs, benchmark, size).where("contaminated").select("k_id", "k_text", F.lit(True).alias("bad")).distinct()
    out, (name,) = with_results(docs, stored(bad), ["bad"], "left")
    return out.where(F.col(name).isNull()).drop(name)
