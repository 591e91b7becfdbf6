"""Sparse and dense vectors of chunk texts."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import token_hash
from ..functions.text import col, is_blank

Tokenizer = Callable[[str], list[str]]
Encoder = Callable[[list[str]], "np.ndarray"]


def words(text: Column | str, stopwords: Iterable[str] = ()) -> Column:
    """Lower-case words of letters and digits, without stop words."""
    found = F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(r"(?U)([\p{L}\p{N}]+)"))
    stop = list(stopwords)
    if stop:
        found = F.filter(found, lambda w: ~w.isin(*stop))
    return F.transform(found, F.lower)


def tokens_with(tokenizer: Tokenizer, text: Column | str) -> Column:
    """Tokens by a user's tokenizer, in Arrow batches."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: [w.strip().lower() for w in tokenizer(t) if w.strip()] if t and t.strip() else [])

    return run(col(text))


VECTOR = "struct<indices:array<bigint>,values:array<double>>"
TOKENS_AT_ONCE = 1_000_000  # tokens of a batch that a task counts at a time


def document_vector(tokens: Column | str) -> Column:
    """Sparse vector of a document: ``1 + ln(count)`` per token, 4 decimals, sorted by index.

    Tokens are counted by Arrow batch, so encoding needs no shuffle, and a token that many rows of a batch share is hashed
    once. Where two tokens share an index the larger weight stays. Null tokens do not count.
    """

    @F.arrow_udf(VECTOR)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            ends = np.cumsum(pc.list_value_length(rows).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            cuts = np.flatnonzero(np.diff(ends // TOKENS_AT_ONCE)) + 1
            bounds = [0, *cuts.tolist(), len(rows)]
            parts = [_count_vectors(rows.slice(lo, hi - lo)) for lo, hi in zip(bounds, bounds[1:])]
            yield pa.concat_arrays(parts)

    return run(col(tokens))


def _count_vectors(rows: pa.Array) -> pa.Array:
    """Vectors of lists of tokens."""
    lengths = pc.list_value_length(rows).fill_null(0).to_numpy(zero_copy_only=False)
    row, flat = np.repeat(np.arange(len(rows), dtype=np.int64), lengths), rows.flatten()
    if flat.null_count:
        row, flat = row[flat.is_valid().to_numpy(zero_copy_only=False)], flat.drop_null()
    coded = flat.dictionary_encode()
    names = coded.dictionary.cast(pa.binary()).to_pylist()
    index = np.array([int.from_bytes(hashlib.sha256(t).digest()[:4], "big") for t in names], dtype=np.int64)
    pair, count = np.unique(row * max(len(names), 1) + coded.indices.to_numpy(), return_counts=True)
    counts, at = np.unique(count, return_inverse=True)
    weight = np.array([_weight(int(c)) for c in counts], dtype=float)[at]
    key = (pair // max(len(names), 1) << 32) | index[pair % max(len(names), 1)]
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    if len(first) < len(key):
        weight = np.maximum.reduceat(weight, first)
        key = key[first]
    ends = np.cumsum(np.bincount(key >> 32, minlength=len(rows)))
    offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (key & 0xFFFFFFFF, weight)]
    return pa.StructArray.from_arrays(lists, names=["indices", "values"])


def _weight(count: int) -> Decimal:
    # Halves go up, as Spark rounds.
    return Decimal(repr(1.0 + math.log(count))).quantize(Decimal("0.0001"), ROUND_HALF_UP)


def query_vector(tokens: Column | str) -> Column:
    """Sparse vector of a query: weight 1 for every distinct index."""
    indices = F.array_sort(F.array_distinct(F.transform(col(tokens), token_hash)))
    return F.transform(
        F.array(indices),
        lambda x: F.struct(x.alias("indices"), F.transform(x, lambda i: F.lit(1.0)).alias("values")),
    )[0]


def postings(vectors: DataFrame, key: str, sparse: str = "sparse") -> DataFrame:
    """Long form of sparse vectors: (key, idx, val)."""
    pairs = F.arrays_zip(F.col(sparse)["indices"].alias("idx"), F.col(sparse)["values"].alias("val"))
    return vectors.select(key, F.explode(pairs).alias("p")).select(key, "p.idx", "p.val")


def dense_vectors(encode: Encoder, text: Column | str, batch_size: int = 16) -> Column:
    """L2-normalised dense vectors by a user's encoder; blank texts are encoded as one space."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            clean = [t if t and t.strip() else " " for t in batch]
            parts = [np.asarray(encode(clean[i : i + batch_size]), dtype=float) for i in range(0, len(clean), batch_size)]
            matrix = np.vstack(parts) if parts else np.zeros((0, 1))
            norm = np.linalg.norm(matrix, axis=1, keepdims=True)
            yield pd.Series(list((matrix / np.where(norm == 0, 1, norm)).astype(np.float32)), dtype=object)

    return run(col(text))


def query_dense(encode: Encoder, text: Column | str, dimension: int) -> Column:
    """Dense vector of a query; a blank query gives the zero vector."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), dimension)
    return F.when(is_blank(text), zero).otherwise(dense_vectors(encode, text))


def normalized(vector: Column | str) -> Column:
    """L2-normalised copy of a vector; the zero vector stays."""
    v = F.transform(col(vector), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)
