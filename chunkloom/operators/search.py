"""Batch hybrid retrieval: sparse and dense candidates per query, fused by reciprocal rank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..session import cut_lineage
from .encode import Encoder, postings, query_dense, query_vector, words

RRF_K = 60
SALTS = 32  # postings of one token are spread over this many tasks
BROADCAST_ROWS = 100_000  # query terms up to this count are broadcast
QUERY_BLOCK = 2048  # query vectors scored at a time, about half as many
QUERY_BYTES = 64_000_000  # of query vectors sent to the tasks for one pass over the index
TASK_GROUPS = 64  # groups of tasks whose best rows are merged first
SCORES_AT_ONCE = 2_000_000  # scores of rows by queries that a task holds
SCORE_DIGITS = 9  # scores closer than this are ties, broken by chunk id


def pool_size(limit: int) -> int:
    return max(2 * limit, 20)


def at_most(df: DataFrame, rows: int) -> bool:
    return df.limit(rows + 1).count() <= rows


def top_per_query(scored: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` rows per query with their 1-based ``rank``. Spark cuts before and after the shuffle."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def idf(index: DataFrame, sparse: str = "sparse") -> DataFrame:
    """(idx, df, idf) over the collection: ``ln(1 + (N - df + 0.5) / (df + 0.5))``."""
    df = postings(index, "chunk_id", sparse).groupBy("idx").agg(F.count("*").alias("df"))
    return _with_idf(df, index)


def _with_idf(df: DataFrame, index: DataFrame) -> DataFrame:
    n = index.agg(F.count("*").cast("double")).scalar()
    return df.select("idx", "df", F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def sparse_scores(queries: DataFrame, index: DataFrame, salts: int = SALTS, corpus: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score): dot product of query and document weights times IDF.

    IDF is taken over ``corpus``, the whole collection where ``index`` is a filtered part of it.

    ``queries`` has query_id and sparse. Up to ``BROADCAST_ROWS`` query terms are broadcast. More are
    joined by token with salt, so that a token found in much of the corpus is spread over many tasks.
    """
    terms = postings(queries, "query_id").withColumnRenamed("val", "weight")
    small = at_most(terms, BROADCAST_ROWS)
    wanted = terms.select("idx").distinct()
    pairs = postings(index, "chunk_id")
    whole = index if corpus is None else corpus
    hit = postings(whole, "chunk_id").join(F.broadcast(wanted) if small else wanted, "idx", "left_semi")
    weights = _with_idf(hit.groupBy("idx").agg(F.count("*").alias("df")), whole).select("idx", "idf")
    terms = terms.join(weights, "idx").select("query_id", "idx", (F.col("weight") * F.col("idf")).alias("weight"))
    if small:
        matched = pairs.join(F.broadcast(terms), "idx")
    else:
        salted = terms.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        matched = pairs.withColumn("salt", F.pmod(F.xxhash64("chunk_id"), F.lit(salts)).cast("int")).join(
            salted, ["idx", "salt"]
        )
    return matched.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(F.col("weight") * F.col("val")), SCORE_DIGITS).alias("score")
    )


def sparse_top(queries: DataFrame, index: DataFrame, limit: int, corpus: DataFrame | None = None) -> DataFrame:
    """Best ``limit`` chunks per query by sparse score, with ``sparse_scores`` as the definition.

    The whole vector of a chunk is in one row, so a task scores its rows against the query terms and returns only its
    best per query: no pair of query and chunk is written out. Queries go to the tasks in blocks of bounded size.
    """
    whole = index if corpus is None else corpus
    terms = postings(queries, "query_id").withColumnRenamed("val", "weight")
    n_terms = terms.count()
    wanted = terms.select("idx").distinct()
    wanted = F.broadcast(wanted) if n_terms <= BROADCAST_ROWS else wanted
    counts = postings(whole, "chunk_id").join(wanted, "idx", "left_semi").groupBy("idx").agg(F.count("*").alias("df"))
    weights = _with_idf(counts, whole).select("idx", "idf")
    # Used once per block of queries.
    terms = cut_lineage(terms.join(weights, "idx").select("query_id", "idx", (F.col("weight") * F.col("idf")).alias("weight")))
    blocks = -(-n_terms // BROADCAST_ROWS) or 1
    id_type = dict(queries.dtypes)["query_id"]
    schema = f"query_id {id_type}, chunk_id string, score double"
    rows = index.select(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("sparse.indices").alias("indices"), F.col("sparse.values").alias("weights"))
    found = index.sparkSession.createDataFrame([], schema)
    for b in range(blocks):
        block = terms.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else terms
        found = found.unionByName(rows.mapInPandas(_best_sparse(block.toPandas(), limit), schema))
    return merged_top(found, limit)


def _best(names: np.ndarray, scores: np.ndarray, limit: int) -> np.ndarray:
    """Numbers of the best rows: highest score, then first name."""
    if len(scores) > limit:
        edge = np.partition(scores, len(scores) - limit)[len(scores) - limit]
        near = np.flatnonzero(scores >= edge)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((names[near], -scores[near]))[:limit]]


def _best_sparse(terms: pd.DataFrame, limit: int):
    """Function over batches of (chunk_id, indices, weights): the best rows of the partition per query."""
    terms = terms.sort_values(["idx", "query_id"], kind="stable")
    ids, query = np.unique(terms["query_id"].to_numpy(), return_inverse=True)
    tokens, starts, counts = np.unique(terms["idx"].to_numpy(), return_index=True, return_counts=True)
    weight = terms["weight"].to_numpy(dtype=np.float64)

    def scored(indices: list, values: list) -> np.ndarray:
        lengths = np.array([len(x) for x in indices])
        row = np.repeat(np.arange(len(indices)), lengths)
        flat, value = np.concatenate(indices), np.concatenate(values)
        at = np.minimum(np.searchsorted(tokens, flat), len(tokens) - 1)
        hit = np.flatnonzero(tokens[at] == flat)
        many = counts[at[hit]]
        which = np.repeat(starts[at[hit]], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        source = np.repeat(hit, many)
        sums = np.bincount(row[source] * len(ids) + query[which], value[source] * weight[which], len(indices) * len(ids))
        return np.round(sums.reshape(len(indices), len(ids)), SCORE_DIGITS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = [(np.array([], dtype=str), np.array([])) for _ in ids]
        size = max(1, SCORES_AT_ONCE // max(1, len(ids)))
        for pdf in batches:
            pdf = pdf[pdf["indices"].map(lambda x: x is not None and len(x) > 0)]
            for s in range(0, len(pdf) if len(ids) else 0, size):
                part = pdf.iloc[s : s + size]
                scores, names = scored(list(part["indices"]), list(part["weights"])), part["chunk_id"].to_numpy(dtype=str)
                for q in range(len(ids)):
                    near = np.flatnonzero(scores[:, q])
                    if len(near):
                        n, v = np.concatenate([kept[q][0], names[near]]), np.concatenate([kept[q][1], scores[near, q]])
                        pick = _best(n, v, limit)
                        kept[q] = (n[pick], v[pick])
        for q, (n, v) in zip(ids, kept):
            if len(n):
                yield pd.DataFrame({"query_id": [q] * len(n), "chunk_id": n, "score": v})

    return run


def _best_in_partition(sent, limit: int, block: int):
    """Function over batches of (chunk_id, dense): the best rows of the partition per query of (ids, matrix) in ``sent``.

    The rows of a batch are read once and scored against all queries, ``block`` of them at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix = sent.value
        kept: list[tuple[np.ndarray, np.ndarray]] = [(np.array([], dtype=str), np.array([])) for _ in ids]
        for pdf in batches:
            if pdf.empty:
                continue
            rows = np.vstack([np.asarray(v, dtype=np.float64) for v in pdf["dense"]])
            norm = np.linalg.norm(rows, axis=1, keepdims=True)
            rows = rows / np.where(norm == 0, 1, norm)
            names = pdf["chunk_id"].to_numpy(dtype=str)
            for s in range(0, len(ids), block):
                scores = np.round(rows @ matrix[s : s + block].T, SCORE_DIGITS)
                for q in range(scores.shape[1]):
                    near = _best(names, scores[:, q], limit)
                    n = np.concatenate([kept[s + q][0], names[near]])
                    v = np.concatenate([kept[s + q][1], scores[near, q]])
                    pick = _best(n, v, limit)
                    kept[s + q] = (n[pick], v[pick])
        for q, (n, v) in zip(ids, kept):
            if len(n):
                yield pd.DataFrame({"query_id": [q] * len(n), "chunk_id": n, "score": v})

    return run


def merged_top(found: DataFrame, limit: int) -> DataFrame:
    """The best rows per query of what tasks kept: groups of tasks first, then the groups, so no task reads all of a query."""
    part = Window.partitionBy("query_id", "__tasks").orderBy(F.desc("score"), "chunk_id")
    grouped = found.withColumn("__tasks", F.spark_partition_id() % TASK_GROUPS)
    first = grouped.withColumn("__rank", F.row_number().over(part)).where(F.col("__rank") <= limit).drop("__rank", "__tasks")
    return top_per_query(first, limit)


def dense_top(queries: DataFrame, index: DataFrame, limit: int) -> DataFrame:
    """Best ``limit`` chunks per query by exact cosine.

    Query vectors go to the tasks together, up to ``QUERY_BYTES``, and are scored in blocks while the index is read once;
    only more than that takes another pass. Each task returns only its best rows per query, so no pair of query and
    chunk is ever written out. Queries without a vector, or with the zero vector, have no dense candidates.
    """
    usable = queries.where(F.exists("dense", lambda x: x != 0)).select("query_id", "dense")
    size, widest = usable.agg(F.count("*"), F.max(F.size("dense"))).first()
    passes = -(-size * (widest or 0) * 8 // QUERY_BYTES) or 1
    vectors = index.where(F.col("dense").isNotNull()).select(F.col("chunk_id").cast("string").alias("chunk_id"), "dense")
    id_type = dict(queries.dtypes)["query_id"]
    schema = f"query_id {id_type}, chunk_id string, score double"
    found = index.sparkSession.createDataFrame([], schema)
    for b in range(passes):
        part = usable.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == b) if passes > 1 else usable
        rows = part.toPandas()
        if rows.empty:
            continue
        matrix = np.vstack([np.asarray(v, dtype=np.float64) for v in rows["dense"]])
        matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
        sent = index.sparkSession.sparkContext.broadcast((rows["query_id"].tolist(), matrix))
        found = found.unionByName(vectors.mapInPandas(_best_in_partition(sent, limit, max(1, QUERY_BLOCK // 2)), schema))
    return merged_top(found, limit)


def fuse(sparse: DataFrame, dense: DataFrame, limit: int, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two ranked candidate tables: (query_id, chunk_id, score, rank)."""
    columns = ["query_id", "chunk_id", "rank"]
    both = sparse.select(*columns).unionByName(dense.select(*columns))
    scored = both.groupBy("query_id", "chunk_id").agg(F.sum(F.lit(1.0) / (k + F.col("rank"))).alias("score"))
    return top_per_query(scored.withColumn("score", F.round("score", 12)), limit)


def hybrid_search(
    queries: DataFrame,
    index: DataFrame,
    limit: int = 10,
    where: Column | None = None,
    k: int = RRF_K,
    collection: str | None = None,
) -> DataFrame:
    """Ranked hits with their index columns for a table of queries (query_id, sparse, dense).

    ``where`` restricts the candidates of both retrievers before they are scored; IDF stays that of the collection.
    An index of several collections is searched in the named one.
    """
    index = index.where(F.col("collection") == collection) if collection is not None else index
    pool = index.where(where) if where is not None else index
    n = pool_size(limit)
    hits = fuse(sparse_top(queries, pool, n, index), dense_top(queries, pool, n), limit, k)
    return hits.join(pool.drop("sparse", "dense"), "chunk_id").withColumn("score", F.round("score", 6))


def search_texts(
    queries: DataFrame,
    index: DataFrame,
    encode: Encoder,
    dimension: int,
    limit: int = 10,
    where: Column | None = None,
    tokens: Column | None = None,
    collection: str | None = None,
) -> DataFrame:
    """Hits for query texts (query_id, text); blank queries have none."""
    q = queries.where(~is_blank("text"))
    q = q.select(
        "query_id",
        query_vector(tokens if tokens is not None else words("text")).alias("sparse"),
        query_dense(encode, "text", dimension).alias("dense"),
    )
    return hybrid_search(q, index, limit, where, collection=collection)
