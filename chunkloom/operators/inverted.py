"""A stored inverted index of sparse vectors, searched exactly without scoring blocks that cannot reach the top.

Chunks are numbered in the order of their ids and cut into blocks. A posting row holds what one token has in one block:
places, weights and the largest weight. Document frequencies and the number of chunks are stored beside. A search sums
the largest weights to a bound per query and block, scores the best blocks first, and then only those whose bound
reaches the score found.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .encode import postings
from .search import BROADCAST_ROWS, SCORE_DIGITS, at_most, top_per_query

BLOCK_ROWS = 1024
FIRST_BLOCKS = 2  # blocks per query that are scored before any is left out
GROUP_TERMS = 100_000  # query terms scored against a block in one task, about
SCORE_CELLS = 2**17  # scores of queries and places that are summed at once


def build_inverted(index: DataFrame, path: str, block_rows: int = BLOCK_ROWS) -> None:
    """Write the inverted index of (chunk_id, sparse) to ``path``: docs, postings, terms and size.

    ``index`` has each chunk once; chunks without a vector count in the size only. Weights must not be negative.
    """
    spark = index.sparkSession
    number = F.monotonically_increasing_id()
    rows = index.select(F.col("chunk_id").cast("string").alias("chunk_id"), "sparse").repartitionByRange("chunk_id").sortWithinPartitions("chunk_id").withColumn("at", number)
    local = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    # Blocks never cross a partition, so their numbers need no count of what lies before.
    block = (F.shiftright("at", 33) * (1 << 33) + F.floor(local / block_rows)).cast("bigint")
    rows.select("chunk_id", "sparse", block.alias("block"), (local % block_rows).cast("int").alias("place")).write.mode("overwrite").parquet(f"{path}/docs")
    docs = spark.read.parquet(f"{path}/docs")
    pairs = docs.select("block", "place", F.explode(F.arrays_zip(F.col("sparse.indices").alias("idx"), F.col("sparse.values").alias("val"))).alias("p"))
    grouped = pairs.groupBy(F.col("p.idx").alias("idx"), "block").agg(
        F.array_sort(F.collect_list(F.struct("place", F.col("p.val").alias("val")))).alias("l"), F.max("p.val").alias("most")
    )
    flat = grouped.select("idx", "block", "most", F.transform("l", lambda x: x["place"]).alias("places"), F.transform("l", lambda x: x["val"]).alias("weights"))
    # A token of most of the corpus is many rows; files hold ranges of tokens, so that a search skips files.
    flat.repartitionByRange("idx", "block").sortWithinPartitions("idx", "block").write.mode("overwrite").parquet(f"{path}/postings")
    stored = spark.read.parquet(f"{path}/postings")
    terms = stored.groupBy("idx").agg(F.sum(F.size("places")).cast("bigint").alias("df"))
    terms.repartitionByRange("idx").sortWithinPartitions("idx").write.mode("overwrite").parquet(f"{path}/terms")
    docs.agg(F.count("*").alias("chunks"), F.count_distinct("block").alias("blocks")).coalesce(1).write.mode("overwrite").parquet(f"{path}/size")


def _weights(queries: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """(query_id, idx, weight): query weights times IDF, of tokens the index has."""
    n = spark.read.parquet(f"{path}/size").select(F.col("chunks").cast("double")).scalar()
    terms = postings(queries, "query_id").join(spark.read.parquet(f"{path}/terms"), "idx")
    return terms.select("query_id", "idx", (F.col("val") * F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("weight"))


def block_bounds(weights: DataFrame, path: str) -> DataFrame:
    """(query_id, block, bound): no chunk of the block has a higher score for the query."""
    most = weights.sparkSession.read.parquet(f"{path}/postings").select("idx", "block", "most")
    terms = F.broadcast(weights) if at_most(weights, BROADCAST_ROWS) else weights
    return most.join(terms, "idx").groupBy("query_id", "block").agg(F.sum(F.col("weight") * F.col("most")).alias("bound"))


def _score_block(limit: int, id_type: str):
    def score(key: tuple, lists: pd.DataFrame, terms: pd.DataFrame) -> pd.DataFrame:
        code, queries = pd.factorize(terms["query_id"])
        by_idx = lists.sort_values("idx")
        idx, asked = by_idx["idx"].to_numpy(np.int64), terms["idx"].to_numpy(np.int64)
        at = np.searchsorted(idx, asked)
        held = np.flatnonzero((at < len(idx)) & (idx[np.minimum(at, len(idx) - 1)] == asked) & (code >= 0)) if len(idx) else np.empty(0, dtype=np.int64)
        if not len(held):
            return pd.DataFrame({"query_id": [], "block": [], "place": [], "score": []}).astype({"block": "int64", "place": "int32", "score": "float64"})
        held = held[np.argsort(code[held], kind="stable")]
        code, at, weight = code[held], at[held], terms["weight"].to_numpy(np.float64)[held]
        counts = by_idx["places"].map(len).to_numpy(np.int64)
        firsts = np.cumsum(counts) - counts
        places = np.concatenate(by_idx["places"].to_numpy())
        values = np.concatenate(by_idx["weights"].to_numpy()).astype(np.float64)
        size = int(places.max()) + 1
        out = []
        # As many queries at once as there is room for a number per query and place.
        step = max(1, SCORE_CELLS // size)
        edges = np.searchsorted(code, np.arange(0, code[-1] + 1 + step, step))
        for part, (s, e) in enumerate(zip(edges[:-1], edges[1:])):
            n = counts[at[s:e]]
            own = np.repeat(np.arange(s, e), n)
            of = np.arange(len(own)) + np.repeat(firsts[at[s:e]] - (np.cumsum(n) - n), n)
            cell = (code[own] - part * step) * size + places[of]
            sums = np.bincount(cell, values[of] * weight[own], step * size).reshape(step, size)
            seen = np.bincount(cell, minlength=step * size).reshape(step, size) > 0
            scores = np.where(seen, np.round(sums, SCORE_DIGITS), -np.inf)
            best = np.argsort(-scores, axis=1, kind="stable")[:, :limit]  # places follow the order of ids
            row = np.repeat(np.arange(step), best.shape[1])
            best = best.ravel()
            real = seen[row, best]
            row, best = row[real], best[real]
            out.append(pd.DataFrame({"query_id": queries[row + part * step], "block": key[0], "place": best.astype(np.int32), "score": scores[row, best]}))
        return pd.concat(out)

    return score, f"query_id {id_type}, block bigint, place int, score double"


def score_blocks(pairs: DataFrame, weights: DataFrame, path: str, limit: int) -> DataFrame:
    """(query_id, chunk_id, score): the best ``limit`` chunks of each (query_id, block) of ``pairs``.

    A task holds the postings of one block for the tokens asked for, and a bounded share of the queries.
    """
    spark = pairs.sparkSession
    terms = pairs.select("query_id", "block").join(weights, "query_id")
    groups = max(1, -(-weights.count() // GROUP_TERMS))
    terms = terms.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(groups)))
    wanted = terms.select("idx", "block", F.col("part").alias("group")).distinct()
    wanted = F.broadcast(wanted) if at_most(wanted, BROADCAST_ROWS) else wanted
    lists = spark.read.parquet(f"{path}/postings").select("idx", "block", "places", "weights").join(wanted, ["idx", "block"])
    run, schema = _score_block(limit, dict(weights.dtypes)["query_id"])
    found = lists.groupBy("block", "group").cogroup(terms.groupBy("block", "part")).applyInPandas(lambda key, a, b: run(key, a, b), schema)
    ids = spark.read.parquet(f"{path}/docs").select("block", "place", "chunk_id")
    return found.join(ids, ["block", "place"]).select("query_id", "chunk_id", "score")


def stored_sparse_top(queries: DataFrame, path: str, limit: int, first_blocks: int = FIRST_BLOCKS) -> DataFrame:
    """Best ``limit`` chunks per query (query_id, sparse) from the index at ``path``, as ``sparse_top`` finds them."""
    return _search(queries, path, limit, first_blocks)[0]


def _search(queries: DataFrame, path: str, limit: int, first_blocks: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hits, bounds of all blocks, blocks that were scored)."""
    weights = cut_lineage(_weights(queries, queries.sparkSession, path))
    bounds = cut_lineage(block_bounds(weights, path))
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    first = bounds.withColumn("no", F.row_number().over(order)).where(F.col("no") <= first_blocks).select("query_id", "block")
    first = cut_lineage(first)
    found = cut_lineage(top_per_query(score_blocks(first, weights, path, limit), limit).drop("rank"))
    # A query with fewer than ``limit`` chunks so far has no score to reach.
    reached = found.groupBy("query_id").agg(F.when(F.count("*") >= limit, F.min("score")).alias("least"))
    slack = 10.0 ** (1 - SCORE_DIGITS)
    rest = bounds.join(first, ["query_id", "block"], "left_anti").join(reached, "query_id", "left")
    rest = cut_lineage(rest.where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - slack)).select("query_id", "block"))
    both = found.unionByName(score_blocks(rest, weights, path, limit))
    return top_per_query(both, limit), bounds, first.unionByName(rest)
