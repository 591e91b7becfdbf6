"""The stored inverted index against scoring all chunks."""

import random

import pytest

from chunkloom.operators import inverted
from chunkloom.operators.search import sparse_top

SPARSE = "struct<indices:array<bigint>,values:array<double>>"


def tables(spark, chunks, queries, vocabulary, seed):
    rng = random.Random(seed)
    # Neighbours by id are alike, as chunks of one document are; one token is in most chunks.
    def vector(topic, n):
        own = {rng.randrange(vocabulary) for _ in range(n)} | {vocabulary + topic * 5 + rng.randrange(5) for _ in range(n)} | ({0} if rng.random() < 0.8 else set())
        return (sorted(own), [round(1 + rng.random() * 2, 4) for _ in own])

    index = [(f"c{i:04d}", vector(i * 20 // chunks, rng.randrange(0, 6))) for i in range(chunks)] + [("none", None), ("empty", ([], []))]
    asked = [(q, vector(rng.randrange(20), 3)) for q in range(queries)] + [(queries, ([10**9], [1.0])), (queries + 1, None)]
    return (
        spark.createDataFrame(index, f"chunk_id string, sparse {SPARSE}").repartition(5),
        spark.createDataFrame([(q, (v[0], [1.0] * len(v[0])) if v else None) for q, v in asked], f"query_id int, sparse {SPARSE}"),
    )


def rows(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize(("limit", "block_rows"), [(3, 16), (20, 64), (2000, 7)])
def test_agrees_with_scoring_all(spark, tmp_path, limit, block_rows):
    index, queries = tables(spark, 600, 25, 40, limit)
    path = str(tmp_path / "index")
    inverted.build_inverted(index, path, block_rows)
    assert rows(inverted.stored_sparse_top(queries, path, limit)) == rows(sparse_top(queries, index, limit))


def test_blocks_are_skipped_and_bounds_hold(spark, tmp_path):
    index, queries = tables(spark, 800, 20, 40, 1)
    path = str(tmp_path / "index")
    inverted.build_inverted(index, path, 20)
    hits, bounds, scored = inverted._search(queries, path, 3, 2)
    assert rows(hits) == rows(sparse_top(queries, index, 3))
    assert scored.count() < 0.6 * bounds.count()
    # No chunk scores above the bound of its block.
    every = sparse_top(queries, index, 10**6).join(spark.read.parquet(f"{path}/docs").select("chunk_id", "block"), "chunk_id")
    assert every.join(bounds, ["query_id", "block"], "left").where("bound IS NULL OR score > bound + 1e-8").isEmpty()
    size = spark.read.parquet(f"{path}/size").first()
    assert size["chunks"] == 802
    df = {r["idx"]: r["df"] for r in spark.read.parquet(f"{path}/terms").collect()}
    assert df[0] == index.where("array_contains(sparse.indices, 0)").count()


def test_many_queries_are_split(spark, tmp_path, monkeypatch):
    index, queries = tables(spark, 100, 60, 20, 2)
    path = str(tmp_path / "index")
    inverted.build_inverted(index, path, 30)
    monkeypatch.setattr(inverted, "GROUP_TERMS", 10)
    monkeypatch.setattr(inverted, "BROADCAST_ROWS", 5)
    assert rows(inverted.stored_sparse_top(queries, path, 4)) == rows(sparse_top(queries, index, 4))


def test_empty_index(spark, tmp_path):
    index, queries = tables(spark, 5, 3, 20, 3)
    inverted.build_inverted(index.where("false"), str(tmp_path / "index"))
    assert inverted.stored_sparse_top(queries, str(tmp_path / "index"), 4).collect() == []


def test_a_block_scores_many_queries_at_once_as_one_by_one():
    import numpy as np
    import pandas as pd

    from chunkloom.operators import inverted

    rng = np.random.default_rng(3)
    places = [np.sort(rng.permutation(64)[: rng.integers(1, 65)]).astype(np.int32) for _ in range(40)]
    lists = pd.DataFrame({"idx": rng.permutation(40), "block": 7, "places": places, "weights": [np.round(rng.random(len(p)), 4) for p in places]})
    asked = [(q, 7, int(i), 0.5 + i) for q in range(5000) for i in rng.permutation(50)[:3]]
    terms = pd.DataFrame(asked, columns=["query_id", "block", "idx", "weight"])
    score, _ = inverted._score_block(5, "bigint")
    found = score((7, 0), lists, terms)
    slices = -(-terms["query_id"].nunique() // (inverted.SCORE_CELLS // 64))
    assert slices > 1  # the queries need several slices
    held = dict(zip(lists["idx"], zip(lists["places"], lists["weights"])))
    got = {q: list(zip(g["score"], g["place"])) for q, g in found.groupby("query_id", sort=False)}
    for q, own in terms.groupby("query_id"):
        sums: dict[int, float] = {}
        for i, w in zip(own["idx"], own["weight"]):
            for p, v in zip(*held.get(i, ((), ()))):
                sums[int(p)] = sums.get(int(p), 0.0) + v * w
        best = sorted(((-round(s, 9), p) for p, s in sums.items()))[:5]
        assert [(round(s, 9), p) for s, p in got.get(q, [])] == [(-s, p) for s, p in best]
