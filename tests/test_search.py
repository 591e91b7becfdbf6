import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkloom.operators import index as ix
from chunkloom.operators import search
from chunkloom.operators.encode import dense_vectors, document_vector, query_dense, query_vector, tokens_with, words


def vectors(spark, texts):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "chunk_id string, text string")
    return df.select("chunk_id", document_vector(words("text")).alias("sparse"))


def test_sparse_vectors(spark):
    rows = {r.chunk_id: r.sparse for r in vectors(spark, ["apple Apple APPLE pear", "", "apple"]).collect()}
    assert sorted(rows["0"].values) == [1.0, round(1 + math.log(3), 4)]
    assert rows["0"].indices == sorted(rows["0"].indices) and rows["1"].indices == []
    q = spark.range(1).select(query_vector(words(F.lit("pear pear apple"))).alias("q")).first().q
    assert q.indices == rows["0"].indices and q.values == [1.0, 1.0]


def test_custom_tokenizer_and_stopwords(spark):
    df = spark.createDataFrame([("the Cat sat",)], "text string")
    r = df.select(words("text", ["the"]).alias("w"), tokens_with(lambda t: t.split("a"), "text").alias("t")).first()
    assert (r.w, r.t) == (["cat", "sat"], ["the c", "t s", "t"])


def corpus(spark, n=40, seed=1):
    rng = random.Random(seed)
    vocabulary = ["common", "red", "green", "blue", "rare"]
    rows = [
        (f"k{i}", " ".join(["common"] + [rng.choice(vocabulary) for _ in range(6)]), [float(rng.randint(-3, 3)) for _ in range(4)])
        for i in range(n)
    ]
    df = spark.createDataFrame(rows, "chunk_id string, text string, dense array<float>")
    return df.select("*", document_vector(words("text")).alias("sparse")), rows


def test_salted_join_equals_broadcast(spark, monkeypatch):
    points, _ = corpus(spark)
    q = spark.createDataFrame([(1, "common rare"), (2, "blue")], "query_id int, text string")
    q = q.select("query_id", query_vector(words("text")).alias("sparse"))
    a = sorted(search.sparse_scores(q, points).collect())
    monkeypatch.setattr(search, "BROADCAST_ROWS", 0)
    b = sorted(search.sparse_scores(q, points, salts=5).collect())
    assert a == b and len(a) > 40


@pytest.mark.parametrize("block", [2048, 2])
def test_dense_top_is_exact(spark, monkeypatch, block):
    monkeypatch.setattr(search, "QUERY_BLOCK", block)
    points, rows = corpus(spark)
    qs = [(i, [float(i - 2), 1.0, 0.5, -1.0]) for i in range(5)] + [(9, [0.0] * 4)]
    q = spark.createDataFrame(qs, "query_id int, dense array<float>")
    got = {}
    for r in search.dense_top(q, points.repartition(3), 7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    want = {}
    for i, v in qs[:-1]:
        def score(d):
            return round(float(np.dot(v, d) / (np.linalg.norm(v) * (np.linalg.norm(d) or 1))), 9)

        want[i] = [k for k, _, d in sorted(rows, key=lambda r: (-score(r[2]), r[0]))][:7]
    assert got == want


def test_hybrid_first_hit_and_filter(spark):
    points = spark.createDataFrame(
        [("a", "hybrid search of text", [0.1, 0.2, 0.3, 0.4], "x"), ("b", "other words", [0.4, 0.3, 0.2, 0.1], "y")],
        "chunk_id string, text string, dense array<float>, part string",
    ).withColumn("sparse", document_vector(words("text")))
    q = spark.createDataFrame([(1, [0.12, 0.22, 0.28, 0.38], "search text"), (2, [0.0] * 4, "")], "query_id int, dense array<float>, text string")
    q = q.select("query_id", "dense", query_vector(words("text")).alias("sparse"))
    hits = search.hybrid_search(q, points).orderBy("rank").collect()
    assert [h.chunk_id for h in hits] == ["a", "b"] and hits[0].score == round(2 / 61, 6)
    only = search.hybrid_search(q, points, where=F.col("part") == "y").collect()
    assert [h.chunk_id for h in only] == ["b"]


def encoder():
    # Functions made here travel to the tasks by value.
    return lambda texts: np.array([[len(t), t.count("a"), 1.0] for t in texts])


def test_dense_encoder(spark):
    df = spark.createDataFrame([("aab",), ("",)], "text string")
    rows = df.select(dense_vectors(encoder(), "text", 1).alias("v"), query_dense(encoder(), "text", 3).alias("q")).collect()
    assert np.allclose(rows[0].v, np.array([3, 2, 1]) / math.sqrt(14)) and np.allclose(rows[1].q, 0)
    assert np.isclose(np.linalg.norm(rows[1].v), 1)


def test_search_texts(spark):
    points, _ = corpus(spark, 10)
    points = points.withColumn("dense", dense_vectors(encoder(), "text"))
    q = spark.createDataFrame([(1, "rare blue"), (2, "  ")], "query_id int, text string")
    hits = search.search_texts(q, points, encoder(), 3, limit=4).collect()
    assert {h.query_id for h in hits} == {1} and sorted(h.rank for h in hits) == [1, 2, 3, 4]


def test_upsert_and_delete(spark):
    def rows(*r):
        return spark.createDataFrame(r, "point_id string, v int, m map<string,string>, doc_id string, doc_title string, breadcrumbs array<string>")

    old = rows(("1", 1, {"a": "x"}, "d1", "", ["T"]), ("2", 1, {}, "d2", "T2", []))
    new = rows(("2", 3, {"b": "y"}, "d2", "T2", []), ("2", 2, {}, "d2", "T2", []), ("3", 1, {}, "d3", "", None))
    out = ix.upsert(old, new, version=F.col("v"))
    assert {r.point_id: (r.v, r.m) for r in out.collect()} == {"1": (1, {"a": "x"}), "2": (3, {"b": "y"}), "3": (1, {})}
    gone = spark.createDataFrame([("T",), ("T2",)], "name string")
    assert [r.point_id for r in ix.delete_documents(out, gone).collect()] == ["3"]


def test_collection(spark, tmp_path):
    path = str(tmp_path / "index")
    assert ix.create_collection(spark, path, "a") and not ix.create_collection(spark, path, "a") and ix.create_collection(spark, path, "a", True)
    assert ix.read_index(spark, path).count() == 0
    row = spark.createDataFrame([], ix.INDEX).unionByName(spark.createDataFrame([("p", "a", "c")], "point_id string, collection string, chunk_id string"), True)
    row.write.mode("append").partitionBy("collection").parquet(path)
    assert ix.create_collection(spark, path, "b") and [r.collection for r in ix.read_index(spark, path).collect()] == ["a"]
    assert ix.create_collection(spark, path, "a", True) and ix.read_index(spark, path).count() == 0


def test_collections_are_apart(spark):
    rows = lambda c, v: spark.createDataFrame([(c, "1", v, "d1", "", ["T"])], "collection string, point_id string, v int, doc_id string, doc_title string, breadcrumbs array<string>")
    both = ix.upsert(rows("a", 1), rows("b", 2), version=F.col("v"))
    assert sorted((r.collection, r.v) for r in both.collect()) == [("a", 1), ("b", 2)]
    gone = spark.createDataFrame([("T",)], "name string")
    assert [r.collection for r in ix.delete_documents(both, gone, "a").collect()] == ["b"]


def test_delete_leaves_points_of_one_id_elsewhere(spark):
    """One point id in three collections (one without name): only points that a name hits go, in all collections."""
    data = [("a", "1", "d1"), ("b", "1", "d2"), (None, "1", "d1"), (None, "2", "d2"), ("b", "3", "d1"), ("a", None, "d1"), ("b", None, "d2")]
    index = spark.createDataFrame([(*r, "", None) for r in data], "collection string, point_id string, doc_id string, doc_title string, breadcrumbs array<string>")
    left = ix.delete_documents(index, spark.createDataFrame([("d1",)], "name string")).collect()
    assert sorted(((r.collection, r.point_id, r.doc_id) for r in left), key=str) == sorted((r for r in data if r[2] == "d2"), key=str)


def test_idf_of_the_whole_collection(spark):
    points = spark.createDataFrame([(f"c{i}", "red blue" if i < 3 else "red", "x" if i < 2 else "y") for i in range(9)], "chunk_id string, text string, part string")
    points = points.withColumn("sparse", document_vector(words("text"))).withColumn("dense", F.lit(None).cast("array<float>"))
    q = spark.createDataFrame([(1, "blue red", None)], "query_id int, text string, dense array<float>").withColumn("sparse", query_vector(words("text")))
    part = points.where("part = 'x'")
    scores = {r.chunk_id: r.score for r in search.sparse_scores(q, part, corpus=points).collect()}
    want = math.log(1 + 6.5 / 3.5) + math.log(1 + 0.5 / 9.5)
    assert scores == {"c0": round(want, 9), "c1": round(want, 9)}


def test_dense_top_in_several_passes(spark, monkeypatch):
    """More query vectors than one pass takes give the same rows."""
    points, _ = corpus(spark)
    q = spark.createDataFrame([(i, [float(i - 2), 1.0, 0.5, -1.0]) for i in range(9)], "query_id int, dense array<float>")
    rows = lambda: sorted(map(str, search.dense_top(q, points.repartition(3), 5).collect()))
    one = rows()
    monkeypatch.setattr(search, "QUERY_BYTES", 3 * 4 * 8)
    monkeypatch.setattr(search, "TASK_GROUPS", 2)
    assert rows() == one and len(one) == 45
