"""Steps that the time of large runs hangs on: how often tables are read and joined, and what a batch works out once."""

import math
from collections import Counter
from hashlib import sha256

import pyarrow as pa

from chunkloom.operators import edits, encode
from chunkloom.operators.chunking import Chunked
from chunkloom.schemas import CHILDREN, PARENTS, SECTIONS


def stored_chunks(spark, path, texts):
    """One section and parent with a child per text, as files."""
    children = [
        ("d", f"d_c{i:04d}", i, "d_p0001", "d_s01", "paragraph", t, None, None, None, None, 1, i, i, ["d"], False, False, False, False, {})
        for i, t in enumerate(texts, 1)
    ]
    rows = {
        "sections": ([("d", "d_s00", 0, "d", 0, None, ["d"], 1, 1), ("d", "d_s01", 1, "A", 1, "d_s00", ["d", "A"], 1, 1)], SECTIONS),
        "parents": ([("d", "d_p0001", 1, "d_s01", "A", "\n\n".join(texts), 1, 1, len(texts), ["d", "A"], False)], PARENTS),
        "children": (children, CHILDREN),
    }
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{path}/{name}")
    return Chunked(*(spark.read.schema(schema).parquet(f"{path}/{name}") for name, (_, schema) in rows.items()))


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_split_reads_the_chunks_few_times(spark, tmp_path):
    c = stored_chunks(spark, tmp_path, ["one two", "three four", "five"])
    e = c.children.where("child_pos < 3").selectExpr("doc_id", "chunk_id", "substring(text, 1, 3) AS text1", "substring(text, 5) AS text2")
    out = edits.split_chunks(c, e)
    assert plan_of(out.children).count("Relation") <= 4
    rows = [(r.chunk_id, r.child_pos, r.text, r.is_edited) for r in out.children.orderBy("child_pos").collect()]
    assert rows == [
        ("d_c0001", 1, "one", True), ("d_c0004", 2, "two", True), ("d_c0002", 3, "thr", True), ("d_c0005", 4, "e four", True), ("d_c0003", 5, "five", False),
    ]
    assert out.parents.first().text == "\n\n".join(r[2] for r in rows)


def test_vectors_hash_a_token_of_a_batch_once(monkeypatch):
    hashed = []
    monkeypatch.setattr(encode.hashlib, "sha256", lambda t: hashed.append(t) or sha256(t))
    lists = [["b", "a", "b"], None, [], ["é", "a", None]]
    got = encode._count_vectors(pa.array(lists, pa.list_(pa.string()))).to_pylist()
    assert sorted(hashed) == sorted([b"a", b"b", "é".encode()])
    number = lambda t: int(sha256(t.encode()).hexdigest()[:8], 16)
    for tokens, vector in zip(lists, got):
        want = sorted((number(t), round(1 + math.log(n), 4)) for t, n in Counter(t for t in tokens or [] if t).items())
        assert list(zip(vector["indices"], vector["values"])) == want


def test_vectors_of_equal_indices_and_slices(spark, monkeypatch):
    """Of two tokens with one index the larger weight stays; batches cut in slices give the same rows."""
    real = encode.hashlib.sha256
    monkeypatch.setattr(encode.hashlib, "sha256", lambda t: real(b"same"))
    assert encode._count_vectors(pa.array([["a", "b", "b"]])).to_pylist()[0]["values"] == [1.6931]
    monkeypatch.setattr(encode.hashlib, "sha256", real)
    rows = spark.range(0, 200, 1, 1).selectExpr("id", "CAST(transform(sequence(0, id % 7), x -> x * id % 5) AS array<string>) AS t")
    whole = rows.select("id", encode.document_vector("t").alias("v")).collect()
    monkeypatch.setattr(encode, "TOKENS_AT_ONCE", 10)
    assert rows.select("id", encode.document_vector("t").alias("v")).collect() == whole
