import random
import time

import pytest
from pyspark.sql import functions as F

from chunkloom.operators import edits, export, refine, stats
from chunkloom.operators.chunking import Chunked, chunk_blocks, chunk_stats
from chunkloom.operators.tree import reindex
from chunkloom.sources.blocks import blocks_from_text
from chunkloom.streaming.ingest import ingest, live_points, read_stream


@pytest.fixture(scope="module")
def chunked(spark, tmp_path_factory):
    rows = [("a", "One line.\nAnother line here.\n" * 40), ("b", "Short."), ("c", "\n")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    return chunk_blocks(blocks_from_text(docs, "doc_id", "text"), 64, 200, long_docs=False).save(str(tmp_path_factory.mktemp("chunks")))


def test_save_edited_round_trip(spark, chunked, tmp_path):
    path = str(tmp_path / "edited")
    export.save_edited(chunked, path)
    one = Chunked(*(t.where("doc_id = 'b'") for t in (chunked.sections, chunked.parents, chunked.children.withColumn("text", F.lit("new")))))
    export.save_edited(one, path)
    loaded = export.load_edited(spark, path)
    assert loaded.children.count() == chunked.children.count()
    assert [r.text for r in loaded.children.where("doc_id = 'b'").collect()] == ["new"]
    left = export.reset_edits(loaded, spark.createDataFrame([("b",)], "doc_id string"))
    assert {r.doc_id for r in left.children.select("doc_id").distinct().collect()} == {"a"}


def test_export_files_and_errors(spark, chunked, tmp_path):
    docs = spark.createDataFrame([("a",), ("missing",)], "doc_id string")
    records = export.export_documents(chunked, docs)
    export.write_jsonl(records, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out"))
    assert back.count() == chunked.children.where("doc_id = 'a'").count()
    assert {"id", "parent_context_text", "metadata"} <= set(back.columns) and "raw_html" not in back.columns
    for bad in ([], [("missing",)]):
        with pytest.raises(ValueError):
            export.export_documents(chunked, spark.createDataFrame(bad, "doc_id string"))


def test_edit_then_reindex(spark, chunked):
    first = chunked.children.where("child_pos = 1 AND doc_id = 'a'").select(
        "doc_id", "chunk_id", F.substring_index("text", " ", 3).alias("text1"), F.expr("substr(text, length(substring_index(text, ' ', 3)) + 2)").alias("text2")
    )
    split = edits.split_chunks(chunked, first).stored()
    assert split.children.count() == chunked.children.count() + 1
    pair = split.children.where("child_pos <= 2 AND doc_id = 'a'").select("doc_id", F.lit("m").alias("merge_id"), "chunk_id")
    merged = edits.merge_chunks(split, pair, " ").stored()
    assert merged.children.count() == chunked.children.count()
    text = lambda c: [r.text for r in c.where("doc_id = 'a'").orderBy("child_pos").collect()]
    assert text(merged.children) == text(chunked.children)
    out = reindex(merged).chunked.stored()
    assert text(out.children.withColumn("doc_id", F.when(F.col("metadata")["doc_title"] == "a", "a"))) == text(chunked.children)
    orphans = out.children.join(out.parents, ["doc_id", "parent_chunk_id"], "left_anti")
    assert orphans.isEmpty()


def test_repeated_edits_are_refused(spark, chunked):
    e = chunked.children.where("child_pos = 1 AND doc_id = 'a'").select("doc_id", "chunk_id", F.lit("x").alias("text"))
    with pytest.raises(ValueError):
        edits.update_chunks(chunked, e.union(e))


def test_stats_agree(spark, chunked):
    docs = spark.createDataFrame([("a", "One line.\nAnother line here.\n" * 40), ("b", "Short."), ("c", "\n")], "doc_id string, text string")
    a = chunk_stats(blocks_from_text(docs, "doc_id", "text"), 64, 200)
    b = stats.document_stats(chunked.sections, chunked.parents, chunked.children)
    assert sorted(a.select(sorted(a.columns)).collect()) == sorted(b.select(sorted(b.columns)).collect())


def test_refine_keeps_going(spark):
    def model(prompt, text):
        if "bad" in text:
            raise RuntimeError("no answer")
        return "```markdown\n" + text.upper() + "\n```"

    df = spark.createDataFrame([("d", "1", "good"), ("d", "2", "bad")], "doc_id string, chunk_id string, text string")
    out = {r.chunk_id: (r.refined_text, r.error) for r in refine.refine(df, model).collect()}
    assert out == {"1": ("GOOD", None), "2": (None, "no answer")}
    assert [r.text for r in refine.as_edits(refine.refine(df, model)).collect()] == ["GOOD"]


def test_word_diff(spark):
    df = spark.createDataFrame([("one two three", "one 2 three four"), ("same", "same")], "a string, b string")
    rows = stats.diff_stats(df, "a", "b").collect()
    for r in rows:
        assert r.char_delta == r.added_chars - r.removed_chars
    assert rows[1].modified_segments == 0 and rows[0].removed_chars == 3


def test_refine_asks_once(spark, tmp_path):
    """Equal texts are one question, and a second run asks for new and failed texts only."""
    calls = spark.sparkContext.accumulator(0)

    def model(prompt, text):
        calls.add(1)
        if text == "bad":
            raise RuntimeError("no answer")
        return f"{prompt[:1]}:{text.upper()}"

    df = spark.createDataFrame([("d", "1", "good"), ("d", "2", "bad"), ("e", "3", "good"), ("e", "4", None)], "doc_id string, chunk_id string, text string")
    path = str(tmp_path / "answers")
    rows = lambda found: {r.chunk_id: (r.refined_text, r.error) for r in found.collect()}
    first = rows(refine.refine_once(df, model, path, "Prompt"))
    assert first == {"1": ("P:GOOD", None), "2": (None, "no answer"), "3": ("P:GOOD", None), "4": ("P:", None)}
    assert calls.value == 3
    again = df.where("chunk_id <> '2'")
    assert rows(refine.refine_once(again, model, path, "Prompt")) == {k: v for k, v in first.items() if k != "2"}
    assert calls.value == 3  # a rerun makes no call
    refine.refine_once(df, model, path, "Prompt").collect()
    assert calls.value == 4  # the failed text only
    refine.refine_once(again, model, path, "Other prompt").collect()
    assert calls.value == 6


def test_word_diff_is_minimal_and_fast():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(14))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        found = stats.common_tokens(a, b)
        assert len(found) == table[-1][-1] and all(a[i] == b[j] for i, j in found)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))
    words = [str(rng.randrange(5000)) for _ in range(20_000)]
    other = [w if rng.random() < 0.9 else "new" for w in words]
    began = time.process_time()
    d = stats._word_diff(" ".join(words), " ".join(other))
    assert time.process_time() - began < 5
    assert d["added_chars"] - d["removed_chars"] == len(" ".join(other)) - len(" ".join(words))


def test_stream_replaces_documents(spark, tmp_path):
    schema = "doc_id string, text string, v int"
    src, path = str(tmp_path / "in"), str(tmp_path / "index")

    def step(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        job = ingest(
            read_stream(spark, src, schema), lambda b: blocks_from_text(b, "doc_id", "text"), path, str(tmp_path / "state"), "main",
            version=F.col("v"), buckets=2,
        )
        job.awaitTermination()
        return {r.doc_id: r.text for r in spark.read.parquet(path).collect()}

    assert step([("a", "first", 1), ("a", "second", 2), ("b", "other", 1)]) == {"a": "second", "b": "other"}
    assert step([("a", "third", 3), ("c", "new", 1)]) == {"a": "third", "b": "other", "c": "new"}


def test_stream_versions_and_emptied_documents(spark, tmp_path):
    schema = "doc_id string, text string, v int"
    src, path = str(tmp_path / "in"), str(tmp_path / "index")

    def step(rows, version):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        ingest(
            read_stream(spark, src, schema), lambda b: blocks_from_text(b, "doc_id", "text"), path, str(tmp_path / "state"), "main",
            version=version, buckets=2,
        ).awaitTermination()
        return {r.doc_id: r.text for r in live_points(spark, path).collect()}

    v = F.col("v")
    assert step([("a", "second", 2), ("b", "other", 1)], v) == {"a": "second", "b": "other"}
    assert step([("a", "first, late", 1), ("c", "new", 1)], v) == {"a": "second", "b": "other", "c": "new"}
    assert step([("b", "", 2)], v) == {"a": "second", "c": "new"}
    assert step([("a", "", 3), ("c", " ", 9)], v) == {}
    assert step([("d", "again", 1)], v) == {"d": "again"}


def test_later_batches_win_without_versions(spark, tmp_path):
    schema = "doc_id string, text string, v int"
    src, path = str(tmp_path / "in"), str(tmp_path / "index")
    for text in ("zzz", "aaa", "mmm"):
        spark.createDataFrame([("a", text, 0)], schema).coalesce(1).write.mode("append").parquet(src)
        ingest(read_stream(spark, src, schema), lambda b: blocks_from_text(b, "doc_id", "text"), path, str(tmp_path / "state"), "main", buckets=2).awaitTermination()
        assert [r.text for r in live_points(spark, path).collect()] == [text]


def test_long_and_short_documents_together(spark):
    rows = [("long", "Line of it.\n" * 60), ("short", "One.\nTwo."), ("other", "Text here.\n" * 5)]
    blocks = blocks_from_text(spark.createDataFrame(rows, "doc_id string, text string"), "doc_id", "text")
    mixed = chunk_blocks(blocks, 16, 40, range_rows=20)
    plain = chunk_blocks(blocks, 16, 40, long_docs=False)
    for a, b in ((mixed.sections, plain.sections), (mixed.parents, plain.parents), (mixed.children, plain.children)):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))
    stats_of = lambda **k: sorted(map(str, chunk_stats(blocks, 16, 40, **k).collect()))
    assert stats_of(range_rows=20) == stats_of(long_docs=False)


def test_ingest_of_a_table_in_one_file_or_a_folder(spark, tmp_path):
    from chunkloom.plans.search_queries import QUERIES

    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([(1, "One.", "en", "s", 4), (2, "Two.", "en", "s", 4)], schema).repartition(2).write.parquet(str(tmp_path / "folder/documents.parquet"))
    part = next((tmp_path / "folder/documents.parquet").glob("part-*.parquet"))
    (tmp_path / "file").mkdir()
    (tmp_path / "file/documents.parquet").write_bytes(part.read_bytes())
    (tmp_path / "none").mkdir()
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none/documents.parquet"))
    found = lambda where: QUERIES["stream_ingest"](spark, str(tmp_path / where)).count()
    assert (found("folder"), found("file"), found("none")) == (2, 1, 0)


def test_lengths_find_long_documents(spark):
    rows = [("long", "Line of it.\n" * 60), ("short", "One.\nTwo.")]
    blocks = blocks_from_text(spark.createDataFrame(rows, "doc_id string, text string"), "doc_id", "text")
    lengths = spark.createDataFrame([("long", 61), ("short", 2)], "doc_id string, block_no bigint")
    a, b = chunk_blocks(blocks, 16, 40, range_rows=20, lengths=lengths).children, chunk_blocks(blocks, 16, 40, long_docs=False).children
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))
