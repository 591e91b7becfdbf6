"""Registered queries of encoding, index maintenance, retrieval and ingest.

Documents are the indexed chunks; embeddings pair with documents by number, and with the benchmark texts,
which are the queries.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..operators import index as ix
from ..operators import search
from ..operators.inverted import build_inverted, stored_sparse_top
from ..operators.encode import document_vector, normalized, postings, query_vector, words
from ..operators.refine import refine, refine_once
from ..operators.cleanup import clean_documents, document_store, store_documents
from ..session import checkpoint_dir, cut_lineage, scratch_dir
from ..sources.artifacts import mark_indexed
from ..sources.blocks import blocks_from_text
from ..streaming.ingest import ingest, ingest_versions, live_points, point_versions, read_stream
from . import chunk_sql
from .tables import line_chunks, table, with_lines

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None, lines: bool = False):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_lines(sql) if lines else sql
        return fn

    return add


TOKENS = r"unnest(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+'))"
HASH = "('0x' || substr(sha256({0}), 1, 8))::BIGINT"
POSTINGS = f"""
    tok AS (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents),
    post AS (SELECT doc_id, {HASH.format('t')} AS idx, max(round(1 + ln(c), 4)) AS val
             FROM (SELECT doc_id, t, count(*) AS c FROM tok GROUP BY ALL) GROUP BY ALL)"""
SCORES = f"""{POSTINGS},
    idf AS (SELECT idx, count(*) AS df, ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM post GROUP BY 1),
    qt AS (SELECT DISTINCT item_id, {HASH.format('t')} AS idx FROM (SELECT item_id, {TOKENS.format('text')} AS t FROM benchmark)),
    ss AS (SELECT item_id, doc_id, round(sum(idf * val), 9) AS score FROM qt JOIN idf USING (idx) JOIN post USING (idx) GROUP BY ALL),
    sr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id::VARCHAR) AS rank FROM ss)"""
DENSE = """
    vec AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings),
    ds AS (SELECT q.item_id, d.vec_id AS doc_id, round(list_inner_product(v.e, d.e) / (v.n * d.n), 9) AS score
           FROM benchmark q JOIN vec v ON v.vec_id = q.item_id JOIN vec d ON d.vec_id IN (SELECT doc_id FROM documents)),
    dr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id::VARCHAR) AS rank FROM ds)"""


def points(spark, sf):
    d = table(spark, sf, "documents")
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("dense"))
    rows = d.join(v, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("chunk_id"), "lang", "source", document_vector(words("text")).alias("sparse"), "dense"
    )
    # An index is a stored table: encode once, search many times.
    return cut_lineage(rows)


def questions(spark, sf):
    b = table(spark, sf, "benchmark")
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("dense"))
    return b.join(v, "item_id", "left").select(F.col("item_id").alias("query_id"), query_vector(words("text")).alias("sparse"), "dense")


@query("sparse_vectors", f"WITH {POSTINGS} SELECT doc_id, idx, val FROM post")
def sparse_vectors(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", document_vector(words("text")).alias("sparse"))
    return postings(d, "doc_id")


@query("query_vectors", f"SELECT DISTINCT item_id, {HASH.format('t')} AS idx, 1.0::DOUBLE AS val FROM (SELECT item_id, {TOKENS.format('text')} AS t FROM benchmark)")
def query_vectors(spark, sf):
    q = table(spark, sf, "benchmark").select("item_id", query_vector(words("text")).alias("sparse"))
    return postings(q, "item_id")


@query("idf", f"WITH {SCORES} SELECT idx, df, round(idf, 9) AS idf FROM idf")
def idf(spark, sf):
    return search.idf(points(spark, sf)).withColumn("idf", F.round("idf", 9))


@query("sparse_topk", f"WITH {SCORES} SELECT item_id AS query_id, doc_id::VARCHAR AS chunk_id, score, rank::INT AS rank FROM sr WHERE rank <= 20")
def sparse_topk(spark, sf):
    return search.sparse_top(questions(spark, sf), points(spark, sf), 20)


@query("stored_sparse_topk", f"WITH {SCORES} SELECT item_id AS query_id, doc_id::VARCHAR AS chunk_id, score, rank::INT AS rank FROM sr WHERE rank <= 20")
def stored_sparse_topk(spark, sf):
    """The same from a stored inverted index, without scoring all blocks."""
    path = scratch_dir(spark, "inverted")
    build_inverted(points(spark, sf), path, block_rows=64)
    return stored_sparse_top(questions(spark, sf), path, 20)


@query("dense_topk", f"WITH {DENSE} SELECT item_id AS query_id, doc_id::VARCHAR AS chunk_id, score, rank::INT AS rank FROM dr WHERE rank <= 20")
def dense_topk(spark, sf):
    return search.dense_top(questions(spark, sf), points(spark, sf), 20)


# Candidates among the kept documents, IDF over all.
KEPT_SCORES = SCORES.replace("JOIN post USING (idx) GROUP", "JOIN post USING (idx) WHERE doc_id IN (SELECT doc_id FROM kept) GROUP")
FUSED = """
    both_ranks AS (SELECT item_id, doc_id, rank FROM sr WHERE rank <= 20 UNION ALL SELECT item_id, doc_id, rank FROM dr WHERE rank <= 20),
    fused AS (SELECT item_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM both_ranks GROUP BY ALL),
    top AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id::VARCHAR)::INT AS rank FROM fused)"""


@query(
    "rrf_hybrid",
    f"""WITH {SCORES}, {DENSE}, {FUSED}
        SELECT item_id AS query_id, doc_id::VARCHAR AS chunk_id, round(score, 6) AS score, rank, lang, source
        FROM top JOIN documents USING (doc_id) WHERE rank <= 10""",
)
def rrf_hybrid(spark, sf):
    return search.hybrid_search(questions(spark, sf), points(spark, sf), 10)


@query(
    "filtered_hybrid",
    f"""WITH kept AS (SELECT * FROM documents WHERE lang = 'en'), {KEPT_SCORES}, {DENSE.replace('documents', 'kept')}, {FUSED}
        SELECT item_id AS query_id, doc_id::VARCHAR AS chunk_id, round(score, 6) AS score, rank, lang, source
        FROM top JOIN kept USING (doc_id) WHERE rank <= 10""",
)
def filtered_hybrid(spark, sf):
    return search.hybrid_search(questions(spark, sf), points(spark, sf), 10, where=F.col("lang") == "en")


@query(
    "vector_norms",
    "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS before, 1.0::DOUBLE AS after, len(embedding) <> 64 AS wrong FROM embeddings",
)
def vector_norms(spark, sf):
    norm = lambda v: F.round(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), 6)
    e = table(spark, sf, "embeddings")
    return e.select(
        "vec_id",
        norm(F.transform("embedding", lambda x: x.cast("double"))).alias("before"),
        norm(normalized("embedding")).alias("after"),
        (F.size("embedding") != 64).alias("wrong"),
    )


@query(
    "index_payload",
    """SELECT c.doc_id, c.chunk_id, c.parent_chunk_id, p.text AS parent_text, c.section_id, c.chunk_type, coalesce(c.table_caption, '') AS title,
              c.page_number, c.page_end, c.page_number - 1 AS page_idx, c.text, c.token_estimate AS token_count, length(c.text)::INT AS char_length,
              c.is_table, c.doc_id AS doc_title
       FROM children c JOIN parents p USING (doc_id, parent_chunk_id) WHERE NOT c.is_ignored""",
    lines=True,
)
def index_payload(spark, sf):
    c = line_chunks(spark, sf)
    p = ix.payload(ix.attach_parent_text(c.children, c.parents), "main")
    return p.select(
        "doc_id", "chunk_id", "parent_chunk_id", "parent_text", "section_id", "chunk_type", "title", "page_number", "page_end", "page_idx",
        "text", "token_count", "char_length", "is_table", "doc_title",
    )


@query(
    "index_report",
    "SELECT count(*) AS total_chunks, count(*) FILTER (WHERE NOT is_ignored) AS upserted_count, true AS success FROM children",
    lines=True,
)
def index_report(spark, sf):
    c = line_chunks(spark, sf)
    return ix.index_report(c.children, ix.index_points(c.children, c.parents, "main")).drop("dense_dim", "error")


@query(
    "upsert_last_wins",
    """WITH batch AS (SELECT user_id, event_type, value, event_id FROM events WHERE event_type <> 'view'
                      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1),
       old AS (SELECT user_id, event_type, value, event_id FROM events WHERE event_type = 'view'
               QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
       SELECT * FROM batch UNION ALL SELECT * FROM old WHERE user_id NOT IN (SELECT user_id FROM batch)""",
)
def upsert_last_wins(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "value", "event_id")
    views = e.where("event_type = 'view'")
    old = ix.last_writes(views, "user_id", F.col("event_id"))
    return ix.upsert(old, e.where("event_type <> 'view'"), "user_id", F.col("event_id"))


@query(
    "delete_by_doc",
    """SELECT doc_id, chunk_id FROM children WHERE doc_id NOT IN (SELECT 'd' || doc_id FROM labels WHERE toxic = 1)
       AND section_title <> 'Section 2'""",
    lines=True,
)
def delete_by_doc(spark, sf):
    c = line_chunks(spark, sf)
    toxic = table(spark, sf, "labels").where("toxic = 1").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"))
    names = toxic.union(spark.range(1).select(F.lit("Section 2")))
    rows = c.children.withColumns({"point_id": F.col("chunk_id"), "doc_title": F.lit("")})
    return ix.delete_documents(rows, names).select("doc_id", "chunk_id")


@query(
    "indexed_flags",
    """WITH n AS (SELECT url AS name FROM pages), k AS (SELECT DISTINCT CASE WHEN page_id < 5 THEN substr(url, 1, 9) ELSE substr(url, 1, length(url) - 1) END AS key
                  FROM pages WHERE contains(url, '/en/') OR contains(url, '/fr/'))
       SELECT DISTINCT name, EXISTS (FROM k WHERE key = name OR (length(key) >= 10 AND (starts_with(name, key) OR starts_with(key, name)))) AS is_embedded FROM n""",
)
def indexed_flags(spark, sf):
    p = table(spark, sf, "pages")
    known = p.where(F.contains("url", F.lit("/en/")) | F.contains("url", F.lit("/fr/"))).select(
        F.when(F.col("page_id") < 5, F.substring("url", 1, 9)).otherwise(F.expr("substring(url, 1, length(url) - 1)")).alias("name")
    )
    return mark_indexed(p.select(F.col("url").alias("name")).distinct(), known)


@query(
    "refined_once",
    "SELECT conv_id::VARCHAR AS doc_id, turn::VARCHAR AS chunk_id, trim(lower(text)) AS refined_text, length(text)::INT AS original_chars FROM conversations",
)
def refined_once(spark, sf):
    """The same through the store of answers, in two runs: one over the questions of users, one over all turns."""
    path = scratch_dir(spark, "answers")
    c = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("string").alias("chunk_id"), "text", "role")
    ask = lambda prompt, text: f"```text\n{text.lower()}\n```"
    refine_once(c.where("role = 'user'"), ask, path)
    return refine_once(c, ask, path).select("doc_id", "chunk_id", "refined_text", "original_chars")


@query("refined_texts", "SELECT conv_id::VARCHAR AS doc_id, turn::VARCHAR AS chunk_id, trim(lower(text)) AS refined_text, length(text)::INT AS original_chars FROM conversations")
def refined_texts(spark, sf):
    c = table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("string").alias("chunk_id"), "text"
    )
    out = refine(c, lambda prompt, text: f"```text\n{text.lower()}\n```")
    return out.select("doc_id", "chunk_id", "refined_text", "original_chars")


def _two_collections(spark, sf):
    """Chunks of all documents in collection a; those over 100 characters also in b, upserted afterwards."""
    c = line_chunks(spark, sf)
    a = ix.index_points(c.children, c.parents, "a")
    b = ix.index_points(c.children.where(F.length("text") > 100), c.parents, "b")
    return ix.upsert(a, b)


@query(
    "upsert_two_collections",
    """SELECT 'a' AS collection, doc_id, chunk_id FROM children WHERE NOT is_ignored
       UNION ALL SELECT 'b', doc_id, chunk_id FROM children WHERE NOT is_ignored AND length(text) > 100""",
    lines=True,
)
def upsert_two_collections(spark, sf):
    return _two_collections(spark, sf).select("collection", "doc_id", "chunk_id")


@query(
    "delete_in_collection",
    """SELECT 'a' AS collection, doc_id, chunk_id FROM children WHERE NOT is_ignored AND doc_id NOT IN (SELECT 'd' || doc_id FROM documents WHERE lang = 'fr')
       UNION ALL SELECT 'b', doc_id, chunk_id FROM children WHERE NOT is_ignored AND length(text) > 100""",
    lines=True,
)
def delete_in_collection(spark, sf):
    """French documents leave collection a only."""
    names = table(spark, sf, "documents").where("lang = 'fr'").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"))
    return ix.delete_documents(_two_collections(spark, sf), names, "a").select("collection", "doc_id", "chunk_id")


@query(
    "created_collection",
    "SELECT 'kept' AS collection, count(*) AS points FROM children WHERE NOT is_ignored",
    lines=True,
)
def created_collection(spark, sf):
    """Points written to one collection stay when another one is created beside it and read back empty."""
    base = f"{checkpoint_dir(spark)}/collections-{uuid.uuid4().hex}"
    c = line_chunks(spark, sf)
    ix.create_collection(spark, base, "kept")
    ix.index_points(c.children, c.parents, "kept").write.mode("append").partitionBy("collection").parquet(base)
    ix.create_collection(spark, base, "empty")
    ix.create_collection(spark, base, "empty", recreate=True)
    return ix.read_index(spark, base).groupBy("collection").agg(F.count("*").alias("points"))


@query(
    "index_job",
    """SELECT doc_id, 'main' AS collection, count(*) AS chunks_count, (SELECT count(*) FROM children) AS total_chunks,
              (SELECT count(*) FROM children WHERE NOT is_ignored) AS upserted_count, 3::INT AS dense_dim
       FROM children WHERE NOT is_ignored GROUP BY doc_id""",
    lines=True,
)
def index_job(spark, sf):
    """Manifest of one index job with a deterministic encoder, and its report on every row."""
    c = line_chunks(spark, sf)
    index = spark.createDataFrame([], ix.INDEX)
    job = ix.index_job(index, c.children, c.parents, "main", encode=lambda texts: [[float(len(t)), float(t.count("a")), 1.0] for t in texts])
    report = job.report.select("total_chunks", "upserted_count", "dense_dim")
    return job.manifest.drop("indexed_at").join(F.broadcast(report))  # the report is one row


JOB_VECTOR = "[length(text)::DOUBLE, length(text) - length(replace(text, 'a', '')), 1]"
UNIT = "list_transform({0}, lambda x: (x / sqrt(list_inner_product({0}, {0})))::FLOAT::DOUBLE)"


@query(
    "search_job",
    f""", a AS (SELECT chunk_id, text FROM children WHERE NOT is_ignored),
       tok AS (SELECT chunk_id, {TOKENS.format('text')} AS t FROM a),
       post AS (SELECT chunk_id, {HASH.format('t')} AS idx, max(round(1 + ln(c), 4)) AS val
                FROM (SELECT chunk_id, t, count(*) AS c FROM tok GROUP BY ALL) GROUP BY ALL),
       idf AS (SELECT idx, ln(1 + ((SELECT count(*) FROM a) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM post GROUP BY 1),
       qt AS (SELECT DISTINCT item_id, {HASH.format('t')} AS idx FROM (SELECT item_id, {TOKENS.format('text')} AS t FROM benchmark)),
       ss AS (SELECT item_id, chunk_id, round(sum(idf * val), 9) AS score FROM qt JOIN idf USING (idx) JOIN post USING (idx) GROUP BY ALL),
       v AS (SELECT chunk_id, {JOB_VECTOR} AS e FROM a), vu AS (SELECT chunk_id, {UNIT.format('e')} AS e FROM v),
       q AS (SELECT item_id, {JOB_VECTOR} AS e FROM benchmark), qu AS (SELECT item_id, {UNIT.format('e')} AS e FROM q),
       ds AS (SELECT item_id, chunk_id, round(list_inner_product(vu.e, qu.e) / sqrt(list_inner_product(vu.e, vu.e) * list_inner_product(qu.e, qu.e)), 9) AS score
              FROM qu, vu),
       r AS (SELECT item_id, chunk_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS rank FROM ss QUALIFY rank <= 20
             UNION ALL
             SELECT item_id, chunk_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS rank FROM ds QUALIFY rank <= 20),
       f AS (SELECT item_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM r GROUP BY ALL),
       t AS (SELECT item_id, chunk_id, score, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id))::INT AS rank FROM f QUALIFY rank <= 10)
       SELECT item_id AS query_id, chunk_id, c.doc_id, c.text, round(score, 6) AS score, rank FROM t JOIN children c USING (chunk_id)""",
    lines=True,
)
def search_job(spark, sf):
    """An index of two collections on disk, written by the index job; benchmark texts are searched in one of them."""
    path = scratch_dir(spark, "index")
    c = line_chunks(spark, sf)
    encode = lambda texts: [[float(len(t)), float(t.count("a")), 1.0] for t in texts]
    for name in ("main", "other"):
        ix.create_collection(spark, path, name)
    main = ix.index_job(ix.read_index(spark, path), c.children, c.parents, "main", encode=encode).points
    other = main.where(F.col("char_length") > 100).withColumn("collection", F.lit("other"))
    main.unionByName(other).write.mode("append").partitionBy("collection").parquet(path)
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    hits = search.search_texts(asked, ix.read_index(spark, path), encode, 3, collection="main")
    return hits.select("query_id", "chunk_id", "doc_id", "text", "score", "rank")


@query("stream_ingest", chunk_sql.chunks() + chunk_sql.INGESTED)
def stream_ingest(spark, sf):
    """All documents through the streaming ingest into a fresh index; chunks and tokens per document."""
    base = f"{checkpoint_dir(spark)}/ingest-{uuid.uuid4().hex}"
    docs = read_stream_of(spark, sf, "documents", "doc_id bigint, text string, lang string, source string, n_chars bigint")
    job = ingest(
        docs, lambda batch: blocks_from_text(batch, "doc_id", "text"), f"{base}/index", f"{base}/state", "main", buckets=8
    )
    job.awaitTermination()
    points_table = live_points(spark, f"{base}/index")
    return points_table.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"))


@query(
    "cleaned_everything",
    """, toxic AS (SELECT 'd' || doc_id AS doc_id FROM labels WHERE toxic = 1)
       SELECT 'children' AS of_table, doc_id, count(*) AS n FROM children WHERE doc_id NOT IN (FROM toxic) GROUP BY 2
       UNION ALL SELECT 'points', doc_id, count(*) FROM children WHERE NOT is_ignored AND section_title <> 'Section 2' AND doc_id NOT IN (FROM toxic) GROUP BY 2
       UNION ALL SELECT 'manifest', doc_id, count(*) FROM children WHERE NOT is_ignored AND doc_id NOT IN (FROM toxic) GROUP BY 2
       UNION ALL SELECT 'sections', doc_id, count(*) FROM sections WHERE doc_id NOT IN (FROM toxic) GROUP BY 2""",
    lines=True,
)
def cleaned_everything(spark, sf):
    """Toxic documents leave chunks, points and manifest, chunks of sections named Section 2 the points; read after compaction."""
    store = document_store(spark, scratch_dir(spark, "documents"))
    c = line_chunks(spark, sf)
    store_documents(store, c, ix.index_points(c.children, c.parents, "main"))
    toxic = table(spark, sf, "labels").where("toxic = 1").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"))
    clean_documents(store, toxic.union(spark.range(1).select(F.lit("Section 2"))))
    store.compact()
    store.vacuum()
    count = lambda name, n: store.read(name).groupBy("doc_id").agg(n.alias("n")).select(F.lit(name).alias("of_table"), "doc_id", "n")
    rows = F.count("*")
    return (
        count("children", rows).unionByName(count("points", rows)).unionByName(count("manifest", F.sum("chunks_count"))).unionByName(count("sections", rows))
    )


# German documents are newer in the last batch, French ones older in it, Spanish ones emptied.
VERSIONS = chunk_sql.chunks().replace("FROM documents)", "FROM (SELECT doc_id, CASE WHEN lang = 'de' THEN 'New.' || chr(10) || text ELSE text END AS text FROM documents WHERE lang <> 'es'))")


@query("stream_versions", VERSIONS + chunk_sql.INGESTED)
def stream_versions(spark, sf):
    """Three batches of documents with versions, the last one with late and emptied ones, through the append-only ingest."""
    base = scratch_dir(spark, "versions")
    schema = "doc_id bigint, text string, v bigint"
    docs = table(spark, sf, "documents")
    batches = [
        docs.where("lang IN ('fr', 'es')").select("doc_id", "text", F.lit(5).cast("bigint").alias("v")),
        docs.where("lang NOT IN ('fr', 'es')").select("doc_id", "text", F.lit(5).cast("bigint").alias("v")),
        docs.where("lang <> 'en'").select(
            "doc_id",
            F.when(F.col("lang") == "es", " ").when(F.col("lang") == "de", F.concat(F.lit("New.\n"), "text")).otherwise("late").alias("text"),
            F.when(F.col("lang") == "fr", 4).otherwise(6).cast("bigint").alias("v"),
        ),
    ]
    for batch in batches:
        batch.write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(schema).parquet(f"{base}/in")
        ingest_versions(
            stream, lambda rows: blocks_from_text(rows, "doc_id", "text"), f"{base}/points", f"{base}/state", "main", version=F.col("v"), buckets=8
        ).awaitTermination()
    found = point_versions(spark, f"{base}/points", 8).read("points")
    return found.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"))


def read_stream_of(spark, sf, name, schema):
    """Stream over one table of the sample folder, which is a file or a folder of files."""
    # Spark streams a single file only by a glob.
    return read_stream(spark, f"{os.fspath(sf)}/{name}.parque[t]", schema)
