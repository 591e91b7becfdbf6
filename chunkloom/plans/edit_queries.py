"""Registered queries of the batch edits, over the chunk tables of ``tables``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import breadcrumb_string
from ..operators import edits, export
from ..operators.chunking import Chunked
from ..operators.tree import rebuild
from ..session import scratch_dir
from .tables import TOKENS, line_children, line_chunks, table, with_lines

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_lines(sql)
        return fn

    return add


SMALL = "token_estimate < 20"


@query(
    "updated_chunks",
    f""", c AS (SELECT doc_id, chunk_id, parent_chunk_id, child_pos, CASE WHEN token_estimate < 20 THEN reverse(text) || ' (edited)' ELSE text END AS text,
                  is_edited OR token_estimate < 20 AS is_edited FROM children)
       SELECT doc_id, chunk_id, text, {TOKENS.format('text')} AS token_estimate, is_edited FROM c""",
)
def updated_chunks(spark, sf):
    c = line_chunks(spark, sf)
    e = c.children.where(SMALL).select("doc_id", "chunk_id", F.concat(F.reverse("text"), F.lit(" (edited)")).alias("text"))
    return edits.update_chunks(c, e).children.select("doc_id", "chunk_id", "text", "token_estimate", "is_edited")


@query(
    "moved_chunks",
    f""", first AS (SELECT doc_id, min(parent_chunk_id) AS target FROM parents GROUP BY 1),
       m AS (SELECT doc_id, chunk_id, CASE WHEN token_estimate < 20 THEN target ELSE parent_chunk_id END AS parent_chunk_id, text,
               token_estimate < 20 AND target <> parent_chunk_id AS moved, child_pos, page_number, page_end, token_estimate < 20 AS hit, parent_chunk_id AS was
             FROM children JOIN first USING (doc_id)),
       aff AS (SELECT doc_id, parent_chunk_id FROM m WHERE hit UNION SELECT doc_id, was FROM m WHERE hit),
       t AS (SELECT doc_id, parent_chunk_id, string_agg(text, chr(10) || chr(10) ORDER BY moved, child_pos) AS text FROM m GROUP BY ALL)
       SELECT p.doc_id, p.parent_chunk_id, CASE WHEN aff.doc_id IS NULL THEN p.text ELSE t.text END AS text, aff.doc_id IS NOT NULL AS is_edited
       FROM parents p JOIN t USING (doc_id, parent_chunk_id) LEFT JOIN aff ON aff.doc_id = p.doc_id AND aff.parent_chunk_id = p.parent_chunk_id""",
)
def moved_chunks(spark, sf):
    """Small chunks go to the end of the first parent of their document."""
    c = line_chunks(spark, sf)
    first = c.parents.groupBy("doc_id").agg(F.min("parent_chunk_id").alias("target"))
    e = c.children.where(SMALL).join(first, "doc_id").select("doc_id", "chunk_id", F.col("target").alias("parent_chunk_id"))
    return edits.update_chunks(c, e).parents.select("doc_id", "parent_chunk_id", "text", "is_edited")


@query("toggled_chunks", "SELECT doc_id, chunk_id, CASE WHEN token_estimate < 20 THEN NOT is_ignored ELSE is_ignored END AS is_ignored FROM children")
def toggled_chunks(spark, sf):
    c = line_children(spark, sf)
    return edits.toggle_ignored(c, c.where(SMALL).select("doc_id", "chunk_id")).select("doc_id", "chunk_id", "is_ignored")


@query("ignored_empty_chunks", "SELECT doc_id, chunk_id, is_ignored OR is_table AS is_ignored FROM children")
def ignored_empty_chunks(spark, sf):
    c = line_children(spark, sf).withColumn("text", F.when(~F.col("is_table"), F.col("text")).otherwise(" "))
    return edits.ignore_empty(c).select("doc_id", "chunk_id", "is_ignored")


@query(
    "bulk_metadata",
    "SELECT doc_id, chunk_id, true AS changed, 'src1' AS source, 'yes' AS reviewed FROM children",
)
def bulk_metadata(spark, sf):
    out = edits.bulk_metadata(line_children(spark, sf), {" reviewed ": "yes", "source": "src1", "page": "99"})
    return out.select(
        "doc_id", "chunk_id", "changed", F.element_at("metadata", "source").alias("source"), F.element_at("metadata", "reviewed").alias("reviewed")
    )


@query(
    "bulk_metadata_kept",
    "SELECT doc_id, chunk_id, lang <> 'en' AS changed, CASE WHEN lang = 'en' THEN 'yes' ELSE 'no' END AS lang_en FROM children",
)
def bulk_metadata_kept(spark, sf):
    out = edits.bulk_metadata(line_children(spark, sf), {"lang_en": "no"}, overwrite=False)
    return out.select("doc_id", "chunk_id", "changed", F.element_at("metadata", "lang_en").alias("lang_en"))


@query("bulk_metadata_deleted", "SELECT doc_id, chunk_id, lang = 'fr' AS changed, CASE WHEN lang <> 'fr' THEN 2 ELSE 1 END AS n FROM children")
def bulk_metadata_deleted(spark, sf):
    out = edits.bulk_metadata(line_children(spark, sf), delete_key="lang_fr")
    keys = F.size(F.map_filter("metadata", lambda k, v: (k == "source") | k.startswith("lang_")))
    return out.select("doc_id", "chunk_id", "changed", keys.alias("n"))


@query(
    "renamed_sections",
    """SELECT c.doc_id, c.chunk_id, array_to_string(list_transform(p.ranks, lambda r: CASE WHEN r = 0 THEN c.doc_id WHEN r <= 2 THEN 'Renamed ' || r
              ELSE 'Section ' || r END), ' > ') AS breadcrumbs FROM children c JOIN paths p USING (doc_id, section_id)""",
)
def renamed_sections(spark, sf):
    c = _rebuilt(line_chunks(spark, sf))
    e = c.sections.where(F.col("section_pos").isin(1, 2)).select("doc_id", "section_id", F.concat(F.lit("Renamed "), "section_pos").alias("title"))
    return edits.rename_sections(c, e).children.select("doc_id", "chunk_id", breadcrumb_string("breadcrumbs").alias("breadcrumbs"))


def _rebuilt(c):
    """The chunk tables with breadcrumbs that follow the section tree."""
    sections = rebuild(c.sections)
    crumbs = sections.select("doc_id", "section_id", F.col("breadcrumbs").alias("b"))
    with_crumbs = lambda t: t.drop("breadcrumbs").join(crumbs, ["doc_id", "section_id"]).withColumnRenamed("b", "breadcrumbs").select(*t.columns)
    return type(c)(sections, with_crumbs(c.parents), with_crumbs(c.children))


@query(
    "deleted_sections",
    """SELECT doc_id, chunk_id, CASE WHEN section_no = 2 THEN printf('%s_s%02d', doc_id, 1) ELSE section_id END AS section_id,
              is_edited OR section_no = 2 AS is_edited FROM children WHERE section_no <> 3""",
)
def deleted_sections(spark, sf):
    """Section 2 is dissolved into its parent, section 3 is deleted with its chunks."""
    c = line_chunks(spark, sf)
    e = c.sections.where(F.col("section_pos").isin(2, 3)).select("doc_id", "section_id", (F.col("section_pos") == 3).alias("delete_chunks"))
    return edits.delete_sections(c, e).children.select("doc_id", "chunk_id", "section_id", "is_edited")


@query(
    "sections_without_empty",
    """SELECT s.doc_id, s.section_id FROM sections s
       WHERE EXISTS (FROM children c WHERE c.doc_id = s.doc_id AND c.section_id = s.section_id AND NOT is_table)
       OR EXISTS (FROM sections b WHERE b.doc_id = s.doc_id AND b.parent_section_id = s.section_id)""",
)
def sections_without_empty(spark, sf):
    c = line_chunks(spark, sf)
    text = c.children.where(~F.col("is_table"))
    parents = c.parents.join(text.select("doc_id", "parent_chunk_id"), ["doc_id", "parent_chunk_id"], "left_semi")
    return edits.drop_empty_sections(type(c)(c.sections, parents, text)).sections.select("doc_id", "section_id")


@query(
    "split_chunks",
    """, s AS (SELECT *, token_estimate > 200 AS hit FROM children),
       nx AS (SELECT doc_id, max(child_pos) AS mx FROM children GROUP BY 1),
       parts AS (
         SELECT doc_id, child_pos, 0 AS i, chunk_id, CASE WHEN hit THEN trim(substr(text, 1, 100)) ELSE text END AS text FROM s
         UNION ALL
         SELECT doc_id, child_pos, 1, printf('%s_c%04d', doc_id, mx + row_number() OVER (PARTITION BY doc_id ORDER BY child_pos)), trim(substr(text, 101))
         FROM s JOIN nx USING (doc_id) WHERE hit)
       SELECT doc_id, chunk_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY child_pos, i) AS child_pos FROM parts""",
)
def split_chunks(spark, sf):
    c = line_chunks(spark, sf)
    e = c.children.where(F.col("token_estimate") > 200).select(
        "doc_id", "chunk_id", F.trim(F.substring("text", 1, 100)).alias("text1"), F.trim(F.expr("substring(text, 101)")).alias("text2")
    )
    return edits.split_chunks(c, e).children.select("doc_id", "chunk_id", "text", "child_pos")


@query(
    "split_parents",
    f""", s AS (SELECT *, token_estimate > 200 AS hit FROM children),
       t AS (SELECT doc_id, parent_chunk_id, bool_or(hit) AS hit, string_agg(CASE WHEN hit THEN trim(substr(text, 1, 100)) || chr(10) || chr(10) || trim(substr(text, 101))
               ELSE text END, chr(10) || chr(10) ORDER BY child_pos) AS text FROM s GROUP BY ALL)
       SELECT doc_id, parent_chunk_id, text, {TOKENS.format('text')} AS token_estimate, hit AS is_edited FROM t""",
)
def split_parents(spark, sf):
    c = line_chunks(spark, sf)
    e = c.children.where(F.col("token_estimate") > 200).select(
        "doc_id", "chunk_id", F.trim(F.substring("text", 1, 100)).alias("text1"), F.trim(F.expr("substring(text, 101)")).alias("text2")
    )
    return edits.split_chunks(c, e).parents.select("doc_id", "parent_chunk_id", "text", "token_estimate", "is_edited")


@query(
    "merge_chunks",
    f""", g AS (SELECT *, count(*) OVER (PARTITION BY doc_id, parent_chunk_id) AS n, row_number() OVER (PARTITION BY doc_id, parent_chunk_id ORDER BY child_pos) AS r
             FROM children),
       m AS (SELECT doc_id, min(chunk_id) FILTER (WHERE r = 1) AS chunk_id, string_agg(trim(text), chr(10) || chr(10) ORDER BY child_pos) AS text, min(page_number) AS page_number,
                    max(page_end) AS page_end, min(child_pos) AS p FROM g WHERE n >= 2 GROUP BY doc_id, parent_chunk_id
             UNION ALL SELECT doc_id, chunk_id, text, page_number, page_end, child_pos FROM g WHERE n < 2)
       SELECT doc_id, chunk_id, text, {TOKENS.format('text')} AS token_estimate, page_number, page_end,
              row_number() OVER (PARTITION BY doc_id ORDER BY p) AS child_pos FROM m""",
)
def merge_chunks(spark, sf):
    """The children of each parent become one."""
    c = line_chunks(spark, sf)
    e = c.children.select("doc_id", F.col("parent_chunk_id").alias("merge_id"), "chunk_id")
    return edits.merge_chunks(c, e).children.select("doc_id", "chunk_id", "text", "token_estimate", "page_number", "page_end", "child_pos")


@query(
    "deleted_chunks",
    f""", k AS (SELECT * FROM children WHERE NOT is_table),
       t AS (SELECT doc_id, parent_chunk_id, string_agg(text, chr(10) || chr(10) ORDER BY child_pos) AS text, min(page_number) AS page_start, max(page_end) AS page_end
             FROM k GROUP BY ALL)
       SELECT doc_id, parent_chunk_id, text, {TOKENS.format('text')} AS token_estimate, page_start, page_end FROM t""",
)
def deleted_chunks(spark, sf):
    c = line_chunks(spark, sf)
    e = c.children.where("is_table").select("doc_id", "chunk_id")
    return edits.delete_chunks(c, e).parents.select("doc_id", "parent_chunk_id", "text", "token_estimate", "page_start", "page_end")


@query(
    "updated_parents",
    """SELECT c.doc_id, c.chunk_id, CASE WHEN p.token_estimate > 400 THEN printf('%s_s00', c.doc_id) ELSE c.section_id END AS section_id,
              CASE WHEN p.token_estimate > 400 THEN c.doc_id || ' > Big ' || p.parent_pos ELSE c.doc_id || ' > ' || c.section_title END AS breadcrumbs
       FROM children c JOIN parents p USING (doc_id, parent_chunk_id)""",
)
def updated_parents(spark, sf):
    """Large parents get a new title and move to the root section."""
    c = line_chunks(spark, sf)
    e = c.parents.where(F.col("token_estimate") > 400).select(
        "doc_id", "parent_chunk_id", F.concat(F.lit("Big "), "parent_pos").alias("title"), F.concat("doc_id", F.lit("_s00")).alias("section_id")
    )
    return edits.update_parents(c, e).children.select("doc_id", "chunk_id", "section_id", breadcrumb_string("breadcrumbs").alias("breadcrumbs"))


@query(
    "deleted_parents",
    "SELECT c.doc_id, c.chunk_id FROM children c JOIN parents p USING (doc_id, parent_chunk_id) WHERE p.token_estimate <= 400",
)
def deleted_parents(spark, sf):
    c = line_chunks(spark, sf)
    return edits.delete_parents(c, c.parents.where(F.col("token_estimate") > 400)).children.select("doc_id", "chunk_id")


@query(
    "added_children",
    """, mx AS (SELECT doc_id, max(child_pos) AS m FROM children GROUP BY 1), fp AS (SELECT doc_id, parent_chunk_id, max(child_pos) AS last FROM children GROUP BY ALL),
       merged AS (SELECT doc_id, chunk_id, text, child_pos AS a, 0 AS s, parent_chunk_id FROM children UNION ALL
         SELECT p.doc_id, printf('%s_c%04d', p.doc_id, m + row_number() OVER (PARTITION BY p.doc_id ORDER BY p.parent_pos)), 'Summary of ' || p.title, last, p.parent_pos, p.parent_chunk_id
         FROM parents p JOIN mx USING (doc_id) JOIN fp USING (doc_id, parent_chunk_id))
       SELECT doc_id, chunk_id, parent_chunk_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY a, s) AS child_pos FROM merged""",
)
def added_children(spark, sf):
    """A summary child at the end of every parent."""
    c = line_chunks(spark, sf)
    none = F.lit(None).cast("string")
    new = c.parents.select(
        "doc_id", F.col("parent_pos").alias("seq"), "parent_chunk_id", F.concat(F.lit("Summary of "), "title").alias("text"),
        F.lit(None).cast("int").alias("page_number"), none.alias("after"), none.alias("place"),
    )
    return edits.add_children(c, new).children.select("doc_id", "chunk_id", "parent_chunk_id", "text", "child_pos")


@query(
    "added_parents",
    """, mx AS (SELECT doc_id, max(parent_pos) AS m FROM parents GROUP BY 1),
       merged AS (SELECT doc_id, parent_chunk_id, title, section_id, parent_pos AS a FROM parents UNION ALL
         SELECT s.doc_id, printf('%s_p%04d', s.doc_id, m + row_number() OVER (PARTITION BY s.doc_id ORDER BY s.section_pos)), 'Notes on ' || s.title, s.section_id, m + 1000 + s.section_pos
         FROM sections s JOIN mx USING (doc_id) WHERE s.section_pos > 0)
       SELECT doc_id, parent_chunk_id, title, section_id, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS parent_pos FROM merged""",
)
def added_parents(spark, sf):
    """A notes parent for every section of the documents that have chunks."""
    c = line_chunks(spark, sf)
    none = F.lit(None).cast("string")
    new = c.sections.where("section_pos > 0").join(c.parents.select("doc_id").distinct(), "doc_id", "left_semi").select(
        "doc_id", F.col("section_pos").alias("seq"), "section_id", F.concat(F.lit("Notes on "), "title").alias("title"), F.lit("To do.").alias("text"),
        F.lit(None).cast("int").alias("page_number"), none.alias("after"), F.lit("end").alias("place"),
    )
    return edits.add_parents(c, new).parents.select("doc_id", "parent_chunk_id", "title", "section_id", "parent_pos")


@query(
    "added_sections",
    """, mx AS (SELECT doc_id, max(section_pos) AS m FROM sections GROUP BY 1)
       SELECT doc_id, section_id, section_pos, title, array_to_string(crumbs, ' > ') AS breadcrumbs FROM paths UNION ALL
       SELECT doc_id, printf('%s_s%02d', doc_id, m + 1), m + 1, 'Appendix', doc_id || ' > Appendix' FROM mx""",
)
def added_sections(spark, sf):
    c = line_chunks(spark, sf)
    none = F.lit(None).cast("string")
    new = c.sections.where("section_pos = 0").select(
        "doc_id", F.lit(1).cast("bigint").alias("seq"), F.lit("Appendix").alias("title"), F.col("section_id").alias("parent_section_id"), none.alias("after"), F.lit("end").alias("place")
    )
    # Positions start at 0 for the root; new ones are dense from 1.
    s = edits.add_sections(c, new).sections
    return s.select("doc_id", "section_id", (F.col("section_pos") - 1).alias("section_pos"), "title", breadcrumb_string("breadcrumbs").alias("breadcrumbs"))


@query(
    "reordered_parents",
    """SELECT doc_id, parent_chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN token_estimate > 400 THEN 0 ELSE 1 END, parent_pos) AS parent_pos
       FROM parents""",
)
def reordered_parents(spark, sf):
    """Large parents first."""
    c = line_chunks(spark, sf)
    e = c.parents.where(F.col("token_estimate") > 400).select("doc_id", "parent_chunk_id", F.lit(0).alias("ordinal"))
    return edits.reorder_parents(c, e).parents.select("doc_id", "parent_chunk_id", "parent_pos")


@query(
    "reordered_sections",
    """SELECT doc_id, section_id, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN section_pos = 1 THEN 2 ELSE section_pos END, section_pos = 1) AS section_pos
       FROM sections""",
)
def reordered_sections(spark, sf):
    """Section 1 goes behind section 2."""
    c = line_chunks(spark, sf)
    e = c.sections.where("section_pos = 1").select("doc_id", "section_id", F.lit(2).alias("ordinal"))
    return edits.reorder_sections(c, e).sections.select("doc_id", "section_id", "section_pos")


@query(
    "reparented_sections",
    """SELECT doc_id, section_id, CASE WHEN section_pos > 3 AND depth > 0 THEN printf('%s_s02', doc_id) ELSE parent_section_id END AS parent_section_id FROM paths""",
)
def reparented_sections(spark, sf):
    """Sections from 4 on go under section 2; moving section 1 or 2 below itself is refused."""
    c = line_chunks(spark, sf)
    e = c.sections.where("section_pos > 3 OR section_pos IN (0, 1, 2)").select("doc_id", "section_id", F.concat("doc_id", F.lit("_s02")).alias("new_parent_id"))
    return edits.reparent_sections(c, e).sections.select("doc_id", "section_id", "parent_section_id")


@query(
    "indented_sections",
    """SELECT * FROM (SELECT doc_id, section_id, lag(section_id) OVER (PARTITION BY doc_id, parent_section_id ORDER BY section_pos) AS new_parent_id
       FROM sections WHERE section_pos > 0) WHERE new_parent_id IS NOT NULL""",
)
def indented_sections(spark, sf):
    return edits.indent_targets(line_chunks(spark, sf).sections)


@query(
    "outdented_sections",
    """SELECT s.doc_id, s.section_id, u.parent_section_id AS new_parent_id FROM sections s JOIN sections u
       ON u.doc_id = s.doc_id AND u.section_id = s.parent_section_id WHERE s.section_pos > 0 AND u.section_pos > 0""",
)
def outdented_sections(spark, sf):
    return edits.outdent_targets(line_chunks(spark, sf).sections)


@query(
    "copied_metadata",
    """, f AS (SELECT doc_id, min(child_pos) AS fp FROM children GROUP BY 1)
       SELECT c.doc_id, c.chunk_id, CASE WHEN c.child_pos > fp THEN s.source ELSE c.source END AS source, c.page_number::VARCHAR AS page
       FROM children c JOIN f USING (doc_id) JOIN children s ON s.doc_id = c.doc_id AND s.child_pos = f.fp""",
)
def copied_metadata(spark, sf):
    """Every chunk takes the custom metadata of the first chunk of its document."""
    c = line_children(spark, sf)
    first = c.groupBy("doc_id").agg(F.min_by("chunk_id", "child_pos").alias("source_id"))
    e = c.join(first, "doc_id").where(F.col("chunk_id") != F.col("source_id")).select("doc_id", "chunk_id", "source_id")
    out = edits.copy_metadata(c, e)
    return out.select("doc_id", "chunk_id", F.element_at("metadata", "source").alias("source"), F.element_at("metadata", "page").alias("page"))


def _language(spark, sf, lang):
    """Chunk tables of the documents in one language."""
    docs = table(spark, sf, "documents").where(F.col("lang") == lang).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"))
    c = line_chunks(spark, sf)
    return Chunked(*(t.join(docs, "doc_id", "left_semi") for t in (c.sections, c.parents, c.children))), docs


def _saved(spark, sf):
    """Edits of French, German and Spanish documents saved one after the other, the German ones without children in the end."""
    path = f"{scratch_dir(spark, 'edits')}"
    note = lambda c, text: Chunked(c.sections, c.parents, c.children.withColumn("text", F.concat(F.lit(text), "text")))
    french, _ = _language(spark, sf, "fr")
    german, _ = _language(spark, sf, "de")
    spanish, docs = _language(spark, sf, "es")
    export.save_edited(note(french, "first: "), path)
    export.save_edited(note(german, "lost: "), path)
    export.save_edited(Chunked(german.sections, german.parents, german.children.where("false")), path)
    export.save_edited(note(french, "second: "), path)
    nothing = (t.where("false") for t in (spanish.sections, spanish.parents, spanish.children))
    export.save_edited(Chunked(*nothing), path, docs)
    return path


@query(
    "saved_edits",
    "SELECT doc_id, chunk_id, CASE WHEN lang = 'fr' THEN 'second: ' || text ELSE text END AS text FROM children WHERE lang NOT IN ('de', 'es')",
)
def saved_edits(spark, sf):
    path = _saved(spark, sf)
    return export.with_saved(line_chunks(spark, sf), path).children.select("doc_id", "chunk_id", "text")


@query(
    "reset_documents",
    "SELECT doc_id, chunk_id, text, NULL::VARCHAR AS saved FROM children WHERE lang <> 'es'",
)
def reset_documents(spark, sf):
    """French and German documents are reset; of the saved edits nothing but the emptied Spanish documents is left."""
    path = _saved(spark, sf)
    _, french = _language(spark, sf, "fr")
    _, german = _language(spark, sf, "de")
    export.reset_saved(spark, path, french.union(german))
    saved = export.load_edited(spark, path).children.select("doc_id", "chunk_id", F.col("text").alias("saved"))
    rows = export.with_saved(line_chunks(spark, sf), path).children.select("doc_id", "chunk_id", "text")
    return rows.join(saved, ["doc_id", "chunk_id"], "left")
