"""Batch edits: a table of edits is applied to all documents at once.

Every operator takes the three chunk tables and a table of edits and returns new tables. Two edits of one
entity in one batch are rejected. Parents that lose or gain text are recomputed, parents left without
children disappear.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.meta import clean_key, custom_metadata, merge_metadata, no_metadata, overlay, page_start, sync_pages
from ..functions.text import non_empty, split_midpoint, strip, token_estimate
from ..session import cut_lineage
from .chunking import Chunked
from .scan import latest, latest_value, number_rows, position_ranges, ranges_of, running
from .stats import empty_sections, is_empty_chunk, next_numbers
from .tree import ancestors, follow_parents, rebuild, sync_order

CHILD = ["doc_id", "chunk_id"]
PARENT = ["doc_id", "parent_chunk_id"]
SECTION = ["doc_id", "section_id"]
EDIT_MARKS = ("is_merged", "merged_from", "merged_count", "is_split", "split_from", "split_part")


def reject_repeats(edits: DataFrame, keys: Sequence[str]) -> None:
    repeated = edits.groupBy(*keys).count().where("count > 1")
    if not repeated.isEmpty():
        raise ValueError(f"several edits of one entity ({', '.join(keys)}) in a batch")


def renumber(rows: DataFrame, anchor: Column, sub: Column, position: str) -> DataFrame:
    """Dense new positions in the order (anchor, sub); rows put after an anchor have a positive ``sub``."""
    keyed = rows.withColumns({"__a": anchor.cast("bigint"), "__s": sub.cast("bigint")}).drop(position)
    ranges = [[F.col("__a"), ranges_of("__s")[0]], [ranges_of("__a")[0]]]
    return number_rows(keyed, ["doc_id"], ["__a", "__s"], position, ranges).drop("__a", "__s").select(*rows.columns)


def recompute_parents(parents: DataFrame, children: DataFrame, affected: DataFrame) -> DataFrame:
    """Text, tokens and pages of the affected parents from their children; parents without children are dropped."""
    hit = affected.select(*PARENT).distinct()
    fresh = (
        children.join(hit, PARENT, "left_semi")
        .groupBy(*PARENT)
        .agg(
            F.array_sort(F.collect_list(F.struct("child_pos", F.coalesce("text", F.lit("")).alias("text")))).alias("__c"),
            F.min(page_start("page_number")).alias("__lo"),
            F.max(F.coalesce("page_end", page_start("page_number"))).alias("__hi"),
        )
        .withColumn("__text", F.array_join(F.transform("__c", lambda c: c["text"]), "\n\n"))
        .drop("__c")
    )
    # The parents are read once, for those that change and the others.
    marked = parents.join(hit.join(fresh, PARENT, "left").withColumn("__hit", F.lit(True)), PARENT, "left")
    changed = F.col("__hit").isNotNull()
    values = {
        "text": F.col("__text"),
        "token_estimate": token_estimate("__text"),
        "page_start": F.col("__lo"),
        "page_end": F.col("__hi"),
        "is_edited": F.lit(True),
    }
    kept = marked.where(~changed | F.col("__text").isNotNull())
    return kept.withColumns({c: F.when(changed, v).otherwise(F.col(c)) for c, v in values.items()}).select(*parents.columns)


def _updated(rows: DataFrame, edits: DataFrame, keys: list[str], allowed: Sequence[str]) -> DataFrame:
    """Rows with the non-null fields of their edits; edited rows are marked, old values stay as ``__old_*``."""
    fields = [c for c in edits.columns if c not in keys]
    unknown = set(fields) - set(allowed)
    if unknown:
        raise ValueError(f"fields that cannot be edited: {sorted(unknown)}")
    e = edits.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in fields], F.lit(True).alias("__hit"))
    joined = rows.join(e, keys, "left")
    old = {f"__old_{c}": F.col(c) for c in fields}
    return joined.withColumns(old).withColumns({c: F.coalesce(f"__new_{c}", c) for c in fields})


def update_chunks(chunked: Chunked, edits: DataFrame) -> Chunked:
    """New field values for chunks (doc_id, chunk_id and any child columns).

    A new text is estimated again unless the edit brings an estimate. A chunk that changes parent goes to
    the end of the new one.
    """
    reject_repeats(edits, CHILD)
    children = chunked.children
    c = _updated(children, edits, CHILD, children.columns)
    hit = F.col("__hit").isNotNull()
    if "text" in edits.columns:
        given = F.col("__new_token_estimate") if "token_estimate" in edits.columns else F.lit(None).cast("int")
        new_text = F.col("__new_text").isNotNull()
        c = c.withColumn("token_estimate", F.when(new_text, F.coalesce(given, token_estimate("text"))).otherwise(F.col("token_estimate")))
    c = c.withColumns(
        {
            "is_edited": hit | F.col("is_edited"),
            "metadata": F.when(hit, sync_pages("metadata", "page_number", "page_end")).otherwise(F.col("metadata")),
        }
    )
    affected = c.where(hit).select(*PARENT)
    if "parent_chunk_id" in edits.columns:
        moved = hit & ~F.col("parent_chunk_id").eqNullSafe(F.col("__old_parent_chunk_id"))
        affected = affected.unionByName(c.where(hit).select("doc_id", F.col("__old_parent_chunk_id").alias("parent_chunk_id")))
        ends = children.groupBy(*PARENT).agg(F.max("child_pos").alias("__end"))
        c = c.withColumn("__moved", moved).join(ends, PARENT, "left")
        anchor = F.when(F.col("__moved"), F.coalesce("__end", "child_pos")).otherwise(F.col("child_pos"))
        c = renumber(c, anchor, F.when(F.col("__moved"), F.col("child_pos") + 1).otherwise(0), "child_pos")
    new_children = c.select(*children.columns)
    return replace(chunked, children=new_children, parents=recompute_parents(chunked.parents, new_children, affected))


def toggle_ignored(children: DataFrame, edits: DataFrame) -> DataFrame:
    """Flip ``is_ignored`` of the listed chunks."""
    reject_repeats(edits, CHILD)
    e = edits.select(*CHILD, F.lit(True).alias("__hit"))
    c = children.join(e, CHILD, "left")
    hit, old = F.col("__hit").isNotNull(), F.coalesce("is_ignored", F.lit(False))
    return c.withColumns({"is_ignored": F.when(hit, ~old).otherwise(old), "is_edited": hit | F.col("is_edited")}).select(
        *children.columns
    )


def ignore_empty(children: DataFrame) -> DataFrame:
    """Ignore every chunk without text and table."""
    target = is_empty_chunk() & ~F.coalesce("is_ignored", F.lit(False))
    return children.withColumns(
        {"is_edited": target | F.col("is_edited"), "is_ignored": target | F.coalesce("is_ignored", F.lit(False))}
    )


def bulk_metadata(
    children: DataFrame,
    set_tags: dict[str, str] | None = None,
    delete_key: str | None = None,
    section_id: str | None = None,
    overwrite: bool = True,
) -> DataFrame:
    """Set tags or delete one key over all chunks or one section; adds ``changed``. Reserved keys are refused.

    Without ``overwrite`` a key that a chunk already has keeps its value.
    """
    meta = F.coalesce("metadata", no_metadata())
    new = meta
    if delete_key is not None and (key := clean_key(delete_key)):
        new = F.map_filter(meta, lambda k, v: k != key)
    tags = {k: v for raw, v in (set_tags or {}).items() if (k := clean_key(raw))}
    if tags:
        given = F.create_map(*[F.lit(x) for kv in tags.items() for x in kv])
        new = overlay(meta, given) if overwrite else overlay(given, meta)
    scope = (F.coalesce(non_empty("section_id"), "parent_chunk_id") == section_id) if section_id else F.lit(True)
    same = F.to_json(F.array_sort(F.map_entries(meta))) == F.to_json(F.array_sort(F.map_entries(new)))
    changed = F.coalesce(scope & ~same, F.lit(False))
    out = children.withColumns({"__new": new, "changed": changed})
    return out.withColumns(
        {
            "metadata": F.when(F.col("changed"), sync_pages("__new", "page_number", "page_end")).otherwise(F.col("metadata")),
            "is_edited": F.col("changed") | F.col("is_edited"),
        }
    ).drop("__new")


def _carry_breadcrumbs(rows: DataFrame, old: DataFrame, new: DataFrame, mark: bool = False) -> DataFrame:
    """Rows with the part of their breadcrumbs that names their section replaced by the section's new one."""
    o = old.select(*SECTION, F.col("breadcrumbs").alias("__ob"))
    n = new.select(*SECTION, F.col("breadcrumbs").alias("__nb"))
    both = n.join(o, SECTION, "left").where(~F.col("__ob").eqNullSafe(F.col("__nb")))
    joined = rows.join(both, SECTION, "left")
    own = F.coalesce("breadcrumbs", F.array().cast("array<string>"))
    size = F.size(F.coalesce("__ob", F.array().cast("array<string>")))
    belongs = F.slice(own, 1, size) == F.col("__ob")
    tail = F.when(belongs, F.slice(own, size + 1, F.size(own))).otherwise(F.array().cast("array<string>"))
    hit = F.col("__nb").isNotNull()
    out = joined.withColumn("breadcrumbs", F.when(hit, F.concat("__nb", tail)).otherwise(F.col("breadcrumbs")))
    if mark:
        out = out.withColumn("is_edited", hit | F.col("is_edited"))
    return out.select(*rows.columns)


def _with_sections(chunked: Chunked, sections: DataFrame) -> Chunked:
    """The tables with new sections: levels and breadcrumbs are rebuilt and carried to chunks and parents."""
    new = rebuild(sections).select(*chunked.sections.columns)
    return Chunked(
        new,
        _carry_breadcrumbs(chunked.parents, chunked.sections, new),
        _carry_breadcrumbs(chunked.children, chunked.sections, new),
    )


def rename_sections(chunked: Chunked, edits: DataFrame) -> Chunked:
    """New titles (doc_id, section_id, title); sections are found by id, so equal titles stay apart."""
    reject_repeats(edits, SECTION)
    renamed = _updated(chunked.sections, edits, SECTION, ["title"]).select(*chunked.sections.columns)
    return _with_sections(chunked, renamed)


def delete_sections(chunked: Chunked, edits: DataFrame) -> Chunked:
    """Delete sections (doc_id, section_id, delete_chunks), with their chunks or moving these to the parent section.

    Sub-sections move up. Where the parent section is unknown the first other section takes the chunks.
    """
    reject_repeats(edits, SECTION)
    e = edits.select(*SECTION, F.coalesce("delete_chunks", F.lit(False)).alias("__drop"))
    s = chunked.sections
    doomed = s.join(e, SECTION)
    kept = s.join(e.select(*SECTION), SECTION, "left_anti")
    # Nearest ancestor that stays, else the first section that stays.
    closed = ancestors(s).join(e, SECTION)
    chain = F.concat(F.transform("path", lambda x: x["id"]), F.array("root_id"))
    steps = closed.select(*SECTION, F.posexplode(chain).alias("__i", "__up"))
    stay = kept.select("doc_id", F.col("section_id").alias("__up"))
    nearest = steps.join(stay, ["doc_id", "__up"]).groupBy(*SECTION).agg(F.min(F.struct("__i", "__up"))["__up"].alias("__to"))
    first = kept.groupBy("doc_id").agg(F.min(F.struct("section_pos", "section_id"))["section_id"].alias("__first"))
    target = (
        doomed.select(*SECTION, "__drop")
        .join(nearest, SECTION, "left")
        .join(first, "doc_id", "left")
        .select(*SECTION, "__drop", F.coalesce("__to", "__first").alias("__to"))
    )
    up = target.select("doc_id", F.col("section_id").alias("parent_section_id"), F.col("__to"))
    kept = kept.join(up, ["doc_id", "parent_section_id"], "left")
    kept = kept.withColumn("parent_section_id", F.coalesce("__to", "parent_section_id")).select(*s.columns)

    def moved(rows: DataFrame) -> DataFrame:
        r = rows.join(target, SECTION, "left").where(~F.coalesce("__drop", F.lit(False)))
        hit = F.col("__to").isNotNull()
        return r.withColumns(
            {"section_id": F.coalesce("__to", "section_id"), "is_edited": hit | F.col("is_edited"), "__moved": hit}
        )

    new = rebuild(kept).select(*s.columns)
    crumbs = new.select(*SECTION, F.col("breadcrumbs").alias("__nb"))

    def finish(rows: DataFrame, columns: list[str]) -> DataFrame:
        r = moved(rows).join(crumbs, SECTION, "left")
        return r.withColumn("breadcrumbs", F.when(F.col("__moved"), F.col("__nb")).otherwise(F.col("breadcrumbs"))).select(*columns)

    return Chunked(new, finish(chunked.parents, chunked.parents.columns), finish(chunked.children, chunked.children.columns))


def drop_empty_sections(chunked: Chunked) -> Chunked:
    """Drop leaf sections without parents and children."""
    empty = empty_sections(chunked.sections, chunked.parents, chunked.children).select(*SECTION)
    return replace(chunked, sections=chunked.sections.join(empty, SECTION, "left_anti"))


def _clean_marks(metadata: str) -> Column:
    return F.map_filter(F.coalesce(metadata, no_metadata()), lambda k, v: ~k.isin(*EDIT_MARKS))


def split_chunks(chunked: Chunked, edits: DataFrame) -> Chunked:
    """Split chunks in two (doc_id, chunk_id; optional text1, text2, page1, page2).

    The first part keeps the id, the second gets the next free one. Without texts the chunk is halved at the
    delimiter nearest its middle.
    """
    have = set(edits.columns)

    def given(name: str, kind: str) -> Column:
        return (F.col(name) if name in have else F.lit(None)).cast(kind)

    e = edits.select(
        *CHILD,
        given("text1", "string").alias("__t1"), given("text2", "string").alias("__t2"),
        given("page1", "int").alias("__p1"), given("page2", "int").alias("__p2"),
    )
    # Stored, as the edits are needed several times and may cost a pass over the chunks themselves.
    e = cut_lineage(e)
    reject_repeats(e, CHILD)
    c = chunked.children
    fresh = next_numbers(c.join(e.select("doc_id").distinct(), "doc_id", "left_semi"), "chunk_id", "c")
    rows = c.join(e.withColumn("__hit", F.lit(1).cast("bigint")), CHILD, "left").withColumn("__hit", F.coalesce("__hit", F.lit(0).cast("bigint")))
    # One running total gives the places of all parts, another numbers the split chunks of a document in order.
    rows = rows.withColumnRenamed("child_pos", "__at")
    rows = running(
        rows, ["doc_id"], ["__at"], {"child_pos": ("sum", 1 + F.col("__hit")), "__n": ("sum", F.col("__hit"))}, position_ranges("__at")
    )
    hit = F.col("__hit") == 1
    half = F.when(hit & (F.col("__t1").isNull() | F.col("__t2").isNull()), split_midpoint("text"))
    rows = rows.withColumn("__half", half).join(fresh, "doc_id", "left")
    part = F.explode(
        F.when(
            hit,
            F.array(
                F.struct(F.lit(0).alias("i"), F.coalesce("__t1", F.col("__half.first")).alias("t"), F.coalesce("__p1", page_start("page_number")).alias("p")),
                F.struct(F.lit(1).alias("i"), F.coalesce("__t2", F.col("__half.second")).alias("t"), F.coalesce("__p2", "page_end", page_start("page_number")).alias("p")),
            ),
        ).otherwise(F.array(F.struct(F.lit(1).alias("i"), F.col("text").alias("t"), F.lit(None).cast("int").alias("p"))))
    )
    parts = rows.withColumn("__x", part)
    new = {
        "chunk_id": F.when(F.col("__x.i") == 0, F.col("chunk_id")).otherwise(ids.chunk_id("doc_id", F.col("next_number") + F.col("__n") - 1)),
        "child_pos": F.col("child_pos") - 1 + F.col("__x.i"),
        "text": F.col("__x.t"),
        "token_estimate": token_estimate(F.col("__x.t")),
        "page_number": F.col("__x.p"),
        "page_end": F.col("__x.p"),
        "is_edited": F.lit(True),
        "metadata": sync_pages(_clean_marks("metadata"), F.col("__x.p"), F.col("__x.p")),
    }
    children = parts.withColumns({n: F.when(hit, v).otherwise(F.col(n)) for n, v in new.items()}).select(*c.columns)
    affected = c.join(e.select(*CHILD), CHILD, "left_semi").select(*PARENT)
    return replace(chunked, children=children, parents=recompute_parents(chunked.parents, children, affected))


def merge_chunks(chunked: Chunked, edits: DataFrame, separator: str = "\n\n") -> Chunked:
    """Merge chunks (doc_id, merge_id, chunk_id): the first one, in order, keeps id, parent, section and metadata.

    Groups of fewer than two chunks are left alone.
    """
    reject_repeats(edits, CHILD)
    c = chunked.children
    member = c.join(edits.select("doc_id", "merge_id", "chunk_id"), CHILD)
    groups = member.groupBy("doc_id", "merge_id").agg(
        F.min_by("chunk_id", "child_pos").alias("__first"),
        F.count("*").alias("__n"),
        F.array_sort(F.collect_list(F.struct("child_pos", strip(F.coalesce("text", F.lit(""))).alias("t")))).alias("__t"),
        F.min(page_start("page_number")).alias("__lo"),
        F.max(F.coalesce("page_end", page_start("page_number"))).alias("__hi"),
    ).where("__n >= 2")
    texts = F.filter(F.transform("__t", lambda x: x["t"]), lambda t: F.length(t) > 0)
    groups = groups.withColumn("__text", F.array_join(texts, separator)).drop("__t")
    in_group = member.join(groups.select("doc_id", "merge_id", "__first"), ["doc_id", "merge_id"])
    gone = in_group.where(F.col("chunk_id") != F.col("__first")).select(*CHILD)
    merged = groups.select("doc_id", F.col("__first").alias("chunk_id"), "__text", "__lo", "__hi")
    out = c.join(gone, CHILD, "left_anti").join(merged, CHILD, "left")
    hit = F.col("__text").isNotNull()
    out = out.withColumns(
        {
            "text": F.coalesce("__text", "text"),
            "token_estimate": F.when(hit, token_estimate("__text")).otherwise(F.col("token_estimate")),
            "page_number": F.coalesce("__lo", "page_number"),
            "page_end": F.when(hit, F.greatest("__lo", "__hi")).otherwise(F.col("page_end")),
            "metadata": F.when(hit, sync_pages(_clean_marks("metadata"), "__lo", "__hi")).otherwise(F.col("metadata")),
            "is_edited": hit | F.col("is_edited"),
            "is_ignored": F.when(hit, False).otherwise(F.col("is_ignored")),
        }
    ).select(*c.columns)
    children = renumber(out, F.col("child_pos"), F.lit(0), "child_pos")
    return replace(chunked, children=children, parents=recompute_parents(chunked.parents, children, in_group.select(*PARENT)))


def delete_chunks(chunked: Chunked, edits: DataFrame) -> Chunked:
    gone = edits.select(*CHILD).distinct()
    affected = chunked.children.join(gone, CHILD, "left_semi").select(*PARENT)
    children = chunked.children.join(gone, CHILD, "left_anti")
    return replace(chunked, children=children, parents=recompute_parents(chunked.parents, children, affected))


def update_parents(chunked: Chunked, edits: DataFrame) -> Chunked:
    """New title or section for parents (doc_id, parent_chunk_id, title, section_id); children follow.

    Breadcrumbs become the section's plus the parent title where that differs from the section title.
    """
    reject_repeats(edits, PARENT)
    p = _updated(chunked.parents, edits, PARENT, ["title", "section_id"])
    hit = F.col("__hit").isNotNull()
    s = chunked.sections.select(*SECTION, F.col("breadcrumbs").alias("__sb"), F.col("title").alias("__st"))
    p = p.join(s, SECTION, "left")
    named = non_empty("title").isNotNull() & ~F.col("title").eqNullSafe(F.col("__st"))
    crumbs = F.when(named, F.concat("__sb", F.array("title"))).otherwise(F.col("__sb"))
    p = p.withColumns(
        {
            "breadcrumbs": F.when(hit, F.coalesce(crumbs, "breadcrumbs")).otherwise(F.col("breadcrumbs")),
            "is_edited": hit | F.col("is_edited"),
        }
    )
    follow = p.where(hit).select(*PARENT, F.col("section_id").alias("__sid"), F.col("breadcrumbs").alias("__nb"))
    c = chunked.children.join(follow, PARENT, "left")
    c = c.withColumns(
        {
            "section_id": F.coalesce("__sid", "section_id"),
            "breadcrumbs": F.coalesce("__nb", "breadcrumbs"),
            "is_edited": F.col("__sid").isNotNull() | F.col("is_edited"),
        }
    )
    return replace(chunked, parents=p.select(*chunked.parents.columns), children=c.select(*chunked.children.columns))


def delete_parents(chunked: Chunked, edits: DataFrame) -> Chunked:
    gone = edits.select(*PARENT).distinct()
    return replace(
        chunked,
        parents=chunked.parents.join(gone, PARENT, "left_anti"),
        children=chunked.children.join(gone, PARENT, "left_anti"),
    )


def _placed(rows: DataFrame, new: DataFrame, id_column: str, position: str) -> DataFrame:
    """``rows`` with ``new`` put in: after the row named by ``after``; first where ``place`` is start, else last."""
    anchors = rows.select("doc_id", F.col(id_column).alias("after"), F.col(position).alias("__at"))
    ends = rows.groupBy("doc_id").agg(F.max(position).alias("__max"))
    n = new.join(anchors, ["doc_id", "after"], "left").join(ends, "doc_id", "left")
    start = F.col("place").eqNullSafe(F.lit("start"))
    at = F.coalesce("__at", F.when(start, F.lit(-1)).otherwise(F.coalesce("__max", F.lit(0))))
    n = n.withColumns({"__anchor": at, "__sub": F.col("__n")})
    old = rows.withColumns({"__anchor": F.col(position), "__sub": F.lit(0).cast("bigint")})
    both = old.unionByName(n.withColumn(position, F.lit(0).cast("bigint")).select(*old.columns))
    return renumber(both, F.col("__anchor"), F.col("__sub"), position).select(*rows.columns)


def _with_new_ids(new: DataFrame, existing: DataFrame, id_column: str, letter: str, make) -> DataFrame:
    """New rows with the next free ids of their documents, in ``seq`` order."""
    new = number_rows(new, ["doc_id"], ["seq"], "__n", position_ranges("seq"))
    fresh = next_numbers(existing, id_column, letter)
    new = new.join(fresh, "doc_id", "left")
    return new.withColumn(id_column, make("doc_id", F.coalesce("next_number", F.lit(1)) + F.col("__n") - 1))


def add_sections(chunked: Chunked, new: DataFrame) -> Chunked:
    """Add sections (doc_id, seq, title, parent_section_id, after, place); they start without chunks."""
    s = chunked.sections
    n = _with_new_ids(new, s, "section_id", "s", ids.section_id)
    pages = s.select("doc_id", F.col("section_id").alias("parent_section_id"), "page_start", "page_end")
    n = n.join(pages, ["doc_id", "parent_section_id"], "left").withColumns(
        {
            "level": F.lit(1),
            "breadcrumbs": F.array("title"),
            "page_start": F.coalesce("page_start", F.lit(1)),
            "page_end": F.coalesce("page_start", F.lit(1)),
        }
    )
    return _with_sections(chunked, _placed(s, n, "section_id", "section_pos"))


def add_children(chunked: Chunked, new: DataFrame) -> Chunked:
    """Add children (doc_id, seq, parent_chunk_id, text, page_number, after, place) to existing parents.

    Section, breadcrumbs and custom metadata come from the parent and its first child.
    """
    c = chunked.children
    n = _with_new_ids(new, c, "chunk_id", "c", ids.chunk_id)
    owner = chunked.parents.select(*PARENT, "section_id", F.col("breadcrumbs").alias("__pb"), F.col("page_start").alias("__page"))
    first = c.groupBy(*PARENT).agg(
        F.min_by(F.struct("metadata", "breadcrumbs"), "child_pos").alias("__f"), F.max_by("chunk_id", "child_pos").alias("__last")
    )
    n = n.join(owner, PARENT).join(first, PARENT, "left")
    page = F.coalesce("page_number", "__page", F.lit(1))
    values = {
        "page_number": page,
        "page_end": page,
        "chunk_type": F.lit("paragraph"),
        "token_estimate": token_estimate("text"),
        "breadcrumbs": F.coalesce("__f.breadcrumbs", "__pb", F.array().cast("array<string>")),
        "metadata": sync_pages(custom_metadata("__f.metadata"), page, page),
        "is_table": F.lit(False),
        "is_atomic_table": F.lit(False),
        "is_edited": F.lit(True),
        "is_ignored": F.lit(False),
        # Without a sibling the chunk goes to the end of its parent.
        "after": F.when(F.col("after").isNull() & F.col("place").isNull(), F.col("__last")).otherwise(F.col("after")),
    }
    n = n.withColumns(values)
    for name in ("raw_html", "table_caption", "table_footnote", "table_type"):
        n = n.withColumn(name, F.lit(None).cast("string"))
    children = _placed(c, n, "chunk_id", "child_pos")
    return replace(chunked, children=children, parents=recompute_parents(chunked.parents, children, n.select(*PARENT)))


def add_parents(chunked: Chunked, new: DataFrame) -> Chunked:
    """Add parents with a first child (doc_id, seq, section_id, title, text, page_number, after, place).

    The child inherits the custom metadata of the first chunk of its section, else of its document.
    """
    p, c = chunked.parents, chunked.children
    s = chunked.sections.select(*SECTION, F.col("breadcrumbs").alias("__sb"))
    n = _with_new_ids(new, p, "parent_chunk_id", "p", ids.parent_id).drop("next_number").join(s, SECTION)
    page = F.coalesce("page_number", F.lit(1))
    crumbs = F.concat("__sb", F.array("title"))
    rows = n.withColumns(
        {
            "token_estimate": token_estimate("text"),
            "page_start": page,
            "page_end": page,
            "breadcrumbs": crumbs,
            "is_edited": F.lit(True),
        }
    )
    parents = _placed(p, rows, "parent_chunk_id", "parent_pos")
    in_section = c.groupBy(*SECTION).agg(F.min_by("metadata", "child_pos").alias("__m1"))
    in_doc = c.groupBy("doc_id").agg(F.min_by("metadata", "child_pos").alias("__m2"))
    ends = c.join(p.select(*PARENT, "parent_pos"), PARENT).groupBy("doc_id", F.col("parent_chunk_id").alias("after")).agg(
        F.max_by("chunk_id", "child_pos").alias("__last")
    )
    kids = _with_new_ids(n.drop("__n"), c, "chunk_id", "c", ids.chunk_id)
    kids = kids.join(in_section, SECTION, "left").join(in_doc, "doc_id", "left").join(ends, ["doc_id", "after"], "left")
    source = F.coalesce("__m1", "__m2")
    kids = kids.withColumns(
        {
            "page_number": page,
            "page_end": page,
            "chunk_type": F.lit("paragraph"),
            "token_estimate": token_estimate("text"),
            "breadcrumbs": crumbs,
            "metadata": sync_pages(custom_metadata(source), page, page),
            "is_table": F.lit(False),
            "is_atomic_table": F.lit(False),
            "is_edited": F.lit(True),
            "is_ignored": F.lit(False),
            "after": F.col("__last"),
        }
    )
    for name in ("raw_html", "table_caption", "table_footnote", "table_type"):
        kids = kids.withColumn(name, F.lit(None).cast("string"))
    return replace(chunked, parents=parents, children=_placed(c, kids, "chunk_id", "child_pos"))


def reorder_sections(chunked: Chunked, edits: DataFrame) -> Chunked:
    """Sections with new positions among their siblings (doc_id, section_id, ordinal); subtrees, parents and children
    move along."""
    reject_repeats(edits, SECTION)
    e = edits.select(*SECTION, F.col("ordinal").alias("__o"))
    s = chunked.sections.join(e, SECTION, "left")
    s = renumber(s, F.coalesce("__o", "section_pos"), F.when(F.col("__o").isNull(), 0).otherwise(F.col("section_pos") + 1), "section_pos")
    return sync_order(replace(chunked, sections=s.select(*chunked.sections.columns)))


def reorder_parents(chunked: Chunked, edits: DataFrame) -> Chunked:
    """Parents with new positions (doc_id, parent_chunk_id, ordinal): after the row that holds the ordinal now; their
    children move along."""
    reject_repeats(edits, PARENT)
    e = edits.select(*PARENT, F.col("ordinal").alias("__o"))
    p = chunked.parents.join(e, PARENT, "left")
    p = renumber(p, F.coalesce("__o", "parent_pos"), F.when(F.col("__o").isNull(), 0).otherwise(F.col("parent_pos") + 1), "parent_pos")
    parents = p.select(*chunked.parents.columns)
    return replace(chunked, parents=parents, children=follow_parents(chunked.children, parents))


def _not_root() -> Column:
    return (F.coalesce("level", F.lit(1)) != 0) & ~F.col("section_id").rlike("(_s00|_root)$")


def reparent_sections(chunked: Chunked, edits: DataFrame) -> Chunked:
    """Sections under a new parent (doc_id, section_id, new_parent_id).

    The root cannot move, and a section cannot go under itself or a section below it: such edits are refused.
    """
    reject_repeats(edits, SECTION)
    s = chunked.sections
    closed = ancestors(s).select("doc_id", F.col("section_id").alias("new_parent_id"), F.transform("path", lambda x: x["id"]).alias("__up"))
    ok = (
        edits.select(*SECTION, "new_parent_id")
        .join(s.where(_not_root()).select(*SECTION), SECTION, "left_semi")
        .join(closed, ["doc_id", "new_parent_id"])
        .where((F.col("section_id") != F.col("new_parent_id")) & ~F.array_contains("__up", F.col("section_id")))
        .select(*SECTION, "new_parent_id")
    )
    moved = s.join(ok, SECTION, "left").withColumn("parent_section_id", F.coalesce("new_parent_id", "parent_section_id"))
    return _with_sections(chunked, moved.select(*s.columns))


def indent_targets(sections: DataFrame) -> DataFrame:
    """(doc_id, section_id, new_parent_id): each section under its previous sibling, where it has one."""
    s = sections.where(_not_root()).select(*SECTION, "parent_section_id", "section_pos")
    before = {"__p": latest(["section_pos"], F.col("section_id"))}
    s = running(s, ["doc_id", "parent_section_id"], ["section_pos"], before, position_ranges("section_pos"), inclusive=False)
    return s.select(*SECTION, latest_value("__p").alias("new_parent_id")).where(F.col("new_parent_id").isNotNull())


def outdent_targets(sections: DataFrame) -> DataFrame:
    """(doc_id, section_id, new_parent_id): each section beside its parent, unless the parent is the root."""
    up = sections.where(_not_root()).select(
        "doc_id", F.col("section_id").alias("parent_section_id"), F.col("parent_section_id").alias("new_parent_id")
    )
    return sections.where(_not_root()).join(up, ["doc_id", "parent_section_id"]).select(*SECTION, "new_parent_id")


def copy_metadata(children: DataFrame, edits: DataFrame) -> DataFrame:
    """Custom metadata of source chunks copied onto target chunks (doc_id, source_id, chunk_id)."""
    reject_repeats(edits, CHILD)
    source = children.select("doc_id", F.col("chunk_id").alias("source_id"), custom_metadata("metadata").alias("__m"))
    e = edits.select(*CHILD, "source_id").join(source, ["doc_id", "source_id"]).drop("source_id")
    c = children.join(e, CHILD, "left")
    hit = F.col("__m").isNotNull() & (F.size("__m") > 0)
    merged = merge_metadata("metadata", "__m", "page_number", "page_end")
    return c.withColumns(
        {
            "metadata": F.when(hit, merged).otherwise(F.col("metadata")),
            "is_edited": F.coalesce(hit, F.lit(False)) | F.col("is_edited"),
        }
    ).select(*children.columns)
