"""Reports over the chunk tables. All of them aggregate before any shuffle."""

from __future__ import annotations

from collections.abc import Iterator
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from ..functions.ids import doc_of_chunk
from ..functions.meta import page_start
from ..functions.text import is_blank, non_empty, strip, token_estimate
from .scan import number_rows, position_ranges, ranges_of


def is_table_row() -> Column:
    return (F.col("chunk_type") == "table") | F.coalesce("is_atomic_table", F.lit(False))


def tokens_of() -> Column:
    return F.coalesce(F.nullif("token_estimate", F.lit(0)), token_estimate("text"))


def is_empty_chunk() -> Column:
    """No text and no table."""
    return is_blank("text") & is_blank("raw_html")


def document_stats(sections: DataFrame, parents: DataFrame, children: DataFrame) -> DataFrame:
    """Counts and token sum per document."""
    s = sections.groupBy("doc_id").agg(F.count("*").alias("total_sections"))
    p = parents.groupBy("doc_id").agg(F.count("*").alias("total_parent_chunks"))
    c = children.groupBy("doc_id").agg(
        F.count("*").alias("total_child_chunks"),
        F.count_if(F.col("chunk_type").isin("paragraph", "article_clause")).alias("paragraph_chunks"),
        F.count_if(F.col("chunk_type") == "table").alias("table_chunks"),
        F.sum("token_estimate").alias("total_tokens"),
    )
    out = s.join(p, "doc_id", "left").join(c, "doc_id", "left")
    return out.na.fill(0)


def inventory(docs: DataFrame, sections: DataFrame, parents: DataFrame, children: DataFrame) -> DataFrame:
    """The document list with its figures; ``parsed`` where chunks exist."""
    t = children.groupBy("doc_id").agg(
        F.count("*").alias("total_chunks"),
        F.count_if((F.col("chunk_type") == "table") | F.coalesce("is_table", F.lit(False))).alias("tables_count"),
        F.sum("token_estimate").alias("estimated_tokens"),
    )
    s = sections.groupBy("doc_id").agg(F.count("*").alias("sections"))
    p = parents.groupBy("doc_id").agg(F.count("*").alias("parent_chunks"))
    out = docs.join(s, "doc_id", "left").join(p, "doc_id", "left").join(t, "doc_id", "left")
    return out.withColumn("parsed", F.col("sections").isNotNull()).na.fill(0)


def corpus_totals(listing: DataFrame) -> DataFrame:
    """One row of totals over an inventory with ``is_embedded`` and ``status``."""
    return listing.agg(
        F.count("*").alias("total_docs"),
        F.count_if("parsed").alias("parsed_docs"),
        F.count_if(F.col("status") == "running").alias("running_jobs"),
        F.sum(F.when(F.col("parsed"), F.col("total_chunks")).otherwise(0)).alias("total_chunks"),
        F.count_if("is_embedded").alias("embedded_docs"),
        F.sum(F.when(F.col("parsed"), F.col("sections")).otherwise(0)).alias("total_sections"),
    )


def lint(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Findings per document: empty, over and under sized children, oversized parents."""
    c = children.withColumns({"__t": is_table_row(), "__w": tokens_of(), "__e": is_empty_chunk()})
    text = ~F.col("__e") & ~F.col("__t")
    found = c.groupBy("doc_id").agg(
        F.count_if("__e").alias("empty_count"),
        F.count_if(text & (F.col("__w") > P.CHILD_BUDGET)).alias("over_count"),
        F.count_if(text & (F.col("__w") > 0) & (F.col("__w") < P.MIN_CHILD_TOKENS)).alias("under_count"),
    )
    over = parents.groupBy("doc_id").agg(F.count_if(F.col("token_estimate") > P.PARENT_BUDGET).alias("parent_over_count"))
    out = found.join(over, "doc_id", "full_outer").na.fill(0)
    return out.withColumn(
        "total_warnings", F.col("empty_count") + F.col("over_count") + F.col("under_count") + F.col("parent_over_count")
    )


def edit_counts(children: DataFrame) -> DataFrame:
    return children.groupBy("doc_id").agg(
        F.count_if(F.coalesce("is_edited", F.lit(False))).alias("edited_count"),
        F.count_if(F.coalesce("is_ignored", F.lit(False))).alias("ignored_count"),
    )


def metadata_keys(children: DataFrame) -> DataFrame:
    """Distinct custom metadata keys, sorted."""
    return (
        children.select(F.explode(F.map_keys("metadata")).alias("key"))
        .where(~F.col("key").isin(*P.RESERVED_METADATA_KEYS))
        .distinct()
        .orderBy("key")
    )


def indexed_names(index: DataFrame) -> DataFrame:
    """Distinct names the indexed documents are known by, sorted."""
    prefix = non_empty(doc_of_chunk("chunk_id"))
    names = F.array(F.get("breadcrumbs", F.lit(0)), non_empty("doc_id"), non_empty("title"), prefix)
    return (
        index.select(F.explode(names).alias("name"))
        .where(F.col("name").isNotNull())
        .select(strip("name").alias("name"))
        .distinct()
        .orderBy("name")
    )


def collection_info(index: DataFrame) -> DataFrame:
    return index.agg(F.count("*").alias("points_count"), F.count_distinct("doc_id").alias("docs_count"))


def manifest(index: DataFrame) -> DataFrame:
    """Chunk count and last index time per document and collection."""
    return index.groupBy("doc_id", "collection").agg(
        F.count("*").alias("chunks_count"), F.max("indexed_at").alias("indexed_at")
    )


def next_numbers(rows: DataFrame, id_column: str, letter: str) -> DataFrame:
    """Next free number per document for ids that end in ``_<letter><digits>``."""
    number = F.regexp_extract(id_column, rf"(?i)_?{letter}(\d+)$", 1)
    found = rows.groupBy("doc_id").agg(F.max(F.nullif(number, F.lit("")).cast("bigint")).alias("m"))
    return found.select("doc_id", (F.coalesce("m", F.lit(0)) + 1).alias("next_number"))


def empty_sections(sections: DataFrame, parents: DataFrame, children: DataFrame) -> DataFrame:
    """Sections without parents, children and sub-sections."""
    key = ["doc_id", "section_id"]
    subs = sections.select("doc_id", F.col("parent_section_id").alias("section_id")).where(F.col("section_id").isNotNull())
    used = parents.select(*key).unionByName(children.select(*key)).unionByName(subs).distinct()
    return sections.join(used, key, "left_anti")


def grouped_ids(rows: DataFrame, group: str, identifier: str, position: str, part_rows: int = 4096) -> DataFrame:
    """Ordered ids per group, in parts of at most ``part_rows`` ids so that no row grows without bound."""
    numbered = number_rows(
        rows.select("doc_id", group, F.col(position).cast("bigint").alias("__p"), identifier),
        ["doc_id", group], ["__p"], "n", position_ranges("__p"),
    )
    return (
        numbered.groupBy("doc_id", group, ranges_of(F.col("n") - 1, part_rows)[0].alias("part_no"))
        .agg(F.array_sort(F.collect_list(F.struct("__p", identifier))).alias("g"))
        .select("doc_id", group, "part_no", F.transform("g", lambda x: x[identifier]).alias("ids"))
    )


def sections_page_list(children: DataFrame) -> DataFrame:
    """First and last page per section."""
    return children.groupBy("doc_id", "section_id").agg(
        F.min(page_start("page_number")).alias("page_start"), F.max("page_end").alias("page_end")
    )


_DIFF = (
    T.StructType()
    .add("added_chars", T.IntegerType())
    .add("removed_chars", T.IntegerType())
    .add("modified_segments", T.IntegerType())
)


def _common_counts(a: list[int], b: list[int]) -> np.ndarray:
    """For each j the length of the longest common subsequence of ``a`` and the first j of ``b``.

    Bit j of a number stands for b[j]; a step per element of ``a`` moves all of them at once.
    """
    masks: dict[int, int] = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(bits == 0)])  # zeros are where the length grows


def common_tokens(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places (i, j) of a longest common subsequence, in order.

    Common ends are cut; the rest is halved where both halves have most in common, which takes memory in proportion to
    the texts.
    """
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        i, k, j, m = work.pop()
        while i < k and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < k and j < m and a[k - 1] == b[m - 1]:
            k, m = k - 1, m - 1
            out.append((k, m))
        if i == k or j == m:
            continue
        if k - i == 1:
            if a[i] in b[j:m]:
                out.append((i, b.index(a[i], j, m)))
            continue
        half = (i + k) // 2
        before = _common_counts(a[i:half], b[j:m])
        behind = _common_counts(a[half:k][::-1], b[j:m][::-1])
        cut = int(np.argmax(before + behind[::-1]))
        work += [(i, half, j, j + cut), (half, k, j + cut, m)]
    return sorted(out)


def _word_diff(before: str | None, after: str | None) -> dict[str, int]:
    texts = [re.findall(r"\s+|\w+|[^\w\s]", t or "") for t in (before, after)]
    numbers: dict[str, int] = {}
    a, b = ([numbers.setdefault(w, len(numbers)) for w in t] for t in texts)
    matched = common_tokens(a, b)
    segments = 0
    last = (-1, -1)
    for i, j in [*matched, (len(a), len(b))]:
        segments += (i - last[0] > 1) + (j - last[1] > 1)
        last = i, j
    same = sum(len(texts[0][i]) for i, _ in matched)
    gone, new = (sum(map(len, t)) - same for t in texts)
    return {"added_chars": new, "removed_chars": gone, "modified_segments": segments}


@F.pandas_udf(_DIFF)
def word_diff(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Added and removed characters and changed segments between two texts, word by word."""
    for before, after in pairs:
        yield pd.DataFrame([_word_diff(a, b) for a, b in zip(before, after)], columns=_DIFF.names)


def diff_stats(rows: DataFrame, original: str, refined: str) -> DataFrame:
    """Sizes and word differences of refined texts."""
    d = rows.withColumn("__d", word_diff(original, refined))
    sizes = {
        "original_chars": F.length(F.coalesce(original, F.lit(""))),
        "refined_chars": F.length(F.coalesce(refined, F.lit(""))),
    }
    d = d.withColumns(sizes).withColumn("char_delta", F.col("refined_chars") - F.col("original_chars"))
    return d.select(*rows.columns, *sizes, "char_delta", "__d.*")
