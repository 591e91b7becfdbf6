"""Parse artifacts: which files exist, which one counts for a document, and name matching."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from ..functions.text import col
from ..session import cut_lineage

MIN_PREFIX = 10
SUFFIX = r"_content_list(_v2)?\.json$"


@F.pandas_udf(T.StringType())
def nfc(names: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode NFC form of names."""
    for batch in names:
        yield batch.map(lambda s: unicodedata.normalize("NFC", s) if s is not None else None)


def list_artifacts(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime) of the parse results below a folder; file contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*_content_list*.json")
        .load(root)
        .select("path", F.col("modificationTime").alias("mtime"))
    )


def describe_artifacts(artifacts: DataFrame) -> DataFrame:
    """Add stem, version (2 for nested results, 1 for flat), backend and method read from the path."""
    parts = F.split("path", "/")
    folders = F.filter(parts, lambda p: p.rlike(P.PIPELINE_FOLDER))
    first = F.coalesce(F.get(folders, F.lit(0)), F.lit(""))
    parent = F.element_at(parts, -2)
    method = F.nullif(F.regexp_extract(first, P.PIPELINE_FOLDER, 2), F.lit(""))
    return artifacts.withColumns(
        {
            "stem": F.regexp_replace(F.element_at(parts, -1), SUFFIX, ""),
            "version": F.when(F.col("path").endswith("_v2.json"), 2).otherwise(1),
            "backend": F.nullif(F.regexp_extract(first, P.PIPELINE_FOLDER, 1), F.lit("")),
            "method": F.coalesce(method, F.when(F.size(parts) > 1, F.when(parent.isin(*P.PARSE_METHOD_FOLDERS), parent))),
        }
    )


def plain_path(path: Column | str) -> Column:
    """A file path without URI escapes and with one slash after the scheme."""
    unescaped = F.url_decode(F.replace(col(path), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(unescaped, "^([A-Za-z][A-Za-z0-9]*):/+(?=[^/])", "$1:/")


def best_match(names: DataFrame, targets: DataFrame, rank: Column) -> DataFrame:
    """For each ``name`` the best target by ``rank``: equal names, or one a prefix of the other.

    Prefix matches need a target ``key`` of at least 10 characters. Names and keys are sorted once; what a string is a
    prefix of follows it in a row, so a sweep over each range finds both kinds of match with a row per name and key.
    """
    n = names.select("name").where("name IS NOT NULL").distinct()
    t = targets.select("key", rank.alias("__r"))
    exact = t.groupBy("key").agg(F.max("__r").alias("best"))
    equal = n.join(exact, n["name"] == exact["key"]).select("name", "best")
    kind = dict(exact.dtypes)["best"]
    items = n.where("name <> ''").select(F.col("name").alias("s"), F.lit(True).alias("is_name"), F.lit(None).cast(kind).alias("best")).unionByName(
        exact.where(F.length("key") >= MIN_PREFIX).select(F.col("key").alias("s"), F.lit(False).alias("is_name"), "best")
    )
    placed = cut_lineage(items.repartitionByRange("s").sortWithinPartitions("s", "is_name").withColumn("part", F.spark_partition_id()))
    # A string of an earlier range that is a prefix of one in this range is a prefix of the first one in it.
    heads = placed.groupBy("part").agg(F.min("s").alias("head"))
    spelled = heads.select("part", F.explode(F.transform(F.sequence(F.lit(1), F.length("head") - 1), lambda i: F.substring("head", F.lit(1), i))).alias("s")).where("s <> ''")
    above = spelled.join(placed.select("s", "is_name", "best"), "s")
    # As many rows as a range's first string has letters, for each range.
    open_before: dict[int, list[tuple[str, bool, object]]] = {}
    for r in above.collect():
        open_before.setdefault(r["part"], []).append((r["s"], r["is_name"], _plain(r["best"])))
    swept = placed.mapInArrow(_sweep(open_before), f"name string, best {kind}")
    return equal.unionByName(swept).groupBy("name").agg(F.max("best").alias("best"))


def _plain(value):
    """Rows as dictionaries, as Arrow gives structs."""
    return {k: _plain(v) for k, v in value.asDict(recursive=False).items()} if isinstance(value, Row) else value


def _order(value) -> tuple:
    """A key that sorts values and structs of one type as Spark does, null first."""
    if value is None:
        return (0,)
    return (1, tuple(map(_order, value.values()))) if isinstance(value, dict) else (1, value)


def _better(a, b):
    return a if b is None or (a is not None and _order(a) >= _order(b)) else b


def _sweep(open_before: dict[int, list[tuple[str, bool, object]]]):
    """Function over a sorted range of (s, is_name, best, part): the best keys that are prefixes of, or begin with, a name.

    Open strings are a stack in which each is a prefix of the next: (s, is_name, carried in, best key up to here, best key
    that begins with it).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[list] = []
        found: list[tuple[str, object]] = []
        begun = False
        kind = None

        def close() -> None:
            s, is_name, carried, chain, inside = stack.pop()
            if is_name:
                best = inside if carried else _better(chain, inside)
                if best is not None:
                    found.append((s, best))
            if stack:
                stack[-1][4] = _better(stack[-1][4], inside)

        def open_(s: str, is_name: bool, best: object, carried: bool) -> None:
            chain = stack[-1][3] if stack else None
            stack.append([s, is_name, carried, chain if is_name else _better(chain, best), None if is_name or carried else best])

        def batch_of() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.string()), pa.array([b for _, b in found], kind)], names=["name", "best"])
            found.clear()
            return out

        for batch in batches:
            kind = batch.schema.field("best").type
            rows = zip(*(batch.column(c).to_pylist() for c in ("s", "is_name", "best", "part")))
            for s, is_name, best, part in rows:
                if not begun:
                    begun = True
                    for before in sorted(open_before.get(part, []), key=lambda x: len(x[0])):
                        open_(*before, True)
                while stack and not s.startswith(stack[-1][0]):
                    close()
                open_(s, is_name, best, False)
            yield batch_of()
        while stack:
            close()
        if found:
            yield batch_of()

    return run


def latest_artifacts(docs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """The artifact that counts for each document (``name``, its file stem): nested before flat, then newest.

    Names and path parts meet in Unicode NFC form, whatever form either is stored in.
    """
    a = describe_artifacts(artifacts)
    known = F.array_distinct(F.concat(F.filter(F.split("path", "/"), lambda p: F.length(p) > 0), F.array("stem")))
    targets = a.select(F.explode(known).alias("key"), "version", "mtime", "path").withColumn("key", nfc("key"))
    named = docs.withColumn("__nfc", nfc("name"))
    found = best_match(named.select(F.col("__nfc").alias("name")), targets, F.struct("version", "mtime", "path"))
    return named.join(found.select(F.col("name").alias("__nfc"), "best.*"), "__nfc", "left").drop("__nfc")


def mark_indexed(docs: DataFrame, indexed: DataFrame) -> DataFrame:
    """Documents with ``is_embedded``: an indexed ``name`` equals or prefix-matches the document's, both in NFC form."""
    named = docs.withColumn("__nfc", nfc("name"))
    found = best_match(named.select(F.col("__nfc").alias("name")), indexed.select(nfc(col("name")).alias("key")), F.lit(1))
    flagged = named.join(found.withColumnRenamed("name", "__nfc"), "__nfc", "left")
    return flagged.withColumn("is_embedded", F.col("best").isNotNull()).drop("best", "__nfc")


def read_artifacts(spark: SparkSession, chosen: DataFrame, root: str) -> DataFrame:
    """JSON texts of chosen artifacts (``name``, ``path``), for ``blocks_from_json``."""
    files = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*_content_list*.json")
        .text(root, wholetext=True)
        .select(plain_path("_metadata.file_path").alias("__path"), F.col("value").alias("json"))
    )
    # Listed paths have no escapes, so only their slashes are brought to one form.
    listed = F.regexp_replace("path", "^([A-Za-z][A-Za-z0-9]*):/+(?=[^/])", "$1:/")
    return files.join(chosen.select("name", listed.alias("__path")), "__path").select(
        F.col("name").alias("doc_id"), F.col("name").alias("doc_title"), F.lit("general").alias("strategy"), "json"
    )
