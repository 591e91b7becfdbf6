"""Merkle manifest of a dataset: leaves per document, a binary tree per language, one root, and proofs.

Nodes of a tree are numbered; 2^10 neighbours are one window partition, and as pairs are aligned none is cut. Within it
every level is lag and lead columns of a fixed offset: a node stands on the row of its first leaf, its sibling 2^level
rows before or behind, masked by slot and run length, and first-child rows hash the parents. What a block of 2^10 nodes
leaves is one node of the next tier. So a language of any size is cut into blocks, and tiers are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

LEVELS = 10  # of one tier; a window partition has 2^LEVELS nodes at most
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """``-`` if null, else the UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    """Lowercase hex sha256 of the values one after the other."""
    return F.sha2(F.concat(*values).cast("binary"), 256)


def tampered(doc_id: Column) -> Column:
    """Whether 7 divides crc32 of the id as text; a null id is never tampered with."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0, F.lit(False))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``n`` (rows of the group) and ``at`` (0, 1, ... in the order) per group; ``group`` is never null.

    The order is cut into ranges by sampled splits; a row's number is its place in its sorted range and the rows of the
    ranges before it. So a group that is most of the table is counted in many tasks. The window has one row per range.
    """
    ranged = stored(
        rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
        .withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    )
    counts = ranged.groupBy("part").agg(F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    placed = ranged.join(F.broadcast(starts), "part").withColumn("at", F.col("start") + F.col("place")).drop("part", "place", "start")
    sizes = placed.groupBy(group).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    return placed.join(sizes, group).withColumn("at", F.col("at") - F.col("first")).drop("first")


def tier(nodes: DataFrame, group: str, levels: int = LEVELS) -> DataFrame:
    """``nodes`` (group, at, n, node and more) with (block, path, top) for up to ``levels`` levels.

    ``path`` lists (first, sibling) from the node up, ``sibling`` empty where a run has one node. On the first row of
    each block ``top`` is the node that the block leaves, else null.
    """
    block = Window.partitionBy(group, "block").orderBy("at")
    before = block.rowsBetween(Window.unboundedPreceding, 0)
    rows = nodes.withColumns({"block": F.shiftright("at", levels), "h0": F.col("node")})
    for level in range(levels):
        step = 1 << level
        # The level has ceil(n / step) nodes; where one is left nothing more is hashed.
        many = F.col("n") > step
        second = F.shiftright("at", level) % 2 == 1
        behind, ahead = F.lag(f"h{level}", step).over(block), F.lead(f"h{level}", step).over(block)
        sibling = F.when(second, behind).when(F.col("at") + step >= F.col("n"), F.lit("")).otherwise(ahead)
        rows = rows.withColumn(f"s{level}", F.when(many & (F.col("at") % step == 0), sibling))
        parent = F.when(many, digest(F.col(f"h{level}"), F.col(f"s{level}"))).otherwise(F.col(f"h{level}"))
        rows = rows.withColumn(f"h{level + 1}", F.when(F.col("at") % (2 * step) == 0, parent))
    # The sibling of a row's node at a level stands on the node's first leaf, the last one before the row.
    steps = [
        F.when(
            F.col("n") > (1 << level),
            F.struct((F.shiftright("at", level) % 2 == 0).alias("first"), F.last(f"s{level}", ignorenulls=True).over(before).alias("sibling")),
        )
        for level in range(levels)
    ]
    path = F.filter(F.array(*steps), lambda x: x.isNotNull())
    return rows.select(*nodes.columns, "block", path.alias("path"), F.col(f"h{levels}").alias("top"))


def tree(nodes: DataFrame, group: str, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """(nodes with ``path`` up to the root, (group, root)) of the trees over stored (group, at, n, node and more)."""
    tiers = [nodes]
    while True:
        done = tier(tiers[-1], group, levels).where(F.col("top").isNotNull())
        above = stored(done.select(group, F.col("block").alias("at"), F.ceil(F.col("n") / (1 << levels)).cast("bigint").alias("n"), F.col("top").alias("node")))
        if (above.agg(F.max("n")).first()[0] or 0) <= 1:
            break
        tiers.append(above)
    rest = None
    for nodes in reversed(tiers):
        own = tier(nodes, group, levels)
        if rest is not None:
            # The window has dealt the rows by (group, block) already.
            own = own.join(rest, [group, "block"]).withColumn("path", F.concat("path", "rest")).drop("rest")
        rest = own.select(group, F.col("at").alias("block"), F.col("path").alias("rest"))
    return own.drop("block", "top"), above.select(group, F.col("node").alias("root"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path."""
    def up(node: Column, step: Column) -> Column:
        return F.when(step["first"], digest(node, step["sibling"])).otherwise(digest(step["sibling"], node))

    return F.aggregate(path, leaf, up)


def merkle_manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, path, proof_sha256, folded_root, verified per row of ``docs``.

    A leaf is the digest of doc_id, source, lang, n_chars and text. Per lang, a null one being a lang of its own, leaves
    ascend by doc_id, null ids last, then by leaf; rows that repeat everything have equal leaves and places of their own.
    ``path`` lists the siblings from the leaf to the root. Tampering adds 1 to n_chars where 7 divides crc32 of the id;
    the folded root then differs, unless n_chars is null. An empty table gives no rows.
    """
    fields = {c: field(F.col(c)) for c in FIELDS}
    changed = field(F.when(tampered(F.col("doc_id")), F.col("n_chars").cast("bigint") + 1).otherwise(F.col("n_chars").cast("bigint")))
    # A lang as text that is never null and sorts as asked: null first, then by bytes.
    lang = F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("l"), F.col("lang")))
    leaves = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        lang.alias("tree"),
        digest(*fields.values()).alias("node"),
        digest(*(fields | {"n_chars": changed}).values()).alias("shown"),
        F.col("doc_id").isNull().alias("no_id"),
    )
    placed = stored(numbered(leaves, "tree", ["no_id", "doc_id", "node"]))
    rows, subroots = tree(placed, "tree", levels)
    langs = stored(numbered(subroots.select(F.lit(0).alias("all"), "tree", F.col("root").alias("node")), "all", ["tree"]))
    over, roots = tree(langs, "all", levels)
    # One row per lang, and one root.
    tops = stored(over.join(roots, "all").select("tree", F.col("node").alias("subroot"), "root", F.col("path").alias("rest")))
    full = rows.join(tops, "tree").withColumn("path", F.concat("path", "rest"))
    proof = F.sha2(F.array_join(F.transform("path", lambda x: x["sibling"]), "").cast("binary"), 256)
    found = full.withColumns({"proof_sha256": proof, "folded_root": folded(F.col("shown"), F.col("path"))})
    return found.select(
        "doc_id", F.col("node").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "path"
    )
