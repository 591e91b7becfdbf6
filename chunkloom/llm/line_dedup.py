"""Line dedup by a suffix array over line ids, built by distributed prefix doubling.

Every line position is a suffix of its document. Its rank at depth k is the number of suffixes whose first k lines
sort lower, plus one; ranks at depth 2k order the pairs of ranks at k lines' distance. Positions whose first k lines
occur once leave the work, so each round holds repeated runs only. Two suffixes whose common prefix is at least m
lines form one interval, found from the ranks of the two blocks of 2^j lines that cover m lines. A position whose
first m lines, the fewest that hold ``min_words`` words, begin at an earlier place too is a hit; hits in a row are one
run. If p agrees with an earlier place for n lines, p + 1 does for n - 1 at least, so the extents of a run's hits never
fall, and what the last hit agrees with beyond its m lines holds fewer than ``min_words`` words past its first line: else
p + 1 were a hit. So ranks are needed to depth m only, and the rest of a run comes from splitting the interval of its last
hit, line by line, into the intervals below it. The runs are the longest ones over all earlier copies.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scan import running
from .common import NO_ID, WORD, identity, stored, text_of, with_results

MIN_WORDS = 50
LAST = 2**63 - 1  # stands for a null doc_id: it sorts after all others
DOC = ["k_id", "k_text"]
INTERVAL = ["m", "r1", "r2"]


def line_table(docs: DataFrame) -> DataFrame:
    """(k_id, k_text, lines): per document its lines as 128-bit digests and word counts."""
    line = lambda x: F.struct(
        F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b"), F.regexp_count(x, F.lit(WORD)).alias("words")
    )
    keys = [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("k_id"), identity()[1]]
    return docs.select(*keys, F.transform(F.split(text_of(), "\n"), line).alias("lines")).dropDuplicates(DOC)


def positions(table: DataFrame, min_words: int) -> DataFrame:
    """(k_id, k_text, pos, a, b, m, t) per line.

    m is how many lines from pos on hold ``min_words`` words, null if all do not; t how many more lines follow them before
    the lines after pos hold ``min_words`` words.
    """
    rows = table.select(*DOC, F.posexplode("lines").alias("pos", "line")).select(*DOC, "pos", "line.*")
    by_pos = Window.partitionBy(*DOC).orderBy("pos")
    upto = F.sum("words").over(by_pos.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("words").over(Window.partitionBy(*DOC))
    rows = rows.select("*", (upto - F.col("words")).alias("before"), total.alias("total"))
    # Lines that begin fewer than min_words words later belong to the block; blank lines before share the same start.
    last = F.max("pos").over(Window.partitionBy(*DOC).orderBy("before").rangeBetween(0, min_words - 1))
    enough = F.col("total") - F.col("before") >= min_words
    rows = rows.select("*", (F.col("before") + F.col("words")).alias("upto"), F.when(enough, last - F.col("pos") + 1).alias("m"))
    rest = F.max("pos").over(Window.partitionBy(*DOC).orderBy("upto").rangeBetween(0, min_words - 1))
    return rows.select(*DOC, "pos", "a", "b", "m", (rest - F.col("pos") - F.col("m") + 1).alias("t"))


def first_ranks(rows: DataFrame) -> DataFrame:
    """(k_id, k_text, pos, m, t, r) of the positions whose line is repeated; lines sort by digest."""
    lines = rows.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1")
    lines = stored(lines)
    ranges = [[F.shiftright("a", 46)], [F.shiftright("a", 56)]]
    ranked = running(lines, [], ["a", "b"], {"r": ("sum", F.col("n"))}, ranges, inclusive=False)
    return rows.join(ranked.select("a", "b", "r"), ["a", "b"]).select(*DOC, "pos", "m", "t", (F.col("r") + 1).alias("r"))


def doubled(ranks: DataFrame, k: int) -> DataFrame:
    """Ranks at depth 2k from ranks at depth k, of the positions whose first 2k lines are repeated."""
    follow = ranks.select(*DOC, (F.col("pos") - k).alias("pos"), F.col("r").alias("next"))
    pairs = ranks.join(follow, [*DOC, "pos"])
    groups = stored(pairs.groupBy("r", "next").agg(F.count("*").alias("n")))
    ranges = [[F.shiftright("next", 12)], [F.shiftright("next", 24)]]
    ordered = running(groups, ["r"], ["next"], {"lower": ("sum", F.col("n"))}, ranges, inclusive=False)
    repeated = ordered.where("n > 1").select("r", "next", (F.col("r") + F.col("lower")).alias("rank"))
    return pairs.join(repeated, ["r", "next"]).select(*DOC, "pos", "m", "t", F.col("rank").alias("r"))


def run_starts(ranks: DataFrame) -> DataFrame:
    """(k_id, k_text, pos, t, m, r1, r2): positions with their interval (m, r1, r2) at depth m.

    Each round's part is stored, so that the union of all is no plan with a join per round.
    """
    parts = []
    k = 1
    while True:
        here = ranks.where(F.col("m").between(k, 2 * k - 1))
        at = ranks.select(*DOC, F.col("pos").alias("p2"), F.col("r").alias("r2"))
        cover = here.withColumn("p2", F.col("pos") + F.col("m") - k).join(at, [*DOC, "p2"])
        parts.append(stored(cover.select(*DOC, "pos", "t", "m", F.col("r").alias("r1"), "r2")))
        deeper = ranks.agg(F.max("m")).first()[0]
        if deeper is None or deeper < 2 * k:
            return reduce(DataFrame.unionByName, parts)
        ranks = stored(doubled(ranks, k))
        k *= 2


def members(starts: DataFrame) -> DataFrame:
    """(k_id, k_text, pos, t, m, r1, r2, hit): positions of intervals with several; all but the first place are hits."""
    first = starts.groupBy(*INTERVAL).agg(F.min(F.struct(*DOC, "pos")).alias("f"), F.count("*").alias("n")).where("n > 1")
    return starts.join(first, INTERVAL).select(*DOC, "pos", "t", *INTERVAL, (F.struct(*DOC, "pos") != F.col("f")).alias("hit"))


def last_hits(found: DataFrame) -> DataFrame:
    """The hits that no hit follows on the next line."""
    after = F.lead("pos").over(Window.partitionBy(*DOC).orderBy("pos"))
    hits = found.where("hit").withColumn("after", after)
    return hits.where(F.col("after").isNull() | (F.col("after") > F.col("pos") + 1)).drop("after", "hit")


def further_lines(found: DataFrame, last: DataFrame, table: DataFrame) -> DataFrame:
    """(k_id, k_text, pos, more): lines of last hits beyond their m lines that an earlier place has too, where there are any.

    Each depth below an interval splits it by the lines so far; a place that is not the first of its part has them from an
    earlier one. All places of the interval take part, hits or not.
    """
    open_ends = last.where("t > 0").select(*INTERVAL).distinct()
    places = found.where("t > 0").join(open_ends, INTERVAL, "left_semi")
    begin = F.col("pos") + F.col("m")
    lines = places.join(table, DOC).select(*DOC, "pos", *INTERVAL, F.posexplode(F.slice("lines", begin + 1, F.col("t"))).alias("depth", "line"))
    so_far = Window.partitionBy(*DOC, "pos").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    # Lines so far as two 64-bit sums without carry of hashes that tell depth and line apart.
    mark = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "depth", "line.a", "line.b")).over(so_far)
    paths = lines.select(*DOC, "pos", *INTERVAL, "depth", mark(1).alias("x"), mark(2).alias("y"))
    part = [*INTERVAL, "depth", "x", "y"]
    first = paths.groupBy(*part).agg(F.min(F.struct(*DOC, "pos")).alias("f"), F.count("*").alias("n")).where("n > 1")
    ends = paths.join(last.select(*DOC, "pos"), [*DOC, "pos"], "left_semi").join(first, part).where(F.struct(*DOC, "pos") != F.col("f"))
    return ends.groupBy(*DOC, "pos").agg((F.max("depth") + 1).alias("more"))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(k_id, k_text, n_lines, n_removed, ranges) per document: ranges (start, end) of its lines that are later copies.

    A line is removed if it lies in a run of lines of at least ``min_words`` words that also begins at an earlier
    place (by doc_id, then by position), whichever earlier place that is.
    """
    table = stored(line_table(docs))
    ranks = stored(first_ranks(positions(table, min_words)))
    found = stored(members(run_starts(ranks)))
    last = stored(last_hits(found))
    more = further_lines(found, last, table)
    tails = last.join(more, [*DOC, "pos"]).select(*DOC, "pos", (F.col("m") + F.col("more")).alias("m"))
    runs = found.where("hit").select(*DOC, "pos", "m").unionByName(tails)
    runs = runs.select(*DOC, F.col("pos").alias("start"), (F.col("pos") + F.col("m")).alias("end"))
    # Ranges that overlap or touch become one.
    reach = F.max("end").over(Window.partitionBy(*DOC).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    opened = runs.withColumn("opens", (reach.isNull() | (F.col("start") > reach)).cast("int"))
    numbered = opened.withColumn("no", F.sum("opens").over(Window.partitionBy(*DOC).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy(*DOC, "no").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    per_doc = merged.groupBy(*DOC).agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ranges"), F.sum(F.col("end") - F.col("start")).alias("n_removed")
    )
    sizes = table.select(*DOC, F.size("lines").cast("bigint").alias("n_lines"))
    out = sizes.join(per_doc, DOC, "left").select(
        F.when(F.col("k_id") == LAST, F.lit(NO_ID)).otherwise(F.col("k_id")).alias("k_id"), "k_text", "n_lines",
        F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("ranges", F.array().cast("array<struct<start:int,end:int>>")).alias("ranges"),
    )
    return out


def kept_text(text: Column, ranges: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda _, i: ~F.exists(ranges, lambda r: (r["start"] <= i) & (i < r["end"])))
    return F.when(F.size(ranges) == 0, text).otherwise(F.array_join(lines, "\n"))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (start:end, comma-joined), kept (the text that stays) per row of ``docs``.

    Lines end at a line feed. A null text stays null, an empty one has one empty line, and blank lines count no words.
    Of equal runs inside one document the first stays. Rows that repeat doc_id and text are one document and get the
    same result; other rows of one doc_id sort by a hash of their text. A null doc_id comes after all others.
    """
    out, (n_lines, n_removed, ranges) = with_results(docs.select("doc_id", "text"), repeated_runs(docs, min_words), ["n_lines", "n_removed", "ranges"])
    spans = F.array_join(F.transform(ranges, lambda r: F.concat_ws(":", r["start"].cast("string"), r["end"].cast("string"))), ",")
    return out.select("doc_id", n_lines, n_removed, spans.alias("removed"), kept_text(F.col("text"), F.col(ranges)).alias("kept"))


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` without the lines ``line_dedup`` removes; a document of which no line is left goes.

    ``n_chars``, where there is such a column, is the length of the new text.
    """
    found = repeated_runs(docs, min_words)
    out, (n_lines, n_removed, ranges) = with_results(docs, found, ["n_lines", "n_removed", "ranges"])
    out = out.where((F.col(n_removed) == 0) | (F.col(n_removed) < F.col(n_lines)))
    new = kept_text(F.col("text"), F.col(ranges))
    if "n_chars" in out.columns:
        kind = dict(out.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(F.col(n_removed) > 0, F.length(new).cast(kind)).otherwise(F.col("n_chars")))
    return out.withColumn("text", new).select(*docs.columns)
