"""Secret scans over a trigram inverted index.

Each rule's regex gives a Boolean trigram query: any of several sets of trigrams, of which a match holds one set
whole. Postings of the trigrams in the queries are intersected; only candidates are verified by the regex. Rules
without mandatory trigrams scan all texts.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_back, identity, stored, text_of, with_results


@dataclass(frozen=True)
class Rule:
    """A kind of secret: what is matched, and the least length of group ``group`` (0: the match) for it to count."""

    kind: str
    pattern: str
    group: int
    least: int


BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("code_host", r"gh[opsu]_[A-Za-z0-9]+", 0, 30),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_.-]+", 0, 30),
)
WIDEST = 64  # literal alternatives of one part of a pattern


def _literals(items: Sequence) -> tuple[set[str] | None, list[set[str]]]:
    """Of a parsed pattern: all texts it can match, lower-cased, if they are few; else None and, in order, sets of
    literals of which every match contains one."""
    parts: list[set[str]] = []
    now: set[str] = {""}
    whole = True
    for op, arg in items:
        name = str(op)
        got: set[str] | None = None
        inner: list[set[str]] = []
        if name == "LITERAL":
            got = {chr(arg).lower()}
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            got = {chr(c).lower() for _, c in arg}
        elif name == "SUBPATTERN":
            got, inner = _literals(arg[3])
        elif name == "BRANCH":
            found = [_literals(x)[0] for x in arg[1]]
            got = None if any(x is None for x in found) else set().union(*found)
        elif name == "MAX_REPEAT" and arg[1] == 1:
            one = _literals(arg[2])[0]
            got = None if one is None else one | ({""} if arg[0] == 0 else set())
        elif name == "MAX_REPEAT" and arg[0] == arg[1] <= 8:
            got, inner = _literals(list(arg[2]) * arg[0])
        if got is not None and len(now) * len(got) <= WIDEST:
            now = {a + b for a in now for b in got}
            continue
        whole = False
        parts += [now, *inner]
        now = got if got is not None else {""}
    return (now, []) if whole else (None, [*parts, now])


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of mandatory trigrams: each match of the pattern, lower-cased, holds all of one of them.

    An empty list says that the pattern has no mandatory trigram.
    """
    whole, parts = _literals(re._parser.parse(pattern))
    choices = []
    for texts in [whole] if whole is not None else parts:
        grams = {frozenset(t[i : i + 3] for i in range(len(t) - 2)) for t in texts}
        if frozenset() not in grams:
            choices.append({g for g in grams if not any(o < g for o in grams)})
    if not choices:
        return []
    out = choices[0]
    for more in choices[1:]:
        if len(out) * len(more) <= WIDEST:
            out = {a | b for a in out for b in more}
    return sorted((g for g in out if not any(o < g for o in out)), key=sorted)


def postings(docs: DataFrame, grams: Sequence[str]) -> DataFrame:
    """(gram, k_id, k_text) for each of ``grams`` that the lower-cased text of a document contains."""
    low = docs.select(*identity(), F.lower(text_of()).alias("low"))
    held = F.filter(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]), lambda g: g.isNotNull())
    return low.select("k_id", "k_text", F.explode(held).alias("gram"))


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(k_id, k_text, kinds): the rules whose trigram query the postings of a document satisfy."""
    terms = [(g, kind, n, len(gs)) for kind, alts in queries.items() for n, gs in enumerate(alts) for g in sorted(gs)]
    spec = index.sparkSession.createDataFrame(terms, "gram string, kind string, alt int, size int")
    full = (
        index.distinct()
        .join(F.broadcast(spec), "gram")  # as many rows as the rules have trigrams
        .groupBy("k_id", "k_text", "kind", "alt")
        .agg(F.count("*").alias("n"), F.first("size").alias("size"))
        .where("n = size")
    )
    return full.groupBy("k_id", "k_text").agg(F.collect_set("kind").alias("kinds"))


def matches(text: Column, rule: Rule) -> Column:
    """Array of (start, end) of the rule's leftmost non-overlapping matches that are long enough, in code points."""
    pattern = _long_enough(rule)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group))
    between = F.transform(F.split(text, pattern, -1), F.length)
    lengths = F.transform(whole, F.length)
    steps = F.arrays_zip(F.slice(between, 1, F.size(whole)).alias("gap"), lengths.alias("len"), F.transform(part, F.length).alias("own"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        end = acc["at"] + s["gap"] + s["len"]
        span = F.struct((acc["at"] + s["gap"]).alias("start"), end.alias("end"))
        kept = F.when(s["own"] >= rule.least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(end.alias("at"), kept.alias("spans"))

    return F.aggregate(steps, start, step, lambda acc: acc["spans"])


def scan_secrets(docs: DataFrame, rules: Sequence[Rule] = BASE_RULES + MORE_RULES) -> DataFrame:
    """(k_id, k_text, spans) of the documents that hold a secret; spans: array of (start, kind_no, kind, end), sorted.

    Starts and ends count code points, ends are exclusive. Null, empty and blank texts hold none.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    order = {r.kind: n for n, r in enumerate(rules)}
    tagged = lambda spans, kind: F.transform(
        spans, lambda x: F.struct(x["start"].alias("start"), F.lit(order[kind]).alias("kind_no"), F.lit(kind).alias("kind"), x["end"].alias("end"))
    )
    found = []
    full = [r for r in rules if not queries[r.kind]]
    if full:
        hit = reduce(lambda a, b: a | b, [F.rlike(text_of(), F.lit(_long_enough(r))) for r in full])
        read = docs.where(hit).select(*identity(), text_of().alias("t"))
        found.append(read.select("k_id", "k_text", F.concat(*[tagged(matches(F.col("t"), r), r.kind) for r in full]).alias("spans")))
    indexed = [r for r in rules if queries[r.kind]]
    if indexed:
        grams = sorted({g for r in indexed for alt in queries[r.kind] for g in alt})
        index = stored(postings(docs, grams))
        df = {r["gram"]: r["count"] for r in index.groupBy("gram").count().collect()}  # one row per trigram of the rules
        rarest = sorted({min(sorted(alt), key=lambda g: df.get(g, 0)) for r in indexed for alt in queries[r.kind]})
        low = F.lower(text_of())
        # Only texts with the rarest trigram of some alternative can be candidates; others stay out of the join.
        read = docs.where(reduce(lambda a, b: a | b, [F.contains(low, F.lit(g)) for g in rarest])).select(*identity(), text_of().alias("t"))
        read = read.dropDuplicates(["k_id", "k_text"]).join(candidates(index, {r.kind: queries[r.kind] for r in indexed}), ["k_id", "k_text"])
        none = F.array().cast("array<struct<start:int,kind_no:int,kind:string,end:int>>")
        spans = [F.when(F.array_contains("kinds", r.kind), tagged(matches(F.col("t"), r), r.kind)).otherwise(none) for r in indexed]
        found.append(read.select("k_id", "k_text", F.concat(*spans).alias("spans")))
    rows = reduce(DataFrame.unionByName, found).where(F.size("spans") > 0).select("k_id", "k_text", F.explode("spans").alias("span")).distinct()
    return rows.groupBy("k_id", "k_text").agg(F.array_sort(F.collect_list("span")).alias("spans"))


def _long_enough(rule: Rule) -> str:
    """A pattern that is one repeated class finds the same long matches when it asks for the least length at once."""
    return re.sub(r"\+$", "{%d,}" % rule.least, rule.pattern) if re.fullmatch(r"\[[^\]]+\]\+", rule.pattern) else rule.pattern


def span_text(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def secret_report(docs: DataFrame, rules: Sequence[Rule] = BASE_RULES + MORE_RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row; see ``scan_secrets``."""
    base = [r.kind for r in BASE_RULES]
    rows, (spans,) = with_results(docs.select("doc_id", "text"), stored(scan_secrets(docs, rules)), ["spans"], "left")
    rows = rows.select("doc_id", F.coalesce(spans, F.array().cast("array<struct<start:int,kind_no:int,kind:string,end:int>>")).alias("s"))
    of = lambda *kinds: F.filter("s", lambda x: x["kind"].isin(*kinds))
    return rows.select(
        "doc_id",
        *[F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in base],
        F.sha2(span_text(of(*base)).cast("binary"), 256).alias("base_sha256"),
        span_text(F.col("s")).alias("spans"),
    )
