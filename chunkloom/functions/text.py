"""Text functions over Columns. Everything here stays inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column | str) -> Column:
    """Remove white space of any kind at both ends."""
    return F.trim(col(text), F.lit(P.WHITE_SPACE))


def is_blank(text: Column | str) -> Column:
    return F.coalesce(F.length(strip(text)) == 0, F.lit(True))


def non_empty(text: Column | str) -> Column:
    """The text, or null where it is the empty string."""
    return F.nullif(col(text), F.lit(""))


def words_of(text: Column | str) -> Column:
    """Array of words of a text that is not blank."""
    return F.split(strip(text), P.SPACE_RUN)


def word_count(text: Column | str) -> Column:
    return F.when(F.length(strip(text)) > 0, F.size(words_of(text))).otherwise(0)


def tokens_from_counts(chars: Column, words: Column) -> Column:
    return F.greatest(F.floor(chars / 2), F.floor(words * F.lit(2.2))).cast("int")


def token_estimate(text: Column | str) -> Column:
    """Estimated token count: the larger of half the characters and 2.2 per word; 0 for no text."""
    t = col(text)
    return F.coalesce(tokens_from_counts(F.length(t), word_count(t)), F.lit(0))


def token_estimate_trimmed(text: Column | str) -> Column:
    """The estimate over the stripped text, as an editor shows it."""
    return token_estimate(strip(text))


def join_hyphenated(text: Column | str) -> Column:
    """Rejoin words that a line end split at a hyphen."""
    t = col(text)
    return F.when(t.rlike(P.HYPHEN_AT_LINE_END), F.regexp_replace(t, P.HYPHEN_BREAK, "$1$2")).otherwise(t)


def embedding_text(text: Column | str) -> Column:
    """Search text: hyphens repaired, each white space run one space, stripped."""
    one_line = F.regexp_replace(join_hyphenated(text), P.SPACE_RUN, " ")
    return F.coalesce(F.trim(one_line), F.lit(""))


def context_text(text: Column | str) -> Column:
    """Reading text: paragraphs kept apart, wrapped lines joined, list and clause lines kept on their own line."""
    t = strip(join_hyphenated(text))
    # Blank lines separate paragraphs.
    t = F.regexp_replace(t, r"(?U)[^\S\n]*+\n[^\S\n]*+", "\n")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    # A single line end becomes a space unless the next line opens a list item, clause or heading.
    t = F.regexp_replace(t, r"(?U)([^\n])\n(?!\n|" + P.STRUCTURAL_LINE + ")", "$1 ")
    return F.coalesce(t, F.lit(""))


def weighted_units(text: str, legal: bool = False, max_tokens: int = P.CHILD_BUDGET) -> Column:
    """Array of ``struct(s, w)``: units of at most ``max_tokens`` with their token estimates.

    ``text`` is a column name or SQL expression. A single word over the budget stays whole.
    """
    return F.expr(_sql_units(text, legal, max_tokens))


def text_units(text: str, legal: bool = False, max_tokens: int = P.CHILD_BUDGET) -> Column:
    """Array of units of at most ``max_tokens`` (a single longer word stays whole)."""
    return F.expr(f"transform({_sql_units(text, legal, max_tokens)}, u -> u.s)")


def split_units(text: str, legal: bool = False) -> Column:
    """Array of clause, line and sentence pieces of any length, in order."""
    return F.expr(_sql_pieces(text, legal))


def split_long_unit(unit: str, max_tokens: int = P.CHILD_BUDGET) -> Column:
    """Array of parts of one unit, cut after commas and semicolons and, where that is not enough, between words."""
    return F.expr(_sql_long_unit(unit, max_tokens))


# The larger array expressions are SQL text: one call builds them, lambdas nest readably.


def _quote(value: str) -> str:
    return "'" + "".join(f"\\u{ord(c):04x}" for c in value) + "'"


def _raw(pattern: str) -> str:
    return f"r'{pattern}'"


def _sql_strip(x: str) -> str:
    return f"trim(BOTH {_quote(P.WHITE_SPACE)} FROM {x})"


def _sql_counts_tokens(chars: str, words: str) -> str:
    return f"int(greatest(floor(({chars}) / 2), floor(({words}) * 2.2D)))"


def _sql_words(x: str) -> str:
    """Word count of a stripped text that is not empty."""
    return f"size(split({x}, {_raw(P.SPACE_RUN)}))"


def _sql_tokens(x: str) -> str:
    return _sql_counts_tokens(f"length({x})", _sql_words(x))


def _sql_let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _sql_pieces(text: str, legal: bool) -> str:
    breaks = (f"{P.CLAUSE_BREAK}|" if legal else "") + P.SENTENCE_BREAK
    hyphen = (
        f"if({text} RLIKE {_raw(P.HYPHEN_AT_LINE_END)}, "
        f"regexp_replace({text}, {_raw(P.HYPHEN_BREAK)}, '$1$2'), {text})"
    )
    pieces = f"split({_sql_strip(hyphen)}, {_raw('(?U)' + breaks)})"
    return f"filter(transform({pieces}, p -> {_sql_strip('p')}), p -> length(p) > 0)"


def _sql_units(text: str, legal: bool, max_tokens: int) -> str:
    kept = _sql_pieces(text, legal)
    weighed = f"transform({kept}, s -> named_struct('s', s, 'w', {_sql_tokens('s')}))"
    parts = f"transform({_sql_long_unit('u.s', max_tokens)}, s -> named_struct('s', s, 'w', {_sql_tokens('s')}))"
    fitted = (
        f"if(exists(us, u -> u.w > {max_tokens}), "
        f"flatten(transform(us, u -> if(u.w > {max_tokens}, {parts}, array(u)))), us)"
    )
    return _sql_let(weighed, "us", fitted)


def _sql_long_unit(unit: str, max_tokens: int) -> str:
    # Items are the pieces between soft breaks, or the words of a piece that is itself too long; f marks a forced cut.
    item = f"named_struct('s', %s, 'n', length(%s), 'k', {_sql_words('%s')}, 'f', %s)"
    words = f"transform(split(p, {_raw(P.SPACE_RUN)}), (x, i) -> named_struct('s', x, 'n', length(x), 'k', 1, 'f', i = 0))"
    pieces = f"filter(transform(split({unit}, {_raw('(?U)' + P.SOFT_BREAK)}), p -> {_sql_strip('p')}), p -> length(p) > 0)"
    items = (
        f"flatten(transform({pieces}, p -> if({_sql_tokens('p')} > {max_tokens}, {words}, "
        f"array({item % ('p', 'p', 'p', 'false')}))))"
    )
    # Greedy fold: length and word count of the open part, and where each part starts.
    over = _sql_counts_tokens("a.n + x.n + 1", "a.k + x.k") + f" > {max_tokens}"
    cut = f"(a.i = 0 OR x.f OR {over})"
    step = (
        "named_struct('i', a.i + 1, 'n', if(c, x.n, a.n + x.n + 1), 'k', if(c, x.k, a.k + x.k), "
        "'at', if(c, array_append(a.at, a.i), a.at))"
    )
    fold = (
        "aggregate(xs, named_struct('i', 0, 'n', 0, 'k', 0, 'at', array()::array<int>), "
        f"(a, x) -> {_sql_let(cut, 'c', step)}, a -> array_append(a.at, a.i))"
    )
    spans = (
        f"transform(slice(at, 1, size(at) - 1), (b, j) -> "
        f"array_join(transform(slice(xs, b + 1, at[j + 1] - b), x -> x.s), ' '))"
    )
    return _sql_let(items, "xs", _sql_let(fold, "at", spans))


def strip_fence(text: Column | str) -> Column:
    """Drop a code fence that wraps a whole answer."""
    t = strip(text)
    inner = F.regexp_extract(t, r"(?sU)^```(?:markdown|text)?\s*\n(.*?)\n```$", 1)
    fenced = t.rlike(r"(?sU)^```(?:markdown|text)?\s*\n(.*?)\n```$")
    return F.when(fenced, strip(inner)).otherwise(t)


def split_midpoint(text: Column | str) -> Column:
    """Struct (first, second): the text halved at the delimiter nearest its middle."""
    t = F.coalesce(col(text), F.lit(""))

    def at_delimiter(mark: str) -> Column:
        width = len(mark)
        parts = F.split(t, mark.replace(".", r"\."), -1)
        ends = F.aggregate(
            F.slice(parts, 1, F.size(parts) - 1),
            F.array().cast("array<int>"),
            lambda acc, p: F.concat(
                acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + F.length(p) + width)
            ),
        )
        best = F.array_min(
            F.transform(ends, lambda e, i: F.struct(F.abs(e - F.length(t) / 2).alias("d"), i.alias("i"), e.alias("e")))
        )["e"]
        return let(
            best,
            lambda at: F.struct(
                strip(F.substring(t, F.lit(1), at - width)).alias("first"),
                strip(F.substring(t, at + 1, F.length(t))).alias("second"),
            ),
        )

    middle = F.floor(F.length(t) / 2).cast("int")
    # Positions are 0-based; -1 where there is no space on that side.
    left = middle - F.instr(F.reverse(F.substring(t, F.lit(1), middle + 1)), " ") + 1
    left = F.when(F.instr(F.substring(t, F.lit(1), middle + 1), " ") > 0, left).otherwise(-1)
    right = F.instr(F.substring(t, middle + 1, F.length(t)), " ") - 1
    right = F.when(right >= 0, right + middle).otherwise(-1)
    cut = (
        F.when((left >= 0) & (right >= 0), F.when(middle - left < right - middle, left).otherwise(right))
        .when(left >= 0, left)
        .when(right >= 0, right)
        .otherwise(middle)
    )
    at_space = F.struct(
        strip(F.substring(t, F.lit(1), cut)).alias("first"),
        strip(F.substring(t, cut + 1, F.length(t))).alias("second"),
    )
    return (
        F.when(t.contains("\n\n"), at_delimiter("\n\n"))
        .when(t.contains("\n"), at_delimiter("\n"))
        .when(t.contains(". "), at_delimiter(". "))
        .otherwise(at_space)
    )


def guess_strategy(title: Column | str) -> Column:
    """``legal`` where the title carries a legal word, else ``general``."""
    return F.when(col(title).rlike(P.LEGAL_TITLE), "legal").otherwise("general")


def breadcrumb_string(breadcrumbs: Column | str) -> Column:
    return F.array_join(F.coalesce(col(breadcrumbs), F.array().cast("array<string>")), " > ")


def parent_context(breadcrumbs: Column | str, parent_text: Column | str) -> Column:
    """Parent text headed by its breadcrumb, unless it already starts with it."""
    trail = breadcrumb_string(breadcrumbs)
    head = F.concat(F.lit("["), trail, F.lit("]"))
    body = F.coalesce(col(parent_text), F.lit(""))
    return F.when(
        (F.length(trail) > 0) & ~F.startswith(body, head), strip(F.concat(head, F.lit("\n"), body))
    ).otherwise(strip(body))
