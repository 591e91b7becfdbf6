"""Page ranges and chunk metadata (``MAP<STRING, STRING>``; arrays are stored as JSON text)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import col, strip

EMPTY_MAP = "map<string,string>"


def page_start(start: Column | str) -> Column:
    return F.coalesce(F.nullif(col(start), F.lit(0)), F.lit(1))


def page_end(start: Column | str, end: Column | str) -> Column:
    return F.greatest(page_start(start), F.coalesce(col(end), page_start(start)))


def page_list(start: Column | str, end: Column | str) -> Column:
    """Every page from start to end; an end before the start counts as the start."""
    return F.sequence(page_start(start), page_end(start, end))


def page_label(start: Column | str, end: Column | str, prefix: str = "p.", again: str = "p.") -> Column:
    """``p.3~p.5``, or ``Page 3~5`` with ``page_label(s, e, "Page ", "")``."""
    s, e = page_start(start), page_end(start, end)
    first = F.concat(F.lit(prefix), s.cast("string"))
    return F.when(e > s, F.concat(first, F.lit("~" + again), e.cast("string"))).otherwise(first)


def no_metadata() -> Column:
    return F.create_map().cast(EMPTY_MAP)


def custom_metadata(metadata: Column | str) -> Column:
    """The entries whose key is not reserved."""
    kept = F.map_filter(col(metadata), lambda k, v: ~k.isin(*P.RESERVED_METADATA_KEYS))
    return F.coalesce(kept, no_metadata())


def without_image_keys(metadata: Column | str) -> Column:
    kept = F.map_filter(col(metadata), lambda k, v: ~k.isin(*P.IMAGE_METADATA_KEYS))
    return F.coalesce(kept, no_metadata())


def overlay(base: Column | str, incoming: Column | str) -> Column:
    """Both maps in one; where both have a key the incoming value stays."""
    b = F.coalesce(col(base), no_metadata())
    i = F.coalesce(col(incoming), no_metadata())
    return F.map_concat(F.map_filter(b, lambda k, v: ~F.map_contains_key(i, k)), i)


def sync_pages(metadata: Column | str, start: Column | str, end: Column | str) -> Column:
    """Metadata with ``page``, ``page_start``, ``page_end`` and ``pages`` set from the chunk."""
    s, e = page_start(start).cast("string"), page_end(start, end).cast("string")
    pages = F.create_map(
        F.lit("page"), s,
        F.lit("page_start"), s,
        F.lit("page_end"), e,
        F.lit("pages"), F.to_json(page_list(start, end)),
    )
    return overlay(metadata, pages)


def merge_metadata(base: Column | str, incoming: Column | str, start: Column | str, end: Column | str) -> Column:
    """Custom entries of both sides, incoming first, with the page keys of the target chunk."""
    return sync_pages(overlay(custom_metadata(base), custom_metadata(incoming)), start, end)


def clean_key(key: str) -> str | None:
    """A custom key ready for use, or None where it is empty or reserved."""
    k = key.strip()
    return None if not k or k in P.RESERVED_METADATA_KEYS else k


def usable_key(key: Column | str) -> Column:
    k = strip(key)
    return F.when((F.length(k) > 0) & ~k.isin(*P.RESERVED_METADATA_KEYS), k)
