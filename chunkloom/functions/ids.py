"""Deterministic ids and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import col, let, non_empty, strip


def uuid5_hex(name: Column | str, namespace_hex: str) -> Column:
    """32 hex digits of the name-based (SHA-1) UUID of a string."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(col(name), "UTF-8")))

    def marked(digest: Column) -> Column:
        variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
        return F.concat(
            F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3), variant, F.substring(digest, 18, 15)
        )

    # In a branch of a condition Spark would work out the digest for every part of it.
    return let(digest, marked)


def dashed(hex32: Column) -> Column:
    return let(
        hex32,
        lambda h: F.concat_ws(
            "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)
        ),
    )


def is_full_doc_id(name: Column | str) -> Column:
    return col(name).rlike(r"^doc_[\p{L}\p{N}]{32}$")


def doc_id(name: Column | str, urn_prefix: str = P.DOC_URN_PREFIX) -> Column:
    """Document id of a name: ids and short plain names are kept, other names hashed, no name gets a random id."""
    clean = strip(name)
    plain = (
        clean.rlike(r"^[a-zA-Z0-9_-]{1,40}$") & ~F.lower(clean).endswith(".pdf") & ~clean.startswith("d_")
    )
    return (
        F.when(F.coalesce(F.length(col(name)), F.lit(0)) == 0, F.concat(F.lit("doc_"), F.replace(F.uuid(), F.lit("-"))))
        .when(is_full_doc_id(clean) | plain, clean)
        .otherwise(
            F.concat(F.lit("doc_"), uuid5_hex(F.concat(F.lit(urn_prefix), clean), P.UUID_NAMESPACE_URL))
        )
    )


def point_id(chunk_id: Column | str) -> Column:
    """Id of an index point: UUIDs are kept in canonical form, other strings are hashed to one.

    Integers stay as they are: pass them cast to string through ``numeric_point_id``.
    """
    c = col(chunk_id).cast("string")
    bare = F.lower(F.replace(F.trim(F.replace(F.replace(c, F.lit("urn:")), F.lit("uuid:")), F.lit("{}")), F.lit("-")))
    # No shorter string is a UUID.
    is_uuid = (F.length(c) >= 32) & bare.rlike("^[0-9a-f]{32}$")
    return F.when(is_uuid, dashed(bare)).otherwise(dashed(uuid5_hex(c, P.UUID_NAMESPACE_DNS)))


def numeric_point_id(number: Column | str) -> Column:
    return col(number).cast("string")


def token_hash(token: Column | str) -> Column:
    """Unsigned 32-bit hash of a token: the first 8 hex digits of its SHA-256."""
    return F.conv(F.substring(F.sha2(col(token), 256), 1, 8), 16, 10).cast("bigint")


def _numbered(doc: Column | str, letter: str, number: Column, digits: int) -> Column:
    # Formats are slow; numbers that fit the digits, as nearly all do, are padded instead.
    n = number.cast("bigint")
    fits = col(doc).isNotNull() & n.between(0, 10**digits - 1)
    padded = F.concat(col(doc), F.lit(f"_{letter}"), F.lpad(n.cast("string"), digits, "0"))
    return F.when(fits, padded).otherwise(F.format_string(f"%s_{letter}%0{digits}d", col(doc), n))


def section_id(doc: Column | str, number: Column) -> Column:
    return _numbered(doc, "s", number, 2)


def parent_id(doc: Column | str, number: Column) -> Column:
    return _numbered(doc, "p", number, 4)


def chunk_id(doc: Column | str, number: Column) -> Column:
    return _numbered(doc, "c", number, 4)


def doc_of_chunk(chunk: Column | str) -> Column:
    """The part of a chunk id before its last ``_c``; empty where there is none."""
    return strip(F.regexp_extract(col(chunk), r"(?s)^(.*)_c", 1))


def backfilled_doc_id(doc: Column | str, breadcrumbs: Column | str, chunk: Column | str) -> Column:
    """Document id of an imported chunk: its own, else its first breadcrumb, else the prefix of its id."""
    first = F.try_element_at(col(breadcrumbs), F.lit(1))
    return F.coalesce(
        non_empty(doc), F.when(first.isNotNull(), strip(first)), doc_of_chunk(chunk)
    )


def _display(identifier: Column, letter: str, shown: str) -> Column:
    number = F.regexp_extract(identifier, rf"(?i)_{letter}(\d+)$", 1)
    tail = F.substring_index(identifier, "_", -1)
    return F.when(F.length(number) > 0, F.concat(F.lit(shown), number)).otherwise(
        F.coalesce(non_empty(tail), identifier)
    )


def display_chunk_id(identifier: Column | str) -> Column:
    return F.coalesce(_display(col(identifier), "c", "c"), F.lit(""))


def display_section_id(identifier: Column | str) -> Column:
    return F.coalesce(_display(col(identifier), "s", "s"), F.lit(""))


def display_parent_id(identifier: Column | str) -> Column:
    short = _display(col(identifier), "p", "P")
    return F.coalesce(F.regexp_replace(short, r"(?i)^p(\d+)$", "P$1"), F.lit(""))


def display_id(identifier: Column | str) -> Column:
    """Short form of any id: ``c0001``, ``P0001`` or ``s01``."""
    i = col(identifier)
    return (
        F.when(i.rlike(r"(?i)(^|_)p\d+$"), display_parent_id(i))
        .when(i.rlike(r"(?i)(^|_)s\d+$"), display_section_id(i))
        .otherwise(display_chunk_id(i))
    )
