"""Identifiers. The dialects disagree on purpose: each belongs to one kind of id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: id prefixes of entity types
PREFIXES = {"organizations": "org", "offices": "office", "roles": "role", "legislation_refs": "legislation", "named_docs": "named_doc"}


def _prefix(kind: Column, prefixes: dict[str, str]) -> Column:
    out = F.lit("entity")
    for k, p in prefixes.items():
        out = F.when(kind == k, p).otherwise(out)
    return out


def safe_id(c: Column) -> Column:
    """Lower case; letters, digits, ``_ - .`` stay, any other character becomes ``_``; outer ``_`` go; empty is ``unknown``."""
    kept = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_.-]", "_")
    bare = F.regexp_replace(kept, "^_+|_+$", "")
    return F.when(bare == "", "unknown").otherwise(bare)


def node_id(kind: str, key: Column) -> Column:
    return F.concat(F.lit(kind + ":"), safe_id(key))


def collapsed_slug(c: Column) -> Column:
    """Runs of anything but ``a-z0-9`` become one ``_``."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def entity_id(name: Column, kind: Column) -> Column:
    return F.concat(_prefix(kind, PREFIXES), F.lit(":"), collapsed_slug(name))


def sync_id(name: Column, kind: Column) -> Column:
    return F.concat(_prefix(kind, PREFIXES | {"named_docs": "doc"}), F.lit(":"), collapsed_slug(name))


def layer_slug(c: Column) -> Column:
    """``collapsed_slug`` of at most 80 characters; empty is ``unknown``."""
    s = F.substring(collapsed_slug(c), 1, 80)
    return F.when(s == "", "unknown").otherwise(s)


def dropping_slug(c: Column) -> Column:
    """Punctuation is dropped; blanks, ``-`` and ``_`` become ``_``."""
    dropped = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"[^a-z0-9\s_-]", "")
    return F.regexp_replace(F.regexp_replace(dropped, r"[\s_-]+", "_"), "^_+|_+$", "")
