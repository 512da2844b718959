"""Pieces of DuckDB SQL that several twins share."""

from __future__ import annotations

from ..functions.tokens import STATUS


def LIST(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def tokens_sql(column: str) -> str:
    return f"list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array({column}, '\\s+'), lambda w: regexp_replace(lower(w), '[^\\p{{L}}\\p{{N}}_]', '', 'g')), lambda t: t <> '')))"


def raw_sql(kind: str, t: str) -> str:
    """Raw markers of one kind of the token list ``t``."""
    if kind == "status":
        return f"list_sort(list_filter({t}, lambda x: x in {LIST(STATUS)}))"
    if kind == "page":
        return f"list_sort(list_filter({t}, lambda x: starts_with(x, 'page') or (list_contains({t}, 'page') and (regexp_matches(x, '^[0-9]+$') or contains(x, '/')))))"
    return f"list_sort(list_filter({t}, lambda x: starts_with(x, '{kind}')))"


def strict_sql(kind: str, t: str) -> str:
    """Strict markers of one kind of the token list ``t``."""
    if kind == "status":
        return raw_sql(kind, t)
    numbered = f"list_filter({t}, lambda x: regexp_matches(x, '^{kind}[0-9]+[a-z]?$'))"
    if kind != "page":
        return f"list_sort({numbered})"
    bare = f"list_transform(list_filter({t}, lambda x: list_contains({t}, 'page') and regexp_matches(x, '^[0-9]+$')), lambda x: 'page' || x)"
    return f"list_sort(list_distinct(list_concat({numbered}, {bare})))"
