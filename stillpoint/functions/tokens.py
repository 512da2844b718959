"""Tokens of recognised text, and sets of them, as column expressions. Sets are sorted arrays without repeats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of browser and window chrome, and words that tell a state.
CHROME = ["backlog", "brainstorm", "browser", "chrome", "dashboard", "figm", "figma", "file", "home", "microsoft", "teams", "tab", "tabs", "window"]
STATUS = ["approved", "approve", "complete", "completed", "confirmed", "draft", "pending", "rejected", "submitted"]
MARKER = r"^(page|option|section|step|status|revision)?[0-9]+[a-z]?$"
UUIDISH = r"^[0-9a-f]{6,}([0-9a-f-]{4,})?$"
#: Letters, digits and underscore in any script, as Java and RE2 both read it.
WORD = r"\p{L}\p{N}_"


def as_set(a: Column) -> Column:
    return F.array_sort(F.array_distinct(a))


def words(text: Column) -> Column:
    """Split at white space; no empty words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def normalized(word: Column) -> Column:
    """Lower case, with everything but letters, digits and underscores taken out."""
    return F.regexp_replace(F.lower(word), f"[^{WORD}]", "")


def token_set(text: Column) -> Column:
    return as_set(F.filter(F.transform(words(text), normalized), lambda t: t != ""))


def rescue_token(word: Column) -> Column:
    """Lower case, keeping dots and hyphens that hold references together."""
    return F.regexp_replace(F.lower(word), f"[^{WORD}.-]", "")


def rescue_token_set(text: Column, most: int = 120) -> Column:
    """Tokens for finding references: no links, no local paths, none over 48 characters; the first ``most``, then as a set."""
    kept = F.filter(
        F.transform(words(text), rescue_token),
        lambda t: (t != "") & (F.char_length(t) <= 48) & ~t.startswith("http") & ~t.startswith("www") & ~t.contains("users") & ~t.contains("downloads"),
    )
    return as_set(F.slice(kept, 1, most))


def clean_tokens(tokens: Column) -> Column:
    """The set without chrome, identifiers, paths and overlong tokens; status words and numbered markers always stay."""
    path = lambda t: t.contains("users") | t.contains("downloads") | t.contains("http") | t.contains("www")
    noise = lambda t: t.isin(CHROME) | (t.rlike(UUIDISH) & t.rlike("[0-9]")) | path(t) | (F.char_length(t) > 36)
    return F.filter(tokens, lambda t: (t != "") & (t.isin(STATUS) | t.rlike(MARKER) | ~noise(t)))


def evidence_tokens(text: Column) -> Column:
    """Tokens of a line, in order: runs of a-z, 0-9 and ._/- that begin with a letter or digit, ends trimmed."""
    found = F.regexp_extract_all(F.regexp_replace(F.lower(text), "ß", "ss"), F.lit("[a-z0-9][a-z0-9._/-]*"), 0)
    return F.filter(F.transform(found, lambda t: F.regexp_replace(t, "[._/-]+$", "")), lambda t: t != "")


def line_signatures(text: Column, lines: int = 80, per_line: int = 12) -> Column:
    """The first tokens of each line that has any, of the first ``lines`` such lines, without repeats, in order."""
    each = F.transform(F.split(F.coalesce(text, F.lit("")), "\r\n|\r|\n"), evidence_tokens)
    full = F.slice(F.filter(each, lambda t: F.size(t) > 0), 1, lines)
    return F.array_distinct(F.transform(full, lambda t: F.array_join(F.slice(t, 1, per_line), " ")))


def jaccard(a: Column, b: Column) -> Column:
    """1 for two empty sets, 0 if one is empty."""
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
        .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .otherwise(F.size(F.array_intersect(a, b)).cast("double") / F.size(F.array_union(a, b)))
    )


def jaccard_of_sets(a: Column, b: Column) -> Column:
    """As jaccard, of arrays without repeats: the union's size follows from the intersection's."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both.cast("double") / (F.size(a) + F.size(b) - both))


def density_veto(a: Column, b: Column) -> Column:
    """Both sets hold something, one has at least twice as many tokens, and some the other lacks."""
    big, small = F.greatest(F.size(a), F.size(b)), F.least(F.size(a), F.size(b))
    extra = F.when(F.size(a) >= F.size(b), F.size(F.array_except(a, b))).otherwise(F.size(F.array_except(b, a)))
    return (small > 0) & (big >= 2 * small) & (extra > 0)
