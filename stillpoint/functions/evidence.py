"""Evidence: markers of pages, options, sections and status in token sets, and what differences between them mean."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tokens import STATUS, as_set, density_veto, evidence_tokens, jaccard

# Words that tell the state of a form.
FORM_STATE = ["approved", "approval", "approve", "completed", "complete", "date", "draft", "error", "field", "mandatory", "please", "required", "selection", "signed", "status", "validation", "workflow"]
# Words that refer to a source.
SOURCES = ["figma", "pdf", "source", "mockup", "design", "document", "doc", "file"]
# Caption words that protect a sample.
PROTECTIVE = ["approval", "dashboard", "dialog", "document", "form", "modal", "page", "pdf", "screenshot", "software interface", "status", "table", "title", "webpage"]
# Vocabularies of the field signatures.
SIGNATURE_STATUS = ["approved", "approve", "complete", "completed", "draft", "pending", "rejected", "submitted"]
VALUES = ["false", "na", "n/a", "no", "none", "true", "yes", *SIGNATURE_STATUS]
REFERENCES = ["attachment", "artifact", "design", "doc", "document", "file", "form", "image", "link", "mockup", "pdf", "record", "reference", "report", "screenshot", "source", "spreadsheet", "url"]
DATE_TOKEN = r"^[0-9]{1,2}[a-z]{3}[0-9]{4}$"
DATE_VALUE = r"\b(?:[0-9]{1,2}[a-z]{3}[0-9]{4}|[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}|[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4})\b"
KINDS = ("page", "option", "section", "status")


def status_words(tokens: Column) -> Column:
    return as_set(F.filter(tokens, lambda t: t.isin(STATUS)))


def raw_markers(tokens: Column) -> Column:
    """struct(page, option, section, status): by prefix; bare numbers and fractions are pages where the word page stands."""
    numbers = F.when(F.array_contains(tokens, "page"), F.filter(tokens, lambda t: t.rlike("^[0-9]+$") | t.contains("/")))
    page = F.array_union(F.filter(tokens, lambda t: t.startswith("page")), F.coalesce(numbers, F.array().cast("array<string>")))
    return F.struct(
        as_set(page).alias("page"),
        as_set(F.filter(tokens, lambda t: t.startswith("option"))).alias("option"),
        as_set(F.filter(tokens, lambda t: t.startswith("section"))).alias("section"),
        status_words(tokens).alias("status"),
    )


def strict_markers(tokens: Column) -> Column:
    """As raw_markers, but only the word with a number; a bare number beside the word page becomes page<number>."""
    of = lambda word: F.filter(tokens, lambda t: t.rlike(f"^{word}[0-9]+[a-z]?$"))
    bare = F.when(F.array_contains(tokens, "page"), F.transform(F.filter(tokens, lambda t: t.rlike("^[0-9]+$")), lambda t: F.concat(F.lit("page"), t)))
    return F.struct(
        as_set(F.array_union(of("page"), F.coalesce(bare, F.array().cast("array<string>")))).alias("page"),
        as_set(of("option")).alias("option"),
        as_set(of("section")).alias("section"),
        status_words(tokens).alias("status"),
    )


def _any(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out | t
    return out


def _all(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out & t
    return out


def has_markers(markers: Column) -> Column:
    return _any([F.size(markers[k]) > 0 for k in KINDS])


def _changed(a: Column, b: Column, k: str) -> Column:
    return (F.size(a[k]) > 0) & (F.size(b[k]) > 0) & (a[k] != b[k])


def differing_markers(x: Column, y: Column) -> Column:
    """Of raw markers: some kind stands in both, but not the same ones."""
    return _any([_changed(x, y, k) for k in KINDS])


def differing_evidence(a: Column, b: Column) -> Column:
    """Of token sets: some kind of raw marker stands in both, but not the same ones."""
    return differing_markers(raw_markers(a), raw_markers(b))


def evidence_asymmetry(a: Column, b: Column) -> Column:
    return has_markers(raw_markers(a)) != has_markers(raw_markers(b))


def set_delta(a: Column, b: Column) -> Column:
    """Size of the symmetric difference."""
    return F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))


def meaningful_for_retention(a: Column, b: Column, visual_delta: Column | None = None, density_delta: Column | None = None) -> Column:
    """Whether the strict markers of two sets differ enough to keep both samples."""
    x, y = strict_markers(a), strict_markers(b)
    flips = _any([(F.size(x[k]) > 0) != (F.size(y[k]) > 0) for k in KINDS])
    changed = [_changed(x, y, k).cast("int") for k in KINDS]
    supplied = (F.abs(F.coalesce(visual_delta, F.lit(0.0))) >= 0.15 if visual_delta is not None else F.lit(False)) | (F.abs(F.coalesce(density_delta, F.lit(0.0))) >= 0.25 if density_delta is not None else F.lit(False))
    numbered = _any([_changed(x, y, k) for k in KINDS[:3]])
    return (x["status"] != y["status"]) | flips | (sum(changed[1:], changed[0]) >= 2) | (numbered & ((set_delta(a, b) >= 3) | supplied))


def _please(tokens: Column) -> Column:
    return F.array_contains(tokens, "please") & F.array_contains(tokens, "selection")


def form_state_gain(new: Column, old: Column) -> Column:
    """One-sided: what ``new`` has over ``old`` tells another state of a form."""
    gained = F.array_except(new, old)
    return (_please(new) & ~_please(old)) | F.exists(gained, lambda t: F.lower(t).rlike(DATE_TOKEN)) | (F.size(F.filter(gained, lambda t: t.isin(FORM_STATE))) >= 2)


def form_state_delta(a: Column, b: Column) -> Column:
    """Two-sided: what stands in one set only tells another state of a form."""
    changed = F.array_union(F.array_except(a, b), F.array_except(b, a))
    return (_please(a) != _please(b)) | F.exists(changed, lambda t: F.lower(t).rlike(DATE_TOKEN)) | (F.size(F.filter(changed, lambda t: t.isin(FORM_STATE))) >= 2)


def marker_equivalent(a: Column, b: Column) -> Column:
    x, y = strict_markers(a), strict_markers(b)
    return has_markers(x) & (x == y)


def marker_redundant(new: Column, old: Column) -> Column:
    return marker_equivalent(old, new) & ~form_state_gain(new, old)


def content_references(tokens: Column) -> Column:
    return as_set(F.filter(tokens, lambda t: t.isin(SOURCES) | t.rlike("[._-]")))


def clip_token_redundant(new: Column, old: Column, cosine: Column, least_cosine: float = 0.93, least_jaccard: float = 0.7) -> Column:
    return ~form_state_gain(new, old) & (cosine >= least_cosine) & (jaccard(new, old) >= least_jaccard)


def strictly_subsumes(new: Column, old: Column) -> Column:
    """``new`` holds all tokens and markers of ``old`` and more, and ``old`` tells no other form state."""
    x, y = strict_markers(new), strict_markers(old)
    within = _all([F.size(F.array_except(y[k], x[k])) == 0 for k in KINDS])
    more = (F.size(F.array_except(old, new)) == 0) & (F.size(F.array_except(new, old)) > 0)
    return F.when(F.size(old) == 0, F.size(new) > 0).otherwise(~form_state_gain(old, new) & within & more)


def caption_protects(caption: Column) -> Column:
    low = F.lower(F.coalesce(caption, F.lit("")))
    return _any([low.contains(w) for w in PROTECTIVE])


def caption_protects_strongly(caption: Column) -> Column:
    low = F.lower(F.coalesce(caption, F.lit("")))
    return _any([low.contains(w) for w in PROTECTIVE if w != "screenshot"])


def generic_transition(caption: Column) -> Column:
    low = F.lower(F.coalesce(caption, F.lit("")))
    generic = _any([low.contains(s) for s in ("screenshot of a computer screen", "computer screen with a white background", "computer screen with a black background")])
    return generic & ~caption_protects_strongly(caption)


def protected(retention_reason: Column, rescue_origin: Column) -> Column:
    """Handled with care by later stages."""
    return (F.coalesce(F.nullif(retention_reason, F.lit("")), F.lit("none")) != "none") | (F.coalesce(rescue_origin, F.lit("")) != "")


def merge_policy(a: Column, b: Column, either_protected: Column, caption_a: Column, caption_b: Column, threshold: float) -> Column:
    """struct(ok, reason) of two non-empty token sets: vetoes in order, then the Jaccard limit (0.9 at least if protected)."""
    limit = F.when(either_protected, F.greatest(F.lit(threshold), F.lit(0.9))).otherwise(F.lit(threshold))
    captions = caption_protects_strongly(caption_a) != caption_protects_strongly(caption_b)
    reason = (
        F.when(differing_evidence(a, b), "differing_evidence")
        .when(density_veto(a, b), "density_asymmetry")
        .when(either_protected & evidence_asymmetry(a, b), "evidence_asymmetry")
        .when(either_protected & captions, "protective_caption_asymmetry")
        .otherwise("ocr_jaccard")
    )
    return F.struct(((reason == "ocr_jaccard") & (jaccard(a, b) >= limit)).alias("ok"), reason.alias("reason"))


def merge_verdict(a: Column, b: Column, has_a: Column, has_b: Column, dt: Column, overlap: Column, either_protected: Column, caption_a: Column, caption_b: Column, markers_a: Column | None = None, markers_b: Column | None = None, likeness: Column | None = None) -> Column:
    """The reason of a pair's verdict for the component merge, ``merge`` if it may; raw markers and Jaccard may be given, so that pairs don't find them again."""
    both = has_a & has_b
    x, y = (markers_a, markers_b) if markers_a is not None else (raw_markers(a), raw_markers(b))
    limit = F.when(either_protected, F.lit(0.9)).otherwise(F.lit(0.75))
    captions = caption_protects_strongly(caption_a) != caption_protects_strongly(caption_b)
    return (
        F.when(both & differing_markers(x, y), "ocr-evidence")
        .when(both & either_protected & (has_markers(x) != has_markers(y)), "ocr-evidence-asymmetry")
        .when(both & either_protected & captions, "ocr-caption-asymmetry")
        .when(both & ((jaccard(a, b) if likeness is None else likeness) < limit), "ocr-jaccard")
        .when(both & density_veto(a, b), "ocr-density")
        .when(has_a != has_b, "ocr-presence")
        .when((dt > 30.0) & (overlap < 2), "time-transcript")
        .when(~has_a & ~has_b & (overlap < 2), "weak-signal")
        .otherwise("merge")
    )


def screen_type(tokens: Column, caption: Column) -> Column:
    text = F.concat(F.lower(F.array_join(tokens, " ")), F.lit(" "), F.lower(F.coalesce(caption, F.lit(""))))
    has = lambda *terms: _any([text.contains(t) for t in terms])
    return (
        F.when(has("approve", "approval", "submit", "confirm"), "approval")
        .when(has("table", "row", "column", "spreadsheet"), "table")
        .when(has("form", "field", "input", "dropdown"), "form")
        .when(F.size(tokens) > 0, "text_screen")
        .otherwise("visual")
    )


def _value_token(t: Column) -> Column:
    return t.isin(VALUES) | t.rlike("[0-9]")


def _short(prefix: str, tokens: Column) -> Column:
    """A short name of some tokens: 10 hex digits of their SHA-256."""
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha2(F.array_join(tokens, " "), 256), 1, 10))


def _value_name(t: Column) -> Column:
    return (
        F.when(t.isin(SIGNATURE_STATUS), F.concat(F.lit("status:"), t))
        .when(t.rlike("^(?:" + DATE_VALUE.replace(r"\b", "") + ")$"), F.concat(F.lit("date:"), t))
        .when(t.startswith("page") & (F.char_length(t) > 4), F.concat(F.lit("page:"), F.substr(t, F.lit(5))))
        .otherwise(_short("value", F.array(t)))
    )


def _labelled(label: Column, values: Column) -> Column:
    """Signatures of a label with up to four of its values; none without both."""
    name = _short("label", F.slice(label, 1, 8))
    of = F.slice(F.transform(F.filter(values, _value_token), _value_name), 1, 4)
    each = F.transform(of, lambda v: F.concat(F.lit("label-value:"), F.substr(name, F.lit(7)), F.lit(":"), v))
    return F.when((F.size(label) > 0) & (F.size(of) > 0), F.array_union(F.array(name), each)).otherwise(F.array().cast("array<string>"))


def _heading(line: Column, tokens: Column) -> Column:
    letters, upper = F.regexp_count(line, F.lit(r"\p{L}")), F.regexp_count(line, F.lit(r"\p{Lu}"))
    titles = F.size(F.filter(F.split(line, r"\s+"), lambda w: w.rlike(r"^\p{Lu}")))
    n = F.size(tokens)
    fits = (n >= 1) & (n <= 8) & ~F.exists(tokens, _value_token) & (F.char_length(line) <= 80) & ~line.rlike("[:=]") & (letters > 0)
    return fits & ((upper >= 0.6 * letters) | (titles >= F.greatest(F.lit(1), n - 1)))


def field_signatures(text: Column, tokens: Column) -> Column:
    """Sorted names of what a screen states: status, dates, pages, sections, references, labelled values and headings."""
    empty = F.array().cast("array<string>")
    hay = F.concat_ws(" ", F.lower(F.coalesce(text, F.lit(""))), F.lower(F.array_join(F.coalesce(tokens, empty), " ")))
    own = evidence_tokens(hay)
    named = lambda prefix, found: F.transform(found, lambda t: F.concat(F.lit(prefix + ":"), t))
    rest = lambda word: F.transform(F.filter(own, lambda t: t.startswith(word) & (F.char_length(t) > len(word))), lambda t: F.substr(t, F.lit(len(word) + 1)))
    whole = F.concat(
        named("status", F.filter(own, lambda t: t.isin(SIGNATURE_STATUS))),
        named("date", F.regexp_extract_all(hay, F.lit(DATE_VALUE), 0)),
        named("page", F.regexp_extract_all(hay, F.lit(r"\bpage\s*([0-9]+[a-z]?)\b"), 1)),
        named("page", rest("page")),
        named("section", rest("section")),
        named("reference", F.filter(own, lambda t: t.isin(REFERENCES))),
    )

    def of_line(line: Column) -> Column:
        toks = evidence_tokens(line)
        parts = F.split(line, r"\s*[:=]\s*", 2)
        last = F.element_at(toks, -1)
        return (
            F.when(F.size(toks) == 0, empty)
            .when(F.size(parts) == 2, _labelled(evidence_tokens(parts[0]), evidence_tokens(parts[1])))
            .when((F.size(toks) >= 2) & _value_token(last), _labelled(F.slice(toks, 1, F.greatest(F.size(toks) - 1, F.lit(0))), F.array(last)))
            .when(_heading(line, toks), F.array(_short("heading", F.slice(toks, 1, 8))))
            .otherwise(empty)
        )

    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\r\n|\r|\n"), lambda x: of_line(F.trim(x)))
    return as_set(F.concat(whole, F.flatten(lines)))


def signature_delta(lines_a: Column, fields_a: Column, lines_b: Column, fields_b: Column) -> Column:
    same = F.size(F.array_intersect(lines_a, lines_b)).cast("double") / F.greatest(F.size(F.array_union(lines_a, lines_b)), F.lit(1))
    return (set_delta(fields_a, fields_b) > 0) | ((F.size(lines_a) > 0) & (F.size(lines_b) > 0) & (same < 0.72))


def low_information(tokens: Column, caption: Column, is_protected: Column, edge: Column, ent: Column, dark: Column, bright: Column, stddev: Column, least_tokens: int = 3) -> Column:
    """Why a sample stays, or null if it says too little; null metrics mean that there is no frame to judge by."""
    evidence = has_markers(raw_markers(tokens))
    strong, any_caption = caption_protects_strongly(caption), caption_protects(caption)
    sparse = ~evidence & generic_transition(caption) & (edge < 6.0) & (ent < 2.2) & ((bright > 0.6) | (dark > 0.6))
    viewer = ~evidence & ~strong & F.lower(F.coalesce(caption, F.lit(""))).contains("computer screen with a black background") & (edge < 8.0) & (ent < 2.7) & (dark > 0.2)
    avatar = (F.size(tokens) < least_tokens) & ~evidence & ~strong & (dark > 0.95) & (edge < 2.0) & (ent < 1.0)
    return (
        F.when(edge.isNull(), "no_frame")
        .when(is_protected & (evidence | strong), "protected_retained_evidence")
        .when(sparse | viewer | avatar, F.lit(None))
        .when((F.size(tokens) >= least_tokens) | evidence | any_caption, "text_or_protective_signal")
        .when((stddev < 12.0) & ((dark > 0.85) | (bright > 0.92) | (edge < 20.0)), F.lit(None))
        .otherwise("visual_signal")
    )
