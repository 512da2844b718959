"""Secret scans: base patterns, and sliding-window Shannon entropy over candidate strings.

Method. Candidate strings are maximal runs of characters of one class (hexadecimal digits, or the base64 and
URL-safe alphabet). A window slides over each candidate; the counts of its characters change by one character in and
one out at each step, and so does the entropy. Windows over the class's limit are united to spans. An allow-list
suppresses what only looks random: UUIDs, plain numbers, words without digits, paths, repeated or ascending runs.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .textio import slices, texts_of

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
#: Order of kinds where spans start together.
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")


@dataclass(frozen=True)
class CharClass:
    """A character class with its window width, entropy limit in bits, and least candidate length."""

    kind: str
    run: re.Pattern
    width: int
    bits: float


CLASSES = (
    CharClass("entropy_hex", re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{24,}(?![0-9A-Fa-f])"), 24, 3.1),
    CharClass("entropy_base64", re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}"), 24, 4.0),
)
ALLOW = tuple(
    re.compile(p)
    for p in (
        r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",  # UUID
        r"[0-9+/_=-]+",  # numbers and rulers
        r"[A-Za-z+/_=-]+",  # words and paths without digits
        r"(.)\1+",
        r"(?i:0123456789abcdef)+",
    )
)


def allowed(candidate: str) -> bool:
    """True if the whole candidate is of a harmless form."""
    return any(p.fullmatch(candidate) for p in ALLOW)


def entropy_windows(s: str, width: int, bits: float) -> list[tuple[int, int]]:
    """Unions of windows of ``s`` whose entropy is at least ``bits``; each step updates two counts.

    With counts c that sum to w the entropy is log2(w) - sum(c log2 c) / w, so only the terms of the character that
    leaves and of the one that enters change.
    """
    if len(s) < width:
        return []
    term = [0.0] + [c * math.log2(c) for c in range(1, width + 1)]
    counts: dict[str, int] = {}
    total = 0.0
    for ch in s[:width]:
        c = counts.get(ch, 0)
        total += term[c + 1] - term[c]
        counts[ch] = c + 1
    limit = (math.log2(width) - bits) * width + 1e-9
    out: list[tuple[int, int]] = []
    for i in range(len(s) - width + 1):
        if i:
            gone, new = s[i - 1], s[i + width - 1]
            c = counts[gone]
            total += term[c - 1] - term[c]
            counts[gone] = c - 1
            c = counts.get(new, 0)
            total += term[c + 1] - term[c]
            counts[new] = c + 1
        if total <= limit:
            if out and out[-1][1] >= i:
                out[-1] = (out[-1][0], i + width)
            else:
                out.append((i, i + width))
    return out


def find_secrets(text: str) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) of a whole text in code points, end exclusive, by start and kind."""
    longest = max(map(len, text.split()), default=0)
    found: list[tuple[int, int, str]] = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if longest >= 16:
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if longest >= 24:
        # the farthest end of the base spans up to each start tells whether one of them covers a window
        starts = sorted((a, b) for a, b, _ in found)
        ends = list(accumulate((b for _, b in starts), max))
        begins = [a for a, _ in starts]

        def covered(a: int, b: int) -> bool:
            k = bisect_right(begins, a)
            return k > 0 and ends[k - 1] >= b

        for cls in CLASSES:
            for m in cls.run.finditer(text):
                if allowed(m[0]):
                    continue
                for a, b in entropy_windows(m[0], cls.width, cls.bits):
                    a, b = a + m.start(), b + m.start()
                    if not allowed(text[a:b]) and not covered(a, b):
                        found.append((a, b, cls.kind))
    if len(found) > 1:
        found.sort(key=lambda x: (x[0], KINDS.index(x[2]), x[1]))
    return found


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of secrets of every row: (id, spans array<struct<start,end,kind>>), found in whole texts.

    Null text is the empty text, with no spans; a null id stays null; repeated rows give repeated rows; other columns
    are not read. One row in, one row out, without a shuffle.
    """
    schema = df.select(id_col).schema
    id_type = schema[0].dataType.simpleString()
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches):
        for b in slices(batches, "text"):
            spans = [[{"start": x, "end": y, "kind": k} for x, y, k in find_secrets(t)] for t in texts_of(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], ["id", "spans"])

    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, spans array<struct<start:bigint,end:bigint,kind:string>>").withColumnRenamed("id", id_col)


MARK = "[SECRET]"


def redact_secrets(df: DataFrame, text_col: str = "text", mark: str = MARK) -> DataFrame:
    """The same rows and columns with every span in ``text_col`` replaced by ``mark``; null text stays null.

    Overlapping spans are replaced once. Other columns, null ids and repeated rows pass as they are, whatever their names
    (``text_col`` must name one column); an empty table gives no rows.
    """
    at = df.columns.index(text_col)

    def clean(t: str | None) -> str | None:
        if not t:
            return t
        parts, end = [], 0
        for a, b, _ in find_secrets(t):
            if a >= end:
                parts += [t[end:a], mark]
            end = max(end, b)
        return t if not parts else "".join(parts) + t[end:]

    def run(batches):
        for whole in batches:
            names = [f"c{i}" if i != at else "text" for i in range(whole.num_columns)]  # names may clash
            for b in slices([pa.RecordBatch.from_arrays(whole.columns, names)], "text"):
                new = pa.array([clean(t) for t in b.column(at).to_pylist()], b.schema.field(at).type)
                yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(b.columns)], whole.schema.names)

    return df.mapInArrow(run, df.schema)


def op1_secret_scans(spark, sf_dir: str) -> DataFrame:
    """The spans of ``documents`` with the counts and the digest of the base kinds."""
    from pyspark.sql import functions as F

    found = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
