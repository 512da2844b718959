"""Document fingerprints: one-permutation MinHash with optimal densification and b-bit packing.

Method. The five-word shingles of a text are hashed once; the high bits of a hash choose its bin, and each bin keeps its
least hash. An empty bin borrows from a bin that isn't empty, found along a fixed random cycle of its own, so that equal
sets borrow alike and the bins stay close to independent. Of each bin the low ``bits`` bits are stored. Bins of
different sets agree by chance in 2**-bits of the cases, which likeness() takes out of the share of equal bins.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textio import WordHasher, mix, slices, texts_of

SHINGLE = 5
BINS = 512
BITS = 4
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


@lru_cache(maxsize=4)
def _cycles(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and odd step of each bin's cycle through all bins (``bins`` is a power of two)."""
    h = mix(np.arange(1, bins + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (h >> np.uint64(20)).astype(np.int64) % bins, ((h >> np.uint64(40)).astype(np.int64) % bins) | 1


def minhash(shingles: np.ndarray, owner: np.ndarray, n: int, bins: int = BINS) -> np.ndarray:
    """n x bins least hashes, densified; a text without shingles has the empty mark in every bin."""
    low = np.full(n * bins, _EMPTY, np.uint64)
    if len(shingles):
        cell = owner * bins + (shingles >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)
        np.minimum.at(low, cell, mix(shingles ^ np.uint64(0x5851F42D4C957F2D)))
    low = low.reshape(n, bins)
    empty = low == _EMPTY
    hollow = empty.all(axis=1)
    rows, cols = np.nonzero(empty & ~hollow[:, None])
    start, step = _cycles(bins)
    out = low.copy()
    at = start[cols]
    while len(rows):
        lent = low[rows, at]
        got = lent != _EMPTY
        out[rows[got], cols[got]] = lent[got]
        rows, cols, at = rows[~got], cols[~got], at[~got]
        at = (at + step[cols]) % bins
    return out


def pack(low: np.ndarray, bits: int = BITS) -> np.ndarray:
    """n x (bins*bits/8) bytes of the low ``bits`` bits (1, 2, 4 or 8) of each bin."""
    v = (low & np.uint64((1 << bits) - 1)).astype(np.uint8)
    if bits == 8:
        return v
    planes = np.unpackbits(v[:, :, None], axis=2, bitorder="little")[:, :, :bits]
    return np.packbits(planes.reshape(len(v), -1), axis=1, bitorder="little")


def likeness(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard similarity, 0 to 1, of packed fingerprints, row by row, with the chance matches taken out."""
    if bits == 8:
        share = (a == b).mean(axis=1)
    else:
        un = lambda x: np.packbits(np.unpackbits(x, axis=1, bitorder="little").reshape(len(x), -1, bits), axis=2, bitorder="little")[:, :, 0]
        share = (un(a) == un(b)).mean(axis=1)
    chance = 2.0**-bits
    return np.clip((share - chance) / (1 - chance), 0.0, 1.0)


class Fingerprinter:
    """Packed fingerprints of texts."""

    def __init__(self, shingle: int = SHINGLE, bins: int = BINS, bits: int = BITS):
        self.shingle, self.bins, self.bits = shingle, bins, bits
        self.words = WordHasher()

    def __call__(self, texts: list[str]) -> np.ndarray:
        h, owner = self.words.shingles(texts, self.shingle)
        return pack(minhash(h, owner, len(texts), self.bins), self.bits)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """(id, fingerprint string) of every row: lowercase hex of the packed bins of its whole text.

    Null text is the empty text; a text without words has every bin at the empty mark (all bits set); one of fewer words
    than a shingle has its whole sequence as the only shingle. A null id stays null; repeated rows give repeated rows;
    other columns are not read. One row in, one row out, without a shuffle.
    """
    id_type = df.select(id_col).schema[0].dataType.simpleString()

    def run(batches):
        make = Fingerprinter(shingle, bins, bits)
        for b in slices(batches, "text"):
            packed = make(texts_of(b))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes().hex() for x in packed], pa.string())], ["id", "fingerprint"])

    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, f"id {id_type}, fingerprint string").withColumnRenamed("id", id_col)


def with_next_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bytes_per_part: int = 8 << 20, most_parts: int = 20_000) -> DataFrame:
    """Deal rows to parts by ranges of the id, each part also borrowing the first row of the part that follows.

    Returns (part, last, id, text), sorted within parts by id downwards; ``last`` marks a borrowed row. What the driver
    holds are one bound and one id for each part, ``most_parts`` at most: up to 160 GB of text a part has about
    ``bytes_per_part``, beyond that the parts grow (100 TB: 5 GB each, which the task reads as a stream, sorted on disk).
    Rows of null id come last; equal ids are ordered by their text. The text is shuffled once.
    """
    rows = df.select(F.coalesce(df[id_col].cast("bigint"), F.lit(-(2**63))).alias("k"), df[id_col].alias("id"), F.coalesce(df[text_col], F.lit("")).alias("text"))
    total = rows.select(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    parts = min(most_parts, max(1, -(-total // bytes_per_part)))
    cuts = np.unique(rows.approxQuantile("k", [i / parts for i in range(1, parts)], 0.1 / parts)) if parts > 1 else np.zeros(0)

    def numbered(k: np.ndarray) -> np.ndarray:
        """Parts are numbered downwards, as the order runs."""
        return len(cuts) - np.searchsorted(cuts, k.astype(np.float64), side="right")

    @F.pandas_udf("int")
    def part_of(k: pd.Series) -> pd.Series:
        return pd.Series(numbered(k.to_numpy()).astype(np.int32))

    tops = {r["part"]: r["top"] for r in rows.groupBy(part_of("k").alias("part")).agg(F.max("k").alias("top")).collect()}
    order = np.array(sorted(tops), np.int64)
    top = np.array([tops[p] for p in order.tolist()], np.int64)

    @F.pandas_udf("array<int>")
    def parts_of(k: pd.Series) -> pd.Series:
        """The row's part and, for the largest id of a part, -1 - the part before it (cyclically), which borrows it."""
        v = k.to_numpy()
        p = numbered(v)
        at = np.searchsorted(order, p)
        lent = top[at] == v
        to = order[at - 1]
        return pd.Series([[x, -1 - y] if z else [x] for x, y, z in zip(p.tolist(), to.tolist(), lent.tolist(), strict=True)])

    spread = rows.select(F.explode(parts_of("k")).alias("to"), "k", "id", "text")
    spread = spread.select(F.when(F.col("to") < 0, -1 - F.col("to")).otherwise(F.col("to")).alias("part"), (F.col("to") < 0).alias("last"), "k", "id", "text")
    return spread.repartition(max(1, len(order)), "part").sortWithinPartitions("part", "last", F.col("k").desc(), "text")


def neighbour_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness, with the next row by descending id.

    The edited text replaces the last floor(n/2) code points by the first as many (or all) of the next row's text; after
    the row of the least id comes the first. Returns (id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next). Null text is the empty text; rows of null id come after all others; equal ids are ordered
    by text; a lone row is its own next; an empty table gives no rows; other columns are not read.
    """
    id_type = df.select(id_col).schema[0].dataType.simpleString()
    dealt = with_next_text(df, id_col, text_col)

    def run(batches):
        make = Fingerprinter(shingle, bins, bits)
        held: list[tuple] = []  # rows that wait for the next row of their part
        part = None

        def emit(rows, upcoming):
            """Results of rows whose next texts are all known."""
            texts = [r[1] for r in rows]
            after = [*texts[1:], upcoming]
            edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, after, strict=True)]
            own = make([*texts, upcoming])
            new = make(edited)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], ids),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in edited], pa.string()),
                    pa.array([x.tobytes().hex() for x in own[:-1]], pa.string()),
                    pa.array([x.tobytes().hex() for x in new], pa.string()),
                    pa.array(likeness(own[:-1], new, bits), pa.float64()),
                    pa.array(likeness(own[:-1], own[1:], bits), pa.float64()),
                ],
                ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        ids = pa.int64()
        closed = False  # the part's borrowed row has been met; further borrowed rows have the same id
        for b in slices(batches, "text"):
            ids = b.schema.field("id").type
            for p, last, i, t in zip(b.column("part").to_pylist(), b.column("last").to_pylist(), b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if p != part:
                    part, held, closed = p, [], False
                if closed:
                    continue
                if last:
                    closed = True
                    if held:
                        yield emit(held, t)
                        held = []
                else:
                    held.append((i, t))
            if len(held) > 1:
                yield emit(held[:-1], held[-1][1])
                held = held[-1:]

    schema = f"id {id_type}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.select("part", "last", "id", "text").mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op6_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return neighbour_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
