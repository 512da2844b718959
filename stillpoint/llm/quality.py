"""Quality classifier by importance resampling of hashed n-gram models.

Method. Two bag-of-n-grams models over the same hashed buckets: one of the target (texts labelled good), one of the raw
corpus (all texts). A text's log weight is the sum over its n-grams of log(target / raw); Gumbel noise keyed by the id
is added, and the k texts of the largest sums are the sample. The n-grams are of words without case, which say what a
text is about, and of word forms (case, digits, punctuation, length class, repetition of the words just before), which
say how it is written. k is a parameter, as a number or as a share; without one it is the number of texts whose log
weight reaches the level that labelled good texts reach. Log weights are sums over whole texts, most of them far from
the k-th: the noise changes the sample near it only, by ``temperature`` nats (see noise_share()).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .textio import CACHE_BYTES, PLACES, Bounded, mix, slices, texts_of

BUCKETS = 10_000
#: Largest n-grams of word forms, and of words.
GRAMS = 2
WORDS = 2
#: Bound of the labelled sample: the target model and the level are fitted on so many labelled rows at most.
MAX_LABELLED = 20_000
#: Share of labelled good texts that may fall under the level, and what the level allows for noise, in nats.
MISSED = 0.0005
MARGIN = 4.0
_SLOTS = 50

_FORM = bytes(97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 57 if 48 <= b <= 57 else b for b in range(256))
_RUN = re.compile(rb"(.)\1+", re.DOTALL)


def _form(word: bytes) -> int:
    """Hash of a word's form: runs collapsed, with a class of length."""
    return xxhash.xxh64_intdigest(_RUN.sub(rb"\1", word)[:8] + b"%d" % (min(len(word), 16) // 4))


class _Places(dict):
    """Places of words in the order in which they first occur; those of a call's new words are taken after it."""

    def __init__(self, limit: int = 200_000, most_bytes: int = CACHE_BYTES):
        super().__init__()
        self._limit, self._most, self._bytes, self._new = limit, most_bytes, 0, []

    def __missing__(self, word):
        place = self[word] = len(self)
        self._new.append(word)
        return place

    def take(self) -> list[bytes]:
        new, self._new = self._new, []
        self._bytes += sum(map(len, new))
        return new

    def full(self) -> bool:
        """Whether to begin anew before the next call, which may add as many words as its texts hold."""
        return len(self) >= self._limit or self._bytes > self._most


class Grams:
    """Buckets of the n-grams of texts: 1 to ``grams`` word forms, 1 to ``words`` words without the case of A-Z."""

    def __init__(self, buckets: int = BUCKETS, grams: int = GRAMS, words: int = 0):
        self.buckets, self.grams, self.words = buckets, grams, words
        self.forms = Bounded(_form)
        self.places = _Places()
        self.known = np.empty((2, 0), np.uint64)

    def _look_up(self, words: list[bytes]) -> np.ndarray:
        """The place of each word in ``known``, whose rows are the hashes of forms and of words without the case of A-Z."""
        if self.places.full():
            self.places = _Places()
            self.known = np.empty((2, 0), np.uint64)
        at = np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))
        if new := self.places.take():
            # words hold no blanks
            forms = b" ".join(new).translate(_FORM).split(b" ")
            hashes = [np.fromiter(map(self.forms.__getitem__, forms), np.uint64, len(new))]
            hashes.append(np.fromiter([xxhash.xxh64_intdigest(w.lower(), 1) for w in new] if self.words else [0] * len(new), np.uint64, len(new)))
            self.known = np.concatenate([self.known, np.array(hashes)], axis=1)
        return at

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, index of text) of every n-gram."""
        words: list[bytes] = []
        counts = np.empty(len(texts), np.int64)
        for i, t in enumerate(texts):
            own = t.encode("utf-8").split()
            counts[i] = len(own)
            words += own
        n = len(words)
        owner = np.repeat(np.arange(len(texts)), counts)
        same = self._look_up(words)
        x = self.known[0, same]
        again = np.zeros(n, np.uint64)
        for lag in (1, 2, 3):
            if n > lag:
                again[lag:] |= ((same[lag:] == same[:-lag]) & (owner[lag:] == owner[:-lag])).astype(np.uint64) << np.uint64(lag)
        x = mix(x + again * PLACES[5])
        found, owners = [], []
        self._add(x, owner, self.grams, found, owners)
        if self.words:
            self._add(self.known[1, same], owner, self.words, found, owners)
        return (np.concatenate(found) % np.uint64(self.buckets)).astype(np.int64), np.concatenate(owners)

    @staticmethod
    def _add(x: np.ndarray, owner: np.ndarray, most: int, found: list, owners: list) -> None:
        """Hashes of the n-grams of ``x`` within each owner, up to ``most``."""
        n = len(x)
        found.append(x)
        owners.append(owner)
        for size in range(2, most + 1):
            if n >= size:
                h = x[: n - size + 1] * PLACES[0]
                for k in range(1, size):
                    h = h + x[k : n - size + 1 + k] * PLACES[k]
                keep = owner[: n - size + 1] == owner[size - 1 :]
                found.append(mix(h[keep]))
                owners.append(owner[: n - size + 1][keep])


class Resampler:
    """The fitted ratio: log(target / raw) of each bucket. Without target counts all weights are 0."""

    def __init__(self, raw: np.ndarray, target: np.ndarray, grams: int = GRAMS, words: int = 0):
        self.grams, self.words = grams, words
        if target.sum() and raw.sum():
            prior = np.full(len(raw), 1.0 / len(raw))
            pad = float(len(raw))  # one count for each bucket, at the target's scale
            self.ratio = np.log((target + pad * prior) / (target.sum() + pad)) - np.log((raw / raw.sum() * target.sum() + pad * prior) / (target.sum() + pad))
        else:
            self.ratio = np.zeros(len(raw))

    def scores(self, texts: list[str], grams: Grams) -> np.ndarray:
        bucket, owner = grams(texts)
        return np.bincount(owner, weights=self.ratio[bucket], minlength=len(texts))


def labelled_sample(labels: DataFrame, bound: int = MAX_LABELLED, id_col: str = "doc_id", label_col: str = "quality") -> dict:
    """Up to ``bound`` labelled ids, those of least hash: {id: quality}. Null ids and labels are left out; an id with several labels has the least."""
    rows = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y")).where("id is not null and y is not null")
    rows = rows.groupBy("id").agg(F.min("y").alias("y"))
    return {r["id"]: r["y"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(bound).collect()}


def fit(docs: DataFrame, sample: dict, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, grams: int = GRAMS, words: int = WORDS) -> Resampler:
    """Counts over all rows, and over those labelled good. The driver receives 2 x ``buckets`` numbers.

    Null text is the empty text, without n-grams; a null id is never labelled; repeated rows count as often as they
    stand; other columns are not read; an empty table gives weights of 0.
    """
    good = {i for i, y in sample.items() if y == 1}
    shared = docs.sparkSession.sparkContext.broadcast(good)
    width = -(-buckets // _SLOTS)

    def count(batches):
        make = Grams(buckets, grams, words)
        raw, target = np.zeros(width * _SLOTS, np.int64), np.zeros(width * _SLOTS, np.int64)
        for b in slices(batches, "text"):
            bucket, owner = make(texts_of(b))
            raw += np.bincount(bucket, minlength=len(raw))
            mine = np.array([i in shared.value for i in b.column(0).to_pylist()], bool)
            if mine.any():
                target += np.bincount(bucket[mine[owner]], minlength=len(raw))
        if raw.any():
            rows = pa.array(range(_SLOTS), pa.int32())
            yield pa.RecordBatch.from_arrays([rows, *(pa.array(list(x.reshape(_SLOTS, width)), pa.list_(pa.int64())) for x in (raw, target))], ["slot", "raw", "target"])

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for s, x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                sums[s] = sums.get(s, 0) + np.array([x, y], np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), *(pa.array([v[k] for v in sums.values()], pa.list_(pa.int64())) for k in (0, 1))], ["slot", "raw", "target"])

    schema = "slot int, raw array<bigint>, target array<bigint>"
    parts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(count, schema)
    raw, target = np.zeros(width * _SLOTS), np.zeros(width * _SLOTS)
    for r in parts.repartition(_SLOTS, "slot").mapInArrow(total, schema).collect():
        raw[r["slot"] * width : (r["slot"] + 1) * width] += r["raw"]
        target[r["slot"] * width : (r["slot"] + 1) * width] += r["target"]
    return Resampler(raw[:buckets], target[:buckets], grams, words)


def _noise(id_col, seed: int, temperature: float = 1.0):
    """Gumbel noise keyed by id and seed, times ``temperature``; one fixed value for null ids."""
    unit = (F.shiftrightunsigned(F.xxhash64(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(seed)), 12).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.log(-F.log(unit)) * F.lit(float(temperature))


def scores(docs: DataFrame, model: Resampler, id_col: str = "doc_id", text_col: str = "text", seed: int = 17, temperature: float = 1.0) -> DataFrame:
    """(_id, _log_weight, _sample_key) of every row; the key is the log weight with the noise added.

    Null text is the empty text, of weight 0; a null id stays null; repeated rows give repeated rows; other columns are not
    read; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.ratio, model.grams, model.words))
    id_type = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches):
        ratio, size, words = shared.value
        make = Grams(len(ratio), size, words)
        for b in slices(batches, "text"):
            bucket, owner = make(texts_of(b))
            weight = np.bincount(owner, weights=ratio[bucket], minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(weight, pa.float64()), pa.array(weight + b.column(1).to_numpy(zero_copy_only=False), pa.float64())], ["_id", "_log_weight", "_sample_key"])

    rows = docs.select(docs[id_col].alias("_id"), _noise(docs[id_col], seed, temperature).alias("_noise"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"_id {id_type}, _log_weight double, _sample_key double")


def filtered(docs: DataFrame, model: Resampler, threshold: float, id_col: str = "doc_id", text_col: str = "text", seed: int = 17, temperature: float = 1.0) -> DataFrame:
    """The rows of ``docs``, all columns, whose key reaches the threshold.

    Nulls and repeated rows as in scores(); columns pass as they are, whatever their names (id and text must name one
    column each); an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.ratio, model.grams, model.words))
    at, schema = docs.columns.index(text_col), docs.schema

    def run(batches):
        ratio, size, words = shared.value
        make = Grams(len(ratio), size, words)
        for whole in batches:
            names = [f"c{i}" if i != at else "text" for i in range(whole.num_columns)]  # names may clash
            for b in slices([pa.RecordBatch.from_arrays(whole.columns, names)], "text"):
                bucket, owner = make(texts_of(b))
                weight = np.bincount(owner, weights=ratio[bucket], minlength=b.num_rows)
                keep = pa.array(weight + b.column(b.num_columns - 1).to_numpy(zero_copy_only=False) >= threshold)
                yield pa.RecordBatch.from_arrays([c.filter(keep) for c in b.columns[:-1]], schema.names)

    return docs.select("*", _noise(docs[id_col], seed, temperature).alias("_noise")).mapInArrow(run, schema)


def level(table: DataFrame, sample: dict, missed: float = MISSED, margin: float = MARGIN) -> float:
    """The log weight that all but ``missed`` of the labelled good texts reach, less ``margin``; -inf without such texts.

    Rows of ``table`` with a null id are no labelled ones; rows of one id count each; an empty table gives -inf.
    """
    spark = table.sparkSession
    good = [(i,) for i, y in sample.items() if y == 1]
    if not good:
        return float("-inf")
    ids = spark.createDataFrame(good, f"_id {table.schema['_id'].dataType.simpleString()}")
    row = table.join(F.broadcast(ids), "_id", "left_semi").select(F.expr(f"percentile(_log_weight, {missed}D)").alias("p")).first()
    return float("-inf") if row["p"] is None else row["p"] - margin


def kth_key(table: DataFrame, k: int, bins: int = 1024) -> float:
    """The k-th largest ``_sample_key``, by histograms that narrow down; the driver sees ``bins`` counts a round."""
    lo, hi, n = table.select(F.min("_sample_key"), F.max("_sample_key"), F.count("_sample_key")).first()
    if not n or k >= n:
        return float("-inf")
    if k <= 0:
        return float("inf")
    above = 0  # keys over hi
    while True:
        width = (hi - lo) / bins
        if width <= 0 or lo + width == lo:
            return lo
        at = F.least(F.floor((F.col("_sample_key") - lo) / width), F.lit(bins - 1))
        inside = table.where((F.col("_sample_key") >= lo) & (F.col("_sample_key") <= hi))
        found = {r["b"]: (r["n"], r["lo"], r["hi"]) for r in inside.groupBy(at.alias("b")).agg(F.count("*").alias("n"), F.min("_sample_key").alias("lo"), F.max("_sample_key").alias("hi")).collect()}
        for b in sorted(found, reverse=True):
            if above + found[b][0] >= k:
                n, lo, hi = found[b]
                break
            above += found[b][0]
        if lo == hi or above + n == k:
            return lo


class Quality:
    """A fitted classifier with the key that a text must reach to be kept."""

    def __init__(self, model: Resampler, threshold: float, level: float, k: int):
        self.model, self.threshold, self.level, self.k = model, threshold, level, k


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 17, max_labelled: int = MAX_LABELLED, missed: float = MISSED, margin: float = MARGIN, k: int | None = None, share: float | None = None, temperature: float = 1.0) -> tuple[Quality, DataFrame, Scratch]:
    """Fit on all rows and a bounded labelled sample; returns the classifier and the table of all scores.

    The sample has ``k`` rows, or a ``share`` of all; with neither, as many as reach the level (see level()).
    """
    sample = labelled_sample(labels, max_labelled)
    model = fit(docs, sample, id_col, text_col)
    scratch = Scratch(docs.sparkSession, "quality")
    table = scratch.save(scores(docs, model, id_col, text_col, seed, temperature), "scores")
    least = float("nan")
    if k is None and share is not None:
        k = round(share * table.count())
    if k is None:
        least = level(table, sample, missed, margin)
        k = table.where(F.col("_log_weight") >= least).count()
    return Quality(model, kth_key(table, k), least, k), table, scratch


def noise_share(quality: Quality, table: DataFrame) -> float:
    """The share of the sample that the noise brought in: rows of the k largest keys that aren't among the k largest log weights."""
    without = kth_key(table.select(F.col("_log_weight").alias("_sample_key")), quality.k)
    new = table.where((F.col("_sample_key") >= quality.threshold) & (F.col("_log_weight") < without)).count()
    return new / max(1, quality.k)


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The sampled texts: (id, log_weight, sample_key), k rows (all rows that tie with the k-th too). Options as of train().

    Null text is the empty text, of weight 0; a null id is kept like any other, with one fixed noise; repeated rows share
    their noise and stay together; other columns are not read. An empty table gives none; without good labels all
    weights are 0 and all rows stay.
    """
    quality, table, _ = train(docs, labels, id_col, text_col, **options)
    return table.where(F.col("_sample_key") >= quality.threshold).select(F.col("_id").alias(id_col), F.col("_log_weight").alias("log_weight"), F.col("_sample_key").alias("sample_key"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that the resampling keeps, with all their columns; the text isn't shuffled, it is scored again.

    Nulls, repeated rows, clashing names and empty tables as in resample() and filtered().
    """
    quality, table, scratch = train(docs, labels, id_col, text_col, **options)
    scratch.drop(table)
    return filtered(docs, quality.model, quality.threshold, id_col, text_col, options.get("seed", 17), options.get("temperature", 1.0))


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
