"""BPE encoding and decoding with word ends, equal to the public tokenizer file that it is given.

Method. The words of a batch that the worker hasn't met are put, as symbol ids, in one flat array. Each round looks up
all neighbouring pairs by binary search over the sorted pair keys, takes each word's lowest rank and merges that pair
in all words at once, until no word has a pair to merge. A worker keeps the words it has met, so that a text is
encoded by one look-up per word.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textio import CACHE_BYTES, slices, texts_of

#: Letters and numbers of the characters up to U+00FF, after lower-casing.
_L, _N = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
#: Texts of these characters need no tables of Unicode: no composition, and one-to-one lower case.
_PLAIN = re.compile("[\t\n\r\x20-\x7e¡-ÿ]*")
_FAR = np.int32(2**31 - 1)
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\\s{_L}{_N}]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where printable, else from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for one file of kind BPE with word ends.

    It forgets the words that it knows before a batch if they are more than ``limit``, or if they and their ids have more
    than ``most_bytes``.
    """

    def __init__(self, path: str, limit: int = 300_000, most_bytes: int = CACHE_BYTES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        end = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._path, self._library = path, None
        letters = byte_letters()
        self._of_letter = {c: b for b, c in enumerate(letters)}
        self._inner = np.array([vocab[c] for c in letters], np.int64)
        self._last = np.array([vocab[c + end] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self._base = max(self.names) + 1
        keys = np.array([vocab[a] * self._base + vocab[b] for a, b in pairs], np.int64)
        into = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        keys, into = keys[order], into[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))  # the first of equal pairs has the lower rank
        self._keys, self._into, self._rank = keys[first], into[first], order[first].astype(np.int32)
        self.limit, self.most_bytes, self._bytes = limit, most_bytes, 0
        #: Known words with their ids as little-endian unsigned 32-bit numbers; special tokens are always known.
        self.ids: dict[str, bytes] = {}
        self._derived: list[tuple[dict, object]] = []
        self._reset()

    def _reset(self) -> None:
        self.ids.clear()
        self._bytes = 0
        self.ids.update((s, i.to_bytes(4, "little")) for s, i in self.special.items())
        for table, of in self._derived:
            table.clear()
            table.update((w, of(ids)) for w, ids in self.ids.items())

    def derived(self, of) -> dict:
        """A look-up table word -> of(list of ids), kept in step with the words that are known, until release()."""
        unpacked = lambda ids: of(np.frombuffer(ids, "<u4").tolist())
        table = {w: unpacked(ids) for w, ids in self.ids.items()}
        self._derived.append((table, unpacked))
        return table

    def release(self) -> None:
        self._derived.clear()

    def words(self, text: str) -> list[str]:
        """The words of a text, special tokens included, in order."""
        if not text:
            return []
        if self._split and "<|" in text:
            parts = self._split.split(text)
            if len(parts) > 1:
                return [w for k, p in enumerate(parts) for w in ([p] if k % 2 else self._words(p))]
        return self._words(text)

    def _words(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            return _WORD.findall(text.lower())
        if self._library is None:  # for rare characters: its own normaliser and word splitter
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path)
        norm = self._library.normalizer.normalize_str(text)
        of = self._of_letter
        return [bytes(map(of.__getitem__, w)).decode("utf-8") for w, _ in self._library.pre_tokenizer.pre_tokenize_str(norm)]

    def learn(self, words: set[str]) -> None:
        """Encode the words that aren't known yet, all in one go."""
        if len(self.ids) > self.limit or self._bytes > self.most_bytes:
            self._reset()
        new = list(words - self.ids.keys())
        for k in range(0, len(new), 50_000):
            part = new[k : k + 50_000]
            known = dict(zip(part, self.merge(part), strict=True))
            self.ids.update(known)
            self._bytes += sum(map(len, known)) + sum(map(len, known.values()))
            for table, of in self._derived:
                table.update((w, of(ids)) for w, ids in known.items())

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of pairs, by binary search over the sorted pair keys."""
        keys = left * self._base + right
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[at] == keys, self._rank[at], _FAR), self._into[at]

    def merge(self, words: list[str]) -> list[bytes]:
        """Ids of each word, by rounds over one flat array of the symbols of all words.

        A round merges, in every word, all places of the word's pair of lowest rank; then only the pairs beside merged
        places are looked up again. Words without pairs to merge leave the array.
        """
        raw = [w.encode("utf-8") for w in words]
        sizes = np.array([len(r) for r in raw], np.int64)
        if not sizes.sum():
            return [b""] * len(words)
        data = np.frombuffer(b"".join(raw), np.uint8)
        sym = self._inner[data]
        ends = np.cumsum(sizes)[sizes > 0] - 1
        sym[ends] = self._last[data[ends]]
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        rank, into = np.full(len(sym), _FAR, np.int32), np.zeros(len(sym), np.int64)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner], into[inner] = self._look(sym[inner], sym[inner + 1])
        done_words, done_syms = [], []
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            spans = np.diff(np.append(starts, len(sym)))
            low = np.minimum.reduceat(rank, starts)
            over = np.repeat(low == _FAR, spans)
            done_words.append(word[over])
            done_syms.append(sym[over])
            take = (rank == np.repeat(low, spans)) & ~over
            # of places that overlap (as in a a a) every second is merged, from the left
            if (take[1:] & take[:-1]).any():
                pos = np.arange(len(sym))
                begins = take & ~np.concatenate([[False], take[:-1]])
                take &= (pos - np.maximum.accumulate(np.where(begins, pos, -1))) % 2 == 0
            keep = ~np.concatenate([[False], take[:-1]]) & ~over
            # a merged place takes over what stood between its second half and the next symbol
            second = np.flatnonzero(take) + 1
            sym[take], rank[take] = into[take], rank[second]
            sym, word, rank, into, take = sym[keep], word[keep], rank[keep], into[keep], take[keep]
            if not len(sym):
                break
            anew = np.flatnonzero(take | np.concatenate([take[1:], [False]]))
            last = np.concatenate([word[1:] != word[:-1], [True]])
            rank[anew[last[anew]]] = _FAR
            anew = anew[~last[anew]]
            rank[anew], into[anew] = self._look(sym[anew], sym[anew + 1])
        owner = np.concatenate(done_words)
        flat = np.concatenate(done_syms)[np.argsort(owner, kind="stable")].astype("<u4").tobytes()
        cuts = (4 * np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))])).tolist()
        return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        lists = [self.words(t) for t in texts]
        self.learn(set().union(*lists))
        return [np.frombuffer(b"".join(map(self.ids.__getitem__, ws)), "<u4").astype(np.int64) for ws in lists]

    def decode(self, ids) -> str:
        """The file has no decoder: tokens joined by one space, special ones included."""
        return " ".join(map(self.names.__getitem__, ids))


@lru_cache(maxsize=4)
def word_bpe(path: str) -> WordBpe:
    """One per Python worker and path."""
    return WordBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_ids(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids array<int>) of every row, from its whole text.

    Null text is the empty text, with no ids; a null id stays null; repeated rows give repeated rows; other columns are
    not read. One row in, one row out, without a shuffle. The tokenizer file must be at ``path`` on every executor.
    """
    path = path or default_path()
    id_type = df.select(id_col).schema[0].dataType.simpleString()

    def run(batches):
        bpe = word_bpe(path)
        for b in slices(batches, "text", 2 << 20):
            ids = bpe.encode(texts_of(b))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, f"id {id_type}, ids array<int>").withColumnRenamed("id", id_col)


def decode_ids(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id, text) from lists of ids.

    A null list is an empty one, of the empty text; a null id stays null; repeated rows give repeated rows; other columns
    are not read; an empty table gives no rows. Null items and ids that the file doesn't have are an error.
    """
    path = path or default_path()
    id_type = df.select(id_col).schema[0].dataType.simpleString()

    def run(batches):
        bpe = word_bpe(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(x or ()) for x in b.column(1).to_pylist()], pa.string())], ["id", "text"])

    return df.select(df[id_col].alias("id"), df[ids_col].alias("ids")).mapInArrow(run, f"id {id_type}, text string").withColumnRenamed("id", id_col)


def round_trip_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row: encode and decode without sending the ids out of the worker.

    Same rules for nulls, repeated rows and other columns as encode_ids. An encoded word is kept with its ids as
    decimals and its tokens as text, so both digests are joins of look-ups.
    """
    path = path or default_path()
    id_type = df.select(id_col).schema[0].dataType.simpleString()

    def run(batches):
        bpe = word_bpe(path)
        count = bpe.derived(len)
        decimals = bpe.derived(lambda ids: " ".join(map(str, ids)).encode())
        tokens = bpe.derived(lambda ids: bpe.decode(ids).encode("utf-8"))
        sha = lambda parts: hashlib.sha256(b" ".join(parts)).hexdigest()
        try:
            for b in slices(batches, "text", 2 << 20):
                lists = [bpe.words(t) for t in texts_of(b)]
                bpe.learn(set().union(*lists))
                cols = [
                    b.column(0),
                    pa.array([sum(map(count.__getitem__, ws)) for ws in lists], pa.int64()),
                    pa.array([sha(map(decimals.__getitem__, ws)) for ws in lists], pa.string()),
                    pa.array([sha(map(tokens.__getitem__, ws)) for ws in lists], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["id", "n_tokens", "ids_sha256", "decoded_sha256"])
        finally:
            bpe.release()

    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def op2_bpe_encode_decode(spark, sf_dir: str) -> DataFrame:
    return round_trip_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
