"""Token counts by a SentencePiece model: batch encoding that returns lengths only.

Method. Arrow functions take slices balanced by bytes. Texts are split at safe boundaries, before a space that follows
another character: no piece of the model spans such a place (checked when the model is loaded), and merges never cross
it, so the count of a text is the sum of the counts of its parts, however long it is. Parts that a worker hasn't met
are encoded in batches of about equal bytes; only their lengths are kept.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textio import CACHE_BYTES, slices, texts_of

_PARTS = re.compile(r" *[^ ]+| +$")
_SPACE = "▁"


class PieceCounter:
    """Counts tokens with one model; ``batch_bytes`` bounds a call of the library (a longer part is one of its own).

    It forgets the parts that it knows before a batch if they are more than ``limit`` or have more than ``most_bytes``.
    """

    def __init__(self, path: str, limit: int = 300_000, batch_bytes: int = 1 << 20, most_bytes: int = CACHE_BYTES):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self._model.id_to_piece(i) for i in range(self._model.get_piece_size())]
        #: Parts may be encoded alone only where no piece crosses their boundary and a lone part gets its leading space back.
        self.safe = not any(re.search(f"[^{_SPACE}]{_SPACE}", p) for p in pieces) and self._model.encode("a", out_type=str)[0].startswith(_SPACE) and self._model.encode("a  a ") != self._model.encode("a a")
        self.limit, self.batch_bytes, self.most_bytes, self._bytes = limit, batch_bytes, most_bytes, 0
        #: A part without text is one last space, which the library's own leading space would hide.
        self._lone = len(self._model.encode("a ")) - len(self._model.encode("a"))
        self.known: dict[str, int] = {"": self._lone}

    def parts(self, text: str) -> list[str]:
        """The parts of a text, each without the one space that the library puts before it."""
        if not text:
            return []
        if not self.safe:
            return [text]
        if _SPACE in text:  # the library's own sign for a space
            text = text.replace(_SPACE, " ")
        if text[0] == " " or text[-1] == " " or "  " in text:
            return [p[1:] for p in _PARTS.findall(" " + text)]
        return text.split(" ")

    def learn(self, parts) -> None:
        if len(self.known) > self.limit or self._bytes > self.most_bytes:
            self.known, self._bytes = {"": self._lone}, 0
        batch: list[str] = []
        size = 0
        for p in parts:
            if p not in self.known:
                own = len(p) if p.isascii() else len(p.encode("utf-8", "surrogatepass"))
                if batch and size + own > self.batch_bytes:
                    self._encode(batch)
                    batch, size = [], 0
                batch.append(p)
                size += own + 16
                self._bytes += own
        self._encode(batch)

    def _encode(self, batch: list[str]) -> None:
        if batch:
            self.known.update(zip(batch, map(len, self._model.encode(batch, num_threads=1)), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        lists = [self.parts(t) for t in texts]
        self.learn(set().union(*lists))
        get = self.known.__getitem__
        return [sum(map(get, ps)) for ps in lists]


@lru_cache(maxsize=4)
def piece_counter(path: str) -> PieceCounter:
    """One per Python worker and path."""
    return PieceCounter(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 4096) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row, from its whole text.

    Null text is the empty text, with 0 bytes and tokens; a null id stays null; repeated rows give repeated rows; other
    columns are not read. One row in, one row out, without a shuffle. ``path`` must exist on every executor.
    """
    path = path or default_path()
    id_type = df.select(id_col).schema[0].dataType.simpleString()

    def run(batches):
        counter = piece_counter(path)
        for b in slices(batches, "text"):
            n_bytes = pc.cast(pc.fill_null(pc.binary_length(b.column(1)), 0), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n_bytes, pa.array(counter.count(texts_of(b)), pa.int64())], ["id", "n_bytes", "n_tokens"])

    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, f"id {id_type}, n_bytes bigint, n_tokens bigint")
    return rows.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
