"""N-gram Jaccard join: exact links between texts by their sets of word shingles, and the components they form.

Method. Equal sets become one class, of which one member goes on. A pair at or over the limit shares a shingle among
the first few of both sets in any fixed order of shingles; the order here puts shingles of rare sketch counters first,
so that common lines and passages bring nothing together. Texts that share such a shingle form a group. Groups are
worked off in tiles of bounded size, banded by set size, in which each text has a bitmap of parities of hashed
shingles: the bits in which two bitmaps differ bound the symmetric difference from below, and so the overlap from
above. Pairs that pass tie the texts to clusters, and within the clusters' tiles the sorted arrays of shingles are
intersected exactly. A tile's search visits linked texts breadth-first and drops each text once it is linked, so that
a group of n alike texts costs n comparisons and gives n - 1 links.

A shingle is known by a 64-bit hash of its words; sets are sets of these.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from ..scratch import Scratch
from .textio import WordHasher, mix, slices, texts_of

_SLOTS = 128


@dataclass(frozen=True)
class Rule:
    """Texts link when 100 * intersection >= percent * union of their sets of ``shingle``-word shingles."""

    shingle: int = 5
    percent: int = 80
    #: log2 of the sketch's counters; it decides how fast the join is, not what it finds.
    sketch_bits: int = 18
    #: Largest group whose pairs are listed one by one; larger ones go to tiles.
    pairs_up_to: int = 6
    #: Texts in a part of a large group, and in the tiles where what the parts leave apart is compared.
    block: int = 2048
    wide: int = 2048
    #: Keys with more postings than this, and than a 100,000th of all shingles, never meet in one task.
    heavy: int = 65_536
    #: Texts of a large group that are put into each of its tiles.
    pivots: int = 8

    def __post_init__(self):
        if not 50 <= self.percent <= 100 or self.shingle < 1 or self.shingle > 6:
            raise ValueError("percent must be 50 to 100 and shingle 1 to 6")

    def heavy_from(self, counters: np.ndarray) -> int:
        """Postings from which a key counts as heavy; at most 100,000 keys have so many."""
        return max(self.heavy, int(counters.sum()) // 100_000) + 1

    def prefix(self, n: int) -> int:
        return n - -(-self.percent * n // 100) + 1

    def may_differ(self, r, s):
        """Largest symmetric difference of linked sets of r and s shingles; negative if the sizes alone rule a link out."""
        overlap = -(-self.percent * (r + s) // (100 + self.percent))
        return np.where(overlap <= np.minimum(r, s), r + s - 2 * overlap, -1)


def width_of(n: int) -> int:
    """Bits of the bitmap of a set of n: a power of two, n at least."""
    return max(64, 1 << (n - 1).bit_length())


def bitmap(shingles: np.ndarray, width: int) -> np.ndarray:
    """Parities of the number of shingles that hash to each bit; halves of it fold to the next narrower bitmap by xor."""
    odd = np.bincount((shingles & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _fold(bits: np.ndarray) -> np.ndarray:
    half = bits.shape[-1] // 2
    return bits[..., :half] ^ bits[..., half:]


class Tile:
    """Texts with their set sizes and bitmaps, and their sorted sets where links must be exact."""

    def __init__(self, rule: Rule, ids: np.ndarray, sizes: np.ndarray, bitmaps: list[np.ndarray], sets: list[np.ndarray] | None):
        self.rule, self.ids, self.sizes, self.bitmaps, self.sets = rule, ids, sizes, bitmaps, sets
        widths = np.array([64 * len(b) for b in bitmaps])
        #: By width: places in the tile by size, their sizes, bitmaps, and bitmaps folded once.
        self.bands: dict[int, tuple] = {}
        for w in np.unique(widths):
            at = np.flatnonzero(widths == w)
            at = at[np.argsort(sizes[at], kind="stable")]
            rows = np.stack([bitmaps[i] for i in at])
            self.bands[int(w)] = (at, sizes[at], rows, _fold(rows) if w > 64 else None)

    def exact(self, x: int, y: int) -> bool:
        if self.sets is None:
            return True
        a, b = self.sets[x], self.sets[y]
        if len(a) > len(b):
            a, b = b, a
        at = np.searchsorted(b, a)
        at[at == len(b)] = 0
        both = int((b[at] == a).sum())
        return 100 * both >= self.rule.percent * (len(a) + len(b) - both)

    def near(self, x: int, wanted: np.ndarray) -> np.ndarray:
        """Places among ``wanted`` (a mask over the tile) that the sizes and the bitmaps don't rule out."""
        own, n = self.bitmaps[x], int(self.sizes[x])
        w = 64 * len(own)
        out = []
        lo, hi = -(-self.rule.percent * n // 100), 100 * n // self.rule.percent
        for width in (w // 2, w, w * 2):
            if width not in self.bands:
                continue
            at, sizes, rows, folded = self.bands[width]
            a, b = np.searchsorted(sizes, lo), np.searchsorted(sizes, hi, side="right")  # the size band
            pick = np.flatnonzero(wanted[at[a:b]]) + a
            if not len(pick):
                continue
            other = (rows if width <= w else folded)[pick]
            mine = own if width >= w else _fold(own)
            differ = np.bitwise_count(other ^ mine).sum(axis=1, dtype=np.int64)
            out.append(at[pick[differ <= self.rule.may_differ(n, sizes[pick])]])
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def forest(self) -> list[tuple[int, int]]:
        """A spanning forest of the links among the tile's texts."""
        rest = np.ones(len(self.ids), bool)
        found = []
        for start in range(len(self.ids)):
            if not rest[start]:
                continue
            rest[start] = False
            queue = [start]
            while queue and rest.any():
                x = queue.pop()
                for y in self.near(x, rest):
                    if self.exact(x, y):
                        rest[y] = False
                        queue.append(int(y))
                        found.append((int(self.ids[x]), int(self.ids[y])))
        return found

    def across(self, left: np.ndarray, labels: np.ndarray) -> list[tuple[int, int]]:
        """Links from the places ``left`` to texts of other labels, one for each pair of text and label."""
        found = []
        for x in left:
            wanted = labels != labels[x]
            for y in self.near(x, wanted):
                if wanted[y] and self.exact(x, y):
                    found.append((int(self.ids[x]), int(self.ids[y])))
                    wanted &= labels != labels[y]
        return found


def sketch(docs: DataFrame, rule: Rule, text_col: str = "text") -> np.ndarray:
    """How many shingles of all texts fall to each counter: 2**sketch_bits numbers, summed in tasks and then by slot."""
    bits, n = rule.sketch_bits, 1 << rule.sketch_bits
    shingle, slots = rule.shingle, min(_SLOTS, n)

    def count(batches):
        words = WordHasher()
        sums = np.zeros(n, np.int64)
        for b in slices(batches, "text"):
            h, _ = words.shingles(texts_of(b), shingle)
            sums += np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=n)
        if sums.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(slots), pa.int32()), pa.array([x.tobytes() for x in sums.reshape(slots, -1).astype("<u4")], pa.binary())], ["slot", "sums"])

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for s, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[s] = sums.get(s, 0) + np.frombuffer(x, "<u4").astype(np.int64)
        for s, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([v.astype("<i8").tobytes()], pa.binary())], ["slot", "sums"])

    rows = docs.select(docs[text_col].alias("text")).mapInArrow(count, "slot int, sums binary")
    out = np.zeros((slots, n // slots), np.int64)
    for r in rows.repartition(slots, "slot").mapInArrow(total, "slot int, sums binary").collect():
        out[r["slot"]] = np.frombuffer(r["sums"], "<i8")
    return out.reshape(-1)


def digest(u: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set of hashes."""
    return tuple(int(mix(u ^ np.uint64(x)).sum(dtype=np.uint64).view(np.int64)) for x in (0x243F6A8885A308D3, 0x13198A2E03707344))


def set_records(docs: DataFrame, rule: Rule, counters: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, h1, h2, keys, maybe_heavy, bits) of every row: set size, 128 bits that stand for the set, first shingles, bitmap.

    The first shingles whose counters reach ``heavy_from`` are in ``maybe_heavy``, all others in ``keys``.
    """
    heavy = rule.heavy_from(counters)
    shared = docs.sparkSession.sparkContext.broadcast(np.minimum(counters, (1 << 24) - 1).astype(np.uint64))
    id_type = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches):
        words = WordHasher()
        counts, shift = shared.value, np.uint64(64 - rule.sketch_bits)
        for b in slices(batches, "text"):
            h, owner = words.shingles(texts_of(b), rule.shingle)
            cuts = np.searchsorted(owner, np.arange(b.num_rows + 1))
            n, h1, h2, keys, maybe_heavy, bits = [], [], [], [], [], []
            for i in range(b.num_rows):
                u = np.unique(h[cuts[i] : cuts[i + 1]])
                n.append(len(u))
                x, y = digest(u)
                h1.append(x)
                h2.append(y)
                if len(u):
                    order = np.argsort((counts[(u >> shift).astype(np.int64)] << np.uint64(40)) | (u >> np.uint64(24)), kind="stable")
                    first = u[order[: rule.prefix(len(u))]]
                    often = counts[(first >> shift).astype(np.int64)] >= min(heavy, (1 << 24) - 1)
                    keys.append(first[~often].view(np.int64))
                    maybe_heavy.append(first[often].view(np.int64))
                    bits.append(bitmap(u, width_of(len(u))).tobytes())
                else:
                    keys.append(np.zeros(0, np.int64))
                    maybe_heavy.append(np.zeros(0, np.int64))
                    bits.append(b"")
            arrays = [b.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in (keys, maybe_heavy)), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n", "h1", "h2", "keys", "maybe_heavy", "bits"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, n bigint, h1 bigint, h2 bigint, keys array<bigint>, maybe_heavy array<bigint>, bits binary")


def groups_of(entries: DataFrame, rule: Rule) -> DataFrame:
    """From (key, id, n), dealt by key: pairs (g null, a, na, b, nb) of small groups, members (g, size, a, na) of others.

    Keys of one text are dropped. Groups of the same members are one group, known by a hash of them. A task holds 24
    bytes for each of its entries; heavy keys aren't among them (see heavy_groups).
    """

    def run(batches):
        got = [[b.column(k).to_numpy(zero_copy_only=False) for k in range(3)] for b in batches if b.num_rows]
        if not got:
            return
        key, ids, n = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.lexsort((ids, key))
        key, ids, n = key[order], ids[order], n[order]
        twice = np.concatenate([[False], (key[1:] == key[:-1]) & (ids[1:] == ids[:-1])])
        key, ids, n = key[~twice], ids[~twice], n[~twice]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        found = []
        for size in range(2, rule.pairs_up_to + 1):
            at = starts[sizes == size]
            for i in range(size):
                for j in range(i + 1, size):
                    found.append(np.stack([ids[at + i], n[at + i], ids[at + j], n[at + j]], 1))
        pairs = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
        pairs = pairs[rule.may_differ(pairs[:, 1], pairs[:, 3]) >= 0]
        pairs = np.unique(pairs, axis=0) if len(pairs) else pairs
        big = sizes > rule.pairs_up_to
        member = np.repeat(big, sizes)
        seed = np.where(member, mix(ids.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), np.uint64(0))
        name = np.add.reduceat(seed, starts).view(np.int64)
        first = np.unique(name[big], return_index=True)[1]
        rows = [np.arange(starts[k], starts[k] + sizes[k]) for k in np.flatnonzero(big)[first]]
        rows = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        g = np.repeat(name[big][first], sizes[big][first])
        cnt = np.repeat(sizes[big][first], sizes[big][first])
        none, null = len(pairs), pa.nulls(len(rows), pa.int64())
        cols = [
            pa.concat_arrays([pa.nulls(none, pa.int64()), pa.array(g, pa.int64())]),
            pa.concat_arrays([pa.nulls(none, pa.int64()), pa.array(cnt, pa.int64())]),
            pa.array(np.concatenate([pairs[:, 0], ids[rows]]), pa.int64()),
            pa.array(np.concatenate([pairs[:, 1], n[rows]]), pa.int64()),
            pa.concat_arrays([pa.array(pairs[:, 2], pa.int64()), null]),
            pa.concat_arrays([pa.array(pairs[:, 3], pa.int64()), null]),
        ]
        yield pa.RecordBatch.from_arrays(cols, ["g", "size", "a", "na", "b", "nb"])

    return entries.mapInArrow(run, "g bigint, size bigint, a bigint, na bigint, b bigint, nb bigint")


def heavy_groups(chosen: DataFrame, rule: Rule, heavy: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Splits the postings of ``maybe_heavy``: entries (key, id, n) of keys that aren't heavy, members (g, size, id, n) of those that are.

    Counted by partial sums and joined to a broadcast list of 100,000 keys at most, so that no key's postings meet in one
    task. Of heavy keys with the same texts (by number and hash) one stays.
    """
    entries = chosen.select(F.explode("maybe_heavy").alias("key"), F.col("node").alias("id"), "n")
    counts = entries.groupBy("key").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("id")).alias("_who")).where(F.col("size") >= heavy)
    counts = scratch.save(counts, "heavy")
    one = counts.groupBy("size", "_who").agg(F.min("key").alias("key"))
    members = entries.join(F.broadcast(one), "key").select(F.xxhash64("key").alias("g"), "size", "id", "n")
    return entries.join(F.broadcast(counts.select("key")), "key", "left_anti"), members


def _tiles(rows: DataFrame, rule: Rule, exact: bool, across: bool) -> DataFrame:
    """Links (a, b) within tiles of (t1, t2, id, n, data, label, mine); a tile is worked off as one."""

    def work(part: list[tuple]):
        ids, n, data, label, mine = (np.array(x) if k in (0, 1, 3, 4) else x for k, x in enumerate(zip(*part, strict=True)))
        once = np.unique(ids, return_index=True)[1]
        if across:
            # a row that is in the tile in both roles counts as one of those that look for links
            mine = np.array([mine[ids == i].any() for i in ids[once]])
        data = [data[i] for i in once]
        sets = [np.frombuffer(x, np.uint64) for x in data] if exact else None
        bits = [bitmap(s, width_of(len(s))) for s in sets] if exact else [np.frombuffer(x, np.uint64) for x in data]
        tile = Tile(rule, ids[once], n[once], bits, sets)
        return tile.across(np.flatnonzero(mine), label[once]) if across else tile.forest()

    def run(batches):
        name, held = None, []

        def emit():
            links = work(held) if len(held) > 1 else []
            if links:
                a, b = np.array(links, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:2] != name:
                    yield from emit()
                    name, held = row[:2], []
                held.append(row[2:])
        yield from emit()

    dealt = rows.select("t1", "t2", "id", "n", "data", "label", "mine").repartition("t1", "t2").sortWithinPartitions("t1", "t2")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def link_groups(members: DataFrame, rule: Rule, exact: bool, scratch: Scratch) -> DataFrame:
    """Links (a, b) that connect within each group what is linked in it; members: (g, size, id, n, data).

    A group over ``block`` texts is split by a hash of the id, its pivots added to each part. What the parts and the
    pivots leave apart from the group's largest component is then compared with the texts of the whole group whose
    size allows a link, tile by tile: sizes lie in bands, and only texts of the same band or of the next ones can link.
    """
    blocks = F.ceil(F.col("size") / rule.block).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    order = F.xxhash64("id"), F.col("id")
    plain = F.lit(0).cast("bigint").alias("label"), F.lit(False).alias("mine")
    small = members.where(F.col("size") <= rule.block)
    large = scratch.save(members.where(F.col("size") > rule.block), "large")
    links = _tiles(small.select(F.col("g").alias("t1"), F.lit(0).alias("t2"), "id", "n", "data", *plain), rule, exact, False)
    if large.isEmpty():
        return links
    # the least of the parts' least, so that a group isn't ranked in one task
    pivots = large.select("g", "id", own.alias("_part")).withColumn("_p", F.row_number().over(Window.partitionBy("g", "_part").orderBy(*order))).where(F.col("_p") <= rule.pivots)
    pivots = pivots.withColumn("_p", F.row_number().over(Window.partitionBy("g").orderBy(*order))).where(F.col("_p") <= rule.pivots).select("g", "id")
    spread = large.join(pivots, ["g", "id"]).withColumn("t2", F.explode(F.sequence(F.lit(0), blocks - 1)))
    parts = large.withColumn("t2", own).unionByName(spread).select(F.col("g").alias("t1"), "t2", "id", "n", "data", *plain)
    first = scratch.save(_tiles(parts, rule, exact, False), "links")
    label = components(first, scratch)
    told = scratch.save(large.join(label, "id", "left").withColumn("label", F.coalesce("label", "id")), "told")
    most = told.groupBy("g", "label").agg(F.count("*").alias("c")).groupBy("g").agg(F.max_by("label", F.struct("c", -F.col("label"))).alias("main"), F.sum("c").alias("all"), F.max("c").alias("c"))
    split = most.where("c < all").select("g", "main", (F.ceil((F.col("all") - F.col("c")) / rule.wide)).cast("int").alias("lefts"))
    # with sizes r <= s linked, 100 r >= percent s: their bands differ by one at most
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / rule.percent)) + 1e-9).cast("int") if rule.percent < 100 else F.col("n").cast("int")
    there = told.join(split, "g").withColumn("band", band)
    bands = there.groupBy("g", "band").agg(F.ceil(F.count("*") / rule.wide).cast("int").alias("blocks"))
    left = F.pmod(F.xxhash64("id"), F.col("lefts")).cast("int")
    near = F.explode(F.array(*(F.col("band") + k for k in (-1, 0, 1))))
    rest = there.where("label <> main").withColumn("x", left).withColumn("band", near).join(bands, ["g", "band"]).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("mine", F.lit(True))
    whole = there.join(bands, ["g", "band"]).withColumn("y", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1))).withColumn("mine", F.lit(False))
    again = rest.unionByName(whole).select(F.xxhash64("g", "x", "band").alias("t1"), F.col("y").alias("t2"), "id", "n", "data", "label", "mine")
    return links.union(first).union(_tiles(again, rule, exact, True))


def _maybe(ids: DataFrame, most_bits: int = 1 << 27):
    """A predicate that is true for all ``ids`` and few others: a Bloom filter of 16 MB at most, whatever their number."""
    n = ids.count()
    bits = min(most_bits, 1 << max(16, (16 * max(1, n)).bit_length()))

    def places(k: np.ndarray) -> list[np.ndarray]:
        h = mix(k.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        g = (h >> np.uint64(32)) | np.uint64(1)
        return [((h + np.uint64(i) * g) % np.uint64(bits)).astype(np.int64) for i in range(4)]

    def build(batches):
        field = np.zeros(bits, bool)
        for b in batches:
            for p in places(b.column(0).to_numpy(zero_copy_only=False)):
                field[p] = True
        packed = np.packbits(field)
        step = 1 << 13
        for k in range(0, len(packed), step):
            if packed[k : k + step].any():
                yield pa.RecordBatch.from_arrays([pa.array([k // step], pa.int32()), pa.array([packed[k : k + step].tobytes()], pa.binary())], ["slot", "bits"])

    def merge(batches):
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for s, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found[s] = found.get(s, np.uint8(0)) | np.frombuffer(x, np.uint8)
        for s, x in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["slot", "bits"])

    field = np.zeros(bits // 8, np.uint8)
    for r in ids.mapInArrow(build, "slot int, bits binary").repartition("slot").mapInArrow(merge, "slot int, bits binary").collect():
        field[r["slot"] << 13 : (r["slot"] << 13) + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    shared = ids.sparkSession.sparkContext.broadcast(field)

    @F.pandas_udf("boolean")
    def maybe(k: pd.Series) -> pd.Series:
        known = k.notna().to_numpy()
        v = k.fillna(0).to_numpy().astype(np.int64)
        hit = known
        for p in places(v):
            hit = hit & ((shared.value[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1).astype(bool)
        return pd.Series(hit)

    return maybe


def sets_of(docs: DataFrame, ids: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, h1, h2, data) for the rows whose id may be among ``ids``: the sorted set as bytes. The text isn't shuffled."""

    def run(batches):
        words = WordHasher()
        for b in slices(batches, "text"):
            h, owner = words.shingles(texts_of(b), rule.shingle)
            cuts = np.searchsorted(owner, np.arange(b.num_rows + 1))
            sets = [np.unique(h[cuts[i] : cuts[i + 1]]) for i in range(b.num_rows)]
            marks = [digest(u) for u in sets]
            cols = [[len(u) for u in sets], [m[0] for m in marks], [m[1] for m in marks]]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols), pa.array([u.tobytes() for u in sets], pa.binary())], ["id", "n", "h1", "h2", "data"])

    rows = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].alias("text"))
    return rows.where(_maybe(ids)("id")).mapInArrow(run, "id bigint, n bigint, h1 bigint, h2 bigint, data binary")


def _likely(pairs: DataFrame, bits: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, na, b, nb) that their bitmaps don't rule out, as (a, b)."""

    def run(batches):
        for b in batches:
            na, nb = b.column(1).to_pylist(), b.column(3).to_pylist()
            keep = []
            for r, s, x, y in zip(na, nb, b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                while len(x) > len(y):
                    x = _fold(x)
                while len(y) > len(x):
                    y = _fold(y)
                keep.append(int(np.bitwise_count(x ^ y).sum()) <= int(rule.may_differ(r, s)))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(2).filter(keep)], ["a", "b"])

    a, b = bits.select(F.col("id").alias("a"), F.col("bits").alias("xa")), bits.select(F.col("id").alias("b"), F.col("bits").alias("xb"))
    rows = pairs.join(a, "a").join(b, "b").select("a", "na", "b", "nb", "xa", "xb")
    return rows.mapInArrow(run, "a bigint, b bigint")


def join_components(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row; component_id is the least id that links reach, the row's own included.

    Null text is the empty text: its set is empty and links with nothing. A text of fewer words than a shingle has its
    whole sequence as its one shingle. A row of null id links with nothing and has a null component. Repeated rows are in
    one component; rows of one id with different texts are one document, with the links of all of them. Other columns
    are not read; an empty table gives no rows. Ids must be integers.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    counters = sketch(docs, rule, text_col)
    records = scratch.save(set_records(docs, rule, counters, id_col, text_col).withColumn("id", F.col("id").cast("bigint")), "records")
    rows, same = records.select("id", "n", "h1", "h2"), ["n", "h1", "h2"]
    known = rows.where("n > 0 and id is not null")
    repeated = not known.groupBy("id").count().where("count > 1").isEmpty()
    single = (lambda df: df.dropDuplicates(["node"])) if repeated else (lambda df: df)
    # a class of equal sets is a node, which the row of its least id stands for; ids that repeat can't name their classes
    node = F.monotonically_increasing_id() if repeated else F.col("id")
    classes = scratch.save(known.groupBy(*same).agg(F.min("id").alias("id")).withColumn("node", node), "classes")
    chosen = scratch.save(single(records.where("n > 0").join(classes, [*same, "id"])).select("node", "n", "keys", "maybe_heavy", "bits"), "chosen")
    total = chosen.agg(F.sum(F.size("keys") + F.size("maybe_heavy"))).first()[0] or 0
    entries = chosen.select(F.explode("keys").alias("key"), F.col("node").alias("id"), "n")
    heavy, heavy_members = rule.heavy_from(counters), None
    if counters.max() >= heavy:
        more, heavy_members = heavy_groups(chosen, rule, heavy, scratch)
        entries = entries.unionByName(more)
    entries = entries.repartition(max(spark.sparkContext.defaultParallelism, -(-total // 400_000)), "key")
    groups = scratch.save(groups_of(entries, rule), "groups")
    pairs = groups.where("g is null").select("a", "na", "b", "nb").distinct()
    members = groups.where("g is not null").select("g", "size", F.col("a").alias("id"), F.col("na").alias("n")).distinct()
    if heavy_members is not None:
        members = members.unionByName(heavy_members)
    bits = chosen.select(F.col("node").alias("id"), "bits")
    tied = link_groups(members.join(bits.withColumnRenamed("bits", "data"), "id"), rule, False, scratch)
    likely = scratch.save(_likely(pairs, bits, rule).union(tied).distinct(), "likely")
    cluster = scratch.save(components(likely, scratch).select(F.col("id").alias("node"), F.col("label").alias("g")).join(classes, "node"), "clusters")
    sizes = cluster.groupBy("g").agg(F.count("*").alias("size"))
    sets = sets_of(docs, cluster.select("id"), rule, id_col, text_col)
    tagged = single(cluster.join(sizes, "g").join(sets, [*same, "id"])).select("g", "size", F.col("node").alias("id"), "n", "data")
    links = link_groups(tagged, rule, True, scratch)
    if repeated:
        # rows of one id with different sets tie their classes together
        of = known.join(classes.select(*same, "node"), same).select("id", "node").distinct()
        links = links.union(of.join(of.groupBy("id").agg(F.min("node").alias("least")), "id").select(F.col("node").alias("a"), F.col("least").alias("b")))
    label = components(scratch.save(links, "exact"), scratch).withColumnRenamed("id", "node")
    named = classes.join(label, "node", "left").withColumn("least", F.col("label"))
    if repeated:
        named = scratch.save(named.drop("least"), "named")
        named = named.join(named.where("label is not null").groupBy("label").agg(F.min("id").alias("least")), "label", "left")
    named = named.select(*same, F.coalesce("least", "id").alias("component"))
    out = rows.join(named, same, "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without those linked to a row of a smaller id: one row of each component stays.

    Of repeated rows of one id one stays; rows of null id and of empty text all stay.
    """
    found = join_components(docs, rule, id_col, text_col).where(F.col(id_col).isNotNull())
    drop = found.where(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias("_id")).distinct()
    kept = docs.join(drop, docs[id_col] == drop["_id"], "left_anti")
    again = docs.where(docs[id_col].isNotNull()).groupBy(docs[id_col].alias("_id")).count().where("count > 1").select("_id")
    if again.isEmpty():
        return kept
    single = kept.join(again, kept[id_col] == again["_id"], "left_anti")
    multiple = kept.join(again, kept[id_col] == again["_id"], "left_semi")
    return single.unionByName(multiple.dropDuplicates([id_col]))


#: DuckDB SQL of op5: links by an inverted index over the classes of equal sets, then the least id along the links.
OP5_SQL = r"""with recursive split as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
word as (select doc_id, len(w) as n, unnest(w) as x, generate_subscripts(w, 1) as p from split),
run as (select doc_id, n, p, concat_ws(' ', x, lead(x, 1) over near, lead(x, 2) over near, lead(x, 3) over near) as s from word window near as (partition by doc_id order by p)),
sets as materialized (select doc_id, list_sort(list(distinct s)) as s from run where p = 1 or p <= n - 3 group by doc_id),
class as materialized (select min(doc_id) as id, len(s) as n, s from sets group by s),
shingle as materialized (select id, n, unnest(s) as x from class),
link as (select a.id as a, b.id as b from shingle a join shingle b on a.x = b.x and a.id < b.id and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) group by a.id, b.id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
edge as materialized (select a, b from link union all select b, a from link),
reach(id, root) as (select id, id from class union select e.b, r.root from reach r join edge e on r.id = e.a where r.root < e.b),
least_id as (select id, min(root) as root from reach group by id)
select d.doc_id, coalesce(len(s.s), 0)::bigint as n_shingles, coalesce(l.root, d.doc_id) as component_id from documents d left join sets s on s.doc_id = d.doc_id left join class c on c.s = s.s left join least_id l on l.id = c.id"""


def op5_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), Rule(shingle=4, percent=85))
