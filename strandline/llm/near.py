"""Groups of nearly equal texts, by covering locality-sensitive hashing over shared grams.

Texts are sets of their distinct 4-character substrings (grams). Texts x and y of likeness (Jaccard) at least T share at least
T * max(|x|, |y|) grams. Put all grams into one fixed order, rarest first: then the first |x| - ceil(T * max(|x|, |y|)) + s grams of x and
as many less of y share at least s grams. Every gram has a code, one of `classes` bits; a mask per class looks at the grams of this prefix
that have its bit, and a table per mask has a key for each `depth` grams that it looks at together. With (depth - 1) * classes < s some
mask sees `depth` shared grams, so the two texts have a key in common: no pair within the radius is missed, whatever the order
of the grams and the codes are.

The masks of the plain scheme cover the grams in which two texts differ. It was built and measured before this one: texts of one
template differ in only about 1.7 times as many grams as the radius allows, so each pair of them met several times (3.4 comparisons a pair
of texts in all); the README has the figures. Masks over what is shared, rarest first, never look at the template.

Keys that many texts have are cut into tiles. Texts with a key in common are compared by the parity bits of their grams
(a bound that never loses a pair), and what is left by the grams themselves.

All keys together take many times the room of the texts. They are made, shuffled and compared part by part, a key's grams saying which part
it is in, so that on disk there is never more than a part's; what the keys are made of is worked out once and kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.session import files, scratch_path

LIKENESS = 0.65
GRAM = 4
#: Low bits of a key that hold the text's size; larger sizes stand as the largest and are let through to the exact comparison.
SIZE_BITS = 14
LARGEST = (1 << SIZE_BITS) - 1
WORDS = 4
#: Rows that one block of comparisons takes from a bucket.
BLOCK = 256
#: Up to this size the buckets of one size are compared together.
SMALL = 24
#: Slots in which grams and keys are counted: 4 MB for the order of grams and 1 MB for keys with many texts, whatever the corpus.
SLOT_BITS, KEY_BITS = 20, 16
#: Keys are counted over one text in so many; a key with more rows than TILE by that count is cut into tiles of about TILE rows a side.
COUNTED = 8
TILE = 8192
#: Bytes of a row of the tables; those of a part of all rows: so many times the texts' own, and at least so many.
ROW_BYTES, PART_SHARE, PART_LEAST = 8 * (2 + WORDS), 3, 192_000_000
#: Texts of the sample by which the depth is chosen, and what a row and a comparison cost in seconds, as measured.
PLAN_TEXTS = 768
ROW_S, COMPARISON_S = 2.5e-6, 5e-9


@dataclass(frozen=True)
class Plan:
    """Of the shared grams, `share` of the least size of a band are looked for, and `depth` of them make a key; every plan is exact.

    Bands are those of the larger size of a pair, each from a power of 2 to the next, so that a text's keys grow with its size and no faster.
    """

    share: float
    depth: int

    @lru_cache(None)  # noqa: B019  three plans
    def band(self, band: int, likeness: float) -> tuple[int, int, int]:
        """(s, depth, classes) of the band of sizes from 1 << band: s shared grams are sure."""
        low = 1 << band
        shared = min(math.ceil(likeness * low - 1e-9), max(self.depth, int(self.share * low)))
        depth = min(self.depth, shared)
        return shared, depth, -(-shared // (depth - 1)) - 1 if depth > 1 else 1


PLANS = (Plan(0.14, 2), Plan(0.18, 3), Plan(0.3, 4))


def normal_text(text: Column) -> Column:
    """Lower case, one blank for each run of anything but letters and digits, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


@lru_cache(2_000)
def grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + GRAM] for i in range(len(text) - GRAM + 1))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash per distinct gram of each text, in order, one text after another; and the number of each text's."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    n = max(0, len(points) - GRAM + 1)
    value = np.zeros(n, np.uint64)
    for j in range(GRAM):
        value = _mixed(value + points[j : j + n])
    owner = np.repeat(np.arange(len(texts)), length)[:n]
    inside = np.arange(n) + GRAM <= np.cumsum(length)[owner]
    value, owner = value[inside], owner[inside]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[fresh], np.bincount(owner[fresh], minlength=len(texts))


def parity_bits(hashes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """WORDS words of bits a text, each the parity of the grams that fall on it: two texts differ in at least as many grams as bits."""
    place = ((hashes >> np.uint64(32)) % np.uint64(64 * WORDS)).astype(np.int64)
    owner = np.repeat(np.arange(len(size)), size)
    odd = np.bincount(owner * 64 * WORDS + place, minlength=len(size) * 64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(size), -1), axis=1).view(np.int64)


def blocks(texts: list[str], most: int = 400_000) -> Iterator[slice]:
    """Slices of texts of about `most` characters, a longer text by itself."""
    begin, total = 0, 0
    for i, text in enumerate(texts):
        if total and total + len(text) > most:
            yield slice(begin, i)
            begin, total = i, 0
        total += len(text)
    if texts:
        yield slice(begin, len(texts))


def slot_of(hashes: np.ndarray, bits: int = SLOT_BITS) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


@lru_cache(64)
def _subsets(n: int, depth: int) -> np.ndarray:
    """The places of all `depth` of n things, a row each."""
    rows = np.arange(n)[:, None]
    for _ in range(depth - 1):
        rows = np.concatenate([np.concatenate([np.repeat(rows[i : i + 1], n - rows[i, -1] - 1, axis=0), np.arange(rows[i, -1] + 1, n)[:, None]], axis=1) for i in range(len(rows))]) if len(rows) else np.zeros((0, rows.shape[1] + 1), np.int64)
    return rows


def _bands(size: np.ndarray, plan: Plan, likeness: float) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(band, depth, classes, grams of each text that are looked at) of each band that pairs of the texts may be in."""
    lowest = np.frexp(np.maximum(size, 1))[1] - 1
    highest = np.frexp(np.maximum(1, np.floor(size / likeness + 1e-9)))[1] - 1
    for band in range(int(lowest.min(initial=1)), int(highest.max(initial=0)) + 1):
        shared, depth, classes = plan.band(band, likeness)
        fewest = np.ceil(likeness * np.maximum(size, 1 << band) - 1e-9).astype(np.int64)
        yield band, depth, classes, np.where((lowest <= band) & (band <= highest), np.minimum(size, size - fewest + shared), 0)


def prefixes(hashes: np.ndarray, size: np.ndarray, often: np.ndarray, plan: Plan, likeness: float) -> tuple[np.ndarray, np.ndarray]:
    """The grams that any band looks at, in 32 bits, rarest first, one text after another; and how many each text has. Grams of equal bits only add keys in common."""
    owner = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((hashes, owner << 32 | often[slot_of(hashes)]))
    place = np.arange(len(hashes)) - np.repeat(np.cumsum(size) - size, size)
    most = np.zeros(len(size), np.int64)
    for *_, length in _bands(size, plan, likeness):
        most = np.maximum(most, length)
    return (hashes[order][place < most[owner]] >> np.uint64(32)).astype(np.uint32), most


def prefix_keys(grams_: np.ndarray, most: np.ndarray, size: np.ndarray, plan: Plan, likeness: float, part: int = 0, parts: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The keys of texts, given by their prefixes, in all tables of the bands that a pair with them may be in, and the text that each key is of: those of one part."""
    owner = np.repeat(np.arange(len(size)), most)
    place = np.arange(len(grams_)) - np.repeat(np.cumsum(most) - most, most)
    value = grams_.astype(np.uint64)
    codes = _mixed(value)
    keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for band, depth, classes, length in _bands(size, plan, likeness):
        seen = place < length[owner]
        group = owner[seen].astype(np.uint64) * np.uint64(classes) + codes[seen] % np.uint64(classes)
        if len(size) * classes < 1 << 32:
            packed = np.sort(group << np.uint64(32) | value[seen])
            group, seen_grams = (packed >> np.uint64(32)).astype(np.int64), packed & np.uint64(2**32 - 1)
        else:
            order = np.lexsort((value[seen], group))
            group, seen_grams = group[order].astype(np.int64), value[seen][order]
        lot = (_mixed(seen_grams ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(parts)).astype(np.uint32)
        begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
        count = np.diff(np.append(begin, len(group)))
        for n in np.unique(count[count >= depth]).tolist():
            chosen = begin[count == n]
            subsets = _subsets(n, depth)
            at = chosen[:, None] + np.arange(n)
            if parts > 1:
                lots = lot[at]
                which, subset = np.nonzero(sum(lots[:, column] for column in subsets.T) % np.uint32(parts) == part)
            else:
                which, subset = np.repeat(np.arange(len(chosen)), len(subsets)), np.tile(np.arange(len(subsets)), len(chosen))
            of = group[chosen][which]
            key = (of % classes + (band << 32) + 1).astype(np.uint64)
            for column in subsets.T:
                key = _mixed(key + seen_grams[chosen[which] + column[subset]])
            keys.append(key)
            owners.append(of // classes)
    return np.concatenate(keys), np.concatenate(owners)


def text_keys(hashes: np.ndarray, size: np.ndarray, often: np.ndarray, plan: Plan, likeness: float) -> tuple[np.ndarray, np.ndarray]:
    """All keys of texts given by their grams, and the text that each key is of."""
    return prefix_keys(*prefixes(hashes, size, often, plan, likeness), size, plan, likeness)


def _summed(texts: DataFrame, count, bits: int) -> np.ndarray:
    """The sum over all texts of count(hashes, sizes) -> slots, in 1 << bits slots; added up per task before the shuffle."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            listed = batch.column(0).to_pylist()
            for block in blocks(listed):
                total += np.bincount(count(*gram_hashes(listed[block])), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])

    summed = texts.select("text").mapInArrow(add, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << bits, np.int64)
    out[summed["slot"].to_numpy(np.int64)] = summed["n"].to_numpy(np.int64)
    return out


def gram_counts(texts: DataFrame) -> np.ndarray:
    """How many texts have a gram of each slot, over all texts: the order of the grams."""
    return np.minimum(_summed(texts, lambda hashes, _: slot_of(hashes), SLOT_BITS), 2**31 - 1).astype(np.int32)


def choose_plan(texts: DataFrame, often: np.ndarray, likeness: float = LIKENESS) -> Plan:
    """The plan of least cost, by the rows and the squares of the bucket sizes of at most PLAN_TEXTS texts, scaled up. Any plan finds the same pairs."""
    many = texts.count()
    share = int(min(1.0, 1.2 * PLAN_TEXTS / max(1, many)) * (1 << 30))
    sample = texts.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) < share).select("text").limit(PLAN_TEXTS).collect()
    hashed = gram_hashes([r.text for r in sample])

    def cost(plan: Plan) -> float:
        keys = text_keys(*hashed, often, plan, likeness)[0]
        _, n = np.unique(keys, return_counts=True)
        scale = many / max(1, len(sample))
        return len(keys) * scale * ROW_S + float((n * (n - 1.0)).sum()) / 2 * scale * scale * COMPARISON_S

    return min(PLANS, key=cost)


BITS = [f"bits{i}" for i in range(WORDS)]


def _prepared(texts: DataFrame, often, plan: Plan, likeness: float) -> DataFrame:
    """(id, size, bits0, ..., prefix): what the rows of a text are made of. often: broadcast."""

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, listed = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for block in blocks(listed):
                hashes, size = gram_hashes(listed[block])
                grams_, most = prefixes(hashes, size, often.value, plan, likeness)
                ends = np.append(0, np.cumsum(most)) * grams_.itemsize
                held, raw = parity_bits(hashes, size), grams_.tobytes()
                prefix = pa.array([raw[i:j] for i, j in zip(ends[:-1], ends[1:])], pa.binary())
                columns = [ids[block], size, *np.ascontiguousarray(held.T)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), prefix], names=["id", "size", *BITS, "prefix"])

    return texts.select("id", "text").mapInArrow(prepare, ", ".join(f"{name} bigint" for name in ("id", "size", *BITS)) + ", prefix binary")


def _tables(prepared: DataFrame, tiles, plan: Plan, likeness: float, part: int, parts: int) -> DataFrame:
    """(key, id, bits0, ...): every text under each of its keys of a part; under a key of n tiles in a row and a column of them. tiles: broadcast."""
    names = ["key", "id", *BITS]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_batch, sizes, listed = np.column_stack([batch.column(0), *batch.columns[2:-1]]), batch.column(1).to_numpy(), batch.column(2 + WORDS).to_pylist()
            for block in blocks(listed):
                held, size = of_batch[block], sizes[block]
                most = np.fromiter(map(len, listed[block]), np.int64, len(size)) // 4
                key, owner = prefix_keys(np.frombuffer(b"".join(listed[block]), np.uint32), most, size, plan, likeness, part, parts)
                many = tiles.value[slot_of(key, KEY_BITS)].astype(np.int64)
                if (many > 1).any():  # a tile for each pair of the text's own part and another part of the key's texts
                    n = np.repeat(many, many)
                    at = np.arange(len(n)) - np.repeat(np.cumsum(many) - many, many)
                    key, owner = np.repeat(key, many), np.repeat(owner, many)
                    mine = (_mixed(key ^ held[owner, 0].view(np.uint64)) % n.astype(np.uint64)).astype(np.int64)
                    tile = np.minimum(mine, at) * n + np.maximum(mine, at) + 1
                    key = np.where(n > 1, _mixed(key + tile.astype(np.uint64)), key)
                key = key & np.uint64(~LARGEST & (2**64 - 1)) | np.minimum(size, LARGEST).astype(np.uint64)[owner]
                for begin in range(0, len(key), 200_000):
                    part_ = slice(begin, begin + 200_000)
                    columns = [key[part_].view(np.int64), *np.ascontiguousarray(held[owner[part_]].T)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return prepared.mapInArrow(emit, ", ".join(f"{name} bigint" for name in names))


class Rows:
    """Rows (key, id, bits0, ...) by column, and which of them may be alike by their sizes and parity bits."""

    def __init__(self, rows: np.ndarray, likeness: float) -> None:
        self.id = np.ascontiguousarray(rows[:, 1])
        self.size = (rows[:, 0] & LARGEST).astype(np.int32)
        self.words = [np.ascontiguousarray(rows[:, 2 + w]).view(np.uint64) for w in range(WORDS)]
        factor = (1 - likeness) / (1 + likeness)
        self.buffers = np.empty((BLOCK, BLOCK), np.uint64), np.empty((BLOCK, BLOCK), np.uint8), np.empty((BLOCK, BLOCK), np.uint16)
        #: The least sum of sizes at which texts may differ in so many bits.
        self.least = np.ceil((np.arange(64 * WORDS + 1) - 1e-9) / factor).astype(np.int32)

    def close(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether rows x and y, pair by pair, may be alike."""
        differ = sum(np.bitwise_count(word[x] ^ word[y]).astype(np.int32) for word in self.words)
        size = self.size[x] + self.size[y]
        return (self.least[differ] <= size) | (np.maximum(self.size[x], self.size[y]) == LARGEST)

    def close_across(self, i: int, j: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of a block of rows from i with one from j that may be alike: first by the bound of the largest sizes, then by their own."""
        n, m = min(BLOCK, end - i), min(BLOCK, end - j)
        bits, count, differ = (buffer[:n, :m] for buffer in self.buffers)
        differ[:] = 0
        for word in self.words:
            np.bitwise_xor(word[i : i + n, None], word[None, j : j + m], out=bits)
            np.bitwise_count(bits, out=count)
            np.add(differ, count, out=differ)
        x, y = self.size[i : i + n].max(), self.size[j : j + m].max()
        bound = 64 * WORDS if max(x, y) == LARGEST else int(np.searchsorted(self.least, x + y, side="right")) - 1
        flat = np.flatnonzero(differ <= bound)
        a, b = i + flat // m, j + flat % m
        keep = self.close(a, b)
        return a[keep], b[keep]


def bucket_pairs(rows: Rows, starts: np.ndarray, likeness: float) -> np.ndarray:
    """Candidate pairs (id, id) of all buckets; starts = where each bucket begins, and the end."""
    left, right = [], []
    size = np.diff(starts)
    for n in np.unique(size[size > 1]).tolist():
        where = starts[:-1][size == n]
        if n <= SMALL:  # many small buckets: one comparison for each pair of places
            for i in range(n):
                for j in range(i + 1, n):
                    at = where[rows.close(where + i, where + j)]
                    left.append(rows.id[at + i])
                    right.append(rows.id[at + j])
        else:
            for begin in where.tolist():
                for i in range(begin, begin + n, BLOCK):
                    for j in range(i, begin + n, BLOCK):
                        if rows.size[j] < LARGEST and rows.size[j] * likeness > rows.size[min(i + BLOCK, begin + n) - 1] + 1e-9:
                            break  # a bucket is sorted by size: from here on all are too large
                        x, y = rows.close_across(i, j, begin + n)
                        left.append(rows.id[x])
                        right.append(rows.id[y])
    if not left:
        return np.zeros((0, 2), np.int64)
    a, b = np.concatenate(left), np.concatenate(right)
    a, b = np.minimum(a, b), np.maximum(a, b)
    apart = a != b
    a, b = a[apart], b[apart]
    order = np.argsort(_mixed(a.view(np.uint64)) ^ b.view(np.uint64))
    a, b = a[order], b[order]
    fresh = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)]
    return np.stack([a[fresh], b[fresh]], axis=1)


def _candidates(tables: DataFrame, likeness: float) -> DataFrame:
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []

        def drained(rows: np.ndarray) -> pa.RecordBatch:
            bucket = rows[:, 0] >> SIZE_BITS
            starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            pairs = bucket_pairs(Rows(rows, likeness), starts, likeness)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        total = 0
        for batch in batches:
            rows = np.stack([column.to_numpy() for column in batch.columns], axis=1)
            kept.append(rows)
            total += len(rows)
            if total > 200_000 and rows[0, 0] >> SIZE_BITS != rows[-1, 0] >> SIZE_BITS:  # the last bucket may go on in the next batch
                rows = np.concatenate(kept)
                cut = int(np.searchsorted(rows[:, 0], rows[-1, 0] >> SIZE_BITS << SIZE_BITS))
                yield drained(rows[:cut])
                kept, total = [rows[cut:]], len(rows) - cut
        if kept and total:
            yield drained(np.concatenate(kept))

    sorted_ = tables.repartition(F.shiftright("key", SIZE_BITS)).sortWithinPartitions("key")
    return sorted_.mapInArrow(compare, "a bigint, b bigint")


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it the shuffle files of a query go when the query ends, and not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def part_count(rows: int, text_bytes: int, least: int = PART_LEAST) -> int:
    """The number of parts in which so many rows of the tables are shuffled."""
    return max(1, -(-rows * ROW_BYTES // max(least, PART_SHARE * text_bytes)))


def alike_texts(texts: DataFrame, likeness: float = LIKENESS, plan: Plan | None = None, tile: int = TILE, part_least: int = PART_LEAST) -> DataFrame:
    """(a, b): ids of the pairs of distinct texts (id bigint, text string) that are at least `likeness` alike.

    `tile`: rows of a tile's side. `part_least`: bytes of rows up to which a part isn't cut further.
    """
    spark = texts.sparkSession
    broadcast = spark.sparkContext.broadcast
    path, prepared_path, pairs_path = (scratch_path(spark, what) for what in ("texts", "prefixes", "pairs"))
    with _shuffles_dropped(spark):
        texts.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "id").write.parquet(path)  # they are read several times
        texts = spark.read.schema(texts.schema).parquet(path)
        counted = gram_counts(texts)
        plan = choose_plan(texts, counted, likeness) if plan is None else plan
        often = broadcast(counted)
        some = texts.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(COUNTED)) == 0)
        rows = _summed(some, lambda hashes, size: slot_of(text_keys(hashes, size, often.value, plan, likeness)[0], KEY_BITS), KEY_BITS) * COUNTED
        over = rows - int(np.median(rows))  # without what other keys of a slot have
        many = np.minimum(np.maximum(1, -(-over // tile)), 2**15 - 1)
        tiles = broadcast(many.astype(np.int16))
        parts = part_count(int((rows * many).sum()), texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0, part_least)
        prepared = _prepared(texts, often, plan, likeness)
        prepared.write.parquet(prepared_path)
        prepared = spark.read.schema(prepared.schema).parquet(prepared_path)
        for part in range(parts):
            _candidates(_tables(prepared, tiles, plan, likeness, part, parts), likeness).write.mode("append").parquet(pairs_path)
    files(spark).delete(prepared_path)
    pairs = spark.read.schema("a bigint, b bigint").parquet(pairs_path).distinct()
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))

    def confirmed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(map(grams, batch["text_a"]), map(grams, batch["text_b"])):
                both = len(x & y)
                keep.append(both >= likeness * (len(x) + len(y) - both) - 1e-12)
            yield batch.loc[keep, ["a", "b"]]

    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInPandas(confirmed, "a bigint, b bigint")


#: Low bits of a text's id by which texts of one hash are told apart.
APART_BITS = 8


def _hash(text: Column) -> Column:
    return F.xxhash64(text)


def _texts(members: DataFrame) -> DataFrame:
    """(id, text): the distinct texts, ids by hash; texts of one hash are numbered, so that no two have one id."""
    hashed = members.select("text").distinct().withColumn("h", F.shiftright(_hash(F.col("text")), APART_BITS))
    number = F.row_number().over(Window.partitionBy("h").orderBy("text")) - 1
    safe = F.when(number < 1 << APART_BITS, number).otherwise(F.raise_error(F.lit("too many texts of one hash")).cast("int"))
    return hashed.select((F.shiftleft("h", APART_BITS) + safe).alias("id"), "text")


def _members(rows: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(row_id, text): the rows and their normal texts; texts without a gram have no likeness and are left out."""
    return rows.select(F.col(id_column).alias("row_id"), normal_text(F.col(text_column)).alias("text")).where(F.length("text") >= GRAM)


def near_duplicate_pairs(rows: DataFrame, id_column: str = "qa_id", text_column: str = "question", likeness: float = LIKENESS) -> DataFrame:
    """(<id>_a, <id>_b), smaller id first: all pairs of rows whose texts are at least `likeness` alike.

    Likeness is that of the sets of distinct 4-character substrings of the normal texts. Equal texts are compared once and
    their rows paired at the end. A pair is named by two ids, so rows without an id are in none; NULL texts and texts of less than 4 characters are
    like none. Rows of equal id aren't paired with each other. Empty input gives an empty result; other columns are ignored.
    """
    named = _members(rows, id_column, text_column).where(F.col("row_id").isNotNull())
    texts = _texts(named)
    found = alike_texts(texts, likeness)
    members = named.join(texts, "text")
    a, b = (members.select(F.col("row_id").alias(f"row_{s}"), F.col("id").alias(s)) for s in "ab")
    copies = a.join(b, F.col("a") == F.col("b")).where(F.col("row_a") < F.col("row_b")).select("row_a", "row_b")
    others = found.join(a, "a").join(b, "b").where(F.col("row_a") != F.col("row_b")).select("row_a", "row_b")
    return copies.unionByName(others).select(
        F.least("row_a", "row_b").alias(f"{id_column}_a"), F.greatest("row_a", "row_b").alias(f"{id_column}_b")
    )


def near_duplicate_classes(rows: DataFrame, id_column: str = "qa_id", text_column: str = "question", likeness: float = LIKENESS) -> DataFrame:
    """(<id>, class_id, n_links): each row, the smallest id among its exact copies, and the number of other texts it is like.

    The form for groups of any size: copies aren't expanded into pairs. Every row comes out. Copies are rows of equal normal texts, those of
    under 4 characters too, which are like no other text; a NULL text is a copy of none and its row is its own class. Rows without an id
    keep it so; their class is that of their copies with one, or NULL.
    """
    named = rows.select(F.col(id_column).alias("row_id"), normal_text(F.col(text_column)).alias("text"))
    first = named.where(F.col("text").isNotNull()).groupBy("text").agg(F.min("row_id").alias("class_id"))
    texts = _texts(first.where(F.length("text") >= GRAM))
    found = alike_texts(texts, likeness)
    links = found.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))
    classes = first.join(texts.join(links, "id").select("text", "n_links"), "text", "left")
    n_links = F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")
    known = named.join(classes, "text").select(F.col("row_id").alias(id_column), "class_id", n_links)
    none = named.where(F.col("text").isNull()).select(F.col("row_id").alias(id_column), F.col("row_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return known.unionByName(none)
