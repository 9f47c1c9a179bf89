"""Best-fit packing with a dominance reduction before it.

Only the lengths of pieces decide, so the instance is a histogram of at most ``capacity`` lengths,
however many documents there are.  Sets of pieces that provably dominate all others are fixed for
whole classes at once, what is left is packed best-fit, and each pattern of lengths is then dealt to
the pieces by their rank within their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.storage import materialize
from lectern.llm.arrow import add_column
from lectern.llm.text import identity
from lectern.llm.tokenization import encoder, tokenizer_path

#: Slices in which the pieces of one length are ranked, at the least, and how many pieces a slice has,
#: more or less, at the most.
SLICES, SLICE_ROWS = 64, 1 << 20


def pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = 2048) -> DataFrame:
    """doc_id, ident, piece, start, length, ids_crc32 of every piece of every document.

    A document is its ids and the id 0; a null or empty text is the id 0 alone.  Only documents
    longer than ``capacity`` are cut, and all pieces but the last are full.
    """

    def make():
        ids = encoder(tokenizer_path(tokenizer)).ids
        step = 4 * capacity

        def cut(texts):
            flat, counts = ids(texts, end=True)
            data, edges = memoryview(flat).cast("B"), np.concatenate([[0], 4 * np.cumsum(counts)]).tolist()
            marks = [range(a, b, step) for a, b in pairwise(edges)]
            lengths = [min(step, b - at) // 4 for (a, b), own in zip(pairwise(edges), marks, strict=True) for at in own]
            crcs = [zlib.crc32(data[at : min(at + step, b)]) for (a, b), own in zip(pairwise(edges), marks, strict=True) for at in own]
            cuts = pa.StructArray.from_arrays([pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], names=["length", "ids_crc32"])
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(own) for own in marks])]), pa.int32()), cuts)

        return cut

    named = docs.select("doc_id", identity().alias("ident"), "text")
    cuts = add_column(named, make, "cuts", "array<struct<length:bigint,ids_crc32:bigint>>", keep=["doc_id", "ident"])
    each = cuts.select("doc_id", "ident", F.posexplode("cuts").alias("piece", "cut"))
    return each.select("doc_id", "ident", "piece", (F.col("piece").cast("long") * capacity).alias("start"), "cut.length", "cut.ids_crc32")


def reduce_by_dominance(left: Counter, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix sets that some optimal packing has, largest length first; ``left`` keeps the rest.

    A set dominates all others that hold its largest piece j if any other such set could be traded
    for it without a bin more: j alone if nothing fits beside it; j and k if k fills the room, if k is
    the largest that fits and no two fit together, or if k is at least as long as any two that fit;
    j, k and m if no three fit, and k and m are the largest first and second that two can be.
    """
    fixed = []
    lengths = sorted(left)

    def take(lots: Counter) -> None:
        many = min(left[x] // n for x, n in lots.items())
        fixed.append((tuple(sorted(lots.elements(), reverse=True)), many))
        for x, n in lots.items():
            left[x] -= n * many
            if not left[x]:
                del left[x], lengths[bisect_left(lengths, x)]

    changed = True
    while changed:
        changed = False
        for j in reversed([*lengths]):
            while left[j]:
                rest = left - Counter([j])
                room = capacity - j
                small = sorted(Counter({x: min(rest[x], 3) for x in lengths[:4] if rest[x]}).elements())[:3]
                if not small or small[0] > room:
                    take(Counter([j]))
                    changed = True
                    continue
                at = bisect_right(lengths, room) - 1
                k = lengths[at] if rest[lengths[at]] else lengths[at - 1]
                if k == room or len(small) < 2 or small[0] + small[1] > room:
                    take(Counter([j, k]))
                    changed = True
                    continue
                if (len(small) < 3 or sum(small) > room) and (pair := _best_pair(lengths, rest, room, k)):
                    take(Counter([j, *pair]))
                    changed = True
                    continue
                break
    return fixed


def _best_pair(lengths: list[int], rest: Counter, room: int, k: int) -> tuple[int, ...] | None:
    """With at most two beside j: k alone, or k and m, if that dominates; else None."""
    longest = second = 0
    for x in lengths[: bisect_right(lengths, room)]:
        if not rest[x]:
            continue
        y = next((y for y in reversed(lengths[: bisect_right(lengths, min(x, room - x))]) if rest[y] > (x == y)), 0)
        if y:
            longest, second = max(longest, x + y), max(second, y)
    if k >= longest:
        return (k,)
    m = next((y for y in reversed(lengths[: bisect_right(lengths, room - k)]) if rest[y] > (k == y)), 0)
    return (k, m) if m and m >= second else None


def best_fit(left: Counter, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first, each to the fullest sequence that has room; like sequences are handled as one."""
    open_bins: dict[int, list] = {}  # room -> [lengths, how many]
    rooms: list[int] = []

    def put(room: int, lengths: tuple[int, ...], many: int) -> None:
        if room not in open_bins:
            open_bins[room] = []
            insort(rooms, room)
        open_bins[room].append((lengths, many))

    for length in sorted(left, reverse=True):
        many = left[length]
        while many:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                if many >= each:
                    put(capacity - each * length, (length,) * each, many // each)
                if many % each:
                    put(capacity - many % each * length, (length,) * (many % each), 1)
                break
            room = rooms[at]
            lengths, bins = open_bins[room].pop()
            used = min(many, bins)
            if bins > used:
                open_bins[room].append((lengths, bins - used))
            if not open_bins[room]:
                del open_bins[room], rooms[at]
            put(room - length, (*lengths, length), used)
            many -= used
    return [lot for lots in open_bins.values() for lot in lots]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences have each."""
    left = Counter({k: n for k, n in histogram.items() if n})
    return reduce_by_dominance(left, capacity) + best_fit(left, capacity)


class Spots:
    """Where the pieces of each length go, by their rank among them: as many rows as patterns have places."""

    def __init__(self, histogram: dict[int, int], base: dict[int, list[int]], patterns: list[tuple[tuple[int, ...], int]]):
        places, given, sequence = [], Counter(), 0
        for lengths, many in patterns:
            offset = 0
            for length in lengths:
                places.append((length, given[length], sequence, offset))
                given[length] += many
                offset += length
            sequence += many
        # Ranks of one length after another, shortest first: the start of each length in that order.
        self.before = np.zeros(max(histogram, default=0) + 1, np.int64)
        for length, total in zip(sorted(histogram), np.cumsum([0, *(histogram[x] for x in sorted(histogram))]).tolist(), strict=False):
            self.before[length] = total
        # The slices of all lengths one after another, and where those of each length begin.
        self.slot = np.zeros(len(self.before), np.int64)
        for length, at in zip(base, np.cumsum([0, *map(len, base.values())]).tolist(), strict=False):
            self.slot[length] = at
        self.slices = np.array([n for below in base.values() for n in below], np.int64)
        length, first, self.sequence, self.offset = np.array(sorted(places), np.int64).reshape(-1, 4).T
        self.first = self.before[length] + first

    def of(self, length: np.ndarray, part: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """sequence_id and offset of the pieces with these places within a slice of their length."""
        rank = self.before[length] + self.slices[self.slot[length] + part] + within
        at = np.searchsorted(self.first, rank, "right") - 1
        return self.sequence[at] + rank - self.first[at], self.offset[at]


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = 2048) -> DataFrame:
    """Every piece with its sequence_id (from 0) and offset (tokens before it in the sequence).

    All rows of ``docs`` are packed, repeated ones too; only doc_id and text are read.  An empty table
    gives no rows.  The driver holds a count for each slice of each length.
    """
    spark, kept = docs.sparkSession, ["doc_id", "piece", "start", "length", "ids_crc32"]
    # Written with a number of its own: it parts and orders repeated rows as well.
    cut = materialize(pieces(docs, tokenizer, capacity).withColumn("tie", F.monotonically_increasing_id()), "pieces")
    histogram = Counter({r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()})
    large = {length: -(-n // SLICE_ROWS) for length, n in histogram.items() if n > SLICE_ROWS * SLICES}
    ways = F.lit(SLICES).cast("long")
    if large:
        sides = (F.array(*map(F.lit, side)).cast("array<long>") for side in (large.keys(), large.values()))
        ways = F.coalesce(F.try_element_at(F.map_from_arrays(*sides), F.col("length")), ways)
    cut = cut.withColumn("slice", F.pmod(F.xxhash64("tie"), ways).cast("int"))
    base = {length: [0] * (large.get(length, SLICES) + 1) for length in sorted(histogram)}
    for r in cut.groupBy("length", "slice").agg(F.count("*").alias("n")).collect():
        base[r["length"]][r["slice"] + 1] = r["n"]
    base = {length: np.cumsum(counts)[:-1].tolist() for length, counts in base.items()}
    spots = spark.sparkContext.broadcast(Spots(histogram, base, plan(histogram, capacity)))
    within = F.row_number().over(Window.partitionBy("length", "slice").orderBy("tie")) - 1
    ranked = cut.select(*kept, "slice", within.cast("long").alias("within"))
    schema = T.StructType([*(ranked.schema[c] for c in kept), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches):
        for batch in batches:
            length, part, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "slice", "within"))
            found = [pa.array(x) for x in spots.value.of(length, part, rank)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), *found], names=schema.names)

    return ranked.mapInArrow(place, schema)
