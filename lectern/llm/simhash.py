"""SimHash near-duplicates over a hierarchical index in Gray order.

Upper nodes of the index are masked bit patterns: 64 bits fall into ``max_bits + 1`` parts, and two
fingerprints within ``max_bits`` agree on one part at least, so the fingerprints that share a part's
bits form a group.  A group that is too large goes a level down, where the bits it doesn't share yet
are parted again in the same way; nothing is lost on the way, and no group stays large, as distinct
fingerprints run out.  Inside a group fingerprints are sorted by Gray rank and nested in runs; each
run keeps the bits that all of it share.  The differences between the shared bits of two runs add up
from the top down and rule out whole pairs of runs before any two fingerprints are compared.
"""

from __future__ import annotations

from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.storage import materialize
from lectern.llm.arrow import add_column, bounded
from lectern.llm.decontamination import may_hold, seed_filter
from lectern.llm.text import identity, wrapped
from lectern.operators.components import connected_components

#: Distinct fingerprints that one group may have before it is parted again.
GROUP = 4096
#: Runs of the index inside a group: fingerprints in a run, and runs in a longer one.
RUN = 8
#: Pairs of runs that are looked at together.
LOT = 1 << 14
#: Shingles that are hashed, and hashes whose bits are counted, together.
PIECE = 1 << 16
#: A-Z lower-cased, and each of the six white-space characters a space.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz     ")


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """XXH64 (seed 42) of the n-word shingles, repeats included; of all words where there are fewer."""
    raw = np.frombuffer((text or "").encode().translate(FOLD), np.uint8)
    blank = raw == ord(" ")
    stays = ~blank
    stays[1:] |= ~blank[:-1]  # of a run of spaces the first
    flat = raw[stays]
    flat = flat[int(len(flat) > 0 and flat[0] == ord(" ")) : len(flat) - int(len(flat) > 0 and flat[-1] == ord(" "))]
    if not len(flat):
        return np.array([], dtype=np.uint64)
    ends = np.append(np.flatnonzero(flat == ord(" ")), len(flat))
    starts = np.append(0, ends[:-1] + 1)
    n = min(n, len(ends))
    data, ends, h = memoryview(flat.tobytes()), ends[n - 1 :], xxhash.xxh64_intdigest
    hashes = np.empty(len(ends), np.uint64)
    for at in range(0, len(ends), PIECE):
        part = zip(starts[at : at + PIECE].tolist(), ends[at : at + PIECE].tolist(), strict=False)
        hashes[at : at + PIECE] = [h(data[a:b], 42) for a, b in part]
    return hashes


def majority(hashes: np.ndarray) -> int:
    """64 bits, each set if it is in over half of the hashes, as a signed number."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), PIECE):
        ones += np.unpackbits(hashes[at : at + PIECE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


#: Keys of a set of shingles, and the least hashes that each is made of: of two sets with a Jaccard
#: similarity s a share of 1 - (1 - s**DEPTH)**BANDS have a key in common, 0.995 at 0.8.
BANDS, DEPTH = 10, 4
#: Of those with a key in common, how many the others meet in the second pass, and the random ways in
#: which these are told.
HEADS, WAYS = 4, 3
_drawn = np.random.default_rng(5)
#: Shingles, the commonest, that are last in the order of which prefixes are taken, by their counts.
COMMON = 1 << 18
#: Pairs of rows with a shingle in common that are looked at together.
MEET = 1 << 18
#: Shingles of a set whose sketch goes with its prefix, and the bits that a sketch has at least.
SMALL = 256
MASK, FACTOR = (_drawn.integers(0, 2**64, BANDS * DEPTH, dtype=np.uint64) for _ in range(2))
FACTOR |= np.uint64(1)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band: its number and its least hashes under DEPTH random orders.  An empty set has none."""
    if not len(hashes):
        return np.array([], np.int64)
    least = np.min([((hashes[at : at + 1024, None] ^ MASK) * FACTOR).min(axis=0) for at in range(0, len(hashes), 1024)], axis=0)
    rows = np.column_stack([np.arange(BANDS, dtype=np.uint64), least.reshape(BANDS, DEPTH)])
    return np.array([xxhash.xxh64_intdigest(r.tobytes()) for r in rows], np.uint64).view(np.int64)


def often(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of the sets have, and how many do."""
    hashes, n = np.unique(np.concatenate([np.array([], np.uint64), *sets]), return_counts=True)
    return hashes[n > 1].view(np.int64), n[n > 1]


def prefix(hashes: np.ndarray, known: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first of a set's hashes in an order that all sets share, as many as two similar sets need to have one in common.

    ``known`` are the common hashes, sorted, and come last by their ``counts``; others follow the hash.
    """
    if not len(hashes):
        return hashes.view(np.int64)
    at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
    n = np.where(known[at] == hashes, counts[at], 0) if len(known) else np.zeros(len(hashes), np.int64)
    return hashes[np.lexsort((hashes, n))[: len(hashes) - int(np.ceil(similarity * len(hashes) - 1e-9)) + 1]].view(np.int64)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """A bit for each slot that an odd number of the hashes fall on, as many slots as hashes at least, in 64-bit words.

    What differs between two sketches is never more than what differs between the sets.  Of a longer
    sketch both halves together are the one of half the slots.
    """
    slots = max(SMALL, 1 << (max(len(hashes), 1) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def differing(sizes, similarity: float):
    """How many hashes two sets of ``sizes`` together may have that the other lacks."""
    return (1 - similarity) / (1 + similarity) * sizes + 1e-9


def may_be_similar(pairs: DataFrame, each: DataFrame, similarity: float) -> DataFrame:
    """a, b: the pairs that sizes and sketches don't rule out; ``each`` has id, size and sketch.  No similar pair is lost."""
    side = lambda of: each.select(F.col("id").alias(of), F.col("size").alias(f"size_{of}"), F.col("sketch").alias(f"sketch_{of}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b"))
    # Sizes are near enough that one sketch is at most twice as long as the other.
    n = F.least(F.size("sketch_a"), F.size("sketch_b"))
    halved = lambda s: F.when(F.size(s) == n, F.col(s)).otherwise(F.zip_with(F.slice(s, 1, n), F.slice(s, n + 1, n), lambda x, y: x.bitwiseXOR(y)))
    apart = F.aggregate(F.zip_with(halved("sketch_a"), halved("sketch_b"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    return both.where(apart <= differing(F.col("size_a") + F.col("size_b"), similarity)).select("a", "b")


def meeting(rows: np.ndarray, similarity: float):
    """Pairs of ids of different groups that share a key and may be similar; ``rows`` are sorted.

    A row is key, component, id, size and place, and the sketch of SMALL bits, if there is one, in four
    more numbers; it tells what differs between two sets of SMALL hashes at most.
    In the first key that two similar sets share, the smaller has it among those that two sets of its
    size need, and behind it both have as many hashes left as the sets must have in common.
    """
    key, group, ids, size, place, *words = rows.T
    new_key = np.append(key[1:] != key[:-1], True)
    new_group = new_key | np.append(group[1:] != group[:-1], True)
    end = lambda new: (e := np.flatnonzero(new) + 1)[np.searchsorted(e, np.arange(len(key)), "right")]
    begin = end(new_group)
    many = end(new_key) - begin
    total = np.cumsum(many)
    at = 0
    while at < len(key):
        to = max(at + 1, int(np.searchsorted(total, total[at] - many[at] + MEET, "right")))
        n = many[at:to]
        i = np.repeat(np.arange(at, to), n)
        j = np.arange(n.sum()) + np.repeat(begin[at:to] - (np.cumsum(n) - n), n)
        at = to
        less, more = np.where(size[i] <= size[j], (i, j), (j, i))
        a, b = size[less], size[more]
        fits = (a >= similarity * b - 1e-9) & (place[less] <= a - np.ceil(2 * similarity / (1 + similarity) * a - 1e-9))
        fits &= np.minimum(a - place[less], b - place[more]) >= similarity / (1 + similarity) * (a + b) - 1e-9
        if words:
            i, j, a, b = (x[fits] for x in (i, j, a, b))
            apart = sum(np.bitwise_count((w[i] ^ w[j]).view(np.uint64)).astype(np.int64) for w in words)
            fits = (b > SMALL) | (apart <= differing(a + b, similarity))
        if fits.any():
            yield np.unique(np.sort(np.column_stack([ids[i[fits]], ids[j[fits]]]), axis=1), axis=0)


def _meet(batches, similarity: float):
    """Rows arrive sorted by key; the key that is still open waits for the next batch."""
    held = None

    def pairs(rows):
        for found in meeting(rows, similarity) if len(rows) else ():
            yield _links([(found[:, 0], found[:, 1])])

    for batch in batches:
        if batch.num_rows:
            new = np.column_stack([c.to_numpy() for c in batch.columns])
            rows = new if held is None else np.concatenate([held, new])
            open_key = np.searchsorted(rows[:, 0], rows[-1, 0])
            held = rows[open_key:]
            yield from pairs(rows[:open_key])
    yield from pairs([] if held is None else held)


def fingerprints(docs: DataFrame, shingle: int = 4, name: str = "fingerprint", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the fingerprint of each whole text; null, empty and blank texts have 0."""
    return add_column(docs, lambda: lambda texts: pa.array([majority(shingle_hashes(t, shingle)) for t in texts], pa.int64()), name, "long", keep=keep)


def gray_rank(code: Column) -> Column:
    """The place of a code in the reflected Gray order: each bit of the rank is the XOR of all higher bits."""
    return reduce(lambda r, k: r.bitwiseXOR(F.shiftrightunsigned(r, k)), (1, 2, 4, 8, 16, 32), code)


def parts(mask: int, max_bits: int) -> list[int]:
    """The masks one level below ``mask``: its free bits in max_bits + 1 parts, each added to it."""
    free = [i for i in range(63, -1, -1) if not mask >> i & 1]
    cut = [round(len(free) * k / (max_bits + 1)) for k in range(max_bits + 2)]
    return [m for a, b in zip(cut, cut[1:], strict=False) if (m := mask | sum(1 << i for i in free[a:b])) != mask]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _nodes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each run: the bits that all of it share, as a mask, and their pattern."""
    at = np.arange(0, len(codes[0]), RUN)
    both = np.bitwise_and.reduceat(codes[0] & codes[1], at)
    none = np.bitwise_and.reduceat(codes[0] & ~codes[1], at)
    return both | none, both


def close_pairs(codes: np.ndarray, max_bits: int):
    """Arrays of places (i < j), lot by lot, of all codes within ``max_bits``; ``codes`` are in Gray order."""
    levels = [(np.full(len(codes), ~np.uint64(0)), codes)]
    while len(levels[-1][0]) > RUN:
        levels.append(_nodes(levels[-1]))
    step = np.arange(RUN)
    stack = [(len(levels) - 1, *np.triu_indices(len(levels[-1][0])))]
    while stack:
        depth, i, j = stack.pop()
        if len(i) > LOT:
            stack += [(depth, i[at : at + LOT], j[at : at + LOT]) for at in range(0, len(i), LOT)]
            continue
        mask, pattern = levels[depth]
        # What differs in bits that both sides share: it only grows from level to level.
        near = np.bitwise_count((pattern[i] ^ pattern[j]) & mask[i] & mask[j]) <= max_bits
        i, j = i[near], j[near]
        if not depth:
            yield i[i < j], j[i < j]
            continue
        width = len(levels[depth - 1][0])
        a = (i[:, None, None] * RUN + step[:, None] + 0 * step).reshape(-1)
        b = (j[:, None, None] * RUN + 0 * step[:, None] + step).reshape(-1)
        fits = (a < width) & (b < width) & (a <= b)
        stack.append((depth - 1, a[fits], b[fits]))


def spanning_links(codes: np.ndarray, ids: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between ids that connect just what the close pairs connect, fewer than there are codes."""
    root = np.arange(len(codes))
    for i, j in close_pairs(codes, max_bits):
        while len(i):
            a, b = root[i], root[j]
            i, j, a, b = (x[a != b] for x in (i, j, a, b))
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root != root[root]).any():
                root = root[root]
    moved = np.nonzero(root != np.arange(len(codes)))[0]
    return ids[moved], ids[root[moved]]


def _search(batches, max_bits: int):
    """Groups arrive sorted by key, then Gray rank; the one that is still open waits for the next batch."""
    key, held = None, []

    def close():
        codes, ids = (np.concatenate(x) for x in zip(*held, strict=True))
        return spanning_links(codes, ids, max_bits)

    for batch in batches:
        keys = np.column_stack([batch.column(k).to_numpy() for k in (0, 1)])
        codes, ids = batch.column(2).to_numpy().view(np.uint64), batch.column(3).to_numpy()
        found = []
        for a, b in pairwise([0, *(np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1), len(codes)]):
            if a == b:
                continue
            if held and (keys[a] != key).any():
                found.append(close())
                held = []
            key = keys[a]
            held.append((codes[a:b], ids[a:b]))
        yield _links(found)
    yield _links([close()] if held else [])


def _links(found):
    flat = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.array([], np.int64)] * 2
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in flat], names=["a", "b"])


def near_links(marks: DataFrame, max_bits: int = 4) -> DataFrame:
    """Links (a, b) between ids that connect all whose codes lie within ``max_bits``.

    ``marks`` has ``code`` and ``id``, each of both once: codes that differ can always be parted, so no
    group stays larger than GROUP.
    """
    masks, members = [0], marks.select(F.lit(0).alias("node"), *marks.columns)
    found = None
    while True:
        pattern = F.col("code").bitwiseAND(F.element_at(F.array(*(F.lit(_signed(m)).cast("long") for m in masks)), F.col("node") + 1))
        members = members.withColumn("pattern", pattern)
        sizes = members.groupBy("node", "pattern").agg(F.count("*").alias("size"))
        below = {k: parts(m, max_bits) for k, m in enumerate(masks)}
        splits = F.element_at(F.array(*(F.lit(bool(below[k])) for k in below)), F.col("node") + 1)
        large = materialize(sizes.where((F.col("size") > GROUP) & splits).select("node", "pattern"), "groups")
        none = large.isEmpty()
        small = members if none else members.join(large, ["node", "pattern"], "left_anti")
        dealt = small.repartition("node", "pattern").sortWithinPartitions("node", "pattern", gray_rank(F.col("code")))
        links = dealt.select("node", "pattern", "code", "id").mapInArrow(lambda b: _search(b, max_bits), "a long, b long")
        found = links if found is None else found.unionByName(links)
        if none:
            return found
        masks = sorted({m for ms in below.values() for m in ms})
        place = {m: k for k, m in enumerate(masks)}
        lower = F.element_at(F.array(*(F.array(*(F.lit(place[m]) for m in below[k])).cast("array<int>") for k in below)), F.col("node") + 1)
        deeper = members.join(large, ["node", "pattern"], "left_semi").select(F.explode(lower).alias("node"), *marks.columns)
        members = materialize(deeper.dropDuplicates(["node", "id"]), "members")


def components(each: DataFrame, links: DataFrame) -> DataFrame:
    """id, component_id and first (the document kept of the component): a row for each id.

    ``each`` has id and ``least``, the first of its documents as struct(n, doc_id, ident), n if doc_id
    is null.  component_id is the least doc_id of all documents that links reach, null if all are null;
    the document kept is the one with that doc_id, and the least ident among several.
    """
    groups = connected_components(links)
    joined = each.select("id", "least").join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("group", F.coalesce("component", "id"))
    kept = joined.groupBy("group").agg(F.min("least").alias("kept"))
    return joined.join(kept, "group").select("id", F.col("kept.doc_id").alias("component_id"), F.struct("kept.doc_id", "kept.ident").alias("first"))


def least_document() -> Column:
    return F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "ident")).alias("least")


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """doc_id, ident, fingerprint, component_id and first of every document.

    Documents are linked if their fingerprints of ``shingle`` words differ in at most ``max_bits``
    bits.  Texts without words have fingerprint 0 and are linked like any others.  Other columns are
    left behind; an empty table gives no rows; repeated rows each have their row.
    """
    named = docs.select("doc_id", identity().alias("ident"), "text")
    marks = materialize(fingerprints(named, shingle, "id", keep=["doc_id", "ident"]), "marks")
    each = materialize(marks.groupBy("id").agg(least_document()), "ids")
    groups = components(each, near_links(each.select("id", F.col("id").alias("code")), max_bits))
    return marks.join(groups, "id").withColumnRenamed("id", "fingerprint")


def _stars(keyed: DataFrame, similarity: float, heads: int = 1) -> DataFrame:
    """Pairs (a < b) of each id with ``heads`` ids at most that have the same key and about its size.

    ``keyed`` has id, size, key and ``way``; ids fall into ``heads`` parts by a hash that differs from
    way to way, and the least id of each part stands for it.  Sizes fall into classes of which each is
    wider than the ratio that similar sets can have, so what is similar lies in one class or in two
    that follow each other.
    """
    part = F.pmod(F.xxhash64("id", "way"), F.lit(heads))
    classed = keyed.select("id", "key", part.alias("part"), F.floor(F.log("size") / -F.log(F.lit(similarity))).cast("int").alias("class"))
    met = classed.groupBy("key", "class", "part").agg(F.min("id").alias("head"), F.count("*").alias("n"))
    asking = classed.select("id", "key", F.explode(F.array("class", F.col("class") - 1)).alias("class"))
    pairs = asking.join(met.select("key", "class", "head"), ["key", "class"]).where("id <> head")
    return pairs.select(F.least("head", "id").alias("a"), F.greatest("head", "id").alias("b"))


def similar_ids(each: DataFrame, sets_of, prefixes: DataFrame, word_bits: int, similarity: float) -> DataFrame:
    """Links (a, b) between ids that connect all whose shingle sets have the similarity.

    ``each`` has id, code, size, bands and sketch, each id once; ``sets_of`` gives the sets (id, shingles)
    of the ids asked for; ``prefixes`` has id, size, keys and sketch (of small sets), an id once or more.

    Three passes.  In the first, ids meet that have word fingerprints within ``word_bits`` by the SimHash
    index, and the least id of all that share a fingerprint or a band of least hashes; this settles
    large groups.  In the second, what the first hasn't joined meets several others of its bands.  Both
    are guesses.  The third is exact: of what isn't joined yet, all ids meet that share a shingle of
    their prefixes, as two sets of the similarity do.  Sets are only fetched for pairs that their
    sketches don't rule out.
    """
    some = each.where("size > 0")
    codes = materialize(some.groupBy("code").agg(F.min("id").alias("id")), "codes")
    keyed = some.select("id", "size", F.posexplode(F.array_append("bands", F.col("code"))).alias("way", "key")).withColumn("way", F.col("way") % WAYS)
    fitting = lambda found: materialize(may_be_similar(found.distinct(), some, similarity), "pairs")

    index = near_links(codes, word_bits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs, others = fitting(index.unionByName(_stars(keyed, similarity))), fitting(_stars(keyed, similarity, HEADS))
    sets = materialize(sets_of(pairs.unionByName(others).select(F.explode(F.array("a", "b")).alias("id")).distinct()), "sets")
    first = materialize(similar_links(pairs, sets, similarity), "links")
    joined = connected_components(first)
    side = lambda of: joined.select(F.col("node").alias(of), F.col("component").alias(f"group_{of}"))
    known = others.join(side("a"), "a", "left").join(side("b"), "b", "left")
    apart = known.where(F.coalesce("group_a", "a") != F.coalesce("group_b", "b")).select("a", "b").join(pairs, ["a", "b"], "left_anti")
    second = first.unionByName(materialize(similar_links(apart, sets, similarity), "links"))
    joined = connected_components(second).select(F.col("node").alias("id"), "component")
    words = [F.coalesce(F.get("sketch", F.lit(k)), F.lit(0)).alias(f"word_{k}") for k in range(SMALL // 64)]
    told = prefixes.join(joined, "id", "left").select(F.coalesce("component", "id").alias("component"), "id", "size", *words, F.posexplode("keys").alias("place", "key"))
    dealt = told.select("key", "component", "id", F.col("size").cast("long"), F.col("place").cast("long"), *(f"word_{k}" for k in range(len(words))))
    met = dealt.repartition("key").sortWithinPartitions("key", "component").mapInArrow(lambda b: _meet(b, similarity), "a long, b long").distinct()
    rest = fitting(met.join(pairs.unionByName(others), ["a", "b"], "left_anti"))
    sets = materialize(sets_of(rest.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "sets")
    return second.unionByName(materialize(similar_links(rest, sets, similarity), "links"))


def similar_links(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sets (id, ``shingles``) have the Jaccard similarity asked for."""
    side = lambda of: sets.select(F.col("id").alias(of), F.col("shingles").alias(f"set_{of}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(common / (F.size("set_a") + F.size("set_b") - common) >= similarity).select("a", "b")


def name_of(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes()) - 2**63


def common_shingles(marks: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the commonest shingles, sorted, and their counts as far as batches hold them more than once.

    At most ``COMMON``.  They only shape the order of which prefixes are taken; any order is exact.
    """
    shared = marks.where(F.size("often") > 0).select(F.explode(F.arrays_zip("often", "times")).alias("s"))
    told = shared.groupBy(F.col("s.often").alias("hash")).agg(F.sum("s.times").alias("n"))
    told = materialize(told.withColumn("step", F.floor(8 * F.log2("n"))), "common")
    least, room = 1 << 20, COMMON
    for step, size in sorted(map(tuple, told.groupBy("step").count().collect()), reverse=True):
        room -= size
        if room < 0:
            break
        least = step
    rows = told.where(F.col("step") >= least).select("hash", "n").toArrow()
    hashes, n = (rows.column(c).to_numpy() for c in ("hash", "n"))
    order = np.argsort(hashes.view(np.uint64))
    return hashes.view(np.uint64)[order], n[order]


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, word_bits: int = 7) -> DataFrame:
    """doc_id, ident, component_id and first of every document, for near copies.

    Documents are linked if the sets of their ``shingle``-word shingles have the Jaccard similarity
    ``similarity``; what is linked is compared set by set, and found as :func:`similar_ids` says, so
    that no two documents of the similarity are left in different components.
    At 0.8 of five-word shingles two 64-bit fingerprints of shingles differ in 10 bits, too many for
    any exact index, so the SimHash index works on a fingerprint of the distinct words, which a few
    edits hardly move.  Texts alike in their shingles are one to begin with; those without words are
    alike.  Rows alike in doc_id and text are one document; other columns are left behind; an empty
    table gives no rows.
    """

    def make():
        kind = pa.struct({"id": pa.int64(), "code": pa.int64(), "size": pa.int32(), "bands": pa.list_(pa.int64()), "sketch": pa.list_(pa.int64()), "often": pa.list_(pa.int64()), "times": pa.list_(pa.int64())})

        def mark(texts):
            sets = [np.unique(shingle_hashes(t, shingle)) for t in texts]
            ids = [*map(name_of, sets)]
            codes = [majority(np.unique(shingle_hashes(t, 1))) for t in texts]
            # What several sets of the batch have goes with its first row.
            shared = [often([*dict(zip(ids, sets, strict=True)).values()]), *[(np.array([], np.int64),) * 2] * (len(texts) - 1)][: len(texts)]
            return pa.array(list(zip(ids, codes, map(len, sets), map(band_keys, sets), map(sketch, sets), *zip(*shared, strict=True), strict=True)), kind)

        return mark

    def make_prefixes():
        kind = pa.struct({"id": pa.int64(), "size": pa.int32(), "keys": pa.list_(pa.int64()), "sketch": pa.list_(pa.int64())})

        def told(texts):
            sets = [np.unique(shingle_hashes(t, shingle)) for t in texts]
            rows, seen = [], set()
            for x in sets:
                name = name_of(x)
                new = name not in seen
                rows.append((name, len(x), prefix(x, known, counts, similarity) if new else [], sketch(x) if new and len(x) <= SMALL else []))
                seen.add(name)
            return pa.array(rows, kind)

        return told

    named = docs.select("doc_id", identity().alias("ident"), "text")
    marks = add_column(named, make, "mark", "struct<id:bigint,code:bigint,size:int,bands:array<bigint>,sketch:array<bigint>,often:array<bigint>,times:array<bigint>>", keep=["doc_id", "ident"])
    marks = materialize(marks.select("doc_id", "ident", "mark.*"), "marks")
    each = materialize(marks.groupBy("id").agg(least_document(), *(F.first(c).alias(c) for c in ("code", "size", "bands", "sketch"))), "ids")

    def sets_of(asked: DataFrame) -> DataFrame:
        shown = each.join(asked, "id", "left_semi").select(F.col("least.ident").alias("gram"))
        bits = docs.sparkSession.sparkContext.broadcast(seed_filter(shown))

        def run(batches):
            for batch in bounded(batches, "text"):
                texts = batch.filter(pa.array(may_hold(bits.value, batch.column(0).to_numpy()))).column(1).to_pylist()
                sets = {name_of(x): x for x in (np.unique(shingle_hashes(t, shingle)) for t in texts)}
                yield pa.RecordBatch.from_arrays([pa.array([*sets], pa.int64()), pa.array([x.view(np.int64) for x in sets.values()], pa.list_(pa.int64()))], names=["id", "shingles"])

        made = named.select("ident", "text").mapInArrow(run, "id long, shingles array<long>")
        return made.join(asked, "id", "left_semi").groupBy("id").agg(F.first("shingles").alias("shingles"))

    known, counts = common_shingles(marks)
    prefixes = add_column(named, make_prefixes, "p", "struct<id:bigint,size:int,keys:array<bigint>,sketch:array<bigint>>", keep=[]).select("p.*").where(F.size("keys") > 0)
    groups = components(each, similar_ids(each, sets_of, prefixes, word_bits, similarity))
    return marks.select("doc_id", "ident", "id").join(groups, "id").drop("id")


def drop_near_duplicates(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, all columns kept; of repeated rows one stays."""
    # One key of both for join and window, so texts are exchanged once; a null doc_id equals another in it.
    who = F.struct("ident", "doc_id").alias("who")
    stay = groups.where((F.col("ident") == F.col("first.ident")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))).select(who).distinct()
    rows = wrapped(docs).withColumn("ident", identity()).select("row", who)
    one = F.row_number().over(Window.partitionBy("who").orderBy("who"))
    return rows.join(stay, "who", "left_semi").withColumn("n", one).where("n = 1").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
