"""Benchmark decontamination: rare n-grams seed, a Smith-Waterman alignment of words decides.

Seeds are three-word grams of an item that few items hold; an item with hardly any such gram has its
least common ones.  Those that far more texts hold than half of the item's other grams go: an item that
very many texts have copied keeps its seeds, as all of them are as common there, and at least half of
the grams stay in any case.  All others are seeds, as an edit breaks only those that it touches.  Grams
of the texts meet seeds in a join, and each text is aligned with the items that it has a seed of,
around all grams they share; edited copies score by what is left.
"""

from __future__ import annotations

import re
from itertools import pairwise, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.storage import materialize
from lectern.llm.arrow import bounded

WORD, FOREIGN = re.compile(r"\w+"), re.compile(r"[^\w\x00-\x7f]")
#: Bytes that part words where all characters beyond ASCII belong to words.
TABLE = bytes(b if b > 127 or chr(b).isalnum() or b == 95 else 32 for b in range(256))
N = 3
#: A gram is rare if no more items hold it; an item with fewer rare grams than SEEDS has its least common ones.
RARE, SEEDS = 32, 4
#: A seed that more than COMMON times as many texts hold as the median of its item's is none.
COMMON = 8
#: The filter of seeds has 2**BITS bits, whatever the size of the benchmark, and is made in slices of 2**SLICE.
BITS, SLICE = 27, 20
#: Words whose hashes a task remembers.
WORDS = 1 << 20
MATCH, MISMATCH, GAP = 2, -1, -1
HITS = "array<struct<item_id:bigint,score:double,first_word:int,last_word:int>>"


def tokens(text: str | None) -> list[bytes]:
    """Runs of letters, digits and underscores of the lower-cased text, in UTF-8."""
    low = (text or "").lower()
    if low.isascii() or not FOREIGN.search(low):
        return low.encode().translate(TABLE).split()
    return [w.encode() for w in WORD.findall(low)]


class Items:
    """Some benchmark items (id, text) as word numbers, with the places of each of their grams."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        self.ids = [i for i, _ in rows]
        self.items = [np.array([number(w, len(self.vocabulary)) for w in tokens(t)], np.int64) for _, t in rows]
        grams = [self.grams(words) for words in self.items]
        flat = np.concatenate([np.array([], np.uint64), *grams])
        order = np.argsort(flat, kind="stable")
        # The places of gram k are those from first[k] to first[k + 1].
        self.keys, first = np.unique(flat[order], return_index=True)
        self.first = np.append(first, len(flat))
        self.item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order]
        self.place = np.concatenate([np.array([], np.int64), *(np.arange(len(g)) for g in grams)])[order]
        # Words of a stretch of text, one flag a number; the last is for words that no item has.
        self.around = np.zeros(len(self.vocabulary) + 1, bool)

    def words(self, text: str | None) -> np.ndarray:
        """Word numbers of a text; -1 for words that no item has."""
        found = tokens(text)
        return np.fromiter(map(self.vocabulary.get, found, repeat(-1)), np.int64, len(found))

    @staticmethod
    def grams(words: np.ndarray) -> np.ndarray:
        """A hash of each gram of word numbers; shorter items are one gram."""
        n = min(N, len(words))
        if not n:
            return np.array([], np.uint64)
        out = np.zeros(len(words) - n + 1, np.uint64)
        for k in range(n):
            out = (out ^ (words[k : len(words) - n + 1 + k] + 2).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
        return out

    def found(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the text holds grams of the items, and which."""
        if len(words) < 1 or not len(self.keys):
            return np.array([], np.int64), np.array([], np.int64)
        g = self.grams(words)
        at = np.nonzero((words[: len(g)] >= 0) & (words[len(words) - len(g) :] >= 0))[0]
        k = np.searchsorted(self.keys, g[at])
        k[k == len(self.keys)] = 0
        same = self.keys[k] == g[at]
        return at[same], k[same]

    def ceiling(self, item: int, words: np.ndarray) -> int:
        """No alignment of the item with ``words`` scores more: what either side lacks costs a step of its own."""
        own = self.items[item]
        return min(self._run(words, own), self._run(own, words))

    def _run(self, there: np.ndarray, words: np.ndarray) -> int:
        """The best stretch of ``words`` if all of them that are ``there`` would match."""
        self.around[there] = True
        self.around[-1] = False
        total = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.where(self.around[words], MATCH, max(MISMATCH, GAP)), out=total[1:])
        self.around[there] = False
        return int((total - np.minimum.accumulate(total)).max())


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: its score, and the first and last word of the text that it takes in."""
    n = len(words)
    gaps = -GAP * np.arange(n + 1)
    score, origin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    for w in item:
        step = np.where((words == w) & (w >= 0), MATCH, MISMATCH)
        diagonal = score[:-1] + step
        up = score[1:] + GAP
        fresh = np.maximum(np.maximum(diagonal, up), 0)
        source = np.where(diagonal >= up, origin[:-1], origin[1:])
        source = np.where(fresh > 0, source, np.arange(1, n + 1))
        row, begin = np.concatenate([[0], fresh]), np.concatenate([[0], source])
        # A gap in the item: the best of what stands to the left, less a gap for each word between.
        reach = row + gaps
        top = np.maximum.accumulate(reach)
        holder = np.maximum.accumulate(np.where(reach == top, np.arange(n + 1), 0))
        score, origin = top - gaps, begin[holder]
        at = int(score.argmax())
        if score[at] > best[0]:
            best = (int(score[at]), int(origin[at]), at - 1)
    return best


def matches(block: Items, words: np.ndarray, threshold: float) -> list[dict]:
    """The best alignment of each item with the text, if its share of a full match reaches ``threshold``."""
    at, grams = block.found(words)
    if not len(at):
        return []
    many = block.first[grams + 1] - block.first[grams]
    held = np.repeat(block.first[grams] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    item, begin = block.item[held], np.repeat(at, many) - block.place[held]
    order = np.lexsort((begin, item))
    item, begin = item[order], begin[order]
    out = []
    edges = [0, *(np.nonzero(np.diff(item))[0] + 1).tolist(), len(item)]
    for a, b in pairwise(edges):
        own = block.items[item[a]]
        m, best, (low, high) = len(own), (0, 0, 0), (0, -1)
        for start in np.unique(begin[a:b]).tolist():
            if start - m >= low and start + 2 * m <= high:
                continue  # inside what has been aligned
            low, high = max(0, start - m), min(len(words), start + 2 * m)
            around = words[low:high]
            if block.ceiling(int(item[a]), around) < threshold * MATCH * m:
                continue
            found = align(own, around)
            if found[0] > best[0]:
                best = (found[0], low + found[1], low + found[2])
        if best[0] and best[0] >= threshold * MATCH * m:
            out.append({"item_id": block.ids[item[a]], "score": best[0] / (MATCH * m), "first_word": best[1], "last_word": best[2]})
    return out


class Hashes(dict):
    """64-bit hashes of words, each worked out when it is met first."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def grams(self, text: str | None) -> np.ndarray:
        """The distinct grams of a text, in ascending order."""
        if len(self) > WORDS:
            self.clear()
        found = tokens(text)
        return np.unique(Items.grams(np.fromiter(map(self.__getitem__, found), np.uint64, len(found)).view(np.int64)))


def _key() -> Column:
    """Equal texts meet the same items; should two texts share a key, each is aligned with the items of both."""
    return F.xxhash64("text")


def _grams(texts: DataFrame, key: str, bits=None) -> DataFrame:
    """``key`` and gram: a row for each distinct gram of a text, those alone that pass the filter ``bits`` if there is one."""

    def search(batches):
        hashes, mask = Hashes(), np.uint64((1 << BITS) - 1)
        flags = None if bits is None else np.frombuffer(bits.value, np.uint8)
        for batch in bounded(batches, "text"):
            keys = batch.column(batch.schema.get_field_index(key)).to_numpy()
            # Copies that stand in one batch are looked at once.
            _, first = np.unique(keys, return_index=True)
            texts = batch.column(batch.schema.get_field_index("text")).take(pa.array(first)).to_pylist()
            found = [hashes.grams(t) for t in texts]
            grams = np.concatenate([np.array([], np.uint64), *found])
            owner = np.repeat(keys[first], [len(g) for g in found])
            if flags is not None:
                slot = grams & mask
                held = flags[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1 == 1
                grams, owner = grams[held], owner[held]
            yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(grams.view(np.int64))], names=[key, "gram"])

    return texts.select(key, "text").mapInArrow(search, f"{key} long, gram long")


def rare_seeds(items: DataFrame) -> DataFrame:
    """item, gram: the seeds of ``items`` (item, text), which must be distinct."""
    grams = _grams(items, "item")
    counted = grams.join(grams.groupBy("gram").agg(F.count("*").alias("items")), "gram")
    rank = F.row_number().over(Window.partitionBy("item").orderBy("items", "gram"))
    return counted.withColumn("rank", rank).where((F.col("items") <= RARE) | (F.col("rank") <= SEEDS)).select("item", "gram")


def telling(seeds: DataFrame, held: DataFrame) -> DataFrame:
    """The seeds that are no more than COMMON times as frequent in the texts (``held``: key, gram) as the item's median."""
    counted = seeds.join(held.groupBy("gram").agg(F.count("*").alias("n")), "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    median = F.percentile_approx("n", 0.5).over(Window.partitionBy("item"))
    return counted.withColumn("median", median).where(F.col("n") <= COMMON * F.greatest("median", F.lit(1))).select("item", "gram")


def seed_filter(seeds: DataFrame) -> bytes:
    """2**BITS bits, those set that a seed falls on: a gram whose bit isn't set is no seed."""
    low = min(BITS, SLICE)

    def slice_of(rows: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(1 << low, np.uint8)
        flags[rows["slot"].to_numpy() & ((1 << low) - 1)] = 1
        return pd.DataFrame({"slice": [rows["slot"].iloc[0] >> low], "bits": [np.packbits(flags, bitorder="little").tobytes()]})

    slots = seeds.select(F.col("gram").bitwiseAND((1 << BITS) - 1).alias("slot")).distinct()
    made = slots.groupBy(F.shiftright("slot", low)).applyInPandas(slice_of, "slice long, bits binary").collect()
    out, size = bytearray(1 << BITS - 3), 1 << low - 3
    for r in made:
        out[r["slice"] * size : (r["slice"] + 1) * size] = r["bits"]
    return bytes(out)


def may_hold(bits: bytes, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be one that :func:`seed_filter` was made of: never false for one that is."""
    slot = keys & (len(bits) * 8 - 1)  # by the filter's own size, which a worker need not share
    return np.frombuffer(bits, np.uint8)[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 == 1


def candidates(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """key, items: for each text that holds a seed, all items (struct of item_id and text) that it holds one of."""
    items = benchmark.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    items = items.withColumn("item", F.xxhash64("item_id", "text"))
    seeds = materialize(rare_seeds(items), "seeds")
    bits = docs.sparkSession.sparkContext.broadcast(seed_filter(seeds))
    held = materialize(_grams(docs.select(_key().alias("key"), "text"), "key", bits).distinct(), "held")
    met = held.join(telling(seeds, held), "gram").select("key", "item").distinct()
    found = met.join(items, "item").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("item_id", "text"))).alias("items"))
    return materialize(found, "candidates")


def _among(found: DataFrame) -> Column:
    """Whether ``key`` may be one of ``found``, by a filter of 2**BITS bits: never false for one that is."""
    bits = found.sparkSession.sparkContext.broadcast(seed_filter(found.select(F.col("key").alias("gram"))))

    @F.pandas_udf("boolean")
    def may(key: pd.Series) -> pd.Series:
        return pd.Series(may_hold(bits.value, key.to_numpy()))

    return may("key")


def _aligned(docs: DataFrame, benchmark: DataFrame, threshold: float, keep: list[str], how: str) -> DataFrame:
    """``row``, a struct of ``keep``, and ``__hits``: of all rows, or (``how`` is inner) of those that may hold a seed.

    Only texts that pass a filter of the candidates' keys are exchanged to meet their items; the
    others stay where they are read.
    """
    rows = docs.select(F.struct(*keep).alias("row"), "text", _key().alias("key"))
    asked = candidates(docs.select("text"), benchmark)
    may = _among(asked)
    met = rows.where(may).join(asked, "key", how).select("row", F.when(F.col("items").isNotNull(), F.col("text")).alias("text"), "items")
    kind = pa.list_(pa.struct({"item_id": pa.int64(), "score": pa.float64(), "first_word": pa.int32(), "last_word": pa.int32()}))

    def search(batches):
        for batch in bounded(batches, "text"):
            texts, lists = (batch.column(batch.schema.get_field_index(c)) for c in ("text", "items"))
            hits = []
            for text, found in zip(texts, lists, strict=True):
                if not found.is_valid:
                    hits.append([])
                    continue
                block = Items([(i["item_id"], i["text"]) for i in found.as_py()])
                hits.append(matches(block, block.words(text.as_py()), threshold))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("row")), pa.array(hits, kind)], names=["row", "__hits"])

    found = met.mapInArrow(search, T.StructType([met.schema["row"], T.StructField("__hits", T._parse_datatype_string(HITS))]))
    return found if how == "inner" else found.unionByName(rows.where(~may).select("row", F.array().cast(HITS).alias("__hits")))


def find_contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, all by default) with ``__hits``: an array of struct(item_id, score,
    first_word, last_word) of all items that the text holds a copy of, empty if none.

    Words are runs of letters and digits, lower-cased.  score is the alignment's share of a full match
    (1.0: word for word).  A copy needs one seed of the item left; an item of one or two words is only
    found where it is the whole text.  Null and empty texts hold nothing; items without words or without
    an id are not looked for.  Items that share an id but not the text are looked for one by one; equal
    rows are one item.  A text that holds an item more than once has it once, at its best place, the first
    of those on a tie.  Texts of any length are aligned as a whole.  Repeated rows each have their row, an
    empty table gives none, an empty benchmark gives empty arrays.  A column named ``__hits`` gives way;
    others stay, whatever their names.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != "__hits"]
    found = _aligned(docs, benchmark, threshold, keep, "left")
    return found.select(*(F.col("row").getField(c).alias(c) for c in keep), "__hits")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, item_id, score, first_word, last_word: a row for each copy of an item in a document."""
    found = _aligned(docs, benchmark, threshold, ["doc_id"], "inner")
    return found.select("row.doc_id", F.explode("__hits").alias("hit")).select("doc_id", "hit.*")
