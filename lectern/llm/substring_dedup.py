"""Substring dedup by level-wise doubling of repeated windows.

Windows of ``length / 4`` words come first: of each full-length window only its least-hashed one, which
is the same in every copy.  Those that occur again somewhere are extended to twice their length, those
of them that still repeat once more, and at full length the first occurrence of each window stays.
Rows that leave a task are one for each hash and batch: repeats inside a batch are settled there, so
that a passage in a third of all documents is never gathered in one place.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.arrow import bounded
from lectern.llm.text import identity

#: Word hashes remembered in a Python worker.
MEMORY = 400_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


known = WordHashes()


class Words:
    """Word hashes of several texts one after another: what their windows are is worked out together."""

    def __init__(self, texts: list[str | None]):
        words = [(t or "").encode().split() for t in texts]  # of bytes: at the six white-space characters alone
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.owner = np.repeat(np.arange(len(words)), self.sizes)
        self.hashes = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.uint64, len(self.owner))

    def starts(self, length: int) -> np.ndarray:
        """Where windows of ``length`` words start that lie in one text."""
        at = np.arange(max(len(self.owner) - length + 1, 0))
        return at[self.owner[at] == self.owner[at + length - 1]]

    def marked(self, places: pa.ListArray) -> np.ndarray:
        """Which words of all are at a place of their text; places beyond it, of a document of the same name, are passed over."""
        own = np.repeat(np.arange(len(places)), pc.fill_null(places.value_lengths(), 0).to_numpy(zero_copy_only=False))
        place = places.flatten().to_numpy(zero_copy_only=False)
        fits = place < self.sizes[own]
        return self.only(self.begins[own[fits]] + place[fits])

    def only(self, at: np.ndarray) -> np.ndarray:
        marks = np.zeros(len(self.owner), bool)
        marks[at] = True
        return marks

    def placed(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The text of each word, and its place there."""
        return self.owner[at], at - self.begins[self.owner[at]]


def joined(a: np.ndarray, b: np.ndarray, turn: int = 31) -> np.ndarray:
    """A hash of a pair of hashes; the order counts."""
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ ((b << np.uint64(turn)) | (b >> np.uint64(64 - turn)))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` consecutive words: two halves joined, odd sizes a word at a time."""
    if len(hashes) < size:
        return hashes[:0]
    if size == 1:
        return hashes
    half = size // 2
    part = windows(hashes, half)
    pair = joined(part[: len(hashes) - 2 * half + 1], part[half : len(hashes) - half + 1])
    return pair if size == 2 * half else joined(pair[: len(hashes) - size + 1], hashes[size - 1 :])


def seeds_of(short: np.ndarray, length: int) -> np.ndarray:
    """For each full-length window, where its least-hashed short window starts (the first on a tie)."""
    span = length - length // 4 + 1
    if len(short) < span:
        return np.array([], np.int64)
    view = np.lib.stride_tricks.sliding_window_view(short, span)
    return view.argmin(axis=1) + np.arange(len(view))


def halves_of(seeds: np.ndarray, length: int) -> np.ndarray:
    """For each full-length window, the start of its half-length window around the seed."""
    starts, quarter = np.arange(len(seeds)), length // 4
    return np.where(seeds - starts >= quarter, seeds - quarter, seeds)


def _rows(names, columns, kinds):
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array | pa.ChunkedArray) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _heads(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each hash is the first of its kind here, and whether there are more of it."""
    _, first, back, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    head = np.zeros(len(h), bool)
    head[first] = True
    return head, count[back] > 1


def _found(batch: pa.RecordBatch, make):
    """What ``make`` finds in slices of the batch: arrays, of which the first has rows of the slice."""
    at, found = 0, []
    for part in bounded([batch], "text"):
        text, places = (part.column(part.schema.get_field_index(c)) if c in part.schema.names else None for c in ("text", "places"))
        owner, *rest = make(Words(text.to_pylist()), places)
        found.append((owner + at, *rest))
        at += part.num_rows
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.array([], np.int64)]


def _level(batches, make):
    """Candidates of a level: ident, spot and key.  spot is 4 * place, plus 1 if the hash repeats in the batch.

    The key is the hash; where it repeats in the batch only the first row keeps it.  The windows of the
    others are known to repeat: their key is ident, which spreads them, and 2 is added to their spot.
    """
    for batch in batches:
        owner, *rest = _found(batch, make)
        if not len(owner):
            continue
        place, h = rest
        head, again = _heads(h)
        ident, settled = batch.column(batch.schema.get_field_index("ident")).to_numpy()[owner], again & ~head
        yield _rows(["ident", "spot", "key"], [ident, 4 * place + again + 2 * settled, np.where(settled, ident, h.view(np.int64))], [pa.int64(), pa.int64(), pa.int64()])


LEVEL = "ident long, spot long, key long"


def _repeated(level: DataFrame) -> DataFrame:
    """ident, places: of each document the candidates whose hash occurs again anywhere."""
    apart = Window.partitionBy("key").orderBy("ident", "spot")
    again = (F.col("spot") % 4 > 0) | F.lag("ident").over(apart).isNotNull() | F.lead("ident").over(apart).isNotNull()
    met = level.withColumn("again", again).where("again").select("ident", F.expr("cast(spot div 4 as int)").alias("place"))
    return met.groupBy("ident").agg(F.collect_list("place").alias("places"))


def _short(length):
    def run(words, _):
        short = windows(words.hashes, length // 4)
        at = np.flatnonzero(words.only(seeds_of(short, length)[words.starts(length)]))
        return *words.placed(at), short[at]

    return lambda batches: _level(batches, run)


def _half(length):
    def run(words, places):
        seeds = seeds_of(windows(words.hashes, length // 4), length)
        at = words.starts(length)
        at = at[words.marked(places)[seeds[at]]]
        at = np.flatnonzero(words.only(halves_of(seeds, length)[at]))
        return *words.placed(at), windows(words.hashes, length // 2)[at]

    return lambda batches: _level(batches, run)


def _full(length):
    """Windows at full length: place and a hash of 95 bits; rows that are not first in their batch have ident and -1."""
    names, half = ["ident", "doc_id", "place", "h1", "h2"], length // 2

    def make(words, places):
        at = words.starts(length)
        at = at[words.marked(places)[halves_of(seeds_of(windows(words.hashes, length // 4), length), length)[at]]]
        whole = windows(words.hashes, half)
        a, b = whole[at], whole[at + half]
        return *words.placed(at), joined(a, b), joined(b, a, 23) >> np.uint64(33)

    def run(batches):
        for batch in batches:
            ident, doc = batch.column(0).to_numpy(), batch.column(1)
            # Batch rows in the order that says which occurrence is first.
            order = np.lexsort((ident, pc.rank(doc, "ascending", null_placement="at_end", tiebreaker="dense").to_numpy()))
            # Repeated rows are one document: here one of them speaks for all.
            order = order[np.sort(np.unique(ident[order], return_index=True)[1])]
            owner, *rest = _found(batch.take(pa.array(order)), make)
            if not len(owner):
                continue
            place, h, h2 = rest
            head, _ = _heads(h)
            rows = order[owner]
            values = [np.where(head, h.view(np.int64), ident[rows]), np.where(head, h2.astype(np.int32), -1)]
            yield _rows(names, [ident[rows], doc.take(pa.array(rows)), place, *values], [pa.int64(), doc.type, pa.int32(), pa.int64(), pa.int32()])

    return run


def covered(n: int, starts: list[int] | None, length: int) -> np.ndarray:
    """Which of ``n`` words lie in a window of ``length`` at one of ``starts``."""
    change = np.zeros(n + length + 1, np.int64)
    for side, at in ((1, 0), (-1, length)):
        np.add.at(change, np.asarray(starts or [], np.int64) + at, side)
    return np.cumsum(change)[:n] > 0


def repeated_windows(docs: DataFrame, length: int = 20) -> DataFrame:
    """doc_id, ident, text and ``lost``: starts of the windows of ``length`` words that also start earlier.

    Earlier is a smaller doc_id (null last, then by text) or an earlier start in the same document.
    Rows alike in doc_id and text count as one document; doc_ids are numbers or strings (these by their
    UTF-8 bytes).  ``length`` must be a multiple of four.
    """
    if length < 4 or length % 4:
        raise ValueError("length must be a multiple of four")
    named = docs.select(identity().alias("ident"), "doc_id", "text")
    kind = dict(docs.dtypes)["doc_id"]
    # The texts are exchanged once: each of these joins reads the same columns, so Spark reuses it.
    with_texts = lambda found, how="inner": named.join(found.hint("shuffle_hash"), "ident", how).select("ident", "doc_id", "text", *found.columns[1:])
    short = _repeated(named.select("ident", "text").mapInArrow(_short(length), LEVEL))
    half = _repeated(with_texts(short).mapInArrow(_half(length), LEVEL))
    whole = with_texts(half).mapInArrow(_full(length), f"ident long, doc_id {kind}, place int, h1 long, h2 int")
    firsts = Window.partitionBy("h1", "h2").orderBy(F.col("doc_id").asc_nulls_last(), "ident", "place")
    # A rank, as repeated rows of other batches have the same window in the same place: none is later than the other.
    later = whole.withColumn("n", F.dense_rank().over(firsts)).where("n > 1 or h2 < 0")
    # Names are 64 bits, and doc_id tells apart what shares one: where it is another's, nothing is lost.
    # The exchange of the texts by name serves this join too.
    lost = later.groupBy("ident").agg(F.collect_list("place").alias("lost"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    joined = with_texts(lost.select("ident", "low", "high", "lost"), "left")
    own = F.col("low").isNull() | (F.col("doc_id") >= F.col("low")) & (F.col("doc_id") <= F.col("high"))
    return joined.select("ident", "doc_id", "text", F.when(own, F.col("lost")).alias("lost"))


def drop_repeated_words(docs: DataFrame, length: int = 20) -> DataFrame:
    """doc_id, ident, n_words, n_removed and ``text``: the kept words joined by single spaces.

    A null or empty text has no words and stays empty.  Other columns are left behind; an empty table
    gives no rows.
    """
    found = repeated_windows(docs, length)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            out = []
            for text, lost in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = (text or "").encode().split()
                if not lost:
                    out.append((len(words), 0, b" ".join(words).decode()))
                    continue
                gone = covered(len(words), lost, length)
                out.append((len(words), int(gone.sum()), b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g).decode()))
            n, removed, kept = zip(*out, strict=True) if out else ((), (), ())
            yield _rows(["doc_id", "ident", "n_words", "n_removed", "text"], [batch.column(1), batch.column(0), n, removed, kept], [None, None, pa.int64(), pa.int64(), pa.string()])

    return found.mapInArrow(run, f"doc_id {kind}, ident long, n_words long, n_removed long, text string")
