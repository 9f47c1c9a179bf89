"""Importance resampling towards a target distribution.

Hashed runs of words are counted over the whole corpus and over the target's texts.  Each bucket gains
the log of the ratio of the two, and an array of those gains scores a text by the mean over its runs.
Gumbel noise from a hash of the doc_id makes the highest scores a sample without replacement.  Which
scores are drawn is found by halving the range of the written scores, with exact counts of all rows;
ties are halved by doc_id in the same way.  The rows drawn are range-partitioned for their ranks.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.storage import materialize
from lectern.llm.arrow import bounded
from lectern.llm.ranks import ranked
from lectern.llm.text import unwrapped

#: Digits, lower-case letters and everything beyond ASCII, as UTF-8.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BREAK = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
#: Bytes of a text whose words are in memory at once, and words that a worker remembers.
PIECE, KNOWN = 1 << 20, 1 << 20
#: Halvings of a range that one count job settles.
HALVINGS = 4


def word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The words of a whole text, A-Z lower-cased, in lists of about ``PIECE`` bytes; a word is never cut."""
    at = 0
    while at < len(text):
        cut = BREAK.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        yield WORD.findall(text[at:end].lower())
        at = end


class Buckets(dict):
    """Word (or run of words) to bucket, remembered up to a bound."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        found = self[word] = zlib.crc32(word) % self.buckets
        return found


def bucket_runs(text: bytes | None, known: Buckets, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each piece of a text its number of words and the buckets of all runs of 1 to ``longest`` words that end in it."""
    before: list[bytes] = []
    for own in word_lists(text or b""):
        words = before + own
        found = [known[w] for w in own]
        for k in range(2, longest + 1):
            found += [known[b" ".join(words[i : i + k])] for i in range(max(0, len(before) - k + 1), len(words) - k + 1)]
        yield len(own), np.array(found, np.int64)
        before = words[max(0, len(words) - longest + 1) :] if longest > 1 else []


def run_counts(texts: DataFrame, buckets: int, longest: int) -> np.ndarray:
    """How often each bucket occurs in all rows of ``text``: a task sends a row for each bucket it has met."""

    def count(batches):
        known, found = Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in bounded(batches, "text"):
            for text in batch.column(0).to_pylist():
                for _, runs in bucket_runs(text, known, longest):
                    found += np.bincount(runs, minlength=buckets)
        met = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(found[met])], names=["bucket", "n"])

    counts = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "bucket long, n long")
    total = np.zeros(buckets, np.int64)
    for r in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[r["bucket"]] = r["n"]
    return total


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What each bucket gains, in thousandths, rounded down; both counts are smoothed by one a bucket."""
    buckets, s_all, t_all = len(raw), float(raw.sum() + len(raw)), float(target.sum() + len(raw))
    ratio = ((target + 1.0) * s_all) / ((raw + 1.0) * t_all)
    return np.array([math.floor(1000 * math.log(ratio[b])) for b in range(buckets)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in thousandths, rounded down, the same for a doc_id on every run."""
    h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, longest: int, seed: int) -> DataFrame:
    """``docs`` (row, doc_id, text) with n_words, n_features, weight and score in place of the text."""
    keep = [c for c in docs.columns if c != "text"]
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight", "score"))])

    def weigh(batches):
        known = Buckets(len(gain))
        for batch in bounded(batches, "text"):
            rows = []
            ids, texts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "text"))
            for doc_id, text in zip(ids, texts, strict=True):
                n_words = n = total = 0
                for own, runs in bucket_runs(text, known, longest):
                    n_words, n, total = n_words + own, n + len(runs), total + int(gain[runs].sum())
                weight = total // n if n else 0
                rows.append((n_words, n, weight, weight + noise(doc_id, seed)))
            made = [pa.array(c, pa.int64()) for c in np.array(rows, np.int64).reshape(-1, 4).T]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), *made], names=schema.names)

    return docs.withColumn("text", F.col("text").cast("binary")).mapInArrow(weigh, schema)


def midpoints(low: int, high: int, halvings: int) -> list[int]:
    """Where halving [low, high] may probe in the next steps, in ascending order."""
    if low >= high or not halvings:
        return []
    mid = (low + high) // 2
    return [*midpoints(low, mid, halvings - 1), mid, *midpoints(mid + 1, high, halvings - 1)]


def cutoff(rows: DataFrame, key: Column, need: int) -> tuple[int, int, int]:
    """The least value that ``need`` rows have or are below, how many are below it, and how many have it.

    The range of values is halved until it is one value; a job counts the rows at or below the
    midpoints of ``HALVINGS`` steps at once.  The range only ever shrinks, so later jobs skip what lies outside.
    """
    low, high, n = rows.agg(F.min(key), F.max(key), F.count("*")).first()
    below, upto = 0, n
    while low < high:
        probes = midpoints(low, high, HALVINGS)
        inside = rows.where((key >= low) & (key <= high)).agg(*(F.count_if(key <= p) for p in probes)).first()
        counts = [(p, below + c) for p, c in zip(probes, inside, strict=True)]
        short, enough = [x for x in counts if x[1] < need], [x for x in counts if x[1] >= need]
        if enough:
            high, upto = enough[0]
        if short:
            low, below = short[-1][0] + 1, short[-1][1]
    return low, below, upto - below


def drawn(rows: DataFrame, keys: list[Column], among: Column, need: int) -> Column:
    """The condition that the first ``need`` rows by ``keys`` fulfil, of those that are ``among``.

    Each key settles what the one before left tied; the last one is different in each row.
    """
    ahead, tied = F.lit(False), among
    for key in keys if need else []:
        value, below, at = cutoff(rows.where(tied), key, need)
        ahead, tied, need = ahead | (tied & (key < value)), tied & (key == value), need - below
        if at == need:
            return ahead | tied
    return ahead


def resample(docs: DataFrame, target: DataFrame, share: int = 10, min_words: int = 20, longest: int = 1, buckets: int = 10_000, seed: int = 2024, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, all by default) with ``__draw`` = struct(n_features, weight, score, rank).

    ``share`` percent, rounded down, of the rows with at least ``min_words`` words are drawn, those with
    the highest scores; their ranks count from 1, the rest has none.  Ties go to the smaller doc_id (an
    integer; null last), those of one doc_id to an arbitrary row that stays the same.  A null or empty
    text has no features and weighs 0; repeated rows count and are drawn as rows of their own.  A word is
    never cut, however long a text is.  Of ``target`` only ``text`` is read; without words in it the gains
    rest on the corpus alone.  All columns stay, whatever their names, but for one named ``__draw``, which
    gives way; an empty table gives no rows.
    """
    keep = docs.columns if keep is None else keep
    gain = gains(run_counts(docs.select("text"), buckets, longest), run_counts(target.select("text"), buckets, longest))
    rows = scored(docs.select(F.struct(*keep).alias("row"), "doc_id", "text"), gain, longest, seed)
    # Written once: every count sees the same rows, and reads no more than the columns it compares.
    rows = materialize(rows.withColumn("tie", F.monotonically_increasing_id()), "scores")
    enough = F.col("n_words") >= min_words
    keys = [-F.col("score"), F.col("doc_id").isNull().cast("int"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col("tie")]
    first = drawn(rows, keys, enough, rows.where(enough).count() * share // 100)
    chosen = ranked(rows.where(first), keys, "drawn").withColumn("rank", F.col("rank") + 1)
    every = chosen.drop("total").unionByName(rows.where(~first).withColumn("rank", F.lit(None).cast("long")))
    return unwrapped(every.withColumn("__draw", F.struct("n_features", "weight", "score", "rank")), keep, "__draw")
