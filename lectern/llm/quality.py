"""Quality rules: base counts of a text, and a hashed n-gram log-likelihood ratio.

Words and pairs of neighbouring words fall into a fixed number of hash buckets.  Two multinomials
over the buckets are counted, one over all of the corpus and one over trusted documents; an n-gram
weighs the log of their ratio, in thousandths.  A document has two scores: the mean over all of its
n-grams, and the weight that only its lowest words stay below, two and one more for every 250 words, so
that a few words which trusted documents lack aren't lost in a long text.  What is below the threshold
of either score goes.  All of it is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.storage import materialize
from lectern.llm.text import WHITE, body, unwrapped, words

BUCKETS = 1 << 18
#: Each threshold is this quantile of the scores of the held-out trusted half, less a margin in
#: thousandths: of the mean, of the lowest words.
MEAN_SHARE, MEAN_MARGIN = 0.001, 50
LOW_SHARE, LOW_MARGIN = 0.002, 200
#: Words to each that may be lower than the second score.
WORDS_EACH = 250
#: Words that a document has at least to pass the base rules.
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"


def of_target(doc_id: str = "doc_id") -> Column:
    """Whether a document, if it is trusted, counts as the target; else it sets the thresholds."""
    return F.pmod(F.xxhash64(F.col(doc_id).cast("string")), F.lit(2)) == 0


def trusted_ids(labels: DataFrame) -> DataFrame:
    """All doc_ids labelled as of good quality and not toxic, with ``target`` for one half.

    That half is counted as the target, the other half sets the thresholds.  Null ids and repeats don't count.
    """
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
    return good.withColumn("target", of_target())


def buckets(tokens: Column) -> Column:
    """Buckets of all words, then those of all pairs of neighbours; ``tokens`` is a column, as lambdas read it again and again."""
    ones = F.transform(tokens, lambda w: _bucket(w))
    others = F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0)))
    return F.concat(ones, F.transform(others, lambda w, i: _bucket(w, F.get(tokens, i + 1))))


def _bucket(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(BUCKETS)).cast("int")


def bucket_weights(docs: DataFrame, trusted: DataFrame) -> DataFrame | None:
    """One row, ``weights``: the log-likelihood ratio of each bucket in thousandths, target over raw; None without trusted texts.

    One pass counts n-grams of all documents, one those of the trusted ones in the target half; only
    that half's texts are exchanged, as ids are as many as documents and can't be broadcast.  A bucket
    counts one more than it holds.  What leaves a task is at most a row for each bucket.
    """

    def counted(texts: DataFrame, name: str) -> DataFrame:
        each = texts.select(words(body()).alias("w")).select(F.explode(buckets(F.col("w"))).alias("bucket"))
        return each.groupBy("bucket").agg(F.count("*").alias(name))

    chosen = docs.where(of_target()).join(trusted.where("target").select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi")
    counts = materialize(counted(docs, "raw").join(counted(chosen, "target"), "bucket", "left"), "counts")
    n, m = counts.agg(F.sum("raw"), F.sum("target")).first()
    if not m:
        return None
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    ratio = (F.coalesce("target", F.lit(0)) + 1) / F.lit(float(m + BUCKETS)) * F.lit(float(n + BUCKETS)) / (F.coalesce("raw", F.lit(0)) + 1)
    row = F.array_sort(F.collect_list(F.struct("bucket", F.round(1000 * F.log(ratio)).cast("int").alias("weight"))))
    return materialize(every.agg(F.transform(row, lambda x: x["weight"]).alias("weights")), "weights")


def with_scores(rows: DataFrame, tokens: str, weights: DataFrame) -> DataFrame:
    """``rows`` with ``score`` = struct(mean, low) of the words ``tokens``, whole thousandths; both null without words.

    The weights are a scalar subquery, read once in a place of its own: a row never holds the table.
    """
    looked = rows.withColumns({"buckets": buckets(F.col(tokens)), "table": weights.select("weights").scalar()})
    each = looked.select(*rows.columns, F.transform("buckets", lambda b: F.get("table", b)).alias("each"))
    n = F.size(tokens)
    mean = F.floor(F.aggregate("each", F.lit(0).cast("long"), lambda a, x: a + x) / F.size("each"))
    low = F.get(F.sort_array(F.slice("each", 1, n)), F.least(n - 1, 1 + F.floor(n / WORDS_EACH).cast("int")))
    return each.withColumn("score", F.struct(F.when(n > 0, mean).alias("mean"), F.when(n > 0, low).cast("long").alias("low"))).drop("each")


def low_ends(scores: DataFrame) -> tuple[int, int] | None:
    """The thresholds by the scores (mean, low) of held-out documents; None without any.

    Scores are whole numbers of a bounded range, so counting them is exact and small.
    """
    of = F.explode(F.array(*(F.struct(F.lit(c).alias("of"), F.col(c).alias("value")) for c in ("mean", "low")))).alias("s")
    counts = scores.select(of).groupBy("s.of", "s.value").agg(F.count("*").alias("n")).collect()
    ends = []
    for name, share, margin in (("mean", MEAN_SHARE, MEAN_MARGIN), ("low", LOW_SHARE, LOW_MARGIN)):
        own = sorted((r["value"], r["n"]) for r in counts if r["of"] == name)
        left = int(share * (sum(n for _, n in own) - 1))
        for value, n in own:
            if left < n:
                ends.append(value - margin)
                break
            left -= n
    return tuple(ends) if ends else None


def repeated_words(hashes: Column, ordered: Column) -> Column:
    """Positions of 3-word windows found twice or more; ``ordered`` holds (hash, position) sorted."""
    same = lambda x, k: F.when((F.get(ordered, k - 1)["h"] == x["h"]) | (F.get(ordered, k + 1)["h"] == x["h"]), x["i"])
    return F.sort_array(F.filter(F.transform(ordered, same), lambda i: i.isNotNull()))


def base_counts(rows: DataFrame) -> DataFrame:
    """``rows``, of which only ``text`` is read, with ``words`` and ``base`` = struct(n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words)."""
    text = body()
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    d = rows.withColumns({"words": words(text), "lines": lines})
    packed = F.array_join("words", "")
    plain = packed
    for c in SYMBOLS:
        plain = F.replace(plain, F.lit(c), F.lit(""))
    window = F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    d = d.withColumns({
        "chars": F.char_length(packed),
        "symbols": F.octet_length(packed) - F.octet_length(plain),
        "dup": F.size("lines") - F.size(F.array_distinct("lines")),
        "h": F.slice(window, 1, F.greatest(F.size("words") - 2, F.lit(0))),
    })
    repeats = F.size(F.array_distinct("h")) < F.size("h")
    d = d.withColumn("sorted", F.when(repeats, F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    d = d.withColumn("again", F.when(F.col("sorted").isNotNull(), repeated_words(F.col("h"), F.col("sorted"))))
    # Each repeated window covers three words, or as many as lie before the next one.
    spans = F.transform("again", lambda p, k: F.least(F.coalesce(F.get("again", k + 1) - p, F.lit(3)), F.lit(3)))
    covered = F.coalesce(F.aggregate(spans, F.lit(0), lambda a, x: a + x), F.lit(0))
    counts = {"n_words": F.size("words"), "word_chars": F.col("chars"), "n_symbols": F.col("symbols"), "n_dup_lines": F.col("dup"), "n_repeat_words": covered}
    return d.withColumn("base", F.struct(*(c.cast("long").alias(k) for k, c in counts.items()))).select(*rows.columns, "words", "base")


def base_failed() -> Column:
    n, repeated = F.col("base.n_words"), F.col("base.n_repeat_words")
    return (n < MIN_WORDS) | (100 * repeated > 50 * n)


def score_quality(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, all by default) with ``__quality`` = struct(the base counts, base_failed, mean, low, kept).

    A null text has no words and fails.  The thresholds lie a margin below the scores of nearly all
    trusted documents of 50 words that the target hasn't seen; without such only the base rules decide,
    and without trusted texts both scores are null.  All columns stay, whatever their names, but for one
    named ``__quality``, which gives way; there is a row for each row, repeated ones too, and none for
    an empty table.  Each repeated row counts in the corpus.  Every text is scored once: the scores are
    written with the columns kept, and the thresholds and verdicts come from there.
    """
    keep = docs.columns if keep is None else keep
    slim = docs.select("doc_id", "text")
    trusted = trusted_ids(labels)
    weights = bucket_weights(slim, trusted)
    d = base_counts(docs.select(F.struct(*keep).alias("row"), "doc_id", "text"))
    if weights is None:
        nothing = F.lit(None).cast("long")
        d = d.withColumn("score", F.struct(nothing.alias("mean"), nothing.alias("low")))
    else:
        d = with_scores(d, "words", weights)
    d = materialize(d.select("row", "doc_id", "base", "score"), "scores")
    unseen = d.where(~of_target()).where(F.col("base.n_words") >= MIN_WORDS).select("doc_id", "score.*")
    ends = None if weights is None else low_ends(unseen.join(trusted.where(~F.col("target")).select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi"))
    good = F.lit(True) if ends is None else F.coalesce((F.col("score.mean") >= ends[0]) & (F.col("score.low") >= ends[1]), F.lit(False))
    verdict = F.struct("base.*", base_failed().alias("base_failed"), "score.mean", "score.low", (~base_failed() & good).alias("kept"))
    return unwrapped(d.withColumn("__quality", verdict), keep, "__quality")
