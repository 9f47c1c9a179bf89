"""Language identification by error-correcting output codes.

Each language has a codeword; for each bit a linear classifier over hashed byte n-grams learns which
languages have it set.  A text goes to the codeword whose bits cost least, each bit's loss weighted by
how well its classifier did in training, and counts as ambiguous if the runner-up costs little more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.arrow import add_column
from lectern.llm.text import identity

#: Hashed features: byte n-grams of the lower-cased text, by n.
GRAMS, BITS = (1, 2, 3), 14
#: Labelled rows that the classifiers are fitted on: at most so many of each language and so many in
#: all, but of no language fewer than LEAST.
SAMPLE_PER_LANGUAGE, SAMPLE_ROWS, LEAST = 400, 8000, 8
#: Passes of the fit, its step, and the weight that pulls coefficients to zero.
PASSES, STEP, PULL = 300, 2.0, 1e-4
#: Rows of the fit that are spread out over all features at a time.
LOT = 2048
AMBIGUOUS = 0.6


def features(text: str) -> np.ndarray:
    """A feature number for each n-gram of each n in the whole text."""
    b = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    out, h = [], np.zeros(len(b), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        if len(b) < n:
            break
        h = (h[: len(b) - n + 1] + b[n - 1 :] + np.uint32(1)) * np.uint32(2654435761)
        h ^= h >> np.uint32(15)
        if n in GRAMS:
            out.append(((h * np.uint32(n * 2 + 1)) >> np.uint32(32 - BITS)).astype(np.int32))
    return np.concatenate(out) if out else np.array([], np.int32)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def codewords(k: int) -> np.ndarray:
    """A row of +1 and -1 for each of k languages.

    Up to seven languages have every split of them into two; more have 16 bits and 8 for each doubling
    drawn from a fixed generator, columns that don't split left out.
    """
    if k < 2:
        return np.ones((k, 0), np.int8)
    if k <= 7:
        bits = [[(c >> i & 1) for i in range(k)] for c in range(1, 2 ** (k - 1))]
        return np.array(bits, np.int8).T * 2 - 1
    drawn = np.random.default_rng(17).integers(0, 2, (k, 16 + 8 * int(np.ceil(np.log2(k)))), dtype=np.int8) * 2 - 1
    return drawn[:, np.abs(drawn.sum(axis=0)) < k]


class Model:
    """Languages, codewords, coefficients (feature x bit), intercepts, and the weight of each bit.

    ``rows`` are (lang, numbers of the features of a text, their shares).
    """

    def __init__(self, rows: list[tuple[str, list[int], list[float]]]):
        self.langs = sorted({lang for lang, _, _ in rows})
        self.codes = codewords(len(self.langs))
        bits = self.codes.shape[1]
        self.coefficients, self.intercepts, self.weights = np.zeros((1 << BITS, bits), np.float32), np.zeros(bits, np.float32), np.zeros(bits)
        if not bits:
            return
        sizes = np.array([len(f) for _, f, _ in rows])
        flat, share = (np.concatenate([np.asarray(r[k]) for r in rows]) for k in (1, 2))
        seen, flat = np.unique(flat, return_inverse=True)
        #: Rare features weigh as much as frequent ones.
        scale = (1 / (np.sqrt(np.bincount(flat, share**2, len(seen)) / len(rows)) + 1e-4)).astype(np.float32) / 30
        place = {lang: k for k, lang in enumerate(self.langs)}
        y = self.codes[[place[lang] for lang, _, _ in rows]].astype(np.float32)
        ends = np.cumsum(sizes)

        def spread(at: int) -> np.ndarray:
            inside = slice(ends[at] - sizes[at], ends[min(at + LOT, len(rows)) - 1])
            x = np.zeros((min(LOT, len(rows) - at), len(seen)), np.float32)
            x[np.repeat(np.arange(len(x)), sizes[at : at + LOT]), flat[inside]] = share[inside] * scale[flat[inside]]
            return x

        whole = spread(0) if len(rows) <= LOT else None
        w, c = np.zeros((len(seen), bits), np.float32), np.zeros(bits, np.float32)
        for _ in range(PASSES):
            down, flatter = PULL * w, np.zeros(bits, np.float32)
            for at in range(0, len(rows), LOT):
                x, own = spread(at) if whole is None else whole, y[at : at + LOT]
                slope = -own / (1 + np.exp(np.clip(own * (x @ w + c), -30, 30))) / len(rows)
                down += x.T @ slope
                flatter += slope.sum(axis=0)
            w -= STEP * down
            c -= STEP * flatter
        right = sum(((spread(at) @ w + c) * y[at : at + LOT] > 0).sum(axis=0) for at in range(0, len(rows), LOT)) / len(rows)
        self.coefficients[seen], self.intercepts = w * scale[:, None], c
        self.weights = np.log(np.clip(right, 0.55, 0.995) / (1 - np.clip(right, 0.55, 0.995)))
        self.weights = self.weights / self.weights.sum()

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether it is ambiguous; ``und`` for texts without a letter."""
        if not self.langs or not has_letter(text):
            return "und", 0.0, True
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        f = features(text)
        at = np.zeros(self.codes.shape[1])
        for k in range(0, len(f), 1 << 16):
            at += self.coefficients[f[k : k + (1 << 16)]].sum(axis=0, dtype=np.float64)
        margin = at / len(f) + self.intercepts
        loss = (np.log1p(np.exp(-np.clip(self.codes * margin, -30, 30))) * self.weights).sum(axis=1)
        share = np.exp(-8 * (loss - loss.min()))
        score = float(1 / share.sum())
        return self.langs[int(loss.argmin())], score, score < AMBIGUOUS


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows that may teach: crc32 of doc_id as text modulo 3 is not 1, lang known, a text with a letter."""
    rows = docs.select("doc_id", "text", "lang").where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    return rows.select("lang", "text", F.concat_ws(" ", identity(), F.xxhash64(F.lit(1), "text")).alias("ident"))


def shares(batches):
    """lang, ident, numbers and shares of the features of each text."""
    names = ["lang", "ident", "features", "shares"]
    for batch in batches:
        made = [np.unique(features(t), return_counts=True) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
        columns = [pa.array([f for f, _ in made], pa.list_(pa.int32())), pa.array([(n / n.sum()).astype(np.float32) for _, n in made], pa.list_(pa.float32()))]
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names[:2]), *columns], names=names)


def fit(docs: DataFrame) -> Model:
    """A model from a bounded sample: of every language the rows with the least hash, whole texts.

    A language has SAMPLE_PER_LANGUAGE rows, or its part of SAMPLE_ROWS if that is less, but LEAST at
    the least; no language is left out.  Rows alike in doc_id and text are one.  Which rows they are is
    settled without their texts, and only counts of features reach the driver.
    """
    rows = training_rows(docs)
    names = rows.select("lang", "ident", F.pmod(F.xxhash64("ident"), F.lit(1 << 30)).alias("h"))
    counts = names.groupBy("lang").agg(F.count("*").alias("n")).collect()
    each = max(LEAST, min(SAMPLE_PER_LANGUAGE, SAMPLE_ROWS // max(len(counts), 1)))
    # The least hashes of a language lie, but for a vanishing chance, below this bound: a row for each language.
    bounds = docs.sparkSession.createDataFrame([(r["lang"], int(min(1.0, (4 * each + 100) / r["n"]) * (1 << 30))) for r in counts], "lang string, bound long")
    low = names.join(F.broadcast(bounds), "lang").where("h < bound").select("lang", "ident", "h").distinct()
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "ident"))
    ids = low.withColumn("n", first).where(F.col("n") <= each).select("lang", "ident")
    sample = rows.join(F.broadcast(ids), ["lang", "ident"], "left_semi").dropDuplicates(["lang", "ident"])
    found = sample.mapInArrow(shares, "lang string, ident string, features array<int>, shares array<float>").collect()
    return Model([(r["lang"], r["features"], r["shares"]) for r in sorted(found, key=lambda r: (r["lang"], r["ident"]))])


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``__lang`` = struct(lang_pred, score, ambiguous), from the whole text alone.

    A null text or one without a letter is ``und`` with score 0 and ambiguous.  An empty table gives no
    rows; all columns stay unless ``keep`` names some.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        predict = shared.value.predict
        kind = pa.struct({"lang_pred": pa.string(), "score": pa.float64(), "ambiguous": pa.bool_()})
        return lambda texts: pa.array([dict(zip(("lang_pred", "score", "ambiguous"), predict(t), strict=True)) for t in texts], kind)

    return add_column(docs, make, "__lang", "struct<lang_pred:string,score:double,ambiguous:boolean>", keep=keep)
