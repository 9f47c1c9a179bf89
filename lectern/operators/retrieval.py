"""Hybrid retrieval for whole tables of queries: BM25 and cosine lists, fused by reciprocal rank."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.models import Model, with_model
from lectern.functions.scores import clamp
from lectern.functions.storage import materialize, spread
from lectern.functions.texts import WHITE, strip

#: Fixed values of the scoring rules.
K1, B, EPSILON, RRF_K = 1.5, 0.75, 0.25, 60


def tokens(text: Column) -> Column:
    """Lower-cased runs between white space, punctuation and all."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "\\s+"), lambda t: t != "")


def top(df: DataFrame, k: int, keys: list[str], *order: Column) -> DataFrame:
    """The first k of each group with their rank from 0."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).where(F.col("rank") < k)


@dataclass(frozen=True)
class Corpus:
    """Statistics of a corpus: chunks, their mean length in terms, and df and idf of each term."""

    chunks: int
    mean_length: float
    terms: DataFrame


#: Rows of a batch that are scored together, and scores that are in memory at once.
SCORED_ROWS, TILE = 2000, 4_000_000


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order and how often each occurs."""
    keys = np.sort(keys)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return keys[starts], np.diff(np.append(starts, len(keys)))


def _counts(batches):
    """term and df of each batch; the row without a term holds the batch's chunks and the sum of their lengths."""
    for batch in batches:
        column = batch.column(0)
        flat = column.flatten().dictionary_encode()
        lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(column)), lengths)
        size = max(len(flat.dictionary), 1)
        once = _distinct(row * size + flat.indices.to_numpy(zero_copy_only=False))[0] % size
        df = np.bincount(once.astype(np.int64), minlength=len(flat.dictionary))
        terms = pa.concat_arrays([flat.dictionary, pa.nulls(1, flat.dictionary.type)])
        yield pa.RecordBatch.from_arrays([terms, pa.array([*df, len(column)], pa.int64()), pa.array([*([0] * len(df)), lengths.sum()], pa.int64())], names=["term", "df", "length"])


def corpus_statistics(chunks: DataFrame) -> Corpus:
    """One pass over the chunks; a negative idf becomes a quarter of the mean idf."""
    found = spread(chunks.select("text")).select(tokens(F.col("text")).alias("terms")).mapInArrow(_counts, "term string, df long, length long")
    df = materialize(found.groupBy("term").agg(F.sum("df").alias("df"), F.sum("length").alias("length")), "df")
    n, total = (df.where("term is null").select("df", "length").first() or (0, 0))[:2]
    raw = df.where("term is not null").withColumn("raw", F.ln((n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    mean = raw.agg(F.avg("raw")).first()[0]
    terms = raw.select("term", "df", F.when(F.col("raw") < 0, F.lit(EPSILON) * F.lit(mean)).otherwise(F.col("raw")).alias("idf"))
    return Corpus(n, total / n if n else 0.0, terms)


class _Best:
    """The k best (score, place) of each query so far, ties to the lesser place; -inf is nothing."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), -np.inf)
        self.place = np.full((queries, k), np.iinfo(np.int64).max)

    def offer(self, rows: slice, score: np.ndarray, place: np.ndarray) -> None:
        """More scores of some queries, a column for each place."""
        k = self.k
        if score.shape[1] > 4 * k:  # what is below the k-th can't be among the best
            low = np.partition(score, -k, axis=1)[:, [-k]]
            wide = int((score >= low).sum(axis=1).max())
            few = np.argsort(-score, axis=1, kind="stable")[:, :wide]
            score, found = np.take_along_axis(score, few, 1), place[few]
        else:
            found = np.broadcast_to(place, score.shape)
        score, found = np.hstack([self.score[rows], score]), np.hstack([self.place[rows], found])
        order = np.lexsort((found, -score), axis=1)[:, :k]
        self.score[rows], self.place[rows] = np.take_along_axis(score, order, 1), np.take_along_axis(found, order, 1)

    def arrays(self, ids: pa.Array) -> list[pa.Array]:
        there = self.score > -np.inf
        return [ids.take(pa.array(np.nonzero(there)[0])), pa.array(self.place[there]), pa.array(self.score[there])]


class AskedTerms:
    """What a block of queries asks for, by term: the queries that hold it and its weight in each.

    Terms that a quarter of the queries hold are columns of a matrix, so that a term that everyone asks
    for costs a product; the others are lists.
    """

    def __init__(self, asked: pa.Table):
        codes = asked["query_id"].combine_chunks().dictionary_encode()
        terms = asked["term"].combine_chunks().dictionary_encode()
        self.ids, self.terms = codes.dictionary, terms.dictionary
        query, term, weight = (x.to_numpy(zero_copy_only=False) for x in (codes.indices, terms.indices, asked["weight"]))
        order = np.argsort(term, kind="stable")
        self.query, self.weight = query[order].astype(np.int64), weight[order]
        many = np.bincount(term, minlength=len(self.terms))
        self.starts = np.concatenate([[0], np.cumsum(many)])
        common = np.flatnonzero(4 * many > len(self.ids))
        self.column = np.full(len(self.terms), -1)
        self.column[common] = np.arange(len(common))
        self.matrix = np.zeros((len(common), len(self.ids)))
        for c, t in enumerate(common):
            own = slice(self.starts[t], self.starts[t + 1])
            self.matrix[c, self.query[own]] = self.weight[own]

    def scores(self, terms: pa.Array, mean_length: float) -> np.ndarray:
        """Scores of all queries (rows) against a batch of chunks, given by their lists of terms."""
        chunks, queries = len(terms), len(self.ids)
        length = pc.list_value_length(terms).to_numpy(zero_copy_only=False)
        found = pc.index_in(terms.flatten(), value_set=self.terms)
        known = found.is_valid().to_numpy(zero_copy_only=False)
        row, term = np.repeat(np.arange(chunks), length)[known], found.drop_null().to_numpy(zero_copy_only=False)
        key, tf = _distinct(row * len(self.terms) + term)
        row, term = key // len(self.terms), key % len(self.terms)
        value = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[row] / mean_length))
        common = self.column[term] >= 0
        held = np.zeros((chunks, len(self.matrix)))
        held[row[common], self.column[term[common]]] = value[common]
        score = (held @ self.matrix).T.ravel()
        row, term, value = row[~common], term[~common], value[~common]
        many = self.starts[term + 1] - self.starts[term]
        ends = np.cumsum(many)
        at = 0
        while at < len(term):  # postings times queries, some millions at a time
            below = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, below + TILE, "right")))
            part = slice(at, end)
            each = np.repeat(np.arange(at, end), many[part])
            place = np.arange(len(each)) - np.repeat(ends[part] - many[part] - below, many[part]) + self.starts[term[each]]
            score += np.bincount(self.query[place] * chunks + row[each], weights=value[each] * self.weight[place], minlength=len(score))
            at = end
        return score.reshape(queries, chunks)


#: Pairs of a query and a term that go to all tasks at once, some tens of megabytes.
SENT_PAIRS = 1_000_000


def bm25(chunks: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, corpus_pos (a whole number), score, rank: the k best chunks of each query, scores not above 0 left out.

    A repeated query term counts as often; ties keep the corpus order.  The chunks are scored where they are
    read, batch by batch against a block of queries, and k rows of each query leave a task: nothing is
    exchanged by term.  Queries beyond a block cost another pass over the chunks.
    """
    corpus = corpus_statistics(chunks)
    asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    weights = materialize(asked.join(corpus.terms, "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("weight")), "asked")
    blocks = max(1, -(-weights.count() // SENT_PAIRS))
    listed = spread(chunks.select("corpus_pos", "text")).select("corpus_pos", tokens(F.col("text")).alias("terms"))
    found = []
    for n in range(blocks):
        block = AskedTerms(weights.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n).toArrow())
        held = chunks.sparkSession.sparkContext.broadcast(block)

        def run(batches, held=held):
            block, kept = held.value, None
            step = max(1, min(SCORED_ROWS, TILE // max(1, len(block.ids))))
            kept = _Best(len(block.ids), k)
            for batch in (whole.slice(at, step) for whole in batches for at in range(0, whole.num_rows, step)):
                if len(block.ids):
                    score = np.round(block.scores(batch.column(1), corpus_mean), 9)
                    score[score <= 0] = -np.inf
                    kept.offer(slice(None), score, batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays(kept.arrays(block.ids), names=["query_id", "corpus_pos", "score"])

        corpus_mean = corpus.mean_length
        kinds = f"query_id {dict(queries.dtypes)['query_id']}, corpus_pos long, score double"
        found.append(top(listed.mapInArrow(run, kinds), k, ["query_id"], F.desc("score"), F.asc("corpus_pos")))
    return reduce(DataFrame.unionByName, found)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def _nearest(held, k: int, grouped: bool, names: list[str]):
    """A task's k nearest vectors of each query (and group), tile by tile of a matrix product."""

    def run(batches):
        ids, asked = held.value  # rows of length 1
        step = max(1, min(SCORED_ROWS, TILE // max(1, len(asked))))
        wide = max(1, TILE // step)
        kept: dict = {}
        for batch in (whole.slice(at, step) for whole in batches for at in range(0, whole.num_rows, step)):
            column = batch.column(1)
            vectors = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
            place = batch.column(0).to_numpy()
            groups = np.array(batch.column(2).to_pylist(), object) if grouped else np.zeros(len(place), object)
            with np.errstate(invalid="ignore", divide="ignore"):
                vectors /= np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
            for group in dict.fromkeys(groups.tolist()):
                at = groups == group
                best = kept.setdefault(group, _Best(len(asked), k))
                for low in range(0, len(asked), wide):
                    score = np.round(asked[low : low + wide] @ vectors[at].T, 6)
                    score[~np.isfinite(score)] = -np.inf
                    best.offer(slice(low, low + wide), score, place[at])
        for group, best in kept.items():
            columns = best.arrays(ids)
            yield pa.RecordBatch.from_arrays(columns + ([pa.array([group] * len(columns[0]), pa.string())] if grouped else []), names=names)

    return run


#: Numbers of query vectors that go to all tasks at once: 64 MB.
SENT_NUMBERS = 8_000_000


def dense(vectors: DataFrame, queries: DataFrame, k: int = 20, by: str | None = None, block: int | None = None) -> DataFrame:
    """query_id, chunk_pos (a whole number), score, rank: the k nearest vectors of each query by cosine, of each value of ``by`` if named.

    Queries of each length meet the vectors of that length.  Vectors are read once for every ``block``
    queries (as many as fill 64 MB by default), which go to all tasks as one matrix; a task keeps k rows for each and has a
    tile of scores in memory.  Vectors that are null or all zeros are never near.
    """
    asked = queries.where("embedding is not null").select("query_id", F.col("embedding").cast("array<double>").alias("q"))
    groups = [by] if by else []
    names = ["query_id", "chunk_pos", "score", *groups]
    schema = f"query_id {dict(queries.dtypes)['query_id']}, chunk_pos long, score double" + "".join(f", {g} string" for g in groups)
    lengths = asked.groupBy(F.size("q").alias("size")).count().where("size > 0").orderBy("size").collect()
    found = [vectors.sparkSession.createDataFrame([], schema + ", rank int")]
    for size, many in lengths:
        blocks = -(-many // (block or max(1, SENT_NUMBERS // size)))
        fitting = vectors.where(F.size("embedding") == size).select("chunk_pos", "embedding", *groups)
        for n in range(blocks):
            own = asked.where((F.size("q") == size) & (F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n)).toArrow()
            matrix = own["q"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            with np.errstate(invalid="ignore", divide="ignore"):
                matrix = matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
            held = vectors.sparkSession.sparkContext.broadcast((own["query_id"].combine_chunks(), matrix))
            found.append(top(fitting.mapInArrow(_nearest(held, k, bool(by), names), schema), k, ["query_id", *groups], F.desc("score"), F.asc("chunk_pos")))
    return reduce(DataFrame.unionByName, found[1:] or found)


def dense_union(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """k from the private collection and k from the shared one in one list."""
    both = dense(vectors.where(F.col("collection").isin("private", "knowledge_base")), queries, k, "collection").withColumnRenamed("collection", "scope")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_pos")) - 1
    return both.withColumn("rank", rank)


#: Collections that each purpose may see; reports are judged by the referential alone.
ROUTES = {"chat": ("private", "knowledge_base"), "analysis": ("referential",)}


def routed(chunks: DataFrame, purpose: str) -> DataFrame:
    """The chunks that a purpose may see, for any search to go through; an unknown purpose is an error."""
    return chunks.where(F.col("collection").isin(*ROUTES[purpose]))


def fusion_key(chunk_id: Column, text: Column) -> Column:
    """What makes two hits the same chunk: its id, or without one the first 80 characters of its text."""
    return F.coalesce(F.nullif(chunk_id, F.lit("")), F.left(text, F.lit(80)))


def fuse(lists: DataFrame, k: int, keys: list[str] | None = None) -> DataFrame:
    """Reciprocal rank fusion of (query_id, list_no, rank, key, ...): rrf_score and the first k keys.

    A key that a list repeats adds its share each time; ties keep the order of first sight.
    """
    keys = keys or ["query_id"]
    share = 1 / (F.lit(float(RRF_K)) + F.col("rank") + 1)
    fused = lists.groupBy(*keys, "key").agg(F.round(F.sum(share), 6).alias("rrf_score"), F.min(F.struct("list_no", "rank")).alias("seen"), F.max(F.when(F.col("list_no") == 0, F.col("score"))).alias("dense_score"))
    return top(fused, k, keys, F.desc("rrf_score"), F.asc("seen"), F.asc("key")).drop("seen")


def as_list(hits: DataFrame, key: str, list_no: int, *more: str) -> DataFrame:
    return hits.select("query_id", *more, F.lit(list_no).alias("list_no"), "rank", F.col(key).alias("key"), "score")


def hybrid(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, query_vectors: DataFrame, k: int = 5, width: int = 20) -> DataFrame:
    """The k best keys of each query over dense and sparse lists of ``width``."""
    lists = as_list(dense_union(vectors, query_vectors, width), "chunk_pos", 0).unionByName(as_list(bm25(chunks, queries, width), "corpus_pos", 1))
    return fuse(lists, k)


def split_hybrid(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, query_vectors: DataFrame, k: int = 5, width: int = 20) -> DataFrame:
    """The k best of the private collection (dense and sparse) and the k best of the shared one (dense)."""
    found = dense_union(vectors, query_vectors, width)
    own = Window.partitionBy("query_id", "scope").orderBy("rank")
    found = found.withColumn("rank", F.row_number().over(own) - 1)
    sparse = bm25(chunks, queries, width).withColumn("scope", F.lit("private"))
    lists = as_list(found, "chunk_pos", 0, "scope").unionByName(as_list(sparse, "corpus_pos", 1, "scope"))
    return fuse(lists, k, ["query_id", "scope"])


def rerank(hits: DataFrame, pair_scores: DataFrame, width: int = 15, k: int = 5) -> DataFrame:
    """The first ``width`` hits ordered anew by a model's scores; pairs without one come last."""
    scored = hits.where(F.col("rank") < width).drop("rank").join(pair_scores, ["query_id", "key"], "left")
    return top(scored, k, ["query_id"], F.desc_nulls_last("rerank_score"), F.asc("key"))


def rerank_with(hits: DataFrame, queries: DataFrame, chunks: DataFrame, key: str, load: Callable[[], Model], width: int = 15, k: int = 5, batch: int = 64) -> DataFrame:
    """:func:`rerank` by a model that scores pairs of ``query`` and ``text``, loaded once a worker and asked in batches.

    ``queries`` has query_id and text, ``chunks`` key and text.  Only the first ``width`` hits of a query are scored.
    """
    first = hits.where(F.col("rank") < width).select("query_id", "key")
    pairs = first.join(queries.select("query_id", F.col("text").alias("query")), "query_id").join(chunks.select("key", "text"), "key")
    scores = with_model(pairs, key, load, ["query", "text"], "rerank_score", T.DoubleType(), batch)
    return rerank(hits, scores.select("query_id", "key", "rerank_score"), width, k)


def boosted(hits: DataFrame, boosts: DataFrame) -> DataFrame:
    """rrf_score times the factor of the hit's source where it is above 1; ranks follow."""
    own = boosts.where("factor > 1").select(F.lower(strip(F.col("source"))).alias("__s"), "factor")
    joined = hits.withColumn("__s", F.lower(strip(F.col("source")))).join(own, "__s", "left").drop("__s")
    score = F.round(F.col("rrf_score") * F.coalesce("factor", F.lit(1.0)), 6)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "rank")) - 1
    return joined.withColumns({"rrf_score": score, "boosted": F.col("factor").isNotNull()}).drop("factor").withColumn("rank", place)


def retrieval_confidence(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Mean of a query's first three scores over the most two lists can give, in [0, 1]; 0 without hits."""
    mean = hits.where("rank < 3").groupBy("query_id").agg(F.avg("rrf_score").alias("mean"))
    value = F.round(clamp(F.col("mean") / (2 / (RRF_K + 2))), 6)
    return queries.select("query_id").join(mean, "query_id", "left").select("query_id", F.coalesce(value, F.lit(0.0)).alias("confidence"))


def context_block(hits: DataFrame, *keys: str) -> DataFrame:
    """Hits as text blocks with a header each, in order of rank."""
    shared = F.concat(F.lit("[KB — "), "source", F.lit(" p."), "page", F.lit("]"), F.coalesce(F.concat(F.lit(" ("), "url", F.lit(")")), F.lit("")))
    header = F.when(F.col("scope") == "knowledge_base", shared).otherwise(F.concat(F.lit("["), "source", F.lit(" p."), "page", F.lit("]")))
    block = F.struct("rank", F.concat(header, F.lit("\n"), "text").alias("block"))
    return hits.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda b: b["block"]), "\n\n---\n\n").alias("context"))


def two_block_context(hits: DataFrame) -> DataFrame:
    """A private and a shared block, either left out if empty, and which of them are there."""
    by = context_block(hits, "query_id", "scope")
    own = F.max(F.when(F.col("scope") == "private", F.concat(F.lit("### PRIVATE\n"), "context")))
    shared = F.max(F.when(F.col("scope") == "knowledge_base", F.concat(F.lit("### PUBLIC\n"), "context")))
    return by.groupBy("query_id").agg(F.concat_ws("\n\n", own, shared).alias("context"), own.isNotNull().alias("has_private"), shared.isNotNull().alias("has_kb"))


def citations(hits: DataFrame) -> DataFrame:
    """What a citation shows, with stand-ins for what is missing."""
    unknown = F.coalesce(F.nullif("source", F.lit("")), F.lit("inconnu"))
    return hits.select("query_id", "rank", F.coalesce("scope", F.lit("private")).alias("scope"), unknown.alias("source"), F.coalesce("page", F.lit("?")).alias("page"), "url")


def distinct_citations(cited: DataFrame) -> DataFrame:
    return top(cited.withColumnRenamed("rank", "place"), 1, ["query_id", "scope", "source", "url"], F.asc("place")).drop("rank")


def tenant_collection(user: Column) -> Column:
    return F.left(F.concat(F.lit("rag_"), F.lower(F.regexp_replace(user, "[^a-zA-Z0-9]", "_"))), F.lit(40))


def visible_chunks(chunks: DataFrame, collection: str, shared: str = "knowledge_base") -> DataFrame:
    """What a tenant may see: rows of its own collection and shared ones, no other tenant's; a filter of the scan."""
    return chunks.where(F.col("collection").isin(collection, shared))


def visible_counts(users: DataFrame, chunks: DataFrame, shared: str = "knowledge_base") -> DataFrame:
    """Chunks that each user (user, collection) may see: ``own`` and ``shared``; users who may see none have no row.

    Chunks are counted by collection first, so shared ones are one row and not one for each user.
    """
    sizes = chunks.groupBy("collection").agg(F.count("*").alias("n"))
    seen = users.select("user", F.explode(F.array_distinct(F.array("collection", F.lit(shared)))).alias("collection")).distinct()
    common = F.col("collection") == shared
    held = seen.join(sizes, "collection").groupBy("user")
    return held.agg(*(F.coalesce(F.sum(F.when(side, F.col("n"))), F.lit(0)).alias(name) for name, side in (("own", ~common), ("shared", common))))


def answered(queries: DataFrame, hits: DataFrame, message: str) -> DataFrame:
    """Every query with its number of hits, and the message where there are none."""
    counts = hits.groupBy("query_id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return queries.select("query_id").join(counts, "query_id", "left").select("query_id", n.alias("n_hits"), F.when(n == 0, message).alias("message"))


def history_window(messages: DataFrame, max_turns: int = 10, max_chars: int = 2000, white: str = WHITE) -> DataFrame:
    """The last messages of user and assistant in each conversation, blank ones left out, long ones cut.

    ``white`` has the characters that make a message blank and that go where one is cut.
    """
    spoken = messages.where(F.col("role").isin("user", "assistant") & (F.btrim("text", F.lit(white)) != ""))
    text = F.when(F.length("text") > max_chars, F.concat(F.rtrim(F.left("text", F.lit(max_chars)), F.lit(white)), F.lit("…"))).otherwise(F.col("text"))
    last = top(spoken, max_turns, ["conv_id"], F.desc("turn"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return last.select("conv_id", "turn", "role", text.alias("text"), place.alias("place"))


#: What the system's message asks for, by the blocks that the context has.
STRUCTURE = {
    "both": "Answer in two sections, private documents first, then public sources; don't mix them.",
    "private": "Answer in one section, from the private documents alone.",
    "public": "Answer in one section, from the public sources alone.",
}


def prompt_messages(contexts: DataFrame, queries: DataFrame, history: DataFrame, structure: dict[str, str] | None = None) -> DataFrame:
    """query_id and the messages for a model: the system's by what the context has, with the context, the history, the question.

    ``contexts`` are those of :func:`two_block_context`; ``structure`` has the texts for both, private and public.
    """
    asks = structure or STRUCTURE
    past = history.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "role", F.col("text").alias("content")))).alias("h"))
    joined = queries.join(contexts, "query_id", "left").join(past, "conv_id", "left")
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    none = F.array().cast("array<struct<role:string,content:string>>")
    said = F.coalesce(F.transform("h", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))), none)
    own = F.coalesce("has_private", F.lit(False))
    asked = F.when(own & F.col("has_kb"), asks["both"]).when(own, asks["private"]).otherwise(asks["public"])
    system = message("system", F.concat(asked, F.lit("\nContext:\n"), F.coalesce("context", F.lit(""))))
    return joined.select("query_id", F.concat(F.array(system), said, F.array(message("user", F.col("text")))).alias("messages"))


def with_hypotheses(queries: DataFrame, hypotheses: DataFrame, limit: int = 600) -> DataFrame:
    """Hypothetical answers as queries of their own: trimmed, cut, blank ones left out."""
    text = F.left(strip(F.coalesce("hypothesis", F.lit(""))), F.lit(limit))
    return queries.select("query_id").join(hypotheses, "query_id").select("query_id", text.alias("text")).where("text <> ''")


def fuse_with_hypotheses(raw: DataFrame, hypothetical: DataFrame, k: int = 10) -> DataFrame:
    """The hits of queries and of their hypotheses in one ranking; without a hypothesis the raw one stays."""
    lists = [hits.select("query_id", F.lit(n).alias("list_no"), "rank", "key", "score") for n, hits in enumerate((raw, hypothetical))]
    return fuse(lists[0].unionByName(lists[1]), k)
