"""Retrieval queries (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.texts import SPACES
from lectern.operators import retrieval as R
from lectern.plans.registry import query

TOK = "list_filter(string_split_regex(lower(coalesce(text, '')), '[\\s]+'), lambda t: t <> '')"
STATS = f"""dt as materialized (select corpus_pos, {TOK} t from chunks_v), size as materialized (select count(*) n, avg(len(t)) avgdl from dt),
  post as (select corpus_pos, len(t) len, unnest(t) term from dt), tf as materialized (select term, corpus_pos, len, count(*) tf from post group by all),
  dfs as materialized (select term, count(*) df, ln(((select n from size) - count(*) + 0.5)::double / (count(*) + 0.5)) raw from tf group by term),
  mn as materialized (select avg(raw) mean from dfs), idf as materialized (select term, df, case when raw < 0 then 0.25 * mean else raw end idf from dfs, mn)"""
BM25 = f"""{STATS}, qt as (select query_id, unnest({TOK}) term from queries_v), qc as (select query_id, term, count(*) times from qt group by all),
  sc as (select query_id, corpus_pos, round(sum(times * idf * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * len / avgdl))), 9) score from tf join qc using (term) join idf using (term), size group by all),
  sparse as (select * from (select *, row_number() over (partition by query_id order by score desc, corpus_pos) - 1 as rank from sc) where rank < 20 and score > 0)"""
COS = "round(list_cosine_similarity(v.embedding::double[], q.embedding::double[]), 6)"
DENSE = f"""ds as (select q.query_id, v.chunk_pos, v.collection, {COS} score from vectors_v v, query_vectors_v q),
  dr as (select *, row_number() over (partition by query_id, collection order by score desc, chunk_pos) - 1 crank from ds),
  dense as (select query_id, chunk_pos, collection as scope, score, crank, row_number() over (partition by query_id order by score desc, chunk_pos) - 1 as rank from dr where crank < 20)"""


def fuse(lists: str, keys: str, k: int) -> str:
    return f"""fs as (select {keys}, key, round(sum(1 / (61.0::double + rank)), 6) rrf_score, min((list_no, rank)) seen, max(case when list_no = 0 then score end) dense_score from ({lists}) group by {keys}, key),
  fused as (select * exclude (seen) from (select *, row_number() over (partition by {keys} order by rrf_score desc, seen, key) - 1 as rank from fs) where rank < {k})"""


LISTS = "select query_id, 0 list_no, rank, chunk_pos as key, score from dense union all select query_id, 1, rank, corpus_pos, score from sparse"
SPLIT = "select query_id, scope, 0 list_no, crank rank, chunk_pos as key, score from dense union all select query_id, 'private', 1, rank, corpus_pos, score from sparse"
HYBRID = f"{BM25}, {DENSE}, {fuse(LISTS, 'query_id', 5)}"
WIDE = f"{BM25}, {DENSE}, {fuse(LISTS, 'query_id', 15)}"
HITS = f"{HYBRID}, hits as (select f.*, c.source, c.collection scope, cast(c.corpus_pos % 9 + 1 as varchar) page, case when c.collection = 'knowledge_base' then 'https://kb/' || c.corpus_pos end url, c.text from fused f join chunks_v c on c.corpus_pos = f.key)"


def hybrid(v, k=5):
    return R.hybrid(v.chunks, v.vectors, v.queries, v.query_vectors, k)


def hits(v, k=5):
    known = v.chunks.select(F.col("corpus_pos").alias("key"), "source", F.col("collection").alias("scope"), (F.col("corpus_pos") % 9 + 1).cast("string").alias("page"), F.when(F.col("collection") == "knowledge_base", F.concat(F.lit("https://kb/"), "corpus_pos")).alias("url"), "text")
    return hybrid(v, k).join(known, "key")


@query("d01_tokens", f"select chunk_id, len({TOK}) n, md5(array_to_string({TOK}, ' ')) digest from chunks_v")
def _(v):
    t = R.tokens(F.col("text"))
    return v.chunks.select("chunk_id", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, " ")).alias("digest"))


@query("d02_term_statistics", f"with {STATS} select term, df, round(idf, 6) idf from idf")
def _(v):
    return R.corpus_statistics(v.chunks).terms.withColumn("idf", F.round("idf", 6))


@query("d03_bm25", f"with {BM25} select query_id, corpus_pos, round(score, 6) score, rank from sparse")
def _(v):
    return R.bm25(v.chunks, v.queries).withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("long"))


@query("d04_dense", f"""with s as (select q.query_id, v.chunk_pos, {COS} score from vectors_v v, query_vectors_v q where collection = 'private')
  select * from (select *, row_number() over (partition by query_id order by score desc, chunk_pos) - 1 as rank from s) where rank < 20""")
def _(v):
    return R.dense(v.vectors.where("collection = 'private'"), v.query_vectors).withColumn("rank", F.col("rank").cast("long"))


@query("d05_dense_union", f"with {DENSE} select query_id, chunk_pos, scope, score, rank from dense")
def _(v):
    return R.dense_union(v.vectors, v.query_vectors).select("query_id", "chunk_pos", "scope", "score", F.col("rank").cast("long").alias("rank"))


@query("d06_scope_default", "select chunk_id, coalesce(case when corpus_pos % 2 = 0 then collection end, 'kb') scope from chunks_v")
def _(v):
    return v.chunks.select("chunk_id", F.coalesce(F.when(F.col("corpus_pos") % 2 == 0, F.col("collection")), F.lit("kb")).alias("scope"))


@query("d07_rrf", f"with {WIDE} select query_id, key, rrf_score, rank from fused")
def _(v):
    return hybrid(v, 15).select("query_id", "key", "rrf_score", F.col("rank").cast("long").alias("rank"))


@query("d07_fusion_key", """with h as (select corpus_pos, case when corpus_pos % 3 = 0 then '' when corpus_pos % 3 = 1 then chunk_id end id, text from chunks_v) select coalesce(nullif(id, ''), left(text, 80)) as key, count(*) n from h group by 1""")
def _(v):
    some = F.when(F.col("corpus_pos") % 3 == 0, "").when(F.col("corpus_pos") % 3 == 1, F.col("chunk_id"))
    return v.chunks.select(R.fusion_key(some, F.col("text")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


@query("d08_rrf_of_lists", f"""with {BM25}, h as (select query_id, 0 list_no, rank, corpus_pos as key, score from sparse union all select query_id, 1, 19 - rank, corpus_pos, score from sparse), {fuse('select * from h', 'query_id', 10)}
  select query_id, key, rrf_score, rank from fused""")
def _(v):
    raw = R.bm25(v.chunks, v.queries)
    lists = R.as_list(raw, "corpus_pos", 0).unionByName(R.as_list(raw.withColumn("rank", 19 - F.col("rank")), "corpus_pos", 1))
    return R.fuse(lists, 10).select("query_id", "key", "rrf_score", F.col("rank").cast("long").alias("rank"))


@query("d09_hybrid", f"with {HITS} select query_id, key, rrf_score, rank, source, page from hits")
def _(v):
    return hits(v).select("query_id", "key", "rrf_score", F.col("rank").cast("long").alias("rank"), "source", "page")


@query("d10_split_hybrid", f"with {BM25}, {DENSE}, {fuse(SPLIT, 'query_id, scope', 5)} select query_id, scope, key, rrf_score, rank from fused")
def _(v):
    return R.split_hybrid(v.chunks, v.vectors, v.queries, v.query_vectors).select("query_id", "scope", "key", "rrf_score", F.col("rank").cast("long").alias("rank"))


@query("d11_rerank", f"""with {WIDE}, p as (select *, case when key % 4 > 0 then (key * 7919) % 1000 end rerank_score from fused)
  select query_id, key, rerank_score, n as rank from (select *, row_number() over (partition by query_id order by rerank_score desc nulls last, key) - 1 n from p) where n < 5""")
def _(v):
    wide = hybrid(v, 15)
    pairs = wide.where("key % 4 > 0").select("query_id", "key", ((F.col("key") * 7919) % 1000).alias("rerank_score"))
    return R.rerank(wide, pairs).select("query_id", "key", "rerank_score", F.col("rank").cast("long").alias("rank"))


def near_lengths():
    """Stands in for a cross-encoder: how near the lengths of the two texts are."""
    return lambda rows: 1 / (1 + (rows["query"].str.len() - rows["text"].str.len()).abs())


@query("d11_model_rerank", f"""with {WIDE}, p as (select f.query_id, f.key, round(1 / (1 + abs(length(q.text) - length(c.text)))::double, 9) rerank_score from fused f left join queries_v q using (query_id) left join chunks_v c on c.corpus_pos = f.key)
  select query_id, key, rerank_score, n as rank from (select *, row_number() over (partition by query_id order by rerank_score desc nulls last, key) - 1 n from p) where n < 5""")
def _(v):
    found = R.rerank_with(hybrid(v, 15), v.queries, v.chunks.select(F.col("corpus_pos").alias("key"), "text"), "lengths", near_lengths)
    return found.select("query_id", "key", F.round("rerank_score", 9).alias("rerank_score"), F.col("rank").cast("long").alias("rank"))


@query("d12_source_boost", f"""with {HITS}, b as (select *, case source when 'src1' then 1.3 when 'src5' then 1.5 end::double factor from hits), s as (select query_id, key, rank old, round(rrf_score * coalesce(factor, 1), 6) rrf_score, factor is not null boosted from b)
  select query_id, key, rrf_score, boosted, row_number() over (partition by query_id order by rrf_score desc, old) - 1 as rank from s""")
def _(v):
    boosts = v.chunks.select(F.initcap("source").alias("source")).distinct().select("source", F.when(F.lower("source") == "src1", 1.3).when(F.lower("source") == "src5", 1.5).otherwise(1.0).alias("factor"))
    return R.boosted(hits(v), boosts).select("query_id", "key", "rrf_score", "boosted", F.col("rank").cast("long").alias("rank"))


@query("d13_dense_fallback", f"""with {BM25}, {DENSE}, {fuse(LISTS.replace("from sparse", "from sparse where query_id % 2 = 0"), 'query_id', 15)} select query_id, key, rrf_score, dense_score, rank from fused""")
def _(v):
    """Every other query has no words: its list is the dense one, scored by its ranks."""
    asked = v.queries.withColumn("text", F.when(F.col("query_id") % 2 == 0, F.col("text")))
    return R.hybrid(v.chunks, v.vectors, asked, v.query_vectors, 15).select("query_id", "key", "rrf_score", "dense_score", F.col("rank").cast("long").alias("rank"))


@query("d14_retrieval_confidence", f"with {HYBRID} select q.query_id, coalesce(round(greatest(least(avg(f.rrf_score) / (2 / 62.0::double), 1), 0), 6), 0) confidence from queries_v q left join fused f on f.query_id = q.query_id and f.rank < 3 group by 1")
def _(v):
    return R.retrieval_confidence(hybrid(v), v.queries)


BLOCK = "case when scope = 'knowledge_base' then '[KB — ' || source || ' p.' || page || ']' || coalesce(' (' || url || ')', '') else '[' || source || ' p.' || page || ']' end || chr(10) || text"
JOINED = f"string_agg({BLOCK}, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank)"


@query("d15_context", f"with {HITS} select query_id, md5({JOINED}) digest from hits group by 1")
def _(v):
    return R.context_block(hits(v), "query_id").select("query_id", F.md5("context").alias("digest"))


@query("d16_two_block_context", f"""with {HITS}, b as (select query_id, scope, {JOINED} context from hits group by 1, 2)
  select query_id, md5(string_agg(case scope when 'private' then '### PRIVATE' else '### PUBLIC' end || chr(10) || context, chr(10) || chr(10) order by scope desc)) digest from b group by 1""")
def _(v):
    return R.two_block_context(hits(v)).select("query_id", F.md5("context").alias("digest"))


CITED = "c as (select query_id, rank, scope, case when key % 3 = 0 then 'inconnu' else source end source, case when key % 5 = 0 then '?' else page end page, url from hits)"


def cited(v):
    holes = {"source": F.when(F.col("key") % 3 != 0, F.col("source")), "page": F.when(F.col("key") % 5 != 0, F.col("page"))}
    return R.citations(hits(v, 5).withColumns(holes)).withColumn("rank", F.col("rank").cast("long"))


@query("d17_citations", f"with {HITS}, {CITED} select * from c")
def _(v):
    return cited(v)


@query("d18_distinct_citations", f"with {HITS}, {CITED} select query_id, scope, source, url, min(rank) place from c group by all")
def _(v):
    return R.distinct_citations(cited(v)).select("query_id", "scope", "source", "url", "place")


@query("d19_tenant_collection", "select id, left('rag_' || lower(regexp_replace(name, '[^a-zA-Z0-9]', '_', 'g')), 40) collection from clients_v")
def _(v):
    return v.clients.select("id", R.tenant_collection(F.col("name")).alias("collection"))


@query("d19_visible_chunks", """select id as user, count(*) filter (where mine) own, count(*) filter (where not mine) shared from (
    select u.id, c.collection = u.collection mine from (select distinct id, case when id % 2 = 0 then 'private' else 'rag_' || id end collection from clients_v where id % 20 = 0) u
    join chunks_v c on c.collection in (u.collection, 'knowledge_base')) group by 1""")
def _(v):
    own = F.when(F.col("id") % 2 == 0, "private").otherwise(F.concat(F.lit("rag_"), "id"))
    users = v.clients.where("id % 20 = 0").select(F.col("id").alias("user"), own.alias("collection"))
    return R.visible_counts(users, v.chunks)


@query("d20_collection_isolation", """with c as (select corpus_pos, case when corpus_pos % 7 = 0 then 'referential' else collection end collection from chunks_v)
  select purpose, collection, count(*) n, min(corpus_pos) first_pos from c join (values ('chat', 'private'), ('chat', 'knowledge_base'), ('analysis', 'referential')) r(purpose, collection) using (collection) group by 1, 2""")
def _(v):
    chunks = v.chunks.withColumn("collection", F.when(F.col("corpus_pos") % 7 == 0, "referential").otherwise(F.col("collection")))
    both = [R.routed(chunks, purpose).withColumn("purpose", F.lit(purpose)) for purpose in ("chat", "analysis")]
    return both[0].unionByName(both[1]).groupBy("purpose", "collection").agg(F.count("*").alias("n"), F.min("corpus_pos").alias("first_pos"))


@query("d21_no_hit_message", f"with {DENSE} select q.query_id, count(d.query_id) n_hits, case when count(d.query_id) = 0 then 'nothing relevant' end as message from queries_v q left join dense d using (query_id) group by 1")
def _(v):
    return R.answered(v.queries, R.dense_union(v.vectors, v.query_vectors), "nothing relevant")


HISTORY = """hist as (select conv_id, turn, role, case when length(text) > 200 then rtrim(left(text, 200)) || '…' else text end text, row_number() over (partition by conv_id order by turn) place
  from (select *, row_number() over (partition by conv_id order by turn desc) rn from messages_v where role in ('user', 'assistant') and trim(text) <> '') where rn <= 2)"""


@query("d22_history", f"with {HISTORY} select * from hist")
def _(v):
    return R.history_window(v.messages, 2, 200, SPACES).withColumn("place", F.col("place").cast("long"))


@query("d23_prompt_messages", f"""with {HITS}, {HISTORY}, sb as (select query_id, scope, {JOINED} context from hits group by 1, 2),
  b as (select query_id, string_agg(case scope when 'private' then '### PRIVATE' else '### PUBLIC' end || chr(10) || context, chr(10) || chr(10) order by scope desc) context, bool_or(scope = 'private') own, bool_or(scope = 'knowledge_base') kb from sb group by 1),
  h as (select conv_id, string_agg(role || '=' || text, '|' order by place) past from hist group by 1)
  select q.query_id, md5(concat_ws('|', 'system=' || case when own and kb then '{R.STRUCTURE["both"].replace("'", "''")}' when own then '{R.STRUCTURE["private"]}' else '{R.STRUCTURE["public"]}' end || chr(10) || 'Context:' || chr(10) || coalesce(context, ''), past, 'user=' || text)) digest
  from queries_v q left join b using (query_id) left join h on h.conv_id = q.query_id""")
def _(v):
    asked = v.queries.withColumn("conv_id", F.col("query_id"))
    messages = R.prompt_messages(R.two_block_context(hits(v)), asked, R.history_window(v.messages, 2, 200, SPACES))
    return messages.select("query_id", F.md5(F.array_join(F.transform("messages", lambda m: F.concat_ws("=", m["role"], m["content"])), "|")).alias("digest"))


# Hypotheses of two of three queries, each with the vector of the query twenty places on.
HYDE = f"""hq as (select query_id, left(trim(left(text, 60)), 600) text from queries_v where query_id % 3 > 0), ht as (select query_id, unnest({TOK}) term from hq), hc as (select query_id, term, count(*) times from ht group by all),
  hs as (select query_id, corpus_pos, round(sum(times * idf * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * len / avgdl))), 9) score from tf join hc using (term) join idf using (term), size group by all),
  hsp as (select * from (select *, row_number() over (partition by query_id order by score desc, corpus_pos) - 1 as rank from hs) where rank < 20 and score > 0),
  hd as (select query_id - 20 query_id, chunk_pos, score, rank from dense where query_id >= 20),
  hf as (select query_id, key, round(sum(1 / (61.0::double + rank)), 6) rrf_score, min((list_no, rank)) seen, max(case when list_no = 0 then score end) dense_score from (select query_id, 0 list_no, rank, chunk_pos as key, score from hd union all select query_id, 1, rank, corpus_pos, score from hsp) group by query_id, key),
  hyde as (select * from (select *, row_number() over (partition by query_id order by rrf_score desc, seen, key) - 1 as rank from hf) where rank < 10),
  raw as (select * from fused)"""
BOTH = "select query_id, 0 list_no, rank, key, rrf_score score from raw union all select query_id, 1, rank, key, rrf_score from hyde"


@query("e13_hypotheses", f"""with {BM25}, {DENSE}, {fuse(LISTS, 'query_id', 10)}, {HYDE}, {fuse(BOTH, 'query_id', 10).replace('fs as', 'gs as').replace('from fs', 'from gs').replace('fused as', 'last as')}
  select query_id, key, rrf_score, rank from last""")
def _(v):
    hypotheses = v.queries.select("query_id", F.when(F.col("query_id") % 3 > 0, F.left("text", F.lit(60))).alias("hypothesis"))
    moved = v.query_vectors.where("query_id >= 20").withColumn("query_id", F.col("query_id") - 20)
    raw = hybrid(v, 10)
    more = R.hybrid(v.chunks, v.vectors, R.with_hypotheses(v.queries, hypotheses), moved, 10)
    return R.fuse_with_hypotheses(*(h.withColumn("score", F.col("rrf_score")) for h in (raw, more))).select("query_id", "key", "rrf_score", F.col("rank").cast("long").alias("rank"))
