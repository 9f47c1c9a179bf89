"""Chunking queries (C)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import chunking as C
from lectern.plans.registry import query

#: Letters whose counts stand in for a model's vector in the test data: both engines count them exactly.
LETTERS = "eanistrould"
WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: The documents with every sixth line a heading and every third after those a subheading.
STRUCTURED = """sd as (select doc_id, source, array_to_string(list_transform(string_split(text, chr(10)),
    lambda x, i: case when (i - 1) % 6 = 0 then '# ' when (i - 1) % 6 = 3 then '## ' else '' end || x), chr(10)) text from documents)"""
PLAIN = "sd as (select doc_id, source, text from documents)"
SECTIONS = f"""pt as (select doc_id, source, generate_subscripts(p, 1) - 1 no, unnest(p) part
    from (select doc_id, source, string_split(regexp_replace(coalesce(text, ''), '(?m){C.HEADING}', chr(2) || '\\0' || chr(3), 'g'), chr(2)) p from sd)),
  sc as (select doc_id, source, no, case when contains(part, chr(3)) then trim(split_part(part, chr(3), 1), {WS}) end heading,
    trim(case when contains(part, chr(3)) then split_part(part, chr(3), 2) else part end, {WS}) body from pt),
  sn as (select doc_id, source, row_number() over (partition by doc_id, source order by no) - 1 no, heading, body as text,
    case when heading is null then null when regexp_matches(heading, '^#{{1,6}}\\s') then len(regexp_extract(heading, '^#+'))
      when regexp_matches(heading, '^\\d') then len(string_split(regexp_extract(heading, '^\\d+(?:\\.\\d+){{0,4}}'), '.')) else 1 end::int depth
    from sc where heading is not null or body <> '')"""
#: Of each section with a body: the headings that it lies below, as far as the next one of the same or a higher rank.
PATHS = """nx as (select a.doc_id, a.source, a.no, any_value(a.heading) heading, min(b.no) until from sn a left join sn b
    on b.doc_id = a.doc_id and b.source = a.source and b.no > a.no and b.depth <= a.depth where a.heading is not null group by 1, 2, 3),
  bl as (select doc_id, source, no, row_number() over (partition by doc_id, source order by no) - 1 block, text from sn where text <> ''),
  ph as (select bl.doc_id, bl.source, bl.block, coalesce(string_agg(nx.heading, ' / ' order by nx.no), '') path from bl left join nx
    on nx.doc_id = bl.doc_id and nx.source = bl.source and nx.no <= bl.no and (nx.until is null or nx.until > bl.no) group by 1, 2, 3)"""
# Twice, as two neighbouring abbreviations share the character between them.
GUARDED = f"trim(coalesce(text, ''), {WS})"
for _ in range(2):
    GUARDED = f"regexp_replace({GUARDED}, '(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(C.ABBREVIATIONS)})\\.\\s', '\\1\\2' || chr(1) || ' ', 'g')"
CUT = f"regexp_replace(regexp_replace({GUARDED}, '([.!?])\\s+([A-ZÀ-ÖØ-Þ0-9])', '\\1' || chr(2) || '\\2', 'g'), '\\n{{2,}}', chr(2), 'g')"
SENTENCES = f"list_filter(list_transform(string_split({CUT}, chr(2)), lambda s: trim(replace(s, chr(1), '.'), {WS})), lambda s: s <> '')"
VECTOR = "[" + ", ".join(f"(length(w) - length(replace(w, '{x}', '')))::double" for x in LETTERS) + "]"
#: Blocks with their sentences and ways; windows of those cut by meaning with their distances; the walk along them.
WALK = f"""st as (select *, {SENTENCES} s from bl), rt as (select *, sum(len(s)) over (partition by doc_id, source) total from st),
  wy as (select *, case when total > 1500 then 'size' when len(s) <= 2 or length(text) <= 1200 then 'whole' else 'meaning' end way from rt where len(s) > 0),
  sx as (select doc_id, source, block, generate_subscripts(s, 1) - 1 i, unnest(s) sentence from wy where way = 'meaning'),
  wn as (select *, concat_ws(' ', sentence, lead(sentence) over p) w from sx window p as (partition by doc_id, source, block order by i)),
  vc as (select doc_id, source, block, i, sentence, {VECTOR} v from wn),
  nv as (select *, lead(v) over (partition by doc_id, source, block order by i) n from vc),
  ds as (select doc_id, source, block, i, sentence, 1 - coalesce(list_dot_product(v, n) / nullif(sqrt(list_dot_product(v, v) * list_dot_product(n, n)), 0), 0) d from nv where n is not null),
  lm as (select doc_id, source, block, list_sort(list(d)) o, 0.9::double * (count(*) - 1) a from ds group by all),
  lt as (select doc_id, source, block, greatest(o[floor(a)::int + 1] + (o[ceil(a)::int + 1] - o[floor(a)::int + 1]) * (a - floor(a)), 0.12) lim from lm),
  fr as (select ds.*, length(sentence) n, d >= lim far from ds join lt using (doc_id, source, block)),
  wk as (select doc_id, source, block, i, n total, n >= 400 and (far or n >= 2400) cut from fr where i = 0
    union all select f.doc_id, f.source, f.block, f.i, case when k.cut then 0 else k.total end + f.n,
      case when k.cut then 0 else k.total end + f.n >= 400 and (far or case when k.cut then 0 else k.total end + f.n >= 2400)
      from wk k join fr f on f.doc_id = k.doc_id and f.source = k.source and f.block = k.block and f.i = k.i + 1),
  sg as (select sx.*, coalesce(sum(wk.cut::int) over (partition by sx.doc_id, sx.source, sx.block order by sx.i rows between unbounded preceding and 1 preceding), 0) seg
    from sx left join wk using (doc_id, source, block, i)),
  ch as (select *, sum(case when i = first_i and (seg = 0 or size > 1) then 1 else 0 end) over (partition by doc_id, source, block order by i) - 1 chunk
    from (select *, min(i) over g first_i, count(*) over g size from sg window g as (partition by doc_id, source, block, seg))),
  bd as (select doc_id, source, block, chunk, min(i) - any_value(case when chunk > 0 then 1 else 0 end) a, max(i) b from ch group by 1, 2, 3, 4),
  cx as (select bd.doc_id, bd.source, bd.block, bd.chunk piece, string_agg(sentence, ' ' order by i) text from bd join sx
    on sx.doc_id = bd.doc_id and sx.source = bd.source and sx.block = bd.block and i between a and b group by 1, 2, 3, 4)"""
CHUNKS = """al as (select doc_id, source, block, piece, text from cx union all select doc_id, source, block, 0, text from wy where way = 'whole'),
  nm as (select *, row_number() over (partition by doc_id, source order by block, piece) - 1 chunk from al)
  select doc_id, concat_ws('_', substr(md5(source), 1, 8), doc_id, chunk) chunk_id, chunk, path heading, 'v2' chunker_version, md5(text) digest from nm join ph using (doc_id, source, block)"""


def chunks_sql(documents: str) -> str:
    """The chunks of ``documents`` (CTE ``sd``) of 1500 sentences at most, told by joins and one recursion."""
    return f"with recursive {documents}, {SECTIONS}, {PATHS}, {WALK}, {CHUNKS}"


def structured(v) -> DataFrame:
    mark = lambda x, i: F.concat(F.when(i % 6 == 0, "# ").when(i % 6 == 3, "## ").otherwise(""), x)
    return v.documents.select("doc_id", "source", F.array_join(F.transform(F.split("text", "\n", -1), mark), "\n").alias("text"))


def letter_counts(df: DataFrame, column: str) -> DataFrame:
    """Stands in for a model: how often each of LETTERS is in the text."""
    counts = [(F.length(column) - F.length(F.replace(F.col(column), F.lit(x), F.lit("")))).cast("double") for x in LETTERS]
    return df.withColumn("embedding", F.array(*counts))


def with_distances(v) -> DataFrame:
    """Blocks cut by meaning, with their sentences and the distances between neighbouring windows."""
    blocks = C.routed_blocks(structured(v), "doc_id").where("way = 'meaning'")
    shown = blocks.select("doc_id", "block", "sentences", C.windows(F.col("sentences")).alias("windows"))
    vector = lambda w: F.array(*((F.length(w) - F.length(F.replace(w, F.lit(x), F.lit("")))).cast("double") for x in LETTERS))
    return shown.select("doc_id", "block", "sentences", C.distances(F.transform("windows", vector)).alias("apart"))


@query("c01_structure_blocks", f"with {STRUCTURED}, {SECTIONS} select doc_id, no::int block, heading, depth, md5(text) digest from sn")
def _(v):
    return C.structure_blocks(structured(v), "doc_id").select("doc_id", "block", "heading", "depth", F.md5("text").alias("digest"))


@query("c02_heading_paths", f"with {STRUCTURED}, {SECTIONS}, {PATHS} select doc_id, block::int block, path from ph")
def _(v):
    return C.heading_paths(structured(v), "doc_id").select("doc_id", "block", F.array_join("heading_path", " / ").alias("path"))


@query("c03_sentences", f"with st as (select doc_id, {SENTENCES} s from documents) select doc_id, len(s) n, md5(array_to_string(s, '|')) digest from st")
def _(v):
    s = C.sentences(F.col("text"))
    return v.documents.select("doc_id", s.alias("s")).select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|")).alias("digest"))


@query("c04_sentence_windows", f"""with st as (select doc_id, {SENTENCES} s from documents), r as (select doc_id, generate_subscripts(s, 1) - 1 pos, unnest(s) sentence from st)
  select doc_id, pos::int pos, md5(concat_ws(' ', sentence, lead(sentence) over (partition by doc_id order by pos))) digest from r""")
def _(v):
    s = v.documents.select("doc_id", C.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.posexplode(C.windows(F.col("s"))).alias("pos", "w")).select("doc_id", "pos", F.md5("w").alias("digest"))


@query("c05_neighbour_distances", f"with recursive {STRUCTURED}, {SECTIONS}, {PATHS}, {WALK} select doc_id, block::int block, i::int pos, round(d, 9) distance from ds")
def _(v):
    return with_distances(v).select("doc_id", "block", F.posexplode("apart").alias("pos", "d")).select("doc_id", "block", "pos", F.round("d", 9).alias("distance"))


@query("c06_breakpoints", f"with recursive {STRUCTURED}, {SECTIONS}, {PATHS}, {WALK} select doc_id, block::int block, (i + 1)::int begins from wk where cut")
def _(v):
    return with_distances(v).select("doc_id", "block", F.explode(C.breakpoints(F.col("sentences"), F.col("apart"))).alias("begins"))


@query("c07_assemble", f"with recursive {STRUCTURED}, {SECTIONS}, {PATHS}, {WALK} select doc_id, block::int block, piece::int piece, length(text) n, md5(text) digest from cx")
def _(v):
    broken = with_distances(v).withColumn("begins", C.breakpoints(F.col("sentences"), F.col("apart")))
    rows = broken.select("doc_id", "block", F.posexplode(C.assembled(F.col("sentences"), F.col("begins"))).alias("piece", "text"))
    return rows.select("doc_id", "block", "piece", F.length("text").cast("long").alias("n"), F.md5("text").alias("digest"))


@query("c08_size_split", """with recursive w as (select doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') w from documents),
  e as (select doc_id, generate_subscripts(w, 1) i, unnest(w) word from w), c as (select doc_id, i, word, sum(len(word) + 1) over (partition by doc_id order by i) run from e),
  cut as (select doc_id, 0 piece, 0::bigint base, min(i) filter (where run >= 2400) last from c group by doc_id
    union all select k.doc_id, piece + 1, max(c.run) filter (where c.i = k.last)::bigint, min(c.i) filter (where c.i > k.last and c.run >= (select run from c x where x.doc_id = k.doc_id and x.i = k.last) + 2400)
    from cut k join c using (doc_id) where k.last is not null group by k.doc_id, piece, k.last),
  n as (select doc_id, max(i) n from e group by 1)
  select doc_id, cast(count(*) as bigint) pieces from (select k.doc_id, k.piece, coalesce(lag(k.last) over (partition by k.doc_id order by piece), 0) before, n from cut k join n using (doc_id)) where before < n group by 1""")
def _(v):
    return v.documents.select("doc_id", F.size(C.size_split(F.col("text"))).cast("long").alias("pieces")).where("pieces > 0")


@query("c09_route", f"with recursive {STRUCTURED}, {SECTIONS}, {PATHS}, {WALK} select doc_id, block::int block, len(s) n_sentences, way from wy")
def _(v):
    return C.routed_blocks(structured(v), "doc_id").select("doc_id", "block", F.size("sentences").cast("long").alias("n_sentences"), "way")


@query("c10_plain_chunks")
def _(v):
    return v.documents.select("doc_id", F.posexplode(C.plain_chunks("text")).alias("chunk", "piece")).select("doc_id", "chunk", F.length("piece").alias("n"), F.md5("piece").alias("digest"))


@query("c11_stamp", "select doc_id, concat(substr(md5(source), 1, 8), '_', row_number() over (partition by source order by doc_id) - 1) chunk_id from documents")
def _(v):
    return C.stamp(v.documents.select("doc_id", "source"), "source", "doc_id").select("doc_id", "chunk_id")


def long_sql(size: int, overlap: int) -> str:
    """CTEs up to ``lp`` (doc_id, piece_no, piece): overlapping pieces of the documents, cut by cut."""
    low = size - C.CUT_WINDOW
    return f"""t as (select doc_id, trim(coalesce(text, ''), {WS}) text from documents), n as (select doc_id, text, length(text) n from t),
  raw as (select doc_id, 0 no, 0 as start, 0 as ends, 0 as follow from n where n > {size}
    union all select doc_id, no + 1, follow, e, case when e >= n then n else greatest(e - {overlap}, follow + 1) end from (
      select *, case when follow + {size} >= n then n when cut > 0 then follow + {low} + cut else follow + {size} end e from (
        select doc_id, no, follow, n, coalesce(
            case when contains(tail, chr(10) || chr(10)) then length(tail) - strpos(reverse(tail), chr(10) || chr(10)) - 1 end,
            case when contains(tail, chr(10)) then length(tail) - strpos(reverse(tail), chr(10)) end,
            case when contains(tail, ' ') then length(tail) - strpos(reverse(tail), ' ') end) cut
        from (select raw.*, n, substr(text, follow + {low} + 1, least({size}, n - follow) - {low}) tail from raw join n using (doc_id) where follow < n)))),
  pc as (select doc_id, no, trim(substr(text, start + 1, ends - start), {WS}) piece from raw join n using (doc_id) where no > 0 union all select doc_id, 1, text from n where n <= {size}),
  lp as (select doc_id, row_number() over (partition by doc_id order by no) - 1 piece_no, piece from pc where piece <> '' or no = 1)"""


@query("c12_long_splits", f"with recursive {long_sql(3000, 300)} select doc_id, piece_no, length(piece) n, md5(piece) digest from lp")
def _(v):
    pieces = C.long_splits(F.col("text"), size=3000, overlap=300)
    return v.documents.select("doc_id", F.posexplode(pieces).alias("piece_no", "p")).select("doc_id", F.col("piece_no").cast("long").alias("piece_no"), F.length("p").cast("long").alias("n"), F.md5("p").alias("digest"))


@query("c13_paged_text", f"""with t as (select source, trim(string_agg('[page ' || doc_id || ']' || chr(10) || coalesce(text, ''), chr(10) || chr(10) order by doc_id), {WS}) text from documents group by 1)
  select source, md5(case when length(text) > 180000 then left(text, 180000) || chr(10) || chr(10) || '[...document tronqué...]' else text end) digest from t""")
def _(v):
    return C.paged_text(v.documents.withColumnRenamed("doc_id", "page")).select("source", F.md5("text").alias("digest"))


@query("c14_inventory", "select collection, coalesce(source, 'unknown') source, count(*) n from chunks_v group by 1, 2")
def _(v):
    return C.inventory(v.chunks)


@query("c15_totals", "select collection, count(distinct source) documents, count(*) chunks from chunks_v group by 1")
def _(v):
    return C.totals(v.chunks)


@query("c16_chunk_documents", chunks_sql(STRUCTURED))
def _(v):
    return C.chunk_documents(structured(v), letter_counts).select("doc_id", "chunk_id", "chunk", "heading", "chunker_version", F.md5("text").alias("digest"))
