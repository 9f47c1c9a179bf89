"""Page and table queries (A, B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.scores import coverage
from lectern.functions.storage import new_path
from lectern.operators import workspace as W
from lectern.operators.chunking import chunk_documents
from lectern.plans.chunking import chunks_sql, letter_counts
from lectern.plans.registry import query
from lectern.plans.workspace import EXPORT, exported, listed_requirements
from lectern.sources import pages as P
from lectern.sources import tables as S
from lectern.sources.store import Store

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SQL_CLEAN = r"""cl as (select page_id, url, html, regexp_replace(coalesce(nullif(regexp_extract(html, '(?is)<article\b[^>]*>(.*)</article>', 1), ''), nullif(regexp_extract(html, '(?is)<main\b[^>]*>(.*)</main>', 1), ''), nullif(regexp_extract(html, '(?is)<body\b[^>]*>(.*)</body>', 1), ''), html),
    '(?is)<!--.*?-->|<nav\b[^>]*>.*?</nav>|<header\b[^>]*>.*?</header>|<footer\b[^>]*>.*?</footer>|<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<noscript\b[^>]*>.*?</noscript>|<form\b[^>]*>.*?</form>|<aside\b[^>]*>.*?</aside>|<div class="ad">.*?</div>', '', 'g') bare from pages),
  sp as (select page_id, url, html, string_split(regexp_replace(bare, '(?i)<(h[1-4]|p|li|td|th)\b[^>]*>', chr(1) || '\1' || chr(2), 'g'), chr(1))[2:] b from cl),
  nt as (select page_id, url, html, list_transform(b, lambda x: {'tag': lower(left(x, 1)), 'text': trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(x, '^[^' || chr(2) || ']*' || chr(2), ''), '(?s)<[^>]*>', ' ', 'g'),
    '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))}) t from sp),
  tx as (select page_id, url, html, array_to_string(list_transform(list_filter(t, lambda x: length(x.text) >= 3), lambda x: case when x.tag = 'h' then chr(10) || x.text || chr(10) else x.text end), chr(10)) text from nt)"""
#: Paragraphs packed one after another by a recursion; pieces of each page.
SQL_PACKED = SQL_CLEAN + r""", pp as (select page_id, url, text, list_filter(list_transform(string_split_regex(text, '
\s*
'), lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda p: p <> '') p from tx),
  pe as (select page_id, generate_subscripts(p, 1) i, unnest(p) p from pp),
  wk as (select page_id, i, length(p) n, 0 piece from pe where i = 1
    union all select e.page_id, e.i, case when w.n + length(e.p) + 2 <= 1800 then w.n + length(e.p) + 2 else length(e.p) end, w.piece + case when w.n + length(e.p) + 2 <= 1800 then 0 else 1 end
      from wk w join pe e on e.page_id = w.page_id and e.i = w.i + 1),
  pk as (select page_id, piece, string_agg(p, chr(10) || chr(10) order by i) chunk from wk join pe using (page_id, i) group by 1, 2
    union all select page_id, 0, left(text, 1800) from pp where len(p) = 0 and text <> ''),
  ps as (select page_id::varchar source_id, left(%s, 1) source, piece pos, chunk, 'section-' || (piece + 1) || '/' || count(*) over (partition by page_id) page from pk join pages using (page_id))"""
SLUG = "regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)/?$', 1)"


SQL_PACKED %= SLUG


#: What the pages hold besides their text.
ADS = (("div", "ad"),)


def cleaned(v):
    return v.pages.select("page_id", "url", "html", P.clean_text(P.main_part(F.col("html")), ADS).alias("text"))


def sections(v):
    rows = cleaned(v).select(P.slug(F.col("url")).substr(1, 1).alias("source"), F.col("page_id").cast("string").alias("source_id"), "text")
    return P.packed_sections(rows)


@query("b01_clean_text", f"with {SQL_CLEAN} select page_id, length(text) n, md5(text) digest from tx")
def _(v):
    return cleaned(v).select("page_id", F.length("text").cast("long").alias("n"), F.md5("text").alias("digest"))


@query("b02_main_part", r"select page_id, md5(coalesce(nullif(regexp_extract(html, '(?is)<article\b[^>]*>(.*)</article>', 1), ''), html)) digest from pages")
def _(v):
    return v.pages.select("page_id", F.md5(P.main_part(F.col("html"))).alias("digest"))


@query("b03_title", rf"select page_id, coalesce(nullif(trim(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1>', 1), '(?s)<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')), ''), {SLUG}) title from pages")
def _(v):
    return v.pages.select("page_id", P.title(F.col("html"), P.slug(F.col("url"))).alias("title"))


@query("b04_numeric_date", "select event_id, try_strptime(printf('%02d/%02d/2024', event_id % 35, event_id % 14), '%d/%m/%Y')::date as day from events")
def _(v):
    text = F.format_string("Page. Mis à jour le %02d/%02d/2024.", F.col("event_id") % 35, F.col("event_id") % 14)
    return v.events.select("event_id", P.numeric_date(text).alias("day"))


@query("b05_french_date", "select event_id, case when event_id % 6 < 5 then try_strptime(printf('2023-%02d-%02d', [1, 2, 8, 12, 12][event_id % 6 + 1], event_id % 33), '%Y-%m-%d')::date end as day from events")
def _(v):
    names = F.array(*map(F.lit, ("janvier", "Février", "août", "décembre", "decembre", "brumaire")))
    text = F.concat(F.lit("Mis à jour le "), (F.col("event_id") % 33).cast("string"), F.lit(" "), F.element_at(names, (F.col("event_id") % 6 + 1).cast("int")), F.lit(" 2023"))
    return v.events.select("event_id", P.french_date(text).alias("day"))


@query("b06_error_pages", "select page_id from pages where page_id % 7 <> 0 and length(html) >= 200 and contains(html, '<h1>')")
def _(v):
    url = F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("https://x/App/Error/"), "page_id")).otherwise(F.col("url"))
    return v.pages.where(~P.is_error_page(url, F.col("html"), "<h1>")).select("page_id")


@query("b07_scope", "select page_id from pages where page_id::varchar in ('1', '5', '8') or contains(lower(url), '/en/')")
def _(v):
    return v.pages.where(P.in_scope(F.col("page_id").cast("string"), F.col("url"), ["1", "5", "8"], ["/en/"])).select("page_id")


@query("b08_legal_references", "select page_id, url || '|' || url refs from pages")
def _(v):
    refs = P.legal_references(F.concat_ws(" , ", F.lit("art. 3"), "url", F.lit(""), "url"))
    return v.pages.select("page_id", F.array_join(refs, "|").alias("refs"))


#: Records over the benchmark, with attributes and parts that some of them lack.
XML = """concat('<?xml version="1.0" encoding="UTF-8"?><Publication', case when item_id % 3 > 0 then concat(' ID="F', cast(item_id as varchar(20)), '" spUrl="https://x/', cast(item_id as varchar(20)), '"') else '' end,
  case when item_id % 4 > 0 then ' dateDerniereModificationImportante="2024-03-05T10:00:00"' else '' end, '>', case when item_id % 2 = 0 then concat('<dc:title> Title ', cast(item_id as varchar(20)), ' </dc:title>') else '' end,
  '<dc:subject>Travail</dc:subject>', case when item_id % 5 > 0 then '<dc:description>About it</dc:description>' else '' end, '<dc:source>art. 3, https://law/1 ,https://law/2</dc:source>',
  '<Introduction><Texte>ab</Texte><Titre>Head <b>of</b> it</Titre></Introduction><Liste type="puce"><Item><Paragraphe> first &amp; foremost </Paragraphe></Item><Item><Paragraphe>', cast(item_id as varchar(20)), '</Paragraphe></Item></Liste></Publication>')"""
RECORDS = """rb as (select item_id, case when item_id % 5 > 0 then 'About it' || chr(10) || chr(10) else '' end || 'Head of it' || chr(10) || chr(10) || 'first & foremost ' || item_id || chr(10) || chr(10) || 'first & foremost'
  || case when length(item_id::varchar) > 3 then chr(10) || chr(10) || item_id else '' end body from benchmark)"""


@query("b09_record_body", f"with {RECORDS} select item_id, body from rb")
def _(v):
    return P.record_body(v.benchmark.select("item_id", F.expr(XML).alias("xml"))).select("item_id", "body")


@query("a04_record_scan", f"""with {RECORDS}, s as (select item_id, case when item_id % 3 > 0 then 'F' || item_id else case when item_id % 2 = 0 then 'F' else 'N' end || 'file' || item_id end source_id, body from rb where item_id % 7 > 0)
  select source_id, case when item_id % 3 > 0 then 'https://x/' || item_id else 'https://base/' || source_id end url, case when item_id % 4 > 0 then '2024-03-05' end updated, case when item_id % 2 = 0 then 'Title ' || item_id else source_id end title,
  'Travail' subject, 'https://law/1|https://law/2' refs, md5(body) digest from s""")
def _(v):
    """Files written by their names, read back by those names: others than F and N stay out."""
    path = new_path(v.spark, "records")
    kind = F.when(F.col("item_id") % 7 == 0, "X").when(F.col("item_id") % 2 == 0, "F").otherwise("N")
    rows = v.benchmark.select("item_id", kind.alias("kind"), F.expr(XML).alias("xml"))
    rows.write.partitionBy("kind", "item_id").text(path)
    # A folder stands for a file here, as Spark names its files itself.
    name = F.concat(F.regexp_extract("path", "kind=(\\w)", 1), F.lit("file"), F.regexp_extract("path", "item_id=(\\d+)", 1), F.lit(".xml"))
    files = v.spark.read.text(f"{path}/*/*", wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("xml")).select(name.alias("name"), "xml")
    found = P.parse_records(S.of_records(files), "https://base/")
    return found.select("source_id", "url", "updated", "title", "subject", F.array_join("references", "|").alias("refs"), F.md5("text").alias("digest"))


@query("a07_record_errors", "select 'F' || item_id || '.xml' as name from benchmark where item_id % 3 = 1")
def _(v):
    """Every third record is cut off before its end; the others aren't disturbed."""
    whole = F.expr(XML)
    files = v.benchmark.select(F.format_string("F%d.xml", "item_id").alias("name"), F.when(F.col("item_id") % 3 == 1, F.expr(f"left({XML}, length({XML}) - 20)")).otherwise(whole).alias("xml"))
    return P.record_errors(files).where("message like 'parse/chunk failed: %'").select("name")


@query("b10_pack_paragraphs", f"with recursive {SQL_PACKED} select source, source_id, pos::int pos, length(chunk) n, md5(chunk) digest from ps")
def _(v):
    return sections(v).select("source", "source_id", "pos", F.length("chunk").cast("long").alias("n"), F.md5("chunk").alias("digest"))


@query("b11_section_labels", f"with recursive {SQL_PACKED} select source_id, pos::int pos, page from ps")
def _(v):
    return sections(v).select("source_id", "pos", "page")


@query("b12_metadata", f"""select page_id, 'boards' source, {SLUG} source_id, url url_canonique, case when page_id % 2 = 0 then 'paie' else 'rh|dsn' end domaine, 'fr' as language, 'kb' as scope, case when page_id % 3 = 0 then '?' else 'section-1/1' end page,
  case when page_id % 4 = 0 then '2024-01-02' end date_maj, version from (select *, null::varchar as version from pages)""")
def _(v):
    rows = v.pages.select(
        "page_id", "url", P.slug(F.col("url")).alias("source_id"), F.lit("t").alias("title"), F.when(F.col("page_id") % 4 == 0, F.lit("2024-01-02").cast("date")).alias("updated"),
        F.when(F.col("page_id") % 2 == 0, "paie").alias("domaine"), F.when(F.col("page_id") % 3 != 0, "section-1/1").alias("page"),
    )
    found = P.with_metadata(rows, "boards", ["rh", "dsn"]).select("page_id", "metadata.*")
    return found.withColumn("domaine", F.array_join("domaine", "|")).drop("title")


@query("b13_length_guard", f"select doc_id, length(left(trim(text, {WS}), 12000)) n, length(trim(text, {WS})) > 12000 cut, md5(left(trim(text, {WS}), 12000)) digest from documents where length(trim(text, {WS})) >= 50")
def _(v):
    return P.length_guard(v.documents.withColumnRenamed("text", "chunk")).select("doc_id", F.length("chunk").cast("long").alias("n"), "cut", F.md5("chunk").alias("digest"))


@query("b13_guard_counts", f"select source, count_if(n >= 300) upserted, count_if(n < 300) dropped, count_if(n > 2000) truncated from (select source, length(trim(coalesce(text, ''), {WS})) n from documents) group by 1")
def _(v):
    return P.guard_counts(v.documents.withColumnRenamed("text", "chunk"), 300, 2000)


@query("b14_stable_ids", f"""with recursive {SQL_PACKED}, g as (select *, row_number() over (partition by source, source_id order by pos) - 1 place from ps where length(trim(chunk, {WS})) >= 50)
  select source_id, page, place, left(sha256(concat_ws('::', source, source_id, page, place)), 32) chunk_id from g""")
def _(v):
    return P.stable_ids(P.length_guard(sections(v))).select("source_id", "page", F.col("place").cast("long").alias("place"), "chunk_id")


@query("b15_run_report", f"""select source, count(distinct doc_id) fetched, count_if(length(trim(text, {WS})) >= 50) chunks, count_if(doc_id % 50 = 0) errors from documents group by 1""")
def _(v):
    return P.run_report(run_rows(v), P.length_guard(run_rows(v)))


def run_rows(v):
    return v.documents.select("source", F.col("doc_id").alias("source_id"), F.col("text").alias("chunk"), F.when(F.col("doc_id") % 50 == 0, F.concat(F.lit("no title in "), "lang")).alias("error"))


@query("b15_run_errors", "select source, doc_id source_id, 'parse/chunk failed: no title in ' || lang message from documents where doc_id % 50 = 0 and lang is not null")
def _(v):
    return P.run_errors(run_rows(v))


BOARDS = P.Source("boards", ("rh", "dsn"), marker="<h1>", words=("/en/", "/fr/"), dropped=ADS)


@query("b17_run_source", f"""with recursive {SQL_PACKED.replace("from tx)", "from tx where length(html) >= 200 and contains(html, '<h1>') and not contains(lower(url), '/app/error/') and (contains(lower(url), '/en/') or contains(lower(url), '/fr/')))", 1)},
  g as (select source_id, pos, chunk, page, {SLUG} slug, row_number() over (partition by {SLUG} order by pos, chunk) - 1 place from ps join pages on page_id::varchar = source_id where length(trim(chunk, {WS})) >= 50)
  select slug source_id, page, place, left(sha256(concat_ws('::', 'boards', slug, page, place)), 32) chunk_id, md5(left(trim(chunk, {WS}), 12000)) digest from g""")
def _(v):
    return P.run_source(v.pages, BOARDS).select("source_id", "page", F.col("place").cast("long").alias("place"), "chunk_id", F.md5("chunk").alias("digest"))


@query("b16_length_statistics", "select source, min(length(text)) shortest, max(length(text)) longest, round(avg(length(text)), 6) mean from documents group by 1")
def _(v):
    return P.length_statistics(v.documents.withColumnRenamed("text", "chunk"))


@query("a02_sheet_text", "select n_regionkey, md5('## Feuille : ' || n_regionkey || chr(10) || string_agg(n_nationkey || ' | ' || n_name, chr(10) order by n_nationkey)) digest from nation group by 1")
def _(v):
    rows = v.nation.withColumn("empty", F.lit(" "))
    return S.sheet_text(rows, ["n_nationkey", "empty", "n_name"], "n_regionkey", "n_nationkey").select("n_regionkey", F.md5("text").alias("digest"))


@query("a05_collection_scan", "select chunk_id, source from chunks_v where collection = 'private'")
def _(v):
    return v.chunks.where("collection = 'private'").select("chunk_id", "source")


@query("a06_report_parse", "select analysis_id, id, status from requirements_v where analysis_id % 10 <> 0")
def _(v):
    json = F.to_json(F.struct(F.array(F.struct("id", "title", "status", "confidence")).alias("requirements")))
    text = F.when(F.col("analysis_id") % 10 != 0, json).otherwise("{broken")
    return v.requirements.select("analysis_id", F.explode(S.parse_report(text)).alias("r")).select("analysis_id", "r.id", "r.status")


@query("a07_supported", "select doc_id from documents where doc_id % 4 <> 3")
def _(v):
    endings = F.array(*map(F.lit, (".pdf", ".MD", ".v1.txt", ".exe")))
    return v.documents.where(S.supported(F.concat("source", F.element_at(endings, (F.col("doc_id") % 4 + 1).cast("int"))))).select("doc_id")


def stored(v, rows, unit=("collection", "source")) -> Store:
    """A new store with ``rows``, written in two lots."""
    store = Store(v.spark, new_path(v.spark, "store"), rows.schema, unit, slots=8)
    for half in (0, 1):
        store.upsert(rows.where(F.pmod(F.xxhash64("chunk_id"), F.lit(2)) == half))
    return store


@query("a07_rejected", "select source || case doc_id % 4 when 3 then '.EXE' else '' end source, case doc_id % 4 when 3 then 'unsupported file ending: .exe' else 'no file ending' end message from documents where doc_id % 4 in (2, 3) and source is not null union all select null, 'no file name' from documents where source is null")
def _(v):
    endings = F.array(*map(F.lit, (".pdf", ".MD", "", ".EXE")))
    return S.rejected(v.documents.select(F.concat("source", F.element_at(endings, (F.col("doc_id") % 4 + 1).cast("int"))).alias("source")))


@query("a08_upsert", "select chunk_id, collection, case when corpus_pos % 3 = 0 then 'new' else source end source from chunks_v where corpus_pos % 5 <> 0 or corpus_pos % 3 = 0")
def _(v):
    """Chunks move to another source; the second run changes nothing."""
    store = stored(v, v.chunks.where("corpus_pos % 5 <> 0").select("chunk_id", "collection", "source"))
    new = v.chunks.where("corpus_pos % 3 = 0").select("chunk_id", "collection", F.lit("new").alias("source"))
    for _ in range(2):
        store.upsert(new.unionByName(new))
    return store.read()


@query("a09_delete_source", "select chunk_id, collection from chunks_v where source is null or source <> 'src1'")
def _(v):
    store = stored(v, v.chunks.select("chunk_id", "collection", "source"))
    store.remove(F.col("source") == "src1")
    return store.read().select("chunk_id", "collection")


@query("a09_deleted_counts", "select collection, source, count(*) deleted from chunks_v where source in ('src1', 'src3') group by all")
def _(v):
    return stored(v, v.chunks.select("chunk_id", "collection", "source")).remove(F.col("source").isin("src1", "src3"))


@query("a10_purge_report", "select collection, count_if(source = 'src1' and collection = 'knowledge_base') deleted from chunks_v group by 1")
def _(v):
    store = stored(v, v.chunks.select("chunk_id", "collection", "source"))
    removed = store.remove((F.col("source") == "src1") & (F.col("collection") == "knowledge_base"))
    return S.deletion_report(removed, store.read())


@query("a11_refresh", f"""{chunks_sql("sd as (select doc_id, source, case when source = 'src2' then text else 'Short. Old. ' || doc_id end text from documents)")}""")
def _(v):
    """All documents are stored in an old version; one source is cut again, once and once more, by the chunker."""
    columns = ["doc_id", "source", "chunk_id", "chunk", "heading", "chunker_version", "text"]
    old = v.documents.select("doc_id", "source", F.concat(F.lit("Short. Old. "), "doc_id").alias("text"))
    rows = chunk_documents(old, letter_counts).select(*columns)
    store = Store(v.spark, new_path(v.spark, "store"), rows.schema, ("source",), slots=8)
    store.replace(rows, rows)
    for _ in range(2):
        source = v.documents.where("source = 'src2'")
        store.replace(source, chunk_documents(source, letter_counts).select(*columns))
    return store.read().select(*(c for c in columns if c not in ("source", "text")), F.md5("text").alias("digest"))


@query("a12_reset_collection", "select chunk_id, source from chunks_v where collection <> 'private' union all select 'fresh', 'src1'")
def _(v):
    """A collection is emptied, what no reader needs is deleted, and a row comes in."""
    store = stored(v, v.chunks.select("chunk_id", "collection", "source"))
    store.remove(F.col("collection") == "private")
    store.vacuum()
    store.upsert(v.spark.createDataFrame([("fresh", "private", "src1")], store.schema))
    return store.read().select("chunk_id", "source")


COLUMNS = ", ".join(f"""case when regexp_matches("{c}", '[;"\\r\\n]') then '"' || replace("{c}", '"', '""') || '"' else "{c}" end""" for c in W.EXPORT)


@query("a14_feedback_csv", f"with {EXPORT} select concat_ws(';', {COLUMNS}) line from ex union all select '{';'.join(W.EXPORT)}'")
def _(v):
    """The sink's lines, read back; the reader takes the byte order mark away."""
    path = new_path(v.spark, "feedback")
    S.write_feedback_csv(exported(v), path, "gzip")
    return v.spark.read.option("lineSep", "\r\n").text(f"{path}/*").select(F.col("value").alias("line"))


def reported(v):
    """Requirements with their lists: criteria, evidence and sources."""
    criteria = F.when(F.col("page") % 3 == 0, F.array(F.lit("one"), F.lit("two"))).otherwise(F.array().cast("array<string>"))
    place = F.when(F.col("page") % 2 == 0, F.concat(F.lit("p. "), "page"))
    return listed_requirements(v).withColumns({"source_location": place, "acceptance_criteria": criteria, "filename": F.concat(F.lit("spec-"), "analysis_id", F.lit(".docx")), "evidence": F.transform("evidence", lambda q: F.trim(q))})


NL = "chr(10)"
LISTS = """ev as (select analysis_id, requirement_id, list(trim(quote) order by pos) quotes from evidence_v group by 1, 2),
  sr as (select analysis_id, requirement_id, list({'source': coalesce(source, '?'), 'page': page, 'score': score} order by pos) cited from sources_v group by 1, 2),
  rp as (select r.*, case when r.page % 2 = 0 then 'p. ' || r.page end place, case when r.page % 3 = 0 then ['one', 'two'] else [] end criteria, coalesce(quotes, []) quotes, cited
    from requirements_v r left join ev on ev.analysis_id = r.analysis_id and ev.requirement_id = r.id left join sr on sr.analysis_id = r.analysis_id and sr.requirement_id = r.id)"""
LINES = f"""'### ' || id || ' — ' || coalesce(title, '') || {NL} || coalesce('**Catégorie** : ' || category || '  ' || {NL}, '') || '**Priorité** : ' || priority || '  ' || {NL} || coalesce('**Localisation source** : ' || place || '  ' || {NL}, '') || {NL}
  || coalesce(description || {NL} || {NL}, '') || coalesce('> **Verdict** — ' || verdict || {NL} || {NL}, '')
  || case when len(criteria) > 0 then '**Critères d''acceptation** :' || {NL} || array_to_string(list_transform(criteria, lambda x: '- ' || x), {NL}) || {NL} || {NL} else '' end
  || case when len(quotes) > 0 then '**Preuves** :' || {NL} || array_to_string(list_transform(quotes, lambda x: '- ' || x), {NL}) || {NL} || {NL} else '' end
  || '**Sources retrouvées** :' || {NL} || array_to_string(list_transform(cited, lambda x: '- ' || x.source || case when x.page is null and x.score is null then '' else ' (' || concat_ws(', ', 'p.' || x.page, 'score ' || printf('%.3f', x.score)) || ')' end), {NL}) || {NL} || {NL} || '---' || {NL}"""


@query("a16_markdown_report", f"""with {LISTS}, en as (select analysis_id, id, status, {LINES} entry from rp),
  gr as (select analysis_id, status, count(*) n, string_agg(entry || {NL}, '' order by id) body from en group by 1, 2),
  ct as (select analysis_id, count(*) total, count_if(status = 'covered') c, count_if(status = 'partial') p, count_if(status = 'missing') m, count_if(status = 'ambiguous') a from en group by 1),
  bo as (select analysis_id, string_agg('## ' || case status when 'covered' then 'Exigences couvertes' when 'partial' then 'Exigences partielles' when 'missing' then 'Exigences manquantes' else 'Exigences ambiguës' end || ' (' || n || ')' || {NL} || {NL} || body, ''
    order by list_position(['covered', 'partial', 'missing', 'ambiguous'], status)) body from gr group by 1)
  select analysis_id, md5('# Analyse de cahier des charges — spec-' || analysis_id || '.docx' || {NL} || {NL} || '_Généré le now_' || {NL} || {NL} || '## Synthèse' || {NL} || {NL} || '| Indicateur | Valeur |' || {NL} || '|---|---|' || {NL}
    || '| Total exigences | ' || total || ' |' || {NL} || '| Couvertes | ' || c || ' |' || {NL} || '| Partielles | ' || p || ' |' || {NL} || '| Manquantes | ' || m || ' |' || {NL} || '| Ambiguës | ' || a || ' |' || {NL}
    || '| **Couverture** | **' || printf('%.1f', round(100 * (c + 0.5::double * p) / total, 1)) || '%** |' || {NL} || {NL} || regexp_replace(body, '\n$', '')) digest from ct join bo using (analysis_id)""")
def _(v):
    return S.report_markdown(reported(v), "now").select("analysis_id", F.md5("markdown").alias("digest"))


@query("a17_flat_export", f"""with {LISTS} select analysis_id, id "ID", coalesce(title, '') "Titre", coalesce(category, '') "Catégorie", priority "Priorité", case status when 'covered' then 'Couvert' when 'partial' then 'Partiel' when 'missing' then 'Manquant' else 'Ambigu' end "Statut",
  coalesce(verdict, '') "Verdict", coalesce(description, '') "Description", array_to_string(list_transform(criteria, lambda x: '• ' || x), {NL}) "Critères d'acceptation", coalesce(place, '') "Localisation source",
  array_to_string(list_transform(quotes, lambda x: '— ' || x), {NL}) "Preuves", array_to_string(list_transform(cited, lambda x: x.source || coalesce(' (p.' || x.page || ')', '')), '; ') "Sources retrouvées" from rp""")
def _(v):
    return S.flat_export(reported(v))


@query("a01_text_scan", "select r_regionkey region, r_name || chr(10) as text from region")
def _(v):
    path = new_path(v.spark, "texts")
    v.region.select("r_regionkey", "r_name").write.partitionBy("r_regionkey").text(path)
    return S.read_texts(v.spark, f"{path}/*").select(F.regexp_extract("source", "r_regionkey=(\\d+)", 1).cast("int").alias("region"), "text")


@query("a03_question_scan", "select item_id::varchar question, text ground_truth from benchmark where item_id % 5 > 0")
def _(v):
    path = new_path(v.spark, "questions")
    truth = F.when(F.col("item_id") % 5 > 0, F.col("text"))
    S.write_evaluation_csv(v.benchmark.select(F.col("item_id").cast("string").alias("question"), truth.alias("ground_truth")), path)
    return S.read_questions(v.spark, path)


@query("a13_analysis_history", "select id, created_at, coverage from (select id, created_at, round(100.0::double * (covered + 0.5::double * n_partial) / total, 1) coverage from analyses_v) where coverage > 50")
def _(v):
    path = new_path(v.spark, "history")
    rows = v.analyses.select("id", "created_at", coverage(F.col("covered"), F.col("n_partial"), F.col("total")).alias("coverage"))
    for part in (rows.where("pmod(xxhash64(id), 2) = 0"), rows.where("pmod(xxhash64(id), 2) = 1")):
        part.write.mode("append").parquet(path)
    return v.spark.read.parquet(path).where("coverage > 50")


@query("a15_evaluation_export", "select item_id::varchar question, text ground_truth from benchmark")
def _(v):
    path = new_path(v.spark, "evaluation")
    S.write_evaluation_csv(v.benchmark.select(F.col("item_id").cast("string").alias("question"), F.col("text").alias("ground_truth")), path)
    return S.read_questions(v.spark, path)
