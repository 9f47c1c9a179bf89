"""Web pages and record sources: cleaning, dates, filters, packing, ids and run reports."""

from __future__ import annotations

import re
from dataclasses import dataclass
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.texts import WHITE, strip

#: Months in French, with and without accents.
MONTHS = {"janvier": 1, "février": 2, "fevrier": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7, "août": 8, "aout": 8, "septembre": 9, "octobre": 10, "novembre": 11, "décembre": 12, "decembre": 12}
#: Elements of a page that are left out.
DROPPED = "nav|header|footer|script|style|noscript|form|aside"
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def unescape(text: Column) -> Column:
    for name, char in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


#: Where the text of a page is looked for, one after another.
CONTAINERS = ("article", "main", "body")


def main_part(html: Column, containers: tuple[str, ...] = CONTAINERS) -> Column:
    """The first of ``containers`` (``tag``, or ``tag#id`` for the one of that id) that the page has, else all of the page."""

    def part(selector: str) -> Column:
        tag, _, name = selector.partition("#")
        having = f"[^>]*\\bid\\s*=\\s*[\"']?{re.escape(name)}(?=[\"'\\s>])" if name else ""
        return F.nullif(F.regexp_extract(html, f"(?is)<{tag}\\b{having}[^>]*>(.*)</{tag}>", 1), F.lit(""))

    return F.coalesce(*map(part, containers), html)


def stripped_nodes(markup: Column) -> Column:
    """The texts between tags, each stripped, with one space between."""
    nodes = F.transform(F.split(markup, "(?s)<[^>]*>"), lambda t: strip(unescape(t)))
    return F.array_join(F.filter(nodes, lambda t: t != ""), " ")


def clean_text(html: Column, dropped: tuple[tuple[str, str], ...] = ()) -> Column:
    """Text of headings, paragraphs, list items and cells, a line each, headings with a blank line on either side.

    Each block is cut at the next opener; texts of less than three characters go.  ``dropped`` names elements
    (tag, class) that a source's pages hold besides their text; one ends at its first end tag.
    """
    boxes = "".join(f"|<{tag}\\b[^>]*\\bclass\\s*=\\s*[\"']?{re.escape(name)}(?=[\"'\\s>])[^>]*>.*?</{tag}>" for tag, name in dropped)
    bare = F.regexp_replace(html, f"(?is)<!--.*?-->|<({DROPPED})\\b[^>]*>.*?</\\1>{boxes}", "")
    marked = F.regexp_replace(bare, "(?i)<(h[1-4]|p|li|td|th)\\b[^>]*>", "\u0001$1\u0002")
    blocks = F.slice(F.split(marked, "\u0001"), 2, 1_000_000)
    text = lambda b: F.trim(F.regexp_replace(unescape(F.regexp_replace(F.regexp_replace(b, "^[^\u0002]*\u0002", ""), "(?s)<[^>]*>", " ")), "\\s+", " "))
    named = F.transform(blocks, lambda b: F.struct(F.lower(F.left(b, F.lit(1))).alias("tag"), text(b).alias("text")))
    kept = F.filter(named, lambda x: F.length(x["text"]) >= 3)
    line = lambda x: F.when(x["tag"] == "h", F.concat(F.lit("\n"), x["text"], F.lit("\n"))).otherwise(x["text"])
    return F.array_join(F.transform(kept, line), "\n")


def title(html: Column, slug: Column) -> Column:
    first = strip(unescape(F.regexp_replace(F.regexp_extract(html, "(?is)<h1\\b[^>]*>(.*?)</h1>", 1), "(?s)<[^>]*>", "")))
    return F.coalesce(F.nullif(first, F.lit("")), slug)


def slug(url: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(url, "[?#].*$", ""), "([^/]*)/?$", 1)


def numeric_date(text: Column) -> Column:
    """Of "Mis à jour le DD/MM/YYYY"; null without a date that exists."""
    return F.try_to_date(F.regexp_extract(text, "(?i)mis à jour le\\s+(\\d{2}/\\d{2}/\\d{4})", 1), "dd/MM/yyyy")


def french_date(text: Column) -> Column:
    """Of "Mis à jour le D mois YYYY"; null for an unknown month or day."""
    found = lambda g: F.regexp_extract(text, "(?i)mis à jour le\\s+(\\d{1,2})(?:er)?\\s+(\\p{L}+)\\s+(\\d{4})", g)
    months = F.create_map(*(x for k, m in MONTHS.items() for x in (F.lit(k), F.lit(m))))
    month = F.try_element_at(months, F.lower(found(2)))
    return F.try_to_date(F.concat_ws("-", F.nullif(found(3), F.lit("")), F.lpad(month.cast("string"), 2, "0"), F.lpad(found(1), 2, "0")), "yyyy-MM-dd")


def is_error_page(url: Column, html: Column, marker: str) -> Column:
    return F.contains(F.lower(url), F.lit("/app/error/")) | (F.length(html) < 200) | ~F.contains(html, F.lit(marker))


def in_scope(identifier: Column, subject: Column, ids: list[str], words: list[str] | None = None) -> Column:
    """Strict: the id is listed; with words: or the subject holds one of them."""
    listed = identifier.isin(ids)
    return listed if not words else listed | F.exists(F.array(*map(F.lit, words)), lambda t: F.contains(F.lower(subject), t))


def legal_references(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda u: strip(u)), lambda u: F.startswith(u, F.lit("http")))


#: Elements of a record whose texts make its body.
BODY = ("Titre", "Paragraphe", "Texte", "Liste")


#: Attributes of a record and elements of it that are fields.
ATTRIBUTES = {"ID": "id", "spUrl": "url", "dateDerniereModificationImportante": "updated"}
FIELDS = {"dc:title": "title", "dc:subject": "subject", "dc:source": "source", "dc:description": "description"}
RECORD = T.StructType([*(T.StructField(c, T.StringType()) for c in (*ATTRIBUTES.values(), *FIELDS.values())), T.StructField("texts", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())])


class _Record:
    """One pass over a record.  Texts between tags are kept once; an element of BODY is a stretch of them, from where
    it opens to where it closes, those inside it included.  Of each field the first element counts."""

    def __init__(self) -> None:
        self.values: dict[str, str] = {}
        self.nodes: list[str] = []
        self.found: list[list[int]] = []
        self.open: dict[str, list[int]] = {name: [] for name in BODY}
        self.inside: list[str] = []

    def start(self, name: str, attributes: dict[str, str]) -> None:
        if name == "Publication":
            for a in ATTRIBUTES.keys() & attributes.keys():
                self.values.setdefault(ATTRIBUTES[a], attributes[a])
        if name in self.open:
            self.open[name].append(len(self.found))
            self.found.append([len(self.nodes), 0])
        if name in FIELDS and (FIELDS[name] not in self.values or name in self.inside):
            self.values.setdefault(FIELDS[name], "")
            self.inside.append(name)

    def end(self, name: str) -> None:
        if name in self.open:
            self.found[self.open[name].pop()][1] = len(self.nodes)
        if name in self.inside:
            self.inside.remove(name)

    def text(self, data: str) -> None:
        if stripped := data.strip(WHITE):
            self.nodes.append(stripped)
        for name in set(self.inside):
            self.values[FIELDS[name]] += data


def read_record(xml: str) -> dict:
    """The attributes, fields and texts of a record, empty ones null; ``error`` alone if it isn't well-formed."""
    record, parser = _Record(), expat.ParserCreate()
    parser.buffer_text, parser.buffer_size = True, 1 << 20
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = record.start, record.end, record.text
    try:
        parser.Parse(re.sub(r"^\s*<\?xml[^>]*\?>", "", xml).encode(), True)
    except expat.ExpatError as error:
        return {"error": str(error)}
    return {k: v.strip(WHITE) or None for k, v in record.values.items()} | {"texts": [" ".join(record.nodes[a:b]) for a, b in record.found]}


@F.pandas_udf(RECORD)
def record_parts(xml: pd.Series) -> pd.DataFrame:
    """:func:`read_record` of each record; nothing of a null one."""
    return pd.DataFrame([read_record(x) if x else {} for x in xml], columns=RECORD.fieldNames(), dtype=object).astype(object).where(lambda d: d.notna(), None)


def _body(parts: Column) -> Column:
    texts = F.filter(F.coalesce(parts["texts"], F.array().cast("array<string>")), lambda t: F.length(t) > 3)
    return F.array_join(F.concat(F.array_compact(F.array(parts["description"])), texts), "\n\n")


def record_body(records: DataFrame) -> DataFrame:
    """``records`` (xml) with ``body``: the description and the texts of titles, paragraphs, texts and lists in order, a blank line between.

    What lies inside a list counts for the list and for itself; texts of up to three characters go.  A
    record that isn't well-formed has none.
    """
    return records.withColumn("__parts", record_parts("xml")).withColumn("body", _body(F.col("__parts"))).drop("__parts")


def _read(files: DataFrame) -> DataFrame:
    return files.where(F.contains("xml", F.lit("<Publication"))).select("name", record_parts("xml").alias("r"))


def parse_records(files: DataFrame, url_base: str = "") -> DataFrame:
    """A row for each file (name, xml) that holds a publication: id, url, date, title, subject, references and text.

    Each file is parsed once; one that isn't well-formed is left out, and :func:`record_errors` tells why.
    """
    named = _read(files).where("r.error is null").withColumn("source_id", F.coalesce("r.id", F.regexp_replace("name", "\\.xml$", "")))
    return named.select(
        "source_id",
        F.coalesce("r.url", F.concat(F.lit(url_base), "source_id")).alias("url"),
        F.left("r.updated", F.lit(10)).alias("updated"),
        F.coalesce("r.title", "source_id").alias("title"),
        F.coalesce("r.subject", F.lit("")).alias("subject"),
        legal_references(F.coalesce("r.source", F.lit(""))).alias("references"),
        _body(F.col("r")).alias("text"),
    )


def record_errors(files: DataFrame) -> DataFrame:
    """name and message of the files that hold a publication but can't be parsed; they don't end a run."""
    return _read(files).where("r.error is not null").select("name", F.concat(F.lit("parse/chunk failed: "), "r.error").alias("message"))


def with_metadata(pages: DataFrame, source: str, domains: list[str]) -> DataFrame:
    """``pages`` with ``metadata``, the same fields for all sources; a page's own ``domaine`` comes before the source's.

    ``pages`` has source_id, title, url, updated, page and domaine, each of which may be null.
    """
    own = F.when(F.col("domaine").isNotNull(), F.array("domaine")).otherwise(F.array(*map(F.lit, domains)))
    fields = {
        "source": F.lit(source), "source_id": F.col("source_id"), "title": F.col("title"), "url_canonique": F.col("url"), "date_maj": F.col("updated").cast("string"),
        "domaine": own, "version": F.lit(None).cast("string"), "language": F.lit("fr"), "scope": F.lit("kb"), "page": F.coalesce(F.col("page").cast("string"), F.lit("?")),
    }
    return pages.withColumn("metadata", F.struct(*(c.alias(k) for k, c in fields.items())))


def pack_paragraphs(text: Column, limit: int = 1800) -> Column:
    """Paragraphs joined while they and two characters between stay within the limit; a long one stays whole.

    Without any paragraph the first ``limit`` characters are the one piece, if there are any.
    """
    paragraphs = F.filter(F.transform(F.split(text, "\\n\\s*\\n"), strip), lambda p: p != "")
    start = F.struct(F.lit("").alias("buf"), F.array().cast("array<string>").alias("out"))

    def step(s, p):
        fits = F.length(s["buf"]) + F.length(p) + 2 <= limit
        joined = F.when(s["buf"] == "", p).otherwise(F.concat(s["buf"], F.lit("\n\n"), p))
        closed = F.when(s["buf"] == "", s["out"]).otherwise(F.array_append(s["out"], s["buf"]))
        return F.struct(F.when(fits, joined).otherwise(p).alias("buf"), F.when(fits, s["out"]).otherwise(closed).alias("out"))

    packed = F.aggregate(paragraphs, start, step, lambda s: F.when(s["buf"] == "", s["out"]).otherwise(F.array_append(s["out"], s["buf"])))
    return F.when(F.size(paragraphs) > 0, packed).otherwise(F.filter(F.array(F.left(text, F.lit(limit))), lambda t: t != ""))


def packed_sections(pages: DataFrame, limit: int = 1800) -> DataFrame:
    """A row for each piece of each page with its label; ``pages`` has source, source_id, text and more."""
    pieces = pack_paragraphs(F.col("text"), limit)
    spread = pages.withColumn("__n", F.size(pieces)).select("*", F.posexplode(pieces).alias("pos", "chunk"))
    return spread.withColumn("page", F.concat(F.lit("section-"), F.col("pos") + 1, F.lit("/"), "__n")).drop("__n")


def length_guard(chunks: DataFrame, least: int = 50, most: int = 12_000) -> DataFrame:
    """Stripped chunks of at least ``least`` characters, cut at ``most``, and whether they were cut."""
    kept = chunks.withColumn("chunk", strip(F.coalesce("chunk", F.lit("")))).where(F.length("chunk") >= least)
    return kept.withColumn("cut", F.length("chunk") > most).withColumn("chunk", F.left("chunk", F.lit(most)))


def guard_counts(chunks: DataFrame, least: int = 50, most: int = 12_000) -> DataFrame:
    """What the guard stores, drops as too short and cuts, by source."""
    n = F.length(strip(F.coalesce("chunk", F.lit(""))))
    return chunks.groupBy("source").agg(F.count_if(n >= least).alias("upserted"), F.count_if(n < least).alias("dropped"), F.count_if(n > most).alias("truncated"))


def stable_ids(chunks: DataFrame) -> DataFrame:
    """Place of each chunk in its record after the guard, and an id made of source, record, label and place; a record is one page."""
    place = F.row_number().over(Window.partitionBy("source", "source_id").orderBy("pos", "chunk")) - 1
    return chunks.withColumn("place", place).withColumn("chunk_id", F.left(F.sha2(F.concat_ws("::", "source", "source_id", "page", "place"), 256), F.lit(32)))


def run_report(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pages fetched, chunks made and error pages of each source."""
    made = chunks.groupBy("source").agg(F.count("*").alias("chunks"))
    got = pages.groupBy("source").agg(F.count_distinct("source_id").alias("fetched"), F.count("error").alias("errors"))
    return got.join(made, "source", "left").select("source", "fetched", F.coalesce("chunks", F.lit(0)).alias("chunks"), "errors")


def run_errors(pages: DataFrame) -> DataFrame:
    """What went wrong, a row for each page with an ``error``; a page that fails doesn't end the run."""
    return pages.where("error is not null").select("source", "source_id", F.concat(F.lit("parse/chunk failed: "), "error").alias("message"))


@dataclass(frozen=True)
class Source:
    """How pages of one source become chunks: its rules, the domains it stands for, and the size of its pieces."""

    name: str
    domains: tuple[str, ...]
    marker: str
    ids: tuple[str, ...] = ()
    words: tuple[str, ...] = ()
    strict: bool = False
    limit: int = 1800
    containers: tuple[str, ...] = CONTAINERS
    dropped: tuple[tuple[str, str], ...] = ()


def run_source(pages: DataFrame, source: Source) -> DataFrame:
    """source, source_id, page, chunk_id, chunk and metadata of the pages (url, html) of a source, all of its rules applied.

    Error pages and pages out of scope go; without ids and words all are in scope.
    """
    kept = pages.where(~is_error_page(F.col("url"), F.col("html"), source.marker)).withColumn("source_id", slug(F.col("url")))
    if source.ids or source.words:
        kept = kept.where(in_scope(F.col("source_id"), F.col("url"), list(source.ids), None if source.strict else list(source.words)))
    text = clean_text(main_part(F.col("html"), source.containers), source.dropped)
    made = kept.select("url", "source_id", F.lit(source.name).alias("source"), title(F.col("html"), F.col("source_id")).alias("title"), text.alias("text"))
    dated = made.withColumns({"updated": F.coalesce(numeric_date(F.col("text")), french_date(F.col("text"))), "domaine": F.lit(None).cast("string")})
    pieces = stable_ids(length_guard(packed_sections(dated, source.limit)))
    return with_metadata(pieces, source.name, list(source.domains)).select("source", "source_id", "page", "place", "chunk_id", "chunk", "metadata")


def length_statistics(chunks: DataFrame) -> DataFrame:
    n = F.length("chunk")
    return chunks.groupBy("source").agg(F.min(n).cast("long").alias("shortest"), F.max(n).cast("long").alias("longest"), F.round(F.avg(n), 6).alias("mean"))
