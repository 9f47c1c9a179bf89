"""Documents into chunks: structure, sentences, semantic breakpoints, sizes and overlaps.

The rules work on one document's text and its arrays, so they are column expressions without a
shuffle; only where a model has to see every window of sentences are these rows of their own.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.embedding import Embed, embed
from lectern.functions.storage import materialize
from lectern.functions.texts import strip
from lectern.operators.retrieval import cosine

#: Characters from which a chunk may end, and at which it ends; sentences of a document
#: above which it is split by size; sentences and characters up to which a block stays whole.
MIN_CHARS, TARGET_CHARS, FAST_SENTENCES, WHOLE_SENTENCES, WHOLE_CHARS = 400, 2400, 1500, 2, 1200
#: The share of distances below a cut, the least distance of a cut, the fewest sentences of a chunk.
PERCENTILE, MIN_DISTANCE, MIN_SENTENCES = 0.9, 0.12, 2
#: The version that chunks carry, and the one of chunks split by size.
VERSION, FAST_VERSION = "v2", "v2-fastpath"
#: Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = ("M", "Mme", "Mlle", "Dr", "Pr", "art", "Art", "n°", "No", "Cf", "cf", "ex", "Ex", "p", "pp", "vs", "etc", "Etc")
#: A heading line, by hashes, by number or by keyword.
HEADING = r"^(?:(?:#{1,6}\s+.+)|(?:\d+(?:\.\d+){0,4}\.?\s+[A-ZÀ-ÖØ-Þ][^\n]{0,200})|(?:(?:Article|Section|Chapitre|Chapter|Annexe|Partie|Titre)\s+[IVXLC0-9]+[^\n]{0,200}))\s*$"
#: Characters behind a piece in which its cut is looked for.
CUT_WINDOW = 2000
#: What parts a text for the plain splitter, the best first, and its sizes.
SEPARATORS, PLAIN_SIZE, PLAIN_OVERLAP = ("\n\n", "\n", ". ", " "), 800, 120
#: Characters that mark a heading's ends, and a guarded full stop, while a text is taken apart.
HEAD, BODY, STOP = "\x02", "\x03", "\x01"

STRINGS = "array<string>"


def sections(text: Column) -> Column:
    """struct(heading, depth, text) of what stands before the first heading (if anything) and of each heading.

    A text without a heading is one section, none if it is blank.  Depth is the number of hashes, the
    dots of the number plus one, or 1.  Bodies are stripped and may be empty.
    """
    clean = F.translate(F.coalesce(text, F.lit("")), HEAD + BODY, "")
    parts = F.split(F.regexp_replace(clean, f"(?md){HEADING}", f"{HEAD}$0{BODY}"), HEAD, -1)

    def section(part: Column) -> Column:
        marked = F.instr(part, BODY) > 0
        heading = strip(F.substring_index(part, BODY, 1))
        hashes, number = F.regexp_extract(heading, r"^(#{1,6})\s", 1), F.regexp_extract(heading, r"^(\d+(?:\.\d+){0,4})", 1)
        depth = F.when(hashes != "", F.length(hashes)).when(number != "", F.size(F.split(number, r"\."))).otherwise(1)
        body = strip(F.when(marked, F.substring_index(part, BODY, -1)).otherwise(part))
        return F.struct(F.when(marked, heading).alias("heading"), F.when(marked, depth).cast("int").alias("depth"), body.alias("text"))

    return F.filter(F.transform(parts, section), lambda s: s["heading"].isNotNull() | (s["text"] != ""))


def with_paths(found: Column) -> Column:
    """struct(heading_path, text) of the sections with a body: the headings above, each less deep than the next."""
    entry = "array<struct<depth:int,heading:string>>"
    none = F.struct(F.array().cast(entry).alias("path"), F.array().cast("array<struct<heading_path:array<string>,text:string>>").alias("out"))

    def step(state: Column, s: Column) -> Column:
        above = F.filter(state["path"], lambda h: h["depth"] < s["depth"])
        path = F.when(s["heading"].isNull(), state["path"]).otherwise(F.array_append(above, F.struct(s["depth"].alias("depth"), s["heading"].alias("heading"))))
        block = F.struct(F.transform(path, lambda h: h["heading"]).alias("heading_path"), s["text"].alias("text"))
        return F.struct(path.alias("path"), F.when(s["text"] == "", state["out"]).otherwise(F.array_append(state["out"], block)).alias("out"))

    return F.aggregate(found, none, step, lambda s: s["out"])


def entries(rows: DataFrame, keys: list[str], array: Column | str, place: str, name: str) -> DataFrame:
    """keys, the place of each entry of the array, and the entry.

    Exploded with outer and without its nulls: else Spark infers a filter on the array's size, which works out all
    that the array is made of once more below, and what several steps share once for each mention.
    """
    return rows.select(*keys, F.posexplode_outer(array).alias(place, name)).where(F.col(place).isNotNull())


def structure_blocks(docs: DataFrame, key: str = "source") -> DataFrame:
    """key, block, heading, depth, text: a row for each section."""
    return entries(docs, [key], sections(F.col("text")), "block", "s").select(key, "block", "s.*")


def heading_paths(docs: DataFrame, key: str = "source") -> DataFrame:
    """key, block, heading_path, text: a row for each section with a body, numbered among these."""
    return entries(docs, [key], with_paths(sections(F.col("text"))), "block", "s").select(key, "block", "s.*")


def sentences(text: Column) -> Column:
    """Sentences of a text: they end at . ! ? before white space and a capital or digit, or at a blank line."""
    guarded = F.regexp_replace(strip(F.coalesce(text, F.lit(""))), rf"(?<![\p{{L}}\p{{N}}_])({'|'.join(ABBREVIATIONS)})\.\s", f"$1{STOP} ")
    parts = F.split(guarded, r"(?<=[.!?])\s+(?=[A-ZÀ-ÖØ-Þ0-9])|\n{2,}", -1)
    return F.filter(F.transform(parts, lambda s: strip(F.replace(s, F.lit(STOP), F.lit(".")))), lambda s: s != "")


def windows(found: Column) -> Column:
    """Each sentence with the next one as context."""
    return F.transform(found, lambda s, i: F.concat_ws(" ", s, F.get(found, i + 1)))


def distances(vectors: Column) -> Column:
    """1 less the cosine of each vector and the next one; one fewer than there are vectors."""
    n = F.greatest(F.size(vectors) - 1, F.lit(0))
    return F.zip_with(F.slice(vectors, 1, n), F.slice(vectors, 2, n), lambda a, b: 1 - F.coalesce(cosine(a, b), F.lit(0.0)))


def percentile(values: Column, share: float) -> Column:
    """The value that ``share`` of the sorted values lie below, between two of them in proportion; null without values."""
    ordered = F.array_sort(values)
    at = share * (F.size(values) - 1)
    low, high = F.get(ordered, F.floor(at).cast("int")), F.get(ordered, F.ceil(at).cast("int"))
    return low + (high - low) * (at - F.floor(at))


def breakpoints(found: Column, apart: Column) -> Column:
    """Numbers of the sentences that begin a new chunk.

    A chunk of MIN_CHARS or more ends where the distance to the next sentence is among the block's
    widest tenth (and MIN_DISTANCE at least), or where it has TARGET_CHARS.
    """
    limit = F.greatest(percentile(apart, PERCENTILE), F.lit(MIN_DISTANCE))
    steps = F.zip_with(F.slice(found, 1, F.size(apart)), apart, lambda s, d: F.struct(F.length(s).alias("n"), d.alias("d")))

    def step(state: Column, x: Column) -> Column:
        total, at = state["total"] + x["n"], state["at"] + 1
        cut = (total >= MIN_CHARS) & ((x["d"] >= state["limit"]) | (total >= TARGET_CHARS))
        return F.struct(F.when(cut, 0).otherwise(total).alias("total"), at.alias("at"), state["limit"].alias("limit"), F.when(cut, F.array_append(state["out"], at)).otherwise(state["out"]).alias("out"))

    # The limit rides along: inside the step it would be worked out for each sentence.
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("at"), limit.alias("limit"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(steps, start, step, lambda s: s["out"])


def assembled(found: Column, begins: Column) -> Column:
    """Chunks of the sentences between the breaks, each led by the last sentence before it.

    What has fewer than MIN_SENTENCES goes to the end of the chunk before it.
    """
    spans = F.zip_with(F.concat(F.array(F.lit(0)), begins), F.concat(begins, F.array(F.size(found))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def step(out: Column, x: Column) -> Column:
        n = F.size(out)
        own = F.array_join(F.slice(found, x["a"] + 1, x["b"] - x["a"]), " ")
        tail = F.concat(F.slice(out, 1, n - 1), F.array(F.concat(F.get(out, n - 1), F.lit(" "), own)))
        led = F.array_append(out, F.concat_ws(" ", F.when(n > 0, F.get(found, x["a"] - 1)), own))
        return F.when((n > 0) & (x["b"] - x["a"] < MIN_SENTENCES), tail).otherwise(led)

    return F.when(F.size(found) == 0, F.array().cast(STRINGS)).otherwise(F.aggregate(spans, F.array().cast(STRINGS), step))


def size_split(text: Column, limit: int = TARGET_CHARS) -> Column:
    """Pieces of words; a piece ends with the word that brings its letters and spaces to the limit."""
    # Each word has one space behind it, so a piece is what reaches the limit by its first space there, or the rest.
    words = F.concat(F.btrim(F.regexp_replace(text, "\\s+", " ")), F.lit(" "))
    return F.transform(F.regexp_extract_all(words, F.lit(f"(?s)[^ ].{{{max(limit - 2, 0)}}}[^ ]* |[^ ].*"), F.lit(0)), lambda p: F.rtrim(p))


def routed_blocks(docs: DataFrame, *keys: str) -> DataFrame:
    """keys, block, heading_path, text, sentences, way: the blocks of each document and how each is to be cut.

    By ``size`` are all blocks of a document of more than FAST_SENTENCES; else a block stays ``whole`` if
    it has two sentences or 1200 characters at most, and is cut by ``meaning`` if it has more.
    """
    found = docs.select(*keys, F.transform(with_paths(sections(F.col("text"))), lambda s: F.struct(s["heading_path"], s["text"], sentences(s["text"]).alias("sentences"))).alias("found"))
    total = F.aggregate("found", F.lit(0), lambda n, s: n + F.size(s["sentences"]))
    rows = entries(found.withColumn("total", total), [*keys, "total"], "found", "block", "s").select(*keys, "total", "block", "s.*")
    whole = (F.size("sentences") <= WHOLE_SENTENCES) | (F.length("text") <= WHOLE_CHARS)
    way = F.when(F.col("total") > FAST_SENTENCES, "size").when(whole, "whole").otherwise("meaning")
    return rows.where(F.size("sentences") > 0).select(*keys, "block", "heading_path", "text", "sentences", way.alias("way"))


def chunk_documents(docs: DataFrame, model: Embed | None = None) -> DataFrame:
    """doc_id, source, chunk_id, chunk, page, heading_path, heading, chunker_version and text of every chunk.

    ``docs`` has doc_id, source and text.  Blocks below headings are cut as :func:`routed_blocks` says;
    by meaning where the vectors of neighbouring windows lie far apart.  ``model`` adds ``embedding``
    to a table of windows; :func:`lectern.functions.embedding.embed` says what there is without one.
    chunk_id holds a hash of the source, doc_id and the place in the document, so it is the same
    whenever and with whatever else a document is cut.  Null and blank texts give no chunks; repeated rows
    give repeated chunks.
    """
    keys = ["doc_id", "source", "copy"]
    # Rows alike in doc_id and source are told apart while their windows are rows of their own.
    named = docs.select("doc_id", "source", F.struct(F.xxhash64("text"), F.monotonically_increasing_id()).alias("copy"), "text")
    meant = F.col("way") == "meaning"
    routed = routed_blocks(named, *keys).select(*keys, "block", "heading_path", "way", F.when(~meant, F.col("text")).alias("text"), F.when(meant, F.col("sentences")).alias("sentences"))
    blocks = materialize(routed, "blocks")
    direct = blocks.where("way <> 'meaning'").select(*keys, "block", "heading_path", "way", F.when(F.col("way") == "size", size_split(F.col("text"))).otherwise(F.array("text")).alias("pieces"))
    shown = entries(blocks.where("way = 'meaning'"), [*keys, "block", "heading_path"], F.arrays_zip("sentences", windows(F.col("sentences")).alias("window")), "pos", "z")
    vectors = embed(shown.select(*keys, "block", "heading_path", "pos", F.col("z.sentences").alias("sentence"), F.col("z.window").alias("window")), "window", model)
    # A block has FAST_SENTENCES at most.
    gathered = vectors.groupBy(*keys, "block").agg(F.first("heading_path").alias("heading_path"), F.sort_array(F.collect_list(F.struct("pos", "sentence", "embedding"))).alias("rows"))
    split = gathered.select(*keys, "block", "heading_path", F.transform("rows", lambda r: r["sentence"]).alias("sentences"), distances(F.transform("rows", lambda r: r["embedding"])).alias("apart"))
    broken = split.withColumn("begins", breakpoints(F.col("sentences"), F.col("apart")))
    pieces = assembled(F.col("sentences"), F.col("begins"))
    cut = direct.unionByName(broken.select(*keys, "block", "heading_path", F.lit("meaning").alias("way"), pieces.alias("pieces")))
    rows = entries(cut, [*keys, "block", "heading_path", "way"], "pieces", "piece", "text")
    place = (F.row_number().over(Window.partitionBy(*keys).orderBy("block", "piece")) - 1).cast("long")
    numbered = rows.withColumn("chunk", place)
    version = F.when(F.col("way") == "size", FAST_VERSION).otherwise(VERSION)
    return numbered.select("doc_id", "source", chunk_id("source", "doc_id", F.col("chunk")).alias("chunk_id"), "chunk", F.lit(1).alias("page"), "heading_path", F.array_join("heading_path", " / ").alias("heading"), version.alias("chunker_version"), "text")


def chunk_id(source: str, doc_id: str, place: Column, prefix: str = "") -> Column:
    """A hash of the source, the document and the place in it."""
    head = F.concat(F.lit(prefix), F.substring(F.md5(F.coalesce(F.col(source).cast("string"), F.lit("unknown"))), 1, 8))
    return F.concat_ws("_", head, F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), place)


def plain_pieces(text: str, separators: tuple[str, ...] = SEPARATORS, size: int = PLAIN_SIZE, overlap: int = PLAIN_OVERLAP) -> list[str]:
    """Pieces of ``size`` characters at most, cut at the best separator that a stretch has; each starts with what
    the one before ends with, ``overlap`` characters at most."""
    used = next((k for k, s in enumerate(separators) if s in text), len(separators))
    mark, finer = (separators[used], separators[used + 1 :]) if used < len(separators) else ("", ())
    # A separator stays with what follows it; without one every character is a part.
    parts = [p for p in re.split(f"(?={re.escape(mark)})", text) if p] if mark else list(text)
    out: list[str] = []
    held: list[str] = []
    total = 0

    def close() -> None:
        if piece := "".join(held).strip():
            out.append(piece)

    for part in parts:
        if len(part) >= size and mark:
            close()
            held, total = [], 0
            out += plain_pieces(part, finer, size, overlap) if finer or part != text else [part]
            continue
        if total + len(part) > size and held:
            close()
            while held and (total > overlap or total + len(part) > size):
                total -= len(held.pop(0))
        held.append(part)
        total += len(part)
    close()
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def plain_chunks(text: pd.Series) -> pd.Series:
    """:func:`plain_pieces` of each text; none of a null or blank one."""
    return text.map(lambda t: plain_pieces(t) if t and t.strip() else [])


def numbered(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``df`` with the place (from 0) of each row in its group; a group may be larger than any task.

    Rows are ordered across all groups, counted in each part of that order, and led by the counts of
    the parts before.
    """
    parted = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    dealt = materialize(parted.withColumn("part", F.spark_partition_id()), "numbered")
    sizes = dealt.groupBy(group, "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = sizes.select(F.col(group).alias("g"), F.col("part").alias("p"), F.coalesce(before, F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy(group, "part").orderBy(*order)) - 1
    placed = dealt.withColumn("inside", inside).join(base, F.col(group).eqNullSafe(F.col("g")) & (F.col("part") == F.col("p")))
    return placed.select(*df.columns, (F.col("base") + F.col("inside")).alias(name))


def stamp(chunks: DataFrame, source: str = "source", order: str = "chunk", prefix: str = "") -> DataFrame:
    """chunk_id from the source's hash and the place among all its chunks."""
    placed = numbered(chunks, source, [order], "place")
    return placed.select(*chunks.columns, F.concat(F.lit(prefix), F.substring(F.md5(source), 1, 8), F.lit("_"), "place").alias("chunk_id"))


def long_splits(text: Column, size: int = 30_000, overlap: int = 2_000) -> Column:
    """Overlapping stripped pieces of the stripped text; blank ones go, a short text is one piece.

    A piece is cut at the last blank line, else line, else space among its last CUT_WINDOW characters;
    the next one starts ``overlap`` before the cut, but moves on.
    """
    last = lambda tail, mark: F.when(F.instr(tail, mark) > 0, F.length(tail) - F.locate(mark, F.reverse(tail)) - len(mark) + 1)

    def part(s: Column, at: Column, length: Column) -> Column:
        """Characters of the text, looked up in the one or two blocks that hold them."""
        block = F.floor(at / size).cast("int")
        both = F.concat(F.get(s["blocks"], block), F.coalesce(F.get(s["blocks"], block + 1), F.lit("")))
        return F.coalesce(F.substring(both, at - block * size + 1, length), F.lit(""))

    def step(s: Column, _: Column) -> Column:
        start, n = s["start"], s["n"]
        hard = F.least(start + size, n)
        low = F.greatest(start + (size - CUT_WINDOW), start)
        tail = part(s, low, hard - low)
        cut = F.coalesce(last(tail, "\n\n"), last(tail, "\n"), last(tail, " "))
        end = F.when((hard < n) & (cut > 0), low + cut).otherwise(hard)
        piece = strip(part(s, start, end - start))
        after = F.when(end >= n, n).otherwise(F.greatest(end - overlap, start + 1))
        more = F.when(piece == "", s["out"]).otherwise(F.array_append(s["out"], piece))
        moved = F.struct(after.alias("start"), more.alias("out"), s["blocks"].alias("blocks"), n.alias("n"))
        return F.when(start >= n, s).otherwise(moved)

    # The text is stripped and cut into blocks once, as what the fold starts from: its steps don't read the text again.
    whole = F.transform(F.array(strip(F.coalesce(text, F.lit("")))), lambda t: F.struct(t.alias("t"), F.length(t).alias("n")))
    least = max(1, size - min(size, CUT_WINDOW) - overlap + 1)

    def walked(w: Column) -> Column:
        begin = F.struct(F.lit(0).alias("start"), F.array().cast(STRINGS).alias("out"), F.regexp_extract_all(w["t"], F.lit(f"(?s).{{1,{size}}}"), F.lit(0)).alias("blocks"), w["n"].alias("n"))
        steps = F.sequence(F.lit(0), F.ceil(w["n"] / F.lit(least)).cast("int"))
        return F.when(w["n"] <= size, F.array(w["t"])).otherwise(F.aggregate(steps, begin, step, lambda s: s["out"]))

    return F.get(F.transform(whole, walked), F.lit(0))


def paged_text(pages: DataFrame, limit: int = 180_000, marker: str = "\n\n[...document tronqué...]") -> DataFrame:
    """Pages (source, page, text) of each source in one text, each under its number, stripped and cut at the limit.

    Only pages that begin before the limit are gathered: lengths are added up first, in parts of a source.
    """
    marked = pages.select("source", "page", F.concat(F.lit("[page "), F.col("page").cast("string"), F.lit("]\n"), F.coalesce("text", F.lit(""))).alias("t"))
    lot = F.floor(F.col("page") / 64)
    sized = marked.select("source", "page", lot.alias("lot"), "t", (F.length("t") + 2).alias("n"))
    lots = sized.groupBy("source", "lot").agg(F.sum("n").alias("n"))
    running = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    base = lots.select("source", "lot", F.coalesce(F.sum("n").over(running("source").orderBy("lot")), F.lit(0)).alias("base"))
    # White space that is stripped in the end may come before the limit, hence the second half of it.
    near = sized.join(base.where(F.col("base") < 2 * limit), ["source", "lot"])
    inside = near.withColumn("at", F.col("base") + F.coalesce(F.sum("n").over(running("source", "lot").orderBy("page")), F.lit(0))).where(F.col("at") < 2 * limit)
    whole = strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "t"))), lambda p: p["t"]), "\n\n"))
    joined = inside.groupBy("source").agg(whole.alias("text"))
    return joined.withColumn("text", F.when(F.length("text") > limit, F.concat(F.left("text", F.lit(limit)), F.lit(marker))).otherwise(F.col("text")))


def inventory(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("collection", F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("n")).orderBy("collection", "source")


def totals(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("collection").agg(F.count_distinct("source").alias("documents"), F.count("*").alias("chunks"))
