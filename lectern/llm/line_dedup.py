"""Line dedup: the first document that holds a line keeps it, every other document loses it.

Hashes of lines are range-partitioned and sorted by document and position inside each partition, so
that the first occurrence streams by before the rest.  What comes out is a compressed bitmap for
each document that loses a line: 64 lines a word, words without a loss left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.storage import materialize
from lectern.llm.text import WHITE, ascii_lower, body, documents_only, identity, same_document, wrapped

#: A line hash that holds at least this share of all lines is dealt in so many ways at least, and in
#: more where a way could have more rows than this.
HOT_SHARE = 0.0005
HOT_WAYS, WAY_ROWS = 64, 1 << 20


def split_lines(text: Column) -> Column:
    return F.split(body(text), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """h1, h2 (128 bits of the key), doc_id, ident, pos of each line whose key has ``min_chars`` code points."""
    lines = docs.select("doc_id", identity().alias("ident"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    keys = lines.select("doc_id", "ident", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7919), "key").alias("h2"), "doc_id", "ident", "pos")


def line_keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """doc_id, ident, n_dropped and ``keep``, a map from word number to the keep bits of lines 64*word to 64*word+63.

    Documents are ordered by doc_id, null last, then by text; rows alike in doc_id and text count as
    one document and lose the same lines.  A null or empty text is one empty line, too short to be
    dropped.  Documents that lose nothing have no row.  An empty table gives no rows.
    """
    lines = materialize(hashed_lines(documents_only(docs), min_chars), "lines")
    hot = lines.stat.freqItems(["h1"], HOT_SHARE).first()[0] or []
    is_hot = F.col("h1").isin(hot) if hot else F.lit(False)
    order = [F.col("doc_id").asc_nulls_last(), "ident"]

    # A hot hash is split by document; its one global first is a pre-aggregated table of few rows.
    many = max(HOT_WAYS, -(-lines.count() // WAY_ROWS))
    ways = F.when(is_hot, F.pmod("ident", F.lit(many)).cast("int")).otherwise(0)
    dealt = lines.withColumn("way", ways).repartitionByRange("h1", "h2", "way")
    stream = Window.partitionBy("h1", "h2", "way").orderBy(*order, "pos")
    seen = dealt.withColumn("first", F.first(F.struct("doc_id", "ident")).over(stream.rowsBetween(Window.unboundedPreceding, 0)))
    if hot:
        first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "ident"))
        heads = lines.where(is_hot).groupBy("h1", "h2").agg(first.alias("head")).select("h1", "h2", F.struct("head.doc_id", "head.ident").alias("head"))
        seen = seen.join(F.broadcast(heads), ["h1", "h2"], "left").withColumn("first", F.coalesce("head", "first"))
    own = (F.col("first.ident") == F.col("ident")) & F.col("first.doc_id").eqNullSafe(F.col("doc_id"))
    dropped = seen.where(~own).select("doc_id", "ident", "pos")

    word = F.shiftright("pos", 6)
    bits = dropped.groupBy("doc_id", "ident", word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("lost"))
    entry = F.struct("word", F.bitwise_not("lost").alias("keep"))
    return bits.groupBy("doc_id", "ident").agg(F.sum(F.bit_count("lost")).alias("n_dropped"), F.map_from_entries(F.collect_list(entry)).alias("keep"))


def kept_lines(lines: Column, keep: Column) -> Column:
    """The lines whose bit is set; a word that the map lacks keeps all of its lines."""
    return F.filter(lines, lambda line, i: _bit(keep, i))


def _bit(keep: Column, i: Column) -> Column:
    word = F.coalesce(F.try_element_at(keep, F.shiftright(i, 6)), F.lit(-1))
    return F.getbit(word, F.pmod(i, F.lit(64))) == 1


def apply_keep_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with the column ``text`` rewritten, and ``__lines`` = struct(n_lines, n_dropped) added.

    All columns of ``docs`` stay, extra ones too, whatever their names (but for one named ``__lines``,
    which gives way); a text that loses nothing stays as it is, null included.
    """
    rows = wrapped(docs).withColumn("ident", identity())
    joined = rows.join(bitmaps, same_document(rows, bitmaps), "left").select("row", rows["text"], "n_dropped", "keep")
    lines = split_lines(F.col("text"))
    text = F.when(F.col("keep").isNull(), F.col("text")).otherwise(F.array_join(kept_lines(lines, F.col("keep")), "\n"))
    counts = F.struct(F.size(lines).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"))
    others = [text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c != "__lines"]
    return joined.select(*others, counts.alias("__lines"))


def dedup_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """:func:`line_keep_bitmaps` applied to the texts it was made from."""
    return apply_keep_bitmaps(docs, line_keep_bitmaps(docs, min_chars))
