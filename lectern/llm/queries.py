"""One query for each operator of this package, over the whole of its table, and SQL where SQL can tell the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.storage import table
from lectern.llm.decontamination import contaminated
from lectern.llm.langid import fit, held_out, identify
from lectern.llm.licenses import GRAM, OF_SPAN, OF_TEMPLATE, PHRASES, SLACK, TEMPLATES, scan_licenses
from lectern.llm.line_dedup import dedup_lines
from lectern.llm.manifest import folded, leaf, merkle_manifest, proof_text
from lectern.llm.packing import pack
from lectern.llm.quality import score_quality
from lectern.llm.resampling import resample
from lectern.llm.sharding import histogram_shards
from lectern.llm.simhash import near_duplicates
from lectern.llm.substring_dedup import drop_repeated_words
from lectern.llm.text import body
from lectern.llm.token_files import round_trip
from lectern.llm.tokenization import count_tokens


def op1_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    s = histogram_shards(docs, num_shards=24)
    crc = F.crc32(body().cast("binary")).alias("text_crc32")
    return s.select("doc_id", "__shard.size", crc, "__shard.law", "__shard.shard", "__shard.slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", limit=512)


def op3_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, table(spark, sf_dir, "labels"), keep=["doc_id"]).select("doc_id", "__quality.*").drop("mean", "low")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), "word_bpe_49k.json", capacity=2048)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")


def op8_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), fit(docs), keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "__lang.*")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "__lines.n_lines", "__lines.n_dropped", F.sha2(body(), 256).alias("kept_sha256"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_words(table(spark, sf_dir, "documents"), length=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    drawn = resample(docs, table(spark, sf_dir, "benchmark"), share=10, min_words=20, longest=1, buckets=10_000, seed=2024, keep=["doc_id"])
    return drawn.select("doc_id", "__draw.*")


def op12_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return found.select("doc_id", "__licenses.*").drop("spans")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every row the path, and what it makes of the row as it is or, where tampered with, as it has become."""
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = table(spark, sf_dir, "documents")
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    now = F.when(changed, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    tampered = leaf([now if c == "n_chars" else F.col(c) for c in columns])
    d = merkle_manifest(docs, columns, by="lang", extra={"tampered": tampered})
    d = d.withColumns({"folded_root": folded(F.col("tampered"), F.col("path")), "proof_sha256": F.sha2(proof_text(F.col("path")), 256)})
    return d.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {
    "op1_histogram_shards": op1_histogram_shards,
    "op2_token_counts": op2_token_counts,
    "op3_simhash_groups": op3_simhash_groups,
    "op4_quality_rules": op4_quality_rules,
    "op5_decontamination": op5_decontamination,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_token_files": op7_token_files,
    "op8_language_codes": op8_language_codes,
    "op9_line_dedup": op9_line_dedup,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_license_scans": op12_license_scans,
    "op13_merkle_manifest": op13_merkle_manifest,
}

#: CRC-32 in SQL: its table of 256, and a macro-like expression over the hex digits of a text's UTF-8 bytes.
CRC_TABLE = """
        crc_table as (
          select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) t
          from range(256) r(i))"""


def sql_crc32(hex_digits: str) -> str:
    octets = f"list_transform(range(0, length({hex_digits}) // 2), lambda i: ('0x' || {hex_digits}[2 * i + 1 : 2 * i + 2])::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"


def sql_words(text: str) -> str:
    lower = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"list_filter(string_split_regex({lower}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


def sql_values(rows) -> str:
    """Rows of texts and numbers as a list of SQL values."""
    told = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(told, r)) + ")" for r in rows)


ORACLES = {
    "op11_importance_resampling": f"""
        with {CRC_TABLE},
        own as (select doc_id, {sql_words("text")} w from documents),
        uses as (select doc_id, unnest(w) word from own),
        asked as (select unnest({sql_words("text")}) word from benchmark),
        known as (select word, {sql_crc32("h")} % 10000 bucket from (select word, hex(encode(word)) h from (select word from uses union select word from asked)), crc_table),
        s as (select bucket, count(*) s from uses join known using (word) group by bucket),
        t as (select bucket, count(*) t from asked join known using (word) group by bucket),
        gains as (
          select bucket, cast(floor(1000 * ln((coalesce(t, 0) + 1.0::double) * ((select count(*) from uses) + 10000.0::double)
                                            / ((coalesce(s, 0) + 1.0::double) * ((select count(*) from asked) + 10000.0::double)))) as bigint) gain
          from (select distinct bucket from known) left join s using (bucket) left join t using (bucket)),
        weights as (select doc_id, count(*) n, cast(sum(gain) as bigint) total from uses join known using (word) join gains using (bucket) group by doc_id),
        each as (
          select doc_id, len(w)::bigint n_features,
                 coalesce((total - ((total % n) + n) % n) // n, 0) weight,
                 ('0x' || sha256('2024:' || doc_id)[1:8])::bigint h
          from own left join weights using (doc_id)),
        scores as (select doc_id, n_features, weight, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296))) as bigint) score from each),
        places as (select doc_id, row_number() over (order by score desc, doc_id) place from scores where n_features >= 20)
        select doc_id, n_features, weight, score, case when place <= (select count(*) from places) * 10 // 100 then place end rank
        from scores left join places using (doc_id)
    """,
    "op12_license_scans": f"""
        with own as (select doc_id, {sql_words("text")} w from documents),
        phrases(phrase, label) as (values {sql_values(PHRASES.items())}),
        templates(template, label, tw) as (select template, label, {sql_words("body")} from (values {sql_values((i, *t) for i, t in enumerate(TEMPLATES))}) v(template, label, body)),
        uses as (select doc_id, generate_subscripts(w, 1) - 1 pos, unnest(w) word from own),
        runs as (
          select doc_id, pos, word || ' ' || lead(word) over d two, word || ' ' || lead(word) over d || ' ' || lead(word, 2) over d three,
                 word || ' ' || lead(word) over d || ' ' || lead(word, 2) over d || ' ' || lead(word, 3) over d four
          from uses window d as (partition by doc_id order by pos)),
        base as (
          select doc_id, count(*) n_base, min(pos) first_word, max(pos) last_word, list(distinct label) labels
          from runs join phrases on phrase = two or phrase = three group by doc_id),
        grams as (
          select template, label, len(tw) of_words, i - 1 tpos, array_to_string(tw[i : i + 3], ' ') gram
          from (select *, unnest(range(1, len(tw) - 2)) i from templates)),
        votes as (select doc_id, template, label, of_words, pos, tpos, pos - tpos diagonal from runs join grams on gram = four),
        lines as (select distinct doc_id, template, diagonal from votes),
        apart as (select *, coalesce(diagonal - lag(diagonal) over d > {SLACK}, true)::int far from lines window d as (partition by doc_id, template order by diagonal)),
        copies as (select doc_id, template, diagonal, sum(far) over (partition by doc_id, template order by diagonal) copy from apart),
        covered as (
          select doc_id, template, label, of_words, copy, pos + n pos, tpos + n tpos
          from votes join copies using (doc_id, template, diagonal), range({GRAM}) r(n)),
        spans as (
          select doc_id, label, count(distinct tpos) / of_words share
          from covered group by doc_id, template, label, of_words, copy
          having count(distinct tpos) / of_words >= {OF_TEMPLATE} and count(distinct pos) >= {OF_SPAN} * (max(pos) + 1 - min(pos))),
        more as (select doc_id, list(distinct label) labels, max(share) share from spans group by doc_id)
        select doc_id, len(w)::bigint n_words, coalesce(n_base, 0) n_base, first_word, last_word,
               array_to_string(list_sort(coalesce(b.labels, [])), ',') base_labels,
               array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ',') labels,
               case when n_base > 0 then 1.0::double else coalesce(share, 0.0)::double end score
        from own left join base b using (doc_id) left join more m using (doc_id)
    """,
    "op13_merkle_manifest": f"""
        with recursive {CRC_TABLE},
        told as (
          select *, {sql_crc32("hex(encode(doc_id::varchar))")} % 7 = 0 changed,
                 coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') head,
                 coalesce(strlen(text) || ':' || text, '-') tail
          from documents, crc_table),
        leaves as (
          select doc_id, coalesce('=' || lang, '') tree, row_number() over (partition by lang order by doc_id) - 1 pos,
                 sha256(head || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || tail) leaf,
                 sha256(head || coalesce(strlen((n_chars + changed::int)::varchar) || ':' || (n_chars + changed::int), '-') || tail) tampered
          from told),
        nodes as (
          select 0 level, tree, pos, leaf h, count(*) over (partition by tree) n from leaves
          union all
          select level + 1, tree, pos // 2, sha256(string_agg(h, '' order by pos)), (n + 1) // 2 from nodes where n > 1 group by level, tree, pos // 2, n),
        subroots as (select tree, h subroot, row_number() over (order by tree) - 1 pos, count(*) over () n from nodes where n = 1),
        tops as (
          select 0 level, pos, subroot h, n from subroots
          union all
          select level + 1, pos // 2, sha256(string_agg(h, '' order by pos)), (n + 1) // 2 from tops where n > 1 group by level, pos // 2, n),
        steps as (
          select l.doc_id, n.level, l.pos >> n.level place, s.h from leaves l join nodes n on n.tree = l.tree and n.pos = l.pos >> n.level and n.n > 1
          left join nodes s on s.tree = l.tree and s.level = n.level and s.pos = xor(n.pos, 1)
          union all
          select l.doc_id, 1000 + t.level, r.pos >> t.level, s.h from leaves l join subroots r using (tree) join tops t on t.pos = r.pos >> t.level and t.n > 1
          left join tops s on s.level = t.level and s.pos = xor(t.pos, 1)),
        paths as (select doc_id, string_agg(h, '' order by level) proof, list({{'odd': place & 1, 'h': h}} order by level) path from steps group by doc_id),
        folds as (
          select doc_id, 1 step, tampered h, path from leaves left join paths using (doc_id)
          union all
          select doc_id, step + 1, sha256(case when path[step].odd = 1 then coalesce(path[step].h, '') || h else h || coalesce(path[step].h, '') end), path
          from folds where step <= coalesce(len(path), 0)),
        ends as (select doc_id, h folded_root from folds where step = coalesce(len(path), 0) + 1)
        select doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) proof_sha256, folded_root, folded_root = root verified
        from leaves join subroots using (tree) left join paths using (doc_id) join ends using (doc_id), (select h root from tops where n = 1)
    """,
    "op10_substring_dedup": r"""
        with words as (
          select doc_id, generate_subscripts(w, 1) i, unnest(w) word
          from (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \x09-\x0D]+'), lambda x: x <> '') w from documents)),
        windows as (
          select doc_id, i, list(word) over (partition by doc_id order by i rows between current row and 19 following) w from words),
        ranked as (
          select doc_id, i, row_number() over (partition by w order by doc_id, i) n from windows where len(w) = 20),
        starts as (select doc_id, i from ranked where n > 1),
        marked as (
          select w.doc_id, w.i, w.word, max(case when s.i is not null then w.i end) over (partition by w.doc_id order by w.i rows between 19 preceding and current row) is not null gone
          from words w left join starts s on s.doc_id = w.doc_id and s.i = w.i),
        kept as (
          select doc_id, count(*) n_words, cast(sum(gone::int) as bigint) n_removed, string_agg(word, ' ' order by i) filter (where not gone) body
          from marked group by doc_id)
        select doc_id, coalesce(n_words, 0) n_words, coalesce(n_removed, 0) n_removed, sha256(coalesce(body, '')) kept_sha256
        from (select distinct doc_id from documents) left join kept using (doc_id)
    """,
    "op9_line_dedup": r"""
        with lines as (
          select doc_id, i, line, translate(trim(line, e' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k
          from (select doc_id, generate_subscripts(l, 1) i, unnest(l) line
                from (select doc_id, string_split(coalesce(text, ''), chr(10)) l from documents))),
        firsts as (select k, min(doc_id) first_doc from lines where length(k) >= 10 group by k having count(distinct doc_id) > 1),
        marked as (select l.*, f.first_doc is not null and f.first_doc <> l.doc_id lost from lines l left join firsts f using (k))
        select doc_id, count(*) n_lines, cast(sum(lost::int) as bigint) n_dropped,
               sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not lost), '')) kept_sha256
        from marked group by doc_id
    """,
}
