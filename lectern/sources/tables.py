"""Reading text, tables, records and reports; writing chunks, reports and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.texts import strip

#: Endings of the files that can be read.
SUPPORTED = (".pdf", ".docx", ".txt", ".md", ".xlsx", ".xls")
REPORT = "struct<filename:string,requirements:array<struct<id:string,title:string,status:string,confidence:double>>>"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """source and text of each file, whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))


def sheet_text(rows: DataFrame, cells: list[str], sheet: str, order: str) -> DataFrame:
    """Rows of a sheet as lines of their non-empty cells, under the sheet's name."""
    line = F.array_join(F.filter(F.transform(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cells)), lambda x: strip(x)), lambda x: x != ""), " | ")
    lines = rows.select(sheet, F.col(order).alias("__o"), line.alias("line")).where("line <> ''")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__o", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy(sheet).agg(F.concat(F.lit("## Feuille : "), F.col(sheet).cast("string"), F.lit("\n"), body).alias("text"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """question and ground_truth of an evaluation file; rows that lack either are left out."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return rows.select("question", "ground_truth").na.drop()


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """name and xml of the XML files whose name starts with F or N, whole; see :func:`lectern.sources.pages.parse_records`."""
    return of_records(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("xml")))


def of_records(files: DataFrame) -> DataFrame:
    return files.where(F.col("name").rlike("^[FN].*\\.xml$"))


def parse_report(text: Column) -> Column:
    """The requirements of a report as JSON text; none of a malformed one."""
    return F.coalesce(F.from_json(text, REPORT)["requirements"], F.from_json(F.lit('{"requirements":[]}'), REPORT)["requirements"])


def supported(source: Column) -> Column:
    return F.lower(F.regexp_extract(source, "\\.[^.]+$", 0)).isin(*SUPPORTED)


def rejected(files: DataFrame) -> DataFrame:
    """source and message of the files (source) whose ending can't be read; a file without one says so."""
    ending = F.lower(F.regexp_extract("source", "\\.[^.]+$", 0))
    why = F.when(ending == "", "no file ending").otherwise(F.concat(F.lit("unsupported file ending: "), ending))
    return files.where(~F.coalesce(supported(F.col("source")), F.lit(False))).select("source", F.coalesce(why, F.lit("no file name")).alias("message"))


def deletion_report(removed: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows gone from each collection, by what a store's ``remove`` tells, and 0 for those that have lost none."""
    gone = removed.groupBy("collection").agg(F.sum("deleted").alias("n"))
    every = stored.select("collection").distinct().unionByName(gone.select("collection")).distinct().withColumnRenamed("collection", "c")
    return every.join(gone, F.col("c").eqNullSafe(F.col("collection")), "left").select(F.col("c").alias("collection"), F.coalesce("n", F.lit(0)).cast("long").alias("deleted"))


def csv_cell(value: Column, separator: str = ";") -> Column:
    """A cell by RFC 4180: in quotes if it holds the separator, a quote or a line end, quotes doubled."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike(f'[{separator}"\\r\\n]'), quoted).otherwise(text)


def csv_lines(rows: DataFrame, separator: str = ";") -> DataFrame:
    return rows.select(F.concat_ws(separator, *(csv_cell(F.col(c), separator) for c in rows.columns)).alias("line"))


def write_feedback_csv(rows: DataFrame, path: str, compression: str = "none") -> None:
    """Lines with CRLF; the header, led by a byte order mark, is the first file.

    ``compression`` is one that Spark's text files know; lines of an export take some twelve times its Parquet input.
    """
    write = lambda df, part: df.write.mode("overwrite").option("lineSep", "\r\n").option("compression", compression).text(f"{path}/{part}")
    header = rows.sparkSession.createDataFrame([("﻿" + ";".join(rows.columns),)], "line string")
    write(header.coalesce(1), "header")
    write(csv_lines(rows), "rows")


def write_evaluation_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


#: How reports call the statuses, and the headings of their groups in order.
STATUS_LABEL = {"covered": "Couvert", "partial": "Partiel", "missing": "Manquant", "ambiguous": "Ambigu"}
GROUPS = {"covered": "Exigences couvertes", "partial": "Exigences partielles", "missing": "Exigences manquantes", "ambiguous": "Exigences ambiguës"}
#: The rows of the summary table.
SUMMARY = {"covered": "Couvertes", "partial": "Partielles", "missing": "Manquantes", "ambiguous": "Ambiguës"}
#: The columns of the flat export.
FLAT = ("ID", "Titre", "Catégorie", "Priorité", "Statut", "Verdict", "Description", "Critères d'acceptation", "Localisation source", "Preuves", "Sources retrouvées")


def _joined(lines: Column, sep: str = "\n") -> Column:
    return F.array_join(lines, sep)


def _entry() -> Column:
    """A requirement of a report: what it is, says and rests on; what is empty is left out."""
    label = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"**{name}** : "), c, F.lit("  \n"))).otherwise("")
    block = lambda head, lines, show: F.when(F.size(lines) > 0, F.concat(F.lit(f"**{head}** :\n"), _joined(F.transform(lines, show)), F.lit("\n\n"))).otherwise("")
    bullet = lambda x: F.concat(F.lit("- "), x)

    def source(s: Column) -> Column:
        page, score = F.concat(F.lit("p."), s["page"].cast("string")), F.concat(F.lit("score "), F.format_string("%.3f", s["score"]))
        extra = F.concat_ws(", ", F.when(s["page"].isNotNull(), page), F.when(s["score"].isNotNull(), score))
        return F.concat(F.lit("- "), F.coalesce(F.nullif(s["source"], F.lit("")), F.lit("?")), F.when(extra != "", F.concat(F.lit(" ("), extra, F.lit(")"))).otherwise(""))

    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return F.concat(
        F.lit("### "), "id", F.lit(" — "), text("title"), F.lit("\n"), label("Catégorie", F.col("category")), label("Priorité", F.col("priority")), label("Localisation source", F.col("source_location")), F.lit("\n"),
        F.when(text("description") != "", F.concat("description", F.lit("\n\n"))).otherwise(""),
        F.when(text("verdict") != "", F.concat(F.lit("> **Verdict** — "), "verdict", F.lit("\n\n"))).otherwise(""),
        block("Critères d'acceptation", F.col("acceptance_criteria"), bullet), block("Preuves", F.col("evidence"), bullet), block("Sources retrouvées", F.col("sources"), source), F.lit("---\n"),
    )


def report_markdown(requirements: DataFrame, made_at: str = "") -> DataFrame:
    """analysis_id and the report of each: its counts, then its requirements by status in the fixed order.

    ``requirements`` has filename and, besides texts, the arrays acceptance_criteria, evidence and sources
    (source, page, score).  Statuses other than the four count in the total but aren't shown.
    """
    status = F.lower(F.coalesce("status", F.lit("")))
    entries = requirements.select("analysis_id", "filename", "id", status.alias("status"), _entry().alias("entry"))
    ordered = lambda s: F.array_sort(F.collect_list(F.when(F.col("status") == s, F.struct("id", "entry"))))
    gathered = entries.groupBy("analysis_id").agg(F.max("filename").alias("filename"), F.count("*").alias("total"), *(ordered(s).alias(s) for s in GROUPS))
    share = F.round(100 * (F.size("covered") + 0.5 * F.size("partial")) / F.col("total"), 1)
    rows = [F.concat(F.lit(f"| {label} | "), F.size(s).cast("string"), F.lit(" |\n")) for s, label in SUMMARY.items()]
    table = F.concat(F.lit("## Synthèse\n\n| Indicateur | Valeur |\n|---|---|\n| Total exigences | "), F.col("total").cast("string"), F.lit(" |\n"), *rows, F.lit("| **Couverture** | **"), F.format_string("%.1f", share), F.lit("%** |\n\n"))
    groups = [F.when(F.size(s) > 0, F.concat(F.lit(f"## {head} ("), F.size(s).cast("string"), F.lit(")\n\n"), _joined(F.transform(s, lambda e: F.concat(e["entry"], F.lit("\n"))), ""))).otherwise("") for s, head in GROUPS.items()]
    head = F.concat(F.lit("# Analyse de cahier des charges — "), F.coalesce("filename", F.lit("")), F.lit(f"\n\n_Généré le {made_at}_\n\n"))
    return gathered.select("analysis_id", F.regexp_replace(F.concat(head, table, *groups), "\\n\\z", "").alias("markdown"))


def flat_export(requirements: DataFrame) -> DataFrame:
    """analysis_id and the eleven columns of FLAT: criteria and evidence a line each, sources as ``src (p.X)``."""
    cited = lambda s: F.concat(F.coalesce(F.nullif(s["source"], F.lit("")), F.lit("?")), F.when(s["page"].isNotNull(), F.concat(F.lit(" (p."), s["page"].cast("string"), F.lit(")"))).otherwise(""))
    label = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in STATUS_LABEL.items() for x in pair)), F.lower("status")), F.lower("status"))
    bulleted = lambda c, mark: _joined(F.transform(c, lambda x: F.concat(F.lit(mark), x)))
    values = [F.col("id"), F.col("title"), F.col("category"), F.col("priority"), label, F.col("verdict"), F.col("description"), bulleted("acceptance_criteria", "• "), F.col("source_location"), strip(bulleted("evidence", "— ")), _joined(F.transform("sources", cited), "; ")]
    return requirements.select("analysis_id", *(F.coalesce(c, F.lit("")).alias(name) for name, c in zip(FLAT, values, strict=True)))
