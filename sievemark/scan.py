"""Entry points: a folder of files, or relations, to findings and reports.

scan_articles() screens article XML, operators.templates.screen() the logs of a process by their domain.
scan_folder() reads what it knows (CSV, TSV, Excel, Word old and new, PDF, archives of figures, pictures),
turns it into the detectors' relations, and runs every registered detector that applies. Files are read
in the executors, one at a time; their contents don't pass the driver.
"""

from __future__ import annotations

import csv
import io
import os
from collections.abc import Iterable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.operators import images, registry
from sievemark.sources import compound, documents, excel, pdf
from sievemark.sources.tables import MISSING


def _delimited(content: bytes) -> Iterator[tuple]:
    """Cells of a CSV or TSV file, which its first line tells apart."""
    text = content.decode("utf-8-sig", "replace")
    first = text.partition("\n")[0]
    rows = list(csv.reader(io.StringIO(text), delimiter="\t" if first.count("\t") > first.count(",") else ","))
    if rows:
        titles = documents.header(rows[0])
        for i, r in enumerate(rows[1:]):
            yield from (("", i, name, value.strip()) for name, value in zip(titles, r, strict=False) if value.strip() not in MISSING)


def delimited_cells(rows: DataFrame) -> DataFrame:
    """path, sheet, row_id, col and text of the filled cells of CSV and TSV files."""
    return documents.parsed(rows, _delimited, "sheet string, row_id long, col string, text string")


def numeric_cells(cells: DataFrame) -> DataFrame:
    """cells(file_id, col, row_id, val) of cells (path, sheet, row_id, col, text), of the columns in which every filled cell is a number."""
    number = F.when(F.col("text").rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), F.col("text").try_cast("double"))
    rows = cells.select("path", F.concat_ws("!", F.nullif("sheet", F.lit("")), "col").alias("col"), "row_id", number.alias("val"))
    whole = rows.groupBy("path", "col").agg(F.bool_and(F.col("val").isNotNull()).alias("numeric")).where("numeric").select("path", "col")
    return rows.join(whole, ["path", "col"]).select(F.col("path").alias("file_id"), "col", "row_id", "val")


def figures(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, kind and picture of the figures in a folder's documents and archives, and of its picture files."""
    of = lambda pattern: documents.files(spark, folder, pattern, recursive=True)
    loose = of("*.{" + ",".join(e[1:] for e in documents.ENDINGS) + "}").select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.lit("").alias("kind"), F.col("content").alias("picture"))
    return reduce(DataFrame.unionByName, [documents.docx_pictures(of("*.docx")), pdf.pdf_pictures(of("*.pdf")), compound.doc_pictures(of("*.{doc,docb}")), documents.archive_pictures(of("*.{tar.gz,tgz}")), loose])


def relations(spark: SparkSession, folder: str, year: int | None = None, authors: Iterable[str] = (), image_store: DataFrame | None = None, pictures: bool = True) -> dict[str, DataFrame]:
    """The detectors' relations of the files in a folder; a paper's year and authors are told, where known."""
    of = lambda pattern: documents.files(spark, folder, pattern, recursive=True)
    tables = documents.docx_tables(of("*.docx")).select("path", F.concat(F.lit("table "), F.col("table").cast("string")).alias("sheet"), "row_id", "col", F.regexp_replace("text", ",", "").alias("text"))
    sheets = excel.excel_cells(of("*.{xlsx,xlsm}")).where("at is null").select("path", "sheet", "row_id", "col", "text")
    cells = numeric_cells(reduce(DataFrame.unionByName, [delimited_cells(of("*.{csv,tsv}")), sheets, tables.where(~F.trim("text").isin(*MISSING))]))
    plain = documents.files(spark, folder, "*.txt", recursive=True).select("path", F.decode("content", "utf-8").alias("text"))
    texts = reduce(DataFrame.unionByName, [documents.docx_text(of("*.docx")), pdf.pdf_text(of("*.pdf")), compound.doc_text(of("*.{doc,docb}")), plain]).select(F.col("path").alias("doc_id"), "text").where("trim(text) <> ''")
    no = F.lit(False)
    dated = texts.withColumns({"paper_year": F.lit(year).cast("int"), "is_clinical_trial": no, "is_human_subjects": no, "is_animal_study": no})
    printed = pdf.pdf_metadata(of("*.pdf")).select("path", F.coalesce("creator", "author").alias("creator"), "created", F.lit(None).cast("int").alias("revision"))
    meta = documents.office_metadata(of("*.{docx,xlsx,xlsm}")).select("path", "creator", "created", "revision").unionByName(printed)
    files = meta.select(F.col("path").alias("file_id"), "creator", "created", "revision", F.array(*[F.lit(a) for a in authors]).cast("array<string>").alias("authors"), F.lit(None).cast("timestamp").alias("claimed_start"))
    out = {"cells": cells, "texts": texts, "dated_texts": dated, "files": files, "revisions": documents.docx_rsids(of("*.docx"))}
    if pictures:
        found = figures(spark, folder)
        named = found.select("path", F.concat_ws("!", "path", "name").alias("image_id"), "picture")
        decoded = images.decoded(named.select(F.col("image_id").alias("origin"), "picture"))
        prints = images.hashed(decoded).withColumnRenamed("origin", "image_id").join(named.select("image_id", F.col("path").alias("doc_id")), "image_id")
        out["images"] = prints.withColumn("authors", F.lit("; ".join(authors)))
        out["pictures"] = decoded
        marks = documents.exif(named.select(F.col("image_id").alias("path"), F.col("picture").alias("content")))
        out["photos"] = marks.join(named.select(F.col("image_id").alias("path"), F.col("path").alias("doc_id")), "path").select("doc_id", F.col("path").alias("image_id"), "model", "shot")
    if image_store is not None:
        out["image_store"] = image_store
    return out


def scan_folder(spark: SparkSession, folder: str, ids: Iterable[str] | None = None, clusters: Iterable[str] | None = None, **known) -> DataFrame:
    """All findings of the files in a folder: doc_key, finding_id, detector_id, summary, p_value, severity."""
    have = relations(spark, folder, **known)
    return registry.scan(have, registry.select(ids, clusters, have))


def scan_articles(articles: DataFrame, ids: Iterable[str] | None = None) -> DataFrame:
    """Findings of the text detectors on article XML (doc_id, xml, paper_year): tags are taken off before any rule reads it."""
    texts = articles.select(F.col("doc_id").cast("string").alias("doc_id"), documents.jats(F.col("xml"))["full_text"].alias("text"), F.col("paper_year").cast("int").alias("paper_year"))
    no = F.lit(False)
    have = {"texts": texts.drop("paper_year"), "dated_texts": texts.withColumns({"is_clinical_trial": no, "is_human_subjects": no, "is_animal_study": no})}
    return registry.scan(have, registry.select(ids, have=have))


def batch(spark: SparkSession, folder: str, out: str, **known) -> DataFrame:
    """scan_folder() written under out (findings and reports); returns the reports: counts, clusters, overall severity, score and summary of each file with a finding."""
    scan_folder(spark, folder, **known).write.parquet(os.path.join(out, "findings"))
    registry.reports(spark.read.parquet(os.path.join(out, "findings"))).write.parquet(os.path.join(out, "reports"))
    return spark.read.parquet(os.path.join(out, "reports"))
