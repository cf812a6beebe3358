"""Readers of articles, chunk and entity files, URL lists, PDFs and logs, with fixed schemas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from lodestone.functions.text import pdf_clean, word_count
from lodestone.plans.arrow import ship
from lodestone.sources import pdf

ARTICLE = "url string, title string, content string, date string, excerpt string, scraped_at string, word_count int"
CLEANED = ARTICLE + ", source_file string, cleaned_word_count int, cleaning_metadata struct<cleaned_at: string, original_word_count: int, cleaned_word_count: int, reduction_percentage: double>"
PDF_ARTICLE = "title string, content string, url string, source string, filename string, metadata string, scraped_at string, word_count int, char_count int"
ENTITY = "struct<text: string, label: string, start: int, end: int, confidence: double, variants: array<string>>"
CHUNK_ENTITIES = f"chunk_entities array<struct<chunk_id: bigint, source_title: string, source_url: string, source_date: string, chunk_position: string, entities: array<{ENTITY}>>>"
CHUNK = "struct<text: string, word_count: int, chunk_id: int, global_chunk_id: bigint, source_url: string, source_title: string, source_date: string, chunk_position: string, preceding_context: string, following_context: string>"
DOWNLOAD_LOG = "url string, pdf_url string, filename string, status string, timestamp string"


def _json(spark: SparkSession, paths: str | Sequence[str], schema: str) -> DataFrame:
    """JSON files, one document each; what does not parse is left out."""
    read = spark.read.schema(schema + ", _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE")
    rows = read.option("pathGlobFilter", "*.json").json(paths if isinstance(paths, str) else list(paths))
    named = rows.select("*", F.col("_metadata.file_name").alias("file_name"))
    return named.filter("_corrupt_record is null").drop("_corrupt_record")


def articles(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Scraped articles with ``file_name``, the raw ``date`` and ``published`` parsed from it."""
    rows = _json(spark, paths, ARTICLE)
    return rows.withColumn("published", F.try_to_timestamp("date"))


def cleaned_articles(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return _json(spark, paths, CLEANED)


def pdf_articles(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return _json(spark, paths, PDF_ARTICLE)


def chunks(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """The chunks of chunk files, one row each."""
    return _json(spark, paths, f"chunks array<{CHUNK}>").select(F.explode("chunks").alias("c")).select("c.*")


def chunk_entities(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """The mentions of entity files, one row each, with their chunk's fields."""
    each = _json(spark, paths, CHUNK_ENTITIES).select(F.explode("chunk_entities").alias("c"))
    return each.select("c.chunk_id", "c.source_title", "c.source_url", "c.source_date", "c.chunk_position", F.explode("c.entities").alias("e")).select("*", "e.*").drop("e")


def download_log(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return _json(spark, paths, DOWNLOAD_LOG)


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """The URLs of a text file, one a line; blank lines and those after ``#`` are left out."""
    line = F.trim("value").alias("url")
    return spark.read.text(path).select(line).filter((F.col("url") != "") & ~F.col("url").startswith("#"))


def pdf_id(filename: Column) -> Column:
    """struct(kind, value) of an identifier in a file name: PubMed, PMC or DOI; null without."""
    stem = F.regexp_replace(filename, r"(?i)\.pdf$", "")
    kind = F.regexp_extract(stem, r"^(pubmed|pmc|doi)_(.*)$", 1)
    value = F.regexp_extract(stem, r"^(pubmed|pmc|doi)_(.*)$", 2)
    value = F.when(kind == "doi", F.replace(value, F.lit("_"), F.lit("/"))).otherwise(value)
    return F.when(kind != "", F.struct(kind.alias("kind"), value.alias("value")))


_PDF = StructType([StructField("page_count", IntegerType()), *(StructField(x, StringType()) for x in (*pdf.INFO, "text", "error"))])


@F.pandas_udf(_PDF)
def _read_pdf(content: pd.Series) -> pd.DataFrame:
    rows = []
    for data in content:
        try:
            found = pdf.read(bytes(data) if data is not None else b"")
            rows.append((found.pages, *(found.info.get(x) for x in pdf.INFO), found.text, None))
        except ValueError as problem:
            rows.append((None, *(None for _ in pdf.INFO), None, str(problem)))
    return pd.DataFrame(rows, columns=_PDF.names)


def pdfs(spark: SparkSession, path: str, extract=None) -> DataFrame:
    """Files with ``is_pdf`` by their first bytes, identifier, page count, document information,
    what kept them from being read, and cleaned text.

    :mod:`pdf` reads plain files; ``extract``, a function of a binary column, may give the text
    of others.  What is text under the name of a PDF is taken as it is if it is long enough.
    """
    ship(spark)
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    plain = F.try_validate_utf8(F.col("content").cast("string"))
    is_pdf = F.substring(F.col("content"), 1, 5) == F.lit(b"%PDF-")
    read = files.withColumn("is_pdf", is_pdf).withColumn("p", _read_pdf("content"))
    text = extract(F.col("content")) if extract else F.col("p.text")
    body = F.when(F.col("is_pdf"), text).when(F.length(plain) > 100, plain)
    told = read.select(
        name.alias("filename"), F.col("length").alias("file_size"), "is_pdf", pdf_id(name).alias("identifier"), "p.page_count",
        *(f"p.{x}" for x in pdf.INFO), "p.error", F.when(body.isNotNull(), pdf_clean(body)).alias("content"),
    )
    return told.withColumn("word_count", word_count(F.col("content"))).withColumn("char_count", F.coalesce(F.length("content"), F.lit(0)))


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """``(term, label)`` of JSON files that map each label to its terms; blank terms are left out."""
    rows = spark.read.option("wholetext", True).text(path).select(F.from_json("value", "map<string, array<string>>").alias("m"))
    each = rows.select(F.explode("m").alias("label", "terms")).select(F.explode("terms").alias("term"), "label")
    return each.filter(F.trim("term") != "").distinct()


def graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges that :func:`writers.write_graph` wrote."""
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def union_sources(sources: Mapping[str, DataFrame]) -> DataFrame:
    """All rows of several sources with ``source_type``; columns that one lacks are null."""
    out = None
    for kind, rows in sources.items():
        tagged = rows.withColumn("source_type", F.lit(kind))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sources")
    return out


def new_rows(found: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not known yet, one for each key; null keys are left out."""
    return found.filter(F.col(key).isNotNull()).join(known.select(key), key, "left_anti").dropDuplicates([key])
