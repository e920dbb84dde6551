"""Document sources: each gives doc_id, title, text, url."""

from __future__ import annotations

import io
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import clean_text, normalize_text, page_url

from .byte_ranges import read_range  # noqa: F401

WIKI_URL = "https://en.wikipedia.org/wiki/"
TEXT_SUFFIXES, HTML_SUFFIXES, PDF_SUFFIXES, IMAGE_SUFFIXES = (".txt", ".md", ".markdown", ".rst"), (".html", ".htm"), (".pdf",), (".png", ".jpg", ".jpeg", ".gif", ".webp")
# Elements whose content is no text, and elements that stand on lines of their own.
SILENT = frozenset({"script", "style", "noscript", "head"})
BLOCKS = frozenset("p div br li tr h1 h2 h3 h4 h5 h6 blockquote section article".split())


def read_wiki_xml(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a wiki dump, also compressed; the schema is declared, since inference reads titles as times."""
    schema = "title string, id string, revision struct<text:string>"
    pages = spark.read.format("xml").option("rowTag", "page").option("ignoreNamespace", True).schema(schema).load(path)
    return pages.where(F.col("id").try_cast("long").isNotNull()).select(F.col("id").cast("long").alias("doc_id"), "title", clean_text("revision.text").alias("text"), page_url(WIKI_URL, "title").alias("url"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with text, numbered from 1 in the order of the file; empty ones take no number.

    Rows before a partition are counted first, so that no partition waits for another.
    """
    placed = rows.where(F.coalesce("text", F.lit("")) != "").withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy("_at"))
    out = placed.withColumn("_nth", nth).join(before, "_part").withColumn("doc_id", (F.col("_before") + F.col("_nth")).cast("bigint"))
    return out.select("doc_id", F.coalesce("title", F.concat(F.lit("Document "), F.col("doc_id").cast("string"))).alias("title"), "text", F.coalesce("url", F.concat(F.lit("doc://"), F.col("doc_id").cast("string"))).alias("url"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return _numbered(_fields(rows))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """One array of objects."""
    return _numbered(_fields(spark.read.schema("title string, text string, url string").json(path, multiLine=True)))


def _fields(rows: DataFrame) -> DataFrame:
    return rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).cast("string").alias(c) for c in ("title", "text", "url")))


def read_passages_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Lines of id, tab, passage; quotes are text here, so it is no CSV. Ids are numbers if all of them are, else text."""
    parts = spark.read.text(path).select(F.split(F.btrim(F.col("value"), F.lit(" \t\r\n")), "\t").alias("p")).where(F.size("p") >= 2)
    said = F.col("p")[0]
    numbers = parts.agg(F.every(said.try_cast("long").isNotNull())).first()[0]
    doc_id = said.cast("long") if numbers else said
    return parts.select(doc_id.alias("doc_id"), F.concat(F.lit("Passage "), said).alias("title"), F.col("p")[1].alias("text"), F.concat(F.lit("msmarco://"), said).alias("url"))


def read_text_folder(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".txt",)) -> DataFrame:
    """Whole files as documents in the order of their paths."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("url"), F.col("_metadata.file_name").alias("title"), F.col("value").alias("text"))
    wanted = F.exists(F.array(*(F.lit(s) for s in suffixes)), lambda s: F.endswith(F.lower("title"), s))
    return rows.where(wanted).select(F.xxhash64("url").alias("doc_id"), "title", "text", "url")


class Lines(HTMLParser):
    """Collects the visible text of a page; block elements stand on lines of their own.

    depth counts the silent elements around a place; an end without a start is nothing.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text, self.depth = io.StringIO(), 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._edge(tag)
        self.depth += tag in SILENT

    def handle_endtag(self, tag: str) -> None:
        self._edge(tag)
        self.depth -= tag in SILENT and self.depth > 0

    def _edge(self, tag: str) -> None:
        if tag in BLOCKS:
            self.text.write("\n")

    def handle_data(self, data: str) -> None:
        if not self.depth:
            self.text.write(data)


def html_to_text(html: str) -> str:
    lines = Lines()
    lines.feed(html or "")
    lines.close()
    return lines.text.getvalue()


def html_text(c: Column | str) -> Column:
    """The text of a page, its white space made plain; a tag parser in batches, as patterns lose text."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(html_to_text)

    return normalize_text(run(c))


def read_html(spark: SparkSession, path: str) -> DataFrame:
    rows = read_text_folder(spark, path, HTML_SUFFIXES)
    return rows.withColumn("text", html_text("text"))


def read_markup_free(spark: SparkSession, path: str) -> DataFrame:
    """Plain text and markdown files, normalised."""
    return read_text_folder(spark, path, TEXT_SUFFIXES).withColumn("text", normalize_text("text"))


def read_binary(spark: SparkSession, path: str, convert: Callable[[bytes, str], str]) -> DataFrame:
    rows = spark.read.format("binaryFile").load(path)

    @F.pandas_udf("string")
    def run(content: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([convert(c, n) for c, n in zip(content, name, strict=True)])

    title = F.element_at(F.split("path", "/"), -1)
    return rows.select(F.xxhash64("path").alias("doc_id"), title.alias("title"), run("content", title).alias("text"), F.col("path").alias("url"))


def pdf_to_text(content: bytes, name: str) -> str:
    from pypdf import PdfReader

    return "\n\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages)


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    import pypdf  # noqa: F401  without it, this source is not there

    return read_binary(spark, path, pdf_to_text).withColumn("text", normalize_text("text"))


def read_images(spark: SparkSession, path: str, describe: Callable[[bytes, str], str] | None = None) -> DataFrame:
    """Descriptions by a vision model; without one, the name of the file."""
    return read_binary(spark, path, describe or (lambda content, name: f"Image file: {name}"))


READERS = {"wiki": read_wiki_xml, "csv": read_csv, "json": read_json, "msmarco": read_passages_tsv, "text": read_text_folder, "plain": read_markup_free, "html": read_html, "pdf": read_pdf, "image": read_images}


def detect(path: str) -> str:
    """Kind of source by the path's ending; loaders of single files come first, a path without ending is a folder."""
    low = path.lower().removesuffix(".bz2")
    kinds = [(TEXT_SUFFIXES, "plain"), (HTML_SUFFIXES, "html"), (PDF_SUFFIXES, "pdf"), (IMAGE_SUFFIXES, "image"), ((".xml",), "wiki"), ((".csv",), "csv"), ((".json",), "json"), ((".tsv",), "msmarco")]
    for suffixes, kind in kinds:
        if low.endswith(suffixes):
            return kind
    if "." in low.rsplit("/", 1)[-1]:
        raise ValueError(f"no reader for {path}")
    return "text"


def read_documents(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    return READERS[kind or detect(path)](spark, path)
