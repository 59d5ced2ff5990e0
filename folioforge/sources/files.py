"""File sources: text with a fallback encoding, PDF by a provider, and request files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import analysis
from folioforge.sources import pdf


def binary(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)


def decoded(content: Column) -> Column:
    """UTF-8, or Latin-1 where the bytes aren't UTF-8."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """path, text, status of the supported text files; a file of white space only is an error."""
    rows = binary(spark, folder).where(analysis.extension(F.col("path")).isin(*(e for e in analysis.SUPPORTED if e != ".pdf")))
    utf8 = F.is_valid_utf8(F.col("content").cast("string"))
    text = decoded(F.col("content"))
    empty = utf8 & (F.regexp_replace(text, r"(?U)\s+", "") == "")
    return rows.select("path", F.when(~empty, text).alias("text"), F.when(empty, "error").otherwise("success").alias("status"))


PageReader = Callable[[bytes], list[str]]


def pdf_texts(rows: DataFrame, pages: PageReader = pdf.pages, numbered: bool = False) -> DataFrame:
    """path, text, status of rows of path and content: page texts joined by blank lines,
    blank pages left out (but counted by page marks); a file without text, or that can't
    be read, is an error."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for content in b["content"]:
                found = [(i, p) for i, p in enumerate(pages(bytes(content)), 1) if p.strip()]
                out.append("\n\n".join(f"[Page {i}]\n{p}" if numbered else p for i, p in found))
            yield pd.DataFrame({"path": b["path"], "text": out})

    found = rows.select("path", "content").mapInPandas(read, "path string, text string")
    return found.select("path", F.when(F.col("text") != "", F.col("text")).alias("text"), F.when(F.col("text") != "", "success").otherwise("error").alias("status"))


def pdf_pages(rows: DataFrame) -> DataFrame:
    """path, page (from 1) and text of each page of rows of path and content, handed on page
    by page, so that a long file isn't one value."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                for i, p in enumerate(pdf.each_page(bytes(content or b"")), 1):
                    yield pd.DataFrame({"path": [path], "page": [i], "text": [p]})

    return rows.select("path", "content").mapInPandas(read, "path string, page int, text string")


def pdfs(spark: SparkSession, folder: str, pages: PageReader = pdf.pages, numbered: bool = False) -> DataFrame:
    """The texts of a folder's PDF files."""
    return pdf_texts(binary(spark, folder).where(analysis.extension(F.col("path")) == ".pdf"), pages, numbered)


def pdf_metadata(rows: DataFrame) -> DataFrame:
    """title (by default the file's stem) and author of raw info maps (path, info)."""
    stem = F.regexp_replace(analysis.file_name(F.col("path")), r"\.[^./]+$", "")
    get = lambda k: F.nullif(F.trim(F.try_element_at("info", F.lit(k))), F.lit(""))
    return rows.select("path", F.coalesce(get("title"), stem).alias("title"), F.coalesce(get("author"), F.lit("Unknown")).alias("author"), *(get(k).alias(k) for k in ("subject", "creator", "producer", "date")))
