"""Uploaded files as pages: validation, DOCX parsing with the standard library, and parsers that callers plug in for other formats."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_BYTES, EXTENSIONS, PARAGRAPHS_PER_PAGE = 20 * 1024 * 1024, ["pdf", "docx"], 40
PAGES = "doc_id string, page_number int, source string, text string, error string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content) of all files under a path that Spark can read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def validate(files: DataFrame) -> DataFrame:
    """files (path, length) with accepted and the HTTP status a refusal has: 415 for other endings, 413 over 20 MB, 422 for empty files."""
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    status = F.when(~ending.isin(EXTENSIONS), 415).when(F.col("length") > MAX_BYTES, 413).when(F.col("length") == 0, 422).otherwise(200)
    return files.withColumn("status", status).withColumn("accepted", F.col("status") == 200)


def docx_parts(data: bytes) -> tuple[list[str], list[str]]:
    """Paragraphs of the body that aren't blank, and each table's rows as lines of cells joined by bars."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    said = lambda p: "".join("\t" if e.tag == f"{_W}tab" else "\n" if e.tag in (f"{_W}br", f"{_W}cr") else e.text or "" for e in p.iter() if e.tag in (f"{_W}t", f"{_W}tab", f"{_W}br", f"{_W}cr"))
    paragraphs = [t for p in body.findall(f"{_W}p") if (t := said(p).strip())]
    tables = []
    for table in body.findall(f"{_W}tbl"):
        rows = [" | ".join(c) for r in table.findall(f"{_W}tr") if (c := [t for cell in r.findall(f"{_W}tc") if (t := "\n".join(said(p) for p in cell.findall(f"{_W}p")).strip())])]
        if rows:
            tables.append("\n".join(rows))
    return paragraphs, tables


def docx_pages(data: bytes) -> list[str]:
    """Pages of forty paragraphs, then one for each table."""
    paragraphs, tables = docx_parts(data)
    return ["\n\n".join(paragraphs[i : i + PARAGRAPHS_PER_PAGE]) for i in range(0, len(paragraphs), PARAGRAPHS_PER_PAGE)] + tables


def parse(files: DataFrame, parsers: dict[str, Callable[[bytes], list[str]]] | None = None, ocr: Callable[[bytes, int], str] | None = None) -> DataFrame:
    """Pages (doc_id, page_number, source, text, error) of files (path, content). DOCX is built in; a PDF parser is given as parsers={'pdf': ...}.

    A page without text is given to `ocr` if there is one, whose failure counts as no text; blank pages are left out. A file that can't be parsed,
    or of an unknown kind, is one row with an error: other files go on.
    """
    known = {"docx": docx_pages, **(parsers or {})}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, data in zip(frame["path"], frame["content"], strict=True):
                source = path.rsplit("/", 1)[-1]
                kind = source.rsplit(".", 1)[-1].lower()
                try:
                    if kind not in known:
                        raise ValueError(f"unsupported type: {kind}")
                    for n, text in enumerate(known[kind](bytes(data)), 1):
                        if not text.strip() and ocr:
                            try:
                                text = ocr(bytes(data), n)
                            except Exception:
                                text = ""
                        if text.strip():
                            rows.append((path, n, source, text, None))
                except Exception as e:
                    rows.append((path, None, source, None, str(e)))
            yield pd.DataFrame(rows, columns=["doc_id", "page_number", "source", "text", "error"]).astype({"page_number": "Int32"})

    return files.select("path", "content").mapInPandas(run, PAGES)


def group_paragraphs(paragraphs: DataFrame, size: int = PARAGRAPHS_PER_PAGE) -> DataFrame:
    """Pages from paragraphs (doc_id, position, text): blank ones dropped, `size` to a page, joined by an empty line."""
    kept = paragraphs.withColumn("text", F.regexp_replace("text", r"(?U)^\s+|\s+$", "")).filter("text <> ''")
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("position"))
    paged = kept.withColumn("page_number", F.ceil(n / size).cast("int"))
    return paged.groupBy("doc_id", "page_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda s: s["text"]), "\n\n").alias("text"))
