"""Distributed loading of files: one scan for each extension, parsed in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.runtime import ship
from quillspark.sources import office

Parser = Callable[[bytes], dict]
SCHEMA = "source_path string, content string, title string, author string, modified string, error string"


def read_text(data: bytes) -> dict:
    text = data.decode("utf-8-sig", "replace")
    head = re.search(r"^#{1,6}\s+(.+)$", text, re.M)
    return {"content": text, "title": head[1].strip() if head else None, "author": None, "modified": None}


def read_pdf(data: bytes) -> dict:
    raise NotImplementedError("no PDF library is installed; register a parser for .pdf")


#: Parser by extension; a later registration replaces an earlier one.
PARSERS: dict[str, Parser] = {".docx": office.read_docx, ".xlsx": office.read_xlsx, ".md": read_text, ".txt": read_text, ".pdf": read_pdf}


def register(extension: str, parser: Parser) -> None:
    PARSERS[extension.lower()] = parser


def parse_binary(files: DataFrame, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """Contents of ``(path, content)`` rows. An error is a value of its row (``kind: message``), not of the job."""
    ship(files.sparkSession)
    table = dict(parsers or PARSERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"]):
                ext = re.search(r"\.[^./]+$", path or "")
                parser = table.get(ext[0].lower()) if ext else None
                try:
                    if parser is None:
                        raise NotImplementedError(f"no parser for {ext[0] if ext else 'files without extension'}")
                    d = parser(bytes(data))
                    rows.append((path, d["content"], d["title"] or re.sub(r".*/|\.[^./]+$", "", path), d["author"], d["modified"], None))
                except (ValueError, RuntimeError) as e:
                    kind = {"InvalidDocument": "invalid", "EmptyDocument": "empty", "NotImplementedError": "unsupported"}.get(type(e).__name__, "invalid")
                    rows.append((path, None, None, None, None, f"{kind}: {e}"))
            yield pd.DataFrame(rows, columns=["source_path", "content", "title", "author", "modified", "error"])

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def load(spark: SparkSession, folder: str, extensions: list[str] | None = None) -> DataFrame:
    """All files under ``folder`` of the given (or all known) extensions."""
    known = extensions or list(PARSERS)
    pattern = "*{" + ",".join(known) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return parse_binary(files.select("path", "content"))


def with_metadata(documents: DataFrame) -> DataFrame:
    """Derived metadata: id from the file name, silo from its folder, type from the title's words."""
    name = F.regexp_extract("source_path", r"([^/]+?)(?:\.[^./]+)?$", 1)
    silo = F.coalesce(F.nullif(F.regexp_extract("source_path", r"([^/]+)/[^/]+$", 1), F.lit("")), F.lit("default"))
    title = F.lower("title")
    kind = F.when(title.rlike("policy|полит"), "Policy").when(title.rlike("contract|agreement|договор"), "Contract").when(title.rlike("report|отч"), "Report").otherwise("Document")
    return documents.withColumns({"id": name, "silo": silo, "document_type": kind})
