"""Sinks: documents as JSON, text and Markdown; indexes as CSV. Nothing is overwritten unless asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_documents(docs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    docs.write.mode(mode).json(path)


def texts(pages: DataFrame, path: str, column: str, by: str | None = None, mode: str = "errorifexists") -> None:
    """A text column as files, in a folder per value of `by`."""
    d = pages.select(*([by] if by else []), F.col(column).alias("value"))
    (d.write.partitionBy(by) if by else d.write).mode(mode).text(path)


def csv_index(rows: DataFrame, path: str, columns: list[str] = ["image_path", "text", "language", "split"], mode: str = "errorifexists") -> None:  # noqa: B006
    rows.select(*columns).write.mode(mode).csv(path, header=True, escape='"', quoteAll=False)


def pages(regions: DataFrame, path: str, formats: list[str], doc: str = "doc_id", page: str = "page_index", key: str = "region_id", mode: str = "errorifexists") -> None:
    """Pages in each of the formats json, markdown and text, one folder a format with one a document below it. Any other format raises before anything is written."""
    from ..operators import compose

    make = {"json": lambda: compose.pages_nested(regions, doc, page), "markdown": lambda: compose.markdown(regions, [doc, page], key), "text": lambda: compose.page_text(regions, [doc, page], key)}
    if set(formats) - set(make):
        raise ValueError(f"no such format: {sorted(set(formats) - set(make))}")
    for f in formats:
        make[f]().write.partitionBy(doc).mode(mode).json(f"{path}/{f}")
