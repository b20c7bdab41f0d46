"""Region, page and document text, Markdown and the nested document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .layout import FURNITURE


def _blank(c: Column) -> Column:
    return c.isNull() | ~F.coalesce(c.rlike(r"(?U)\S"), F.lit(False))


def region_text(lines: DataFrame, by: list[str], order: str = "line_no", key: str = "textline_id") -> DataFrame:
    """Per region its non-blank lines joined by line breaks, and the mean of the known confidences (null if none). A region's lines are what is gathered."""
    item = F.when(~_blank(F.col("text")), F.struct(F.col(order).alias("o"), F.col(key).alias("k"), F.col("text").alias("t")))
    return lines.groupBy(*by).agg(strip(_join_agg(item, "\n")).alias("text"), F.avg("confidence").alias("recognition_confidence"), F.count("*").alias("n_lines"))


def _join_agg(item: Column, sep: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), sep)


def table_text(cells: DataFrame, by: list[str]) -> DataFrame:
    """Cells of (row, col, text): columns joined by " | ", rows by line breaks."""
    rows = cells.groupBy(*by, "row").agg(_join_agg(F.struct(F.col("col").alias("o"), F.coalesce("text", F.lit("")).alias("t")), " | ").alias("_line"))
    return rows.groupBy(*by).agg(strip(_join_agg(F.struct(F.col("row").alias("o"), F.col("_line").alias("t")), "\n")).alias("text"))


def reading_key(*more: str) -> list[Column]:
    """Regions without an order come last; then order, y1, x1 and the given keys."""
    return [(F.col("reading_order") < 0).cast("int").alias("k0"), F.col("reading_order").alias("k1"), F.col("y1").alias("k2"), F.col("x1").alias("k3"), *[F.col(c).alias(f"k_{c}") for c in more]]


def page_text(regions: DataFrame, page: list[str], key: str = "region_id", furniture: bool = False) -> DataFrame:
    """Texts of a page's regions in reading order, parted by blank lines; blank ones, and furniture unless asked for, are left out. Pages without text come out empty."""
    use = ~_blank(F.col("text"))
    if not furniture:
        use = use & ~F.coalesce(F.col("type").isin(*FURNITURE), F.lit(False))
    item = F.when(use, F.struct(*reading_key(key), F.col("text").alias("t")))
    return regions.groupBy(*page).agg(_join_agg(item, "\n\n").alias("text"))


def markdown(regions: DataFrame, page: list[str], key: str = "region_id") -> DataFrame:
    """A page in Markdown: titles, lists, tables as code or pipes, captions in italics."""
    items = F.array_join(F.transform(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"(?U)\S")), lambda x: F.concat(F.lit("- "), x)), "\n\n")
    body = F.when(F.col("type") == "title", F.concat(F.lit("## "), "text")).when(F.col("type") == "list", items).when(F.col("type") == "table", F.concat(F.lit("```\n"), "text", F.lit("\n```"))).when(F.col("type") == "caption", F.concat(F.lit("*"), "text", F.lit("*"))).otherwise(F.col("text"))
    use = ~_blank(F.col("text")) & ~F.coalesce(F.col("type").isin(*FURNITURE), F.lit(False))
    return regions.groupBy(*page).agg(_join_agg(F.when(use, F.struct(*reading_key(key), body.alias("t"))), "\n\n").alias("markdown"))


def pipe_table(cells: DataFrame, by: list[str]) -> DataFrame:
    """Cells as a Markdown table: pipes escaped, short rows padded, a rule under the first row."""
    t = F.replace(F.coalesce("text", F.lit("")), F.lit("|"), F.lit("\\|"))
    rows = cells.groupBy(*by, "row").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("col").alias("o"), t.alias("t")))), lambda x: x["t"]).alias("_c"))
    g = rows.groupBy(*by).agg(F.max(F.size("_c")).alias("_m"), F.array_sort(F.collect_list(F.struct(F.col("row").alias("o"), F.col("_c").alias("c")))).alias("_r"))
    line = lambda x: F.concat(F.lit("| "), F.array_join(F.concat(x["c"], F.array_repeat(F.lit(""), F.col("_m") - F.size(x["c"]))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit(" --- "), F.col("_m")), "|"), F.lit("|"))
    out = F.transform("_r", line)
    return g.select(*by, F.array_join(F.concat(F.slice(out, 1, 1), F.array(rule), F.slice(out, 2, 1 << 30)), "\n").alias("markdown"))


def pages_nested(regions: DataFrame, doc: str = "doc_id", page: str = "page_index") -> DataFrame:
    """(doc, page, schema_version, regions): each page with its regions in reading order, ready for a JSON sink. A page is the largest thing that is gathered; a document's pages stay rows, as one document may hold a large part of all."""
    skip = {doc, page}
    body = F.struct(*reading_key("region_id"), F.struct(*[c for c in regions.columns if c not in skip]).alias("t"))
    p = regions.groupBy(doc, page).agg(F.transform(F.array_sort(F.collect_list(body)), lambda x: x["t"]).alias("regions"))
    return p.select(doc, page, F.lit("1.0").alias("schema_version"), "regions")


def manifest(regions: DataFrame, doc: str = "doc_id", page: str = "page_index") -> DataFrame:
    """(doc, n_pages, n_regions, first_page, last_page): what belongs to a document whose pages are rows."""
    return regions.groupBy(doc).agg(F.count_distinct(page).alias("n_pages"), F.count("*").alias("n_regions"), F.min(page).alias("first_page"), F.max(page).alias("last_page"))


def region_script(lines: DataFrame, by: list[str]) -> DataFrame:
    """(by, script) of regions: the script of their lines if it is but one, else `mixed`; blank lines count for nothing, null if there are no others."""
    s = lines.filter(~_blank(F.col("text"))).groupBy(*by).agg(F.count_distinct("script").alias("_n"), F.min("script").alias("_s"))
    return lines.select(*by).distinct().join(s, by, "left").select(*by, F.when(F.col("_n") > 1, "mixed").otherwise(F.col("_s")).alias("script"))
