"""Sources: indexes, label files, annotation files, documents, archives."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import nfc, strip


def csv_index(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV of strings with a header; a byte-order mark before the first name goes. Missing `columns` raise."""
    d = spark.read.csv(path, header=True, multiLine=True, escape='"')
    d = d.toDF(*[c.lstrip("﻿").strip() for c in d.columns])
    lack = [c for c in columns or [] if c not in d.columns]
    if lack:
        raise ValueError(f"{path} lacks {lack}")
    return d


def first_column(d: DataFrame, names: list[str], out: str) -> DataFrame:
    """`out` as the first non-null of those columns that there are; null if there are none."""
    have = [F.col(n) for n in names if n in d.columns]
    return d.withColumn(out, F.coalesce(*have) if have else F.lit(None).cast("string"))


def label_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, raw) of layout label files."""
    d = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "raw"))
    return d.filter("trim(raw) <> ''")


def typed_labels(raw: DataFrame) -> DataFrame:
    """Label lines of five fields as numbers; others are passed over."""
    p = F.split(F.trim("raw"), r"\s+")
    d = raw.filter(F.size(p) == 5).select("file", "line_no", p[0].try_cast("int").alias("class_id"), *[p[i + 1].try_cast("double").alias(c) for i, c in enumerate(("cx", "cy", "w", "h"))])
    return d.filter("class_id is not null and cx is not null and cy is not null and w is not null and h is not null")


_COCO = "images array<struct<id: bigint, file_name: string, width: double, height: double, language: string, document_category: string>>, annotations array<struct<image_id: bigint, category_id: bigint, bbox: array<double>>>, categories array<struct<id: bigint, name: string>>"


def coco(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Annotations with image and category names. Image ids are unique within a split only, so the split stays with them."""
    f = spark.read.schema(_COCO).json(path, multiLine=True)
    i = f.select(F.explode("images").alias("i")).select("i.*").withColumnRenamed("id", "image_id")
    a = f.select(F.explode("annotations").alias("a")).select("a.*").filter("image_id is not null")
    c = f.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("category_id"), F.col("c.name").alias("category"))
    box = [F.try_element_at("bbox", F.lit(k + 1)).alias(n) for k, n in enumerate(("x", "y", "bw", "bh"))]
    return a.join(i, "image_id").join(c, "category_id", "left").select(F.lit(split).alias("split"), "image_id", "file_name", "width", "height", "language", "document_category", "category", *box)


def annotation_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, text) of "name<tab>text" or "name text" lines: a tab wins over the first blank; texts are composed, empty ones go."""
    d = spark.read.text(path).select(F.input_file_name().alias("file"), "value")
    tab = F.instr("value", "\t") > 0
    p = F.when(tab, F.split("value", "\t", 2)).otherwise(F.split("value", " ", 2))
    return d.select("file", p[0].alias("name"), nfc(F.trim(F.try_element_at(p, F.lit(2)))).alias("text")).filter("text is not null and text <> ''")


def corpus_lines(spark: SparkSession, path: str, least: int = 5, most: int = 60) -> DataFrame:
    """Distinct lines with white space collapsed, of a length in bounds."""
    t = F.trim(F.regexp_replace("value", r"(?U)\s+", " "))
    return spark.read.text(path).select(t.alias("text")).filter(F.length("text").between(least, most)).distinct()


def documents_json(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Documents as the schema has them, and those that don't fit it."""
    j = F.from_json("value", schema + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    d = spark.read.text(path).filter(F.trim("value") != "").select(j.alias("j"), "value")
    bad = F.col("j._corrupt_record").isNotNull()
    return d.filter(~bad).select("j.*").drop("_corrupt_record"), d.filter(bad).select(F.col("value").alias("_corrupt_record"))


def archive_members(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """(archive, member, content) of tar and zip files, one pass each; `wanted` (name) keeps members by full path or base name.

    Each file is one task's; its members are passed on one by one as they are read, so a task never holds them all.
    """
    f = spark.read.format("binaryFile").load(path).select("path", "content")

    def members(c: bytes) -> Iterator[tuple[str, bytes]]:
        if zipfile.is_zipfile(io.BytesIO(c)):
            with zipfile.ZipFile(io.BytesIO(c)) as z:
                yield from ((n, z.read(n)) for n in z.namelist() if not n.endswith("/"))
        else:
            with tarfile.open(fileobj=io.BytesIO(c)) as t:
                yield from ((m.name, t.extractfile(m).read()) for m in t if m.isfile())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b.path, b.content):
                for name, content in members(c):
                    yield pd.DataFrame({"archive": [p], "member": [name], "content": [content]})

    d = f.mapInPandas(run, "archive string, member string, content binary")
    if wanted is None:
        return d
    base = F.regexp_replace("member", "^.*/", "")
    w = wanted.select(F.col("name").alias("_n")).distinct()
    by_name = d.withColumn("_n", F.explode(F.array_distinct(F.array("member", base))))
    return by_name.join(w, "_n", "left_semi").drop("_n").dropDuplicates(["archive", "member"])


def page_numbers(members: DataFrame) -> DataFrame:
    """Members with the page number their name states; null if none."""
    return members.withColumn("page", F.regexp_extract(F.regexp_replace("member", "^.*/", ""), r"(\d+)(?!.*\d)", 1).try_cast("int"))


def pixels_digest(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def named_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): the base name without its type as the text, for image folders that have no annotation file."""
    f = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"))
    return f.withColumn("text", F.regexp_replace(F.regexp_replace("file", r"^.*/", ""), r"\.[^.]*$", "")).filter("text <> ''")


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """(word): distinct lines, trimmed and composed; blank ones go."""
    return spark.read.text(path).select(nfc(strip(F.col("value"))).alias("word")).filter("word <> ''").distinct()


def annotation_misses(lines: DataFrame, files: DataFrame, name: str = "name") -> DataFrame:
    """(n_lines, n_missing): annotations, and those whose file isn't there. Names are compared without folders."""
    base = lambda c: F.regexp_replace(c, r"^.*[/\\]", "")
    have = files.select(base(F.col("path")).alias("_b")).distinct().withColumn("_ok", F.lit(1))
    return lines.withColumn("_b", base(F.col(name))).join(have, "_b", "left").agg(F.count("*").alias("n_lines"), F.count_if(F.col("_ok").isNull()).alias("n_missing"))


def benchmark(images: DataFrame, texts: DataFrame, manifest: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, image, text) of a benchmark's pages, and (rule, key, detail) of what was left out.

    `images` has path, `texts` path and text. Pages and texts pair by the stem of their names, or by
    `manifest` (image, text, approved): ids there must stand once, and pages that aren't approved are left out.
    """
    stem = lambda c: F.regexp_replace(F.regexp_replace(c, r"^.*[/\\]", ""), r"\.[^.]*$", "")
    i = images.select(stem(F.col("path")).alias("id"), F.col("path").alias("image"))
    t = texts.select(stem(F.col("path")).alias("tid"), strip(F.col("text")).alias("text"))
    gap = lambda d, rule, key, detail: d.select(F.lit(rule).alias("rule"), F.col(key).alias("key"), F.lit(detail).alias("detail"))
    if manifest is None:
        return i.join(t.withColumnRenamed("tid", "id"), "id"), gap(i.join(t, i.id == t.tid, "left_anti"), "has_text", "id", "absent")
    m = manifest.select(stem(F.col("image")).alias("id"), stem(F.col("text")).alias("tid"), F.coalesce("approved", F.lit(False)).alias("approved"))
    twice = m.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
    ok = m.filter("approved").join(twice, "id", "left_anti")
    out = gap(twice, "once_in_manifest", "id", "repeated").unionByName(gap(m.filter("not approved"), "approved", "id", "row")).unionByName(gap(i.join(m, "id", "left_anti"), "in_manifest", "id", "absent")).unionByName(gap(m.join(i, "id", "left_anti"), "has_image", "id", "absent")).unionByName(gap(ok.join(t, "tid", "left_anti"), "has_text", "id", "absent"))
    return i.join(ok, "id").join(t, "tid").select("id", "image", "text"), out


@F.pandas_udf(StringType())
def json_text(s: pd.Series) -> pd.Series:
    """All values of "text" in a JSON of unknown shape, in their order, on lines; what isn't JSON is itself the text. Null stays null."""
    import json

    def one(raw: str | None) -> str | None:
        try:
            todo, out = [json.loads(raw)] if raw and raw.strip() else [], []
        except ValueError:
            return raw
        while todo:
            x = todo.pop()
            if isinstance(x, list):
                todo += x[::-1]
            elif isinstance(x, dict):
                if isinstance(x.get("text"), str) and x["text"]:
                    out.append(x["text"])
                todo += [v for k, v in x.items() if k != "text"][::-1]
        return None if raw is None else "\n".join(out)

    return s.map(one)


def envelope_text(c: Column) -> Column:
    """The first text in a service's answer, wherever its versions put it; empty if there is none."""
    ways = [f"$.{node}[0].output[0].{f}" for node in ("pipelineResponse", "output") for f in ("source", "text", "target")] + [f"$.{node}[0].{f}" for node in ("pipelineResponse", "output") for f in ("source", "text")]
    return F.coalesce(*[F.nullif(strip(F.get_json_object(c, w)), F.lit("")) for w in ways], F.lit(""))


def batch_pages(answers: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(batch, image_id, text, failed) of saved batches, and (rule, key, detail) of batches that can't be used.

    `answers` has batch, page_num, status and blocks (reading_order, y, x, text); `mapping` has batch,
    image_id and output_page. Page numbers count within their batch, from 1 without gaps; a page that is
    repeated, absent or not asked for spoils its batch. Blocks come in their stated order, else by place;
    a page that wasn't completed, or has no text, is empty and failed.
    """
    m = mapping.select("batch", "image_id", F.col("output_page").alias("page_num"))
    shape = m.groupBy("batch").agg(F.count("*").alias("n"), F.min("page_num").alias("lo"), F.max("page_num").alias("hi"), F.count_distinct("page_num").alias("d"), F.count_distinct("image_id").alias("i"))
    bad = shape.filter("n <> d or n <> i or lo <> 1 or hi <> n").select(F.lit("mapping_contiguous").alias("rule"), F.col("batch").cast("string").alias("key"), F.lit("mapping").alias("detail"))
    per = answers.groupBy("batch", "page_num").agg(F.count("*").alias("k"))
    both = per.join(m, ["batch", "page_num"], "full_outer")
    off = both.filter("k is null or image_id is null or k > 1").select(F.when(F.col("k").isNull(), "page_answered").when(F.col("image_id").isNull(), "page_asked").otherwise("page_once").alias("rule"), F.col("batch").cast("string").alias("key"), F.col("page_num").cast("string").alias("detail"))
    gaps = bad.unionByName(off)
    blank = lambda t: ~F.coalesce(t.rlike(r"(?U)\S"), F.lit(False))
    order = F.transform(F.col("blocks"), lambda b, i: F.struct(b["reading_order"].isNull().alias("k0"), b["reading_order"].alias("k1"), b["y"].alias("k2"), b["x"].alias("k3"), i.alias("k4"), strip(b["text"]).alias("t")))
    text = F.array_join(F.transform(F.filter(F.array_sort(order), lambda b: ~blank(b["t"])), lambda b: b["t"]), "\n")
    done = F.coalesce(F.lower("status").isin("completed", "complete", "succeeded", "success"), F.lit(False))
    x = answers.join(m, ["batch", "page_num"]).join(gaps.select("key").distinct(), F.col("batch").cast("string") == F.col("key"), "left_anti")
    x = x.select("batch", "image_id", F.when(done, F.coalesce(text, F.lit(""))).otherwise("").alias("text"))
    return x.withColumn("failed", F.col("text") == ""), gaps
