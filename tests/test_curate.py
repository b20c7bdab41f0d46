import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from shabdika.config import Config
from shabdika.operators import compose, curate, recognise
from shabdika.sources import readers, sinks
from shabdika.sources.tables import earliest
from shabdika.streaming import files


def test_label_repair(spark):
    lines = ["1 0.5 0.5 0.2 0.2", "1 0.5 0.5", "x 0.5 0.5 0.2 0.2", "1 99 0.5 0.2 0.2", "1 1.2 0.5 0.2 0.2", "1 0.5 0.5 0.0005 -0.2", "", None]
    fixed, status = curate.repaired_label(F.col("t"))
    got = [(r.s, r.f) for r in spark.createDataFrame([(x,) for x in lines], "t string").select(status.alias("s"), fixed.alias("f")).collect()]
    assert [g[0] for g in got] == ["ok", "dropped_bad_format", "dropped_parse_error", "dropped_unrecoverable", "clamped", "dropped_degenerate", "dropped_bad_format", "dropped_bad_format"]
    assert got[4][1] == "1 1.000000 0.500000 0.200000 0.200000"


def test_class_policies(spark):
    rows = spark.createDataFrame([(1, "Body Text"), (2, "seal"), (3, "other"), (4, None)], "id int, name string")
    m = spark.createDataFrame([("body_text", "text")], "source string, target string")
    assert [(r.id, r.target) for r in curate.resolve(rows, "name", m, ["seal"]).collect()] == [(1, "text")]
    assert {r.id for r in curate.resolve(rows, "name", m, ["seal"], "text").collect()} == {1, 3, 4}
    with pytest.raises(Exception, match="unmapped"):
        curate.resolve(rows, "name", m, ["seal"], "fail").collect()
    assert [r.source for r in curate.unmapped(rows, "name", m, ["seal"]).collect()] == ["other"]


def test_near_hashes_against_brute_force(spark):
    import random

    r = random.Random(5)
    base = [r.getrandbits(64) - (1 << 63) for _ in range(40)]
    other = [b ^ (1 << r.randrange(63)) ^ (1 << r.randrange(63)) ^ (1 << r.randrange(63)) for b in base[:20]] + [r.getrandbits(64) - (1 << 63) for _ in range(20)] + [None]
    a = spark.createDataFrame(list(enumerate(base)), "id int, hash long")
    b = spark.createDataFrame(list(enumerate(other)), "id int, hash long")
    got = {(x.a_id, x.b_id, x.distance) for x in curate.near_hashes(a, b).collect()}
    want = {(i, j, d) for i, x in enumerate(base) for j, y in enumerate(other) if y is not None and (d := bin((x ^ y) & (1 << 64) - 1).count("1")) <= 4}
    assert got == want and len(want) >= 20


def test_split_is_exact_on_a_hot_stratum(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else None) for i in range(900)], "id int, s string")
    got = {(r.s, r.split): r["count"] for r in curate.stratified_split(rows, ["s"], "id").groupBy("s", "split").count().collect()}
    assert got == {("hot", "train"): 540, ("hot", "val"): 60, (None, "train"): 270, (None, "val"): 30}
    assert curate.stratified_sample(rows, ["s"], 4, "id").count() == 8


def test_violations(spark):
    d = spark.createDataFrame([(1, "a"), (2, None), (2, "b")], "id int, v string")
    v = curate.violations(d, {"has_v": (F.col("v").isNotNull(), F.col("id"))}).unionByName(curate.duplicates(d, "id", "once"))
    assert sorted((r.rule, r.key) for r in v.collect()) == [("has_v", "2"), ("once", "2")]
    with pytest.raises(ValueError):
        curate.required(v)
    curate.required(v.filter("false"))


def test_compose(spark):
    lines = spark.createDataFrame([(1, 1, " b ", 0.5), (2, 0, "a", None), (3, 2, "  ", 1.0), (4, 3, None, None)], "textline_id long, line_no int, text string, confidence double").withColumn("r", F.lit(1))
    r = compose.region_text(lines, ["r"]).first()
    assert r.text == "a\n b" and r.recognition_confidence == 0.75
    cells = spark.createDataFrame([(0, 0, "a|b"), (0, 1, "c"), (1, 0, "d")], "row int, col int, text string").withColumn("t", F.lit(1))
    assert compose.table_text(cells, ["t"]).first().text == "a|b | c\nd"
    assert compose.pipe_table(cells, ["t"]).first().markdown == "| a\\|b | c |\n| --- | --- |\n| d |  |"


def test_ctc_and_router(spark):
    d = spark.createDataFrame([([0, 1, 1, 0, 1, 2, 2, 0],), ([],)], "s array<int>")
    assert [r.o for r in d.select(recognise.greedy(F.col("s")).alias("o")).collect()] == [[1, 1, 2], []]
    assert recognise.beam([[-5.0, -0.1, -3.0], [-0.1, -5.0, -3.0], [-5.0, -0.1, -3.0]])[0] == [1, 1]
    c = "d struct<text:string,confidence:double>, l struct<text:string,confidence:double>, s string, f double"
    rows = [((("x", 0.2)), ("y", 0.9), "deva", 0.1), (("x", 0.2), ("y", 0.9), "deva", 0.9), (("", 0.9), (" ", 0.9), "mixed", 0.9), (("ab", None), ("c", 0.0), "unknown", None)]
    got = [r.t for r in spark.createDataFrame(rows, c).select(recognise.routed(F.col("d"), F.col("l"), F.col("s"), F.col("f"))["text"].alias("t")).collect()]
    assert got == ["y", "x", "", "ab"]


def test_registry(spark):
    assert "stub" in recognise.available()
    d = spark.createDataFrame([(1, "a"), (2, None)], "id long, text string")
    assert {(r.id, r.text, r.confidence) for r in recognise.recognised(d, "stub", "id").collect()} == {(1, "a", 1.0), (2, None, None)}
    with pytest.raises(KeyError):
        recognise.recognised(d, "none", "id")


def test_alignment(spark):
    assert recognise.line_spans("a\n\n  bc \nd") == [("a", 0, 1), ("bc", 5, 7), ("d", 9, 10)]
    assert [g[:2] for g in recognise.aligned([100.0, 200.0], [10, 20])] == [(0, 1), (1, 2)]
    crops = spark.createDataFrame([("p", 1, 0, 100.0, 20.0), ("q", 2, 0, 10.0, 20.0)], "page string, crop_id long, seq int, width double, height double")
    pages = spark.createDataFrame([("p", "x" * 10), ("q", None)], "page string, text string")
    assert {(r.crop_id, r.status) for r in recognise.align_pages(crops, pages, "page").collect()} == {(1, "candidate_match"), (2, "no_match")}


def test_long_lines_and_pixels():
    import numpy as np

    blank = [False] * 600
    blank[480:490] = [True] * 10
    assert recognise.long_line(blank, 32) == ([(0, 490), (480, 600)], "word_gap")
    assert recognise.long_line([False] * 600, 32)[1] == "fallback_no_word_gap"
    assert recognise.long_line([False] * 10, 32)[1] == "within_limit" and recognise.long_line([], 32) == ([], "empty")
    page = np.full((60, 40), 255, np.uint8)
    page[5:17] = page[35:47] = 0
    assert [(a <= 5 <= 17 <= b, b - a < 20) for a, b in recognise.text_lines(page)[:1]] == [(True, True)]
    assert len(recognise.text_lines(page)) == 2 and recognise.text_lines(np.full((5, 5), 9, np.uint8)) == []


def test_config():
    c = Config({"a": {"b": 1}}).override("a.b=2", "x.y=true", "n=null", "t=word")
    assert (c.get("a.b"), c.get("x.y"), c.get("n", 5), c.get("t"), c.get("no.no", 3)) == (2, True, None, "word", 3)
    assert c.hash() == Config({"t": "word", "x": {"y": True}, "n": None, "a": {"b": 2}}).hash()
    with pytest.raises(KeyError):
        c.require("z")


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "i.csv").write_text("﻿image_path,text\na.png,x\n", encoding="utf-8")
    d = readers.csv_index(spark, str(tmp_path / "i.csv"), ["image_path"])
    assert d.columns == ["image_path", "text"] and d.count() == 1
    with pytest.raises(ValueError):
        readers.csv_index(spark, str(tmp_path / "i.csv"), ["split"])
    assert readers.first_column(d, ["image", "image_path"], "img").first().img == "a.png"
    (tmp_path / "l.txt").write_text("0 0.5 0.5 0.1 0.1\nbad line\n\n")
    assert readers.typed_labels(readers.label_files(spark, str(tmp_path / "l.txt"))).count() == 1
    (tmp_path / "c.json").write_text(json.dumps({"images": [{"id": 1, "file_name": "a"}], "annotations": [{"image_id": 1, "category_id": 2, "bbox": [1.0, 2.0, 3.0, 4.0]}, {"image_id": None}], "categories": [{"id": 2, "name": "text"}]}))
    r = readers.coco(spark, str(tmp_path / "c.json"), "val").collect()
    assert [(x.file_name, x.category, x.bh) for x in r] == [("a", "text", 4.0)]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("out/page_3.txt", "hi")
    with tarfile.open(tmp_path / "t.tar", "w") as t:
        info = tarfile.TarInfo("x/a.png")
        info.size = 2
        t.addfile(info, io.BytesIO(b"ok"))
    m = readers.page_numbers(readers.archive_members(spark, str(tmp_path / "z.zip")))
    assert [(x.member, x.page, bytes(x.content)) for x in m.collect()] == [("out/page_3.txt", 3, b"hi")]
    w = spark.createDataFrame([("a.png",)], "name string")
    assert readers.archive_members(spark, str(tmp_path / "t.tar"), w).count() == 1
    sinks.csv_index(spark.createDataFrame([("p", "t", "hi", "train")], "image_path string, text string, language string, split string"), str(tmp_path / "out"))
    with pytest.raises(Exception):
        sinks.csv_index(d.selectExpr("image_path", "text", "'' language", "'' split"), str(tmp_path / "out"))


def test_stream_passes_over_what_is_written(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string").write.parquet(src)
    run = lambda k: files.resumable(spark, src, "id long, t string", out, "id", lambda d: d.withColumn("n", F.length("t")), str(tmp_path / k)).awaitTermination()
    run("c1")
    run("c2")
    assert spark.read.parquet(out).count() == 2


def test_earliest(spark):
    d = spark.createDataFrame([(1, "a", 2), (1, "a", 1), (None, "b", 1), (2, None, None)], "id int, v string, loaded_at int")
    assert {tuple(r) for r in earliest(d, "id").select("id", "v", "loaded_at").collect()} == {(1, "a", 1), (2, None, None)}


def test_leaked_and_nearest(spark):
    d = spark.createDataFrame([("a", "train", 1), ("a", "val", 4), ("b", "val", 9), (None, "val", 9)], "k string, split string, at int")
    assert [r.k for r in curate.leaked(d, "k").collect()] == ["a"]
    got = {(r.k, r.at): r.nearest for r in curate.nearest(d, ["k"], "at", F.col("split") == "train").collect()}
    assert got == {("a", 1): 0, ("a", 4): 3, ("b", 9): None, (None, 9): None}


def test_near_empty_tables(spark):
    e = spark.createDataFrame([], "id int, v string, s string")
    assert curate.stratified_split(e, ["s"], "id").count() == 0 and curate.stratified_sample(e, ["s"], 2, "id").count() == 0
    assert curate.duplicates(e, "id", "x").count() == 0
