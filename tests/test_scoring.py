import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shabdika.operators import compose, curate, detection, recognise, scoring
from shabdika.sources import readers, sinks


def test_pairing_by_id_with_its_checks(spark):
    ref = spark.createDataFrame([("a", "kitten"), ("b", "x y"), ("c", "only"), ("d", ""), (None, "n")], "id string, text string")
    hyp = spark.createDataFrame([("b", "x z y"), ("a", "sitting"), ("e", "more"), ("d", ""), ("d", "twice")], "id string, text string")
    rows = {r.id: (r.errors, r.word_errors) for r in scoring.scored(scoring.paired(ref.filter("id <> 'd'"), hyp)).collect()}
    assert rows == {"a": (3, 1), "b": (2, 1)}
    assert {(r.rule, r.key) for r in scoring.unpaired(ref.filter("id is not null"), hyp).collect()} == {("no_hypothesis", "c"), ("no_reference", "e"), ("repeated", "d")}
    assert scoring.unpaired(ref.filter("false"), hyp.filter("false")).count() == 0


def test_complete_runs_only(spark):
    runs = spark.createDataFrame([("x", 1), ("x", 2), ("x", 2), ("y", 1), ("y", 9)], "run string, page int")
    pages = spark.createDataFrame([(1,), (2,)], "page int")
    assert {(r.run, r.page) for r in scoring.complete(runs, pages, "run", "page").collect()} == {("x", 1), ("x", 2)}


def test_confusion_guards_zero(spark):
    d = spark.createDataFrame([("deva", "deva"), ("deva", "latin")], "t string, p string")
    r = {x.label: (x.n, x.recall) for x in scoring.confusion(d, "t", "p", ["deva", "latin"]).collect()}
    assert r == {"deva": (2, 0.5)} and scoring.accuracy(d.filter("false"), "t", "p").first().accuracy == 0.0


def test_histogram_without_a_second_hump(spark):
    d = spark.createDataFrame([("a", 0, 5), ("a", 4, 9), ("a", 6, 2), ("a", 10, 4), ("b", 2, 3), ("c", 0, 9), ("c", 6, 8), ("c", 8, 9)], "g string, bin int, n long")
    r = {x.g: (x.mode1, x.mode2, x.valley, x.second_hump) for x in scoring.histogram_shape(d, ["g"]).collect()}
    assert r == {"a": (4, 10, 6, True), "b": (2, None, None, False), "c": (0, None, 6, False)}


def test_boundaries_against_brute_force(spark):
    r = random.Random(4)
    p, t = ([(i % 6, k, a, a + r.randint(2, 9)) for k, (i, a) in enumerate((r.randrange(6), r.randrange(40)) for _ in range(n))] for n in (40, 35))
    iou = lambda x, y: max(0, min(x[3], y[3]) - max(x[2], y[2])) / (max(1e-9, (x[3] - x[2]) + (y[3] - y[2]) - max(0, min(x[3], y[3]) - max(x[2], y[2]))))
    tp = exact = 0
    lines = {x[0] for x in p + t}
    for i in lines:
        free, mine = sorted(x[1:] for x in t if x[0] == i), sorted(x[1:] for x in p if x[0] == i)
        exact += len(free) == len(mine)
        for x in mine:
            best = max(free, key=lambda y: (iou((0, *x), (0, *y)), -y[0]), default=None)
            if best and iou((0, *x), (0, *best)) >= 0.5:
                free.remove(best)
                tp += 1
    s = "line int, seq long, a double, b double"
    got = detection.boundaries(spark.createDataFrame([(i, k, float(a), float(b)) for i, k, a, b in p], s), spark.createDataFrame([(i, k, float(a), float(b)) for i, k, a, b in t], s), "line").first()
    assert math.isclose(got.precision, tp / 40) and math.isclose(got.recall, tp / 35) and math.isclose(got.exact_count_rate, exact / len(lines)) and got.n_lines == len(lines)
    none = spark.createDataFrame([], s)
    assert detection.boundaries(none, none, "line").first().f1 == 0.0


def test_suppression_in_one_dimension_goes_by_position(spark):
    d = spark.createDataFrame([("t", 1, 0.0, 10.0), ("t", 2, 1.0, 10.0), ("t", 3, 8.0, 20.0), ("t", 4, None, 3.0)], "t string, seq long, a double, b double")
    assert {r.seq for r in detection.suppressed_1d(d, ["t"], "a", "b", "seq").collect()} == {1, 3}


def test_class_maps_unions_and_lists(spark):
    m = spark.createDataFrame([("a", "text"), ("b", "lost"), ("c", None)], "source string, target string")
    assert [r.key for r in curate.class_map_gaps(m, spark.createDataFrame([("text",)], "target string")).collect()] == ["lost"]
    x, y = spark.createDataFrame([(1, "a")], "id int, v string"), spark.createDataFrame([(1,), (2,)], "id int")
    whole, gaps = curate.united([x, y], "id")
    assert whole.count() == 3 and [r.key for r in gaps.collect()] == ["1"]
    assert curate.list_gaps({"a": ["x", "y"], "b": ["x"], "c": ["x", "y"]}) == [(1, {"a": "y", "b": None, "c": "y"})] and curate.list_gaps({}) == []


def test_halves_and_pools(spark):
    rows = spark.createDataFrame([(f"p{i}", "ab"[i % 2], i) for i in range(11)] * 2, "page string, g string, i int")
    got = {(r.g, r.part): r.n for r in curate.halved(rows, "page", ["g"]).groupBy("g", "part").agg(F.count_distinct("page").alias("n")).collect()}
    assert got == {("a", "tune"): 3, ("a", "check"): 3, ("b", "tune"): 3, ("b", "check"): 2}
    pool = lambda n, c: spark.createDataFrame([(i, c) for i in range(n)], "id int, coverage double")
    p = curate.pooled({"manual": (pool(3, 0.9), 0.8), "pseudo": (pool(2, 0.1), 0.6), "general": (pool(50, 1.0), 0.999)}, "general", "id", "coverage")
    assert {r.pool: r["count"] for r in p.groupBy("pool").count().collect()} == {"manual": 3, "general": 3}


def test_assigned_lines_and_baseline(spark):
    d = spark.createDataFrame([("p", 0, 1, 10), ("p", 1, 3, 10), ("p", 2, 0, 10), ("q", 0, 0, 3), ("q", 1, 0, 3)], "page string, seq int, k int, n int")
    got = {(r.page, r.seq): (r.from_line, r.to_line) for r in curate.assigned_lines(d, ["page"], "seq", "k", "n").collect()}
    assert got == {("p", 0): (0, 2), ("p", 1): (2, 10), ("p", 2): (10, 10), ("q", 0): (0, 1), ("q", 1): (1, 3)}
    n = spark.createDataFrame([("s", i) for i in range(40)] + [("t", 1)], "s string, n long")
    b = {r.s: r.baseline for r in curate.random_split_baseline(n, ["s"], "n", 10, 1, trials=40).collect()}
    assert 0.85 < b["s"] <= 1 and b["t"] == 0


def test_paths_and_coverage(spark):
    d = spark.createDataFrame([("D:\\x\\hindi\\train\\a.png",), ("/kaggle/in/b.png",), ("c.png",), (None,)], "p string")
    assert [r[0] for r in d.select(curate.portable_path(F.col("p"), ["hindi"], ["/kaggle/in/"])).collect()] == ["hindi/train/a.png", "b.png", "c.png", None]
    t = spark.createDataFrame([("aab",), ("zzz",), ("",), (None,)], "t string")
    assert curate.covered(t, "t", ["a", "b"], 0.9).count() == 3 and curate.covered(t, "t", [], 0.9).count() == 2


def test_alignment_against_brute_force(spark):
    r = random.Random(8)
    for _ in range(40):
        w, n = [r.randint(5, 200) for _ in range(r.randint(0, 5))], [r.randint(1, 40) for _ in range(r.randint(1, 5))]
        scale = sum(w) / max(1, sum(n))
        fit = lambda i, c: min(abs(math.log(max(max(w[i], 1) / c / max(scale, 1e-9), 1e-9))), 3)

        def best(i, j):
            ways = ([best(i - 1, j) + 0.9] if i else []) + ([best(i, j - 1) + 0.85] if j else []) + ([best(i - 1, j - 1) + fit(i - 1, n[j - 1])] if i and j else []) + ([best(i - 1, j - 2) + fit(i - 1, n[j - 2] + 1 + n[j - 1]) + 0.24] if i and j > 1 else [])
            return min(ways, default=0.0)

        got = recognise.aligned(w, n)
        used = [g for g in got if g]
        assert all(a[1] <= b[0] for a, b in zip(used, used[1:]))
        assert math.isclose(sum(g[2] for g in used) + 0.9 * (len(w) - len(used)) + 0.85 * (len(n) - sum(b - a for a, b, _ in used)), best(len(w), len(n)), abs_tol=1e-9)
    crops = spark.createDataFrame([("p", 1, 1, 100.0, 20.0), ("p", 2, 2, 100.0, 5.0), ("q", 3, 1, 10.0, 20.0), ("t", 4, 1, 90.0, 20.0)], "page string, crop_id long, seq int, width double, height double")
    pages = spark.createDataFrame([("p", "aaaaaaaaaa\nbbbbbbbbbb", None), ("q", None, True), ("t", "aaaa", True)], "page string, text string, table_page boolean")
    x = {i.crop_id: (i.status, i.passage, i.reasons) for i in recognise.align_pages(crops, pages, "page").collect()}
    assert x[1][:2] == ("ambiguous_match", "aaaaaaaaaa") and x[2][0] == "boundary_review" and x[2][2] == [recognise.THIN_CROP]
    assert x[3] == ("no_match", "", [recognise.UNUSED]) and x[4][2] == [recognise.TABLE_PAGE]


def test_beam_against_brute_force():
    from itertools import product

    r = np.random.default_rng(1)
    for _ in range(20):
        p = r.dirichlet(np.ones(3), 4)
        mass = {}
        for path in product(range(3), repeat=4):
            out = tuple(k for i, k in enumerate(path) if k and (not i or path[i - 1] != k))
            mass[out] = mass.get(out, 0) + math.prod(p[i, k] for i, k in enumerate(path))
        got, q = recognise.beam(np.log(p).tolist(), width=200)
        assert math.isclose(q, max(mass.values()), rel_tol=1e-9) and math.isclose(mass[tuple(got)], q, rel_tol=1e-9)
    assert recognise.beam([]) == ([], 1.0)


def test_pixels_as_boxes():
    g = np.full((60, 200), 255, np.uint8)
    for x in (10, 120):
        for y in (5, 35):
            g[y : y + 15, x : x + 60] = 0
    assert [(a, b) for a, _, b, _ in recognise.column_lines(g)] == [(0, 95), (0, 95), (95, 200), (95, 200)]
    assert [(r, c) for r, c, *_ in recognise.table_cells(g)] == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert recognise.table_cells(np.zeros((0, 0))) == [] and len(recognise.table_cells(np.zeros((9, 9), np.uint8))) == 1
    assert recognise.words_split([True, False, True, True, False, False, True], 2) == [(1, 2), (4, 6)] and recognise.words_split([True], 1) == []


def test_decode_and_chunks(spark):
    d = spark.createDataFrame([([1, 0, 2, 9],)], "i array<int>")
    assert d.select(recognise.decode(F.col("i"), {"a": 1, "b": 2})).first()[0] == "ab"
    c = spark.createDataFrame([("l", 2, " b ", None), ("l", 1, "a", 0.5), ("l", 3, " ", 0.7)], "l string, o int, text string, confidence double")
    assert tuple(recognise.chunks_merged(c, ["l"], "o").first())[1:3] == ("a b", 0.6)
    s = spark.createDataFrame([("r", "deva", "x"), ("r", "latin", " "), ("m", "deva", "x"), ("m", "latin", "y"), ("n", None, None)], "r string, script string, text string")
    assert {x.r: x.script for x in compose.region_script(s, ["r"]).collect()} == {"r": "deva", "m": "mixed", "n": None}


def test_benchmark_pairing(spark):
    i = spark.createDataFrame([("d/a.png",), ("d/b.png",), ("d/c.png",)], "path string")
    t = spark.createDataFrame([("t/a.txt", " x "), ("t/b.txt", "y"), ("t/other.txt", "z")], "path string, text string")
    rows, gaps = readers.benchmark(i, t)
    assert {(r.id, r.text) for r in rows.collect()} == {("a", "x"), ("b", "y")} and [r.key for r in gaps.collect()] == ["c"]
    m = spark.createDataFrame([("a.png", "other.txt", True), ("b.png", "b.txt", False), ("x.png", "b.txt", True)], "image string, text string, approved boolean")
    rows, gaps = readers.benchmark(i, t, m)
    assert [(r.id, r.text) for r in rows.collect()] == [("a", "z")]
    assert {(r.rule, r.key) for r in gaps.collect()} == {("approved", "b"), ("in_manifest", "c"), ("has_image", "x")}


def test_saved_batches(spark):
    blocks = "array<struct<reading_order:int,y:double,x:double,text:string>>"
    a = spark.createDataFrame([("A", 2, "completed", [(1, 0.0, 0.0, "two")]), ("A", 1, "completed", [(None, 0.8, 0.1, "low"), (None, 0.1, 0.3, "right"), (None, 0.1, 0.1, "left"), (3, 0.0, 0.0, "first"), (4, 0.0, 0.0, " ")]), ("A", 3, "failed", [(1, 0.0, 0.0, "x")]), ("B", 1, "success", None), ("B", 1, "success", None)], f"batch string, page_num int, status string, blocks {blocks}")
    m = spark.createDataFrame([("A", "i1", 1), ("A", "i2", 2), ("A", "i3", 3), ("B", "i4", 1), ("C", "i5", 2)], "batch string, image_id string, output_page int")
    rows, gaps = readers.batch_pages(a, m)
    assert {r.image_id: (r.text, r.failed) for r in rows.collect()} == {"i1": ("first\nleft\nright\nlow", False), "i2": ("two", False), "i3": ("", True)}
    assert {(r.rule, r.key) for r in gaps.collect()} == {("page_once", "B"), ("mapping_contiguous", "C"), ("page_answered", "C")}


def test_texts_of_answers(spark):
    raw = ['{"a":[{"text":"x","more":{"text":"y"}},{"text":""}],"b":{"text":"z"}}', "plain", "", None]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in raw], "t string").select(readers.json_text("t")).collect()] == ["x\ny\nz", "plain", "", None]
    e = ['{"pipelineResponse":[{"output":[{"source":" a "}]}]}', '{"output":[{"text":"b"}]}', "{}", "no"]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in e], "t string").select(readers.envelope_text(F.col("t"))).collect()] == ["a", "b", "", ""]


def test_round_trips(spark, tmp_path):
    r = spark.createDataFrame([("d", 0, 1, "title", "शीर्षक", 0, 1.0, 1.0), ("d", 0, 2, "text", "x", 1, 2.0, 1.0), ("e", 1, 1, "text", "y", 0, 1.0, 1.0)], "doc_id string, page_index int, region_id int, type string, text string, reading_order int, y1 double, x1 double")
    sinks.pages(r, f"{tmp_path}/out", ["json", "markdown", "text"])
    assert {x.doc_id: x.markdown for x in spark.read.json(f"{tmp_path}/out/markdown").collect()} == {"d": "## शीर्षक\n\nx", "e": "y"}
    p = compose.pages_nested(r)
    sinks.json_documents(p, f"{tmp_path}/nested")
    good, bad = readers.documents_json(spark, f"{tmp_path}/nested", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in p.schema))
    assert sorted(map(str, good.select(*p.columns).collect())) == sorted(map(str, p.collect())) and bad.count() == 0
    with pytest.raises(ValueError):
        sinks.pages(r, f"{tmp_path}/no", ["pdf"])
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "शब्द.png").write_bytes(b"x")
    assert [x.text for x in readers.named_texts(spark, f"{tmp_path}/img").collect()] == ["शब्द"]
    (tmp_path / "words.txt").write_text(" क़लम \n\nक़लम\n", encoding="utf-8")
    assert readers.word_list(spark, f"{tmp_path}/words.txt").count() == 1
