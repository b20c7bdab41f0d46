import unicodedata

from shabdika.llm import lookalike as L

SAME = [("Café", "Café"), ("ｆｕｌｌ １２", "full 12"), ("Тоwn", "Town"), ("अाहे", "आहे"), ("अॉगस्ट", "ऑगस्ट"), ("a​b­c", "abc"), ("a　b ", " a b"), ("ﬁx oﬃce", "fix office"), ("क़", "क़"), ("भू‑अ", "भू-अ"), ("येईल|", "येईल।")]
DIFFERENT = [("a", "A"), ("१", "1"), ("é", "e"), ("कि", "की"), ("का", "कां"), ("ab", "a b"), ("–", "-")]


def test_forms():
    r = L.Rewriter(L.classes({"e": 5, "a": 9}))
    for a, b in SAME:
        assert r(a) == r(b), (a, b)
        assert r(r(a)) == r(a)
    for a, b in DIFFERENT:
        assert r(a) != r(b), (a, b)
    assert r(None) is None and r("") == "" and r(" ​﻿ ") == ""


def test_classes_are_transitive_and_frequency_decides():
    m = L.classes({"о": 100, "o": 1, "ο": 2})
    assert m["o"] == m["ο"] == "о"
    uf = L.Classes()
    for a, b in [("a", "b"), ("c", "d"), ("b", "c")]:
        uf.link(a, b)
    assert uf.groups() == [["a", "b", "c", "d"]]


def test_form_respects_canonical_equivalence():
    r = L.Rewriter(L.classes({}))
    for t in ("Coördinator résumé", "ज़मीन सड़क"):
        assert r(unicodedata.normalize("NFD", t)) == r(unicodedata.normalize("NFC", t))


def test_pairs_against_brute_force(spark):
    a = [(1, "Тоwn"), (2, "Town"), (3, None), (4, ""), (5, "x​y"), (2, "Town"), (6, "​")]
    b = [(1, "Town"), (2, "Ｔown"), (3, "xy"), (4, None), (5, "  "), (6, "town")]
    x = spark.createDataFrame([(*r, "c") for r in a], "textline_id long, text string, _f string")
    y = spark.createDataFrame([(*r, "d") for r in b], "row_id long, text string, _f string")
    r = L.Rewriter(L.classes({}))
    want = {(i, j) for i, s in a for j, t in b if s is not None and t is not None and s != t and r(s) == r(t) != ""}
    got = L.alike_pairs(x, "textline_id", y, "row_id")
    assert {tuple(p) for p in got.collect()} == want and got.count() == len(want)
    assert L.alike_pairs(x.filter("false"), "textline_id", y, "row_id").count() == 0
