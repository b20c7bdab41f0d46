import pytest
from pyspark.sql import functions as F

from shabdika.functions import edit, markup, text


def one(spark, fn, value):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("r")).first().r


KA, VIRAMA, SSA, AA, NUKTA = "क", "्", "ष", "ा", "़"


@pytest.mark.parametrize(
    ("before", "after"),
    [(KA + VIRAMA + " " + SSA, KA + VIRAMA + SSA), (KA + " " + AA, KA + AA), ("क़", KA + NUKTA), (" " + AA + KA, KA), ("a\x00b", "ab"), ("", ""), ("a ,b", "a, b"), (None, None), ("x  y\n\n\n\nz ", "x y\n\nz")],
)
def test_clean_text(spark, before, after):
    assert one(spark, text.clean_text, before) == after


def test_clean_text_twice_changes_nothing(spark):
    t = KA + VIRAMA + " " + SSA + " ;x : " + AA
    once = one(spark, text.clean_text, t)
    assert one(spark, text.clean_text, once) == once


def test_scoring_form_never_repairs(spark):
    t = KA + VIRAMA + " " + SSA
    assert one(spark, text.normalize_for_scoring, t) == t
    assert one(spark, text.normalize_for_scoring, "é‍\t x ") == "é x"


def test_script(spark):
    kind = lambda c: text.script_of_text(c)[0]
    for t, want in [("2024 / 15 - 03", "unknown"), (KA * 9, "deva"), ("abc", "latin"), (KA + "a", "mixed"), ("", "unknown")]:
        assert one(spark, kind, t) == want
    assert one(spark, lambda c: text.script_of_text(c)[1], KA + "a") == 1.0
    assert one(spark, lambda c: text.has_devanagari(c), "") is False


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d &amp; e</td></tr></table>", "a\tb\nc\td & e"),
        ("<table><tr><th>नाव</th><th>दिनांक</th></tr><tr><td>राम</td><td>२०२६</td></tr></table>", "नाव\tदिनांक\nराम\t२०२६"),
        ("before<table><TR class='x'><td>a<br>b</td><td> c  d </td></TR></table>after", "before\na\nb\t c  d \nafter"),
        ("<tr><td></td><td>x</td><td></td><td>y</td></tr>", "x\ty"),
        ("plain", "plain"),
        ("a < b &lt;td&gt;", "a < b <td>"),
        ("", ""),
        (None, None),
    ],
)
def test_table_text(spark, html, want):
    assert one(spark, markup.table_text, html) == want


@pytest.mark.parametrize(("html", "want"), [("<p>मराठी मजकूर</p><table><tr><td>अ</td><td>१२</td></tr></table>", "मराठी मजकूर\n\n अ  १२"), ("<h1>A</h1><p>b<br>c</p>", "A\n\nb\nc"), ("x<br/>y<!-- <p> -->z", "x\n\nyz"), ("R&amp;D", "R&D"), (" ", ""), (None, None)])
def test_block_text(spark, html, want):
    assert one(spark, markup.block_text, html) == want


def test_mojibake(spark):
    word = KA + AA
    for page in ("latin-1", "cp1252"):
        bad = "शासन".encode().decode(page, "ignore") if page == "latin-1" else word.encode().decode("latin-1")
        assert text.repair_mojibake(bad) in ("शासन", word)
    assert text.repair_mojibake("महाराष्ट्र शासन") == "महाराष्ट्र शासन" and text.repair_mojibake("à¤" + KA) == "à¤" + KA
    assert text.repair_mojibake("Corrigendum – III") == "Corrigendum – III" and text.repair_mojibake("à§\xff") == "à§\xff" and text.repair_mojibake("") == ""
    assert one(spark, text.mojibake_column, word.encode().decode("latin-1")) == word and one(spark, text.mojibake_column, None) is None


def test_lone_tab_stays(spark):
    assert one(spark, text.collapse_whitespace, "a\tb \t c") == "a\tb c"


def test_lexical_helpers(spark):
    assert one(spark, text.strip_punctuation, "“(कर)।") == "कर" and one(spark, text.lexical, "(ab)") is False and one(spark, text.devanagari_count, "कर1") == 2


def test_distance_and_operations():
    assert edit.distance("MAHARASHTRA", "MAHARASTRA") == 1
    assert edit.operations("MAHARASHTRA", "MAHARASTRA") == (0, 1, 0)
    assert edit.distance([], []) == 0 and edit.operations("", "ab") == (0, 0, 2)
    assert edit.distance("one two three four".split(), "one 2 three four".split()) == 1


def table_of(a, b):
    t = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i][j] = min(t[i - 1][j - 1] + (a[i - 1] != b[j - 1]), t[i - 1][j] + 1, t[i][j - 1] + 1)
    return t


def test_operations_sum_to_distance():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=80, deadline=None)
    @given(st.text("abc", max_size=8), st.text("abc", max_size=8))
    def check(a, b):
        t = table_of(a, b)
        assert sum(edit.operations(a, b)) == edit.distance(a, b) == edit.distance(b, a) == t[-1][-1]
        cols = edit._columns(a, b)
        assert all(edit._at(cols, i, j) == t[i][j] for i in range(len(a) + 1) for j in range(len(b) + 1))

    check()


def test_corpus_rates(spark):
    rows = [("g", "a" * 100, "a" * 100), ("g", "abcd", "xxxx"), ("e", "", ""), ("e", "", "x"), ("n", None, "x")]
    got = {r.g: r for r in edit.corpus(spark.createDataFrame(rows, "g string, reference string, hypothesis string"), "g").collect()}
    assert (got["g"].errors, got["g"].ref_chars, got["g"].cer, got["g"].mean_doc_cer) == (4, 104, round(4 / 104, 6), 0.5)
    assert got["e"].cer is None and got["e"].mean_doc_cer == 0.5 and "n" not in got


def test_bootstrap_holds_the_rate(spark):
    rows = [(i, i % 3, 10) for i in range(400)]
    r = edit.bootstrap(spark.createDataFrame(rows, "id long, errors long, size long"), rounds=200).first()
    assert r.low < sum(x[1] for x in rows) / 4000 < r.high < 0.2
