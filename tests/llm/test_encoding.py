import pytest

from shabdika.llm.encoding import restore, restored

MR = "परिपत्रक क्रमांक"


@pytest.mark.parametrize("page", ["latin-1", "iso8859-15", "cp850", "cp437", "mac_roman"])
def test_round_trip(page):
    bad = MR.encode().decode(page)
    assert restore(bad)[0] == MR and restore(bad)[1] > 0
    assert restore("before " + bad + " शेवट")[0] == "before " + MR + " शेवट"


def test_undefined_bytes_kept_as_controls():
    bad = "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in MR.encode())
    assert restore(bad)[0] == MR


def test_twice_and_lossy():
    twice = MR.encode().decode("latin-1").encode().decode("latin-1")
    assert restore(twice)[0] == MR
    text, spans, lost = restore(MR.encode().decode("cp1252", "replace"))
    assert spans and lost and text.startswith("परिपत")


@pytest.mark.parametrize("text", ["résumé", "12°C", "Coördinator’s “naïve”", "SÃO", "(Ã)", "à", "₹250 …", "±½", "", None, "   ", "a\x00b", "Москва и мир", "ﬁne"])
def test_written_on_purpose(text):
    assert restore(text) == (text, 0, 0)


def test_rows(spark):
    rows = [(1, MR.encode().decode("latin-1"), "x"), (2, None, None), (3, "", "y"), (1, MR.encode().decode("latin-1"), "x"), (4, "é" * 50000, "z")]
    d = spark.createDataFrame(rows, "doc_id long, text string, garbled_spans string")
    got = restored(d).collect()
    assert sorted((r.doc_id, r.garbled_spans > 0) for r in got) == [(1, True), (1, True), (2, False), (3, False), (4, False)]
    assert restored(d.filter("false")).count() == 0
