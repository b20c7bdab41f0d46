import pytest

import __spark_entry__ as entry
from shabdika.plans import queries as core

DIR = "/root/testdata/sf0.001"


def test_entry_and_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_core_query_runs(spark, name):
    assert core.QUERIES[name](spark, DIR).count() >= 0


def test_core_does_not_import_training():
    from pathlib import Path

    root = Path(core.__file__).resolve().parent.parent
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert ".llm" not in f.read_text() and "shabdika.llm" not in f.read_text(), f


def test_bootstrap_query_takes_all_rounds(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(core.edit, "bootstrap", lambda p, *by, rounds=2000, **kw: taken.append(rounds) or p.selectExpr("lang", "0.0D AS low", "0.0D AS high"))
    core.QUERIES["q54_bootstrap_ci"](spark, DIR)
    assert taken == [2000]


def test_table_text_of_every_table_region(spark, tmp_path):
    import re

    texts = ["a | b\nc | d", "a – b |  ｆｕｌｌ\u00a0x", " a  b | | c ", "| x |\n|", "कर | R&D <t> 5 > 4 &lt;", "a|b | c", "", "   ", "\u2003| é"]
    spark.createDataFrame([*[(i, "table", t) for i, t in enumerate(texts)], (3, "table", texts[3]), (90, "table", None), (91, "text", "a | b")], "region_key long, type string, text string").write.parquet(f"{tmp_path}/regions.parquet")

    def row(line):
        # a cell after some text has a tab before it unless there is one; empty rows leave nothing
        out = ""
        for c in re.split(r"(?<!\S)\|(?!\S)", line):
            out += "\t" * (out != "" and not out.endswith("\t")) + c
        return out

    want = {i: "\n".join(r for r in map(row, t.split("\n")) if r) for i, t in enumerate(texts)}
    rows = core.QUERIES["q17_html_table_all"](spark, str(tmp_path)).collect()
    assert len(rows) == len(texts) and {r.region_key: r.table_text for r in rows} == want
