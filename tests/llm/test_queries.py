import pytest

from shabdika.llm import queries as Q

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_runs(spark, name):
    df = Q.QUERIES[name](spark, DIR)
    assert df.count() >= 0
    if name.endswith("_found"):
        assert df.count() == df.distinct().count()


def test_columns_of_found(spark):
    want = {"p1_found": ["row_id_a", "row_id_b"], "p2_found": ["doc_key"], "p3_found": ["textline_id", "row_id"], "p4_found": ["field_name", "category"], "p5_found": ["textline_id", "noise_kind"], "p6_found": ["measure_id", "cut_kind"], "p7_found": ["table_name", "rec_id", "language"], "p10_found": ["doc_id"]}
    for name, cols in want.items():
        assert Q.QUERIES[name](spark, DIR).columns == cols


def test_report_says_what_the_quotas_miss(spark):
    rows = Q.QUERIES["p4_report"](spark, "/root/testdata/sf0.01").collect()
    drawn = Q.QUERIES["p4_sample"](spark, "/root/testdata/sf0.01").collect()
    for r in rows:
        assert r.planned == sum(x[r.field_name] == r.category for x in drawn)
        assert r.missed == max(0, r.wanted - r.planned) >= r.short
    assert any(r.missed for r in rows)
