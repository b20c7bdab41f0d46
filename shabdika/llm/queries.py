"""Queries of the training-data operators over the project's tables; names pN_... are those of the problems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from ..session import cut
from ..sources.tables import latest
from . import containers, encoding, language, lookalike, mixing, naming, ocrtext, overlap, pieces, quota, splits, tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with at least one passage decoded with the wrong encoding."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return encoding.restored(docs).filter("garbled_spans > 0").select("doc_id").distinct()


@query
def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    """All documents with their text restored where possible."""
    return encoding.restored(table(spark, d, "documents").select("doc_id", "text"))


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a text line and an index row drawn alike but of different characters."""
    return lookalike.alike_pairs(table(spark, d, "textline"), "textline_id", table(spark, d, "index_test"), "row_id")


@query
def p3_one_form(spark: SparkSession, d: str) -> DataFrame:
    """Every text of both tables in its one form."""
    a = table(spark, d, "textline").select(F.lit("textline").alias("table_name"), F.col("textline_id").alias("rec_id"), "text")
    b = table(spark, d, "index_test").select(F.lit("index_test").alias("table_name"), F.col("row_id").alias("rec_id"), "text")
    both = a.unionByName(b)
    return lookalike.one_form(both, lookalike.classes(lookalike.character_counts([both]))).select("table_name", "rec_id", "one_form").distinct()


def _document_links(spark: SparkSession, d: str) -> DataFrame:
    """Edges between every spelling of a document and its key, from pages and crops."""
    pages = table(spark, d, "detections_20261017_203514").select(F.col("image").alias("path"))
    crops = table(spark, d, "index_test").select(F.col("image_path").alias("path"))
    paths = pages.unionByName(crops).filter("path is not null")
    return paths.select(F.concat(F.lit("name:"), naming.spelt_doc(F.col("path"))).alias("a"), F.concat(F.lit("doc:"), naming.doc_key(F.col("path"))).alias("b")).distinct()


def _in_components(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The crops with the component of their document, and the components' vertices."""
    parts = cut(splits.components(_document_links(spark, d)))
    crops = table(spark, d, "index_test").select("row_id", "split", F.concat(F.lit("name:"), naming.spelt_doc(F.col("image_path"))).alias("vertex"))
    return crops.join(parts, "vertex"), parts


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose index rows stand in more than one split."""
    crops, parts = _in_components(spark, d)
    torn = crops.groupBy("component").agg(F.count_distinct("split").alias("n")).filter("n > 1")
    keys = parts.filter("vertex like 'doc:%'").select("component", F.substring("vertex", 5, 1000).alias("doc_key"))
    return keys.join(torn.select("component"), "component").select("doc_key").distinct()


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    parts = cut(splits.components(_document_links(spark, d)))
    pages = table(spark, d, "detections_20261017_203514").select(F.col("image").alias("path")).distinct()
    crops = table(spark, d, "index_test").select("row_id", F.col("image_path").alias("path")).distinct().select("path")
    names = pages.unionByName(crops).select(F.concat(F.lit("name:"), naming.spelt_doc(F.col("path"))).alias("vertex")).groupBy("vertex").count()
    weights = names.join(parts, "vertex").groupBy("component").agg(F.sum("count").alias("weight"))
    target = [(r.split_name, r.share_pct) for r in table(spark, d, "split_target").collect()]
    keys = parts.filter("vertex like 'doc:%'").select("component", F.substring("vertex", 5, 1000).alias("doc_key"))
    return splits.assign(weights, target).join(keys, "component")


@query
def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its split and its number of pages and crops."""
    return _assigned(spark, d).select("doc_key", "weight", "split")


@query
def p2_shares(spark: SparkSession, d: str) -> DataFrame:
    """Share of pages and crops that each split got, against its target."""
    got = _assigned(spark, d).groupBy("split").agg(F.sum("weight").alias("records"), F.count("*").alias("documents"))
    whole = got.agg(F.sum("records").alias("whole"))
    t = table(spark, d, "split_target").select(F.col("split_name").alias("split"), "share_pct")
    return t.join(got, "split", "left").crossJoin(whole).select("split", "share_pct", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("documents", F.lit(0)).alias("documents"), F.round(100 * F.coalesce("records", F.lit(0)) / F.col("whole"), 3).alias("actual_pct"))


_FIELDS = ["language", "domain", "scan_type"]


def _sampling(spark: SparkSession, d: str) -> tuple[DataFrame, list[tuple], dict[tuple, int], int]:
    pages = latest(table(spark, d, "metadata").select("line_id", *_FIELDS, "loaded_at"), "line_id").drop("loaded_at")
    pages = cut(quota.categorised(pages, table(spark, d, "category_alias"), _FIELDS))
    targets = [tuple(r) for r in table(spark, d, "sample_target").select("field_name", "category", "share_pct", "min_pages").collect()]
    have = quota.cells(pages, "line_id", _FIELDS)
    return pages, targets, have, sum(have.values()) * _setting(spark, d, "sample_pct") // 100


def _setting(spark: SparkSession, d: str, name: str) -> int:
    return table(spark, d, "run_setting").filter(F.col("setting_name") == name).first().setting_value


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Categories of sample_target that the pages can't meet: their slack arc carries pages."""
    _, targets, have, n = _sampling(spark, d)
    short = quota.shortfalls(have, quota.needs(targets, n), _FIELDS)
    return spark.createDataFrame([k for k, v in sorted(short.items()) if v > 0], "field_name string, category string")


@query
def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    """The pages drawn, with their categories."""
    pages, targets, have, n = _sampling(spark, d)
    return quota.draw(pages, "line_id", _FIELDS, quota.quotas(have, targets, n, _FIELDS)).select("line_id", *_FIELDS)


@query
def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """For each category of sample_target: pages wanted, available, planned, short by what its own field allows, and missed: those the quotas drawn leave out, for whatever reason."""
    _, targets, have, n = _sampling(spark, d)
    want, plan = quota.needs(targets, n), quota.quotas(have, targets, n, _FIELDS)
    short = quota.shortfalls(have, want, _FIELDS)
    got = {(f, c): sum(v for k, v in plan.items() if k[i] == c) for i, f in enumerate(_FIELDS) for ff, c, *_ in targets if ff == f}
    rows = [(f, c, want[f, c], sum(v for k, v in have.items() if k[i] == c), got[f, c], short[f, c], max(0, want[f, c] - got[f, c])) for i, f in enumerate(_FIELDS) for ff, c, *_ in targets if ff == f]
    return spark.createDataFrame(rows, "field_name string, category string, wanted long, available long, planned long, short long, missed long")


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Crops wider than the limit and the kind of cut they need."""
    return _pieces(spark, d).select("measure_id", "cut_kind").distinct()


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.pieces(table(spark, d, "measure_row"), _setting(spark, d, "piece_limit_px"), _setting(spark, d, "piece_overlap_px"))


@query
def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every crop wider than the limit, in pixels at height 32."""
    return _pieces(spark, d)


#: A container of instruction data holds at most so many examples.
SEGMENTS = 64


@query
def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every text, or part of one larger than a container, with its container."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    cap = _setting(spark, d, "container_tokens")
    return containers.filled(tokens.counted(docs, head="head"), (cap, SEGMENTS, cap))


@query
def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mix: which document is read in which epoch."""
    return _mix(spark, d)[0]


@query
def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source."""
    return _mix(spark, d)[1]


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "domain", "text")
    items = cut(tokens.counted(docs))
    whole = items.agg(F.sum("tokens")).first()[0] or 0
    weights = [tuple(r) for r in table(spark, d, "mix_target").select("source", "weight_pct", "max_repeats").collect()]
    return mixing.mixed(items, weights, whole * _setting(spark, d, "mix_total_tokens_pct") // 100)


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlaps(table(spark, d, "index_test").select("row_id", "image_path", "text", "split"), naming.line_key(F.col("image_path")))


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of index rows, one in train and one in val or test, that hold the same crop or line."""
    return _overlaps(spark, d).select("row_id_a", "row_id_b")


@query
def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Per evaluation split and source: pairs, and evaluation rows that have a partner, by crop and by text."""
    rows = table(spark, d, "index_test").select("row_id", "split", "source").distinct()
    pairs = _overlaps(spark, d)
    ends = pairs.select(F.col("row_id_a").alias("row_id"), "by_crop", "by_text").unionByName(pairs.select(F.col("row_id_b").alias("row_id"), "by_crop", "by_text"))
    per = ends.groupBy("row_id").agg(F.count("*").alias("n"), F.max("by_crop").alias("c"), F.max("by_text").alias("t"))
    return per.join(rows.filter("split <> 'train'"), "row_id").groupBy("split", "source").agg(F.sum("n").alias("pairs"), F.count("*").alias("rows"), F.sum(F.col("c").cast("int")).alias("rows_by_crop"), F.sum(F.col("t").cast("int")).alias("rows_by_text"))


def _labelled(spark: SparkSession, d: str) -> tuple[DataFrame, language.Model]:
    """All records of the three tables with their label; garbled documents restored first."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    code = F.regexp_extract(F.lower("doc_id"), r"^[a-z]+[^a-z0-9]+([a-z]+)[^a-z0-9]", 1)
    prior = F.when(code == "mar", "mr").when(code == "hin", "hi").when(code == "eng", "en")
    a = encoding.restored(docs).select(F.lit("documents").alias("table_name"), F.col("doc_id").alias("rec_id"), F.col("lang").alias("label"), "text", F.lit(None).cast("string").alias("prior"), F.lit(False).alias("wrapped"))
    b = table(spark, d, "regions").filter("type in ('text', 'list')").select(F.lit("regions").alias("table_name"), F.col("region_key").alias("rec_id"), F.col("script").alias("label"), "text", prior.alias("prior"), F.lit(True).alias("wrapped"))
    c = table(spark, d, "textline").select(F.lit("textline").alias("table_name"), F.col("textline_id").alias("rec_id"), F.col("script").alias("label"), "text", prior.alias("prior"), F.lit(True).alias("wrapped"))
    return a.unionByName(b).unionByName(c), language.models(docs)


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Records whose label is missing or wrong or whose text mixes languages, one row per language."""
    rows, model = _labelled(spark, d)
    found = language.identified(rows, model).filter("case")
    return found.select("table_name", "rec_id", F.explode("languages").alias("language")).distinct()


@query
def p7_languages(spark: SparkSession, d: str) -> DataFrame:
    """The languages of every record with a confidence each."""
    rows, model = _labelled(spark, d)
    x = language.identified(rows, model).withColumn("z", F.explode(F.arrays_zip("languages", "confidence")))
    return x.select("table_name", "rec_id", F.col("z.languages").alias("language"), F.col("z.confidence").alias("confidence"), F.col("case").alias("label_disagrees")).distinct()


@query
def p7_segments(spark: SparkSession, d: str) -> DataFrame:
    """The segments of every record with language and confidence."""
    rows, model = _labelled(spark, d)
    return language.segments(rows, model).distinct()


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Text lines with noise, one row per line and kind."""
    return ocrtext.analysed(table(spark, d, "textline"))[0]


@query
def p5_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Continuous paragraphs of every document: no furniture, no broken words, misread words replaced."""
    return ocrtext.paragraphs(table(spark, d, "textline"))


# --- SQL -------------------------------------------------------------------------------------------------

_NAME = r"'^([a-z]+)[^a-z0-9]+([a-z]+)[^a-z0-9]+0*([0-9]+)[^a-z0-9]'"
_BASE = r"lower(regexp_replace(image_path, '^.*[/\\]', ''))"
SQL["p2_found"] = f"SELECT concat_ws('_', regexp_extract(b, {_NAME}, 1), regexp_extract(b, {_NAME}, 2), regexp_extract(b, {_NAME}, 3)) AS doc_key FROM (SELECT {_BASE} AS b, split FROM index_test) WHERE regexp_extract(b, {_NAME}, 1) <> '' GROUP BY doc_key HAVING count(DISTINCT split) > 1"
_BLANK = r"[\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NORM = f"regexp_replace(lower(regexp_replace(regexp_replace(v, '^{_BLANK}+', ''), '{_BLANK}+$', '')), '(?:{_BLANK}|-)+', '_', 'g')"
SQL["p4_found"] = f"""WITH raw AS (SELECT DISTINCT 'language' AS field_name, line_id, language AS v FROM metadata UNION ALL SELECT DISTINCT 'domain', line_id, domain FROM metadata UNION ALL SELECT DISTINCT 'scan_type', line_id, scan_type FROM metadata),
    cat AS (SELECT r.field_name, r.line_id, coalesce(a.category, r.n) AS category FROM (SELECT *, {_NORM} AS n FROM raw) r LEFT JOIN category_alias a ON a.field_name = r.field_name AND a.raw_value = r.n),
    have AS (SELECT field_name, category, count(DISTINCT line_id) AS pages FROM cat GROUP BY ALL),
    n AS (SELECT (SELECT count(DISTINCT line_id) FROM metadata) * setting_value // 100 AS n FROM run_setting WHERE setting_name = 'sample_pct')
    SELECT t.field_name, t.category FROM sample_target t CROSS JOIN n LEFT JOIN have h USING (field_name, category) WHERE coalesce(h.pages, 0) < greatest(ceil(t.share_pct * n.n / 100.0), t.min_pages)"""
SQL["p6_found"] = """WITH lim AS (SELECT setting_value AS m FROM run_setting WHERE setting_name = 'piece_limit_px'),
    rows AS (SELECT DISTINCT measure_id, original_width AS w, original_height AS h, height32_width_before_cap AS b, gap_x, text FROM measure_row WHERE measure_id IS NOT NULL),
    wide AS (SELECT *, CASE WHEN w > 0 AND h > 0 THEN greatest(8, round_even(w * 32.0 / h, 0)) WHEN b > 0 THEN b END AS w32 FROM rows),
    k AS (SELECT wide.*, m, rtrim(coalesce(text, '')) AS said, CASE WHEN h > 0 THEN 32.0::DOUBLE / h WHEN w > 0 THEN w32::DOUBLE / w END AS k1 FROM wide, lim WHERE w32 > m),
    s AS (SELECT *, coalesce(k1, CASE WHEN len(gap_x) > 0 AND contains(said, ' ') THEN w32 / greatest(list_max(gap_x) * length(said) / (length(said) - length(regexp_extract(said, '[^ ]*$')) - 1 + 0.5), list_max(gap_x) + 1) ELSE 1.0 END) AS k FROM k),
    e AS (SELECT measure_id, m, unnest(list_sort(list_concat([0.0::DOUBLE, CASE WHEN w > 0 THEN w * k ELSE w32 END], list_filter(list_transform(coalesce(gap_x, []), lambda g: g * k), lambda g: g > 0 AND g < CASE WHEN w > 0 THEN w * k ELSE w32 END)))) AS x FROM s)
    SELECT measure_id, CASE WHEN max(d) > any_value(m) + 1e-9 THEN 'hard' ELSE 'gap' END AS cut_kind FROM (SELECT measure_id, m, x - lag(x) OVER (PARTITION BY measure_id ORDER BY x) AS d FROM e) GROUP BY measure_id"""
