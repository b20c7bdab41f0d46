"""Queries of scoring runs, breakdowns, table layouts, set checks and samples, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import edit, geometry, text
from ..operators import compose, curate, detection, layout, recognise, scoring
from ..sources.tables import table
from .queries import _BOXES, _DET, _MAPSQL, _MAP, _PAGE, _W, _boxes, once, query

# --- a scoring run over two tables: regions against the lines read with confidence -------------------------

_ASCII = "array_to_string(list_transform(regexp_extract_all({}, '(?s).'), lambda c: chr((33 + unicode(c) % 90)::INT)), '')"


def _folded(c: Column) -> Column:
    """Each character as one of ninety signs: SQL's edit distance counts bytes."""
    return F.array_join(F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.char(F.lit(33) + F.conv(F.hex(F.encode(x, "utf-16be")), 16, 10).cast("long") % 90)), "")


def _run(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """References and hypotheses under region ids: a region's text, and its lines read with a confidence of 0.6 and more."""
    key = F.concat_ws("/", *_PAGE, "region_id").alias("id")
    ref = once(spark, d, "regions", *_PAGE, "region_id", "type", "text").filter("text is not null").select(key, "type", _folded(F.col("text")).alias("text"))
    t = once(spark, d, "textline", "textline_id", *_PAGE, "region_id", "line_no", "text", "confidence").filter("confidence >= 0.6 and text is not null")
    hyp = t.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "textline_id", "text"))), lambda x: x["text"]), " ").alias("text"))
    return ref, hyp.withColumn("text", _folded(F.col("text")))


_REF = f"(SELECT concat_ws('/', doc_id, page_index, region_id) AS id, type, {_ASCII.format('text')} AS reference FROM (SELECT DISTINCT doc_id, page_index, region_id, type, text FROM regions WHERE text IS NOT NULL))"
_HYP = f"(SELECT id, {_ASCII.format('t')} AS hypothesis FROM (SELECT concat_ws('/', doc_id, page_index, region_id) AS id, string_agg(text, ' ' ORDER BY line_no, textline_id) AS t FROM (SELECT DISTINCT textline_id, doc_id, page_index, region_id, line_no, text, confidence FROM textline WHERE confidence >= 0.6 AND text IS NOT NULL) GROUP BY ALL))"
_SCORED = f"(SELECT *, levenshtein(reference, hypothesis) AS e FROM {_REF} JOIN {_HYP} USING (id))"


@query(f"SELECT type, count(*) AS n, sum(e)::BIGINT AS errors, round(sum(e) / nullif(sum(length(reference)), 0), 6) AS cer, round(avg(CASE WHEN reference = hypothesis THEN 1 ELSE 0 END), 6) AS exact FROM {_SCORED} GROUP BY type")
def q65_scoring_run(spark: SparkSession, d: str) -> DataFrame:
    return scoring.rates(scoring.scored(scoring.paired(*_run(spark, d))), "type").drop("wer")


@query(f"SELECT CASE WHEN h IS NULL THEN 'no_hypothesis' ELSE 'no_reference' END AS rule, count(*) AS n FROM (SELECT r.id AS r, h.id AS h FROM {_REF} r FULL JOIN {_HYP} h ON r.id = h.id) WHERE r IS NULL OR h IS NULL GROUP BY rule")
def q66_unpaired(spark: SparkSession, d: str) -> DataFrame:
    return scoring.unpaired(*_run(spark, d)).groupBy("rule").agg(F.count("*").alias("n"))


@query(f"SELECT type, sum(e)::BIGINT AS errors, sum(length(hypothesis))::BIGINT AS ref_chars, round(sum(e) / nullif(sum(length(hypothesis)), 0), 6) AS cer FROM {_SCORED} GROUP BY type")
def q67_cer_arguments_swapped(spark: SparkSession, d: str) -> DataFrame:
    return scoring.corpus_swapped(scoring.paired(*_run(spark, d)), "type").select("type", "errors", "ref_chars", "cer")


@query(f"SELECT count(*) AS n, sum(o)::BIGINT AS operations FROM (SELECT e AS o FROM {_SCORED})")
def q68_operations_sum_to_distance(spark: SparkSession, d: str) -> DataFrame:
    p = scoring.paired(*_run(spark, d)).withColumn("o", edit.edit_ops(F.col("reference"), F.col("hypothesis")))
    return p.agg(F.count("*").alias("n"), F.sum(F.col("o.s") + F.col("o.d") + F.col("o.i")).cast("long").alias("operations"))


@query(f"SELECT id, e AS distance FROM {_SCORED} WHERE reference <> hypothesis ORDER BY e DESC, id LIMIT 10")
def q69_differences_first_ten(spark: SparkSession, d: str) -> DataFrame:
    s = scoring.scored(scoring.paired(*_run(spark, d))).filter("not same")
    return s.select("id", F.col("errors").alias("distance")).orderBy(F.desc("distance"), "id").limit(10)


@query(f"SELECT long, count(*) AS n, round(sum(e) / nullif(sum(length(reference)), 0), 6) AS cer FROM (SELECT *, length(reference) > 200 AS long FROM {_SCORED}) GROUP BY long")
def q70_width_split_control(spark: SparkSession, d: str) -> DataFrame:
    s = scoring.scored(scoring.paired(*_run(spark, d))).withColumn("long", F.col("size") > 200)
    return scoring.rates(s, "long").select("long", "n", "cer")


@query("SELECT backend, doc_id, page_index FROM (SELECT DISTINCT backend, doc_id, page_index FROM textline WHERE backend IS NOT NULL AND doc_id IN (SELECT doc_id FROM regions WHERE type = 'table') ) x SEMI JOIN (SELECT backend FROM (SELECT DISTINCT backend, doc_id, page_index FROM textline WHERE backend IS NOT NULL AND doc_id IN (SELECT doc_id FROM regions WHERE type = 'table') AND page_index = 0) GROUP BY backend HAVING count(*) = (SELECT count(DISTINCT doc_id) FROM regions WHERE type = 'table' AND doc_id IN (SELECT doc_id FROM textline WHERE page_index = 0))) f ON f.backend = x.backend WHERE page_index = 0")
def q71_complete_runs(spark: SparkSession, d: str) -> DataFrame:
    """First pages of documents with a table: the recognisers that read every one of them."""
    t = table(spark, d, "textline").filter("backend is not null and page_index = 0").select("backend", *_PAGE).distinct()
    docs = table(spark, d, "regions").filter("type = 'table'").select("doc_id").distinct().join(table(spark, d, "textline").filter("page_index = 0").select("doc_id").distinct(), "doc_id", "left_semi")
    return scoring.complete(t, docs, "backend", "doc_id").select("backend", *_PAGE)


# --- breakdowns -------------------------------------------------------------------------------------------

_SCRIPT = r"(CASE WHEN q IS NULL THEN 'unknown' WHEN q >= 0.85 THEN 'deva' WHEN q <= 0.15 THEN 'latin' ELSE 'mixed' END)"
_SCRIPTED = rf"(SELECT *, {_SCRIPT} AS told FROM (SELECT *, d / nullif(d + a, 0) AS q FROM (SELECT DISTINCT region_key, type, coalesce(lower(trim(script)), '') AS label, length(regexp_replace(coalesce(text, ''), '[^\x{{900}}-\x{{97f}}\x{{a8e0}}-\x{{a8ff}}]', '', 'g'))::DOUBLE AS d, length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS a FROM regions)))"


def _scripted(spark: SparkSession, d: str) -> DataFrame:
    r = once(spark, d, "regions", "region_key", "type", "script", "text")
    return r.select("region_key", "type", F.coalesce(F.lower(F.trim("script")), F.lit("")).alias("label"), text.script_of_text(F.coalesce("text", F.lit("")))[0].alias("told"))


@query(f"SELECT type, count(*) FILTER (WHERE told = 'deva') AS deva, count(*) FILTER (WHERE told = 'latin') AS latin, count(*) FILTER (WHERE told = 'mixed') AS mixed, count(*) FILTER (WHERE told = 'unknown') AS unknown FROM {_SCRIPTED} GROUP BY type")
def q72_type_by_script(spark: SparkSession, d: str) -> DataFrame:
    return _scripted(spark, d).groupBy("type").pivot("told", ["deva", "latin", "mixed", "unknown"]).count().na.fill(0)


@query(f"SELECT label, count(*) FILTER (WHERE told = 'deva') AS deva, count(*) FILTER (WHERE told = 'latin') AS latin, count(*) FILTER (WHERE told IN ('deva', 'latin')) AS n, round(count(*) FILTER (WHERE told = label) / greatest(count(*) FILTER (WHERE told IN ('deva', 'latin')), 1), 6) AS recall FROM {_SCRIPTED} WHERE label IN ('deva', 'latin') GROUP BY label")
def q73_confusion_recalls(spark: SparkSession, d: str) -> DataFrame:
    return scoring.confusion(_scripted(spark, d), "label", "told", ["deva", "latin"])


@query(f"SELECT count(*) AS n, round(avg(CASE WHEN told = label THEN 1 ELSE 0 END), 6) AS accuracy FROM {_SCRIPTED}")
def q73_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return scoring.accuracy(_scripted(spark, d), "label", "told")


_GAPSQL = "(SELECT measure_id, source, original_width AS width, unnest(list_transform(range(1, len(gap_x)), lambda i: gap_x[i + 1] - gap_x[i])) AS g FROM (SELECT DISTINCT measure_id, source, original_width, gap_x FROM measure_row))"


def _gap_runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    m = table(spark, d, "measure_row").select("measure_id", "source", F.col("original_width").alias("width"), "gap_x").dropDuplicates(["measure_id"])
    n = F.size("gap_x")
    return m.filter(n > 1).select("measure_id", "source", F.explode(F.zip_with(F.slice("gap_x", 2, n - 1), F.slice("gap_x", 1, n - 1), lambda a, b: a - b)).alias("g")), m.select("source", "width")


@query(f"""SELECT l.source, k.least, coalesce(r.runs, 0) AS runs, round(coalesce(r.runs, 0) / l.n, 6) AS per_line, round(coalesce(r.runs, 0) / (l.w / 100), 6) AS per_100px FROM (SELECT source, count(*) AS n, sum(original_width)::DOUBLE AS w FROM (SELECT DISTINCT measure_id, source, original_width FROM measure_row) GROUP BY source) l
    CROSS JOIN (SELECT unnest([20, 60, 120]) AS least) k LEFT JOIN (SELECT source, k.least, count(*) AS runs FROM {_GAPSQL} JOIN (SELECT unnest([20, 60, 120]) AS least) k ON g >= k.least GROUP BY ALL) r ON r.source = l.source AND r.least = k.least""")
def q74_rates_per_line_and_100px(spark: SparkSession, d: str) -> DataFrame:
    runs, lines = _gap_runs(spark, d)
    return scoring.run_rates(runs, lines, ["source"], "g", [20, 60, 120])


_BINS = f"(SELECT source, (g // 20) * 2 AS bin, count(*) AS n FROM {_GAPSQL} WHERE g >= 0 AND g < 400 GROUP BY ALL)"


@query(f"""WITH h AS {_BINS}, m AS (SELECT source, arg_max(bin, struct_pack(n := n, k := -bin)) FILTER (WHERE bin < 6) AS m1, arg_max(bin, struct_pack(n := n, k := -bin)) FILTER (WHERE bin >= 8) AS m2, max(n) FILTER (WHERE bin >= 8) AS n2 FROM h GROUP BY source),
    v AS (SELECT source, arg_min(bin, struct_pack(n := n, k := bin)) AS v, min(n) AS nv FROM h JOIN m USING (source) WHERE bin > m1 AND bin < m2 GROUP BY source)
    SELECT source, m1 AS mode1, CASE WHEN m2 IS NOT NULL AND (coalesce(nv, 0) = 0 OR n2 >= 1.2 * nv) THEN m2 END AS mode2, v AS valley, round(coalesce(nv, 0) / n2, 4) AS valley_ratio, m2 IS NOT NULL AND (coalesce(nv, 0) = 0 OR n2 >= 1.2 * nv) AS second_hump FROM m LEFT JOIN v USING (source)""")
def q75_histogram_modes(spark: SparkSession, d: str) -> DataFrame:
    g = _gap_runs(spark, d)[0].filter("g >= 0 and g < 400")
    return scoring.histogram_shape(g.groupBy("source", (F.floor(F.col("g") / 20) * 2).cast("int").alias("bin")).agg(F.count("*").alias("n")), ["source"])


@query("SELECT words, gap, count(*) FILTER (WHERE source = 'linebank_train') AS dummy, count(*) AS n FROM (SELECT DISTINCT measure_id, source, len(string_split(trim(text), ' ')) // 5 AS words, coalesce(len(gap_x), 0) // 5 AS gap FROM measure_row WHERE text IS NOT NULL) GROUP BY words, gap")
def q76_condition_grid(spark: SparkSession, d: str) -> DataFrame:
    m = once(spark, d, "measure_row", "measure_id", "source", "text", "gap_x").filter("text is not null")
    g = m.select("source", F.floor(F.size(F.split(F.trim("text"), " ")) / 5).alias("words"), F.floor(F.size(F.coalesce("gap_x", F.array().cast("array<int>"))) / 5).alias("gap"))
    return g.groupBy("words", "gap").agg(F.count_if(F.col("source") == "linebank_train").alias("dummy"), F.count("*").alias("n"))


_PUNCT = text.PUNCTUATION.replace("'", "''")


@query(rf"""WITH s AS (SELECT textline_id, coalesce(backend, '') AS backend, w, x2 - x1 AS width, trim(w, '{_PUNCT}') AS p FROM (SELECT textline_id, backend, x1, x2, unnest(string_split(text, ' ')) AS w FROM (SELECT DISTINCT textline_id, backend, x1, x2, text FROM textline)) WHERE w <> ''),
    v AS (SELECT DISTINCT trim(w, '{_PUNCT}') AS p FROM (SELECT unnest(string_split(text, ' ')) AS w FROM index_test WHERE split = 'train' AND text IS NOT NULL)),
    j AS (SELECT s.*, v.p IS NOT NULL AS known, length(regexp_replace(s.p, '[^\x{{900}}-\x{{97f}}]', '', 'g')) AS n FROM s LEFT JOIN v ON v.p = s.p)
    SELECT backend, count(*) AS n_segments, round(count(*) / count(DISTINCT textline_id), 3) AS segments_per_line, count(*) FILTER (WHERE n > 0) AS n_lexical, round(coalesce(count(*) FILTER (WHERE n > 0 AND known) / nullif(count(*) FILTER (WHERE n > 0), 0), 0), 4) AS in_vocab_rate, round(coalesce(sum(CASE WHEN known THEN n ELSE 0 END) / nullif(sum(n), 0), 0), 4) AS char_in_vocab_rate,
    round(coalesce(count(*) FILTER (WHERE n BETWEEN 1 AND 2) / nullif(count(*) FILTER (WHERE n > 0), 0), 0), 4) AS fragment_rate, round(coalesce(avg(width) FILTER (WHERE n > 0), 0), 1) AS mean_width FROM j GROUP BY backend""")
def q77_segment_statistics(spark: SparkSession, d: str) -> DataFrame:
    t = once(spark, d, "textline", "textline_id", "backend", "x1", "x2", "text")
    s = t.select("textline_id", F.coalesce("backend", F.lit("")).alias("backend"), (F.col("x2") - F.col("x1")).alias("width"), F.explode(F.split("text", " ")).alias("text")).filter("text <> ''")
    v = table(spark, d, "index_test").filter("split = 'train' and text is not null").select(F.explode(F.split("text", " ")).alias("w")).select(text.strip_punctuation(F.col("w")).alias("word"))
    return scoring.segment_stats(s, v, ["backend"], "textline_id")


@query("SELECT first, count(*) AS n, round(avg(length(w)), 6) AS mean_chars FROM (SELECT i = 1 AS first, w FROM (SELECT unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM (SELECT DISTINCT textline_id, text FROM textline)) WHERE w <> '') GROUP BY first")
def q78_position_breakdown(spark: SparkSession, d: str) -> DataFrame:
    w = once(spark, d, "textline", "textline_id", "text").select(F.posexplode(F.split("text", " ")).alias("i", "w")).filter("w <> ''")
    return w.groupBy((F.col("i") == 0).alias("first")).agg(F.count("*").alias("n"), F.round(F.avg(F.length("w")), 6).alias("mean_chars"))


# --- boxes ------------------------------------------------------------------------------------------------


@query()
def q79_single_point_ap(spark: SparkSession, d: str) -> DataFrame:
    from .queries import _truth

    return detection.single_point(_boxes(spark, d), _truth(spark, d))


@query(f"WITH c AS (SELECT cls, row_number() OVER w AS k, count(*) OVER (PARTITION BY cls) AS n FROM {_BOXES} WINDOW w AS (PARTITION BY cls ORDER BY score DESC, seq)) SELECT cls, round(({' + '.join(f'coalesce(max(CASE WHEN k / n >= {i} / 10.0 THEN 1 - k / (2.0 * n) END), 0)' for i in range(11))}) / 11, 6) AS ap FROM c GROUP BY cls")
def q80_eleven_point_ap(spark: SparkSession, d: str) -> DataFrame:
    """Eleven-point means of a falling line over each class's boxes by score."""
    b = _boxes(spark, d)
    n = b.groupBy("cls").agg(F.count("*").alias("n"))
    # one curve point a class and rank; ranks come from the sorted scores' counts, the largest class has few of them here
    k = b.withColumn("k", F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("score"), "seq"))).join(n, "cls")
    return detection.eleven_point(k.select("cls", (F.col("k") / F.col("n")).alias("recall"), (1 - F.col("k") / (2.0 * F.col("n"))).alias("precision")), ["cls"]).withColumn("ap", F.round("ap", 6))


def _iou1(a: str, b: str) -> str:
    i = f"greatest(0, least({a}.hi, {b}.hi) - greatest({a}.lo, {b}.lo))"
    return f"(CASE WHEN ({a}.hi - {a}.lo) + ({b}.hi - {b}.lo) - {i} > 0 THEN {i} / (({a}.hi - {a}.lo) + ({b}.hi - {b}.lo) - {i}) ELSE 0 END)"


_FOLD1 = f"list_reduce(list([b] ORDER BY b.lo, b.seq), lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: {_iou1('k', 'x[1]')} > 0.5)) = 0 THEN list_concat(acc, x) ELSE acc END)"


@query(f"SELECT page, unnest(kept).seq AS seq FROM (SELECT page, {_FOLD1} AS kept FROM (SELECT page, struct_pack(seq := seq, lo := y1, hi := y2) AS b FROM {_BOXES} WHERE y1 IS NOT NULL AND y2 IS NOT NULL) GROUP BY page)")
def q81_suppressed_1d(spark: SparkSession, d: str) -> DataFrame:
    return detection.suppressed_1d(_boxes(spark, d), ["page"], "y1", "y2", "seq")


# Detections read as a table model's rows and columns.
_LABELS = {"text": "table row", "list": "table row", "title": "table column header", "figure": "table column", "table": "table column"}


def _bands(spark: SparkSession, d: str) -> DataFrame:
    m = F.create_map(*[F.lit(x) for p in _LABELS.items() for x in p])
    b = _boxes(spark, d).withColumn("label", F.try_element_at(m, F.col("class_name")))
    return detection.table_bands(b, ["page"], F.lit(800.0), F.lit(1000.0))


_KIND = "CASE WHEN class_name IN ('text', 'list', 'title') THEN 'row' WHEN class_name IN ('figure', 'table') THEN 'column' END"
_CLIPPED = f"(SELECT page, seq, {_KIND} AS axis, greatest(0.0, x1) AS x1, greatest(0.0, y1) AS y1, least(800.0, x2) AS x2, least(1000.0, y2) AS y2 FROM {_BOXES} WHERE score >= 0.5)"
_BANDSQL = f"(SELECT page, axis, row_number() OVER (PARTITION BY page, axis ORDER BY k.lo, k.seq) - 1 AS number, k.lo AS lo, k.hi AS hi FROM (SELECT page, axis, unnest(kept) AS k FROM (SELECT page, axis, {_FOLD1} AS kept FROM (SELECT page, axis, struct_pack(seq := seq, lo := CASE WHEN axis = 'row' THEN y1 ELSE x1 END, hi := CASE WHEN axis = 'row' THEN y2 ELSE x2 END) AS b FROM {_CLIPPED} WHERE axis IS NOT NULL AND x2 - x1 >= 2 AND y2 - y1 >= 2) GROUP BY page, axis)))"


@query(f"SELECT page, axis, number, round(lo, 6) AS lo, round(hi, 6) AS hi FROM {_BANDSQL}")
def q82_table_bands(spark: SparkSession, d: str) -> DataFrame:
    return _bands(spark, d).withColumns({c: F.round(c, 6) for c in ("lo", "hi")})


@query(f"SELECT r.page, r.number AS row, c.number AS \"column\", round(c.lo, 6) AS x1, round(r.lo, 6) AS y1, round(c.hi, 6) AS x2, round(r.hi, 6) AS y2 FROM {_BANDSQL} r JOIN {_BANDSQL} c ON r.page = c.page AND r.axis = 'row' AND c.axis = 'column' WHERE c.hi - c.lo >= 4 AND r.hi - r.lo >= 4")
def q83_table_cells(spark: SparkSession, d: str) -> DataFrame:
    return detection.table_cells(_bands(spark, d), ["page"]).withColumns({c: F.round(c, 6) for c in ("x1", "y1", "x2", "y2")})


@query()
def q84_boundary_f1(spark: SparkSession, d: str) -> DataFrame:
    """Words of crops by their blanks, against the same blanks without the narrow steps."""
    m = table(spark, d, "measure_row").filter("size(gap_x) > 1").select("measure_id", "gap_x").dropDuplicates(["measure_id"])

    def spans(c: Column) -> DataFrame:
        n = F.size("g")
        x = m.withColumn("g", c).filter(n > 1).select("measure_id", F.posexplode(F.arrays_zip(F.slice("g", 1, n - 1).alias("a"), F.slice("g", 2, n - 1).alias("b"))).alias("seq", "s"))
        return x.select(F.col("measure_id").alias("line"), F.col("seq").cast("long").alias("seq"), "s.a", "s.b")

    wide = F.filter("gap_x", lambda x, i: (i == 0) | (x - F.get("gap_x", i - 1) >= 40))
    return detection.boundaries(spans(F.col("gap_x")), spans(wide), "line").select("n_lines", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "exact_count_rate")])


@query(f"SELECT seq, round_even(least(greatest(x1, 0), 799), 0)::INT AS x1, round_even(least(greatest(y1, 0), 999), 0)::INT AS y1, round_even(least(greatest(x2, 1), 800), 0)::INT AS x2, round_even(least(greatest(y2, 1), 1000), 0)::INT AS y2 FROM {_BOXES} WHERE round_even(least(greatest(x2, 1), 800), 0) > round_even(least(greatest(x1, 0), 799), 0) AND round_even(least(greatest(y2, 1), 1000), 0) > round_even(least(greatest(y1, 0), 999), 0)")
def q85_crop_rects(spark: SparkSession, d: str) -> DataFrame:
    return _boxes(spark, d).select("seq", geometry.crop_rect(F.lit(800.0), F.lit(1000.0)).alias("r")).filter("r is not null").select("seq", "r.*")


@query("SELECT textline_id, t.x1 + r.x1 AS x1, t.y1 + r.y1 AS y1, t.x2 + r.x1 AS x2, t.y2 + r.y1 AS y2 FROM (SELECT DISTINCT textline_id, doc_id, page_index, region_id, x1, y1, x2, y2 FROM textline) t JOIN (SELECT DISTINCT region_key, doc_id, page_index, region_id, x1, y1 FROM regions) r USING (doc_id, page_index, region_id)")
def q85_offset_boxes(spark: SparkSession, d: str) -> DataFrame:
    key = [*_PAGE, "region_id"]
    t = once(spark, d, "textline", "textline_id", *key, "x1", "y1", "x2", "y2")
    r = once(spark, d, "regions", "region_key", *key, "x1", "y1").withColumnsRenamed({"x1": "rx", "y1": "ry"})
    return t.join(r, key).select("textline_id", *geometry.offset(F.col("rx"), F.col("ry")))


@query(f"""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN t < 0.08 AND a > 3 THEN 'header' WHEN t > 0.88 AND a > 3 THEN 'footer' WHEN t > 0.85 AND bw < 160 THEN 'page_number' WHEN p < 0.015 AND a < 1.5 THEN 'stamp_seal' WHEN bh > 250 AND bw > 480 THEN 'table' WHEN bh < 60 AND t < 0.2 AND bw > 240 THEN 'title' WHEN bh < 60 AND a > 5 THEN 'caption' WHEN p < 0.02 THEN 'signature' ELSE 'text' END AS kind
    FROM (SELECT x2 - x1 AS bw, y2 - y1 AS bh, y1 / 1000 AS t, (x2 - x1) * (y2 - y1) / 800000 AS p, (x2 - x1) / greatest(y2 - y1, 1) AS a FROM {_BOXES})) GROUP BY kind""")
def q86_regions_by_place(spark: SparkSession, d: str) -> DataFrame:
    return _boxes(spark, d).groupBy(geometry.region_by_place(F.lit(800.0), F.lit(1000.0)).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT a.seq AS seq_a, b.seq AS seq_b, round(i / greatest(1, aa + ab - i), 6) AS iou, round(CASE WHEN greatest(a.y2, b.y2) > least(a.y1, b.y1) THEN greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) / (greatest(a.y2, b.y2) - least(a.y1, b.y1)) ELSE 0 END, 6) AS iou_y FROM (SELECT a, b, CASE WHEN least(a.x2, b.x2) > greatest(a.x1, b.x1) AND least(a.y2, b.y2) > greatest(a.y1, b.y1) THEN (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) ELSE 0 END AS i, (a.x2 - a.x1) * (a.y2 - a.y1) AS aa, (b.x2 - b.x1) * (b.y2 - b.y1) AS ab FROM " + _BOXES + " a JOIN " + _BOXES + " b ON a.page = b.page AND a.seq < b.seq) WHERE i / greatest(1, aa + ab - i) >= 0.5")
def q87_overlaps_flagged(spark: SparkSession, d: str) -> DataFrame:
    b = _boxes(spark, d)
    side = lambda t: b.select("page", F.col("seq").alias(f"seq_{t}"), *[F.col(c).alias(c + t) for c in ("x1", "y1", "x2", "y2")])
    j = side("a").join(side("b"), "page").filter("seq_a < seq_b").withColumn("iou", geometry.iou_integer("a", "b")).filter("iou >= 0.5")
    return j.select("seq_a", "seq_b", F.round("iou", 6).alias("iou"), F.round(geometry.iou_1d(F.col("y1a"), F.col("y2a"), F.col("y1b"), F.col("y2b")), 6).alias("iou_y"))


# --- order and text ---------------------------------------------------------------------------------------


@query("SELECT doc_id, page_index, region_id, CASE WHEN n > 1 THEN 'mixed' ELSE s END AS script FROM (SELECT doc_id, page_index, region_id, count(DISTINCT script) FILTER (WHERE regexp_matches(text, '[^" + _W[1:-1] + "]')) AS n, min(script) FILTER (WHERE regexp_matches(text, '[^" + _W[1:-1] + "]')) AS s FROM textline GROUP BY ALL)")
def q88_region_script(spark: SparkSession, d: str) -> DataFrame:
    return compose.region_script(table(spark, d, "textline").select(*_PAGE, "region_id", "script", "text"), [*_PAGE, "region_id"])


@query("SELECT doc_id, page_index, region_id, coalesce(string_agg(regexp_replace(regexp_replace(text, '^" + _W + "+', ''), '" + _W + "+$', ''), ' ' ORDER BY line_no, textline_id) FILTER (WHERE regexp_matches(text, '[^" + _W[1:-1] + "]')), '') AS text, round(avg(confidence), 9) AS confidence, count(*) AS n_chunks FROM (SELECT DISTINCT textline_id, doc_id, page_index, region_id, line_no, text, confidence FROM textline) GROUP BY ALL")
def q89_chunks_merged(spark: SparkSession, d: str) -> DataFrame:
    t = once(spark, d, "textline", "textline_id", *_PAGE, "region_id", "line_no", "text", "confidence").withColumn("o", F.struct("line_no", "textline_id"))
    return recognise.chunks_merged(t, [*_PAGE, "region_id"], "o").withColumn("confidence", F.round("confidence", 9))


@query("SELECT textline_id, lag(textline_id) OVER w AS previous, lead(textline_id) OVER w AS next FROM (SELECT DISTINCT textline_id, doc_id, page_index, region_id, line_no FROM textline) WINDOW w AS (PARTITION BY doc_id, page_index ORDER BY region_id, line_no, textline_id)")
def q90_previous_and_next(spark: SparkSession, d: str) -> DataFrame:
    return curate.neighbours(once(spark, d, "textline", "textline_id", *_PAGE, "region_id", "line_no"), _PAGE, ["region_id", "line_no"], "textline_id").select("textline_id", "previous", "next")


@query("SELECT doc_id, page_index, region_id, n, lo = 0 AND hi = n - 1 AND k = n AS consecutive FROM (SELECT doc_id, page_index, region_id, count(*) AS n, min(line_no) AS lo, max(line_no) AS hi, count(DISTINCT line_no) AS k FROM (SELECT DISTINCT textline_id, doc_id, page_index, region_id, line_no FROM textline) GROUP BY ALL)")
def q91_consecutive_groups(spark: SparkSession, d: str) -> DataFrame:
    t = once(spark, d, "textline", "textline_id", *_PAGE, "region_id", "line_no").withColumn("k", F.col("line_no") + 1)
    return curate.consecutive(t, [*_PAGE, "region_id"], "k")


_RUNS = "(SELECT doc_id, page_index, on_, min(page_pos) AS f, max(page_pos) AS t FROM (SELECT *, page_pos - row_number() OVER (PARTITION BY doc_id, page_index, on_ ORDER BY page_pos) AS g FROM (SELECT doc_id, page_index, y AS page_pos, ink > 1 AS on_ FROM p)) WHERE on_ GROUP BY doc_id, page_index, on_, g)"


@query("WITH p AS (SELECT doc_id, page_index, floor(y1 / 50)::INT AS y, count(*) AS ink FROM (SELECT DISTINCT textline_id, doc_id, page_index, y1 FROM textline) GROUP BY ALL) SELECT doc_id, page_index, f AS run_from, t AS run_to, t - f + 1 AS length FROM " + _RUNS + " WHERE t - f + 1 >= 2")
def q92_profile_runs(spark: SparkSession, d: str) -> DataFrame:
    p = once(spark, d, "textline", "textline_id", *_PAGE, "y1").groupBy(*_PAGE, F.floor(F.col("y1") / 50).cast("int").alias("y")).agg(F.count("*").alias("ink"))
    return layout.runs(p, _PAGE, "y", F.col("ink") > 1, 2)


@query("WITH p AS (SELECT doc_id, page_index, floor(y1 / 50)::INT AS y, count(*) AS ink FROM (SELECT DISTINCT textline_id, doc_id, page_index, y1 FROM textline) GROUP BY ALL) SELECT doc_id, page_index, y, ink, round(sum(ink) OVER (PARTITION BY doc_id, page_index ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3, 6) AS smooth FROM p")
def q93_moving_average(spark: SparkSession, d: str) -> DataFrame:
    p = once(spark, d, "textline", "textline_id", *_PAGE, "y1").groupBy(*_PAGE, F.floor(F.col("y1") / 50).cast("int").alias("y")).agg(F.count("*").alias("ink"))
    return layout.smoothed(p, _PAGE, "y", "ink", 3).withColumn("smooth", F.round("smooth", 6))


@query("""WITH r AS (SELECT doc_id, page_index, region_id, count(*) AS k FROM (SELECT DISTINCT textline_id, doc_id, page_index, region_id FROM textline) GROUP BY ALL), p AS (SELECT *, sum(k) OVER (PARTITION BY doc_id, page_index) + 1 AS n, sum(k) OVER (PARTITION BY doc_id, page_index) AS s, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY region_id DESC) = 1 AS last FROM r),
    q AS (SELECT *, greatest(1, round_even(k::DOUBLE / s * n, 0))::INT AS m FROM p), z AS (SELECT *, least(n, coalesce(sum(m) OVER (PARTITION BY doc_id, page_index ORDER BY region_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS f FROM q) SELECT doc_id, page_index, region_id, f AS from_line, CASE WHEN last THEN n ELSE least(f + m, n) END::INT AS to_line FROM z""")
def q94_lines_assigned(spark: SparkSession, d: str) -> DataFrame:
    r = once(spark, d, "textline", "textline_id", *_PAGE, "region_id").groupBy(*_PAGE, "region_id").agg(F.count("*").alias("k"))
    r = r.withColumn("n", F.sum("k").over(Window.partitionBy(*_PAGE)) + 1)
    return curate.assigned_lines(r, _PAGE, "region_id", "k", "n")


# --- sets, checks and samples -----------------------------------------------------------------------------


@query(f"SELECT 'target_known' AS rule, m.target AS key, 'absent' AS detail FROM (SELECT DISTINCT target FROM {_MAPSQL}) m WHERE m.target NOT IN (SELECT class_name FROM {_DET} WHERE class_name IS NOT NULL)")
def q95_class_map_gaps(spark: SparkSession, d: str) -> DataFrame:
    m = spark.createDataFrame(_MAP, "source string, target string")
    return curate.class_map_gaps(m, table(spark, d, _DET).filter("class_name is not null").select(F.col("class_name").alias("target")).distinct())


@query("SELECT rule, count(*) AS n FROM (SELECT 'file_exists' AS rule, p FROM (SELECT DISTINCT image_path AS p FROM index_test WHERE image_path IS NOT NULL) WHERE p NOT IN (SELECT image_path FROM measure_row WHERE image_path IS NOT NULL) UNION ALL SELECT 'in_manifest', p FROM (SELECT DISTINCT image_path AS p FROM measure_row WHERE image_path IS NOT NULL) WHERE p NOT IN (SELECT image_path FROM index_test WHERE image_path IS NOT NULL)) GROUP BY rule")
def q96_coverage_both_ways(spark: SparkSession, d: str) -> DataFrame:
    side = lambda n: table(spark, d, n).filter("image_path is not null").select("image_path")
    return curate.coverage_gaps(side("index_test"), side("measure_row"), "image_path").groupBy("rule").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n_words FROM (SELECT unnest(string_split(text, ' ')) AS w FROM index_test WHERE text IS NOT NULL UNION SELECT unnest(string_split(text, ' ')) FROM textline) WHERE w <> ''")
def q97_vocabulary_union(spark: SparkSession, d: str) -> DataFrame:
    w = lambda n: table(spark, d, n).filter("text is not null").select(F.explode(F.split("text", " ")).alias("w"))
    return w("index_test").union(w("textline")).filter("w <> ''").distinct().agg(F.count("*").alias("n_words"))


@query("SELECT 'in_one_part' AS rule, image_path AS key, 'parts=' || count(DISTINCT split) AS detail FROM index_test WHERE image_path IS NOT NULL AND split IN ('train', 'val', 'test') GROUP BY image_path HAVING count(DISTINCT split) > 1")
def q98_union_overlaps(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "index_test").filter("image_path is not null").select("image_path", "split")
    return curate.united([t.filter(F.col("split") == s) for s in ("train", "val", "test")], "image_path")[1]


@query("SELECT part, language, count(*) AS n FROM (SELECT DISTINCT row_id, source, language, CASE WHEN r <= ceil(n / 2) THEN 'tune' ELSE 'check' END AS part FROM (SELECT DISTINCT row_id, source, language FROM index_test) JOIN (SELECT source, row_id AS k, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || row_id::VARCHAR), row_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM (SELECT DISTINCT row_id, source FROM index_test)) USING (source) WHERE row_id = k) GROUP BY ALL")
def q99_tune_check(spark: SparkSession, d: str) -> DataFrame:
    return curate.halved(once(spark, d, "index_test", "row_id", "source", "language"), "row_id", ["source"]).groupBy("part", "language").agg(F.count("*").alias("n"))


@query("SELECT pool, count(*) AS n, min(h) AS first FROM (SELECT row_id, pool, h FROM (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY h, row_id) AS r FROM (SELECT row_id, CASE split WHEN 'val' THEN 'manual' WHEN 'test' THEN 'pseudo' ELSE 'general' END AS pool, md5('42:' || row_id::VARCHAR) AS h FROM (SELECT DISTINCT row_id, split FROM index_test))) WHERE pool <> 'general' OR r <= (SELECT count(DISTINCT row_id) FROM index_test WHERE split IN ('val', 'test'))) GROUP BY pool")
def q100_pools_mixed(spark: SparkSession, d: str) -> DataFrame:
    t = once(spark, d, "index_test", "row_id", "split").withColumn("coverage", F.lit(1.0))
    part = lambda s: t.filter(F.col("split") == s)
    p = curate.pooled({"manual": (part("val"), 0.8), "pseudo": (part("test"), 0.6), "general": (part("train"), 0.999)}, "general", "row_id", "coverage")
    return p.groupBy("pool").agg(F.count("*").alias("n"), F.min(curate.hashed(F.col("row_id"))).alias("first"))


@query("SELECT stage, row_id FROM (SELECT 0 AS stage, row_id, row_number() OVER (ORDER BY md5('42:' || row_id::VARCHAR), row_id) AS r FROM (SELECT DISTINCT row_id FROM index_test WHERE split = 'train')) WHERE r <= 40 UNION ALL SELECT stage, row_id FROM (SELECT 1 AS stage, row_id, row_number() OVER (ORDER BY md5('42:' || row_id::VARCHAR), row_id) AS r FROM (SELECT DISTINCT row_id FROM index_test WHERE split = 'val')) WHERE r <= 10")
def q101_curriculum_mix(spark: SparkSession, d: str) -> DataFrame:
    t = once(spark, d, "index_test", "row_id", "split")
    return curate.limited_mix([(t.filter("split = 'train'").select("row_id"), 40), (t.filter("split = 'val'").select("row_id"), 10)], "row_id").select("stage", "row_id")


@query("SELECT textline_id, script FROM (SELECT *, row_number() OVER (PARTITION BY script ORDER BY h, textline_id) AS c FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY h, textline_id) AS p FROM (SELECT *, md5('42:' || textline_id::VARCHAR) AS h FROM (SELECT DISTINCT textline_id, doc_id, page_index, script FROM textline))) WHERE p <= 2) WHERE c <= 20")
def q102_capped_harvest(spark: SparkSession, d: str) -> DataFrame:
    return curate.harvested(once(spark, d, "textline", "textline_id", *_PAGE, "script"), _PAGE, ["script"], "textline_id", 2, 20).select("textline_id", "script")


@query("SELECT textline_id, 4 AS n_words, array_to_string(w[1:4], ' ') AS text FROM (SELECT textline_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM (SELECT DISTINCT textline_id, text FROM textline)) WHERE len(w) >= 4")
def q103_synthetic_lines(spark: SparkSession, d: str) -> DataFrame:
    w = once(spark, d, "textline", "textline_id", "text").select("textline_id", F.posexplode(F.filter(F.split("text", " "), lambda x: x != "")).alias("k", "text")).withColumn("k", F.col("k") + 1)
    return curate.synthetic_lines(w, ["textline_id"], "k", 4)


@query("SELECT measure_id, bucket FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5('42:' || measure_id::VARCHAR), measure_id) AS r FROM (SELECT DISTINCT measure_id, CASE WHEN height32_width_before_cap <= 256 THEN 'a' WHEN height32_width_before_cap <= 512 THEN 'b' ELSE 'c' END AS bucket FROM measure_row)) WHERE r <= 30")
def q104_bucketed_sample(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("height32_width_before_cap")
    return curate.bucketed_sample(once(spark, d, "measure_row", "measure_id", "height32_width_before_cap"), F.when(v <= 256, "a").when(v <= 512, "b").otherwise("c"), 30, "measure_id").select("measure_id", "bucket")


@query("SELECT row_id, coalesce(m.augmented, 'no') AS augmented FROM (SELECT DISTINCT row_id, image_path FROM index_test) i LEFT JOIN (SELECT image_path, max(CASE WHEN augmented THEN 'yes' END) AS augmented FROM measure_row GROUP BY image_path) m USING (image_path)")
def q105_enriched(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "measure_row").groupBy("image_path").agg(F.max(F.when(F.col("augmented"), "yes")).alias("augmented"))
    return curate.enriched(once(spark, d, "index_test", "row_id", "image_path"), m, "image_path", {"augmented": "no"}).select("row_id", "augmented")


@query(f"SELECT name AS class_name, coalesce(n, 0) AS found, 100 AS expected, coalesce(n, 0) - 100 AS difference FROM (VALUES ('text'), ('title'), ('table'), ('never')) c(name) LEFT JOIN (SELECT class_name, count(DISTINCT det_id) AS n FROM {_DET} GROUP BY class_name) x ON x.class_name = c.name")
def q106_labels_recounted(spark: SparkSession, d: str) -> DataFrame:
    want = spark.createDataFrame([(c, 100) for c in ("text", "title", "table", "never")], "class_name string, expected int")
    return curate.recounted(once(spark, d, _DET, "det_id", "class_name"), want, "class_name")


@query("SELECT coalesce(f.split, p.split) AS split, coalesce(p.wanted, 0) AS wanted, coalesce(f.found, 0) AS found FROM (SELECT split, count(DISTINCT row_id) AS found FROM index_test GROUP BY split) f FULL JOIN (VALUES ('train', 1), ('extra', 5)) p(split, wanted) ON p.split = f.split WHERE coalesce(p.wanted, 0) <> coalesce(f.found, 0)")
def q107_plan_gaps(spark: SparkSession, d: str) -> DataFrame:
    plan = spark.createDataFrame([("train", 1), ("extra", 5)], "split string, wanted int")
    return curate.plan_gaps(once(spark, d, "index_test", "row_id", "split"), plan, ["split"])


@query(f"SELECT 'class' AS kind, name, coalesce(n, 0) AS n FROM (VALUES ('text'), ('title'), ('never')) c(name) LEFT JOIN (SELECT class_name, count(DISTINCT det_id) AS n FROM {_DET} GROUP BY class_name) x ON x.class_name = c.name UNION ALL SELECT 'pages_without', '', count(*) FROM (SELECT DISTINCT image FROM {_DET}) WHERE image NOT IN (SELECT image FROM {_DET} WHERE conf >= 0.9)")
def q108_prelabel_summary(spark: SparkSession, d: str) -> DataFrame:
    b = once(spark, d, _DET, "det_id", "image", "class_name", "conf")
    classes = spark.createDataFrame([("text",), ("title",), ("never",)], "class_name string")
    per = curate.prelabel_summary(b, b, classes, "image", "class_name").filter("kind = 'class'")
    return per.unionByName(curate.prelabel_summary(b.filter("conf >= 0.9"), b, classes, "image", "class_name").filter("kind = 'pages_without'"))


@query("SELECT DISTINCT row_id, coalesce(nullif(regexp_extract(p, '(?:^|/)((?:hindi|marathi)/.+)$', 1), ''), p) AS path FROM (SELECT row_id, replace(image_path, chr(92), '/') AS p FROM index_test)")
def q109_portable_paths(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "index_test", "row_id", "image_path").select("row_id", curate.portable_path(F.col("image_path"), ["hindi", "marathi"]).alias("path"))


@query(r"SELECT count(*) AS n FROM (SELECT DISTINCT row_id, text FROM index_test) WHERE text IS NULL OR text = '' OR length(regexp_replace(text, '[^a-z ]', '', 'g')) / length(text) >= 0.9")
def q110_covered_rows(spark: SparkSession, d: str) -> DataFrame:
    return curate.covered(once(spark, d, "index_test", "row_id", "text"), "text", [*"abcdefghijklmnopqrstuvwxyz "], 0.9).agg(F.count("*").alias("n"))


@query(f"SELECT coalesce(class_name, '') AS class_name, count(*) FILTER (WHERE s = 'ok') AS ok, count(*) FILTER (WHERE s = 'clamped') AS clamped, 0::BIGINT AS unrecoverable, count(*) FILTER (WHERE s = 'degenerate') AS degenerate, 0::BIGINT AS other FROM (SELECT class_name, CASE WHEN cx BETWEEN 0 AND 1 AND cy BETWEEN 0 AND 1 AND w BETWEEN 0 AND 1 AND h BETWEEN 0 AND 1 AND w > 0 AND h > 0 THEN 'ok' WHEN least(1, greatest(0, w)) < 0.001 OR least(1, greatest(0, h)) < 0.001 THEN 'degenerate' ELSE 'clamped' END AS s FROM (SELECT DISTINCT det_id, class_name, round(cx, 6) AS cx, round(cy, 6) AS cy, round(w, 6) AS w, round(h, 6) AS h FROM {_DET})) GROUP BY 1")
def q111_repair_summary(spark: SparkSession, d: str) -> DataFrame:
    b = once(spark, d, _DET, "det_id", "class_id", "class_name", "cx", "cy", "w", "h")
    line = F.concat_ws(" ", F.col("class_id").cast("string"), *[F.format_string("%.6f", c) for c in ("cx", "cy", "w", "h")])
    return curate.repair_summary(b.select(F.coalesce("class_name", F.lit("")).alias("class_name"), curate.repaired_label(line)[1].alias("status")), ["class_name"])


@query(f"WITH b AS (SELECT DISTINCT det_id, class_id, cx, cy, w, h FROM {_DET}), r AS (SELECT 'bad_value' AS rule, det_id FROM b WHERE NOT (cx BETWEEN 0 AND 1 AND cy BETWEEN 0 AND 1 AND w BETWEEN 0 AND 1 AND h BETWEEN 0 AND 1) UNION ALL SELECT 'bad_size', det_id FROM b WHERE w <= 0 OR h <= 0 UNION ALL SELECT 'bad_class', det_id FROM b WHERE class_id NOT BETWEEN 0 AND 10) SELECT rule, rank, det_id FROM (SELECT rule, det_id, row_number() OVER (PARTITION BY rule ORDER BY det_id) AS rank FROM r) WHERE rank <= 10")
def q112_first_offenders(spark: SparkSession, d: str) -> DataFrame:
    return curate.offenders(once(spark, d, _DET, "det_id", "class_id", "cx", "cy", "w", "h"), "det_id")


@query()
def q113_random_split_baseline(spark: SparkSession, d: str) -> DataFrame:
    p = once(spark, d, "index_test", "row_id", "image_path").select(text.filename_parts(F.regexp_replace("image_path", r"^.*[/\\]", "")).alias("p")).filter("p.number <> ''")
    n = p.select(F.lower("p.prefix").alias("series"), F.col("p.number").cast("long").alias("number"))
    return curate.random_split_baseline(n, ["series"], "number", 10, 3).withColumn("baseline", F.round("baseline", 6))


@query("SELECT backend, least, round(score, 6) AS score FROM (SELECT backend, least, score, row_number() OVER (PARTITION BY backend ORDER BY score DESC, least) AS r FROM (SELECT coalesce(backend, '') AS backend, k.least, 2.0 * count(*) FILTER (WHERE confidence >= k.least AND length(text) > 40) / (count(*) FILTER (WHERE confidence >= k.least) + count(*) FILTER (WHERE length(text) > 40)) AS score FROM (SELECT DISTINCT textline_id, backend, confidence, text FROM textline), (SELECT unnest([0.6::DOUBLE, 0.7, 0.8, 0.9]) AS least) k GROUP BY ALL)) WHERE r = 1")
def q114_sweep_best(spark: SparkSession, d: str) -> DataFrame:
    t = once(spark, d, "textline", "textline_id", "backend", "confidence", "text").select(F.coalesce("backend", F.lit("")).alias("backend"), "confidence", (F.length("text") > 40).alias("long"))
    x = t.withColumn("least", F.explode(F.array(*[F.lit(v) for v in (0.6, 0.7, 0.8, 0.9)])))
    told = F.coalesce(F.col("confidence") >= F.col("least"), F.lit(False))
    s = x.groupBy("backend", "least").agg(F.count_if(told & F.col("long")).alias("tp"), F.count_if(told).alias("p"), F.count_if("long").alias("t"))
    return scoring.best_of(s, ["backend"], F.round(2.0 * F.col("tp") / (F.col("p") + F.col("t")), 12), ["least"]).withColumn("score", F.round("score", 6))


@query(f"SELECT round(avg(n) FILTER (WHERE n > 0), 6) AS mean_present, round(sum(n) / 14.0, 6) AS mean_all FROM (SELECT class_name, count(DISTINCT det_id)::DOUBLE AS n FROM {_DET} WHERE class_name IS NOT NULL GROUP BY class_name)")
def q115_two_means(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, _DET).filter("class_name is not null").groupBy("class_name").agg(F.count_distinct("det_id").cast("double").alias("n"))
    return scoring.two_means(g, "n", "n", 14)


@query("SELECT coalesce(a.lang, b.lang) AS lang, a.n AS reported, b.n AS recomputed, round(b.n - a.n, 9) AS difference FROM (SELECT lang, count(*)::DOUBLE AS n FROM documents WHERE lang IN ('mr', 'hi') GROUP BY lang) a FULL JOIN (SELECT lang, count(*)::DOUBLE AS n FROM documents WHERE lang IN ('hi', 'en') AND text IS NOT NULL GROUP BY lang) b ON a.lang = b.lang")
def q116_reported_recomputed(spark: SparkSession, d: str) -> DataFrame:
    g = lambda langs, ok="true": table(spark, d, "documents").filter(F.col("lang").isin(*langs)).filter(ok).groupBy("lang").agg(F.count("*").cast("double").alias("n"))
    return scoring.compared(g(["mr", "hi"]), g(["hi", "en"], "text is not null"), "lang", "n")


@query("SELECT source, n AS value, 100::BIGINT AS expected FROM (SELECT source, count(*) AS n FROM documents GROUP BY source) WHERE abs(n - 100) > 50")
def q117_off_reference(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("value"))
    return scoring.off_reference(g, g.select("source", F.lit(100).cast("long").alias("value")), "source", "value", 50)


@query(f"SELECT split, count(*) AS rows, count(*) FILTER (WHERE regexp_matches(text, '[^{_W[1:-1]}]')) AS with_text, count(DISTINCT image_path) AS files FROM (SELECT DISTINCT row_id, split, text, image_path FROM index_test) GROUP BY split")
def q118_row_and_file_counts(spark: SparkSession, d: str) -> DataFrame:
    t = once(spark, d, "index_test", "row_id", "split", "text", "image_path")
    return t.groupBy("split").agg(F.count("*").alias("rows"), F.count_if(F.coalesce(F.col("text").rlike(r"(?U)\S"), F.lit(False))).alias("with_text"), F.count_distinct("image_path").alias("files"))
