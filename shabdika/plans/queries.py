"""Queries over the project's tables, each with the SQL it is held against where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import edit, geometry, markup, text
from ..operators import compose, curate, detection, layout, ranks, recognise
from ..sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: White space and marks as SQL has to spell them.
_W = r"[\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_DET = "detections_20261017_203514"


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def once(spark: SparkSession, d: str, name: str, *cols: str) -> DataFrame:
    """Rows of a table without re-deliveries."""
    return table(spark, d, name).select(*cols).distinct()


def _score_sql(c: str) -> str:
    c = rf"nfc_normalize(regexp_replace({c}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'))"
    for k, v in text.NUKTA.items():
        c = f"replace({c}, '{k}', '{v}')"
    c = f"regexp_replace({c}, '[‌‍]', '', 'g')"
    return f"trim(regexp_replace({c}, '{_W}+', ' ', 'g'), ' ')"


def _clean_sql(c: str) -> str:
    c = rf"nfc_normalize(regexp_replace({c}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'))"
    for k, v in text.NUKTA.items():
        c = f"replace({c}, '{k}', '{v}')"
    join = rf"({text.CONSONANT}\x{{94d}})(?:{_W}|[\x{{200c}}\x{{200d}}])+({text.CONSONANT})"
    for _ in range(2):
        c = rf"regexp_replace({c}, '{join}', '\1\2', 'g')"
    c = rf"regexp_replace({c}, '({text.CONSONANT}){_W}+({text.MARK})', '\1\2', 'g')"
    c = rf"regexp_replace({c}, '(^|{_W}){text.MARK}+', '\1', 'g')"
    c = rf"regexp_replace({c}, '{_W}+([,;:!?.।॥])', '\1', 'g')"
    for _ in range(2):
        c = rf"regexp_replace({c}, '([,;:।॥])([^\t\n\x0b\f\r \x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}])', '\1 \2', 'g')"
    c = rf"regexp_replace(regexp_replace({c}, '[ \t]{{2,}}', ' ', 'g'), '\n\n\n+', chr(10) || chr(10), 'g')"
    c = rf"regexp_replace({c}, '[\t\x0b\f\r \x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+\n', chr(10), 'g')"
    return rf"nfc_normalize(regexp_replace(regexp_replace({c}, '^{_W}+', '', 'g'), '{_W}+$', '', 'g'))"


# --- scoring -------------------------------------------------------------------------------------

# Systems to score: A reads four letters as signs that no text has, B leaves a letter out, C misreads words with a letter.
_LOST = "aeाे"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = once(spark, d, "index_test", "row_id", "text", "language", "source").filter("text is not null")
    ref = text.normalize_for_scoring(F.col("text"))
    return rows.select("row_id", F.coalesce(F.lower(F.trim("language")), F.lit("")).alias("lang"), "source", ref.alias("reference"))


_PAIRS = f"(SELECT row_id, coalesce(lower(trim(language)), '') AS lang, source, {_score_sql('text')} AS reference FROM (SELECT DISTINCT row_id, text, language, source FROM index_test WHERE text IS NOT NULL))"


def _substituted(c: Column) -> Column:
    return F.translate(c, _LOST, "①②③④")


@query(f"""SELECT lang, count(*) AS n_docs, sum(e)::BIGINT AS errors, sum(length(reference))::BIGINT AS ref_chars,
    round(sum(e) / nullif(sum(length(reference)), 0), 6) AS cer, round(avg(CASE WHEN length(reference) = 0 THEN 0 ELSE e / length(reference) END), 6) AS mean_doc_cer
    FROM (SELECT *, length(regexp_replace(reference, '[^{_LOST}]', '', 'g')) AS e FROM {_PAIRS}) GROUP BY lang""")
def q01_corpus_cer_by_lang(spark: SparkSession, d: str) -> DataFrame:
    return edit.corpus(_pairs(spark, d).withColumn("hypothesis", _substituted(F.col("reference"))), "lang")


@query(f"""SELECT lang, count(*) AS n_docs, sum(e)::BIGINT AS errors, sum(n)::BIGINT AS ref_words, round(sum(e) / nullif(sum(n), 0), 6) AS wer
    FROM (SELECT lang, len(w) AS n, len(list_filter(w, lambda x: regexp_matches(x, '[aा]'))) AS e FROM (SELECT lang, list_filter(string_split(reference, ' '), lambda x: x <> '') AS w FROM {_PAIRS})) GROUP BY lang""")
def q02_corpus_wer_by_lang(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d).withColumn("hypothesis", F.regexp_replace("reference", r"(\S*[aा]\S*)", "①$1"))
    r, h = text.words(F.col("reference")), text.words(F.col("hypothesis"))
    p = p.select("lang", edit.word_distance(r, h).alias("e"), F.size(r).alias("n"))
    return p.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("e").cast("long").alias("errors"), F.sum("n").cast("long").alias("ref_words"), F.round(F.sum("e") / F.nullif(F.sum("n"), F.lit(0)), 6).alias("wer"))


@query(f"""SELECT lang, 0::BIGINT AS substitutions, sum(length(reference) - length(replace(reference, 'व', '')))::BIGINT AS deletions, 0::BIGINT AS insertions FROM {_PAIRS} GROUP BY lang""")
def q03_edit_ops(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d).withColumn("o", edit.edit_ops(F.col("reference"), F.replace("reference", F.lit("व"), F.lit(""))))
    return p.groupBy("lang").agg(F.sum("o.s").cast("long").alias("substitutions"), F.sum("o.d").cast("long").alias("deletions"), F.sum("o.i").cast("long").alias("insertions"))


@query(f"""SELECT source, round(avg(CASE WHEN regexp_matches(reference, '[{_LOST}]') THEN 0 ELSE 1 END), 6) AS exact_accuracy,
    round(sum(len(list_filter(w, lambda x: NOT regexp_matches(x, '[{_LOST}]')))) / nullif(sum(len(w)), 0), 6) AS positional_accuracy
    FROM (SELECT source, reference, list_filter(string_split(reference, ' '), lambda x: x <> '') AS w FROM {_PAIRS}) GROUP BY source""")
def q04_exact_and_positional_accuracy(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d).withColumn("h", _substituted(F.col("reference")))
    r, h = text.words(F.col("reference")), text.words(F.col("h"))
    p = p.withColumn("n", F.size(r)).withColumn("same", F.size(F.filter(F.arrays_zip(r.alias("r"), h.alias("h")), lambda z: z["r"] == z["h"])))
    return p.groupBy("source").agg(F.round(F.avg((F.col("reference") == F.col("h")).cast("int")), 6).alias("exact_accuracy"), F.round(F.sum("same") / F.nullif(F.sum("n"), F.lit(0)), 6).alias("positional_accuracy"))


@query(f"""SELECT lang, sum(length(reference) - length(replace(reference, ' ', '')))::BIGINT AS ref_spaces, sum(length(h) - length(replace(h, ' ', '')))::BIGINT AS hyp_spaces,
    round(avg(CASE WHEN length(reference) - length(replace(reference, ' ', '')) = length(h) - length(replace(h, ' ', '')) THEN 1 ELSE 0 END), 6) AS same_share
    FROM (SELECT lang, reference, replace(reference, 'व ', 'व') AS h FROM {_PAIRS}) GROUP BY lang""")
def q05_space_metrics(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d).withColumn("h", F.replace("reference", F.lit("व "), F.lit("व")))
    a, b = F.regexp_count("reference", F.lit(" ")), F.regexp_count("h", F.lit(" "))
    return p.groupBy("lang").agg(F.sum(a).cast("long").alias("ref_spaces"), F.sum(b).cast("long").alias("hyp_spaces"), F.round(F.avg((a == b).cast("int")), 6).alias("same_share"))


@query(f"""SELECT lang, sum(length(n) - length(replace(n, 'व', '')))::BIGINT AS errors, sum(length(n))::BIGINT AS ref_chars, round(sum(length(n) - length(replace(n, 'व', ''))) / nullif(sum(length(n)), 0), 6) AS cer
    FROM (SELECT lang, replace(reference, ' ', '') AS n FROM {_PAIRS}) GROUP BY lang""")
def q06_cer_no_spaces(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d).withColumn("reference", F.replace("reference", F.lit(" "), F.lit("")))
    return edit.corpus(p.withColumn("hypothesis", F.replace("reference", F.lit("व"), F.lit(""))), "lang").select("lang", "errors", "ref_chars", "cer")


@query(f"""SELECT row_id, e AS distance, reference FROM (SELECT row_id, reference, translate(reference, '{_LOST}', '①②③④') AS h, length(regexp_replace(reference, '[^{_LOST}]', '', 'g')) AS e FROM {_PAIRS}) ORDER BY e DESC, encode(reference) DESC, encode(h) DESC, row_id LIMIT 10""")
def q07_worst_k(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d).select("row_id", edit.char_distance(F.col("reference"), _substituted(F.col("reference"))).alias("distance"), "reference")
    return p.orderBy(F.desc("distance"), F.desc("reference"), F.desc(_substituted(F.col("reference"))), "row_id").limit(10)


@query(f"""SELECT lang, count(*) FILTER (WHERE a AND b) AS both_right, count(*) FILTER (WHERE a AND NOT b) AS only_a, count(*) FILTER (WHERE NOT a AND b) AS only_b, count(*) FILTER (WHERE NOT a AND NOT b) AS both_wrong
    FROM (SELECT lang, NOT regexp_matches(reference, '[{_LOST}]') AS a, NOT contains(reference, 'व') AS b FROM {_PAIRS}) GROUP BY lang""")
def q08_paired_contingency(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d)
    a = F.col("reference") == _substituted(F.col("reference"))
    b = F.col("reference") == F.replace("reference", F.lit("व"), F.lit(""))
    n = lambda c: F.count_if(c)
    return p.groupBy("lang").agg(n(a & b).alias("both_right"), n(a & ~b).alias("only_a"), n(~a & b).alias("only_b"), n(~a & ~b).alias("both_wrong"))


@query(f"SELECT DISTINCT textline_id, {_score_sql('text')} AS scoring_form FROM textline")
def q09_scoring_normal_form(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "textline").select("textline_id", text.normalize_for_scoring(F.col("text")).alias("scoring_form")).distinct()


@query(f"SELECT DISTINCT textline_id, {_clean_sql('text')} AS clean FROM textline")
def q10_clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "textline").select("textline_id", text.clean_text(F.col("text")).alias("clean")).distinct()


@query(r"""SELECT textline_id, CASE WHEN s IS NULL THEN 'unknown' WHEN s >= 0.85 THEN 'deva' WHEN s <= 0.15 THEN 'latin' ELSE 'mixed' END AS script,
    round(CASE WHEN s IS NULL THEN 0 WHEN s >= 0.85 THEN s WHEN s <= 0.15 THEN 1 - s ELSE 1 - 2 * abs(s - 0.5) END, 6) AS confidence
    FROM (SELECT textline_id, d / nullif(d + a, 0) AS s FROM (SELECT DISTINCT textline_id, length(regexp_replace(text, '[^\x{900}-\x{97f}\x{a8e0}-\x{a8ff}]', '', 'g'))::DOUBLE AS d, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS a FROM textline))""")
def q11_script_of_text(spark: SparkSession, d: str) -> DataFrame:
    kind, conf = text.script_of_text(F.col("text"))
    return table(spark, d, "textline").select("textline_id", kind.alias("script"), F.round(conf, 6).alias("confidence")).distinct()


@query(r"""SELECT r AS rule_two, h AS has_devanagari, count(*) AS n FROM (SELECT CASE WHEN d > a THEN 'hindi' WHEN a > 0 THEN 'english' ELSE 'mixed' END AS r, coalesce(d::DOUBLE / nullif(l, 0) >= 0.2, false) AS h
    FROM (SELECT DISTINCT textline_id, length(regexp_replace(text, '[^\x{900}-\x{97f}]', '', 'g')) AS d, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS a, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS l FROM textline)) GROUP BY ALL""")
def q11_script_rules_two_three(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return once(spark, d, "textline", "textline_id", "text").groupBy(text.script_rule_two(t).alias("rule_two"), text.has_devanagari(t, 0.2).alias("has_devanagari")).agg(F.count("*").alias("n"))


_CHARS = "unnest(regexp_extract_all(text, '(?s).'))"


def _charset(spark: SparkSession, d: str) -> DataFrame:
    train = once(spark, d, "index_test", "row_id", "text", "split").filter("split = 'train' and text is not null")
    return train.select(F.explode(F.split("text", "")).alias("ch")).filter("ch <> ''").groupBy("ch").agg(F.count("*").alias("n")).filter("n >= 2")


_CHARSET = f"(SELECT ch, count(*) AS n FROM (SELECT {_CHARS} AS ch FROM (SELECT DISTINCT row_id, text FROM index_test WHERE split = 'train' AND text IS NOT NULL)) GROUP BY ch HAVING count(*) >= 2)"


@query(f"SELECT ch, n, row_number() OVER (ORDER BY unicode(ch)) AS idx FROM {_CHARSET}")
def q12_charset_build(spark: SparkSession, d: str) -> DataFrame:
    return _charset(spark, d).withColumn("idx", F.row_number().over(Window.orderBy(F.encode("ch", "utf-16be"))))  # one row per character


@query(f"""SELECT row_id, round(1 - coalesce(sum(CASE WHEN s.ch IS NULL THEN 1 ELSE 0 END), 0) / count(*), 6) AS coverage
    FROM (SELECT row_id, {_CHARS} AS ch FROM (SELECT DISTINCT row_id, text FROM index_test WHERE split <> 'train' AND text <> '')) c LEFT JOIN {_CHARSET} s USING (ch) GROUP BY row_id""")
def q13_charset_coverage(spark: SparkSession, d: str) -> DataFrame:
    rows = once(spark, d, "index_test", "row_id", "text", "split").filter("split <> 'train' and text <> ''")
    ch = rows.select("row_id", F.explode(F.split("text", "")).alias("ch")).filter("ch <> ''").groupBy("row_id", "ch").agg(F.count("*").alias("k"))
    j = ch.join(_charset(spark, d), "ch", "left")
    return j.groupBy("row_id").agg(F.round(1 - F.sum(F.when(F.col("n").isNull(), F.col("k")).otherwise(0)) / F.sum("k"), 6).alias("coverage"))


@query(f"""SELECT ch, count(*) AS n FROM (SELECT {_CHARS} AS ch FROM (SELECT DISTINCT row_id, text FROM index_test WHERE split <> 'train' AND text IS NOT NULL)) c
    WHERE ch NOT IN (SELECT ch FROM {_CHARSET}) GROUP BY ch ORDER BY n DESC, unicode(ch) LIMIT 12""")
def q14_missing_chars_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = once(spark, d, "index_test", "row_id", "text", "split").filter("split <> 'train' and text is not null")
    ch = rows.select(F.explode(F.split("text", "")).alias("ch")).filter("ch <> ''").groupBy("ch").agg(F.count("*").alias("n"))
    return ch.join(_charset(spark, d).select("ch"), "ch", "left_anti").orderBy(F.desc("n"), F.encode("ch", "utf-16be")).limit(12)


@query("""SELECT backend, count(*) AS words, count(*) FILTER (WHERE v.w IS NOT NULL) AS known, round(count(*) FILTER (WHERE v.w IS NOT NULL) / count(*), 6) AS known_rate
    FROM (SELECT coalesce(backend, '') AS backend, unnest(string_split(text, ' ')) AS w FROM (SELECT DISTINCT textline_id, text, backend FROM textline)) t
    LEFT JOIN (SELECT DISTINCT unnest(string_split(text, ' ')) AS w FROM index_test WHERE text IS NOT NULL) v USING (w) WHERE t.w <> '' GROUP BY backend""")
def q15_vocab_membership(spark: SparkSession, d: str) -> DataFrame:
    lines = once(spark, d, "textline", "textline_id", "text", "backend").select(F.coalesce("backend", F.lit("")).alias("backend"), F.explode(F.split("text", " ")).alias("w")).filter("w <> ''")
    seen = table(spark, d, "index_test").filter("text is not null").select(F.explode(F.split("text", " ")).alias("w")).distinct().withColumn("hit", F.lit(1))
    c = lines.groupBy("backend", "w").agg(F.count("*").alias("n")).join(seen, "w", "left")
    k = F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("n"))), F.lit(0))
    return c.groupBy("backend").agg(F.sum("n").alias("words"), k.alias("known"), F.round(k / F.sum("n"), 6).alias("known_rate"))


@query(rf"""SELECT region_key, line_no, line, (start + length(regexp_extract(raw, '^{_W}*')))::BIGINT AS span_from, (start + length(regexp_extract(raw, '^{_W}*')) + length(line))::BIGINT AS span_to
    FROM (SELECT region_key, i AS line_no, raw, regexp_replace(regexp_replace(raw, '^{_W}+', ''), '{_W}+$', '') AS line, coalesce(sum(length(raw) + 1) OVER (PARTITION BY region_key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM (SELECT region_key, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM (SELECT DISTINCT region_key, text FROM regions WHERE text IS NOT NULL))) WHERE line <> ''""")
def q16_line_split_offsets(spark: SparkSession, d: str) -> DataFrame:
    r = once(spark, d, "regions", "region_key", "text").filter("text is not null").select("region_key", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    before = Window.partitionBy("region_key").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("start", F.coalesce(F.sum(F.length("raw") + 1).over(before), F.lit(0))).withColumn("line", text.strip(F.col("raw")))
    lead = F.length(F.regexp_extract("raw", r"(?U)^(\s*)", 1))
    return r.filter("line <> ''").select("region_key", F.col("line_no").cast("long").alias("line_no"), "line", (F.col("start") + lead).cast("long").alias("span_from"), (F.col("start") + lead + F.length("line")).cast("long").alias("span_to"))


def _escaped(c: Column) -> Column:
    for k, v in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


# what marks come to, by what stands before them
_SETTLED = "replace(replace(text, ' | ', chr(2)), chr(10), chr(1))"
for _from, _to in ((r"(^|\n)[\x01\x02]+", r"\1"), (r"\t\x02*\x01[\x01\x02]*", "\t\n"), (r"\t\x02+", "\t"), (r"\x02+\x01[\x01\x02]*", "\t\n"), (r"\x01[\x01\x02]*", "\n"), (r"\x02+", "\t")):
    _SETTLED = f"regexp_replace({_SETTLED}, '{_from}', '{_to}', 'g')"


@query(f"SELECT DISTINCT region_key, trim({_SETTLED}, chr(10)) AS table_text FROM regions WHERE type = 'table' AND text IS NOT NULL")
def q17_html_table_text(spark: SparkSession, d: str) -> DataFrame:
    r = once(spark, d, "regions", "region_key", "type", "text").filter("type = 'table' and text is not null")
    html = F.concat(F.lit("<table><tr><td>"), F.replace(F.replace(_escaped(F.col("text")), F.lit(" | "), F.lit("</td><td>")), F.lit("\n"), F.lit("</td></tr><tr><td>")), F.lit("</td></tr></table>"))
    return r.select("region_key", markup.table_text(html).alias("table_text"))


@query()
def q17_html_table_all(spark: SparkSession, d: str) -> DataFrame:
    # a bar between blanks of any kind or at a line's end parts cells, also empty ones
    r = once(spark, d, "regions", "region_key", "type", "text").filter("type = 'table' and text is not null")
    html = F.concat(F.lit("<table><tr><td>"), F.replace(F.regexp_replace(_escaped(F.col("text")), r"(?U)(?<!\S)\|(?!\S)", "</td><td>"), F.lit("\n"), F.lit("</td></tr><tr><td>")), F.lit("</td></tr></table>"))
    return r.select("region_key", markup.table_text(html).alias("table_text"))


@query(f"SELECT DISTINCT region_key, regexp_replace(regexp_replace(replace(text, chr(10), chr(10) || chr(10)), '^{_W}+', ''), '{_W}+$', '') AS block_text FROM regions WHERE text IS NOT NULL")
def q18_html_block_text(spark: SparkSession, d: str) -> DataFrame:
    r = once(spark, d, "regions", "region_key", "text").filter("text is not null")
    return r.select("region_key", markup.block_text(F.concat(F.lit("<p>"), F.replace(_escaped(F.col("text")), F.lit("\n"), F.lit("<br/>")), F.lit("</p>"))).alias("block_text"))


@query(r"""SELECT backend, count(*) AS lines, count(*) FILTER (WHERE length(t) >= 4 AND n >= 2 AND n / greatest(1, length(t)) >= 0.3) AS valid
    FROM (SELECT coalesce(backend, '') AS backend, t, length(regexp_replace(t, '[^\p{L}\p{N}]', '', 'g')) AS n FROM (SELECT backend, regexp_replace(regexp_replace(text, '^""" + _W + r"""+', ''), '""" + _W + r"""+$', '') AS t FROM (SELECT DISTINCT textline_id, backend, text FROM textline))) GROUP BY backend""")
def q18_line_validity(spark: SparkSession, d: str) -> DataFrame:
    t = once(spark, d, "textline", "textline_id", "backend", "text")
    return t.groupBy(F.coalesce("backend", F.lit("")).alias("backend")).agg(F.count("*").alias("lines"), F.count_if(text.valid_line(F.col("text"))).alias("valid"))


@query("""SELECT DISTINCT row_id, regexp_extract(f, '^([A-Za-z]+)_([A-Za-z]+)_(\\d+)(?:_(.+))?\\.[A-Za-z]+$', 1) AS prefix, regexp_extract(f, '^([A-Za-z]+)_([A-Za-z]+)_(\\d+)(?:_(.+))?\\.[A-Za-z]+$', 2) AS language,
    regexp_extract(f, '^([A-Za-z]+)_([A-Za-z]+)_(\\d+)(?:_(.+))?\\.[A-Za-z]+$', 3) AS number, regexp_extract(f, '^([A-Za-z]+)_([A-Za-z]+)_(\\d+)(?:_(.+))?\\.[A-Za-z]+$', 4) AS suffix
    FROM (SELECT row_id, regexp_replace(image_path, '^.*[/\\\\]', '') AS f FROM index_test)""")
def q18_filename_parts(spark: SparkSession, d: str) -> DataFrame:
    r = once(spark, d, "index_test", "row_id", "image_path")
    return r.select("row_id", text.filename_parts(F.regexp_replace("image_path", r"^.*[/\\]", "")).alias("p")).select("row_id", "p.*")


# --- boxes ---------------------------------------------------------------------------------------


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    """Detections as pixel boxes of an 800 x 1000 page; class, key and score under the names the operators use."""
    b = once(spark, d, _DET, "det_id", "image", "class_id", "class_name", "conf", "cx", "cy", "w", "h")
    xy = geometry.from_centre(*[F.col(c) for c in ("cx", "cy", "w", "h")], F.lit(800.0), F.lit(1000.0))
    return b.select(F.col("image").alias("page"), F.col("class_id").alias("cls"), F.col("det_id").alias("seq"), F.coalesce("conf", F.lit(0.0)).alias("score"), "class_name", *xy)


_BOXES = f"(SELECT image AS page, class_id AS cls, det_id AS seq, coalesce(conf, 0) AS score, class_name, (cx - w / 2) * 800.0 AS x1, (cy - h / 2) * 1000.0 AS y1, (cx + w / 2) * 800.0 AS x2, (cy + h / 2) * 1000.0 AS y2 FROM (SELECT DISTINCT det_id, image, class_id, class_name, conf, cx, cy, w, h FROM {_DET}))"


def _truth(spark: SparkSession, d: str) -> DataFrame:
    """Ground truth made of the boxes, moved a little."""
    k = F.pmod(F.col("seq"), F.lit(7)).cast("double")
    return _boxes(spark, d).withColumn("x1", F.col("x1") + k).withColumn("x2", F.col("x2") + k)


_I = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
_AREA = "(a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1)"
_IOU = f"CASE WHEN ({_AREA}) - ({_I}) > 0 THEN ({_I}) / (({_AREA}) - ({_I})) ELSE 0 END"


@query(f"SELECT a.seq AS seq_a, b.seq AS seq_b, round({_IOU}, 6) AS iou FROM {_BOXES} a JOIN {_BOXES} b ON a.page = b.page AND a.seq < b.seq WHERE {_IOU} >= 0.25")
def q19_iou_overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    b = _boxes(spark, d)
    side = lambda t: b.select("page", F.col("seq").alias(f"seq_{t}"), *[F.col(c).alias(c + t) for c in ("x1", "y1", "x2", "y2")])
    return side("a").join(side("b"), "page").filter("seq_a < seq_b").withColumn("iou", geometry.iou("a", "b")).filter("iou >= 0.25").select("seq_a", "seq_b", F.round("iou", 6).alias("iou"))


@query(f"""SELECT a.seq, coalesce(arg_max(b.cls, struct_pack(i := round({_IOU}, 9), k := -b.seq)) FILTER (WHERE {_IOU} > 0.3), -1) AS best_class FROM {_BOXES} a LEFT JOIN (SELECT page, cls, seq, x1 + seq % 7 AS x1, y1, x2 + seq % 7 AS x2, y2 FROM {_BOXES}) b ON a.page = b.page GROUP BY a.seq""")
def q20_best_class(spark: SparkSession, d: str) -> DataFrame:
    box = ["x1", "y1", "x2", "y2"]
    p = _boxes(spark, d).select("page", "seq", *[F.col(c).alias(c + "p") for c in box])
    t = _truth(spark, d).select("page", "cls", F.col("seq").alias("gseq"), *[F.col(c).alias(c + "g") for c in box])
    j = p.join(t, "page", "left").withColumn("iou", geometry.iou("p", "g"))
    return j.groupBy("seq").agg(F.coalesce(F.max_by("cls", F.when(F.col("iou") > 0.3, F.struct(F.round("iou", 9), -F.col("gseq")))), F.lit(-1)).alias("best_class"))


def _iou_of(a: str, b: str) -> str:
    i = f"greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"
    u = f"(({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1) - {i})"
    return f"(CASE WHEN least({a}.x2, {b}.x2) > greatest({a}.x1, {b}.x1) AND least({a}.y2, {b}.y2) > greatest({a}.y1, {b}.y1) AND {u} > 0 THEN ({i}) / {u} ELSE 0 END)"


@query(f"""SELECT page, k.seq AS seq, i - 1 AS region_id FROM (SELECT page, unnest(kept) AS k, generate_subscripts(kept, 1) AS i FROM (SELECT page, list_reduce(list([b] ORDER BY -b.score, b.seq), lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: {_iou_of('k', 'x[1]')} >= 0.25)) = 0 THEN list_concat(acc, x) ELSE acc END) AS kept
    FROM (SELECT page, struct_pack(seq := seq, score := score, x1 := x1, y1 := y1, x2 := x2, y2 := y2) AS b FROM {_BOXES} WHERE x1 IS NOT NULL AND y1 IS NOT NULL AND x2 IS NOT NULL AND y2 IS NOT NULL) GROUP BY page))""")
def q21_suppress(spark: SparkSession, d: str) -> DataFrame:
    return detection.suppressed(_boxes(spark, d), threshold=0.25)


def _matched_sql(cls: str, thresholds: str) -> str:
    """Predictions with the truth they take: a fold over each page and class, best score first; each takes its best free truth."""
    boxes = f"(SELECT page, {cls} AS cls, seq, score, x1, y1, x2, y2 FROM {_BOXES})"
    truth = f"(SELECT page, {cls} AS cls, seq, x1 + seq % 7 AS x1, y1, x2 + seq % 7 AS x2, y2 FROM {_BOXES})"
    free = "list_filter(x[1].c, lambda y: NOT list_contains(list_transform(acc, lambda z: z.got), y.g))"
    return f"""SELECT p.page, p.cls, p.seq, p.score, t.th AS threshold, h.got AS gseq FROM {boxes} p CROSS JOIN (SELECT unnest({thresholds}) AS th) t LEFT JOIN (SELECT page, cls, th, unnest(list_filter(hits, lambda z: z.got >= 0), recursive := true) FROM (SELECT page, cls, th,
        list_reduce(list([struct_pack(p := seq, c := c, got := -1::BIGINT)] ORDER BY -score, seq), lambda acc, x: list_concat(acc, CASE WHEN len({free}) > 0 THEN [struct_pack(p := x[1].p, c := x[1].c, got := ({free})[1].g)] ELSE [struct_pack(p := x[1].p, c := x[1].c, got := -1::BIGINT)] END), [struct_pack(p := -1::BIGINT, c := []::STRUCT(o DOUBLE, g BIGINT)[], got := -1::BIGINT)]) AS hits
        FROM (SELECT p.page, p.cls, t.th, p.seq, p.score, list(struct_pack(o := -{_iou_of('p', 'g')}::DOUBLE, g := g.seq) ORDER BY -{_iou_of('p', 'g')}, g.seq) AS c FROM {boxes} p JOIN {truth} g ON p.page = g.page AND p.cls = g.cls CROSS JOIN (SELECT unnest({thresholds}) AS th) t WHERE {_iou_of('p', 'g')} >= t.th GROUP BY ALL) GROUP BY page, cls, th)) h ON h.page = p.page AND h.cls = p.cls AND h.th = t.th AND h.p = p.seq"""


def _ap_sql(thresholds: str) -> str:
    rows = f"SELECT m.*, CASE WHEN gseq IS NULL THEN 0 ELSE 1 END AS hit FROM ({_matched_sql('cls', thresholds)}) m SEMI JOIN {_BOXES} b ON b.page = m.page AND b.cls = m.cls"
    return f"""SELECT n.cls, t.th AS threshold, n.n_gt, coalesce(a.n_pred, 0) AS n_pred, coalesce(a.ap, 0) AS ap FROM (SELECT cls, count(*) AS n_gt FROM {_BOXES} GROUP BY cls) n CROSS JOIN (SELECT unnest({thresholds}) AS th) t LEFT JOIN
        (SELECT cls, threshold, count(*) AS n_pred, sum(hit / n_gt * best) AS ap FROM (SELECT *, max(prec) OVER (PARTITION BY cls, threshold ORDER BY score DESC, page, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS best FROM (SELECT r.*, g.n_gt, sum(hit) OVER w / count(*) OVER w AS prec FROM ({rows}) r JOIN (SELECT cls, count(*) AS n_gt FROM {_BOXES} GROUP BY cls) g USING (cls) WINDOW w AS (PARTITION BY cls, threshold ORDER BY score DESC, page, seq ROWS UNBOUNDED PRECEDING))) GROUP BY cls, threshold) a ON a.cls = n.cls AND a.threshold = t.th"""


_TEN = "[" + ", ".join(f"{round(0.5 + 0.05 * i, 2)}::DOUBLE" for i in range(10)) + "]"


@query(f"SELECT cls, threshold, n_gt, n_pred, round(ap, 9) AS ap FROM ({_ap_sql('[0.5::DOUBLE]')})")
def q22_ap50(spark: SparkSession, d: str) -> DataFrame:
    return detection.average_precision(_boxes(spark, d), _truth(spark, d), [0.5]).withColumn("ap", F.round("ap", 9))


@query(f"SELECT round(avg(ap) FILTER (WHERE threshold = 0.5), 9) AS map50, round(avg(ap) FILTER (WHERE threshold = 0.75), 9) AS map75, round(avg(ap), 9) AS map FROM ({_ap_sql(_TEN)})")
def q23_map5095(spark: SparkSession, d: str) -> DataFrame:
    m = detection.mean_ap(detection.average_precision(_boxes(spark, d), _truth(spark, d), [round(0.5 + 0.05 * i, 2) for i in range(10)]))
    return m.select(*[F.round(c, 9).alias(c) for c in ("map50", "map75", "map")])


@query(f"""SELECT count(*) AS n_pred, count(gseq) AS tp, any_value(n_gt) AS n_gt, round(count(gseq) / count(*), 6) AS precision, round(count(gseq) / any_value(n_gt), 6) AS recall FROM ({_matched_sql('0', '[0.5::DOUBLE]')}) CROSS JOIN (SELECT count(*) AS n_gt FROM {_BOXES})""")
def q24_prf_agnostic(spark: SparkSession, d: str) -> DataFrame:
    one = F.lit(0)
    p, t = _boxes(spark, d).withColumn("cls", one), _truth(spark, d).withColumn("cls", one)
    m = detection.matched(p, t, [0.5]).agg(F.count("*").alias("n_pred"), F.count("gseq").alias("tp")).crossJoin(t.agg(F.count("*").alias("n_gt")))  # single rows
    return m.withColumn("precision", F.round(F.try_divide("tp", "n_pred"), 6)).withColumn("recall", F.round(F.try_divide("tp", "n_gt"), 6))


@query(f"""SELECT seq, least(greatest(x1, 0), 799) AS x1, least(greatest(y1, 0), 999) AS y1, least(greatest(x2, 1), 800) AS x2, least(greatest(y2, 1), 1000) AS y2 FROM {_BOXES}""")
def q25_clipped_boxes(spark: SparkSession, d: str) -> DataFrame:
    return _boxes(spark, d).select("seq", *geometry.clip(F.lit(800.0), F.lit(1000.0)))


@query(f"""SELECT seq, 1000.0 - y2 AS x1, x1 AS y1, 1000.0 - y1 AS x2, x2 AS y2 FROM {_BOXES}""")
def q25_rotated_boxes(spark: SparkSession, d: str) -> DataFrame:
    return _boxes(spark, d).select("seq", *geometry.rotate_quadrant(3, F.lit(800.0), F.lit(1000.0)))


@query(f"""SELECT CASE WHEN class_name = 'figure' AND w > 0 AND h > 0 AND cy > 0.35 AND w / h BETWEEN 0.6 AND 1.7 AND w * h < 0.08 THEN 'stamp_seal' WHEN class_name = 'figure' AND w > 0 AND h > 0 AND cy > 0.35 AND w / h > 1.8 AND w * h < 0.04 THEN 'signature' ELSE coalesce(class_name, '') END AS kind, count(*) AS n
    FROM (SELECT DISTINCT det_id, class_name, cy, w, h FROM {_DET}) GROUP BY kind""")
def q25_figures_reclassified(spark: SparkSession, d: str) -> DataFrame:
    b = once(spark, d, _DET, "det_id", "class_name", "cy", "w", "h")
    k = geometry.reclassified(F.coalesce("class_name", F.lit("")), F.col("w"), F.col("h"), F.col("cy"))
    return b.groupBy(k.alias("kind")).agg(F.count("*").alias("n"))


@query(f"""SELECT image, n, small_share, n >= 8 AND small_share >= 0.4 AS dense FROM (SELECT image, count(*) AS n, round(avg(CASE WHEN w * h < 0.01 THEN 1 ELSE 0 END), 6) AS small_share FROM (SELECT DISTINCT det_id, image, w, h FROM {_DET}) GROUP BY image)""")
def q25_dense_pages(spark: SparkSession, d: str) -> DataFrame:
    g = once(spark, d, _DET, "det_id", "image", "w", "h").groupBy("image").agg(F.count("*").alias("n"), F.round(F.avg((F.col("w") * F.col("h") < 0.01).cast("int")), 6).alias("small_share"))
    return g.withColumn("dense", (F.col("n") >= 8) & (F.col("small_share") >= 0.4))


# --- order and composition -----------------------------------------------------------------------

_PAGE = ["doc_id", "page_index"]
_REGIONS = "(SELECT DISTINCT region_key, doc_id, page_index, region_id, type, x1, y1, x2, y2, reading_order, text FROM regions)"
_FURN = "type IN ('header', 'footer', 'page_number')"


def _regions(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "regions", "region_key", "doc_id", "page_index", "region_id", "type", "x1", "y1", "x2", "y2", "reading_order", "text")


@query(f"SELECT region_key, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY CASE WHEN {_FURN} THEN 1 ELSE 0 END, y1, x1, region_key) - 1 AS reading_order FROM {_REGIONS}")
def q26_topdown_order(spark: SparkSession, d: str) -> DataFrame:
    return layout.topdown(_regions(spark, d), _PAGE, key="region_key").select("region_key", "reading_order")


@query()
def q27_column_aware(spark: SparkSession, d: str) -> DataFrame:
    return layout.ordered(_regions(spark, d), _PAGE, "column_aware", key="region_key")


@query()
def q28_xy_cut(spark: SparkSession, d: str) -> DataFrame:
    return layout.ordered(_regions(spark, d), _PAGE, "xy_cut", key="region_key")


@query(f"""SELECT doc_id, page_index, max(y1 - e) AS widest, count(*) AS gaps FROM (SELECT *, max(y2) OVER (PARTITION BY doc_id, page_index ORDER BY y1, y2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM {_REGIONS}) WHERE y1 > e GROUP BY ALL""")
def q29_interval_widest_gap(spark: SparkSession, d: str) -> DataFrame:
    return layout.gaps(_regions(spark, d), _PAGE, "y1", "y2").groupBy(*_PAGE).agg(F.max("size").alias("widest"), F.count("*").alias("gaps"))


@query(f"""SELECT n.doc_id, n.page_index, n.n, round(CASE WHEN n.n < 2 THEN 1 ELSE coalesce(p.ok, 0) / (n.n * (n.n - 1) / 2) END, 6) AS accuracy FROM (SELECT doc_id, page_index, count(*) AS n FROM {_REGIONS} GROUP BY ALL) n LEFT JOIN
    (SELECT a.doc_id, a.page_index, count(*) FILTER (WHERE (a.reading_order < b.reading_order) = (a.region_id < b.region_id)) AS ok FROM {_REGIONS} a JOIN {_REGIONS} b ON a.doc_id = b.doc_id AND a.page_index = b.page_index AND a.region_key < b.region_key GROUP BY ALL) p ON p.doc_id = n.doc_id AND p.page_index = n.page_index""")
def q30_pair_order_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return layout.order_accuracy(_regions(spark, d), _PAGE, "reading_order", "region_id", "region_key").withColumn("accuracy", F.round("accuracy", 6))


_HAS = "text IS NOT NULL AND regexp_matches(text, '[^" + _W[1:-1] + "]')"
_ALL = f"string_agg(text, chr(10) ORDER BY line_no, textline_id) FILTER (WHERE {_HAS})"


@query(f"""SELECT doc_id, page_index, region_id, coalesce(regexp_replace(regexp_replace({_ALL}, '^{_W}+', '', 'g'), '{_W}+$', '', 'g'), '') AS text, round(avg(confidence), 9) AS recognition_confidence, count(*) AS n_lines
    FROM (SELECT DISTINCT textline_id, doc_id, page_index, region_id, line_no, text, confidence FROM textline) GROUP BY doc_id, page_index, region_id""")
def q31_compose_region(spark: SparkSession, d: str) -> DataFrame:
    t = once(spark, d, "textline", "textline_id", "doc_id", "page_index", "region_id", "line_no", "text", "confidence")
    return compose.region_text(t, [*_PAGE, "region_id"]).withColumn("recognition_confidence", F.round("recognition_confidence", 9))


_ORDER = "CASE WHEN reading_order < 0 THEN 1 ELSE 0 END, reading_order, y1, x1, region_key"


@query(f"""SELECT doc_id, page_index, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY {_ORDER}) FILTER (WHERE {_HAS} AND NOT coalesce({_FURN}, false)), '') AS text FROM {_REGIONS} GROUP BY doc_id, page_index""")
def q32_page_text(spark: SparkSession, d: str) -> DataFrame:
    return compose.page_text(_regions(spark, d), _PAGE, key="region_key")


@query(f"""SELECT doc_id, page_index, coalesce(string_agg(CASE type WHEN 'title' THEN '## ' || text WHEN 'list' THEN array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{_W[1:-1]}]')), lambda x: '- ' || x), chr(10) || chr(10)) WHEN 'table' THEN '```' || chr(10) || text || chr(10) || '```' WHEN 'caption' THEN '*' || text || '*' ELSE text END, chr(10) || chr(10) ORDER BY {_ORDER}) FILTER (WHERE {_HAS} AND NOT coalesce({_FURN}, false)), '') AS markdown FROM {_REGIONS} GROUP BY doc_id, page_index""")
def q33_markdown(spark: SparkSession, d: str) -> DataFrame:
    return compose.markdown(_regions(spark, d), _PAGE, key="region_key")


@query(f"""SELECT doc_id, page_index, '1.0' AS schema_version, string_agg(region_id || ':' || coalesce(type, '') || ':' || coalesce(length(text), -1), ',' ORDER BY CASE WHEN reading_order < 0 THEN 1 ELSE 0 END, reading_order, y1, x1, region_id) AS regions FROM {_REGIONS} GROUP BY doc_id, page_index""")
def q33_pages_nested(spark: SparkSession, d: str) -> DataFrame:
    p = compose.pages_nested(_regions(spark, d).drop("region_key"))
    item = lambda r: F.concat_ws(":", r["region_id"], F.coalesce(r["type"], F.lit("")), F.coalesce(F.length(r["text"]), F.lit(-1)))
    return p.withColumn("regions", F.array_join(F.transform("regions", item), ","))


@query(f"SELECT doc_id, count(DISTINCT page_index) AS n_pages, count(*) AS n_regions, min(page_index) AS first_page, max(page_index) AS last_page FROM {_REGIONS} GROUP BY doc_id")
def q33_documents_manifest(spark: SparkSession, d: str) -> DataFrame:
    return compose.manifest(_regions(spark, d))


# --- curation ------------------------------------------------------------------------------------

# A small class map for the detections, and what is ignored.
_MAP = [("text", "text"), ("title", "title"), ("table", "table"), ("list", "text"), ("figure", "figure"), ("caption", "text"), ("header", "furniture"), ("footer", "furniture")]
_IGNORE = ["signature"]
_MAPSQL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _MAP) + ") m(source, target)"
_KEYSQL = f"regexp_replace(lower(regexp_replace(regexp_replace(class_name, '^{_W}+', ''), '{_W}+$', '')), '{_W}|-', '_', 'g')"


def _class_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_MAP, "source string, target string")


@query(f"SELECT det_id, target FROM (SELECT det_id, {_KEYSQL} AS source FROM (SELECT DISTINCT det_id, class_name FROM {_DET})) JOIN {_MAPSQL} USING (source)")
def q34_class_resolve(spark: SparkSession, d: str) -> DataFrame:
    return curate.resolve(once(spark, d, _DET, "det_id", "class_name"), "class_name", _class_map(spark), _IGNORE).select("det_id", "target")


@query(f"SELECT DISTINCT {_KEYSQL} AS source FROM {_DET} WHERE class_name IS NOT NULL AND {_KEYSQL} NOT IN ('signature', {', '.join(repr(a) for a, _ in _MAP)})")
def q35_unmapped(spark: SparkSession, d: str) -> DataFrame:
    return curate.unmapped(table(spark, d, _DET), "class_name", _class_map(spark), _IGNORE)


@query("SELECT DISTINCT row_id, language FROM index_test WHERE lower(coalesce(language, '')) IN ('marathi', 'mr')")
def q36_filter_rejecting(spark: SparkSession, d: str) -> DataFrame:
    return curate.filter_rejecting(once(spark, d, "index_test", "row_id", "language"), "language", ["marathi", "mr"])


@query("SELECT DISTINCT row_id, language FROM index_test WHERE lower(coalesce(language, '')) IN ('', 'marathi', 'mr')")
def q37_filter_keeping(spark: SparkSession, d: str) -> DataFrame:
    return curate.filter_keeping(once(spark, d, "index_test", "row_id", "language"), "language", ["marathi", "mr"])


_N6 = "printf('%.6f', {})"


@query(f"""SELECT det_id, CASE WHEN k = 0 THEN 'dropped_bad_format' WHEN k = 1 THEN 'dropped_parse_error' WHEN cx BETWEEN 0 AND 1 AND cy BETWEEN 0 AND 1 AND w BETWEEN 0 AND 1 AND h BETWEEN 0 AND 1 AND w > 0 AND h > 0 THEN 'ok' WHEN k = 2 OR abs(cx) > 10 OR abs(cy) > 10 OR abs(w) > 10 OR abs(h) > 10 THEN 'dropped_unrecoverable' WHEN least(1, greatest(0, w)) < 0.001 OR least(1, greatest(0, h)) < 0.001 THEN 'dropped_degenerate' ELSE 'clamped' END AS status
    FROM (SELECT det_id, det_id % 23 AS k, round(CASE WHEN det_id % 23 = 2 THEN 99.0 WHEN det_id % 23 = 3 THEN 1.2 ELSE cx END, 6) AS cx, round(cy, 6) AS cy, round(w, 6) AS w, round(CASE WHEN det_id % 23 = 4 THEN 0.0 ELSE h END, 6) AS h FROM (SELECT DISTINCT det_id, cx, cy, w, h FROM {_DET}))""")
def q38_label_repair(spark: SparkSession, d: str) -> DataFrame:
    b = once(spark, d, _DET, "det_id", "class_id", "cx", "cy", "w", "h").withColumn("k", F.pmod("det_id", F.lit(23)))
    n = lambda c: F.format_string("%.6f", c)
    cx = F.when(F.col("k") == 2, 99.0).when(F.col("k") == 3, 1.2).otherwise(F.col("cx"))
    h = F.when(F.col("k") == 4, 0.0).otherwise(F.col("h"))
    line = F.when(F.col("k") == 0, n(F.col("cx"))).otherwise(F.concat_ws(" ", F.when(F.col("k") == 1, "x").otherwise(F.col("class_id").cast("string")), n(cx), n(F.col("cy")), n(F.col("w")), n(h)))
    return b.select("det_id", curate.repaired_label(line)[1].alias("status"))


@query(f"""SELECT count(*) AS boxes, count(*) FILTER (WHERE class_id NOT BETWEEN 0 AND 10) AS bad_class, count(*) FILTER (WHERE NOT (cx BETWEEN 0 AND 1 AND cy BETWEEN 0 AND 1 AND w BETWEEN 0 AND 1 AND h BETWEEN 0 AND 1)) AS bad_value, count(*) FILTER (WHERE w <= 0 OR h <= 0) AS bad_size FROM (SELECT DISTINCT det_id, class_id, cx, cy, w, h FROM {_DET})""")
def q39_label_audit(spark: SparkSession, d: str) -> DataFrame:
    return curate.label_audit(once(spark, d, _DET, "det_id", "class_id", "cx", "cy", "w", "h"))


@query(f"""SELECT 'text_present' AS rule, row_id::VARCHAR AS key, 'row' AS detail FROM (SELECT DISTINCT row_id, text FROM index_test) WHERE NOT coalesce(regexp_matches(text, '[^{_W[1:-1]}]'), false)
    UNION ALL SELECT 'language_known', row_id::VARCHAR, 'row' FROM (SELECT DISTINCT row_id, language FROM index_test) WHERE language IS NULL
    UNION ALL SELECT 'path_once', image_path, 'rows=' || count(*) FROM (SELECT DISTINCT row_id, image_path FROM index_test) GROUP BY image_path HAVING count(*) > 1
    UNION ALL SELECT 'crop_measured', image_path, 'absent' FROM (SELECT DISTINCT image_path FROM index_test WHERE image_path NOT IN (SELECT image_path FROM measure_row WHERE image_path IS NOT NULL))""")
def q40_manifest_violations(spark: SparkSession, d: str) -> DataFrame:
    r = once(spark, d, "index_test", "row_id", "image_path", "text", "language")
    rules = {"text_present": (F.col("text").rlike(r"(?U)\S"), F.col("row_id")), "language_known": (F.col("language").isNotNull(), F.col("row_id"))}
    return curate.violations(r, rules).unionByName(curate.duplicates(r, "image_path", "path_once")).unionByName(curate.missing(r.filter("image_path is not null"), table(spark, d, "measure_row"), "image_path", "crop_measured"))


@query("""SELECT row_id, language, source FROM (SELECT *, row_number() OVER (PARTITION BY language, source ORDER BY md5('42:' || row_id::VARCHAR), row_id) AS r FROM (SELECT DISTINCT row_id, language, source FROM index_test)) WHERE r <= 5""")
def q41_strat_sample(spark: SparkSession, d: str) -> DataFrame:
    return curate.stratified_sample(once(spark, d, "index_test", "row_id", "language", "source"), ["language", "source"], 5, "row_id")


@query("""SELECT row_id, CASE WHEN r <= ceil(n * 0.9) THEN 'train' ELSE 'val' END AS split FROM (SELECT row_id, row_number() OVER (PARTITION BY language, source ORDER BY md5('42:' || row_id::VARCHAR), row_id) AS r, count(*) OVER (PARTITION BY language, source) AS n FROM (SELECT DISTINCT row_id, language, source FROM index_test))""")
def q42_strat_split(spark: SparkSession, d: str) -> DataFrame:
    return curate.stratified_split(once(spark, d, "index_test", "row_id", "language", "source"), ["language", "source"], "row_id").select("row_id", "split")


@query()
def q43_neardup_hamming(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation and training lines whose 64-bit sketches (four bits of each of 16 minimum hashes of their words) are within 4 bits."""
    x = once(spark, d, "index_test", "row_id", "split", "text").withColumn("w", text.words(F.col("text"))).filter("size(w) > 0")
    part = "shiftleft(shiftrightunsigned(array_min(transform(w, v -> xxhash64(i, v))), 17) & 15L, cast(4 * i as int))"
    sketch = F.expr(f"aggregate(sequence(0, 15), 0L, (a, i) -> a | {part})")
    x = x.select(F.col("row_id").alias("id"), "split", sketch.alias("hash"))
    return curate.near_hashes(x.filter("split <> 'train'"), x.filter("split = 'train'"))


@query(f"""SELECT region_key, least(page_index - p, n - page_index) AS nearest FROM (SELECT region_key, page_index, max(CASE WHEN type = 'table' THEN page_index END) OVER (PARTITION BY doc_id ORDER BY page_index, region_key ROWS UNBOUNDED PRECEDING) AS p, min(CASE WHEN type = 'table' THEN page_index END) OVER (PARTITION BY doc_id ORDER BY page_index, region_key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM {_REGIONS})""")
def q44_nearest_neighbour(spark: SparkSession, d: str) -> DataFrame:
    return curate.nearest(_regions(spark, d), ["doc_id"], "page_index", F.col("type") == "table").select("region_key", "nearest")


_MEASURE = "(SELECT DISTINCT measure_id, source, original_width AS v FROM measure_row WHERE original_width IS NOT NULL)"


@query(f"""SELECT source, count(*) AS n, round(quantile_cont(v, 0.9), 6) AS linear, list_sort(list(v))[least(floor(0.9 * count(*))::BIGINT, count(*) - 1) + 1] AS floored, list_sort(list(v))[floor(0.9 * (count(*) - 1))::BIGINT + 1] AS scaled FROM {_MEASURE} GROUP BY source""")
def q45_quantiles_three(spark: SparkSession, d: str) -> DataFrame:
    m = once(spark, d, "measure_row", "measure_id", "source", "original_width").filter("original_width is not null")
    lin = m.groupBy("source").agg(F.round(F.percentile("original_width", F.lit(0.9)), 6).alias("linear"))
    at = ranks.at_index(m, ["source"], "original_width", {"floored": ranks.floor_index(0.9), "scaled": ranks.scaled_index(0.9)})
    return at.join(lin, "source")




def _gaps(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "measure_row").select("measure_id", "gap_x").filter("size(gap_x) > 1").dropDuplicates(["measure_id"])
    n = F.size("gap_x")
    return m.select("measure_id", F.explode(F.zip_with(F.slice("gap_x", 2, n - 1), F.slice("gap_x", 1, n - 1), lambda a, b: a - b)).alias("g"))


@query(f"SELECT bin, count(*) AS n FROM (SELECT CASE WHEN g >= 0 AND g < 40 THEN (g // 2) * 2 WHEN g = 40 THEN 38 END AS bin FROM (SELECT measure_id, gap_x[i + 1] - gap_x[i] AS g FROM (SELECT DISTINCT measure_id, gap_x FROM measure_row), range(1, 200) t(i) WHERE i < len(gap_x))) WHERE bin IS NOT NULL GROUP BY bin")
def q46_hist_2px(spark: SparkSession, d: str) -> DataFrame:
    b = F.when((F.col("g") >= 0) & (F.col("g") < 40), F.floor(F.col("g") / 2) * 2).when(F.col("g") == 40, F.lit(38)).cast("int")
    return _gaps(spark, d).select(b.alias("bin")).filter("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN v <= 128 THEN '<=128' WHEN v <= 256 THEN '129-256' WHEN v <= 512 THEN '257-512' ELSE '>512' END AS bucket, count(*) AS n, round(avg(characters), 6) AS mean_chars FROM (SELECT DISTINCT measure_id, characters, height32_width_before_cap AS v FROM measure_row) WHERE v IS NOT NULL GROUP BY bucket""")
def q47_width_buckets(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("height32_width_before_cap")
    b = F.when(v <= 128, "<=128").when(v <= 256, "129-256").when(v <= 512, "257-512").otherwise(">512")
    m = once(spark, d, "measure_row", "measure_id", "characters", "height32_width_before_cap").filter(v.isNotNull())
    return m.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("characters"), 6).alias("mean_chars"))


@query("""SELECT measure_id, greatest(8, round_even(w * 32.0 / h, 0))::INT AS width32, least(512, greatest(8, round_even(w * 32.0 / h, 0)))::INT AS capped, greatest(1, greatest(8, round_even(w * 32.0 / h, 0))::INT // 2 // 2 - 1)::INT AS steps, greatest(8, round_even(w * 32.0 / h, 0))::INT IS DISTINCT FROM b AS differs
    FROM (SELECT DISTINCT measure_id, original_width::DOUBLE AS w, original_height::DOUBLE AS h, height32_width_before_cap AS b FROM measure_row) WHERE w > 0 AND h > 0""")
def q47_width_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = once(spark, d, "measure_row", "measure_id", "original_width", "original_height", "height32_width_before_cap")
    w = geometry.width32(F.col("original_width"), F.col("original_height"))
    m = m.withColumn("width32", w).filter("width32 is not null")
    return m.select("measure_id", "width32", F.least("width32", F.lit(512)).alias("capped"), geometry.ctc_length(F.col("width32")).alias("steps"), (~F.col("width32").eqNullSafe(F.col("height32_width_before_cap"))).alias("differs"))


@query("""SELECT coalesce(source, '') AS source, coalesce(domain, '') AS domain, count(*) AS n, sum(n_chars)::BIGINT AS chars, grouping(source)::INT AS all_sources, grouping(domain)::INT AS all_domains FROM documents GROUP BY GROUPING SETS ((), (source), (domain))""")
def q48_grouping_breakdown(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select("source", "domain", "n_chars")
    g = x.groupingSets([[], ["source"], ["domain"]], "source", "domain").agg(F.count("*").alias("n"), F.sum("n_chars").cast("long").alias("chars"), F.grouping("source").cast("int").alias("all_sources"), F.grouping("domain").cast("int").alias("all_domains"))
    return g.withColumns({c: F.coalesce(c, F.lit("")) for c in ("source", "domain")})




def _months(spark: SparkSession, d: str) -> DataFrame:
    t = once(spark, d, "textline", "textline_id", "backend", "recognised_at")
    return t.groupBy(F.coalesce("backend", F.lit("")).alias("backend"), F.date_format("recognised_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


_MONTHSQL = "(SELECT coalesce(backend, '') AS backend, strftime(recognised_at AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS n FROM (SELECT DISTINCT textline_id, backend, recognised_at FROM textline) GROUP BY ALL)"


@query(f"SELECT backend, month, n, n - lag(n) OVER w AS change, round(regr_slope(n, r) OVER (PARTITION BY backend ORDER BY month ROWS 4 PRECEDING), 6) AS slope5 FROM (SELECT *, row_number() OVER (PARTITION BY backend ORDER BY month) AS r FROM {_MONTHSQL}) WINDOW w AS (PARTITION BY backend ORDER BY month)")
def q49_slope_and_deltas(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("backend").orderBy("month")
    m = _months(spark, d).withColumn("r", F.row_number().over(w))
    return m.select("backend", "month", "n", (F.col("n") - F.lag("n").over(w)).alias("change"), F.round(F.regr_slope("n", "r").over(w.rowsBetween(-4, 0)), 6).alias("slope5"))


@query(f"SELECT backend, arg_max(month, struct_pack(n := n, k := -r)) AS best_month, max(n) AS n FROM (SELECT *, row_number() OVER (PARTITION BY backend ORDER BY month) AS r FROM {_MONTHSQL}) GROUP BY backend")
def q50_best_epoch(spark: SparkSession, d: str) -> DataFrame:
    m = _months(spark, d).withColumn("r", F.row_number().over(Window.partitionBy("backend").orderBy("month")))
    return m.groupBy("backend").agg(F.max_by("month", F.struct("n", -F.col("r"))).alias("best_month"), F.max("n").alias("n"))


@query("""SELECT doc_id, page_index, region_id, string_agg(text, ' ' ORDER BY line_no, textline_id) AS line, greatest(0, min(x1) - 4) AS x1, greatest(0, min(y1) - 4) AS y1, max(x2) + 4 AS x2, max(y2) + 4 AS y2, round(avg(confidence), 9) AS confidence
    FROM (SELECT DISTINCT textline_id, doc_id, page_index, region_id, line_no, text, confidence, x1, y1, x2, y2 FROM textline) WHERE confidence >= 0.6 AND text <> '' GROUP BY doc_id, page_index, region_id""")
def q51_line_assembly(spark: SparkSession, d: str) -> DataFrame:
    t = once(spark, d, "textline", "textline_id", "doc_id", "page_index", "region_id", "line_no", "text", "confidence", "x1", "y1", "x2", "y2").filter("confidence >= 0.6 and text <> ''")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "textline_id", "text"))), lambda x: x["text"]), " ")
    return t.groupBy(*_PAGE, "region_id").agg(joined.alias("line"), F.greatest(F.lit(0.0), F.min("x1") - 4).alias("x1"), F.greatest(F.lit(0.0), F.min("y1") - 4).alias("y1"), (F.max("x2") + 4).alias("x2"), (F.max("y2") + 4).alias("y2"), F.round(F.avg("confidence"), 9).alias("confidence"))


@query("""SELECT textline_id, array_to_string(list_filter(list_transform(s, lambda x, i: CASE WHEN i > 1 AND s[i - 1] = x THEN 0 ELSE x END), lambda x: x <> 0), ',') AS symbols FROM (SELECT textline_id, list_transform(regexp_extract_all(text, '(?s).'), lambda c: unicode(c) % 5) AS s FROM (SELECT DISTINCT textline_id, text FROM textline))""")
def q52_ctc_greedy(spark: SparkSession, d: str) -> DataFrame:
    t = once(spark, d, "textline", "textline_id", "text")
    steps = F.transform(F.filter(F.split("text", ""), lambda c: c != ""), lambda c: F.conv(F.hex(F.encode(c, "utf-16be")), 16, 10).cast("long") % 5)
    return t.withColumn("s", steps).select("textline_id", F.array_join(recognise.greedy(F.col("s")).cast("array<string>"), ",").alias("symbols"))


@query(f"""SELECT region_key, CASE WHEN sure AND s = 'deva' THEN 'deva' WHEN sure AND s = 'latin' THEN 'latin' WHEN dt AND (NOT lt OR (dc, dl) >= (lc, ll)) THEN 'deva' WHEN lt THEN 'latin' ELSE 'none' END AS choice FROM
    (SELECT region_key, coalesce(script_confidence >= 0.8, true) AS sure, lower(trim(script)) AS s, d <> '' AS dt, l <> '' AS lt, length(d) AS dl, length(l) AS ll, coalesce(recognition_confidence, 0) AS dc, 0.85 AS lc
     FROM (SELECT DISTINCT region_key, script, script_confidence, recognition_confidence, regexp_replace(coalesce(text, ''), '[^\\x{{900}}-\\x{{97f}}]', '', 'g') AS d, regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g') AS l FROM regions))""")
def q53_router_choice(spark: SparkSession, d: str) -> DataFrame:
    r = once(spark, d, "regions", "region_key", "script", "script_confidence", "recognition_confidence", "text")
    t = F.coalesce("text", F.lit(""))
    deva = F.struct(F.regexp_replace(t, r"[^\x{900}-\x{97f}]", "").alias("text"), F.col("recognition_confidence").alias("confidence"), F.lit("deva").alias("who"))
    latin = F.struct(F.regexp_replace(t, "[^A-Za-z]", "").alias("text"), F.lit(0.85).alias("confidence"), F.lit("latin").alias("who"))
    r = r.withColumn("dv", deva).withColumn("la", latin)
    two = lambda c: F.struct(F.col(c)["text"].alias("text"), F.col(c)["confidence"].alias("confidence"))
    got = recognise.routed(two("dv"), two("la"), F.lower(F.trim("script")), F.col("script_confidence"), 0.8)
    r = r.withColumn("got", got)
    return r.select("region_key", F.when((F.col("got.text") == "") & (F.col("dv.text") == "") & (F.col("la.text") == "") & ~F.coalesce((F.coalesce("script_confidence", F.lit(1.0)) >= 0.8) & F.lower(F.trim("script")).isin("deva", "latin"), F.lit(False)), "none").when(F.col("got").eqNullSafe(two("dv")) & ~((F.coalesce("script_confidence", F.lit(1.0)) >= 0.8) & F.coalesce(F.lower(F.trim("script")) == "latin", F.lit(False))), "deva").otherwise("latin").alias("choice"))


@query()
def q54_bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d).select("lang", F.col("row_id").alias("id"), edit.char_distance(F.col("reference"), _substituted(F.col("reference"))).alias("errors"), F.length("reference").alias("size"))
    return edit.bootstrap(p, "lang").select("lang", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query()
def q55_crop_alignment(spark: SparkSession, d: str) -> DataFrame:
    t = once(spark, d, "textline", "textline_id", "doc_id", "page_index", "region_id", "line_no", "x1", "x2", "y1", "y2")
    page = F.concat_ws("/", "doc_id", "page_index")
    order = F.row_number().over(Window.partitionBy("doc_id", "page_index").orderBy("region_id", "line_no", "textline_id"))
    crops = t.select(page.alias("page"), F.col("textline_id").alias("crop_id"), order.alias("seq"), (F.col("x2") - F.col("x1")).alias("width"), (F.col("y2") - F.col("y1")).alias("height"))
    pages = compose.page_text(_regions(spark, d), _PAGE, key="region_key", furniture=True).select(page.alias("page"), "text")
    return recognise.align_pages(crops, pages, "page")


@query(f"SELECT coalesce(class_name, '') AS category, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM (SELECT DISTINCT det_id, class_name FROM {_DET}) GROUP BY category")
def q56_category_rollup(spark: SparkSession, d: str) -> DataFrame:
    g = once(spark, d, _DET, "det_id", "class_name").groupBy(F.coalesce("class_name", F.lit("")).alias("category")).agg(F.count("*").alias("n"))
    return g.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))  # one row per class


@query(r"""SELECT label, count(*) FILTER (WHERE s = 'deva') AS deva, count(*) FILTER (WHERE s = 'latin') AS latin, count(*) FILTER (WHERE s = 'mixed') AS mixed, count(*) FILTER (WHERE s = 'unknown') AS unknown FROM (SELECT coalesce(lower(trim(script)), '') AS label, CASE WHEN q IS NULL THEN 'unknown' WHEN q >= 0.85 THEN 'deva' WHEN q <= 0.15 THEN 'latin' ELSE 'mixed' END AS s
    FROM (SELECT script, d / nullif(d + a, 0) AS q FROM (SELECT DISTINCT region_key, script, length(regexp_replace(coalesce(text, ''), '[^\x{900}-\x{97f}\x{a8e0}-\x{a8ff}]', '', 'g'))::DOUBLE AS d, length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS a FROM regions))) GROUP BY label""")
def q57_script_confusion(spark: SparkSession, d: str) -> DataFrame:
    r = once(spark, d, "regions", "region_key", "script", "text")
    s = text.script_of_text(F.coalesce("text", F.lit("")))[0]
    return r.select(F.coalesce(F.lower(F.trim("script")), F.lit("")).alias("label"), s.alias("s")).groupBy("label").pivot("s", ["deva", "latin", "mixed", "unknown"]).count().na.fill(0)


@query("SELECT image_path, count(DISTINCT split) AS n_splits FROM index_test WHERE image_path IS NOT NULL GROUP BY image_path HAVING count(DISTINCT split) > 1")
def q58_leaked_keys(spark: SparkSession, d: str) -> DataFrame:
    return curate.leaked(table(spark, d, "index_test"), "image_path")


@query("""SELECT measure_id, len(list_filter(g, lambda x: x >= 10)) + 1 AS pieces10, len(list_filter(g, lambda x: x >= 20)) + 1 AS pieces20, len(list_filter(g, lambda x: x >= 40)) + 1 AS pieces40 FROM (SELECT DISTINCT measure_id, coalesce(list_transform(range(1, len(gap_x)), lambda i: gap_x[i + 1] - gap_x[i]), []) AS g FROM measure_row)""")
def q59_segments_per_threshold(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "measure_row").groupBy("measure_id").agg(F.first("gap_x", ignorenulls=True).alias("gap_x"))
    n = F.size("gap_x")
    g = F.when(n > 1, F.zip_with(F.slice("gap_x", 2, n - 1), F.slice("gap_x", 1, n - 1), lambda a, b: a - b)).otherwise(F.array().cast("array<int>"))
    over = lambda k: F.size(F.filter(g, lambda x: x >= k)) + 1
    return m.select("measure_id", *[over(k).cast("long").alias(f"pieces{k}") for k in (10, 20, 40)])


@query("""SELECT row_id, source, CASE WHEN r <= 2 THEN 'shared' WHEN r <= 6 THEN 'transcribe' ELSE 'pool' END AS tier, a AS annotator FROM (SELECT row_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || row_id::VARCHAR), row_id) AS r FROM (SELECT DISTINCT row_id, source FROM index_test)), range(0, 3) t(a) WHERE r <= 2 OR a = r % 3""")
def q60_annotation_pack(spark: SparkSession, d: str) -> DataFrame:
    return curate.dealt(once(spark, d, "index_test", "row_id", "source"), ["source"], "row_id", 2, 4, 3).withColumn("annotator", F.col("annotator").cast("long"))


@query(f"SELECT source, width, cer FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY width, cer) AS r FROM (SELECT *, min(cer) OVER (PARTITION BY source) AS m FROM (SELECT source, p.w AS width, round(avg(abs(v - p.w)), 6) AS cer FROM {_MEASURE}, (VALUES (200), (300), (400), (500)) p(w) GROUP BY ALL)) WHERE cer <= m + 20) WHERE r = 1")
def q61_sweep_choice(spark: SparkSession, d: str) -> DataFrame:
    m = once(spark, d, "measure_row", "measure_id", "source", "original_width").filter("original_width is not null")
    x = m.groupBy("source", "original_width").agg(F.count("*").alias("n")).withColumn("width", F.explode(F.array(*[F.lit(k) for k in (200, 300, 400, 500)])))
    s = x.groupBy("source", "width").agg(F.round(F.sum(F.abs(F.col("original_width") - F.col("width")) * F.col("n")) / F.sum("n"), 6).alias("cer"))
    return curate.choose(s, "cer", "width", 20.0, ["source"]).select("source", "width", "cer")


@query("SELECT DISTINCT doc_id, page_index, count(*) OVER (PARTITION BY doc_id, page_index) AS regions, count(DISTINCT type) OVER (PARTITION BY doc_id, page_index) AS types FROM (SELECT DISTINCT region_key, doc_id, page_index, type FROM regions)")
def q62_page_profile(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "regions", "region_key", *_PAGE, "type").groupBy(*_PAGE).agg(F.count("*").alias("regions"), F.count_distinct("type").alias("types"))


@query("SELECT textline_id, r.region_key, (r.x1 <= t.x1 AND r.x2 >= t.x2) AS inside FROM (SELECT DISTINCT textline_id, doc_id, page_index, region_id, x1, x2 FROM textline) t JOIN (SELECT DISTINCT region_key, doc_id, page_index, region_id, x1, x2 FROM regions) r USING (doc_id, page_index, region_id)")
def q63_lines_in_regions(spark: SparkSession, d: str) -> DataFrame:
    key = [*_PAGE, "region_id"]
    t = once(spark, d, "textline", "textline_id", *key, "x1", "x2")
    r = once(spark, d, "regions", "region_key", *key, "x1", "x2").withColumnsRenamed({"x1": "rx1", "x2": "rx2"})
    return t.join(r, key).select("textline_id", "region_key", ((F.col("rx1") <= F.col("x1")) & (F.col("rx2") >= F.col("x2"))).alias("inside"))


@query()
def q64_mojibake_whole(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", "text")
    return t.select("doc_id", text.mojibake_column(F.col("text")).alias("fixed")).join(t, "doc_id").filter("not (fixed <=> text)").select("doc_id", "fixed")


from . import analyses  # noqa: E402, F401
