"""Curation of annotations, labels and indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranks import first_k, ranked


def class_key(c: Column, ampersand: bool = False) -> Column:
    """Lower case, blanks and hyphens as underscores; with `ampersand`, "&" reads "and"."""
    c = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.regexp_replace(F.replace(c, F.lit("&"), F.lit("and")) if ampersand else c, r"(?U)[\s-]", "_")


def resolve(rows: DataFrame, name: str, mapping: DataFrame, ignore: list[str], policy: str = "drop") -> DataFrame:
    """Rows with `target` from mapping (source, target). Ignored names go; unmapped ones fail, become text, or go by `policy`. Null names are unmapped."""
    if policy not in ("fail", "text", "drop"):
        raise ValueError(f"no such policy: {policy}")
    d = rows.withColumn("source", class_key(F.col(name))).filter(F.col("source").isNull() | ~F.col("source").isin(*ignore)).join(mapping.select("source", "target").distinct(), "source", "left")
    if policy == "drop":
        d = d.filter("target is not null")
    elif policy == "text":
        d = d.withColumn("target", F.coalesce("target", F.lit("text")))
    else:
        d = d.withColumn("target", F.when(F.col("target").isNull(), F.raise_error(F.concat(F.lit("unmapped class: "), F.coalesce("source", F.lit("null"))))).otherwise(F.col("target")))
    return d.drop("source")


def unmapped(rows: DataFrame, name: str, mapping: DataFrame, ignore: list[str]) -> DataFrame:
    """Distinct names that are neither mapped nor ignored."""
    d = rows.filter(F.col(name).isNotNull()).select(class_key(F.col(name)).alias("source")).distinct()
    return d.filter(~F.col("source").isin(*ignore)).join(mapping, "source", "left_anti")


def filter_rejecting(rows: DataFrame, col: str, wanted: list[str]) -> DataFrame:
    """With a filter set, rows with an empty value go."""
    return rows.filter(F.lower(F.coalesce(F.col(col), F.lit(""))).isin(*[w.lower() for w in wanted])) if wanted else rows


def filter_keeping(rows: DataFrame, col: str, wanted: list[str]) -> DataFrame:
    """With a filter set, rows with an empty value stay."""
    v = F.lower(F.coalesce(F.col(col), F.lit("")))
    return rows.filter((v == "") | v.isin(*[w.lower() for w in wanted])) if wanted else rows


def repaired_label(line: Column) -> tuple[Column, Column]:
    """(fixed line or null, status) of a layout label: class and four numbers.

    ok: all within 0 to 1 and sizes positive; else values beyond 10 can't be recovered; others are
    clamped, and go if a size is then under a thousandth. The class isn't checked for range.
    """
    t = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
    p = F.split(t, r"(?U)\s+")
    cls = F.try_element_at(p, F.lit(1)).try_cast("int")
    v = [F.try_element_at(p, F.lit(i)).try_cast("double") for i in (2, 3, 4, 5)]
    bad = cls.isNull() | v[0].isNull() | v[1].isNull() | v[2].isNull() | v[3].isNull()
    inside = v[0].between(0, 1) & v[1].between(0, 1) & v[2].between(0, 1) & v[3].between(0, 1) & (v[2] > 0) & (v[3] > 0)
    wild = (F.abs(v[0]) > 10) | (F.abs(v[1]) > 10) | (F.abs(v[2]) > 10) | (F.abs(v[3]) > 10)
    c = [F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) for x in v]
    status = F.when(line.isNull() | (F.size(p) != 5), "dropped_bad_format").when(bad, "dropped_parse_error").when(inside, "ok").when(wild, "dropped_unrecoverable").when((c[2] < 0.001) | (c[3] < 0.001), "dropped_degenerate").otherwise("clamped")
    fixed = F.when(status == "ok", t).when(status == "clamped", F.concat_ws(" ", cls.cast("string"), *[F.format_string("%.6f", x) for x in c]))
    return fixed, status


def label_audit(labels: DataFrame, classes: int = 11) -> DataFrame:
    """Counts of offences over typed labels: class out of range, value off the page, size not positive."""
    v = [F.col(c) for c in ("cx", "cy", "w", "h")]
    off = ~(v[0].between(0, 1) & v[1].between(0, 1) & v[2].between(0, 1) & v[3].between(0, 1))
    n = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("int")), F.lit(0)).cast("long")
    return labels.agg(F.count("*").alias("boxes"), n(~F.col("class_id").between(0, classes - 1)).alias("bad_class"), n(off).alias("bad_value"), n((v[2] <= 0) | (v[3] <= 0)).alias("bad_size"))


def hashed(key: Column, seed: int = 42) -> Column:
    """A seeded order that any engine can reproduce."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def stratified_sample(rows: DataFrame, by: list[str], k: int, key: str, seed: int = 42) -> DataFrame:
    """k rows of each stratum in seeded order; ranks are cut within salts first, so a hot stratum is never ranked whole."""
    return first_k(rows.withColumn("_h", hashed(F.col(key), seed)), by, k, F.col("_h"), F.col(key)).drop("_h", "rank")


def stratified_split(rows: DataFrame, by: list[str], key: str, share: float = 0.9, seed: int = 42) -> DataFrame:
    """`split` train or val: of n rows of a stratum the first ceil(share n) in seeded order are train.

    The cut is found from counts per hash prefix and then within one prefix, never by ranking a stratum.
    """
    d = ranked(rows.withColumn("_h", hashed(F.col(key), seed)), by, "_h", key, "_r", "_n")
    return d.withColumn("split", F.when(F.col("_r") <= F.ceil(F.col("_n") * share), "train").otherwise("val")).drop("_h", "_r", "_n")


def leaked(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys in more than one split, with the splits' number."""
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(split).alias("n_splits")).filter("n_splits > 1")


def near_hashes(a: DataFrame, b: DataFrame, bits: int = 4) -> DataFrame:
    """(a_id, b_id, distance) of 64-bit hashes within `bits`: of bits + 2 blocks two are equal, so each two blocks together join by equality.

    Null hashes match nothing. Hashes are compared once however many rows have them; rows come back in by
    joins at the end. Two blocks of 4 bits' search hold 21 bits, so chance meetings stay rare up to millions
    of distinct hashes; each meeting is counted at the first pair of blocks that is equal.
    """
    n = bits + 2
    edges = [64 * i // n for i in range(n + 1)]
    block = lambda h, i: F.shiftrightunsigned(h, edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1))
    two = [(i, j) for i in range(n) for j in range(i + 1, n)]
    keys = lambda h: F.array(*[F.struct(F.lit(k).alias("k"), block(h, i).alias("u"), block(h, j).alias("v")) for k, (i, j) in enumerate(two)])
    side = lambda d, out: d.filter("hash is not null").select(F.col("hash").alias(out)).distinct().withColumn("key", F.explode(keys(F.col(out))))
    x, y = F.col("ha"), F.col("hb")
    d = F.bit_count(x.bitwiseXOR(y))
    same = [(block(x, i) == block(y, i)) & (block(x, j) == block(y, j)) for i, j in two]
    first = F.coalesce(*[F.when(ok, F.lit(k)) for k, ok in enumerate(same)])
    near = side(a, "ha").join(side(b, "hb"), "key").filter((d <= bits) & (F.col("key.k") == first)).select("ha", "hb", d.alias("distance"))
    ids = lambda t, h, out: t.filter("hash is not null").select(F.col("hash").alias(h), F.col("id").alias(out)).distinct()
    return near.join(ids(a, "ha", "a_id"), "ha").join(ids(b, "hb", "b_id"), "hb").select("a_id", "b_id", "distance")


def nearest(rows: DataFrame, by: list[str], at: str, mark: Column) -> DataFrame:
    """Rows with the distance in `at` to the nearest marked row of their group, before or after; null where there is none."""
    # over the distinct positions of a group, not over its rows
    m = rows.groupBy(*by, at).agg(F.max(F.when(mark, F.col(at))).alias("_m"))
    w = Window.partitionBy(*by).orderBy(at)
    m = m.withColumn("_p", F.last("_m", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_f", F.first("_m", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    m = m.select(*by, at, F.least(F.col(at) - F.col("_p"), F.col("_f") - F.col(at)).alias("nearest"))
    same = F.lit(True)
    for x in [*by, at]:
        same = same & F.col(f"r.{x}").eqNullSafe(F.col(f"m.{x}"))
    return rows.alias("r").join(m.alias("m"), same, "left").select("r.*", "m.nearest")


def dealt(rows: DataFrame, cell: list[str], key: str, shared: int, fixed: int, people: int, seed: int = 42) -> DataFrame:
    """(key, annotator, tier): the first of each cell shared by all, the next for transcription, the rest dealt in turn by hash."""
    d = ranked(rows.withColumn("_h", hashed(F.col(key), seed)), cell, "_h", key, "_r").withColumn("tier", F.when(F.col("_r") <= shared, "shared").when(F.col("_r") <= shared + fixed, "transcribe").otherwise("pool"))
    who = F.when(F.col("tier") == "shared", F.sequence(F.lit(0), F.lit(people - 1))).otherwise(F.array(F.pmod(F.col("_r"), F.lit(people)).cast("int")))
    return d.select(key, *cell, "tier", F.explode(who).alias("annotator"))


def violations(df: DataFrame, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(rule, key, detail) of rows that break a row rule: name -> (condition that must hold, key). Null conditions break it."""
    out = None
    for name, (ok, key) in rules.items():
        d = df.filter(~F.coalesce(ok, F.lit(False))).select(F.lit(name).alias("rule"), key.cast("string").alias("key"), F.lit("row").alias("detail"))
        out = d if out is None else out.unionByName(d)
    return out


def duplicates(df: DataFrame, key: str, rule: str) -> DataFrame:
    """(rule, key, detail) of keys that stand more than once."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), F.concat(F.lit("rows="), "n").alias("detail"))


def missing(left: DataFrame, right: DataFrame, key: str, rule: str) -> DataFrame:
    """(rule, key, detail) of left keys without a right one."""
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti").select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), F.lit("absent").alias("detail"))


def required(found: DataFrame) -> None:
    """Raise with a few violations if there are any."""
    rows = found.limit(10).collect()
    if rows:
        raise ValueError("; ".join(f"{r.rule} {r.key} ({r.detail})" for r in rows))


def choose(sweep: DataFrame, metric: str, prefer: str, within: float, by: list[str] | None = None) -> DataFrame:
    """Of the rows whose metric is within a tolerance of the least, the one with the smallest preference."""
    by = by or []
    least = F.min(metric).over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1)))
    d = sweep.withColumn("_m", least).filter(F.col(metric) <= F.col("_m") + within)
    cols = [c for c in sweep.columns if c not in by]
    best = F.min_by(F.struct(*cols), F.struct(prefer, metric))
    return d.groupBy(*by).agg(best.alias("_b")).select(*by, *[F.col("_b")[c].alias(c) for c in cols])


def repair_summary(labels: DataFrame, by: list[str]) -> DataFrame:
    """Counts of repair statuses per group; lines of a wrong format or that can't be parsed fold into `other`. `labels` has status."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return labels.groupBy(*by).agg(n("ok").alias("ok"), n("clamped").alias("clamped"), n("dropped_unrecoverable").alias("unrecoverable"), n("dropped_degenerate").alias("degenerate"), n("dropped_bad_format", "dropped_parse_error").alias("other"))


def offenders(labels: DataFrame, key: str, k: int = 10, classes: int = 11) -> DataFrame:
    """(rule, rank, key): the first k label rows by key that break each rule of the audit."""
    v = [F.col(c) for c in ("cx", "cy", "w", "h")]
    rules = {"bad_class": ~F.col("class_id").between(0, classes - 1), "bad_value": ~(v[0].between(0, 1) & v[1].between(0, 1) & v[2].between(0, 1) & v[3].between(0, 1)), "bad_size": (v[2] <= 0) | (v[3] <= 0)}
    d = labels.select(key, F.explode(F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())).alias("rule"))
    return first_k(d, ["rule"], k, F.col(key)).select("rule", "rank", key)


def class_map_gaps(mapping: DataFrame, targets: DataFrame) -> DataFrame:
    """(rule, key, detail) of mapping targets that the target list doesn't have: must be empty."""
    return mapping.filter("target is not null").select("target").distinct().join(targets.select("target"), "target", "left_anti").select(F.lit("target_known").alias("rule"), F.col("target").alias("key"), F.lit("absent").alias("detail"))


def coverage_gaps(manifest: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """(rule, key, detail) of keys that only one of manifest and files has, in both directions."""
    return missing(manifest, files, key, "file_exists").unionByName(missing(files, manifest, key, "in_manifest"))


def united(parts: list[DataFrame], key: str) -> tuple[DataFrame, DataFrame]:
    """All parts in one, and (rule, key, detail) of keys that stand in several parts, which must be empty."""
    whole = None
    for i, p in enumerate(parts):
        d = p.withColumn("_part", F.lit(i))
        whole = d if whole is None else whole.unionByName(d, allowMissingColumns=True)
    twice = whole.groupBy(key).agg(F.count_distinct("_part").alias("n")).filter("n > 1")
    return whole.drop("_part"), twice.select(F.lit("in_one_part").alias("rule"), F.col(key).cast("string").alias("key"), F.concat(F.lit("parts="), "n").alias("detail"))


def halved(rows: DataFrame, page: str, by: list[str], seed: int = 42) -> DataFrame:
    """`part` tune or check: half of each group's pages, by the order of a seeded hash, the odd page to tune. All rows of a page go together."""
    p = ranked(rows.select(*by, page).distinct().withColumn("_h", hashed(F.col(page), seed)), by, "_h", page, "_r", "_n")
    part = F.when(F.col("_r") <= F.ceil(F.col("_n") / 2), "tune").otherwise("check")
    return rows.join(p.select(*by, page, part.alias("part")), [*by, page])


def pooled(pools: dict[str, tuple[DataFrame, float]], base: str, key: str, coverage: str, seed: int = 42) -> DataFrame:
    """Training rows of several pools with `pool`: name -> (rows, least coverage). Every pool but `base` stays whole; of `base` as many rows are drawn, by seeded order, as all others have together.

    The draw is by rank within hash prefixes, so the base is never ranked in one task.
    """
    kept = {n: d.filter(F.col(coverage) >= least).withColumn("pool", F.lit(n)) for n, (d, least) in pools.items()}
    rest = None
    for n, d in kept.items():
        if n != base:
            rest = d if rest is None else rest.unionByName(d, allowMissingColumns=True)
    if rest is None:
        return kept[base]
    size = rest.agg(F.count("*").alias("_k"))
    b = ranked(kept[base].withColumn("_h", hashed(F.col(key), seed)), ["pool"], "_h", key, "_r").crossJoin(size).filter("_r <= _k").drop("_h", "_r", "_k")  # one row
    return rest.unionByName(b, allowMissingColumns=True)


def limited_mix(parts: list[tuple[DataFrame, int]], key: str, seed: int = 42) -> DataFrame:
    """A curriculum's mix: of each part the first so many rows in seeded order, with the part's number as `stage`."""
    out = None
    for i, (d, k) in enumerate(parts):
        x = stratified_sample(d.withColumn("stage", F.lit(i)), ["stage"], k, key, seed)
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    return out


def harvested(rows: DataFrame, page: list[str], cell: list[str], key: str, per_page: int, per_cell: int, seed: int = 42) -> DataFrame:
    """At most `per_page` rows of a page and then `per_cell` of a cell, both in seeded order."""
    d = first_k(rows.withColumn("_h", hashed(F.col(key), seed)), page, per_page, F.col("_h"), F.col(key)).drop("rank")
    return first_k(d, cell, per_cell, F.col("_h"), F.col(key)).drop("_h", "rank")


def synthetic_lines(words: DataFrame, line: list[str], at: str, n: int) -> DataFrame:
    """(line, n_words, text): the first n words of each source line joined by blanks; lines whose numbers aren't 1, 2, 3 ... are left out, as are those of fewer words."""
    g = words.groupBy(*line).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("k"), F.col("text").alias("t")))).alias("w"))
    g = g.filter(F.forall(F.transform("w", lambda x, i: x["k"] == i + 1), lambda ok: ok) & (F.size("w") >= n))
    return g.select(*line, F.lit(n).alias("n_words"), F.array_join(F.transform(F.slice("w", 1, n), lambda x: x["t"]), " ").alias("text"))


def consecutive(rows: DataFrame, by: list[str], at: str) -> DataFrame:
    """Groups with `n` and whether their numbers are 1 to n, each once."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), ((F.min(at) == 1) & (F.max(at) == F.count("*")) & (F.count_distinct(at) == F.count("*"))).alias("consecutive"))


def bucketed_sample(rows: DataFrame, bucket: Column, k: int, key: str, seed: int = 42) -> DataFrame:
    """Of each bucket at most k rows in seeded order, with `bucket`: what is then scored."""
    return stratified_sample(rows.withColumn("bucket", bucket), ["bucket"], k, key, seed)


def neighbours(rows: DataFrame, by: list[str], order: list[str], key: str) -> DataFrame:
    """Rows with the key before and after theirs in their group."""
    w = Window.partitionBy(*by).orderBy(*order, key)
    return rows.withColumns({"previous": F.lag(key).over(w), "next": F.lead(key).over(w)})


def enriched(rows: DataFrame, more: DataFrame, key: str, defaults: dict[str, str]) -> DataFrame:
    """Rows with the columns of `defaults` from `more`, the default where there is none or it is null."""
    return rows.join(more.select(key, *defaults), key, "left").na.fill(defaults)


def list_gaps(lists: dict[str, list[str]]) -> list[tuple[int, dict[str, str | None]]]:
    """Positions at which ordered lists of class names differ, with what each list has there (none past its end). Empty if all agree."""
    n = max(map(len, lists.values()), default=0)
    rows = [(i, {k: v[i] if i < len(v) else None for k, v in lists.items()}) for i in range(n)]
    return [(i, r) for i, r in rows if len(set(r.values())) > 1]


def recounted(labels: DataFrame, expected: DataFrame, cls: str) -> DataFrame:
    """(class, expected, found, difference) over all expected classes, with 0 for those never found."""
    f = labels.groupBy(cls).agg(F.count("*").alias("found"))
    return expected.join(f, cls, "left").select(cls, "expected", F.coalesce("found", F.lit(0)).alias("found"), (F.coalesce("found", F.lit(0)) - F.col("expected")).alias("difference"))


def plan_gaps(rows: DataFrame, plan: DataFrame, by: list[str]) -> DataFrame:
    """(by, wanted, found) of groups whose count isn't the plan's, absent ones and unplanned ones included."""
    f = rows.groupBy(*by).agg(F.count("*").alias("found"))
    return plan.join(f, by, "full_outer").na.fill(0, ["wanted", "found"]).filter("wanted <> found").select(*by, "wanted", "found")


def prelabel_summary(boxes: DataFrame, pages: DataFrame, classes: DataFrame, page: str, cls: str) -> DataFrame:
    """(kind, name, n): boxes of each class, the classes never seen with 0, and the number of pages without a box."""
    per = classes.select(cls).join(boxes.groupBy(cls).agg(F.count("*").alias("n")), cls, "left").select(F.lit("class").alias("kind"), F.col(cls).cast("string").alias("name"), F.coalesce("n", F.lit(0)).alias("n"))
    none = pages.select(page).distinct().join(boxes.select(page).distinct(), page, "left_anti").agg(F.count("*").alias("n")).select(F.lit("pages_without").alias("kind"), F.lit("").alias("name"), "n")
    return per.unionByName(none)


def portable_path(path: Column, folders: list[str], prefixes: list[str] = []) -> Column:  # noqa: B006
    """The path from the first of the anchor folders on, with forward slashes; else without a known prefix; else as it is."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    got = F.nullif(F.regexp_extract(p, rf"(?:^|/)((?:{'|'.join(folders)})/.+)$", 1), F.lit(""))
    for x in prefixes:
        got = F.coalesce(got, F.when(p.startswith(x), F.ltrim(F.substring(p, len(x) + 1, 1 << 20), F.lit("/"))))
    return F.coalesce(got, p)


def covered(rows: DataFrame, text: str, charset: list[str], least: float) -> DataFrame:
    """Rows of which the charset has at least the share `least` of the characters; empty texts count as covered."""
    c = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), ""), lambda x: x != "")
    have = F.size(F.filter(c, lambda x: x.isin(*charset))) if charset else F.lit(0)
    return rows.filter(F.when(F.size(c) == 0, F.lit(True)).otherwise(have / F.size(c) >= least))


def random_split_baseline(numbers: DataFrame, by: list[str], at: str, n_val: int, within: int, trials: int = 200, seed: int = 42) -> DataFrame:
    """(by, baseline): the share of validation numbers with a training number within reach, over random splits, in the mean of all trials.

    Each trial orders a group's numbers by a seeded hash of their own, so trials run side by side; the
    neighbours are found by windows. Groups of no more than `n_val` numbers leave nothing to train on: 0.
    """
    t = numbers.select(*by, at).distinct().withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    group = Window.partitionBy(*by, "_t")
    t = t.withColumn("_v", F.row_number().over(group.orderBy(F.xxhash64(F.lit(seed), "_t", at), at)) <= n_val)
    up, down = group.orderBy(at).rowsBetween(Window.unboundedPreceding, 0), group.orderBy(at).rowsBetween(0, Window.unboundedFollowing)
    train = F.when(~F.col("_v"), F.col(at))
    near = F.coalesce(F.least(F.col(at) - F.last(train, ignorenulls=True).over(up), F.first(train, ignorenulls=True).over(down) - F.col(at)) <= within, F.lit(False))
    s = t.withColumn("_near", near).filter("_v").groupBy(*by, "_t").agg(F.avg(F.col("_near").cast("int")).alias("_s"))
    return s.groupBy(*by).agg(F.avg("_s").alias("baseline"))


def assigned_lines(regions: DataFrame, page: list[str], seq: str, detected: str, n_lines: str) -> DataFrame:
    """(page, seq, from_line, to_line): a page's ground-truth lines dealt to its regions in order, by their share of detected lines (half to even, at least one); the last region takes the rest."""
    w = Window.partitionBy(*page).orderBy(seq)
    total, last = F.sum(detected).over(Window.partitionBy(*page)), F.lead(seq).over(w).isNull()
    share = F.when(total > 0, F.greatest(F.lit(1), F.bround(F.col(detected) / total * F.col(n_lines)).cast("int"))).otherwise(F.greatest(F.lit(1), F.floor(F.col(n_lines) / F.count("*").over(Window.partitionBy(*page))).cast("int")))
    d = regions.withColumn("_n", share).withColumn("_last", last)
    before = F.least(F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), F.col(n_lines))
    d = d.withColumn("from_line", before)
    return d.select(*page, seq, F.col("from_line").cast("int").alias("from_line"), F.when(F.col("_last"), F.col(n_lines)).otherwise(F.least(F.col("from_line") + F.col("_n"), F.col(n_lines))).cast("int").alias("to_line"))
