"""Mixing sources to target weights (problem 9).

Hierarchical budgeting: the wanted size goes down a tree of source, language and domain by weights; what
a leaf can't give, its siblings give first, then the siblings of its ancestors. Each leaf is read in
seeded epochs and gives the prefix of its epochs that fills its budget.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass
class Node:
    """A node of the budget tree. `most` is what a leaf can give, repeats included."""

    name: str
    weight: float = 1.0
    most: int = 0
    below: list["Node"] = field(default_factory=list)
    budget: int = 0

    def can(self) -> int:
        return sum(c.can() for c in self.below) if self.below else self.most


def budget(node: Node, wanted: int) -> int:
    """Give `wanted` to the node and split it among its children by weight; what a child can't take goes to its siblings by weight. Returns what was taken."""
    node.budget = min(wanted, node.can())
    if not node.below:
        return node.budget
    got = {id(c): 0 for c in node.below}
    left, open_ = node.budget, [c for c in node.below if c.can() > 0 and c.weight > 0] or [c for c in node.below if c.can() > 0]
    while left > 0 and open_:
        whole = sum(c.weight for c in open_) or float(len(open_))
        shut = [c for c in open_ if got[id(c)] + left * (c.weight or 1.0) / whole >= c.can()]
        if not shut:
            exact = [(c, left * (c.weight or 1.0) / whole) for c in open_]
            for c, x in exact:
                got[id(c)] += int(x)
            short = left - sum(int(x) for _, x in exact)
            for c, x in sorted(exact, key=lambda p: (int(p[1]) - p[1], p[0].name))[:short]:
                got[id(c)] += 1
            left = 0
            break
        for c in shut:
            left -= c.can() - got[id(c)]
            got[id(c)] = c.can()
        open_ = [c for c in open_ if c not in shut]
    for c in node.below:
        budget(c, got[id(c)])
    return node.budget


def tree(sizes: list[tuple[str, str, str, int]], weights: dict[str, tuple[float, int]]) -> Node:
    """Root over sources over languages over domains. Sources without a weight are left out; below a source, weights are token shares."""
    root = Node("")
    for s, (w, times) in sorted(weights.items()):
        src = Node(s, w)
        by: dict[str, Node] = {}
        for ss, lang, dom, n in sorted(sizes):
            if ss == s and n > 0:
                mid = by.setdefault(lang, Node(lang, 0.0))
                mid.below.append(Node(dom, float(n), n * times))
                mid.weight += n
        src.below = list(by.values())
        root.below.append(src)
    return root


def mixed(items: DataFrame, weights: list[tuple[str, float, int]], wanted: int, seed: int = 17, buckets: int = 256) -> tuple[DataFrame, DataFrame]:
    """The mix, (doc_id, source, lang, domain, epoch, tokens), and a report per source.

    `items` has doc_id, source, lang, domain and tokens; null labels count as ''. Texts without tokens
    and null ids are left out. Each epoch of a leaf has its own seeded order; of the last one, a
    prefix is taken, up to the item whose middle is the last within the budget: large items make the
    shares neither short nor long on average. The prefix is found by sums over buckets of the
    order, then within the bucket where the budget ends, so no leaf is ever sorted in one task. A leaf's
    table is bounded by sources x languages x domains.
    """
    spark = items.sparkSession
    d = items.filter("doc_id is not null and tokens > 0").select("doc_id", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("source", "lang", "domain")], F.col("tokens").cast("long").alias("tokens"))
    leaf = ["source", "lang", "domain"]
    sizes = [tuple(r) for r in d.groupBy(*leaf).agg(F.sum("tokens").alias("n")).collect()]
    have = {tuple(r[:3]): r[3] for r in sizes}
    w = {s: (float(x or 0), max(0, int(k or 0))) for s, x, k in weights if s is not None}
    root = tree(sizes, w)
    budget(root, wanted)
    plan = []
    for src in root.below:
        for mid in src.below:
            for lf in mid.below:
                n = have[src.name, mid.name, lf.name]
                plan += [(src.name, mid.name, lf.name, e, min(n, lf.budget - e * n), n) for e in range(-(-lf.budget // n))]
    epochs = spark.createDataFrame(plan, "source string, lang string, domain string, epoch int, room long, size long")
    x = d.join(epochs, leaf)
    every = x.filter("room = size").select("doc_id", *leaf, "epoch", "tokens")
    part = x.filter("room < size").withColumn("h", F.pmod(F.xxhash64(F.lit(seed), "epoch", "doc_id"), F.lit(1 << 40)))
    part = part.withColumn("k", F.floor(F.col("h") * buckets / (1 << 40)))
    by = part.groupBy(*leaf, "k").agg(F.sum("tokens").alias("kt"))
    before = by.select(*leaf, "k", (F.sum("kt").over(Window.partitionBy(*leaf).orderBy("k")) - F.col("kt")).alias("before"))
    part = part.join(before, [*leaf, "k"]).filter("before < room")
    run = F.sum("tokens").over(Window.partitionBy(*leaf, "k").orderBy("h", "doc_id"))
    some = part.withColumn("mid", F.col("before") + run - F.col("tokens") / 2).filter(F.col("mid") <= F.col("room")).select("doc_id", *leaf, "epoch", "tokens")
    mix = every.unionByName(some)
    rows = [(s.name, float(s.weight), w[s.name][1], sum(n for (a, _, _), n in have.items() if a == s.name), s.budget) for s in root.below]
    asked = spark.createDataFrame(rows, "source string, weight double, max_repeats int, available long, budget long")
    got = mix.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("records"), (F.max("epoch") + 1).alias("epochs"))
    all_ = got.agg(F.sum("tokens").alias("whole"))
    whole_w = sum(r[1] for r in rows) or 1.0
    report = asked.join(got, "source", "left").crossJoin(all_).select("source", F.round(100 * F.col("weight") / whole_w, 3).alias("target_pct"), F.round(100 * F.coalesce("tokens", F.lit(0)) / F.col("whole"), 3).alias("actual_pct"), "max_repeats", F.coalesce("epochs", F.lit(0)).alias("epochs"), "available", "budget", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("records", F.lit(0)).alias("records"))
    return mix, report
