"""Splits that keep related records together (problem 2).

Connected components by random-mate contraction: each round, vertices chosen by a coin are contracted
into neighbours by SQL joins until no edge is left; labels are then unwound from the last round to the
first. Components go to splits by cumulative weight, summed over buckets so that no task sees them all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut


def components(edges: DataFrame, seed: int = 17, rounds: int = 200) -> DataFrame:
    """(vertex, component) for all vertices of `edges` (columns a and b of one type).

    Null ends are dropped; an edge from a vertex to itself makes a component of its own; repeated edges
    count once. Each round, leaves first go into their only neighbour without a coin (of two leaves the
    larger into the smaller); then every vertex left flips a coin and a "tail" goes into its smallest
    "head" neighbour, if it has one. Expected rounds grow with the logarithm of the number of vertices. The least vertex of a
    component isn't always its name, but every vertex of it has the same one.
    """
    e = edges.select("a", "b").filter("a is not null and b is not null")
    loops = e.filter("a = b").select(F.col("a").alias("vertex"), F.col("a").alias("component")).distinct()
    e = cut(e.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    done: list[DataFrame] = []
    def contract(e: DataFrame, up: DataFrame) -> DataFrame:
        for c in ("a", "b"):
            e = e.join(up.select(F.col("v").alias(c), "to"), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
        return cut(e.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    for r in range(rounds):
        if e.isEmpty():
            break
        both = e.union(e.select("b", "a"))
        leaf = both.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("to")).filter("n = 1").select(F.col("a").alias("v"), "to")
        two = leaf.select(F.col("v").alias("to"), F.lit(True).alias("pair"))
        up = cut(leaf.join(two, "to", "left").filter("pair is null or v > to").select("v", "to"))
        if not up.isEmpty():
            done.append(up)
            e = contract(e, up)
            if e.isEmpty():
                break
        head = lambda c: F.pmod(F.xxhash64(F.lit(seed), F.lit(r), F.col(c)), F.lit(2)) == 1
        both = e.union(e.select("b", "a"))
        up = cut(both.filter(~head("a") & head("b")).groupBy("a").agg(F.min("b").alias("to")).select(F.col("a").alias("v"), "to"))
        done.append(up)
        e = contract(e, up)
    else:
        raise RuntimeError("contraction did not end")
    if not done:
        return loops
    label = None
    for up in reversed(done):
        if label is None:
            label = up.select(F.col("v").alias("vertex"), F.col("to").alias("component"))
            continue
        now = up.join(label.withColumnRenamed("vertex", "to"), "to", "left").select(F.col("v").alias("vertex"), F.coalesce("component", "to").alias("component"))
        label = cut(label.unionByName(now))
    roots = label.select(F.col("component").alias("vertex"), "component").distinct()
    label = label.unionByName(roots)
    return label.unionByName(loops.join(label.select("vertex"), "vertex", "left_anti"))


def assign(weights: DataFrame, target: list[tuple[str, float]], seed: int = 17, heavy: float = 0.005, buckets: int = 1024) -> DataFrame:
    """(component, weight, split): components laid end to end, heavy ones first, then in seeded order; a component belongs to the split in whose share its middle falls.

    `weights` has component and weight (null counts as 0). Shares are normalised; a target of no shares
    gives no rows. Running sums are made over buckets of the seeded order and then within buckets, so
    no task handles all components. The largest share comes first: it takes the heavy components.
    """
    target = sorted(((s, float(p)) for s, p in target if p and p > 0), key=lambda x: (-x[1], x[0]))
    if not target:
        return weights.select("component", F.coalesce("weight", F.lit(0)).alias("weight"), F.lit("").alias("split")).filter("false")
    w = weights.select("component", F.coalesce(F.col("weight"), F.lit(0)).cast("long").alias("weight"))
    total = w.agg(F.sum("weight")).first()[0] or 0
    w = w.withColumn("h", F.pmod(F.xxhash64(F.lit(seed), "component"), F.lit(1 << 40)))
    w = w.withColumn("k", F.when(F.col("weight") > heavy * total, F.lit(-1)).otherwise(F.floor(F.col("h") * buckets / (1 << 40))))
    per = w.groupBy("k").agg(F.sum("weight").alias("kw"))
    before = per.select("k", (F.sum("kw").over(Window.orderBy("k")) - F.col("kw")).alias("before"))  # at most buckets + 1 rows
    inside = Window.partitionBy("k").orderBy(F.desc(F.when(F.col("k") == -1, F.col("weight"))), "h", "component")
    w = w.join(before, "k").withColumn("mid", F.col("before") + F.sum("weight").over(inside) - F.col("weight") / 2)
    whole, at, col = sum(p for _, p in target), 0.0, None
    for s, p in target[:-1]:
        at += p
        ok = F.col("mid") < F.lit(total * at / whole)
        col = F.when(ok, s) if col is None else col.when(ok, s)
    return w.select("component", "weight", (F.lit(target[-1][0]) if col is None else col.otherwise(target[-1][0])).alias("split"))
