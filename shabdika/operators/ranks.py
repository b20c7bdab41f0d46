"""Values at given ranks of large groups, without gathering a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def at_index(df: DataFrame, by: list[str], value: str, index: dict[str, Column]) -> DataFrame:
    """Per group, the value at each 0-based index of its sorted values. `index` maps an output name to an index over the column `n`, the group's size.

    Works on counts per distinct value: the running count is a window over distinct values only. Null
    values are left out; groups of nulls alone give no row.
    """
    c = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by).orderBy(value)
    c = c.withColumn("_to", F.sum("_c").over(w)).withColumn("n", F.sum("_c").over(Window.partitionBy(*by)))
    hit = lambda i: F.max(F.when((F.col("_to") - F.col("_c") <= i) & (i < F.col("_to")), F.col(value)))
    return c.groupBy(*by).agg(F.max("n").alias("n"), *[hit(F.least(F.floor(i), F.col("n") - 1)).alias(k) for k, i in index.items()])


def floor_index(p: float) -> Column:
    """Index min(int(p n), n - 1)."""
    return F.floor(F.lit(p) * F.col("n"))


def scaled_index(p: float) -> Column:
    """Index int(p (n - 1))."""
    return F.floor(F.lit(p) * (F.col("n") - 1))


def first_k(df: DataFrame, by: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each group. Rows are cut to k per group and salt first, so a hot group is never ranked whole."""
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(64))
    d = df.withColumn("_s", salt)
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_s").orderBy(*order))).filter(F.col("_r") <= k).drop("_r")
    return d.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k).drop("_s")


def ranked(df: DataFrame, by: list[str], order: str, key: str, out: str = "rank", size: str | None = None, prefix: int = 2) -> DataFrame:
    """Rank of each row in its group by (order, key), `order` being a hex hash; with `size` also the group's size.

    Counts per hash prefix give what stands before, so only rows of one prefix are ever ranked together.
    """
    d = df.withColumn("_b", F.substring(order, 1, prefix))
    w = Window.partitionBy(*by)
    c = d.groupBy(*by, "_b").agg(F.count("*").alias("_c"))
    c = c.withColumn("_before", F.sum("_c").over(w.orderBy("_b")) - F.col("_c")).withColumn("_whole", F.sum("_c").over(w))
    same = F.lit(True)
    for x in [*by, "_b"]:
        same = same & F.col(f"d.{x}").eqNullSafe(F.col(f"c.{x}"))
    j = d.alias("d").join(c.alias("c"), same).select("d.*", "c._before", "c._whole")
    j = j.withColumn(out, F.col("_before") + F.row_number().over(Window.partitionBy(*by, "_b").orderBy(order, key)))
    return (j.withColumn(size, F.col("_whole")) if size else j).drop("_b", "_before", "_whole")
