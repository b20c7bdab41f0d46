"""A sample that matches target category shares (problem 4).

Min-cost flow on the counts of cross-classified cells. Floors are kept first; arcs carry the margins and
what is available, dear arcs what goes beyond a margin, so that no page is dropped. Integer cell quotas
come out of a flow with random arc costs, and pages are drawn within cells by a seeded order.
"""

from __future__ import annotations

import heapq
import random
from collections import Counter
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Cost of a unit that passes a slack arc; far above any other cost.
SLACK = 10**6
#: Cost of a unit beyond a margin; far above the costs of a way through the cells.
OVER = 10**6


@dataclass
class Flow:
    """Min-cost max-flow by successive shortest paths with potentials; all costs are >= 0."""

    out: dict = field(default_factory=dict)
    arcs: list = field(default_factory=list)  # [to, left, cost]; the reverse arc stands at index ^ 1

    def arc(self, a: object, b: object, room: int, cost: int = 0) -> int:
        for x, y, c, k in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out.setdefault(x, []).append(len(self.arcs))
            self.arcs.append([y, int(c), k])
        return len(self.arcs) - 2

    def used(self, i: int) -> int:
        return self.arcs[i ^ 1][1]

    def run(self, s: object, t: object) -> int:
        high: dict = {}
        moved = 0
        while True:
            dist, via, heap, n = {s: 0}, {}, [(0, 0, s)], 0
            while heap:
                d, _, x = heapq.heappop(heap)
                if d > dist[x]:
                    continue
                for i in self.out.get(x, ()):
                    y, left, k = self.arcs[i]
                    e = d + k + high.get(x, 0) - high.get(y, 0)
                    if left > 0 and e < dist.get(y, 1 << 60):
                        dist[y], via[y], n = e, i, n + 1
                        heapq.heappush(heap, (e, n, y))
            if t not in dist:
                return moved
            for x in self.out:
                high[x] = high.get(x, 0) + dist.get(x, dist[t])
            f, x = 1 << 60, t
            while x != s:
                f, x = min(f, self.arcs[via[x]][1]), self.arcs[via[x] ^ 1][0]
            x = t
            while x != s:
                self.arcs[via[x]][1] -= f
                self.arcs[via[x] ^ 1][1] += f
                x = self.arcs[via[x] ^ 1][0]
            moved += f


def category(value: Column) -> Column:
    """A raw value trimmed, lower-cased, blanks and hyphens as underscores."""
    return F.regexp_replace(F.lower(F.regexp_replace(value, r"(?U)^\s+|\s+$", "")), r"(?U)[\s\-]+", "_")


def categorised(pages: DataFrame, alias: DataFrame, fields: list[str]) -> DataFrame:
    """`pages` with each field brought to its category; null stays null, unknown values stay as spelt in normal form."""
    for f in fields:
        a = alias.filter(F.col("field_name") == f).select(F.col("raw_value").alias("_raw"), F.col("category").alias("_cat")).distinct()
        pages = pages.withColumn("_raw", category(F.col(f))).join(a, "_raw", "left").withColumn(f, F.coalesce("_cat", "_raw")).drop("_raw", "_cat")
    return pages


def cells(pages: DataFrame, key: str, fields: list[str]) -> dict[tuple, int]:
    """Distinct pages of each cell. Bounded by the product of the categories, not by the pages."""
    return {tuple(r[f] for f in fields): r.n for r in pages.groupBy(*fields).agg(F.count_distinct(key).alias("n")).collect()}


def needs(targets: list[tuple], n: int) -> dict[tuple[str, str], int]:
    """(field, category) -> pages wanted: the share of n rounded up, at least the floor."""
    return {(f, c): max(-(-int(share or 0) * n // 100), int(floor or 0)) for f, c, share, floor in targets}


def shortfalls(have: dict[tuple, int], want: dict[tuple[str, str], int], fields: list[str]) -> dict[tuple[str, str], int]:
    """What the slack arc of each category carries: for each field, a flow from its categories through the cells that have pages."""
    out = {}
    for i, f in enumerate(fields):
        g, slack = Flow(), {}
        for (ff, c), w in want.items():
            if ff == f:
                g.arc("s", ("c", c), w)
                slack[c] = g.arc(("c", c), "t", w, SLACK)
        for cell, n in have.items():
            if cell[i] in slack:
                g.arc(("c", cell[i]), cell, n, 1)
            g.arc(cell, "t", n)
        g.run("s", "t")
        out |= {(f, c): g.used(a) for c, a in slack.items()}
    return out


def margins(targets: list[tuple], n: int, field_name: str, room: dict[str, int]) -> dict[str, int]:
    """The field's n pages by share, none above its room: what a short category can't take goes to the others by their shares.

    Largest remainders first, then floors taken from the category furthest above its own.
    """
    own = {c: (float(s or 0), min(int(m or 0), room.get(c, 0))) for f, c, s, m in targets if f == field_name}
    got, left = dict.fromkeys(own, 0), n
    free = {c for c, (s, _) in own.items() if s > 0}
    while free:
        whole = sum(own[c][0] for c in free)
        exact = {c: left * own[c][0] / whole for c in free}
        full = {c for c in free if exact[c] >= room.get(c, 0)}
        if not full:
            got |= {c: int(x) for c, x in exact.items()}
            for c in sorted(exact, key=lambda c: (got[c] - exact[c], c))[: max(0, left - sum(got[c] for c in free))]:
                got[c] += 1
            break
        got |= {c: room.get(c, 0) for c in full}
        left, free = left - sum(got[c] for c in full), free - full
    for c, (_, m) in own.items():
        while got[c] < m:
            if sum(got.values()) >= n:
                big = max(got, key=lambda x: (got[x] - own[x][1], x))
                if got[big] <= own[big][1]:
                    break
                got[big] -= 1
            got[c] += 1
    return got


def floored(have: dict[tuple, int], floor: list[dict[str, int]], want: list[dict[str, int]], n: int) -> dict[tuple, int]:
    """Pages that keep the floors, at most n: always from the cell that serves most open floors, then the one that passes fewest margins.

    A floor is only left open if n pages don't reach for it, as long as no floor is above what its category has.
    """
    open_, got = [dict(f) for f in floor], [Counter() for _ in floor]
    out: Counter = Counter()
    while n > 0:
        best = max((x for x, m in have.items() if out[x] < m), default=None, key=lambda x: (sum(o.get(c, 0) > 0 for o, c in zip(open_, x)), -sum(g[c] >= w.get(c, 0) for g, w, c in zip(got, want, x)), have[x] - out[x], str(x)))
        if best is None or not any(o.get(c, 0) > 0 for o, c in zip(open_, best)):
            break
        out[best], n = out[best] + 1, n - 1
        for o, g, c in zip(open_, got, best):
            o[c], g[c] = o.get(c, 0) - 1, g[c] + 1
    return dict(out)


def exchanged(quota: dict[tuple, int], have: dict[tuple, int], floor: list[dict[str, int]], want: list[dict[str, int]], n: int) -> dict[tuple, int]:
    """`quota` filled up to n pages and moved between cells while that brings the margins nearer; no floor is given up."""
    q = Counter(quota)
    got = [Counter() for _ in want]
    for x, m in q.items():
        for g, c in zip(got, x):
            g[c] += m
    over = lambda i, c: got[i][c] - want[i].get(c, 0)

    def move(x: tuple, m: int) -> None:
        q[x] += m
        for g, c in zip(got, x):
            g[c] += m

    while (lack := n - sum(q.values())) > 0:
        x = max((x for x, m in have.items() if q[x] < m), default=None, key=lambda x: (sum(over(i, c) < 0 for i, c in enumerate(x)), sum(c in w for w, c in zip(want, x)), str(x)))
        if x is None:
            break
        under = [-over(i, c) for i, c in enumerate(x) if over(i, c) < 0]
        move(x, min([lack, have[x] - q[x], *under]))
    while True:
        best = (0, 0, None, None)
        give = [x for x in q if q[x] > 0 and any(over(i, c) > 0 for i, c in enumerate(x))]
        take = [x for x in have if q[x] < have[x] and any(over(i, c) < 0 for i, c in enumerate(x))]
        for a in give:
            for b in take:
                gain, most = 0, min(q[a], have[b] - q[b])
                for i, (c, e) in enumerate(zip(a, b)):
                    if c != e:
                        up, down = over(i, c), -over(i, e)
                        gain += (1 if up > 0 else -1) + (1 if down > 0 else -1)
                        most = min([most, got[i][c] - floor[i].get(c, 0), *(v for v in (up, down) if v > 0)])
                if most > 0 and gain > best[0]:
                    best = (gain, most, a, b)
        if not best[0]:
            return {x: m for x, m in q.items() if m}
        move(best[2], -best[1])
        move(best[3], best[1])


def quotas(have: dict[tuple, int], targets: list[tuple], n: int, fields: list[str], seed: int = 17) -> dict[tuple, int]:
    """Integer quotas of the cells, n in all as far as there are pages: floors first, then two flows over the rest, then exchanges.

    The first field flows against the second, those cells then against the third. Each cell's arc has a
    cheap part, its proportional share rounded randomly, and a dearer rest; arcs beyond a margin carry at
    OVER what the cells can't bring elsewhere, so no page is dropped. Values without a target have a margin
    of 0 and come a little cheaper than an overfull category, so that a rare category's pages are taken.
    """
    rng = random.Random(seed)
    n = min(n, sum(have.values()))
    room = [Counter() for _ in fields]
    for cell, m in have.items():
        for r, c in zip(room, cell):
            r[c] += m
    want = [margins(targets, n, f, r) for f, r in zip(fields, room)]
    floor = [{c: min(int(m or 0), r[c]) for f, c, _, m in targets if f == name} for name, r in zip(fields, room)]
    base = floored(have, floor, want, n)
    rest = {cell: m - base.get(cell, 0) for cell, m in have.items()}
    goal = [{c: max(0, w.get(c, 0) - sum(b for cell, b in base.items() if cell[i] == c)) for c in room[i]} for i, w in enumerate(want)]
    beyond = [{c: OVER if c in w else OVER - OVER // 10 for c in r} for w, r in zip(want, room)]
    left_over = n - sum(base.values())
    state: dict[tuple, int] = {(c,): w for c, w in goal[0].items()}
    for k in range(1, len(fields)):
        avail: dict[tuple, dict[str, int]] = {}
        for cell, m in rest.items():
            avail.setdefault(cell[:k], Counter())[cell[k]] += m
        g, arcs = Flow(), {}
        whole = sum(goal[k].values()) or 1
        g.arc("s", "n", left_over)
        for left, m in state.items():
            g.arc("n", ("l", left), m)
            if k == 1:
                g.arc("n", ("l", left), left_over, beyond[0][left[0]])
            for c, a in sorted(avail.get(left, {}).items(), key=str):
                fair = min(a, int(m * goal[k][c] / whole + rng.random()))
                arcs[(*left, c)] = [g.arc(("l", left), ("r", c), fair, rng.randrange(1, 50)), g.arc(("l", left), ("r", c), a - fair, rng.randrange(200, 400))]
        for c, w in goal[k].items():
            g.arc(("r", c), "t", w)
            g.arc(("r", c), "t", left_over, beyond[k][c])
        g.run("s", "t")
        state = {cell: sum(map(g.used, two)) for cell, two in arcs.items()}
    return exchanged(Counter(base) + Counter(state), have, floor, want, n)


def draw(pages: DataFrame, key: str, fields: list[str], quota: dict[tuple, int], seed: int = 17, buckets: int = 512) -> DataFrame:
    """The pages drawn: in each cell the first `quota` in seeded order, found by buckets of that order so that a large cell is never ranked in one task."""
    spark = pages.sparkSession
    q = spark.createDataFrame([(i, *c, int(m)) for i, (c, m) in enumerate(quota.items())], "_c int, " + ", ".join(f"_{f} string" for f in fields) + ", _q long")
    same = reduce(lambda a, b: a & b, [F.col(f).eqNullSafe(F.col(f"_{f}")) for f in fields])  # null is a category too
    p = pages.join(F.broadcast(q), same).drop(*[f"_{f}" for f in fields]).withColumn("_h", F.xxhash64(F.lit(seed), key)).withColumn("_b", F.floor(F.pmod("_h", F.lit(1 << 40)) * buckets / (1 << 40)))
    by = p.groupBy("_c", "_b").agg(F.count("*").alias("_n"))
    before = by.withColumn("_before", F.sum("_n").over(Window.partitionBy("_c").orderBy("_b")) - F.col("_n")).drop("_n")
    p = p.join(before, ["_c", "_b"]).filter("_before < _q")
    rank = F.row_number().over(Window.partitionBy("_c", "_b").orderBy("_h", key))
    return p.withColumn("_r", rank).filter("_before + _r <= _q").drop("_c", "_h", "_b", "_q", "_r", "_before")
