import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from shabdika.llm import containers, mixing, pieces, quota, splits, tokens


def union(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        up[find(a)] = find(b)
    out = defaultdict(set)
    for x in list(up):
        out[find(x)].add(x)
    return {frozenset(v) for v in out.values()}


@pytest.mark.parametrize("kind", ["random", "star", "path", "ring"])
def test_components(spark, kind):
    r = random.Random(4)
    edges = {"random": [(r.randrange(60), r.randrange(60)) for _ in range(45)], "star": [(0, i) for i in range(1, 40)], "path": [(i, i + 1) for i in range(30)], "ring": [(i, (i + 1) % 25) for i in range(25)]}[kind]
    d = spark.createDataFrame([*edges, edges[0], (7, None), (None, None)], "a long, b long")
    rows = splits.components(d).collect()
    got = defaultdict(set)
    for x in rows:
        got[x.component].add(x.vertex)
    assert {frozenset(v) for v in got.values()} == union(edges) and len(rows) == sum(map(len, got.values()))


def test_components_of_nothing(spark):
    d = spark.createDataFrame([], "a string, b string")
    assert splits.components(d).count() == 0
    assert splits.components(spark.createDataFrame([("x", "x")], "a string, b string").filter("true")).collect()[0].component == "x"


def test_split_shares(spark):
    r = random.Random(2)
    w = [(i, 3000 if i == 0 else r.randrange(1, 9)) for i in range(2000)] + [(5000, None)]
    rows = splits.assign(spark.createDataFrame(w, "component long, weight long"), [("train", 80), ("val", 10), ("test", 10), ("none", 0)]).collect()
    got = Counter()
    for x in rows:
        got[x.split] += x.weight
    whole = sum(got.values())
    assert len(rows) == len({x.component for x in rows}) == 2001
    assert abs(got["val"] / whole - 0.1) < 0.01 and abs(got["test"] / whole - 0.1) < 0.01
    assert splits.assign(spark.createDataFrame(w, "component long, weight long"), []).count() == 0


def test_flow_and_shortfalls():
    have = {("a", "x"): 10, ("a", "y"): 2, (None, "x"): 5}
    want = {("f", "a"): 8, ("g", "x"): 20, ("g", "y"): 2, ("g", "z"): 1}
    assert quota.shortfalls(have, want, ["f", "g"]) == {("f", "a"): 0, ("g", "x"): 5, ("g", "y"): 0, ("g", "z"): 1}
    assert quota.shortfalls({}, want, ["f", "g"]) == dict(want)


def test_min_cost_flow_against_networkless_brute_force():
    r = random.Random(3)
    for _ in range(25):
        cost = [[r.randrange(1, 9) for _ in range(3)] for _ in range(3)]
        g = quota.Flow()
        arcs = {}
        for i in range(3):
            g.arc("s", ("l", i), 1)
            g.arc(("r", i), "t", 1)
            for j in range(3):
                arcs[i, j] = g.arc(("l", i), ("r", j), 1, cost[i][j])
        assert g.run("s", "t") == 3
        from itertools import permutations

        assert sum(cost[i][j] for (i, j), a in arcs.items() if g.used(a)) == min(sum(cost[i][p[i]] for i in range(3)) for p in permutations(range(3)))


def test_sample_keeps_margins(spark):
    r = random.Random(6)
    rows = [(f"p{i}", r.choice(["mr", "mr", "hi"]), r.choice(["a", "b"]), r.choice(["s", "t"])) for i in range(900)] + [("q", None, "a", "s")]
    f = ["l", "d", "k"]
    targets = [("l", "mr", 50, 1), ("l", "hi", 50, 1), ("d", "a", 70, 1), ("d", "b", 30, 1), ("k", "s", 40, 1), ("k", "t", 60, 1)]
    d = spark.createDataFrame(rows, "line_id string, l string, d string, k string")
    have = quota.cells(d, "line_id", f)
    q = quota.quotas(have, targets, 200, f)
    got = quota.draw(d, "line_id", f, q).collect()
    assert len(got) == len({x.line_id for x in got}) == 200
    assert Counter(x.l for x in got) == {"mr": 100, "hi": 100} and Counter(x.d for x in got) == {"a": 140, "b": 60} and Counter(x.k for x in got) == {"s": 80, "t": 120}


SHORT = {("mr", "a", "s"): 400, ("mr", "b", "t"): 30, ("hi", "a", "t"): 300, ("kok", "b", "t"): 4, ("hi", "c", "s"): 3, ("mr", None, "s"): 5, ("hi", "?", "t"): 5}
SHORT_TARGETS = [("l", "mr", 50, 1), ("l", "hi", 40, 1), ("l", "kok", 10, 3), ("d", "a", 60, 1), ("d", "b", 20, 1), ("d", "c", 10, 3), ("d", "none", 10, 2), ("k", "s", 50, 1), ("k", "t", 50, 1)]


def test_sample_is_whole_where_categories_are_short(spark):
    f = ["l", "d", "k"]
    for n in (40, 200, 740, 747, 900):
        q = quota.quotas(SHORT, SHORT_TARGETS, n, f)
        assert sum(q.values()) == min(n, 747) and all(m <= SHORT[c] for c, m in q.items())
        assert sum(m for c, m in q.items() if c[0] == "kok") >= 3 and sum(m for c, m in q.items() if c[1] == "c") == 3
    rows = [(f"{c}{i}", *c) for c, m in SHORT.items() for i in range(m)]
    d = spark.createDataFrame(rows, "line_id string, l string, d string, k string")
    for n in (200, 745):
        got = quota.draw(d, "line_id", f, quota.quotas(SHORT, SHORT_TARGETS, n, f)).collect()
        assert len(got) == len({x.line_id for x in got}) == n
        assert n < 745 or any(x.d is None for x in got)


def test_sample_keeps_floors_of_the_last_field():
    # the only pages of t lie in a cell that the margins of the first two fields don't ask for
    have = {("x", "p", "s"): 500, ("y", "q", "s"): 500, ("x", "q", "t"): 5}
    targets = [("l", "x", 50, 0), ("l", "y", 50, 0), ("d", "p", 50, 0), ("d", "q", 50, 0), ("k", "s", 100, 0), ("k", "t", 0, 4)]
    q = quota.quotas(have, targets, 20, ["l", "d", "k"])
    assert sum(q.values()) == 20 and q["x", "q", "t"] == 4


def test_margins_hand_on_what_a_short_category_lacks():
    assert quota.margins([("f", "a", 50, 0), ("f", "b", 25, 0), ("f", "c", 25, 0), ("g", "z", 100, 0)], 100, "f", {"a": 90, "b": 70, "c": 1}) == {"a": 66, "b": 33, "c": 1}
    assert quota.margins([("f", "a", 90, 0), ("f", "b", 10, 15), ("f", "c", 0, 2)], 100, "f", {"a": 90, "b": 70, "c": 1}) == {"a": 84, "b": 15, "c": 1}


def test_pieces():
    kind, p = pieces.cut_row(1000, 1000, 32, [100, 400, 480, 700, 900], "a b c d e f", 512, 32)
    assert kind == "gap" and all(b - a <= 512 for a, b, _ in p) and p[0][0] == 0 and p[-1][1] == 1000
    assert all(y[0] == pytest.approx(x[1] - 32) for x, y in zip(p, p[1:])) and all(e == "blank" for *_, e in p[:-1])
    kind, p = pieces.cut_row(2000, 2000, 32, None, None, 512, 32)
    assert kind == "hard" and all(b - a <= 512 + 1e-6 for a, b, _ in p) and {e for *_, e in p} == {"inside", "end"}
    kind, p = pieces.cut_row(600, None, None, [300], "ab cd", 512, 32)
    assert kind == "gap" and len(p) == 2
    assert pieces.cut_row(600, 600, 32, [520, 520, -3, 9999, None], "x", 512, 32)[0] == "hard"


def test_pieces_prefer_phrases():
    _, p = pieces.cut_row(900, 900, 32, [100, 200, 300, 400, 500, 600, 700, 800], "a b c, d e f, g h i", 512, 32)
    assert [x[1] for x in p] == [300.0, 600.0, 900.0]


def test_pieces_rows(spark):
    rows = [(1, 1000, 32, None, [200, 500, 800], "a b c d"), (1, 1000, 32, None, [200, 500, 800], "a b c d"), (2, None, 0, 700, [], None), (3, None, None, None, [1], "x"), (4, 0, 10, 90, None, ""), (None, 9000, 32, None, None, None)]
    d = spark.createDataFrame(rows, "measure_id long, original_width int, original_height int, height32_width_before_cap int, gap_x array<int>, text string")
    got = pieces.pieces(d, 512, 32).collect()
    assert {(r.measure_id, r.cut_kind) for r in got} == {(1, "gap"), (2, "hard")} and pieces.pieces(d.filter("false"), 512, 32).count() == 0
    with pytest.raises(ValueError):
        pieces.pieces(d, 10, 10)


def test_packing_keeps_limits():
    rng = np.random.default_rng(1)
    t = rng.integers(0, 200, 3000)
    loss = (t * rng.random(3000)).astype(int)
    box = containers.pack(t, loss, (256, 12, 256))
    assert (box >= 0).all()
    n = box.max() + 1
    assert np.bincount(box, t, n).max() <= 256 and np.bincount(box, loss, n).max() <= 256 and np.bincount(box).max() <= 12
    assert t.sum() / 256 / n > 0.97
    assert len(containers.pack(np.zeros(0, int), np.zeros(0, int), (10, 2, 10))) == 0


def test_containers_whole(spark):
    r = random.Random(8)
    rows = [(i, r.choice([0, 3, 40, 99, 100, 250]), 2) for i in range(500)] + [(None, 5, 0)]
    d = spark.createDataFrame(rows, "doc_id long, tokens int, head int")
    got = containers.filled(d, (100, 50, 100), group=120).collect()
    fill, sizes = Counter(), Counter()
    for x in got:
        fill[x.container] += x.tokens
        sizes[x.doc_id] += x.tokens
    assert max(fill.values()) <= 100 and len(sizes) == 500
    assert all(sizes[i] == t for i, t, _ in rows if i is not None)
    assert all(x.part == 0 for x in got if rows[x.doc_id][1] <= 100)
    assert containers.filled(d.filter("false"), (100, 50, 100)).count() == 0
    with pytest.raises(ValueError):
        containers.filled(d, (100, 50, 10))


def test_token_counts(spark):
    d = spark.createDataFrame([(1, "one two\nthree", "c"), (2, None, None), (3, "", "c"), (4, "कृषी विभाग " * 5000, "c")], "doc_id long, text string, _c string")
    got = {r.doc_id: r for r in tokens.counted(d, head="head").collect()}
    assert got[2].tokens == got[3].tokens == 0 and 0 < got[1].head < got[1].tokens and got[4].head == 0 and got[4].tokens > 10000
    assert tokens.counted(d.filter("false"), head="head").count() == 0


def test_budget():
    root = mixing.tree([("a", "x", "p", 100), ("a", "y", "p", 100), ("b", "x", "p", 10), ("z", "x", "p", 99)], {"a": (50, 1), "b": (50, 2), "c": (10, 5)})
    assert mixing.budget(root, 150) == 150
    got = {s.name: s.budget for s in root.below}
    assert got == {"a": 130, "b": 20, "c": 0}
    assert mixing.budget(root, 10**6) == 220


def test_mix(spark):
    r = random.Random(9)
    rows = [(i, r.choice(["big", "big", "big", "small"]), r.choice(["mr", None]), None, r.randrange(1, 50)) for i in range(3000)] + [(9999, "big", "mr", None, 0), (None, "big", "mr", None, 4)]
    d = spark.createDataFrame(rows, "doc_id long, source string, lang string, domain string, tokens int")
    whole = sum(x[4] for x in rows if x[0] is not None)
    mix, report = mixing.mixed(d, [("big", 50, 1), ("small", 50, 2), ("none", 5, 2)], whole // 2)
    got = mix.collect()
    by = Counter()
    for x in got:
        by[x.source] += x.tokens
    assert len(got) == len({(x.doc_id, x.epoch) for x in got}) and max(x.epoch for x in got) <= 1
    rep = {x.source: x for x in report.collect()}
    assert abs(by["big"] - rep["big"].budget) < 200 and abs(by["small"] - rep["small"].budget) < 200
    assert rep["none"].tokens == 0 and abs(sum(x.actual_pct for x in rep.values()) - 100) < 0.01
    empty = mixing.mixed(d.filter("false"), [("big", 50, 1)], 10)
    assert empty[0].count() == 0 and empty[1].first().tokens == 0
