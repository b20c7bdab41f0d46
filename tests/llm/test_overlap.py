import random
import unicodedata

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shabdika.functions.edit import distance
from shabdika.llm import lookalike, naming, overlap


def test_cores_are_disjoint_and_least():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n, k = 40, int(rng.integers(0, 4))
        w = rng.integers(0, 20, (5, n - overlap.Q + 1)).astype(float)
        for at, v in zip(overlap.cores(w, n, k).tolist(), w):
            assert len(at) == k + 1 and all(b - a >= overlap.Q for a, b in zip(at, at[1:])) and at[0] >= 0 and at[-1] + overlap.Q <= n
            best = np.full((k + 2, n + 1), np.inf)
            best[0] = 0
            for j in range(1, k + 2):
                for e in range(overlap.Q, n + 1):
                    best[j, e] = min(best[j, e - 1], best[j - 1, e - overlap.Q] + v[e - overlap.Q])
            assert sum(v[a] for a in at) == best[k + 1, n]


def test_every_length_has_room():
    for n in range(14, 3000):
        assert overlap.edits(n) < 1 or n // (overlap.edits(n) + 1) >= overlap.Q
    assert all(overlap.edits(n) >= 7 * m // 100 for n in range(1, 500) for m in range(n, 2 * n) if m - n <= 7 * m // 100)


def spoilt(a, k, r):
    b = list(a)
    for _ in range(k):
        i = r.randrange(len(b))
        b[i : i + 1] = r.choice([[], ["x"], [b[i], "y"]])
    return "".join(b)


def test_signature_bounds_edits():
    r = random.Random(1)
    for _ in range(200):
        a, k = "".join(r.choice("abcdefgh") for _ in range(60)), r.randrange(5)
        x, y = overlap.signatures([a, spoilt(a, k, r)])
        assert np.bitwise_count((x ^ y).view(np.uint64)).sum() <= 4 * k


def test_every_near_pair_meets():
    r = random.Random(1)
    ev = ["".join(r.choice("abcdefgh") for _ in range(r.choice([14, 20, 27, 40, 95, 130, 225, 240, 241, 260, 400]))) for _ in range(600)]
    tr = [spoilt(a, r.randrange(1, 2 + overlap.edits(len(a))), r) for a in ev]
    counts = np.ones(1 << overlap.COUNT_BITS, np.float32)
    s = overlap.stored(ev, ["7"] * 600, counts)
    assert set(s.groupby("text").size()) == {overlap.edits(n) + 1 for n in map(len, ev)}
    assert all((x.a == (x.a + x["size"]).shift(fill_value=0)).all() and x["size"].sum() == len(ev[i]) and (x.p >= x.a).all() and (x.p + overlap.Q <= x.a + x["size"]).all() for i, x in s.groupby("text"))
    sets = overlap.signatures(ev)
    index = overlap.Index(s.assign(fid=s.text, g=s.g.to_numpy().view(np.int64), whole=s.whole.to_numpy().view(np.int64)), pd.DataFrame({"fid": range(600), "n": [len(x) for x in ev], **{f"s{i}": sets[:, i] for i in range(overlap.WORDS)}}))
    everything = lambda g: np.arange(len(g))
    met = set(zip(*(x.tolist() for x in index.met(tr, ["7"] * 600, everything))))
    near = [i for i in range(600) if distance(ev[i], tr[i]) * 100 <= 7 * max(len(ev[i]), len(tr[i]))]
    assert len(near) > 300 and all((i, i) in met for i in near) and len(met) <= 600
    assert not len(index.met(tr, ["8"] * 600, everything)[0])


def test_forms_in_bulk_equal_forms_one_by_one():
    import regex

    texts = ["", None, "  ", "Straße 12/3 ४५", "ＡＢＣ １２", "re\u0301sume\u0301", "résumé", "a\u200bb\u00a0c", "कार्य\u200dालय अाज", "x\n7\n8", "७८ ९", "²½Ⅳ 5", "Ωmega", "МОСКВА", "\U0001d400b", "12", "34"]
    m = lookalike.classes({c: 1 for t in texts if t for c in t})
    form, digits = lookalike.Rewriter(m), {c: str(unicodedata.digit(chr(c))) for c in range(0x80, 0x1FC00) if unicodedata.category(chr(c)) == "Nd"}
    got = list(zip(*overlap.Forms(m)(texts)))
    for t, g in zip(texts, got):
        x = (form(t or "") or "").translate(digits).casefold()
        assert g == (regex.sub(r"[^\p{L}\p{M}\p{N}]+", "", x), " ".join(regex.findall(r"\d+", x))), t


@pytest.mark.parametrize("most", [overlap.INDEX, 0])
def test_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(overlap, "INDEX", most)
    r = random.Random(7)
    words = ["tender", "repair", "market", "school", "bridge", "office", "within", "report"]
    rows, base = [], []
    for i in range(60):
        t = " ".join(r.choice(words) for _ in range(r.randrange(1, 14))) + r.choice(["", " 12", " 7 3", " १२"])
        base.append(t)
        rows.append((i, f"d/abc_mar_{i:04d}_0_l{i % 3:03d}.png", t, "train", "s"))
    for i in range(60, 130):
        t = list(r.choice(base))
        for _ in range(r.randrange(0, 9)):
            j = r.randrange(len(t))
            if not t[j].isdigit():
                t[j : j + 1] = r.choice([[], ["z"], [t[j].upper()], [t[j], ","]])
        rows.append((i, f"e/abc-mar-{i - 60}-0-l{i % 3}.jpg", "".join(t), r.choice(["val", "test"]), "s"))
    rows += [(200, None, None, "train", "s"), (201, None, "  ", "val", "s"), (202, "x", "!!", "train", "s"), (203, "x", "??", "val", "s"), (204, None, "12", "train", "s"), (205, None, "१२", "test", "s"), (206, None, "y" * 20000, "train", "s"), (207, None, "y" * 19000 + "z" * 1000, "val", "s"), (None, None, "12", "val", "s"), (204, None, "12", "train", "s")]
    d = spark.createDataFrame(rows, "row_id long, image_path string, text string, split string, form string")
    got = {(p.row_id_a, p.row_id_b): p for p in overlap.overlaps(d, naming.line_key(F.col("image_path"))).collect()}
    form = lookalike.classes({})
    f = {x[0]: overlap.comparable(x[2], form) for x in rows}
    want = set()
    for a in rows:
        for b in rows:
            if a[0] is not None and b[0] is not None and a[3] == "train" and b[3] != "train" and f[a[0]][0] and f[b[0]][0] and f[a[0]][1] == f[b[0]][1]:
                x, y = f[a[0]][0], f[b[0]][0]
                n = max(len(x), len(y))
                if n < 5000 and distance(x, y) * 100 <= 7 * n or n >= 5000 and x[:1] == y[:1] == "y" and 1000 * 100 <= 7 * n:
                    want.add((min(a[0], b[0]), max(a[0], b[0])))
    assert {k for k, p in got.items() if p.by_text} == want
    crop = {(i, i + 60) for i in range(60) if i % 3 == (i + 60) % 3}
    assert {k for k, p in got.items() if p.by_crop} == crop


def test_empty(spark):
    d = spark.createDataFrame([], "row_id long, image_path string, text string, split string")
    assert overlap.overlaps(d, naming.line_key(F.col("image_path"))).count() == 0


def test_names(spark):
    names = ["datasets/a/cir_mar_00000410_p0_l002.jpg", "X\\Cir mar 410 0 l002.jpeg", "cir.mar.000410.0.l002.tif", "CIR_MAR_00000410_0_L002.PNG", "cir_mar_00000410_0000_l002_aug3.png", None, "", "photo.png"]
    d = spark.createDataFrame([(n,) for n in names], "n string")
    c = F.col("n")
    got = [tuple(r) for r in d.select(naming.doc_key(c), naming.page_key(c), naming.line_key(c)).collect()]
    assert got[:5] == [("cir_mar_410", "cir_mar_410_0", "cir_mar_410_0_2")] * 5 and got[5:] == [(None, None, None)] * 3
