import pytest

from shabdika.llm import language as L

MR = "सदर प्रस्ताव मंजूर करण्यात येत आहे आणि नागरिकांनी तक्रारी कार्यालयात नोंदवाव्यात"
HI = "यह प्रस्ताव स्वीकृत किया जाता है और निवासियों की शिकायत कार्यालय में दर्ज की जाए"
EN = "The proposal has been approved and residents may bring complaints to the office"


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, k, t) for i, (k, t) in enumerate([("mr", MR + ". " + MR), ("hi", HI + "। " + HI), ("en", EN + ". " + EN)] * 5 + [("hi", MR), (None, EN), ("mr", None)])]
    return L.models(spark.createDataFrame(rows, "doc_id long, lang string, text string"))


def test_probabilities_sum_to_one(model):
    import numpy as np

    # over all characters after a seen context, interpolation leaves no more than the whole
    ctx = model.ctx[1][: 20]
    for h in ctx:
        p = sum(np.exp(model.logp[1][i][0]) for i, k in enumerate(model.keys[1]) if k >> 10 == h)
        assert p <= 1.01


def judged(model, texts, **kw):
    has, conf = L.judge(texts, L.Words(model), **kw)
    return ["".join(k[0] for k, h in zip(L.LANGUAGES, row) if h) for row in has]


def test_one_and_mixed(model):
    assert judged(model, [MR, HI, EN, MR + ". " + HI, MR + " / " + EN, MR + " " + HI, "", "१२ ३४", MR + " (PDF)"]) == ["m", "h", "e", "mh", "me", "mh", "", "", "m"]


def test_change_and_back(model):
    # leanings of about +, -, + and -, +, -: no part outweighs what stands before it
    assert judged(model, [f"{MR}, {HI}, {MR}", f"{HI}; {MR}; {HI}", f"{MR}\n{HI}\n{MR}"], wrapped=True) == ["mh"] * 3
    assert judged(model, [f"{MR}, {MR}, {MR}", f"{HI}, {HI}"]) == ["m", "h"]
    assert judged(model, [f"{MR}, {HI}, {MR}. {HI}", MR, f"{HI}, {MR}, {HI}"]) == ["mh", "m", "mh"]


def test_points_that_end_no_sentence(model):
    assert L.unpointed("क्र. 12 दि. 1.5.2020 No. 7 says no. F. 3\n2. x 2020. y आहे. A.B.") == "क्र  12 दि  1 5 2020 No  7 says no. F  3\n2. x 2020. y आहे. A B "
    en = "The proposal has been Dr. approved and residents"  # parts of 4 and 3 words
    assert judged(model, [f"{MR}. {en}", f"{MR}. The proposal has been no. 12 approved and residents", f"{MR}. The proposal has been. Approved and residents"]) == ["me", "me", "m"]
    t = f"{MR} क्र. 12 {MR}"
    assert [x[:3] for x in L.spans(t, L.Words(model))] == [(0, len(t), "mr")]


def test_prior_and_fragments(model):
    assert judged(model, ["आहे", "है", "xq"]) == ["m", "h", "e"]
    assert judged(model, ["झटट"], prior=[1]) == ["h"] and judged(model, ["झटट"], prior=[0]) == ["m"]


def test_spans_cover_languages(model):
    t = MR + ". " + EN
    got = L.spans(t, L.Words(model))
    assert [g[2] for g in got] == ["mr", "en"] and got[0][0] == 0 and got[-1][1] == len(t) and L.spans(None, L.Words(model)) == []


def test_words_forget_without_change(model):
    a, b = L.Words(model, most=3), L.Words(model)
    toks = (MR + " " + HI).split()
    for _ in range(3):
        assert (a.look(toks) == b.look(toks)).all()


@pytest.fixture(scope="module")
def fitted(spark):
    import random

    r = random.Random(5)
    mixed = lambda t: ". ".join(" ".join(r.sample(t.split(), 10)) for _ in range(8))
    rows = [(i, k, mixed(t)) for i, (k, t) in enumerate([("mr", MR), ("hi", HI), ("en", EN)] * 160)]
    return L.models(spark.createDataFrame(rows, "doc_id long, lang string, text string"))


def test_rejected_text_has_low_confidence(fitted):
    assert (fitted.limit < L.REJECT).all()
    french, marathi = "Le conseil municipal ne peut accepter cette demande avant jeudi", "Sadar prastav manjur karanyat yet ahe ani nagarikanni takrari"
    has, conf = L.judge([EN, french, marathi, "xqzv wkjh ptrl mnbv zxcq wrtp", MR, HI, "झङढ ठणझ ङञढ घझठ ढङझ ञझघ"], L.Words(fitted))
    assert has[:4, 2].all() and conf[0, 2] > 0.5 and (conf[1:4, 2] < 0.5).all()
    assert has[4, 0] and has[5, 1] and conf[4, 0] > 0.5 and conf[5, 1] > 0.5 and has[6, :2].sum() == 1 and conf[6].max() < 0.5


def test_threshold(fitted):
    said = [EN.split()] * L.LEAST
    assert L.threshold(fitted, 2, said[1:]) == L.REJECT
    assert -L.score(fitted, said[0])[:, 2].sum() / (len(EN) + 1) < L.threshold(fitted, 2, said) < L.REJECT


def test_rows(spark, model):
    rows = [("d", 1, "mr", MR), ("d", 2, None, MR), ("d", 3, "en", HI), ("d", 4, " MR-IN ", MR), ("d", 5, "deva", HI), ("d", 6, "mr", None), ("d", 7, "", "  "), ("d", 8, "mul", MR + ". " + EN), ("d", 9, "latin", "12")]
    d = spark.createDataFrame([(*r, None, False) for r in rows], "table_name string, rec_id long, label string, text string, prior string, wrapped boolean")
    got = {r.rec_id: (r.case, tuple(r.languages)) for r in L.identified(d, model).collect()}
    assert {k for k, v in got.items() if v[0]} == {2, 3, 8} and got[8][1] == ("mr", "en") and got[6] == (False, ()) and got[9] == (False, ())
    assert L.identified(d.filter("false"), model).count() == 0 and L.segments(d, model).filter("rec_id = 8").count() == 2
    assert L.identified(spark.createDataFrame([("d", 1, "mr", MR * 2000, None, True)], d.schema), model).first().languages == ["mr"]
