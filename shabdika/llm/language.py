"""Languages of documents and of their segments (problem 7).

A character model per language: interpolated Kneser-Ney over characters within words, its probabilities
and back-off weights in sorted key arrays. A segment gets the language of lowest cross-entropy per
character; segments that fit no model, or two equally well, are rejected. Text beyond a threshold fitted to held-out
documents keeps its likeliest language, with a low confidence. Words are scored once per
worker and batch; everything after that is arithmetic on arrays.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import encoding, lookalike

LANGUAGES = ("mr", "hi", "en")
#: Characters in a model's window, the one it predicts included.
ORDER = 4
DISCOUNT = 0.75
#: Labelled documents per language that the models are fitted on. All else covers every row.
SAMPLE = 1000
#: A language counts if a segment in it has so many words, and beats the others by so many nats.
SENTENCE, MARGIN = 6, 3.0
#: Nats by which a stretch of each language must lean where the language changes inside a segment; a few invented names lean less.
CHANGE = 30.0
#: Characters judged at once.
AT_ONCE = 1_000_000
#: Cross-entropy per character above which a segment says nothing about its text's languages; also the threshold of confidence where there are too few held-out segments to fit one.
REJECT = 5.0
#: Every so many-th labelled document is held out to fit the thresholds of rejection; segments that takes, and the share of them to be kept.
HELD, LEAST, KEEP = 5, 200, 0.999
#: Share of characters that may be misread in a text that is still in its language; labelled documents are cleaner than recognised lines.
MISREAD = 0.1

#: Words of Latin and of Devanagari letters; ends of sentences; the mark between two texts.
_TOKEN = re.compile("[A-Za-zÀ-ɏ]+|[ऀ-ॣॱ-ॿ]+|[.।?!|/\n\x01]")
#: Points that end no sentence: between digits, after initials and fixed abbreviations; "no." and the like only before a number, as a word may end a sentence.
_ABBREVIATIONS = "Dr|Mr|Mrs|Ms|Prof|Smt|Shri|Sr|Jr|Rs|Dept|Govt|Ltd|viz|vs|डॉ|क्र|श्री|सौ|कु|रु|मा|ता|जि|दि|प्रा|प्रो|पं|सं|अॅड"
_POINT = re.compile(rf"(?<=[0-9०-९])\.(?=[0-9०-९])|(?<![A-Za-zÀ-ɏऀ-ॿ])(?:(?:{_ABBREVIATIONS}|[A-Z]|[अ-हक़-ॡ])\.|(?:[Nn]os?|[Rr]ef|[Ff]ig|[Pp]p?)\.(?=\s*[0-9०-९]))")
_ODD = re.compile("[^\x00-\x7fऀ-ॿ]")


@dataclass
class Model:
    """All languages' models over one alphabet. keys[n] are sorted windows of n + 1 characters with logp[n] (one column a language); ctx[n] and back[n] likewise hold contexts of n + 1 characters and log back-off weights."""

    alphabet: np.ndarray
    keys: list
    logp: list
    ctx: list
    back: list
    limit: np.ndarray = field(default_factory=lambda: np.full(len(LANGUAGES), REJECT))


def fit(words: dict[str, Counter]) -> Model:
    """Models from word counts per language. A word is read as ^word$."""
    chars = sorted({c for w in words.values() for x in w for c in x if ord(c) < 0x10000})[:1000]
    alphabet = np.ones(0x10000, np.int64)  # 1: unknown
    for i, c in enumerate(chars):
        alphabet[ord(c)] = i + 4
    alphabet[ord("^")], alphabet[ord("$")] = 2, 3
    size = len(chars) + 4
    low = (1 << 10 * (ORDER - 1)) - 1
    per = []
    for lang in LANGUAGES:
        # a window is a number of 10 bits a character, the last one lowest
        top: Counter = Counter()
        for w, n in words.get(lang, Counter()).items():
            g = 0
            for _ in range(ORDER - 1):
                g = g << 10 | 2
            for c in [*alphabet[[min(ord(c), 0xFFFF) for c in w]].tolist(), 3]:
                g = (g & low) << 10 | c
                top[g] += n
        counts: list = [None] * ORDER
        counts[ORDER - 1] = top
        for n in range(ORDER - 2, -1, -1):  # continuation counts: in how many contexts
            mask = (1 << 10 * (n + 1)) - 1
            counts[n] = Counter(g & mask for g in counts[n + 1])
        probs: list[dict] = []
        backs: list[dict] = []
        for n in range(ORDER):
            total: Counter = Counter()
            kinds: Counter = Counter()
            for g, c in counts[n].items():
                total[g >> 10] += c
                kinds[g >> 10] += 1
            back = {h: DISCOUNT * kinds[h] / total[h] for h in total}
            mask = (1 << 10 * n) - 1
            under = probs[n - 1] if n else {}
            probs.append({g: (c - DISCOUNT) / total[g >> 10] + back[g >> 10] * (under.get(g & mask, 0.0) if n else 1 / size) for g, c in counts[n].items()})
            backs.append(back)
        per.append((probs, backs))
    keys, logp, ctx, back_ = [], [], [], []
    for n in range(ORDER):
        k = np.array(sorted(set().union(*(probs[n] for probs, _ in per))), np.int64)
        lp = np.zeros((len(k), len(LANGUAGES)), np.float64)
        for i, (probs, backs) in enumerate(per):
            own, bk, mask = probs[n], backs[n], (1 << 10 * n) - 1
            have = np.array([own.get(g, 0.0) for g in k.tolist()])
            if n:  # what a model lacks comes from its shorter window
                short = np.exp(logp[n - 1][_find(keys[n - 1], k & mask), i].astype(np.float64))
                fall = np.array([bk.get(g >> 10, 1.0) for g in k.tolist()]) * short
            else:
                fall = np.full(len(k), 1 / size)
            lp[:, i] = np.log(np.where(have > 0, have, fall))
        keys.append(k)
        logp.append(lp.astype(np.float32))
        h = np.array(sorted(set().union(*(b[n] for _, b in per))), np.int64)
        ctx.append(h)
        back_.append(np.log(np.array([[b[n].get(x, 1.0) for _, b in per] for x in h.tolist()]).reshape(-1, len(LANGUAGES))).astype(np.float32))
    return Model(alphabet, keys, logp, ctx, back_)


def _find(sorted_keys: np.ndarray, k: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_keys, k)
    at[at == len(sorted_keys)] = 0
    return np.where(sorted_keys[at] == k, at, -1) if len(sorted_keys) else np.full(len(k), -1)


def score(m: Model, words: list[str]) -> np.ndarray:
    """Log-likelihood of each word under each model."""
    if not words:
        return np.zeros((0, len(LANGUAGES)))
    pad = "^" * (ORDER - 1)
    whole = "".join([f"{pad}{w}$" for w in words])
    ids = m.alphabet[np.minimum(np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4"), 0xFFFF)]
    lens = np.array([len(w) for w in words]) + ORDER
    starts = np.r_[0, np.cumsum(lens)[:-1]]
    real = np.ones(len(ids), bool)
    for i in range(ORDER - 1):
        real[starts + i] = False
    pos = np.flatnonzero(real)
    out = np.zeros((len(pos), len(LANGUAGES)), np.float32)
    todo = np.arange(len(pos))
    for n in range(ORDER - 1, -1, -1):
        k = np.zeros(len(todo), np.int64)
        for i in range(n, -1, -1):
            k = (k << 10) | ids[pos[todo] - i]
        hit = _find(m.keys[n], k)
        ok = hit >= 0
        out[todo[ok]] += m.logp[n][hit[ok]]
        todo, k = todo[~ok], k[~ok]
        if not len(todo):
            break
        h = _find(m.ctx[n], k >> 10)
        some = h >= 0
        out[todo[some]] += m.back[n][h[some]]
    out[todo] += -np.log(1000.0)
    cum = np.vstack([np.zeros((1, len(LANGUAGES))), np.cumsum(out, axis=0, dtype=np.float64)])
    ends = np.cumsum(lens - ORDER + 1)
    return cum[ends] - cum[np.r_[0, ends[:-1]]]


def threshold(m: Model, lang: int, said: list[list[str]]) -> float:
    """Cross-entropy of rejection: what KEEP of the held-out segments stay under with MISREAD of their characters misread."""
    if len(said) < LEAST:
        return REJECT
    rng = random.Random(0)
    letters = sorted({c for x in said for w in x for c in w})
    noisy = ["".join(rng.choice(letters) if rng.random() < MISREAD else c for c in w) for x in said for w in x]
    first = np.cumsum([0, *(len(x) for x in said[:-1])])
    return float(np.quantile(-np.add.reduceat(score(m, noisy)[:, lang], first) / np.add.reduceat([len(w) + 1 for w in noisy], first), KEEP))


_PLAIN: list = []


def tidy(text: str) -> str:
    """Look-alike letters and full-width forms as plain ones, nothing invisible; line breaks stay."""
    if not _ODD.search(text):
        return text
    if not _PLAIN:
        _PLAIN.append(lookalike.Rewriter(lookalike.classes({})))
    return "\n".join(_PLAIN[0](t) for t in text.split("\n"))


class Words:
    """Scores of words, kept per worker; forgotten when there are too many, which changes nothing but time."""

    def __init__(self, model: Model, most: int = 400_000) -> None:
        self.model, self.most = model, most
        self.reset()

    def reset(self) -> None:
        # 0 ends a sentence, 1 ends a text
        self.ids: dict[str, int] = {**{c: 0 for c in ".।?!|/\n"}, "\x01": 1}
        self.table = np.zeros((2, 6))

    def look(self, tokens: list[str]) -> np.ndarray:
        """Rows of (kind, characters, scores): kind 0 sentence end, 1 text end, 2 Latin, 3 Devanagari."""
        if len(self.ids) > self.most:
            self.reset()
        new = list({t for t in tokens if t not in self.ids})
        if new:
            s = score(self.model, new)
            kind = np.array([3.0 if "ऀ" <= w[0] <= "ॿ" else 2.0 for w in new])
            base = len(self.table)
            self.ids.update({w: base + i for i, w in enumerate(new)})
            self.table = np.vstack([self.table, np.column_stack([kind, [len(w) + 1 for w in new], s, np.zeros(len(new))])])
            self.table[0, 0], self.table[1, 0] = 0, 1
        ids = self.ids
        at = np.fromiter((ids[t] for t in tokens), np.int64, len(tokens))
        out = self.table[at]
        out[at == 1, 0] = 1
        return out


def unpointed(text: str) -> str:
    """The text, as long as before, with a blank for every point that ends no sentence."""
    return _POINT.sub(lambda m: m[0][:-1] + " ", text)


def judge(texts: list[str], words: Words, prior: list[int] | None = None, wrapped: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """For each text, which languages it has (n x 3 booleans) and the confidence in each.

    A segment is a stretch between sentence ends in one script; with `wrapped`, line breaks end none. Where
    no segment is a sentence, the text has the one language that fits it best, `prior` (index of a
    language, or -1) deciding what the models can't. Texts without a letter have none.
    """
    n, k = len(texts), len(LANGUAGES)
    has, conf = np.zeros((n, k), bool), np.zeros((n, k))
    if not n:
        return has, conf
    plain = [unpointed(tidy(t)) for t in texts]
    whole = "\x01".join([(t.replace("\n", " ") if wrapped else t).replace("\x01", " ") for t in plain]) + "\x01"
    tokens = _TOKEN.findall(whole)
    r = words.look(tokens)
    kind = r[:, 0]
    text = np.cumsum(kind == 1) - (kind == 1)
    word = kind >= 2
    w, t, kd, s, ch = r[word], text[word], kind[word], r[word][:, 2 : 2 + k], r[word][:, 1]
    if not len(w):
        return has, conf
    at = np.flatnonzero(word)
    new = np.r_[True, (np.diff(at) > 1) | (np.diff(kd) != 0)]
    first = np.flatnonzero(new)
    size = np.diff(np.r_[first, len(w)])
    total = np.add.reduceat(s, first, axis=0)
    chars = np.add.reduceat(ch, first)
    seg_t, seg_k = t[first], kd[first]
    deva = seg_k == 3
    total[deva, 2] = -1e9  # a script rules a language out
    total[~deva, :2] = -1e9
    best = np.argmax(total, axis=1)
    top = total[np.arange(len(total)), best]
    rest = total.copy()
    rest[np.arange(len(total)), best] = -np.inf
    lead = np.minimum(top - rest.max(axis=1), 1e6)
    limit = words.model.limit[best]
    fits = -top / np.maximum(1, chars) <= REJECT  # the fitted thresholds speak in the confidence, so that no language of a badly read text is lost
    sentence = (size >= SENTENCE) & (lead >= MARGIN) & fits
    np.logical_or.at(has, (seg_t[sentence], best[sentence]), True)
    # a change between the two languages of one script inside a segment
    d = np.clip(s[:, 0] - s[:, 1], -10, 10)  # so that it takes several words
    c = np.cumsum(d)
    start = c[first] - d[first]
    part = c - np.repeat(start, size)
    # the largest rise is a Marathi stretch, the largest fall a Hindi one, wherever they lie
    apart = np.repeat(np.arange(len(first)) * (1.0 + 2 * np.abs(part).max()), size)
    low = np.minimum(np.minimum.accumulate(part - apart) + apart, 0)
    high = np.maximum(np.maximum.accumulate(part + apart) - apart, 0)
    rise, fall = np.maximum.reduceat(part - low, first), np.maximum.reduceat(high - part, first)
    turn = (rise >= CHANGE) & (fall >= CHANGE)
    two = deva & turn & (size >= 2 * SENTENCE) & fits
    for x in (0, 1):
        has[seg_t[two], x] = True
    # what all segments say together
    sums = np.zeros((n, k))
    near = np.zeros((n, 2))
    np.add.at(sums[:, 2], seg_t[~deva], chars[~deva])
    np.add.at(sums[:, 0], seg_t[deva], chars[deva])
    np.add.at(near, seg_t[deva], total[deva][:, :2])
    odds = near[:, 0] - near[:, 1]
    if prior is not None:
        p = np.asarray(prior)
        odds = odds + np.where(p == 0, MARGIN, np.where(p == 1, -MARGIN, 0.0))
    none = ~has.any(axis=1)
    # single foreign words and file marks are no language: Latin must be by far the larger, or expected
    latin = sums[:, 2] > 3 * sums[:, 0]
    if prior is not None:
        latin |= (p == 2) & (sums[:, 2] > sums[:, 0])
    some = (sums[:, 0] + sums[:, 2]) > 0
    has[none & some & latin, 2] = True
    has[none & some & ~latin & (odds >= 0), 0] = True
    has[none & some & ~latin & (odds < 0), 1] = True
    sure = 1 / (1 + np.exp(-np.minimum(30, np.abs(odds) / 2)))
    # how much likelier each script's text is than at the threshold of rejection: 0.5 there, less beyond
    over = np.zeros((n, 2))
    np.add.at(over, (seg_t, np.where(deva, 0, 1)), top + limit * chars)
    in_any = 1 / (1 + np.exp(-np.clip(over / 2, -30, 30)))
    both = has[:, 0] & has[:, 1]
    conf[:, 0] = conf[:, 1] = np.where(both, 0.95, sure) * in_any[:, 0]
    conf[:, 2] = in_any[:, 1]
    return has, np.round(np.where(has, conf, 0.0), 4)


def spans(text: str | None, words: Words, wrapped: bool = False) -> list[tuple[int, int, str, float]]:
    """(start, end, language, confidence) of the segments of one text, neighbours of one language joined. Offsets count code points of the text as given."""
    if not text:
        return []
    out: list[list] = []
    piece = re.compile(r"[^.।?!|/\x01]+[.।?!|/]*" if wrapped else r"[^.।?!|/\n\x01]+[.।?!|/\n]*")
    runs: list[tuple[int, int]] = []
    for m in piece.finditer(unpointed(text)):
        at, last = m.start(), None
        for x in re.finditer("[A-Za-zÀ-ɏ]+|[ऀ-ॣॱ-ॿ]+", m[0]):
            k = "ऀ" <= x[0][0] <= "ॿ"
            if last is not None and k != last:
                runs.append((at, m.start() + x.start()))
                at = m.start() + x.start()
            last = k
        runs.append((at, m.end()))
    has, conf = judge([text[a:b] for a, b in runs], words, wrapped=wrapped)
    for (a, b), h, c in zip(runs, has, conf):
        if h.any():
            k = int(np.argmax(np.where(h, c, -1)))
            if out and out[-1][2] == LANGUAGES[k]:
                out[-1][1], out[-1][3] = b, max(out[-1][3], float(c[k]))
            else:
                out.append([a, b, LANGUAGES[k], float(c[k])])
    return [tuple(x) for x in out]


def models(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Models fitted on at most `sample` documents with a clean label per language, chosen by a hash of their id.

    Labels are partly wrong: sentences that another language's first model fits better are dropped, and
    the models fitted again. The first models leave out every HELD-th document, whose sentences fit the
    thresholds of rejection.
    """
    clean = docs.filter(F.col("lang").isin(*LANGUAGES) & F.col("text").isNotNull())
    size = {r.lang: r.n for r in clean.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    some = None  # one pass for all: by hash a little more than enough, then exactly `sample`
    for k, n in size.items():
        own = (F.col("lang") == k) & (at < int((1 << 40) * min(1.0, 1.2 * sample / n)))
        some = own if some is None else some | own
    rows = clean.filter(some & ~F.col("text").rlike(encoding.SUSPICIOUS)).select("lang", at.alias("at"), "text").collect() if size else []
    texts = {k: [r.text for r in sorted((r for r in rows if r.lang == k), key=lambda r: r.at)[:sample]] for k in LANGUAGES}
    said = {k: [(i, [w for w in _TOKEN.findall(x) if len(w) > 1 or w.isalpha()]) for i, t in enumerate(v) for x in re.split("[.।?!\n]", t)] for k, v in texts.items()}
    held = {k: HELD if sum(i % HELD == HELD - 1 and len(x) >= SENTENCE for i, x in v) >= LEAST else len(v) + 1 for k, v in said.items()}
    first = {k: Counter(w for i, x in v if i % held[k] != held[k] - 1 for w in x) for k, v in said.items()}
    words = Words(fit(first))
    kept: dict[str, Counter] = {}
    limit = np.full(len(LANGUAGES), REJECT)
    for i, k in enumerate(LANGUAGES):
        kept[k] = Counter()
        flat = [w for _, x in said[k] for w in x]
        if not flat:
            continue
        r = words.look(flat)
        s, own = r[:, 2:5], r[:, 0] == (2 if k == "en" else 3)
        at, apart = 0, []
        for j, x in said[k]:
            here = slice(at, at + len(x))
            if x and s[here].sum(axis=0).argmax() == i:
                kept[k].update(x)
                if j % held[k] == held[k] - 1 and own[here].sum() >= SENTENCE:
                    apart.append([w for w, o in zip(x, own[here]) if o])
            at += len(x)
        limit[i] = threshold(words.model, i, apart)
    model = fit(kept)
    model.limit = limit
    return model


#: Spellings of the right label, after trimming and lower-casing, cut at "-" or "_".
LABELS = {"mr": "mr", "mar": "mr", "marathi": "mr", "hi": "hi", "hin": "hi", "hindi": "hi", "en": "en", "eng": "en", "english": "en"}
SCRIPTS = {"deva": ("mr", "hi"), "devanagari": ("mr", "hi"), "latin": ("en",), "latn": ("en",)}


def label(raw: Column) -> Column:
    """A label trimmed, lower-cased and without a region."""
    return F.regexp_replace(F.lower(F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")), r"[-_].*$", "")


def identified(rows: DataFrame, model: Model) -> DataFrame:
    """`rows` (table_name, rec_id, label, text, prior, wrapped) with languages and confidence, without the text.

    Null and blank texts, and texts without a letter, have no language. `case` says that the label is
    missing, wrong, or the text mixes languages. `prior` may be null.
    """
    fits = {**{k: (v,) for k, v in LABELS.items()}, **SCRIPTS}
    shape = "table_name string, rec_id long, languages array<string>, confidence array<double>, case boolean"
    sent = rows.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words(sent.value)
        for b in batches:
            texts = [t or "" for t in b.text]
            has = np.zeros((len(b), len(LANGUAGES)), bool)
            conf = np.zeros((len(b), len(LANGUAGES)))
            for flag in (False, True):
                at = np.flatnonzero(b.wrapped.to_numpy(dtype=bool) == flag)
                # so many characters at once, a longer text alone and whole: tokens take far more room than text
                ends = np.cumsum([len(texts[i]) for i in at]) // AT_ONCE
                for part in np.split(at, np.flatnonzero(np.diff(ends)) + 1) if len(at) else []:
                    prior = [LANGUAGES.index(p) if p in LANGUAGES else -1 for p in b.prior.iloc[part]]
                    has[part], conf[part] = judge([texts[i] for i in part], words, prior, flag)
            langs = [[LANGUAGES[k] for k in np.flatnonzero(h)] for h in has]
            case = [len(x) > 1 or len(x) == 1 and x[0] not in fits.get(lab or "", ()) for x, lab in zip(langs, b.label)]
            yield pd.DataFrame({"table_name": b.table_name, "rec_id": b.rec_id, "languages": langs, "confidence": [[float(v) for v in c[h]] for c, h in zip(conf, has)], "case": case})

    return rows.select("table_name", "rec_id", label(F.col("label")).alias("label"), "text", "prior", "wrapped").mapInPandas(run, shape)


def segments(rows: DataFrame, model: Model) -> DataFrame:
    """(table_name, rec_id, segment, from_char, to_char, language, confidence) for every segment of every record."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words(sent.value)
        for b in batches:
            out = [(n, i, k, *s) for n, i, t, w in zip(b.table_name, b.rec_id, b.text, b.wrapped) for k, s in enumerate(spans(t, words, bool(w)))]
            if out:
                yield pd.DataFrame(out, columns=["table_name", "rec_id", "segment", "from_char", "to_char", "language", "confidence"])

    return rows.select("table_name", "rec_id", "text", "wrapped").mapInPandas(run, "table_name string, rec_id long, segment int, from_char int, to_char int, language string, confidence double")
