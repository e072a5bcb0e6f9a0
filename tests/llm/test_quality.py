import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import hashing, quality
from tests.llm.fixtures import TEXTS, empty


SCORED = "doc_id long, version long, lang string, against string, text string"


def code(x):
    n = ord(x)
    if n < quality.OWN_CODES:
        return n + 1
    return quality.OWN_CODES + int(hashing.mixed(np.array([n], np.uint64))[0]) % (quality.SYMBOLS - 2 - quality.OWN_CODES) + 1


class Plain:
    """Interpolated modified Kneser-Ney by the book, with dictionaries."""

    def __init__(self, texts):
        n = quality.ORDER
        self.c = {n: Counter()}
        for t in texts:
            s = [0] * (n - 1) + [code(x) for x in t]
            self.c[n].update(tuple(s[i - n + 1 : i + 1]) for i in range(n - 1, len(s)))
        for i in range(n - 1, 0, -1):
            self.c[i] = Counter(g[1:] for g in self.c[i + 1])
        self.d, self.total, self.rest = {}, {}, {}
        for i, c in self.c.items():
            k = Counter(c.values())
            n1 = max(k[1], 1e-9)
            y = n1 / (n1 + 2 * k[2])
            self.d[i] = {}
            for j, own, more in ((1, n1, k[2]), (2, k[2], k[3]), (3, k[3], k[4])):
                self.d[i][j] = min(max(j - (j + 1) * y * more / own if own else 0.5, 0.05), j - 0.05)
            self.total[i], self.rest[i] = defaultdict(float), defaultdict(float)
            for g, x in c.items():
                self.total[i][g[:-1]] += x
                self.rest[i][g[:-1]] += self.d[i][min(x, 3)]

    def p(self, g):
        i = len(g)
        if not i:
            return 1 / quality.SYMBOLS
        below, h = self.p(g[1:]), g[:-1]
        if not self.total[i].get(h):
            return below
        x = self.c[i][g]
        return ((x - self.d[i][min(x, 3)] if x else 0) + self.rest[i][h] * below) / self.total[i][h]

    def perplexity(self, t):
        n = quality.ORDER
        s = [0] * (n - 1) + [code(x) for x in t]
        return math.exp(-sum(math.log(self.p(tuple(s[i - n + 1 : i + 1]))) for i in range(n - 1, len(s))) / len(t))


@pytest.mark.parametrize("block", [10**6, 3000])
def test_perplexity_by_the_book(spark, block):
    r = random.Random(1)
    words = ["the", "of", "and", "eraß", "日本", "x"]
    train = [("a", " ".join(r.choices(words, k=30))) for _ in range(20)] + [("b", "zz zy zz " * 5)]
    trained = quality.model(quality.counts(spark.createDataFrame(train, "lang string, text string")))
    docs = [(i, lang, t) for i, t in enumerate([t for t in TEXTS if len(t or "") < 9000] + ["the of 日本 q"]) for lang in ("a", "b", "*")]
    rows = [(i, 0, lang, quality.AGAINST + "*", t) for i, lang, t in [*docs, (None, "a", "the")]]
    got = quality.scored(spark.createDataFrame(rows, SCORED), trained, block).collect()
    plain = {lang: Plain([t for x, t in train if lang in (x, "*")]) for lang in ("a", "b", "*")}
    assert len(got) == len(docs) + 1
    value = {(x.doc_id, x.lang): x for x in got}
    for i, lang, t in docs:
        assert value[i, lang].n_chars == len(t or "")
        if t:
            assert value[i, lang].perplexity == pytest.approx(plain[lang].perplexity(t), rel=1e-5)
        else:
            assert value[i, lang].perplexity is None


def test_held_out_labels(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    # the labels of every other document train, the rest are the test
    half = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)) == 0
    out = quality.judged(d, labels.filter(half)).join(labels.filter(~half), "doc_id")
    rates = {r.quality: r.kept for r in out.filter("toxic = 0").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()}
    assert rates[1] > 0.95 and rates[0] < 0.45


def test_held_out_junk_and_toxic(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)) == 0
    out = quality.judged(d, labels.filter(half)).join(labels.filter(~half), "doc_id").join(d.select("doc_id", "text"), "doc_id")
    kept = F.avg(F.col("kept").cast("double"))
    assert out.filter("quality = 1 and toxic = 0").agg(kept).first()[0] > 0.97
    assert out.filter("quality = 0").agg(kept).first()[0] < 0.15  # 0.19 by perplexity alone
    assert out.filter("quality = 1 and toxic = 1").agg(kept).first()[0] < 0.6  # 0.98
    assert out.filter("quality = 0").filter(F.col("text").rlike(r"(?:^|\s)(\S+)(?: \1){4}")).agg(kept).first()[0] < 0.5  # one word again and again: 0.74


@pytest.mark.parametrize("block", [10**6, 100])
def test_contrast(spark, block):
    """The greatest log ratio of two models over a stretch, by the book."""
    r = random.Random(4)
    draw = lambda words, k: " ".join(r.choices(words, k=k))
    good, bad = [draw(["the", "of", "and"], 40) for _ in range(9)], [draw(["the", "vile", "of"], 40) for _ in range(9)]
    trained = quality.model(quality.counts(spark.createDataFrame([*[("a", t) for t in good], *[(quality.AGAINST + "a", t) for t in bad]], "lang string, text string")))
    texts = [good[0][:60] + " vile vile " + good[1][:40], "vile", "", None, good[2][:90]]
    docs = spark.createDataFrame([(i, 0, a, b, t) for i, t in enumerate(texts) for a, b in (("a", quality.AGAINST + "a"), ("*", quality.AGAINST + "*"))], SCORED)
    p, q = Plain(good), Plain(bad)
    for x in quality.scored(docs, trained, block).collect():
        t = texts[x.doc_id] or ""
        s = [0] * (quality.ORDER - 1) + [ord(c) + 1 for c in t]
        grams = [tuple(s[i : i + quality.ORDER]) for i in range(len(t))]
        ratio = [math.log(q.p(g) / p.p(g)) for g in grams]
        want = max(sum(ratio[i:j]) for i in range(len(t) + 1) for j in range(i, len(t) + 1))
        assert x.contrast == pytest.approx(want, rel=1e-5, abs=1e-5)


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, None, 0), (None, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    d = spark.createDataFrame([(1, "some text", "en"), (1, "other", None), (2, None, "en"), (3, "", "xx"), (None, "abc", "en")], "doc_id long, text string, lang string")
    got = quality.judged(d, labels).collect()
    assert len(got) == 5 and sum(not r.kept for r in got) == 2
    assert quality.judged(empty(spark), labels).count() == 0
    assert quality.judged(d, labels.limit(0)).filter("kept").count() == 3


def test_texts_of_wide_alphabets_have_their_own_perplexity(spark):
    texts = ["これは日本語の文章です。", "这是一段中文文本内容。", "이것은 한국어 문장입니다", "ეს არის ქართული ტექსტი"]
    trained = quality.model(quality.counts(spark.createDataFrame([("*", t * 3) for t in texts[:2]], "lang string, text string")))
    rows = [(i, 0, "*", quality.AGAINST + "*", t) for i, t in enumerate([*texts, "日日日日日日日日"])]
    got = {x.doc_id: x.perplexity for x in quality.scored(spark.createDataFrame(rows, SCORED), trained).collect()}
    assert len(set(got.values())) == 5 and max(got[0], got[1]) < min(got[2], got[3], got[4])


def test_one_exchange_of_the_texts(spark):
    """Both readings of a block share the exchange that deals the texts, and nothing of the model is broadcast."""
    trained = quality.model(quality.counts(spark.createDataFrame([("*", "some words here " * 9)], "lang string, text string")))
    rows = spark.createDataFrame([(i, 0, "*", quality.AGAINST + "*", f"words {i}") for i in range(50)], SCORED)
    out = quality.scored(rows, trained)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final and "Broadcast" not in final


def brute_edges(held, low, high, margin, lang):
    """The edges of one language by the docstring's words, from lists."""
    mine = [x for x in held if lang in (None, x[0])]
    least, most, far = 0.0, math.inf, math.inf if lang is None else None
    for kind, size in enumerate(quality.CELLS):
        cells = [(math.floor((math.log(x[1]) if kind == 0 else x[2]) * size), x[3]) for x in mine]
        good, bad = sorted(c for c, g in cells if g), sorted(c for c, g in cells if not g)
        if not good:
            continue
        mean = sum(good) / len(good)
        apart = quality.SPREAD * (1 + quality.FEW / len(good)) * math.sqrt(sum((c - mean) ** 2 for c in good) / len(good))
        every = sorted({c for c, _ in cells})

        def halfway(at, step):
            beyond = [c for c in bad if (c > at if step > 0 else c < at)]
            return (at + min((c for c in every if (c - at) * step > 0), key=lambda c: abs(c - at)) + 1) / 2 if beyond else None

        if kind == 0:
            i, j = (next(c for c in every if sum(g <= c for g in good) / len(good) >= x) for x in (low, high))
            least, most = math.exp(i / size) * (1 - margin), math.exp((j + 1) / size) * (1 + margin)
            if (under := halfway(i, -1)) is not None:
                least = max(least, math.exp(min(under, mean - apart) / size))
            if (over := halfway(j, 1)) is not None:
                most = min(most, math.exp(max(over, mean + apart) / size))
        elif lang is None or len(good) >= quality.LEAST_HELD:
            best = max(every, key=lambda c: (quality.LOST * sum(g <= c for g in good) - sum(b <= c for b in bad), -c))
            over = halfway(best, 1)
            middle = next(c for c in every if sum(g <= c for g in good) / len(good) >= 0.5)
            off = sorted(abs(c - middle) for c in good)
            sigma = 1.4826 * next(x for x in off if sum(y <= x for y in off) >= len(good) / 2)
            far = math.inf if over is None else max(over, middle + quality.SPREAD * (1 + quality.FEW / len(good)) * sigma) / size
    return least, most, far


def brute_judged(spark, docs, labels):
    """Ids that the classifier keeps, from dictionaries and lists. docs: rows (doc_id, lang, text), ids without repeats."""
    said = [(r.doc_id, r.quality == 1 and r.toxic == 0, r.quality == 0 or r.toxic == 1) for r in labels.collect()]
    labelled = {}
    for i, good, bad in said:
        g, b = labelled.get(i, (True, False))
        labelled[i] = (g and good, b or bad)
    labelled = {i: g for i, (g, b) in labelled.items() if (g or b) and i is not None}
    ids = spark.createDataFrame([(i,) for i in labelled], "doc_id long")
    fold = {r.doc_id for r in ids.filter(F.pmod(F.xxhash64("doc_id"), F.lit(quality.FOLDS)) != 0).collect()}
    text, lang = {r.doc_id: r.text or "" for r in docs}, {r.doc_id: r.lang for r in docs}
    own = [i for i in text if i in fold]
    times = Counter((lang[i], labelled[i]) for i in own if lang[i])
    known = {x for x, _ in times if times[x, True] >= quality.MIN_TRUSTED}
    contrasted = {x for x in known if times[x, False] >= quality.MIN_TRUSTED}
    models = {(None, g): Plain([text[i] for i in own if labelled[i] is g]) for g in (True, False)}
    models |= {(x, True): Plain([text[i] for i in own if labelled[i] and lang[i] == x]) for x in known}
    models |= {(x, False): Plain([text[i] for i in own if not labelled[i] and lang[i] == x]) for x in contrasted}
    seen: dict = {}

    def score(i):
        x = lang[i] if lang[i] in known else None
        p, q = models[x, True], models[x if x in contrasted else None, False]
        s = [0] * (quality.ORDER - 1) + [code(c) for c in text[i]]
        logs = []
        for k in range(len(text[i])):
            g = tuple(s[k : k + quality.ORDER])
            if (id(p), id(q), g) not in seen:
                seen[id(p), id(q), g] = (math.log(p.p(g)), math.log(q.p(g)))
            logs.append(seen[id(p), id(q), g])
        now = most = 0.0
        for a, b in logs:
            now = max(now + b - a, 0.0)
            most = max(most, now)
        return x, math.exp(-sum(a for a, _ in logs) / len(logs)), most

    scores = {i: score(i) for i in text if text[i]}
    held = [(*(scores[i][0] or quality.ALL, *scores[i][1:]), labelled[i]) for i in scores if i in labelled and i not in fold]
    edges = {x: brute_edges(held, 0.002, 0.998, 0.15, x) for x in {None, *(h[0] for h in held)}} if held else {}
    kept = set()
    for i, (x, perplexity, contrast) in scores.items():
        least, most, far = (a if a is not None else b for a, b in zip(edges.get(x or quality.ALL, (None,) * 3), edges.get(None, (0.0, math.inf, math.inf))))
        if least <= perplexity <= most and contrast <= far:
            kept.add(i)
    return kept


def test_edges_by_brute_force(spark):
    """Ties, repeated rows, languages with few or no trusted documents, any order."""
    r = random.Random(6)
    held = [("a", round(r.lognormvariate(2, 0.3), 1), round(r.gauss(-10, 5), 1), True) for _ in range(200)]
    held += [("a", round(r.lognormvariate(3, 0.8), 1), round(r.gauss(5, 9), 1), False) for _ in range(60)]
    held += [("b", 7.0, -3.0, True)] * 20 + [("b", 90.0, 30.0, False)] * 5 + [("c", 5.0, 1.0, True), ("c", 5.0, 1.0, False)] + [("d", 4.0, 2.0, False)] + held[:40]
    for seed in (1, 2):
        random.Random(seed).shuffle(held)
        d = spark.createDataFrame(held, "lang string, perplexity double, contrast double, good boolean").repartition(3)
        got = {x.lang: (x.least, x.most, x.far) for x in quality.edges(d, 0.002, 0.998, 0.15).collect()}
        assert set(got) == {None, "a", "b", "c", "d"}
        for lang, found in got.items():
            want = brute_edges(held, 0.002, 0.998, 0.15, lang)
            for x, y in zip(found, want):
                assert (x is None or math.isnan(x)) if y is None else x == pytest.approx(y), (lang, found, want)


def test_clashing_columns_and_a_bounded_sample(spark):
    r = random.Random(8)
    words = ["the", "of", "and", "to", "in", "is"]
    rows = [(i, " ".join(r.choices(words, k=25)) if i % 5 else "###$$$ " * 9, "en", "x", 1.0, i) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, version string, perplexity double, good long")
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0, "en", "x") for i in range(300)], "doc_id long, quality int, toxic int, lang string, text string")
    for training in (quality.TRAINING, 120):
        kept = {x.doc_id: x.kept for x in quality.judged(d, labels, training=training).collect()}
        assert sum(kept[i] == (i % 5 > 0) for i in range(400)) > 390


def test_every_labelled_document_of_the_training_folds_trains(spark, monkeypatch):
    class Seen(Exception):
        pass

    def counts(trusted, into=None):
        raise Seen({r["lang"]: r["count"] for r in trusted.groupBy("lang").count().collect()})

    monkeypatch.setattr(quality, "counts", counts)
    ids = spark.range(70_000).withColumnRenamed("id", "doc_id")
    labels = ids.selectExpr("doc_id", "cast(doc_id % 10 > 0 as int) as quality", "0 as toxic")
    with pytest.raises(Seen) as seen:
        quality.judged(ids.selectExpr("doc_id", "'some words' as text", "'en' as lang"), labels)
    taken = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(quality.FOLDS)) != 0)
    assert seen.value.args[0] == {"en": taken.filter("quality = 1").count(), quality.AGAINST + "en": taken.filter("quality = 0").count()}


def test_texts_travel_packed(spark, monkeypatch):
    """Each task sends a block's rows together, compressed, and they come back as they were."""
    monkeypatch.setattr(quality, "DEALT", 40_000)
    r = random.Random(9)
    words = ["".join(r.choices("abcdefgh", k=r.randint(2, 9))) for _ in range(300)]
    texts = [*TEXTS, *(" ".join(r.choices(words, k=150)) for _ in range(300))]
    rows = [(i % 7, i, "*", t) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "block int, doc_id long, lang string, text string").repartition(2)
    got = quality._packed(d).collect()
    assert sorted((*x, b) for b, data in got for x in [r[1:] for pdf in quality._rows([data]) for r in pdf.itertuples(index=False)]) == sorted(((i, lang, t, b) for b, i, lang, t in rows), key=lambda x: x[0])
    assert len(got) < len(rows) / 2 and sum(len(x.data) for x in got) < 0.5 * sum(len((t or "").encode()) for t in texts)
