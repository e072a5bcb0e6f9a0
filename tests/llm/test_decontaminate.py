import hashlib
import random
import re
from collections import Counter

from tessera.llm import decontaminate
from tests.llm.fixtures import TEXTS, empty

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIND = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall


def words(t):
    return FIND((t or "").translate(str.maketrans(UP, LOW)))


def brute(docs, items, width=10):
    out = []
    wins = [(i, tuple(w[s : s + width])) for i, t in items if i is not None for w in [words(t)] if w for s in range(max(len(w) - width + 1, 1))]
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for i, win in wins:
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit.update(range(s, s + len(win)))
                    ids.add(str(i))
        out.append((d is None, d or 0, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_against_brute_force(spark):
    r = random.Random(4)
    vocabulary = ["the", "of", "And", "ÉLAN", "élan", "K9", "İx", *["".join(r.choice(LOW) for _ in range(4)) for _ in range(60)]]
    pick = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(pick(r.choice([1, 3, 9, 10, 11, 25])))) for i in range(12)] + [(12, "the the the the the the the the the the the the"), (13, None), (None, "alone"), (14, "--"), (2, "zzz yyy"), (15, "ÉLAN of the K9")]
    docs = []
    for i in range(40):
        w = pick(r.randint(0, 40))
        for _ in range(2):
            at = r.randint(0, len(w))
            w[at:at] = words(r.choice(items)[1])
        docs.append((i, r.choice([" ", ", ", "\n"]).join(w).upper() if i % 3 == 0 else " ".join(w)))
    docs += [(50, "the " * 40), (51, "zzz  YYY"), (3, docs[3][1]), (3, docs[4][1]), (None, docs[5][1]), (None, None), *enumerate(TEXTS, 60)]
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, window int, term string")
    b = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, doc_id int, n string")
    got = [(x.doc_id is None, x.doc_id or 0, x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in decontaminate.contamination(d, b).collect()]
    assert sorted(got) == brute(docs, items)


def test_near_terms(spark):
    """Places of a window's rarest term with its next rarest one at most nine words away, by brute force."""
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(30)] + ["the", "of"] * 8
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 2, 5, 12, 20])))) for i in range(10)]
    docs = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 80)))) for i in range(40)] + [(90, None), (91, "")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    freq = Counter(w for _, t in docs for w in words(t))
    pairs = set()
    for _, t in items:
        w = words(t)
        for s in range(max(len(w) - 9, 1)):
            best = sorted((freq[x], x, k) for k, x in enumerate(w[s : s + 10]))[:2]
            if len(best) == 2 and best[0][1] != best[1][1]:
                pairs.add((best[0][1], best[1][1]))
    want = {i: len({(p, a, z) for a, z in pairs for p, x in enumerate(words(t)) if x == a and z in words(t)[max(p - 9, 0) : p + 10]}) for i, t in docs}
    assert {x.doc_id: x.n_near for x in decontaminate.contamination(d, b).collect()} == want


def test_empty_tables(spark):
    b = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    d = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    assert decontaminate.contamination(empty(spark), b).count() == 0
    row = decontaminate.contamination(d, b.limit(0)).collect()[0]
    assert (row.n_words, row.n_hit, row.contaminated) == (3, 0, False)


def test_proximity(spark):
    d = spark.createDataFrame([(1, "alpha x x beta x x x alpha"), (2, "beta alpha"), (3, "alpha " + "x " * 9 + "beta")], "doc_id long, text string")
    terms = spark.createDataFrame([("alpha",), ("beta",)], "term string")
    index = decontaminate.postings(decontaminate.documents(d), terms, 0)
    pairs = spark.createDataFrame([("alpha", "beta")], "term_a string, term_b string")
    got = decontaminate.proximity_matches(index, pairs, 3).select("doc_id", "pos_a", "pos_b").collect()
    assert sorted(map(tuple, got)) == [(1, 1, 4), (2, 2, 1)]
