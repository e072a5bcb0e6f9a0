import hashlib
import random
import re

import numpy as np
import pytest

from tessera.llm import components, knn, line_dedup, lsh, near_dedup
from tessera.llm.hashing import distinct
from tests.llm.fixtures import TEXTS, empty

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_set(t, width):
    w = WORDS((t or "").translate(LOW))
    return {tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set()


def groups(sets, percent):
    """Component of each index by all pairs."""
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if same and 100 * same >= percent * (len(sets[i]) + len(sets[j]) - same):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(sets))]


def copies(seed, n=14):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgé") for _ in range(r.randint(2, 6))) for _ in range(400)]
    out = []
    for size in (3, 7, 12, 40, 150, 400):
        base = [r.choice(vocabulary) for _ in range(size)]
        for i in range(n):
            words = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, max(1, size // 40), max(1, size // 25)])):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            base = words if i % 3 == 0 else base  # drifting, so that far members hang together by others
            out.append(" ".join(words).upper() if i % 5 == 0 else " ".join(words))
    r.shuffle(out)
    return out


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_documents_against_all_pairs(spark, width, percent):
    texts = copies(1) + TEXTS + ["one two", "ONE two", "one"]
    d = spark.createDataFrame([(i, t, 2, "x") for i, t in enumerate(texts)], "doc_id long, text string, version int, e string").repartition(5)
    got = {r.doc_id: r for r in near_dedup.components(d, width, percent).collect()}
    want = groups([word_set(t, width) for t in texts], percent)
    for i, t in enumerate(texts):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(word_set(t, width)), want[i], want[i] == i), i


def test_documents_odd_rows(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "e f g h"), (None, "a b c d"), (None, None), (2, "e f g h"), (3, ""), (9, "q")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in near_dedup.components(d).drop("version").filter("doc_id is not null").collect())
    assert [(r[0], r[2], r[3]) for r in got] == [(1, 1, True)] * 3 + [(2, 1, False), (3, 3, True), (9, 9, True)]
    assert near_dedup.components(d).filter("doc_id is null and kept").count() == 2
    assert near_dedup.components(empty(spark)).count() == 0


def test_links_that_no_star_meets(spark, monkeypatch):
    """Bands whose hub is far from all others, and blocks smaller than the cluster."""
    texts = list({frozenset(word_set(t, 3)): t for t in copies(5, 20)}.values())  # copies are the caller's to join
    sets = near_dedup.sets(3, 85)
    wide = lsh.Sets(sets.keys, sets.loose, sets.percent, 1, 8)  # one place a band: large, loose buckets
    elements = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc long, nr int, text string")
    texts_of = lambda nodes: elements.join(nodes, ["doc", "nr"], "left_semi")
    monkeypatch.setattr(lsh, "BLOCK", 3)
    monkeypatch.setattr(lsh, "OTHERS", 5)
    star = lsh.met(lsh.requests(elements, wide, 4), 16).select(*lsh.A, *lsh.B).distinct()
    got = {r.doc: r.root.doc for r in lsh.linked(star, wide, texts_of).collect()}
    want = groups([word_set(t, 3) for t in texts], 85)
    small = [i for i, t in enumerate(texts) if len(word_set(t, 3)) > 30]  # few places, so small sets may share none
    assert {i: got.get(i, i) for i in small} == {i: want[i] for i in small}


def test_tags_of_64_bits(spark):
    """Different sets whose tags agree in one half are no copies, in a batch or in a bucket."""
    tags = np.array([5 << 32 | 1, 5 << 32 | 2, 6 << 32 | 1, 5 << 32 | 1], np.uint64)
    each = [lsh.stars(np.full((1, 1), 9, np.uint64), np.array([i]), np.array([0]), tags[i : i + 1], 4) for i in range(4)]
    whole = lsh.stars(np.full((4, 1), 9, np.uint64), np.arange(4), np.zeros(4, np.int64), tags, 4)
    for rows in ([r for x in each for r in x], list(whole)):
        asked = spark.createDataFrame([(r["kind"], r["bucket"], bytearray(r["data"])) for r in rows], lsh.SENT)
        assert {(r.a_doc, r.b_doc) for r in lsh.met(asked, 4).collect()} == {(0, 1), (0, 2)}


def test_one_stray_of_a_large_cluster():
    """A set apart from a component of 20,000 meets it in parts of bounded size, and one link is enough."""
    r = np.random.default_rng(3)
    common = distinct(r.integers(0, 2**62, 40).astype(np.uint64))
    many = [distinct(np.append(common, r.integers(0, 2**62, 2).astype(np.uint64))) for _ in range(20_000)]
    near = distinct(np.append(many[777][:-1], r.integers(0, 2**62, 1).astype(np.uint64)))  # shares one of the two with no other
    far = distinct(np.append(common[:20], r.integers(0, 2**62, 30).astype(np.uint64)))
    rows = many + [near, far]
    label = np.array([1] * 20_000 + [2, 3])
    rule = lsh.Sets(None, None, 93, 4, 24)
    found = lsh.cross_links(np.concatenate(rows), np.array([len(x) for x in rows]), label != 1, label, rule)
    want = {i for i, x in enumerate(many) if 100 * len(np.intersect1d(x, near)) >= 93 * len(np.union1d(x, near))}
    assert len(found) == 1 and found[0][1] == 20_000 and found[0][0] in want


def test_sketch_estimates_similarity():
    r = np.random.default_rng(0)
    keys = r.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = np.unique(keys[:2400]), np.unique(keys[600:])
    s = lsh.sketch(np.concatenate([a, b, a[:5]]), np.array([len(a), len(b), 5, 0]), 128)
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.15 and not s[3].any() and len(np.unique(s[2])) <= 5


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(50)] + [(100, x) for x in range(101, 130)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(40)] + [(7, 7)]
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    linked = {x for e in edges for x in e if e[0] != e[1]}
    table = spark.createDataFrame(edges, "a long, b long")
    for local in (10**6, 30):  # in one partition, and by stars between several
        assert {x.node: x.root for x in components.components(table, local).collect()} == {x: find(x) for x in linked}
    pairs = table.selectExpr("struct(a % 10 as doc, cast(a as int) as nr) as a", "struct(b % 10 as doc, cast(b as int) as nr) as b")
    least = {x: min((y % 10, y) for y in linked if find(y) == find(x)) for x in linked}
    assert {x.node.nr: tuple(x.root) for x in components.components(pairs).collect()} == least
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def char_set(line, width=8):
    return {line[i : i + width] for i in range(max(len(line) - width + 1, 1))}


def test_lines_against_all_pairs(spark):
    r = random.Random(3)
    pool = [t for t in copies(4, 6) if t] + ["All rights reserved.", "all rights reserved.", "ok", "ok", "x" * 3000, "日本語の行です、はい。", "日本語の行です、はい!"]
    texts = ["\n".join(r.choice([p, "  " + p + "\r", "", " "]) for p in r.choices(pool, k=r.randint(0, 6))) for _ in range(50)] + [None, "", "\n\n", pool[0]]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string, nr string, kept int").repartition(4)
    flat = [(i, n, x.strip(" \t\r\x0b\x0c")) for i, t in enumerate(texts) if t is not None for n, x in enumerate(t.split("\n")) if x.strip(" \t\r\x0b\x0c")]
    label = groups([char_set(x) for _, _, x in flat], 80)
    gone = {(i, n): flat[label[p]][0] for p, (i, n, _) in enumerate(flat) if label[p] != p}
    got = {x.doc_id: x for x in line_dedup.deduplicated(d).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        kept = "\n".join(x for n, x in enumerate((t or "").split("\n")) if (i, n) not in gone)
        mine = [k for k in gone if k[0] == i]
        assert got[i].n_removed == len(mine), i
        assert got[i].n_lines == sum(a == i for a, _, _ in flat)
        assert got[i].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
        assert got[i].kept_by == sorted({gone[k] for k in mine})


def test_lines_odd_rows(spark):
    rows = [(1, "same line here\nother words"), (1, "same line here\nother words"), (2, "a b\nsame line here"), (2, "same line here"), (None, "same line here"), (None, None)]
    got = line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 6
    assert sum(r.n_removed for r in got if r.doc_id is None) == 0
    assert line_dedup.deduplicated(empty(spark)).count() == 0


def brute_knn(rows, k):
    good = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, v in good:
        if q % 20:
            continue
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))[:k]
        out |= {(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)}
    return out


@pytest.mark.parametrize("block", [4096, 3])
def test_knn_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(knn, "BLOCK", block)
    monkeypatch.setattr(knn, "SAMPLE", 40)
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=8).round(2).tolist()) for i in range(200)] + [(i, [1.0] * 8) for i in range(200, 260)]
    rows += [(300, None), (301, []), (302, [1.0, None]), (303, [float("nan")] * 8), (None, [1.0] * 8), (304, [float("inf")] * 8), (320, [1.0, 2.0]), (321, [2.0, 1.0]), (340, [1.0, 2.0, 3.0]), (0, rows[0][1]), (7, [0.5] * 8)]
    d = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cell string")
    vectors = knn.integer_vectors(d, 64)
    got = [tuple(x) for x in knn.search(vectors, vectors.filter("vec_id % 20 = 0"), 5).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_knn(rows, 5)
    # many rows of a query's id, whose vector is a whole cell of its own
    rows = [(20, [9.0, 9.0])] * 40 + [(i, [0.1 * i, 0.2]) for i in range(1, 15)]
    vectors = knn.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 64)
    assert {tuple(x) for x in knn.search(vectors, vectors.filter("vec_id % 20 = 0"), 5).collect()} == brute_knn(rows[39:], 5)
    none = knn.integer_vectors(d.limit(0), 64)
    assert knn.search(none, none, 5).count() == 0


def test_every_two_of_a_cluster_meet_once(spark, monkeypatch):
    """One of them outside the largest component; moved rows grow slower than the square of a cluster."""
    monkeypatch.setattr(lsh, "BLOCK", 4)
    monkeypatch.setattr(lsh, "OTHERS", 6)
    monkeypatch.setattr(lsh, "LARGE", 64)
    node = "doc long, nr int, root struct<doc: long, nr: int>"
    moved = {}
    for n in (5, 30, 100, 400, 1600):
        root = {i: 0 if i % 4 == 0 else i - i % 3 for i in range(n)}  # the largest component, others of up to three, single ones
        clusters = spark.createDataFrame([(i, 0, (0, 0)) for i in range(n)], node)
        roots = spark.createDataFrame([(i, 0, (root[i], 0)) for i in range(n) if root[i] != i or i == 0], node)
        rows = lsh.meetings(clusters, roots).collect()
        moved[n] = len(rows)
        if n > 400:
            continue
        groups = {}
        for r in rows:
            groups.setdefault((r.block, r.part), []).append(r)
        met = [frozenset((a.doc, b.doc)) for (x, y), g in groups.items() for k, a in enumerate(g) for b in g[:k] if ((a.asks or b.asks) if x == y else a.asks != b.asks)]
        want = {frozenset((a, b)) for a in range(n) for b in range(a) if root[a] or root[b]}
        assert len(met) == len(set(met)) and set(met) == want
    assert moved[5] == 5
    assert moved[400] / moved[100] < 10 and moved[1600] / moved[400] < 10  # the square of 4 is 16, the power 1.5 is 8
