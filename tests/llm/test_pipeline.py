import hashlib

import corpus_pipeline
from tessera.llm import line_dedup
from tests.llm.test_decontaminate import words
from tests.llm.test_near import char_set, groups, word_set
from tests.llm.test_quality import brute_judged
from tests.llm.test_tokens import library

SPACE = " \t\r\x0b\x0c"


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_stages_against_brute_force(spark, sf):
    """Each stage on what its predecessor kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.saved(stage(spark, docs, sf), name)
        outs.append(docs)
    source = {r["doc_id"]: r for r in rows_of(spark.read.parquet(f"{sf}/documents.parquet"))}
    kept = brute_judged(spark, spark.read.parquet(f"{sf}/documents.parquet").collect(), spark.read.parquet(f"{sf}/labels.parquet"))
    first, second, third, fourth, last = map(rows_of, outs)
    assert {r["doc_id"]: r for r in first} == {i: r for i, r in source.items() if i in kept}

    flat = [(r["doc_id"], n, x.strip(SPACE)) for r in sorted(first, key=lambda r: r["doc_id"]) for n, x in enumerate(r["text"].split("\n")) if x.strip(SPACE)]
    label = groups([char_set(x, line_dedup.WIDTH) for _, _, x in flat], line_dedup.PERCENT)
    gone = {(i, n) for p, (i, n, _) in enumerate(flat) if label[p] != p}
    want = {}
    for r in first:
        lines = [(n, x) for n, x in enumerate(r["text"].split("\n")) if (r["doc_id"], n) not in gone]
        if any(x.strip(SPACE) for _, x in lines) or not r["text"].strip(SPACE + "\n"):
            text = "\n".join(x for _, x in lines)
            want[r["doc_id"]] = {**r, "text": text, "n_chars": len(text)}
    assert {r["doc_id"]: r for r in second} == want

    ordered = sorted(second, key=lambda r: r["doc_id"])
    root = groups([word_set(r["text"], 5) for r in ordered], 80)
    assert {r["doc_id"]: r for r in third} == {r["doc_id"]: r for i, r in enumerate(ordered) if root[i] == i}

    wins = set()
    for r in rows_of(spark.read.parquet(f"{sf}/benchmark.parquet")):
        w = words(r["text"])
        wins |= {tuple(w[s : s + 10]) for s in range(max(len(w) - 9, 1))} if w else set()
    sizes = {len(x) for x in wins}
    clean = {}
    for r in third:
        w = words(r["text"])
        if not any(tuple(w[s : s + n]) in wins for n in sizes for s in range(len(w) - n + 1)):
            clean[r["doc_id"]] = r
    assert {r["doc_id"]: r for r in fourth} == clean

    enc = library()
    assert len(last) == len(fourth)
    for r in last:
        text = clean[r["doc_id"]]["text"]
        assert r["ids"] == enc.encode_ordinary(text) and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_odd_rows(spark, sf):
    rows = [(1, "one line here\nanother", "en", None, 3), (1, "one line here\nanother", "en", None, 3), (1, "else", None, "s", 4), (None, "one line here", None, None, None), (None, None, None, None, None), (2, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for given in (docs, docs.limit(0)):
        out = given
        for name, stage in corpus_pipeline.STAGES:
            out = corpus_pipeline.saved(stage(spark, out, sf), name)
        assert out.count() <= given.count()
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    assert sorted((r.doc_id or 0, r.text) for r in stage(spark, docs.filter("text is not null and text <> ''"), sf).collect()) == [(0, "one line here"), (1, "else"), (1, "one line here\nanother")]
