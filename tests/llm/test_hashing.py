"""Regular text that makes polynomial hashes collide must not be taken for equal text."""

import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tessera.llm import hashing, near_dedup, suffix_array, suffix_tree, token_files, words
from tests.llm.test_repeats import check_bytes, check_words


def thue_morse(n, a="a", b="b"):
    return "".join(b if i.bit_count() & 1 else a for i in range(n))


PAIRS = [(thue_morse(n), thue_morse(n, "b", "a")) for n in (1024, 2048)]


def test_strings_and_spans_tell_regular_text_apart():
    for one, two in PAIRS:
        sym = [np.frombuffer(t.encode(), np.uint8).astype(np.uint64) for t in (one, two)]
        assert hashing.strings(sym[0], len(one)) != hashing.strings(sym[1], len(two))
        data = np.frombuffer((one + two + one).encode(), np.uint8)
        at = np.array([0, len(one), 2 * len(one)])
        for h in hashing.spans(data, at, at + len(one), 2):
            assert h[0] != h[1] and h[0] == h[2]
    r = np.random.default_rng(5)
    data = r.integers(97, 99, 5000).astype(np.uint8)  # few letters, so many equal spans
    start = r.integers(0, 4000, 3000)
    stop = start + np.where(r.random(3000) < 0.1, r.integers(200, 900, 3000), r.integers(1, 9, 3000))
    one, two = hashing.spans(data, start, stop, 2, chunk=700)
    texts = [data[i:j].tobytes() for i, j in zip(start, stop)]
    assert len({*zip(texts, one, two)}) == len(set(texts)) == len(set(one)) == len(set(two))
    assert (hashing.spans(data, start, stop)[0] == one).all()
    sym = hashing.mixed(r.integers(0, 3, 400).astype(np.uint64))
    for k in (1, 2, 3, 5, 24, 50):
        h = hashing.strings(sym, k)
        assert len(h) == 400 - k + 1 and len(set(h)) == len({tuple(sym[i : i + k]) for i in range(len(h))})
    assert len(hashing.strings(sym[:3], 5)) == 0


@pytest.mark.parametrize("parts", [1, 4])
def test_documents_of_regular_words_are_not_linked(spark, parts):
    texts = [t for pair in PAIRS for t in pair] + [f"{a} {b} {a}" for a, b in PAIRS] + [f"{b} {a} {b}" for a, b in PAIRS]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
    assert all(r.kept for r in near_dedup.components(d, 3, 85).collect())


@pytest.mark.parametrize("parts", [1, 4])
def test_regular_text_is_not_removed(spark, parts):
    texts = []
    for one, two in PAIRS:
        texts += [one, two, f"start {one} middle {two} end", f"begin {two} middle {one} stop"]
        texts += [" ".join(one), " ".join(two), one + two + one, two + one + two]
    pairs = list(enumerate(texts))
    d = spark.createDataFrame(pairs, "doc_id long, text string").repartition(parts)
    check_words(suffix_tree.deduplicated(d).collect(), pairs, 50)
    check_bytes(suffix_array.deduplicated(d).collect(), pairs, 50)


@pytest.mark.parametrize("parts", [1, 4])
def test_token_ids_of_regular_words(spark, parts):
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = [t for pair in PAIRS for t in (*pair, " ".join(pair), "Is " + ", ".join(pair) + ".")]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
    got = {r.doc_id: r for r in token_files.written(d, P.path("word_bpe_49k.json"), 2).collect()}
    for i, t in enumerate(texts):
        assert got[i].ids_crc32 == zlib.crc32(np.array(tok.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes()), i


def test_a_cached_word_of_the_same_number_is_seen(monkeypatch):
    """Words of one number, in one batch or in two, are encoded by the library."""
    real = words.spans
    monkeypatch.setattr(words, "spans", lambda data, start, stop, count=1: [np.zeros(len(start), np.uint64), *real(data, start, stop, 2)[1:]][:count])
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    encoder = token_files.Encoder(P.path("word_bpe_49k.json"))
    for texts in (["hello hello"], ["world"], ["one two three", "four"], ["hello"]):
        ids, ends = encoder.encode(texts)
        assert [ids[i:j].tolist() for i, j in zip(ends[:-1], ends[1:])] == [tok.encode(t, add_special_tokens=False).ids for t in texts]



def test_even_keys_take_a_partition_each(spark):
    for n in (1, 2, 16, 100, 4096):
        keys = hashing.even_keys(n).tolist()
        parts = spark.createDataFrame([(k,) for k in keys], "k int").selectExpr(f"pmod(hash(k), {n}) as p").collect()
        assert sorted(r.p for r in parts) == list(range(n))
