"""Cases in which an operator differs from its nearest SQL form, and round trips."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import bits, codec
from tessera.functions import text as T
from tessera.operators import search, sequence, setops, stats, suffixes
from tessera.sources import lines, store
from tessera.streaming import pipeline


def values(spark, xs):
    return spark.createDataFrame([(x,) for x in xs], "v int")


def got(df):
    return sorted(r.v for r in df.collect())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_multiplicities(spark):
    a, b = values(spark, [1, 2, 2, 2, 3]), values(spark, [2, 2, 4])
    assert got(setops.intersect_left(a, b)) == [2, 2, 2]
    assert got(setops.intersect_right(a, b)) == [2, 2]
    assert got(setops.multiset_union(a, b)) == [1, 2, 2, 2, 2, 2, 3, 4]
    assert got(setops.multiset_difference(a, b)) == [1, 2, 3]
    assert got(setops.set_difference(a, b)) == [1, 2, 3]
    assert got(setops.kway_intersection([a, b, values(spark, [2, 2, 2])])) == [2, 2]
    assert got(setops.kway_intersection([a, b], multiset=False)) == [2]
    assert setops.intersect_count(a, b).first().n == 1
    empty = values(spark, [])
    assert got(setops.intersect_left(a, empty)) == [] and got(setops.set_union(a, empty)) == [1, 2, 3]


def test_percentile_is_of_the_floor(spark):
    h = stats.histogram(values(spark, [1, 2, 3]), F.col("v"))
    assert {r.p: r.key for r in stats.percentiles(h, [0.0, 0.5, 1.0, 1.5]).collect()} == {0.0: 1, 0.5: 1, 1.0: 3}
    assert stats.jaccard(values(spark, []), values(spark, [])).first().jaccard == 1.0
    assert stats.accumulate(values(spark, []), F.col("v")).first().variance == 0.0


@pytest.mark.parametrize("block", [2, 1 << 16])
def test_rank_and_select(spark, monkeypatch, block):
    monkeypatch.setattr(sequence, "BLOCK", block)
    pattern = [0, 1, 1, 0, 1, 0, 0, 1]
    d = spark.createDataFrame(list(enumerate(pattern)), "pos long, bit int")
    assert {r.pos: r.rank1 for r in sequence.rank1(d).collect()} == {i: sum(pattern[:i]) for i in range(8)}
    assert sorted((r.k, r.pos) for r in sequence.select1(d).collect()) == [(0, 1), (1, 2), (2, 4), (3, 7)]


def test_next_geq(spark):
    lists = spark.createDataFrame([("a", 3), ("a", 7), ("a", 9), ("b", 1)], "g string, v int")
    probes = spark.createDataFrame([("a", 3), ("a", 4), ("a", 10), ("b", 0), ("c", 1)], "g string, target int")
    out = {(r.g, r.target): (r.idx, r.next) for r in sequence.next_geq(lists, probes, ["g"]).collect()}
    assert out == {("a", 3): (0, 3), ("a", 4): (1, 7), ("a", 10): (None, None), ("b", 0): (0, 1), ("c", 1): (None, None)}


def test_lookups_ahead_take_linear_time(spark):
    """A frame that ends with its group is made anew for every row: the time was the square of a range's rows."""
    rng = random.Random(1)
    keys, asked = sorted(rng.sample(range(9000), 2000)), rng.sample(range(-5, 9005), 2000)
    bounds = sequence.lower_bound(values(spark, keys * 2), spark.createDataFrame([(x,) for x in asked], "target int"), "v")
    ahead = lambda x: min((k for k in keys if k >= x), default=None)
    assert sorted(map(tuple, bounds.collect()), key=str) == sorted(((x, ahead(x), ahead(x + 1)) for x in asked), key=str)
    lists = spark.createDataFrame([("a", 3), ("a", 7), ("a", 7)], "g string, v int")
    found = sequence.next_geq(lists, spark.createDataFrame([("a", 5)], "g string, target int"), ["g"])
    assert tuple(found.first()) == ("a", 5, 1, 7)
    for df in (bounds, found):
        assert "unboundedfollowing" not in df._jdf.queryExecution().toString()


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, T.words(lit("café a_b c-d"))) == ["caf", "a_b", "c", "d"]
    assert one(spark, T.boundaries(lit("ab c"))) == [0, 2, 3, 4] and one(spark, T.boundaries(lit(""))) == [0]
    assert one(spark, T.find(lit("éab"), "b")) == 3 and one(spark, T.find(lit("x"), "y")) is None and one(spark, T.find(lit("x"), "")) == 0
    assert one(spark, T.find_all(lit("aaa"), "aa")) == [0, 1]
    assert one(spark, T.split_drop(lit("a,"), ",")) == ["a"] and one(spark, T.split_drop(lit(""), ",")) == [] and one(spark, T.split_keep(lit("a,"), ",")) == ["a", ""]
    for p, t, want in (("a*c", "abbc", True), ("a?c", "ac", False), ("*%*", "50%", True), ("a", "ab", False), ("a_", "ab", False)):
        assert one(spark, T.wildcard(lit(t), p)) is want
    order = ["-100", "-10", "-9", "-0", "0", "5", "42", "99", "100", "123456789012345678901234567890"]
    keys = [one(spark, T.integer_key(lit(x))) for x in order]
    assert keys == sorted(keys) and one(spark, T.integer_key(lit("abc"))) is None and one(spark, T.integer_key(lit("007"))) == one(spark, T.integer_key(lit("7")))
    reals = ["-10", "-9.99", "-1.5", "2.71", "3.14", "9.99", "10"]
    keys = [one(spark, T.real_key(lit(x))) for x in reals]
    assert keys == sorted(keys) and one(spark, T.real_key(lit("1.2.3"))) is None
    assert one(spark, T.unhex_strict(lit("abc"))) is None and one(spark, T.unhex_strict(lit("zz"))) is None
    assert one(spark, T.common_prefix(lit("abcx"), lit("abdx"))) == "ab"
    assert one(spark, T.display_width(lit("a日\t"))) == 3


def test_bytes_not_characters_are_edited(spark):
    assert one(spark, search.byte_distance(F.lit("é"), F.lit("e"), 5)) == 2
    assert one(spark, search.byte_distance(F.lit("abcdef"), F.lit("uvwxyz"), 2)) == -1


def test_fuzzy_join_finds_all(spark):
    r = random.Random(1)
    a = sorted({"".join(r.choice("abé") for _ in range(r.randint(0, 7))) for _ in range(60)})
    d = spark.createDataFrame([(x,) for x in a], "a string")

    def distance(x, y):
        x, y = x.encode(), y.encode()
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            row, last = [i], row
            for j, e in enumerate(y, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != e)))
        return row[-1]

    for limit in (0, 1, 2):
        out = {(x.a, x.b) for x in search.fuzzy_join(d, d.withColumnRenamed("a", "b"), "a", "b", limit).collect()}
        assert out == {(x, y) for x in a for y in a if distance(x, y) <= limit}


def test_multi_pattern_both_ways(spark):
    t = spark.createDataFrame([(1, "abcabc"), (2, "日本日本"), (3, None), (4, "")], "k long, text string")
    e = spark.createDataFrame([("abc",), ("bc",), ("日本",), ("",), ("zz",)], "entry string")
    want = sorted([(1, 0, "abc"), (1, 3, "abc"), (1, 1, "bc"), (1, 4, "bc"), (2, 0, "日本"), (2, 2, "日本")])
    for limit in (100, 1):
        assert sorted(tuple(r) for r in search.multi_pattern(t, e, "k", limit=limit).collect()) == want


def test_multi_pattern_holds_few_rows(spark, monkeypatch):
    """Matches leave as they are found, not when a whole Arrow batch is through; and all of them do."""
    monkeypatch.setattr(search, "HELD", 10)
    monkeypatch.setattr(search, "TEXTS", 2)
    texts = spark.createDataFrame([(i, "ab" * i) for i in range(9)] + [(9, None)], "k long, text string").coalesce(1)
    entries = spark.createDataFrame([("ab",), ("b",)], "entry string")
    rows = search.multi_pattern(texts, entries, "k")
    want = sorted((i, 2 * j + p, e) for i in range(9) for j in range(i) for p, e in ((0, "ab"), (1, "b")))
    assert sorted(map(tuple, rows.collect())) == want

    class Texts:
        select = lambda self, *columns: self
        mapInArrow = lambda self, run, schema: run

    run = search._over_texts(Texts(), "k", "t", lambda t: ((x,) for x in t), "k long, x string", [pa.string()])
    batch = pa.RecordBatch.from_pydict({"k": [1, 2, 3], "t": ["a" * 25, None, "bc"]})
    assert [b.num_rows for b in run(iter([batch]))] == [10, 10, 7]
    counts = search.multi_pattern_counts(texts, entries, "k").collect()
    assert sorted(map(tuple, counts)) == sorted((i, e, i, p) for i in range(1, 9) for p, e in ((0, "ab"), (1, "b")))


def test_fieldnorm(spark):
    d = spark.range(0, 5000).select(F.col("id").alias("n"), bits.fieldnorm_encode(F.col("id")).alias("c"))
    rows = d.withColumn("low", bits.fieldnorm_decode(F.col("c"))).orderBy("n").collect()
    assert all(r.low == r.n for r in rows[:16]) and all(r.low <= r.n for r in rows)
    assert [r.c for r in rows] == sorted(r.c for r in rows) and rows[-1].c < 256


def test_codecs(spark):
    assert codec.crc32c_of([b"123456789", b"", b"abc", b"123456789" * 40])[[0, 1]].tolist() == [0xE3069283, 0]
    each = [b"x" * n for n in (5, 0, 300, 5)]
    assert codec.crc32c_of(each).tolist() == [int(codec.crc32c_of([x])[0]) for x in each]
    r = random.Random(3)
    datas = [b"", b"a", b"aaaa" * 500, bytes(r.randrange(256) for _ in range(3000)), b"abracadabra" * 90, bytes(range(256))]
    for data in datas:
        assert codec.huffman_data(codec.huffman_bytes(data)) == data
        assert codec.rans_data(codec.rans_bytes(data)) == data
        assert codec.fse_data(codec.fse_bytes(data)) == data
    numbers = [0, 1, 127, 128, 300, 2**31, 2**32 - 1]
    assert codec.varint_values(codec.varint_bytes(numbers)) == numbers and codec.streamvbyte_values(codec.streamvbyte_bytes(numbers)) == numbers
    with pytest.raises(ValueError):
        codec.varint_values(b"\x80")
    d = spark.createDataFrame([(bytearray(x),) for x in datas] + [(None,)], "x binary")
    signed = [0, -1, 1, 5, -(2**40), 2**62, -(2**62)]
    for name, (pack, read) in codec.INTEGER_FORMS.items():
        for values in ([], [7], numbers, numbers[::-1], [3] * 9):
            assert read(pack(values)) == values, name
    for name in ("zigzag", "delta", "bit_packed"):
        pack, read = codec.INTEGER_FORMS[name]
        assert read(pack(signed)) == signed
    for pack, read in (codec.INTEGER_FORMS[n] for n in ("group", "prefix_free", "bit_packed", "streamvbyte")):
        with pytest.raises((ValueError, IndexError)):
            read(pack(numbers)[:-1])
    words = b"the quick brown fox jumps over the lazy dog " * 3
    for data in [*datas, b"the lazy fox jumps over", words + b"!" + words]:
        coded = codec.match_stream_bytes(suffixes.Dictionary(words), data)
        assert codec.match_stream_data(words, coded) == data
    assert len(codec.match_stream_bytes(suffixes.Dictionary(words), words * 5)) < len(words)
    with pytest.raises(ValueError):
        codec.match_stream_data(words, codec.varint_bytes([3, 1]) + b"x")
    for c in codec.BYTE_FORMS:
        assert [r.y for r in d.select(codec.decode(codec.encode(F.col("x"), c), c).alias("y")).collect()] == [*map(bytearray, datas), None]


@pytest.mark.parametrize("form", ["fse", "huffman_o1", "huffman_o2"])
def test_tables_of_short_texts_are_made_at_once(form):
    """Calls grow with the bytes, not with 4,096 states or 256 code lengths of every context."""
    import cProfile
    import pstats

    data = b"a short text, and its contexts"
    encode, decode = (make() for make in codec.BYTE_FORMS[form])
    with cProfile.Profile() as p:
        assert decode(encode(data)) == data
    assert pstats.Stats(p).total_calls < 100 * len(data)


def test_coded_bytes_are_as_before():
    import hashlib

    data = bytes(i * i % 251 for i in range(3000)) + b"aaab" * 50
    sha = {f: hashlib.sha256(codec.BYTE_FORMS[f][0]()(data)).hexdigest()[:8] for f in ("huffman", "rans", "fse")}
    assert sha == {"huffman": "b6d3fd54", "rans": "d84a44e8", "fse": "ca2ff426"}
    one = codec.huffman_bytes(b"aaaaaaaaa")
    assert codec.huffman_data(one) == b"aaaaaaaaa"
    for bad in (one[:-1], one[:-2] + b"\1\0"):
        with pytest.raises(ValueError):
            codec.huffman_data(bad)


def test_suffixes():
    def common(x, y):
        return next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))

    for data in (b"", b"a", b"banana", b"mississippi" * 5, bytes(range(200)) * 2, b"a" * 40):
        places, lcp = suffixes.suffixes_of(data)
        want = sorted(range(len(data)), key=lambda i: data[i:])
        assert places.tolist() == want == suffixes.suffix_array_of(data).tolist()
        assert lcp.tolist() == [0] * bool(data) + [common(data[a:], data[b:]) for a, b in zip(want, want[1:])]
        for pattern in (b"", b"a", b"an", b"issi", b"zz"):
            below, n = sum(data[i:] < pattern for i in want), sum(data[i:].startswith(pattern) for i in want)
            assert suffixes._bounds(data, places, pattern) == (below, below + n)
    known = suffixes.Dictionary(b"banana bandana")
    for data in (b"bandit", b"ananas", b"xyz", b"banana bandana!"):
        place, n = known.longest(data, 0)
        assert n == max(k for k in range(len(data) + 1) if data[:k] in known.words) and known.words[place : place + n] == data[:n]


def test_bitmaps(spark):
    pattern = [0, 1, 1, 0, 1, 0, 0, 1]
    d = spark.createDataFrame(list(enumerate(pattern)), "pos long, bit int")
    assert {r.pos: r.rank0 for r in sequence.rank0(d).collect()} == {i: i - sum(pattern[:i]) for i in range(8)}
    assert sorted((r.k, r.pos) for r in sequence.select0(d).collect()) == [(0, 0), (1, 3), (2, 5), (3, 6)]
    ranges = spark.createDataFrame([(0, 8), (2, 2), (1, 5), (5, 100), (90, 100)], "start long, stop long")
    assert {(r.start, r.stop): r.ones for r in sequence.count_range(d, ranges).collect()} == {(0, 8): 4, (2, 2): 0, (1, 5): 3, (5, 100): 1, (90, 100): 0}
    places = {0, 5, 63, 64, 130}
    words = sequence.words_of(spark.createDataFrame([(x,) for x in places], "pos long"))

    def bits_of(df):
        return {r.block * 64 + i for r in df.collect() for i in range(64) if r.word >> i & 1}

    assert bits_of(words) == places
    for start, stop in ((0, 64), (60, 70), (63, 64), (10, 10), (1, 300)):
        assert bits_of(sequence.set_range(words, start, stop, True)) == places | set(range(start, stop))
        assert bits_of(sequence.set_range(words, start, stop, False)) == places - set(range(start, stop))
    word = F.lit(-(2**63) + 0b1110110).cast("long")
    got_ = spark.range(1).select(
        bits.bit_get(word, F.lit(63)).alias("a"), bits.bit_get(word, F.lit(64)).alias("b"), bits.count_ones_range(word, F.lit(0), F.lit(64)).alias("c"), bits.count_ones_range(word, F.lit(60), F.lit(30)).alias("d"),
        bits.count_ones_range(word, F.lit(64), F.lit(1)).alias("e"), bits.ones_run(word, F.lit(4)).alias("f"), bits.ones_run(word, F.lit(0)).alias("g"), bits.ones_run(F.lit(-1).cast("long"), F.lit(3)).alias("h"),
    ).first()
    assert tuple(got_) == (1, None, 6, 1, 0, 3, 0, 61)


def test_hash_combine_wraps(spark):
    r = random.Random(2)
    rows = [(r.randrange(-(2**63), 2**63), r.randrange(-(2**63), 2**63)) for _ in range(200)]
    d = spark.createDataFrame(rows, "h long, v long").select("h", "v", bits.hash_combine(F.col("h"), F.col("v")).alias("x"))
    for x in d.collect():
        h = x.h % 2**64
        want = (((h << 5 | h >> 59) % 2**64) + x.v) % 2**64
        assert x.x % 2**64 == want


def test_unicode_text(spark):
    d = spark.createDataFrame([("ÉLAN x\u00a0y\u2003İ ΣΑΣ", 1), ("", 2), (None, 3)], "t string, k int")
    rows = {r.k: r.w for r in d.select("k", T.unicode_words(F.col("t")).alias("w")).collect()}
    assert rows == {1: ["élan", "x", "y", "i̇", "σας"], 2: [], 3: None}
    for first, last in T.WIDE:
        assert one(spark, T.display_width(F.lit(chr(first) + chr(last)))) == 4
    assert one(spark, T.display_width(F.lit("\u18b0\U0001f600\U0003fffd"))) == 3
    assert one(spark, T.code_points(F.lit("aé日😀"))) == [0x61, 0xE9, 0x65E5, 0x1F600]
    assert one(spark, T.printable(F.lit("a\tb\n"))) and not one(spark, T.printable(F.lit("a\x1b")))
    assert one(spark, T.find_all(F.lit("aaaa"), "aa", 2)) == [0, 1]
    assert [tuple(x) for x in one(spark, T.find_any(F.lit("xéx"), b"x"))] == [(0, 120), (3, 120)]


def test_fragments_keep_their_limits(spark):
    r = random.Random(4)
    rows = [(i, "".join(r.choice("ab,:é") for _ in range(r.randint(0, 60)))) for i in range(40)] + [(90, None), (91, "")]
    d = spark.createDataFrame(rows, "k long, t string")
    pool, lists = store.fragments(d, "k", "t", ",:", 3, 9)
    sizes = [len(x.fragment) for x in pool.collect()]
    assert max(sizes) <= 9 and len(set(x.fragment_id for x in pool.collect())) == len(sizes)
    back = {x.k: bytes(x.data).decode() for x in store.restored(pool, lists, "k").collect()}
    assert back == {k: t or "" for k, t in rows}
    with pytest.raises(ValueError):
        store.fragments(d, "k", "t", ",", 5, 5)


def test_late_rows_are_dropped(spark, tmp_path):
    """A row older than the watermark is not counted; one that is late but within the delay is."""
    schema = "ts timestamp, k string"
    path = f"file://{tmp_path}/in"
    for hour in (("2024-01-01 00:10", "2024-01-01 09:00"), ("2024-01-01 09:30",), ("2024-01-01 08:30", "2024-01-01 00:20", "2024-01-01 23:00"), ("2024-01-02 23:00",)):
        spark.createDataFrame([(t, "a") for t in hour], "t string, k string").selectExpr("cast(t as timestamp) as ts", "k").coalesce(1).write.mode("append").parquet(path)
    counted = pipeline.windowed(pipeline.source(spark, path, schema, 1), "ts", "1 hour", "2 hours", ["k"])
    q = counted.writeStream.outputMode("append").format("memory").queryName("late").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    pipeline.finished(q)
    got_ = {r.start.hour: r.n for r in spark.table("late").filter("start < '2024-01-02'").collect()}
    assert got_ == {0: 1, 8: 1, 9: 2, 23: 1}  # the watermark of the batch before last decides what is late


@pytest.mark.parametrize("name", ["sessions", "join", "first_seen", "pipeline", "running", "windows"])
def test_results_of_streams_stay_on_the_executors(spark, sf, name):
    """They are read from files, not from a table in the driver's memory; the session keeps its settings."""
    from tessera.plans.catalog import QUERIES

    before = {k: spark.conf.get(k, None) for k in pipeline.STATE}
    plan = QUERIES[f"streaming_{name}"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" in plan and "MemoryPlan" not in plan and "LocalRelation" not in plan
    assert {k: spark.conf.get(k, None) for k in pipeline.STATE} == before


def test_results_by_mode(spark, tmp_path):
    schema = "ts timestamp, k string"
    rows = spark.sql("select timestamp'2024-01-01 00:00:00' ts, 'a' k union all select timestamp'2024-01-01 00:10:00', 'a'")
    counts = lambda x: pipeline.windowed(x, "ts", "1 hour", "2 hours", ["k"])
    assert [r.n for r in pipeline.result(counts(pipeline.replayed(spark, rows, "rows", 2)), "complete").collect()] == [2]
    assert sorted(r.k for r in pipeline.result(pipeline.replayed(spark, rows, "rows", 2).select("k"), "append").collect()) == ["a", "a"]
    (tmp_path / "none").mkdir()
    assert pipeline.result(pipeline.source(spark, str(tmp_path / "none"), schema), "append").collect() == []


def test_store(spark, tmp_path):
    s = store.RecordStore(spark, f"file://{tmp_path}/records")
    assert s.scan().count() == 0
    d = spark.createDataFrame([(5, bytearray(b"x")), (7, bytearray(b"yy")), (9, bytearray(b""))], "o long, data binary")
    assert sorted((r.o, r.record_id) for r in s.put_batch(d, "o").collect()) == [(5, 0), (7, 1), (9, 2)]
    assert s.get(1) == b"yy" and s.remove_batch(spark.createDataFrame([(1,), (44,)], "record_id long")) == 1
    with pytest.raises(KeyError):
        s.get(1)
    s.put_batch(d, "o")
    assert sorted(r.record_id for r in s.scan().collect()) == [0, 2, 3, 4, 5]
    assert s.remove_batch(spark.createDataFrame([(5,), (4,)], "record_id long")) == 2
    before = sorted(map(tuple, s.scan().collect()))
    s.compact()
    assert sorted(map(tuple, s.scan().collect())) == before and len(s._parts()) == 1
    assert sorted(r.record_id for r in s.put_batch(d, "o").collect()) == [6, 7, 8]  # a removed greatest id is not used again
    f = store.FolderStore(spark, f"file://{tmp_path}/folders")
    f.put_batch(spark.createDataFrame([(1, bytearray(b"a")), (2, bytearray(b""))], "record_id long, data binary"))
    assert f.get(2) == b"" and f.remove(1) and not f.remove(1)
    with pytest.raises(KeyError):
        f.get(1)


def test_lines(spark):
    d = spark.createDataFrame([(1, "a\r\n\n  b \n"), (2, None)], "k long, t string")
    assert [(r.line_no, r.line) for r in lines.numbered(d, "k", "t").orderBy("line_no").collect()] == [(1, "a"), (2, ""), (3, "  b "), (4, "")]
    assert [(r.line_no, r.line) for r in lines.numbered(d, "k", "t", True, True).orderBy("line_no").collect()] == [(1, "a"), (2, "b")]


def test_normalised_shares(spark):
    d = spark.createDataFrame([(0, b, n) for b, n in enumerate([1, 1, 1, 100000, 3, 50])], "g int, byte int, n long")
    rows = stats.normalised(d, 64, ["g"]).collect()
    assert sum(r.share for r in rows) == 64 and min(r.share for r in rows) >= 1
