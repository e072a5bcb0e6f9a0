"""Bitmaps, automata, suffix searches, integer and byte codecs, profiles, stores and streams: what the other modules leave."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import bits, codec
from tessera.functions import text as T
from tessera.operators import search, sequence, stats, suffixes
from tessera.plans.positional import _BITS, _SEQ, _SIGNED, _bits, _seq
from tessera.plans.registry import query, table
from tessera.sources import store
from tessera.streaming import pipeline

_ONES = f"(SELECT pos, max(bit) AS bit FROM {_BITS} GROUP BY pos)"


def _ones(spark, sf_dir):
    return _bits(spark, sf_dir).groupBy("pos").agg(F.max("bit").alias("bit"))


@query(f"SELECT pos, CAST(coalesce(sum(1 - bit) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rank0 FROM {_ONES}")
def rank0(spark, sf_dir):
    """Zeros before each place."""
    return sequence.rank0(_ones(spark, sf_dir)).select("pos", "rank0")


@query(f"SELECT row_number() OVER (ORDER BY pos) - 1 AS k, pos FROM {_ONES} WHERE bit = 0")
def select0(spark, sf_dir):
    """The place of the k-th zero, k from 0."""
    return sequence.select0(_ones(spark, sf_dir))


@query(f"SELECT dim, pos, CAST(coalesce(sum(bit) OVER (PARTITION BY dim ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rank1 FROM (SELECT dim, pos, max(bit) AS bit FROM {_BITS} GROUP BY dim, pos)")
def rank1_by_dimension(spark, sf_dir):
    b = _bits(spark, sf_dir).groupBy("dim", "pos").agg(F.max("bit").alias("bit"))
    return sequence.rank1(b, by=["dim"]).select("dim", "pos", "rank1")


@query(f"WITH b AS (SELECT * FROM {_ONES} WHERE bit = 1), r AS (SELECT DISTINCT c_custkey * 7 AS start, c_custkey * 7 + c_nationkey * 40 AS stop FROM customer) SELECT start, stop, CAST(count(pos) AS BIGINT) AS ones FROM r LEFT JOIN b ON pos >= start AND pos < stop GROUP BY start, stop")
def ones_in_ranges(spark, sf_dir):
    """Ones in half-open ranges of places, some of them empty."""
    start = F.col("c_custkey") * 7
    r = table(spark, sf_dir, "customer").select(start.cast("long").alias("start"), (start + F.col("c_nationkey") * 40).cast("long").alias("stop")).distinct()
    return sequence.count_range(_ones(spark, sf_dir), r).select("start", "stop", "ones")


@query(
    "SELECT l_orderkey, l_linenumber, CAST((l_partkey >> (l_linenumber::INTEGER)) & 1 AS INTEGER) AS bit, CAST(bit_count((l_partkey >> (l_linenumber::INTEGER)) & 31) AS INTEGER) AS ones, "
    "CAST(coalesce(list_min(list_filter(range(0, 40), lambda i: (l_partkey >> CAST(l_linenumber + i AS INTEGER)) & 1 = 0)), 0) AS INTEGER) AS run FROM lineitem"
)
def bit_access(spark, sf_dir):
    """A bit, the ones among five bits, and the ones on end, from a place in a word on."""
    w, at = F.col("l_partkey").cast("long"), F.col("l_linenumber").cast("int")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", bits.bit_get(w, at).alias("bit"), bits.count_ones_range(w, at, F.lit(5)).alias("ones"), bits.ones_run(w, at).alias("run"))


@query(f"WITH b AS (SELECT DISTINCT l_partkey AS v FROM lineitem UNION SELECT unnest(range(100, 1000)) AS v), c AS (SELECT v FROM b WHERE v < 300 OR v >= 451), w AS (SELECT v // 64 AS block, bit_or(1::UBIGINT << (v % 64)::UBIGINT) AS word FROM c GROUP BY 1) SELECT block, {_SIGNED.format('word')} AS word FROM w")
def bitmap_set_range(spark, sf_dir):
    """Words of 64 bits with one range of bits set and then another cleared."""
    words = sequence.words_of(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("long").alias("pos")).distinct())
    return sequence.set_range(sequence.set_range(words, 100, 1000, True), 300, 451, False)


@query("SELECT l_orderkey, l_linenumber, list_reduce(list_prepend(0::HUGEINT, list_transform(range(0, 63), lambda i: ((l_partkey >> CAST(i AS INTEGER)) & 1)::HUGEINT << CAST(63 - i AS INTEGER))), lambda a, b: a + b)::DECIMAL(20, 0) AS turned FROM lineitem")
def bit_reverse(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", bits.reverse(F.col("l_partkey").cast("long")).alias("turned"))


@query(
    "WITH x AS (SELECT l_orderkey, l_linenumber, (l_orderkey % 100000)::HUGEINT * 90000000000000 AS h, l_partkey::HUGEINT * 7 AS v FROM lineitem), c AS (SELECT l_orderkey, l_linenumber, (((h * 32) % 18446744073709551616 + h // 576460752303423488) % 18446744073709551616 + v) % 18446744073709551616 AS c FROM x) "
    f"SELECT l_orderkey, l_linenumber, {_SIGNED.format('c')} AS hash, CAST(c % 64 AS INTEGER) AS bucket FROM c"
)
def hash_combine(spark, sf_dir):
    """Two numbers combined to one hash, and its bucket of 64."""
    h, v = (F.col("l_orderkey") % 100000).cast("long") * 90000000000000, F.col("l_partkey").cast("long") * 7
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", bits.hash_combine(h, v).alias("hash"))
    return x.withColumn("bucket", F.col("hash").bitwiseAND(F.lit(63)).cast("int"))


@query("SELECT p_partkey, list_reduce(list_prepend(0::HUGEINT, list_transform(range(0, least(8, length(p_name))), lambda i: ascii(substr(p_name, i + 1, 1))::HUGEINT << CAST(8 * i AS INTEGER))), lambda a, b: a + b)::DECIMAL(20, 0) AS key FROM part")
def prefix_key(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.prefix_key(F.col("p_name")).alias("key"))


@query("SELECT p_partkey, dense_rank() OVER (ORDER BY p_type) - 1 AS type_id, p_brand AS brand FROM part")
def interned_strings(spark, sf_dir):
    """Types by the number of the string in a dictionary; brands in a field of ten bytes."""
    p = table(spark, sf_dir, "part")
    ids = search.dictionary(p, "p_type")
    return p.join(ids, p["p_type"] == ids["term"]).select("p_partkey", F.col("term_id").alias("type_id"), T.fixed_length(F.col("p_brand"), 10).alias("brand"))


@query("WITH p AS (SELECT DISTINCT p_type AS k FROM part WHERE p_type <> ''), s AS (SELECT k, unnest(range(1, length(k) + 1)) AS i FROM p) SELECT substr(k, 1, i - 1) AS state, substr(k, i, 1) AS symbol, substr(k, 1, i) AS next, bool_or(i = length(k)) AS final FROM s GROUP BY 1, 2, 3")
def automaton_transitions(spark, sf_dir):
    return search.transitions(table(spark, sf_dir, "part"), "p_type")


@query("WITH k AS (SELECT DISTINCT p_type AS k FROM part), s AS (SELECT DISTINCT unnest(list_transform(range(0, length(k) + 1), lambda i: substr(k, 1, i))) AS s FROM k), q AS (SELECT DISTINCT replace(p_type, 'BRUSHED', 'BRUSH') || CASE WHEN p_size > 40 THEN 'X' ELSE '' END AS q FROM part) SELECT q AS probe, CAST((SELECT max(length(s)) FROM s WHERE starts_with(q, s)) AS INTEGER) AS steps, EXISTS (SELECT 1 FROM k WHERE k = q) AS accepted FROM q")
def automaton_accepts(spark, sf_dir):
    """How far an automaton of all types gets in changed types, and whether it accepts them."""
    p = table(spark, sf_dir, "part")
    probe = F.concat(F.replace("p_type", F.lit("BRUSHED"), F.lit("BRUSH")), F.when(F.col("p_size") > 40, "X").otherwise(""))
    return search.accepts(p.select(probe.alias("probe")).distinct(), p, "probe", "p_type")


@query("WITH s AS (SELECT p_partkey, substr(p_name, unnest(range(1, length(p_name) + 1))) AS x FROM part) SELECT p_partkey, count(*) FILTER (WHERE x < 'an') AS first, count(*) FILTER (WHERE starts_with(x, 'an')) AS n FROM s GROUP BY p_partkey")
def suffix_search(spark, sf_dir):
    """By binary search on each name's suffix array: rank of the first suffix not below a pattern, and how many begin with it."""
    return suffixes.search(table(spark, sf_dir, "part"), "p_partkey", "p_name", "an")


@query("SELECT page_id, list_transform(list_filter(range(1, length(html)), lambda i: substr(html, i, 2) = 'th'), lambda i: CAST(i - 1 AS INTEGER))[1:5] AS at FROM pages")
def pattern_positions(spark, sf_dir):
    """The first five places of a pattern."""
    return table(spark, sf_dir, "pages").select("page_id", T.find_all(F.col("html"), "th", 5).alias("at"))


@query("WITH x AS (SELECT p_partkey, list_filter(range(1, length(p_name) + 1), lambda i: substr(p_name, i, 1) IN ('a', 'e', 'z')) AS i, p_name FROM part) SELECT p_partkey, list_transform(i, lambda k: CAST(k - 1 AS INTEGER)) AS at, list_transform(i, lambda k: CAST(ascii(substr(p_name, k, 1)) AS INTEGER)) AS byte FROM x")
def multi_byte_search(spark, sf_dir):
    """Places of any of three bytes, and which byte it is."""
    x = table(spark, sf_dir, "part").select("p_partkey", T.find_any(F.col("p_name"), b"aez").alias("x"))
    return x.select("p_partkey", F.col("x.pos").alias("at"), F.col("x.byte").alias("byte"))


@query("SELECT doc_id, lower(text || ' ÀÉÎÕÜ ΑΒΓ ЖЩ') AS low, upper(replace(substr(text, 1, 50), 'ß', '') || ' àéîõü αβγ жщ') AS up FROM documents")
def unicode_case(spark, sf_dir):
    """Lower and upper case by Unicode's mapping; ß, of which upper case makes two letters and DuckDB one, is left out."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.lower(F.concat(t, F.lit(" ÀÉÎÕÜ ΑΒΓ ЖЩ"))).alias("low"), F.upper(F.concat(F.replace(F.substring(t, 1, 50), F.lit("ß"), F.lit("")), F.lit(" àéîõü αβγ жщ"))).alias("up"))


@query("SELECT doc_id, list_transform(string_split(substr(text, 1, 40) || '日😀', ''), lambda c: CAST(unicode(c) AS INTEGER)) AS points, NOT regexp_matches(text, '[\\x{0}-\\x{8}\\x{B}\\x{C}\\x{E}-\\x{1F}\\x{7F}-\\x{9F}]') AS printable FROM documents")
def code_points(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.code_points(F.concat(F.substring(t, 1, 40), F.lit("日😀"))).alias("points"), T.printable(t).alias("printable"))


@query(
    "WITH b AS (SELECT p_partkey, p_name, unnest(range(1, strlen(p_name) + 1)) AS i FROM part), c AS (SELECT p_partkey, substr(p_name, i, 1) AS c, i > 1 AND substr(p_name, i, 1) = substr(p_name, i - 1, 1) AS same FROM b), "
    "f AS (SELECT p_partkey, c, count(*) AS n, sum(count(*)) OVER (PARTITION BY p_partkey) AS t FROM c GROUP BY 1, 2), e AS (SELECT p_partkey, round(sum(-(n / t) * log2(n / t)), 8) AS bits, CAST(count(*) AS INTEGER) AS alphabet FROM f GROUP BY 1), "
    "r AS (SELECT p_partkey, count(*) AS size, count(*) FILTER (WHERE same) AS s FROM c GROUP BY 1) SELECT p_partkey, size, alphabet, round(s / size, 8) AS repetition, round(size / (size - s), 8) AS run_length, bits FROM r JOIN e USING (p_partkey)"
)
def text_profile(spark, sf_dir):
    """Alphabet, repetition, runs and entropy of each name."""
    p = stats.text_profile(table(spark, sf_dir, "part"), "p_partkey", "p_name").filter("size > 0")
    return p.select("p_partkey", "size", "alphabet", *[F.round(c, 8).alias(c) for c in ("repetition", "run_length", "bits")])


@query("SELECT 'quantity' AS name, count(l_quantity) AS n, round(sum(l_quantity), 4)::DOUBLE AS total, min(l_quantity)::DOUBLE AS least, max(l_quantity)::DOUBLE AS most, round(avg(l_quantity), 6) AS mean FROM lineitem UNION ALL SELECT 'line', count(l_linenumber), sum(l_linenumber)::DOUBLE, min(l_linenumber)::DOUBLE, max(l_linenumber)::DOUBLE, round(avg(l_linenumber), 6) FROM lineitem")
def named_statistics(spark, sf_dir):
    """Several named accumulators in one pass."""
    x = stats.named(table(spark, sf_dir, "lineitem"), {"quantity": F.col("l_quantity"), "line": F.col("l_linenumber")})
    return x.select("name", "n", F.round("total", 4).alias("total"), "least", "most", F.round("mean", 6).alias("mean"))


@query(f"WITH d AS (SELECT user_id, (pos - 1) // 8 AS block, pos, event_id - lag(event_id) OVER (PARTITION BY user_id, (pos - 1) // 8 ORDER BY pos) AS d FROM {_SEQ}), e AS (SELECT user_id, block, d, d = lag(d) OVER (PARTITION BY user_id, block ORDER BY pos) AS same FROM d) SELECT user_id, block, avg(CAST(d = 0 AS INTEGER)) AS zero, avg(CAST(d >= 0 AND d < 256 AS INTEGER)) AS small, avg(CAST(d > 0 AND bit_count(d) = 1 AS INTEGER)) AS power, avg(CAST(coalesce(same, false) AS INTEGER)) AS repeated FROM e WHERE d IS NOT NULL GROUP BY user_id, block")
def sequence_patterns_by_block(spark, sf_dir):
    """The same profile with differences that start anew every eight events."""
    rows = _seq(spark, sf_dir).withColumn("block", F.floor((F.col("pos") - 1) / 8))
    return stats.sequence_profile(rows, "event_id", "pos", ["user_id", "block"])


@query("SELECT o_custkey AS g, list(o_orderkey ORDER BY o_orderkey) AS delta, list(o_orderkey ORDER BY o_orderkey) AS grouped, list(o_orderkey ORDER BY o_orderkey) AS prefix_free, list(o_orderkey ORDER BY o_orderkey) AS bit_packed, list(1000 - o_orderkey ORDER BY o_orderkey) AS signed, CAST(13 + ceil(count(*) * length(bin(max(o_orderkey) - min(o_orderkey))) / 8) AS INTEGER) AS packed_bytes FROM orders GROUP BY 1 HAVING count(*) > 1 AND max(o_orderkey) > min(o_orderkey)")
def integer_codecs_more(spark, sf_dir):
    """Differences, groups, sized numbers, packed bits and signed varints, read back, and the bytes that packing takes."""
    v = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("g")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("v")).filter("size(v) > 1 and array_max(v) > array_min(v)")
    back = lambda c, x=F.col("v"): codec.decode(codec.encode(x, c), c)
    signed = F.transform("v", lambda x: 1000 - x)
    return v.select("g", back("delta").alias("delta"), back("group").alias("grouped"), back("prefix_free").alias("prefix_free"), back("bit_packed").alias("bit_packed"), back("zigzag", signed).alias("signed"), F.octet_length(codec.encode(F.col("v"), "bit_packed")).alias("packed_bytes"))


@query("SELECT conv_id, turn, text AS huffman_o1, text AS huffman_o2, text AS huffman_x4, text AS rans_x2, text AS rans_x8 FROM conversations")
def byte_codecs_more(spark, sf_dir):
    """Codes by context, and interleaved streams, read back."""
    data = F.encode(F.col("text"), "UTF-8")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", *[F.decode(codec.decode(codec.encode(data, c), c), "UTF-8").alias(c) for c in ("huffman_o1", "huffman_o2", "huffman_x4", "rans_x2", "rans_x8")])


@query("SELECT event_id, props AS back FROM events")
def match_streams(spark, sf_dir):
    """Event properties as copies from a dictionary (of a bounded sample's commonest pieces) and literals, and read back."""
    e = table(spark, sf_dir, "events").select("event_id", "props")
    pieces = e.orderBy(F.xxhash64("event_id")).limit(2000).select(F.explode(F.split("props", "(?<=[,:])")).alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    words = "".join(r["p"] for r in pieces.orderBy(F.desc(F.col("n") * F.length("p")), "p").limit(200).collect()).encode()[: 1 << 14]
    data = F.encode("props", "UTF-8")
    return e.select("event_id", F.decode(codec.decode_matches(codec.encode_matches(data, words), words), "UTF-8").alias("back"))


@query(
    "WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 1 WHEN l_linenumber = 2 THEN l_partkey % 12 + 1 ELSE l_partkey * 53 END AS d, CAST(l_quantity AS BIGINT) * l_linenumber AS n FROM lineitem) SELECT l_orderkey, l_linenumber, "
    "CASE WHEN n = 1 THEN 'Literal' WHEN d = 1 AND n <= 33 THEN 'RLE' WHEN d >= 2 AND d <= 9 AND n <= 5 THEN 'NearShort' WHEN d >= 2 AND d <= 257 AND n <= 33 THEN 'Far1Short' WHEN d >= 258 AND d <= 65793 AND n <= 33 THEN 'Far2Short' WHEN d <= 65535 AND n >= 34 THEN 'Far2Long' ELSE 'Far3Long' END AS kind, "
    "CASE WHEN n = 1 THEN 2 WHEN d = 1 AND n <= 33 THEN 1 WHEN d >= 2 AND d <= 9 AND n <= 5 THEN 1 WHEN d >= 2 AND d <= 257 AND n <= 33 THEN 2 WHEN d >= 258 AND d <= 65793 AND n <= 33 THEN 3 WHEN d <= 65535 AND n >= 34 THEN CASE WHEN n <= 64 THEN 3 ELSE 6 END WHEN n <= 35 THEN 4 ELSE 7 END AS bytes FROM x"
)
def match_costs(spark, sf_dir):
    """Kind and bytes of copies by distance and length."""
    line, part = F.col("l_linenumber"), F.col("l_partkey").cast("long")
    d = F.when(line == 1, F.lit(1)).when(line == 2, part % 12 + 1).otherwise(part * 53)
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", bits.match_cost(d, F.col("l_quantity").cast("long") * line).alias("x"))
    return x.select("l_orderkey", "l_linenumber", "x.kind", "x.bytes")


_PERMUTED = "(SELECT p_partkey AS pos, CASE WHEN p_partkey // 10 % 3 = 1 THEN p_partkey // 10 * 10 + 9 - p_partkey % 10 ELSE p_partkey END + 1000000 * (p_partkey // 10 % 2) AS new_pos FROM part)"


def _permuted(spark, sf_dir):
    pos, block = F.col("p_partkey").cast("long"), F.expr("p_partkey div 10")
    new = F.when(block % 3 == 1, block * 10 + 9 - pos % 10).otherwise(pos) + 1000000 * (block % 2)
    return table(spark, sf_dir, "part").select(pos.alias("pos"), new.alias("new_pos"))


@query(f"WITH s AS (SELECT pos, new_pos, new_pos - lag(new_pos) OVER (ORDER BY pos) AS step, pos - lag(pos) OVER (ORDER BY pos) AS gap FROM {_PERMUTED}), r AS (SELECT *, sum(CASE WHEN gap = 1 AND abs(step) = 1 THEN 0 ELSE 1 END) OVER (ORDER BY pos) AS run FROM s) SELECT min(pos) AS start, min_by(new_pos, pos) AS new_start, count(*) AS length, CASE WHEN count(*) > 1 THEN max_by(step, pos) ELSE 1 END::INTEGER AS step FROM r GROUP BY run")
def reorder_runs(spark, sf_dir):
    """A permutation as stretches that go up or down by one."""
    return store.reorder_runs(_permuted(spark, sf_dir))


@query(f"SELECT pos, new_pos FROM {_PERMUTED}")
def reorder_restored(spark, sf_dir):
    return store.reorder_of(store.reorder_runs(_permuted(spark, sf_dir)))


@query("SELECT n_nationkey::BIGINT AS record_id, n_name AS name FROM nation WHERE n_nationkey <> 3")
def folder_store(spark, sf_dir):
    """A folder for each record; one is removed."""
    s = store.FolderStore(spark, f"{store.shared_dir(spark)}/tessera-{uuid.uuid4().hex}/folders")
    s.put_batch(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("record_id"), F.encode("n_name", "UTF-8").alias("data")))
    s.remove(3)
    return s.scan().select("record_id", F.decode("data", "UTF-8").alias("name"))


@query("SELECT event_id, event_type, CASE WHEN event_id % 2 = 0 THEN value ELSE -1 END AS value FROM events")
def schema_versions(spark, sf_dir):
    """Files of an old version lack a field, which is read with its default; one that later versions dropped is left out."""
    root = f"{store.shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events")
    e.filter("event_id % 2 = 0").select("event_id", "event_type", "value").write.parquet(f"{root}/new")
    e.filter("event_id % 2 <> 0").select("event_id", "event_type", "props").write.parquet(f"{root}/old")
    return store.read_versions(spark, [f"{root}/old", f"{root}/new"], "event_id long, event_type string, value double", {"value": -1.0})


@query("SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s")
def streaming_sessions(spark, sf_dir):
    """Sessions of each user: events less than six hours apart."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    stream = pipeline.replayed(spark, events, "events")
    return pipeline.result(pipeline.sessions(stream, "ts", "6 hours", "3650 days", ["user_id"]), "complete").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT a.event_id AS viewed, b.event_id AS bought FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 DAY")
def streaming_join(spark, sf_dir):
    """Purchases within a day of a view, from two streams."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    a = pipeline.replayed(spark, events.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("viewed"), F.col("ts").alias("view_ts")), "views")
    b = pipeline.replayed(spark, events.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("bought"), F.col("ts").alias("buy_ts")), "purchases")
    return pipeline.result(pipeline.joined(a, b, "user_id", "view_ts", "buy_ts", "1 day", "3650 days").select("viewed", "bought"), "append")


@query("SELECT DISTINCT user_id FROM events")
def streaming_first_seen(spark, sf_dir):
    """Users as they are first seen; a key is passed on once."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return pipeline.result(pipeline.first_seen(pipeline.replayed(spark, events, "events"), ["user_id"], "ts", "3650 days").select("user_id"), "append")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def streaming_batches(spark, sf_dir):
    """What a function that gets micro-batches, here with a batch stage before it, has written in the end."""
    root = f"{store.shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "events").select("event_id", "event_type")
    stage = pipeline.batch_stage(lambda frames: (f[["event_type"]] for f in frames), "event_type string")
    stream = pipeline.chained(pipeline.replayed(spark, rows, "events"), stage)
    q = pipeline.timed_batches(stream, lambda batch, nr: batch.write.mode("overwrite").parquet(f"{root}/out/batch={nr}"), 0, f"{root}/checkpoint")
    q.processAllAvailable()
    q.stop()
    return spark.read.parquet(f"{root}/out").groupBy("event_type").agg(F.count("*").alias("n"))
