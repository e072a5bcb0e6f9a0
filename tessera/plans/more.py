"""Graph walks, codecs, bit functions, stores and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import bits, codec
from tessera.functions.text import words
from tessera.operators import graph, ranking, sequence, stats, suffixes
from tessera.plans.registry import query, table
from tessera.sources import store
from tessera.streaming import pipeline

_EDGES = "(SELECT 'r' || r_regionkey AS src, 'n' || n_nationkey AS dst FROM region JOIN nation ON r_regionkey = n_regionkey UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"


def _edges(spark, sf_dir):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    n, c, s, o = (table(spark, sf_dir, t) for t in ("nation", "customer", "supplier", "orders"))
    return (
        n.select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst")).unionAll(c.select(name("n", "c_nationkey"), name("c", "c_custkey")))
        .unionAll(s.select(name("n", "s_nationkey"), name("s", "s_suppkey"))).unionAll(o.select(name("c", "o_custkey"), name("o", "o_orderkey")))
    )


@query(f"WITH RECURSIVE w AS (SELECT 'r1' AS v, 0 AS depth UNION SELECT dst, depth + 1 FROM w JOIN {_EDGES} e ON e.src = w.v WHERE depth + 1 < 3) SELECT v, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY v")
def bfs_levels(spark, sf_dir):
    """Breadth first from one region; the greatest depth is not reached."""
    return graph.levels(_edges(spark, sf_dir), spark.createDataFrame([("r1",)], "v string"), 3)


@query(f"WITH RECURSIVE w AS (SELECT 'n3' AS v UNION SELECT dst FROM w JOIN {_EDGES} e ON e.src = w.v) SELECT v FROM w")
def reachable(spark, sf_dir):
    return graph.reachable(_edges(spark, sf_dir), spark.createDataFrame([("n3",)], "v string"))


@query(
    "WITH RECURSIVE e AS (SELECT n_regionkey::BIGINT AS g, -1::BIGINT AS src, n_nationkey::BIGINT AS dst FROM nation UNION ALL SELECT n_regionkey, n_nationkey, c_custkey + 1000 FROM customer JOIN nation ON c_nationkey = n_nationkey), "
    "w AS (SELECT DISTINCT g, -1::BIGINT AS v, CAST([] AS BIGINT[]) AS path FROM e UNION ALL SELECT w.g, e.dst, list_append(w.path, e.dst) FROM w JOIN e ON e.g = w.g AND e.src = w.v) "
    "SELECT g, v, CAST(row_number() OVER (PARTITION BY g ORDER BY path) - 1 AS INTEGER) AS nr FROM w"
)
def dfs_order(spark, sf_dir):
    """Depth-first order in each region's graph of nations and customers."""
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    top = n.select(F.col("n_regionkey").cast("long").alias("g"), F.lit(-1).cast("long").alias("src"), F.col("n_nationkey").cast("long").alias("dst"))
    low = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").cast("long"), F.col("n_nationkey").cast("long"), (F.col("c_custkey") + 1000).alias("dst"))
    seeds = n.select(F.col("n_regionkey").cast("long").alias("g"), F.lit(-1).cast("long").alias("v")).distinct()
    return graph.depth_first(top.unionAll(low), seeds, "g")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey = 0 THEN 0 ELSE length(bin(l_orderkey)) END::INTEGER AS width, ((l_orderkey >> 3) & 31) AS field, (l_orderkey - 1000) * 2 AS twice FROM lineitem")
def bit_functions(spark, sf_dir):
    k = F.col("l_orderkey")
    zig = bits.zigzag(k - 1000)
    back = F.when(zig % 2 == 0, F.shiftright(zig, 1)).otherwise(-F.shiftright(zig, 1) - 1)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", bits.bit_width(k).alias("width"), bits.field(k, 3, 5).alias("field"), (back * 2).alias("twice"))


@query("SELECT l_orderkey, l_linenumber, (l_orderkey & 3) | (((l_orderkey >> 4) & 3) << 2) AS packed, (l_orderkey & 3) | (((l_orderkey >> 2) & 3) << 4) AS spread FROM lineitem")
def bit_extract_deposit(spark, sf_dir):
    k = F.col("l_orderkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", bits.extract(k, 0b110011).alias("packed"), bits.deposit(k, 0b110011).alias("spread"))


@query("SELECT p_partkey, list_reduce(list_prepend(0::BIGINT, list_transform(range(0, 31), lambda i: (((p_partkey >> CAST(i AS INTEGER)) & 1) << CAST(2 * i AS INTEGER)) + (((CAST(p_size AS BIGINT) >> CAST(i AS INTEGER)) & 1) << CAST(2 * i + 1 AS INTEGER)))), lambda a, b: a + b) AS z FROM part")
def z_order(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", bits.interleave(F.col("p_partkey"), F.col("p_size")).alias("z"))


@query("WITH l AS (SELECT o_custkey AS g, list(o_orderkey ORDER BY o_orderkey) AS v FROM orders GROUP BY 1) SELECT g, CAST(ceil(len(v) / 4.0) + list_sum(list_transform(v, lambda x: greatest(ceil(length(bin(x)) / 8.0), 1))) AS INTEGER) AS stream_bytes, CASE WHEN len(v) >= 16 THEN 'group' WHEN len(v) > 6 THEN 'delta' WHEN list_max(v) < 256 THEN 'compact' ELSE 'leb128' END AS choice, CAST(list_sum(list_transform(v, lambda x: greatest(ceil(length(bin(x)) / 7.0), 1))) AS INTEGER) AS varint_bytes FROM l")
def integer_code_sizes(spark, sf_dir):
    v = table(spark, sf_dir, "orders").filter("o_orderkey >= 0").groupBy(F.col("o_custkey").alias("g")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("v"))
    total = F.aggregate("v", F.lit(0), lambda a, x: a + bits.varint_size(x))
    return v.select("g", bits.streamvbyte_size(F.col("v")).alias("stream_bytes"), bits.varint_choice(F.col("v")).alias("choice"), total.alias("varint_bytes"))


@query("SELECT term, count(*) AS n, CASE WHEN count(*) <= 64 THEN 'dense' WHEN max(doc_id) - min(doc_id) <= 2 * count(*) THEN 'clustered' WHEN count(*) <= 256 THEN 'ef' WHEN count(*) <= 4096 THEN 'pef' ELSE 'opef' END AS layout FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS term FROM documents) GROUP BY term")
def posting_encoding_choice(spark, sf_dir):
    p = ranking.postings(table(spark, sf_dir, "documents")).groupBy("term").agg(F.count("*").alias("n"), (F.max("doc_id") - F.min("doc_id")).alias("span"))
    return p.select("term", "n", bits.posting_encoding(F.col("n"), F.col("span")).alias("layout"))


@query("SELECT o_custkey AS g, list(o_orderkey ORDER BY o_orderkey) AS v, true AS same FROM orders GROUP BY 1")
def integer_codecs(spark, sf_dir):
    """Varints and byte-oriented integers, encoded and read back."""
    v = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("g")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("v"))
    back = v.select("g", "v", codec.decode(codec.encode(F.col("v"), "varint"), "varint").alias("a"), codec.decode(codec.encode(F.col("v"), "streamvbyte"), "streamvbyte").alias("b"))
    return back.select("g", F.col("a").alias("v"), (F.col("a") == F.col("b")).alias("same"))


@query("SELECT conv_id, turn, text AS huffman, text AS rans, text AS fse, text AS zstd FROM conversations")
def byte_codecs(spark, sf_dir):
    """Texts of conversations through four codecs and back."""
    data = F.encode(F.col("text"), "UTF-8")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", *[F.decode(codec.decode(codec.encode(data, c), c), "UTF-8").alias(c) for c in ("huffman", "rans", "fse", "zstd")])


@query("SELECT event_id, props AS back FROM events")
def zstd_dictionary(spark, sf_dir):
    """Event properties compressed against a dictionary that a bounded sample of them trained, and read back."""
    e = table(spark, sf_dir, "events").select("event_id", F.encode("props", "UTF-8").alias("data"))
    words = codec.dictionary([bytes(r["data"]) for r in e.filter("data is not null").orderBy(F.xxhash64("event_id")).limit(2000).collect()])
    return e.select("event_id", F.decode(codec.decode_with(codec.encode_with(F.col("data"), words), words), "UTF-8").alias("back"))


@query("WITH t AS (SELECT doc_id, text FROM documents) SELECT g, count(*) AS n FROM (SELECT substr(term, i, 3) AS g FROM (SELECT term, unnest(range(1, length(term) - 1)) AS i FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS term FROM t) WHERE length(term) >= 3)) GROUP BY g ORDER BY n DESC, g LIMIT 100")
def frequent_substrings(spark, sf_dir):
    """The commonest strings of three characters in words: what a codec's dictionary would hold."""
    w = table(spark, sf_dir, "documents").select(F.explode(words(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("c")).filter(F.length("w") >= 3)
    g = w.select("c", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 2), lambda i: F.substring(F.col("w"), i, F.lit(3)))).alias("g"))
    return g.groupBy("g").agg(F.sum("c").alias("n")).orderBy(F.desc("n"), "g").limit(100)


@query("WITH l AS (SELECT o_custkey AS g, list(o_orderkey ORDER BY o_orderkey) AS v FROM orders GROUP BY 1), s AS (SELECT g, 8 * len(v) AS size, CAST(4 + ceil(len(v) / 4.0) + list_sum(list_transform(v, lambda x: greatest(ceil(length(bin(x)) / 8.0), 1))) AS BIGINT) AS coded FROM l) SELECT g, size, coded, round(coded / size, 6) AS ratio, round((1 - coded / size) * 100, 4) AS saved FROM s")
def compression_ratio(spark, sf_dir):
    """Plain and coded size of each customer's order keys, their ratio, and the share that is saved."""
    v = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("g")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("v"))
    s = v.select("g", (8 * F.size("v")).cast("long").alias("size"), F.octet_length(codec.encode(F.col("v"), "streamvbyte")).cast("long").alias("coded"))
    return s.withColumn("ratio", F.round(F.col("coded") / F.col("size"), 6)).withColumn("saved", F.round((1 - F.col("coded") / F.col("size")) * 100, 4))


@query()
def crc32c(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", codec.crc32c(F.encode(F.col("p_name"), "UTF-8")).alias("crc"))


@query("WITH b AS (SELECT p_brand, ('0x' || substr(h, 2 * i + 1, 2))::INTEGER AS byte FROM (SELECT p_brand, hex(encode(p_name)) AS h, unnest(range(0, strlen(p_name))) AS i FROM part)), c AS (SELECT p_brand, byte, count(*) AS n FROM b GROUP BY 1, 2), e AS (SELECT p_brand, sum(-(n / t) * log2(n / t)) AS bits, max(t) AS size, count(*) AS kinds FROM (SELECT *, sum(n) OVER (PARTITION BY p_brand) AS t FROM c) GROUP BY p_brand) SELECT p_brand, CASE WHEN 1 - kinds / 256 > 0.8 THEN 'dictionary' WHEN bits < 4 AND size > 1024 THEN 'fse' WHEN bits BETWEEN 4 AND 6 AND size > 256 THEN 'rans' ELSE 'huffman' END AS choice FROM e")
def codec_choice(spark, sf_dir):
    c = stats.byte_counts(table(spark, sf_dir, "part"), ["p_brand"], "p_name")
    e = stats.entropy(c, ["p_brand"]).join(c.groupBy("p_brand").agg(F.sum("n").alias("size"), F.count("*").alias("kinds")), "p_brand")
    return e.select("p_brand", codec.codec_choice(F.col("bits"), F.col("size"), F.col("kinds")).alias("choice"))


@query(
    "WITH s AS (SELECT p_partkey, unnest(range(0, length(p_name))) AS pos, p_name FROM part), o AS (SELECT p_partkey, pos, substr(p_name, pos + 1) AS x, row_number() OVER w - 1 AS nr, lag(substr(p_name, pos + 1)) OVER w AS y FROM s WINDOW w AS (PARTITION BY p_partkey ORDER BY substr(p_name, pos + 1))) "
    "SELECT p_partkey, nr, pos, CAST(CASE WHEN y IS NULL THEN 0 ELSE list_max(list_filter(range(0, least(length(x), length(y)) + 1), lambda i: substr(x, 1, i) = substr(y, 1, i))) END AS BIGINT) AS lcp FROM o"
)
def suffix_array(spark, sf_dir):
    """Places of each name's suffixes in order, and the common prefix of each with the one before."""
    return suffixes.suffix_array(table(spark, sf_dir, "part"), "p_partkey", "p_name")


@query("WITH s AS (SELECT p_partkey, unnest(range(0, length(p_name))) AS pos, p_name FROM part) SELECT p_partkey, string_agg(CASE WHEN pos = 0 THEN right(p_name, 1) ELSE substr(p_name, pos, 1) END, '' ORDER BY substr(p_name, pos + 1)) AS bwt FROM s GROUP BY p_partkey")
def burrows_wheeler(spark, sf_dir):
    return suffixes.bwt(table(spark, sf_dir, "part"), "p_partkey", "p_name").select("p_partkey", F.decode("bwt", "UTF-8").alias("bwt"))


@query("WITH p AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS record_id, p_name FROM part), n AS (SELECT count(*) AS n FROM part) SELECT q AS pos, q AS record_id, CASE WHEN q < n THEN a.p_name ELSE b.p_name END AS data FROM (SELECT unnest(range(0, (SELECT 2 * n + 5 FROM n))) AS q), n LEFT JOIN p a ON a.record_id = q AND q % 5 <> 0 LEFT JOIN p b ON b.record_id = q - n")
def blob_get_batch(spark, sf_dir):
    """Records put into a store, a fifth of them removed, all put once more, then every id asked for; misses are null and no id is used again."""
    s = store.RecordStore(spark, f"{store.shared_dir(spark)}/tessera-{uuid.uuid4().hex}/records")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.encode("p_name", "UTF-8").alias("data"))
    s.put_batch(rows, "p_partkey")
    s.remove_batch(s.scan().filter("record_id % 5 = 0").select("record_id"))
    s.put_batch(rows, "p_partkey")
    ids = spark.range(0, 2 * rows.count() + 5).select(F.col("id").alias("pos"), F.col("id").alias("record_id"))
    return s.get_batch(ids).select("pos", "record_id", F.decode("data", "UTF-8").alias("data"))


@query("SELECT p_name AS key, p_partkey FROM part WHERE p_name LIKE 'c%'")
def blob_prefix(spark, sf_dir):
    return store.by_prefix(table(spark, sf_dir, "part").select(F.col("p_name").alias("key"), "p_partkey"), "key", "c")


@query("WITH n AS (SELECT strlen(p_name) AS n, count(*) AS c FROM part GROUP BY 1 ORDER BY c DESC, n LIMIT 1) SELECT p_partkey, strlen(p_name) = (SELECT n FROM n) AS is_fixed FROM part")
def mixed_length_store(spark, sf_dir):
    return store.length_split(table(spark, sf_dir, "part").select("p_partkey", F.encode("p_name", "UTF-8").alias("data"))).select("p_partkey", "is_fixed")


@query("SELECT event_id, props AS data, len(regexp_extract_all(props, '(?s).{4}.{0,11}?[,:]|.{1,16}')) AS fragments FROM events")
def fragment_store(spark, sf_dir):
    """Event properties cut into fragments of 5 to 16 bytes behind commas and colons, each kept once, and put together again."""
    pool, lists = store.fragments(table(spark, sf_dir, "events"), "event_id", "props", ",:", 4, 16)
    back = store.restored(pool, lists, "event_id").select("event_id", F.decode("data", "UTF-8").alias("data"))
    return back.join(lists.select("event_id", F.size("ids").cast("long").alias("fragments")), "event_id")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most FROM events GROUP BY event_type")
def streaming_running(spark, sf_dir):
    """Events through micro-batches; the last state of the running counters."""
    stream = pipeline.replayed(spark, table(spark, sf_dir, "events"), "events")
    return pipeline.result(pipeline.running(stream, ["event_type"], "value"), "complete").withColumn("total", F.round("total", 4))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def streaming_windows(spark, sf_dir):
    """Counts by day of event time, all windows closed or open."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    stream = pipeline.replayed(spark, events, "events")
    return pipeline.result(pipeline.windowed(stream, "ts", "1 day", "3650 days", ["event_type"]), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT event_id, value * 2 AS doubled FROM events WHERE event_type = 'click'")
def streaming_pipeline(spark, sf_dir):
    """A filter and a map in one stream."""
    stream = pipeline.replayed(spark, table(spark, sf_dir, "events"), "events")
    out = pipeline.chained(stream, pipeline.filter_stage(F.col("event_type") == "click"), pipeline.map_stage(doubled=F.col("value") * 2)).select("event_id", "doubled")
    return pipeline.result(out, "append")


@query("SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def streaming_upserts(spark, sf_dir):
    """The newest event of each user, merged micro-batch by micro-batch."""
    root = f"{store.shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    q = pipeline.upserts(pipeline.replayed(spark, rows, "events"), f"{root}/table", ["user_id"], "event_id", f"{root}/checkpoint")
    pipeline.finished(q)
    return pipeline.upserted(spark, f"{root}/table", rows.schema).select("user_id", "event_id", "event_type")


@query("SELECT event_type, list_sort(list(DISTINCT user_id))[1:5] AS users, count(DISTINCT user_id) AS n FROM events GROUP BY event_type")
def array_operations(spark, sf_dir):
    a = table(spark, sf_dir, "events").groupBy("event_type").agg(F.array_sort(F.collect_set("user_id")).alias("x"))
    return a.select("event_type", F.slice("x", 1, 5).alias("users"), F.size("x").cast("long").alias("n"))


@query("SELECT k, c AS hit FROM (SELECT unnest([1, 3, 99999999]) AS k) LEFT JOIN (SELECT o_custkey, count(*) AS c FROM orders GROUP BY 1) ON k = o_custkey")
def map_gather(spark, sf_dir):
    """Counts by key asked for in order; a miss is null."""
    c = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("hit"))
    return spark.createDataFrame([(1,), (3,), (99999999,)], "k int").join(c, F.col("k") == F.col("o_custkey"), "left").select("k", "hit")


@query("SELECT doc_id, n, rank() OVER (ORDER BY n, doc_id) - 1 AS below FROM (SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS n FROM documents)")
def order_ranks(spark, sf_dir):
    """Place of each document by its number of words, range by range."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.size(words(F.col("text"))).alias("n"))
    return sequence.running_by(d, ["n", "doc_id"], F.lit(1), inclusive=False).select("doc_id", "n", F.col("running").alias("below"))
