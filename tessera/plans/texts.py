"""Text functions over documents, pages, conversations and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.plans.registry import query, table
from tessera.sources import lines

_WORD = "[A-Za-z0-9_]+"
_L = "(SELECT page_id, unnest(string_split(html, chr(10))) AS line FROM pages)"


@query(f"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '{T.UNICODE_SPACE}+')) AS word FROM conversations) WHERE word <> '' GROUP BY word")
def word_frequency(spark, sf_dir):
    """Words between Unicode white space in lower case, punctuation kept."""
    each = table(spark, sf_dir, "conversations").select(F.explode(T.unicode_words(F.col("text"))).alias("word"))
    return each.groupBy("word").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, regexp_extract_all(text, '{_WORD}') AS words FROM documents")
def tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.words(F.col("text")).alias("words"))


@query("SELECT p_partkey, CASE WHEN p_name = '' THEN [0] ELSE list_concat([0], list_transform(list_filter(range(1, length(p_name)), lambda i: regexp_matches(substr(p_name, i, 1), '[A-Za-z0-9_]') <> regexp_matches(substr(p_name, i + 1, 1), '[A-Za-z0-9_]')), lambda i: CAST(i AS INTEGER)), [CAST(length(p_name) AS INTEGER)]) END AS at FROM part")
def word_boundaries(spark, sf_dir):
    """Byte offsets; names are of ASCII alone."""
    return table(spark, sf_dir, "part").select("p_partkey", T.boundaries(F.col("p_name")).alias("at"))


@query("SELECT doc_id, CASE WHEN instr(text, 'é') > 0 THEN strlen(string_split(text, 'é')[1]) END AS at FROM documents")
def find_first(spark, sf_dir):
    """Byte offset of the first é."""
    return table(spark, sf_dir, "documents").select("doc_id", T.find(F.col("text"), "é").cast("long").alias("at"))


@query("SELECT p_partkey, list_transform(list_filter(range(1, length(p_name)), lambda i: substr(p_name, i, 2) = 'an'), lambda i: CAST(i - 1 AS INTEGER)) AS at FROM part")
def find_all(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.find_all(F.col("p_name"), "an").alias("at"))


@query("SELECT p_partkey FROM part WHERE p_type LIKE '%A_D%'")
def wildcard(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(T.wildcard(F.col("p_type"), "*A?D*")).select("p_partkey")


@query(f"SELECT page_id, count(*) AS lines, sum(length(line))::BIGINT AS chars, sum(strlen(line))::BIGINT AS bytes, sum(len(regexp_extract_all(line, '[^ \\t\\n\\x0B\\f\\r]+')))::BIGINT AS words, count(*) FILTER (WHERE trim(line, ' ' || chr(9) || chr(13)) = '') AS empty, max(strlen(line)) AS longest, min(strlen(line)) AS shortest FROM {_L} GROUP BY page_id")
def text_statistics(spark, sf_dir):
    return lines.statistics(lines.numbered(table(spark, sf_dir, "pages"), "page_id", "html"), ["page_id"])


@query(f"SELECT DISTINCT line FROM {_L}")
def unique_lines(spark, sf_dir):
    return lines.numbered(table(spark, sf_dir, "pages"), "page_id", "html").select("line").distinct()


@query("SELECT page_id, CAST(i AS INTEGER) AS line_no, line FROM (SELECT page_id, unnest(string_split(html, chr(10))) AS line, unnest(range(1, len(string_split(html, chr(10))) + 1)) AS i FROM pages) WHERE strlen(line) BETWEEN 20 AND 60")
def line_filter(spark, sf_dir):
    """Numbered lines of 20 to 60 bytes."""
    return lines.by_length(lines.numbered(table(spark, sf_dir, "pages"), "page_id", "html"), 20, 60).select("page_id", "line_no", "line")


@query("SELECT page_id, CAST((i - 1) // 5 AS BIGINT) AS batch, count(*) AS n FROM (SELECT page_id, unnest(range(1, len(string_split(html, chr(10))) + 1)) AS i FROM pages) GROUP BY 1, 2")
def line_batches(spark, sf_dir):
    """Batches of five lines; a last one may be partial."""
    b = lines.batches(lines.numbered(table(spark, sf_dir, "pages"), "page_id", "html"), 5)
    return b.groupBy("page_id", "batch").agg(F.count("*").alias("n"))


@query("SELECT event_id, string_split(props, ':') AS fields FROM events")
def split_fields(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.split_keep(F.col("props"), ":").alias("fields"))


@query("WITH s AS (SELECT page_id, string_split(url, '/') AS f FROM pages) SELECT page_id, CASE WHEN f[-1] = '' THEN f[1 : len(f) - 1] ELSE f END AS fields FROM s")
def split_dropping_last(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.split_drop(F.col("url"), "/").alias("fields"))


@query("SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def join_strings(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"))
    return c.select("conv_id", F.array_join("x.role", ",").alias("roles"))


@query("SELECT p_partkey, translate(p_name, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS up, regexp_replace(p_name || ' 12', '[^A-Za-z]', '', 'g') AS alpha, regexp_replace(p_name || ' 12', '[^0-9]', '', 'g') AS digit, regexp_replace(p_name, '[ \\t\\n\\x0B\\f\\r]', '', 'g') AS no_space, translate(p_name, 'aeiou', '') AS removed FROM part")
def char_filters(spark, sf_dir):
    name = F.col("p_name")
    more = F.concat(name, F.lit(" 12"))
    return table(spark, sf_dir, "part").select("p_partkey", T.ascii_upper(name).alias("up"), T.keep_class(more, "alpha").alias("alpha"), T.keep_class(more, "digit").alias("digit"), T.keep_class(name, "no_space").alias("no_space"), T.keep_class(name, "remove", "aeiou").alias("removed"))


@query("SELECT p_partkey, list_transform(range(1, length(p_brand) + 1), lambda i: regexp_matches(substr(p_brand, i, 1), '[0-9]')) AS mask FROM part")
def class_mask(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.class_mask(F.col("p_brand"), "[0-9]").alias("mask"))


_COUNT = "len(regexp_extract_all(text, '{}'))"
_ASCII = _COUNT.format("[\\x{0}-\\x{7F}]")


@query(
    f"SELECT doc_id, strlen(text) AS bytes, length(text) AS chars, {_ASCII} AS ascii, {_COUNT.format('[\\p{L}\\p{Nl}]')} AS alphabetic, {_COUNT.format('\\p{N}')} AS numeric, {_COUNT.format(T.UNICODE_SPACE)} AS whitespace, {_COUNT.format('\\p{Cc}')} AS control, "
    f"{_COUNT.format('[\\x{80}-\\x{FF}]')} AS latin, {_COUNT.format('[\\x{100}-\\x{17FF}]')} AS middle, {_COUNT.format('[\\x{1800}-\\x{10FFFF}]')} AS high, "
    f"round(CASE WHEN length(text) = 0 THEN 0 ELSE 0.7 * (length(text) - {_ASCII}) / length(text) + least(0.3, (strlen(text) / length(text) - 1) / 3 * 0.3) END, 9) AS score FROM documents"
)
def unicode_profile(spark, sf_dir):
    p = table(spark, sf_dir, "documents").select("doc_id", T.unicode_profile(F.col("text")).alias("p"))
    kinds = ("bytes", "chars", "ascii", "alphabetic", "numeric", "whitespace", "control", "latin", "middle", "high")
    return p.select("doc_id", *[F.col(f"p.{c}").cast("long").alias(c) for c in kinds], F.round("p.score", 9).alias("score"))


@query("SELECT p_partkey, lower(hex(encode(p_name))) AS hex, base64(encode(p_name)) AS b64, p_name AS back FROM part")
def hex_and_base64(spark, sf_dir):
    data = F.encode(F.col("p_name"), "UTF-8")
    t = table(spark, sf_dir, "part").select("p_partkey", T.hex_lower(data).alias("hex"), F.base64(data).alias("b64"))
    return t.select("p_partkey", "hex", "b64", F.decode(T.unhex_strict(F.col("hex")), "UTF-8").alias("back"))


@query("WITH x AS (SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN '-' ELSE '' END || '00' || o_custkey AS a, CASE WHEN o_orderkey % 2 = 0 THEN '-' ELSE '+' END || o_orderkey AS b FROM orders) SELECT o_orderkey, sign(CAST(a AS BIGINT) - CAST(b AS BIGINT))::INTEGER AS cmp FROM x")
def numeric_string_compare(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a = F.concat(F.when(F.col("o_custkey") % 3 == 0, "-").otherwise(""), F.lit("00"), F.col("o_custkey").cast("string"))
    b = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "-").otherwise("+"), F.col("o_orderkey").cast("string"))
    return o.select("o_orderkey", T.compare(T.integer_key(a), T.integer_key(b)).alias("cmp"))


@query("SELECT a.c_custkey AS c_custkey, sign(a.c_acctbal - b.c_acctbal)::INTEGER AS cmp FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1")
def real_string_compare(spark, sf_dir):
    """Amounts written with two decimals, compared as text."""
    c = table(spark, sf_dir, "customer").select("c_custkey", T.real_key(F.col("c_acctbal").cast("decimal(18,2)").cast("string")).alias("k"))
    d = c.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("k").alias("l"))
    return c.join(d, "c_custkey").select("c_custkey", T.compare(F.col("k"), F.col("l")).alias("cmp"))


@query("SELECT doc_id, starts_with(text, 'Th') AS starts, ends_with(text, '.') AS ends, substr(text, 3, 5) AS part, reverse(substr(text, 1, 6)) AS back FROM documents")
def affixes_and_slices(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", t.startswith("Th").alias("starts"), t.endswith(".").alias("ends"), F.substring(t, 3, 5).alias("part"), F.reverse(F.substring(t, 1, 6)).alias("back"))


_WIDE = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in T.WIDE) + "]"


@query(f"SELECT doc_id, CAST(length(text) - len(regexp_extract_all(text, '\\p{{Cc}}')) + len(regexp_extract_all(text, '{_WIDE}')) AS INTEGER) AS width FROM (SELECT doc_id, text || chr(9) || chr(12687) || chr(12703) || chr(42191) || chr(65049) || chr(131072) || chr(194560) || chr(200000) AS text FROM documents)")
def display_width(spark, sf_dir):
    """Columns on a terminal, of texts with a tab, wide characters of several blocks and one that is not listed behind them."""
    tail = "".join(map(chr, (9, 12687, 12703, 42191, 65049, 131072, 194560, 200000)))
    return table(spark, sf_dir, "documents").select("doc_id", T.display_width(F.concat("text", F.lit(tail))).alias("width"))


@query("SELECT p_partkey, p_partkey % 3 <> 1 AS valid, CASE WHEN p_partkey % 3 <> 1 THEN length(p_name) + (p_partkey % 3 = 0)::INTEGER END AS chars FROM part")
def utf8_validation(spark, sf_dir):
    """Names with a whole two-byte letter behind them, half of one, and none."""
    data = F.encode(F.concat("p_name", F.lit("é")), "UTF-8")
    n = F.octet_length(data) - (F.col("p_partkey") % 3).cast("int")
    t = table(spark, sf_dir, "part").select("p_partkey", F.substring(data, F.lit(1), n).alias("data"))
    valid = F.is_valid_utf8(F.col("data").cast("string"))
    return t.select("p_partkey", valid.alias("valid"), F.when(valid, F.char_length(F.col("data").cast("string"))).cast("long").alias("chars"))
