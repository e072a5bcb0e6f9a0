"""Term dictionaries and lookups: exact, prefix, range, fuzzy, longest prefix, many patterns."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import as_bytes, common_prefix
from tessera.operators.sequence import numbered, running_by


def dictionary(rows: DataFrame, term: str) -> DataFrame:
    """(term, term_id): distinct terms, numbered from 0 in order, range by range."""
    terms = rows.select(F.col(term).alias("term")).filter("term is not null").distinct()
    return numbered(terms, ["term"]).select("term", (F.col("nr") - 1).alias("term_id"))


def membership(probes: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """probes with found; a probe is one row, whatever the keys repeat."""
    known = keys.select(F.col(key)).distinct().withColumn("found", F.lit(True))
    return probes.join(known, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def with_prefix(rows: DataFrame, key: str, prefix: str) -> DataFrame:
    return rows.filter(F.col(key).startswith(prefix))


def prefix_join(keys: DataFrame, prefixes: DataFrame, key: str, prefix: str = "prefix") -> DataFrame:
    """(prefix, key): keys by prefix; an equi join on the prefix lengths there are, not a comparison of all pairs."""
    sizes = prefixes.select(F.length(prefix).alias("_n")).distinct()
    cut = keys.crossJoin(F.broadcast(sizes)).filter(F.length(key) >= F.col("_n"))  # a row for each length, a few at most
    return cut.withColumn(prefix, F.substring(F.col(key), F.lit(1), F.col("_n"))).join(prefixes.select(prefix).distinct(), prefix).select(prefix, key)


def in_range(rows: DataFrame, key: str, low: str, high: str) -> DataFrame:
    return rows.filter((F.col(key) >= low) & (F.col(key) < high))


def longest_prefix(probes: DataFrame, keys: DataFrame, probe: str, key: str) -> DataFrame:
    """(probe, matched): the longest key that is a prefix of each probe, null if none. Hash join on all prefixes of a probe."""
    cut = probes.select(probe).distinct().withColumn(key, F.explode(F.transform(F.sequence(F.lit(0), F.length(probe)), lambda n: F.substring(F.col(probe), F.lit(1), n))))
    best = cut.join(keys.select(key).distinct(), key).groupBy(probe).agg(F.max_by(key, F.length(key)).alias("matched"))
    return probes.join(best, probe, "left")


def byte_distance(a: Column, b: Column, limit: int) -> Column:
    """Edit distance over bytes, -1 beyond limit."""
    return F.levenshtein(as_bytes(a), as_bytes(b), limit)


def fuzzy_join(left: DataFrame, right: DataFrame, a: str, b: str, limit: int) -> DataFrame:
    """(a, b, distance) of distinct strings at most limit edits apart (bytes, no transposition).

    Two strings within d edits agree in one of d + 1 pieces of the shorter, moved by d places at most: pieces of one
    side meet substrings of the other by hash join, and the distance is computed for those that meet.
    """
    x = left.select(a).distinct().withColumn("_x", as_bytes(F.col(a))).withColumn("_n", F.length("_x"))
    y = right.select(b).distinct().withColumn("_y", as_bytes(F.col(b))).withColumn("_m", F.length("_y"))
    parts = limit + 1
    size = F.floor(F.col("_n") / parts).cast("int")
    cut = F.array(*[F.struct(F.lit(i).alias("i"), (size * i + 1).alias("p"), (size if i < parts - 1 else F.col("_n") - size * i).cast("int").alias("l")) for i in range(parts)])
    x = x.withColumn("_c", F.explode(cut)).select(a, "_x", "_n", F.col("_c.i").alias("_i"), F.col("_c.p").alias("_p"), F.substring(F.col("_x"), F.col("_c.p"), F.col("_c.l")).alias("_piece"))
    near = y.withColumn("_n", F.explode(F.sequence(F.greatest(F.col("_m") - limit, F.lit(0)), F.col("_m") + limit)))
    shifts = F.transform(F.sequence(F.lit(-limit), F.lit(limit)), lambda s: s)
    near = near.withColumn("_c", F.explode(cut)).withColumn("_s", F.explode(shifts)).withColumn("_q", (F.col("_c.p") + F.col("_s")).cast("int"))
    near = near.filter((F.col("_q") >= 1) & (F.col("_q") + F.col("_c.l") - 1 <= F.col("_m")))
    near = near.select(b, "_y", "_n", F.col("_c.i").alias("_i"), F.substring(F.col("_y"), F.col("_q"), F.col("_c.l")).alias("_piece")).distinct()
    met = x.join(near, ["_n", "_i", "_piece"]).select(a, b, "_x", "_y").distinct()
    return met.withColumn("distance", F.levenshtein("_x", "_y", limit)).filter("distance >= 0").select(a, b, "distance")


#: Dictionary entries up to which an automaton is sent to all executors.
AUTOMATON = 500_000
#: Texts that are Python strings at once, and rows of results that are held.
TEXTS, HELD = 64, 50_000


def _over_texts(texts: DataFrame, key: str, text: str, found: Callable[[str], Iterable[tuple]], schema: str, types: list[pa.DataType]) -> DataFrame:
    """(key, *row) for the rows that found makes of each text. What is held does not grow with the Arrow batch or the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, held = [batch.schema.field(0).type, *types], []
            made = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=names)  # noqa: B023, E731
            for lo in range(0, batch.num_rows, TEXTS):
                part = batch.slice(lo, TEXTS)
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for row in found(t) if t else ():
                        held.append((k, *row))
                        if len(held) == HELD:
                            yield made()
                            held.clear()
            if held:
                yield made()

    names = [c.split()[0] for c in schema.split(", ")]
    return texts.select(key, text).mapInArrow(run, schema)


def multi_pattern(texts: DataFrame, entries: DataFrame, key: str, text: str = "text", entry: str = "entry", limit: int = AUTOMATON) -> DataFrame:
    """(key, pos, entry): every place (from 0) of every entry, overlaps too.

    One automaton of a checked size runs over each text once; a larger dictionary meets the texts' substrings of the
    entries' lengths by hash join.
    """
    known = entries.select(entry).filter(F.length(entry) > 0).distinct()
    if known.limit(limit + 1).count() > limit:
        return _multi_pattern_join(texts, known, key, text, entry)
    words = [r[0] for r in known.collect()]
    kind = texts.schema[key].dataType.simpleString()

    places = _places(words)

    def found(t: str) -> Iterator[tuple[int, str]]:
        return ((end - len(w) + 1, w) for end, w in places(t))

    return _over_texts(texts, key, text, found, f"{key} {kind}, pos int, {entry} string", [pa.int32(), pa.string()])


def _places(words: list[str]) -> Callable[[str], Iterable[tuple[int, str]]]:
    """The (end, word) of every place in a text; the automaton is made once a task, where it runs."""
    made: list[ahocorasick.Automaton] = []

    def places(t: str) -> Iterable[tuple[int, str]]:
        if not words:
            return ()
        if not made:
            automaton = ahocorasick.Automaton()
            for w in words:
                automaton.add_word(w, w)
            automaton.make_automaton()
            made.append(automaton)
        return made[0].iter(t)

    return places


def multi_pattern_counts(texts: DataFrame, entries: DataFrame, key: str, text: str = "text", entry: str = "entry", limit: int = AUTOMATON) -> DataFrame:
    """(key, entry, places, first): how often each entry occurs in each text, and where first; counted where the text is."""
    known = entries.select(entry).filter(F.length(entry) > 0).distinct()
    if known.limit(limit + 1).count() > limit:
        return _multi_pattern_join(texts, known, key, text, entry).groupBy(key, entry).agg(F.count("*").alias("places"), F.min("pos").alias("first"))
    words = [r[0] for r in known.collect()]
    kind = texts.schema[key].dataType.simpleString()

    places = _places(words)

    def found(t: str) -> Iterator[tuple[str, int, int]]:
        seen: dict[str, list[int]] = {}
        for end, w in places(t):
            if (of := seen.get(w)) is None:
                seen[w] = [1, end - len(w) + 1]
            else:
                of[0] += 1
        return ((w, n, first) for w, (n, first) in seen.items())

    each = _over_texts(texts, key, text, found, f"{key} {kind}, {entry} string, places long, first int", [pa.string(), pa.int64(), pa.int32()])
    return each.groupBy(key, entry).agg(F.sum("places").alias("places"), F.min("first").alias("first"))  # a key may be in several rows


def _multi_pattern_join(texts: DataFrame, entries: DataFrame, key: str, text: str, entry: str) -> DataFrame:
    sizes = entries.select(F.length(entry).alias("_n")).distinct()
    at = texts.select(key, text).crossJoin(F.broadcast(sizes)).filter(F.length(text) >= F.col("_n"))
    at = at.select(key, text, "_n", F.explode(F.sequence(F.lit(1), F.length(text) - F.col("_n") + 1)).alias("_p"))
    at = at.select(key, (F.col("_p") - 1).alias("pos"), F.substring(F.col(text), F.col("_p"), F.col("_n")).alias(entry))
    return at.join(entries, entry).select(key, "pos", entry)


def frequent_prefixes(keys: DataFrame, key: str, support: int, limit: int) -> DataFrame:
    """(prefix, n): prefixes of 1 to limit characters of at least support keys, repeats counted."""
    each = keys.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.length(key), F.lit(limit)), F.lit(1))), lambda n: F.substring(F.col(key), F.lit(1), n))).alias("prefix"))
    return each.filter("prefix <> ''").groupBy("prefix").agg(F.count("*").alias("n")).filter(F.col("n") >= support)


def set_prefix(keys: DataFrame, key: str) -> DataFrame:
    """One row: the longest common prefix of all keys, which is that of the least and the greatest."""
    return keys.agg(F.min(key).alias("_a"), F.max(key).alias("_b")).select(common_prefix(F.col("_a"), F.col("_b")).alias("prefix"))


def insertion_point(keys: DataFrame, needles: DataFrame, key: str, needle: str) -> DataFrame:
    """(needle, pos, found): keys below each distinct needle, and whether it is one.

    Keys are counted by value and put in order together with the needles, range by range.
    """
    counts = keys.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n")).withColumn("_side", F.lit(1))
    asked = needles.select(F.col(needle).alias("_k"), F.lit(0).cast("long").alias("_n"), F.lit(0).alias("_side")).distinct()
    both = running_by(counts.unionByName(asked), ["_k", "_side"], F.col("_n"), inclusive=False)
    here = counts.select("_k", F.lit(True).alias("found"))
    return both.filter("_side = 0").join(here, "_k", "left").select(F.col("_k").alias(needle), F.col("running").alias("pos"), F.coalesce("found", F.lit(False)).alias("found"))


def transitions(keys: DataFrame, key: str) -> DataFrame:
    """(state, symbol, next, final) of the automaton of a set of keys; a state is named by the prefix that leads to it."""
    known = keys.select(F.col(key).alias("_k")).filter("_k is not null").distinct()
    cut = lambda n: F.substring(F.col("_k"), F.lit(1), n)
    steps = F.transform(F.sequence(F.lit(1), F.length("_k")), lambda n: F.struct(cut(n - 1).alias("state"), F.substring(F.col("_k"), n, F.lit(1)).alias("symbol"), cut(n).alias("next"), (n == F.length("_k")).alias("final")))
    each = known.filter(F.length("_k") > 0).select(F.explode(steps).alias("x")).select("x.*")
    return each.groupBy("state", "symbol", "next").agg(F.max("final").alias("final"))


def accepts(probes: DataFrame, keys: DataFrame, probe: str, key: str) -> DataFrame:
    """probes with steps, the transitions that an automaton of the keys takes before it is stuck, and accepted."""
    known = keys.select(F.col(key).alias("_k")).filter("_k is not null").distinct()
    states = known.select(F.explode(F.transform(F.sequence(F.lit(0), F.length("_k")), lambda n: F.substring(F.col("_k"), F.lit(1), n))).alias("_s")).distinct()
    each = probes.select(probe).distinct()
    cut = each.select(probe, F.explode(F.transform(F.sequence(F.lit(0), F.length(probe)), lambda n: F.substring(F.col(probe), F.lit(1), n))).alias("_s"))
    steps = cut.join(states, "_s").groupBy(probe).agg(F.max(F.length("_s")).alias("steps"))
    final = known.select(F.col("_k").alias(probe), F.lit(True).alias("accepted"))
    out = probes.join(steps, probe, "left").join(final, probe, "left")
    return out.withColumn("steps", F.coalesce("steps", F.lit(0))).withColumn("accepted", F.coalesce("accepted", F.lit(False)))
