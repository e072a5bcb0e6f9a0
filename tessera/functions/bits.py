"""Bit functions and size rules of integer codes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bit_width(x: Column) -> Column:
    """Bits of a non-negative number; 0 has none."""
    return F.when(x == 0, 0).otherwise(F.length(F.bin(x)))


def leading_zeros(x: Column) -> Column:
    return 64 - bit_width(x)


def trailing_zeros(x: Column) -> Column:
    return F.when(x == 0, 64).otherwise(F.length(F.bin(x)) - F.length(F.rtrim(F.translate(F.bin(x), "0", " "))))


def bit_get(word: Column, pos: Column) -> Column:
    """Bit number pos of a 64-bit word; null outside."""
    return F.when(pos.between(0, 63), F.call_function("shiftrightunsigned", word, pos.cast("int")).bitwiseAND(F.lit(1)).cast("int"))


def count_ones_range(word: Column, start: Column, size: Column) -> Column:
    """Ones among size bits of a word from start on, clipped at its end."""
    n = F.least(size, 64 - start).cast("int")
    low = F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), 64 - n)
    rest = F.call_function("shiftrightunsigned", word, F.least(start, F.lit(63)).cast("int"))
    return F.when((start >= 64) | (size <= 0), 0).otherwise(F.bit_count(rest.bitwiseAND(low)))


def ones_run(word: Column, pos: Column) -> Column:
    """Ones on end from bit pos of a word on."""
    rest = F.call_function("shiftrightunsigned", word, pos.cast("int"))
    return F.least(trailing_zeros(F.bitwise_not(rest)), 64 - pos).cast("int")


def reverse(x: Column) -> Column:
    """The 64 bits in the opposite order, as an unsigned number (decimal)."""
    return F.conv(F.reverse(F.lpad(F.bin(x), 64, "0")), 2, 10).cast("decimal(20,0)")


def hash_combine(h: Column, value: Column) -> Column:
    """A hash turned left by five bits plus the next value, modulo 2^64."""
    low, up = F.lit(0xFFFFFFFF), lambda x: F.shiftrightunsigned(x, 32)
    turned = F.shiftleft(h, 5).bitwiseOR(F.shiftrightunsigned(h, 59))
    a = turned.bitwiseAND(low) + value.bitwiseAND(low)
    b = up(turned) + up(value) + up(a)
    return F.shiftleft(b, 32).bitwiseOR(a.bitwiseAND(low))


def field(x: Column, offset: int, bits: int) -> Column:
    """bits bits of x from offset on."""
    return F.shiftright(x, offset).bitwiseAND(F.lit((1 << bits) - 1))


def extract(x: Column, mask: int) -> Column:
    """The bits of x under mask, moved together (PEXT)."""
    places = [i for i in range(63) if mask >> i & 1]
    return sum((F.shiftleft(F.shiftright(x, p).bitwiseAND(F.lit(1).cast("long")), i) for i, p in enumerate(places)), F.lit(0).cast("long"))


def deposit(x: Column, mask: int) -> Column:
    """The low bits of x, moved apart to the places of mask (PDEP)."""
    places = [i for i in range(63) if mask >> i & 1]
    return sum((F.shiftleft(F.shiftright(x, i).bitwiseAND(F.lit(1).cast("long")), p) for i, p in enumerate(places)), F.lit(0).cast("long"))


def interleave(x: Column, y: Column, bits: int = 31) -> Column:
    """Z-order key: the bits of x at even places, of y at odd ones."""
    one = F.lit(1).cast("long")
    return sum(
        (F.shiftleft(F.shiftright(x.cast("long"), i).bitwiseAND(one), 2 * i) + F.shiftleft(F.shiftright(y.cast("long"), i).bitwiseAND(one), 2 * i + 1) for i in range(bits)),
        F.lit(0).cast("long"),
    )


def zigzag(x: Column) -> Column:
    """Signed to unsigned: 0, -1, 1, -2 become 0, 1, 2, 3."""
    return F.shiftleft(x.cast("long"), 1).bitwiseXOR(F.shiftright(x.cast("long"), 63))


def varint_size(x: Column) -> Column:
    """Bytes of a non-negative number in groups of seven bits."""
    return F.greatest(F.ceil(bit_width(x) / 7), F.lit(1)).cast("int")


def byte_class(x: Column) -> Column:
    """Bytes of a 32-bit number without leading zero bytes, 1 at least."""
    return F.greatest(F.ceil(bit_width(x) / 8), F.lit(1)).cast("int")


def streamvbyte_size(values: Column) -> Column:
    """Bytes of an array in a byte-oriented code: one control byte for four values, and their bytes."""
    return (F.ceil(F.size(values) / 4) + F.aggregate(values, F.lit(0), lambda a, x: a + byte_class(x))).cast("int")


def varint_choice(values: Column) -> Column:
    """Which integer code suits an array: group, delta, compact or leb128."""
    n = F.size(values)
    below = lambda limit: F.forall(values, lambda x: x < limit)
    return F.when((n >= 16) & below(1 << 32), "group").when((n > 6) & (values == F.array_sort(values)), "delta").when(below(256), "compact").otherwise("leb128")


def fieldnorm_encode(length: Column) -> Column:
    """One byte for a length: exact below 16, then four significant bits; monotone."""
    shift = (F.length(F.bin(length)) - 4).cast("int")
    return F.when(length < 8, length).otherwise(F.expr("0") + (shift + 1) * 8 + F.call_function("shiftright", length, shift).bitwiseAND(F.lit(7))).cast("int")


def fieldnorm_decode(code: Column) -> Column:
    """The least length of a code's bucket; 2^32 - 1 beyond."""
    shift = F.shiftright(code.cast("int"), 3) - 1
    value = F.call_function("shiftleft", (F.lit(8) + code % 8).cast("long"), F.greatest(shift, F.lit(0)))
    return F.when(code < 8, code.cast("long")).when(shift >= 29, F.lit(4294967295)).otherwise(value)


def posting_encoding(n: Column, span: Column) -> Column:
    """Which layout suits a posting list of n ids over a span."""
    return F.when(n <= 64, "dense").when(span <= 2 * n, "clustered").when(n <= 256, "ef").when(n <= 4096, "pef").otherwise("opef")


_ANY = (None, None)
#: Kinds of matches by the range of the backward distance and of the length, the first that fits, with their bytes.
MATCHES = [
    ("Literal", _ANY, (1, 1), 2),
    ("RLE", (1, 1), (None, 33), 1),
    ("NearShort", (2, 9), (None, 5), 1),
    ("Far1Short", (2, 257), (None, 33), 2),
    ("Far2Short", (258, 65793), (None, 33), 3),
    ("Far2Long", (None, 65535), (34, 64), 3),
    ("Far2Long", (None, 65535), (65, None), 6),
    ("Far3Long", _ANY, (None, 35), 4),
    ("Far3Long", _ANY, (36, None), 7),
]


def match_cost(distance: Column, length: Column) -> Column:
    """(kind, bytes) of a copy of length bytes from distance bytes back."""

    def within(x: Column, least: int | None, most: int | None) -> Column:
        return (x >= least if least is not None else F.lit(True)) & (x <= most if most is not None else F.lit(True))

    out = F.lit(None)
    for kind, d, n, cost in reversed(MATCHES):
        out = F.when(within(distance, *d) & within(length, *n), F.struct(F.lit(kind).alias("kind"), F.lit(cost).alias("bytes"))).otherwise(out)
    return F.when(distance.isNotNull() & length.isNotNull(), out)
