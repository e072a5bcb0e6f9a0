"""Text functions as column expressions.

Words are runs of ASCII letters, digits and underscores. Functions that count or
index bytes read a string's UTF-8 as one ISO-8859-1 character per byte.
"""

from __future__ import annotations

import os.path
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word, the ASCII letters, ASCII white space, ASCII punctuation without the underscore.
WORD = "[A-Za-z0-9_]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE_CLASS = r"[ \t\n\x0B\f\r]"
PUNCTUATION = r"""[!-/:-@\[-^`{-~]"""
#: First and last code points of the double-width ranges.
WIDE = [
    (0x1100, 0x115F), (0x2E80, 0x2EFF), (0x2F00, 0x2FDF), (0x3000, 0x303F), (0x3040, 0x309F), (0x30A0, 0x30FF), (0x3100, 0x312F), (0x3130, 0x318F), (0x3190, 0x319F), (0x31A0, 0x31BF), (0x31C0, 0x31EF), (0x31F0, 0x31FF),
    (0x3200, 0x32FF), (0x3300, 0x33FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA000, 0xA48F), (0xA490, 0xA4CF), (0xAC00, 0xD7AF), (0xF900, 0xFAFF), (0xFE10, 0xFE1F), (0xFE30, 0xFE4F), (0xFE50, 0xFE6F), (0xFF00, 0xFFEF),
    (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2F800, 0x2FA1F),
]
#: Fixed value: Unicode's White_Space characters, as a class that Java's and RE2's patterns read alike.
UNICODE_SPACE = r"[\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def as_bytes(text: Column) -> Column:
    """One character per UTF-8 byte."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def ascii_upper(text: Column) -> Column:
    return F.translate(text, LOWER, UPPER)


def unicode_words(text: Column) -> Column:
    """Lower-cased words between Unicode white space, by Unicode's full case mapping."""
    return F.filter(F.split(F.lower(text), UNICODE_SPACE + "+"), lambda w: w != "")


_STRETCH = re.compile(rb"[A-Za-z0-9_]+|[^A-Za-z0-9_]+")


def boundaries(text: Column) -> Column:
    """Byte offsets at which the word class changes, with 0 and the length; an empty text has 0 alone."""

    @F.pandas_udf("array<int>")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda t: None if t is None else [0, *(m.end() for m in _STRETCH.finditer(t.encode()))])

    return run(text)


def find(text: Column, needle: str) -> Column:
    """0-based byte offset of the first occurrence, null if absent, 0 for an empty needle."""
    at = F.instr(as_bytes(text), needle.encode().decode("latin-1"))
    return F.lit(0) if not needle else F.when(at > 0, at - 1)


def find_all(text: Column, needle: str, most: int | None = None) -> Column:
    """0-based character places of all occurrences (the first most of them), overlapping ones too; none for an empty needle."""

    def places(t: str) -> list[int]:
        out, at = [], t.find(needle)
        while at >= 0 and (most is None or len(out) < most):
            out.append(at)
            at = t.find(needle, at + 1)
        return out

    @F.pandas_udf("array<int>")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda t: None if t is None else places(t) if needle else [])

    return run(text)


def bytes_of(text: Column) -> Column:
    """The UTF-8 bytes as numbers, in an array."""
    return F.transform(F.filter(F.split(as_bytes(text), ""), lambda c: c != ""), lambda c: F.ascii(c))


def find_any(text: Column, needles: bytes) -> Column:
    """(pos, byte) of every byte that is one of needles, positions from 0."""
    each = F.transform(bytes_of(text), lambda b, i: F.struct(i.alias("pos"), b.alias("byte")))
    return F.filter(each, lambda x: x["byte"].isin(list(needles)))


def prefix_key(text: Column) -> Column:
    """The first eight bytes as an unsigned little-endian number (decimal); missing bytes are 0. It does not keep the order."""
    digits = F.rpad(F.hex(F.substring(F.encode(text, "UTF-8"), 1, 8)), 16, "0")
    turned = F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(8)])
    return F.conv(turned, 16, 10).cast("decimal(20,0)")


def fixed_length(text: Column, size: int) -> Column:
    """text, which may have size bytes at most; a longer one fails the query."""
    return F.when(F.octet_length(text) > size, F.raise_error(F.concat(F.lit(f"longer than {size} bytes: "), text))).otherwise(text)


def code_points(text: Column) -> Column:
    """The code points of a text, characters beyond U+FFFF too."""
    digits = F.hex(F.encode(text, "UTF-32"))
    return F.transform(F.regexp_extract_all(digits, F.lit(".{8}"), F.lit(0)), lambda d: F.conv(d, 16, 10).cast("int"))


def printable(text: Column) -> Column:
    """Whether there is no control character but tabs, line feeds and carriage returns."""
    return F.regexp_count(text, F.lit(r"[\p{Cc}&&[^\t\n\r]]")) == 0


def like_pattern(wildcard: str) -> str:
    """A LIKE pattern of a wildcard pattern: * any run, ? one character."""
    return "".join({"*": "%", "?": "_", "%": r"\%", "_": r"\_", "\\": r"\\"}.get(c, c) for c in wildcard)


def wildcard(text: Column, pattern: str) -> Column:
    return text.like(like_pattern(pattern))


def split_drop(text: Column, separator: str) -> Column:
    """Fields between one-byte separators; a last empty field is dropped, an empty text has none."""
    parts = F.split(text, "\\Q" + separator + "\\E", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def split_keep(text: Column, separator: str) -> Column:
    """Fields between separators, all of them."""
    return F.split(text, "\\Q" + separator + "\\E", -1)


def keep_class(text: Column, name: str, chars: str = "") -> Column:
    """alpha, digit, alnum, no_space, keep (chars), remove (chars): the characters that stay."""
    patterns = {"alpha": "[^A-Za-z]", "digit": "[^0-9]", "alnum": "[^A-Za-z0-9]", "no_space": SPACE_CLASS}
    if name == "remove":
        return F.translate(text, chars, "")
    if name == "keep":
        return F.regexp_replace(text, "[^" + "".join("\\" + c if not c.isalnum() else c for c in chars) + "]", "")
    return F.regexp_replace(text, patterns[name], "")


def class_mask(text: Column, pattern: str) -> Column:
    """For each byte, whether it is of the class."""
    return F.transform(F.filter(F.split(as_bytes(text), ""), lambda c: c != ""), lambda c: c.rlike(pattern))


def unicode_profile(text: Column) -> Column:
    """Counts of kinds of characters, of four ranges of code points, and a complexity score."""
    chars, size = F.char_length(text), F.octet_length(text)
    in_range = lambda a, b: F.regexp_count(text, F.lit(f"[\\x{{{a:x}}}-\\x{{{b:x}}}]"))
    ascii_ = in_range(0, 0x7F)
    score = F.when(chars == 0, 0.0).otherwise(0.7 * (chars - ascii_) / chars + F.least(F.lit(0.3), (size / chars - 1) / 3 * 0.3))
    return F.struct(
        size.alias("bytes"), chars.alias("chars"), ascii_.alias("ascii"), F.regexp_count(text, F.lit(r"\p{IsAlphabetic}")).alias("alphabetic"), F.regexp_count(text, F.lit(r"\p{N}")).alias("numeric"),
        F.regexp_count(text, F.lit(r"\p{IsWhite_Space}")).alias("whitespace"), F.regexp_count(text, F.lit(r"\p{Cc}")).alias("control"),
        in_range(0x80, 0xFF).alias("latin"), in_range(0x100, 0x17FF).alias("middle"), in_range(0x1800, 0x10FFFF).alias("high"), score.alias("score"),
    )


def display_width(text: Column) -> Column:
    """Columns on a terminal: 0 for control characters, 2 for the wide ranges, else 1."""
    wide = "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in WIDE) + "]"
    return F.char_length(text) - F.regexp_count(text, F.lit(r"\p{Cc}")) + F.regexp_count(text, F.lit(wide))


def integer_key(text: Column) -> Column:
    """Order key of an integer written in digits: null if it is none; -0 is below 0; any length."""
    sign = F.regexp_extract(text, r"^([+-]?)([0-9]+)$", 1)
    digits = F.regexp_replace(F.regexp_extract(text, r"^([+-]?)([0-9]+)$", 2), "^0+(?=[0-9])", "")
    size = F.length(digits)
    flip = F.translate(digits, "0123456789", "9876543210")
    key = F.struct(F.when(sign == "-", -1).otherwise(1).alias("sign"), F.when(sign == "-", -size).otherwise(size).alias("size"), F.when(sign == "-", flip).otherwise(digits).alias("digits"))
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), key)


def real_key(text: Column) -> Column:
    """Order key of a decimal number in normal form; null if it is none."""
    good = text.rlike(r"^[+-]?[0-9]*\.?[0-9]*$") & text.rlike("[0-9.]")
    negative = text.startswith("-")
    body = F.regexp_replace(text, "^[+-]", "")
    whole = F.length(F.substring_index(body, ".", 1))
    flip = F.concat(F.translate(body, "0123456789", "9876543210"), F.lit("~"))
    key = F.struct(F.when(negative, -1).otherwise(1).alias("sign"), F.when(negative, -whole).otherwise(whole).alias("whole"), F.when(negative, flip).otherwise(body).alias("text"))
    return F.when(good, key)


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1; null if either is."""
    return F.when(a.isNull() | b.isNull(), None).when(a < b, -1).when(a > b, 1).otherwise(0)


def hex_lower(data: Column) -> Column:
    return F.lower(F.hex(data))


def unhex_strict(text: Column) -> Column:
    """The bytes; null for an odd length or a bad digit."""
    return F.when((F.length(text) % 2 == 0) & text.rlike("^[0-9A-Fa-f]*$"), F.unhex(text))


def common_prefix(a: Column, b: Column) -> Column:
    """The longest common prefix of two strings."""

    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else os.path.commonprefix([x, y]) for x, y in zip(a, b)], dtype=object)

    return run(a, b)
