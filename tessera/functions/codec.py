"""Codecs and checksums as Arrow-batched functions on binary columns.

Decoders of damaged data raise; a null stays null. Encoded forms are this
library's own unless a standard is named.
"""

from __future__ import annotations

import functools
import heapq
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.operators.suffixes import Dictionary

#: Fixed value: the reversed Castagnoli polynomial.
CASTAGNOLI = 0x82F63B78


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = (i >> 1) ^ (CASTAGNOLI if i & 1 else 0)
        out.append(i)
    return out


_CRC = _crc_table()


def crc32c_of(datas: list[bytes]) -> np.ndarray:
    """Checksums of all data, a byte of each at a time; data of like lengths go together."""
    table, out = np.array(_CRC, np.uint32), np.zeros(len(datas), np.uint32)
    sizes = np.array([len(d) for d in datas], np.int64)
    order = np.argsort(-sizes, kind="stable")
    crc = np.full(len(datas), 0xFFFFFFFF, np.uint32)
    flat = np.frombuffer(b"".join(datas), np.uint8)
    start = (np.cumsum(sizes) - sizes)[order]
    live = sizes[order]
    n = len(datas)
    for i in range(int(sizes.max(initial=0))):
        n = int(np.searchsorted(-live[:n], -i, "left"))  # those with more than i bytes stand first
        crc[:n] = table[(crc[:n] ^ flat[start[:n] + i]) & 0xFF] ^ (crc[:n] >> np.uint32(8))
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def varint_bytes(values: list[int]) -> bytes:
    """LEB128 of non-negative numbers."""
    out = bytearray()
    for v in values:
        if v < 0:
            raise ValueError("varints are of non-negative numbers; use zigzag first")
        while v > 127:
            out.append(v & 127 | 128)
            v >>= 7
        out.append(v)
    return bytes(out)


def varint_values(data: bytes) -> list[int]:
    out, v, shift = [], 0, 0
    for b in data:
        v |= (b & 127) << shift
        shift += 7
        if b < 128:
            out.append(v)
            v, shift = 0, 0
    if shift:
        raise ValueError("truncated varint")
    return out


def streamvbyte_bytes(values: list[int]) -> bytes:
    """Control bytes (two bits a value: its bytes less one), then the bytes of all values."""
    sizes = [max(1, (v.bit_length() + 7) // 8) for v in values]
    control = bytearray((len(values) + 3) // 4)
    for i, n in enumerate(sizes):
        control[i // 4] |= (n - 1) << (i % 4 * 2)
    return len(values).to_bytes(4, "little") + bytes(control) + b"".join(v.to_bytes(n, "little") for v, n in zip(values, sizes))


def streamvbyte_values(data: bytes) -> list[int]:
    n = int.from_bytes(data[:4], "little")
    at, out = 4 + (n + 3) // 4, []
    for i in range(n):
        size = (data[4 + i // 4] >> (i % 4 * 2) & 3) + 1
        out.append(int.from_bytes(data[at : at + size], "little"))
        at += size
    if at != len(data):
        raise ValueError("damaged integers")
    return out


def zigzag_varint_bytes(values: list[int]) -> bytes:
    """Varints of signed numbers."""
    return varint_bytes([v << 1 if v >= 0 else (-v << 1) - 1 for v in values])


def zigzag_varint_values(data: bytes) -> list[int]:
    return [(v >> 1) ^ -(v & 1) for v in varint_values(data)]


def delta_bytes(values: list[int]) -> bytes:
    """The first value and differences, as signed varints."""
    return zigzag_varint_bytes([b - a for a, b in zip([0, *values], values)])


def delta_values(data: bytes) -> list[int]:
    return np.cumsum(np.array(zigzag_varint_values(data), np.int64)).tolist()


def group_varint_bytes(values: list[int]) -> bytes:
    """Groups of four 32-bit numbers: a byte with two bits a number (its bytes less one), then their bytes."""
    out = bytearray(len(values).to_bytes(4, "little"))
    for i in range(0, len(values), 4):
        part = values[i : i + 4]
        sizes = [max(1, (v.bit_length() + 7) // 8) for v in part]
        if min(part) < 0 or max(sizes) > 4:
            raise ValueError("groups hold 32-bit numbers")
        out.append(sum((n - 1) << (2 * k) for k, n in enumerate(sizes)))
        for v, n in zip(part, sizes):
            out += v.to_bytes(n, "little")
    return bytes(out)


def group_varint_values(data: bytes) -> list[int]:
    n, at, out = int.from_bytes(data[:4], "little"), 4, []
    while len(out) < n:
        control, at = data[at], at + 1
        for k in range(min(4, n - len(out))):
            size = (control >> (2 * k) & 3) + 1
            out.append(int.from_bytes(data[at : at + size], "little"))
            at += size
    if at != len(data):
        raise ValueError("damaged integers")
    return out


def prefix_free_bytes(values: list[int]) -> bytes:
    """Each number after a byte with its size."""
    return b"".join(bytes([n]) + v.to_bytes(n, "little") for v, n in ((v, (v.bit_length() + 7) // 8) for v in values))


def prefix_free_values(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        n = data[at]
        if at + 1 + n > len(data):
            raise ValueError("truncated integer")
        out.append(int.from_bytes(data[at + 1 : at + 1 + n], "little"))
        at += 1 + n
    return out


def bit_packed_bytes(values: list[int]) -> bytes:
    """Number, least value and bits a value, then the values less the least, packed."""
    if not len(values):
        return b"\0" * 13
    least = min(values)
    width = (max(values) - least).bit_length()
    rest = np.array([v - least for v in values], np.uint64)
    planes = (rest[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return len(values).to_bytes(4, "little") + least.to_bytes(8, "little", signed=True) + bytes([width]) + np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def bit_packed_values(data: bytes) -> list[int]:
    n, least, width = int.from_bytes(data[:4], "little"), int.from_bytes(data[4:12], "little", signed=True), data[12]
    if len(data) != 13 + (n * width + 7) // 8:
        raise ValueError("damaged integers")
    planes = np.unpackbits(np.frombuffer(data, np.uint8, offset=13), count=n * width, bitorder="little").reshape(n, width).astype(np.uint64)
    rest = (planes << np.arange(width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) if width else np.zeros(n, np.uint64)
    return [int(v) + least for v in rest]


def interleaved_bytes(form: str, ways: int, data: bytes) -> bytes:
    """Every ways-th byte is a stream of its own: sizes of the coded streams, and the streams."""
    parts = [BYTE_FORMS[form][0]()(data[i::ways]) for i in range(ways)]
    return b"".join(len(p).to_bytes(4, "little") for p in parts) + b"".join(parts)


def interleaved_data(form: str, ways: int, coded: bytes) -> bytes:
    sizes = [int.from_bytes(coded[4 * i : 4 * i + 4], "little") for i in range(ways)]
    ends = np.cumsum([4 * ways, *sizes]).tolist()
    if ends[-1] != len(coded):
        raise ValueError("damaged streams")
    parts = [BYTE_FORMS[form][1]()(coded[i:j]) for i, j in zip(ends[:-1], ends[1:])]
    out = bytearray(sum(map(len, parts)))
    for i, p in enumerate(parts):
        out[i::ways] = p
    return bytes(out)


def huffman_o1_bytes(data: bytes, order: int = 1) -> bytes:
    """A Huffman code for each context, the order bytes before (zeros before the first)."""
    padded, n = bytes(order) + data, len(data)
    streams: dict[bytes, bytearray] = {}
    for i in range(n):
        streams.setdefault(padded[i : i + order], bytearray()).append(data[i])
    coded = {c: huffman_bytes(bytes(x)) for c, x in streams.items()}
    body = n.to_bytes(4, "little") + len(coded).to_bytes(4, "little")
    body += b"".join(c + len(coded[c]).to_bytes(4, "little") + coded[c] for c in sorted(coded))
    return zstandard.ZstdCompressor().compress(body)  # most code lengths are 0


def huffman_o1_data(coded: bytes, order: int = 1) -> bytes:
    body = zstandard.ZstdDecompressor().decompress(coded)
    n, kinds, at, streams = int.from_bytes(body[:4], "little"), int.from_bytes(body[4:8], "little"), 8, {}
    for _ in range(kinds):
        size = int.from_bytes(body[at + order : at + order + 4], "little")
        streams[body[at : at + order]] = iter(huffman_data(body[at + order + 4 : at + order + 4 + size]))
        at += order + 4 + size
    out = bytearray(order)
    for _ in range(n):
        out.append(next(streams[bytes(out[len(out) - order :])]))
    return bytes(out[order:])


#: The least match that a match stream takes from its dictionary.
LEAST_MATCH = 4


def match_stream_bytes(words: Dictionary, data: bytes) -> bytes:
    """Runs of literals and copies from a dictionary by turns: varints of a run's size, its bytes, a copy's size and place."""
    out, literal, at = bytearray(varint_bytes([len(data)])), bytearray(), 0
    while at < len(data):
        place, size = words.longest(data, at)
        if size < LEAST_MATCH:
            literal.append(data[at])
            at += 1
            continue
        out += varint_bytes([len(literal)]) + literal + varint_bytes([size, place])
        literal, at = bytearray(), at + size
    return bytes(out + varint_bytes([len(literal)]) + literal)


def match_stream_data(words: bytes, coded: bytes) -> bytes:
    at = 0

    def number() -> int:
        nonlocal at
        end = at
        while coded[end] > 127:
            end += 1
        value = varint_values(coded[at : end + 1])[0]
        at = end + 1
        return value

    total, out = number(), bytearray()
    while True:
        n = number()
        out += coded[at : at + n]
        at += n
        if at == len(coded):
            break
        size, place = number(), number()
        out += words[place : place + size]
    if len(out) != total:
        raise ValueError("damaged match stream")
    return bytes(out)


def _code_lengths(counts: Counter) -> dict[int, int]:
    if len(counts) == 1:
        return {next(iter(counts)): 1}
    heap = [(n, i, (b,)) for i, (b, n) in enumerate(sorted(counts.items()))]
    heapq.heapify(heap)
    size, nr = Counter(), len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for x in a[2] + b[2]:
            size[x] += 1
        heapq.heappush(heap, (a[0] + b[0], nr, a[2] + b[2]))
        nr += 1
    return dict(size)


def _canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    code, last, out = 0, 0, {}
    for n, b in sorted((n, b) for b, n in lengths.items()):
        code <<= n - last
        out[b], last, code = (code, n), n, code + 1
    return out


def _lengths(table: bytes) -> dict[int, int]:
    return {b: table[b] for b in np.flatnonzero(np.frombuffer(table, np.uint8)).tolist()}


@functools.lru_cache(maxsize=4096)
def _codes(table: bytes) -> dict[int, str]:
    """The bits of each byte's code, by 256 code lengths; contexts of few bytes have the same ones again and again."""
    return {b: format(code, f"0{n}b") for b, (code, n) in _canonical(_lengths(table)).items()}


@functools.lru_cache(maxsize=4096)
def _symbols(table: bytes) -> dict[int, int]:
    """The byte of each code with a one before it, which tells its length."""
    return {1 << n | code: b for b, (code, n) in _canonical(_lengths(table)).items()}


def huffman_bytes(data: bytes) -> bytes:
    """Canonical Huffman: length, 256 code lengths, bits."""
    if not data:
        return b"\0" * 4
    table = bytearray(256)
    if data.count(data[0]) == len(data):  # most contexts of a text: the code is a zero
        table[data[0]] = 1
        return len(data).to_bytes(4, "little") + table + bytes((len(data) + 7) // 8)
    for b, n in _code_lengths(Counter(data)).items():
        table[b] = n
    head = len(data).to_bytes(4, "little") + table
    codes = _codes(bytes(table))
    bits = "".join(map(codes.__getitem__, data))
    bits += "0" * (-len(bits) % 8)
    return head + int(bits, 2).to_bytes(len(bits) // 8, "big")


def huffman_data(coded: bytes) -> bytes:
    n = int.from_bytes(coded[:4], "little")
    if not n:
        return b""
    table = coded[4:260]
    kinds = table.translate(None, b"\0")
    if len(kinds) == 1 and kinds == b"\1":
        bits = coded[260:]
        if 8 * len(bits) < n or int.from_bytes(bits, "big") >> (8 * len(bits) - n):
            raise ValueError("damaged Huffman data")
        return table.index(1).to_bytes(1, "little") * n
    codes = _symbols(table)
    out, code = bytearray(), 1
    for bit in np.unpackbits(np.frombuffer(coded, np.uint8, offset=min(260, len(coded)))).tolist():
        code = code << 1 | bit
        if (b := codes.get(code)) is not None:
            out.append(b)
            code = 1
            if len(out) == n:
                return bytes(out)
    raise ValueError("damaged Huffman data")


RANS_BITS, RANS_LOW = 12, 1 << 31


def _shares(data: bytes) -> list[int]:
    """256 shares of 2^RANS_BITS, 1 at least for what occurs."""
    count, total = np.bincount(np.frombuffer(data, np.uint8), minlength=256), 1 << RANS_BITS
    share = np.where(count > 0, np.maximum(count * total // len(data), 1), 0)
    share[share.argmax()] += total - share.sum()
    return share.tolist()


def rans_bytes(data: bytes) -> bytes:
    """64-bit range asymmetric numeral system: length, shares, state, 32-bit words."""
    if not data:
        return b"\0" * 4
    share = _shares(data)
    start = np.concatenate([[0], np.cumsum(share)]).tolist()
    x, words = RANS_LOW, []
    for b in reversed(data):
        f = share[b]
        if x >= ((RANS_LOW >> RANS_BITS) << 32) * f:
            words.append(x & 0xFFFFFFFF)
            x >>= 32
        x = (x // f << RANS_BITS) + x % f + start[b]
    return len(data).to_bytes(4, "little") + np.array(share, "<u2").tobytes() + x.to_bytes(8, "little") + np.array(words[::-1], "<u4").tobytes()


def rans_data(coded: bytes) -> bytes:
    n = int.from_bytes(coded[:4], "little")
    if not n:
        return b""
    share = np.frombuffer(coded[4:516], "<u2")
    start = (np.cumsum(share) - share).tolist()
    symbol, share = np.repeat(np.arange(256, dtype=np.uint8), share).tobytes(), share.tolist()
    x, words, at, out = int.from_bytes(coded[516:524], "little"), np.frombuffer(coded[524:], "<u4").tolist(), 0, bytearray()
    mask = (1 << RANS_BITS) - 1
    for _ in range(n):
        b = symbol[x & mask]
        out.append(b)
        x = share[b] * (x >> RANS_BITS) + (x & mask) - start[b]
        if x < RANS_LOW and at < len(words):
            x, at = x << 32 | words[at], at + 1
    if x != RANS_LOW or at != len(words):
        raise ValueError("damaged data")
    return bytes(out)


FSE_BITS = 12


#: Places at which the states of one symbol after another lie.
_SPREAD = np.arange(1 << FSE_BITS) * ((1 << FSE_BITS >> 1) + (1 << FSE_BITS >> 3) + 3) & ((1 << FSE_BITS) - 1)


def _fse_order(share: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of all states by symbol and then place, the symbol of each, what is left of the state before)."""
    symbol = np.repeat(np.arange(256), share)
    spread = np.empty(1 << FSE_BITS, np.int64)
    spread[_SPREAD] = symbol
    first = np.cumsum(share) - share
    return np.argsort(spread, kind="stable"), symbol, np.arange(1 << FSE_BITS) - (first - share)[symbol]


def fse_bytes(data: bytes) -> bytes:
    """Tabled asymmetric numeral system: length, shares, last state, number of bits, bits."""
    if not data:
        return b"\0" * 4
    share = _shares(data)
    size = 1 << FSE_BITS
    following = (_fse_order(share)[0] + size).tolist()
    least = [FSE_BITS + 1 - f.bit_length() for f in share]
    place = (np.cumsum(share) - 2 * np.array(share)).tolist()  # of a symbol's states, less its share
    state, parts = size, []
    for b in reversed(data):
        bits = least[b]
        if state >> bits < share[b]:
            bits -= 1
        if bits:
            parts.append(format(state & ((1 << bits) - 1), f"0{bits}b"))
        state = following[place[b] + (state >> bits)]
    text = "".join(reversed(parts))
    body = int(text, 2).to_bytes((len(text) + 7) // 8, "big") if text else b""
    return len(data).to_bytes(4, "little") + np.array(share, "<u2").tobytes() + state.to_bytes(4, "little") + len(text).to_bytes(8, "little") + body


def fse_data(coded: bytes) -> bytes:
    n = int.from_bytes(coded[:4], "little")
    if not n:
        return b""
    order, by, left = _fse_order(np.frombuffer(coded[4:516], "<u2").tolist())
    width = FSE_BITS + 1 - np.frexp(left.astype(np.float64))[1]
    symbols, widths, bases = (np.empty(1 << FSE_BITS, np.int64) for _ in range(3))
    symbols[order], widths[order], bases[order] = by, width, (left << width) - (1 << FSE_BITS)
    symbols, widths, bases = symbols.tolist(), widths.tolist(), bases.tolist()
    state, size = int.from_bytes(coded[516:520], "little") - (1 << FSE_BITS), int.from_bytes(coded[520:528], "little")
    body = coded[528:]
    at, end = 8 * len(body) - size, 8 * len(body)
    if at < 0:
        raise ValueError("damaged data")
    out = bytearray()
    body += bytes(3)
    for _ in range(n):
        out.append(symbols[state])
        bits = widths[state]
        if at + bits > end:
            raise ValueError("damaged data")
        i = at >> 3
        state = bases[state] + ((body[i] << 16 | body[i + 1] << 8 | body[i + 2]) >> (24 - (at & 7) - bits) & ((1 << bits) - 1))
        at += bits
    if at != end or state:
        raise ValueError("damaged data")
    return bytes(out)


def dictionary(samples: list[bytes], size: int = 16384) -> bytes:
    """A zstd dictionary trained on a bounded list of samples; a raw one of their ends if they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _each(make: Callable[[], Callable], kind: str) -> Callable[[Column], Column]:
    """A function of single values, made once a batch."""

    @F.pandas_udf(kind)
    def run(column: pd.Series) -> pd.Series:
        f = make()
        return column.map(lambda x: None if x is None else f(x if isinstance(x, bytes) else x.tolist() if isinstance(x, np.ndarray) else x))

    return run


def encode_with(data: Column, words: bytes) -> Column:
    """zstd against a dictionary that all records share."""
    return _each(lambda: zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(words)).compress, "binary")(data)


def decode_with(data: Column, words: bytes) -> Column:
    return _each(lambda: zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words)).decompress, "binary")(data)


def encode_matches(data: Column, words: bytes) -> Column:
    """A match stream against a dictionary of bounded size, whose suffix array is made once a batch."""

    def make() -> Callable[[bytes], bytes]:
        known = Dictionary(words)
        return lambda x: match_stream_bytes(known, x)

    return _each(make, "binary")(data)


def decode_matches(data: Column, words: bytes) -> Column:
    return _each(lambda: lambda x: match_stream_data(words, x), "binary")(data)


def crc32c(data: Column) -> Column:
    @F.pandas_udf("long")
    def run(column: pd.Series) -> pd.Series:
        there = column.notna().to_numpy()
        out = pd.Series([None] * len(column), dtype="Int64")
        out[there] = crc32c_of([bytes(x) for x in column[there]]).astype(np.int64)
        return out

    return run(data)


#: Codecs of bytes, and of arrays of integers: makers of an encoder and a decoder.
BYTE_FORMS: dict[str, tuple[Callable, Callable]] = {
    "zstd": (lambda: zstandard.ZstdCompressor().compress, lambda: zstandard.ZstdDecompressor().decompress),
    "huffman": (lambda: huffman_bytes, lambda: huffman_data),
    "rans": (lambda: rans_bytes, lambda: rans_data),
    "fse": (lambda: fse_bytes, lambda: fse_data),
    "huffman_o1": (lambda: huffman_o1_bytes, lambda: huffman_o1_data),
    "huffman_o2": (lambda: lambda x: huffman_o1_bytes(x, 2), lambda: lambda x: huffman_o1_data(x, 2)),
}
for _form in ("huffman", "rans"):
    for _ways in (2, 4, 8):
        BYTE_FORMS[f"{_form}_x{_ways}"] = (lambda f=_form, w=_ways: lambda x: interleaved_bytes(f, w, x), lambda f=_form, w=_ways: lambda x: interleaved_data(f, w, x))
INTEGER_FORMS = {
    "varint": (varint_bytes, varint_values), "streamvbyte": (streamvbyte_bytes, streamvbyte_values), "zigzag": (zigzag_varint_bytes, zigzag_varint_values), "delta": (delta_bytes, delta_values),
    "group": (group_varint_bytes, group_varint_values), "prefix_free": (prefix_free_bytes, prefix_free_values), "bit_packed": (bit_packed_bytes, bit_packed_values),
}


def encode(data: Column, codec: str) -> Column:
    """One of BYTE_FORMS, or of arrays one of INTEGER_FORMS."""
    make = BYTE_FORMS[codec][0] if codec in BYTE_FORMS else lambda: INTEGER_FORMS[codec][0]
    return _each(make, "binary")(data)


def decode(data: Column, codec: str) -> Column:
    if codec in BYTE_FORMS:
        return _each(BYTE_FORMS[codec][1], "binary")(data)
    return _each(lambda: INTEGER_FORMS[codec][1], "array<long>")(data)


def codec_choice(bits: Column, size: Column, distinct: Column) -> Column:
    """Which codec suits data by entropy (bits a byte), length and number of distinct bytes."""
    return F.when(1 - distinct / 256 > 0.8, "dictionary").when((bits < 4) & (size > 1024), "fse").when((bits >= 4) & (bits <= 6) & (size > 256), "rans").otherwise("huffman")
