"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut where no match of the splitting pattern runs over: before
white space that follows something else, and where ASCII letters, digits and
signs meet (but not after an apostrophe, which may begin a contraction). A long
run of white space is a match of its own, but for its last character where more
text follows; it is encoded apart, since the library's matcher would try it
from every place. So the pieces' ids joined are the text's ids. Ids are turned
back to raw bytes, without a detour over UTF-8.

Edge cases: a null or empty text has no ids (n_tokens 0, decoded bytes empty);
null ids of documents and repeated rows pass through, one output row per input
row; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import each_row, id_text

#: Fixed value: the characters of Unicode's White_Space property, as the library's pattern takes them.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SIGN = r"!-&(-/:-@\[-`{-~"
_CUT = re.compile(rf"(?<=[^{_WHITE}])(?=[{_WHITE}])|(?<=[A-Za-z])(?=[0-9'{_SIGN}])|(?<=[0-9])(?=[A-Za-z'{_SIGN}])|(?<=[{_SIGN}])(?=[A-Za-z0-9])")
#: Characters after which a long text is cut at the next safe place, and of white space that are encoded apart.
STRIDE, BLANK = 1 << 16, 4096
_BLANKS = re.compile(rf"[{_WHITE}]{{{BLANK},}}")


class Codec(NamedTuple):
    """split: the encoding by its pattern; whole: the same ranks, with any text as one match."""

    split: tiktoken.Encoding
    whole: tiktoken.Encoding


@functools.lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str) -> Codec:
    """Encodings without special tokens; loaded once in each Python worker."""
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}
    return Codec(*(tiktoken.Encoding("tessera", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (pattern, r"[\s\S]+")))


def safe_parts(text: str, stride: int = STRIDE) -> Iterator[str]:
    """Parts of about stride characters whose joins no pattern match crosses; one longer match is a part with what is around it."""
    start = 0
    for run in [*_BLANKS.finditer(text), None]:
        stop = run.start() if run else len(text)
        while stop - start > stride:
            cut = _CUT.search(text, start + stride, stop)
            if cut is None or cut.start() == stop:
                break
            yield text[start : cut.start()]
            start = cut.start()
        if start < stop or not text:
            yield text[start:stop]
        if run:
            start = run.end() - (run.end() < len(text))
            yield text[stop:start]


def encode(codec: Codec, text: str) -> list[int]:
    if len(text) <= BLANK:
        return codec.split.encode_ordinary(text)
    return [i for part in safe_parts(text) for i in (codec.whole if _BLANKS.fullmatch(part) else codec.split).encode_ordinary(part)]


def decode(codec: Codec, ids: list[int]) -> bytes:
    return codec.split.decode_bytes(ids)


def encoded(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row."""

    def run(texts: list[str]) -> dict[str, list]:
        enc = encoding(rank_file, pattern)
        return {"ids": [encode(enc, t) for t in texts]}

    return each_row(id_text(docs, id_col, text_col), run, "ids array<int>")


def round_trip(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of every row."""

    def run(texts: list[str]) -> dict[str, list]:
        enc = encoding(rank_file, pattern)
        ids = [encode(enc, t) for t in texts]
        return {"n_tokens": [len(i) for i in ids], "ids": ids, "decoded_sha256": [hashlib.sha256(decode(enc, i)).hexdigest() for i in ids]}

    return each_row(id_text(docs, id_col, text_col), run, "n_tokens long, ids array<int>, decoded_sha256 string", chars=1_000_000)


def decoded(tokens: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, data binary): the bytes that each row's ids stand for; null ids give no bytes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(rank_file, pattern)
        for pdf in frames:
            data = [decode(enc, [] if x is None else list(x)) for x in pdf["ids"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "no_id": pdf["no_id"], "data": data})

    key = tokens[id_col].cast("long")
    rows = tokens.select(F.coalesce(key, F.lit(0)).alias("doc_id"), key.isNull().alias("no_id"), tokens[ids_col].cast("array<int>").alias("ids"))
    out = rows.mapInPandas(run, "doc_id long, no_id boolean, data binary")
    return out.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "data")


def digests(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes, decodes and sums up in one pass, without a shuffle."""

    def run(texts: list[str]) -> dict[str, list]:
        enc = encoding(rank_file, pattern)
        n, of_ids, of_bytes = [], [], []
        for text in texts:
            ids = encode(enc, text)
            n.append(len(ids))
            of_ids.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
            of_bytes.append(hashlib.sha256(decode(enc, ids)).hexdigest())
        return {"n_tokens": n, "ids_sha256": of_ids, "decoded_sha256": of_bytes}

    return each_row(id_text(docs, id_col, text_col), run, "n_tokens long, ids_sha256 string, decoded_sha256 string")
