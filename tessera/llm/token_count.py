"""Count-only Viterbi for unigram vocabularies.

An Aho-Corasick automaton enumerates every vocabulary piece in a word in one
pass; dynamic programming carries only the best score and the number of pieces
of the best path to each place, never the path. Ties follow the tokenizer: of
equal scores the piece that starts first wins, and a character without a
one-character piece may also be an unknown, tried last, whose score is the
least score less 10. An unknown is spelled by byte pieces if the vocabulary has
them, else each run of unknowns counts once.

Words do not interact (each is prefixed with the word mark), so a worker counts
each distinct word once and looks the rest up.

Edge cases: a null or empty text, or one of white space, has no tokens; one
output row per input row, repeated or not.
"""

from __future__ import annotations

import functools
import math
import re
import ahocorasick
import sentencepiece
from pyspark.sql import DataFrame

from tessera.llm.common import WORD, each_row, id_text

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE = 600_000


def zipf_vocabulary(model_file: str) -> list[tuple[str, float]]:
    """Pieces of a SentencePiece file with log scores.

    The file's scores are merge ranks (0, -1, ...), not log probabilities; by
    Zipf's law a piece of rank r gets -ln(1 + r).
    """
    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [(sp.id_to_piece(i), -math.log1p(abs(sp.get_score(i)))) for i in range(sp.get_piece_size())]


class Counter:
    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True) -> None:
        self.automaton = ahocorasick.Automaton()
        for piece, score in dict(reversed(vocabulary)).items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        have = {p for p, _ in vocabulary}
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in have for b in range(256))

    def count(self, word: str) -> int:
        """Pieces of the best path through word."""
        n = len(word)
        best, count, single = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        reached, unk = [True] + [False] * n, [False] * (n + 1)
        done = 0

        def close(end: int) -> None:  # the unknown of one character is the last candidate for its end
            if not single[end]:
                score = best[end - 1] + self.unknown
                if not reached[end] or score > best[end]:
                    width = len(word[end - 1].encode("utf-8", "surrogatepass")) if self.bytes else int(not unk[end - 1])
                    best[end], count[end], reached[end], unk[end] = score, count[end - 1] + width, True, True

        for last, (size, value) in self.automaton.iter(word):  # longest, so earliest start, first
            end = last + 1
            while done < end - 1:
                done += 1
                close(done)
            start = end - size
            score = best[start] + value
            if size == 1:
                single[end] = True
            if not reached[end] or score > best[end]:
                best[end], count[end], reached[end] = score, count[start] + 1, True
        while done < n:
            done += 1
            close(done)
        return count[n]


@functools.lru_cache(maxsize=2)
def _loaded(model_file: str) -> tuple[Counter, dict[str, int]]:
    return Counter(zipf_vocabulary(model_file)), {}


def token_counts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens) of every row; map-only."""

    def run(texts: list[str]) -> dict[str, list]:
        counter, cache = _loaded(model_file)
        find = re.compile(WORD).findall
        if len(cache) > CACHE:
            cache.clear()
        words, tokens = [], []
        for text in texts:
            found = find(text)
            for w in set(found).difference(cache):
                cache[w] = counter.count(MARK + w)
            words.append(len(found))
            tokens.append(sum(map(cache.__getitem__, found)))
        return {"n_words": words, "n_tokens": tokens}

    return each_row(id_text(docs, id_col, text_col), run, "n_words long, n_tokens long")
