"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates every vocabulary piece in a text; dynamic programming over end positions carries
the best score and the number of pieces of the path that has it, nothing else. Ties follow the tokenizer: starts are
visited in text order and a path is replaced only by a strictly better one, so of equal paths into a position the one
whose last piece starts first stays. A character that is no piece by itself is unknown: it scores ten below the least
piece and counts as its UTF-8 bytes when the vocabulary has byte pieces, else a run of unknowns counts as one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from fieldtrace.llm.common import whole

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Word counts that a worker remembers.
REMEMBERED = 1 << 19


def read_vocabulary(path: str) -> tuple[list[tuple[str, float]], bool]:
    """Pieces with their scores from a sentencepiece model file, and whether unknown characters fall back to bytes.

    Control, unknown, unused and byte pieces stand for no text of their own: "</s>" or "<0x0A>" in a text are plain characters.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    apart = (model.is_control, model.is_unknown, model.is_unused, model.is_byte)
    pieces = [(model.id_to_piece(i), float(model.get_score(i))) for i in range(n) if not any(kind(i) for kind in apart)]
    return pieces, sum(model.is_byte(i) for i in range(n)) == 256


class Counter:
    """Counts pieces; built once per worker from a vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool) -> None:
        self.byte_fallback = byte_fallback
        self.automaton = ahocorasick.Automaton()
        best: dict[str, float] = {}
        for piece, score in pieces:
            if piece:
                best[piece] = score
        for piece, score in best.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(best.values(), default=0.0) - UNKNOWN_PENALTY
        self.single = {p for p in best if len(p) == 1}
        self.longest = max(map(len, best), default=1)
        # Where no piece has another character before a space mark, every path breaks there; likewise around a
        # character that only stands alone. Words are then counted one by one, and remembered.
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in best)
        newline = not any("\n" in p for p in best if len(p) > 1)
        self.cut = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n" if newline else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        # A run of unknowns is one piece without byte fallback, across the cut too: then only whole texts are exact.
        self.by_word = self.by_word and byte_fallback
        self.seen: dict[str, int] = {}

    def path(self, text: str) -> int:
        """Pieces of the best path through ``text``; keeps as many end positions as the longest piece has."""
        n, keep = len(text), self.longest + 1
        score, pieces, unknown = [0.0] * keep, [0] * keep, [False] * keep
        set_at = [-1] * keep
        set_at[0] = 0
        # Matches come in the order of their ends; the ones of an end, longest first, that is by start. A position is
        # final once all matches that end there are seen, which is before any later end needs it.
        matches = self.automaton.iter(text) if len(self.automaton) else iter(())
        pending = next(matches, None)
        for end in range(1, n + 1):
            slot, reached = end % keep, False
            best, count, odd = 0.0, 0, False
            while pending is not None and pending[0] == end - 1:
                length, value = pending[1]
                start = (end - length) % keep
                total = score[start] + value
                if not reached or total > best:
                    reached, best, count, odd = True, total, pieces[start] + 1, False
                pending = next(matches, None)
            char = text[end - 1]
            if char not in self.single:
                start = (end - 1) % keep
                total = score[start] + self.unknown
                if not reached or total > best:
                    best, odd = total, True
                    more = len(char.encode("utf-8", "replace")) if self.byte_fallback else int(not unknown[start])
                    count = pieces[start] + more
            score[slot], pieces[slot], unknown[slot] = best, count, odd
        return pieces[n % keep]

    def count(self, text: str | None) -> int:
        """Pieces of a whole text, spaces as marks and one mark in front; 0 for null and empty."""
        if not text:
            return 0
        marked = SPACE + text.replace(" ", SPACE)
        if not self.by_word:
            return self.path(marked)
        seen, total = self.seen, 0
        for found in self.cut.finditer(marked):
            word = found.group()
            number = seen.get(word)
            if number is None:
                number = self.path(word)
                if len(word) <= 64:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[word] = number
            total += number
        return total


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Each row with doc (struct of all columns), doc_id and tokens, the number of pieces of its whole text.

    ``vocabulary`` is the path of a sentencepiece model file, read by the driver. Null and empty texts have 0 tokens;
    characters outside the vocabulary count as the module says. Every row is counted, repeated ones alike; a text of any
    length is read whole, with as many positions in memory as the longest piece has; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    @pandas_udf(LongType())
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(*shared.value)
        for texts in parts:
            yield pd.Series(np.fromiter(map(counter.count, texts), dtype=np.int64, count=len(texts)))

    return docs.select(whole(docs), "doc_id", count(F.col("text")).alias("tokens"))
