"""Token counts of a unigram tokenizer without making the tokens: count-only Viterbi.

An Aho-Corasick automaton enumerates the vocabulary matches in a word; dynamic programming carries, for each place, the best
score and the number of pieces on the best path. Ties go as in the tokenizers library's unigram model: starts are
visited in ascending order and a path replaces another only if its score is strictly larger, so the longest last piece wins;
a character without a piece costs the lowest score less ten and is counted as its bytes' pieces.

The vocabulary (pieces and scores) is a parameter; ``piece_scores`` takes it from a SentencePiece file. Words are as the library's
metaspace pre-tokenizer makes them: each space starts one, and one mark is set before the text. Each distinct word is solved once
per worker, up to ``REMEMBERED`` words.

Null text counts as empty; an empty text has no tokens. Repeated rows each get a row. Only id and text are read.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.batches import bounded
from loomgraph.llm.tokens import vocabulary

REMEMBERED = 700_000
MARK = "▁"
UNKNOWN_PENALTY = 10.0


def piece_scores(model: str) -> list[tuple[str, float]]:
    """The pieces of a SentencePiece file with their scores, by id."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=model)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(len(sp))]


class Counter:
    """Counts of one vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in dict(pieces).items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.known: dict[str, int] = {}

    def solve(self, word: str) -> int:
        """Pieces on the best path through one word."""
        n = len(word)
        best, count, single = [0.0] + [float("-inf")] * n, [0] * (n + 1), [False] * n
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, (size, score) in self.automaton.iter(word):
            ending[end].append((end + 1 - size, score))
            single[end] |= size == 1
        for end in range(n):
            top, pieces = float("-inf"), 0
            # Starts ascend, so among equal scores the first, longest piece stays.
            for start, score in sorted(ending[end]):
                if best[start] + score > top:
                    top, pieces = best[start] + score, count[start] + 1
            if not single[end] and best[end] + self.unknown > top:
                top, pieces = best[end] + self.unknown, count[end] + len(word[end].encode())
            best[end + 1], count[end + 1] = top, pieces
        return count[n]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        body = text.replace(MARK, " ")
        if body[0] != " ":
            body = " " + body
        words = body[1:].split(" ")
        known = self.known
        total = 0
        for word in words:
            n = known.get(word)
            if n is None:
                if len(known) > REMEMBERED:
                    known.clear()
                n = known[word] = self.solve(MARK + word)
            total += n
        return total


@lru_cache(maxsize=2)
def counter(model: str) -> Counter:
    """One counter per worker and file."""
    return Counter(piece_scores(model))


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens)`` of every whole text."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([counter(model).count(t) for t in texts], dtype="int64")

    return bounded(docs).select(F.col(id_col).alias("doc_id"), count(F.col(text_col)).alias("n_tokens"))


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs, vocabulary("piece_bpe_32k.model"))
