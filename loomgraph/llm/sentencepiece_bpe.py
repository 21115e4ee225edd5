"""SentencePiece BPE encoding by a table of prefixes' last tokens, and decoding.

For merges ranked by the merged piece, a sequence is the encoding of its text exactly if each neighbouring pair is: of all
pieces that end a prefix, only one follows the prefix before it compatibly. An Aho-Corasick automaton lists the pieces that end at
each place; a pair is tested by taking its two pieces apart in reverse merge order and looking for a merge across the seam
that would have come first. The table holds one last token for each prefix; ids are read off it backwards.

No piece has a space mark behind another character or a line end, so texts are cut there and each distinct chunk is encoded once per
worker (memory starts anew beyond ``REMEMBERED`` chunks). Pieces made of several space marks share one rank, for which the
pair test does not hold: chunks with such runs are merged step by step from a heap of pairs. Characters without a piece become their bytes' pieces.

Null text counts as empty; an empty text has no ids and decodes to an empty text. Texts and chunks of any length are encoded whole, in time near their length.
Pairs of one rank are merged leftmost first. Repeated rows each get a row; ids of rows
may be null. Only id and text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from functools import lru_cache
from heapq import heapify, heappop, heappush

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.batches import bounded
from loomgraph.llm.tokens import vocabulary

REMEMBERED = 500_000
#: Tested pairs remembered per worker.
PAIRS = 1_000_000
MARK = "▁"
_ODD = re.compile(f"{MARK}|  ")
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class PieceBpe:
    """One model file's pieces, ranked by score."""

    def __init__(self, model: str):
        from sentencepiece import SentencePieceProcessor

        self.library = sp = SentencePieceProcessor(model_file=model)
        plain = [i for i in range(len(sp)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.piece = {i: sp.id_to_piece(i) for i in plain}
        self.id = {p: i for i, p in self.piece.items()}
        assert not any("\n" in p or MARK in p.lstrip(MARK) for p in self.id), "chunks would not be independent"
        # A single character is there from the start: it ranks before every merge.
        self.rank = {p: (-1.0 if len(p) == 1 else -sp.get_score(i)) for p, i in self.id.items()}
        self.byte = {b: sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.automaton = ahocorasick.Automaton()
        for p in self.id:
            if len(p) == 1 or (self._split(p) and len(p.lstrip(MARK)) >= len(p) - 1):
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()

    def _merged(self, chunk: str) -> tuple[list[str], tuple[str, str] | None]:
        """Merging step by step, best rank and then leftmost first: the tokens, and the two halves merged last. A heap of pairs over linked parts."""
        parts: list[str | None] = list(chunk)
        after, before, last = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1)), None
        rank = self.rank.get
        heap = [(r, i, parts[i] + parts[i + 1]) for i in range(len(parts) - 1) if (r := rank(parts[i] + parts[i + 1])) is not None]
        heapify(heap)
        while heap:
            _, i, both = heappop(heap)
            j = after[i]
            if parts[i] is None or j >= len(parts) or len(parts[i]) + len(parts[j]) != len(both):
                continue  # one of the two is part of another piece by now
            last = (parts[i], parts[j])
            parts[i], parts[j], after[i] = both, None, after[j]
            if after[i] < len(parts):
                before[after[i]] = i
                if (r := rank(both + parts[after[i]])) is not None:
                    heappush(heap, (r, i, both + parts[after[i]]))
            h = before[i]
            if h >= 0 and (r := rank(parts[h] + both)) is not None:
                heappush(heap, (r, h, parts[h] + both))
        return [x for x in parts if x is not None], last

    def _split(self, piece: str) -> tuple[str, str] | None:
        """The halves a piece is merged from; none for a character or a piece that merging does not reach."""
        if piece not in self.halves:
            parts, last = self._merged(piece)
            self.halves[piece] = last if len(parts) == 1 else None
        return self.halves[piece]

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging leaves a, b as they are when they stand side by side."""
        if (found := self.pairs.get((a, b))) is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            found = self.pairs[a, b] = self._compatible(a, b)
        return found

    def _compatible(self, a: str, b: str) -> bool:
        # Merges happen in ascending (rank, place). ``bound`` is the first of the undone merges beside the seam;
        # ``tie`` says whether a merge across the seam of just that rank would still come before it.
        rank, bound, tie = self.rank, float("inf"), True
        while True:
            across = rank.get(a + b)
            if across is not None and (across < bound or across == bound and tie):
                return False
            ra, rb = (rank.get(x, -1.0) if len(x) > 1 else -1.0 for x in (a, b))
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                bound, tie, a = ra, False, self._split(a)[1]
            else:
                bound, tie, b = rb, True, self._split(b)[0]

    def tokens(self, chunk: str) -> list[str]:
        """The encoding of one chunk."""
        if MARK in chunk[1:]:
            return self._merged(chunk)[0]
        n = len(chunk)
        ends: list[list[str]] = [[] for _ in range(n)]
        for end, piece in self.automaton.iter(chunk):
            ends[end].append(piece)
        last: list[str] = []
        for end in range(n):
            for piece in ends[end] or (chunk[end],):
                start = end - len(piece)
                if start < 0 or self.compatible(last[start], piece):
                    last.append(piece)
                    break
            else:
                raise AssertionError(f"no last token for {chunk[: end + 1]!r}")
        out, at = [], n - 1
        while at >= 0:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def _ids(self, chunk: str) -> tuple[int, ...]:
        out: list[int] = []
        for token in self.tokens(chunk):
            if token in self.id:
                out.append(self.id[token])
            else:
                out += [self.byte[b] for b in token.encode()]
        return tuple(out)

    def chunks(self, text: str) -> Iterable[str]:
        """Independent chunks whose encodings together are the text's."""
        out: list[str] = []
        for i, line in enumerate(text.split("\n")):
            if i:
                out.append("\n")
            elif text:
                line = " " + line
            if not line:
                continue
            if _ODD.search(line):
                out += _CHUNK.findall(line.replace(" ", MARK))
            else:
                cut = line.replace(" ", f" {MARK}").split(" ")
                out += cut if cut[0] else cut[1:]
        return out

    def encode(self, text: str | None) -> list[int]:
        known, out = self.known, []
        for chunk in self.chunks(text or ""):
            ids = known.get(chunk)
            if ids is None:
                if len(known) > REMEMBERED:
                    known.clear()
                ids = known[chunk] = self._ids(chunk)
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@lru_cache(maxsize=2)
def coder(model: str) -> PieceBpe:
    """One coder per worker and model file."""
    return PieceBpe(model)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids)`` of every whole text."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series([coder(model).encode(t) for t in texts])

    return bounded(docs).select(F.col(id_col).alias("doc_id"), ids(F.col(text_col)).alias("ids"))


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``(doc_id, text)`` of rows ``(doc_id, ids)``; null ids count as none."""

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        return pd.Series(["" if i is None else coder(model).decode([int(x) for x in i]) for i in ids])

    return bounded(encoded).select("doc_id", text("ids").alias("text"))


def digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: encoding and decoding in one pass, without moving the ids."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def both(texts: pd.Series) -> pd.DataFrame:
        c, rows = coder(model), []
        for t in texts:
            ids = c.encode(t)
            rows.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(c.decode(ids).encode()).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return bounded(docs).select(F.col(id_col).alias("doc_id"), both(F.col(text_col)).alias("d")).select("doc_id", "d.*")


def op6_sentencepiece(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(docs, vocabulary("piece_bpe_32k.model"))
