"""Whole texts to token ids with the tokenizers library, each distinct chunk encoded once per worker.

The pre-tokenizers used here never let a token cross certain places, so a text is cut there, the library encodes the chunks
that a worker has not seen, and the ids are joined. Texts where the cut would not be safe go to the library whole.
Ids are bytes: little-endian unsigned 32-bit integers. Null text counts as empty; an empty text has no ids.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

#: Chunks remembered per worker in each of two generations (about 170 bytes each); a full one becomes the older, whose
#: chunks come back when they are met again. Words with folded case need half as many.
REMEMBERED = 450_000
#: A space between white space and white space belongs to a longer run.
_RUN = re.compile(r"\s (?:\s|\Z)|\0")
_LINES = re.compile(r"(?<=\S)\n(?=\S)")
_TAIL = ".,!?;:"


class Encoder:
    """Encodes with one tokenizer file. ``words``: white space is dropped and case is folded, else a space opens the chunk that follows it.

    A chunk is remembered only if it may stand anywhere: it isn't empty and doesn't end in white space. So a text whose chunks
    are all remembered is one that was safe to cut; any other is cut with care, or not at all.
    """

    def __init__(self, path: str, words: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one thread
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.words = words
        self.start = {"": b""} if words else {"\n": self.library(["\n"])[0]}
        self.known: dict[str, bytes] = dict(self.start)
        self.older: dict[str, bytes] = {}

    def library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, text: str) -> list[str]:
        if self.words:
            try:
                text.encode("latin-1")  # in these characters lower case depends on nothing around
                text = text.lower()
            except UnicodeEncodeError:
                pass
            return text.replace("\n", " ").split(" ")
        return [] if "\0" in text else text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")

    def _learn(self, chunks: set[str]) -> None:
        """Adds chunks to those known, but for closing marks by the parts they fall into."""
        known, older, new, made = self.known, self.older, [], []
        for c in chunks:
            if (ids := older.get(c)) is not None:
                known[c] = ids
                continue
            core = c.rstrip(_TAIL)
            if len(core) < len(c) and core.lower()[-1:].isalpha():
                made.append((c, core, c[len(core) :]))
            elif not c[-1:].isspace() and c:
                new.append(c)
        parts = {p for _, *ps in made for p in ps}.difference(known, new)
        for p in parts:
            if (ids := older.get(p)) is not None:
                known[p] = ids
            else:
                new.append(p)
        known.update(zip(new, self.library(new), strict=True))
        known.update([(c, known[a] + known[b]) for c, a, b in made])

    def _with_care(self, text: str) -> bytes:
        """A text with runs of white space: cut where one can be, the chunks encoded as they are; else whole."""
        if self.words or not text or _RUN.search(text):
            return self.library([text])[0]
        chunks = _LINES.sub("\0\n\0", text).replace(" ", "\0 ").split("\0")
        return b"".join(self.library(chunks))

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        texts = [t or "" for t in texts]
        cut = list(map(self._cut, texts))
        if len(self.known) > (REMEMBERED // 2 if self.words else REMEMBERED):
            self.known, self.older = dict(self.start), self.known
        missing = set().union(*cut).difference(self.known)
        if missing:
            self._learn(missing)
        get, out = self.known.__getitem__, []
        for chunks, text in zip(cut, texts, strict=True):
            try:
                out.append(b"".join(map(get, chunks)) if chunks else self.library([text])[0])
            except KeyError:
                out.append(self._with_care(text))
        return out


@lru_cache(maxsize=4)
def encoder(path: str, words: bool = False) -> Encoder:
    """One encoder per worker and file."""
    return Encoder(path, words)


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
