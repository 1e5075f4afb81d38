"""Encoding with the tokenizers library, word by word with a memory of known words.

The tokenizer's rules never cross what it knows as white space, so the ids of a text are those of its
white-space chunks in order. `Encoder` checks at start which of Python's white space the tokenizer
treats so; texts with any other are encoded whole. Chunks seen before come from a dictionary of bounded
size. New chunks that are letters of Latin-1, with or without a full stop or comma behind, go straight
to the library's model (folded and written in the byte alphabet as its own steps would, which is also
checked at start); all others go through the whole library.
"""

from __future__ import annotations

import os
from array import array
from itertools import chain

# Characters that str.split() takes for white space beyond ASCII space, tab and line ends.
ODD_SPACE = "\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0                　"


class Encoder:
    """ids of texts as little-endian unsigned 32-bit integers in bytes."""

    def __init__(self, path: str, known: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), known
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}
        a, b = self.whole(["a", "b"])
        spaces = [*" \t\n\r", *ODD_SPACE]
        unlike = [c for c, got in zip(spaces, self.whole([f"a{c}b" for c in spaces]), strict=True) if got != a + b]
        self.by_chunk = not set(unlike) & set(" \t\n\r")
        self.bars = unlike
        self.marks = {p: ids for p, ids, got in zip(".,", self.whole([*".,"]), self.whole(["a.", "a,"]), strict=True) if got == a + ids}
        # Letters of Latin-1 in the byte alphabet of the model.
        letters = [c for c in map(chr, range(0xAA, 0x100)) if c.isalpha()]
        before = self.tokenizer.pre_tokenizer
        self.alphabet = {ord(c): "".join(x for x, _ in before.pre_tokenize_str(c)) for c in letters} if before else {}
        probes = ["the", "Of", "Reallyunlikelyword", *(f"{x}{c}{y}" for c in letters for x, y in (("", ""), ("t", "on"), ("Re", "ment")))]
        self.straight = self.by_chunk and [self.letters(w) for w in probes] == self.whole(probes)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def letters(self, word: str) -> bytes:
        word = word.lower()
        if not word.isascii():
            word = word.translate(self.alphabet)
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of new chunks."""
        out, marks, letters, hard = {}, self.marks, self.letters, []
        for w in new:
            mark = marks.get(w[-1], b"")
            core = w[:-1] if mark else w
            if self.straight and core.isalpha() and (core.isascii() or max(core) < "\u0100"):
                out[w] = letters(core) + mark
            else:
                hard.append(w)
        out.update(zip(hard, self.whole(hard), strict=True))
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; None is empty."""
        plain = [x or "" for x in texts]
        if not self.by_chunk:
            return self.whole(plain)
        barred = [i for i, x in enumerate(plain) if any(c in x for c in self.bars)]
        for i in barred:
            plain[i] = ""
        split = [x.split() for x in plain]
        words = list(chain.from_iterable(split))
        ids = list(map(self.known.get, words))
        holes = [i for i, v in enumerate(ids) if v is None]
        if holes:
            found = self.learn(list({words[i] for i in holes}))
            for i in holes:
                ids[i] = found[words[i]]
            if len(self.known) < self.limit:
                self.known.update(found)
        out, at = [], 0
        for x in split:
            out.append(b"".join(ids[at : at + len(x)]))
            at += len(x)
        for i, whole in zip(barred, self.whole([texts[i] for i in barred]), strict=True):
            out[i] = whole
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
