"""Exact, cached encoding with a public tokenizer file."""

from __future__ import annotations

import os
import re

import numpy as np

#: Lower-cased ASCII and Latin-1 letters, digits and ASCII punctuation without the apostrophe: text of
#: these falls into runs of letters, single digits and runs of punctuation, whatever stands around it.
_LETTERS = "a-zß-öø-ÿ"
_SAFE = re.compile(f"[{_LETTERS}0-9!-&(-/:-@\\[-`{{-~]+")
_PUNCTUATION = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
_UNSAFE = re.compile(f"[^{_LETTERS}0-9!-&(-/:-@\\[-`{{-~ \n\r\t]")
_PIECES = re.compile(f"[{_LETTERS}]+|[0-9]|[!-&(-/:-@\\[-`{{-~]+")


def _byte_letters() -> dict[int, str]:
    """The byte-to-letter map of byte-level models: printable bytes stand for themselves, others follow from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in own else next(rest)) for b in range(256)}


class WordEncoder(dict):
    """Maps a blank-delimited chunk of text to its ids as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its
    pieces in a row; pieces repeat, and so each is encoded by the tokenizers library once and kept
    (up to ``keep``). A text of safe characters falls into pieces at once. Any other is cut at
    blanks and newlines only, and what is unusual in a chunk is left to the tokenizer. Texts that
    hold a special token's string are encoded whole.
    """

    def __init__(self, path: str, keep: int = 200_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.keep = keep
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.map = _byte_letters()
        self.pieces = _Pieces(self, keep)
        self.chunks = _Chunks(self.pieces, keep)
        # the short way round normaliser and splitter holds for the word-end model only
        probes = "Zsé.o!! abc, x 12a;b ÀÉ--q".split()
        self.short = all(self.whole(w) == self.chunks[w.lower()] for w in probes)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        low = chunk.lower()
        out = self.chunks[low] if self.short and _SAFE.fullmatch(low) else self.whole(chunk)
        if len(self) < self.keep and len(chunk) < 64:
            self[chunk] = out
        return out

    def encode(self, text: str | None) -> bytes:
        """All ids of a whole text as '<u4' bytes; null and empty texts give none."""
        if not text:
            return b""
        low = text.lower()
        if self.short and not _UNSAFE.search(low):
            if "<|" in low and any(s in text for s in self.specials):
                return self.whole(text)
            return b"".join(map(self.chunks.__getitem__, low.split()))
        if any(s in text for s in self.specials):
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


class _Pieces(dict):
    """Ids of one run of letters, digit or run of punctuation, by the library's model."""

    def __init__(self, owner: WordEncoder, keep: int):
        super().__init__()
        self.model, self.map, self.keep = owner.model, owner.map, keep

    def __missing__(self, piece: str) -> bytes:
        word = piece if piece.isascii() else "".join([self.map[b] for b in piece.encode()])
        out = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(word)])
        if len(self) < self.keep and len(piece) < 48:
            self[piece] = out
        return out


class _Chunks(dict):
    """Ids of one safe, lower-cased chunk: mostly a word, perhaps with punctuation behind it."""

    def __init__(self, pieces: _Pieces, keep: int):
        super().__init__()
        self.pieces, self.keep = pieces, keep

    def __missing__(self, chunk: str) -> bytes:
        word = chunk.rstrip(_PUNCTUATION)
        if word.isalpha():
            out = self.pieces[word]
            if len(word) < len(chunk):
                out += self.pieces[chunk[len(word) :]]
        else:
            out = b"".join(map(self.pieces.__getitem__, _PIECES.findall(chunk)))
        if len(self) < self.keep and len(chunk) < 48:
            self[chunk] = out
        return out


_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, keep: int = 200_000) -> WordEncoder:
    """The worker's encoder for a tokenizer file, kept between tasks."""
    if (path, keep) not in _ENCODERS:
        _ENCODERS[path, keep] = WordEncoder(path, keep)
    return _ENCODERS[path, keep]
