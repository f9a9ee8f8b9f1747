"""Tokenization with the public tokenizers, several times faster than text by text.

Both tokenizers cut a text into pieces (words with their blank, runs of marks, ...) and encode each piece by
itself, so the ids of a piece can be kept: texts are cut with the same rules and only pieces not seen before
go to the tokenizers library.  A text with a character outside a range where those rules are plain (ASCII,
Latin-1 and Latin Extended-A letters, no control characters) is encoded whole by the library, and so is one
with the string of an added token, which the library finds before it cuts.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"
#: Pieces whose ids a task keeps: this many new ones, and as many from before that.
KEPT_PIECES = 200_000

#: Characters with plain rules: no combining marks, no case pairs of another length, NFC is the identity.
PLAIN = re.compile(r"[\n\x20-\x7e¡-§©«¬®¯°±´¶·»¿À-ÖØ-öø-įĲ-ľŁ-ňŊ-žǍ-ǜ–—‘’“”…€]*")
#: Blanks that are not single, or not before something; plain texts have no others.
ODD_BLANKS = ("  ", "\n\n", " \n", "\n ")
_LETTER = "A-Za-zÀ-ÖØ-öø-įĲ-ľŁ-ňŊ-žǍ-ǜ"


def _shown(piece: str) -> str:
    """A piece as the byte-level vocabularies spell it: every byte is a visible character."""
    if piece.isascii() and "\n" not in piece:
        # of the plain characters only the blank is spelled in another way
        return piece.replace(" ", _SPELLING[0x20])
    return piece.encode().decode("latin-1").translate(_SPELLING)


def _spelling() -> dict[int, str]:
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(256 + k) for k, b in enumerate(hidden)}


_SPELLING = _spelling()
_BLANK = _SPELLING[0x20]


class Kept:
    """ids by piece; when full, the pieces not used since the last time are forgotten."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def add(self, piece: str, ids: bytes) -> bytes:
        if len(self.new) >= self.size:
            self.old = dict(self.new)
            self.new.clear()
        self.new[piece] = ids
        return ids

    def rest(self) -> None:
        """At the end of a task: only the newer ones stay for the next."""
        self.old.clear()


class Encoder:
    """ids as little-endian unsigned 32-bit bytes; one per task."""

    def __init__(self, path: str, kept: int = KEPT_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = sorted({t.content for t in self.tokenizer.get_added_tokens_decoder().values()})
        #: Case counts for nothing here: normalized added tokens are looked for in the lowered text.
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        self.model = self.tokenizer.model
        self.words = "word" in os.path.basename(path)
        #: Of blank-free runs and of the parts they are cut into; a part by itself has the same ids.
        self.pieces = Kept(kept if self.words else kept // 4)
        #: For byte BPE, of blank-free runs that come after a blank.
        self.spaced = Kept(kept * 3 // 4)
        if self.words:
            self.cut = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\s0-9{_LETTER}]+")
        else:
            self.cut = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\s0-9{_LETTER}]+|\s+(?!\S)|\s+")

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _ids(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(_shown(piece))]).tobytes()

    def _spaced_run(self, run: str) -> bytes:
        """ids of a blank and a blank-free run; its first part is kept by itself too, as a word that ends a sentence also stands within one."""
        if not run.isalpha():
            first, *rest = self.cut.findall(" " + run)
            if rest:
                ids = self.spaced.new.get(first[1:])
                return b"".join([self.after_blank(first[1:]) if ids is None else ids, *[self.part(p) for p in rest]])
        if run.isascii():
            return array("I", [t.id for t in self.model.tokenize(_BLANK + run)]).tobytes()
        return self._ids(" " + run)

    def part(self, piece: str) -> bytes:
        ids = self.pieces.new.get(piece)
        if ids is None:
            ids = self.pieces.old.get(piece)
            self.pieces.add(piece, ids := self._ids(piece) if ids is None else ids)
        return ids

    def _run(self, run: str) -> bytes:
        """ids of a blank-free run; letters alone are one part."""
        if run.lstrip(" ").isalpha():
            return self._ids(run)
        return b"".join([self.part(p) for p in self.cut.findall(run)])

    def chunk(self, run: str) -> bytes:
        ids = self.pieces.old.get(run)
        return self.pieces.add(run, self._run(run) if ids is None else ids)

    def after_blank(self, run: str) -> bytes:
        ids = self.spaced.old.get(run)
        return self.spaced.add(run, self._spaced_run(run) if ids is None else ids)

    def rest(self) -> None:
        """At the end of a task: give the older half of the memory back."""
        self.pieces.rest()
        self.spaced.rest()

    def encode(self, text: str) -> bytes:
        if not PLAIN.fullmatch(text) or self.added is not None and self.added.search(text):
            return self.whole(text)
        get, chunk = self.pieces.new.get, self.chunk
        if self.words:
            return b"".join([ids if (ids := get(w)) is not None else chunk(w) for w in text.lower().split()])
        if text.endswith((" ", "\n")) or any(x in text for x in ODD_BLANKS):
            return b"".join([ids if (ids := get(p)) is not None else chunk(p) for p in self.cut.findall(text)])
        # single blanks go with the word behind them, single line ends are pieces of their own
        out, spaced, after_blank = [], self.spaced.new.get, self.after_blank
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(get("\n") or chunk("\n"))
            first, *rest = line.split(" ")
            if first:
                out.append(ids if (ids := get(first)) is not None else chunk(first))
            out += [ids if (ids := spaced(w)) is not None else after_blank(w) for w in rest]
        return b"".join(out)


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(name: str = WORD_BPE, folder: str | None = None, kept: int = KEPT_PIECES) -> Encoder:
    """The encoder of this worker for a vocabulary file of the installed public tokenizers, or of a folder."""
    if folder is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    else:
        path = os.path.join(folder, name)
    if (path, kept) not in _encoders:
        _encoders[path, kept] = Encoder(path, kept)
    return _encoders[path, kept]
