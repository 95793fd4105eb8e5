"""Token ids by the tokenizers library, with a memory of pieces of text already seen.

Byte-pair encoding works within pieces that a pattern cuts out, so a piece's ids never depend on
its surroundings.  Texts made of ASCII and common Latin letters are cut here with that pattern and
each new piece goes through the library's model once; every other text goes through the library
whole.  Ids are equal either way.
"""

from __future__ import annotations

import os
import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

#: Pieces remembered by one worker, some 60 MB; pieces beyond are encoded anew each time.
MEMORY = 400_000
LONG = 40

# The letters, digits and white space among the characters that the fast way takes.
_LETTERS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-įı-ňŊ-ž"
_DIGITS = r"0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACE = r"\t\n\r \xa0"
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa0-\xac\xae-\xffĀ-įı-ňŊ-ž]*")
# The cutting patterns of the two vocabularies, for those characters.
_BYTE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^{_SPACE}{_LETTERS}{_DIGITS}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_SPACE}{_LETTERS}{_DIGITS}]+")


def byte_names() -> dict[int, str]:
    """Byte-level vocabularies write each byte as one visible character."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + n) for n, b in enumerate(hidden)}


class Encoder:
    """ids(text): little-endian unsigned 32-bit ids as bytes."""

    def __init__(self, path: str, lower: bool, plain: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = plain
        # a text that may hold the string of an added token goes through the library whole
        added = () if plain else self.whole.get_added_tokens_decoder().values()
        self.added = [t.content.lower() if lower else t.content for t in added]
        self.model, self.lower, self.names, self.seen = self.whole.model, lower, byte_names(), _Seen(self)
        self.cut = (_WORD if lower else _BYTE).findall

    def piece(self, piece: str) -> bytes:
        named = piece.encode("utf-8").decode("latin-1").translate(self.names)
        return np.array([t.id for t in self.model.tokenize(named)], "<u4").tobytes()

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        cased = text.lower() if self.lower else text
        if any(map(cased.__contains__, self.added)) or not _PLAIN.fullmatch(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.seen.__getitem__, self.cut(cased)))


class _Seen(dict):
    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        found = self.encoder.piece(piece)
        if len(self) < MEMORY and len(piece) <= LONG:
            self[piece] = found
        return found


_encoders: dict[tuple[str, bool, bool], Encoder] = {}


def encoder(file: str, lower: bool, plain: bool = False) -> Encoder:
    """One per worker; its memory serves all tasks of that worker.

    ``plain``: strings of special tokens inside a text are ordinary text; else they get their own ids,
    as the library does unless told otherwise.
    """
    if (file, lower, plain) not in _encoders:
        _encoders[file, lower, plain] = Encoder(file if os.path.isabs(file) else public_tokenizers.path(file), lower, plain)
    return _encoders[file, lower, plain]
