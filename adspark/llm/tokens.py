"""Token ids by public tokenizers, encoded once per distinct piece of text.

Both supported kinds of vocabulary treat a text piece by piece: no token crosses
the borders between the pieces cut here, so the ids of a text are those of its
pieces in turn. Frequent pieces are remembered by a worker, up to a bound; pieces
new to a batch are encoded together. Texts with white space beyond ASCII or with
the vocabulary's special tokens are handed to the tokenizer whole.
"""

from __future__ import annotations

import re
import struct
import sys
import types

import numpy as np
from tokenizers import Tokenizer

CACHE_PIECES = 600_000
#: A word with the one space before it, or a run of white space.
BYTE_PIECES = re.compile(
    rb" ?[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+(?![^\x20\x09-\x0d])|[\x20\x09-\x0d]+").findall
#: White space that is more than one space or line end between two words.
UNEVEN = re.compile(rb"[\x20\n][\x20\n]|[\t\x0b-\r]|^[\x20\n]|[\x20\n]\Z").search
#: UTF-8 of the white space that is not among the six ASCII characters above, and
#: of the separators that some definitions count as white space.
ODD_SPACE = (
    rb"[\x1c-\x1f]|\xc2\x85|\xc2\xa0|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]"
    rb"|\xe2\x81\x9f|\xe3\x80\x80")
SEARCH_ODD = re.compile(ODD_SPACE).search
#: First bytes of what ``ODD_SPACE`` finds beyond ASCII, which most texts lack.
ODD_STARTS = (b"\xc2", b"\xe1\x9a", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80")
ODD_ASCII = b"\x1c\x1d\x1e\x1f"
#: Letters below U+0100: they compose with nothing, and a run of them is one piece
#: of the vocabulary's own cutting, as is a run of these signs.
LATIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch
SIGNS = b".,;:!?|%$&*#"


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + i)
    return out


LETTERS = byte_letters()


def _kept(name: str) -> dict:
    """A dictionary that lives as long as the worker process, not just as the task."""
    holder = sys.modules.setdefault("_worker_memory", types.ModuleType("_worker_memory"))
    return holder.__dict__.setdefault(name, {})


class _Pieces(dict):
    """Ids of pieces as bytes; a new piece is encoded when it is first asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: bytes) -> bytes:
        ids = self[piece] = self.encode(piece)
        return ids


class Encoder:
    """``kind``: "word" where white space is dropped and case ignored, "byte" where both count.

    Letters and signs go to the vocabulary's model, other pieces through its whole
    pipeline. One per vocabulary and worker process.
    """

    def __new__(cls, path: str, kind: str):
        kept = _kept("encoders")
        if path not in kept:
            kept[path] = super().__new__(cls)
            kept[path]._load(path, kind)
        return kept[path]

    def _load(self, path: str, kind: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.lower = self.tokenizer.model, kind == "word"
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65_536 else "<u4")
        self.code = "H" if self.type.itemsize == 2 else "I"
        special = [t.content.encode().lower() if self.lower else t.content.encode()
                   for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = special
        self.plain = _Pieces(lambda p: self._piece(p, b""))
        self.spaced = _Pieces(self._spaced)  # known by what follows the space

    def _odd(self, low: bytes) -> bool:
        """Whether a text has white space beyond the six characters, or a special token."""
        if any(s in low for s in self.special):
            return True
        if not low.isascii() and any(s in low for s in ODD_STARTS):
            return SEARCH_ODD(low) is not None
        return len(low.translate(None, ODD_ASCII)) < len(low)

    def _ids(self, text: bytes) -> bytes:
        found = self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)
        return np.array(found[0].ids, self.type).tobytes()

    def _piece(self, piece: bytes, space: bytes) -> bytes:
        word = piece.rstrip(SIGNS)
        signed = len(word) < len(piece)
        if signed and (word.isalpha() or LATIN(word)) and (
                known := (self.spaced if space else self.plain).get(word)):
            return known + self.plain[piece[len(word):]]
        if word.isalpha():  # of bytes: ASCII letters
            text = (space + word).decode()
        elif LATIN(word):
            text = word.decode()
            text = (space + (text.lower() if self.lower else text).encode()).decode("latin-1")
        else:
            return self._ids(space + piece)
        ids = [t.id for t in self.model.tokenize(text.translate(LETTERS) if space or not
                                                 text.isascii() else text)]
        own = struct.pack(f"<{len(ids)}{self.code}", *ids)
        return own if len(word) == len(piece) else own + self.plain[piece[len(word):]]

    def _spaced(self, piece: bytes) -> bytes:
        if piece[:1] == b"\n":
            return self.plain[b"\n"] + self.plain[piece[1:]]
        return self._piece(piece, b" ")

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """For each text its ids, as bytes of ``self.type``."""
        out = []
        for t in texts:
            for cache in (self.plain, self.spaced):
                if len(cache) > CACHE_PIECES:
                    cache.clear()
            low = t.lower() if self.lower else t
            if self._odd(low):
                out.append(self._ids(t))
            elif self.lower:
                out.append(b"".join(map(self.plain.__getitem__, low.split())))
            elif not t or UNEVEN(t):
                out.append(b"".join(map(self.plain.__getitem__, BYTE_PIECES(t))))
            else:
                first, *rest = t.replace(b"\n", b" \n").split(b" ")
                out.append(self.plain[first] + b"".join(map(self.spaced.__getitem__, rest)))
        return out
