"""Exact token ids of whole texts by the tokenizers library, with a bounded memo of short pieces.

The byte-level pre-tokenizer never merges across a run of white space that follows other text, nor across a special
string, so a text is cut before each such run and around each special string, and every piece is encoded by the
library once per worker and memo. Texts of Latin letters whose only white space is space and newline are cut into the
pre-tokens themselves, of which there are fewer kinds. Files of another kind get texts whole.
"""

from __future__ import annotations

import functools
import os
import re
import sys
import zlib
from array import array

END_ID = 2
assert sys.byteorder == "little" and array("I").itemsize == 4
#: White space as the library's pattern has it (Unicode's property; Python's own class has four more).
_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECE = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
#: Pieces in each of the memo's two generations (together about 100 MB in a worker).
MEMO_PIECES = 250_000
#: Longer pieces are encoded but not remembered.
MEMO_CHARS = 64


@functools.cache
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def is_byte_level(path: str) -> bool:
    """Whether the file is a byte-level BPE without normalizer, whose pieces may be encoded apart."""
    if not path.endswith(".json"):
        return False
    import json

    t = load(path)
    pre = json.loads(t.to_str()).get("pre_tokenizer") or {}
    return t.normalizer is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")


#: Texts and pieces of Latin letters, which are the same in every Unicode version, and the pre-tokenizer's pattern for them.
_LATIN = re.compile(r"[\x20\n!-~\u00A1-\u024F]+")
_PRE_TOKEN = re.compile(
    r"'(?:s|t|re|ve|m|ll|d)"
    r"| ?[A-Za-z\u00AA\u00B5\u00BA\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+"
    r"| ?[0-9\u00B2\u00B3\u00B9\u00BC-\u00BE]+"
    r"| ?[^ \nA-Za-z0-9\u00AA\u00B2\u00B3\u00B5\u00B9\u00BA\u00BC-\u00BE\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+"
    r"|[ \n]+(?![^ \n])|[ \n]+"
)


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: visible bytes stand for themselves, the others for letters from 256 on, in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(visible)]
    return dict(zip(rest, range(256, 256 + len(rest)), strict=True))


_BYTE_LETTERS = _byte_letters()
SHOWN_SPACE = chr(_BYTE_LETTERS[0x20])


class _Memo:
    """Ids of short pieces, in plain dictionaries: what a text's pieces miss there is encoded one by one.

    When the young generation is full it becomes the old one, so frequent pieces stay and rare ones go.
    """

    def __init__(self, tokenizer, room: int, special: list[str]):
        self.tokenizer, self.model, self.room, self.special = tokenizer, tokenizer.model, room, frozenset(special)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def joined(self, pieces: list[str], pre_tokens: bool = False) -> bytes:
        """Ids of pieces in a row; pre_tokens says that they are pre-tokens of Latin text already."""
        found = list(map(self.young.get, pieces))
        if None in found:
            for k, ids in enumerate(found):
                if ids is None:
                    found[k] = self.young.get(pieces[k]) or self.missed(pieces[k], pre_tokens)
        return b"".join(found)

    def missed(self, piece: str, pre_token: bool) -> bytes:
        ids = self.old.get(piece) or self.encoded(piece, pre_token)
        if len(piece) <= MEMO_CHARS and self.room:
            if len(self.young) >= self.room:
                self.old, self.young = self.young, {}
            self.young[piece] = ids
        return ids

    def encoded(self, piece: str, pre_token: bool) -> bytes:
        if len(piece) > MEMO_CHARS or not pre_token and (piece in self.special or not _LATIN.fullmatch(piece)):
            return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        if not pre_token:
            parts = _PRE_TOKEN.findall(piece)
            if len(parts) > 1:  # its words may be known from elsewhere
                return self.joined(parts, True)
        shown = piece.replace(" ", SHOWN_SPACE) if piece.isascii() and "\n" not in piece else piece.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()


class Encoder:
    """ids(text) as little-endian unsigned 32-bit bytes, equal to the library's encode(text, add_special_tokens=False)."""

    def __init__(self, path: str, memo_pieces: int = MEMO_PIECES):
        self.tokenizer = load(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        # A special string that takes white space or whole words with it is left to the library, text and all.
        self.by_piece = is_byte_level(path) and not any(t.lstrip or t.rstrip or t.single_word for t in added)
        self.special = [t.content for t in added]
        self.around = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.memo = _Memo(self.tokenizer, memo_pieces, self.special)

    def pieces(self, text: str) -> list[str]:
        """Parts of a text that may be encoded apart."""
        if not self.by_piece:
            return [text] if text else []
        if any(s in text for s in self.special):
            return [x for k, part in enumerate(self.around.split(text)) if part for x in ([part] if k % 2 else _PIECE.findall(part))]
        return _PIECE.findall(text)

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.by_piece:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if any(s in text for s in self.special):
            return self.memo.joined(self.pieces(text))
        if _LATIN.fullmatch(text):
            return self.memo.joined(_PRE_TOKEN.findall(text), True)
        return self.memo.joined(_PIECE.findall(text))


@functools.cache
def encoder(path: str) -> Encoder:
    """One per worker process, so that its memo lasts over tasks."""
    return Encoder(path)


def crc(ids: bytes) -> int:
    return zlib.crc32(ids) & 0xFFFFFFFF
