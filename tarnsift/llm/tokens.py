"""Token ids of whole texts with a memo of pre-tokens, equal to the tokenizers library's.

A pre-token's ids don't depend on what stands around it, so a worker encodes each distinct
one once (a memo of bounded size) and joins bytes. Texts are cut by Python's ``re`` with
classes listed for code points below U+0300, whose Unicode classes are settled; any other
text, and any that holds the first characters of a special token, goes through the library
as a whole.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from array import array
from functools import lru_cache

import numpy as np

#: Distinct pre-tokens that a worker keeps, in two generations of half as many.
MEMO = 900_000
#: Characters of text cut into pre-tokens at a time.
SPAN = 1_000_000
LIMIT = 0x300
#: White space below LIMIT (Unicode's White_Space; Python's isspace has more).
SPACE = "\t\n\x0b\x0c\r \x85\xa0"


def _class(first: str) -> str:
    return "".join(re.escape(chr(i)) for i in range(LIMIT) if unicodedata.category(chr(i))[0] == first)


_L, _N = _class("L"), _class("N")
_W = "".join(map(re.escape, SPACE))
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
#: The two published cutting rules, with classes spelled out.
BYTE_LEVEL = re.compile(rf"{_SHORT}| ?[{_L}]+| ?[{_N}]+| ?[^{_W}{_L}{_N}]+|[{_W}]+(?![^{_W}])|[{_W}]+")
WORD_END = re.compile(rf"{_SHORT}|[{_L}]+|[{_N}]|[^{_W}{_L}{_N}]+")
_HIGH = re.compile(r"[^\x00-˿]")


def plain(text: str) -> bool:
    """Whether every code point is below LIMIT."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _HIGH.search(text) is None
    return True


def spans(texts: list[str | None], most: int = SPAN):
    """``texts`` in runs of about ``most`` characters, nulls as empty texts."""
    part, n = [], 0
    for t in texts:
        part.append(t or "")
        n += len(t or "")
        if n >= most:
            yield part
            part, n = [], 0
    if part:
        yield part


def byte_symbols() -> list[str]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves, the
    others for the code points from 256 in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


def u32(ids) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


class Memo(dict):
    """Ids by pre-token. What isn't known comes from the generation before or from ``make``;
    a full generation becomes the one before, so pre-tokens in use stay."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def turn(self) -> None:
        self.old = dict(self)
        self.clear()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMO // 2:
            self.turn()
        ids = self.old.get(word)
        if ids is None:
            ids = self.make(word)
        self[word] = ids
        return ids


class Coder:
    """Encodes texts as bytes of little-endian unsigned 32-bit ids, as the library does with
    add_special_tokens=False. ``word_end``: the lower-casing rule with word ends, else the
    byte-level rule. Both are checked against the tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        pre = json.dumps(spec["pre_tokenizer"])
        if spec["normalizer"] is None and '"ByteLevel"' in pre and '"Split"' not in pre:
            self.cut, self.lower = BYTE_LEVEL, False
        elif '"Lowercase"' in json.dumps(spec["normalizer"]) and r"[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in pre:
            self.cut, self.lower = WORD_END, True
        else:
            self.cut, self.lower = None, False  # all texts as a whole
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.memo = self.new_memo()

    def new_memo(self) -> Memo:
        shown, model, little = byte_symbols(), self.tokenizer.model, sys.byteorder == "little"

        def make(word: str) -> bytes:
            symbols = "".join(map(shown.__getitem__, word.encode("utf-8")))
            ids = [t.id for t in model.tokenize(symbols)]
            return array("I", ids).tobytes() if little else u32(ids)

        return Memo(make)

    def whole(self, text: str) -> bytes:
        return u32(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def forget(self) -> None:
        """Empty the memo, for workers that go on to other work."""
        self.memo.clear()
        self.memo.old = {}

    def pieces(self, text: str) -> list[str] | None:
        """Pre-tokens by the fast rule, or None where the library must take the text whole."""
        if self.cut is None or any(s in text for s in self.special):
            return None
        t = text.lower() if self.lower else text
        return self.cut.findall(t) if plain(t) and (t is text or plain(text)) else None

    def encode(self, texts: list[str | None]):
        """The ids of each text, in order."""
        get = self.memo.__getitem__
        for t in texts:
            c = self.pieces(t or "")
            yield self.whole(t or "") if c is None else b"".join(map(get, c))


@lru_cache(maxsize=4)
def coder(path: str) -> Coder:
    """One coder per tokenizer file and worker process."""
    return Coder(path)


