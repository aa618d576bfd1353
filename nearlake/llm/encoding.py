"""Token ids of whole texts, from a tokenizers file, with a memo of words.

Byte-pair merges never cross the pieces of the pre-tokenizer, and a piece never holds a
non-space followed by white space. A text whose white space is only single blanks and single
line ends can therefore be cut at these and encoded word by word, and most words were seen
before. Any other text goes through the tokenizer as a whole. Both ways give the same ids.
"""

from __future__ import annotations

import json
import re
import sys
from array import array

import regex

assert sys.byteorder == "little" and array("I").itemsize == 4

#: The byte alphabet of byte-level BPE, printable bytes as themselves.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

#: White space other than blanks and line ends.
UNUSUAL = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Blanks and line ends that don't stand alone between two other characters.
UNEVEN = ("  ", "\n\n", " \n", "\n ")


#: Words whose ids are remembered, twice at most.
MEMO_WORDS = 400_000


def _byte_letters() -> dict[int, str]:
    letters = {b: chr(b) for b in PRINTABLE}
    others = (b for b in range(256) if b not in letters)
    return letters | {b: chr(256 + i) for i, b in enumerate(others)}


class Memo(dict):
    """A bounded memo of a function: when full, what wasn't used since the last time is dropped."""

    def __init__(self, fn, limit: int):
        super().__init__()
        self.fn, self.limit, self.old = fn, limit, {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.fn(key)
        self[key] = value
        return value


class Encoder:
    """encode(text) gives little-endian unsigned 32-bit ids as bytes."""

    def __init__(self, path: str, words: int = MEMO_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.tokenizer.model._resize_cache(0)  # the memos below take its place
        self.letters = _byte_letters()
        self.blank = self.letters[32]
        kind = json.loads(self.tokenizer.to_str())["pre_tokenizer"]
        self.keeps_blanks = kind["type"] == "ByteLevel"
        if self.keeps_blanks:
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            self.word = Memo(self._word_with_blank, words)
        else:
            split = next(p for p in kind["pretokenizers"] if p["type"] == "Split")
            pattern = split["pattern"]["Regex"]
            self.word = Memo(self._word, words)
        self.cut = regex.compile(pattern).findall
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.piece = Memo(self._piece, words)

    def _piece(self, piece: str) -> bytes:
        if piece.isalpha() and piece.isascii():
            tokens = self.merge(piece)
        else:
            tokens = self.merge(piece.encode().decode("latin-1").translate(self.letters))
        return array("I", [t.id for t in tokens]).tobytes()

    def _word_with_blank(self, word: str) -> bytes:
        """Ids of a word and the blank before it, or of a line end and the word after it."""
        if word.isalpha():
            if word.isascii():
                return array("I", [t.id for t in self.merge(self.blank + word)]).tobytes()
            return self._piece(" " + word)
        head, tail = word[:-1], word[-1]
        if tail in ",.!" and head.isalpha():
            return self.word[head] + self.piece[tail]
        return b"".join([self.piece[p] for p in self.cut(word if word[0] == "\n" else " " + word)])

    def _word(self, word: str) -> bytes:
        word = word.lower() if word.isascii() else self.tokenizer.normalizer.normalize_str(word)
        if word.isalpha():
            return self.piece[word]
        head, tail = word[:-1], word[-1:]
        if tail in ",.!" and head.isalpha():
            return self.piece[head] + self.piece[tail]
        return b"".join([self.piece[p] for p in self.cut(word)])

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def is_even(self, text: str) -> bool:
        return not (
            text[0] in " \n" or text[-1] in " \n" or any(u in text for u in UNEVEN) or UNUSUAL.search(text) or any(t in text for t in self.added)
        )

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.is_even(text):
            return self.whole(text)
        if not self.keeps_blanks:
            return b"".join(map(self.word.__getitem__, text.split()))
        first, *rest = text.replace("\n", " \n").split(" ")
        start = b"".join([self.piece[p] for p in self.cut(first)])
        return start + b"".join(map(self.word.__getitem__, rest))
