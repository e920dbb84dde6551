"""Encodings of word_bpe_49k.json, with a memory of the words seen before.

The tokenizer normalises (NFC, white space, lower case), splits a text into pieces that
hold no white space and lets its BPE model encode every piece by itself. In a text whose
characters all come from the safe ones, a word between white space therefore always has
the same ids, and only words not seen before go to the library's model. Any other text,
and any text with a special string, goes to the library whole.
"""

from __future__ import annotations

import numpy as np
import regex

from .common import worker_state

#: Printable ASCII, tab, line feed, carriage return and Latin letters and signs below
#: U+0250 (U+0130 excepted): NFC leaves them alone, lower case is letter by letter.
UNSAFE = regex.compile(r"[^\t\n\r\x20-\x7e¡-¬®-įı-ɏ]")
#: The piece pattern of the vocabulary file.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SPECIAL = "<|"
#: Words kept by a worker, none of them longer than CACHE_CHARS: about 200 bytes each, 120 MB in all.
CACHE_WORDS, CACHE_CHARS = 600_000, 48


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the rest from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Words(dict):
    """word -> ids, filled on demand. When half the room is full, what is not looked up again until the other half is full goes."""

    def __init__(self, model):
        super().__init__()
        self.model, self.letters, self.older = model, byte_letters(), {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS // 2:
            self.older = dict(self)
            self.clear()
        if word in self.older:
            self[word] = out = self.older[word]
            return out
        ids: list[int] = []
        for piece in PIECES.findall(word):
            spelt = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
            ids += [t.id for t in self.model.tokenize(spelt)]
        out = np.array(ids, "<u4").tobytes()
        if len(word) <= CACHE_CHARS:
            self[word] = out
        return out


class WordBpe:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.words = Words(self.library.model)

    def is_plain(self, text: str) -> bool:
        return SPECIAL not in text and UNSAFE.search(text) is None

    def ids(self, text: str) -> bytes:
        if self.is_plain(text):
            return b"".join(map(self.words.__getitem__, text.lower().split()))
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def starts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Start of each token in the text and its id."""
        e = self.library.encode(text, add_special_tokens=False)
        return np.fromiter((o[0] for o in e.offsets), np.int64, len(e.ids)), np.array(e.ids, np.uint32)


def word_bpe(path: str) -> WordBpe:
    """The worker's own encoder for this file."""
    state = worker_state()
    known = state.__dict__.setdefault("word_bpe", {})
    if path not in known:
        known[path] = WordBpe(path)
    return known[path]
