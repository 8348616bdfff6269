"""Token ids of whole texts by the ``tokenizers`` library, inside tasks.

Byte-level BPE never joins characters across the start of a space that
follows another character, so a text is a sequence of space-led words whose
ids do not depend on their neighbours. The library encodes each distinct
word once per worker; a text's ids are the concatenation. Texts for which
that does not hold (white space on both sides of a space, or special tokens)
go through the library whole. The memo holds at most ``MAX_WORDS`` words, or
as many as its user asks for: a rare word costs far more than a remembered one.
"""

from __future__ import annotations

import json
import os
import re
import string
from functools import lru_cache

import numpy as np

MAX_WORDS = 500_000
LONG = 64
_NOT_SPLITTABLE = re.compile(r"\s (?:\s|\Z)")
_MARKS = string.punctuation
_LATIN_END = "\u0250"


def byte_characters() -> list[str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, others move up from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    moved = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(moved)) for b in range(256)]


class _Words(dict):
    """word -> ids of the word after a space, learnt when first met."""

    def __init__(self, learn, most: int | None = None):
        super().__init__()
        self.learn, self.most = learn, most

    def __missing__(self, word: str) -> bytes:
        if len(self) >= (self.most or MAX_WORDS):
            self.clear()
        ids = self.learn(word)
        if len(word) <= LONG:  # longer ones seldom come again, and would fill the memory
            self[word] = ids
        return ids


def _latin(word: str) -> bool:
    return word.isalpha() and (word.isascii() or max(word) < _LATIN_END)


class WordMemo:
    """Encodes texts word by word. Subclasses give ``whole(text)`` and
    ``stem(word of Latin letters, whether a space leads it)``, as bytes."""

    def __init__(self, special: list[str], splittable: bool, most: int | None = None):
        self.special, self.splittable = special, splittable
        self.words = _Words(self._after_space, most)
        self.firsts: dict[str, bytes] = {}
        #: Words that begin with white space, or are empty: only next to them a split may be wrong.
        self.odd: set[str] = set()

    def _after_space(self, w: str) -> bytes:
        if _latin(w):  # one pre-token
            return self.stem(w, True)
        stem = w.rstrip(_MARKS)
        if _latin(stem):  # and a run of marks
            return self.words[stem] + self._first(w[len(stem):])
        a, line, b = w.partition("\n")
        if line and a and not a[-1].isspace() and b and not b[0].isspace():  # a line's last word, the break, and the next line's first
            return self.words[a] + self._first("\n") + self._first(b)
        if not w or w[0].isspace():
            self.odd.add(w)
        return self.whole(" " + w)

    def _first(self, w: str) -> bytes:
        """Ids of a word that no space leads."""
        ids = self.firsts.get(w)
        if ids is None:
            if len(self.firsts) > (self.words.most or MAX_WORDS) // 10:
                self.firsts.clear()
            stem = w.rstrip(_MARKS)
            ids = self.firsts[w] = self.stem(w, False) if _latin(w) \
                else self._first(stem) + self._first(w[len(stem):]) if _latin(stem) else self.whole(w)
        return ids

    def encode(self, text: str) -> bytes:
        if not self.splittable or any(s in text for s in self.special):
            return self.whole(text)
        if len(self.odd) > MAX_WORDS // 10:  # forgotten together, between texts
            self.words.clear()
            self.odd.clear()
        words = text.split(" ")
        ids = self._first(words[0]) + b"".join(map(self.words.__getitem__, words[1:]))
        if self.odd and not self.odd.isdisjoint(words) and _NOT_SPLITTABLE.search(text):
            return self.whole(text)
        return ids

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian uint32."""
        return list(map(self.encode, texts))


class WordEncoder(WordMemo):
    """Ids by the ``tokenizers`` library."""

    def __init__(self, path: str, most: int | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        parts = json.loads(self.tokenizer.to_str())
        pre = parts["pre_tokenizer"] or {}
        byte_level = (parts["normalizer"] is None and pre.get("type") == "ByteLevel"
                      and pre.get("use_regex") is True and pre.get("add_prefix_space") is False)
        self.alphabet = byte_characters()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.packed = [i.to_bytes(4, "little") for i in range(max(vocab.values()) + 1)]
        super().__init__([t.content for t in self.tokenizer.get_added_tokens_decoder().values()], byte_level, most)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def stem(self, word: str, led: bool) -> bytes:
        mapped = "Ġ" * led + (  # the byte-level alphabet's space
            word if word.isascii() else "".join(map(self.alphabet.__getitem__, word.encode())))
        return b"".join([self.packed[t.id] for t in self.tokenizer.model.tokenize(mapped)])


@lru_cache(maxsize=4)
def encoder(path: str, most: int | None = None) -> WordEncoder:
    """The worker's encoder for a vocabulary file, remembering at most ``most`` words (``MAX_WORDS`` if not given)."""
    return WordEncoder(path, most)


def release() -> None:
    """Give up the worker's encoders and their memos, before a task that needs the room for its own."""
    encoder.cache_clear()


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
