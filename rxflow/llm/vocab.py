"""Public vocabularies, loaded once in each Python process; their files are parameters."""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex

from rxflow.llm.common import hold

#: Words whose ids a process remembers at most, about; each takes some 200 bytes.
CACHE_WORDS = 1_000_000
#: Longer words are encoded whenever they are met.
LONGEST = 64


def vocab_file(name: str) -> str:
    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def ranks_of(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken vocabulary file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=2)
def bytes_of(path: str) -> list[bytes]:
    """The bytes of each id of a tiktoken vocabulary file."""
    ranks = ranks_of(path)
    out = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        out[i] = token
    return out


@lru_cache(maxsize=2)
def tokenizer_of(path: str):
    """A tokenizer of the tokenizers library as its file describes it: added tokens in a text are told from ordinary text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def splitter(pattern: str = public_tokenizers.PATTERN):
    return regex.compile(pattern)


#: In texts without these characters ``re`` (the faster), the regex module and the tokenizers
#: library split alike. Elsewhere their classes differ by Unicode version.
_ODD_FOR_RE = re.compile(r"[^\x00-\x1b\x20-\x84\x86-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]")
_ODD_FOR_TOKENIZERS = re.compile(r"[^\x00-\u052f\u2010-\u2027\u2030-\u205e\u20a0-\u20b5]")
_FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def split(text: str) -> list[str]:
    """The matches of the public pattern."""
    return _FAST.findall(text) if not _ODD_FOR_RE.search(text) else splitter().findall(text)


# White space but blank and line feed, by Unicode or by Python, and the mark that ``chunks`` cuts by.
_OTHER_SPACE = "\0\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def chunks(text: str) -> list[str]:
    """A text cut before each blank and line feed, or the whole text where pieces of the public pattern might cross such a cut.

    Before white space after other characters a piece always starts. Of two white spaces before other characters the
    first is a piece, too, and a run at the end of a text is one. Longer runs and other white space are left alone.
    """
    body = text.rstrip(" \n")
    if "   " in body.replace("\n", " ") or any(c in body for c in _OTHER_SPACE):
        return [text]
    found = body.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
    if len(body) < len(text):
        found.append(text[len(body) :])
    return found


class Words(dict):
    """Ids, as bytes, of the words that were met.

    A word is what ``find`` makes of a text; one that is new is split into pieces, which are words themselves;
    ``encode`` gives the ids of a single piece. Known words live in two generations. When the young one is full it becomes
    the old one, and words that are met again come back from there, so that rare words are forgotten.
    """

    def __init__(self, encode: Callable[[str], bytes], pieces: Callable[[str], list[str]] = split, find: Callable[[str], list[str]] = chunks):
        self.encode, self.pieces, self.find = encode, pieces, find
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            parts = self.pieces(word)
            ids = b"".join(map(self.__getitem__, parts)) if len(parts) > 1 else self.encode(word)
        if len(word) <= LONGEST:
            if len(self) >= CACHE_WORDS // 2:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.find(text)))


# The characters that byte-level vocabularies write for the bytes.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = dict(zip(_SHOWN, _SHOWN)) | {b: 0x100 + k for k, b in enumerate(sorted(set(range(0x100)).difference(_SHOWN)))}


class WordCache:
    """Ids of texts by the tokenizers library, whose model merges every piece that isn't known.

    A text that holds an added token (such as an end mark) is encoded by the library as a whole.
    """

    def __init__(self, path: str):
        self.tokenizer = tokenizer_of(path)
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.kind, self.code = ("<u4", "I") if wide else ("<u2", "H")
        self.words = Words(self._merged, self._pieces)

    def _merged(self, piece: str) -> bytes:
        shown = piece.encode().decode("latin-1").translate(_BYTES)
        return array(self.code, [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _pieces(self, text: str) -> list[str]:
        """By the library's own split where classes differ."""
        if not text.isascii() and _ODD_FOR_TOKENIZERS.search(text):
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return split(text)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, of 16 bits each where the vocabulary allows."""
        if any(a in text for a in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)
        return np.frombuffer(self.words.ids(text), self.kind)

    def encode_all(self, texts: list[str]) -> Iterator[np.ndarray]:
        return map(self.encode, texts)


_caches: dict[str, WordCache] = {}


def words_of(path: str) -> WordCache:
    """The word cache of this process."""
    hold("vocab", _caches.clear)
    if path not in _caches:
        _caches[path] = WordCache(path)
    return _caches[path]
