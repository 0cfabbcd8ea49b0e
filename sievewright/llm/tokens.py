"""Encoding with a byte-level BPE of the tokenizers library, with bounded caches.

The pre-tokeniser of such a vocabulary never joins what stands on either side of a
space that follows a character other than white space or precedes one. Texts are
therefore cut before such spaces; the ids of each piece are kept, as most pieces of
a corpus repeat. A new piece of a space and letters is one word to the pre-tokeniser
and goes to the library's model as it is; any other one is cut by the vocabulary's own
pattern first. A text with white space on both sides of a space, or with the string of an
added token, is given to the library whole.
"""

from __future__ import annotations

import re

import numpy as np

#: Pieces and parts whose ids a worker keeps (in two halves, the older one is dropped), and the longest one kept.
CACHE_ROWS = 1_100_000
CACHE_CHARS = 64
#: Pieces kept where other stages share the workers and the memory of their executors: a worker holds less, and spends more time on words.
SMALL_CACHE_ROWS = 200_000

_WIDE = re.compile(r"\s \s")
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_loaded: dict[tuple[str, bool, int], ByteBpe] = {}


class Odd(Exception):
    """A piece whose ids depend on what stands beside it, or that holds an added token."""


def kept(rows: int, make) -> dict[str, bytes]:
    """A dictionary that makes what it lacks, in two generations: when the younger is full, the older one is dropped."""
    half, old = rows // 2, {}

    class Kept(dict):
        def __missing__(self, key: str) -> bytes:
            nonlocal old
            value = old.get(key)
            if value is None:
                value = make(key)
            if len(key) <= CACHE_CHARS:
                if len(self) >= half:
                    old = self.copy()
                    self.clear()
                self[key] = value
            return value

    return Kept()


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class ByteBpe:
    """Encodes texts to little-endian unsigned 32-bit ids.

    plain: strings of added tokens in a text are ordinary text; else they are the tokens, as the library has it by default.
    rows: pieces whose ids are kept; a smaller number costs time, never ids.
    """

    def __init__(self, path: str, plain: bool = False, rows: int = CACHE_ROWS):
        import regex
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain
        self.library.no_padding()
        self.library.no_truncation()
        self.added = [] if plain else [t.content for t in self.library.get_added_tokens_decoder().values()]
        letters, model, cut = byte_letters(), self.library.model, regex.compile(PATTERN)
        space, tokenize = letters[32], model.tokenize
        holds_added = re.compile("|".join(map(re.escape, self.added)) or "(?!)").search
        raw = [k.to_bytes(4, "little") for k in range(self.library.get_vocab_size(with_added_tokens=True))]

        def part(x: str) -> bytes:
            return b"".join([raw[t.id] for t in tokenize(x.encode().decode("latin-1").translate(letters))])

        def word(x: str) -> bytes:
            """The ids of a space and ``x``, which holds no space."""
            if x.isalpha():
                return b"".join([raw[t.id] for t in tokenize(space + (x if x.isascii() else x.encode().decode("latin-1").translate(letters)))])
            if not x or x[0].isspace() or holds_added(x):
                raise Odd
            return regular(" " + x)

        def regular(x: str) -> bytes:
            bare = x.rstrip(_SIGNS)
            if bare[1:].isalpha() and bare[0] == " ":  # a word, and signs that stand together
                return words[bare[1:]] + parts[x[len(bare) :]]
            # a word after a space is a piece of its own elsewhere
            return b"".join([words[p[1:]] if p[0] == " " and p[1:].isalpha() else parts[p] for p in cut.findall(x)])

        parts, words = kept(rows // 8, part), kept(rows, word)
        self.parts, self.words, self.regular, self.holds_added = parts, words, regular, holds_added

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text, without the special tokens that a template would add."""
        if not text:
            return b""
        first, *rest = text.split(" ")
        try:
            if self.holds_added(first):
                raise Odd
            return b"".join([self.regular(first) if first else b"", *map(self.words.__getitem__, rest)])
        except Odd:
            if _WIDE.search(text) or self.holds_added(text):
                return self.whole(text)
            odd = lambda x: not x or x[0].isspace()
            return b"".join([self.regular(first) if first else b"", *(self.regular(" " + x) if odd(x) else self.words[x] for x in rest)])


def load(path: str, plain: bool = False, rows: int = CACHE_ROWS) -> ByteBpe:
    """The encoder of a vocabulary file, one for each worker process."""
    if (path, plain, rows) not in _loaded:
        _loaded[path, plain, rows] = ByteBpe(path, plain, rows)
    return _loaded[path, plain, rows]


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file; every worker has them at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)
