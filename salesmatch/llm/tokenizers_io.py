"""Encoders of single words for the three kinds of vocabulary files.

Each ``make_*`` returns a picklable factory; a task calls it once and gets a
function from words (bytes) to lists of ids. Pieces inside a word are kept in a
bounded cache: words such as ``foo,`` and ``foo.`` share the piece ``foo``.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable

#: Pieces kept in a task's cache before it is started anew.
CACHE_PIECES = 100_000

#: Fixed values of the public vocabularies: how text is split before merging.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies."""
    same = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(same)]
    return {b: chr(b) for b in same} | {b: chr(256 + i) for i, b in enumerate(rest)}


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 token and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def make_rank_encoder(path: str, pattern: str) -> Callable:
    """Words by the tiktoken library: each pattern match is merged by itself; no special tokens."""

    def make():
        import regex
        import tiktoken

        enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})
        split, cache = regex.compile(pattern).findall, {}

        def piece(p: str):
            ids = cache.get(p)
            if ids is None:
                if len(cache) >= CACHE_PIECES:
                    cache.clear()
                ids = cache[p] = enc._encode_single_piece(p)
            return ids

        return lambda words: [[i for p in split(w.decode()) for i in piece(p)] for w in words]

    return make


def make_library_encoder(path: str, pattern: str, lower: bool) -> Callable:
    """Words by the tokenizers library, special tokens' strings being ordinary text.

    For words of letters below U+0250 (already in NFC) the lower-casing, the split
    and the byte letters are done here, and the library's model merges the pieces,
    which is twice as fast as its whole chain; all other words take that chain.
    """

    def make():
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        model = tok.model
        split, letters, cache = regex.compile(pattern).findall, _byte_letters(), {}
        easy = regex.compile("[\\x21-\\x7e\\u00a1-\\u024f \\n]+").fullmatch

        def piece(p: str):
            ids = cache.get(p)
            if ids is None:
                if len(cache) >= CACHE_PIECES:
                    cache.clear()
                ids = cache[p] = [t.id for t in model.tokenize("".join([letters[b] for b in p.encode()]))]
            return ids

        def encode(w: bytes) -> list[int]:
            s = w.decode()
            if not easy(s):
                return tok.encode(s, add_special_tokens=False).ids
            if lower:
                s = s.lower()
            return [i for p in split(s) for i in piece(p)]

        return lambda words: [encode(w) for w in words]

    return make
