"""Blocks of documents with a dictionary of their distinct words.

A task reads its documents in blocks of bounded text size. All words of a block
are hashed together with numpy; the block's dictionary holds each distinct word
once, most frequent first, and a document becomes the list of its words'
dictionary positions. Blocks are what lets word-level work (encoding a word,
looking it up in a corpus-wide table) shuffle one row per *distinct* word of a
block instead of one per occurrence, so a frequent word costs one entry per
block, never a hot key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

from salesmatch.llm.packing import offsets

#: Text bytes after which a block is closed. Bounds a worker's memory; a single
#: longer document makes a block of its own.
BLOCK_BYTES = 8 << 20
#: Rows of a block at most: null and empty texts fill none of its bytes.
BLOCK_ROWS = 1 << 16
#: Bytes hashed at once; longer words are hashed one by one.
_WINDOW = 1 << 18
#: Odd multipliers of the two polynomial hashes.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _ws_places(a: np.ndarray) -> np.ndarray:
    """Places of the ASCII white-space bytes."""
    return np.flatnonzero((a == 32) | ((a - np.uint8(9)) < 5))


def word_spans(a: np.ndarray, doc_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without ASCII white space; no run crosses a document's end."""
    p = _ws_places(a)
    starts = np.insert(p + 1, np.searchsorted(p, doc_at[:-1]), doc_at[:-1])
    ends = np.insert(p, np.searchsorted(p, doc_at[1:]), doc_at[1:])
    keep = ends > starts
    return starts[keep], ends[keep]


def chunk_spans(a: np.ndarray, doc_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut each text before every ASCII white-space run that follows a character
    which is surely not white space, so that the chunks joined are the text.

    The pre-token patterns used here never match across such a place, so a text's
    tokens are its chunks' tokens, joined. After a character that may count as
    white space (\\x1c-\\x1f, U+0085, U+00A0 and the three-byte spaces) no cut is
    made; a longer chunk is always safe.
    """
    p = _ws_places(a)
    b1, b2, b3 = (np.where(p >= k, a[np.maximum(p - k, 0)], 0) for k in (1, 2, 3))
    unsafe = (b1 == 32) | ((b1 >= 9) & (b1 <= 13)) | ((b1 >= 0x1C) & (b1 <= 0x1F))
    unsafe |= (b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))
    unsafe |= ((b3 == 0xE2) & ((b2 == 0x80) | (b2 == 0x81))) | ((b3 == 0xE1) & (b2 == 0x9A)) \
        | ((b3 == 0xE3) & (b2 == 0x80))
    starts = np.sort(np.concatenate((p[~unsafe], doc_at[:-1][np.diff(doc_at) > 0])))
    starts = starts[np.diff(starts, prepend=-1) > 0]
    return starts, np.append(starts[1:], len(a))[:len(starts)]


def _power_tables() -> list[tuple[np.ndarray, np.ndarray]]:
    if not _powers:
        for base in _BASES:
            pair = []
            for b in (base, pow(base, -1, 1 << 64)):
                p = np.full(_WINDOW + 1, b, np.uint64)
                p[0] = 1
                pair.append(np.multiply.accumulate(p))
            _powers.append((pair[0], pair[1]))
    return _powers


def span_keys(a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each span's bytes."""
    n = len(starts)
    out = (np.empty(n, np.uint64), np.empty(n, np.uint64))
    i = 0
    while i < n:
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + _WINDOW, "right")))
        hi = ends[j - 1]
        if hi - lo > _WINDOW:
            word = a[lo:hi].tobytes()
            out[0][i], out[1][i] = xxhash.xxh64_intdigest(word, 1), xxhash.xxh64_intdigest(word, 2)
        else:
            c = a[lo:hi].astype(np.uint64) + np.uint64(1)
            s, e = starts[i:j] - lo, ends[i:j] - lo
            size = (e - s).astype(np.uint64)
            for k, (power, inverse) in enumerate(_power_tables()):
                total = np.zeros(len(c) + 1, np.uint64)
                np.cumsum(c * power[:len(c)], out=total[1:])
                h = (total[e] - total[s]) * inverse[s] + size
                h ^= h >> np.uint64(29)
                h *= np.uint64(0xBF58476D1CE4E5B9)
                out[k][i:j] = h ^ (h >> np.uint64(32))
        i = j
    return out


@dataclass
class Block:
    """key identifies the block's content; its dictionary is ordered by falling
    frequency, with the words' hashes and counts; index holds the dictionary
    position of every word, doc_at the place of each document's first word in it."""

    key: int
    hashes: np.ndarray
    counts: np.ndarray
    index: np.ndarray
    doc_at: np.ndarray
    text: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def words(self) -> list[bytes]:
        """The dictionary."""
        return [self.text[i:j].tobytes() for i, j in zip(self.starts.tolist(), self.ends.tolist())]

    def joined(self, some: np.ndarray) -> tuple[np.ndarray, bytes]:
        """Lengths of some dictionary words, and the words joined."""
        size = self.ends[some] - self.starts[some]
        out = offsets(size)
        return size, self.text[np.arange(out[-1]) + np.repeat(self.starts[some] - out[:-1], size)].tobytes()


def _distinct(k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """First place and number of each word by one sort of (hash, place) packed
    into 64 bits; None if the shortened hashes do not tell the words apart."""
    n = len(k1)
    bits = max(1, int(n).bit_length())
    low = np.uint64((1 << bits) - 1)
    packed = np.sort((k1 & ~low) | np.arange(n, dtype=np.uint64))
    place = (packed & low).astype(np.int64)
    packed &= ~low
    first = np.ones(n, bool)
    first[1:] = packed[1:] != packed[:-1]
    number = np.cumsum(first) - 1
    head = place[first]
    same = head[number]
    if (k1[place] != k1[same]).any() or (k2[place] != k2[same]).any():
        return None
    index = np.empty(n, np.int64)
    index[place] = number
    return head, index


def make_block(text: np.ndarray, at: np.ndarray, spans) -> Block:
    """The block of the texts ``text[at[i]:at[i + 1]]`` (bytes)."""
    starts, ends = spans(text, at)
    k1, k2 = span_keys(text, starts, ends)
    doc_at = np.searchsorted(starts, at)
    digest = xxhash.xxh64(k1.tobytes())
    digest.update(doc_at.tobytes())
    found = _distinct(k1, k2)
    if found is None:  # number the words one by one
        seen: dict[bytes, int] = {}
        index = np.array([seen.setdefault(text[s:e].tobytes(), len(seen)) for s, e in zip(starts, ends)], np.int64)
        head = np.unique(index, return_index=True)[1]
    else:
        head, index = found
    counts = np.bincount(index, minlength=len(head))
    order = np.lexsort((k1[head], -counts))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    head = head[order]
    return Block(digest.intdigest() - (1 << 63), k1[head], counts[order], place[index], doc_at,
                 text, starts[head], ends[head])


def block_of(texts: list[bytes], spans) -> Block:
    """A block of some texts."""
    return make_block(np.frombuffer(b"".join(texts), np.uint8), offsets(np.array([len(t) for t in texts])), spans)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and where each row begins and ends in them."""
    column = column.cast(pa.large_string())
    _, edge, data = column.buffers()
    at = np.frombuffer(edge, np.int64)[column.offset:column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def blocks(batches, text: str, spans, block_bytes: int = BLOCK_BYTES, block_rows: int = BLOCK_ROWS) -> Iterator[tuple[list, Block]]:
    """Cut Arrow batches into blocks of bounded bytes and rows: yields (a list of the block's batch slices, its Block).

    Blocks follow the order of rows, so the same rows give the same blocks again.
    """
    parts, data, sizes, size, held = [], [], [], 0, 0

    def block():
        return parts, make_block(np.concatenate(data), offsets(np.concatenate(sizes)), spans)

    for batch in batches:
        if not batch.num_rows:
            continue
        raw, at = _bytes_of(batch.column(text))
        i = 0
        while i < batch.num_rows:
            j = min(int(np.searchsorted(at, at[i] + block_bytes - size, "right")) - 1, i + block_rows - held)
            if j <= i:
                if parts:
                    yield block()
                    parts, data, sizes, size, held = [], [], [], 0, 0
                    continue
                j = i + 1
            parts.append(batch.slice(i, j - i))
            data.append(raw[at[i]:at[j]])
            sizes.append(np.diff(at[i:j + 1]))
            size += int(at[j] - at[i])
            held += j - i
            i = j
    if parts:
        yield block()
