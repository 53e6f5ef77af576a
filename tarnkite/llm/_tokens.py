"""Words of many texts at once: hashes and places from the UTF-8 bytes, in numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once (a longer text, or word, is one piece).
PIECE = 1 << 20

_draw = np.random.Generator(np.random.PCG64(20240229))
_SLOT = _draw.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEED = _draw.integers(1, 1 << 63, 4, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32  # A-Z count as a-z
#: Keeps the first k of eight bytes.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes up to which a word is hashed among all others; longer ones are rare.
LONG = 64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Splits at every ASCII byte that is no letter or digit.
_OTHER = np.ones(256, bool)
_OTHER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
SEPARATORS = {"space": _SPACE, "other": _OTHER, "characters": _OTHER}
#: Bytes of the characters that begin so and that "characters" takes as words of their own: U+3000 to U+9FFF, U+F000 to U+FFFF and all above, scripts that set no spaces.
_ALONE = np.zeros(256, np.int64)
_ALONE[[*range(0xE3, 0xEA), 0xEF]] = 3
_ALONE[0xF0:0xF5] = 4

def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and where each begins (one more place than texts); null: empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(texts: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about `limit` bytes, or one longer text."""
    at = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
        yield low, high
        low = high


def words(raw: np.ndarray, at: np.ndarray, separator: str = "space") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word in raw, and the number of its text. raw is valid UTF-8."""
    inside = ~SEPARATORS[separator][raw]
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    end[:-1] &= ~inside[1:] | edge[1:-1]
    if separator == "characters":
        first = np.flatnonzero(_ALONE[raw])
        after = first + _ALONE[raw[first]]
        begin[first] = end[after - 1] = True
        end[first[first > 0] - 1] |= inside[first[first > 0] - 1]
        after = after[after < len(raw)]
        begin[after] |= inside[after]
    begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return begin, end, np.searchsorted(at, begin, "right") - 1


def word_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, lane: int = 0, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each word's bytes, A-Z as a-z (if fold); lanes are independent of each other.

    Eight bytes at a time go through a mix that is no linear function of them, so
    no two words collide by their structure; words of one length up to eight
    bytes never do. Long words go through BLAKE2b.
    """
    out = np.empty(len(begin), np.uint64)
    k = 0
    while k < len(begin):
        low = begin[k]
        m = max(k + 1, int(np.searchsorted(end, low + PIECE, "right")))
        piece = np.zeros(int(end[m - 1] - low) + 8, np.uint8)
        piece[:-8] = _LOWER[raw[low : end[m - 1]]] if fold else raw[low : end[m - 1]]
        eights = np.ndarray(len(piece) - 7, "<u8", piece, strides=(1,))
        b, size = begin[k:m] - low, end[k:m] - begin[k:m]
        part = mixed(size.astype(np.uint64) + _SEED[lane])
        live, at = np.flatnonzero(size <= LONG), 0
        while len(live):
            left = size[live] - at
            part[live] = mixed(part[live] ^ ((eights[b[live] + at] & _FIRST[np.minimum(left, 8)]) * _SLOT[lane]))
            live, at = live[left > 8], at + 8
        for x in np.flatnonzero(size > LONG).tolist():
            part[x] = int.from_bytes(hashlib.blake2b(piece[b[x] : b[x] + size[x]], digest_size=8, salt=bytes([lane])).digest(), "little")
        out[k:m] = part
        k = m
    return out


def spans_of(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all ranges start..end, one range after the other."""
    many = end - start
    return np.arange(many.sum()) + np.repeat(start - np.concatenate([[0], np.cumsum(many)[:-1]]), many)


def shingles(hashes: np.ndarray, doc: np.ndarray, n_docs: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each run of `width` words; a text with fewer words is one run."""
    count = np.bincount(doc, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    total = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width):
        total += hashes[k : len(hashes) - width + 1 + k] * _SLOT[k] if len(total) else total
    keep = doc[: len(total)] == doc[width - 1 :] if len(total) else np.zeros(0, bool)
    out, of = mixed(total[keep]), doc[: len(total)][keep]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            some = count[short] > k
            extra[some] += hashes[first[short[some]] + k] * _SLOT[k]
        out = np.concatenate([out, mixed(extra + count[short].astype(np.uint64) * _SLOT[width])])
        of = np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        out, of = out[order], of[order]
    return out, of
