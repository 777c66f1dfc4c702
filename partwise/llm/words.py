"""Vectorised work on the ASCII-space-separated words of whole texts."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The six characters that separate words.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keyed(n: int, seed: int) -> np.ndarray:
    """``n`` pseudo-random unsigned 64-bit values of a seed."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003 % 2**63)) * _MIX)


_BYTE = keyed(256, 11)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]


def give_back() -> None:
    """Return freed memory to the system: workers are reused, and what one stage held would be missing in the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library: its allocator is left to itself
        pass


def slices(array: pa.Array, most: int = 2 << 20):
    """Cut a string column into runs of at most ``most`` bytes (a longer text stands alone): (first, after)."""
    lengths = pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.concatenate([[0], np.cumsum(lengths)])
    at = 0
    while at < len(array):
        end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + most, "right")) - 1)
        yield at, min(end, len(array))
        at = min(end, len(array))


def parts(text: bytes, most: int = 2 << 20) -> list[bytes]:
    """A long text cut at spaces, so that the arrays below stay small; one endless word stays whole."""
    out, at = [], 0
    while len(text) - at > most:
        end = next((i for i in range(at + most, len(text)) if text[i] in SPACES), len(text))
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def word_hashes(texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of the texts in order, and the number of words of each text."""
    if len(texts) == 1 and len(texts[0]) > 3 << 20:
        done = [_word_hashes([p], lower) for p in parts(texts[0])]
        return np.concatenate([h for h, _ in done]), np.array([sum(int(n[0]) for _, n in done)])
    return _word_hashes(texts, lower)


def _word_hashes(texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        buffer = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        lengths = np.array([len(t) + 1 for t in texts], np.int64)
        space = _IS_SPACE[buffer]
        starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        if not len(starts):
            return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
        powers = np.empty(len(buffer), np.int64)
        first = np.zeros(len(buffer), np.int64)
        first[starts] = starts
        np.maximum.accumulate(first, out=first)
        np.subtract(np.arange(len(buffer)), first, out=powers)
        del first
        longest = int(powers.max()) + 1
        base = np.cumprod(np.full(longest, np.uint64(0xD6E8FEB86659FD93)), dtype=np.uint64)
        value = (_LOWER if lower else _BYTE)[buffer] * base[powers]
        value[space] = 0
        hashes = mix64(np.add.reduceat(value, starts))
        ends = np.cumsum(lengths)
        per = np.diff(np.concatenate([[0], np.searchsorted(starts, ends)]))
        return hashes, per


def shingle_sets(texts: list[bytes | None], width: int, lower: bool = True) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than ``width`` make one shingle, none an empty set."""
    hashes, counts = word_hashes([t or b"" for t in texts], lower)
    out, at = [], 0
    weights = keyed(width, 7) | np.uint64(1)
    with np.errstate(over="ignore"):
        for n in counts.tolist():
            own = hashes[at : at + n]
            at += n
            if n < width:
                out.append(mix64((own * weights[:n]).sum(keepdims=True) + np.uint64(n)) if n else own)
                continue
            s = own[: n - width + 1] * weights[0]
            for i in range(1, width):
                s += own[i : n - width + 1 + i] * weights[i]
            out.append(np.unique(mix64(s + np.uint64(width))))
    return out
