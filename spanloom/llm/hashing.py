"""Hashes of character ranges and of word runs, in numpy batches."""

from __future__ import annotations

import functools
import hashlib
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Characters taken into one numpy batch; a longer text is a batch of its own.
BATCH_CHARS = 1 << 18


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of BASE and of its inverse modulo 2**64, at least n + 1 of them; kept between calls."""
    if len(_POWERS[0]) <= n:
        for k, b in enumerate((int(BASE), pow(int(BASE), -1, 1 << 64))):
            p = np.full(2 * n + 2, np.uint64(b))
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return h ^ (h >> np.uint64(29))


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Running sums from which `range_hashes` takes the hash of any range."""
    m = len(codes)
    up, _ = powers(m)
    s = np.zeros(m + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(mixed(codes.astype(np.uint64) + np.uint64(1)) * up[:m], out=s[1:])
    return s


def range_hashes(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of the ranges [a, b); equal ranges have equal hashes wherever they stand."""
    with np.errstate(over="ignore"):
        return mixed((s[b] - s[a]) * powers(len(s))[1][a])


@functools.lru_cache(maxsize=1)
def letters_and_digits() -> np.ndarray:
    """For each code point whether it is a letter or a number; none is beyond the first four planes."""
    out = np.zeros(sys.maxunicode + 1, bool)
    out[:0x40000] = np.fromiter((unicodedata.category(chr(c))[0] in "LN" for c in range(0x40000)), bool, 0x40000)
    return out


def _batches(texts: list[str]) -> Iterator[list[str]]:
    part: list[str] = []
    n = 0
    for t in texts:
        if part and n + len(t) > BATCH_CHARS:
            yield part
            part, n = [], 0
        part.append(t)
        n += len(t) + 1
    if part:
        yield part


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, laid end to end, and the number of words of each text.

    A word is a maximal run of letters and digits of the lower-cased text.
    """
    words, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    is_word = letters_and_digits()
    for part in _batches([t.lower() for t in texts]):
        c = codes_of("\n".join(part))
        inside = np.zeros(len(c) + 2, np.int8)
        inside[1:-1] = is_word[c]
        d = np.diff(inside)
        a, b = np.flatnonzero(d == 1), np.flatnonzero(d == -1)
        words.append(range_hashes(prefix_sums(c), a, b) if len(a) else np.zeros(0, np.uint64))
        ends = np.cumsum([len(t) + 1 for t in part])
        sizes.append(np.diff(np.searchsorted(a, ends), prepend=0))
    return np.concatenate(words), np.concatenate(sizes)


def run_hashes(words: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of `n` words of each text as hashes, ascending within a text, laid end to end; runs per text."""
    total = len(words) - n + 1
    if total <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(sizes), np.int64)
    with np.errstate(over="ignore"):
        h = words[:total].copy()
        for k in range(1, n):
            h = mixed(h * STEP + words[k : k + total])
    row = np.repeat(np.arange(len(sizes)), sizes)
    one = row[:total] == row[n - 1 :]
    h, row = h[one], row[:total][one]
    of = np.bincount(row, minlength=len(sizes))
    ends = np.cumsum(of)
    for a, b in zip(ends - of, ends):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.bincount(row[new], minlength=len(sizes))


def digests(runs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(texts, 2) int64: a 128-bit digest of each text's runs."""
    ends = np.cumsum(sizes)
    raw = b"".join(hashlib.blake2b(runs[a:b].tobytes(), digest_size=16).digest() for a, b in zip(ends - sizes, ends))
    return np.frombuffer(raw, np.int64).reshape(-1, 2)


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """A list column of the values laid end to end."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column without nulls, laid end to end, and the size of each list."""
    v = column.flatten().to_numpy(zero_copy_only=False)
    return v, np.diff(column.offsets.to_numpy()).astype(np.int64)
