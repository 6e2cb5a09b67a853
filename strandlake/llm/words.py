"""Words and five-word shingles of many texts at once, as 64-bit hashes.

A word is a run of bytes other than space and tab to carriage return, with A-Z
in lower case. A text's shingles are the distinct runs of five words; with
fewer words, all of them as one; without words, none.
"""

import numpy as np
import pyarrow as pa

WORDS = 5
#: Bytes of text that are hashed together; longer texts alone.
CHUNK = 256 << 10

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)  # odd, so that powers have inverses


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)[_LOWER]
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, base in enumerate((int(_BASE), _inverse(int(_BASE)))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array and the offsets of its values; nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = texts.cast(pa.large_string())
    _, at, data = wide.buffers()
    offsets = np.frombuffer(at, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words in bytes that end in a space."""
    gap = _SPACE[raw]
    change = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if len(gap) and not gap[0]:
        change = np.concatenate(([0], change))
    if len(change) % 2:
        change = np.append(change, len(raw))
    return change[0::2], change[1::2]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word: a polynomial over its bytes from prefix sums, shifted to the word's start; some bytes at a time."""
    out, a, n = np.empty(len(starts), np.uint64), 0, len(starts)
    while a < n:
        base = starts[a]
        b = max(a + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
        s, e = starts[a:b] - base, ends[a:b] - base
        up, down = _powers(int(e[-1]) + 1)
        total = np.zeros(e[-1] + 1, np.uint64)
        np.cumsum(_BYTE[raw[base : base + e[-1]]] * up[:-1], out=total[1:])
        out[a:b] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
        a = b
    return out


def _spaced(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space behind each, so that no word crosses two of them."""
    n = len(offsets) - 1
    where = offsets[1:]
    out = np.insert(raw, where, np.uint8(32))
    return out, offsets + np.arange(n + 1)


def word_runs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts: hash, start and end of each word (in the spaced bytes), and each text's first word with one past the last."""
    spaced, at = _spaced(raw, offsets)
    starts, ends = word_spans(spaced)
    return word_hashes(spaced, starts, ends), starts, ends, np.searchsorted(starts, at)


_LANES = mix(np.arange(11, 11 + WORDS, dtype=np.uint64) * _U(0xA24BAED4963EE407)) | _U(1)


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of the five-word runs of one sequence of word hashes, or of all of it if shorter; with repeats."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    if n < WORDS:
        return mix((words * _LANES[:n]).sum(dtype=np.uint64, keepdims=True) + _U(n))
    h = words[: n - 4] * _LANES[0]
    for k in range(1, WORDS):
        h += words[k : n - 4 + k] * _LANES[k]
    return mix(h + _U(WORDS))


def groups(offsets: np.ndarray, most: int = CHUNK):
    """Row ranges of about so many bytes."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def shingle_runs(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of many texts with repeats, in text order, and each text's first with one past the last."""
    counts = np.diff(first)
    sizes = np.where(counts >= WORDS, counts - (WORDS - 1), np.minimum(counts, 1))
    at = np.concatenate(([0], np.cumsum(sizes)))
    n = len(words)
    if n >= WORDS:
        h = words[: n - 4] * _LANES[0]
        for k in range(1, WORDS):
            h += words[k : n - 4 + k] * _LANES[k]
        full = mix(h + _U(WORDS))
    else:
        full = np.zeros(0, np.uint64)
    out = np.empty(at[-1], np.uint64)
    long = counts >= WORDS
    inside = np.repeat(long, sizes)
    step = np.arange(at[-1]) - np.repeat(at[:-1] - first[:-1], sizes)
    out[inside] = full[step[inside]]
    for k in np.flatnonzero(~long & (counts > 0)):
        out[at[k]] = shingle_hashes(words[first[k] : first[k + 1]])[0]
    return out, at


def distinct_runs(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each range sorted and without repeats; sorts in place."""
    for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if e - s > 1:
            hashes[s:e].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[at[:-1][at[:-1] < len(hashes)]] = True
    return hashes[new], np.concatenate(([0], np.cumsum(new)))[at]


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and each text's first with one past the last."""
    raw, offsets = buffers(texts)
    parts, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in groups(offsets):
        words, _, _, first = word_runs(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        h, at = distinct_runs(*shingle_runs(words, first))
        parts.append(h)
        sizes.append(np.diff(at))
    return np.concatenate(parts), np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype(np.int64)
