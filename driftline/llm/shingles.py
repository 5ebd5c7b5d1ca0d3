"""Word and shingle hashes of whole texts, computed over the bytes of many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes handled at once; a longer text is a range of its own.
SLICE_BYTES = 1_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if "up" not in _powers or len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            factors = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
            factors[0] = 1
            _powers[name] = np.multiply.accumulate(factors)
    return _powers["up"], _powers["down"]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, lower-cased A-Z, and offsets. Null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8, int(bounds[-1] - bounds[0]), int(bounds[0])) if data is not None and bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    return _LOWER[raw], bounds - bounds[0]


def word_hashes(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (maximal run of bytes that are no ASCII white space) and the offsets of each text's words."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    inside = ~_SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[ends] = True
    starts = np.flatnonzero(inside & (edge[:-1] | np.concatenate([[True], ~inside[:-1]])))
    stops = np.flatnonzero(inside & (edge[1:] | np.concatenate([~inside[1:], [True]]))) + 1
    up, down = _power(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[raw] * up[:n], out=total[1:])
    return mix((total[stops] - total[starts]) * down[starts]), np.searchsorted(starts, ends)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words of a text, or of all its words if they are fewer; and each one's text."""
    n = np.diff(bounds)
    out, of = [], []
    if len(words) >= size:
        last = len(words) - size + 1
        h = mix(words[:last] + np.uint64(size))
        for k in range(1, size):
            h = mix(h + words[k : last + k])
        text = np.repeat(np.arange(len(n)), n)
        whole = text[:last] == text[size - 1 :]
        out.append(h[whole])
        of.append(text[:last][whole])
    for k in range(1, size):
        few = np.flatnonzero(n == k)
        if len(few):
            h = mix(words[bounds[few]] + np.uint64(k))
            for j in range(1, k):
                h = mix(h + words[bounds[few] + j])
            out.append(h)
            of.append(few)
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(out) == 1:
        return out[0], of[0]
    h, of = np.concatenate(out), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return h[order], of[order]


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw, ends = text_bytes(texts)
    words, bounds = word_hashes(raw, ends)
    h, of = shingle_hashes(words, bounds, size)
    at = np.searchsorted(of, np.arange(len(ends)))
    return [np.unique(h[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
