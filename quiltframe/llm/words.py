"""Hashes of the words of many texts at once, by NumPy over their bytes."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

U = np.uint64
_STEP = 1 << 20
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
#: Words of more bytes are hashed one by one.
_LONG = 128


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _spaces(raw: np.ndarray) -> np.ndarray:
    return (raw == 32) | ((raw - np.uint8(9)) < 5)


def _hash(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some bytes, A-Z as a-z, and where each begins."""
    lower = np.bitwise_or(raw, ((raw - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5))
    gap = np.ones(len(raw) + 2, bool)
    gap[1:-1] = _spaces(raw)
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[0::2], edge[1::2]
    return hashed(lower, start, end), start


def hashed(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of pieces of some bytes; eight bytes of all pieces are mixed in at a time."""
    raw = np.append(raw, np.zeros(8, np.uint8))
    size = end - start
    eight = np.ndarray((len(raw) - 8,), "<u8", raw, strides=(1,))
    h = mix((eight[start] & _MASKS[np.minimum(size, 8)]) ^ size.astype(U) * U(0x2545F4914F6CDD1D))
    left = np.flatnonzero((size > 8) & (size <= _LONG))
    for at in range(8, _LONG, 8):
        if not len(left):
            break
        h[left] = mix((h[left] + U(0x9E3779B97F4A7C15)) ^ (eight[start[left] + at] & _MASKS[np.minimum(size[left] - at, 8)]))
        left = left[size[left] > at + 8]
    for k in np.flatnonzero(size > _LONG):
        h[k] = int.from_bytes(blake2b(raw[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    return h


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of the words of all texts one after another, and the index of the text of each.

    Words are runs of what is no ASCII white space; A-Z count as lower case.
    """
    raw = [t.encode() for t in texts]
    out, of, at = [], [], 0
    while at < len(raw):
        to, size = at, 0
        while to < len(raw) and (to == at or size + len(raw[to]) + 1 < _STEP):
            size += len(raw[to]) + 1
            to += 1
        if size > _STEP:  # one long text, cut where white space allows
            for part in _slices(np.frombuffer(raw[at], np.uint8)):
                out.append(_hash(part)[0])
                of.append(np.full(len(out[-1]), at))
        elif size > to - at:
            h, start = _hash(np.frombuffer(b"\n".join(raw[at:to]), np.uint8))
            ends = np.cumsum([len(r) + 1 for r in raw[at:to]])
            out.append(h)
            of.append(at + np.searchsorted(ends, start, "right"))
        at = to
    if not out:
        return np.zeros(0, U), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(of)


def _slices(raw: np.ndarray) -> list[np.ndarray]:
    """Pieces of about _STEP bytes that end at white space, however far that is."""
    cuts = [0]
    while cuts[-1] < len(raw):
        to = cuts[-1] + _STEP
        while to < len(raw):
            gaps = np.flatnonzero(_spaces(raw[to : to + _STEP]))
            if len(gaps):
                to += int(gaps[0]) + 1
                break
            to += _STEP
        cuts.append(min(to, len(raw)))
    return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
