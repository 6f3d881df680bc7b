"""Bit packing of unsigned integers in blocks of 128, with optional deltas."""

from __future__ import annotations

import numpy as np

BLOCK = 128
TRANSFORMS = ("none", "delta", "delta_zigzag")


def pack(values: np.ndarray, transform: str = "none") -> bytes:
    """Each block at the width of its largest value: element size, transform, count, then width and bits block by block."""
    if values.dtype not in (np.uint32, np.uint64):
        raise ValueError("only unsigned integers of 32 or 64 bits are packed")
    size = values.dtype.itemsize
    x = values.copy()
    if transform not in TRANSFORMS:
        raise ValueError(f"no such transform: {transform!r}")
    if transform != "none" and len(x):
        with np.errstate(over="ignore"):
            x[1:] = values[1:] - values[:-1]
            if transform == "delta_zigzag":
                signed = x.view(np.int32 if size == 4 else np.int64)
                x[1:] = ((signed << 1) ^ (signed >> (8 * size - 1))).view(x.dtype)[1:]
    out = [bytes([size, TRANSFORMS.index(transform)]), len(x).to_bytes(8, "little")]
    for at in range(0, len(x), BLOCK):
        block = x[at : at + BLOCK]
        width = int(block.max()).bit_length()
        bits = (block[:, None] >> np.arange(width, dtype=x.dtype)) & x.dtype.type(1)
        out += [bytes([width]), np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()]
    return b"".join(out)


def unpack(raw: bytes) -> np.ndarray:
    size, transform, n = raw[0], TRANSFORMS[raw[1]], int.from_bytes(raw[2:10], "little")
    kind = np.uint32 if size == 4 else np.uint64
    x, pos = np.zeros(n, kind), 10
    for at in range(0, n, BLOCK):
        m, width = min(BLOCK, n - at), raw[pos]
        nbytes = (m * width + 7) // 8
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, nbytes, pos + 1), count=m * width, bitorder="little").reshape(m, width)
        x[at : at + m] = (bits.astype(kind) << np.arange(width, dtype=kind)).sum(1, dtype=kind)
        pos += 1 + nbytes
    if transform != "none" and n:
        if transform == "delta_zigzag":
            one = kind(1)
            x[1:] = ((x >> one) ^ (~(x & one) + one))[1:]
        x = np.cumsum(x, dtype=kind)
    return x
