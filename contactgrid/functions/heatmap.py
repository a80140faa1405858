"""A square of similarities as text and as a picture."""

from __future__ import annotations

import struct
import zlib

import numpy as np


def tsv(labels: list[str], values: np.ndarray) -> str:
    head = "\t".join(["", *labels])
    return "\n".join([head, *("\t".join([name, *(f"{v:.4f}" for v in row)]) for name, row in zip(labels, values, strict=True))]) + "\n"


def colour(r: float) -> tuple[int, int, int]:
    """Blue for -1 over white for 0 to red for 1; grey for NaN."""
    if r != r:
        return 128, 128, 128
    fade = int(round(255 * (1 - min(1.0, abs(r)))))
    return (255, fade, fade) if r >= 0 else (fade, fade, 255)


def png(values: np.ndarray, cell: int = 32) -> bytes:
    """An RGB picture with a square of `cell` pixels for each value."""
    rgb = np.array([[colour(float(v)) for v in row] for row in values], dtype=np.uint8)
    big = rgb.repeat(cell, axis=0).repeat(cell, axis=1)
    height, width = big.shape[:2]
    raw = b"".join(b"\0" + row.tobytes() for row in big)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
