"""Gray pages as baseline JPEG: cosine transform of 8 x 8 blocks, quantisation, and the file around them."""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

QUALITY = 95
#: The luminance quantisation table at quality 50, and the order in which a block's coefficients are written.
LUMINANCE = (
    (16, 11, 10, 16, 24, 40, 51, 61), (12, 12, 14, 19, 26, 58, 60, 55), (14, 13, 16, 24, 40, 57, 69, 56), (14, 17, 22, 29, 51, 87, 80, 62),
    (18, 22, 37, 56, 68, 109, 103, 77), (24, 35, 55, 64, 81, 104, 113, 92), (49, 64, 78, 87, 103, 121, 120, 101), (72, 92, 95, 98, 112, 100, 103, 99),
)
ZIGZAG = sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8))
#: A quotient this close below a half is rounded up, so that rounding noise decides nothing.
_NOISE = 1e-6


def quantiser(quality: int = QUALITY) -> np.ndarray:
    """The table at a quality from 1 to 100."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(LUMINANCE) * scale + 50) // 100, 1, 255)


@lru_cache(maxsize=1)
def basis() -> np.ndarray:
    """The orthonormal cosine transform of 8 values."""
    k = np.arange(8)
    out = np.cos((2 * k[None] + 1) * k[:, None] * np.pi / 16) / 2
    out[0] /= np.sqrt(2)
    return out


def _blocks(gray: np.ndarray) -> np.ndarray:
    """(rows, columns, 8, 8): the page's blocks; its last row and column are repeated to fill them."""
    h, w = gray.shape
    wide = np.pad(gray, ((0, -h % 8), (0, -w % 8)), "edge")
    return wide.reshape(wide.shape[0] // 8, 8, wide.shape[1] // 8, 8).swapaxes(1, 2)


def coefficients(gray: np.ndarray, quality: int = QUALITY) -> np.ndarray:
    """Quantised coefficients of each block."""
    c = basis()
    return np.floor(c @ (_blocks(gray).astype(float) - 128) @ c.T / quantiser(quality) + 0.5 + _NOISE).astype(np.int32)


def restored(found: np.ndarray, height: int, width: int, quality: int = QUALITY) -> np.ndarray:
    """The page of quantised coefficients."""
    c = basis()
    blocks = np.clip(np.floor(c.T @ (found * quantiser(quality)) @ c + 128.5), 0, 255).astype(np.uint8)
    return blocks.swapaxes(1, 2).reshape(blocks.shape[0] * 8, blocks.shape[1] * 8)[:height, :width]


def lossy(gray: np.ndarray, quality: int = QUALITY) -> np.ndarray:
    """What a reader sees of the page after it has been written."""
    return restored(coefficients(gray, quality), *gray.shape, quality)


def bound(quality: int = QUALITY) -> float:
    """No pixel is off by more: half a step of every coefficient, times its basis, and the last rounding."""
    c = np.abs(basis())
    return float((c.T @ (quantiser(quality) / 2) @ c).max() + 0.5)


def encode(gray: np.ndarray, quality: int = QUALITY) -> bytes:
    """The file. Its Huffman codes are of one length each (4 bits for steps of the mean, 8 for the rest), which any reader takes from the file."""
    h, w = gray.shape
    found = coefficients(gray, quality).reshape(-1, 64)[:, ZIGZAG]
    runs = [(r << 4) | s for r in range(16) for s in range(1, 11)] + [0x00, 0xF0]
    code = {symbol: k for k, symbol in enumerate(runs)}
    bits: list[str] = []

    def value(x: int, size: int) -> str:
        return format(x if x > 0 else x + (1 << size) - 1, f"0{size}b") if size else ""

    before = 0
    for block in found.tolist():
        step, before = block[0] - before, block[0]
        size = abs(step).bit_length()
        bits += [format(size, "04b"), value(step, size)]
        run = 0
        last = max((k for k in range(1, 64) if block[k]), default=0)
        for x in block[1 : last + 1]:
            if not x:
                run += 1
                continue
            bits += [format(code[0xF0], "08b")] * (run // 16)
            size = abs(x).bit_length()
            bits += [format(code[(run % 16) << 4 | size], "08b"), value(x, size)]
            run = 0
        if last < 63:
            bits.append(format(code[0x00], "08b"))
    stream = "".join(bits)
    stream += "1" * (-len(stream) % 8)
    data = int(stream, 2).to_bytes(len(stream) // 8, "big").replace(b"\xff", b"\xff\0") if stream else b""

    def part(mark: int, body: bytes) -> bytes:
        return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body

    def codes(kind: int, length: int, symbols: list[int]) -> bytes:
        return bytes([kind, *(len(symbols) if k == length else 0 for k in range(1, 17)), *symbols])

    table = bytes([0, *quantiser(quality).ravel()[ZIGZAG].tolist()])
    return b"".join((
        b"\xff\xd8", part(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"), part(0xDB, table), part(0xC0, struct.pack(">BHHBBBB", 8, h, w, 1, 1, 0x11, 0)),
        part(0xC4, codes(0x00, 4, list(range(12))) + codes(0x10, 8, runs)), part(0xDA, bytes([1, 1, 0x00, 0, 63, 0])), data, b"\xff\xd9",
    ))
