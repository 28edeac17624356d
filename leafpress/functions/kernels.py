"""Image kernels on numpy arrays: gray, blur, adaptive threshold, non-local means.

Pages of one size may be stacked; the last two axes (three with channels) are a page's own.
"""

from __future__ import annotations

import numpy as np

#: Kernel sizes, block size, offset and strength of the cleaning chain.
BLUR_TAPS = (1, 4, 6, 4, 1)
THRESHOLD_BLOCK, THRESHOLD_OFFSET = 11, 2
DENOISE_STRENGTH, TEMPLATE, SEARCH = 10.0, 7, 21


def to_gray(pixels: np.ndarray) -> np.ndarray:
    """(..., height, width) uint8 from pixels with 1, 3 (BGR) or 4 (BGRA) channels last, by fixed-point weights."""
    if pixels.shape[-1] == 1:
        return pixels[..., 0].astype(np.uint8)
    b, g, r = (pixels[..., k].astype(np.int64) for k in range(3))
    return ((9798 * r + 19235 * g + 3735 * b + 16384) >> 15).astype(np.uint8)


def oriented(pixels: np.ndarray, orientation: int) -> np.ndarray:
    """(height, width, ...) as it is to be seen, from the orientation (1 to 8) that a camera noted; other values leave it."""
    turn = {
        2: lambda p: p[:, ::-1], 3: lambda p: p[::-1, ::-1], 4: lambda p: p[::-1], 5: lambda p: p.swapaxes(0, 1),
        6: lambda p: p[::-1].swapaxes(0, 1), 7: lambda p: p[::-1, ::-1].swapaxes(0, 1), 8: lambda p: p[:, ::-1].swapaxes(0, 1),
    }
    return turn[orientation](pixels) if orientation in turn else pixels


def _padded(image: np.ndarray, reach: int, mode: str) -> np.ndarray:
    """Pads the last two axes; where an axis is too short to mirror, its edge is repeated."""
    out = image.astype(float)
    for axis in (-2, -1):
        n = out.shape[axis]
        short = n <= reach if mode == "reflect" else n < reach
        pads = [(0, 0)] * out.ndim
        pads[axis] = (reach, reach)
        out = np.pad(out, pads, "edge" if short else mode)
    return out


def _separable(image: np.ndarray, taps: np.ndarray, mode: str) -> np.ndarray:
    wide = _padded(image, len(taps) // 2, mode)
    h, w = image.shape[-2:]
    rows = sum(t * wide[..., k : k + h, :] for k, t in enumerate(taps))
    return sum(t * rows[..., :, k : k + w] for k, t in enumerate(taps))


def blur(gray: np.ndarray) -> np.ndarray:
    """5x5 Gaussian, borders mirrored without the edge pixel, rounded once."""
    return np.clip(np.floor(_separable(gray, np.array(BLUR_TAPS) / 16.0, "reflect") + 0.5), 0, 255).astype(np.uint8)


def adaptive_threshold(gray: np.ndarray) -> np.ndarray:
    """255 where a pixel exceeds its Gaussian neighbourhood mean less the offset, else 0."""
    sigma = 0.3 * ((THRESHOLD_BLOCK - 1) * 0.5 - 1) + 0.8
    x = np.arange(THRESHOLD_BLOCK) - THRESHOLD_BLOCK // 2
    taps = np.exp(-(x**2) / (2 * sigma**2))
    mean = np.floor(_separable(gray, taps / taps.sum(), "edge") + 0.5)
    return np.where(gray.astype(np.int64) - mean > -THRESHOLD_OFFSET, 255, 0).astype(np.uint8)


def _sevens(a: np.ndarray) -> np.ndarray:
    """Sums of seven rows that follow each other: of one, two and four."""
    two = a[..., :-1, :] + a[..., 1:, :]
    four = two[..., :-2, :] + two[..., 2:, :]
    out = four[..., :-3, :] + two[..., 4:-1, :]
    out += a[..., 6:, :]
    return out


def _boxes(bits: np.ndarray) -> np.ndarray:
    """Sums of all boxes of TEMPLATE x TEMPLATE ones, in bytes."""
    return _sevens(_sevens(bits).swapaxes(-1, -2)).swapaxes(-1, -2)


def _denoise_binary(gray: np.ndarray, strength: float) -> np.ndarray:
    """``denoise`` of 0 and 255 alone, to the bit: a template's distance is the number of pixels that differ, so it is counted in bytes and its weight looked up."""
    t, s = TEMPLATE // 2, SEARCH // 2
    k = TEMPLATE
    h, w = gray.shape[-2:]
    wide = _padded(gray, s + t, "symmetric") > 0
    home = wide[..., s : s + h + 2 * t, s : s + w + 2 * t]
    # Weights as the distances would give them, in an array of the kernel's own type.
    likes = np.exp(-np.maximum(np.arange(k**2 + 1) * 255.0**2 / k**2, 0) / strength**2)
    total, weight = np.zeros(gray.shape), np.zeros(gray.shape)
    for dy in range(2 * s + 1):
        for dx in range(2 * s + 1):
            away = wide[..., dy : dy + h + 2 * t, dx : dx + w + 2 * t]
            like = likes[_boxes((home ^ away).view(np.uint8))]
            weight += like
            like *= away[..., t : t + h, t : t + w]
            total += like
    return np.clip(np.floor(255 * total / weight + 0.5), 0, 255).astype(np.uint8)


#: Pixels that are denoised at a time, so that what a shift of the window needs stays in a core's cache.
BLOCK_PIXELS = 1 << 15


def denoise(gray: np.ndarray, strength: float = DENOISE_STRENGTH) -> np.ndarray:
    """Non-local means: each pixel is the mean of its search window, weighted by template likeness."""
    if gray.ndim > 2 and len(gray) > 1 and (step := max(1, BLOCK_PIXELS // max(1, gray[0].size))) < len(gray):
        return np.concatenate([denoise(gray[k : k + step], strength) for k in range(0, len(gray), step)])
    if not ((gray != 0) & (gray != 255)).any():
        return _denoise_binary(gray, strength)
    t, s = TEMPLATE // 2, SEARCH // 2
    k = TEMPLATE
    h, w = gray.shape[-2:]
    wide = _padded(gray, s + t, "symmetric")
    home = wide[..., s : s + h + 2 * t, s : s + w + 2 * t]
    total, weight = np.zeros(gray.shape), np.zeros(gray.shape)
    edge = [(0, 0)] * (gray.ndim - 2) + [(1, 0), (1, 0)]
    for dy in range(2 * s + 1):
        for dx in range(2 * s + 1):
            away = wide[..., dy : dy + h + 2 * t, dx : dx + w + 2 * t]
            sums = np.pad(((home - away) ** 2).cumsum(-2).cumsum(-1), edge)
            distance = (sums[..., k:, k:] - sums[..., :-k, k:] - sums[..., k:, :-k] + sums[..., :-k, :-k]) / k**2
            like = np.exp(-np.maximum(distance, 0) / strength**2)
            total += like * away[..., t : t + h, t : t + w]
            weight += like
    return np.clip(np.floor(total / weight + 0.5), 0, 255).astype(np.uint8)


def clean_gray(gray: np.ndarray) -> np.ndarray:
    """The chain after gray: blur, threshold, denoise."""
    return denoise(adaptive_threshold(blur(gray)))


def clean(pixels: np.ndarray) -> np.ndarray:
    """The whole chain, fused: gray, blur, threshold, denoise. (..., height, width, channels) to (..., height, width)."""
    return clean_gray(to_gray(pixels))
