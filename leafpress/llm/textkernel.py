"""Vectorized text kernels: texts as arrays of code points, with tables per code point."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Planes 0 to 3 hold every assigned letter; larger code points count as the last one (unassigned).
_TABLE = 0x40000

#: First code points of Unicode script ranges, with the script's name.
SCRIPT_STARTS = (
    (0x0041, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"),
    (0x0A80, "Gujarati"), (0x0B00, "Other"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"),
    (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"),
    (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"),
    (0x1780, "Khmer"), (0x1800, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"),
    (0x2C60, "Latin"), (0x2C80, "Other"), (0x2DE0, "Cyrillic"), (0x2E00, "Other"), (0x2E80, "Han"),
    (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"), (0x31F0, "Kana"), (0x3200, "Han"),
    (0xA000, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xAB30, "Latin"), (0xAB70, "Other"),
    (0xAC00, "Hangul"), (0xD800, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Armenian"),
    (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFE70, "Arabic"), (0xFF00, "Latin"),
    (0xFF65, "Kana"), (0xFFA0, "Hangul"), (0x10000, "Other"), (0x20000, "Han"), (0x323B0, "Other"),
)
SCRIPTS = tuple(dict.fromkeys(name for _, name in SCRIPT_STARTS))


def codes(text: str) -> np.ndarray:
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), _TABLE - 1)


@lru_cache(maxsize=1)
def lower_table() -> np.ndarray:
    low = np.arange(_TABLE, dtype=np.uint32)
    for i in range(0x1F000):
        if len(c := chr(i).lower()) == 1:
            low[i] = ord(c)
    return low


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """2 for letters, 1 for marks, 0 for the rest."""
    out = np.zeros(_TABLE, np.uint8)
    for i in range(_TABLE):
        c = chr(i)
        out[i] = 2 if c.isalpha() else unicodedata.category(c) in ("Mn", "Mc")
    return out


@lru_cache(maxsize=1)
def space_table() -> np.ndarray:
    out = np.zeros(_TABLE, bool)
    out[[i for i in range(0x3001) if chr(i).isspace()]] = True
    return out


@lru_cache(maxsize=1)
def case_table() -> np.ndarray:
    """1 upper-case, 2 lower-case, 3 digit, 4 other letter, 0 the rest."""
    out = np.zeros(_TABLE, np.uint8)
    for i in range(0x1F000):
        c = chr(i)
        out[i] = 1 if c.isupper() else 2 if c.islower() else 3 if c.isdigit() else 4 if c.isalpha() else 0
    return out


@lru_cache(maxsize=1)
def word_table() -> np.ndarray:
    """True for letters, marks and digits."""
    return (letter_table() > 0) | (case_table() == 3)


@lru_cache(maxsize=1)
def script_table() -> np.ndarray:
    starts = np.array([0, *(s for s, _ in SCRIPT_STARTS)])
    names = np.array([SCRIPTS.index("Other"), *(SCRIPTS.index(n) for _, n in SCRIPT_STARTS)], np.uint8)
    return names[np.searchsorted(starts, np.arange(_TABLE), "right") - 1]


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.diff(np.concatenate(([0], inside.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the splitmix finalizer)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def word_hashes(code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of code[start:end]; equal words get equal hashes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    flat = code[np.repeat(starts, lengths) + at]
    with np.errstate(over="ignore"):
        each = mix64(flat.astype(np.uint64) + (at.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        return mix64(np.add.reduceat(each, np.cumsum(lengths) - lengths) + lengths.astype(np.uint64))


#: Bytes of text that a kernel turns into Python strings at a time.
SLICE = 1 << 18


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """The batch in parts whose texts have at most ``limit`` bytes together, or one longer text, with the texts."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < batch.num_rows:
        before = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + limit, "right")))
        part = batch.slice(i, j - i)
        yield part, part[column].to_pylist()
        i = j
