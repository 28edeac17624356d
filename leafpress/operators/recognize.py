"""Text recognition behind a protocol, one recognizer per Python worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FRAGMENTS = "array<struct<bbox:array<struct<x:double,y:double>>,text:string,confidence:double>>"
RECOGNIZED = f"struct<value:{FRAGMENTS},error:string>"


class Recognizer(Protocol):
    def recognize(self, page: np.ndarray) -> list[tuple[list[tuple[float, float]], str, float]]:
        """(corner points, text, confidence) of each fragment, in reading order of the engine."""
        ...


_loaded: dict[str, Recognizer] = {}


def once(name: str, make: Callable[[], Recognizer]) -> Recognizer:
    """The worker's recognizer, made at first use."""
    if name not in _loaded:
        _loaded[name] = make()
    return _loaded[name]


class EasyOcr:
    """Adapter of an optional engine; importing it fails where the engine isn't installed."""

    def __init__(self, languages: tuple[str, ...] = ("vi",)):
        import easyocr

        self.reader = easyocr.Reader(list(languages), gpu=False)

    def recognize(self, page: np.ndarray):
        return [([(float(x), float(y)) for x, y in box], text, float(sure)) for box, text, sure in self.reader.readtext(page)]


class Embedded:
    """Test double, not recognition: reads text that a test wrote into the first pixels, up to a zero byte."""

    def recognize(self, page: np.ndarray):
        raw = page.tobytes().split(b"\0", 1)[0]
        return [([(0.0, float(k))], line, 1.0) for k, line in enumerate(raw.decode("utf-8", "replace").split("\n")) if raw]


class PageSize:
    """Stand-in where no engine is installed, no recognition: says how large the page is, with a blank fragment between."""

    def recognize(self, page: np.ndarray):
        return [([(0.0, float(k))], text, 1.0) for k, text in enumerate((f"{page.shape[0]} rows", " ", f"{page.shape[1]} columns"))]


def recognizer_column(pixels: Column, name: str = "easyocr", make: Callable[[], Recognizer] = EasyOcr) -> Column:
    """struct<value fragments, error> of a pixels column (height, width, channels, data)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for h, w, c, data in b[["height", "width", "channels", "data"]].itertuples(index=False):
                if data is None:
                    rows.append((None, None))
                    continue
                try:
                    page = np.frombuffer(data, np.uint8).reshape(int(h), int(w), int(c))
                    found = once(name, make).recognize(page)
                    rows.append(([{"bbox": [{"x": x, "y": y} for x, y in box], "text": t, "confidence": s} for box, t, s in found], None))
                except Exception as e:  # noqa: BLE001
                    rows.append((None, str(e)))
            yield pd.DataFrame(rows, columns=["value", "error"])

    return F.pandas_udf(run, RECOGNIZED)(pixels)
