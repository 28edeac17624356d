"""Large pages as tiles: cut with a halo, worked on all over the cluster, put together again.

A pixel of the result depends on the pixels within the chain's reach, so a tile that carries as many beyond its core has all that its core
needs; where the page ends, the tile ends too and the kernel's own border rule applies. The result equals the untiled one byte for byte.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafpress.functions import kernels
from leafpress.sources.images import CLEANED, clean_pixels

#: Pixels along a tile's core, and the pixels of a page from which on it is cut.
TILE, LARGE = 256, 1 << 20


@dataclass(frozen=True)
class Chain:
    """What is done to a gray page, and how far it looks in each direction."""

    run: Callable[[np.ndarray], np.ndarray]
    reach: int


_BLUR = len(kernels.BLUR_TAPS) // 2
CHAINS = {
    "blur": Chain(kernels.blur, _BLUR),
    "clean": Chain(kernels.clean_gray, _BLUR + kernels.THRESHOLD_BLOCK // 2 + kernels.SEARCH // 2 + kernels.TEMPLATE // 2),
}
_CORE = "top int, left int, rows int, cols int"


def spans(n: int, size: int, reach: int) -> list[tuple[int, int, int, int]]:
    """(core start, core end, tile start, tile end) along one side."""
    return [(a, min(a + size, n), max(0, a - reach), min(n, a + size + reach)) for a in range(0, n, size)]


def cut(pages: DataFrame, chain: str, size: int) -> DataFrame:
    """Pages (id, height, width, channels, data) to gray tiles: the page's size, the tile's core, its offset in the tile, the tile."""
    reach, kind = CHAINS[chain].reach, pages.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for page in batch.itertuples(index=False):
                gray = kernels.to_gray(np.frombuffer(page.data, np.uint8).reshape(page.height, page.width, page.channels))
                for y0, y1, ya, yb in spans(page.height, size, reach):
                    row = [(page.id, page.height, page.width, y0, x0, y1 - y0, x1 - x0, y0 - ya, x0 - xa, yb - ya, xb - xa, gray[ya:yb, xa:xb].tobytes()) for x0, x1, xa, xb in spans(page.width, size, reach)]
                    yield pd.DataFrame(row, columns=["id", "height", "width", "top", "left", "rows", "cols", "dy", "dx", "h", "w", "data"])

    return pages.select("id", "height", "width", "channels", "data").mapInPandas(run, f"id {kind}, height int, width int, {_CORE}, dy int, dx int, h int, w int, data binary")


def worked(tiles: DataFrame, chain: str) -> DataFrame:
    """(id, height, width, core, data): the cores after the chain. Tiles are dealt evenly, as a tile takes far longer than its reading."""
    kind = tiles.schema["id"].dataType.simpleString()
    run_chain = CHAINS[chain].run

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for t in batch.itertuples(index=False):
                out = run_chain(np.frombuffer(t.data, np.uint8).reshape(t.h, t.w))
                made.append(out[t.dy : t.dy + t.rows, t.dx : t.dx + t.cols].tobytes())
            yield batch[["id", "height", "width", "top", "left", "rows", "cols"]].assign(data=made)

    return tiles.repartition("id", "top", "left").mapInPandas(run, f"id {kind}, height int, width int, {_CORE}, data binary")


def joined(cores: DataFrame) -> DataFrame:
    """(id, height, width, data): pages from their cores. A task holds one page of one byte a pixel at a time."""
    kind = cores.schema["id"].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        page = np.zeros((int(group["height"].iloc[0]), int(group["width"].iloc[0])), np.uint8)
        for t in group.itertuples(index=False):
            page[t.top : t.top + t.rows, t.left : t.left + t.cols] = np.frombuffer(t.data, np.uint8).reshape(t.rows, t.cols)
        return pd.DataFrame([(group["id"].iloc[0], *page.shape, page.tobytes())], columns=["id", "height", "width", "data"])

    return cores.groupBy("id").applyInPandas(run, f"id {kind}, height int, width int, data binary")


def tiled(pages: DataFrame, chain: str = "clean", size: int = TILE) -> DataFrame:
    """Pages (id, height, width, channels, data), of distinct ids, after the chain, all through tiles."""
    return joined(worked(cut(pages, chain, size), chain))


def is_large(p: Column, large: int = LARGE) -> Column:
    """Whether pixels are to be cut into tiles: of more than ``large`` pixels, and filling their page. Never null."""
    area = p["height"].cast("long") * p["width"]
    return F.coalesce((p["height"] > 0) & (p["width"] > 0) & (area > large) & p["channels"].isin(1, 3, 4) & (F.octet_length(p["data"]) == area * p["channels"]), F.lit(False))


def cleaned_pages(pages: DataFrame, large: int = LARGE, size: int = TILE) -> DataFrame:
    """(scan_id, clean struct<value, error>) of pages (scan_id, pixels): small ones whole, larger ones through tiles. Other columns stay."""
    rest = [c for c in pages.columns if c not in ("scan_id", "pixels")]
    big = is_large(F.col("pixels"), large)
    small = pages.where(~big).select("scan_id", *rest, clean_pixels("pixels").alias("clean"))
    cut_up = tiled(pages.where(big).select(F.col("scan_id").alias("id"), "pixels.*"), size=size)
    value = F.struct("height", "width", F.lit(1).alias("channels"), "data")
    large_ones = cut_up.select(F.col("id").alias("scan_id"), F.struct(value.alias("value"), F.lit(None).cast("string").alias("error")).cast(CLEANED).alias("clean"))
    return small.unionByName(large_ones.join(pages.where(big).select("scan_id", *rest), "scan_id") if rest else large_ones)
