"""Ink on page images: thresholds, bands and extents, with numpy on Arrow batches.

Images come from Spark's image source (path, height, width, nChannels, data in BGR) or as gray bytes; what can't be
read has no ink. A page is one row, so a task holds one page at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BAND = "struct<y0:int,y1:int,ink:double>"


def otsu(gray) -> int:
    """The gray value that parts ink from paper best: between-class variance over the histogram."""
    import numpy as np

    h = np.bincount(gray.ravel(), minlength=256).astype(float)
    n, total = h.sum(), (h * np.arange(256)).sum()
    w = np.cumsum(h)
    s = np.cumsum(h * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        var = (total * w / n - s) ** 2 / (w * (n - w))
    return int(np.nanargmax(np.where(np.isfinite(var), var, -1)))


def ink_map(gray):
    """Whether each pixel is ink: darker than the threshold; a page of one gray has none."""
    return gray <= otsu(gray) if gray.size and gray.min() < gray.max() else gray < 0


def extent(projection, least: int = 1) -> tuple[int, int] | None:
    """The first and last position with enough ink, the last one exclusive."""
    import numpy as np

    at = np.flatnonzero(projection >= least)
    return (int(at[0]), int(at[-1]) + 1) if len(at) else None


def bands(ink, least: int = 1, gap: int = 2) -> list[tuple[int, int]]:
    """The runs of rows with ink; gaps of up to `gap` rows don't part them."""
    import numpy as np

    at = np.flatnonzero(ink.sum(axis=1) >= least)
    out: list[list[int]] = []
    for y in at.tolist():
        if out and y - out[-1][1] <= gap:
            out[-1][1] = y + 1
        else:
            out.append([y, y + 1])
    return [tuple(b) for b in out]


def masked(ink, boxes: list[tuple[int, int, int, int]]):
    """The ink without what stands in boxes to be ignored."""
    out = ink.copy()
    for x1, y1, x2, y2 in boxes:
        out[max(0, y1) : max(0, y2), max(0, x1) : max(0, x2)] = False
    return out


def cleared_edges(ink, share: float = 0.6, depth: int = 3):
    """The ink without ruled lines at the edges: rows and columns near an edge that are mostly ink."""
    out = ink.copy()
    h, w = out.shape
    for y in [*range(min(depth, h)), *range(max(0, h - depth), h)]:
        if out[y].mean() > share:
            out[y] = False
    for x in [*range(min(depth, w)), *range(max(0, w - depth), w)]:
        if out[:, x].mean() > share:
            out[:, x] = False
    return out


def carved(box: tuple[int, int, int, int], ignored: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The horizontal slices of a box that boxes to be ignored leave."""
    x1, y1, x2, y2 = box
    cuts = sorted((max(y1, b), min(y2, d)) for a, b, c, d in ignored if min(x2, c) > max(x1, a) and min(y2, d) > max(y1, b))
    out, at = [], y1
    for b, d in cuts:
        if b > at:
            out.append((x1, at, x2, b))
        at = max(at, d)
    return out + [(x1, at, x2, y2)] if at < y2 else out


def page_bands(images: DataFrame) -> DataFrame:
    """(path, threshold, left, right, bands) of page images."""

    def run(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            rows = []
            for path, h, w, ch, data in zip(b["path"], b["height"], b["width"], b["nChannels"], b["data"]):
                if data is None or h is None or w is None or len(data) != h * w * ch or h * w == 0:
                    rows.append((path, None, None, None, []))
                    continue
                a = np.frombuffer(data, np.uint8).reshape(h, w, ch)
                gray = a[..., 0] if ch == 1 else (a[..., :3].astype(np.float64) @ np.array([0.114, 0.587, 0.299])).round().astype(np.uint8)
                ink = ink_map(gray)
                cols = extent(ink.sum(axis=0))
                found = [{"y0": y0, "y1": y1, "ink": float(ink[y0:y1].mean())} for y0, y1 in bands(ink)]
                rows.append((path, otsu(gray), cols and cols[0], cols and cols[1], found))
            out = pd.DataFrame(rows, columns=["path", "threshold", "left", "right", "bands"])
            for c in ("threshold", "left", "right"):
                out[c] = out[c].astype("Int32")
            yield out

    return images.select("path", "height", "width", "nChannels", "data").mapInPandas(run, f"path string, threshold int, left int, right int, bands array<{BAND}>")


def read_images(spark, folder: str) -> DataFrame:
    """PNG, JPEG and other images of a folder as Spark's image source reads them; what it can't read is left out."""
    d = spark.read.format("image").option("dropInvalid", True).load(folder)
    return d.select(F.col("image.origin").alias("path"), "image.height", "image.width", "image.nChannels", "image.data")
