"""Masks and gray images as arrays of rows: perimeters and projections by expressions, components and contours by numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.kernels import column_means, row_means  # noqa: F401  mean projections belong here too


def perimeter(mask: Column) -> Column:
    """Foreground pixels whose right, left, upper or lower neighbour is background; beyond the border nothing differs."""
    def line(row: Column, y: Column) -> Column:
        def edge(p: Column, x: Column) -> Column:
            other = lambda q: F.coalesce(q != p, F.lit(False))
            up, down = F.get(F.get(mask, y - 1), x), F.get(F.get(mask, y + 1), x)
            return p & (other(F.get(row, x - 1)) | other(F.get(row, x + 1)) | other(up) | other(down))

        return F.transform(row, edge)

    return F.transform(mask, line)


def above(image: Column, threshold: float = 127) -> Column:
    return F.transform(image, lambda r: F.transform(r, lambda v: v > threshold))


def label_components(mask: np.ndarray) -> np.ndarray:
    """4-connected components numbered from 1 in reading order, 0 the background."""
    out, n = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask)):
        if out[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        out[y, x] = n
        while todo:
            a, b = todo.pop()
            for c, d in ((a - 1, b), (a + 1, b), (a, b - 1), (a, b + 1)):
                if 0 <= c < mask.shape[0] and 0 <= d < mask.shape[1] and mask[c, d] and not out[c, d]:
                    out[c, d] = n
                    todo.append((c, d))
    return out


def opened(mask: np.ndarray, least: int) -> np.ndarray:
    """mask without components of fewer pixels."""
    lab = label_components(mask)
    return mask & (np.bincount(lab.ravel())[lab] >= least)


def contour(mask: np.ndarray) -> list[tuple[int, int]]:
    """The longest outer boundary, as (x, y) in clockwise order, each pixel 8-connected to the next, by Moore tracing."""
    ring = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]  # clockwise from above
    m, best = np.pad(mask, 1), []
    seen = np.zeros_like(m)
    for y, x in zip(*np.nonzero(m & ~np.roll(m, 1, 1))):
        if seen[y, x]:
            continue
        start, at, came, out = (y, x), (y, x), 6, []
        first = None
        while True:
            out.append((int(at[1]) - 1, int(at[0]) - 1))
            seen[at] = True
            for k in range(1, 9):
                d = (came + k) % 8
                to = (at[0] + ring[d][0], at[1] + ring[d][1])
                if m[to]:
                    break
            else:
                break
            if at == start and first == d:
                out.pop()
                break
            if at == start and first is None:
                first = d
            at, came = to, (d + 5) % 8 if d % 2 else (d + 6) % 8
        if len(out) > len(best):
            best = out
    return best


def _per_mask(kind: str, f):
    @F.pandas_udf(kind)
    def of(masks: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in masks:
            yield pd.Series([None if m is None else f(np.array([list(r) for r in m], bool)) for m in s])

    return of


def area_open(mask: Column, least: int) -> Column:
    return _per_mask("array<array<boolean>>", lambda m: opened(m, least).tolist())(mask)


def component_areas(mask: Column) -> Column:
    """Pixels of each component, in reading order."""
    return _per_mask("array<int>", lambda m: [int(n) for n in np.bincount(label_components(m).ravel())[1:]])(mask)


def boundary(mask: Column) -> Column:
    """Array of (x, y) of the longest contour."""
    return _per_mask("array<struct<x:int,y:int>>", lambda m: [{"x": x, "y": y} for x, y in contour(m)])(mask)


def _lanczos(n: int, size: int) -> np.ndarray:
    """Weights by which n pixels become `size`: a windowed sinc of three lobes, widened where the image shrinks."""
    scale = n / size
    reach = 3 * max(scale, 1.0)
    at = (np.arange(size) + 0.5) * scale
    x = (np.arange(n)[None, :] + 0.5 - at[:, None]) / max(scale, 1.0)
    w = np.where(np.abs(x) * max(scale, 1.0) < reach, np.sinc(x) * np.sinc(x / 3), 0.0)
    return w / w.sum(1, keepdims=True)


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """A gray image of 0 to 255 resampled without aliasing, first along rows, then along columns."""
    step = lambda x: np.clip(np.floor(x + 0.5), 0, 255)
    return step(_lanczos(image.shape[0], height) @ step(image @ _lanczos(image.shape[1], width).T))


def scaled_masks(image: Column, scale: int, height: int = 400, width: int = 800, threshold: float = 127) -> Column:
    """Gray images shrunk to height / scale by width / scale, upside down, and where they are above the threshold."""

    @F.pandas_udf("array<array<boolean>>")
    def of(images: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in images:
            yield pd.Series([None if m is None else (resize(np.array([list(r) for r in m], float), height // scale, width // scale)[::-1] > threshold).tolist() for m in s])

    return of(image)
