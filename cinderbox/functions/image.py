"""Images as arrays: channel order, layout, scaling and resizing.

Small per-row arrays stay in the JVM; pixel blocks go through Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def reversed_channels(pixel: Column) -> Column:
    """BGR to RGB, or back."""
    return F.reverse(pixel)


def unit_scaled(pixels: Column) -> Column:
    """Bytes to numbers in [0, 1]."""
    return F.transform(pixels, lambda x: x / F.lit(255.0))


def transposed(flat: Column, rows: int, cols: int) -> Column:
    """A flat row-major matrix by columns."""
    at = F.array(*[F.lit(r * cols + c + 1) for c in range(cols) for r in range(rows)])
    return F.transform(at, lambda i: F.element_at(flat, i))


def _image(data: bytes, h: int, w: int, c: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(h, w, c)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def to_tensor(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """(data, height, width, channels) in BGR rows to a flat float32 tensor, channels first, RGB, 0 to 1."""
    for data, h, w, c in batches:
        yield pd.Series([(_image(*x)[:, :, ::-1].transpose(2, 0, 1).astype(np.float32) / np.float32(255)).ravel() for x in zip(data, h, w, c, strict=True)])


def bilinear(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear resize whose corners are not aligned: sample i reads at (i + 0.5) scale - 0.5, edges repeat."""
    h, w = image.shape[-2:]

    def axis(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.maximum((np.arange(m) + 0.5) * (n / m) - 0.5, 0)
        lo = np.minimum(at.astype(int), n - 1)
        return lo, np.minimum(lo + 1, n - 1), at - lo

    r0, r1, fr = axis(h, height)
    c0, c1, fc = axis(w, width)
    top = image[..., r0, :] * (1 - fr)[:, None] + image[..., r1, :] * fr[:, None]
    return top[..., c0] * (1 - fc) + top[..., c1] * fc


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def resized(pixels: pd.Series, h: pd.Series, w: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    """A flat one-channel image at another size."""
    return pd.Series([bilinear(np.asarray(p, float).reshape(a, b), c, d).ravel() for p, a, b, c, d in zip(pixels, h, w, height, width, strict=True)])


@F.pandas_udf(T.BinaryType())
def boxes_drawn(data: pd.Series, h: pd.Series, w: pd.Series, c: pd.Series, boxes: pd.Series) -> pd.Series:
    """The frame with the outline of each box (x1, y1, x2, y2, red, green, blue) set, in the order given; BGR bytes."""
    out = []
    for d, hh, ww, cc, bs in zip(data, h, w, c, boxes, strict=True):
        im = _image(d, hh, ww, cc).copy()
        for box in [] if bs is None else bs:
            x1, y1, x2, y2, r, g, b = box.values() if isinstance(box, dict) else box
            x1, x2 = (int(np.clip(x, 0, ww - 1)) for x in (x1, x2))
            y1, y2 = (int(np.clip(y, 0, hh - 1)) for y in (y1, y2))
            colour = np.array([b, g, r])[:cc]
            im[[y1, y2], x1:x2 + 1] = colour
            im[y1:y2 + 1, [x1, x2]] = colour
        out.append(im.tobytes())
    return pd.Series(out)
