"""Row predictors of image data: PNG filters and the TIFF difference, on numpy rows."""

from __future__ import annotations

import numpy as np


def _shifted(row: np.ndarray, bpp: int) -> np.ndarray:
    out = np.zeros_like(row)
    out[bpp:] = row[:-bpp] if len(row) > bpp else row[:0]
    return out


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    a, b, c = (x.astype(np.int16) for x in (a, b, c))
    p = a + b - c
    da, db, dc = abs(p - a), abs(p - b), abs(p - c)
    return np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c)).astype(np.uint8)


def encode_png_best(data: bytes, stride: int, bpp: int) -> bytes:
    """Rows of ``stride`` bytes, each under the filter kind 0-4 of least byte sum; the lowest kind on ties.

    All filters read unfiltered neighbours, so every row and kind is computed at once.
    """
    if not data or stride <= 0:
        return b""
    rows = np.frombuffer(data, np.uint8)[: len(data) // stride * stride].reshape(-1, stride)
    up = np.zeros_like(rows)
    up[1:] = rows[:-1]
    left, corner = np.zeros_like(rows), np.zeros_like(rows)
    if stride > bpp:
        left[:, bpp:], corner[:, bpp:] = rows[:, :-bpp], up[:, :-bpp]
    mean = ((left.astype(np.uint16) + up) // 2).astype(np.uint8)
    kinds = np.stack([rows, rows - left, rows - up, rows - mean, rows - _paeth(left, up, corner)])
    best = kinds.sum(2, dtype=np.int64).argmin(0)
    out = np.empty((len(rows), stride + 1), np.uint8)
    out[:, 0] = best
    out[:, 1:] = kinds[best, np.arange(len(rows))]
    return out.tobytes()


def decode_png(data: bytes, stride: int, bpp: int) -> bytes | None:
    """The rows of filtered data; None for an unknown kind or a ragged length."""
    if stride <= 0 or len(data) % (stride + 1):
        return None
    rows = np.frombuffer(data, np.uint8).reshape(-1, stride + 1)
    out = np.zeros((len(rows) + 1, stride), np.uint8)
    for k, row in enumerate(rows):
        kind, x, up = row[0], row[1:], out[k]
        if kind > 4:
            return None
        if kind in (0, 2):
            out[k + 1] = x + up if kind else x
        elif kind == 1:
            padded = np.concatenate([x, np.zeros(-stride % bpp, np.uint8)]).reshape(-1, bpp)
            out[k + 1] = np.cumsum(padded, 0, dtype=np.uint8).ravel()[:stride]
        else:
            y = out[k + 1]
            for at in range(0, stride, bpp):
                to = min(at + bpp, stride)
                left = y[at - bpp : at][: to - at] if at else np.zeros(to - at, np.uint8)
                if kind == 3:
                    guess = ((left.astype(np.uint16) + up[at:to]) // 2).astype(np.uint8)
                else:
                    guess = _paeth(left, up[at:to], up[at - bpp : at][: to - at] if at else np.zeros(to - at, np.uint8))
                y[at:to] = x[at:to] + guess
    return out[1:].tobytes()


def encode_tiff(data: bytes, width: int, colors: int) -> bytes:
    """Differences to the pixel on the left, of 8-bit samples; a rest that fills no row stays."""
    stride = width * colors
    if stride <= 0:
        return data
    whole = len(data) // stride * stride
    rows = np.frombuffer(data, np.uint8)[:whole].reshape(-1, width, colors)
    return np.diff(rows, axis=1, prepend=np.zeros((len(rows), 1, colors), np.uint8)).tobytes() + data[whole:]


def decode_tiff(data: bytes, width: int, colors: int) -> bytes:
    stride = width * colors
    if stride <= 0:
        return data
    whole = len(data) // stride * stride
    rows = np.frombuffer(data, np.uint8)[:whole].reshape(-1, width, colors)
    return np.cumsum(rows, axis=1, dtype=np.uint8).tobytes() + data[whole:]
