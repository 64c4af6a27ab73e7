"""Statistics and resampling of RGB images, on numpy arrays."""

from __future__ import annotations

import numpy as np

GATE = 0.98


def pixels(width: int, height: int, rgb: bytes) -> np.ndarray:
    return np.frombuffer(rgb, np.uint8)[: width * height * 3].reshape(height, width, 3).astype(np.int64)


def luma(p: np.ndarray) -> np.ndarray:
    return (77 * p[..., 0] + 150 * p[..., 1] + 29 * p[..., 2]) >> 8


def classify(width: int, height: int, rgb: bytes) -> str:
    """Photo, Screenshot, LineArt or Bitonal, by the levels, colours, edges and runs of an image."""
    n = width * height
    if not n or len(rgb) < 3 * n:
        return "Photo"
    p = pixels(width, height, rgb)
    y = luma(p)
    step = np.abs(np.diff(y, axis=1))
    levels = len(np.unique(y))
    colors = min(len(np.unique(p[..., 0] << 16 | p[..., 1] << 8 | p[..., 2])), 4096)
    edges, runs = (step > 40).sum() / n, (step == 0).sum() / n
    if levels <= 4 and colors <= 4:
        return "Bitonal"
    if colors <= 24 and edges > 0.08:
        return "LineArt"
    return "Screenshot" if colors < 512 and (runs > 0.35 or edges > 0.12) else "Photo"


def ssim(width: int, height: int, a: bytes, b: bytes) -> float:
    """Mean structural similarity of the luma over 8x8 windows; windows cut by an edge count in full."""
    if not width * height:
        return 1.0
    ya, yb = (luma(pixels(width, height, x)).astype(float) for x in (a, b))
    rows, cols = np.arange(0, height, 8), np.arange(0, width, 8)

    def total(x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.add.reduceat(x, rows, 0), cols, 1)

    n = total(np.ones_like(ya))
    ma, mb = total(ya) / n, total(yb) / n
    va, vb = np.maximum(total(ya * ya) / n - ma * ma, 0), np.maximum(total(yb * yb) / n - mb * mb, 0)
    cov = total(ya * yb) / n - ma * mb
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return float(((2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))).mean())


def passes_gate(a: tuple[int, int, bytes], b: tuple[int, int, bytes]) -> bool:
    """Whether b looks like a; each is (width, height, rgb)."""
    return a[:2] == b[:2] and (a[2] == b[2] or ssim(*a, b[2]) >= GATE)


def fit(width: int, height: int, edge: int) -> tuple[int, int]:
    """The size within ``edge`` at the same proportions, halves rounded up, at least 1."""
    longest = max(width, height)
    if longest <= edge:
        return width, height
    return tuple(max(1, int(np.floor(x * (edge / longest) + 0.5))) for x in (width, height))


def resize(samples: np.ndarray, width: int, height: int) -> np.ndarray:
    """Truncated box means of an array (rows, columns, channels)."""
    h, w = samples.shape[:2]
    x = samples.astype(np.int64)
    for axis, (old, new) in enumerate(((h, height), (w, width))):
        k = np.arange(new, dtype=np.int64)
        low = k * old // new
        high = np.maximum((k + 1) * old // new, low + 1)
        sums = np.concatenate([np.zeros_like(x.take([0], axis)), np.cumsum(x, axis)], axis)
        x = sums.take(high, axis) - sums.take(low, axis)
        count = (high - low) if axis else (high - low)[:, None]
        area = count if axis == 0 else area * count  # noqa: F821
    return (x // area[..., None]).astype(np.uint8)


def fingerprint(rgb: bytes, width: int, height: int) -> bytes:
    """The key under which equal images meet: content and size."""
    import hashlib

    return hashlib.sha256(width.to_bytes(4) + height.to_bytes(4) + rgb).digest()


def fnv_fold(data: bytes) -> bytes:
    """The 32-byte FNV-1a fold: each byte is hashed into one slot of eight bytes' spread and mixed raw
    into another; the low byte of the length goes into the first."""
    out = bytearray(32)
    state = 0xCBF29CE484222325
    for k, byte in enumerate(data):
        state = ((state ^ byte) * 0x100000001B3) & (2**64 - 1)
        out[k % 32] ^= state >> (8 * (k % 8)) & 255
        out[(k + 7) % 32] ^= byte
    out[0] ^= len(data) & 255
    return bytes(out)
