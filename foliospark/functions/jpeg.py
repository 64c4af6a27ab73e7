"""A baseline JPEG encoder on numpy blocks: 4:4:4 or 4:2:0, with the standard's Annex K tables."""

from __future__ import annotations

import numpy as np

# Quantisation tables, and Huffman code counts by length with their symbols (ITU T.81, Annex K).
LUMA_QUANT = np.array([
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
])
CHROMA_QUANT = np.array([
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
])
DC_LUMA = ([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], list(range(12)))
DC_CHROMA = ([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0], list(range(12)))
AC_LUMA = ([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125], [
    1, 2, 3, 0, 4, 17, 5, 18, 33, 49, 65, 6, 19, 81, 97, 7, 34, 113, 20, 50, 129, 145, 161, 8,
    35, 66, 177, 193, 21, 82, 209, 240, 36, 51, 98, 114, 130, 9, 10, 22, 23, 24, 25, 26, 37, 38, 39, 40,
    41, 42, 52, 53, 54, 55, 56, 57, 58, 67, 68, 69, 70, 71, 72, 73, 74, 83, 84, 85, 86, 87, 88, 89,
    90, 99, 100, 101, 102, 103, 104, 105, 106, 115, 116, 117, 118, 119, 120, 121, 122, 131, 132, 133, 134, 135, 136, 137,
    138, 146, 147, 148, 149, 150, 151, 152, 153, 154, 162, 163, 164, 165, 166, 167, 168, 169, 170, 178, 179, 180, 181, 182,
    183, 184, 185, 186, 194, 195, 196, 197, 198, 199, 200, 201, 202, 210, 211, 212, 213, 214, 215, 216, 217, 218, 225, 226,
    227, 228, 229, 230, 231, 232, 233, 234, 241, 242, 243, 244, 245, 246, 247, 248, 249, 250,
])
AC_CHROMA = ([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119], [
    0, 1, 2, 3, 17, 4, 5, 33, 49, 6, 18, 65, 81, 7, 97, 113, 19, 34, 50, 129, 8, 20, 66, 145,
    161, 177, 193, 9, 35, 51, 82, 240, 21, 98, 114, 209, 10, 22, 36, 52, 225, 37, 241, 23, 24, 25, 26, 38,
    39, 40, 41, 42, 53, 54, 55, 56, 57, 58, 67, 68, 69, 70, 71, 72, 73, 74, 83, 84, 85, 86, 87, 88,
    89, 90, 99, 100, 101, 102, 103, 104, 105, 106, 115, 116, 117, 118, 119, 120, 121, 122, 130, 131, 132, 133, 134, 135,
    136, 137, 138, 146, 147, 148, 149, 150, 151, 152, 153, 154, 162, 163, 164, 165, 166, 167, 168, 169, 170, 178, 179, 180,
    181, 182, 183, 184, 185, 186, 194, 195, 196, 197, 198, 199, 200, 201, 202, 210, 211, 212, 213, 214, 215, 216, 217, 218,
    226, 227, 228, 229, 230, 231, 232, 233, 234, 242, 243, 244, 245, 246, 247, 248, 249, 250,
])
#: Places of an 8x8 block along its falling diagonals.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, (k // 8 if (k // 8 + k % 8) % 2 else k % 8))))


def rounded(x: np.ndarray) -> np.ndarray:
    """The nearest integers, halves away from zero."""
    return np.sign(x) * np.floor(np.abs(x) + 0.5)


def scaled_quant(table: np.ndarray, quality: int) -> np.ndarray:
    q = min(max(quality, 1), 100)
    return np.clip((table * (5000 // q if q < 50 else 200 - 2 * q) + 50) // 100, 1, 255)


def _codes(table: tuple[list[int], list[int]]) -> dict[int, tuple[int, int]]:
    out, code, symbols = {}, 0, iter(table[1])
    for length, count in enumerate(table[0], 1):
        for _ in range(count):
            out[next(symbols)] = (code, length)
            code += 1
        code <<= 1
    return out


_K = np.arange(8)
_DCT = (np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16) * np.where(_K[:, None] == 0, np.sqrt(1 / 8), 0.5)).astype(np.float32)


def _plane(samples: np.ndarray, quant: np.ndarray, grid: int) -> np.ndarray:
    """Quantised coefficients in zigzag order of a plane's blocks; edges repeat up to ``grid`` blocks."""
    h, w = samples.shape
    p = np.pad(samples, ((0, -h % (8 * grid)), (0, -w % (8 * grid))), mode="edge").astype(np.float32) - 128
    blocks = p.reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).swapaxes(1, 2)
    return rounded((_DCT @ blocks @ _DCT.T).reshape(*blocks.shape[:2], 64) / quant)[..., ZIGZAG].astype(np.int64)


def ycbcr(rgb: np.ndarray) -> list[np.ndarray]:
    r, g, b = (rgb[..., k].astype(np.float32) for k in range(3))
    planes = (0.299 * r + 0.587 * g + 0.114 * b, -0.168736 * r - 0.331264 * g + 0.5 * b + 128, 0.5 * r - 0.418688 * g - 0.081312 * b + 128)
    return [np.clip(rounded(x), 0, 255) for x in planes]


def halved(plane: np.ndarray) -> np.ndarray:
    """Truncated means of two by two samples, edges repeated."""
    p = np.pad(plane, ((0, plane.shape[0] % 2), (0, plane.shape[1] % 2)), mode="edge").astype(np.int64)
    return (p[::2, ::2] + p[1::2, ::2] + p[::2, 1::2] + p[1::2, 1::2]) // 4


def _bits(blocks: list[tuple[int, np.ndarray]]) -> bytes:
    """Entropy-coded blocks, given as (component, coefficients)."""
    tables = [(_codes(DC_LUMA), _codes(AC_LUMA)), (_codes(DC_CHROMA), _codes(AC_CHROMA))]
    last, out = [0, 0, 0], []

    def value(v: int, size: int) -> None:
        if size:
            out.append(format(v if v > 0 else v + (1 << size) - 1, f"0{size}b"))

    for component, c in blocks:
        dc, ac = tables[component > 0]
        d = int(c[0]) - last[component]
        last[component] = int(c[0])
        size = abs(d).bit_length()
        out.append(format(dc[size][0], f"0{dc[size][1]}b"))
        value(d, size)
        at = 0
        for k in (np.flatnonzero(c[1:]) + 1).tolist():
            run, v = k - at - 1, int(c[k])
            while run > 15:
                out.append(format(ac[0xF0][0], f"0{ac[0xF0][1]}b"))
                run -= 16
            size = abs(v).bit_length()
            code, length = ac[run << 4 | size]
            out.append(format(code, f"0{length}b"))
            value(v, size)
            at = k
        if at < 63:
            out.append(format(ac[0][0], f"0{ac[0][1]}b"))
    text = "".join(out)
    text += "1" * (-len(text) % 8)
    return int(text or "0", 2).to_bytes(len(text) // 8).replace(b"\xff", b"\xff\x00") if text else b""


def _marker(code: int, body: bytes) -> bytes:
    return bytes([0xFF, code]) + (len(body) + 2).to_bytes(2) + body


def encode_rgb(width: int, height: int, rgb: bytes, quality: int, subsample: bool = False) -> bytes:
    """A baseline JPEG of interleaved 8-bit RGB. Sides above 65535 or missing bytes raise ValueError."""
    if not 0 < width < 65536 or not 0 < height < 65536 or len(rgb) < width * height * 3:
        raise ValueError("bad image size")
    luma, chroma = scaled_quant(LUMA_QUANT, quality), scaled_quant(CHROMA_QUANT, quality)
    y, cb, cr = ycbcr(np.frombuffer(rgb, np.uint8)[: width * height * 3].reshape(height, width, 3))
    n = 2 if subsample else 1
    planes = [_plane(y, luma, n), *(_plane(halved(p) if subsample else p, chroma, 1) for p in (cb, cr))]
    blocks = []
    for row in range(planes[1].shape[0]):
        for col in range(planes[1].shape[1]):
            blocks += [(0, planes[0][row * n + i, col * n + j]) for i in range(n) for j in range(n)]
            blocks += [(1, planes[1][row, col]), (2, planes[2][row, col])]
    frame = bytes([8]) + height.to_bytes(2) + width.to_bytes(2) + bytes([3, 1, n << 4 | n, 0, 2, 0x11, 1, 3, 0x11, 1])
    tables = b"".join(_marker(0xC4, bytes([k, *t[0], *t[1]])) for k, t in ((0x00, DC_LUMA), (0x10, AC_LUMA), (0x01, DC_CHROMA), (0x11, AC_CHROMA)))
    quants = b"".join(_marker(0xDB, bytes([k, *q[ZIGZAG]])) for k, q in enumerate((luma, chroma)))
    return b"\xff\xd8" + quants + _marker(0xC0, frame) + tables + _marker(0xDA, bytes([3, 1, 0, 2, 0x11, 3, 0x11, 0, 63, 0])) + _bits(blocks) + b"\xff\xd9"
