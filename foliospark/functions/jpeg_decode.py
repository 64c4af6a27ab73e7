"""A baseline JPEG decoder: sequential Huffman frames of one or three components, with restarts."""

from __future__ import annotations

import numpy as np

from foliospark.functions.jpeg import _DCT, ZIGZAG, rounded


class Unsupported(ValueError):
    pass


def _lookup(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


class _Bits:
    """The bits of an entropy-coded segment, as one integer read from the top."""

    def __init__(self, data: bytes):
        self.n = len(data) * 8
        self.text = format(int.from_bytes(data), f"0{self.n}b") if data else ""
        self.at = 0

    def take(self, n: int) -> int:
        if self.at + n > self.n:
            raise Unsupported("data ends early")
        self.at += n
        return int(self.text[self.at - n : self.at], 2) if n else 0

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (s := table.get((length, code))) is not None:
                return s
        raise Unsupported("unknown code")

    def value(self, size: int) -> int:
        v = self.take(size)
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


def _segments(data: bytes, at: int) -> tuple[list[bytes], int]:
    """Entropy-coded segments from ``at`` on, cut at restart markers, without stuffed zeros."""
    out, begin = [], at
    while True:
        k = data.find(b"\xff", at)
        if k < 0 or k + 1 >= len(data):
            return [*out, data[begin:].replace(b"\xff\x00", b"\xff")], len(data)
        marker = data[k + 1]
        if marker == 0:
            at = k + 2
        elif 0xD0 <= marker <= 0xD7:
            out.append(data[begin:k].replace(b"\xff\x00", b"\xff"))
            at = begin = k + 2
        elif marker == 0xFF:
            at = k + 1
        else:
            return [*out, data[begin:k].replace(b"\xff\x00", b"\xff")], k


def decode(data: bytes) -> tuple[int, int, int, bytes]:
    """(width, height, channels, samples): gray of one channel or RGB. Anything else raises ValueError."""
    if data[:2] != b"\xff\xd8":
        raise Unsupported("no JPEG")
    quant: dict[int, np.ndarray] = {}
    huff: dict[int, dict] = {}
    frame, restart, transform, at = None, 0, None, 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        marker = data[at + 1]
        if marker == 0xFF or marker == 0x01 or 0xD0 <= marker <= 0xD8:
            at += 1 if marker == 0xFF else 2
            continue
        if marker == 0xD9:
            break
        size = int.from_bytes(data[at + 2 : at + 4])
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        try:
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    n = 128 if wide else 64
                    table = np.zeros(64)
                    table[ZIGZAG] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8)
                    quant[body[0] & 15], body = table, body[1 + n :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    huff[body[0]], body = _lookup(body[1:17], body[17 : 17 + n]), body[17 + n :]
            elif marker in (0xC0, 0xC1):
                if body[0] != 8 or body[5] not in (1, 3):
                    raise Unsupported("samples or components")
                parts = [(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)]
                frame = int.from_bytes(body[3:5]), int.from_bytes(body[1:3]), parts
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise Unsupported("no baseline frame")
            elif marker == 0xDD:
                restart = int.from_bytes(body[:2])
            elif marker == 0xEE and body[:5] == b"Adobe" and len(body) > 11:
                transform = body[11]
            elif marker == 0xDA:
                if frame is None or body[0] != len(frame[2]) or not frame[0] * frame[1]:
                    raise Unsupported("scan without its frame")
                tables = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
                return _picture(frame, tables, quant, huff, restart, transform, _segments(data, at)[0])
        except (IndexError, KeyError) as e:
            raise Unsupported(f"broken segment: {e}") from None
    raise Unsupported("no picture")


def _picture(frame, tables, quant, huff, restart, transform, segments) -> tuple[int, int, int, bytes]:
    width, height, parts = frame
    hmax, vmax = max(p[1] for p in parts), max(p[2] for p in parts)
    if len(parts) == 1:
        parts, hmax, vmax = [(parts[0][0], 1, 1, parts[0][3])], 1, 1
    cols, rows = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    blocks = [np.zeros((rows * v, cols * h, 64)) for _, h, v, _ in parts]
    bits = iter(segments)
    source, last = _Bits(next(bits)), [0] * len(parts)
    for n in range(rows * cols):
        if restart and n and n % restart == 0:
            source, last = _Bits(next(bits, b"")), [0] * len(parts)
        y, x = divmod(n, cols)
        for c, (ident, h, v, _) in enumerate(parts):
            dc, ac = huff[tables[ident] >> 4], huff[0x10 | tables[ident] & 15]
            for j in range(v):
                for i in range(h):
                    block = blocks[c][y * v + j, x * h + i]
                    last[c] += source.value(source.symbol(dc))
                    block[0] = last[c]
                    k = 1
                    while k < 64:
                        s = source.symbol(ac)
                        k += s >> 4
                        if not s & 15:
                            if s != 0xF0:
                                break
                            k += 1
                            continue
                        block[ZIGZAG[k]] = source.value(s & 15)
                        k += 1
    planes = []
    for b, (_, h, v, q) in zip(blocks, parts, strict=True):
        p = _DCT.T @ (b * quant[q]).reshape(*b.shape[:2], 8, 8) @ _DCT + 128
        p = np.clip(rounded(p), 0, 255).swapaxes(1, 2).reshape(b.shape[0] * 8, b.shape[1] * 8)
        planes.append(p.repeat(vmax // v, 0).repeat(hmax // h, 1)[:height, :width])
    if len(planes) == 1:
        return width, height, 1, planes[0].astype(np.uint8).tobytes()
    y, cb, cr = planes
    if transform != 0:
        cb, cr = cb - 128, cr - 128
        y, cb, cr = y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb
    return width, height, 3, np.clip(rounded(np.stack([y, cb, cr], 2)), 0, 255).astype(np.uint8).tobytes()
