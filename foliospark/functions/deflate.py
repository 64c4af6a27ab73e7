"""A DEFLATE encoder: match finding, parsing, length-limited Huffman codes, one dynamic block.

``compress`` is what the engine uses by default (the platform's zlib at its best level); the
encoder here makes tokens, frequencies and code lengths available as values, and is checked
against the platform's decoder.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter, defaultdict

WINDOW, SHORTEST, LONGEST = 32768, 3, 258
#: Candidates looked at for a match, by size of the input; the parse is optimal up to the second.
CHAIN, CHAIN_LARGE, LARGE, OPTIMAL = 64, 16, 65536, 16384

Token = tuple[int, int]  # (byte, 0) or (length, distance)


def _ranges(first: int, extras: list[int]) -> list[tuple[int, int]]:
    """(first value, extra bits) of each symbol, of which each covers two to its extra bits values."""
    out, at = [], first
    for e in extras:
        out.append((at, e))
        at += 1 << e
    return out


#: Symbols 257-285 by their least length, and 0-29 by their least distance (RFC 1951, 3.2.5).
LENGTHS = [*_ranges(3, [0] * 8 + [k for k in range(1, 6) for _ in range(4)])[:-1], (227, 5), (258, 0)]
DISTANCES = _ranges(1, [0] * 4 + [k for k in range(1, 14) for _ in range(2)])
#: Order of the code-length code's lengths (RFC 1951, 3.2.7).
CODE_ORDER = [16, 17, 18, 0, 8, 7, 9, 6, 10, 5, 11, 4, 12, 3, 13, 2, 14, 1, 15]


def _symbols(table: list[tuple[int, int]], top: int) -> list[int]:
    out, k = [0] * (top + 1), 0
    for v in range(table[0][0], top + 1):
        while k + 1 < len(table) and table[k + 1][0] <= v:
            k += 1
        out[v] = k
    return out


_LENGTH_SYMBOL = _symbols(LENGTHS, LONGEST)
_DISTANCE_SYMBOL = _symbols(DISTANCES, WINDOW)


def longest_matches(data: bytes) -> list[Token]:
    """For each place the longest match behind it, nearest first on ties; (0, 0) without one."""
    n = len(data)
    chain = CHAIN_LARGE if n > LARGE else CHAIN
    last: dict[bytes, int] = {}
    before = [-1] * n
    out: list[Token] = [(0, 0)] * n
    for at in range(n - SHORTEST + 1):
        key = data[at : at + 3]
        found, best, where = last.get(key, -1), SHORTEST - 1, 0
        top = min(LONGEST, n - at)
        for _ in range(chain):
            if found < 0 or at - found > WINDOW:
                break
            if best < top and data[found + best] == data[at + best] and data[found : found + best] == data[at : at + best]:
                k = best + 1
                while k < top and data[found + k] == data[at + k]:
                    k += 1
                best, where = k, at - found
                if k == top:
                    break
            found = before[found]
        if where:
            out[at] = (best, where)
        before[at] = last.get(key, -1)
        last[key] = at
    return out


def _lazy(data: bytes, found: list[Token]) -> list[Token]:
    out, at = [], 0
    while at < len(data):
        length, distance = found[at]
        if length and not (at + 1 < len(data) and found[at + 1][0] > length):
            out.append((length, distance))
            at += length
        else:
            out.append((data[at], 0))
            at += 1
    return out


def _optimal(data: bytes, found: list[Token]) -> list[Token]:
    """The parse of least bits under the fixed code, from the end to the start."""
    n = len(data)
    cost, step = [0] * (n + 1), [0] * n
    for at in range(n - 1, -1, -1):
        cost[at], step[at] = cost[at + 1] + (8 if data[at] < 144 else 9), 1
        length, distance = found[at]
        if length:
            tail = 5 + DISTANCES[_DISTANCE_SYMBOL[distance]][1]
            for k in {x for x in (3, 4, 5, 8, 16, 32, 64, 128) if x <= length} | {length}:
                s = _LENGTH_SYMBOL[k]
                bits = (7 if s < 23 else 8) + LENGTHS[s][1] + tail + cost[at + k]
                if bits < cost[at]:
                    cost[at], step[at] = bits, k
    out, at = [], 0
    while at < n:
        out.append((step[at], found[at][1]) if step[at] > 1 else (data[at], 0))
        at += step[at]
    return out


def parse(data: bytes) -> list[Token]:
    found = longest_matches(data)
    return _optimal(data, found) if len(data) <= OPTIMAL else _lazy(data, found)


def restore(tokens: list[Token]) -> bytes:
    """The bytes that tokens stand for."""
    out = bytearray()
    for a, distance in tokens:
        if distance:
            for _ in range(a):
                out.append(out[-distance])
        else:
            out.append(a)
    return bytes(out)


def frequencies(tokens: list[Token]) -> tuple[list[int], list[int]]:
    """Counts of the 286 literal and length symbols, one block end among them, and the 30 distances."""
    lit, dist = [0] * 286, [0] * 30
    lit[256] = 1
    for a, distance in tokens:
        lit[257 + _LENGTH_SYMBOL[a] if distance else a] += 1
        if distance:
            dist[_DISTANCE_SYMBOL[distance]] += 1
    if not any(dist):
        dist[0] = 1
    return lit, dist


def code_lengths(freq: list[int], limit: int) -> list[int]:
    """Optimal code lengths of at most ``limit`` bits, by package-merge; complete but for one symbol."""
    used = sorted((f, s) for s, f in enumerate(freq) if f)
    out = [0] * len(freq)
    if len(used) == 1:
        out[used[0][1]] = 1
    if len(used) < 2:
        return out
    leaves = [(f, (s,)) for f, s in used]
    packed: list[tuple[int, tuple[int, ...]]] = []
    for _ in range(limit):
        row = list(heapq.merge(leaves, packed, key=lambda x: x[0]))
        packed = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(row[::2], row[1::2])]
    for s, n in Counter(s for _, ss in packed[: len(used) - 1] for s in ss).items():
        out[s] = n
    return out


def canonical(lengths: list[int]) -> list[tuple[int, int]]:
    """(code with its first bit lowest, length) of each symbol."""
    count = Counter(n for n in lengths if n)
    code, start = 0, {}
    for n in range(1, 16):
        code = (code + count.get(n - 1, 0)) << 1
        start[n] = code
    out = []
    for n in lengths:
        out.append((int(format(start[n], f"0{n}b")[::-1], 2), n) if n else (0, 0))
        if n:
            start[n] += 1
    return out


def length_runs(lengths: list[int]) -> list[tuple[int, int, int]]:
    """(symbol, extra value, extra bits) of the code-length code, runs as 16, 17 and 18."""
    out, at = [], 0
    while at < len(lengths):
        v, n = lengths[at], 1
        while at + n < len(lengths) and lengths[at + n] == v:
            n += 1
        at += n
        if v:
            out.append((v, 0, 0))
            n -= 1
        while n >= 3:
            k = min(n, 138 if not v else 6)
            out.append((16, k - 3, 2) if v else (17, k - 3, 3) if k <= 10 else (18, k - 11, 7))
            n -= k
        out += [(v, 0, 0)] * n
    return out


class BitWriter:
    """Bits, lowest first."""

    def __init__(self):
        self.out, self.held, self.n = bytearray(), 0, 0

    def put(self, value: int, bits: int) -> None:
        self.held |= value << self.n
        self.n += bits
        while self.n >= 8:
            self.out.append(self.held & 255)
            self.held >>= 8
            self.n -= 8

    def finish(self) -> bytes:
        if self.n:
            self.put(0, 8 - self.n)
        return bytes(self.out)


def deflate(data: bytes) -> bytes:
    """data as one final dynamic block."""
    tokens = parse(data)
    lit, dist = (code_lengths(f, 15) for f in frequencies(tokens))
    n_lit, n_dist = max(257, len(lit) - next(k for k, n in enumerate(reversed(lit)) if n)), max(1, len(dist) - next(k for k, n in enumerate(reversed(dist)) if n))
    runs = length_runs(lit[:n_lit] + dist[:n_dist])
    freq = defaultdict(int, Counter(s for s, _, _ in runs))
    short = code_lengths([freq[k] for k in range(19)], 7)
    n_short = max(4, 19 - next(k for k, s in enumerate(reversed(CODE_ORDER)) if short[s]))
    w = BitWriter()
    for value, bits in ((1, 1), (2, 2), (n_lit - 257, 5), (n_dist - 1, 5), (n_short - 4, 4), *((short[s], 3) for s in CODE_ORDER[:n_short])):
        w.put(value, bits)
    codes = canonical(short)
    for s, extra, bits in runs:
        w.put(*codes[s])
        w.put(extra, bits)
    lits, dists = canonical(lit), canonical(dist)
    for a, distance in tokens:
        if not distance:
            w.put(*lits[a])
            continue
        for value, table, symbol, code in ((a, LENGTHS, _LENGTH_SYMBOL[a], lits[257 + _LENGTH_SYMBOL[a]]), (distance, DISTANCES, _DISTANCE_SYMBOL[distance], dists[_DISTANCE_SYMBOL[distance]])):
            w.put(*code)
            w.put(value - table[symbol][0], table[symbol][1])
    w.put(*lits[256])
    return w.finish()


def compress_zlib(data: bytes) -> bytes:
    """data in the zlib format by the encoder of this module."""
    return b"\x78\xda" + deflate(data) + zlib.adler32(data).to_bytes(4)


def compress(data: bytes) -> bytes:
    return zlib.compress(data, 9)
