"""Pictures to RGB and to JPEG, with numpy alone.

``decode`` reads PNG (8 and 16 bits, not interlaced), binary PGM and PPM, and BMP (24 and 32 bits,
uncompressed) into RGB; transparency is dropped. ``encode`` writes baseline JPEG without
subsampling, with Huffman tables made for the picture. ``to_jpeg`` is the encoder of the image sink:
what is a JPEG already is stored as it is.
"""

from __future__ import annotations

import heapq
import struct
import zlib

import numpy as np

# The quantisation tables of the JPEG standard (luminance, chrominance) at quality 50.
_LUMINANCE = """16 11 10 16 24 40 51 61  12 12 14 19 26 58 60 55  14 13 16 24 40 57 69 56  14 17 22 29 51 87 80 62
18 22 37 56 68 109 103 77  24 35 55 64 81 104 113 92  49 64 78 87 103 121 120 101  72 92 95 98 112 100 103 99"""
_CHROMINANCE = """17 18 24 47 99 99 99 99  18 21 26 66 99 99 99 99  24 26 56 99 99 99 99 99  47 66 99 99 99 99 99 99
99 99 99 99 99 99 99 99  99 99 99 99 99 99 99 99  99 99 99 99 99 99 99 99  99 99 99 99 99 99 99 99"""
_TABLES = [np.array(t.split(), np.int64).reshape(8, 8) for t in (_LUMINANCE, _CHROMINANCE)]

# the zigzag: diagonals, each the other way round
_ZIGZAG = np.array([8 * i + j for i, j in sorted(((i, j) for i in range(8) for j in range(8)), key=lambda x: (sum(x), x[0] if sum(x) % 2 else x[1]))])
_DCT = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


# ---------------------------------------------------------------- reading


def _png(data: bytes) -> np.ndarray:
    at, head, body, palette = 8, None, [], None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(chunk)
        at += 12 + n
    if head is None:
        raise ValueError("no header")
    w, h, depth, kind, _, _, interlaced = head
    if interlaced or depth not in (8, 16):
        raise ValueError("this kind of PNG isn't read")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    step = channels * depth // 8
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, 1 + w * step)
    out = np.zeros((h + 1, w * step), np.uint8)
    for y in range(h):
        line, above, rule = raw[y, 1:], out[y], raw[y, 0]
        if rule == 0:
            out[y + 1] = line
        elif rule == 2:
            out[y + 1] = line + above
        elif rule == 1:
            out[y + 1] = np.cumsum(line.reshape(w, step), axis=0, dtype=np.uint8).ravel()
        else:
            now, up = [0] * step + [0] * len(line), [0] * step + above.tolist()
            for i, x in enumerate(line.tolist(), step):
                a, b, c = now[i - step], up[i], up[i - step]
                if rule == 3:
                    guess = (a + b) // 2
                else:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                now[i] = (x + guess) & 255
            out[y + 1] = now[step:]
    px = out[1:].reshape(h, w, step)[:, :, :: depth // 8]
    if kind == 3:
        if palette is None:
            raise ValueError("no palette")
        return palette[px[:, :, 0]]
    return px[:, :, :3] if kind in (2, 6) else np.repeat(px[:, :, :1], 3, axis=2)


def _netpbm(data: bytes) -> np.ndarray:
    words, at = [], 2
    while len(words) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        words.append(int(data[at:end]))
        at = end
    w, h, top = words
    if top != 255:
        raise ValueError("only 8 bits a channel are read")
    channels = 3 if data[:2] == b"P6" else 1
    px = np.frombuffer(data, np.uint8, w * h * channels, at + 1).reshape(h, w, channels)
    return px if channels == 3 else np.repeat(px, 3, axis=2)


def _bmp(data: bytes) -> np.ndarray:
    start, _, w, h, _, bits, packed = struct.unpack("<IIiiHHI", data[10:34])
    if bits not in (24, 32) or packed not in (0, 3):
        raise ValueError("this kind of BMP isn't read")
    stride = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(h), start).reshape(abs(h), stride)
    px = rows[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1]
    return px[::-1] if h > 0 else px


def decode(data: bytes) -> np.ndarray:
    """RGB pixels (height, width, 3) of a picture; a ValueError if it can't be read."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
        if data[:2] in (b"P5", b"P6"):
            return _netpbm(data)
        if data[:2] == b"BM":
            return _bmp(data)
    except (struct.error, zlib.error, KeyError, IndexError) as e:
        raise ValueError(f"a broken picture: {e}") from e
    raise ValueError("an unknown kind of picture")


# ---------------------------------------------------------------- writing


def _huffman(counts: np.ndarray) -> tuple[list[int], list[int], np.ndarray, np.ndarray]:
    """(codes per length 1..16, symbols, code and length of each symbol); no code is all ones."""
    heap = [(int(n), i, [s]) for i, (s, n) in enumerate([*((s, n) for s, n in enumerate(counts) if n), (256, 0)])]
    depth = np.zeros(257, np.int64)
    heapq.heapify(heap)
    while len(heap) > 1:
        (n, _, a), (m, i, b) = heapq.heappop(heap), heapq.heappop(heap)
        depth[a + b] += 1
        heapq.heappush(heap, (n + m, 300 + i, a + b))
    if depth[256] == 0:
        depth[256] = 1
    number = np.bincount(depth[depth > 0], minlength=258)
    for k in range(257, 16, -1):  # too long codes move up, two at a time
        while number[k] > 0:
            j = k - 2
            while number[j] == 0:
                j -= 1
            number[k] -= 2
            number[k - 1] += 1
            number[j + 1] += 2
            number[j] -= 1
    longest = int(np.flatnonzero(number)[-1])
    number[longest] -= 1  # the code of all ones stays free
    order = sorted((s for s in range(256) if counts[s]), key=lambda s: (depth[s], s))
    code, codes, lengths, at = 0, np.zeros(256, np.int64), np.zeros(256, np.int64), 0
    for k in range(1, 17):
        for s in order[at : at + number[k]]:
            codes[s], lengths[s] = code, k
            code += 1
        at += number[k]
        code <<= 1
    return number[1:17].tolist(), order, codes, lengths


def _bits_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Category and extra bits of coefficients."""
    size = np.ceil(np.log2(np.abs(values) + 1)).astype(np.int64)
    return size, np.where(values < 0, values + (1 << size) - 1, values)


def encode(rgb: np.ndarray, quality: int = 95) -> bytes:
    """A baseline JPEG of RGB pixels."""
    h, w = rgb.shape[:2]
    if not (0 < h < 65536 and 0 < w < 65536):
        raise ValueError("a picture without pixels, or too large")
    scale = 5000 // max(1, quality) if quality < 50 else 200 - 2 * min(100, quality)
    quants = [np.clip((t * scale + 50) // 100, 1, 255) for t in _TABLES]
    x = np.pad(rgb.astype(np.float64), ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge")
    r, g, b = x[..., 0], x[..., 1], x[..., 2]
    y = 0.299 * r + 0.587 * g + 0.114 * b
    planes = (y - 128, (b - y) / 1.772, (r - y) / 1.402)
    symbols = []  # per component: order, table, symbol, extra bits, their number
    for c, plane in enumerate(planes):
        blocks = plane.reshape(plane.shape[0] // 8, 8, plane.shape[1] // 8, 8).swapaxes(1, 2).reshape(-1, 8, 8)
        z = np.rint(_DCT @ blocks @ _DCT.T / quants[min(c, 1)]).astype(np.int64).reshape(-1, 64)[:, _ZIGZAG]
        n = len(z)
        size, extra = _bits_of(np.diff(z[:, 0], prepend=0))
        rank = lambda block, place, c=c: (block * 3 + c) * 256 + place
        symbols.append((rank(np.arange(n), 0), np.full(n, 2 * min(c, 1)), size, extra, size))
        block, place = np.nonzero(z[:, 1:])
        place += 1
        before = np.where(np.append(True, np.diff(block) != 0), 0, np.append(0, place[:-1])) if len(block) else place
        run = place - before - 1
        size, extra = _bits_of(z[block, place])
        table = 2 * min(c, 1) + 1
        symbols.append((rank(block, place * 4 - 1), np.full(len(block), table), (run % 16) * 16 + size, extra, size))
        for k in range(3):  # runs of sixteen zeros
            long = run // 16 > k
            symbols.append((rank(block[long], place[long] * 4 - 4 + k), np.full(long.sum(), table), np.full(long.sum(), 0xF0), np.zeros(long.sum(), np.int64), np.zeros(long.sum(), np.int64)))
        open_end = np.flatnonzero(z[:, 63] == 0)
        zero = np.zeros(len(open_end), np.int64)
        symbols.append((rank(open_end, 255), np.full(len(open_end), table), zero, zero, zero))
    order, table, symbol, extra, size = (np.concatenate(s) for s in zip(*symbols))
    by = np.argsort(order, kind="stable")
    table, symbol, extra, size = table[by], symbol[by], extra[by], size[by]
    trees = [_huffman(np.bincount(symbol[table == t], minlength=256)) for t in range(4)]
    codes, lengths = np.stack([t[2] for t in trees]), np.stack([t[3] for t in trees])
    value = codes[table, symbol] << size | extra
    length = lengths[table, symbol] + size
    total = int(length.sum())
    shift = np.repeat(np.cumsum(length), length) - 1 - np.arange(total)
    bits = (np.repeat(value, length) >> shift & 1).astype(np.uint8)
    body = np.packbits(np.concatenate([bits, np.ones(-total % 8, np.uint8)])).tobytes().replace(b"\xff", b"\xff\x00")
    part = lambda mark, data: bytes([255, mark]) + struct.pack(">H", len(data) + 2) + data
    out = b"\xff\xd8" + part(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0")
    out += b"".join(part(0xDB, bytes([i, *q.reshape(64)[_ZIGZAG].tolist()])) for i, q in enumerate(quants))
    out += part(0xC0, struct.pack(">BHHB", 8, h, w, 3) + bytes(v for i in range(3) for v in (i + 1, 0x11, min(i, 1))))
    out += b"".join(part(0xC4, bytes([(t % 2) << 4 | t // 2, *trees[t][0], *trees[t][1]])) for t in range(4))
    return out + part(0xDA, bytes([3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0])) + body + b"\xff\xd9"


def to_jpeg(data: bytes, quality: int = 95) -> bytes:
    """A picture as JPEG; one that is a JPEG already stays as it is."""
    return data if data[:3] == b"\xff\xd8\xff" else encode(decode(data), quality)
