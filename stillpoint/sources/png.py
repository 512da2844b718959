"""PNG files of 8 bits a sample, without interlacing: read and written with zlib alone."""

from __future__ import annotations

import struct
import zlib

import numpy as np

_MAGIC = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def decode(data: bytes) -> np.ndarray:
    """h x w x c bytes; an alpha channel is dropped. ValueError for what isn't such a file."""
    if data[:8] != _MAGIC:
        raise ValueError("not a PNG file")
    at, body, head = 8, [], None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"IDAT":
            body.append(chunk)
        at += size + 12
    if head is None or head[2] != 8 or head[3] not in _CHANNELS or head[6]:
        raise ValueError("only 8-bit grey and RGB files without interlacing")
    w, h, c = head[0], head[1], _CHANNELS[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, 1 + w * c)
    out = np.zeros((h, w * c), np.uint8)
    above = np.zeros(w * c, np.int64)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        if kind == 1:  # running sums of each channel
            line = np.cumsum(line.reshape(w, c), axis=0).reshape(-1) & 255
        elif kind == 2:
            line = (line + above) & 255
        elif kind in (3, 4):
            for x in range(w * c):
                left = line[x - c] if x >= c else 0
                if kind == 3:
                    guess = (left + above[x]) >> 1
                else:
                    corner = above[x - c] if x >= c else 0
                    far = [(abs(above[x] - corner), left), (abs(left - corner), above[x]), (abs(left + above[x] - 2 * corner), corner)]
                    guess = min(far, key=lambda p: p[0])[1]
                line[x] = (line[x] + guess) & 255
        out[y], above = line, line
    return out.reshape(h, w, c)[:, :, : c - (c in (2, 4))]


def encode(pixels: np.ndarray) -> bytes:
    """A file of h x w or h x w x 3 bytes."""
    p = pixels.astype(np.uint8)
    h, w = p.shape[:2]
    kind = 2 if p.ndim == 3 and p.shape[2] == 3 else 0
    rows = np.concatenate([np.zeros((h, 1), np.uint8), p.reshape(h, -1)], axis=1).tobytes()
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return _MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
