"""PNG pictures as arrays of 8-bit samples, and back."""

from __future__ import annotations

import struct
import zlib

import numpy as np

# fixed values: the signature of PNG files, and samples a pixel by colour type
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _nearest(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of left, above and above left, the one nearest to left + above - above left; the first of equally near ones."""
    a, b, c = (x.astype(np.int16) for x in (a, b, c))
    p = a + b - c
    da, db, dc = np.abs(p - a), np.abs(p - b), np.abs(p - c)
    return np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c)).astype(np.uint8)


def _unfiltered(kind: int, row: np.ndarray, above: np.ndarray) -> np.ndarray:
    """A row of pixels from what was left of it by its filter."""
    if kind == 0:
        return row
    if kind == 1:
        return np.cumsum(row, axis=0, dtype=np.uint8)
    if kind == 2:
        return row + above
    if kind not in (3, 4):
        raise ValueError("no such filter")
    out, left, corner = np.empty_like(row), np.zeros_like(row[0]), np.zeros_like(row[0])
    for k in range(len(row)):
        guess = ((left.astype(np.int16) + above[k]) // 2).astype(np.uint8) if kind == 3 else _nearest(left, above[k], corner)
        out[k] = left = row[k] + guess
        corner = above[k]
    return out


def decoded(data: bytes) -> np.ndarray:
    """height x width x 3 or 4 samples: grey is repeated, palettes are looked up, alpha is kept.

    8 bits a sample and rows in order; a ValueError says what is wrong with other data.
    """
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG")
    at, head, body, palette = 8, None, [], None
    while at + 8 <= len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if len(part) < size:
            raise ValueError("cut short")
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif name == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            body.append(part)
        elif name == b"IEND":
            break
        at += 12 + size
    if not head or head[2] != 8 or head[3] not in SAMPLES or head[6]:
        raise ValueError("no 8-bit picture with rows in order")
    width, height, _, kind, *_ = head
    each = SAMPLES[kind]
    if not width or not height:
        raise ValueError("no pixels")
    try:
        raw = zlib.decompress(b"".join(body))
    except zlib.error as e:
        raise ValueError("damaged") from e
    if len(raw) != height * (1 + width * each):
        raise ValueError("wrong size")
    lines = np.frombuffer(raw, np.uint8).reshape(height, -1)
    out = np.zeros((height, width, each), np.uint8)
    above = np.zeros((width, each), np.uint8)
    for k in range(height):
        out[k] = above = _unfiltered(int(lines[k, 0]), lines[k, 1:].reshape(width, each), above)
    if kind == 3:
        if palette is None or out.max() >= len(palette):
            raise ValueError("no such colour")
        return palette[out[:, :, 0]]
    if kind in (0, 4):
        return np.concatenate((np.repeat(out[:, :, :1], 3, axis=2), out[:, :, 1:]), axis=2)
    return out


def encoded(pixels: np.ndarray, filters: tuple[int, ...] = (0,)) -> bytes:
    """A PNG of height x width x samples; rows take these filters in turn."""
    height, width, each = pixels.shape
    kind = {n: k for k, n in SAMPLES.items() if k != 3}[each]
    rows, above = [], np.zeros((width, each), np.uint8)
    for k, row in enumerate(pixels):
        left = np.vstack((np.zeros((1, each), np.uint8), row[:-1]))
        corner = np.vstack((np.zeros((1, each), np.uint8), above[:-1]))
        f = filters[k % len(filters)]
        mean = ((left.astype(np.int16) + above) // 2).astype(np.uint8)
        guess = (np.zeros_like(row), left, above, mean, _nearest(left, above, corner))[f]
        rows.append(bytes([f]) + (row - guess).tobytes())
        above = row
    chunk = lambda name, part: struct.pack(">I", len(part)) + name + part + struct.pack(">I", zlib.crc32(name + part))
    head = struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")


def statistics(pixels: np.ndarray, bins: int, grid: int) -> dict[str, list]:
    """Mean, deviation and quartiles of red, green and blue between 0 and 1; their histograms; their means by patch.

    Histograms have ``bins`` equal ranges a channel, one after the other; patches are ``grid`` x ``grid``, by rows.
    """
    colour = pixels[:, :, :3]
    flat = colour.reshape(-1, 3) / 255.0
    counts = [np.bincount(colour[:, :, c].ravel().astype(np.int64) * bins // 256, minlength=bins) for c in range(3)]
    patches = [part.reshape(-1, 3).mean(axis=0) / 255.0 for band in np.array_split(colour, min(grid, colour.shape[0])) for part in np.array_split(band, min(grid, colour.shape[1]), axis=1)]
    return {
        "mean": flat.mean(axis=0).tolist(),
        "deviation": flat.std(axis=0).tolist(),
        "quartiles": np.percentile(flat, [25, 50, 75], axis=0).T.ravel().tolist(),
        "histogram": np.concatenate(counts).tolist(),
        "patches": np.concatenate(patches).tolist(),
    }
