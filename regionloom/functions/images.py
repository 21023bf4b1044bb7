"""Images as numpy arrays (rows x columns x channels, 8 bit): PNG reading, crops and the inputs of feature networks.

These run inside a plug-in, on one image at a time; Spark deals the images.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Mean and deviation of the channels that the networks were trained with (fixed values).
MEAN = (0.485, 0.456, 0.406)
STD = (0.229, 0.224, 0.225)
#: Channels of the PNG colour types with 8 bits a channel: grey, RGB, grey and alpha, RGB and alpha.
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def read_png(content: bytes) -> np.ndarray:
    """The pixels of a PNG of 8 bits a channel without interlacing; another kind is an error."""
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, header = 8, [], None
    while at + 8 <= len(content):
        n, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + n]
        at += 12 + n
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
    if header is None or header[2] != 8 or header[3] not in _CHANNELS or header[6]:
        raise ValueError("only PNGs of 8 bits a channel without interlacing are read")
    width, height, step = header[0], header[1], _CHANNELS[header[3]]
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, 1 + width * step)
    out, above = np.empty((height, width * step), np.uint8), np.zeros(width * step, np.uint8)
    for y, line in enumerate(lines):
        above = out[y] = _unfiltered(int(line[0]), line[1:], above, step)
    pixels = out.reshape(height, width, step)
    return pixels[:, :, 0] if step == 1 else pixels


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 1:  # differences to the pixel before, by channel
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
    if kind == 2:
        return line + above
    if kind not in (3, 4):
        raise ValueError("damaged PNG")
    made, up = [0] * step + line.tolist(), [0] * step + above.tolist()
    for i in range(step, len(made)):
        left, top, corner = made[i - step], up[i], up[i - step]
        if kind == 3:
            guess = (left + top) // 2
        else:
            guess = min((left, top, corner), key=lambda v, p=left + top - corner: abs(p - v))
        made[i] = (made[i] + guess) & 255
    return np.array(made[step:], np.uint8)


def grey(pixels: np.ndarray) -> np.ndarray:
    """Luma of 8-bit pixels by the usual integer weights; alpha is not read."""
    if pixels.ndim == 2 or pixels.shape[2] < 3:
        return pixels if pixels.ndim == 2 else pixels[:, :, 0]
    return (pixels[:, :, :3].astype(np.int64) @ np.array([19595, 38470, 7471]) + 0x8000 >> 16).astype(np.uint8)


def load_mask(content: bytes | None, size: tuple[int, int], path: str = "") -> np.ndarray:
    """The grey mask of an image of ``size`` (width, height); none, or one of another size, is an error."""
    if not content:
        raise ValueError("the mask region needs a mask for each image")
    mask = grey(read_png(content))
    if mask.shape != size[::-1]:
        raise ValueError(f"mask {path} is {mask.shape[1]}x{mask.shape[0]}, its image {size[0]}x{size[1]}")
    return mask


def mask_box(mask: np.ndarray) -> tuple[float, float, float, float]:
    """The least box around cells that are not zero; the whole image if there are none."""
    rows, columns = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    if not len(rows):
        return 0.0, 0.0, float(mask.shape[1]), float(mask.shape[0])
    return float(columns[0]), float(rows[0]), float(columns[-1] + 1), float(rows[-1] + 1)


def crop_of(box: tuple[float, float, float, float] | None, width: int, height: int, padding: float = 0.15, least: int = 32) -> tuple[int, int, int, int]:
    """``boxes.padded_crop`` for one image whose size is known only when it is decoded."""
    if box is None:
        return 0, 0, width, height

    def span(lo: float, hi: float, limit: int) -> tuple[int, int]:
        want = max((hi - lo) + 2 * ((hi - lo) * padding), float(least))
        a, b = (lo + hi) / 2 - want / 2, (lo + hi) / 2 + want / 2
        a, b = max(a, 0.0), b - a if a < 0 else b
        a, b = max(a - (b - limit) if b > limit else a, 0.0), min(b, float(limit))
        first = max(0, min(limit - 1, int(a)))
        return first, max(first + 1, min(limit, round(b)))

    (left, right), (top, bottom) = span(box[0], box[2], width), span(box[1], box[3], height)
    return left, top, right, bottom


def masked(pixels: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Pixels over black by a mask: of truth values, or of 8-bit weights, rounded."""
    weights = mask.reshape(mask.shape + (1,) * (pixels.ndim - 2))
    if mask.dtype == bool:
        return np.where(weights, pixels, 0)
    return ((pixels.astype(np.int64) * weights + 127) // 255).astype(pixels.dtype)


def resize(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bicubic (a = -0.5) with the kernel widened when it shrinks; columns, then rows, each rounded to 8 bits."""
    for axis, to in ((1, width), (0, height)):
        if pixels.shape[axis] != to:
            made = np.moveaxis(np.tensordot(_cubic(pixels.shape[axis], to), pixels, (1, axis)), 0, axis)
            pixels = np.clip(np.floor(made + 0.5), 0, 255).astype(np.uint8)
    return pixels


def _cubic(n: int, to: int) -> np.ndarray:
    """to x n weights, each row summing to one."""
    wide = max(n / to, 1.0)
    centres = (np.arange(to) + 0.5) * (n / to)
    x = np.abs((np.arange(n) + 0.5 - centres[:, None]) / wide)
    weights = np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0.0))
    return weights / weights.sum(axis=1, keepdims=True)


def _normalized(pixels: np.ndarray) -> np.ndarray:
    """Channels x rows x columns of 32-bit floats, normalised."""
    return np.moveaxis((pixels.astype(np.float32) / 255 - np.float32(MEAN)) / np.float32(STD), 2, 0)


def feature_input(pixels: np.ndarray, size: int) -> np.ndarray:
    """The shorter side to ``size``, then the square in the middle."""
    h, w = pixels.shape[:2]
    short, long = min(h, w), max(h, w)
    other = int(size * long / short)
    pixels = resize(pixels, *((size, other) if w <= h else (other, size)))
    top, left = round((pixels.shape[0] - size) / 2), round((pixels.shape[1] - size) / 2)
    return _normalized(pixels[top : top + size, left : left + size])


def heatmap_input(pixels: np.ndarray, size: int) -> np.ndarray:
    """The whole image as a square, without a crop."""
    return _normalized(resize(pixels, size, size))
