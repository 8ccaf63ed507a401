"""Image arithmetic in numpy: stretching, windows, equalisation, resampling, perturbations, PNG bytes.

These are the kernels of the image sources; they run inside ``mapInPandas`` on decoded arrays.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from fathom.operators.metrics import bilinear_matrix


def stretched(values: np.ndarray) -> np.ndarray:
    """Percentiles 0.5 to 99.5 of the finite pixels become 0 to 255; a constant image becomes 0."""
    v = np.asarray(values, dtype=np.float64)
    finite = v[np.isfinite(v)]
    if not len(finite):
        return np.zeros(v.shape, dtype=np.uint8)
    low, high = np.percentile(finite, [0.5, 99.5])
    if high <= low:
        low, high = finite.min(), finite.max()
    if high <= low:
        return np.zeros(v.shape, dtype=np.uint8)
    return np.floor(np.clip((np.nan_to_num(v, nan=low, posinf=high, neginf=low) - low) / (high - low), 0, 1) * 255).astype(np.uint8)


def windowed(values: np.ndarray, window: tuple[float, float] | None) -> np.ndarray:
    """Clip to a window (or to percentiles 0.5 and 99.5) and scale to bytes."""
    v = np.asarray(values, dtype=np.float64)
    low, high = window if window else np.percentile(v, [0.5, 99.5])
    return (np.clip((v - low) / max(high - low, 1e-12), 0, 1) * 255).astype(np.uint8)


def binary_mask(values: np.ndarray) -> np.ndarray:
    return np.where(np.asarray(values) > 0, 255, 0).astype(np.uint8)


def equalisation_table(histogram: np.ndarray) -> np.ndarray:
    """Lookup of 256 grey values from a histogram whose empty bin is ignored.

    The cumulative share scales to 255; results strictly between 0 and 150 are squeezed into 30..150.
    """
    counts = np.asarray(histogram, dtype=np.float64).copy()
    counts[0] = 0
    if not counts.sum():
        return np.zeros(256, dtype=np.uint8)
    grey = np.floor(255 * np.cumsum(counts / counts.sum()))
    squeezed = np.floor(grey / 150 * 120 + 30)
    return np.where((grey > 0) & (grey < 150), squeezed, grey).astype(np.uint8)


def equalised(image: np.ndarray) -> np.ndarray:
    return equalisation_table(np.bincount(image.ravel(), minlength=256))[image]


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, channel by channel."""
    a, b = bilinear_matrix(image.shape[0], height), bilinear_matrix(image.shape[1], width)
    return np.einsum("yi,ijc,xj->yxc", a, image.astype(np.float64), b)


def letterbox(image: np.ndarray, size: int, mean, sd) -> tuple[np.ndarray, tuple[int, int, int, int]]:
    """Fit an RGB image into a black square, scale to 0..1, normalise; also the box ``(top, left, h, w)``."""
    h, w = image.shape[:2]
    scale = size / max(h, w)
    nh, nw = max(1, round(h * scale)), max(1, round(w * scale))
    top, left = (size - nh) // 2, (size - nw) // 2
    canvas = np.zeros((size, size, image.shape[2]))
    canvas[top : top + nh, left : left + nw] = resized(image, nh, nw)
    return (canvas / 255 - np.asarray(mean)) / np.asarray(sd), (top, left, nh, nw)


def boxed_mask(mask: np.ndarray, size: int, box: tuple[int, int, int, int]) -> np.ndarray:
    """A mask resampled by nearest pixel into the same box."""
    top, left, h, w = box
    rows = np.minimum(((np.arange(h) + 0.5) * mask.shape[0] / h).astype(int), mask.shape[0] - 1)
    cols = np.minimum(((np.arange(w) + 0.5) * mask.shape[1] / w).astype(int), mask.shape[1] - 1)
    out = np.zeros((size, size), dtype=np.uint8)
    out[top : top + h, left : left + w] = mask[np.ix_(rows, cols)] > 0
    return out


def perturb(image: np.ndarray, kind: str, mean, sd, rng: np.random.Generator) -> np.ndarray:
    """A nuisance variant of a normalised image: ``noise``, ``blur``, ``gamma`` or ``resolution``."""
    mean, sd = np.asarray(mean), np.asarray(sd)
    x = np.clip(image * sd + mean, 0, 1)
    if kind == "noise":
        x = x + 0.015 * rng.standard_normal(x.shape)
    elif kind == "blur":
        padded = np.pad(x, ((1, 1), (1, 1), (0, 0)))
        h, w = x.shape[:2]
        x = sum(padded[i : i + h, j : j + w] for i in range(3) for j in range(3)) / 9
    elif kind == "gamma":
        x = np.maximum(x, 1e-6) ** 1.08
    elif kind == "resolution":
        h, w = x.shape[:2]
        x = resized(_reduced(x, max(1, int(h * 0.75)), max(1, int(w * 0.75))), h, w)
    else:
        raise ValueError(f"unknown perturbation {kind!r}")
    return (np.clip(x, 0, 1) - mean) / sd


def _triangle_matrix(source: int, target: int) -> np.ndarray:
    """Resampling weights of a triangle as wide as the reduction, so that shrinking does not alias."""
    scale = max(1.0, source / target)
    centre = (np.arange(target) + 0.5) * source / target
    weight = np.maximum(0.0, 1 - np.abs(np.arange(source)[None, :] + 0.5 - centre[:, None]) / scale)
    return weight / weight.sum(1, keepdims=True)


def _reduced(image: np.ndarray, height: int, width: int) -> np.ndarray:
    return np.einsum("yi,ijc,xj->yxc", _triangle_matrix(image.shape[0], height), image, _triangle_matrix(image.shape[1], width))


def png_bytes(image: np.ndarray) -> bytes:
    """Grey or RGB bytes as a PNG file."""
    image = np.ascontiguousarray(image, dtype=np.uint8)
    h, w = image.shape[:2]
    colour = 0 if image.ndim == 2 else 2
    raw = b"".join(b"\0" + row.tobytes() for row in image)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def png_pixels(data: bytes) -> np.ndarray:
    """Pixels of an 8-bit, non-interlaced grey, grey-alpha, RGB or RGBA PNG; alpha is dropped."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, packed, head = 8, [], None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        at += size + 12
    w, h, depth, colour, _, _, interlace = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or interlace or channels is None:
        raise ValueError("only plain 8-bit PNG images are read")
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8).reshape(h, 1 + w * channels)
    out = np.zeros((h, w * channels), dtype=np.uint8)
    for y in range(h):
        line, mode = raw[y, 1:].astype(np.int64), raw[y, 0]
        up = out[y - 1].astype(np.int64) if y else np.zeros(w * channels, dtype=np.int64)
        if mode == 0:
            out[y] = line
        elif mode == 2:
            out[y] = (line + up) & 255
        else:
            own = np.zeros(w * channels, dtype=np.int64)
            for x in range(w * channels):
                a = own[x - channels] if x >= channels else 0
                c = up[x - channels] if x >= channels else 0
                if mode == 1:
                    guess = a
                elif mode == 3:
                    guess = (a + up[x]) // 2
                else:
                    p = a + up[x] - c
                    guess = min((abs(p - a), 0, a), (abs(p - up[x]), 1, up[x]), (abs(p - c), 2, c))[2]
                own[x] = (line[x] + guess) & 255
            out[y] = own
    out = out.reshape(h, w, channels)
    return out[:, :, 0] if channels < 3 else out[:, :, :3]


def blended_panels(image: np.ndarray, mask: np.ndarray | None, maps: list[np.ndarray], top: float = 2.0) -> np.ndarray:
    """Panels side by side: the input, the mask, and each score map over the input on a fixed scale."""
    rgb = image if image.ndim == 3 else np.repeat(image[:, :, None], 3, axis=2)
    panels = [rgb, np.repeat(binary_mask(mask)[:, :, None], 3, axis=2) if mask is not None else np.zeros_like(rgb)]
    for score in maps:
        heat = np.clip(np.asarray(score) / top, 0, 1)
        colour = np.stack([255 * heat, np.zeros_like(heat), 255 * (1 - heat)], axis=2)
        panels.append((0.55 * rgb + 0.45 * colour).astype(np.uint8))
    return np.concatenate(panels, axis=1).astype(np.uint8)
