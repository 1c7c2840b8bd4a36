"""Image forensics on decoded images (the `image` data source): one image at a time in NumPy, nothing exploded to rows of pixels."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PATCH = 32


def images(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("image").option("dropInvalid", True).load(path).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")


def _unfiltered(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """Rows of a PNG without their filters."""
    rows = np.frombuffer(raw, np.uint8)[: height * (stride + 1)].reshape(height, stride + 1)
    out = np.zeros((height + 1, stride + step), np.uint8)  # a row above and a pixel before, of zeros
    for y in range(height):
        kind, line, up = rows[y, 0], rows[y, 1:], out[y]
        here = out[y + 1]
        if kind == 0:
            here[step:] = line
        elif kind == 1:
            here[step:] = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            here[step:] = line + up[step:]
        else:
            for x in range(stride):
                a, b, c = int(here[x]), int(up[x + step]), int(up[x])
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    near = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = (a, b, c)[near.index(min(near))]
                here[x + step] = (int(line[x]) + guess) & 255
    return out[1:, step:]


def decode(blob: bytes) -> np.ndarray | None:
    """Height x width x channels (grey, or blue, green, red) of a picture; None if it can't be read.

    PNG of eight bits without interlacing and plain BMP are read here; others if an imaging library is at hand.
    """
    if blob.startswith(b"\x89PNG\r\n\x1a\n"):
        at, data, palette, head = 8, [], None, None
        while at + 8 <= len(blob):
            n, name = struct.unpack_from(">I4s", blob, at)
            part = blob[at + 8 : at + 8 + n]
            if name == b"IHDR":
                head = struct.unpack(">IIBBBBB", part)
            elif name == b"PLTE":
                palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
            elif name == b"IDAT":
                data.append(part)
            at += 12 + n
        channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(head[3]) if head else None
        if channels and head[2] == 8 and not head[6]:
            a = _unfiltered(zlib.decompress(b"".join(data)), head[1], head[0] * channels, channels).reshape(head[1], head[0], channels)
            a = palette[a[..., 0]] if head[3] == 3 and palette is not None else a[..., : 1 if channels < 3 else 3]
            return np.ascontiguousarray(a[..., ::-1])
    if blob.startswith(b"BM") and len(blob) > 54:
        start, size, width, height, bits, packed = *struct.unpack_from("<I", blob, 10), *struct.unpack_from("<I", blob, 14), *struct.unpack_from("<ii", blob, 18), *struct.unpack_from("<HI", blob, 28)
        stride = (3 * width + 3) // 4 * 4
        if size >= 40 and bits == 24 and not packed and start + stride * abs(height) <= len(blob):
            a = np.frombuffer(blob, np.uint8, stride * abs(height), start).reshape(abs(height), stride)[:, : 3 * width].reshape(abs(height), width, 3)
            return np.ascontiguousarray(a[::-1] if height > 0 else a)
    try:
        from PIL import Image
    except ImportError:
        return None
    a = np.asarray(Image.open(io.BytesIO(blob)).convert("RGB"))
    return np.ascontiguousarray(a[..., ::-1])


def decoded(pictures: DataFrame) -> DataFrame:
    """origin, height, width, nChannels and data of each picture (origin, picture) that can be read, as images() gives them."""

    def run(blob: bytes | None) -> tuple | None:
        try:
            a = decode(bytes(blob))
        except (ValueError, TypeError, IndexError, OSError, struct.error, zlib.error):
            a = None
        return (*a.shape, a.tobytes()) if a is not None and a.size else None

    found = pictures.select("origin", by_row(run, "height int, width int, nChannels int, data binary")("picture").alias("r"))
    return found.where("r is not null").select("origin", "r.*")


def _grey(a: np.ndarray) -> np.ndarray:
    return a[..., :3].mean(axis=2) if a.ndim == 3 else a


def phash(a: np.ndarray) -> int:
    """64 bits: which low DCT coefficients of the 32 x 32 picture exceed their median."""
    g = _grey(a.astype(float))
    rows, cols = (np.linspace(0, n, 33).astype(int) for n in g.shape)
    small = np.array([[g[r0 : max(r1, r0 + 1), c0 : max(c1, c0 + 1)].mean() for c0, c1 in zip(cols, cols[1:], strict=False)] for r0, r1 in zip(rows, rows[1:], strict=False)])
    k = np.arange(32)
    dct = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / 64)
    low = (dct @ small @ dct.T)[:8, :8].ravel()
    bits = low > np.median(low)
    return int(np.packbits(bits).view(">i8")[0])


def copy_move(a: np.ndarray, stride: int = 16, apart: int = 50) -> tuple[int, int]:
    """(votes of the commonest translation between alike patches, severity)."""
    g = _grey(a.astype(float))
    ys, xs = np.arange(0, g.shape[0] - PATCH + 1, stride), np.arange(0, g.shape[1] - PATCH + 1, stride)
    if not len(ys) or not len(xs):
        return 0, 0
    lap = np.zeros_like(g)
    lap[1:-1, 1:-1] = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    at = np.array([(y, x) for y in ys for x in xs])
    f = np.array([(p.mean(), p.std(), q.var()) for y, x in at for p, q in [(g[y : y + PATCH, x : x + PATCH], lap[y : y + PATCH, x : x + PATCH])]])
    order = np.argsort(f[:, 0])
    votes: dict[tuple[int, int], int] = {}
    for k, i in enumerate(order):
        stop = np.searchsorted(f[order, 0], f[i, 0] + 0.5, "right")
        j = order[k + 1 : stop]
        near = (np.abs(f[j, 1] - f[i, 1]) <= 0.5) & (np.abs(f[j, 2] - f[i, 2]) <= 0.02 * np.maximum(f[j, 2], f[i, 2])) & (np.hypot(*(at[j] - at[i]).T) >= apart) & (f[j, 1] > 1)
        for d in at[j[near]] - at[i]:
            key = tuple(d if tuple(d) > (0, 0) else -d)
            votes[key] = votes.get(key, 0) + 1
    top = max(votes.values(), default=0)
    return top, 3 if top >= 30 else 2 if top >= 15 else 1 if top >= 5 else 0


def patch_splice(a: np.ndarray, z_cut: float = 6.0, cluster_cut: int = 8) -> tuple[float, int, int]:
    """(largest robust z of a patch's colour divergence from its neighbours, largest cluster of outliers, severity)."""
    a = a if a.ndim == 3 else a[..., None]
    ny, nx = a.shape[0] // PATCH, a.shape[1] // PATCH
    if ny < 2 or nx < 2:
        return 0.0, 0, 0
    hist = np.zeros((ny, nx, a.shape[2] * 16))
    for y in range(ny):
        for x in range(nx):
            p = a[y * PATCH : (y + 1) * PATCH, x * PATCH : (x + 1) * PATCH]
            h = np.concatenate([np.histogram(p[..., c], 16, (0, 256))[0] for c in range(a.shape[2])]).astype(float)
            hist[y, x] = h / h.sum() + 1e-12

    def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        m = (p + q) / 2
        return 0.5 * (p * np.log(p / m)).sum(-1) + 0.5 * (q * np.log(q / m)).sum(-1)

    total, count = np.zeros((ny, nx)), np.zeros((ny, nx))
    for s, t in (((slice(1, None), slice(None)), (slice(None, -1), slice(None))), ((slice(None), slice(1, None)), (slice(None), slice(None, -1)))):
        d = divergence(hist[s], hist[t])
        for side in (s, t):
            total[side] += d
            count[side] += 1
    score = total / count
    mad = np.median(np.abs(score - np.median(score))) * 1.4826 or 1e-9
    z = (score - np.median(score)) / mad
    out, cluster = z >= z_cut, 0
    seen = np.zeros_like(out)
    for start in zip(*np.nonzero(out), strict=True):
        stack, size = [start] if not seen[start] else [], 0
        seen[start] = True
        while stack:
            y, x = stack.pop()
            size += 1
            for q in [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if 0 <= q[0] < ny and 0 <= q[1] < nx and out[q] and not seen[q]:
                    seen[q] = True
                    stack.append(q)
        cluster = max(cluster, size)
    return float(z.max()), cluster, 3 if z.max() >= z_cut and cluster >= cluster_cut else 2 if z.max() >= z_cut or cluster >= cluster_cut else 0


def spectral(a: np.ndarray) -> tuple[float, float, int]:
    """(largest robust z in the outer spectrum, residual energy after smoothing, severity)."""
    g = _grey(a.astype(float))
    if min(g.shape) < 64:
        return 0.0, 1.0, 0
    power = np.log1p(np.abs(np.fft.fftshift(np.fft.fft2(g - g.mean()))))
    y, x = np.indices(g.shape)
    r = np.hypot(y - g.shape[0] // 2, x - g.shape[1] // 2).astype(int)
    radial = np.bincount(r.ravel(), power.ravel())[: min(g.shape) // 2] / np.maximum(1, np.bincount(r.ravel())[: min(g.shape) // 2])
    outer = radial[int(0.6 * len(radial)) :]
    mad = np.median(np.abs(outer - np.median(outer))) * 1.4826 or 1e-9
    z = float(np.abs(outer - np.median(outer)).max() / mad)
    weight = total = np.zeros_like(g)
    for i in range(-2, 3):
        for j in range(-2, 3):
            near = np.roll(g, (i, j), (0, 1))
            w = np.exp(-(i * i + j * j) / 8 - (near - g) ** 2 / (2 * 25**2))
            weight, total = weight + w, total + w * near
    residual = float(min(1.0, np.abs(g - total / weight).std() / 25))
    strong = (z >= 5, residual <= 0.3)
    fires = (z >= 3, residual <= 0.5)
    return z, residual, 4 if all(strong) else 3 if all(fires) else 2 if any(strong) else 1 if any(fires) else 0


def by_row(run: Callable, schema: str) -> Callable:
    """A function of a row's columns to a struct. Workers get rows by the hundred: an Arrow batch of ten thousand pictures wouldn't fit their memory."""
    return F.udf(run, f"struct<{schema}>", useArrow=False).asNondeterministic()


def each(pictures: DataFrame, kernel: Callable[[np.ndarray], tuple], schema: str) -> DataFrame:
    """origin and what the kernel gives for each picture."""

    def run(height: int, width: int, channels: int, data: bytes) -> tuple:
        return kernel(np.frombuffer(data, np.uint8).reshape(height, width, channels))

    return pictures.select("origin", by_row(run, schema)("height", "width", "nChannels", "data").alias("r")).select("origin", "r.*")


def hashed(pictures: DataFrame) -> DataFrame:
    return each(pictures, lambda a: (phash(a),), "phash long")


def copy_moves(pictures: DataFrame) -> DataFrame:
    return each(pictures, copy_move, "votes int, severity int")


def patch_splices(pictures: DataFrame) -> DataFrame:
    return each(pictures, patch_splice, "z double, cluster int, severity int")


def spectra(pictures: DataFrame) -> DataFrame:
    return each(pictures, spectral, "z double, residual double, severity int")
