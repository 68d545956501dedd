"""Pictures of sparsity patterns: the grid is an aggregate, the PNG is written from the grid on the driver."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrel.relation import Matrix

#: Longest edge of a picture, in pixels; bounds the grid that comes to the driver.
EDGE = 1024


def for_each_nonzero(a: Matrix) -> DataFrame:
    """The stored entries that aren't zero."""
    return a.df.where("v <> 0")


def grid_shape(a: Matrix, edge: int = EDGE) -> tuple[int, int]:
    if 0 in a.shape:
        raise ValueError("a dimension is zero")
    scale = min(1.0, edge / max(a.shape))
    return max(1, round(a.nrows * scale)), max(1, round(a.ncols * scale))


def build_grid(a: Matrix, edge: int = EDGE) -> DataFrame:
    """Rows ``y, x, n, m``: a picture cell's number of nonzeros and largest magnitude."""
    h, w = grid_shape(a, edge)
    cell = for_each_nonzero(a).select(F.expr(f"i * {h} div {a.nrows}").alias("y"), F.expr(f"j * {w} div {a.ncols}").alias("x"), F.abs("v").cast("double").alias("m"))
    return cell.groupBy("y", "x").agg(F.count("m").alias("n"), F.max("m").alias("m"))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(pixels: np.ndarray) -> bytes:
    """A grey (h x w) or colour (h x w x 3) picture of bytes as a PNG file."""
    h, w = pixels.shape[:2]
    colour = 2 if pixels.ndim == 3 else 0
    raw = np.concatenate([np.zeros((h, 1), np.uint8), pixels.astype(np.uint8).reshape(h, -1)], 1).tobytes()
    head = struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw)) + _chunk(b"IEND", b"")


def write_png_gray(path: str, pixels: np.ndarray) -> None:
    with open(path, "wb") as file:
        file.write(png(pixels))


write_png_rgb = write_png_gray


def _values(a: Matrix, edge: int, field: str) -> np.ndarray:
    out = np.zeros(grid_shape(a, edge))
    for r in build_grid(a, edge).collect():
        out[r["y"], r["x"]] = r[field]
    return out


def spy(a: Matrix, path: str, edge: int = EDGE) -> None:
    """Black where there is a nonzero, white elsewhere."""
    write_png_gray(path, np.where(_values(a, edge, "n") > 0, 0, 255))


def colormap(t: np.ndarray) -> np.ndarray:
    """From 0 to 1: blue over green to red."""
    t = np.clip(t, 0, 1)[..., None]
    return (255 * np.clip(np.concatenate([1.5 - np.abs(4 * t - 3), 1.5 - np.abs(4 * t - 2), 1.5 - np.abs(4 * t - 1)], -1), 0, 1)).astype(np.uint8)


def _coloured(values: np.ndarray, log: bool) -> np.ndarray:
    there = values > 0
    shown = np.where(there, np.log10(np.where(there, values, 1)) if log else values, 0)
    low, high = (shown[there].min(), shown[there].max()) if there.any() else (0.0, 0.0)
    t = (shown - low) / (high - low) if high > low else np.ones_like(shown)
    return np.where(there[..., None], colormap(t), 255)


def spy_magnitude(a: Matrix, path: str, log: bool = False, edge: int = EDGE) -> None:
    """Coloured by the largest magnitude in each cell."""
    write_png_rgb(path, _coloured(_values(a, edge, "m"), log))


def spy_density(a: Matrix, path: str, log: bool = False, edge: int = EDGE) -> None:
    """Coloured by the number of nonzeros in each cell."""
    write_png_rgb(path, _coloured(_values(a, edge, "n"), log))
