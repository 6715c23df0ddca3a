"""GeoTIFF files as rows of pixels, and back: strips, uncompressed or deflated, bands interleaved by pixel, WGS84 degrees.

A file is one raster and one task reads it; a window or some bands of it are cut in that task, before any row is made.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the TIFF and GeoTIFF formats: sizes and codes of field types, tags, sample formats.
_TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 11: "f", 12: "d", 16: "Q"}
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _PHOTOMETRIC, _OFFSETS, _SAMPLES, _STRIP_ROWS, _COUNTS, _PLANAR, _PREDICTOR, _TILE, _FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 339
_SCALE, _TIEPOINT, _KEYS, _NODATA = 33550, 33922, 34735, 42113
_NONE, _DEFLATE, _OLD_DEFLATE = 1, 8, 32946
_WGS84 = (1, 1, 0, 3, 1024, 0, 1, 2, 1025, 0, 1, 1, 2048, 0, 1, 4326)
_ROWS = 64


def encode(data: np.ndarray, transform: tuple[float, float, float, float, float, float], nodata: float | None = None, deflate: bool = True) -> bytes:
    """A GeoTIFF of ``data`` (height, width, bands) whose pixels are not rotated."""
    height, width, bands = data.shape
    data = np.ascontiguousarray(data, data.dtype.newbyteorder("<"))
    kind = {"u": 1, "i": 2, "f": 3}[data.dtype.kind]
    strips = [data[r : r + _ROWS].tobytes() for r in range(0, height, _ROWS)]
    strips = [zlib.compress(s) for s in strips] if deflate else strips
    places = np.cumsum([8, *map(len, strips)])
    fields = [
        (_WIDTH, 4, (width,)), (_HEIGHT, 4, (height,)), (_BITS, 3, (data.dtype.itemsize * 8,) * bands), (_COMPRESSION, 3, (_DEFLATE if deflate else _NONE,)), (_PHOTOMETRIC, 3, (1,)),
        (_OFFSETS, 4, tuple(places[:-1].tolist())), (_SAMPLES, 3, (bands,)), (_STRIP_ROWS, 4, (_ROWS,)), (_COUNTS, 4, tuple(map(len, strips))), (_PLANAR, 3, (1,)), (_FORMAT, 3, (kind,) * bands),
        (_SCALE, 12, (transform[0], -transform[4], 0.0)), (_TIEPOINT, 12, (0.0, 0.0, 0.0, transform[2], transform[5], 0.0)), (_KEYS, 3, _WGS84),
    ]
    if nodata is not None:
        fields.append((_NODATA, 2, tuple(bytes([b]) for b in f"{nodata}\0".encode())))
    at = int(places[-1])
    pad = at % 2
    start = at + pad
    extra, entries = b"", b""
    for tag, code, values in fields:
        packed = struct.pack(f"<{len(values)}{_TYPES[code]}", *values)
        if len(packed) > 4:
            place = start + 2 + 12 * len(fields) + 4 + len(extra)
            extra += packed + b"\0" * (len(packed) % 2)
            packed = struct.pack("<I", place)
        entries += struct.pack("<HHI", tag, code, len(values)) + packed.ljust(4, b"\0")
    return struct.pack("<2sHI", b"II", 42, start) + b"".join(strips) + b"\0" * pad + struct.pack("<H", len(fields)) + entries + struct.pack("<I", 0) + extra


def _fields(data: bytes) -> tuple[str, dict[int, tuple]]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(f"{order}H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack(f"{order}I", data[4:8])[0]
    out = {}
    for k in range(struct.unpack(f"{order}H", data[at : at + 2])[0]):
        tag, code, n = struct.unpack(f"{order}HHI", data[at + 2 + 12 * k : at + 10 + 12 * k])
        if code not in _TYPES:
            continue
        form = f"{order}{n}{_TYPES[code]}" if code != 5 else f"{order}{2 * n}I"
        size, place = struct.calcsize(form), at + 10 + 12 * k
        if size > 4:
            place = struct.unpack(f"{order}I", data[place : place + 4])[0]
        out[tag] = struct.unpack(form, data[place : place + size])
    return order, out


def decode(data: bytes, window: tuple[int, int, int, int] | None = None) -> tuple[np.ndarray, tuple, float | None]:
    """``(height, width, bands)``, the transform and the no-data value; of a window ``(row, col, height, width)`` only strips that it meets are read."""
    order, f = _fields(data)
    if _TILE in f or f.get(_PLANAR, (1,))[0] != 1 or f.get(_PREDICTOR, (1,))[0] != 1 or f.get(_COMPRESSION, (1,))[0] not in (_NONE, _DEFLATE, _OLD_DEFLATE):
        raise ValueError("only strips are read, interleaved by pixel, without predictor, uncompressed or deflated")
    width, height, bands = f[_WIDTH][0], f[_HEIGHT][0], f.get(_SAMPLES, (1,))[0]
    kind = np.dtype(f"{order}{'uif'[f.get(_FORMAT, (1,))[0] - 1]}{f[_BITS][0] // 8}")
    row, col, tall, wide = window or (0, 0, height, width)
    tall, wide = max(0, min(tall, height - row)), max(0, min(wide, width - col))
    rows = min(f.get(_STRIP_ROWS, (height,))[0], height)
    parts = []
    for k, (place, size) in enumerate(zip(f[_OFFSETS], f[_COUNTS])):
        if k * rows < row + tall and (k + 1) * rows > row:
            raw = data[place : place + size]
            raw = raw if f.get(_COMPRESSION, (1,))[0] == _NONE else zlib.decompress(raw)
            strip = np.frombuffer(raw, kind).reshape(-1, width, bands)
            parts.append(strip[max(0, row - k * rows) : row + tall - k * rows, col : col + wide])
    out = np.concatenate(parts) if parts else np.zeros((0, wide, bands), kind)
    transform = None
    if _SCALE in f and _TIEPOINT in f:
        (sx, sy, _), (i, j, _, x, y, _) = f[_SCALE], f[_TIEPOINT][:6]
        transform = (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
    text = b"".join(f[_NODATA]).rstrip(b"\0 ").decode() if _NODATA in f else ""
    return out, transform, float(text) if text else None


def read(spark: SparkSession, path: str, bands: list[int] | None = None, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """``path, r, c, b1, b2, ...`` (numbers) of the pixels of all files below ``path``; ``bands`` from 1 (by default the first),
    ``window`` as ``(row, col, height, width)``. Pixels outside a raster give no rows; files that are no such GeoTIFF are an error.
    """
    bands = bands or [1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = decode(content, window)[0]
                height, width, n = data.shape
                if max(bands) > n:
                    raise ValueError(f"{name} has {n} bands")
                for a in range(0, height, 256):  # rows leave in parts
                    part = data[a : a + 256]
                    size = part.shape[0] * width
                    r = np.repeat(np.arange(a, a + part.shape[0]), width) + (window[0] if window else 0)
                    c = np.tile(np.arange(width), part.shape[0]) + (window[1] if window else 0)
                    values = [pa.array(part[:, :, b - 1].reshape(-1).astype(np.float64)) for b in bands]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * size, pa.string()), pa.array(r, pa.int64()), pa.array(c, pa.int64()), *values], ["path", "r", "c", *(f"b{b}" for b in bands)])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tif*").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, r long, c long, " + ", ".join(f"b{b} double" for b in bands))


def write(pixels: DataFrame, path: str, transform: tuple[float, float, float, float, float, float], bands: tuple[str, ...] = ("p",), dtype: str = "float32", nodata: float | None = None) -> DataFrame:
    """Write ``pixels(scene, r, c, <bands>)`` to ``path/<scene>.tif``, one raster per scene and task; return ``path, scene, height, width``.

    Rasters go from row and column 0 to the largest; pixels that are missing or null get ``nodata``, or 0. Files go through Arrow's file
    systems, so ``path`` is any that these reach.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        height, width = int(frame.r.max()) + 1, int(frame.c.max()) + 1
        data = np.full((height, width, len(bands)), nodata or 0, dtype)
        for k, b in enumerate(bands):
            known = frame[b].notna().to_numpy()
            data[frame.r.to_numpy()[known], frame.c.to_numpy()[known], k] = frame[b].to_numpy()[known]
        system, place = fs.FileSystem.from_uri(path)
        system.create_dir(place, recursive=True)
        name = f"{place}/{frame.scene.iloc[0]}.tif"
        with system.open_output_stream(name) as out:
            out.write(encode(data, transform, nodata))
        return pd.DataFrame({"path": [name], "scene": [str(frame.scene.iloc[0])], "height": [height], "width": [width]})

    rows = pixels.select("scene", "r", "c", *bands).groupBy("scene").applyInPandas(run, "path string, scene string, height long, width long")
    return rows
