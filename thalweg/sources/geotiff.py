"""Pixels from GeoTIFF files and tiles of pixels as GeoTIFF: band 1, tiles or strips, plain or deflated."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# TIFF's field types (size, letter) and the numbers of its tags.
TYPES = {1: (1, "B"), 2: (1, "c"), 3: (2, "H"), 4: (4, "I"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q")}
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, SAMPLES, ROWS, COUNTS, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT, SCALE, TIE, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 42113


def _tags(data: bytes) -> tuple[str, dict[int, tuple]]:
    """Of the first image: byte order, and the tags' values."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None:
        raise ValueError("not a TIFF file")
    big = struct.unpack_from(order + "H", data, 2)[0] == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)[0]
    count, entry, inline, number = (struct.unpack_from(order + "Q", data, at)[0], 20, 8, "Q") if big else (struct.unpack_from(order + "H", data, at)[0], 12, 4, "I")
    tags, at = {}, at + (8 if big else 2)
    for i in range(count):
        p = at + i * entry
        tag, kind, n = struct.unpack_from(order + "HH" + number, data, p)
        if kind not in TYPES:
            continue
        size, letter = TYPES[kind]
        value = p + entry - inline
        if size * n > inline:
            value = struct.unpack_from(order + number, data, value)[0]
        tags[tag] = struct.unpack_from(f"{order}{n}{letter}", data, value)
    return order, tags


def decode(data: bytes) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, col, values) of each tile or strip of band 1; refuses compressions besides deflate."""
    order, t = _tags(data)
    if t.get(SAMPLES, (1,))[0] != 1:
        raise ValueError("more than one band in a pixel")
    width, height, how, predictor = t[WIDTH][0], t[HEIGHT][0], t.get(COMPRESSION, (1,))[0], t.get(PREDICTOR, (1,))[0]
    if how not in (1, 8, 32946) or predictor not in (1, 2):
        raise ValueError(f"compression {how} with predictor {predictor} cannot be read")
    kind = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[t.get(FORMAT, (1,))[0]] }{t[BITS][0] // 8}")
    tiled = TILE_WIDTH in t
    w, h = (t[TILE_WIDTH][0], t[TILE_HEIGHT][0]) if tiled else (width, min(height, t.get(ROWS, (height,))[0]))
    across = -(-width // w)
    for i, (at, n) in enumerate(zip(t[TILE_OFFSETS if tiled else OFFSETS], t[TILE_COUNTS if tiled else COUNTS])):
        row, col = i // across * h, i % across * w
        if not n:
            continue
        raw = data[at : at + n] if how == 1 else zlib.decompress(data[at : at + n])
        px = np.frombuffer(raw, kind).reshape(-1, w)
        if predictor == 2:
            px = np.cumsum(px, axis=1, dtype=kind)
        yield row, col, px[: height - row, : width - col]


def encode(px: np.ndarray, north: float, west: float, size: float, nodata: int | None = None) -> bytes:
    """One strip, deflated, with its place and nodata."""
    kind = {"u": 1, "i": 2, "f": 3}[px.dtype.kind]
    body = zlib.compress(np.ascontiguousarray(px).astype(px.dtype.newbyteorder("<")).tobytes())
    words = [(WIDTH, 4, (px.shape[1],)), (HEIGHT, 4, (px.shape[0],)), (BITS, 3, (px.dtype.itemsize * 8,)), (COMPRESSION, 3, (8,)), (262, 3, (1,)), (OFFSETS, 4, (8,)), (SAMPLES, 3, (1,)), (ROWS, 4, (px.shape[0],)), (COUNTS, 4, (len(body),)), (FORMAT, 3, (kind,)), (SCALE, 12, (size, size, 0.0)), (TIE, 12, (0.0, 0.0, 0.0, west, north, 0.0))]
    if nodata is not None:
        words.append((NODATA, 2, tuple(bytes([b]) for b in str(nodata).encode() + b"\0")))
    at = 8 + len(body) + len(body) % 2
    beyond, entries = at + 2 + 12 * len(words) + 4, b""
    extra = b""
    for tag, kind_, values in words:
        packed = struct.pack(f"<{len(values)}{TYPES[kind_][1]}", *values)
        if len(packed) > 4:
            entries += struct.pack("<HHII", tag, kind_, len(values), beyond + len(extra))
            extra += packed + b"\0" * (len(packed) % 2)
        else:
            entries += struct.pack("<HHI", tag, kind_, len(values)) + packed.ljust(4, b"\0")
    return struct.pack("<2sHI", b"II", 42, at) + body + b"\0" * (len(body) % 2) + struct.pack("<H", len(words)) + entries + struct.pack("<I", 0) + extra


def read(spark: SparkSession, path: str, skip: int | None = None) -> DataFrame:
    """(path, row, col, value) of the pixels of all files there but those equal to `skip`.

    A file is one record, held whole by one task, as Spark's binary source does; large grids come as many tiles.
    """

    def run(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in files:
            for name, data in zip(some["path"], some["content"]):
                for row, col, px in decode(bytes(data)):
                    r, c = np.nonzero(np.ones(px.shape, bool) if skip is None else px != skip)
                    yield pd.DataFrame({"path": name, "row": r.astype(np.int64) + row, "col": c.astype(np.int64) + col, "value": px[r, c].astype(np.float64)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, row long, col long, value double")


def tiles(pixels: DataFrame, value: str, side: int, kind: str, nodata: int, north: float, west: float, size: float) -> DataFrame:
    """(trow, tcol, content): pixels (row, col, value) as one GeoTIFF a tile; positions without a pixel are nodata."""

    def run(px: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(px["row"].iloc[0]) // side, int(px["col"].iloc[0]) // side
        out = np.full((side, side), nodata, kind)
        out[px["row"] - tr * side, px["col"] - tc * side] = px[value]
        return pd.DataFrame({"trow": [tr], "tcol": [tc], "content": [encode(out, north - tr * side * size, west + tc * side * size, size, nodata)]})

    from pyspark.sql import functions as F

    return pixels.select("row", "col", value).groupBy(F.expr(f"row div {side}"), F.expr(f"col div {side}")).applyInPandas(run, "trow long, tcol long, content binary")
