"""Lengths, areas and small rules of the grid as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The WGS84 ellipsoid, the radius of the sphere of its area, and the earth of the MERIT pixel area.
A = 6378137.0
FLATTENING = 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)
MERIT_RADIUS = 6378136.0
MERIT_E2 = 0.00669447
AUTHALIC = A * math.sqrt(0.5 * (1 + (1 - E2) / math.sqrt(E2) * math.atanh(math.sqrt(E2))))


def _zone(lat: Column) -> Column:
    e, s = math.sqrt(E2), F.sin(F.radians(lat))
    return s / (1 - E2 * s * s) + F.log((1 + e * s) / (1 - e * s)) / (2 * e)


def pixel_area_m2(lat: Column, width: float, height: float) -> Column:
    """The ellipsoid's strip between a pixel's edges in latitude, cut to its width."""
    return F.lit(A * A * (1 - E2) * math.radians(abs(width)) * 0.5) * (_zone(lat + abs(height) / 2) - _zone(lat - abs(height) / 2))


def pixel_area_m2_merit(lat: Column, width: float, height: float) -> Column:
    """The truncated zone series of MERIT Hydro, rounded to single precision before and after the width."""
    zone = lambda x: F.sin(F.radians(x)) * (1 + MERIT_E2 * F.pow(F.sin(F.radians(x)), F.lit(2)) / 2)
    strip = F.lit(math.pi * MERIT_RADIUS**2 * (1 - MERIT_E2) / 180) * (zone(lat + abs(height) / 2) - zone(lat - abs(height) / 2))
    return (strip.cast("float") * F.lit(abs(width)).cast("float")).cast("float").cast("double")


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on the authalic sphere, scaled by ellipsoidal to spherical arc at the middle latitude."""
    turn = lon2 - lon1
    dlon = F.radians(F.when(turn > 180, turn - 360).when(turn < -180, turn + 360).otherwise(turn))
    dlat, p1, p2 = F.radians(lat2 - lat1), F.radians(lat1), F.radians(lat2)
    h = F.least(F.lit(1.0), F.pow(F.sin(dlat / 2), F.lit(2)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlon / 2), F.lit(2)))
    sphere = 2 * AUTHALIC * F.atan2(F.sqrt(h), F.sqrt(1 - h))
    mid = (p1 + p2) / 2
    w = F.sqrt(1 - E2 * F.pow(F.sin(mid), F.lit(2)))
    own = F.hypot(A / w * F.cos(mid) * dlon, A * (1 - E2) / (w * w * w) * dlat)
    ball = F.hypot(AUTHALIC * F.cos(mid) * dlon, AUTHALIC * dlat)
    return F.when((sphere > 0) & (ball > 0), sphere * own / ball).otherwise(sphere)


def upstream_count_of(value: Column) -> Column:
    """A producer's count, rounded half up; 0 outside 1 to 9e18 and for NaN."""
    v = value.cast("double")
    return F.when(~F.isnan(v) & (v >= 1) & (v < 9e18), F.floor(v + 0.5)).otherwise(0).cast("long")


def block_floor(x: Column, block: int) -> Column:
    return (F.floor(x / block) * block).cast("long")


def block_ceil(x: Column, block: int) -> Column:
    return ((F.floor((x - 1) / block) + 1) * block).cast("long")


def centre(row: Column, col: Column, north: float, west: float, size: float, cols: int, periodic: bool = False) -> tuple[Column, Column]:
    """lat, lon of pixel centres; columns past the seam of a periodic grid count from its first."""
    at = F.pmod(col, F.lit(cols)) if periodic else col
    return north - (row + 0.5) * size, west + (at + 0.5) * size


def box(row_min: Column, row_max: Column, col_min: Column, col_max: Column, north: float, west: float, size: float) -> tuple[Column, Column, Column, Column]:
    """north, south, west, east of right-open boxes of pixels."""
    return north - row_min * size, north - row_max * size, west + col_min * size, west + col_max * size


def step_lengths_m(row: Column, north: float, size: float) -> dict[str, Column]:
    """Lengths of the steps that start in a row: east or west, north, south, and the diagonals north and south."""
    lat = north - (row + 0.5) * size
    to = lambda up, side: distance_m(lat, F.lit(0.0), lat + up * size, F.lit(side * size))
    return {"ew": to(0, 1), "n": to(1, 0), "s": to(-1, 0), "nd": to(1, 1), "sd": to(-1, 1)}


def unrolled(boxes: DataFrame, cols: int) -> DataFrame:
    """boxes with col_min, col_max (last columns) of objects that span over half a periodic grid taken from the frame that
    is shifted by half (shift_min, shift_max), past the last column where need be; astride says which."""
    half = cols // 2
    astride = (F.col("col_max") - F.col("col_min") > half) & (F.col("col_max") > F.col("col_min"))
    first = F.pmod(F.col("shift_min") - half, F.lit(cols))
    kept = [c for c in boxes.columns if c not in ("col_min", "col_max", "shift_min", "shift_max")]
    return boxes.select(*kept, F.when(astride, first).otherwise(F.col("col_min")).alias("col_min"), F.when(astride, first + F.col("shift_max") - F.col("shift_min")).otherwise(F.col("col_max")).alias("col_max"), astride.cast("int").alias("astride"))


def integral(value: Column) -> Column:
    """The value as a long; null where it is not finite, not whole or beyond 63 bits."""
    v = value.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < 2.0**63) & (v == F.floor(v)), v.cast("decimal(38,0)").cast("long"))


def region_order(region: Column) -> Column:
    """Sorts regions by their unit, then by id: parts of four digits stand where their unit of two stands."""
    return F.struct(F.when((region >= 100) & (region < 10000), F.floor(region / 100)).otherwise(region).cast("long"), F.when(region < 100, 0).otherwise(region).cast("long"))


def with_hilbert(cells: DataFrame, row: str, col: str, order: int, name: str = "hilbert") -> DataFrame:
    """The place of each cell on a Hilbert curve of side 2^order, a projection a level."""
    out = cells.select("*", F.col(row).cast("long").alias("_r"), F.col(col).cast("long").alias("_c"), F.lit(0).cast("long").alias(name))
    last = (1 << order) - 1
    keep = cells.columns
    for level in reversed(range(order)):
        rb, cb = (F.shiftright(F.col(x), level).bitwiseAND(F.lit(1).cast("long")) for x in ("_r", "_c"))
        out = out.select(*keep, "_r", "_c", rb.alias("_rb"), cb.alias("_cb"), name)
        quarter = F.lit(1 << (2 * level)).cast("long") * (3 * F.col("_cb")).bitwiseXOR(F.col("_rb"))
        flipped = lambda x: F.when(F.col("_cb") == 1, last - F.col(x)).otherwise(F.col(x))
        out = out.select(*keep, F.when(F.col("_rb") == 0, flipped("_c")).otherwise(F.col("_r")).alias("_r"), F.when(F.col("_rb") == 0, flipped("_r")).otherwise(F.col("_c")).alias("_c"), (F.col(name) + quarter).alias(name))
    return out.select(*keep, name)
