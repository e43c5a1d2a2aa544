"""Windows and halos of a grid, overlapping boxes, and views of objects as sides, polygons and colours."""

from __future__ import annotations

import struct
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Objects that colours() takes: a view's table and its pairs, of some 100 bytes each, are held by the driver.
MOST_OBJECTS = 2_000_000


def window(pixels: DataFrame, value: str, row0: int, nrow: int, col0: int, ncol: int, cols: int, fill: int, periodic: bool = False) -> DataFrame:
    """(row, col, value) of every position of a rectangle, fill where the grid has none; columns wrap on a periodic grid.

    The pixels are filtered by row before they meet the positions.
    """
    spark = pixels.sparkSession
    at = spark.range(nrow * ncol).select((F.lit(row0) + F.expr(f"id div {ncol}")).alias("row"), (F.lit(col0) + F.col("id") % ncol).alias("col"))
    at = at.withColumn("c", F.pmod("col", F.lit(cols)) if periodic else F.col("col"))
    near = pixels.where(F.col("row").between(row0, row0 + nrow - 1)).select("row", F.col("col").alias("c"), F.col(value).alias("value"))
    return at.join(near, ["row", "c"], "left").select("row", "col", F.coalesce("value", F.lit(fill)).alias("value"))


def with_halo(pixels: DataFrame, side: int, cols: int, periodic: bool = False) -> DataFrame:
    """pixels once for each tile (trow, tcol) that holds them or touches them: a tile and its ring of one pixel."""
    wide = -(-cols // side)
    around = F.inline(F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r in (-1, 0, 1) for c in (-1, 0, 1)]))
    seen = pixels.select("*", around)
    # Going round the seam: the tile of the column beside, counted on the wrapped grid.
    col = F.pmod(F.col("col") + F.col("dc"), F.lit(cols)) if periodic else F.col("col") + F.col("dc")
    tiles = seen.select(*pixels.columns, F.floor((F.col("row") + F.col("dr")) / side).alias("trow"), F.floor(col / side).alias("tcol"))
    return tiles.where((F.col("trow") >= 0) & (F.col("tcol") >= 0) & (F.col("tcol") < wide)).distinct()


def overlapping(boxes: DataFrame, block: int) -> DataFrame:
    """(a, b), a < b: right-open boxes (id, row_min, row_max, col_min, col_max) that share a pixel; they meet by blocks."""
    every = lambda lo, hi: F.explode(F.sequence(F.expr(f"{lo} div {block}"), F.expr(f"({hi} - 1) div {block}")))
    at = boxes.select("*", every("row_min", "row_max").alias("br")).select("*", every("col_min", "col_max").alias("bc"))
    other = at.select("br", "bc", *[F.col(c).alias(f"o_{c}") for c in boxes.columns])
    return at.join(other, ["br", "bc"]).where("id < o_id and row_min < o_row_max and o_row_min < row_max and col_min < o_col_max and o_col_min < col_max").select(F.col("id").alias("a"), F.col("o_id").alias("b")).distinct()


def mosaic(parts: list[DataFrame]) -> DataFrame:
    """The union of tiles (row, col, ...). Raises if a pixel lies in two."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    if whole.groupBy("row", "col").count().where("count > 1").limit(1).count():
        raise ValueError("tiles overlap")
    return whole


def sides(cells: DataFrame) -> DataFrame:
    """(basin_id, r0, c0, r1, c1): the sides at which objects on cells end, each with its object on the left."""
    ends = (("dr", -1, 0, (0, 1), (0, 0)), ("dr", 1, 0, (1, 0), (1, 1)), ("dc", 0, -1, (0, 0), (1, 0)), ("dc", 0, 1, (1, 1), (0, 1)))
    four = F.inline(F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc"), F.lit(a[0]).alias("a0"), F.lit(a[1]).alias("a1"), F.lit(b[0]).alias("b0"), F.lit(b[1]).alias("b1")) for _, r, c, a, b in ends]))
    out = cells.select("crow", "ccol", "basin_id", four).select("basin_id", (F.col("crow") + F.col("dr")).alias("nr"), (F.col("ccol") + F.col("dc")).alias("nc"), (F.col("crow") + F.col("a0")).alias("r0"), (F.col("ccol") + F.col("a1")).alias("c0"), (F.col("crow") + F.col("b0")).alias("r1"), (F.col("ccol") + F.col("b1")).alias("c1"))
    beside = cells.select(F.col("crow").alias("nr"), F.col("ccol").alias("nc"), F.col("basin_id").alias("n_id"))
    return out.join(beside, ["nr", "nc"], "left").where("n_id is null or n_id <> basin_id").select("basin_id", "r0", "c0", "r1", "c1")


def _rings(edges: list[tuple[int, int, int, int]]) -> list[list[tuple[int, int]]]:
    """Closed rings of (row, col) corners; where two rings touch at a corner they stay apart. Straight runs are joined."""
    onward = defaultdict(list)
    for r0, c0, r1, c1 in sorted(edges):
        onward[r0, c0].append((r1, c1))
    rings = []
    for first in sorted(onward):
        while onward[first]:
            ring, at = [first], onward[first].pop(0)
            while at != first:
                back, going = ring[-1], onward[at]
                turn = lambda to: (at[0] - back[0]) * (to[1] - at[1]) - (at[1] - back[1]) * (to[0] - at[0])  # noqa: B023, E731
                ring.append(at)
                to = max(going, key=turn)  # the object is on the left, rows grow downward: the turn into it
                going.remove(to)
                at = to
            rings.append([p for i, p in enumerate(ring) if (ring[i - 1][0] - p[0]) * (ring[(i + 1) % len(ring)][1] - p[1]) != (ring[i - 1][1] - p[1]) * (ring[(i + 1) % len(ring)][0] - p[0])])
    return rings


def _area2(ring: list[tuple[int, int]]) -> int:
    """Twice the area; above 0 for outer rings."""
    return sum(c0 * -r1 - c1 * -r0 for (r0, c0), (r1, c1) in zip(ring, ring[1:] + ring[:1]))


def _inside(r: float, c: float, ring: list[tuple[int, int]]) -> bool:
    hit = [(c0 + (r - r0) / (r1 - r0) * (c1 - c0)) > c for (r0, c0), (r1, c1) in zip(ring, ring[1:] + ring[:1]) if (r0 > r) != (r1 > r)]
    return sum(hit) % 2 == 1


def polygons(cells: DataFrame, north: float, west: float, size: float) -> DataFrame:
    """(basin_id, cells, parts, geometry): each object on cells as an ISO WKB multipolygon, little-endian, of parts that hang
    together by sides. Only the sides of an object come together, a group an object."""

    def build(px: pd.DataFrame) -> pd.DataFrame:
        rings = _rings(list(px[["r0", "c0", "r1", "c1"]].itertuples(index=False, name=None)))
        outer = sorted((r for r in rings if _area2(r) > 0), key=_area2)
        held = {i: [r] for i, r in enumerate(outer)}
        for hole in (r for r in rings if _area2(r) < 0):
            # A point within the object beside the hole's first side.
            (r0, c0), (r1, c1) = hole[0], hole[1]
            dr, dc = (r1 > r0) - (r1 < r0), (c1 > c0) - (c1 < c0)
            r, c = r0 + dr * 0.5 - dc * 0.25, c0 + dc * 0.5 + dr * 0.25
            held[next(i for i, o in enumerate(outer) if _inside(r, c, o))].append(hole)
        at = lambda p: struct.pack("<dd", west + p[1] * size, north - p[0] * size)
        line = lambda ring: struct.pack("<I", len(ring) + 1) + b"".join(at(p) for p in [*ring, ring[0]])
        made = [struct.pack("<BII", 1, 3, len(p)) + b"".join(line(r) for r in p) for p in held.values()]
        return pd.DataFrame({"basin_id": [px["basin_id"].iloc[0]], "cells": [sum(map(_area2, rings)) // 2], "parts": [len(made)], "geometry": [struct.pack("<BII", 1, 6, len(made)) + b"".join(made)]})

    return sides(cells).groupBy("basin_id").applyInPandas(build, "basin_id long, cells long, parts long, geometry binary")


def with_empty(table: DataFrame, made: DataFrame, missing: int = -9999) -> DataFrame:
    """table with its objects' cells, 0 and no geometry for those without, and their boxes' rows `missing`."""
    return table.join(made, "basin_id", "left").withColumn("cells", F.coalesce("cells", F.lit(0).cast("long"))).withColumn("box_row", F.when(F.col("cells") > 0, F.col("row_min")).otherwise(missing))


def colours(objects: DataFrame, pairs: DataFrame, at_least: int = 8) -> DataFrame:
    """(basin_id, colour): touching objects (a, b) differ; at_least numbers are used evenly.

    Objects are taken out one by one, fewest neighbours left first, and coloured in the opposite order. A number on no
    neighbour's neighbour is preferred, then the one used least, then the smallest. One order over a whole graph is
    sequential, so the driver does it, up to MOST_OBJECTS.
    """
    spark = objects.sparkSession
    ids = [r[0] for r in objects.select("basin_id").distinct().orderBy("basin_id").limit(MOST_OBJECTS + 1).collect()]
    if len(ids) > MOST_OBJECTS:
        raise ValueError(f"over {MOST_OBJECTS} objects")
    near: dict[int, set[int]] = {i: set() for i in ids}
    for a, b in pairs.select("a", "b").toLocalIterator():
        if a in near and b in near:
            near[a].add(b)
            near[b].add(a)
    left = {i: len(n) for i, n in near.items()}
    # Buckets by neighbours left, each a stack: the last one put in is taken first.
    stacks: dict[int, list[int]] = defaultdict(list)
    for i in reversed(ids):
        stacks[left[i]].append(i)
    order, low = [], 0
    while len(order) < len(ids):
        while not stacks[low]:
            low += 1
        i = stacks[low].pop()
        if left.get(i) != low:
            continue
        del left[i]
        order.append(i)
        for n in sorted(near[i] & left.keys()):
            left[n] -= 1
            stacks[left[n]].append(n)
        low = max(0, low - 1)
    used, colour = [0] * at_least, {}
    for i in reversed(order):
        barred = {colour[n] for n in near[i] if n in colour}
        second = {colour[m] for n in near[i] for m in near[n] if m != i and m in colour}
        free = [k for k in range(len(used)) if k not in barred]
        if not free:
            used.append(0)
            free = [len(used) - 1]
        k = min([k for k in free if k not in second] or free, key=lambda k: (used[k], k))
        used[k] += 1
        colour[i] = k
    return spark.createDataFrame([(i, k + 1) for i, k in colour.items()], "basin_id long, colour int")


def clashes(coloured: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b): pairs that got one colour; none if the colouring holds."""
    of = lambda c: coloured.select(F.col("basin_id").alias(c), F.col("colour").alias(f"colour_{c}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").where("colour_a = colour_b").select("a", "b")
