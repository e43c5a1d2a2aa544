"""Tables of basins, groups and views from labelled pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thalweg.operators.order import numbered


def ranked(labelled: DataFrame) -> DataFrame:
    """basin_id 1..N by pixels falling, then outlet; counts and right-open boxes. labelled: pix, row, col, root.

    The order is made by ranges, so no partition holds all outlets.
    """
    stats = labelled.groupBy("root").agg(F.count("*").alias("grid_count"), F.min("row").alias("row_min"), (F.max("row") + 1).alias("row_max"), F.min("col").alias("col_min"), (F.max("col") + 1).alias("col_max"))
    return numbered(stats, "basin_id", F.desc("grid_count"), F.asc("root")).select("basin_id", F.col("root").alias("outlet_pix"), "grid_count", "row_min", "row_max", "col_min", "col_max")


def vote(pixels: DataFrame) -> DataFrame:
    """(basin_id, code, votes): the most frequent code above 0 of each basin, ties by code."""
    n = pixels.where("code > 0").groupBy("basin_id", "code").agg(F.count("*").alias("votes"))
    return n.select("*", F.row_number().over(Window.partitionBy("basin_id").orderBy(F.desc("votes"), "code")).alias("k")).where("k = 1").drop("k")


def boundaries(pixels: DataFrame) -> DataFrame:
    """(basin_id, neighbour_id, edges): pixel sides that two basins share, both ways round."""
    at = pixels.select("row", "col", "basin_id")
    beside = F.inline(F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in ((0, 1), (1, 0))]))
    moved = at.select("row", "col", "basin_id", beside).select((F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"), F.col("basin_id").alias("a"))
    met = moved.join(at, ["row", "col"]).where("a <> basin_id")
    both = F.inline(F.array(F.struct(F.col("a").alias("basin_id"), F.col("basin_id").alias("neighbour_id")), F.struct(F.col("basin_id"), F.col("a").alias("neighbour_id"))))
    return met.select(both).groupBy("basin_id", "neighbour_id").agg(F.count("*").alias("edges"))


def nearest(free: DataFrame, coded: DataFrame, reach: int) -> DataFrame:
    """(basin_id, near_id, d2): of each free outlet the nearest coded one within reach, ties by id.

    Both: basin_id, row, col. Outlets meet by cells of the reach's size, so only neighbours are compared.
    """
    cell = lambda x: F.floor(F.col(x) / reach)
    around = F.inline(F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r in (-1, 0, 1) for c in (-1, 0, 1)]))
    asked = free.select("basin_id", "row", "col", cell("row").alias("r"), cell("col").alias("c"), around).select("basin_id", "row", "col", (F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dc")).alias("c"))
    there = coded.select(F.col("basin_id").alias("near_id"), F.col("row").alias("row2"), F.col("col").alias("col2"), cell("row").alias("r"), cell("col").alias("c"))
    d2 = (F.col("row") - F.col("row2")) * (F.col("row") - F.col("row2")) + (F.col("col") - F.col("col2")) * (F.col("col") - F.col("col2"))
    best = asked.join(there, ["r", "c"]).select("basin_id", F.struct(d2.alias("d2"), "near_id").alias("s")).where(F.col("s.d2") <= reach * reach).groupBy("basin_id").agg(F.min("s").alias("s"))
    return best.select("basin_id", "s.near_id", "s.d2")


def fold_view(pixels: DataFrame, factor: int, ids: int) -> DataFrame:
    """(crow, ccol, basin_id): cells with a quarter of land; ids up to `ids` with a quarter of it; most pixels, then smaller id."""
    n = pixels.groupBy(F.floor(F.col("row") / factor).alias("crow"), F.floor(F.col("col") / factor).alias("ccol"), "basin_id").agg(F.count("*").alias("n"))
    land = n.groupBy("crow", "ccol").agg(F.sum("n").alias("land"), F.min(F.when(F.col("basin_id") <= ids, F.struct((-F.col("n")).alias("less"), "basin_id"))).alias("best"))
    return land.where((F.col("land") * 100 >= 25 * factor * factor) & (-F.col("best.less") * 100 >= 25 * F.col("land"))).select("crow", "ccol", F.col("best.basin_id").alias("basin_id"))


def ids_of_view(ranked: DataFrame, factor: int) -> int:
    """How many basins hold at least a quarter of a cell's pixels; ranked by their pixels, they are the ids 1 to that."""
    return ranked.where(F.col("grid_count") * 4 >= factor * factor).count()


def adjacent(cells: DataFrame) -> DataFrame:
    """(a, b), a < b: objects that touch on cells, corners included."""
    ahead = F.inline(F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    moved = cells.select("crow", "ccol", "basin_id", ahead).select((F.col("crow") + F.col("dr")).alias("crow"), (F.col("ccol") + F.col("dc")).alias("ccol"), F.col("basin_id").alias("x"))
    met = moved.join(cells, ["crow", "ccol"]).where("x <> basin_id")
    return met.select(F.least("x", "basin_id").alias("a"), F.greatest("x", "basin_id").alias("b")).distinct()


def rolled_up(groups: DataFrame) -> DataFrame:
    """(level, code, basins, land, row_min, row_max, col_min, col_max) of level 3 and what folds from it."""
    parts = []
    for level, by in ((3, 1), (2, 10), (1, 100)):
        code = F.floor(F.col("code") / by).cast("long")
        parts.append(groups.groupBy(code.alias("code")).agg(F.count("*").alias("basins"), F.sum("grid_count").alias("land"), F.min("row_min").alias("row_min"), F.max("row_max").alias("row_max"), F.min("col_min").alias("col_min"), F.max("col_max").alias("col_max")).select(F.lit(level).alias("level"), "*"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
