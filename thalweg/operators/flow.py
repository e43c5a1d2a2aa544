"""The forest of D8 flow: links, and what follows from all of a pixel's path or catchment.

Paths and catchments are folded by doubling: after k rounds every pixel knows the pixel 2^k steps down, the sums along
those steps, and the sums over what lies fewer than 2^k steps above. A round is an equi-join and a grouped sum, so the
closure of all pairs is never made, and the rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thalweg.sources.shared import cut

#: D8 code, row step, column step.
D8 = ((1, 0, 1), (2, 1, 1), (4, 1, 0), (8, 1, -1), (16, 0, -1), (32, -1, -1), (64, -1, 0), (128, -1, 1))
MOUTH, SINK, NODATA, UNKNOWN = 0, 255, 247, 254


def steepest_descent(surface: DataFrame) -> DataFrame:
    """(pix, row, col, code, down) of land pixels (pix, row, col, z): each flows to its lowest lower neighbour.

    Equal heights go by pixel; a pixel without a lower neighbour ends its path: a mouth if even, else a sink.
    """
    steps = F.inline(F.array(*[F.struct(F.lit(c).alias("code"), F.lit(r).alias("dr"), F.lit(k).alias("dc")) for c, r, k in D8]))
    offered = surface.select("pix", "z", "row", "col", steps).select("pix", "z", "code", (F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"))
    near = surface.select("row", "col", F.col("pix").alias("down"), F.col("z").alias("dz"))
    lower = offered.join(near, ["row", "col"]).where("dz < z or (dz = z and down < pix)")
    best = lower.groupBy("pix").agg(F.min(F.struct("dz", "down", "code")).alias("b")).select("pix", "b.code", "b.down")
    end = F.when(F.col("pix") % 2 == 0, MOUTH).otherwise(SINK)
    return surface.join(best, "pix", "left").select("pix", "row", "col", F.coalesce("code", end).alias("code"), "down")


def recode(pixels: DataFrame, codes: dict[int, int], sink: int, nodata: int, mouth: int | None, rows: int, cols: int, periodic: bool = False) -> DataFrame:
    """(pix, row, col, native) to one coding: nodata, then sink, then direction, a mouth if it leaves the land, then mouth, else unknown."""
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    named = pixels.select("pix", "row", "col", "native", table[F.col("native")].alias("d8"))
    dr, dc = (F.create_map(*[F.lit(x) for step in D8 for x in (step[0], step[k])])[F.col("d8")] for k in (1, 2))
    aimed = named.select("*", (F.col("row") + dr).alias("r2"), (F.pmod(F.col("col") + dc, F.lit(cols)) if periodic else F.col("col") + dc).alias("c2"))
    land = pixels.where(F.col("native") != nodata).select(F.col("row").alias("r2"), F.col("col").alias("c2"), F.lit(True).alias("land"))
    met = aimed.join(land, ["r2", "c2"], "left")
    is_mouth = F.lit(False) if mouth is None else F.col("native") == mouth
    code = F.when(F.col("native") == nodata, NODATA).when(F.col("native") == sink, SINK).when(F.col("d8").isNotNull(), F.when(F.col("land"), F.col("d8")).otherwise(MOUTH)).when(is_mouth, MOUTH).otherwise(UNKNOWN)
    return met.select("pix", "row", "col", "native", code.alias("code"))


def links(coded: DataFrame, cols: int, periodic: bool = False) -> DataFrame:
    """(pix, row, col, code, down) from D8 codes: down is null at mouths and sinks."""
    dr, dc = (F.create_map(*[F.lit(x) for step in D8 for x in (step[0], step[k])])[F.col("code")] for k in (1, 2))
    col = F.pmod(F.col("col") + dc, F.lit(cols)) if periodic else F.col("col") + dc
    return coded.where(F.col("code") != NODATA).select("pix", "row", "col", "code", ((F.col("row") + dr) * cols + col).cast("long").alias("down"))


def fold(flow: DataFrame, along: dict[str, str], above: dict[str, str], longest: str | None = None, start: str | None = None) -> DataFrame:
    """Of each pixel: root, hops, sums `along` its path down, sums `above` over its catchment (itself included).

    along: name to column summed over the pixels of the path that flow on. above: name to column summed over the
    catchment. longest: a name of `along` whose greatest sum over the catchment becomes `up_<name>`, from `start` (a column) on if given.
    Raises on a cycle.
    """
    state = flow.select("pix", F.col("down").alias("jump"), F.coalesce("down", "pix").alias("root"), F.col("down").isNotNull().cast("long").alias("hops"), *[F.when(F.col("down").isNotNull(), F.col(c)).otherwise(0).cast("long").alias(n) for n, c in along.items()], *[F.col(c).cast("long").alias(n) for n, c in above.items()], *([F.col(start).cast("long").alias(f"up_{longest}")] if start else []))
    up = f"up_{longest}" if longest else None
    if up and start is None:
        state = state.withColumn(up, F.lit(0).cast("long"))
    sums, tops = ["hops", *along], list(above)
    state = cut(state)
    rounds, most = 0, max(1, state.count()).bit_length() + 1
    while state.where("jump is not null").limit(1).count():
        if (rounds := rounds + 1) > most:
            raise ValueError("the flow has a cycle")
        arriving = state.where("jump is not null").groupBy(F.col("jump").alias("pix")).agg(*[F.sum(n).alias(f"a_{n}") for n in tops], *([F.max(F.col(up) + F.col(longest)).alias("a_up")] if up else []), F.count("*").alias("a_rows"))
        further = state.select(F.col("pix").alias("jump"), F.col("jump").alias("jump2"), F.col("root").alias("root2"), *[F.col(n).alias(f"b_{n}") for n in sums])
        both = state.join(further, "jump", "left").join(arriving, "pix", "left")
        state = cut(
            both.select(
                "pix", F.col("jump2").alias("jump"), F.coalesce("root2", "root").alias("root"),
                *[(F.col(n) + F.coalesce(f"b_{n}", F.lit(0))).alias(n) for n in sums],
                *[(F.col(n) + F.coalesce(f"a_{n}", F.lit(0))).alias(n) for n in tops],
                *([F.greatest(up, F.coalesce("a_up", F.lit(0))).alias(up)] if up else []),
            )
        )
    return state.drop("jump")


def main_donor(flow: DataFrame, size: str) -> DataFrame:
    """(down, pix): the donor of greatest size, ties by pixel."""
    best = F.row_number().over(Window.partitionBy("down").orderBy(F.desc(size), "pix"))
    return flow.where("down is not null").select("down", "pix", best.alias("k")).where("k = 1").drop("k")


def strahler(flow: DataFrame, most: int = 254, closure: Callable[..., DataFrame] = fold) -> DataFrame:
    """(pix, ord) over a network that is closed downstream: order k+1 is what lies below a pixel with two donors of order k."""
    tile = [c for c in ("tile", "down_tile") if c in flow.columns]
    order = flow.select("pix", "down", *tile, F.lit(1).cast("long").alias("ord"))
    for k in range(1, most):
        met = order.where(F.col("ord") >= k).where("down is not null").groupBy(F.col("down").alias("pix")).agg(F.count("*").alias("n")).where("n >= 2").select("pix", F.lit(1).alias("seed"))
        seeded = cut(order.join(met, "pix", "left").select("pix", "down", *tile, "ord", F.coalesce("seed", F.lit(0)).alias("seed")))
        if not seeded.where("seed = 1").limit(1).count():
            return order.select("pix", "ord")
        below = closure(seeded, {}, {"seeds": "seed"}).select("pix", "seeds")
        order = cut(seeded.join(below, "pix").select("pix", "down", *tile, F.when(F.col("seeds") > 0, k + 1).otherwise(F.col("ord")).cast("long").alias("ord")))
    raise ValueError("an order above the greatest one allowed")
