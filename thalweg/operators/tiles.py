"""The same folds as operators.flow, in two passes over tiles.

A pass moves every pixel once, to its tile, where numpy does the doubling; only the pixels at which paths leave a tile
take part in the rounds between. Memory is bounded by the tile's area, rounds and shuffles by its edges.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.operators import flow as forest
from thalweg.sources.shared import cut


def _within(at: np.ndarray, down: np.ndarray, sums: list[np.ndarray], tops: list[np.ndarray], up: np.ndarray | None, lead: int) -> np.ndarray:
    """Fold in place within one tile: sums run to the last pixel of the tile and include it. Returns the place of that pixel.

    at: pixels, rising. down: where each flows, -1 outside. up grows by sums[lead].
    """
    place = np.minimum(np.searchsorted(at, down), len(at) - 1)
    jump = np.where(at[place] == down, place, -1)
    root = np.where(jump >= 0, jump, np.arange(len(at)))
    for _ in range(len(at).bit_length() + 1):
        live = np.flatnonzero(jump >= 0)
        if not len(live):
            return root
        to = jump[live]
        if up is not None:
            far = up.copy()
            np.maximum.at(far, to, up[live] + sums[lead][live])
            up[:] = far
        for t in tops:
            more = np.zeros_like(t)
            np.add.at(more, to, t[live])
            t += more
        for s in sums:
            s[live] = s[live] + s[to]
        root[live], jump[live] = root[to], jump[to]
    raise ValueError("the flow has a cycle")


def fold(flow: DataFrame, along: dict[str, str], above: dict[str, str], longest: str | None = None) -> DataFrame:
    """operators.flow.fold of links that also have tile and down_tile (null where down is). Raises on a cycle, and where
    flow leaves the land."""
    sums, tops, up = ["hops", *along], list(above), [f"up_{longest}"] if longest else []
    lead = sums.index(longest) if longest else 0
    own = flow.select(
        "pix", "down", "tile", "down_tile", F.col("down").isNotNull().cast("long").alias("hops"),
        *[F.when(F.col("down").isNotNull(), F.col(c)).otherwise(0).cast("long").alias(n) for n, c in along.items()],
        *[F.col(c).cast("long").alias(n) for n, c in above.items()],
    )
    leaving = own.where("tile <> down_tile")
    inlets = leaving.select(F.col("down_tile").alias("tile"), F.col("down").alias("pix")).distinct()
    numbers = ", ".join(f"`{n}` long" for n in (*sums, *tops, *up))

    def run(px: pd.DataFrame, arriving: pd.DataFrame | None):
        px = px.sort_values("pix")
        at = px["pix"].to_numpy()
        down = px["down"].fillna(-1).to_numpy().astype(np.int64)
        # A copy each: the folds write in place.
        v, t = ([px[n].to_numpy(dtype=np.int64).copy() for n in names] for names in (sums, tops))
        u = np.zeros(len(at), np.int64) if up else None
        if arriving is not None and len(arriving):
            to = np.searchsorted(at, arriving["pix"].to_numpy())
            for n, x in zip(tops, t):
                np.add.at(x, to, arriving[n].to_numpy(dtype=np.int64))
            if up:
                np.maximum.at(u, to, arriving[up[0]].to_numpy(dtype=np.int64))
        last = [x.copy() for x in v]
        root = _within(at, down, v, t, u, lead)
        return px, at, v, t, u, last, root

    def edges(px: pd.DataFrame, doors: pd.DataFrame) -> pd.DataFrame:
        if not len(px):
            raise ValueError("flow leaves the land")
        px, at, v, t, u, last, root = run(px, None)
        ends = np.flatnonzero(root == np.arange(len(at)))
        node = {"kind": 0, "tile": px["tile"].iloc[0], "pix": at[ends], "down": px["down"].to_numpy()[ends], "down_tile": px["down_tile"].to_numpy()[ends]}
        node |= {n: x[ends] for n, x in zip(sums, last)} | {n: x[ends] for n, x in zip(tops, t)} | ({up[0]: u[ends]} if up else {})
        wanted = doors["pix"].to_numpy()
        i = np.minimum(np.searchsorted(at, wanted), len(at) - 1)
        if (at[i] != wanted).any():
            raise ValueError("flow leaves the land")
        door = {"kind": 1, "tile": px["tile"].iloc[0], "pix": wanted, "down": at[root[i]], "down_tile": px["tile"].iloc[0]}
        door |= {n: x[i] - y[root[i]] for n, x, y in zip(sums, v, last)} | dict.fromkeys((*tops, *up), 0)
        return pd.concat([pd.DataFrame(x).astype({"down": "Int64", "down_tile": "Int64"}) for x in (node, door)])

    found = cut(own.groupBy("tile").cogroup(inlets.groupBy("tile")).applyInPandas(edges, f"kind int, tile long, pix long, down long, down_tile long, {numbers}"))
    nodes, doors = found.where("kind = 0"), found.where("kind = 1")
    onward = doors.select(F.col("pix").alias("down"), F.col("down").alias("next"), *[F.col(n).alias(f"d_{n}") for n in sums])
    edge = nodes.join(onward, "down", "left").select("pix", F.col("next").alias("down"), *[(F.col(n) + F.coalesce(f"d_{n}", F.lit(0))).alias(f"e_{n}") for n in sums], *[F.col(n).alias(f"e_{n}") for n in (*tops, *up)])
    total = forest.fold(edge, {f"t_{n}": f"e_{n}" for n in sums}, {f"t_{n}": f"e_{n}" for n in tops}, f"t_{longest}" if longest else None, start=f"e_{up[0]}" if up else None)
    both = cut(nodes.select("pix", "tile", "down", "down_tile", *[F.col(sums[lead]).alias("step")]).join(total.drop("hops"), "pix"))
    of_node = both.select("tile", F.lit(0).alias("kind"), "pix", "root", *[F.col(f"t_{n}").alias(n) for n in sums], *[F.lit(0).cast("long").alias(n) for n in (*tops, *up)])
    come = both.where("down is not null").select(F.col("down_tile").alias("tile"), F.lit(1).alias("kind"), F.col("down").alias("pix"), "root", *[F.lit(0).cast("long").alias(n) for n in sums], *[F.col(f"t_{n}").alias(n) for n in tops], *([(F.col(f"up_t_{longest}") + F.col("step")).alias(up[0])] if up else []))

    def whole(px: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        px, at, v, t, u, last, root = run(px, known[known["kind"] == 1])
        node = known[known["kind"] == 0].sort_values("pix")
        k = np.searchsorted(node["pix"].to_numpy(), at[root])
        out = {"pix": at, "root": node["root"].to_numpy()[k]}
        out |= {n: x - y[root] + node[n].to_numpy()[k] for n, x, y in zip(sums, v, last)} | dict(zip(tops, t)) | ({up[0]: u} if up else {})
        return pd.DataFrame(out)

    return own.groupBy("tile").cogroup(of_node.unionByName(come).groupBy("tile")).applyInPandas(whole, f"pix long, root long, {numbers}")
