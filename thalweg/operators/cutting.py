"""Pfafstetter cutting of basins into pieces: every basin and piece of a level at once.

The main stem of a piece is what reaches its outlet over main donors alone, so a level is one fold of the flow that is
cut at the outlets known so far. What it keeps apart are tables of outlets, which do not grow with the pixels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thalweg.operators.flow import fold, main_donor
from thalweg.sources.shared import cut

TRIBUTARIES = 4


def _cut_at(flow: DataFrame, outlets: DataFrame) -> DataFrame:
    """flow whose links end at the outlets."""
    marked = flow.join(outlets.select("pix", F.lit(True).alias("ends")), "pix", "left")
    gone = [F.when(F.col("ends").isNull(), F.col(c)).alias(c) for c in ("down", "down_tile") if c in flow.columns]
    return marked.select(*[c for c in flow.columns if c not in ("down", "down_tile")], *gone)


def pieces(flow: DataFrame, outlets: DataFrame, levels: int, closure: Callable[..., DataFrame] = fold) -> DataFrame:
    """(root, code, pix) of the pieces of `levels` cuts; pix is a piece's outlet.

    flow: pix, row, col, down, up_count of the network that is walked (with tile and down_tile for tiles.fold).
    outlets: root, pix of the basins to cut. The four greatest tributaries (then the nearer to the outlet, then row and
    column) become 2, 4, 6, 8 in the order along the stem, its stretches 1, 3, 5, 7, 9; tributaries that meet share one
    confluence, with no stretch between. A stem without junctions gives one piece, which is its parent.
    """
    minor = flow.where("down is not null").select("pix").join(main_donor(flow, "up_count").select("pix"), "pix", "left_anti").select("pix", F.lit(1).alias("minor"))
    known = cut(flow.join(minor, "pix", "left").withColumn("minor", F.coalesce("minor", F.lit(0))))
    made = outlets.select("root", F.lit(0).cast("long").alias("code"), "pix")
    for _ in range(levels):
        made = cut(made)
        turned = closure(_cut_at(known, made), {"turns": "minor"}, {}).select("pix", F.col("root").alias("outlet"), "hops", "turns").where("turns <= 1")
        walked = cut(turned.join(made.select("root", "code", F.col("pix").alias("outlet")), "outlet").join(known.select("pix", "row", "col", "up_count", "minor"), "pix"))
        # Only pixels beside stems come here, and of each stem four go on.
        first = Window.partitionBy("outlet").orderBy(F.desc("up_count"), "hops", "row", "col")
        along = Window.partitionBy("outlet").orderBy("hops", F.desc("up_count"), "row", "col")
        four = walked.where("turns = 1 and minor = 1").withColumn("r", F.row_number().over(first)).where(F.col("r") <= TRIBUTARIES)
        chosen = cut(four.select("root", "code", "outlet", "pix", "hops", F.row_number().over(along).alias("k"), F.lead("hops").over(along).alias("next_hops")))
        ones = made.select("root", (F.col("code") * 10 + 1).alias("code"), "pix")
        evens = chosen.select("root", (F.col("code") * 10 + 2 * F.col("k")).alias("code"), "pix")
        above = chosen.where("next_hops is null or next_hops <> hops").select("outlet", "hops", "k")
        odds = walked.where("turns = 0").join(above, ["outlet", "hops"]).select("root", (F.col("code") * 10 + 2 * F.col("k") + 1).alias("code"), "pix")
        made = ones.unionByName(evens).unionByName(odds)
    return cut(made)


def labels(flow: DataFrame, made: DataFrame, closure: Callable[..., DataFrame] = fold) -> DataFrame:
    """(pix, root, code): the piece whose outlet a pixel's path meets first; pixels of basins that are not cut are left out."""
    met = closure(_cut_at(flow, made), {}, {}).select("pix", F.col("root").alias("outlet"))
    return met.join(made.select("root", "code", F.col("pix").alias("outlet")), "outlet").select("pix", "root", "code")


def table(made: DataFrame, labelled: DataFrame, flow: DataFrame) -> DataFrame:
    """(root, code, pix, next_code, expected, labelled): the piece below (null at the basin's outlet), the count at the
    outlet less those flowing in, and the pixels found; the two agree."""
    at = made.join(flow.select("pix", "down", "up_count"), "pix")
    below = at.join(labelled.select(F.col("pix").alias("down"), F.col("code").alias("next_code"), F.col("root").alias("next_root")), "down", "left")
    own = below.select("root", "code", "pix", "up_count", F.when(F.col("next_root") == F.col("root"), F.col("next_code")).alias("next_code"))
    into = own.where("next_code is not null").groupBy("root", F.col("next_code").alias("code")).agg(F.sum("up_count").alias("come"))
    found = labelled.groupBy("root", "code").agg(F.count("*").alias("labelled"))
    return own.join(into, ["root", "code"], "left").join(found, ["root", "code"], "left").select("root", "code", "pix", "next_code", (F.col("up_count") - F.coalesce("come", F.lit(0))).alias("expected"), F.coalesce("labelled", F.lit(0).cast("long")).alias("labelled"))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """root, code and next_code (-1: none) of some basins at a time, none of them cut, from rows by basin."""

    def columns(t: pa.Table) -> list[np.ndarray]:
        return [c.fill_null(-1).to_numpy() for c in t.columns]

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        root = b.column(0).to_numpy()
        last = int(np.searchsorted(root, root[-1]))
        if held and (last or held[-1].column(0)[-1].as_py() != root[0]):
            ready = pa.Table.from_batches([*held, b.slice(0, last)])
            held = []
            yield columns(ready)
            held.append(b.slice(last))
        elif last:
            yield columns(pa.Table.from_batches([b.slice(0, last)]))
            held.append(b.slice(last))
        else:
            held.append(b)
    if held:
        yield columns(pa.Table.from_batches(held))


def levels_of(pieces_table: DataFrame) -> DataFrame:
    """(root, code, level, number): 1 + the longest chain of pieces that flow in; numbers 1..n of a basin by (level, code).

    A basin has at most 9 ** levels pieces and its chains stay within it, so basins are dealt whole and numbered some
    at a time. A chain that never ends raises.
    """

    def levelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for root, code, below in _whole(batches):
            basin = np.cumsum(np.concatenate([[0], root[1:] != root[:-1]]))
            span = max(int(code.max()), int(below.max())) + 2
            key = basin * span + code
            to = np.searchsorted(key, basin * span + below)
            flows = (below >= 0) & (key[np.minimum(to, len(key) - 1)] == basin * span + below)
            level, live = np.ones(len(key), np.int64), np.flatnonzero(flows)
            for _ in range(len(key) + 1):  # those whose level rose pass it on
                if not len(live):
                    break
                before = level.copy()
                np.maximum.at(level, to[live], level[live] + 1)
                live = np.flatnonzero((level > before) & flows)
            else:
                raise ValueError("the pieces have a cycle")
            order = np.lexsort((code, level, basin))
            number = np.empty(len(key), np.int64)
            number[order] = np.arange(len(key)) - np.searchsorted(basin, basin) + 1  # order keeps each basin's places
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (root, code, level, number)], names=["root", "code", "level", "number"])

    own = pieces_table.select(*[F.col(c).cast("long") for c in ("root", "code", "next_code")])
    return own.repartition("root").sortWithinPartitions("root", "code").mapInArrow(levelled, "root long, code long, level long, number long")
