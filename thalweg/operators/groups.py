"""Which level-3 code small, doubtful basins take: from around them, or along the run of doubtful basins they are in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.operators.flow import fold
from thalweg.sources.shared import cut

#: Fixed value: pixels up to which a basin may be doubtful.
SMALL = 10000


def resolved(voted: DataFrame, boundary: DataFrame) -> DataFrame:
    """(basin_id, code, given): voted (basin_id, land, code or 0, votes) with doubtful basins' codes replaced.

    A basin of up to SMALL pixels with no code, or fewer than half its pixels for it, takes the code it shares the
    longest boundary with (ties: the smaller) among basins that are not doubtful. One that touches doubtful basins only
    follows the largest of them (ties: the smaller id) until one has a code. As each step leads to the largest neighbour,
    a run can only close between two basins that are each other's largest; there it ends in the larger one's own vote.
    boundary: (basin_id, neighbour_id, edges) both ways.
    """
    doubt = (F.col("land") <= SMALL) & ((F.col("code") == 0) | (F.col("votes") * 2 < F.col("land")))
    at = cut(voted.select("basin_id", "land", "code", doubt.alias("doubtful")))
    other = at.select(F.col("basin_id").alias("neighbour_id"), F.col("land").alias("n_land"), F.col("code").alias("n_code"), F.col("doubtful").alias("n_doubtful"))
    met = cut(boundary.join(at.where("doubtful").select("basin_id"), "basin_id").join(other, "neighbour_id"))
    shared = met.where("not n_doubtful and n_code > 0").groupBy("basin_id", "n_code").agg(F.sum("edges").alias("e"))
    best = shared.groupBy("basin_id").agg(F.min(F.struct((-F.col("e")).alias("less"), "n_code")).alias("s")).select("basin_id", F.col("s.n_code").alias("best"))
    link = met.where("n_doubtful").groupBy("basin_id").agg(F.min(F.struct((-F.col("n_land")).alias("less"), "neighbour_id")).alias("s")).select("basin_id", F.col("s.neighbour_id").alias("link"))
    known = cut(at.where("doubtful").join(best, "basin_id", "left").join(link, "basin_id", "left"))
    waits = known.where("best is null and link is not null")
    onward = known.select(F.col("basin_id").alias("link"), F.col("best").alias("l_best"), F.col("link").alias("back"), F.col("land").alias("l_land"))
    step = cut(waits.join(onward, "link"))
    closes = F.col("l_best").isNull() & (F.col("back") == F.col("basin_id")) & ((F.col("land") > F.col("l_land")) | ((F.col("land") == F.col("l_land")) & (F.col("basin_id") < F.col("link"))))
    ends = cut(step.select("basin_id", F.when(F.col("l_best").isNull() & ~closes, F.col("link")).alias("down"), F.when(closes, F.col("code")).otherwise(F.col("l_best")).alias("end_code")))
    roots = fold(ends.select(F.col("basin_id").alias("pix"), "down"), {}, {}).select(F.col("pix").alias("basin_id"), "root")
    ran = roots.join(ends.select(F.col("basin_id").alias("root"), F.col("end_code").alias("ran")), "root").select("basin_id", "ran")
    given = F.coalesce("best", F.when(F.col("ran") > 0, F.col("ran")))
    out = at.join(best, "basin_id", "left").join(ran, "basin_id", "left")
    return out.select("basin_id", F.coalesce(given, "code").cast("long").alias("code"), given.isNotNull().cast("int").alias("given"))


def faults(groups: DataFrame, basins: DataFrame) -> DataFrame:
    """(code, basins, land, found_basins, found_land) of groups (code, basins, land) that differ from their basins (code, land)."""
    found = basins.groupBy("code").agg(F.count("*").alias("found_basins"), F.sum("land").alias("found_land"))
    return groups.select("code", "basins", "land").join(found, "code", "full").where("not (basins <=> found_basins) or not (land <=> found_land)")


def region_of_basin(basins: DataFrame, regions: DataFrame, outlet_pieces: DataFrame) -> DataFrame:
    """(basin_id, region): the map's region, or where that is 0 or missing the one of the piece at the basin's outlet."""
    joined = basins.select("basin_id").join(regions.select("basin_id", F.col("region").alias("m")), "basin_id", "left").join(outlet_pieces.select("basin_id", F.col("region").alias("p")), "basin_id", "left")
    return joined.select("basin_id", F.coalesce(F.when(F.col("m") != 0, F.col("m")), "p").alias("region"))
