"""Tables, masks, views and joins of groups and regions, and the checks on their rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Kinds of a group.
ONE_BASIN, MANY = 1, 2
# Published ids of islands start here, 100 for each unit of level 1.
ISLANDS, PER_UNIT = 20000, 100


def row_faults(table: DataFrame, key: str, rules: Sequence[Column]) -> DataFrame:
    """(key, fault): of each row the places, from 1, of the rules that do not hold; a null counts as broken."""
    broken = F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(None).cast("int")).otherwise(k) for k, rule in enumerate(rules, 1)])
    return table.select(key, F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("fault"))


def with_row_before(basins: DataFrame) -> DataFrame:
    """basins with before_id, before_area and before_count of the row whose id is one less: a join, not a window over all rows."""
    before = basins.select((F.col("basin_id") + 1).alias("basin_id"), F.col("basin_id").alias("before_id"), F.round("basin_area_km2", 6).alias("before_area"), F.col("basin_grid_count").alias("before_count"))
    return basins.join(before, "basin_id", "left")


def basin_rules() -> list[Column]:
    """What each row of with_row_before(basin table) must be: ids without a gap, outlet, flag and counts, order, box, box sizes."""
    c = F.col
    area = c("basin_area_km2")
    unset = (c("basin_row_min") == -1) & (c("basin_row_max") == -1) & (c("basin_col_min") == -1) & (c("basin_col_max") == -1)
    around = (c("basin_row_min") >= 0) & (c("basin_col_min") >= 0) & (c("basin_row_max") > c("basin_row_min")) & (c("basin_col_max") > c("basin_col_min")) & (c("outlet_row") >= c("basin_row_min")) & (c("outlet_row") < c("basin_row_max"))
    size = lambda lo, hi: F.when(c("basin_row_min") >= 0, c(hi) - c(lo)).otherwise(0)
    return [
        (c("basin_id") == 1) | c("before_id").isNotNull(),
        (c("outlet_row") >= 0) & (c("outlet_col") >= 0) & c("outlet_flag").isin(0, 1) & (c("basin_grid_count") >= 1) & ((area > 0) | (area == -1)),
        F.when(c("before_id").isNull(), True).when((area == -1) != (c("before_area") == -1), False).when(area == -1, c("basin_grid_count") <= c("before_count")).otherwise(F.round(area, 6) <= c("before_area")),
        unset | around,
        (c("basin_nrow") == size("basin_row_min", "basin_row_max")) & (c("basin_ncol") == size("basin_col_min", "basin_col_max")),
    ]


def group_rules() -> list[Column]:
    c = F.col
    return [
        c("group_id") > 0,
        c("group_level").between(0, 3) & c("group_kind").between(1, 4) & (c("level_code") >= 0),
        (c("basin_count") > 0) & (c("land_grid_count") > 0),
        (c("window_row_min") >= 0) & (c("window_col_min") >= 0) & (c("window_row_max") > c("window_row_min")) & (c("window_col_max") > c("window_col_min")),
        c("window_grid_count") == c("window_nrow") * c("window_ncol"),
    ]


def region_rules() -> list[Column]:
    c = F.col
    return [c("region_id") > 0, (c("row_max") > c("row_min")) & (c("col_max") > c("col_min")), (c("nrow") == c("row_max") - c("row_min")) & (c("ncol") == c("col_max") - c("col_min"))]


def place_in(unit: str, *by: Column) -> Column:
    """1.. within the unit; 0 where the unit is unset (0). A unit's rows meet in one window."""
    return F.when(F.col(unit) != 0, F.row_number().over(Window.partitionBy(unit).orderBy(*by))).otherwise(0).cast("long")


def group_table(members: DataFrame, block: int, north: float, west: float, size: float) -> DataFrame:
    """The groups of levels 3, 2 and 1 with windows in whole blocks.

    members: basin_id, code (level 3), given (1 where neighbours gave it), grid_count, and right-open boxes.
    """
    levels = F.inline(F.array(*[F.struct(F.lit(n).alias("group_level"), F.lit(d).alias("by")) for n, d in ((3, 1), (2, 10), (1, 100))]))
    at = members.select("*", levels).withColumn("group_id", F.expr("code div by"))
    low, high = (lambda x: F.expr(f"{x} div {block}")), (lambda x: F.expr(f"({x} - 1) div {block} + 1"))
    g = at.groupBy("group_level", "group_id").agg(
        F.countDistinct("code").alias("level3_count"),
        F.count("*").alias("basin_count"),
        F.sum("given").alias("neighbour_basin_count"),
        F.sum("grid_count").alias("land_grid_count"),
        F.min(low("row_min")).alias("window_row_min"),
        F.max(high("row_max")).alias("window_row_max"),
        F.min(low("col_min")).alias("window_col_min"),
        F.max(high("col_max")).alias("window_col_max"),
    )
    coded = F.col("basin_count") - F.col("neighbour_basin_count")
    rows, cols = ((F.col(f"window_{x}_max") - F.col(f"window_{x}_min")) * block for x in ("row", "col"))
    g = g.select("*", coded.alias("coded_basin_count"), F.when((F.col("group_level") == 3) & (coded == 1), ONE_BASIN).otherwise(MANY).alias("group_kind"), F.col("group_id").alias("level_code"), rows.alias("window_nrow"), cols.alias("window_ncol"))
    g = g.withColumn("window_grid_count", F.col("window_nrow") * F.col("window_ncol"))
    edge = lambda x: F.col(f"window_{x}") * block * size
    return g.select(
        "*",
        (F.lit(100.0) * F.col("land_grid_count") / F.col("window_grid_count")).alias("fill_percent"),
        (west + edge("col_min")).alias("window_minlon"),
        (west + edge("col_max")).alias("window_maxlon"),
        (north - edge("row_max")).alias("window_minlat"),
        (north - edge("row_min")).alias("window_maxlat"),
    )


def cell_owner(entries: DataFrame) -> DataFrame:
    """(crow, ccol, owner): the group with the most land of each cell, ties by id. entries: crow, ccol, grp, land."""
    land = entries.groupBy("crow", "ccol", "grp").agg(F.sum("land").alias("land")).where("land > 0")
    return land.groupBy("crow", "ccol").agg(F.min(F.struct((-F.col("land")).alias("less"), "grp")).alias("s")).select("crow", "ccol", F.col("s.grp").alias("owner"))


def touching(entries: DataFrame) -> DataFrame:
    """(a, b), a < b: groups that share a cell or hold cells beside one another, corners included."""
    at = entries.select("crow", "ccol", "grp").distinct()
    ahead = F.inline(F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))]))
    moved = at.select("*", ahead).select((F.col("crow") + F.col("dr")).alias("crow"), (F.col("ccol") + F.col("dc")).alias("ccol"), F.col("grp").alias("x"))
    met = moved.join(at, ["crow", "ccol"]).where("x <> grp")
    return met.select(F.least("x", "grp").alias("a"), F.greatest("x", "grp").alias("b")).distinct()


def enclosed(owners: DataFrame) -> DataFrame:
    """(inside, around): groups all of whose cells have, all round, cells of their own or of one other group only."""
    ring = F.inline(F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r in (-1, 0, 1) for c in (-1, 0, 1) if r or c]))
    asked = owners.select(F.col("owner").alias("inside"), "crow", "ccol", ring).select("inside", (F.col("crow") + F.col("dr")).alias("crow"), (F.col("ccol") + F.col("dc")).alias("ccol"))
    seen = asked.join(owners, ["crow", "ccol"], "left").groupBy("inside")
    other = F.when(F.col("owner") != F.col("inside"), F.col("owner"))
    n = seen.agg(F.sum(F.col("owner").isNull().cast("int")).alias("open"), F.min(other).alias("around"), F.max(other).alias("last"))
    return n.where("open = 0 and around = last").select("inside", "around")


def cheapest_join(windows: DataFrame, pairs: DataFrame, held: DataFrame, capacity: int) -> DataFrame:
    """(first, second, extra): the pair whose joined window has the fewest blocks more than the two apart; ties by ids.

    Two may join that touch, if the joined window fits, or of which one encloses the other, window and cells, whatever
    the capacity. windows: grp, row_min, row_max, col_min, col_max in blocks; pairs: a, b; held: inside, around.
    """
    box = ("row_min", "row_max", "col_min", "col_max")
    side = lambda s: windows.select(F.col("grp").alias(s), *[F.col(x).alias(f"{s}_{x}") for x in box])
    both = pairs.select("a", "b", F.lit(0).alias("inside")).unionByName(held.select(F.least("inside", "around").alias("a"), F.greatest("inside", "around").alias("b"), "inside"))
    both = both.groupBy("a", "b").agg(F.max((F.col("inside") == F.col("a")).cast("int")).alias("a_in"), F.max((F.col("inside") == F.col("b")).cast("int")).alias("b_in"), F.max((F.col("inside") == 0).cast("int")).alias("touch"))
    w = both.join(side("a"), "a").join(side("b"), "b")
    c = F.col
    holds = lambda s, t: (c(f"{s}_row_min") <= c(f"{t}_row_min")) & (c(f"{s}_row_max") >= c(f"{t}_row_max")) & (c(f"{s}_col_min") <= c(f"{t}_col_min")) & (c(f"{s}_col_max") >= c(f"{t}_col_max"))
    blocks = lambda s: (c(f"{s}_row_max") - c(f"{s}_row_min")) * (c(f"{s}_col_max") - c(f"{s}_col_min"))
    joined = (F.greatest("a_row_max", "b_row_max") - F.least("a_row_min", "b_row_min")) * (F.greatest("a_col_max", "b_col_max") - F.least("a_col_min", "b_col_min"))
    nested = ((c("b_in") == 1) & holds("a", "b")) | ((c("a_in") == 1) & holds("b", "a"))
    may = w.where(nested | ((c("touch") == 1) & (joined <= capacity)))
    return may.select(F.struct((joined - blocks("a") - blocks("b")).alias("extra"), c("a").alias("first"), c("b").alias("second")).alias("s")).agg(F.min("s").alias("s")).where("s is not null").select("s.first", "s.second", "s.extra")


def best_lines(members: DataFrame, block: int) -> DataFrame:
    """(grp, axis, line, larger, uneven): of each set the block line that leaves the smallest larger window.

    members: grp, land and right-open boxes. A member goes to the side that holds its box's middle. axis 0 cuts between
    rows, 1 between columns; line is the first block past it. Ties: the more even land, then axis and line. Running
    extrema go over block lines, of which the grid has a bounded number, not over members.
    """
    low, high = (lambda x: F.expr(f"{x} div {block}")), (lambda x: F.expr(f"({x} - 1) div {block} + 1"))
    mid = lambda x: F.expr(f"(({x}_min + {x}_max - 1) div 2) div {block}")
    axes = F.inline(F.array(F.struct(F.lit(0).alias("axis"), mid("row").alias("at")), F.struct(F.lit(1).alias("axis"), mid("col").alias("at"))))
    boxed = members.select("grp", "land", low("row_min").alias("r0"), high("row_max").alias("r1"), low("col_min").alias("c0"), high("col_max").alias("c1"), axes)
    by_line = boxed.groupBy("grp", "axis", "at").agg(F.sum("land").alias("land"), F.min("r0").alias("r0"), F.max("r1").alias("r1"), F.min("c0").alias("c0"), F.max("c1").alias("c1"))
    order = Window.partitionBy("grp", "axis").orderBy("at")
    up_to, past = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(1, Window.unboundedFollowing)
    area = lambda w: (F.max("r1").over(w) - F.min("r0").over(w)) * (F.max("c1").over(w) - F.min("c0").over(w))
    cuts = by_line.select("grp", "axis", (F.col("at") + 1).alias("line"), area(up_to).alias("one"), area(past).alias("two"), F.abs(F.sum("land").over(up_to) - F.sum("land").over(past)).alias("uneven")).where("two is not null")
    return cuts.groupBy("grp").agg(F.min(F.struct(F.greatest("one", "two").alias("larger"), "uneven", "axis", "line")).alias("s")).select("grp", "s.axis", "s.line", "s.larger", "s.uneven")


def fold_objects(pixels: DataFrame, view: DataFrame, factor: int) -> DataFrame:
    """(crow, ccol, object): the view of regions that follows the view of basins (crow, ccol, basin_id).

    A cell with a basin takes the object with the most of that basin's pixels there; another cell takes the object with
    the most of its pixels, if a quarter of the cell lies in objects. Ties: the smaller id. pixels: row, col, basin_id,
    object (0 or null: none). A cell whose basin has no pixel in any object there is left out.
    """
    n = pixels.groupBy(F.floor(F.col("row") / factor).alias("crow"), F.floor(F.col("col") / factor).alias("ccol"), "basin_id", "object").agg(F.count("*").alias("n"))
    kept = n.where("object <> 0").join(view.select("crow", "ccol", F.col("basin_id").alias("shown")), ["crow", "ccol"], "left")
    of = kept.where("shown is null or shown = basin_id").groupBy("crow", "ccol", "object").agg(F.sum("n").alias("n"), F.max("shown").alias("shown"))
    cells = of.groupBy("crow", "ccol").agg(F.sum("n").alias("land"), F.max("shown").alias("shown"), F.min(F.struct((-F.col("n")).alias("less"), "object")).alias("s"))
    return cells.where((F.col("shown").isNotNull()) | (F.col("land") * 4 >= factor * factor)).select("crow", "ccol", F.col("s.object").alias("object"))


def mask(pixels: DataFrame, cut_basins: DataFrame, regions: DataFrame, pieces: DataFrame) -> DataFrame:
    """(pix, region, status): pieces laid over basins.

    pixels: pix, basin_id, piece (0: none); cut_basins: basin_id; regions: basin_id, region; pieces: basin_id, piece,
    region. A cut basin's pixel takes its piece's region, another its basin's. status 1: a pixel of a cut basin without
    a piece; 2: a piece in a basin that is not cut; 3: a piece or basin of no region. The region is then 0.
    """
    at = pixels.join(cut_basins.select("basin_id", F.lit(1).alias("is_cut")), "basin_id", "left")
    at = at.join(regions.select("basin_id", F.col("region").alias("whole")), "basin_id", "left").join(pieces.select("basin_id", "piece", F.col("region").alias("part")), ["basin_id", "piece"], "left")
    is_cut, none = F.col("is_cut").isNotNull(), F.coalesce(F.col("piece"), F.lit(0)) == 0
    found = F.coalesce(F.when(is_cut, F.col("part")).otherwise(F.col("whole")), F.lit(0))
    status = F.when(is_cut & none, 1).when(~is_cut & ~none, 2).when(found == 0, 3).otherwise(0)
    return at.select("pix", F.when(status == 0, found).otherwise(0).cast("long").alias("region"), status.alias("status"))


def region_table(pixels: DataFrame, block: int, north: float, west: float, size: float) -> DataFrame:
    """Regions' pixels, boxes, block windows, fill and counts. pixels: region, basin_id, piece (0: none), row, col."""
    # Counted by basin and piece first, so that a region that holds most pixels is one group of few rows.
    part = pixels.groupBy("region", "basin_id", "piece").agg(F.count("*").alias("n"), F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    own = part.groupBy(F.col("region").alias("region_id")).agg(F.sum("n").alias("region_grid_count"), F.countDistinct("basin_id").alias("basin_count"), F.sum((F.col("piece") != 0).cast("int")).alias("piece_count"), F.min("r0").alias("bbox_row_min"), (F.max("r1") + 1).alias("bbox_row_max"), F.min("c0").alias("bbox_col_min"), (F.max("c1") + 1).alias("bbox_col_max"))
    edges = {f"{x}_{e}": F.expr(f"bbox_{x}_min div {block} * {block}" if e == "min" else f"((bbox_{x}_max - 1) div {block} + 1) * {block}") for x in ("row", "col") for e in ("min", "max")}
    t = own.select("*", *[v.alias(k) for k, v in edges.items()]).select("*", (F.col("row_max") - F.col("row_min")).alias("nrow"), (F.col("col_max") - F.col("col_min")).alias("ncol"))
    t = t.withColumn("window_grid_count", F.col("nrow") * F.col("ncol")).withColumn("fill_percent", F.lit(100.0) * F.col("region_grid_count") / F.col("window_grid_count"))
    return t.select("*", (west + F.col("col_min") * size).alias("minlon"), (west + F.col("col_max") * size).alias("maxlon"), (north - F.col("row_max") * size).alias("minlat"), (north - F.col("row_min") * size).alias("maxlat"))


def own_area(pieces: DataFrame) -> DataFrame:
    """(root, code, own_area): the area above a piece's outlet less that above the outlets that flow into it. pieces: root, code, next_code, up_area."""
    come = pieces.where("next_code is not null").groupBy("root", F.col("next_code").alias("code")).agg(F.sum("up_area").alias("come"))
    return pieces.join(come, ["root", "code"], "left").select("root", "code", (F.col("up_area") - F.coalesce("come", F.lit(0))).alias("own_area"))


def cut_faults(cuts: DataFrame, labels: DataFrame, steps: dict[int, tuple[int, int]]) -> DataFrame:
    """(root, code, fault): 1, the outlet's direction does not lead to the parent's inlet; 2, the inlet is no pixel of the parent.

    cuts: root, code, direction, outlet_row, outlet_col, inlet_row, inlet_col, parent; labels: row, col, root, code.
    """
    step = lambda i: F.coalesce(*[F.when(F.col("direction") == d, s[i]) for d, s in steps.items()])
    leads = (F.col("outlet_row") + step(0) == F.col("inlet_row")) & (F.col("outlet_col") + step(1) == F.col("inlet_col"))
    there = labels.select(F.col("row").alias("inlet_row"), F.col("col").alias("inlet_col"), F.col("root").alias("l_root"), F.col("code").alias("l_code"))
    met = cuts.join(there, ["inlet_row", "inlet_col"], "left")
    belongs = (F.col("l_root") == F.col("root")) & (F.col("l_code") == F.col("parent"))
    fault = F.when(~F.coalesce(leads, F.lit(False)), 1).when(~F.coalesce(belongs, F.lit(False)), 2)
    return met.select("root", "code", fault.alias("fault")).where("fault is not null")


def seam_gaps(pixels: DataFrame, cols: int) -> DataFrame:
    """(basin_id, first_col, gap): on a periodic grid each object's widest run of empty columns and the column after it; ties: the smaller column."""
    held = pixels.select("basin_id", "col").distinct()
    order = Window.partitionBy("basin_id").orderBy("col")
    before = F.coalesce(F.lag("col").over(order), F.max("col").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - cols)
    gaps = held.select("basin_id", "col", (F.col("col") - before - 1).alias("gap"))
    return gaps.groupBy("basin_id").agg(F.min(F.struct((-F.col("gap")).alias("less"), "col")).alias("s")).select("basin_id", F.col("s.col").alias("first_col"), (-F.col("s.less")).alias("gap"))


def island_ids(islands: DataFrame) -> DataFrame:
    """(region, published): islands numbered within their unit of level 1, most land first, then build id.

    islands: region (build id), level1, land. Where any unit holds PER_UNIT islands or more, all keep their build ids.
    """
    n = islands.select("region", "level1", F.row_number().over(Window.partitionBy("level1").orderBy(F.desc("land"), "region")).alias("n"))
    most = islands.groupBy("level1").count().agg(F.max("count").alias("most"))
    # One row.
    return n.join(F.broadcast(most)).select("region", F.when(F.col("most") < PER_UNIT, ISLANDS + F.col("level1") * PER_UNIT + F.col("n")).otherwise(F.col("region")).cast("long").alias("published"))
