"""Queries of the tables, masks, views and joins of groups and regions over the test grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.functions import earth
from thalweg.operators import basins, regions
from thalweg.operators.order import numbered
from thalweg.plans import cutting, grid, registry
from thalweg.plans.registry import query

BLOCK, FACTOR, CAPACITY, NORTH, WEST, SIZE = 8, 5, 60, 60.0, -180.0, 0.5
# The D8 codes with their row and column steps.
STEPS = {1: (0, 1), 2: (1, 1), 4: (1, 0), 8: (1, -1), 16: (0, -1), 32: (-1, -1), 64: (-1, 0), 128: (-1, 1)}
_V = "(SELECT basin_id, code FROM votes WHERE k = 1)"


@grid.product
def _basin_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = grid.attributes(spark, sf_dir)
    boxes = basins.ranked(a).drop("basin_id")
    out = a.where("pix = root").select(F.col("root").alias("outlet_pix"), "row", "col", "code", "up_area")
    t = numbered(boxes.join(out, "outlet_pix"), "basin_id", F.desc("up_area"), F.desc("grid_count"), F.asc("outlet_pix"))
    voted = basins.vote(grid.labelled(spark, sf_dir).join(t.select("basin_id", F.col("outlet_pix").alias("root")).withColumnRenamed("basin_id", "id"), "root").select(F.col("id").alias("basin_id"), F.col("code")))
    t = t.withColumnRenamed("code", "direction").join(voted.select("basin_id", "code"), "basin_id", "left").fillna(0, ["code"])
    lat, lon = earth.centre(F.col("row"), F.col("col"), NORTH, WEST, SIZE, grid.COLS)
    north, south, west, east = earth.box(*[F.col(c) for c in ("row_min", "row_max", "col_min", "col_max")], NORTH, WEST, SIZE)
    t = t.select(
        "basin_id", F.col("basin_id").alias("global_basin_id"), F.expr("code div 100").alias("level1_id"), F.expr("code div 10").alias("level2_id"), F.col("code").alias("level3_id"), F.expr("code div 10 * 100 + code % 10").alias("region_id"),
        F.col("row").alias("outlet_row"), F.col("col").alias("outlet_col"), lon.alias("outlet_lon"), lat.alias("outlet_lat"), (F.col("direction") == 255).cast("int").alias("outlet_flag"),
        F.col("grid_count").alias("basin_grid_count"), (F.col("up_area") / 1e6).alias("basin_area_km2"),
        *[F.col(f"{x}_{e}").alias(f"basin_{x}_{e}") for x in ("row", "col") for e in ("min", "max")], (F.col("row_max") - F.col("row_min")).alias("basin_nrow"), (F.col("col_max") - F.col("col_min")).alias("basin_ncol"),
        west.alias("bbox_minlon"), south.alias("bbox_minlat"), east.alias("bbox_maxlon"), north.alias("bbox_maxlat"),
    )
    for unit, place in (("level1_id", "basin_id_in_level1"), ("level2_id", "basin_id_in_level2"), ("level3_id", "basin_id_in_level3"), ("region_id", "basin_id_in_region")):
        t = t.withColumn(place, regions.place_in(unit, F.asc("basin_id")))
    return registry.flow.cut(t)


_BASINS = f""", sized AS (SELECT row_number() OVER (ORDER BY up_area DESC, grid_count DESC, ranked.root) AS basin_id, ranked.root, flow."row", flow.col, flow.code AS direction, grid_count, up_area, row_min, row_max, col_min, col_max, coalesce(v.code, 0) AS code
        FROM ranked JOIN flow ON flow.pix = ranked.root JOIN up ON up.pix = ranked.root LEFT JOIN {_V} v ON v.basin_id = ranked.basin_id),
    bt AS MATERIALIZED (SELECT basin_id, basin_id AS global_basin_id, code // 100 AS level1_id, code // 10 AS level2_id, code AS level3_id, code // 10 * 100 + code % 10 AS region_id, "row" AS outlet_row, col AS outlet_col, -180 + (col + 0.5::DOUBLE) * 0.5::DOUBLE AS outlet_lon, 60 - ("row" + 0.5::DOUBLE) * 0.5::DOUBLE AS outlet_lat,
        CAST(direction = 255 AS INTEGER) AS outlet_flag, grid_count AS basin_grid_count, up_area / 1e6::DOUBLE AS basin_area_km2, row_min AS basin_row_min, row_max AS basin_row_max, col_min AS basin_col_min, col_max AS basin_col_max, row_max - row_min AS basin_nrow, col_max - col_min AS basin_ncol,
        -180 + col_min * 0.5::DOUBLE AS bbox_minlon, 60 - row_max * 0.5::DOUBLE AS bbox_minlat, -180 + col_max * 0.5::DOUBLE AS bbox_maxlon, 60 - row_min * 0.5::DOUBLE AS bbox_maxlat,
        CASE WHEN code // 100 <> 0 THEN row_number() OVER (PARTITION BY code // 100 ORDER BY basin_id) ELSE 0 END AS basin_id_in_level1, CASE WHEN code // 10 <> 0 THEN row_number() OVER (PARTITION BY code // 10 ORDER BY basin_id) ELSE 0 END AS basin_id_in_level2,
        CASE WHEN code <> 0 THEN row_number() OVER (PARTITION BY code ORDER BY basin_id) ELSE 0 END AS basin_id_in_level3, CASE WHEN code // 10 * 100 + code % 10 <> 0 THEN row_number() OVER (PARTITION BY code // 10 * 100 + code % 10 ORDER BY basin_id) ELSE 0 END AS basin_id_in_region FROM sized)"""


@query(grid.ORACLE + _BASINS + " SELECT * FROM bt")
def basin_table(spark, sf_dir):
    return _basin_table(spark, sf_dir)


@query(grid.ORACLE + _BASINS + """, bad AS MATERIALIZED (SELECT basin_id, basin_id % 7 = 0 AS b7, basin_id % 11 = 0 AS b11, basin_id % 13 = 0 AS b13, basin_id % 17 = 0 AS b17, basin_id % 19 = 0 AS b19 FROM bt)
    SELECT basin_id, 1 AS fault FROM bad WHERE NOT b19 AND basin_id > 1 AND (basin_id - 1) % 19 = 0 UNION ALL SELECT basin_id, 2 FROM bad WHERE NOT b19 AND b13
    UNION ALL SELECT basin_id, 3 FROM bad JOIN bt USING (basin_id) JOIN (SELECT basin_id + 1 AS basin_id, basin_area_km2 AS p, basin_id % 13 = 0 AS p13, basin_id % 17 = 0 AS p17 FROM bt WHERE basin_id % 19 <> 0) USING (basin_id)
        WHERE NOT b19 AND round(CASE WHEN b13 THEN -0.5 WHEN b17 THEN basin_area_km2 + 1000 ELSE basin_area_km2 END, 6) > round(CASE WHEN p13 THEN -0.5 WHEN p17 THEN p + 1000 ELSE p END, 6)
    UNION ALL SELECT basin_id, 4 FROM bad WHERE NOT b19 AND b11 UNION ALL SELECT basin_id, 5 FROM bad WHERE NOT b19 AND (b7 <> b11 OR (b7 AND b11))""")
def basin_table_faults(spark, sf_dir):
    """The table's rules over a copy with rows missing, sizes, boxes, areas and the order damaged."""
    every = lambda n: F.col("basin_id") % n == 0
    bad = _basin_table(spark, sf_dir).where("basin_id % 19 <> 0")
    bad = bad.withColumn("basin_nrow", F.when(every(7), F.col("basin_nrow") + 1).otherwise(F.col("basin_nrow"))).withColumn("basin_row_max", F.when(every(11), F.col("basin_row_min")).otherwise(F.col("basin_row_max")))
    bad = bad.withColumn("basin_area_km2", F.when(every(13), -0.5).when(every(17), F.col("basin_area_km2") + 1000).otherwise(F.col("basin_area_km2")))
    return regions.row_faults(regions.with_row_before(bad), "basin_id", regions.basin_rules())


@query(grid.ORACLE + _BASINS + " SELECT basin_id, row_number() OVER (ORDER BY basin_area_km2 DESC, basin_grid_count DESC, basin_id) AS place FROM bt WHERE level3_id % 2 = 0")
def seeds_in_order(spark, sf_dir):
    free = _basin_table(spark, sf_dir).where("level3_id % 2 = 0").select("basin_id", "basin_area_km2", "basin_grid_count")
    return numbered(free, "place", F.desc("basin_area_km2"), F.desc("basin_grid_count"), F.asc("basin_id")).select("basin_id", "place")


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry._grouped(spark, sf_dir).withColumn("given", (F.col("basin_id") % 3 == 0).cast("int"))


@query(f"""SELECT *, 100.0::DOUBLE * land_grid_count / window_grid_count AS fill_percent, -180 + window_col_min * {BLOCK} * 0.5::DOUBLE AS window_minlon, -180 + window_col_max * {BLOCK} * 0.5::DOUBLE AS window_maxlon, 60 - window_row_max * {BLOCK} * 0.5::DOUBLE AS window_minlat, 60 - window_row_min * {BLOCK} * 0.5::DOUBLE AS window_maxlat FROM (
    SELECT *, (window_row_max - window_row_min) * {BLOCK} * (window_col_max - window_col_min) * {BLOCK} AS window_grid_count, (window_row_max - window_row_min) * {BLOCK} AS window_nrow, (window_col_max - window_col_min) * {BLOCK} AS window_ncol, basin_count - neighbour_basin_count AS coded_basin_count, group_id AS level_code,
    CASE WHEN group_level = 3 AND basin_count - neighbour_basin_count = 1 THEN 1 ELSE 2 END AS group_kind FROM (SELECT n AS group_level, code // d AS group_id, count(DISTINCT code) AS level3_count, count(*) AS basin_count, CAST(sum(CAST(basin_id % 3 = 0 AS INTEGER)) AS BIGINT) AS neighbour_basin_count, CAST(sum(grid_count) AS BIGINT) AS land_grid_count,
    min(row_min // {BLOCK}) AS window_row_min, max((row_max - 1) // {BLOCK} + 1) AS window_row_max, min(col_min // {BLOCK}) AS window_col_min, max((col_max - 1) // {BLOCK} + 1) AS window_col_max FROM ranked JOIN {_V} USING (basin_id) CROSS JOIN (VALUES (3, 1), (2, 10), (1, 100)) l(n, d) GROUP BY n, code // d))""")
def group_table(spark, sf_dir):
    return regions.group_table(_members(spark, sf_dir), BLOCK, NORTH, WEST, SIZE)


# Entries: cells of ten pixels and the level-2 groups of the pixels in them.
_ENTRIES = """, en AS MATERIALIZED (SELECT "row" // 10 AS crow, col // 10 AS ccol, code // 10 AS grp, count(*) AS land FROM lab WHERE code > 0 GROUP BY ALL),
    owners AS MATERIALIZED (SELECT crow, ccol, grp AS owner FROM (SELECT *, row_number() OVER (PARTITION BY crow, ccol ORDER BY land DESC, grp) AS k FROM en) WHERE k = 1),
    pairs AS MATERIALIZED (SELECT DISTINCT least(x.grp, y.grp) AS a, greatest(x.grp, y.grp) AS b FROM en x JOIN en y ON abs(x.crow - y.crow) <= 1 AND abs(x.ccol - y.ccol) <= 1 AND x.grp <> y.grp)"""
_WINDOWS = f""", win AS MATERIALIZED (SELECT code // 10 AS grp, min("row") // {BLOCK} AS r0, max("row") // {BLOCK} + 1 AS r1, min(col) // {BLOCK} AS c0, max(col) // {BLOCK} + 1 AS c1 FROM lab WHERE code > 0 GROUP BY code // 10)"""


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = grid.labelled(spark, sf_dir).where("code > 0")
    return at.groupBy(F.expr("row div 10").alias("crow"), F.expr("col div 10").alias("ccol"), F.expr("code div 10").alias("grp")).agg(F.count("*").alias("land"))


@query(grid.ORACLE + _ENTRIES + " SELECT a, b FROM pairs")
def group_adjacency(spark, sf_dir):
    return regions.touching(_entries(spark, sf_dir))


@query(grid.ORACLE + _ENTRIES + " SELECT crow, ccol, owner FROM owners")
def cell_owners(spark, sf_dir):
    return regions.cell_owner(_entries(spark, sf_dir))


@query(grid.ORACLE + _ENTRIES + _WINDOWS + f""", ok AS (SELECT a, b, x.r0 AS ar0, x.r1 AS ar1, x.c0 AS ac0, x.c1 AS ac1, y.r0 AS br0, y.r1 AS br1, y.c0 AS bc0, y.c1 AS bc1 FROM pairs JOIN win x ON x.grp = a JOIN win y ON y.grp = b)
    SELECT a AS first, b AS second, j - p - q AS extra FROM (SELECT a, b, (greatest(ar1, br1) - least(ar0, br0)) * (greatest(ac1, bc1) - least(ac0, bc0)) AS j, (ar1 - ar0) * (ac1 - ac0) AS p, (br1 - br0) * (bc1 - bc0) AS q FROM ok) WHERE j <= {CAPACITY} ORDER BY j - p - q, a, b LIMIT 1""")
def cheapest_join(spark, sf_dir):
    """Groups of the grid span its width, and none encloses another; enclosed ones are tested on a fixture."""
    at, entries = grid.labelled(spark, sf_dir).where("code > 0"), _entries(spark, sf_dir)
    low, high = (lambda x: F.expr(f"min({x}) div {BLOCK}")), (lambda x: F.expr(f"max({x}) div {BLOCK} + 1"))
    windows = at.groupBy(F.expr("code div 10").alias("grp")).agg(low("row").alias("row_min"), high("row").alias("row_max"), low("col").alias("col_min"), high("col").alias("col_max"))
    return regions.cheapest_join(windows, regions.touching(entries), regions.enclosed(regions.cell_owner(entries)), CAPACITY)


@query(grid.ORACLE + f""", m AS (SELECT code // 100 AS grp, grid_count AS land, row_min // {BLOCK} AS r0, (row_max - 1) // {BLOCK} + 1 AS r1, col_min // {BLOCK} AS c0, (col_max - 1) // {BLOCK} + 1 AS c1, ((row_min + row_max - 1) // 2) // {BLOCK} AS rm, ((col_min + col_max - 1) // 2) // {BLOCK} AS cm FROM ranked JOIN {_V} USING (basin_id)),
    l AS (SELECT *, 0 AS axis, rm AS spot FROM m UNION ALL SELECT *, 1, cm FROM m), c AS (SELECT DISTINCT grp, axis, spot + 1 AS line FROM l),
    sc AS (SELECT grp, axis, line, (max(r1) FILTER (spot < line) - min(r0) FILTER (spot < line)) * (max(c1) FILTER (spot < line) - min(c0) FILTER (spot < line)) AS one, (max(r1) FILTER (spot >= line) - min(r0) FILTER (spot >= line)) * (max(c1) FILTER (spot >= line) - min(c0) FILTER (spot >= line)) AS two,
        CAST(abs(sum(land) FILTER (spot < line) - sum(land) FILTER (spot >= line)) AS BIGINT) AS uneven FROM c JOIN l USING (grp, axis) GROUP BY grp, axis, line)
    SELECT grp, axis, line, greatest(one, two) AS larger, uneven FROM sc WHERE two IS NOT NULL QUALIFY row_number() OVER (PARTITION BY grp ORDER BY greatest(one, two), uneven, axis, line) = 1""")
def best_split_lines(spark, sf_dir):
    m = registry._grouped(spark, sf_dir).select(F.expr("code div 100").alias("grp"), F.col("grid_count").alias("land"), "row_min", "row_max", "col_min", "col_max")
    return regions.best_lines(m, BLOCK)


# Basins of LARGE pixels or more are cut; pieces here are bands of ten rows, and some faults are planted.
_PIECE = f"CASE WHEN pix % 101 = 0 THEN 0 WHEN grid_count >= {cutting.LARGE} THEN 1 + ROWS % 4 WHEN pix % 103 = 0 THEN 1 ELSE 0 END"
_MASK = f""", pc AS (SELECT pix, "row", col, basin_id, grid_count >= {cutting.LARGE} AS is_cut, {_PIECE.replace('ROWS', '("row" // 10)')} AS piece FROM lab JOIN (SELECT basin_id, grid_count FROM ranked) USING (basin_id)),
    mask AS MATERIALIZED (SELECT *, CASE WHEN is_cut AND piece = 0 THEN 1 WHEN NOT is_cut AND piece <> 0 THEN 2 WHEN NOT is_cut AND basin_id % 23 = 0 THEN 3 ELSE 0 END AS status, CASE WHEN is_cut THEN 100 + basin_id * 10 + piece ELSE 1 + basin_id % 23 END AS r FROM pc)"""


@grid.product
def _overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = grid.labelled(spark, sf_dir)
    sized = basins.ranked(at).select("basin_id", "grid_count")
    pixels = at.join(sized, "basin_id").select("pix", "row", "col", "basin_id", F.expr(_PIECE.replace("ROWS", "(row div 10)")).alias("piece"))
    large = sized.where(F.col("grid_count") >= cutting.LARGE).select("basin_id")
    whole = sized.where("basin_id % 23 <> 0").select("basin_id", (1 + F.col("basin_id") % 23).alias("region"))
    parts = large.select("basin_id", F.explode(F.array(*map(F.lit, range(1, 5)))).alias("piece")).withColumn("region", 100 + F.col("basin_id") * 10 + F.col("piece"))
    return registry.flow.cut(regions.mask(pixels.select("pix", "basin_id", "piece"), large, whole, parts).join(pixels, "pix"))


@query(grid.ORACLE + _MASK + " SELECT pix, CAST(CASE WHEN status = 0 THEN r ELSE 0 END AS BIGINT) AS region, status FROM mask")
def region_mask(spark, sf_dir):
    return _overlay(spark, sf_dir).select("pix", "region", "status")


@query(grid.ORACLE + _MASK + f""", t AS (SELECT r AS region_id, count(*) AS region_grid_count, count(DISTINCT basin_id) AS basin_count, count(DISTINCT CASE WHEN piece <> 0 THEN basin_id * 10 + piece END) AS piece_count, min("row") AS bbox_row_min, max("row") + 1 AS bbox_row_max, min(col) AS bbox_col_min, max(col) + 1 AS bbox_col_max FROM mask WHERE status = 0 GROUP BY r),
    boxed AS (SELECT *, bbox_row_min // {BLOCK} * {BLOCK} AS row_min, ((bbox_row_max - 1) // {BLOCK} + 1) * {BLOCK} AS row_max, bbox_col_min // {BLOCK} * {BLOCK} AS col_min, ((bbox_col_max - 1) // {BLOCK} + 1) * {BLOCK} AS col_max FROM t)
    SELECT *, row_max - row_min AS nrow, col_max - col_min AS ncol, (row_max - row_min) * (col_max - col_min) AS window_grid_count, 100.0::DOUBLE * region_grid_count / ((row_max - row_min) * (col_max - col_min)) AS fill_percent, -180 + col_min * 0.5::DOUBLE AS minlon, -180 + col_max * 0.5::DOUBLE AS maxlon, 60 - row_max * 0.5::DOUBLE AS minlat, 60 - row_min * 0.5::DOUBLE AS maxlat FROM boxed""")
def region_statistics(spark, sf_dir):
    return regions.region_table(_overlay(spark, sf_dir).where("status = 0"), BLOCK, NORTH, WEST, SIZE)


_BY_AREA = """, seen AS MATERIALIZED (SELECT crow, ccol, basin_id FROM (SELECT *, row_number() OVER (PARTITION BY crow, ccol ORDER BY n DESC, basin_id) AS k FROM cells WHERE basin_id <= (SELECT count(*) FROM ranked WHERE grid_count * 4 >= 25)) WHERE k = 1 AND land * 100 >= 25 * 25 AND n * 100 >= 25 * land)"""


def _objects_sql(source: str) -> str:
    return _BY_AREA + f""", ob AS (SELECT crow, ccol, p.obj, seen.basin_id AS shown, count(*) AS n FROM (SELECT "row" // 5 AS crow, col // 5 AS ccol, basin_id, {source} AND obj <> 0) p LEFT JOIN seen USING (crow, ccol) WHERE seen.basin_id IS NULL OR seen.basin_id = p.basin_id GROUP BY ALL)
    SELECT crow, ccol, CAST(obj AS BIGINT) AS object FROM (SELECT *, sum(n) OVER (PARTITION BY crow, ccol) AS land, row_number() OVER (PARTITION BY crow, ccol ORDER BY n DESC, obj) AS k FROM ob) WHERE k = 1 AND (shown IS NOT NULL OR land * 4 >= 25)"""


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.QUERIES["fold_basin_view_by_area"](spark, sf_dir)


@query(grid.ORACLE + _MASK + _objects_sql("CASE WHEN status = 0 THEN r ELSE 0 END AS obj FROM mask WHERE true"))
def fold_region_view(spark, sf_dir):
    return regions.fold_objects(_overlay(spark, sf_dir).select("row", "col", "basin_id", F.col("region").alias("object")), _seen(spark, sf_dir), FACTOR)


@query(grid.ORACLE + _objects_sql("basin_id % 40 + 1 AS obj FROM lab WHERE true"))
def fold_group_view(spark, sf_dir):
    return regions.fold_objects(grid.labelled(spark, sf_dir).select("row", "col", "basin_id", (F.col("basin_id") % 40 + 1).alias("object")), _seen(spark, sf_dir), FACTOR)


@query(f"SELECT pix, coalesce(v.code, 0) AS grp FROM lab LEFT JOIN {_V} v USING (basin_id)")
def fine_group_raster(spark, sf_dir):
    at = grid.labelled(spark, sf_dir)
    groups = basins.vote(at).select("basin_id", F.col("code").alias("grp"))
    return at.select("pix", "basin_id").join(groups, "basin_id", "left").select("pix", F.coalesce("grp", F.lit(0).cast("long")).alias("grp"))


@query(f"""SELECT grp, CAST(sum(grid_count) AS BIGINT) AS land, CAST(sum(grid_count) AS BIGINT) AS pixels FROM (SELECT coalesce(v.code, 0) AS grp, grid_count FROM ranked LEFT JOIN {_V} v USING (basin_id)) GROUP BY grp""")
def group_read_back(spark, sf_dir):
    """Each group's land by its table and by the pixels of the group raster."""
    at = grid.labelled(spark, sf_dir)
    table = basins.ranked(at).join(basins.vote(at), "basin_id", "left").groupBy(F.coalesce("code", F.lit(0).cast("long")).alias("grp")).agg(F.sum("grid_count").alias("land"))
    return table.join(fine_group_raster(spark, sf_dir).groupBy("grp").agg(F.count("*").alias("pixels")), "grp", "full")


@query(cutting._SQL + """, pa AS MATERIALIZED (SELECT root, code, next_code, up_area FROM own JOIN (SELECT pix, up_area FROM up) USING (pix))
    SELECT pa.root, pa.code, pa.up_area - coalesce(come, 0) AS own_area FROM pa LEFT JOIN (SELECT root, next_code AS code, CAST(sum(up_area) AS BIGINT) AS come FROM pa WHERE next_code IS NOT NULL GROUP BY ALL) USING (root, code)""")
def piece_own_area(spark, sf_dir):
    t = cutting.cutting.table(*cutting._pieces(spark, sf_dir))
    return regions.own_area(t.join(grid.attributes(spark, sf_dir).select("pix", "up_area"), "pix"))


@query(cutting._SQL + """SELECT root, code, CASE WHEN code % 5 = 0 THEN 1 ELSE 2 END AS fault FROM own WHERE next_code IS NOT NULL AND (code % 5 = 0 OR code % 7 = 0)""")
def cut_faults(spark, sf_dir):
    """The cuts against the directions, some inlets moved and some parents changed first."""
    made, labels, flow = cutting._pieces(spark, sf_dir)
    own = cutting.cutting.table(made, labels, flow).where("next_code is not null").select("root", "code", "pix", "next_code")
    links = grid.links(spark, sf_dir)
    at = own.join(links.select("pix", F.col("row").alias("outlet_row"), F.col("col").alias("outlet_col"), F.col("code").alias("direction"), "down"), "pix")
    at = at.join(links.select(F.col("pix").alias("down"), F.col("row").alias("inlet_row"), F.col("col").alias("inlet_col")), "down")
    at = at.withColumn("inlet_col", F.col("inlet_col") + (F.col("code") % 5 == 0).cast("int")).withColumn("parent", F.col("next_code") + (F.col("code") % 7 == 0).cast("int"))
    return regions.cut_faults(at, labels.join(links.select("pix", "row", "col"), "pix"), STEPS)


@query(f"""SELECT basin_id, first_col, gap FROM (SELECT *, row_number() OVER (PARTITION BY basin_id ORDER BY gap DESC, first_col) AS k FROM (SELECT basin_id, x AS first_col, x - coalesce(lag(x) OVER (PARTITION BY basin_id ORDER BY x), max(x) OVER (PARTITION BY basin_id) - {grid.COLS}) - 1 AS gap FROM (SELECT DISTINCT basin_id, (col * 7 + "row") % {grid.COLS} AS x FROM lab))) WHERE k = 1""")
def seam_gaps(spark, sf_dir):
    return regions.seam_gaps(grid.labelled(spark, sf_dir).select("basin_id", ((F.col("col") * 7 + F.col("row")) % grid.COLS).alias("col")), grid.COLS)


@query("""SELECT region, CAST(CASE WHEN max(n) OVER () < 100 THEN 20000 + level1 * 100 + n ELSE region END AS BIGINT) AS published FROM (SELECT 200000 + basin_id AS region, basin_id % 9 + 1 AS level1, row_number() OVER (PARTITION BY basin_id % 9 ORDER BY grid_count DESC, basin_id) AS n FROM ranked)""")
def island_ids(spark, sf_dir):
    r = basins.ranked(grid.attributes(spark, sf_dir))
    return regions.island_ids(r.select((200000 + F.col("basin_id")).alias("region"), (F.col("basin_id") % 9 + 1).alias("level1"), F.col("grid_count").alias("land")))


@query("""WITH r AS (SELECT DISTINCT 1 + o_orderkey * 37 % 30000 AS region FROM orders) SELECT region, row_number() OVER (ORDER BY CASE WHEN region >= 100 AND region < 10000 THEN region // 100 ELSE region END, CASE WHEN region < 100 THEN 0 ELSE region END) AS place FROM r""")
def region_rows_in_order(spark, sf_dir):
    r = spark.read.parquet(f"{sf_dir}/orders.parquet").select((1 + F.col("o_orderkey") * 37 % 30000).alias("region")).distinct()
    return numbered(r.withColumn("_k", earth.region_order(F.col("region"))), "place", F.asc("_k")).select("region", "place")
