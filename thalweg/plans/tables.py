"""Queries of windows, views, groups, checks and attributes over the test grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from thalweg.functions import earth
from thalweg.operators import attributes, basins, flow, groups, tiles, views
from thalweg.plans import grid, registry
from thalweg.plans.registry import query


@query(f"""SELECT CAST(p.r AS BIGINT) AS "row", CAST(p.c AS BIGINT) AS col, CAST(coalesce(flow.code, 247) AS INTEGER) AS value FROM (SELECT r, c FROM range(-2, 8) a(r), range(95, 107) b(c)) p LEFT JOIN flow ON flow."row" = p.r AND flow.col = p.c % {grid.COLS}""")
def window_scan(spark, sf_dir):
    return views.window(grid.links(spark, sf_dir), "code", -2, 10, 95, 12, grid.COLS, flow.NODATA, periodic=True).select(F.col("row").cast("long"), F.col("col").cast("long"), "value")


@query("""SELECT DISTINCT pix, CAST((("row" + dr) // 20) AS BIGINT) AS trow, CAST(((col + dc) // 20) AS BIGINT) AS tcol FROM flow, range(-1, 2) a(dr), range(-1, 2) b(dc) WHERE "row" + dr >= 0 AND col + dc BETWEEN 0 AND 99""")
def halo_tiles(spark, sf_dir):
    return views.with_halo(grid.links(spark, sf_dir).select("pix", "row", "col"), 20, grid.COLS).select("pix", "trow", "tcol")


@query("SELECT a.basin_id AS a, b.basin_id AS b FROM ranked a JOIN ranked b ON a.basin_id < b.basin_id AND a.row_min < b.row_max AND b.row_min < a.row_max AND a.col_min < b.col_max AND b.col_min < a.col_max")
def box_overlaps(spark, sf_dir):
    return views.overlapping(basins.ranked(grid.attributes(spark, sf_dir)).select(F.col("basin_id").alias("id"), "row_min", "row_max", "col_min", "col_max"), 16)


@query("""SELECT basin_id, row_min * 0.5::DOUBLE AS south_of, 60 - row_max * 0.5::DOUBLE AS south, -180 + col_min * 0.5::DOUBLE AS west, -180 + col_max * 0.5::DOUBLE AS east FROM ranked""")
def basin_boxes_lon_lat(spark, sf_dir):
    north, south, west, east = earth.box(*[F.col(c) for c in ("row_min", "row_max", "col_min", "col_max")], 60.0, -180.0, 0.5)
    return basins.ranked(grid.attributes(spark, sf_dir)).select("basin_id", (60 - north).alias("south_of"), south.alias("south"), west.alias("west"), east.alias("east"))


@query("""SELECT pix, 60 - ("row" + 0.5::DOUBLE) * 0.5::DOUBLE AS lat, -180 + (col + 0.5::DOUBLE) * 0.5::DOUBLE AS lon FROM flow""")
def pixel_centres(spark, sf_dir):
    lat, lon = earth.centre(F.col("row"), F.col("col"), 60.0, -180.0, 0.5, grid.COLS)
    return grid.links(spark, sf_dir).select("pix", lat.alias("lat"), lon.alias("lon"))


@query(f"""SELECT basin_id, CASE WHEN a THEN ((s0 - 50) % 100 + 100) % 100 ELSE c0 END AS col_min, CASE WHEN a THEN ((s0 - 50) % 100 + 100) % 100 + s1 - s0 ELSE c1 END AS col_max, CAST(a AS INTEGER) AS astride FROM
    (SELECT *, c1 - c0 > 50 AND c1 > c0 AS a FROM (SELECT basin_id, min(x) AS c0, max(x) AS c1, min((x + 50) % 100) AS s0, max((x + 50) % 100) AS s1 FROM (SELECT basin_id, (col * 7 + "row") % {grid.COLS} AS x FROM lab) GROUP BY basin_id))""")
def unrolled_columns(spark, sf_dir):
    at = grid.labelled(spark, sf_dir).select("basin_id", ((F.col("col") * 7 + F.col("row")) % grid.COLS).alias("x")).withColumn("y", (F.col("x") + 50) % 100)
    return earth.unrolled(at.groupBy("basin_id").agg(F.min("x").alias("col_min"), F.max("x").alias("col_max"), F.min("y").alias("shift_min"), F.max("y").alias("shift_max")), grid.COLS)


_DOUBT = """, v AS (SELECT basin_id, grid_count AS land, coalesce(code, 0) AS code, coalesce(votes, 0) AS votes, grid_count <= 10000 AND (code IS NULL OR 2 * votes < grid_count) AS d FROM ranked LEFT JOIN (SELECT basin_id, code, votes FROM votes WHERE k = 1) USING (basin_id)),
    bound AS MATERIALIZED (SELECT a.basin_id, b.basin_id AS n, count(*) AS e FROM lab a JOIN lab b ON (b."row" = a."row" AND abs(b.col - a.col) = 1) OR (b.col = a.col AND abs(b."row" - a."row") = 1) WHERE a.basin_id <> b.basin_id GROUP BY ALL),
    met AS (SELECT bound.*, v.land, v.code, v.d FROM bound JOIN v ON v.basin_id = bound.n WHERE bound.basin_id IN (SELECT basin_id FROM v WHERE d)),
    best AS MATERIALIZED (SELECT basin_id, code FROM (SELECT basin_id, code, row_number() OVER (PARTITION BY basin_id ORDER BY sum(e) DESC, code) AS k FROM met WHERE NOT d AND code > 0 GROUP BY basin_id, code) WHERE k = 1),
    link AS MATERIALIZED (SELECT basin_id, n FROM (SELECT basin_id, n, row_number() OVER (PARTITION BY basin_id ORDER BY land DESC, n) AS k FROM met WHERE d) WHERE k = 1),
    run AS (SELECT basin_id AS src, basin_id AS cur FROM link WHERE basin_id NOT IN (SELECT basin_id FROM best) UNION SELECT src, link.n FROM run JOIN link ON link.basin_id = cur WHERE cur NOT IN (SELECT basin_id FROM best)),
    coded AS (SELECT src, max(best.code) AS code FROM run JOIN best ON best.basin_id = cur GROUP BY src),
    loops AS (SELECT src, arg_max(v.code, v.land * 1000000 - v.basin_id) AS code FROM run JOIN link a ON a.basin_id = cur JOIN link b ON b.basin_id = a.n AND b.n = cur JOIN v ON v.basin_id = cur WHERE cur NOT IN (SELECT basin_id FROM best) AND a.n NOT IN (SELECT basin_id FROM best) AND src NOT IN (SELECT src FROM coded) GROUP BY src),
    given AS (SELECT v.basin_id, v.code AS own, coalesce(best.code, coded.code, nullif(loops.code, 0)) AS g FROM v LEFT JOIN best USING (basin_id) LEFT JOIN coded ON coded.src = v.basin_id LEFT JOIN loops ON loops.src = v.basin_id)"""


@query(_DOUBT + "SELECT basin_id, CAST(coalesce(g, own) AS BIGINT) AS code, CAST(g IS NOT NULL AS INTEGER) AS given FROM given")
def resolved_codes(spark, sf_dir):
    at = grid.labelled(spark, sf_dir)
    voted = basins.ranked(at).select("basin_id", F.col("grid_count").alias("land")).join(basins.vote(at), "basin_id", "left").fillna(0, ["code", "votes"])
    return groups.resolved(voted, basins.boundaries(at))


@query("SELECT basin_id, CASE WHEN basin_id % 5 = 0 THEN (SELECT 1000 + ranked.basin_id % 3) ELSE basin_id % 5 END AS region FROM ranked")
def region_of_basin(spark, sf_dir):
    r = basins.ranked(grid.attributes(spark, sf_dir)).select("basin_id")
    return groups.region_of_basin(r, r.select("basin_id", (F.col("basin_id") % 5).alias("region")), r.select("basin_id", (1000 + F.col("basin_id") % 3).alias("region")))


@query("""SELECT code, basins, land, found_basins, found_land FROM (SELECT code, count(*) AS basins, CAST(sum(grid_count) AS BIGINT) AS land FROM ranked JOIN (SELECT basin_id, code FROM votes WHERE k = 1) USING (basin_id) GROUP BY code)
    FULL JOIN (SELECT code, count(*) AS found_basins, CAST(sum(grid_count) AS BIGINT) AS found_land FROM ranked JOIN (SELECT basin_id, code FROM votes WHERE k = 1) USING (basin_id) WHERE basin_id % 50 <> 0 GROUP BY code) USING (code) WHERE basins IS DISTINCT FROM found_basins OR land IS DISTINCT FROM found_land""")
def group_faults(spark, sf_dir):
    at = grid.labelled(spark, sf_dir)
    voted = basins.ranked(at).select("basin_id", F.col("grid_count").alias("land")).join(basins.vote(at), "basin_id")
    return groups.faults(voted.groupBy("code").agg(F.count("*").alias("basins"), F.sum("land").alias("land")), voted.where("basin_id % 50 <> 0"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice = floor(l_extendedprice) THEN CAST(l_extendedprice AS BIGINT) END AS whole FROM lineitem")
def integral_ids(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", earth.integral(F.col("l_extendedprice")).alias("whole"))


def _view(spark, sf_dir):
    return basins.fold_view(grid.labelled(spark, sf_dir), 5, 200)


@query("""SELECT v.basin_id, CASE WHEN s.dr = 1 THEN crow + 1 WHEN s.dr = -1 THEN crow WHEN s.dc = -1 THEN crow ELSE crow + 1 END AS r0, CASE WHEN s.dr = 1 THEN ccol WHEN s.dr = -1 THEN ccol + 1 WHEN s.dc = -1 THEN ccol ELSE ccol + 1 END AS c0,
    CASE WHEN s.dr = 1 THEN crow + 1 WHEN s.dr = -1 THEN crow WHEN s.dc = -1 THEN crow + 1 ELSE crow END AS r1, CASE WHEN s.dr = 1 THEN ccol + 1 WHEN s.dr = -1 THEN ccol WHEN s.dc = -1 THEN ccol ELSE ccol + 1 END AS c1
    FROM view v CROSS JOIN (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) s(dr, dc) WHERE NOT EXISTS (SELECT 1 FROM view n WHERE n.crow = v.crow + s.dr AND n.ccol = v.ccol + s.dc AND n.basin_id = v.basin_id)""")
def boundary_sides(spark, sf_dir):
    return views.sides(_view(spark, sf_dir))


@query("SELECT basin_id, count(*) AS cells FROM view GROUP BY basin_id")
def polygon_cells(spark, sf_dir):
    return views.polygons(_view(spark, sf_dir), 60.0, -180.0, 2.5).select("basin_id", "cells")


@query(None)
def polygons(spark, sf_dir):
    return views.polygons(_view(spark, sf_dir), 60.0, -180.0, 2.5)


@query("SELECT ranked.basin_id, row_min, coalesce(n, 0) AS cells, CASE WHEN n > 0 THEN row_min ELSE -9999 END AS box_row FROM ranked LEFT JOIN (SELECT basin_id, count(*) AS n FROM view GROUP BY basin_id) USING (basin_id) WHERE ranked.basin_id <= 200")
def view_rows(spark, sf_dir):
    r = basins.ranked(grid.attributes(spark, sf_dir)).where("basin_id <= 200").select("basin_id", "row_min")
    return views.with_empty(r, _view(spark, sf_dir).groupBy("basin_id").agg(F.count("*").alias("cells")))


@query(None)
def colouring(spark, sf_dir):
    v = _view(spark, sf_dir)
    return views.colours(v, basins.adjacent(v))


@query("SELECT basin_id AS a, basin_id AS b FROM view WHERE false")
def colouring_clashes(spark, sf_dir):
    v = _view(spark, sf_dir)
    pairs = basins.adjacent(v)
    return views.clashes(views.colours(v, pairs), pairs)


attributes.register(attributes.Attribute("relief", lambda: F.col("pixels") * 10 + F.col("hops") % 10, above={"pixels": "one"}))


@query("SELECT root, count(*) AS pixels, min(up_count * 10 + hops % 10) AS least, max(up_count * 10 + hops % 10) AS greatest, max(CASE WHEN pix = root THEN up_count * 10 + hops % 10 END) AS at_outlet FROM up JOIN attr USING (pix) GROUP BY root")
def user_attribute(spark, sf_dir):
    own = grid.tiled(grid.links(spark, sf_dir)).withColumn("one", F.lit(1))
    return attributes.by_basin(attributes.derive("relief", own, tiles.fold))


@query(registry._RECODE + "SELECT pix, row_number() OVER (ORDER BY code, pix) AS place FROM recoded WHERE code = 254")
def numbered_rows(spark, sf_dir):
    return registry.numbered(registry._recoded(spark, sf_dir).where(F.col("code") == flow.UNKNOWN).select("pix", "code"), "place", F.asc("code"), F.asc("pix")).drop("code")
