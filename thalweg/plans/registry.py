"""Registered queries and their oracle SQL, by name."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thalweg.functions import earth
from thalweg.operators import basins, flow, tiles
from thalweg.operators.order import numbered
from thalweg.plans import grid

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql if sql.lstrip().startswith("WITH") else grid.ORACLE + sql
        return f

    return register


# A producer's convention, its code for each direction.
ESRI_LIKE = {1: 1, 2: 2, 3: 4, 4: 8, 5: 16, 6: 32, 7: 64, 8: 128}
_NATIVE = "CASE WHEN o_orderkey % 29 = 0 THEN -1 WHEN o_orderkey % 31 = 0 THEN 9 WHEN o_orderkey % 37 = 0 THEN 0 WHEN o_orderkey % 41 = 0 THEN 77 ELSE 1 + o_custkey % 8 END"


def _native(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("pix"), F.expr("o_orderkey div 100").alias("row"), (F.col("o_orderkey") % 100).alias("col"), F.expr(_NATIVE).cast("int").alias("native"))


def _recoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.recode(_native(spark, sf_dir), ESRI_LIKE, sink=9, nodata=-1, mouth=0, rows=0, cols=100)


_RECODE = f"""WITH n AS (SELECT o_orderkey AS pix, o_orderkey // 100 AS r, o_orderkey % 100 AS c, CAST({_NATIVE} AS INTEGER) AS native FROM orders),
    o(native, code, dr, dc) AS (VALUES (1,1,0,1),(2,2,1,1),(3,4,1,0),(4,8,1,-1),(5,16,0,-1),(6,32,-1,-1),(7,64,-1,0),(8,128,-1,1)),
    recoded AS (SELECT n.pix, n.r AS "row", n.c AS col, n.native, CAST(CASE WHEN n.native = -1 THEN 247 WHEN n.native = 9 THEN 255 WHEN o.code IS NOT NULL THEN CASE WHEN t.pix IS NOT NULL THEN o.code ELSE 0 END WHEN n.native = 0 THEN 0 ELSE 254 END AS INTEGER) AS code
        FROM n LEFT JOIN o ON o.native = n.native LEFT JOIN n t ON t.r = n.r + o.dr AND t.c = n.c + o.dc AND t.native <> -1)"""


@query(_RECODE + "SELECT * FROM recoded")
def recode(spark, sf_dir):
    return _recoded(spark, sf_dir)


@query(_RECODE + "SELECT code, count(*) AS pixels FROM recoded GROUP BY code")
def recode_balance(spark, sf_dir):
    return _recoded(spark, sf_dir).groupBy("code").agg(F.count("*").alias("pixels"))


@query(_RECODE + "SELECT pix, native FROM recoded WHERE code = 254")
def unknown_codes(spark, sf_dir):
    return _recoded(spark, sf_dir).where(F.col("code") == flow.UNKNOWN).select("pix", "native")


@query("SELECT pix, code, down FROM flow")
def flow_links(spark, sf_dir):
    return grid.links(spark, sf_dir).select("pix", "code", "down")


@query("SELECT pix, CASE WHEN code = 255 THEN 1 ELSE 0 END AS endorheic FROM flow WHERE code IN (0, 255)")
def terminals(spark, sf_dir):
    return grid.links(spark, sf_dir).where("code in (0, 255)").select("pix", (F.col("code") == 255).cast("int").alias("endorheic"))


_E = math.sqrt(earth.E2)


@query(f"""WITH r AS (SELECT DISTINCT o_orderkey // 100 AS "row" FROM orders), l AS (SELECT "row", 60 - ("row" + 0.5::DOUBLE) * 0.05::DOUBLE AS lat FROM r),
    z AS (SELECT "row", lat, sin(radians(lat - 0.025::DOUBLE)) AS a, sin(radians(lat + 0.025::DOUBLE)) AS b FROM l)
    SELECT "row", round({earth.A * earth.A * (1 - earth.E2) * math.radians(0.05) * 0.5!r}::DOUBLE * (b / (1 - {earth.E2!r}::DOUBLE * b * b) + ln((1 + {_E!r}::DOUBLE * b) / (1 - {_E!r}::DOUBLE * b)) / {2 * _E!r}::DOUBLE - a / (1 - {earth.E2!r}::DOUBLE * a * a) - ln((1 + {_E!r}::DOUBLE * a) / (1 - {_E!r}::DOUBLE * a)) / {2 * _E!r}::DOUBLE), 0) AS area_m2 FROM z""")
def pixel_area(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.expr("o_orderkey div 100").alias("row")).distinct()
    return rows.select("row", F.round(earth.pixel_area_m2(60 - (F.col("row") + 0.5) * 0.05, 0.05, 0.05), 0).alias("area_m2"))


@query("SELECT pix, code, CAST(cm AS BIGINT) AS cm FROM flow")
def step_lengths(spark, sf_dir):
    return grid.links(spark, sf_dir).select("pix", "code", grid.step_cm().alias("cm"))


@query("SELECT pix, up_count FROM up")
def upstream_count(spark, sf_dir):
    return grid.attributes(spark, sf_dir).select("pix", "up_count")


@query("SELECT pix, up_area FROM up")
def upstream_area_m2(spark, sf_dir):
    return grid.attributes(spark, sf_dir).select("pix", "up_area")


@query(f"SELECT pix, CASE WHEN up_count >= {grid.CHANNEL} THEN 1 ELSE 0 END AS channel FROM up")
def channel_mask(spark, sf_dir):
    return grid.attributes(spark, sf_dir).select("pix", (F.col("up_count") >= grid.CHANNEL).cast("int").alias("channel"))


@query("SELECT c.pix, c.down FROM ch c LEFT JOIN ch d ON d.pix = c.down WHERE c.down IS NOT NULL AND d.pix IS NULL")
def channel_breaks(spark, sf_dir):
    c = grid.channels(spark, sf_dir)
    return c.where("down is not null").select("pix", "down").join(c.select(F.col("pix").alias("down")), "down", "left_anti").select("pix", "down")


@query("SELECT pix, up_count, up_area, hops, ldn, root, lup FROM up JOIN attr USING (pix)")
def exit_accumulation(spark, sf_dir):
    own = grid.links(spark, sf_dir).select("*", grid.step_cm().alias("cm"), F.lit(1).alias("one"), (F.lit(900) + F.col("row") % 7).alias("area"))
    return tiles.fold(grid.tiled(own, 16), {"ldn": "cm"}, {"up_count": "one", "up_area": "area"}, longest="ldn").withColumnRenamed("up_ldn", "lup")


@query("SELECT pix, root FROM attr")
def watershed_labels(spark, sf_dir):
    return grid.attributes(spark, sf_dir).select("pix", "root")


@query("SELECT pix, hops FROM attr")
def topological_level(spark, sf_dir):
    return grid.attributes(spark, sf_dir).select("pix", "hops")


@query("SELECT basin_id, root AS outlet_pix, grid_count, row_min, row_max, col_min, col_max FROM ranked")
def basin_rank(spark, sf_dir):
    return basins.ranked(grid.attributes(spark, sf_dir).select("pix", "row", "col", "root"))


@query("SELECT ch.pix, count(*) AS shv FROM ch JOIN w ON w.cur = ch.pix JOIN heads ON heads.pix = w.src GROUP BY ch.pix")
def shreve(spark, sf_dir):
    return tiles.fold(grid.tiled(grid.channels(spark, sf_dir)), {}, {"shv": "head"}).select("pix", "shv")


def _strahler_sql() -> str:
    sets = ", s1 AS MATERIALIZED (SELECT pix FROM ch)"
    for k in range(1, 7):
        sets += f", s{k + 1} AS MATERIALIZED (SELECT DISTINCT w.cur AS pix FROM w JOIN (SELECT ch.down AS pix FROM ch JOIN s{k} USING (pix) WHERE ch.down IS NOT NULL GROUP BY ch.down HAVING count(*) >= 2) j ON j.pix = w.src)"
    return sets + " SELECT pix, CAST(max(k) AS BIGINT) AS ord FROM (" + " UNION ALL ".join(f"SELECT pix, {k} AS k FROM s{k}" for k in range(1, 8)) + ") GROUP BY pix"


@query(_strahler_sql())
def strahler(spark, sf_dir):
    return flow.strahler(grid.tiled(grid.channels(spark, sf_dir)), closure=tiles.fold)


@query("SELECT down, pix FROM donor WHERE k = 1")
def main_donor(spark, sf_dir):
    return flow.main_donor(grid.attributes(spark, sf_dir), "up_count")


@query("SELECT w.src AS pix, 1 + CAST(count(d.pix) AS BIGINT) AS hck FROM w LEFT JOIN (SELECT pix FROM donor WHERE k > 1) d ON d.pix = w.cur GROUP BY w.src")
def hack(spark, sf_dir):
    a = grid.attributes(spark, sf_dir)
    minor = a.select("pix", "down").join(flow.main_donor(a, "up_count").select("pix", F.lit(0).alias("minor")), "pix", "left").select("pix", "down", F.coalesce("minor", F.lit(1)).alias("minor"))
    return tiles.fold(grid.tiled(minor), {"turns": "minor"}, {}).select("pix", (F.col("turns") + 1).alias("hck"))


@query("SELECT pix, ldn FROM attr")
def distance_to_outlet(spark, sf_dir):
    return grid.attributes(spark, sf_dir).select("pix", "ldn")


@query("SELECT pix, lup FROM up")
def upstream_length(spark, sf_dir):
    return grid.attributes(spark, sf_dir).select("pix", "lup")


_HEAD = "(SELECT root, pix, ldn FROM (SELECT root, pix, ldn, row_number() OVER (PARTITION BY root ORDER BY ldn DESC, pix) AS k FROM attr) WHERE k = 1)"


def _heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    far = F.min(F.struct((-F.col("ldn")).alias("less"), "pix")).alias("s")
    return grid.attributes(spark, sf_dir).groupBy("root").agg(far).select("root", F.col("s.pix").alias("pix"), (-F.col("s.less")).alias("ldn"))


@query(f"SELECT root, pix, ldn FROM {_HEAD}")
def longest_path_head(spark, sf_dir):
    return _heads(spark, sf_dir)


@query(f"SELECT w.cur AS pix, h.root AS lfp FROM {_HEAD} h JOIN w ON w.src = h.pix")
def longest_path_pixels(spark, sf_dir):
    own = grid.links(spark, sf_dir).select("pix", "down").join(_heads(spark, sf_dir).select("pix", F.lit(1).alias("head")), "pix", "left").select("pix", "down", F.coalesce("head", F.lit(0)).alias("head"))
    return tiles.fold(grid.tiled(own), {}, {"heads": "head"}).where("heads > 0").select("pix", F.col("root").alias("lfp"))


@query("SELECT ranked.basin_id, ranked.root AS outlet_pix, grid_count, max(attr.ldn) AS farthest_cm, max(CASE WHEN attr.pix = ranked.root THEN up.lup END) AS lup_at_outlet FROM ranked JOIN attr USING (root) JOIN up ON up.pix = attr.pix GROUP BY ALL")
def attribute_basin_table(spark, sf_dir):
    a = grid.attributes(spark, sf_dir)
    per = a.groupBy("root").agg(F.max("ldn").alias("farthest_cm"), F.max(F.when(F.col("pix") == F.col("root"), F.col("lup"))).alias("lup_at_outlet"))
    return basins.ranked(a).join(per, F.col("outlet_pix") == F.col("root")).select("basin_id", "outlet_pix", "grid_count", "farthest_cm", "lup_at_outlet")


@query("SELECT basin_id, code, votes FROM votes WHERE k = 1")
def vote_mode(spark, sf_dir):
    return basins.vote(grid.labelled(spark, sf_dir))


@query("SELECT basin_id FROM ranked LEFT JOIN (SELECT basin_id, votes FROM votes WHERE k = 1) v USING (basin_id) WHERE grid_count <= 10000 AND (v.votes IS NULL OR 2 * v.votes < grid_count)")
def doubtful_basins(spark, sf_dir):
    at = grid.labelled(spark, sf_dir)
    land = at.groupBy("basin_id").agg(F.count("*").alias("land"))
    return land.join(basins.vote(at), "basin_id", "left").where("land <= 10000 and (votes is null or 2 * votes < land)").select("basin_id")


@query("""SELECT basin_id, neighbour_id, count(*) AS edges FROM (SELECT a.basin_id, b.basin_id AS neighbour_id FROM lab a JOIN lab b ON (b."row" = a."row" AND abs(b.col - a.col) = 1) OR (b.col = a.col AND abs(b."row" - a."row") = 1) WHERE a.basin_id <> b.basin_id) GROUP BY ALL""")
def shared_boundary(spark, sf_dir):
    return basins.boundaries(grid.labelled(spark, sf_dir))


def _outlets(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = grid.labelled(spark, sf_dir)
    return at.where("pix = root").select("basin_id", "row", "col").join(basins.vote(at).select("basin_id", "votes"), "basin_id", "left")


@query("""SELECT basin_id, near_id, d2 FROM (SELECT f.basin_id, c.basin_id AS near_id, (f."row" - c."row") * (f."row" - c."row") + (f.col - c.col) * (f.col - c.col) AS d2, row_number() OVER (PARTITION BY f.basin_id ORDER BY (f."row" - c."row") * (f."row" - c."row") + (f.col - c.col) * (f.col - c.col), c.basin_id) AS k
    FROM lab f JOIN lab c ON f.pix = f.root AND c.pix = c.root WHERE f.basin_id NOT IN (SELECT basin_id FROM votes) AND c.basin_id IN (SELECT basin_id FROM votes) AND (f."row" - c."row") * (f."row" - c."row") + (f.col - c.col) * (f.col - c.col) <= 100) WHERE k = 1""")
def nearest_coded(spark, sf_dir):
    o = _outlets(spark, sf_dir)
    return basins.nearest(o.where("votes is null"), o.where("votes is not null"), 10)


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = grid.labelled(spark, sf_dir)
    return basins.ranked(at).join(basins.vote(at), "basin_id")


@query("""SELECT level, code // divisor AS code, count(*) AS basins, CAST(sum(grid_count) AS BIGINT) AS land, min(row_min) AS row_min, max(row_max) AS row_max, min(col_min) AS col_min, max(col_max) AS col_max
    FROM ranked JOIN (SELECT basin_id, code FROM votes WHERE k = 1) USING (basin_id) CROSS JOIN (VALUES (3, 1), (2, 10), (1, 100)) l(level, divisor) GROUP BY level, code // divisor""")
def group_rollup(spark, sf_dir):
    return basins.rolled_up(_grouped(spark, sf_dir))


@query("""SELECT code, row_min // 8 * 8 AS row_min, ((row_max - 1) // 8 + 1) * 8 AS row_max, col_min // 8 * 8 AS col_min, ((col_max - 1) // 8 + 1) * 8 AS col_max FROM (SELECT code, min(row_min) AS row_min, max(row_max) AS row_max, min(col_min) AS col_min, max(col_max) AS col_max FROM ranked JOIN (SELECT basin_id, code FROM votes WHERE k = 1) USING (basin_id) GROUP BY code)""")
def group_windows(spark, sf_dir):
    g = basins.rolled_up(_grouped(spark, sf_dir)).where("level = 3")
    return g.select("code", *[(earth.block_floor if c.endswith("min") else earth.block_ceil)(F.col(c), 8).alias(c) for c in ("row_min", "row_max", "col_min", "col_max")])


@query("""SELECT basin_id, cell FROM (SELECT basin_id, "row" // 10 * 10 + col // 10 AS cell, row_number() OVER (PARTITION BY basin_id ORDER BY count(*) DESC, "row" // 10 * 10 + col // 10) AS k FROM lab GROUP BY basin_id, "row" // 10 * 10 + col // 10) WHERE k = 1""")
def cells_of_basins(spark, sf_dir):
    n = grid.labelled(spark, sf_dir).groupBy("basin_id", F.expr("row div 10 * 10 + col div 10").alias("cell")).agg(F.count("*").alias("n"))
    return n.groupBy("basin_id").agg(F.min(F.struct((-F.col("n")).alias("less"), "cell")).alias("s")).select("basin_id", "s.cell")


@query("SELECT basin_id, code, row_number() OVER (PARTITION BY code ORDER BY basin_id) AS place FROM votes WHERE k = 1")
def place_in_unit(spark, sf_dir):
    return basins.vote(grid.labelled(spark, sf_dir)).select("basin_id", "code", F.row_number().over(Window.partitionBy("code").orderBy("basin_id")).alias("place"))


@query("SELECT run, basin_id, row_number() OVER (ORDER BY grid_count DESC, run, basin_id) AS global_id FROM (SELECT 1 AS run, basin_id, grid_count FROM ranked UNION ALL SELECT 2, basin_id, grid_count FROM ranked WHERE basin_id % 2 = 1)")
def global_basin_id(spark, sf_dir):
    r = basins.ranked(grid.attributes(spark, sf_dir)).select("basin_id", "grid_count")
    runs = r.select(F.lit(1).alias("run"), "*").unionByName(r.where("basin_id % 2 = 1").select(F.lit(2).alias("run"), "*"))
    return numbered(runs, "global_id", F.desc("grid_count"), F.asc("run"), F.asc("basin_id")).drop("grid_count")


@query("SELECT crow, ccol, basin_id FROM view")
def fold_basin_view(spark, sf_dir):
    return basins.fold_view(grid.labelled(spark, sf_dir), 5, 200)


@query("""SELECT crow, ccol, basin_id FROM (SELECT *, row_number() OVER (PARTITION BY crow, ccol ORDER BY n DESC, basin_id) AS k FROM cells WHERE basin_id <= (SELECT count(*) FROM ranked WHERE grid_count * 4 >= 25))
    WHERE k = 1 AND land * 100 >= 25 * 25 AND n * 100 >= 25 * land""")
def fold_basin_view_by_area(spark, sf_dir):
    return basins.fold_view(grid.labelled(spark, sf_dir), 5, basins.ids_of_view(basins.ranked(grid.attributes(spark, sf_dir)), 5))


@query("SELECT DISTINCT least(a.basin_id, b.basin_id) AS a, greatest(a.basin_id, b.basin_id) AS b FROM view a JOIN view b ON abs(a.crow - b.crow) <= 1 AND abs(a.ccol - b.ccol) <= 1 AND a.basin_id <> b.basin_id")
def object_adjacency(spark, sf_dir):
    return basins.adjacent(basins.fold_view(grid.labelled(spark, sf_dir), 5, 200))


@query("SELECT down, pix, up_count FROM (SELECT down, pix, up_count, row_number() OVER (PARTITION BY root ORDER BY up_count DESC, donor.pix) AS r FROM donor JOIN attr USING (pix) WHERE k > 1) WHERE r <= 4")
def tributaries_top4(spark, sf_dir):
    a = grid.attributes(spark, sf_dir)
    minor = a.where("down is not null").join(flow.main_donor(a, "up_count").select("pix"), "pix", "left_anti")
    top = F.row_number().over(Window.partitionBy("root").orderBy(F.desc("up_count"), "pix"))
    return minor.select("down", "pix", "up_count", top.alias("r")).where("r <= 4").drop("r")


@query("""SELECT a.pix, a.down, a."row" // 32 * 100 + a.col // 32 AS tile, b."row" // 32 * 100 + b.col // 32 AS down_tile FROM flow a JOIN flow b ON b.pix = a.down WHERE tile <> down_tile""")
def exits_inlets(spark, sf_dir):
    f = grid.links(spark, sf_dir).select("pix", "down", F.expr("row div 32 * 100 + col div 32").alias("tile"))
    return f.where("down is not null").join(f.select(F.col("pix").alias("down"), F.col("tile").alias("down_tile")), "down").where("tile <> down_tile").select("pix", "down", "tile", "down_tile")


@query("""SELECT pix, basin_id FROM lab WHERE "row" % 30 = 0 AND col % 30 = 0""")
def preview_decimate(spark, sf_dir):
    return grid.labelled(spark, sf_dir).where("row % 30 = 0 and col % 30 = 0").select("pix", "basin_id")


# The curve's recurrence in SQL, a level at a time.
_HILBERT = grid.ORACLE + """, hil AS (SELECT DISTINCT "row" // 10 AS crow, col // 10 AS ccol, "row" // 10 AS r, col // 10 AS c, CAST(0 AS BIGINT) AS h, 10 AS level FROM lab UNION ALL
    SELECT crow, ccol, CASE WHEN (r >> level) & 1 = 0 THEN CASE WHEN (c >> level) & 1 = 1 THEN 2047 - c ELSE c END ELSE r END, CASE WHEN (r >> level) & 1 = 0 THEN CASE WHEN (c >> level) & 1 = 1 THEN 2047 - r ELSE r END ELSE c END,
        h + (CAST(1 AS BIGINT) << (2 * level)) * xor(3 * ((c >> level) & 1), (r >> level) & 1), level - 1 FROM hil WHERE level >= 0) """


@query(_HILBERT + "SELECT crow, ccol, h AS hilbert FROM hil WHERE level = -1")
def hilbert_index(spark, sf_dir):
    cells = grid.labelled(spark, sf_dir).select(F.expr("row div 10").alias("crow"), F.expr("col div 10").alias("ccol")).distinct()
    return earth.with_hilbert(cells, "crow", "ccol", 11)


# These add their own queries.
from thalweg.plans import cutting, regions, tables  # noqa: E402, F401
