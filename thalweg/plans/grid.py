"""The test grid over the orders table, and its products.

A product is made once for each state of the input: it is remembered together with the names, lengths and times of the
table's files, so a table that was replaced is read anew.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.operators import basins, flow, tiles
from thalweg.sources.shared import cut

COLS = 100
STRAIGHT_CM, DIAGONAL_CM = 3000, 4243
CHANNEL = 5
#: Pixels of a tile's side.
TILE = 512


#: Products held at once; the one used longest ago goes first.
HELD = 16
_held: OrderedDict = OrderedDict()


def _state(spark: SparkSession, path: str) -> tuple[tuple[str, int, int], ...]:
    """Name, length and time of each file of a table, as the file system that Spark reads names them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files, out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(at, True), []
    while files.hasNext():
        f = files.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def product[T](make: Callable[[SparkSession, str], T]) -> Callable[[SparkSession, str], T]:
    """make(spark, sf_dir), remembered while the session and the files of the orders table stay as they are."""

    @wraps(make)
    def made(spark: SparkSession, sf_dir: str) -> T:
        key = (make.__module__, make.__name__, spark.sparkContext.applicationId, _state(spark, f"{sf_dir}/orders.parquet"))
        if key not in _held:
            _held[key] = make(spark, sf_dir)
            while len(_held) > HELD:
                _held.popitem(last=False)
        _held.move_to_end(key)
        return _held[key]

    return made


def forget() -> None:
    """Drop every product, so that the next query makes its own."""
    _held.clear()


def surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice").where("o_orderkey % 29 <> 0")
    row = F.expr(f"o_orderkey div {COLS}")
    return o.select(F.col("o_orderkey").alias("pix"), row.alias("row"), (F.col("o_orderkey") % COLS).alias("col"), (F.col("o_totalprice") - 200000 * row).alias("z"))


def step_cm(code: str = "code") -> F.Column:
    return F.when(F.col(code).isin(1, 4, 16, 64), STRAIGHT_CM).when(F.col(code).isin(2, 8, 32, 128), DIAGONAL_CM).otherwise(0).cast("long")


@product
def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(flow.steepest_descent(surface(spark, sf_dir)))


def tiled(links: DataFrame, side: int = TILE) -> DataFrame:
    """links with the tiles of pix and of down."""
    tile = lambda c: F.expr(f"{c} div {COLS} div {side} * 1000000 + {c} % {COLS} div {side}").cast("long")
    return links.select("*", tile("pix").alias("tile"), tile("down").alias("down_tile"))


@product
def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pix, row, col, code, down, root, hops, ldn (cm), up_count, up_area (m2) and lup (cm) of every land pixel."""
    own = links(spark, sf_dir).select("*", step_cm().alias("cm"), F.lit(1).alias("one"), (F.lit(900) + F.col("row") % 7).alias("area"))
    found = tiles.fold(tiled(own), {"ldn": "cm"}, {"up_count": "one", "up_area": "area"}, longest="ldn")
    return cut(links(spark, sf_dir).join(found.withColumnRenamed("up_ldn", "lup"), "pix"))


@product
def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pix, row, col, root, basin_id and code (a level-3 code by blocks, 0 where there is none)."""
    a = attributes(spark, sf_dir).select("pix", "row", "col", "root")
    code = F.when(F.col("pix") % 7 == 0, 0).otherwise(100 + F.expr("row div 10 % 60") * 10 + F.expr("col div 25")).cast("long")
    return cut(a.join(basins.ranked(a).select(F.col("outlet_pix").alias("root"), "basin_id"), "root").select("pix", "row", "col", "root", "basin_id", code.alias("code")))


@product
def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pix, down, root, up_count and head (1 where no channel flows in) of pixels with CHANNEL or more above."""
    c = attributes(spark, sf_dir).where(F.col("up_count") >= CHANNEL).select("pix", "down", "root", "up_count")
    fed = c.where("down is not null").select(F.col("down").alias("pix"), F.lit(0).alias("fed")).distinct()
    return cut(c.join(fed, "pix", "left").select("pix", "down", "root", "up_count", F.coalesce("fed", F.lit(1)).alias("head")))


# The D8 codes with their row and column steps, in o(code, dr, dc) below.
#: The same grid, paths and products in DuckDB's SQL, for the oracle. w holds all pairs (src, cur) along paths.
ORACLE = f"""
    WITH RECURSIVE g AS (SELECT o_orderkey AS pix, o_orderkey // {COLS} AS "row", o_orderkey % {COLS} AS col, o_totalprice - 200000 * (o_orderkey // {COLS}) AS z FROM orders WHERE o_orderkey % 29 <> 0),
    o(code, dr, dc) AS (VALUES (1,0,1),(2,1,1),(4,1,0),(8,1,-1),(16,0,-1),(32,-1,-1),(64,-1,0),(128,-1,1)),
    cand AS (SELECT a.pix, o.code, b.pix AS down, row_number() OVER (PARTITION BY a.pix ORDER BY b.z, b.pix) AS rn FROM g a CROSS JOIN o JOIN g b ON b."row" = a."row" + o.dr AND b.col = a.col + o.dc WHERE b.z < a.z OR (b.z = a.z AND b.pix < a.pix)),
    flow AS MATERIALIZED (SELECT g.pix, g."row", g.col, CAST(coalesce(cand.code, CASE WHEN g.pix % 2 = 0 THEN 0 ELSE 255 END) AS INTEGER) AS code, cand.down,
        CASE WHEN cand.code IN (1,4,16,64) THEN {STRAIGHT_CM} WHEN cand.code IN (2,8,32,128) THEN {DIAGONAL_CM} ELSE 0 END AS cm, 900 + g."row" % 7 AS area
        FROM g LEFT JOIN cand ON cand.pix = g.pix AND cand.rn = 1),
    w AS (SELECT pix AS src, pix AS cur, 0 AS k FROM flow UNION ALL SELECT src, down, k + 1 FROM w JOIN flow ON flow.pix = cur WHERE down IS NOT NULL),
    path AS MATERIALIZED (SELECT src, cur, k, code, down, cm, sum(cm) OVER (PARTITION BY src ORDER BY k DESC) AS ldn_rest, area FROM w JOIN flow ON flow.pix = cur),
    attr AS MATERIALIZED (SELECT src AS pix, CAST(max(k) AS BIGINT) AS hops, CAST(sum(cm) AS BIGINT) AS ldn, CAST(max(CASE WHEN down IS NULL THEN cur END) AS BIGINT) AS root FROM path GROUP BY src),
    up AS MATERIALIZED (SELECT w.cur AS pix, count(*) AS up_count, CAST(sum(s.area) AS BIGINT) AS up_area, CAST(max(a.ldn - b.ldn) AS BIGINT) AS lup FROM w JOIN flow s ON s.pix = w.src JOIN attr a ON a.pix = w.src JOIN attr b ON b.pix = w.cur GROUP BY w.cur),
    ranked AS MATERIALIZED (SELECT row_number() OVER (ORDER BY count(*) DESC, root) AS basin_id, root, count(*) AS grid_count, min("row") AS row_min, max("row") + 1 AS row_max, min(col) AS col_min, max(col) + 1 AS col_max FROM attr JOIN flow USING (pix) GROUP BY root),
    lab AS MATERIALIZED (SELECT flow.pix, flow."row", flow.col, attr.root, basin_id, CAST(CASE WHEN flow.pix % 7 = 0 THEN 0 ELSE 100 + ("row" // 10 % 60) * 10 + col // 25 END AS BIGINT) AS code FROM flow JOIN attr USING (pix) JOIN ranked USING (root)),
    votes AS (SELECT basin_id, code, count(*) AS votes, row_number() OVER (PARTITION BY basin_id ORDER BY count(*) DESC, code) AS k FROM lab WHERE code > 0 GROUP BY basin_id, code),
    ch AS MATERIALIZED (SELECT flow.pix, flow.down, root, up_count FROM flow JOIN up USING (pix) JOIN attr USING (pix) WHERE up_count >= {CHANNEL}),
    heads AS (SELECT pix FROM ch WHERE pix NOT IN (SELECT down FROM ch WHERE down IS NOT NULL)),
    donor AS MATERIALIZED (SELECT down, pix, up_count, row_number() OVER (PARTITION BY down ORDER BY up_count DESC, pix) AS k FROM flow JOIN up USING (pix) WHERE down IS NOT NULL),
    cells AS (SELECT "row" // 5 AS crow, col // 5 AS ccol, basin_id, count(*) AS n, sum(count(*)) OVER (PARTITION BY "row" // 5, col // 5) AS land FROM lab GROUP BY "row" // 5, col // 5, basin_id),
    view AS (SELECT crow, ccol, basin_id FROM (SELECT *, row_number() OVER (PARTITION BY crow, ccol ORDER BY n DESC, basin_id) AS k FROM cells WHERE basin_id <= 200) WHERE k = 1 AND land * 100 >= 25 * 25 AND n * 100 >= 25 * land)
"""
