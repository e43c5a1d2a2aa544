"""Queries of the Pfafstetter cut over the test grid: basins of LARGE pixels or more, two levels."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.operators import cutting, tiles
from thalweg.plans import grid
from thalweg.plans.registry import query
from thalweg.sources.shared import cut

LARGE, LEVELS = 60, 2


def _sql() -> str:
    out = f""", big AS (SELECT root FROM ranked WHERE grid_count >= {LARGE}),
    net AS MATERIALIZED (SELECT flow.pix, flow."row", flow.col, root, up_count FROM flow JOIN up USING (pix) JOIN attr USING (pix) WHERE root IN (SELECT root FROM big)),
    minor AS MATERIALIZED (SELECT pix FROM donor WHERE k > 1),
    o0 AS (SELECT root, CAST(0 AS BIGINT) AS code, root AS pix FROM big)"""
    for i in range(1, LEVELS + 1):
        out += f""",
    f{i} AS MATERIALIZED (SELECT w.src, arg_min(o.root, w.k) AS root, arg_min(o.code, w.k) AS code, arg_min(o.pix, w.k) AS outlet, min(w.k) AS hops FROM w JOIN o{i - 1} o ON o.pix = w.cur GROUP BY w.src),
    t{i} AS MATERIALIZED (SELECT f.src AS pix, f.root, f.code, f.outlet, f.hops, count(m.pix) AS turns FROM f{i} f LEFT JOIN w ON w.src = f.src AND w.k < f.hops LEFT JOIN minor m ON m.pix = w.cur GROUP BY ALL),
    j{i} AS (SELECT t.*, net."row", net.col, up_count, row_number() OVER (PARTITION BY outlet ORDER BY up_count DESC, hops, "row", col) AS r FROM t{i} t JOIN minor USING (pix) JOIN net USING (pix) WHERE turns = 1),
    c{i} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY outlet ORDER BY hops, up_count DESC, "row", col) AS k, lead(hops) OVER (PARTITION BY outlet ORDER BY hops, up_count DESC, "row", col) AS next_hops FROM j{i} WHERE r <= 4),
    o{i} AS MATERIALIZED (SELECT root, code * 10 + 1 AS code, pix FROM o{i - 1} UNION ALL SELECT root, code * 10 + 2 * k, pix FROM c{i}
        UNION ALL SELECT c.root, c.code * 10 + 2 * c.k + 1, t.pix FROM c{i} c JOIN t{i} t ON t.outlet = c.outlet AND t.turns = 0 AND t.hops = c.hops WHERE next_hops IS NULL OR next_hops <> c.hops)"""
    return out + f""",
    lp AS MATERIALIZED (SELECT w.src AS pix, arg_min(o.root, w.k) AS root, arg_min(o.code, w.k) AS code FROM w JOIN o{LEVELS} o ON o.pix = w.cur GROUP BY w.src),
    own AS MATERIALIZED (SELECT o.root, o.code, o.pix, up_count, n.code AS next_code FROM o{LEVELS} o JOIN flow USING (pix) JOIN up USING (pix) LEFT JOIN lp n ON n.pix = flow.down)
    """


_SQL = _sql()


def _network(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = grid.attributes(spark, sf_dir)
    large = a.where(F.col("pix") == F.col("root")).where(F.col("up_count") >= LARGE).select("root")
    return grid.tiled(a.join(large, "root").select("pix", "row", "col", "down", "up_count", "root"))


@grid.product
def _pieces(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    net = cut(_network(spark, sf_dir))
    flow = net.drop("root")
    made = cutting.pieces(flow, net.where("pix = root").select("root", "pix"), LEVELS, tiles.fold)
    return made, cut(cutting.labels(flow, made, tiles.fold)), flow


@query(_SQL + f"SELECT root, code, pix FROM o{LEVELS}")
def pfafstetter_pieces(spark, sf_dir):
    return _pieces(spark, sf_dir)[0]


@query(_SQL + "SELECT pix, root, code FROM lp")
def piece_labels(spark, sf_dir):
    return _pieces(spark, sf_dir)[1]


@query(_SQL + """SELECT own.root, own.code, own.pix, own.next_code, own.up_count - coalesce(come, 0) AS expected, labelled FROM own
    LEFT JOIN (SELECT root, next_code AS code, CAST(sum(up_count) AS BIGINT) AS come FROM own WHERE next_code IS NOT NULL GROUP BY ALL) USING (root, code) LEFT JOIN (SELECT root, code, count(*) AS labelled FROM lp GROUP BY ALL) USING (root, code)""")
def piece_table(spark, sf_dir):
    return cutting.table(*_pieces(spark, sf_dir))


@query(_SQL + """, lv AS (SELECT root, code, code AS cur, next_code, 0 AS d FROM own UNION ALL SELECT lv.root, lv.code, own.code, own.next_code, d + 1 FROM lv JOIN own ON own.root = lv.root AND own.code = lv.next_code),
    levels AS (SELECT root, cur AS code, max(d) + 1 AS level FROM lv GROUP BY root, cur) SELECT root, code, level, row_number() OVER (PARTITION BY root ORDER BY level, code) AS number FROM levels""")
def region_numbering(spark, sf_dir):
    return cutting.levels_of(cutting.table(*_pieces(spark, sf_dir)))


@query(_SQL + "SELECT root, grid_count AS pixels FROM ranked WHERE (row_max - row_min) * (col_max - col_min) > 400")
def basins_over_capacity(spark, sf_dir):
    from thalweg.operators import basins

    window = (F.col("row_max") - F.col("row_min")) * (F.col("col_max") - F.col("col_min"))
    return basins.ranked(grid.attributes(spark, sf_dir)).where(window > 400).select(F.col("outlet_pix").alias("root"), F.col("grid_count").alias("pixels"))
