import math

import pytest
from pyspark.sql import functions as F

from thalweg.functions import earth
from thalweg.operators import basins, cutting, flow
from thalweg.plans import grid


def test_cycle_is_refused(spark):
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "pix long, down long")
    with pytest.raises(ValueError):
        flow.fold(ring, {}, {})


# Counts with what they round to, and cells' shares with their winner, as published data have them.
def test_upstream_counts_round_half_up(spark):
    cases = [(1.0, 1), (1.4, 1), (1.5, 2), (1.6, 2), (2.5, 3), (0.9, 0), (0.0, 0), (-1.0, 0), (float("nan"), 0), (9e18, 0), (1.79e308, 0), (7.0, 7)]
    rows = spark.createDataFrame(cases, "v double, want long").select(earth.upstream_count_of(F.col("v")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in rows)


@pytest.mark.parametrize("ids,counts,want", [((3, 1), (60, 30), 3), ((5, 2), (45, 45), 2), ((4, 1, 9), (54, 26, 20), 4), ((9, 2, 3), (50, 30, 20), 2), ((1,), (24,), None), ((7,), (25,), 7), ((8, 1, 6), (30, 30, 40), 6), ((10, 2), (76, 24), None)])
def test_cell_winner(spark, ids, counts, want):
    flat = [i for i, n in zip(ids, counts) for _ in range(n)]
    cell = spark.createDataFrame([(k // 10, k % 10, i) for k, i in enumerate(flat)], "row long, col long, basin_id long")
    got = [r.basin_id for r in basins.fold_view(cell, 10, 8).collect()]
    assert got == ([] if want is None else [want])


def test_hilbert_visits_neighbours(spark):
    cells = spark.createDataFrame([(r, c) for r in range(8) for c in range(8)], "r long, c long")
    order = sorted((x.hilbert, x.r, x.c) for x in earth.with_hilbert(cells, "r", "c", 3).collect())
    assert [h for h, _, _ in order] == list(range(64))
    assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(order, order[1:]))


def test_view_holds_every_basin_of_a_quarter_cell(spark):
    # 300 basins of one 4 x 4 cell each: sixteen pixels, four and three.
    sizes = [16] * 250 + [4] * 30 + [3] * 20
    pixels = spark.createDataFrame([(4 * k + j // 4, j % 4, k + 1) for k, n in enumerate(sizes) for j in range(n)], "row long, col long, basin_id long")
    ids = basins.ids_of_view(pixels.groupBy("basin_id").agg(F.count("*").alias("grid_count")), 4)
    assert ids == 280
    assert sorted(r.basin_id for r in basins.fold_view(pixels, 4, ids).collect()) == list(range(1, 281))


def test_products_follow_the_table(spark, tmp_path):
    def write(rows):
        spark.createDataFrame([(k, float(k % 13)) for k in range(1, rows)], "o_orderkey long, o_totalprice double").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/orders.parquet")
        return sum(k % 29 != 0 for k in range(1, rows))

    for rows in (300, 900):
        land = write(rows)
        assert grid.links(spark, str(tmp_path)).count() == land == grid.attributes(spark, str(tmp_path)).count()


def test_distances_and_areas_of_the_earth(spark):
    def between(*at):
        return earth.distance_m(*[F.lit(float(v)) for v in at])

    degree = math.pi / 180 * 6378137  # of the equator
    steps = earth.step_lengths_m(F.lit(0), 0.5, 1.0)  # row 0 lies on the equator
    r = spark.range(1).select(between(0, 0, 0, 1).alias("east"), between(0, 179.5, 0, -179.5).alias("seam"), between(7, 3, 7, 3).alias("none"), between(59.5, 0, 60.5, 0).alias("north"), *[v.alias(k) for k, v in steps.items()]).first()
    assert r.none == 0 and r.east == pytest.approx(degree, rel=1e-4) and r.seam == pytest.approx(r.east, rel=1e-9) and r.ew == pytest.approx(r.east, rel=1e-9)
    assert r.north == pytest.approx(111412.9, rel=1e-4)  # the meridian's arc about 60 degrees on WGS84
    assert r.n == pytest.approx(r.s, rel=1e-9) and r.nd == pytest.approx(r.sd, rel=1e-9) and r.ew < r.nd < r.n + r.ew
    lat = F.col("id") - 89.5
    exact, series = spark.range(180).agg(F.sum(earth.pixel_area_m2(lat, 1.0, 1.0)), F.sum(earth.pixel_area_m2_merit(lat, 1.0, 1.0))).first()
    assert 360 * exact == pytest.approx(5.10065622e14, rel=1e-6)  # the area of the WGS84 ellipsoid
    assert series == pytest.approx(exact, rel=5e-3)


def test_regions_stand_by_unit(spark):
    rows = spark.createDataFrame([(r,) for r in (13, 1299, 12, 1201, 1300)], "region long").orderBy(earth.region_order(F.col("region"))).collect()
    assert [r.region for r in rows] == [12, 1201, 1299, 13, 1300]

def test_pieces_are_numbered_without_rounds_of_jobs(spark):
    # Two basins of a chain and a fork, and one piece whose lower one is not there.
    rows = [(5, 11, None), (5, 12, 11), (5, 13, 12), (5, 14, 13), (5, 15, 13), (9, 1, None), (9, 4, 1), (9, 2, 1), (9, 3, 2), (12, 7, 8)]
    spark.sparkContext.setJobGroup("numbered", "")
    got = {tuple(r) for r in cutting.levels_of(spark.createDataFrame(rows, "root long, code long, next_code long")).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("numbered"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {(5, 14, 1, 1), (5, 15, 1, 2), (5, 13, 2, 3), (5, 12, 3, 4), (5, 11, 4, 5), (9, 3, 1, 1), (9, 4, 1, 2), (9, 2, 2, 3), (9, 1, 3, 4), (12, 7, 1, 1)}
    assert jobs <= 4  # a fold took dozens
    with pytest.raises(Exception, match="cycle"):
        cutting.levels_of(spark.createDataFrame([(1, 1, 2), (1, 2, 1)], "root long, code long, next_code long")).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)  # basins that batches cut
    try:
        many = [(b, c, c // 2 or None) for b in range(40) for c in range(1, b + 2)]
        found = cutting.levels_of(spark.createDataFrame(many, "root long, code long, next_code long")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all((r.level == 1) == (2 * r.code > r.root + 1) for r in found)
    assert sorted((r.root, r.number) for r in found) == sorted((b, c) for b, c, _ in many)
