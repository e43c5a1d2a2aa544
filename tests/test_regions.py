"""Rules of groups and regions on small fixtures, where the test grid has no such case."""

from pyspark.sql import functions as F

from thalweg.operators import regions


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_enclosed_and_nested_join(spark):
    owners = spark.createDataFrame([(r, c, 2 if (r, c) == (2, 2) else 1) for r in range(5) for c in range(5)] + [(0, 5, 3)], "crow int, ccol int, owner int")
    assert rows(regions.enclosed(owners)) == [(2, 1)]
    windows = spark.createDataFrame([(1, 0, 5, 0, 5), (2, 2, 3, 2, 3), (3, 0, 1, 5, 6)], "grp int, row_min int, row_max int, col_min int, col_max int")
    pairs = regions.touching(owners.withColumnRenamed("owner", "grp"))
    assert rows(pairs) == [(1, 2), (1, 3)]
    # What encloses joins whatever the capacity; without that, only what fits.
    assert rows(regions.cheapest_join(windows, pairs, regions.enclosed(owners), 1)) == [(1, 2, -1)]
    assert rows(regions.cheapest_join(windows.where("grp <> 2"), pairs, regions.enclosed(owners), 30)) == [(1, 3, 4)]
    assert rows(regions.cheapest_join(windows.where("grp <> 2"), pairs, regions.enclosed(owners), 29)) == []


def test_a_hole_at_the_sea_is_not_enclosed(spark):
    owners = spark.createDataFrame([(r, c, 2 if (r, c) == (1, 1) else 1) for r in range(3) for c in range(3) if (r, c) != (0, 0)], "crow int, ccol int, owner int")
    assert rows(regions.enclosed(owners)) == []


def test_rules_count_nulls_as_broken(spark):
    t = spark.createDataFrame([(1, 0, 8, 0, 8, 8, 8), (0, 0, 8, 0, 8, 8, 8), (2, 8, 8, 0, 8, 0, 8), (3, 0, 8, 0, 8, 7, None)], "region_id int, row_min int, row_max int, col_min int, col_max int, nrow int, ncol int")
    assert rows(regions.row_faults(t, "region_id", regions.region_rules())) == [(0, 1), (2, 2), (3, 3)]
    g = spark.createDataFrame([(7, 3, 1, 7, 1, 9, 0, 1, 0, 1, 8, 8, 64), (8, 4, 1, 7, 0, 9, 0, 0, 0, 1, 8, 8, 63)], "group_id int, group_level int, group_kind int, level_code int, basin_count int, land_grid_count int, window_row_min int, window_row_max int, window_col_min int, window_col_max int, window_nrow int, window_ncol int, window_grid_count int")
    assert rows(regions.row_faults(g, "group_id", regions.group_rules())) == [(8, 2), (8, 3), (8, 4), (8, 5)]


def test_islands_keep_build_ids_when_a_unit_is_full(spark):
    few = spark.range(99).select((200001 + F.col("id")).alias("region"), F.lit(2).alias("level1"), F.col("id").alias("land"))
    assert rows(regions.island_ids(few))[-1] == (200099, 20201)
    more = spark.range(100).select((200001 + F.col("id")).alias("region"), F.lit(2).alias("level1"), F.col("id").alias("land"))
    assert all(a == b for a, b in rows(regions.island_ids(more)))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "crow int, ccol int, grp int, land long")
    assert rows(regions.touching(empty)) == rows(regions.cell_owner(empty)) == []
    windows = spark.createDataFrame([], "grp int, row_min int, row_max int, col_min int, col_max int")
    assert rows(regions.cheapest_join(windows, regions.touching(empty), regions.enclosed(regions.cell_owner(empty)), 9)) == []
    assert rows(regions.island_ids(spark.createDataFrame([], "region int, level1 int, land long"))) == []


def test_gap_across_the_seam(spark):
    at = spark.createDataFrame([(1, 98), (1, 99), (1, 0), (1, 1), (2, 40), (2, 60)], "basin_id int, col int")
    assert rows(regions.seam_gaps(at, 100)) == [(1, 98, 96), (2, 40, 79)]
