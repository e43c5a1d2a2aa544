"""Round trips of sources, the rules of parameters, polygons, colours and tilings."""

import json
import struct

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from thalweg.functions import conventions as cv
from thalweg.operators import attributes, basins, flow, tiles, views
from thalweg.sources import geotiff, tables

TABLE = StructType([StructField("basin_id", LongType()), StructField("area", DoubleType())])


def test_conventions():
    assert cv.convention("taudem").to_ours() == {1: 1, 8: 2, 7: 4, 6: 8, 5: 16, 4: 32, 3: 64, 2: 128}
    assert cv.convention("esri", nodata=247).nodata == 247
    assert cv.convention("custom", "E=10,SE=11,S=12,SW=13,W=14,NW=15,N=16,NE=17", nodata=0).codes == tuple(range(10, 18))
    for bad in (dict(name="none"), dict(name="custom", codes="E=1"), dict(name="esri", sink=255), dict(name="grass", codes="E=7"), dict(name="esri", codes="X=3"), dict(name="merit", mouth=70000)):
        with pytest.raises(ValueError):
            cv.convention(**bad)


def test_capacities_and_areas():
    assert [cv.top_blocks(n) for n in (3600, 1200)] == [160, 1400]
    assert [cv.capacity_blocks(t, 3600) for t in ("2^31", "2^30", "2^32", "160deg2", "7")] == [160, 80, 320, 160, 7]
    for bad in ("2^19", "2^20", "x", "0"):
        with pytest.raises(ValueError):
            cv.capacity_blocks(bad, 3600)
    assert cv.least_basin_km2(0.01) == 0.000025 and cv.least_basin_km2(5.566) == 7.7451 and cv.area_text(0.000025) == "2.5e-05"


def test_delimited(spark, tmp_path):
    at = str(tmp_path / "t")
    tables.write_delimited(spark.createDataFrame([(1, -0.0), (2, 2.5), (3, -0.0001)], TABLE), at, {"area": "%.2f"})
    assert sorted(map(tuple, tables.read_delimited(spark, at, TABLE).collect())) == [(1, 0.0), (2, 2.5), (3, 0.0)]
    assert tables.read_delimited(spark, at, TABLE, ["area"]).columns == ["area"]
    with pytest.raises(ValueError):
        tables.read_delimited(spark, at, StructType([StructField("x", LongType())]))


def test_published_ids_and_maps(spark, tmp_path):
    outlets = spark.createDataFrame([(1, 2), (3, 4)], "row long, col long")
    (tmp_path / "p.csv").write_text("outlet_row,outlet_col,basin_id\n1,2,7\n3,4,5\n")
    assert sorted(map(tuple, tables.published_ids(spark, str(tmp_path / "p.csv"), outlets).collect())) == [(1, 2, 7), (3, 4, 5)]
    (tmp_path / "q.csv").write_text("row,col,id\n1,2,7\n3,5,5\n")
    with pytest.raises(ValueError):
        tables.published_ids(spark, str(tmp_path / "q.csv"), outlets)
    tables.write_map(spark.createDataFrame([(1, 9)], "basin_id long, value long"), str(tmp_path / "m"), "af", "region", "k")
    assert tables.read_map(spark, str(tmp_path / "m"), "af", "region", "k").collect() == [(1, 9)]
    with pytest.raises(ValueError):
        tables.read_map(spark, str(tmp_path / "m"), "af", "region", "other")


def test_geotiff(spark, tmp_path):
    rng = np.random.default_rng(3)
    grid = rng.integers(0, 255, (23, 31)).astype(np.uint8)
    px = spark.createDataFrame([(r, c, int(grid[r, c])) for r in range(23) for c in range(31)], "row long, col long, v long")
    made = geotiff.tiles(px, "v", 16, "uint8", 255, 10.0, 20.0, 0.5).collect()
    assert len(made) == 4
    for t in made:
        (tmp_path / f"{t.trow}_{t.tcol}.tif").write_bytes(t.content)
    back = np.full((23, 31), -1)
    for path, r, c, v in geotiff.read(spark, str(tmp_path / "*.tif"), skip=255).collect():
        tr, tc = map(int, path.rsplit("/", 1)[1][:-4].split("_"))
        back[tr * 16 + r, tc * 16 + c] = v
    assert (back == grid).all()
    with pytest.raises(ValueError):
        next(geotiff.decode(b"no picture"))


def _wkb(data: bytes) -> list[list[list[tuple[float, float]]]]:
    at, parts = 9, []
    for _ in range(struct.unpack_from("<I", data, 5)[0]):
        rings, at = [], at + 9
        for _ in range(struct.unpack_from("<I", data, at - 4)[0]):
            n = struct.unpack_from("<I", data, at)[0]
            rings.append([struct.unpack_from("<dd", data, at + 4 + 16 * i) for i in range(n)])
            at += 4 + 16 * n
        parts.append(rings)
    assert at == len(data)
    return parts


def test_polygons_and_geoparquet(spark, tmp_path):
    # 1: a ring with a hole that holds 2, and a cell that touches it at a corner only.
    ring = [(r, c, 1) for r in range(3) for c in range(3) if (r, c) != (1, 1)]
    made = views.polygons(spark.createDataFrame([*ring, (1, 1, 2), (3, 3, 1)], "crow long, ccol long, basin_id long"), 0.0, 0.0, 1.0)
    got = {r.basin_id: r for r in made.collect()}
    assert (got[1].cells, got[1].parts, got[2].cells, got[2].parts) == (9, 2, 1, 1)
    assert sorted(len(rings) for rings in _wkb(got[1].geometry)) == [1, 2]
    assert all(r[0] == r[-1] and len(r) == 5 for rings in _wkb(got[1].geometry) for r in rings)
    at = str(tmp_path / "g")
    tables.write_geoparquet(made, at, "MultiPolygon")
    files = list((tmp_path / "g").glob("*.parquet"))
    assert json.loads(pq.read_schema(files[0]).metadata[b"geo"])["primary_column"] == "geometry"
    assert spark.read.parquet(at).count() == 2
    with pytest.raises(ValueError):
        tables.write_geoparquet(made, at, "MultiPolygon")


def test_colours(spark):
    rng = np.random.default_rng(1)
    cells = spark.createDataFrame([(r, c, int(rng.integers(0, 25))) for r in range(20) for c in range(20)], "crow long, ccol long, basin_id long")
    pairs = basins.adjacent(cells)
    coloured = views.colours(cells, pairs)
    assert coloured.count() == 25 and views.clashes(coloured, pairs).count() == 0


def _forest(spark, n=400, cols=20):
    rng = np.random.default_rng(5)
    z = rng.random(n)
    rows = [(i, i // cols, i % cols, float(z[i]) - 0.2 * (i // cols)) for i in range(n) if i % 23]
    f = flow.steepest_descent(spark.createDataFrame(rows, "pix long, row long, col long, z double"))
    return f.withColumn("one", F.lit(1)).withColumn("cm", F.when(F.col("code").isin(1, 4, 16, 64), 10).otherwise(14))


@pytest.mark.parametrize("side", [1, 3, 20])
def test_any_tiling_gives_the_same(spark, side):
    f = _forest(spark)
    tile = lambda c: F.expr(f"{c} div 20 div {side} * 100 + {c} % 20 div {side}")
    got = tiles.fold(f.withColumn("tile", tile("pix")).withColumn("down_tile", tile("down")), {"len": "cm"}, {"n": "one"}, "len")
    want = flow.fold(f, {"len": "cm"}, {"n": "one"}, "len")
    cols = sorted(want.columns)
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_cycles_and_leaving_flow_are_refused(spark):
    schema = "pix long, down long, tile long, down_tile long, one long"
    for rows in ([(1, 2, 0, 0, 1), (2, 1, 0, 0, 1)], [(1, 2, 0, 1, 1), (2, 1, 1, 0, 1)], [(1, 9, 0, 1, 1), (2, None, 1, None, 1)], [(1, 9, 0, 7, 1)]):
        with pytest.raises(Exception, match="cycle|leaves the land"):
            tiles.fold(spark.createDataFrame(rows, schema), {}, {"n": "one"}).collect()


def test_attributes_are_registered_once():
    a = attributes.Attribute("t", lambda: F.col("n"), above={"n": "one"})
    attributes.register(a)
    attributes.register(a)
    with pytest.raises(ValueError):
        attributes.register(attributes.Attribute("t", lambda: F.lit(1)))


def test_mosaic_refuses_overlap(spark):
    a = spark.createDataFrame([(0, 0, 1)], "row long, col long, value long")
    assert views.mosaic([a, a.withColumn("col", F.lit(1).cast("long"))]).count() == 2
    with pytest.raises(ValueError):
        views.mosaic([a, a])
