"""Tables as text separated by spaces, as Parquet, and as pixels by tile; with the checks made on reading."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType


def read_delimited(spark: SparkSession, path: str, schema: StructType, columns: list[str] | None = None) -> DataFrame:
    """A table with a header line, fields parted by any number of spaces or tabs; refuses another header.

    A field that does not fit its type stops the query, as does a line with too few or too many fields.
    """
    names = schema.fieldNames()
    lines = spark.read.text(path).select(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("f")).where(F.size("f") > 0)
    header = F.array(*map(F.lit, names))
    if lines.where(F.col("f") == header).limit(1).count() == 0:
        raise ValueError(f"{path}: the header is not {' '.join(names)}")
    whole = F.when(F.size("f") == len(names), F.col("f")).otherwise(F.raise_error(F.concat(F.lit("not as many fields as columns: "), F.array_join("f", " "))))
    rows = lines.where(F.col("f") != header).where(F.col("f") != F.array(F.lit(""))).select(whole.alias("f"))
    return rows.select(*[F.col("f")[i].cast(t.dataType).alias(t.name) for i, t in enumerate(schema) if columns is None or t.name in columns])


def write_delimited(df: DataFrame, path: str, formats: dict[str, str] | None = None) -> None:
    """The same form, each part with its header; printf formats by column, and no negative zero."""
    formats = formats or {}

    def text(field):
        c = F.col(field.name)
        if isinstance(field.dataType, (DoubleType, FloatType)):
            c = F.when(c == 0, F.lit(0.0)).otherwise(c)
        shown = F.format_string(formats[field.name], c) if field.name in formats else c.cast("string")
        return F.regexp_replace(shown, r"^-(0(\.0*)?)$", "$1").alias(field.name)

    df.select(*[text(f) for f in df.schema]).write.option("sep", " ").option("header", True).option("quote", "\u0000").option("nullValue", "-").csv(path)


#: The names by which published tables call a row, a column and an id.
PUBLISHED = (("row", "col", "basin_id"), ("outlet_row", "outlet_col", "basin_id"), ("row", "col", "id"))


def published_ids(spark: SparkSession, path: str, outlets: DataFrame) -> DataFrame:
    """(row, col, basin_id) from a published table (Parquet, or text by comma or space), which must name each outlet once."""
    if path.endswith(".parquet"):
        table = spark.read.parquet(path)
    else:
        comma = "," in spark.read.text(path).first()[0]
        table = spark.read.option("header", True).option("sep", "," if comma else " ").csv(path)
    names = next((n for n in PUBLISHED if set(n) <= set(table.columns)), None)
    if names is None:
        raise ValueError(f"{path}: no row, column and id among {', '.join(table.columns)}")
    ids = table.select(*[F.col(n).cast("long").alias(to) for n, to in zip(names, PUBLISHED[0])])
    met = outlets.select("row", "col").join(ids, ["row", "col"], "full").groupBy("row", "col").agg(F.count("basin_id").alias("n"))
    twice = ids.groupBy("basin_id").count().where("count > 1")
    gone = ids.join(outlets.select("row", "col"), ["row", "col"], "left_anti")
    if met.where("n <> 1").limit(1).count() or twice.limit(1).count() or gone.limit(1).count():
        raise ValueError(f"{path}: outlets and ids do not pair one to one")
    return ids


def write_map(values: DataFrame, path: str, run: str, kind: str, key: str) -> None:
    """(basin_id, value), kept under what it holds for."""
    values.select(F.lit(run).alias("run"), F.lit(kind).alias("kind"), F.lit(key).alias("key"), "basin_id", "value").write.partitionBy("run", "kind", "key").parquet(path)


def read_map(spark: SparkSession, path: str, run: str, kind: str, key: str) -> DataFrame:
    """Refuses a map made for another run, kind or key."""
    found = spark.read.parquet(path).where((F.col("run") == run) & (F.col("kind") == kind) & (F.col("key") == key))
    if not found.limit(1).count():
        raise ValueError(f"{path}: no {kind} of {run} for {key}")
    return found.select("basin_id", "value")


def write_pixels(pixels: DataFrame, path: str, side: int) -> None:
    """Pixels (row, col, ...) by strips of tiles, each tile's together and in order, for pruning by place."""
    at = pixels.withColumns({"trow": F.expr(f"row div {side}"), "tcol": F.expr(f"col div {side}")})
    at.repartition("trow", "tcol").sortWithinPartitions("trow", "tcol", "row", "col").write.partitionBy("trow").parquet(path)


def write_geoparquet(df: DataFrame, path: str, geometry_type: str, crs: dict | None = None) -> None:
    """df with its column geometry (ISO WKB or null) as GeoParquet 1.1, a file a partition: zstd, 65536 rows a row group.

    Spark's writer can't put the geo entry into a footer, so each task writes its file, under a name of its own attempt
    that becomes the part's in the end: a task that is run again replaces its own part. A partition is held whole by its
    task. path is on a file system that all executors see, and must be empty.
    """
    column = {"encoding": "WKB", "geometry_types": [geometry_type]} | ({"crs": crs} if crs else {})
    geo = json.dumps({"version": "1.1.0", "primary_column": "geometry", "columns": {"geometry": column}}, separators=(",", ":"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = list(batches)
        fs, at = (pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path))
        fs.create_dir(at)
        if held:
            t, task = pa.Table.from_batches(held), TaskContext.get()
            own = f"{at}/_part-{task.partitionId():05d}-{task.taskAttemptId()}"
            with fs.open_output_stream(own) as out:
                pq.write_table(t.replace_schema_metadata({"geo": geo}), out, compression="zstd", row_group_size=65536)
            fs.move(own, f"{at}/part-{task.partitionId():05d}.parquet")
        yield pa.RecordBatch.from_pydict({"rows": pa.array([sum(b.num_rows for b in held)], pa.int64())})

    if df.sparkSession._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).exists(df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)):
        raise ValueError(f"{path} exists")
    df.mapInArrow(write, "rows long").agg(F.sum("rows")).collect()
