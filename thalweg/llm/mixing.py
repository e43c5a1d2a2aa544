"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source's target is its share of all words by weight, at most CAP times what it holds; what a source cannot take
goes to the others by weight. Targets that exceed a source give whole epochs first. What then is left of the budget is
filled by documents in the order of exponential keys divided by their quality weights, up to the document at which the
running sum of sizes comes nearest the budget.

The running sum is taken over slices of the key within a source: sizes are summed by slice, slices that lie wholly
within the budget are taken whole, and only the slice that the budget ends in is sorted. So a source that holds most
rows needs no task that sees them all. What is found is a place in that order for each source; every row is then held
against its source's place where it lies, and texts are never shuffled.

Keys come from a hash of the id, so reruns agree. Null texts count as empty, with size 0; a null source is a source of
its own, the last; null ids share one key and are then ordered by their text's hash; repeated rows are each taken by
themselves. Empty tables give no rows. Further columns change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, id_and_text, keep

WEIGHTS = (5, 2, 1)
CAP = 3
SLICES = 4096
#: Up to so many bytes the table of sources is broadcast.
BROADCAST_BYTES = 16 << 20


def size_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def quality_of(text: Column) -> Column:
    """A quality weight from the whole text: 1 without digits and markup signs, towards 1/2 with nothing else."""
    return F.lit(1.0) - F.lit(0.5) * (F.length(text) - F.length(F.translate(text, "0123456789#$%&*|!", ""))) / F.greatest(F.length(text), F.lit(1))


def unit(doc_id: Column) -> Column:
    """A number in (0, 1) from 52 bits of the id's MD5."""
    return (F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def measured(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, source, size, key and tie of each row, and the columns `more`."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(text).alias("size"), quality_of(text).alias("quality"), F.xxhash64(text).alias("tie"), *more)
    given = rows.columns[5:]
    return rows.select("doc_id", "source", "size", (-F.log(unit(F.col("doc_id"))) / F.col("quality")).alias("key"), "tie", *given)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size and target; sizes: source and source_size, one row a source.

    Sources stop at the cap in the order of cap over weight, so the level that the others share is found by prefix sums
    in that order: it is the first at which no further source is above its cap.
    """
    ranked = sizes.select("source", "source_size", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).alias("rank"))
    weighed = ranked.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long").alias("weight"), (F.col("source_size") * cap).alias("most"))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = weighed.select(
        "*",
        (F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0))).alias("words_left"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weight_left"),
    )
    # The first source in this order that stays within its cap fixes the level for itself and all after it.
    within = left.select("*", (F.col("words_left") * F.col("weight") <= F.col("most") * F.col("weight_left")).alias("within"))
    found = within.select("*", F.min(F.when(F.col("within"), F.struct(F.col("most") / F.col("weight"), F.coalesce(F.col("source"), F.lit("")), "words_left", "weight_left"))).over(every).alias("first"))
    level = F.col("first.words_left").cast("double") * F.col("weight") / F.col("first.weight_left")
    return found.select("source", "source_size", F.when(F.col("first").isNull(), F.col("most").cast("double")).otherwise(F.least(F.col("most").cast("double"), level)).alias("target"))


def slice_of(key: Column) -> Column:
    return F.floor(F.lit(float(SLICES)) * key / (1 + key)).cast("int")


def cuts(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row a source: _source, source_size, target, epochs, and where the fractional selection ends.

    `last` is the place (slice, key, id, tie) of the last row taken beyond the epochs, null where there is none;
    `equal_rows` rows stand at that place and `equal_taken` of them are taken. rows: as measured() gives them.
    """
    slice_ = slice_of(F.col("key"))
    by_slice = keep(rows.groupBy("source", slice_.alias("slice")).agg(F.sum("size").alias("words")), "slices")
    goal = targets(by_slice.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap)
    goal = goal.select("*", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(1).cast("long").alias("epochs"))
    goal = keep(goal.select(F.col("source").alias("_source"), "source_size", "target", "epochs", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("budget")), "targets")
    along = Window.partitionBy("source").orderBy("slice")
    started = by_slice.select("source", "slice", (F.sum("words").over(along) - F.col("words")).alias("start"), "words")
    # The slice that the budget ends in: the first whose end reaches it.
    met = started.join(goal, started["source"].eqNullSafe(goal["_source"]))
    ends = keep(met.where("budget > 0 and start < budget and start + words >= budget").select(F.col("source").alias("_at"), F.col("slice").alias("cut"), "start", "budget"), "ends")
    inner = small_side(ends, "_at")
    inside = rows.withColumn("slice", slice_).join(inner, rows["source"].eqNullSafe(F.col("_at")) & (F.col("slice") == F.col("cut")))
    run = F.col("start") + F.sum("size").over(Window.partitionBy("_at").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0))
    # A document that crosses the budget is taken if that leaves the sum nearer to it.
    taken = (run - F.col("size") / 2 <= F.col("budget")).cast("long")
    places = inside.select("_at", "key", "doc_id", "tie", taken.alias("taken")).groupBy("_at", "key", "doc_id", "tie").agg(F.count("*").alias("rows"), F.sum("taken").alias("taken"))
    last = places.where("taken > 0").groupBy("_at").agg(F.max(F.struct("key", "doc_id", "tie", "rows", "taken")).alias("m"))
    # Where no row of that slice is taken, the place stands before them all: null sorts first.
    found = ends.select("_at", "cut").join(last.withColumnRenamed("_at", "_of"), F.col("_at").eqNullSafe(F.col("_of")), "left")
    found = found.select("_at", F.struct(F.col("cut").alias("slice"), F.col("m.key").alias("key"), F.col("m.doc_id").alias("doc_id"), F.col("m.tie").alias("tie")).alias("last"), F.coalesce("m.rows", F.lit(0)).alias("equal_rows"), F.coalesce("m.taken", F.lit(0)).alias("equal_taken"))
    return keep(goal.drop("budget").join(found, F.col("_source").eqNullSafe(F.col("_at")), "left").drop("_at"), "cuts")


def small_side(of_sources: DataFrame, name: str) -> DataFrame:
    """A written table of one row a source: broadcast if its measured bytes are few, merged otherwise."""
    rows, names = of_sources.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(name)), F.lit(0))).first()
    return F.broadcast(of_sources) if rows * 128 + names <= BROADCAST_BYTES else of_sources.hint("merge")


def counted(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows with source_size, target and times, the number of copies that the mix takes.

    rows: any columns beside source, key, doc_id and tie; plan: as cuts() gives it. A row's place alone decides, so no
    row is shuffled but those at the very place of the cut, and they only where some of several equal rows are taken.
    """
    met = rows.join(small_side(plan, "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    met = met.withColumn("_place", F.struct(slice_of(F.col("key")).alias("slice"), F.col("key"), F.col("doc_id"), F.col("tie")))
    extra = F.when(F.col("last").isNull(), 0).otherwise((F.col("_place") <= F.col("last")).cast("int"))
    times = (F.col("epochs") + F.col("extra")).alias("times")
    out = [*rows.columns, "source_size", "target", times]
    if not plan.where("equal_taken < equal_rows").limit(1).count():
        return met.withColumn("extra", extra).select(out)
    split = F.coalesce((F.col("equal_taken") < F.col("equal_rows")) & (F.col("_place") == F.col("last")), F.lit(False))
    nth = F.row_number().over(Window.partitionBy("source").orderBy("tie"))
    some = met.where(split).withColumn("extra", (nth <= F.col("equal_taken")).cast("int"))
    return met.where(~split).withColumn("extra", extra).select(out).unionByName(some.select(out))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """doc_id, source, size, source_size, target, times (copies of the row that the mix takes) and taken."""
    rows = keep(measured(docs), "measured")
    return counted(rows, cuts(rows, weights, cap)).select("doc_id", "source", "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The rows of documents as often as the mix takes them, with all their columns, whatever their names.

    The rows are read twice, once for their measures and once to be taken, and their texts are not shuffled.
    """
    plan = cuts(keep(measured(docs), "measured"), weights, cap)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    taken = counted(measured(docs, whole).select("row", "source", "key", "doc_id", "tie"), plan).where("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy")).select("row.*")
