"""Document fingerprints by consistent weighted sampling, in DataFrame functions alone.

A text is a set of words weighted by how often they occur. For every word and each of SAMPLES hash functions two gamma
variates and a uniform one are drawn from hashes; they give each weight a level and a value, and the word of least value
is the sample. Two texts share a sample with the probability of their generalised Jaccard similarity (the sum of the
lesser over the sum of the greater weights), so the share of equal samples estimates it. Equal sample and level have
equal least values and others differ, so the least values themselves serve as the signature: plain minima of doubles.

Documents are dealt once, by ranges of the id; neighbours, word counts and minima all use that one distribution, in
which no key but (range, row) occurs.

Null texts count as empty. Texts without words share a signature of zeros: likeness 1 to each other, 0 to all others.
Null ids come first; rows of one id are ordered by text, and each row has its own neighbour. A single row is its own
neighbour. Empty tables give no rows; further columns change nothing.
"""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, keep

SAMPLES = 64
#: Words that can't come below this over the text's number of words are passed over; that no word of a text does has
#: a chance of exp(-LIKELY) a sample, and such texts are done again with all words.
LIKELY = 20.0
BLANK = r"[\x20\x09-\x0D]+"


def _unit(bits: Column, low: int) -> Column:
    return (F.shiftrightunsigned(bits, low).bitwiseAND(F.lit((1 << 21) - 1).cast("long")).cast("double") + 0.5) / F.lit(float(1 << 21))


def draws(h: Column, k: Column) -> tuple[Column, Column, Column]:
    """Of word hash h and sample k: u, p and beta. -log(u) is Gamma(2, 1), and so is -log(p); beta is uniform."""
    a, b = F.xxhash64(h, k), F.xxhash64(k, h)
    return _unit(a, 0) * _unit(a, 21), _unit(a, 42) * _unit(b, 0), _unit(b, 21)


def may_reach(u: Column, p: Column, beta: Column, weight: Column, reach: Column) -> Column:
    """Whether the exponential of a word's value can lie below reach over its weight; no logarithms are taken.

    The value is at least log(-log(p)) - log(weight) - r, and with weight 1 it is log(-log(p)) - r * (1 - beta). Here
    -log(p) >= 2 (1 - p) / (1 + p), and exp(-r * a) = u ** a >= u / (a + (1 - a) u).
    """
    a = F.when(weight <= 1, 1 - beta).otherwise(1.0)
    return 2 * (1 - p) * u < reach * (1 + p) * (a + (1 - a) * u)


def value(r: Column, log_c: Column, beta: Column, log_weight: Column) -> Column:
    return log_c - r * (F.floor(log_weight / r + beta).cast("double") - beta + 1)


def _ranges(rows: DataFrame) -> Column:
    """The range of a row's id, ascending: some for each shuffle partition, of about as many rows each, whatever the ids.

    The bounds are the ids' approximate quantiles; where they lie changes no result. Nulls make range -1. Rows of one id
    share a range.
    """
    count = 8 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("doc_id", [k / count for k in range(1, count)], 4 * count)).first()[0]
    if not cuts:
        return F.when(F.col("doc_id").isNull(), -1).otherwise(0)
    bounds = sorted(set(cuts))
    step = math.isqrt(len(bounds)) + 1
    listed = lambda values: F.array(*[F.lit(c) for c in values]).cast("array<long>")
    passed = lambda values: F.size(F.filter(values, lambda c: c <= F.col("doc_id")))
    # Of every step-th bound first, then of those up to the next of them.
    coarse = passed(listed(bounds[step - 1 :: step])) * step
    return F.when(F.col("doc_id").isNull(), -1).otherwise(coarse + passed(F.slice(listed(bounds), coarse + 1, step)))


def _followed_by(first: DataFrame, value_: str) -> DataFrame:
    """Of each range, the value that the first row of the next range has; the last range is followed by the first.

    first: range and value, one row a range, of which there are a bounded number.
    """
    order = Window.orderBy("range")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return first.select("range", F.coalesce(F.lead(value_).over(order), F.first(value_).over(every)).alias(value_))


def edited(docs: DataFrame) -> DataFrame:
    """range, row (within it), doc_id, n_chars, text and edited_text: the last quarter replaced by the start of the next document."""
    rows = id_and_text(docs)
    rows = rows.select(_ranges(rows).alias("range"), "doc_id", "text")
    least = rows.groupBy("range").agg(F.min("doc_id").alias("least_id"))
    # Broadcast: a row for each range, 8 for each shuffle partition.
    heads = rows.alias("a").join(F.broadcast(least).alias("b"), (F.col("a.range") == F.col("b.range")) & F.col("doc_id").eqNullSafe(F.col("least_id"))).groupBy("a.range").agg(F.min("text").alias("text"))
    marks = _followed_by(heads, "text").select("range", F.lit(None).cast("long").alias("doc_id"), "text", F.lit(1).alias("mark"))
    both = rows.withColumn("mark", F.lit(0)).unionByName(marks)
    order = Window.partitionBy("range").orderBy("mark", "doc_id", "text")
    near = both.select("*", F.row_number().over(order).alias("row"), F.lead("text").over(order).alias("next_text")).where("mark = 0")
    n = F.length("text")
    part = F.floor(n / 4).cast("int")
    return near.select("range", "row", "doc_id", n.cast("long").alias("n_chars"), "text", F.concat(F.substring(F.col("text"), F.lit(1), n - part), F.substring(F.col("next_text"), F.lit(1), part)).alias("edited_text"))


def signatures(pairs: DataFrame, samples: int = SAMPLES, likely: float | None = LIKELY) -> DataFrame:
    """range, row, doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and sure, from edited().

    A word whose value in a sample exceeds log(likely / words of the text) whatever its logarithms are gets none. The
    least value, if no greater than that, is the same without it; else the row is not sure. likely null: all words.
    """
    key = ["range", "row", "doc_id", "n_chars", "size0", "size1"]
    parts = pairs.select("range", "row", "doc_id", "n_chars", "edited_text", F.split("text", BLANK).alias("parts0"), F.split("edited_text", BLANK).alias("parts1"))
    parts = parts.select("*", *[F.size(F.array_remove(f"parts{k}", "")).alias(f"size{k}") for k in (0, 1)])
    # The digest rides along as four words of 64 bits, tagged 1 to 4, so that the texts are read and dealt only once.
    quarters = F.array(*[F.substring(F.sha2("edited_text", 256), 16 * k + 1, 16) for k in range(4)])
    kinds = parts.select(*key, F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), x.alias("parts")) for k, x in enumerate((F.col("parts0"), F.col("parts1"), quarters))])).alias("k"))
    words = kinds.select(*key, F.col("k.kind").alias("kind"), F.posexplode("k.parts").alias("at", "word"))
    is_digest = F.col("kind") == 2
    counted = (
        words.select(*key, "kind", "word", F.when(is_digest, F.col("at") + 1).otherwise(0).alias("tag"))
        .select(*key, "kind", "tag", F.when(is_digest, F.conv("word", 16, -10).cast("long")).otherwise(F.xxhash64("word")).alias("h"), (F.col("word") != "").alias("full"))
        .groupBy(*key, "tag", "h")
        .agg(*[F.sum(F.when((F.col("kind") == k) & F.col("full"), 1).otherwise(0)).alias(f"w{k}") for k in (0, 1)])
    )
    weight = lambda k: F.when((F.col("tag") == 0) & (F.col(f"w{k}") > 0), F.log(F.col(f"w{k}").cast("double"))).alias(f"l{k}")
    groups = F.when(F.col("tag") == 0, F.array(*map(F.lit, range(samples)))).otherwise(F.array(F.lit(0)))
    share = lambda k: F.col(f"w{k}") / F.greatest(F.col(f"size{k}"), F.lit(1))
    reach = F.greatest(share(0), share(1)) * ((likely or 1.0) * (1 + 1e-9))
    spread = counted.select(*key, "tag", "h", weight(0), weight(1), F.greatest("w0", "w1").alias("most"), reach.alias("reach"), F.explode(groups).alias("g"))
    drawn = spread.select("*", *[c.alias(n) for n, c in zip(("u", "p", "beta"), draws(F.col("h"), F.col("g")), strict=True)])
    if likely is not None:
        drawn = drawn.where((F.col("tag") > 0) | may_reach(*map(F.col, ("u", "p", "beta", "most", "reach"))))
    drawn = drawn.select(*key, "tag", "h", "g", "l0", "l1", "beta", (-F.log("u")).alias("r"), F.log(-F.log("p")).alias("c"))
    least = drawn.groupBy(*key, "g").agg(
        *[F.min(value(F.col("r"), F.col("c"), F.col("beta"), F.col(f"l{k}"))).alias(f"m{k}") for k in (0, 1)],
        *[F.max(F.when(F.col("tag") == q, F.col("h"))).alias(f"q{q}") for q in range(1, 5)],
    )
    short = lambda c: F.lpad(F.lower(F.hex(F.coalesce(F.when(c.isNotNull(), F.xxhash64(c).bitwiseAND(F.lit(0xFFFFFFFF))), F.lit(0)))), 8, "0")
    equal = F.col("m0").eqNullSafe(F.col("m1")).cast("int")
    within = lambda k: (F.col(f"size{k}") == 0) | F.coalesce(F.col(f"m{k}") <= F.log((likely or 1.0) / F.greatest(F.col(f"size{k}"), F.lit(1))), F.lit(False))
    said = least.select(*key, "g", equal.alias("equal"), (within(0) & within(1)).cast("int").alias("sure"), *[short(F.col(f"m{k}")).alias(f"s{k}") for k in (0, 1)], *[f"q{q}" for q in range(1, 5)])
    said_of = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", f"s{k}"))), lambda x: x[f"s{k}"]), "")
    joined = said.groupBy(*key).agg(F.sum("equal").alias("equal"), F.sum("sure").alias("sure"), said_of(0).alias("fingerprint"), said_of(1).alias("edited_fingerprint"), *[F.max(f"q{q}").alias(f"q{q}") for q in range(1, 5)])
    digest = F.concat(*[F.lpad(F.lower(F.hex(f"q{q}")), 16, "0") for q in range(1, 5)])
    blank = F.col("size0") + F.col("size1") == 0  # no word of theirs came here
    zeros = F.lit("0" * 8 * samples)
    prints = [F.when(blank, zeros).otherwise(F.col(c)).alias(c) for c in ("fingerprint", "edited_fingerprint")]
    near = (F.when(blank, samples).otherwise(F.col("equal")) / samples).alias("near_edited")
    return joined.select(*key[:4], digest.alias("edited_sha256"), *prints, near, (F.lit(likely is None) | blank | (F.col("sure") == samples)).alias("sure"))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of equal samples of two fingerprints."""
    at = F.array(*[F.lit(8 * k + 1) for k in range(samples)])
    return F.aggregate(at, F.lit(0), lambda n, i: n + (F.substring(a, i, F.lit(8)) == F.substring(b, i, F.lit(8))).cast("int")) / samples


def sure_signatures(pairs: DataFrame, samples: int = SAMPLES, likely: float = LIKELY) -> DataFrame:
    """signatures() of all rows, those that are not sure anew from all their words."""
    rows = keep(signatures(pairs, samples, likely), "signatures")
    unsure = rows.where(~F.col("sure")).select("range", "row")
    if unsure.isEmpty():
        return rows.drop("sure")
    again = keep(signatures(pairs.join(unsure, ["range", "row"], "left_semi"), samples, None), "signatures")
    return rows.where("sure").unionByName(again).drop("sure")


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each row."""
    rows = sure_signatures(edited(docs), samples)
    marks = _followed_by(rows.where("row = 1").select("range", "fingerprint"), "fingerprint").withColumn("mark", F.lit(1))
    order = Window.partitionBy("range").orderBy("mark", "row")
    near = rows.withColumn("mark", F.lit(0)).unionByName(marks, allowMissingColumns=True).select("*", F.lead("fingerprint").over(order).alias("next")).where("mark = 0")
    return near.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", likeness(F.col("fingerprint"), F.col("next"), samples).alias("near_next"))
