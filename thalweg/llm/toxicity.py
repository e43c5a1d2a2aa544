"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over words and word beginnings is fitted in numpy from texts confirmed toxic and from unlabelled
texts of the whole corpus. The risk weighs both by the class prior: the positive part, plus the negative part of the
unlabelled texts less what positives add to it, which is kept from falling below zero. Every whole text is then scored
in one map over rows.

The fit reads a bounded sample, by hash of the id: the texts of at most MAX_POSITIVE confirmed ids and MAX_UNLABELLED
others, one row for each id (of repeated ids the least text); the class prior counts all labels. At most MAX_FEATURES
features get a weight, those that tell the sample's two kinds apart best: a bound of the fitted model, whatever the
input's size; every feature of a text that has a weight counts in its score. Null texts count as empty and score like
any text without known words. Very long texts are scored whole; in the fit each counts once, by the set of its
features. Null labels are no labels; of repeated labels of a document the highest holds. Without any confirmed text
every score is that of the bias alone, 6e-6. Null ids, repeated rows and further columns, whatever their names, change
nothing: each row gets one score from its text alone. A table without rows gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, free_name, id_and_text

MAX_POSITIVE = 3000
MAX_UNLABELLED = 9000
MAX_FEATURES = 4000
BEGINNINGS = (4, 5)
WORDS = re.compile(r"\w+").findall


@dataclass
class Weights:
    bias: float = -12.0
    of: dict[str, float] = field(default_factory=dict)

    def score(self, text: str) -> float:
        z = self.bias
        if self.of:
            known = self.of.keys()
            words = set(WORDS(text.lower()))
            found = words & known
            for n in BEGINNINGS:
                found |= {w[:n] + "*" for w in words if len(w) > n} & known
            z += sum(map(self.of.__getitem__, sorted(found)))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def features(words: set[str]) -> set[str]:
    return words.union(*({w[:n] + "*" for w in words if len(w) > n} for n in BEGINNINGS))


def hashed(features_: set[str]) -> np.ndarray:
    return np.sort(np.fromiter((xxhash.xxh64_intdigest(f) for f in features_), np.uint64, len(features_)))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 400, rate: float = 0.1, decay: float = 2e-4) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, feature hashes and their weights, from the feature hashes of each text.

    Full-batch non-negative risk with the logistic loss over the presence of features that positives prefer.
    """
    none = np.zeros(0, np.uint64)
    if not positive or not unlabelled or not 0 < prior < 1:
        return Weights.bias, none, np.zeros(0)
    n_p, n_u = len(positive), len(unlabelled)
    flat = np.concatenate(positive + unlabelled)
    row = np.repeat(np.arange(n_p + n_u), [*map(len, positive + unlabelled)])
    known, p_df = np.unique(np.concatenate(positive), return_counts=True)
    at = np.minimum(np.searchsorted(known, flat), max(0, len(known) - 1))
    there = known[at] == flat if len(known) else np.zeros(len(flat), bool)
    flat, row = at[there], row[there]
    u_df = np.bincount(flat[row >= n_p], minlength=len(known))
    z = (p_df / n_p - u_df / n_u) / np.sqrt((p_df + u_df + 1) / (n_p + n_u) * (1 / n_p + 1 / n_u))
    fit_ = (p_df >= max(2, 0.002 * n_p)) & ((p_df + 0.5) / n_p >= 2 * (u_df + 0.5) / n_u) & (z > 3.5)
    chosen = np.flatnonzero(fit_)
    chosen = chosen[np.argsort(-z[chosen], kind="stable")][:MAX_FEATURES]
    bias = float(np.log(prior / (1 - prior)))
    if not len(chosen):
        return bias, none, np.zeros(0)
    place = np.full(len(known), -1)
    place[chosen] = np.arange(len(chosen))
    c, r, n = place[flat], row, n_p + n_u
    c, r = c[c >= 0], r[c >= 0]
    w = np.zeros(len(chosen) + 1)
    w[-1] = bias
    m, v = np.zeros_like(w), np.zeros_like(w)
    share = np.concatenate([np.full(n_p, prior / n_p), np.full(n_u, 1 / n_u)])
    is_p = np.arange(n) < n_p
    for step in range(1, steps + 1):
        s = 1 / (1 + np.exp(-np.clip(np.bincount(r, w[c], n) + w[-1], -40, 40)))
        loss = np.where(is_p, -1, 1) * share * -np.log(np.maximum(1 - s, 1e-12))
        if loss.sum() < 0:  # the corrected negative risk must not be negative: climb back
            g = -np.where(is_p, -1, 1) * share * s
        else:
            g = share * np.where(is_p, -1, s)  # d/dz of: prior*l(+) on positives, l(-) on unlabelled, less prior*l(-) on positives
        grad = np.append(np.bincount(c, g[r], len(chosen)), g.sum()) + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return float(w[-1]), known[chosen], w[:-1]


def train(docs: DataFrame, labels: DataFrame, fold: tuple[int, int] | None = None) -> Weights:
    """Weights from the documents and labels outside the fold (modulus, held-out remainder of crc32).

    The driver gathers the sample's feature hashes, eight bytes each, and the texts of the features that were chosen.
    """
    text = id_and_text(docs)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = text.select("doc_id").where("doc_id is not null")
    if fold:
        known, ids = known.where(crc_mod("doc_id", fold[0]) != fold[1]), ids.where(crc_mod("doc_id", fold[0]) != fold[1])
    n, toxic = known.agg(F.count("*"), F.sum("toxic")).first()
    if not n or not toxic:
        return Weights()
    some = lambda df, most: df.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    positive = some(known.where("toxic = 1"), MAX_POSITIVE).withColumn("kind", F.lit(1))
    chosen = positive.unionByName(some(ids, MAX_UNLABELLED).withColumn("kind", F.lit(0)))
    # Broadcast: MAX_POSITIVE + MAX_UNLABELLED rows at most.
    taken = text.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))  # one row an id
    sample = taken.join(F.broadcast(chosen), "doc_id").select("kind", "text")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([hashed(features(set(WORDS(x.as_py().lower())))).tobytes() for x in b.column(1)], pa.binary())], names=["kind", "h"])

    got = sample.mapInArrow(hashes, "kind int, h binary").toArrow().combine_chunks().sort_by([("kind", "descending"), ("h", "ascending")])  # the same fit whatever order the rows come in
    kinds = got["kind"].to_numpy()
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in got["h"]]
    n_p = int((kinds == 1).sum())
    bias, names, weights = fit(sets[:n_p], sets[n_p:], prior=toxic / n)
    if not len(names):
        return Weights(bias)
    by_hash = dict(zip(names.tolist(), weights.tolist(), strict=True))

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = set()
        for b in batches:
            for x in b.column(0):
                found |= {f for f in features(set(WORDS(x.as_py().lower()))) if xxhash.xxh64_intdigest(f) in by_hash}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["f"])

    spelling = text.join(F.broadcast(positive), "doc_id").select("text").mapInArrow(spelled, "f string").distinct().collect()  # MAX_FEATURES rows at most
    return Weights(bias, {r["f"]: by_hash[xxhash.xxh64_intdigest(r["f"])] for r in spelling})


def score(docs: DataFrame, weights: Weights) -> DataFrame:
    """doc_id and score of each row, from its whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([weights.score(x.as_py()) for x in b.column(1)], pa.float64())], schema=schema)

    return id_and_text(docs).mapInArrow(scored, "doc_id long, score double")


def without_toxic(docs: DataFrame, weights: Weights, threshold: float = 0.7) -> DataFrame:
    """The rows, with all their columns, that score under the threshold."""
    flag = F.pandas_udf(lambda texts: texts.fillna("").map(weights.score), "double")
    flag = flag.asNondeterministic()  # evaluated once a row
    mark = free_name(docs, "_thalweg_toxic")
    return docs.withColumn(mark, flag(F.col("text"))).where(F.col(mark) < threshold).drop(mark)
