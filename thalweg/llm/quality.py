"""Quality: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of each whole text are standardised and sent through random cosines that approximate a Gaussian kernel. The
normal equations are summed by partition and solved on the driver, whose share is FEATURES squared whatever the number
of rows. Two half models score each other's rows, and a non-decreasing curve through those scores (pooled adjacent
violators, over equal bins) turns a score into a probability. All labelled rows outside the held-out fold take part.

Null texts count as empty, with a score of their own. Null labels are no labels; of repeated labels the highest
holds. Without labels every score is 0.5. Null ids, repeated rows and further columns change nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, id_and_text, keep

COSINES = 256
RIDGE = 1e-3
BINS = 1000
STATISTICS = (
    "log_chars", "upper", "lower", "digit", "space", "high", "odd_sign", "bar", "mark", "stop", "entropy",
    "log_words", "word_length", "word_length_spread", "distinct", "top_word", "repeated_next", "capital_words",
    "log_lines", "line_length", "distinct_lines", "short_words",
)


def statistics(text: str) -> list[float]:
    raw = text.encode()
    n = max(1, len(raw))
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = c[c > 0] / n
    words = raw.split()
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    most = Counter(words)
    k = max(1, len(words))
    lines = raw.split(b"\n")
    of = lambda signs: float(c[list(signs)].sum()) / n
    return [
        float(np.log1p(len(raw))), c[65:91].sum() / n, c[97:123].sum() / n, c[48:58].sum() / n, c[[9, 10, 11, 12, 13, 32]].sum() / n, c[128:].sum() / n,
        of(b"#$%&*@^~<>{}[]\\_=+"), of(b"|"), of(b"!?"), of(b".,;:"), float(-(share * np.log(share)).sum()) if len(raw) else 0.0,
        float(np.log1p(len(words))), float(lengths.mean()), float(np.log1p(lengths.std())), len(most) / k, max(most.values(), default=0) / k,
        sum(map(bytes.__eq__, words, words[1:])) / k, sum(map(bytes.isupper, words)) / k,
        float(np.log1p(len(lines))), float(np.log1p(n / len(lines))), len(set(lines)) / len(lines), float((lengths <= 3).mean()),
    ]


def describe(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics of each row's whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([statistics(t.as_py()) for t in b.column(1)], schema.field(1).type)], schema=schema)

    return id_and_text(docs).mapInArrow(described, "doc_id long, x array<double>")


@dataclass
class Cosines:
    """Standardised statistics, a constant, and random cosines of them."""

    mean: np.ndarray
    spread: np.ndarray
    count: int = COSINES
    width: float = 4.0
    seed: int = 5

    def __post_init__(self) -> None:
        rng = np.random.default_rng(self.seed)
        self.w = rng.normal(size=(len(self.mean), self.count)) / self.width
        self.b = rng.uniform(0, 2 * np.pi, self.count)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return np.hstack([np.ones((len(z), 1)), z * 0.3, np.sqrt(2 / self.count) * 4 * np.cos(z @ self.w + self.b)])


def isotonic(score: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: centres and heights of the non-decreasing steps through ordered points."""
    blocks: list[list[float]] = []
    for s, m, w in zip(score, mean, weight, strict=True):
        blocks.append([s * w, m * w, w])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], b[:, 1] / b[:, 2]


@dataclass
class Model:
    cosines: Cosines | None = None
    weights: np.ndarray | None = None
    at: np.ndarray | None = None
    height: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.cosines is None or not len(x):
            return np.full(len(x), 0.5)
        raw = self.cosines(x) @ self.weights
        # A trace of the raw score keeps the order of rows that share a step.
        return np.clip(np.interp(raw, self.at, self.height) * 0.998 + 0.002 / (1 + np.exp(-np.clip(raw * 4 - 2, -30, 30))), 0, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, len(STATISTICS)))


def train(described: DataFrame, labels: DataFrame, label: str, fold: tuple[int, int] | None = None) -> Model:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    if fold:
        known = known.where(crc_mod("doc_id", fold[0]) != fold[1])
    rows = keep(described.join(known, "doc_id").select("doc_id", "x", "y", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half")), "quality-rows")
    k = len(STATISTICS)
    moments = rows.agg(F.count("*").alias("n"), *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(k)], *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(k)]).first()
    if moments["n"] < 4:
        return Model()
    cosines = Cosines(np.array([moments[f"m{i}"] for i in range(k)]), np.maximum([moments[f"s{i}"] for i in range(k)], 1e-6))
    width = 1 + k + COSINES

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, width, width + 1))
        seen = 0
        for b in batches:
            f, y, half = cosines(_matrix(b.column("x"))), b.column("y").to_numpy(), b.column("half").to_numpy()
            seen += len(y)
            for h in (0, 1):
                own = f[half == h]
                sums[h] += np.hstack([own.T @ own, (own.T @ y[half == h])[:, None]])
        if seen:
            at = np.arange(2 * width)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(list(sums.reshape(2 * width, -1)), pa.list_(pa.float64()))], names=["i", "v"])

    def added(t: pa.Table) -> pa.Table:
        return pa.table({"i": t["i"][:1], "v": pa.array([_matrix(t["v"].combine_chunks()).sum(axis=0)], pa.list_(pa.float64()))})

    sums = rows.select("x", "y", "half").mapInArrow(equations, "i int, v array<double>").groupBy("i").applyInArrow(added, "i int, v array<double>").toArrow().sort_by("i")
    halves = _matrix(sums["v"].combine_chunks()).reshape(2, width, width + 1)

    def solve(s: np.ndarray) -> np.ndarray:
        n = s[0, 0]
        return np.linalg.solve(s[:, :-1] + (RIDGE * n + 0.5) * np.diag(np.append(1e-6, np.ones(width - 1))), s[:, -1])

    weights, crossed = solve(halves.sum(axis=0)), [solve(halves[1]) if halves[1][0, 0] else None, solve(halves[0]) if halves[0][0, 0] else None]
    if any(w is None for w in crossed):
        crossed = [weights, weights]

    def crossed_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f, half = cosines(_matrix(b.column("x"))), b.column("half").to_numpy()
            s = np.where(half == 0, f @ crossed[0], f @ crossed[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.clip((s + 1) / 3 * BINS, 0, BINS - 1).astype(np.int32)), pa.array(s), b.column("y")], names=["bin", "s", "y"])

    bins = rows.select("x", "y", "half").mapInArrow(crossed_scores, "bin int, s double, y double").groupBy("bin").agg(F.avg("s").alias("s"), F.avg("y").alias("y"), F.count("*").cast("double").alias("n")).toArrow().sort_by("bin")
    at, height = isotonic(*(bins[c].to_numpy() for c in ("s", "y", "n")))
    return Model(cosines, weights, at, height)


def score(described: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each row."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(_matrix(b.column(1))), pa.float64())], names=["doc_id", "score"])

    return described.mapInArrow(scored, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", fold: tuple[int, int] | None = None) -> DataFrame:
    """doc_id and score of every row; statistics are computed once and kept in the shared folder."""
    described = keep(describe(docs), "quality-statistics")
    return score(described, train(described, labels, label, fold))
