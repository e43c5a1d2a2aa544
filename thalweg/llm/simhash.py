"""SimHash fingerprints, and near-duplicate groups by a self-join of binary tries.

Equal fingerprints are grouped first, so that every fingerprint enters the join once. With a budget of four differing
bits, some block of bits of any linked pair is equal: fingerprints are dealt by the bits of each choice of equal
blocks, and those that agree there form a binary trie over their bits. Pairs of its nodes are walked together: an
unequal step adds an error, a pair past the budget is dropped, and a pair of nodes that one group holds already needs no
further look. A trie gives one link from each fingerprint to the least of its group there, never all pairs, and the
links' connected components are the result.

More fingerprints mean more, and so longer, dealing bits: from 13 bits at five copies a fingerprint to 32 at seventy.

Null texts count as empty: no words, fingerprint zero, linked like any other. Null ids take part; a group's id is its
smallest id, null only where no row has one. Repeated rows and further columns, whatever their names, change nothing.
Very long texts are read whole. A table without rows gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, id_and_text, keep, own_columns, quoted
from .components import stars

SHINGLE = 4
SEED = 42
ERRORS = 4
#: Node pairs walked at once, and pairs of fingerprints compared without going further down.
FRONTIER = 1 << 17
LEAF = 64


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    words = text.encode().lower().split()  # bytes: only A-Z are lowered, only ASCII white space splits
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        hashes = map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)), repeat(SEED))
    h = np.fromiter(hashes, np.uint64, max(1, len(words) - shingle + 1))
    ones = np.add.reduce(np.unpackbits(h.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64), axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint of each row's whole text as a signed long."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return id_and_text(docs).mapInArrow(mapped, "doc_id long, fp long")


class Trie:
    """Binary tries over sorted fingerprints, one for each range of `bounds`, joined with themselves."""

    def __init__(self, fp: np.ndarray, bounds: np.ndarray, errors: int) -> None:
        self.fp, self.bounds, self.errors = fp, bounds, errors
        self.group = np.arange(len(fp))
        self.changed = True

    def roots(self, at: np.ndarray) -> np.ndarray:
        g = self.group[at]
        while (up := self.group[g]).tobytes() != g.tobytes():
            g = up
        return g

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.roots(i), self.roots(j)
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.group, np.maximum(a, b), np.minimum(a, b))
            self.changed = True

    def _turn(self, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
        """Where the bit, unset at first, becomes set within each sorted range."""
        lo, hi = lo.copy(), hi.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            one = (self.fp[np.minimum(mid, len(self.fp) - 1)] >> np.uint64(bit)) & np.uint64(1) == 1
            hi = np.where(open_ & one, mid, hi)
            lo = np.where(open_ & ~one, mid + 1, lo)
        return lo

    def _compare(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> None:
        """All pairs between small ranges [a, b) and [c, d)."""
        width = d - c
        count = (b - a) * width
        ends = np.cumsum(count)
        k = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count)
        w = np.repeat(width, count)
        i, j = np.repeat(a, count) + k // w, np.repeat(c, count) + k % w
        near = (i < j) & (np.bitwise_count(self.fp[i] ^ self.fp[j]) <= self.errors)
        self.link(i[near], j[near])

    def _one_group(self) -> None:
        if self.changed:
            self.group = self.roots(np.arange(len(self.fp)))
            self.runs = np.concatenate([[0], np.cumsum(self.group[1:] != self.group[:-1])])
            self.changed = False

    def join(self) -> np.ndarray:
        """Least index of the group of each fingerprint."""
        lo, hi = self.bounds[:-1], self.bounds[1:]
        stack = [(63, lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
        while stack:
            bit, a, b, c, d, err = stack.pop()
            if len(a) * 16 >= len(self.fp) or len(a) >= FRONTIER // 4:
                self._one_group()
                done = (self.runs[b - 1] == self.runs[a]) & (self.runs[d - 1] == self.runs[c]) & (self.group[a] == self.group[c])
                a, b, c, d, err = (x[~done] for x in (a, b, c, d, err))
            small = (b - a) * (d - c) <= LEAF
            if small.any():
                self._compare(*(x[small] for x in (a, b, c, d)))
                a, b, c, d, err = (x[~small] for x in (a, b, c, d, err))
            if not len(a):
                continue
            if bit < 0:  # ranges of equal fingerprints
                self.link(np.repeat(a, d - c), np.concatenate([np.arange(x, y) for x, y in zip(c, d, strict=True)]))
                self.link(a, c)
                continue
            m, n = self._turn(a, b, bit), self._turn(c, d, bit)
            same = a == c
            children = [
                (a, m, c, n, err, np.ones(len(a), bool)),
                (m, b, n, d, err, np.ones(len(a), bool)),
                (a, m, n, d, err + 1, np.ones(len(a), bool)),
                (m, b, c, n, err + 1, ~same),
            ]
            a, b, c, d, err, fit = (np.concatenate(x) for x in zip(*children, strict=True))
            fit &= (err <= self.errors) & (a < b) & (c < d) & ~((a == c) & (b - a == 1))
            a, b, c, d, err = (x[fit] for x in (a, b, c, d, err))
            order = np.argsort(-err, kind="stable")  # the nearest are walked first, and their groups spare the others
            for k in range(0, len(order), FRONTIER):
                own = order[k : k + FRONTIER]
                stack.append((bit - 1, *(x[own] for x in (a, b, c, d, err))))
        self.changed = True
        self._one_group()
        return self.group


def choices(rows: int, errors: int = ERRORS) -> list[list[tuple[int, int]]]:
    """The choices of blocks (lowest bit, bits) of which some must be equal, and enough bits to deal so many rows."""
    blocks = errors + 1
    while blocks < errors + 4 and (64 * (blocks - errors)) // blocks < np.log2(max(rows, 2)) - 9:
        blocks += 1
    at = [64 * k // blocks for k in range(blocks + 1)]
    return [[(at[k], at[k + 1] - at[k]) for k in chosen] for chosen in combinations(range(blocks), blocks - errors)]


def links(distinct: DataFrame, rows: int, errors: int = ERRORS) -> DataFrame:
    """(u, v): each of the distinct fingerprints fp to the least one that it is grouped with in some trie."""
    keys = []
    for k, chosen in enumerate(choices(rows, errors)):
        key = F.lit(k).cast("long")
        for low, bits in chosen:
            key = F.shiftleft(key, bits).bitwiseOR(F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << bits) - 1).cast("long")))
        keys.append(key)
    dealt = distinct.select(F.explode(F.array(*keys)).alias("key"), "fp")
    # Unsigned order within a key, as the trie needs it.
    dealt = dealt.repartition("key").sortWithinPartitions("key", F.col("fp") < 0, "fp")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(keys: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            bounds = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            group = Trie(fp.view(np.uint64), bounds, errors).join()
            at = np.flatnonzero(group != np.arange(len(group)))
            return pa.RecordBatch.from_arrays([pa.array(fp[at]), pa.array(fp[group[at]])], names=["u", "v"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            size += len(held[-1][0])
            if size >= 1 << 16 and held[0][0][0] != held[-1][0][-1]:  # joined only where a key ends
                keys, fp = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1
                yield linked(keys[:cut], fp[:cut])
                held, size = [(keys[cut:], fp[cut:])], len(keys) - cut
        if size:
            yield linked(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return dealt.mapInArrow(joined, "u long, v long")


def _grouped(docs: DataFrame, errors: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """doc_id and fp of each row; and of each distinct fp its group's root fingerprint and smallest id."""
    marked = keep(fingerprints(docs, shingle), "fingerprints")
    distinct = keep(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    star = stars(links(distinct, distinct.count(), errors))
    rooted = distinct.join(star.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return marked, rooted.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, errors: int = ERRORS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp and component_id of each row."""
    marked, named = _grouped(docs, errors, shingle)
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, errors: int = ERRORS, shingle: int = SHINGLE) -> DataFrame:
    """One row of each group, with all its columns: that of the group's smallest id; of its rows that share that id, the least text.

    Groups without any id keep their least text. Groups are told apart by their root fingerprint, never by an id.
    """
    marked, named = _grouped(docs, errors, shingle)
    named = keep(named, "named")
    own_id = F.col("doc_id").eqNullSafe(F.col("component_id"))
    # Rows are counted over all groups: an id that is the smallest of one may be in another too.
    kept = keep(marked.join(named, "fp").groupBy("doc_id").agg(F.count("*").alias("rows"), F.bool_or(own_id).alias("first")).where("first"), "kept")
    own = own_columns(docs)
    id_, times, fp, root, whole = (free_name(docs, f"_thalweg_{n}") for n in ("id", "rows", "fp", "root", "row"))
    # The ids that stay grow with the corpus: they are merged with the rows at every size, never broadcast.
    ids = kept.select(F.col("doc_id").alias(id_), F.col("rows").alias(times)).hint("merge")
    rows = docs.join(ids, F.col("doc_id").cast("long") == F.col(id_))
    alone = rows.where(F.col(times) == 1).select(own)
    if not kept.where("rows > 1 or doc_id is null").limit(1).count():
        return alone
    # Ids that several rows share, and rows without one: the least row of each group, by the fingerprint of its text.
    shared = rows.where(F.col(times) > 1).select(own).unionByName(docs.where(F.col("doc_id").cast("long").isNull()))
    printed = F.pandas_udf(lambda t: t.fillna("").map(lambda x: np.uint64(fingerprint(x, shingle)).astype(np.int64)), "long")
    roots = named.select(F.col("fp").alias(fp), F.col("root").alias(root), F.col("component_id").alias(id_))
    again = shared.withColumn(fp, printed(F.col("text"))).join(roots, fp).where(F.col("doc_id").cast("long").eqNullSafe(F.col(id_)))
    order = F.struct(F.coalesce("text", F.lit("")), *[F.col(quoted(c)) for c, kind in docs.dtypes if "map<" not in kind])
    least = again.groupBy(root).agg(F.min_by(F.struct(*own), order).alias(whole))
    return alone.unionByName(least.select(*[F.col(whole)[c].alias(c) for c in docs.columns]))
