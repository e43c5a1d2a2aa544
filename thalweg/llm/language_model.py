"""Language-model scores by interpolated modified Kneser-Ney over n-grams, trigrams unless another order is asked.

Counting: blocks of documents give their distinct n-grams of the highest order with counts, dealt by a hash of the words
between the first and the last. So all n-grams with the same words but the last, and all with the same but the first,
meet in one dealing, which writes the two highest orders' tables of the model without another shuffle and sends on only
what the third highest needs. Where the words between make up more of a sample than an even dealing holds, their n-grams
are dealt by all words but the first, so no frequent word gathers in one task, and what is known of their contexts is
sent on too and added up there. Which words those are changes the dealing alone, no count. Orders below the third highest
are merged one by one: for each n-gram without its first word, how often it occurs and after how many different words;
for each without its last word, how many different words follow it once, twice and more often. Scoring is a map over
documents whose workers memory-map the tables, wherever the model is larger than memory, and look up each block's
distinct n-grams by part.

A table holds its n-grams' hashes in order: the leading bits by the place (starts of short buckets, as what they differ
from even ones), the next 40 bits in five bytes; and one byte that numbers the commonest rows of counts, the others in
full. What dealings send is compressed: words once, places among them by the frequency of the words, as differences.

Below the highest order counts are of different words before, but n-grams that begin at a document's start, which
nothing precedes, count as they occur. A token's context never holds more than one start.

The model lives in the folder that all executors share; where that is no mounted file system, a worker maps local
copies of its files. The driver gathers a few sums for each dealing, no words.

Hashes of words and of counted n-grams have 64 bits: two that share one count as the same. An n-gram that was not counted
is taken for one that was with a chance of some 4 in 2^40 a look-up. Null texts count as empty: the end token
alone. Null ids, repeated rows and further columns change nothing; with no row to learn from every token has
probability 1 over (V + 1) = 1.
"""

from __future__ import annotations

import atexit
import itertools
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, shared_path

START, END = (np.uint64(xxhash.xxh64_intdigest(x)) for x in (b"  ", b" "))  # no word has white space
ORDER = 3
#: Tokens that a worker takes at once, to score and to count.
BLOCK, COUNTED = 1_300_000, 3_000_000
APART = 255  # the number of rows of counts that are kept in full
#: The counts of a context that one word follows once. Most do, and are left out: the highest order's contexts are the
#: grams of the order before it that end no document.
ONCE = np.array([1, 1, 0, 0])
#: One document in so many says which n-grams are dealt finer.
SAMPLE = 32


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _mix(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A hash of the pair, in order."""
    x = v * np.uint64(0x9E3779B97F4A7C15) ^ (w + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _blocks(batches: Iterator[pa.RecordBatch], most: int = BLOCK) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Ids, numbers of tokens and token hashes (end tokens included) of some documents at a time."""
    hashes, ids, parts, held = _Hashes(), [], [], 0
    for b in batches:
        for doc_id, text in zip(b.column(0), b.column(1), strict=True):
            words = text.as_py().encode().lower().split()
            ids.append(doc_id.as_py())
            parts.append(np.append(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)), END))
            held += len(words) + 1
            if held >= most:
                yield ids, np.array([*map(len, parts)]), np.concatenate(parts)
                ids, parts, held = [], [], 0
    if ids:
        yield ids, np.array([*map(len, parts)]), np.concatenate(parts)


def _grams(tokens: np.ndarray, lengths: np.ndarray, order: int) -> np.ndarray:
    """A column for each token: the tokens before it, starts where its document has none, and itself last."""
    place = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return np.stack([np.where(place >= k, np.roll(tokens, k), START) for k in range(order - 1, -1, -1)])


def _hash(grams: np.ndarray) -> np.ndarray:
    h = grams[0]
    for w in grams[1:]:
        h = _mix(h, w)
    return h


def _top(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def _runs(sorted_: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, np.int64)


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers in as few bytes as hold their greatest, these by place, compressed."""
    heads, planes = [len(arrays)], []
    for a in arrays:
        width = (int(a.max()).bit_length() + 7) // 8 if len(a) else 0
        heads += [len(a), width]
        planes.append(np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    return np.array(heads, "<u8").tobytes() + pa.compress(b"".join(planes), "zstd", asbytes=True)


def _unpacked(cell: pa.Scalar) -> list[np.ndarray]:
    buffer = cell.as_buffer()
    k = int(np.frombuffer(buffer, "<u8", 1)[0])
    heads = np.frombuffer(buffer, "<u8", 2 * k, 8).reshape(k, 2).astype(np.int64).tolist()
    body = np.frombuffer(pa.decompress(buffer.slice(8 + 16 * k), sum(n * w for n, w in heads), "zstd"), np.uint8)
    out, at = [], 0
    for n, width in heads:
        a = np.zeros((n, 8), np.uint8)
        a[:, :width] = body[at : at + n * width].reshape(width, n).T
        out.append(a.view("<u8").ravel())
        at += n * width
    return out


def _packed_grams(grams: np.ndarray, *counts: np.ndarray) -> bytes:
    """Distinct grams and their counts, in an order of their own."""
    words, at, often = np.unique(grams, return_inverse=True, return_counts=True)
    by = np.lexsort((words, -often))  # many occur once: their hashes ascend
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    at = rank[at.reshape(grams.shape)]
    first, second = (1, 0) if len(at) > 2 else (0, len(at) - 1)  # the word between, by which grams are dealt, varies least
    order = np.argsort(at[first] * len(by) + at[second])
    at = at[:, order]
    new = np.diff(at[first], prepend=-1) != 0
    steps = np.where(new, at[second], np.diff(at[second], prepend=0))
    rest = [at[k] for k in range(len(at)) if k not in (first, second)]
    words = words[by]
    return _packed(np.diff(words, prepend=np.uint64(0)), np.diff(at[first], prepend=0), *([steps] if second != first else []), *rest, *(c[order] for c in counts))


def _unpacked_grams(cell: pa.Scalar, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The grams of n words, and their counts."""
    steps, *columns = _unpacked(cell)
    words = np.cumsum(steps, dtype=np.uint64)
    columns = [c.astype(np.int64) for c in columns]
    first, second = (1, 0) if n > 2 else (0, n - 1)
    at = np.zeros((n, len(columns[0])), np.int64)
    at[first] = np.cumsum(columns[0])
    if n > 1:
        start = _runs(at[first])
        whole = np.cumsum(columns[1])
        at[second] = whole - np.repeat(whole[start] - columns[1][start], np.diff(np.append(start, len(whole))))
    for k, column in zip([k for k in range(n) if k not in (first, second)], columns[2:], strict=False):
        at[k] = column
    return words[at], columns[n:]


def _summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys in order, a place of each, and the values' sums."""
    order = np.argsort(key, kind="stable")
    at = _runs(key[order])
    return key[order[at]], order[at], [np.add.reduceat(v[order], at) if len(at) else np.zeros(0, np.int64) for v in values]


#: What dealings send on. kind 0: grams with raw counts and counts; kind 1: contexts (hashes, sums of counts, how many
#: words follow once, twice and more often); kind 2: contexts of the highest order; part -1: sums over an order.
MESSAGE = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("a", pa.binary())])
DDL = "part int, kind int, a binary"


def _sent(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(MESSAGE), MESSAGE, strict=True)], schema=MESSAGE)


def _by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each part that there is, and where."""
    if len(part) and part.max() < 1 << 16:
        part = part.astype(np.uint16)  # sorted by digits
    order = np.argsort(part, kind="stable")
    cuts = np.append(_runs(part[order]), len(part)).tolist()
    for a, b in itertools.pairwise(cuts):
        yield int(part[order[a]]), order[a:b]


def _dealt(grams: np.ndarray, part: np.ndarray, *counts: np.ndarray) -> Iterator[tuple]:
    """Messages of distinct grams; with one array of counts, it is of raw ones too."""
    for k, at in _by_part(part):
        yield k, 0, _packed_grams(grams[:, at], *(c[at] for c in counts))


def _contexts(kind: int, h: np.ndarray, sums: list[np.ndarray], bits: int) -> Iterator[tuple]:
    """Messages of contexts whose hashes are in order."""
    for k, at in _by_part(_top(h, bits)):
        yield k, kind, _packed(np.diff(h[at], prepend=np.uint64(0)), *(s[at] for s in sums))


def _after(h: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct contexts' hashes in order, a place of each, the sums of counts and how many grams occur once, twice and more often."""
    return _summed(h, count, *(x.astype(np.int64) for x in (count == 1, count == 2, count >= 3)))


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, and which of them each is."""
    found = pa.array(np.ascontiguousarray(values)).dictionary_encode()
    return found.dictionary.to_numpy(), found.indices.to_numpy()


def _padded(a: np.ndarray) -> bytes:
    b = np.ascontiguousarray(a).tobytes()
    return b + bytes(-len(b) % 8)


def _write(path: str, name: str, h: np.ndarray, columns: list[np.ndarray]) -> None:
    """A table of distinct hashes in order and their rows of counts, as one file."""
    n, rows = len(h), np.stack(columns, axis=1).astype(np.int64)
    bits = max(0, int(n // 2).bit_length() - 1)
    even = np.arange((1 << bits) + 1) * n >> bits
    start = np.searchsorted(_top(h, bits), np.arange((1 << bits) + 1)) - even
    start = start.astype(next(d for d in ("<i2", "<i4", "<i8") if np.abs(start).max() <= np.iinfo(d).max))
    low = h << np.uint64(bits) >> np.uint64(24)
    mixed = np.zeros(n, np.uint64)  # rows apart by a hash, and compared with what it stands for
    for column in columns:
        mixed = _mix(mixed, column.astype(np.uint64))
    _, back = _numbered(mixed)
    often = np.bincount(back)
    where = np.empty(len(often), np.int64)
    where[back] = np.arange(n)  # any place of each
    common = np.argsort(-often, kind="stable")[:APART]
    number = np.full(len(often), APART)
    number[common] = np.arange(len(common))
    code = number[back].astype(np.uint8)
    common = rows[where[common]]
    if len(common):
        code[(common[np.minimum(code, len(common) - 1)] != rows).any(axis=1)] = APART
    apart = np.flatnonzero(code == APART)
    rest = rows[apart]
    rest = rest.astype(next(d for d in ("<u2", "<u4", "<u8") if not len(rest) or int(rest.max()) <= np.iinfo(d).max))
    head = np.array([n, bits, start.itemsize, len(common), len(apart), rest.itemsize, len(columns), 0], "<i8")
    where_to, root = fs.FileSystem.from_uri(path)
    where_to.create_dir(root)
    own = f"{root}/{name}.{uuid.uuid4().hex}"  # no two attempts share a name, on whatever hosts
    with where_to.open_output_stream(own) as out:
        out.write(b"".join(map(_padded, (head, (low >> np.uint64(8)).astype("<u4"), low.astype(np.uint8), start, code, common.astype("<i8"), apart.astype("<u4"), rest))))
    where_to.move(own, f"{root}/{name}")  # a task that runs again writes the same bytes


def _write_contexts(path: str, name: str, h: np.ndarray, counts: list[np.ndarray]) -> None:
    more = np.any([c != once for c, once in zip(counts, ONCE, strict=True)], axis=0)
    _write(path, name, h[more], [c[more] for c in counts])


_MAPPED: dict[str, str] = {}


def _local(path: str) -> str:
    """The model's folder as a mounted path: itself, or a copy for this worker that goes with it."""
    where, root = fs.FileSystem.from_uri(path)
    if isinstance(where, fs.LocalFileSystem):
        return root
    if path not in _MAPPED:
        _MAPPED[path] = tempfile.mkdtemp(prefix="model-")
        fs.copy_files(root, _MAPPED[path], source_filesystem=where, destination_filesystem=fs.LocalFileSystem())
        atexit.register(shutil.rmtree, _MAPPED[path], True)
    return _MAPPED[path]


class _Table:
    """A table of the model, memory-mapped."""

    def __init__(self, file: str) -> None:
        self.n = 0
        if not os.path.exists(file):
            return
        whole, at = np.asarray(np.memmap(file, np.uint8, "r")), 64
        self.n, self.bits, start, common, apart, rest, self.columns, _ = whole[:64].view("<i8").tolist()

        def section(dtype: str, *shape: int) -> np.ndarray:
            nonlocal at
            size = int(np.prod(shape)) * np.dtype(dtype).itemsize
            a, at = whole[at : at + size], at + size + -size % 8
            return a.view(dtype).reshape(shape)

        self.low = section("<u4", self.n), section("u1", self.n)
        self.start = section(f"<i{start}", (1 << self.bits) + 1)
        self.code = section("u1", self.n)
        self.common = section("<i8", common, self.columns)
        self.apart = section("<u4", apart)
        self.rest = section(f"<u{rest}", apart, self.columns)

    def rows(self, h: np.ndarray, columns: int) -> np.ndarray:
        """The rows of counts of hashes; zeros where there is none."""
        out = np.zeros((len(h), columns), np.int64)
        if not self.n:
            return out
        bucket = _top(h, self.bits)
        a, b = ((k * self.n >> self.bits) + self.start[k] for k in (bucket, bucket + 1))
        wanted = h << np.uint64(self.bits) >> np.uint64(24)

        def key(at: np.ndarray) -> np.ndarray:
            return self.low[0][at].astype(np.uint64) << np.uint64(8) | self.low[1][at]

        end, open_ = b.copy(), np.flatnonzero(a < b)
        while len(open_):
            middle = a[open_] + b[open_] >> 1
            less = key(middle) < wanted[open_]
            a[open_[less]] = middle[less] + 1
            b[open_[~less]] = middle[~less]
            open_ = open_[a[open_] < b[open_]]
        there = np.flatnonzero(a < end)
        there = there[key(a[there]) == wanted[there]]
        at = a[there]
        code = self.code[at]
        plain = code != APART
        out[there[plain]] = self.common[code[plain]]
        out[there[~plain]] = self.rest[np.searchsorted(self.apart, at[~plain].astype(np.uint32))]
        return out


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Of counts 1, 2 and 3 or more, from how many things occur once to four times; at fixed values where too few do."""
    n1, n2, n3, n4 = n
    if min(n1, n2, n3) <= 0:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(x, 0.05), 0.95 * k) for k, x in enumerate(d, 1))  # type: ignore[return-value]


@dataclass(frozen=True)
class Model:
    path: str
    order: int
    bits: tuple[int, ...]  # of a hash that name its file, by order from 1
    finer: np.ndarray  # hashes of words between whose grams are dealt finer, in order
    tokens: int
    words: int
    total: int  # of the counts of single words
    discounts: tuple[tuple[float, float, float], ...]  # by order from 1
    word_rest: float

    def look_up(self, table: str, h: np.ndarray, part: np.ndarray, columns: int) -> np.ndarray:
        """Rows of counts of distinct n-grams, by hashes and the parts of the table that hold them."""
        root = _local(self.path)
        out = np.zeros((len(h), columns), np.int64)
        for k, at in _by_part(part):
            out[at] = _Table(f"{root}/{table}-{k}").rows(h[at], columns)
        return out

    def rows(self, grams: np.ndarray) -> np.ndarray:
        """Of distinct n-grams, none of which ends a document, if they are contexts. Columns: count; as contexts the sum of
        counts, how many words follow once, twice and more often; below the two highest orders the raw count.
        """
        n, h = len(grams), _hash(grams)
        if n <= self.order - 2 or self.order == 2:
            return self.look_up(f"{n}", h, _top(h, self.bits[n - 1]), 6)
        count = self.look_up(f"{n}", h, dealing(grams[n - self.order + 1 :], self.bits[-1], self.finer), 1)
        if n == self.order:
            return count
        between = _hash(grams[1:])
        finer = _among(self.finer, between)
        out = np.zeros((len(h), 4), np.int64)
        for table, here, by, bits in (("context", ~finer, between, self.bits[-1]), ("finer", finer, h, self.bits[n - 2])):
            out[here] = self.look_up(table, h[here], _top(by[here], bits), 4)
        out[(count[:, 0] > 0) & (out[:, 0] == 0)] = ONCE  # not in the table
        return np.concatenate([count, out], axis=1)

    def score(self, tokens: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By document: tokens known, add-one score and the model's, both as log10."""
        first = np.cumsum(lengths) - lengths
        place = np.arange(len(tokens)) - np.repeat(first, lengths)
        words, number = _numbered(np.append(tokens, START))
        start, number = number[-1], number[:-1]
        grams, own = words[None], number
        rows = self.rows(grams)
        count, *_, known = rows[own].T
        d = np.array([0.0, *self.discounts[0]])
        even = 1 / (self.words + 1)
        p = np.maximum(count - d[np.minimum(count, 3)], 0) / self.total + self.word_rest * even if self.total else np.full(len(tokens), even)
        for order in range(2, self.order + 1):
            # The context; one start alone serves the second order only, and in higher ones any row stands for more of them.
            before = np.where(place >= 1, np.roll(own, 1), start if order == 2 else 0)
            d = np.array([0.0, *self.discounts[order - 1]])
            total, n1, n2, n3 = rows[:, 1:5].T
            rest = np.where(total > 0, (d[1] * n1 + d[2] * n2 + d[3] * n3) / np.maximum(total, 1), 1.0)[before]
            total = np.maximum(total, 1)[before]
            pairs, own = _numbered(own.astype(np.int64) * len(words) + np.where(place >= order - 1, np.roll(number, order - 1), start))
            grams = np.concatenate([words[None, pairs % len(words)], grams[:, pairs // len(words)]])
            rows = self.rows(grams)
            count = rows[:, 0]
            p = np.where(place >= order - 2, np.maximum(count - d[np.minimum(count, 3)], 0)[own] / total + rest * p, p)
        base = np.log10((known + 1) / (self.tokens + self.words + 1))
        return np.add.reduceat((known > 0).astype(np.int64), first), np.add.reduceat(base, first), np.add.reduceat(np.log10(p), first)


def _bits(parts: int) -> int:
    return max(2, int(np.ceil(np.log2(max(2, parts)))))


def _among(sorted_: np.ndarray, h: np.ndarray) -> np.ndarray:
    return sorted_[np.minimum(np.searchsorted(sorted_, h), len(sorted_) - 1)] == h if len(sorted_) else np.zeros(len(h), bool)


def dealing(suffix: np.ndarray, bits: int, finer: np.ndarray) -> np.ndarray:
    """The parts of grams of the highest order, by all their words but the first."""
    between = _hash(suffix[:-1])
    return _top(np.where(_among(finer, between), _hash(suffix), between), bits)


def _finer(text: DataFrame, order: int, bits: int) -> np.ndarray:
    """Hashes of the words between first and last that make up more of a sample than an even dealing holds."""

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, lengths, w in _blocks(batches):
            h, _, (n,) = _summed(_hash(_grams(w, lengths, order)[1:-1]), np.ones(len(w), np.int64))
            some = n > len(w) >> bits + 2
            yield pa.RecordBatch.from_arrays([pa.array(np.append(h[some].view(np.int64), 0)), pa.array(np.append(n[some], 0)), pa.array(np.append(np.zeros(some.sum(), np.int64), len(w)))], names=["h", "n", "every"])

    found = text.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).mapInArrow(often, "h long, n long, every long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("every").alias("every"))
    found = found.where((F.col("n") > 0) | (F.col("every") > 0)).orderBy(F.desc("n")).limit(1 << bits).collect()  # no more can hold such a share
    every = sum(r["every"] for r in found)
    return np.sort(np.array([r["h"] for r in found if r["n"] << bits > every], np.int64).view(np.uint64))


def train(docs: DataFrame, chosen: Column | None = None, order: int = ORDER) -> Model:
    """The model of the chosen rows' whole texts."""
    spark = docs.sparkSession
    most = _bits(int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Each dealing fits a worker's memory; the fewer there are, the more grams share the words that are sent with them.
    bits = tuple([max(2, most - 1)] * (order - 1) + [max(4, most - 1)])
    path = shared_path(spark, "language-model")
    text = id_and_text(docs)
    text = text if chosen is None else text.where(chosen)
    finer = _finer(text, order, bits[-1]) if order > 2 else np.zeros(0, np.uint64)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, lengths, w in _blocks(batches, COUNTED):
            grams = _grams(w, lengths, order)
            h, at, (n,) = _summed(_hash(grams), np.ones(len(w), np.int64))
            grams = grams[:, at]
            yield from _sent([*_dealt(grams, dealing(grams[1:], bits[-1], finer) if order > 2 else _top(h, bits[-1]), n)]).to_batches()

    def sums(level: int, raw: np.ndarray, m: np.ndarray) -> tuple:
        found = [level, int(raw.sum()), len(raw), int(m.sum()), *(int((m == k).sum()) for k in (1, 2, 3, 4)), int((m >= 3).sum())]
        return -1, 0, np.array(found, "<i8").tobytes()

    def lower(g: np.ndarray, raw: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What a dealing of a level knows of the next: grams, hashes, raw counts and counts."""
        h, at, (raw, before, whole) = _summed(_hash(g[1:]), raw, np.ones(len(count), np.int64), count)
        return g[1:, at], h, raw, np.where(g[1, at] == START, whole, before)

    def down(level: int, g: np.ndarray, raw: np.ndarray, count: np.ndarray, own: np.ndarray) -> list[tuple]:
        """Messages to the next level."""
        low = bits[level - 2]
        grams, h, *counts = lower(g, raw, count)
        c, _, after = _after(_hash(g[:-1, own]), count[own])
        return [*_dealt(grams, _top(h, low), *counts), *_contexts(1, c, after, low)]

    def gathered(level: int, t: pa.Table) -> tuple:
        """The grams of a dealing with their hashes, raw counts and counts, and the contexts by kind."""
        grams, raws, counts, contexts = [np.zeros((level, 0), np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], {k: [[np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 4]] for k in (1, 2)}
        for kind, a in zip(t["kind"].to_pylist(), t["a"], strict=True):
            if kind:
                h, *counters = _unpacked(a)
                contexts[kind].append([np.cumsum(h, dtype=np.uint64), *(x.astype(np.int64) for x in counters)])
            else:
                g, numbers = _unpacked_grams(a, level)
                grams.append(g)
                raws.append(numbers[0])
                counts.append(numbers[-1])
        g, raw, count = np.concatenate(grams, axis=1), np.concatenate(raws), np.concatenate(counts)
        del grams, raws, counts
        h, at, (raw, count) = _summed(_hash(g), raw, count)
        return g[:, at], h, raw, count, {k: _summed(*(np.concatenate(x) for x in zip(*c, strict=True))) for k, c in contexts.items()}

    def highest(t: pa.Table) -> pa.Table:
        """The two highest orders of a dealing."""
        part = t["part"][0].as_py()
        g, h, raw, _, _ = gathered(order, t)
        _write(path, f"{order}-{part}", h, [raw])
        # Grams whose context is starts alone, more than one, serve the lower orders only.
        own = g[1] != START
        rows = [sums(order, raw, raw[own])]
        c, at, after = _after(_hash(g[:-1, own]), raw[own])
        some = _among(finer, _hash(g[1:-1, own][:, at]))
        _write_contexts(path, f"context-{part}", c[~some], [s[~some] for s in after])
        rows += _contexts(2, c[some], [s[some] for s in after], bits[order - 3])
        del c, at, after, some
        g, h, raw, count = lower(g, raw, raw)
        _write(path, f"{order - 1}-{part}", h, [count])
        own = g[1] != START
        return _sent([*rows, sums(order - 1, raw, count[own]), *down(order - 1, g, raw, count, own)])

    def merged(level: int, t: pa.Table) -> pa.Table:
        part = t["part"][0].as_py()
        if part < 0:
            return t
        g, h, raw, count, contexts = gathered(level, t)
        c, _, after = contexts[1]
        every = np.union1d(h, c) if len(c) else h
        columns = [np.zeros(len(every), np.int64) for _ in range(6)]
        for at, some in ((np.searchsorted(every, h), {0: count, 5: raw}), (np.searchsorted(every, c), dict(enumerate(after, 1)))):
            for k, v in some.items():
                columns[k][at] = v
        _write(path, f"{level}-{part}", every, columns)
        if len(contexts[2][0]):
            _write_contexts(path, f"finer-{part}", contexts[2][0], contexts[2][2])
        del every, columns, contexts, c, after
        own = g[1] != START if level > 1 else np.ones(len(h), bool)
        return _sent([sums(level, raw, count[own]), *(down(level, g, raw, count, own) if level > 1 else [])])

    def merging(level: int) -> Callable[[pa.Table], pa.Table]:
        def of_level(t: pa.Table) -> pa.Table:
            return merged(level, t)

        return of_level

    dealt = text.mapInArrow(counted, DDL)
    if order > 2:
        dealt = dealt.groupBy("part").applyInArrow(highest, DDL)
    for level in range(order - 2 if order > 2 else order, 0, -1):
        dealt = dealt.groupBy("part").applyInArrow(merging(level), DDL)
    found = np.zeros((order + 1, 8), np.int64)
    for row in dealt.select("a").collect():  # a row for each of a few dealings
        level, *sums = np.frombuffer(row.a, "<i8").tolist()
        found[level] += sums
    tokens, words, total, m1, m2, m3, m4, m3up = found[1].tolist()
    d = discounts([m1, m2, m3, m4])
    higher = [discounts(found[k][3:7].tolist()) for k in range(2, order + 1)]
    return Model(path, order, bits, finer, tokens, words, total, (d, *higher), (d[0] * m1 + d[1] * m2 + d[2] * m3up) / total if total else 1.0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of each row's whole text."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, lengths, tokens in _blocks(batches):
            known, base, own = model.score(tokens, lengths)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(own)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return id_and_text(docs).mapInArrow(scored, "doc_id long, n_tokens long, n_known long, base_score double, score double").withColumn("train_tokens", F.lit(model.tokens).cast("long"))
