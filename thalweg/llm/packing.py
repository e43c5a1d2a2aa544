"""Packing by power-of-two decomposition.

Each document is tokenized whole, closed by one end id, and cut into pieces whose lengths are powers of two: as
many of the longest length as fit, then the binary digits of what is left, longest first. A piece is a sequence of
its own, so none crosses documents and none needs padding; pieces of equal length share a bucket, from which batches
of one shape are drawn. It is a map over rows: nothing is shuffled, and a lost task is simply run again.

Null texts count as empty and give one piece, the end id. Null, repeated and clashing ids or columns change nothing:
every input row is packed by itself. Very long texts give more pieces; no text is cut short.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text

SEQUENCE = 4096
END_ID = 2
#: White-space-free chunks whose ids a worker remembers; beyond it the memory is emptied and filled anew.
REMEMBERED = 800_000


def binary_lengths(n: int, longest: int = SEQUENCE) -> list[int]:
    """Powers of two that sum to n, longest first; only the longest may repeat."""
    if longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    out = [longest] * (n // longest)
    rest = n % longest
    while rest:
        top = 1 << (rest.bit_length() - 1)
        out.append(top)
        rest -= top
    return out


class _Lists:
    """Growing lists of ids by key, kept end to end so that many are gathered at once."""

    def __init__(self) -> None:
        self.place: dict = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 12, np.int64)
        self.length = np.zeros(1 << 12, np.int64)
        self.used = 0

    def add(self, keys: list, lengths: np.ndarray, ids: np.ndarray) -> None:
        first, last = len(self.place), len(self.place) + len(keys)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while last > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        self.place.update(zip(keys, range(first, last), strict=True))
        self.length[first:last] = lengths
        self.start[first:last] = self.used + np.cumsum(lengths) - lengths
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def gather(self, keys: list) -> tuple[np.ndarray, np.ndarray]:
        """Lengths by key, and the ids end to end."""
        if not keys:
            return np.zeros(0, np.int64), np.zeros(0, np.uint32)
        at = np.fromiter(map(self.place.__getitem__, keys), np.int64, len(keys))
        length = self.length[at]
        ends = np.cumsum(length)
        return length, self.flat[np.repeat(self.start[at] - ends + length, length) + np.arange(ends[-1])]


class ChunkTokenizer:
    """Ids of whole texts from remembered ids of their chunks between ASCII white space.

    Neither normalisation nor pre-tokenization of the word-level vocabularies looks across white space, and white
    space itself has no ids, so the ids of a text are those of its chunks end to end. Chunks of plain Latin letters,
    digits and signs are split here, and their parts go to the model, whose words end in a marked id; any other chunk
    goes through the whole tokenizer.
    """

    PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    PLAIN = r"[\n\x21-\x7e\xa1-\u012f\u0131-\u024f]*"

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        known = [p.get("pattern", {}).get("Regex") for p in (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        kinds = [n["type"] for n in (rules.get("normalizer") or {}).get("normalizers", [])]
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        suffix = rules["model"].get("end_of_word_suffix") or ""
        self.by_parts = known[:1] == [self.PARTS] and kinds == ["NFC", "Replace", "Lowercase"] and suffix == "</w>"
        if self.by_parts:
            for token, k in self.tokenizer.get_vocab().items():
                self.ends[k] = token.endswith(suffix)
            self.words = Tokenizer(self.tokenizer.model)
            self.words.pre_tokenizer = WhitespaceSplit()
            self.find, self.plain = regex.compile(r"\n|" + self.PARTS).findall, regex.compile(self.PLAIN).fullmatch
        self.chunks, self.parts = _Lists(), _Lists()

    def _is_plain(self, text: str) -> bool:
        return "<|" not in text and self.plain(text) is not None

    def _learn_parts(self, parts: list[str]) -> None:
        signs = " ".join([p if p.isascii() else p.encode().decode("latin-1").translate(_BYTE_SIGNS) for p in parts])
        ids = np.array(self.words.encode_batch_fast([signs], add_special_tokens=False)[0].ids, np.uint32)
        after = np.flatnonzero(self.ends[ids]) + 1
        if len(after) != len(parts):
            raise ValueError("the vocabulary does not mark each word's end")
        self.parts.add(parts, np.diff(after, prepend=0), ids)

    def _learn(self, raw: list[bytes]) -> None:
        texts = [c.decode() for c in raw]
        odd = []
        if not self.by_parts:
            odd, raw, texts = list(zip(raw, texts, strict=True)), [], []
        elif not self._is_plain("\n".join(texts)):
            kept = [self._is_plain(t) for t in texts]
            odd = [x for x, k in zip(zip(raw, texts, strict=True), kept, strict=True) if not k]
            raw, texts = [c for c, k in zip(raw, kept, strict=True) if k], [t for t, k in zip(texts, kept, strict=True) if k]
        if raw:
            parts = self.find("\n".join(texts).lower())
            if new := {p for p in parts if p not in self.parts.place}:
                new.discard("\n")
                if "\n" not in self.parts.place:
                    self.parts.add(["\n"], np.zeros(1, np.int64), np.zeros(0, np.uint32))
                if new:
                    self._learn_parts(list(new))
            length, ids = self.parts.gather(parts)
            line = np.cumsum([p == "\n" for p in parts])
            self.chunks.add(raw, np.bincount(line, length, len(raw)).astype(np.int64), ids)
        if odd:
            ids = [e.ids for e in self.tokenizer.encode_batch([t for _, t in odd], add_special_tokens=False)]
            self.chunks.add([c for c, _ in odd], np.array([*map(len, ids)], np.int64), np.array([k for own in ids for k in own], np.uint32))

    def ids(self, text: str) -> np.ndarray:
        chunks = text.encode().split()
        if len(self.chunks.place) > REMEMBERED:
            self.chunks, self.parts = _Lists(), _Lists()
        if new := {c for c in chunks if c not in self.chunks.place}:
            self._learn(list(new))
        return self.chunks.gather(chunks)[1]


def _byte_signs() -> dict[int, str]:
    """The printable sign of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


_BYTE_SIGNS = _byte_signs()
_BLANKS = {c: " " for c in (9, 10, 11, 12, 13)}
_TOKENIZERS: dict[str, ChunkTokenizer] = {}


def _tokenizer(path: str) -> ChunkTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ChunkTokenizer(path)
    return _TOKENIZERS[path]


_SCHEMA = "doc_id long, start long, length long, bucket int, ids binary, doc_tokens long"


def pack(docs: DataFrame, tokenizer_path: str, longest: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, bucket (log2 of the length), ids (uint32, little-endian), doc_tokens."""
    fields = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("bucket", pa.int32()), ("ids", pa.binary()), ("doc_tokens", pa.int64())])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path)
        out: list[tuple] = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.append(tokenizer.ids(text.as_py()), np.uint32(end_id)).astype("<u4")
                at, doc = 0, doc_id.as_py()
                for n in binary_lengths(len(ids), longest):
                    out.append((doc, at, n, n.bit_length() - 1, ids[at : at + n].tobytes(), len(ids)))
                    at += n
                held += len(ids)
                if held > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)

    return id_and_text(docs).mapInArrow(pieces, _SCHEMA)


def digest_of_pieces(pieces: DataFrame) -> DataFrame:
    """The contract's columns: crc32 instead of the ids, and each piece as a sequence of its own.

    sequence_id numbers rows within the partitions of the scan, so it needs no shuffle and is the same for a task
    that is run again.
    """
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "bucket")
