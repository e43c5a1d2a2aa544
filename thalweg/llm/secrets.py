"""Secret scans: patterns, and a likelihood ratio of two character Markov models.

The base spans are those of three patterns. Beside them, every run of token characters long enough to hold a key is
scored by two first-order Markov models over characters, one trained from samples labelled random, one from samples
labelled ordinary: its log-likelihood ratio a character, above a threshold, adds a span of kind markov; nothing else is
asked of a run, digits or not. A run that overlaps a base span is left to it. The scan is a map over whole texts, without a shuffle.

Null texts count as empty; null or repeated ids and further columns change nothing; every row gives one row. Offsets
are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, id_and_text, quoted

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Nats a character by which the random model must explain a run better than the ordinary one.
THRESHOLD = 0.8


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of the patterns' matches that are long enough, by start, then kind."""
    spans = []
    low = text.lower() if any(c.isupper() for c in text) else text
    if any(w in low for w in ASSIGN_WORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    # Runs of hexadecimal digits are maximal either way, so asking for sixteen at once finds the runs that are kept.
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


#: Words that ordinary identifiers are made of, for the built-in labelled sample.
ORDINARY = (
    "account action address array async attribute average balance batch boolean branch buffer build button cache callback channel character "
    "client cluster column command comment commit component config connection container content context control counter create current "
    "database default delete document download driver element email enable encoder engine entity error event example exception execute "
    "factory feature field filter folder format function gateway generator global graph group handler header helper history image import "
    "index input instance interface internal invoice iterator journal kernel language layout length library limit listener local location "
    "logger manager matrix memory message method metric migration model module monitor network number object offset operation option order "
    "output package parameter parser partition password path payload permission pipeline pointer policy position prefix process product "
    "profile project property protocol provider query queue random range record reference region registry release report request resource "
    "response result return router sample schedule schema scope search section selector sequence server service session setting shard signal "
    "snapshot socket source state status storage stream string structure style subject suffix summary support switch symbol system table "
    "target template terminal thread timeout timestamp token tracker transaction transform trigger update upload user utility validate value "
    "variable version vertex view virtual visitor volume warning widget window worker wrapper writer"
).split()

#: Words of running text, of which its longest words and runs without blanks are made.
PROSE = (
    "although another because before between children country different everything government however important information international "
    "nevertheless notwithstanding particular people possible question responsibility something straightforward through together understanding "
    "understand university weather whether without worthwhile yesterday knowledge neighbourhood characteristic thought themselves "
    "aber arbeit bedeutung beziehung bundesregierung durch einschliesslich entwicklung erfahrung freundschaft gemeinschaft geschwindigkeit "
    "gesellschaft gleichzeitig herausforderung jahrhundert krankenversicherung landschaft menschen moeglichkeit nachrichten oeffentlichkeit "
    "rechtswissenschaft schliesslich selbstverstaendlich sprache staatsangehoerigkeit unterschied verantwortung verschiedene wahrscheinlich "
    "wirtschaft wissenschaft zusammenarbeit zwischen einheit freiheit sicherheit zukunft ueberzeugung auch keine sich nicht "
    "actuellement aujourdhui beaucoup bonheur chaleureux citoyennete cependant connaissance developpement egalement environnement evenement "
    "gouvernement habituellement heureux immediatement maintenant malheureusement nombreux nouvelle particulierement pourquoi quelquefois "
    "quelque rapprochement reconnaissance renseignement serieux toujours travail travaux lieux mieux vieux eaux leurs parmi elle "
    "actualmente administracion ademas ahora ayuntamiento caracteristicas ciudadanos conocimiento construccion desarrollo desgraciadamente "
    "ejercicio entonces especialmente espectaculo extraordinario independientemente investigacion mientras muchachos naturaleza necesidades "
    "nosotros posibilidades principalmente pueblo querido respuesta siguiente tambien todavia trabajadores universidades veces ellos alegria"
).split()


def labelled_samples(rows: int = 6000, seed: int = 11) -> list[tuple[str, int]]:
    """(string, 1 if random): keys over usual alphabets, and identifiers, compounds, words of prose and repeated signs."""
    rng = random.Random(seed)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    alphabets = (lower + digits, upper + digits, lower + upper + digits, lower + upper + digits + "+/", lower + upper + digits + "_-", "abcdef" + digits, lower + upper, lower, upper)
    out = [("".join(rng.choices(alphabets[k % len(alphabets)], k=rng.randint(16, 64))), 1) for k in range(rows)]
    for k in range(rows):
        words = rng.choices(ORDINARY, k=rng.randint(2, 4))
        joined = ("_".join(words), "".join(words), "".join(w.title() for w in words), "-".join(words), "_".join(words).upper(), "/".join(words))[k % 6]
        out.append((joined + (str(rng.randint(1, 2030)) if rng.random() < 0.15 else ""), 0))
        spoken = rng.choices(PROSE, k=rng.randint(1, 3))
        out.append((("".join(spoken), "".join(w.title() for w in spoken), "-".join(spoken), "".join(spoken).capitalize(), "".join(spoken).upper())[k % 5], 0))
        if k % 10 == 0:
            out.append((rng.choice(ALPHABET) * rng.randint(16, 64), 0))
            out.append(("".join(rng.choices("=-_+/", k=2)) * rng.randint(8, 32), 0))
    return out


@dataclass(frozen=True)
class MarkovRatio:
    """log p(next | this) of the random model less that of the ordinary one, by pair of characters; row 0 starts."""

    table: np.ndarray
    place: np.ndarray

    @classmethod
    def train(cls, samples: list[tuple[str, int]], smoothing: float = 0.5) -> MarkovRatio:
        """First-order models with additive smoothing towards even pairs, from labelled samples."""
        place = np.zeros(128, np.int64)
        for k, c in enumerate(ALPHABET, 1):
            place[ord(c)] = k
        n = len(ALPHABET) + 1
        counts = np.full((2, n, n), smoothing)
        for text, label in samples:
            codes = place[np.frombuffer(text.encode("ascii", "ignore"), np.uint8) & 127]
            np.add.at(counts[label], (np.concatenate([[0], codes[:-1]]), codes), 1)
        p = np.log(counts / counts.sum(axis=2, keepdims=True))
        return cls(p[1] - p[0], place)

    def ratio(self, run: str) -> float:
        codes = self.place[np.frombuffer(run.encode(), np.uint8)]
        return float(self.table[np.concatenate([[0], codes[:-1]]), codes].mean())


def added_spans(text: str, base: list[tuple[int, int, int]], model: MarkovRatio, threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    """Runs that look random and meet no base span. The ratio alone decides."""
    out = []
    for m in RUN.finditer(text):
        a, b = m.span()
        if not any(s < b and a < e for s, _, e in base) and model.ratio(m[0]) > threshold:
            out.append((a, 3, b))
    return out


def scan(docs: DataFrame, samples: list[tuple[str, int]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans of each row."""
    model = MarkovRatio.train(samples if samples is not None else labelled_samples())
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("n_markov", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, value in zip(batch.column(0), batch.column(1), strict=True):
                text = value.as_py()
                base = base_spans(text)
                spans = sorted(base + added_spans(text, base, model, threshold))
                n = [sum(k == i for _, k, _ in spans) for i in range(4)]
                rows.append((doc_id.as_py(), *n, hashlib.sha256(said(base).encode()).hexdigest(), said(spans)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)

    kinds = {pa.int64(): "long", pa.string(): "string"}
    return id_and_text(docs).mapInArrow(scanned, ", ".join(f"{f.name} {kinds[f.type]}" for f in schema))


def redacted(docs: DataFrame, mark: str, samples: list[tuple[str, int]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of documents with their secrets replaced by the mark, and n_chars counted anew where a text changed."""
    model = MarkovRatio.train(samples if samples is not None else labelled_samples())

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        base = base_spans(text)
        spans = sorted(base + added_spans(text, base, model, threshold))
        return without(text, spans, mark) if spans else text

    replaced = F.pandas_udf(lambda texts: texts.map(clean), "string").asNondeterministic()(F.col("text"))  # evaluated once a row
    made = free_name(docs, "_thalweg_text")
    new = docs.select("*", replaced.alias(made))
    own = {"text": F.col(made)}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(F.col("text").eqNullSafe(F.col(made)), F.col("n_chars")).otherwise(F.length(made)).cast("long")
    return new.select(*[own[c].alias(c) if c in own else F.col(quoted(c)) for c in docs.columns])


def without(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """The text with each span, or run of overlapping spans, replaced by the mark."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]
