"""The registered queries and the pipeline's stages on a small folder of tables, against SQL and brute force."""

import hashlib
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from thalweg.llm import queries, secrets, simhash, toxicity, weighted_sampling


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    words = [f"w{k}" for k in range(80)] + ["The", "basin", "É,"]
    texts = [" ".join(rng.choices(words, k=rng.randint(4, 50))) + (" vileness vileness" if k % 9 == 0 else "") for k in range(160)]
    texts += [None, "", " \t", texts[3], texts[3], "secret = abcdefghijkl12 AKIA" + "B2" * 9 + " 00112233445566778899", "long " * 20000]
    path = tmp_path_factory.mktemp("tables")
    ids = list(range(len(texts)))
    ids[-7] = 10**12  # an id far from the others
    rows = [(i, t, "en", ["a", "b", None, "c"][k % 4], len(t or "")) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(3).write.parquet(f"{path}/documents.parquet")
    labels = [(k, int(k % 9 == 0), int(k % 2 == 0)) for k in range(160)] + [(5, None, None), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{path}/labels.parquet")
    return str(path), {i: t or "" for i, t in zip(ids, texts, strict=True)}


def test_sql_of_search_and_licences(spark, folder):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder[0]}/documents.parquet/*.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        got, want = queries.QUERIES[name](spark, folder[0]).toPandas(), db.sql(sql).df()
        cols = sorted(want.columns)
        assert sorted(got.columns) == cols
        got, want = (x[cols].sort_values([c for c in cols if c != "score"]).reset_index(drop=True) for x in (got, want))
        assert len(got) == len(want) and all(np.allclose(got[c], want[c], rtol=0, atol=1e-4) if c == "score" else got[c].astype(str).replace("nan", "None").tolist() == want[c].astype(str).replace("nan", "None").tolist() for c in cols)


@pytest.mark.parametrize("name,modulus,held", [("op3_toxicity", 3, 1), ("op8_quality", 4, 2)])
def test_decisions(spark, folder, name, modulus, held):
    rows = queries.QUERIES[name](spark, folder[0]).collect()
    assert sorted(r.doc_id for r in rows) == sorted(folder[1])
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == held) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    if name == "op3_toxicity":
        mine = [(r.predicted, int("vileness" in folder[1][r.doc_id])) for r in rows if r.held_out]
        assert sum(a == b for a, b in mine) >= 0.9 * len(mine)


def test_fingerprint_strings(spark, folder):
    for r in queries.op4_simhash(spark, folder[0]).collect():
        w = folder[1][r.doc_id].encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        assert r.fingerprint == f"{sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)):016x}"


def test_edited_texts(spark, folder):
    own = sorted(folder[1])
    rows = {r.doc_id: r for r in queries.op6_fingerprints(spark, folder[0]).collect()}
    assert sorted(rows) == own
    for k, i in enumerate(own):
        text, after = folder[1][i], folder[1][own[(k + 1) % len(own)]]
        n = len(text) // 4
        assert rows[i].n_chars == len(text) and rows[i].edited_sha256 == hashlib.sha256((text[: len(text) - n] + after[:n]).encode()).hexdigest()
        assert 0 <= rows[i].near_edited <= 1 and 0 <= rows[i].near_next <= 1


def test_one_far_id_leaves_the_ranges_even(spark):
    ids = [*range(4000), 10**15, None, None]
    rows = spark.createDataFrame([(i, "x") for i in ids], "doc_id long, text string")
    sizes = {r["range"]: r["count"] for r in rows.select(weighted_sampling._ranges(rows).alias("range")).groupBy("range").count().collect()}
    places = rows.where("doc_id is not null").select("doc_id", weighted_sampling._ranges(rows).alias("range")).orderBy("doc_id").collect()
    assert all(a["range"] <= b["range"] for a, b in zip(places, places[1:]))
    assert sizes.pop(-1) == 2 and max(sizes.values()) <= 3 * 4000 / (8 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def test_pieces(spark, folder):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    whole = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    found, held = {}, {}
    for r in queries.op7_packing(spark, folder[0]).collect():
        found.setdefault(r.doc_id, {})[r.start] = r
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, text in folder[1].items():
        ids, at = [*whole.encode(text, add_special_tokens=False).ids, 2], 0
        for start in sorted(found[i]):
            r = found[i][start]
            assert start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096


def brute_spans(text):
    """Base spans by plain scanning with the patterns of the contract."""
    kinds = [
        (r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
        (r"AKIA[A-Z0-9]+", 0, 18),
        (r"[0-9a-f]+", 0, 16),
    ]
    out = []
    for kind, (pattern, group, least) in enumerate(kinds):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return sorted(out)


def test_secrets_by_brute_force(spark, folder):
    names = ("assign", "access", "hex")
    for r in queries.op10_secrets(spark, folder[0]).collect():
        base = brute_spans(folder[1][r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in base) for i in range(3))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{names[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()


def test_secrets_held_out_precision_and_recall():
    samples = secrets.labelled_samples()
    random.Random(1).shuffle(samples)
    cut = len(samples) * 4 // 5
    model = secrets.MarkovRatio.train(samples[:cut])
    tried = [(model.ratio(t) > secrets.THRESHOLD, y) for t, y in samples[cut:] if len(t) >= 16]
    hits = sum(x and y for x, y in tried)
    assert hits >= 0.95 * sum(x for x, _ in tried) and hits >= 0.9 * sum(y for _, y in tried)


CLASH = ("_thalweg_text", "_thalweg_toxic", "_thalweg_id", "_THALWEG_ROWS", "_thalweg_fp", "_thalweg_root", "_thalweg_row", "rows", "root", "fp", "a.b")


def test_stages_keep_clashing_columns_and_odd_rows(spark):
    secret = "Zk9XqT2vLw8RbN4mYc7HdP1sGf6JtKuE"
    texts = ["one two three four five six", "one two three four five six", None, "", f"key {secret} end", "vile vile", "w " * 30000, "seven eight nine ten eleven"]
    ids = [1, 1, 2, 3, 4, 5, None, None]
    rows = [(i, t, "en", "s" if k % 2 else None, len(t or ""), *[f"{c}{k}" for c in CLASH]) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *CLASH])
    weights = toxicity.Weights(-12.0, {"vile": 30.0})
    for made, want in [(toxicity.without_toxic(docs, weights), {k for k in range(8)} - ({5} if weights.score("vile vile") >= 0.7 else set())), (secrets.redacted(docs, "[x]"), set(range(8)))]:
        assert made.columns == docs.columns and {int(r["rows"][4:]) for r in made.collect()} == want
    clean = {r["rows"]: (r.text, r.n_chars, r["a.b"], r["_thalweg_text"]) for r in secrets.redacted(docs, "[x]").collect()}
    assert clean["rows4"] == ("key [x] end", 11, "a.b4", "_thalweg_text4") and clean["rows2"][0] is None
    kept = simhash.one_of_each(docs)
    # Rows 0 and 1 are one text, and 2 and 3 both hold no word; the row of the smallest id stays.
    assert kept.columns == docs.columns and sorted(r["rows"] for r in kept.collect()) == ["rows0", "rows2", "rows4", "rows5", "rows6", "rows7"]
    assert {r["_thalweg_id"] for r in kept.collect()} == {f"_thalweg_id{k}" for k in (0, 2, 4, 5, 6, 7)}


def test_pipeline_on_odd_rows_and_none(spark, folder):
    pytest.importorskip("public_tokenizers")
    docs = corpus_pipeline.common.documents(spark, folder[0])
    assert corpus_pipeline.run(spark, folder[0]).select("doc_id").distinct().count() > 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where(F.lit(False)), folder[0]).count() == 0, name
        if name != "packing":
            assert stage(spark, docs, folder[0]).columns == docs.columns, name
