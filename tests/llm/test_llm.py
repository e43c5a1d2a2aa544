"""Each text operator against brute force or an exact rule, on small tables with nulls, ties and repeats."""

import hashlib
import math
import os
import random
import re
import textwrap
import zlib
from collections import Counter
from importlib import resources

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from thalweg.llm import language_model, licenses, license_texts, mixing, packing, quality, search, secrets, simhash, toxicity, weighted_sampling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, bucket int"


def table(spark, texts):
    sources = ["a", "b", None, "c", "a"]
    return spark.createDataFrame([(k, t, "en", sources[k % 5], len(t or ""), "x", 1) for k, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)] + ["Émile,", "THE", "the"]
    own = [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(60)]
    return [*own, None, "", " \t\n", own[0], own[0], own[1] + " more", "x " * 9000, "one"]


def test_empty_tables(spark):
    none = table(spark, ["x"]).where("doc_id < 0")
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert simhash.near_duplicates(none).count() == simhash.one_of_each(none).count() == mixing.mix(none).count() == secrets.scan(none).count() == 0
    assert weighted_sampling.fingerprints(none).count() == search.search(none, none).count() == licenses.scan(none).count() == 0
    assert toxicity.score(none, toxicity.train(none, labels)).count() == quality.classify(none, labels).count() == 0
    assert language_model.score(none, language_model.train(none)).count() == 0


def test_simhash_links(spark, texts):
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(table(spark, texts)).collect()}

    def fp(text):
        w = (text or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    own = [fp(t) for t in texts]
    assert [got[k][0] % (1 << 64) for k in range(len(texts))] == own
    least = list(range(len(own)))
    for _ in own:
        least = [min([least[j] for j, b in enumerate(own) if (a ^ b).bit_count() <= 4]) for a in own]
    assert [got[k][1] for k in range(len(own))] == least
    assert sorted(r.doc_id for r in simhash.one_of_each(table(spark, texts)).collect()) == sorted(set(least))


def test_one_of_each_goes_by_group(spark):
    rng = random.Random(8)
    a, b, c, d, e, f = (" ".join(rng.choices([f"v{k}" for k in range(500)], k=50)) for _ in range(6))
    keep = lambda rows: sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect())
    said = lambda *rows: sorted((k is None, k or 0, t) for k, t in rows)
    # Unlike texts without an id, and copies of one of them.
    assert keep([(None, a, 1), (None, b, 2), (None, c, 3), (None, c, 4), (9, d, 5)]) == said((None, a), (None, b), (None, c), (9, d))
    # Without an id there is one row that no other matches.
    assert keep([(None, a, 1), (9, d, 5)]) == said((None, a), (9, d))
    # Unlike texts under one id, the smallest of both groups.
    assert keep([(1, a, 1), (1, b, 2), (2, a, 3), (3, b, 4)]) == said((1, a), (1, b))
    # An id that is the smallest of one group only: its row in the other group goes.
    assert keep([(5, a, 1), (5, b, 2), (2, b, 3), (None, e, 4), (7, e, 5), (None, f, 6)]) == said((5, a), (2, b), (7, e), (None, f))


def test_trie_join_equals_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    fp = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 20, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 20, dtype=np.uint64)) for _ in range(40)]))
    group = simhash.Trie(fp, np.array([0, len(fp)]), 4).join()
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
    want = np.arange(len(fp))
    for _ in fp:
        new = np.array([want[n].min() for n in near])
        if (new == want).all():
            break
        want = new
    assert (group == want).all()


def test_mixing_targets_and_reruns(spark, texts):
    rows = mixing.mix(table(spark, texts)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in mixing.mix(table(spark, texts).repartition(3)).collect())
    assert all(r.taken <= 3 * r.size for r in rows) and len(rows) == len(texts)
    size = {r.source: r.source_size for r in rows}
    total, weight, capped = sum(size.values()), dict(zip(sorted(size, key=lambda s: (s is None, s or "")), [5, 2, 1, 5])), {}
    while True:
        free = [s for s in size if s not in capped]
        share = {s: (total - sum(capped.values())) * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: 3 * size[s] for s in free if share[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    assert {r.source: pytest.approx(r.target) for r in rows} == capped | share
    for s in size:
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own) / 2 + 1e-6
    assert mixing.mixed(table(spark, texts)).count() == sum(r["times"] for r in rows)


def test_mixing_repeats_and_clashing_names(spark):
    sources = ["a", "b", None]
    rows = [(7, "one two three", sources[k % 3], k, k, k) for k in range(60)] + [(None, None, "d", 0, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row int, _source int, `a.b` int")
    taken, mixed = mixing.mix(docs).collect(), mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.times for r in taken)
    for s in sources:  # equal rows are split one by one
        own = [r for r in taken if r.source == s]
        assert len(own) == 20 and abs(sum(r.taken for r in own) - own[0].target) <= 1.5 + 1e-6 and max(r.times for r in own) - min(r.times for r in own) <= 1
    assert [(r.size, r.taken) for r in taken if r.source == "d"] == [(0, 0)]


def test_mixing_merges_where_the_sources_are_not_small(spark, texts, monkeypatch):
    want = sorted((r.doc_id, r.times) for r in mixing.mix(table(spark, texts)).collect())
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", -1)
    assert sorted((r.doc_id, r.times) for r in mixing.mix(table(spark, texts)).collect()) == want


def test_packing_round_trip(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    odd = [*texts, "It's 12 İstanbul ΣΑΣ <|endoftext|> é 日本語", "café'll x"]
    whole = Tokenizer.from_file(path)
    found = {}
    for r in packing.pack(table(spark, odd), path).collect():
        assert r.length & (r.length - 1) == 0 and r.length <= 4096
        found.setdefault(r.doc_id, {})[r.start] = np.frombuffer(r.ids, "<u4").tolist()
    for k, t in enumerate(odd):
        assert [i for a in sorted(found[k]) for i in found[k][a]] == [*whole.encode(t or "", add_special_tokens=False).ids, 2]
    assert packing.binary_lengths(9000) == [4096, 4096, 512, 256, 32, 8]


def test_secret_spans(spark):
    key = "Zk9XqT2vLw8RbN4mYc7HdP1sGf6JtKuE"
    text = f"é password: abcdefghijkl1 AKIA{'A1' * 8} x 0123456789abcdef {key} internationalization_of_identifiers secret=short"
    row = secrets.scan(table(spark, [text, None, ""])).orderBy("doc_id").collect()
    assert (row[0].n_assign, row[0].n_access, row[0].n_hex, row[0].n_markov) == (1, 1, 1, 1)
    base = secrets.base_spans(text)
    assert row[0].base_sha256 == hashlib.sha256(secrets.said(base).encode()).hexdigest() and base[0] == (2, 0, text.index("1 AKIA") + 1)
    assert text[text.index(key) :][: len(key)] == key and f"markov:{text.index(key)}:{text.index(key) + len(key)}" in row[0].spans
    assert row[1].spans == row[2].spans == ""
    assert key not in secrets.redacted(table(spark, [text]), "[x]").first().text


def test_secrets_without_digits(spark):
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    keys = ["".join(rng.choices(letters[: 26 * (1 + k % 2)], k=40)) for k in range(100)] + ["".join(rng.choices(letters, k=23)) + "7" for _ in range(100)]
    plain = "internationalization_of_identifiers Donaudampfschifffahrtsgesellschaft anticonstitutionnellement electroencefalografista getElementsByTagName LICENSE_AGREEMENT_TEXT usr/local/share/doc/package"
    rules = " ".join(c * 30 for c in "=-_+/xX") + " " + "=-" * 12
    rows = secrets.scan(table(spark, [*keys, plain, rules])).orderBy("doc_id").collect()
    assert sum(r.n_markov for r in rows[:-2]) >= 190
    assert rows[-2].spans == rows[-1].spans == ""
    text = secrets.redacted(table(spark, [f"key {keys[-1]} end"]), "[x]").first().text
    assert text == "key [x] end"


def test_search_equals_brute_force(spark, texts):
    docs = table(spark, texts)
    got = {(r.query_id, r["rank"]): (r.doc_id, round(r.score * 1e6)) for r in search.search(docs, docs.where("doc_id % 20 = 0"), k=5, shard_words=4000).collect()}
    tf = [Counter((t or "").encode().lower().split()) for t in texts]
    n, df = len(tf), Counter(w for c in tf for w in c)
    mean = sum(sum(c.values()) for c in tf) / n
    for q in range(0, n, 20):
        points = [sum(int(np.floor(m * np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * (c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))) * 1e6 + 0.5)) for w, m in tf[q].items() if w in c) for c in tf]
        best = sorted((k for k in range(n) if points[k]), key=lambda k: (-points[k], k))[:5]
        assert [got[q, r][0] for r in range(1, len(best) + 1)] == best
        assert all(abs(got[q, r][1] - points[k]) <= len(tf[q]) for r, k in enumerate(best, 1))


def test_search_prunes_exactly(spark):
    # Many documents share frequent words; some rows repeat, as does one query's id; shards end within a task.
    rng = random.Random(21)
    common, rare = [f"c{k}" for k in range(25)], [f"r{k}" for k in range(400)]
    texts = [" ".join(rng.choices(common, k=rng.randint(5, 80)) + rng.choices(rare, k=rng.randint(0, 6))) for _ in range(1500)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, texts[0]), (40, texts[3]), (7, texts[7]), (1501, texts[20]), (1600, texts[20])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {}
    for r in search.search(docs, docs.where("doc_id % 20 = 0"), k=7, shard_words=9000).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.doc_id, round(r.score * 1e6)))
    own = [(k, Counter(t.encode().split())) for k, t in rows if k is not None]
    n, df = len(own), Counter(w for _, c in own for w in c)
    mean = sum(sum(c.values()) for _, c in own) / n
    for q in sorted({k for k, _ in own if k % 20 == 0}):
        asked = sum((c for k, c in own if k == q), Counter())
        weight = {w: m * np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) for w, m in asked.items()}
        points = [(-sum(int(np.floor(weight[w] * (f * 2.2 / (f + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))) * 1e6 + 0.5)) for w, f in c.items() if w in weight), k) for k, c in own]
        got = sorted(found[q])
        assert [r for r, _, _ in got] == list(range(1, 8))
        assert all(abs(-p - x) <= 60 for (p, _), (_, _, x) in zip(sorted(points)[:7], got, strict=True))
        assert {d for _, d, _ in got} <= {k for p, k in points if -p >= got[-1][2] - 60}

def test_weighted_sampling_estimates_likeness(spark, texts):
    rows = {r.doc_id: r for r in weighted_sampling.fingerprints(table(spark, texts)).collect()}
    texts = [t or "" for t in texts]
    miss = []
    for k, t in enumerate(texts):
        after, part = texts[(k + 1) % len(texts)], len(t) // 4
        edited = t[: len(t) - part] + after[:part]
        assert rows[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and rows[k].n_chars == len(t)
        a, b = (Counter(w for w in re.split(r"[\x20\x09-\x0D]+", x) if w) for x in (t, edited))
        miss.append(rows[k].near_edited - (sum((a & b).values()) / sum((a | b).values()) if a | b else 1))
    assert abs(np.mean(miss)) < 0.05 and np.abs(miss).max() < 0.3
    assert rows[0].fingerprint == rows[63].fingerprint == rows[64].fingerprint


def test_language_model_sums_to_one_and_counts(spark, texts):
    docs = table(spark, texts)
    model = language_model.train(docs)
    tokens = [[*(t or "").encode().lower().split(), None] for t in texts]
    count = Counter(w for t in tokens for w in t)
    assert (model.tokens, model.words) == (sum(count.values()), len(count))
    h = lambda w: language_model.END if w is None else np.uint64(xxhash.xxh64_intdigest(w))
    for before in (b"w1", b"the", b"never-seen"):
        every = [h(w) for w in count] + [h(b"unknown")]
        p = [10 ** model.score(np.array([h(before), w]), np.array([2]))[2][0] / 10 ** model.score(np.array([h(before)]), np.array([1]))[2][0] for w in every]
        assert sum(p) == pytest.approx(1, abs=1e-9)
    rows = {r.doc_id: r for r in language_model.score(docs, model).collect()}
    for k, t in enumerate(tokens):
        assert rows[k].n_tokens == rows[k].n_known == len(t)
        assert rows[k].base_score == pytest.approx(sum(np.log10((count[w] + 1) / (model.tokens + model.words + 1)) for w in t))


def test_language_model_of_each_order_equals_its_formula(spark, texts):
    docs = table(spark, texts)
    said = [[*(t or "").encode().lower().split(), None] for t in texts]
    for order in (2, 3, 4):
        model = language_model.train(docs, order=order)
        count = [None, *(Counter() for _ in range(order))]
        for t in said:
            padded = ["start"] * (order - 1) + t
            count[order].update(tuple(padded[k : k + order]) for k in range(len(t)))
        for n in range(order - 1, 0, -1):
            for g, c in count[n + 1].items():
                count[n][g[1:]] += c if g[1] == "start" else 1
        discount = [None] + [language_model.discounts([sum(c == k and not (n > 1 and g[1] == "start") for g, c in count[n].items()) for k in (1, 2, 3, 4)]) for n in range(1, order + 1)]
        after = [{} for _ in range(order + 1)]
        for n in range(1, order + 1):
            for g, c in count[n].items():
                after[n].setdefault(g[:-1], []).append(c)

        def p(g):
            n = len(g)
            if not n:
                return 1 / (len(count[1]) + 1)
            d, follow, c = discount[n], after[n].get(g[:-1], []), count[n][g]  # noqa: B023
            if not follow:
                return p(g[1:])
            return (max(c - (d[min(c, 3) - 1] if c else 0), 0) + sum(d[min(x, 3) - 1] for x in follow) * p(g[1:])) / sum(follow)

        rows = {r.doc_id: r.score for r in language_model.score(docs, model).collect()}
        for k, t in enumerate(said):
            want = sum(np.log10(p(tuple((["start"] + t)[max(0, i + 2 - order) : i + 2]))) for i in range(len(t)))
            assert rows[k] == pytest.approx(want, rel=1e-9)
    assert language_model.train(docs).order == 3


def test_licenses(spark):
    mit = dict(license_texts.TEXTS[:1])["MIT"]
    changed = "Copyright (c) 2020 Someone\n\n" + mit.replace("sublicense", "sub-licence").upper()
    rows = licenses.scan(table(spark, [changed, mit + " more", None, "Released under the MIT Licence!"])).orderBy("doc_id").collect()
    assert [r.license for r in rows] == ["MIT", None, None, "MIT notice"] and rows[2].digest is None
    said = licenses.scan(table(spark, ["Copyright 2020 A", "copyright 2020, a", "(c) B\nx", "X", " \n--"])).orderBy("doc_id").collect()
    assert said[0].digest == said[1].digest and said[2].digest == said[3].digest != said[0].digest and said[4].digest is None


def test_licenses_wrapped_and_whole(spark):
    texts = {name: text for name, text in reversed(license_texts.TEXTS)}
    wrapped = [(name, "Copyright (c) 2020, Some One <a@b.c>\nCopyright The Example Authors.\nAll rights reserved.\n\n" + re.sub(r" (copyright)\b", r"\n\1", texts[name], flags=re.I)) for name in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Unlicense")]
    folder = resources.files("thalweg.llm").joinpath("full_texts")
    whole = [(f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in folder.iterdir()]
    whole += [(name, "\n\n".join(textwrap.fill(x, width, break_long_words=False, break_on_hyphens=False) for x in text.split("\n\n"))) for name, text in whole if name in ("Apache-2.0", "CC0-1.0", "MPL-2.0") for width in (50, 70, 100)]
    rows = licenses.scan(table(spark, [t for _, t in wrapped + whole])).orderBy("doc_id").collect()
    assert [r.license for r in rows] == [name for name, _ in wrapped + whole]


def test_toxicity_learns_from_positives_and_unlabelled(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choices([f"w{j}" for j in range(200)], k=40)) + (" vileness" if k % 8 == 0 else "")) for k in range(400)]
    docs = spark.createDataFrame([*rows, (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 8 == 0)) for k in range(400)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels, (3, 1))).collect()}
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert np.mean([(got[k] >= 0.7) == (k % 8 == 0) for k in held]) > 0.95 and 0 <= got[None] < 0.7


def test_quality_separates(spark):
    rows = [(k, ("WIN!! CASH!! " * 20) if k % 4 == 0 else f"a calm sentence number {k} about rivers and their basins. " * (1 + k % 5)) for k in range(200)]
    docs = spark.createDataFrame([*rows, (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 != 0)) for k in range(200)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.classify(docs, labels, "quality", (4, 2)).collect()}
    assert all((got[k] >= 0.7) == (k % 4 != 0) for k in range(200)) and 0 <= got[None] <= 1
    assert quality.isotonic(np.array([0.0, 1, 2]), np.array([1.0, 0, 2]), np.ones(3))[1].tolist() == [0.5, 2.0]


def test_search_answers_many_queries_at_once_as_brute_force_does():
    rng = np.random.default_rng(5)
    words = np.array([b"w%d" % i for i in range(300)])
    texts = [b" ".join(words[np.minimum(rng.zipf(1.3, n) - 1, 299)]).decode() for n in rng.integers(1, 60, 700)]
    shard = search.Shard(30.0)
    for i, text in enumerate(texts):
        shard.add(1000 - i, text)
    shard.close()
    assert 0 < shard.frequent < 300
    asked = [([*dict.fromkeys(x.encode().split()), b"absent"], rng.random(len(set(x.split())) + 1) * 5) for x in texts[: 2 * search.TOGETHER + 3]] + [([b"absent"], np.ones(1))]
    parts = []
    for text in texts:
        tf, n = Counter(text.encode().split()), len(text.split())
        parts.append({w: c * (search.K1 + 1) / (c + search.K1 * (1 - search.B + search.B * n / 30.0)) for w, c in tf.items()})
    for (terms, weights), (ids, points) in zip(asked, shard.tops(asked, 7), strict=True):
        every = sorted((-sum(math.floor(w * p[t] * search.UNIT + 0.5) for t, w in zip(terms, weights, strict=True) if t in p), 1000 - i) for i, p in enumerate(parts))
        assert [(-p, i) for i, p in zip(ids.tolist(), points.tolist(), strict=True)] == [x for x in every[:7] if x[0] < 0]


def test_weighted_sampling_passes_over_words_without_changing_a_sample(spark, texts):
    pairs = weighted_sampling.edited(table(spark, texts))
    every = sorted(map(str, weighted_sampling.signatures(pairs, likely=None).drop("sure").collect()))
    # At 1 most texts have a sample that no word is likely enough for, and are done again.
    assert not weighted_sampling.signatures(pairs, likely=1.0).where("not sure").isEmpty()
    assert weighted_sampling.signatures(pairs).where("not sure").isEmpty()
    for likely in (1.0, weighted_sampling.LIKELY):
        assert sorted(map(str, weighted_sampling.sure_signatures(pairs, likely=likely).collect())) == every


def test_language_model_takes_few_bytes_and_deals_frequent_words_without_changing_a_score(spark, monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(("of", "the", f"w{int(rng.paretovariate(0.4)) % 20000}")) for _ in range(400)) for _ in range(150)]
    texts += ["", None, "the", "of the of the"]
    docs, models = table(spark, texts), {}
    for sample in (1, 10**9):  # all documents say which words are frequent; none does
        monkeypatch.setattr(language_model, "SAMPLE", sample)
        models[sample] = language_model.train(docs)
    assert len(models[1].finer) >= 2 and not len(models[10**9].finer)
    got = [[tuple(r) for r in language_model.score(docs, m).orderBy("doc_id").collect()] for m in models.values()]
    assert got[0] == got[1]
    said = [[None, None, *(t or "").encode().split(), b" "] for t in texts]
    grams = sum(len({tuple(t[k - n + 1 : k + 1]) for t in said for k in range(2, len(t))}) for n in (2, 3))
    for m in models.values():
        root = language_model._local(m.path)
        files = [f for f in os.listdir(root) if f.split("-")[0] != "1" and not f.endswith(".crc")]
        assert sum(os.path.getsize(f"{root}/{f}") for f in files) < 9.2 * grams


def test_language_model_messages_and_tables_give_back_what_they_hold(tmp_path):
    rng = np.random.default_rng(4)
    words = rng.integers(0, 2**64, 500, np.uint64)
    for n in (1, 2, 3, 4):
        grams = np.unique(words[np.minimum(rng.zipf(1.2, (n, 4000)) - 1, 499)], axis=1)
        count = rng.zipf(1.5, grams.shape[1]).astype(np.int64) % 10**9
        packed = language_model._packed_grams(grams, count, count + 1)
        got, counts = language_model._unpacked_grams(pa.scalar(packed, pa.binary()), n)
        assert sorted(zip(*got.tolist(), *(c.tolist() for c in counts), strict=True)) == sorted(zip(*grams.tolist(), count.tolist(), (count + 1).tolist(), strict=True))
        assert n < 3 or len(packed) < 11 * grams.shape[1]
    for size in (0, 1, 3, 5000):
        h = np.unique(rng.integers(0, 2**64, size, np.uint64))
        columns = [rng.zipf(1.2, len(h)).astype(np.int64) % 10**12 for _ in range(2)]
        language_model._write(f"file://{tmp_path}", f"t-{size}", h, columns)
        asked = np.unique(np.append(h, rng.integers(0, 2**64, 1000, np.uint64)))
        rows = language_model._Table(f"{tmp_path}/t-{size}").rows(asked, 2)
        there = np.isin(asked, h)
        assert (rows[there] == np.stack(columns, axis=1)).all() and not rows[~there].any()
