"""BPE, whitening and divergence against brute force, on small tables with nulls, ties, repeats, clashing names and no rows."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import bpe, divergence, queries, whitening

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "e", "t", "the", " ", "  ", "\n", "'s", "'", "é", "漢", "1", "23", ".", "--", "<|endoftext|>", "<|endof", "aaa", "in", "g", "\t", "　", "😀", "ing", " t", "h", "\x1c", "\x85"]


@pytest.fixture(scope="module")
def tables():
    return bpe.load_tables(PATH)


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def theirs(library, texts):
    return [np.array(x.ids, dtype="<u4").tobytes() for x in library.encode_batch(texts, add_special_tokens=False)]


def test_encoder_equals_library(tables, library):
    rng = random.Random(1)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(rng.choice("etaoinshrdlucmfwyp") for _ in range(rng.randint(1, 14))) for _ in range(20000)]
    texts += ["a" * 5000 + " " * 900 + "ab" * 300, "".join(rng.choice("etaoinshrdlu") for _ in range(20000)), "ab " * 10 + "<|endoftext|>" * 100]
    encoder = bpe.Encoder(tables)
    assert encoder.encode(texts) == theirs(library, texts)
    assert encoder.merged > 1000  # the exact branch was used


def test_every_kind_of_character(tables, library):
    odd = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 7 == 0)]
    texts = [f"a{c}b {c}{c} 1{c}" for c in odd if unicodedata.category(c) != "Cn"]
    assert bpe.Encoder(tables).encode(texts) == theirs(library, texts)


def test_compatible_is_exact(tables):
    rng = np.random.default_rng(2)
    sound = np.flatnonzero(tables.sound)
    common = np.concatenate([rng.choice(sound, (20000, 2)), rng.choice(sound[sound < 1500], (20000, 2))])
    pairs = {(k >> 32, k & 0xFFFFFFFF): (r, m) for k, r, m in zip(tables.keys.tolist(), tables.ranks.tolist(), tables.made.tolist(), strict=True)}
    single = {t: i for i, t in enumerate(tables.tokens) if len(t) == 1}
    alone = [bpe._merged([single[bytes([c])] for c in tables.tokens[a] + tables.tokens[b]], pairs)[0] == [a, b] for a, b in common.tolist()]
    got = bpe.compatible(tables, common[:, 0], common[:, 1])
    assert got.tolist() == alone and 0 < sum(alone) < len(alone)


def test_long_runs_and_little_memory(tables, library, monkeypatch):
    monkeypatch.setattr(bpe, "CUT", 64)
    monkeypatch.setattr(bpe, "KEPT", 8)
    monkeypatch.setattr(bpe, "LONGEST", 4)
    texts = ["one  two three\nfour 's 12 " * 40, "x" * 500, " lead " * 30, "", "a b"] * 3
    assert bpe.Encoder(tables).encode(texts) == theirs(library, texts)


def test_bpe_round_trip(spark, library):
    texts = ["Plain words, here.", None, "", " ", "é漢😀 <|endoftext|>x", "word " * 30000, "same", "same"]
    rows = [(i if i != 3 else None, t, "x", b"y", "z") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded binary, n_tokens string").repartition(3)
    out = {(r.doc_id, r.decoded): r for r in bpe.bpe_decode(bpe.bpe_encode(docs, PATH), PATH).collect()}
    for i, t in enumerate(texts):
        r = out[i if i != 3 else None, t or ""]
        assert bytes(r.ids) == theirs(library, [t or ""])[0] and r.n_tokens == len(r.ids) // 4
        assert r.decoded == library.decode(np.frombuffer(r.ids, "<u4").tolist(), skip_special_tokens=False)
    assert bpe.bpe_decode(bpe.bpe_encode(docs.limit(0), PATH), PATH).count() == 0
    bad = spark.createDataFrame([(bytes([0xA0, 0, 0, 0, 1, 255, 255, 0]),), (None,)], "ids binary")
    assert {r.decoded for r in bpe.bpe_decode(bad, PATH).collect()} == {library.decode([0xA0, 16776961], skip_special_tokens=False), None}


def test_op11_on_a_table(spark, library, tmp_path):
    texts = ["one two", None, "Über <|endoftext|>", "tt " * 50]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.QUERIES["op11_bpe"](spark, str(tmp_path)).collect():
        ids = theirs(library, [texts[r.doc_id] or ""])[0]
        assert (r.n_tokens, r.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def vectors(n=400, d=20, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)) * np.linspace(3, 0.2, d)
    return np.vstack([x, x[:50], x[:1].repeat(80, 0)]).astype("float32")


def brute(x):
    z = np.floor(64 * x.astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(z, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = (fit * n - s) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    return z, n, s, e[::-1], u[:, ::-1]


@pytest.mark.parametrize("d", [20, 3])
def test_whitening_equals_dense(spark, d):
    x = vectors(d=d)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(None, None, 2), (900, [None] * d, 1), (901, [float("nan")] * d, 1), (902, [float("inf")] * d, 1), (903, [], 1), (904, [1.0], 1), (905, x[0].tolist()[:-1] + [None], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int").repartition(4)
    z, n, s, e, u = brute(x)
    got = whitening.whiten(df).collect()
    k = min(16, d)
    assert len(got) == len(x) * k and {r.n for r in got} == {n}
    w = (z * n - s) / n @ u / np.sqrt(e)
    signs = {}
    for r in got:
        want, j = w[r.vec_id, r.component - 1], r.component
        if abs(want) > 1e-3:
            assert signs.setdefault(j, np.sign(want * r.whitened)) == np.sign(want * r.whitened)
        assert abs(abs(want) - abs(r.whitened)) < 1e-9 * max(1, abs(want))
        assert r.deviation == int(((z[r.vec_id] * n - s) ** 2).sum())
        assert abs(r.explained - e[j - 1] / e.sum()) < 1e-12 and r.identity_error < 1e-10


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], schema)).count() == 0
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 5.0]), (2, [2.0, 5.0]), (2, [2.0, 5.0]), (None, [4.0, 5.0])], schema)).collect()
    assert [r.component for r in flat] == [1] * 4 and {r.n for r in flat} == {3} and max(r.identity_error for r in flat) < 1e-12
    tied = whitening.whiten(spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(np.vstack([np.eye(6), -np.eye(6)]))], schema)).collect()
    assert len(tied) == 72 and max(r.identity_error for r in tied) < 1e-12


def test_jacobi_davidson_without_the_whole_space():
    rng = np.random.default_rng(4)
    z = rng.standard_normal((2000, 300)) * 0.95 ** np.arange(300)
    v = z.T @ z / len(z)
    seen = []
    e, u = whitening.jacobi_davidson(lambda b: seen.append(b.shape[1]) or z.T @ (z @ b) / len(z), 300, 16)
    assert np.abs(e - np.linalg.eigvalsh(v)[::-1][:16]).max() < 1e-13 * e[0] and np.linalg.norm(v @ u - u * e, axis=0).max() < 1e-12 * e[0]
    assert len(seen) < 120
    e, u = whitening.jacobi_davidson(lambda b: z.T @ (z @ b) / len(z), 300, 4, at_once=2, inner=3)
    assert np.linalg.norm(v @ u - u * e, axis=0).max() < 1e-12 * e[0]


def test_partial_sums_in_levels(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    x = vectors(60, 5)
    df = spark.createDataFrame([(v.tolist(),) for v in np.floor(x * 64).astype(int)], "x array<long>").distinct().repartition(7)
    fit = whitening.FitList(df, 5)
    assert fit.parts > 2
    c = np.unique(np.floor(x * 64).astype(float), axis=0)
    c = c - c.mean(axis=0)
    assert np.allclose(fit.product(np.eye(5)), c.T @ c / len(c), rtol=1e-12)


def audit(rows, least, listed):
    term = re.compile(divergence.TERM)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups, in_docs = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for _, text, lang, source, *_ in rows:
        ts = term.findall((text or "").translate(lower))
        groups[lang or "", source or ""].update(ts)
        in_docs[lang or ""].update(set(ts))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in in_docs[lang].items() if n >= least]
        share = lambda c: {t: 1 + (10**9 * (c[t] + 5)) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        own = {s: share(c) for (l, s), c in groups.items() if l == lang}  # noqa: E741
        whole = share(sum((c for (l, _), c in groups.items() if l == lang), collections.Counter()))  # noqa: E741
        for s, p in own.items():
            pairs = [(o, sum(abs(p[t] - q[t]) for t in kept)) for o, q in own.items() if o != s]
            terms = [(t, p[t] - whole[t]) for t in kept if groups[lang, s][t] and p[t] > whole[t]]
            for part, some, last in (("pair", pairs, None), ("term", terms, listed)):
                for rank, (item, value) in enumerate(sorted(some, key=lambda x: (-x[1], x[0].encode()))[:last], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


@pytest.mark.parametrize(("groups", "terms", "least"), [(64, 4096, 3), (2, 7, 3), (3, 4096, 2), (1, 1, 40)])
def test_divergence_equals_brute_force(spark, groups, terms, least):
    rng = random.Random(6)
    words = ["alpha", "Beta", "beta", "漢字", "éa", "x1y", "gamma-delta", "tail", "Ünder"] + [f"{a}{b}" for a in "pqrs" for b in "tuvw"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))), rng.choice(["en", "de", None]), rng.choice([f"s{j}" for j in range(9)] + [None, "é", "\U0001f600", "｡"]), "x") for i in range(160)]
    rows += [rows[0]] * 5 + [(None, None, "xx", "a", None), (None, "", "xx", "b", None), (7, "only", "yy", "z", None), (8, "long " * 20000, "en", "s1", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n string").repartition(5)
    got = [tuple(r) for r in divergence.divergence(df, least, groups, terms, listed=4).collect()]
    want = audit(rows, least, 4)
    assert len(got) == len(set(got)) == len(want) and set(got) == want


def test_divergence_of_nothing(spark):
    assert divergence.divergence(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def test_shares_are_exact_beyond_a_long(spark):
    n, total, v = 5 * 10**12, 7 * 10**15, 10**6
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(v)).alias("p")).first().p
    assert got == 1 + (10**9 * (n + 5)) // (total + 5 * v)


def test_counters_are_flushed(spark, monkeypatch):
    rows = [(i, f"w{chr(97 + i % 26)} common", "en", f"s{i % 3}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(2)
    monkeypatch.setattr(divergence, "COUNTERS", 4)
    monkeypatch.setattr(divergence, "SLICE", 40)
    got = {tuple(r) for r in divergence.divergence(df, 2).collect()}
    assert got == audit(rows, 2, 50)
