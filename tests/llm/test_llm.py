"""Training-data operators against brute force, on small tables with nulls, ties, repeats, clashing names and no rows."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import os
import random
import tracemalloc
import types
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from panelforge.llm import chat, common, katz, line_dedup, mixing, packing, quality_rules, simhash, substring_dedup, toxicity
from panelforge.llm.common import connected_components
from panelforge.llm.exact_dedup import exact_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, rid string, batch string"
BLANKS = b" \t\n\x0b\x0c\r"


def texts() -> list[str | None]:
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = prose(120), prose(60)
    out = [prose(rng.randint(1, 150)) for _ in range(40)] + [base, base, base.replace("a", "b", 1), base + " tail"]
    out += [prose(30) + passage + prose(30) for _ in range(4)] + [None, "", " ", "One", "one two", "For " * 400, prose(6000), "x\ny\nx\n\n" + base, "éàü ñ 漢字 " * 30]
    for _ in range(6):
        ws = base.split()
        ws[rng.randrange(len(ws))] = "changed"
        out.append("\n".join([" ".join(ws), prose(20)]))
    return out


@pytest.fixture(scope="module")
def rows():
    ts = texts()
    got = [(i, t, "en", f"src{i % 4}" if i % 11 else None, None, "d", "r", "b") for i, t in enumerate(ts)]
    return [*got, got[40], (None, ts[3], None, None, 1, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def data(t):
    return (t or "").encode()


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(50)] + [(None, 3), (5, 5)]
    parent = {x: x for p in pairs if None not in p for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {x for p in pairs if None not in p and p[0] != p[1] for x in p}
    assert got == {x: find(x) for x in linked}


def test_exact_dedup(docs, rows, empty):
    got = exact_dedup(docs, heavy=4).collect()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[data(r[1])].append(r[0])
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(groups)
    by = {hashlib.sha256(t).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
    assert exact_dedup(empty).count() == 0


def fingerprint(text):
    ws = data(text).lower().split()
    shingles = [b" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("posting", [1, 2, 2048])
def test_simhash(docs, rows, empty, posting):
    got = simhash.near_duplicates(docs, posting=posting).collect()
    fp = [fingerprint(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if (fp[a] ^ fp[b]).bit_count() <= 3:
            parent[find(a)] = find(b)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    want = collections.Counter((r[0], f"{fp[i]:016x}", least.get(find(i))) for i, r in enumerate(rows))
    assert collections.Counter(map(tuple, got)) == want
    assert simhash.near_duplicates(empty).count() == 0


def shingle_set(text, k=5):
    ws = data(text).lower().split()
    return frozenset(tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))) if ws else frozenset()


def test_simhash_stage(spark, docs, rows, empty):
    ts = sorted({r[1] or "" for r in rows})
    sets = {t: shingle_set(t) for t in ts}
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    parent = {t: t for t in ts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(ts, 2):
        if near(a, b):
            parent[find(a)] = find(b)
    want = {}
    for r in rows:
        k = (r[0] is None, r[0] or 0, hashlib.sha256(data(r[1])).hexdigest())
        want[find(r[1] or "")] = min(want.get(find(r[1] or ""), k), k)
    got = simhash.stage_simhash(None, docs, "")
    assert got.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, hashlib.sha256(data(r.text)).hexdigest()) for r in got.collect()) == sorted(want.values())
    assert simhash.stage_simhash(None, empty, "").count() == 0


def test_simhash_stage_keeps_unlike_texts_of_one_id(spark):
    rows = [(5, "one two three four five six", 1), (5, "seven eight nine ten eleven", 2), (6, "a b c d e f g", 3), (None, "h i j k l m", 4), (None, "n o p q r s", 5), (6, "a b c d e f g", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k long")
    assert sorted(r.k for r in simhash.stage_simhash(spark, docs, "").collect()) == [1, 2, 3, 4, 5]


def test_quads_lie_in_any_five_positions():
    assert all(any(set(q) <= set(five) for q in simhash.EXACT.keys) for five in itertools.combinations(range(8), 5))


def _partition(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    groups = {}
    for n in nodes:
        groups.setdefault(find(n), set()).add(n)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("stage,posting,chunk", [(True, 32, 64), (True, 4, 7), (True, 2048, 1 << 14), (False, 4, 8), (False, 32, 64)])
def test_links_in_lists_of_any_length(spark, stage, posting, chunk):
    """Entries that all share the bytes asked for: no link is lost where lists are refined and dealt into parts."""
    base = simhash.STAGE if stage else simhash.EXACT
    index = simhash.Index(base.keys, base.width, base.least_bytes, base.most_bits, posting, chunk)
    rng = random.Random(posting)
    same = rng.randbytes(base.least_bytes)
    prints = []
    for _ in range(150):
        one = bytearray(same + rng.randbytes(base.width - len(same)))
        two = bytearray(one)
        # the pair shares just the bytes that the filter asks for, or a few more
        for at in range(len(same), base.width) if stage else rng.sample(range(len(same), base.width), 3):
            two[at] ^= 1 << rng.randrange(8)
        prints += [bytes(one), bytes(two)]
    prints = sorted(set(prints))
    brute = [
        (i, j) for i, j in itertools.combinations(range(len(prints)), 2)
        if sum(a == b for a, b in zip(prints[i], prints[j])) >= index.least_bytes and sum((a ^ b).bit_count() for a, b in zip(prints[i], prints[j])) <= index.most_bits
    ]
    entries = spark.createDataFrame([(bytearray(f), i) for i, f in enumerate(prints)], "fp binary, node long")
    got = [(r.a, r.b) for r in simhash.links(entries, index).collect()]
    assert len(brute) >= 100 and set(got) <= set(brute)
    assert _partition(range(len(prints)), got) == _partition(range(len(prints)), brute)


@pytest.mark.parametrize("changed", [0, 1])
def test_simhash_stage_recall(spark, changed):
    """Pairs of texts at 0.8 to 0.9 among unrelated ones."""
    rng = random.Random(8)
    rows, pairs = [], 0
    while pairs < 150:
        ws = [f"w{rng.randrange(5000)}" for _ in range(300)]
        other = list(ws)
        for i in rng.sample(range(300), 6 - 2 * changed):  # each change costs five shingles
            other[i] = "x"
        j = len(shingle_set(" ".join(ws)) & shingle_set(" ".join(other))) / len(shingle_set(" ".join(ws)) | shingle_set(" ".join(other)))
        if 0.8 <= j:
            rows += [(2 * pairs, " ".join(ws)), (2 * pairs + 1, " ".join(other))]
            pairs += 1
    kept = simhash.stage_simhash(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert all(r.doc_id % 2 == 0 for r in kept if r.doc_id - 1 not in {k.doc_id for k in kept} ) and len(rows) - len(kept) >= (0.9 if changed == 0 else 0.95) * pairs


def test_spans_of_history_rewriting_template():
    forgets = lambda ms: "".join(f"[{r}]{t if i == len(ms) - 1 else t[:3]};" for i, (r, t) in enumerate(ms))
    inc = chat.Incremental(forgets)
    assert [inc.add(m).rewrites for m in [("user", "hello there"), ("assistant", "long answer")]] == [False, True]
    # the last 20 turns only are rendered: history is rewritten from turn 20 on, and by a template that drops thoughts late
    last = lambda ms: "".join(f"[{r}]{t};" for r, t in ms[-20:])
    inc = chat.Incremental(last)
    assert [inc.add(("user", f"turn {i}")).rewrites for i in range(60)] == [i >= 20 for i in range(60)]
    late = lambda ms: "".join(f"[{r}]{t if len(ms) < 40 else t[:2]};" for r, t in ms)
    inc = chat.Incremental(late)
    assert [inc.add(("user", f"turn {i}")).rewrites for i in range(60)] == [i == 39 for i in range(60)]
    system = lambda ms: "".join(f"{r}>{ms[0][1] if i == len(ms) - 1 and i else ''}{t}|" for i, (r, t) in enumerate(ms))
    inc = chat.Incremental(system)
    assert any(inc.add(("user", f"turn {i}")).rewrites for i in range(30))
    inc = chat.Incremental(chat.chatml)
    for i in range(20):
        t = inc.add(("assistant", f"<|im_end|> {i} <\\|x|> <"))
        assert chat.unescape(t.segment[t.start : t.stop]) == f"<|im_end|> {i} <\\|x|> <" and not t.rewrites
        assert t.segment[t.role_start : t.role_stop] == "assistant"


@pytest.mark.parametrize("text", ["", "<", "<|", "<\\|", "<\\\\|x<|", "|", "a<|im_start|>b", "<<||>>"])
def test_escape_round_trip(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role(text + "\n\\n")) == text + "\n\\n"


def test_chat(spark):
    turns = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "a"), (None, None, None, None), (2, 0, "assistant", "x" * 5000)] + [(3, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(50)]
    got = {r.conv_id: r for r in chat.conversation_digests(chat.format_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).collect()}
    assert set(got) == {1, 2, 3, None} and got[1].n_turns == 3 and got[1].loss_chars == 2
    assert got[1].loss_sha256 == hashlib.sha256(b"ab").hexdigest()
    assert got[3].turns_sha256 == hashlib.sha256("".join(f"{'user' if i % 2 else 'assistant'}\nt{i}\n" for i in range(50)).encode()).hexdigest()
    assert got[1].formatted_chars == len(chat.chatml([("user", ""), ("assistant", "a"), ("assistant", "b")]))
    clash = spark.createDataFrame([(1, 0, "user", "x", "c", 1, "s", "l")], "conv_id long, turn long, role string, text string, conv string, ix long, segment string, loss string")
    assert chat.conversation_digests(chat.format_conversations(clash)).first().n_turns == 1
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_mixing(docs, rows, empty):
    got = mixing.mix(docs, block=8).collect()
    size = lambda t: len(data(t).split())
    total = collections.Counter()
    for r in rows:
        total[r[3]] += size(r[1])
    order = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [None]
    weight = dict(zip(order, itertools.cycle((5, 2, 1))))
    target, goal, capped = {}, 1.5 * sum(total.values()), set()
    while True:
        level = (goal - sum(2 * total[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and weight[s] * level > 2 * total[s]}
        if not more:
            break
        capped |= more
    target = {s: 2 * total[s] if s in capped else weight[s] * level for s in order}
    assert len(got) == len(rows)
    taken = collections.Counter()
    names = {r[0]: r[3] for r in rows}
    for r in got:
        s = names[r.doc_id] if r.doc_id is not None else None
        assert r.target == pytest.approx(target[s]) and r.source_size == total[s] and r.taken <= 2 * r.size
        taken[s] += r.taken
    largest = max(size(r[1]) for r in rows)
    assert all(abs(taken[s] - target[s]) <= largest for s in order)
    again = mixing.mix(docs.repartition(3), block=8).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(empty).count() == 0


def test_flight_keeps_both_totals():
    rng = random.Random(3)
    size, p = [float(rng.randint(1, 50)) for _ in range(500)], [rng.random() for _ in range(500)]
    q = mixing.flight(size, p, rng)
    assert sum(0 < x < 1 for x in q) <= 2
    assert sum(q) == pytest.approx(sum(p)) and sum(s * x for s, x in zip(size, q)) == pytest.approx(sum(s * x for s, x in zip(size, p)))
    land = mixing.landing(size, q, p)
    assert set(land) <= {0.0, 1.0}


def test_length_buckets_are_optimal():
    rng = random.Random(2)
    for n, k in ((1, 3), (7, 3), (9, 4), (10, 1), (12, 5)):
        x = sorted(rng.sample(range(1, 100), n))
        c = [rng.randint(1, 9) for _ in x]
        cost = lambda bounds: sum(m * next(b for b in bounds if b >= v) for v, m in zip(x, c))
        best = min(cost(sorted([*pick, x[-1]])) for r in range(min(k, n)) for pick in itertools.combinations(x[:-1], r))
        assert cost(packing.bucket_bounds(x, c, k)) == best


def test_packing(docs, rows, empty):
    got = packing.pack(docs, buckets=4, budget=500).collect()
    assert len(got) == len(rows)
    batches = collections.defaultdict(list)
    for r in got:
        assert r.length <= r.bucket_length and r.padding == r.bucket_length - r.length
        batches[r.bucket, r.batch].append(r)
    fits = {}
    for (b, _), rs in batches.items():
        most = max(1, 500 // max(rs[0].bucket_length, 1))
        assert sorted(r.slot for r in rs) == list(range(len(rs))) and len(rs) <= most
        fits.setdefault(b, []).append(len(rs) < most)
    assert all(sum(short) <= 1 for short in fits.values())
    assert packing.pack(empty).count() == 0


def test_packing_bounds_over_long_lengths(spark):
    """Lengths far apart and above 16,384: the bounds are the best of all choices."""
    lengths = [3, 17000, 17001, 17050, 40000, 40001, 99999, 100000, 5_000_000]
    rows = [(None, x) for x in lengths for _ in range(1 + x % 3)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, size long"), buckets=4, length=F.col("size")).collect()
    count = collections.Counter(x for _, x in rows)
    cost = lambda bounds: sum(m * (next(b for b in bounds if b >= v) - v) for v, m in count.items())
    best = min(cost(sorted([*pick, lengths[-1]])) for pick in itertools.combinations(lengths[:-1], 3))
    assert sum(r.padding for r in got) == best and len(got) == len(rows)


def test_katz(docs, rows, empty):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    toks = [[w for w in data(r[1]).lower().split()] + [None] for r in rows]
    train = [not held(r[0]) for r in rows]
    uni, big, hist = collections.Counter(), collections.Counter(), collections.Counter()
    for x, t in zip(toks, train):
        if t:
            uni.update(x)
            for a, b in zip([0, *x[:-1]], x):
                big[a, b] += 1
                hist[a] += 1
    n, k = sum(uni.values()), katz.DISCOUNTED
    d1, d2 = katz.good_turing(collections.Counter(uni.values())), katz.good_turing(collections.Counter(big.values()))
    disc = lambda d, c: c * (d[c] if c <= k else 1)
    unk = 1 - sum(disc(d1, c) for c in uni.values()) / n
    p1 = lambda w: disc(d1, uni[w]) / n if w in uni else unk
    after = collections.defaultdict(list)
    for (a, b), c in big.items():
        after[a].append((b, c))
    below, alpha = {}, {}
    for a, items in after.items():
        s = sum(disc(d2, c) for _, c in items)
        below[a] = hist[a] if hist[a] - s > 1e-9 * hist[a] else hist[a] + 1
        alpha[a] = (1 - s / below[a]) / (1 - sum(p1(b) for b, _ in items))
        assert sum(disc(d2, c) / below[a] for _, c in items) + alpha[a] * (sum(p1(w) for w in uni if (a, w) not in big) + unk) == pytest.approx(1)
    rule = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    for options in ({}, {"vocabulary": 50, "part_tokens": 100}, {"vocabulary": 1}, {"part_tokens": 30}):
        got = collections.defaultdict(list)
        for r in katz.katz_scores(docs, rule, **options).collect():
            got[r.doc_id].append(r)
        assert sum(map(len, got.values())) == len(rows)
        for r, x in zip(rows, toks):
            want = sum(math.log10(disc(d2, big[a, b]) / below[a] if (a, b) in big else alpha.get(a, 1) * p1(b)) for a, b in zip([0, *x[:-1]], x))
            base = sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (len(uni) + 1))) for w in x)
            g = min(got[r[0]], key=lambda g: abs(g.score - want))
            assert (g.held_out, g.n_tokens, g.train_tokens, g.n_known) == (held(r[0]), len(x), n, sum(w in uni for w in x))
            assert g.score == pytest.approx(want, rel=1e-9) and g.base_score == pytest.approx(base)
    assert katz.katz_scores(empty, rule).count() == 0


def test_katz_memory_of_a_part():
    """Scoring a part holds few columns of its tokens at a time."""
    rng, n, np = katz.np.random.default_rng(1), 400_000, katz.np
    u = katz.Unigrams(np.sort(rng.integers(0, 1 << 60, 5000)), rng.integers(1, 1000, 5000), 10**7, 5001, {r: 5000 // r for r in range(1, 7)}, 1000)
    code = np.sort((rng.integers(0, 1000, n) << katz.BITS) | (rng.zipf(1.3, n) % 5000))
    doc = rng.integers(0, 8000, n) | (rng.integers(0, 60, n) << (katz.DOC_BITS + 1)) | np.where(rng.random(n) < 0.8, katz._TRAIN, 0)
    entries, wide = katz._block(code, doc, rng.integers(1, 3, n)), katz._pack(*[np.zeros(0, dtype=k) for k in katz._WIDE])
    row = {"part": [3], "hot": [False], "n": [n], "entries": [entries], "batches": [np.arange(60, dtype="<i8").tobytes()], "m": [0], "wide": [wide]}
    shared = types.SimpleNamespace(value=(vars(u), np.zeros(0, dtype=np.int64)))
    rows = katz.pa.RecordBatch.from_pydict(row)
    del code, doc
    tracemalloc.start()
    try:
        out = list(katz._score_part(iter([rows]), shared, katz.good_turing({1: 9, 2: 4, 3: 2, 4: 1, 5: 1, 6: 1}), None, 7))
        assert tracemalloc.get_traced_memory()[1] < 80 * n
    finally:
        tracemalloc.stop()
    assert out[-1].num_rows == 60


def test_katz_ties_and_no_training_text(spark):
    """Twenty texts of words that occur once, under a cap they all tie at; and nothing to learn from."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(10))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [sorted((r.doc_id, round(r.score, 6)) for r in katz.katz_scores(docs, F.lit(False), vocabulary=v).collect()) for v in (50, 1000)]
    assert got[0] == got[1] and all(math.isfinite(s) for _, s in got[0])
    assert all(math.isfinite(r.score) and r.n_known == 0 for r in katz.katz_scores(docs, F.lit(True)).collect())


def test_substring_dedup(docs, rows, empty):
    starts = collections.Counter(data(r[1])[i : i + 200] for r in rows for i in range(len(data(r[1])) - 199))
    want = collections.Counter()
    for r in rows:
        t = data(r[1])
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if starts[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(t, gone) if not g)
        want[r[0], len(t), sum(gone), sum(1 for g, _ in itertools.groupby(gone) if g), hashlib.sha256(kept).hexdigest()] += 1
    assert collections.Counter(map(tuple, substring_dedup.substring_dedup(docs).collect())) == want
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_substrings_of_large_groups_and_segments(docs, monkeypatch):
    want = sorted(map(str, substring_dedup.substring_dedup(docs).collect()))
    monkeypatch.setattr(substring_dedup, "GROUP", 1)
    monkeypatch.setattr(substring_dedup, "CHUNK", 700)
    assert sorted(map(str, substring_dedup.substring_dedup(docs).collect())) == want


def test_large_groups_of_periodic_text(spark, monkeypatch):
    rng = random.Random(7)
    # the run whose gram hashes least is an anchor of every text
    grams = b"".join(bytes([c]) * substring_dedup.GRAM for c in range(33, 127))
    at = substring_dedup.np.arange(0, len(grams), substring_dedup.GRAM)
    run = chr(33 + int(substring_dedup.Hashes(substring_dedup.np.frombuffer(grams, dtype="u1")).of(at, at + substring_dedup.GRAM, 1).argmin())) * 45
    noise = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(250))
    rows = [(i, noise() + run + noise()) for i in range(50)]
    rows += [(50, rows[0][1]), (51, rows[1][1][100:400]), (52, run * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(str, substring_dedup.substring_dedup(docs).collect()))
    monkeypatch.setattr(substring_dedup, "GROUP", 1)
    got = substring_dedup.substring_dedup(docs).collect()
    assert sorted(map(str, got)) == want
    assert {r.doc_id for r in got if r.n_removed} == {0, 1, 50, 51, 52}


def test_maximal_repeats_by_hand():
    left, right = [x[::-1] for x in (b"..abc", b"..abc", b"..xbc")], [b"defgh1", b"defgh2", b"defzzz"]
    assert sorted((a, b, sorted(g)) for a, b, g in substring_dedup.maximal_repeats(left, right, 4)) == [(2, 3, [0, 1, 2]), (5, 5, [0, 1])]


def test_scan_by_arrays_covers_what_the_maximal_repeats_cover(monkeypatch):
    rng = random.Random(1)
    draw = lambda of, least, most: "".join(rng.choice(of) for _ in range(rng.randint(least, most))).encode()
    for _ in range(300):
        n, of, least = rng.randint(2, 30), rng.choice(["ab", "abc", "a"]), rng.randint(3, 9)
        left, right = [draw(of, 0, 8) for _ in range(n)], [draw(of, 1, 9) for _ in range(n)]
        want = {}
        for x, y, group in substring_dedup.maximal_repeats(left, right, least):
            for g in group:
                want[g] = (max(x, want.get(g, (0, 0))[0]), max(y, want.get(g, (0, 0))[1]))
        assert substring_dedup.reach(left, right, least) == want
    # near copies lie in nested runs, which were listed whole each
    base, sizes, whole = draw("abcdefgh", 360, 360), [], substring_dedup.maximal_repeats
    texts = [base[:k] + b"x" + base[k + 1 :] for k in range(205, 305)]
    monkeypatch.setattr(substring_dedup, "maximal_repeats", lambda left, right: sizes.append(len(left)) or whole(left, right))
    pa = substring_dedup.pa
    kind = pa.struct([("doc_id", pa.int64()), ("th", pa.int64()), ("pos", pa.int64()), ("single", pa.bool_()), ("before", pa.binary()), ("after", pa.binary())])
    members = pa.array([[{"doc_id": i, "th": i, "pos": 160, "single": True, "before": t[:160], "after": t[160:]} for i, t in enumerate(texts)]], pa.list_(kind))
    (spans,) = substring_dedup._group_spans([pa.RecordBatch.from_arrays([members], ["members"])])
    assert sorted(spans.column(0).to_pylist()) == list(range(100)) and set(spans.column(2).to_pylist()) == {0}
    assert dict(zip(spans.column(0).to_pylist(), spans.column(3).to_pylist(), strict=True))[0] == 205 and not sizes


def test_quality_rules(docs, rows, empty):
    got = quality_rules.quality_rules(docs).collect()
    assert len(got) == len(rows)
    want = collections.Counter()
    for r in rows:
        ws = data(r[1]).split()
        w8 = collections.Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
        rep = {j for i in range(len(ws) - 7) if w8[tuple(ws[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in data(r[1]).split(b"\n") if x.strip(BLANKS)]
        want[r[0], len(ws), sum(len(w.decode()) for w in ws), sum(c in "#*$%&|<>" for c in r[1] or ""), len(lines) - len(set(lines)), len(rep), len(ws) < 20 or 100 * len(rep) > 30 * len(ws)] += 1
    assert collections.Counter(tuple(r)[:7] for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)
    assert quality_rules.quality_rules(empty).count() == 0
    assert all(r.kept for r in quality_rules.quality_rules(docs, limit=1.0).collect() if not r.base_failed)
    assert not any(r.kept for r in quality_rules.quality_rules(docs, limit=0.0).collect())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_toxicity_finds_held_out_labels(spark):
    got = toxicity.op3_toxicity(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    r = got.join(labels, "doc_id").where("held_out").agg(F.sum(F.col("predicted") * F.col("toxic")).alias("hit"), F.sum("predicted").alias("said"), F.sum("toxic").alias("is")).first()
    assert got.count() == 1000 and r.hit >= 0.6 * r["is"] and r.hit >= 0.8 * r.said
    assert got.where("score < 0 or score > 1 or score is null").count() == 0


def test_toxicity_edges(spark, docs, empty):
    rule = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity_scores(docs, none, rule).count() == docs.count()
    few = spark.createDataFrame([(1, None, 1), (1, 1, 0), (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity_scores(docs, few, rule).where("score is null").count() == 0
    assert toxicity.toxicity_scores(empty, none, rule).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, names = docs.columns, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "simhash", "mixing", "packing"]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        out = stage(spark, docs, "/root/testdata/sf0.001")
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= before and docs.count() > 0
        if i < 4:
            assert docs.columns == columns


def test_pipeline_stages_take_any_rows(spark, docs, empty):
    import corpus_pipeline

    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for d in (docs, empty):
            out = stage(spark, d, "")
            assert out.count() >= 0 and (i == 4 or out.columns == d.columns)


def test_whole_texts_are_dealt_out_once_at_most(spark):
    """Quality rules and mixing join small tables of hosts and sources to texts; SimHash deals rows out by one key."""
    docs = spark.createDataFrame([(i, f"{i} " + " ".join(f"w{i}x{k}" for k in range(40)), "en", f"s{i % 3}", 9) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "-1")  # as if tables were large
    try:
        # of mixing: texts and what is taken, by row; of SimHash: whole rows by id and digest, and of ids alone what is kept (4)
        for stage, most in ((quality_rules.stage_quality, 0), (mixing.stage_mixing, 2), (simhash.stage_simhash, 5)):
            out = stage(spark, docs, "")
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert out.count() == 40 or stage is mixing.stage_mixing
            assert plan.count("Exchange hashpartitioning") <= most, (stage, plan)
    finally:
        spark.conf.set(setting, before)


def test_nothing_that_grows_is_broadcast_by_a_guess(spark, monkeypatch):
    """Postings are 48 rows a text, which Spark takes for one; neither they nor their keys may go through the driver."""
    monkeypatch.setattr(common, "FEW", 0, raising=False)
    docs = spark.createDataFrame([(i, " ".join(f"w{i // 2}x{k}" for k in range(60 + i % 2)), "en", "s", 9) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = common.written(docs)
    store = spark._jsparkSession.sharedState().statusStore()
    before, setting = store.executionsCount(), "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(setting)
    spark.conf.set(setting, "1g")
    try:
        assert simhash.stage_simhash(spark, docs, "").count() == 30
    finally:
        spark.conf.set(setting, was)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    found, done = [], store.executionsList()
    for i in range(done.size()):
        if done.apply(i).executionId() >= before:
            nodes = store.planGraph(done.apply(i).executionId()).allNodes()
            found += [n.name() for n in (nodes.apply(k) for k in range(nodes.size())) if n.name().startswith("BroadcastExchange")]
    assert not found


@pytest.mark.parametrize("most", [8, 0])
def test_stage_verifies_all_candidates_of_a_list(spark, monkeypatch, most):
    """In lists of one shared byte unlike texts meet alike ones: a forest of all that meet has few of the alike pairs."""
    rng = random.Random(5)
    monkeypatch.setattr(simhash, "STAGE", simhash.Index([(0,)], 32, 1, 256))
    monkeypatch.setattr(simhash, "MOST_PAIRS", most, raising=False)
    rows = []
    for i in range(0, 240, 3):
        ws = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        rows += [(i, " ".join(ws)), (i + 1, " ".join([*ws[:-4], "a", "b", "c", "d"])), (i + 2, " ".join(f"u{rng.randrange(10**6)}" for _ in range(120)))]
    sets = [simhash.shingle_hashes(t) for _, t in rows]
    first = [simhash._majority(np.stack([simhash._mix(h, 1000 + i) for i in range(4)], axis=1))[0] for h in sets]
    alike = {i + 1 for i in range(0, 240, 3) if first[i] == first[i + 1]}
    assert len(alike) > 20 and all(len(np.intersect1d(sets[i], sets[i - 1])) >= 0.8 * len(np.union1d(sets[i], sets[i - 1])) for i in alike)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {i for i, _ in rows} - {r.doc_id for r in simhash.stage_simhash(spark, docs, "").collect()} == alike


def test_a_wrong_declaration_of_reach_is_found(spark):
    """Templates that say a turn depends on itself alone, but drop or count earlier turns in longer conversations."""
    drops = lambda ms: chat.chatml(ms[1:] if len(ms) > 2 else ms)
    late = lambda ms: chat.chatml(ms) + "!" * (len(ms) > 5)
    drops.reach = late.reach = 0
    given = spark.createDataFrame([(n, k, "user", f"text {k}") for n in (1, 2, 3, 4, 7, 9) for k in range(n)], "conv_id long, turn long, role string, text string")
    for template, wrong in ((chat.chatml, set()), (drops, {3, 4, 7, 9}), (late, {7, 9})):
        out = chat.conversation_digests(chat.format_conversations(given, template)).collect()
        assert {r.conv_id for r in out if r.rewrites_history} == wrong
        assert {r.conv_id: r.n_turns for r in out} == {n: n for n in (1, 2, 3, 4, 7, 9)}
