"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier on its posteriors."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import durable, written

#: Labelled rows from which the lexicon is mined, and rows on which the classifier is fitted: those with the smallest
#: hash of their id. These two bounds limit only what is fitted; votes, the label model and scores cover all rows.
LABELLED, FITTED = 40_000, 20_000
LEXICON, VOTERS, PREFIXES = 256, 48, (4, 5, 6, 7)
ROUNDS, THRESHOLD, REDUNDANT = 12, 0.3, 0.5
EDGES = ".,;:!?\"'()[]{}<>*_-…«»„“”"

#: Pattern voters: name, first guess of how often it fires on toxic and on clean texts.
PATTERNS = (
    ("two_terms", 0.6, 0.02),
    ("dense_terms", 0.5, 0.02),
    ("shouting", 0.1, 0.05),
    ("exclaims", 0.1, 0.05),
)


def terms(word: str) -> list[str]:
    """The word without punctuation at its edges, and its first letters as stems."""
    w = word.strip(EDGES)
    return [w, *[f"{w[:n]}~" for n in PREFIXES if len(w) > n]] if w else []


def _term_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = (Counter(), Counter())
        for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
            found[int(toxic > 0)].update({t for w in set(text.lower().split()) for t in terms(w)})
        names = list(found[0].keys() | found[1].keys())
        yield pd.DataFrame({"term": names, "clean": [found[0][t] for t in names], "toxic": [found[1][t] for t in names]})


def lexicon(labelled: DataFrame, size: int = LEXICON) -> tuple[pd.DataFrame, np.ndarray]:
    """(term, fires_toxic, fires_clean) of the terms that mark toxic texts best, from rows of (text, toxic), and the
    numbers of clean and toxic texts; equal texts count once."""
    once = durable(labelled.groupBy(F.sha2("text", 256).alias("digest")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).drop("digest"))
    n = dict(once.groupBy((F.col("toxic") > 0).cast("int")).count().collect())
    t, c = n.get(1, 0), n.get(0, 0)
    rate = lambda col, total: (F.col(col) + 0.5) / F.lit(total + 1.0)
    counts = once.mapInPandas(_term_counts, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    strong = counts.where(F.col("toxic") >= max(4, 0.01 * t)).withColumn("odds", F.log(rate("toxic", t) / rate("clean", c))).where("odds > 2.5 and toxic >= 0.9 * (toxic + clean)")
    best = strong.orderBy(F.desc(F.col("odds") * F.col("toxic")), "term").limit(4 * size).toPandas()
    chosen: list[str] = []
    for term in best["term"]:  # one term of a family: a stem or a word of it, whichever marks better
        stem = term.rstrip("~")
        if not any((x[-1] == "~" and stem.startswith(x[:-1])) or (term[-1] == "~" and x.startswith(stem)) for x in chosen):
            chosen.append(term)
    best = best[best["term"].isin(chosen[:size])]
    out = pd.DataFrame({"term": best["term"], "fires_toxic": (best["toxic"] + 0.5) / (t + 1), "fires_clean": (best["clean"] + 0.5) / (c + 1)})
    return out.reset_index(drop=True), np.array([c, t], dtype=float)


def _votes(batches: Iterator[pa.RecordBatch], index: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """Feature hits (terms, then patterns) of whole texts."""
    cache: dict[str, tuple] = {}
    for b in batches:
        out = []
        for text in b.column(2).to_pylist():
            words = text.split()
            hits = set()
            for w in set(text.lower().split()):
                f = cache.get(w)
                if f is None:
                    if len(cache) > 400_000:
                        cache.clear()
                    f = cache[w] = tuple(index[t] for t in terms(w) if t in index)
                if f:
                    hits.update(f)
            n, k = len(words), len(index)
            letters = sum(1 for w in words if len(w) > 3 and w.isupper())
            fires = (len(hits) >= 2, n > 0 and len(hits) * 50 >= n, n > 0 and letters * 3 > n, "!!" in text)
            out.append(sorted(hits) + [k + i for i, x in enumerate(fires) if x])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "held_out", "hits"])


class LabelModel:
    """Two latent classes; each voter fires at a rate of its own in each. Correlated voters share their weight.

    The first guesses of the rates and of the class balance stay in as so many pseudo-counts, which keeps
    the classes from turning into some other structure of the corpus (a language, a group of copies).
    """

    def __init__(self, toxic: np.ndarray, clean: np.ndarray, anchors: np.ndarray):
        self.rates = self.guess = np.clip(np.stack([clean, toxic]), 1e-5, 1 - 1e-5)
        self.anchors = np.maximum(anchors, [9.0, 1.0])
        self.prior, self.weight = self.anchors[1] / self.anchors.sum(), np.ones(len(toxic))

    def posterior(self, fired: np.ndarray) -> np.ndarray:
        clean, toxic = self.rates
        on, off = np.log(toxic / clean) * self.weight, np.log((1 - toxic) / (1 - clean)) * self.weight
        return 1 / (1 + np.exp(-np.clip(np.log(self.prior / (1 - self.prior)) + off.sum() + fired @ (on - off), -40, 40)))

    def update(self, moments: np.ndarray) -> None:
        """From the expected co-firing tables of both classes: rates, class balance, and correlations inside a class."""
        n = len(self.weight)
        total, tables = moments[:2], moments[2:].reshape(2, n, n)
        held = total + self.anchors
        self.prior = float(held[1] / held.sum())
        self.rates = np.clip((np.stack([np.diag(x) for x in tables]) + self.anchors[:, None] * self.guess) / held[:, None], 1e-5, 1 - 1e-5)
        own = np.stack([np.diag(x) for x in tables]) / np.maximum(total, 1)[:, None]
        joint = tables / np.maximum(total, 1)[:, None, None]
        spread = np.maximum(np.sqrt(own * (1 - own)), 1e-3)
        r = (joint - own[:, :, None] * own[:, None, :]) / (spread[:, :, None] * spread[:, None, :])
        # redundant voters only: a correlation over REDUNDANT between voters that fire often enough in the class to tell
        often = (own * total[:, None]) >= 10
        shared = np.where((r > REDUNDANT) & often[:, :, None] & often[:, None, :], np.minimum(r, 1), 0).max(axis=0)
        np.fill_diagonal(shared, 0)
        self.weight = 1 / (1 + shared.sum(axis=1))


def _moments(batches: Iterator[pd.DataFrame], model: LabelModel) -> Iterator[pd.DataFrame]:
    n = len(model.weight)
    total = np.zeros(2 + 2 * n * n)
    for pdf in batches:
        mask = pdf["mask"].to_numpy(dtype=np.int64)
        fired = ((mask[:, None] >> np.arange(n)) & 1).astype(float)
        p, count = model.posterior(fired), pdf["count"].to_numpy(dtype=float)
        for y, w in enumerate((count * (1 - p), count * p)):
            total[y] += w.sum()
            total[2 + y * n * n : 2 + (y + 1) * n * n] += ((fired * w[:, None]).T @ fired).ravel()
    yield pd.DataFrame({"k": np.arange(len(total)), "value": total})


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 12) -> np.ndarray:
    """Weights and bias of a ridge logistic regression on soft labels, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        w = w - np.linalg.solve(hessian, x.T @ (p - y) + penalty * w)
    return w


def toxicity_scores(docs: DataFrame, labels: DataFrame, held_out, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Labels are used only where `held_out` (a column of the id) is false, and only to mine the lexicon and a
    first guess of the voters' rates. The label model is fitted by expectation maximisation over the votes
    of all rows not held out, grouped by their pattern; a round sums one table of fixed size. The classifier
    is fitted on its posteriors. Null texts are empty; null labels are left out; of repeated labels of an id
    the largest counts; rows with a null id are not held out. Without labels the lexicon is empty and scores
    rest on patterns. An empty table gives an empty result; other columns are ignored.
    """
    h = F.coalesce(held_out, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), h.alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    # the held-out rule is a rule of the id alone, so it holds for labels as well
    sample = known.withColumnRenamed("doc_id", id_col).where(~h).withColumnRenamed(id_col, "doc_id").orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").limit(LABELLED)
    labelled = rows.where("not held_out").join(F.broadcast(sample), "doc_id").select("text", "toxic")
    terms_, anchors = lexicon(labelled)
    index = {t: i for i, t in enumerate(terms_["term"])}
    n_terms, n_voters = len(index), min(len(index), VOTERS)
    voted = written(rows.mapInArrow(lambda b: _votes(b, index), "doc_id long, held_out boolean, hits array<int>"))

    voters = [*range(n_voters), *range(n_terms, n_terms + len(PATTERNS))]
    place = {f: i for i, f in enumerate(voters)}
    bit = F.lit([1 << place[f] if f in place else 0 for f in range(n_terms + len(PATTERNS))]).cast("array<bigint>")
    mask = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, i: acc.bitwiseOR(F.element_at(bit, i + 1)))
    votes = durable(voted.where("not held_out").groupBy(mask.alias("mask")).count())
    model = LabelModel(np.array([*terms_["fires_toxic"][:n_voters], *[p[1] for p in PATTERNS]]), np.array([*terms_["fires_clean"][:n_voters], *[p[2] for p in PATTERNS]]), anchors)
    for _ in range(ROUNDS):
        model.update(_expected(votes, model))

    width = n_terms + len(PATTERNS)
    fitted = voted.where("not held_out").orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(FITTED).select("hits").toPandas()
    x = np.zeros((len(fitted), width))
    for i, hits in enumerate(fitted["hits"]):
        x[i, hits] = 1
    w = fit_linear(x, model.posterior(x[:, voters])) if len(fitted) else np.zeros(width + 1)
    weights = F.lit([float(v) for v in w[:-1]])
    z = F.aggregate("hits", F.lit(float(w[-1])), lambda acc, i: acc + F.element_at(weights, i + 1))
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    return voted.select("doc_id", "held_out", score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _expected(votes: DataFrame, model: LabelModel) -> np.ndarray:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _moments(batches, model)

    got = votes.mapInPandas(run, "k int, value double").groupBy("k").agg(F.sum("value").alias("value")).orderBy("k").toPandas()
    n = len(model.weight)
    return got["value"].to_numpy() if len(got) else np.zeros(2 + 2 * n * n)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity_scores(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
