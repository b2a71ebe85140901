"""Source divergence audit: how far the term shares of every two sources of a language lie apart.

Every two groups meet in every term, so the work is a cube: groups x groups x terms. It is cut into cells of one block of
groups, another of the same language, and one block of its terms. A slice of counts (a block of groups, a block of terms)
is copied to the cells of all partner blocks; a cell adds up partial divergences of its pairs, and the partial sums are
added along the term axis. A cell holds two dense slices of bounded size, whatever the number of sources and terms.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import by_bytes, lower_ascii, written

#: A term is a run of ASCII letters and of characters beyond ASCII; of these only A-Z are lower-cased.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents that must hold a kept term, added to every count, and what one is in shares.
LEAST_DOCS, ADDED, ONE = 30, 5, 1_000_000_000
#: Groups and terms of a block on average, terms listed of each group, and counters a task holds.
GROUPS, TERMS, LISTED, COUNTERS = 64, 4096, 50, 400_000
SLICE = 1 << 22
#: So many languages are broadcast at most, a row each; of more, none can hold much of the table's groups or terms.
LANGS = 10_000


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of a task's documents, added up before they move; a null term says that a group occurs."""
    found = regex.compile(TERM).findall
    total: dict[tuple, Counter] = defaultdict(Counter)
    docs: dict[tuple, Counter] = defaultdict(Counter)

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), some in total.items():
            terms = [None, *some]
            held = docs[lang, source]
            columns = [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([0, *some.values()], pa.int64()), pa.array([0, *map(held.__getitem__, some)], pa.int64())], ["lang", "source", "term", "n", "docs"])
        total.clear()
        docs.clear()

    for b in by_bytes(batches, 2, SLICE):
        for lang, source, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            terms = Counter(found(text))
            total[lang, source].update(terms)
            docs[lang, source].update(terms.keys())
        if sum(map(len, total.values())) > COUNTERS:
            yield from out()
    yield from out()


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term of each group, dealt by (lang, term).

    A row with a null term stands for each group that occurs. Tasks add up first, so a frequent term is as many rows
    as tasks and sources saw it.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), lower_ascii(text(text_col)).alias("text"))
    parts = rows.mapInArrow(_counts, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count, total, size):
    """1 + floor(ONE * (count + ADDED) / (total + ADDED * size)), in exact decimals at any count."""
    whole = lambda c: c.cast("decimal(19,0)")
    top, below = F.lit(ONE).cast("decimal(10,0)") * (whole(count) + ADDED), whole(total) + whole(size) * ADDED
    return F.call_function("div", top.cast("decimal(38,0)"), below.cast("decimal(38,0)")) + 1


def _slices(rows: pd.DataFrame) -> pd.DataFrame:
    """One slice as packed columns: group and term numbers inside their blocks, and shares."""
    pack = lambda c, t: rows[c].to_numpy().astype(t).tobytes()
    first = rows.iloc[0]
    return pd.DataFrame({"lang": [first["lang"]], "gb": [first["gb"]], "tb": [first["tb"]], "groups": [pack("g", "<i4")], "terms": [pack("t", "<i4")], "shares": [pack("p", "<i8")]})


def _cell(rows: pd.DataFrame) -> pd.DataFrame:
    """Partial divergences of one cell: all pairs of its two blocks of groups, over its block of terms."""
    first = rows.iloc[0]
    if first["i"] != first["j"] and len(rows) < 2:  # the partner block holds no group
        return pd.DataFrame(columns=["lang", "i", "j", "a", "b", "value"])
    size = int(first["size"])
    dense = {}
    for side, g, t, p, none in zip(rows["side"], rows["groups"], rows["terms"], rows["shares"], rows["none"], strict=True):
        m = np.repeat(np.asarray(none, dtype=np.int64)[:, None], size, axis=1)
        if g is not None:
            m[np.frombuffer(g, dtype="<i4"), np.frombuffer(t, dtype="<i4")] = np.frombuffer(p, dtype="<i8")
        dense[side] = m
    left, right = dense[0], dense.get(1, dense[0])
    sums = np.stack([np.abs(row - right).sum(axis=1) for row in left])
    a, b = np.nonzero(np.ones_like(sums, dtype=bool) if 1 in dense else np.triu(np.ones_like(sums, dtype=bool), 1))
    return pd.DataFrame({"lang": first["lang"], "i": first["i"], "j": first["j"], "a": a.astype("int32"), "b": b.astype("int32"), "value": sums[a, b]})


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, groups: int = GROUPS, terms: int = TERMS, listed: int = LISTED) -> DataFrame:
    """(lang, source, part, item, value, rank): each group's divergence from every other of its language, and its over-used terms.

    Null text, lang and source count as ''. Part `pair` has a row for every ordered pair of sources of a language, also
    of those without terms (0 where the language keeps none). Part `term` has the `listed` kept terms by which a group
    lies most above its language. Rows of documents count each for themselves, repeated ones too; no documents give no
    rows; other columns are ignored. Values are sums of whole numbers, so results do not depend on the order of work.
    """
    found = written(term_counts(docs))
    every = found.where("term is null").select("lang", "source")
    seen = found.where("term is not null")
    kept = written(
        seen.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("of_lang")).where(F.col("docs") >= least_docs)
        .select("lang", "term", "of_lang")
    )
    counts = written(seen.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "of_lang"))
    size = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("of_lang").alias("lang_total"))
    lang = every.groupBy("lang").agg(F.count(F.lit(1)).alias("g_count")).join(size, "lang", "left").select(
        "lang", F.ceil(F.col("g_count") / groups).cast("int").alias("g_blocks"), F.coalesce("v", F.lit(0)).cast("long").alias("v"),
        F.greatest(F.lit(1), F.ceil(F.coalesce("v", F.lit(0)) / terms)).cast("int").alias("t_blocks"), F.coalesce("lang_total", F.lit(0)).cast("long").alias("lang_total"),
    )
    lang = written(lang)
    lang = F.broadcast(lang) if lang.count() <= LANGS else lang  # a join by language alone would gather one in a task
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    number = lambda by, c: (F.row_number().over(Window.partitionBy("lang", by).orderBy(c)) - 1).cast("int")
    group = written(
        every.join(totals, ["lang", "source"], "left").join(lang, "lang").withColumn("total", F.coalesce("total", F.lit(0)).cast("long"))
        .withColumn("gb", block("source", "g_blocks")).withColumn("g", number("gb", "source"))
        .withColumn("none", share(F.lit(0), F.col("total"), F.greatest("v", F.lit(1))))
    )
    term = kept.join(lang, "lang").withColumn("tb", block("term", "t_blocks")).withColumn("t", number("tb", "term")).select("lang", "term", "tb", "t")
    shares = written(
        counts.join(group.select("lang", "source", "total", "v", "lang_total", "gb", "g"), ["lang", "source"]).join(term, ["lang", "term"])
        .select("lang", "source", "term", "gb", "g", "tb", "t", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), share(F.col("of_lang"), F.col("lang_total"), F.col("v")).alias("q"))
    )
    over = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    top = ranked(over).where(F.col("rank") <= listed).withColumn("part", F.lit("term"))

    # every block of groups has a slice in every block of terms, empty ones too, as absent terms have a share as well
    packed = shares.select("lang", "gb", "tb", "g", "t", "p").groupBy("lang", "gb", "tb").applyInPandas(_slices, "lang string, gb int, tb int, groups binary, terms binary, shares binary")
    ends = group.groupBy("lang", "gb", "g_blocks", "t_blocks").agg(F.array_sort(F.collect_list(F.struct("g", "none"))).alias("all"))
    base = ends.select("lang", "gb", "g_blocks", F.explode(F.sequence(F.lit(0), F.col("t_blocks") - 1)).alias("tb"), F.col("all.none").alias("none"))
    sizes = term.groupBy("lang", "tb").agg(F.count(F.lit(1)).cast("int").alias("size"))
    slices = written(base.join(sizes, ["lang", "tb"]).join(packed, ["lang", "gb", "tb"], "left"))
    partner = F.explode(F.sequence(F.lit(0), F.col("g_blocks") - 1)).alias("other")
    held = ("size", "groups", "terms", "shares", "none")
    copies = slices.select("lang", "tb", "gb", partner, *held).select(
        "lang", F.least("gb", "other").alias("i"), F.greatest("gb", "other").alias("j"), "tb", F.when(F.col("gb") <= F.col("other"), 0).otherwise(1).alias("side"), *held
    )
    partial = copies.groupBy("lang", "i", "j", "tb").applyInPandas(_cell, "lang string, i int, j int, a int, b int, value long")
    summed = partial.groupBy("lang", "i", "j", "a", "b").agg(F.sum("value").alias("value"))
    name = lambda side, b, g: group.select("lang", F.col("gb").alias(b), F.col("g").alias(g), F.col("source").alias(side))
    named = written(summed.join(name("one", "i", "a"), ["lang", "i", "a"]).join(name("two", "j", "b"), ["lang", "j", "b"]).select("lang", "one", "two", "value"))
    bare = group.where("v = 0").select("lang", "source")
    nothing = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").where("source != item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    both = named.select("lang", F.col("one").alias("source"), F.col("two").alias("item"), "value").unionByName(named.select("lang", F.col("two").alias("source"), F.col("one").alias("item"), "value"))
    pairs = ranked(both.unionByName(nothing)).withColumn("part", F.lit("pair"))
    order = ("lang", "source", "part", "item", "value", "rank")
    return pairs.select(*order).unionByName(top.select(*order))


def op13_divergence(spark, sf_dir: str) -> DataFrame:
    """Divergences of all groups of `documents`."""
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS terms FROM documents),
e AS (SELECT rid, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS ln FROM e GROUP BY ALL HAVING count(DISTINCT rid) >= {LEAST_DOCS}),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM e GROUP BY ALL),
f AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, ln, sum(coalesce(n, 0)) OVER (PARTITION BY g.lang, g.source) AS total,
  count(*) OVER (PARTITION BY g.lang, g.source) AS v, sum(ln) OVER (PARTITION BY g.lang, g.source) AS lang_total
  FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, n, CAST(1 + {ONE} * (n + {ADDED}) // CAST(total + {ADDED} * v AS HUGEINT) AS BIGINT) AS p,
  CAST(1 + {ONE} * (ln + {ADDED}) // CAST(lang_total + {ADDED} * v AS HUGEINT) AS BIGINT) AS q FROM f),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source != b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= {LISTED}
"""
