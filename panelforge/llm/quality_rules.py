"""Document quality rules with host-level verdicts; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import BLANKS, durable, to_join, words, written

SYMBOLS = "#*$%&|<>"
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: A host goes if its shrunk failure rate is above this.
HOST_LIMIT = 0.5


def _neighbours(array: str, distance: int, f) -> Column:
    """f of each element and the one `distance` further on."""
    n = F.greatest(F.size(array) - F.lit(distance), F.lit(0))
    return F.zip_with(F.slice(array, F.lit(1), n), F.slice(array, F.lit(distance + 1), n), f)


def with_repeat_words(df: DataFrame, ws: str, window: int = WINDOW) -> DataFrame:
    """Adds n_repeat_words: words inside windows of `window` words that occur twice or more in array `ws`.

    Windows (a power of two of words) are compared by a 64-bit hash built by doubling: words, pairs, fours,
    eights. If all are distinct the answer is 0; else the (hash, place) pairs are sorted, places whose
    neighbour has the same hash are kept, and the union of their spans is summed. Work is n log n for a
    text of n words. Each step is a column of its own, as a nested expression would be evaluated anew at
    each of its uses.
    """
    df = df.withColumn("_h", F.transform(ws, lambda w: F.xxhash64(w))).drop(ws)
    span = 1
    while span < window:
        df = df.withColumn("_g", _neighbours("_h", span, lambda a, b: F.xxhash64(a, b))).drop("_h").withColumnRenamed("_g", "_h")
        span *= 2
    df = df.withColumn("_n", F.size(F.array_distinct("_h")))
    pairs = F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    df = df.withColumn("_p", F.when(F.col("_n") < F.size("_h"), F.sort_array(pairs)).otherwise(none)).drop("_h", "_n")
    same = _neighbours("_p", 1, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    df = df.withColumn("_p", F.sort_array(F.array_distinct(F.flatten(same))))
    df = df.withColumn("_s", _neighbours("_p", 1, lambda a, b: F.least(b - a, F.lit(window))))
    total = F.aggregate("_s", F.lit(window).cast("long"), lambda acc, x: acc + x)
    return df.withColumn("n_repeat_words", F.when(F.size("_p") > 0, total).otherwise(0).cast("long")).drop("_p", "_s")


def features(docs: DataFrame, text: Column, keep: list[Column]) -> DataFrame:
    """`keep` columns plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    base = docs.select(
        *keep,
        t.alias("_t"),
        words(t).alias("_w"),
        lines.alias("_l"),
    )
    base = base.select(
        *[F.col(c) for c in base.columns[: len(keep)]],
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        "_w",
    )
    base = with_repeat_words(base, "_w")
    return base.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def host_verdicts(rated: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """(v_host, host_docs, host_rate, host_ok), as a side of a join, from rows of (host, base_failed).

    The prior of the failure rate is Beta(m*s, (1-m)*s): m and s by moments from all hosts' rates, weighted by
    their documents; s is at least 2. A host's rate is shrunk to (failed + m*s) / (docs + s).
    """
    hosts = durable(rated.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"), F.count_if("base_failed").alias("failed")))
    rate = F.col("failed") / F.col("host_docs")
    total, failed, n, squares = hosts.agg(F.sum("host_docs"), F.sum("failed"), F.count(F.lit(1)), F.sum(rate * rate * F.col("host_docs"))).first()
    total = total or 1
    mean = min(max((failed or 0) / total, 1e-6), 1 - 1e-6)
    between = max((squares or 0.0) / total - mean * mean - mean * (1 - mean) * (n or 1) / total, 1e-9)
    strength = max(mean * (1 - mean) / between - 1, 2.0)
    shrunk = (F.col("failed") + F.lit(mean * strength)) / (F.col("host_docs") + F.lit(strength))
    return to_join(hosts.select(F.col("host").alias("v_host"), "host_docs", shrunk.alias("host_rate"), (shrunk <= limit).alias("host_ok")), n)


def quality_rules(docs: DataFrame, limit: float = HOST_LIMIT, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, the rule counts, base_failed, host_rate and kept.

    A null text counts as empty and fails (no words); null hosts are one host; repeated rows count each; an
    empty table gives an empty result; other columns are ignored. The counts are computed once and written;
    hosts are aggregated before they are joined back.
    """
    base = written(features(docs, F.col(text_col), [F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host")]))
    verdicts = host_verdicts(base, limit)
    out = base.join(verdicts, F.col("host").eqNullSafe(F.col("v_host")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      (~F.col("base_failed") & F.col("host_ok")).alias("kept"), "host_rate")


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts, rule failures and verdicts of all of `documents`."""
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage_quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of documents that pass their own rules and come from a host that passes.

    The rated rows are written once with their texts: a filter on the rules over a plan that computes them
    would be pushed below it, and so compute them anew at every mention. Null texts have no word and fail;
    null hosts are one host; repeated rows count each; an empty table gives an empty result.
    """
    whole = [F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]
    rated = written(features(docs, F.col("text"), [*whole, F.col("source").cast("string").alias("host")]).select(*[f"c{i}" for i in range(len(whole))], "host", "base_failed"))
    kept = rated.where("not base_failed").join(host_verdicts(rated), F.col("host").eqNullSafe(F.col("v_host"))).where("host_ok")
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c
      FROM (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS k
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w))),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM g, (SELECT unnest(range(0, 8)) AS j) WHERE c > 1 GROUP BY doc_id),
b AS (SELECT w.doc_id, source, len(ws) AS n_words,
             length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
      FROM w LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b),
h AS (SELECT source, count(*) AS docs, count(*) FILTER (base_failed) AS failed FROM f GROUP BY source),
m0 AS (SELECT sum(docs) AS total, least(greatest(sum(failed) / sum(docs), 1e-6), 1 - 1e-6) AS mean,
             sum((failed / docs) * (failed / docs) * docs) / sum(docs) AS sq, count(*) AS n FROM h),
m AS (SELECT *, greatest(mean * (1 - mean) / greatest(sq - mean * mean - mean * (1 - mean) * n / total, 1e-9) - 1, 2) AS s FROM m0),
v AS (SELECT source, (failed + mean * s) / (docs + s) AS host_rate FROM h, m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND host_rate <= 0.5 AS kept, host_rate
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""
