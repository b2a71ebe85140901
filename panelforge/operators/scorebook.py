"""Live scorebook: setups, tags, agreement, sector leadership, rank changes and cached cross-sections."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.semantics import correlation
from panelforge.operators import matrix, trees


def place_and_percentile(scored: DataFrame, by: list[str]) -> DataFrame:
    """Rank by falling score (ties by symbol) and percentile 100 * (1 - (rank - 1) / (n - 1))."""
    w = Window.partitionBy(*by)
    df = scored.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("score"), "symbol")), "n": F.count(F.lit(1)).over(w)})
    return df.withColumn("percentile", F.when(F.col("n") > 1, 100 * (1 - (F.col("rank") - 1) / (F.col("n") - 1))).otherwise(100.0))


def first_true(*named: tuple[Column, str], most: int = 4) -> Column:
    """Names of the first conditions that hold; unknown ones do not."""
    return F.slice(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in named])), 1, most)


def reason_tags() -> Column:
    """Up to four reasons of a row of the full matrix."""
    # fixed values
    return first_true(
        (F.col("volatility_60d_minus_sector_median") < 0, "Lower 60d volatility than sector median"), (F.col("momentum_252_20_minus_sector_median") > 0, "Long-horizon momentum ahead of sector median"),
        (F.col("return_120d_sector_rank") >= 0.7, "Top-sector 120d return rank"), (F.col("price_vs_sma_200") > 0, "Above 200d trend"),
        (F.col("from_high_252d") > -0.08, "Within 8% of 52w high"), (F.col("log_dollar_volume_20d_rank") >= 0.7, "Liquid versus universe"),
    )


def risk_flags() -> Column:
    """Up to four risks of a row of the full matrix."""
    # fixed values
    return first_true(
        (F.col("rsi_14") > 76, "RSI extended"), (F.col("volatility_60d_minus_sector_median") > 0, "Above-sector volatility"), (F.col("price_vs_sma_50") < 0, "Below 50d trend"),
        (F.col("price_vs_sma_200") < 0, "Below 200d trend"), (F.col("volume_ratio_20d") < 0.7, "Weak volume confirmation"),
    )


def setup_type(top: Column, trends: tuple[str, ...] = ("vs_sma20", "vs_sma50"), returns: tuple[str, ...] = ("r5", "r20")) -> Column:
    """Setup of a top-decile row from its prices against averages and its returns; an unknown one confirms nothing."""
    signals = [F.col(c) for c in (*trends, *returns)]
    up, down = reduce(and_, [x > 0 for x in signals]), reduce(and_, [x < 0 for x in signals])
    # fixed values
    return F.when(top & up, "momentum_confirmed").when(top & down, "model_rebound_watch").when(top & reduce(or_, [F.col(c) < 0 for c in trends]), "model_ranked_not_momentum_confirmed").otherwise("model_ranked")


def setup_tags(setup: Column) -> Column:
    """Tags shown with a setup."""
    # fixed values
    tags = {"momentum_confirmed": ["Momentum Confirmed"], "model_rebound_watch": ["Model Rebound Watch", "Not Momentum Confirmed", "Activation Pending"], "model_ranked_not_momentum_confirmed": ["Not Momentum Confirmed"]}
    return F.coalesce(*[F.when(setup == name, F.lit(values)) for name, values in tags.items()], F.array().cast("array<string>"))


def in_best(share: float) -> Column:
    """Whether a row's rank is among the best share of its n, one row at least; rows without a rank are not."""
    return F.coalesce((F.col("n") > 0) & (F.col("rank") <= F.greatest(F.lit(1), F.ceil(F.col("n") * share))), F.lit(False))


def candidate_setups(df: DataFrame, multiple: float = 0.75) -> DataFrame:
    """Adds setup, tags, bucket, stop (whether a stop is shown), activation_price and activation_pct to a ranked cross-section.

    Columns rank, n, close, vol20, prices against the averages of 50 and 200 sessions, returns over 20 and 60. A rebound waits
    for a close `multiple` daily volatilities above its own; without a close and a volatility above 0 there is no such price.
    """
    top = in_best(0.1)
    df = df.withColumn("setup", setup_type(top, ("vs_sma50", "vs_sma200"), ("r20", "r60")))
    waits = (F.col("setup") == "model_rebound_watch") & (F.col("close") > 0) & (F.col("vol20") > 0)
    return df.withColumns({
        "tags": setup_tags(F.col("setup")), "bucket": F.when(top, "Top Decile").when(in_best(0.2), "Top Quintile").otherwise("Ranked"), "stop": top | (F.col("setup") != "model_ranked"),
        "activation_price": F.when(waits, F.round(F.col("close") * (1 + multiple * F.col("vol20")), 2)), "activation_pct": F.when(waits, F.round(100 * multiple * F.col("vol20"), 2)),
    })


def activation_price(setup: Column, close: Column, vol: Column, multiple: float = 0.75) -> Column:
    return F.when((setup == "model_rebound_watch") & (close > 0) & (vol > 0), F.round(close * (1 + multiple * vol), 2))


def agreement_label(long: Column, tactical: Column, momentum: Column) -> Column:
    """Eight labels of a strategic percentile against a tactical one."""
    strong, m = long >= 90, F.coalesce(momentum, F.lit(False))
    # fixed values
    return (
        F.when(strong & (tactical >= 80) & m, "Both Models Agree").when(strong & m, "1Y Strong + Tactical Momentum").when(strong & (tactical >= 80), "1Y Strong / Tactical Watch")
        .when(strong & (tactical < 50), "1Y Strong / Tactical Weak").when(strong, "Long-Horizon Leader").when(tactical >= 90, "Tactical Only").when(long >= 80, "Long-Horizon Watch").otherwise("Monitor")
    )


def sector_inference(returns: DataFrame, sectors: DataFrame, least: int = 60) -> DataFrame:
    """Sector series that a symbol's returns correlate with most, over pairs of known returns on the same date."""
    j = returns.join(sectors, "date").where("r1 is not null and s1 is not null")
    g = j.groupBy("symbol", "sector").agg(F.count(F.lit(1)).alias("n"), F.corr("r1", "s1").alias("corr")).where(F.col("n") >= least)
    return g.groupBy("symbol").agg(F.max_by("sector", F.struct("corr", "sector")).alias("inferred"), F.max("corr").alias("corr"))


def infer_sectors(returns: DataFrame, sectors: DataFrame, least: int = 60, last: int = 252, fallback: str = "Information Technology") -> DataFrame:
    """(symbol, sector, source, correlation, observations) of every symbol: the sector series its returns follow most.

    Symbols and series bring their last `last` known returns; dates that both have are paired, `least` at least. A symbol
    without a correlation gets the fallback sector, and its source says so. Ties go to the first sector by name.
    """
    tail = lambda df, key, x: df.where(F.col(x).isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("date")))).where(F.col("_n") <= last).select(key, "date", x)
    pairs = tail(returns, "symbol", "r1").join(tail(sectors, "sector", "s1"), "date")
    g = pairs.groupBy("symbol", "sector").agg(F.count(F.lit(1)).alias("n"), correlation(F.col("r1"), F.col("s1")).alias("c")).where((F.col("n") >= least) & F.col("c").isNotNull() & ~F.isnan("c"))
    best = g.groupBy("symbol").agg(F.min(F.struct((-F.col("c")).alias("c"), "sector", "n")).alias("b"))
    df = returns.select("symbol").distinct().join(best, "symbol", "left")
    return df.select("symbol", F.coalesce("b.sector", F.lit(fallback)).alias("sector"), F.when(F.col("b").isNull(), "fallback").otherwise("return_correlation").alias("source"), F.round(-F.col("b.c"), 4).alias("correlation"), F.coalesce("b.n", F.lit(0)).cast("long").alias("observations"))


def against_reference(outsiders: DataFrame, reference: DataFrame) -> DataFrame:
    """Place of outside scores in a frozen cross-section: one more than the reference scores above.

    The reference is one day's cross-section; its scores are sorted once and counted by a union and a window.
    """
    both = reference.select("date", "score", F.lit(None).cast("string").alias("symbol")).unionByName(outsiders.select("date", "score", "symbol"))
    above = F.count(F.when(F.col("symbol").isNull(), 1)).over(Window.partitionBy("date").orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ties = F.count(F.when(F.col("symbol").isNull(), 1)).over(Window.partitionBy("date", "score"))
    return both.withColumn("place", above - ties + 1).where("symbol is not null").select("date", "symbol", "score", "place")


def place_outsiders(reference: DataFrame, outsiders: DataFrame, frozen: DataFrame, models: DataFrame, model: str, columns: list[str], ranked: list[str], centred: list[str]) -> DataFrame:
    """(date, symbol, score, place, of, percentile): names outside a cached cross-section, scored as if they were in it.

    `reference` and `outsiders` have symbol, date, sector and the raw columns; their union is ranked anew (`*_rank`,
    `*_sector_rank`, `*_minus_sector_median`), so an outsider's columns are placed among the reference's. The saved
    model scores them, and the scores are compared with the `frozen` ones (date, score) of the reference: place is one
    more than the frozen scores above, of `of` frozen ones. A symbol of the reference is no outsider.
    """
    strange = outsiders.join(reference.select("symbol", "date"), ["symbol", "date"], "left_anti")
    both = reference.withColumn("_out", F.lit(False)).unionByName(strange.withColumn("_out", F.lit(True)))
    placed = both.join(matrix.ranks(both, ranked, centred), ["symbol", "date"]).where("_out")
    scored = trees.score_saved(placed.withColumn("_model", F.lit(model)), models, columns, "_model").select("date", "symbol", F.col("model_score").alias("score"))
    known = frozen.where("score is not null").select("date", "score")
    size = known.groupBy("date").agg(F.count(F.lit(1)).alias("of"))
    out = against_reference(scored.where("score is not null"), known).join(size, "date", "left").withColumn("of", F.coalesce("of", F.lit(0)))
    return out.withColumn("percentile", 100 * (1 - (F.col("place") - 1) / F.greatest(F.col("of") - 1, F.lit(1))))


def sector_leadership(scored: DataFrame) -> DataFrame:
    """By sector: top-decile names, average percentile and the first six symbols."""
    top = scored.where(F.col("rank") <= F.greatest(F.lit(1), F.ceil(F.col("n") * 0.1)))
    return top.groupBy("sector").agg(F.count(F.lit(1)).alias("names"), F.avg("percentile").alias("percentile"), F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("rank", "symbol"))), 1, 6), lambda x: x["symbol"]), ",").alias("symbols"))


def rank_changes(snapshots: DataFrame, back: int = 5, most: int = 20) -> DataFrame:
    """Latest snapshot of the latest model against its previous and `back`-th previous one; largest moves first."""
    latest = snapshots.agg(F.max_by("model", F.struct("as_of", "model"))).first()[0]
    own = snapshots.where(F.col("model") == latest)
    days = own.select("as_of").distinct().withColumn("k", F.row_number().over(Window.orderBy(F.desc("as_of"))) - 1)
    df = own.join(F.broadcast(days), "as_of")
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("rank")))
    g = df.groupBy("symbol").agg(at(0).alias("rank"), at(1).alias("previous"), at(back).alias("earlier")).where("rank is not null")
    status = F.when(F.col("previous").isNull(), "new").when(F.col("previous") > F.col("rank"), "up").when(F.col("previous") < F.col("rank"), "down").otherwise("same")
    return g.select("symbol", "rank", (F.col("previous") - F.col("rank")).alias("change_1"), (F.col("earlier") - F.col("rank")).alias("change_n"), status.alias("status")).orderBy(F.desc_nulls_last(F.abs("change_1")), "symbol").limit(most)


def over_represented(scored: DataFrame, least: int = 2) -> DataFrame:
    """Sectors whose share among the bottom quarter is at least their share of all."""
    bottom = F.col("rank") > F.col("n") * 0.75
    g = scored.groupBy("sector").agg(F.count(F.lit(1)).alias("all"), F.count_if(bottom).alias("bottom"))
    tot = g.agg(F.sum("all").alias("ta"), F.sum("bottom").alias("tb")).first()
    return g.withColumn("ratio", (F.col("bottom") / tot["tb"]) / (F.col("all") / tot["ta"])).where((F.col("ratio") >= 1) & (F.col("bottom") >= least))


def bottom_candidates(ranked: DataFrame, most: int = 12) -> DataFrame:
    """The names of each date with the worst ranks, worst first."""
    place = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("rank"), "symbol"))
    return ranked.where("rank is not null").withColumn("place", place).where(F.col("place") <= most)


def bottom_sectors(ranked: DataFrame, least: int = 25, share: float = 0.15, count: int = 3, most: int = 4) -> DataFrame:
    """(date, sector, count, universe, bottom_share, universe_share, ratio, examples): sectors over-represented at the bottom of each date.

    The bottom is the worst `share` of ranked names, `least` names at least. A sector is listed with `count` names or more there
    and a share no smaller than its share of all, by ratio and count, `most` a date; its four worst names are the examples.
    An unknown sector counts as one. Percentages have one digit and ratios two.
    """
    w = Window.partitionBy("date")
    df = ranked.where("rank is not null").withColumns({"sector": F.coalesce("sector", F.lit("Unknown")), "place": F.row_number().over(w.orderBy(F.desc("rank"), "symbol")), "n": F.count(F.lit(1)).over(w)})
    df = df.withColumn("own", F.row_number().over(Window.partitionBy("date", "sector").orderBy("place")))
    low = F.col("place") <= F.greatest(F.lit(least), F.ceil(F.col("n") * share))
    g = df.groupBy("date", "sector").agg(
        F.count_if(low).alias("count"), F.count(F.lit(1)).alias("universe"), F.max("n").alias("n"),
        F.transform(F.slice(F.array_sort(F.collect_list(F.when(low & (F.col("own") <= 4), F.struct("place", "symbol")))), 1, 4), lambda x: x["symbol"]).alias("examples"),
    )
    size = F.least(F.greatest(F.lit(least), F.ceil(F.col("n") * share)), F.col("n"))
    bottom, whole = F.col("count") / size * 100, F.col("universe") / F.col("n") * 100
    g = g.withColumns({"bottom_share": F.round(bottom, 1), "universe_share": F.round(whole, 1), "ratio": F.round(bottom / whole, 2)}).where((F.col("count") >= count) & (F.col("ratio") >= 1))
    place = F.row_number().over(w.orderBy(F.desc("ratio"), F.desc("count"), "sector"))
    return g.withColumn("_p", place).where(F.col("_p") <= most).select("date", "sector", "count", "universe", "bottom_share", "universe_share", "ratio", "examples")


def stance(share: Column) -> Column:
    return F.when(share >= 0.55, "Risk on").when(share >= 0.40, "Mixed").otherwise("Risk off")


def union_missing(rows: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """Rows, and those extra ones whose key is not there yet."""
    return rows.unionByName(extra.join(rows.select(key), key, "left_anti"))


def to_refresh(wanted: DataFrame, cache: DataFrame, now, max_age_days: int, most: int) -> DataFrame:
    """Keys to fetch again: missing first, then stale, oldest first."""
    df = wanted.join(cache, "key", "left").withColumn("missing", F.col("fetched").isNull())
    return df.where(F.col("missing") | (F.datediff(now, "fetched") > max_age_days)).orderBy(F.desc("missing"), "fetched", "key").limit(most).select("key", "missing")


def label_summary(summary: DataFrame, strategy: str, cohorts: list[str], measures: list[str]) -> DataFrame:
    """One row of a label's summary (strategy, cohort, measures): a strategy's measures side by side for each cohort; absent ones are null."""
    cells = [F.max(F.when(F.col("cohort") == c, F.col(x))).alias(f"{c}_{x}") for c in cohorts for x in measures]
    return summary.where(F.col("strategy") == strategy).agg(*cells)


def strategy_rows(summary: DataFrame, cohort: str, by: str) -> DataFrame:
    """A cohort's strategies, best first, unknown last."""
    return summary.where(F.col("cohort") == cohort).orderBy(F.col(by).desc_nulls_last(), "strategy")


def macro_context(books: DataFrame, releases: DataFrame, drivers: DataFrame) -> DataFrame:
    """(book, origin, ref, text): the first ready release with a reading, else the best-placed driver with a text, else neither.

    Columns book; book, place, status, reading, ref of releases; book, place, title, summary, ref of drivers.
    """
    ready = releases.where((F.col("status") == "ready") & (F.coalesce("reading", F.lit("")) != "")).select("book", F.lit(1).alias("tier"), "place", F.lit("release").alias("origin"), "ref", F.col("reading").alias("text"))
    text = F.coalesce(F.nullif("summary", F.lit("")), F.nullif("title", F.lit("")))
    told = drivers.select("book", F.lit(2).alias("tier"), "place", F.lit("driver").alias("origin"), "ref", text.alias("text")).where("text is not null")
    both = ready.unionByName(told)
    first = both.groupBy("book").agg(F.min_by(F.struct("origin", "ref", "text"), F.struct("tier", "place", "ref")).alias("a"))
    return books.select("book").distinct().join(first, "book", "left").select("book", F.coalesce("a.origin", F.lit("none")).alias("origin"), "a.ref", "a.text")


#: Agreement labels that count as strong in both models, and as weak in the tactical one; fixed values.
BOTH_STRONG = ["Both Models Agree", "1Y Strong + Tactical Momentum"]
TACTICAL_WEAK = "1Y Strong / Tactical Weak"


def trend_summary(rows: DataFrame, sectors: int = 6, symbols: int = 6) -> DataFrame:
    """(date, part, item, place, names, percentile, tactical, symbols): what the top of each date's ranking is made of.

    `rows` has date, symbol, rank, percentile, tactical, sector, cap and agreement. The top are the percentiles from 90; where a
    date has none, its first tenth by rank (null ranks last). Part `sector`: the leading `sectors` by names, then by mean
    percentile, with their first `symbols` by rank; `cap`: all buckets by names, with all symbols; `count`: top_decile, both_strong
    and tactical_weak. Ties go to the item that the ranking meets first. Means have one digit, null percentiles count as zero;
    null sectors are Unclassified, null buckets Unknown cap.
    """
    dates = Window.partitionBy("date")
    high = F.coalesce(F.col("percentile") >= 90, F.lit(False))
    place = F.row_number().over(dates.orderBy(F.col("rank").asc_nulls_last(), "symbol"))
    top = rows.withColumns({"_high": high, "_any": F.max(high).over(dates), "_n": F.count(F.lit(1)).over(dates), "_at": place})
    top = top.where(F.when(F.col("_any"), F.col("_high")).otherwise(F.col("_at") <= F.ceil(F.col("_n") * F.lit(0.1))))
    item = lambda part, name: F.struct(F.lit(part).alias("part"), name.alias("item"))
    items = F.array_compact(F.array(
        item("sector", F.coalesce("sector", F.lit("Unclassified"))), item("cap", F.coalesce("cap", F.lit("Unknown cap"))), item("count", F.lit("top_decile")),
        F.when(F.col("agreement").isin(BOTH_STRONG), item("count", F.lit("both_strong"))), F.when(F.col("agreement") == TACTICAL_WEAK, item("count", F.lit("tactical_weak")))))
    mean = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0.0))), 1)
    listed = F.collect_list(F.when(F.col("x.part") != "count", F.struct("_at", "symbol")))
    g = top.withColumn("x", F.explode(items)).groupBy("date", "x.part", "x.item").agg(
        F.count(F.lit(1)).alias("names"), mean("percentile").alias("percentile"), mean("tactical").alias("tactical"), F.min("_at").alias("_first"), F.sort_array(listed).alias("_s"))
    mean_first = F.when(F.col("part") == "sector", F.col("percentile"))
    g = g.withColumn("place", F.row_number().over(Window.partitionBy("date", "part").orderBy(F.desc("names"), mean_first.desc_nulls_last(), "_first", "item")))
    kept = F.when(F.col("part") == "sector", F.slice("_s", 1, symbols)).otherwise(F.col("_s"))
    return g.where((F.col("part") != "sector") | (F.col("place") <= sectors)).select("date", "part", "item", "place", "names", "percentile", "tactical", F.transform(kept, lambda v: v["symbol"]).alias("symbols"))
