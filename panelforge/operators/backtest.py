"""Ranking evaluation: baskets, buckets, cohorts, drawdowns, turnover, bootstrap and monitoring tables.

Tables of predictions have (date, symbol, sector, score, outcome[, grade]). Ties in score go by symbol. Windows are
partitioned by date; the daily tables that follow have a row a day.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.semantics import bucket_of, correlation, pct_rank, share_true, tail_size


def ranked(preds: DataFrame, descending: bool = True) -> DataFrame:
    """Adds `place` (1 is best) and `n` on the date."""
    order = F.desc("score") if descending else F.asc("score")
    return preds.withColumns({"place": F.row_number().over(Window.partitionBy("date").orderBy(order, "symbol")), "n": F.count(F.lit(1)).over(Window.partitionBy("date"))})


def with_decile(preds: DataFrame) -> DataFrame:
    """Adds the quantile bucket, 1 lowest, of the score's place from below."""
    up = ranked(preds, descending=False)
    return up.withColumn("decile", bucket_of(F.col("place"), F.col("n")))


def daily_baskets(preds: DataFrame, share: float = 0.1) -> DataFrame:
    """By date: mean, median and hit rate of the top and bottom baskets, and their spread."""
    df = ranked(preds.where("score is not null and outcome is not null"))
    k = tail_size(F.col("n"), share)
    top, bottom = F.col("place") <= k, F.col("place") > F.col("n") - k
    x = lambda c: F.when(c, F.col("outcome"))
    out = df.groupBy("date").agg(
        F.max("n").alias("n"), F.avg(x(top)).alias("top_mean"), F.median(x(top)).alias("top_median"), F.avg(F.when(top, (F.col("outcome") > 0).cast("int"))).alias("top_hit"),
        F.avg(x(bottom)).alias("bottom_mean"), F.median(x(bottom)).alias("bottom_median"), F.avg(F.when(top, F.col("grade"))).alias("top_grade"),
    )
    return out.withColumns({"spread": F.col("top_mean") - F.col("bottom_mean"), "spread_median": F.col("top_median") - F.col("bottom_median")})


def summary_of(daily: DataFrame, by: list[str] | None = None) -> DataFrame:
    g = daily.groupBy(*(by or []))
    return g.agg(F.count(F.lit(1)).alias("dates"), *[F.avg(c).alias(c) for c in ("top_mean", "top_hit", "bottom_mean", "spread", "top_grade")], *[F.median(c).alias(f"{c}_median") for c in ("top_mean", "bottom_mean", "spread")])


def strategies(preds: DataFrame, scores: list[str]) -> DataFrame:
    """One row per (date, symbol, strategy): score columns side by side become long."""
    return preds.unpivot(["date", "symbol", "sector", "outcome", "grade"], scores, "strategy", "score")


def strategy_baskets(preds: DataFrame, scores: list[str], descending: bool = True) -> DataFrame:
    """Daily top and bottom means of each strategy, in one pass over (strategy, date)."""
    long = strategies(preds, scores).where("score is not null and outcome is not null")
    w = Window.partitionBy("strategy", "date")
    order = F.desc("score") if descending else F.asc("score")
    df = long.withColumns({"place": F.row_number().over(w.orderBy(order, "symbol")), "n": F.count(F.lit(1)).over(w)})
    k = tail_size(F.col("n"))
    top, bottom = F.col("place") <= k, F.col("place") > F.col("n") - k
    out = df.groupBy("strategy", "date").agg(F.avg(F.when(top, F.col("outcome"))).alias("top_mean"), F.avg(F.when(bottom, F.col("outcome"))).alias("bottom_mean"), F.avg(F.when(top, (F.col("outcome") > 0).cast("int"))).alias("top_hit"))
    return out.withColumn("spread", F.col("top_mean") - F.col("bottom_mean"))


def cohort_summary(preds: DataFrame, scores: list[str], cohorts: dict[str, DataFrame]) -> DataFrame:
    """Strategy by cohort: means over the cohort's dates."""
    dates = reduce(DataFrame.union, [d.select(F.lit(name).alias("cohort"), "date") for name, d in cohorts.items()])
    return strategy_baskets(preds, scores).join(F.broadcast(dates), "date").groupBy("cohort", "strategy").agg(F.count(F.lit(1)).alias("dates"), *[F.avg(c).alias(c) for c in ("top_mean", "bottom_mean", "spread", "top_hit")])


def agreement(model: Column, relative: Column, classic: Column) -> Column:
    """Label of a model percentile against two momentum percentiles."""
    top, confirmed = model >= 0.9, relative >= 0.7
    # fixed values
    return (
        F.when(top & confirmed, "Consensus Long-Horizon Candidate").when(top & (classic >= 0.7), "Model Candidate With Classic Momentum")
        .when(top, "Model-Only Candidate").when(relative >= 0.9, "Rules Candidate").otherwise("Monitor")
    )


def bucket_summary(preds: DataFrame) -> DataFrame:
    """Mean of daily means by bucket, with names a day."""
    df = with_decile(preds.where("score is not null and outcome is not null"))
    daily = df.groupBy("date", "decile").agg(F.count(F.lit(1)).alias("names"), F.avg("outcome").alias("mean"), F.median("outcome").alias("median"), F.avg((F.col("outcome") > 0).cast("int")).alias("hit"))
    return daily.groupBy("decile").agg(F.count(F.lit(1)).alias("dates"), F.avg("names").alias("names"), F.avg("mean").alias("mean"), F.avg("median").alias("median"), F.avg("hit").alias("hit"))


def max_drawdown(daily: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Deepest fall of the compounded series from its running peak; unknown returns count as 0."""
    w = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    grown = daily.withColumn("equity", F.product(1 + F.coalesce(F.col(column), F.lit(0.0))).over(w))
    fall = grown.withColumn("fall", F.col("equity") / F.max("equity").over(w) - 1)
    return fall.groupBy(*by).agg(F.min("fall").alias("max_drawdown"))


def turnover(preds: DataFrame, share: float = 0.1) -> DataFrame:
    """By date, share of the top basket that was not in the one before."""
    df = ranked(preds.where("score is not null"))
    top = df.where(F.col("place") <= tail_size(F.col("n"), share)).groupBy("date").agg(F.collect_set("symbol").alias("names"))
    before = F.lag("names").over(Window.orderBy("date"))
    return top.select("date", F.when(before.isNotNull(), 1 - F.size(F.array_intersect("names", before)) / F.size("names")).alias("turnover"))


def offset_summary(daily: DataFrame, h: int, column: str = "top_mean") -> DataFrame:
    """Every start offset of periods h sessions apart: periods, mean and compounded growth (floored at 0.01)."""
    ix = F.row_number().over(Window.orderBy("date")) - 1
    df = daily.withColumn("offset", ix % h)
    return df.groupBy("offset").agg(F.count(F.lit(1)).alias("periods"), F.avg(column).alias("mean"), (F.product(F.greatest(1 + F.col(column), F.lit(0.01))) - 1).alias("compounded"))


def daily_equivalent(x: Column, h: int) -> Column:
    return F.pow(F.greatest(1 + x, F.lit(0.01)), F.lit(1.0 / h)) - 1


def describe(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """n, mean, median, hit rate and quartiles of the known values."""
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.75)))
    out = df.where(F.col(column).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(column).alias("mean"), F.median(column).alias("median"), F.avg((F.col(column) > 0).cast("int")).alias("hit"), q.alias("q"))
    return out.select(*by, "n", "mean", "median", "hit", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p75"))


def auc(df: DataFrame, by: list[str]) -> DataFrame:
    """Rank-sum AUC of score for outcome > 0, ties averaged."""
    r = df.where("score is not null and outcome is not null").withColumn("n_all", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    r = r.withColumn("r", pct_rank(F.col("score"), *by) * F.col("n_all"))
    y = (F.col("outcome") > 0).cast("int")
    g = r.groupBy(*by).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"), F.sum(F.when(y == 1, F.col("r"))).alias("ranks"))
    return g.select(*by, "pos", "neg", F.when((F.col("pos") > 0) & (F.col("neg") > 0), (F.col("ranks") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * F.col("neg"))).alias("auc"))


def known_baskets(preds: DataFrame, share: float = 0.1) -> DataFrame:
    """Top basket ranked before unknown outcomes are looked at: its mean is null unless all members are known."""
    df = ranked(preds.where("score is not null"))
    top = df.where(F.col("place") <= tail_size(F.col("n"), share))
    x = F.col("outcome")
    return top.groupBy("date").agg(F.count(F.lit(1)).alias("members"), F.count(x).alias("known"), F.when(F.count(x) == F.count(F.lit(1)), F.avg(x)).alias("top_mean"))


def paired(long: DataFrame, arms: list[str], value: str = "spread") -> DataFrame:
    """Dates on which every arm has a value, side by side, from rows of (date, strategy, value)."""
    return long.groupBy("date").pivot("strategy", arms).agg(F.first(value)).dropna(subset=arms)


def probability_metrics(df: DataFrame, by: list[str], share: float = 0.1) -> DataFrame:
    """By group of (date, symbol, probability, outcome, label): how good probabilities are as such and as a ranking.

    Log loss (probabilities kept 1e-6 from 0 and 1), accuracy at 0.5, positive rate, mean outcome, correlations with outcome
    and label; top and bottom baskets of each date averaged over dates (`top`, `top_hit`, `bottom`, `spread`), and the top
    tenth and fifth of all rows together (`global_top`, `global_fifth`: rounded down, one row at least). Ties in probability
    go by date and symbol. The places among all rows come from a count of rows above by probability, so no group is one task.
    """
    known = df.where("probability is not null and outcome is not null and label is not null")
    p, y = F.col("probability"), F.col("label")
    clipped = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    own = known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(-(y * F.log(clipped) + (1 - y) * F.log(1 - clipped))).alias("log_loss"), F.avg(((p >= 0.5).cast("int") == y).cast("int")).alias("accuracy"),
        F.avg(y).alias("positive_rate"), F.avg("outcome").alias("mean_outcome"), correlation(p, F.col("outcome")).alias("outcome_correlation"), correlation(p, y.cast("double")).alias("label_correlation"),
    )
    w = Window.partitionBy(*by, "date")
    d = known.withColumns({"place": F.row_number().over(w.orderBy(F.desc("probability"), "symbol")), "n": F.count(F.lit(1)).over(w)})
    k = F.greatest(F.lit(1), F.ceil(F.col("n") * share))
    top, bottom = F.col("place") <= k, F.col("place") > F.col("n") - k
    daily = d.groupBy(*by, "date").agg(F.avg(F.when(top, F.col("outcome"))).alias("t"), F.avg(F.when(top, y)).alias("h"), F.avg(F.when(bottom, F.col("outcome"))).alias("b"))
    balanced = daily.groupBy(*by).agg(F.avg("t").alias("top"), F.avg("h").alias("top_hit"), F.avg("b").alias("bottom"), F.avg(F.col("t") - F.col("b")).alias("spread"))
    # rows above a probability: counts by probability first, then a running sum over the few distinct ones of a group
    sizes = known.groupBy(*by, "probability").agg(F.count(F.lit(1)).alias("same"))
    running = Window.partitionBy(*by).orderBy(F.desc("probability")).rowsBetween(Window.unboundedPreceding, 0)
    above = sizes.withColumn("above", F.sum("same").over(running) - F.col("same"))
    ranked_all = known.join(above, [*by, "probability"]).join(own.select(*by, "rows"), by)
    ties = F.row_number().over(Window.partitionBy(*by, "probability").orderBy("date", "symbol"))
    edge = lambda s: F.greatest(F.lit(1), F.floor(F.col("rows") * s))
    inside = ranked_all.where(F.col("above") < edge(2 * share)).withColumn("place", F.col("above") + ties)
    whole = inside.groupBy(*by).agg(F.avg(F.when(F.col("place") <= edge(share), F.col("outcome"))).alias("global_top"), F.avg(F.when(F.col("place") <= edge(2 * share), F.col("outcome"))).alias("global_fifth"))
    return own.join(balanced, by).join(whole, by)


#: The modulus and step of the draws, whose arithmetic stays within a long and can be repeated in SQL.
_PRIME, _STEP = 2_147_483_647, 48_271


def draw(rep: Column, k: Column, seed: int) -> Column:
    """A whole number below 2^31 - 1 for each (repetition, draw): four rounds of squaring and stepping modulo a prime."""
    x = (rep * 1_103_515_245 + k * 12_345_701 + seed) % _PRIME
    for i in range(4):
        x = ((x * x) % _PRIME + x * _STEP + i + 1) % _PRIME
    return x


def _interval(spark, means: DataFrame, n: int) -> DataFrame:
    return means.agg(F.lit(n).alias("n"), F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def bootstrap_mean(daily: DataFrame, column: str, reps: int = 2000, seed: int = 42) -> DataFrame:
    """95% interval of the mean over dates (a row a day); null for fewer than three dates. Reruns agree, and SQL can repeat it."""
    days = daily.where(F.col(column).isNotNull()).select(F.col(column).alias("x"), (F.row_number().over(Window.orderBy("date")) - 1).cast("long").alias("i"))
    spark, n = daily.sparkSession, days.count()
    if n < 3:
        return spark.createDataFrame([(n, None, None)], "n int, low double, high double")
    at = spark.range(reps * n).select(F.floor(F.col("id") / n).alias("rep"), (F.col("id") % n).alias("k"))
    draws = at.select("rep", (draw(F.col("rep"), F.col("k"), seed) % n).alias("i"))
    return _interval(spark, draws.join(F.broadcast(days), "i").groupBy("rep").agg(F.avg("x").alias("m")), n)


def _block_means(days: DataFrame, n: int, block: int, reps: int, seed: int) -> DataFrame:
    """(rep, m): means of n values in circular blocks; a block's sum is a difference of prefix sums of the doubled series.

    Rows are repetitions times blocks, not times dates; the prefix sums are a row a day, twice.
    """
    spark = days.sparkSession
    twice = days.unionByName(days.select("x", (F.col("i") + n).alias("i")))
    prefix = twice.select((F.col("i") + 1).alias("i"), F.sum("x").over(Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)).alias("s")).unionByName(spark.range(1).select(F.col("id").alias("i"), F.lit(0.0).alias("s")))
    blocks = -(-n // block)
    at = spark.range(reps * blocks).select(F.floor(F.col("id") / blocks).alias("rep"), (F.col("id") % blocks).alias("k"))
    start = draw(F.col("rep"), F.col("k"), seed) % n
    size = F.least(F.lit(block).cast("long"), n - F.col("k") * block)
    ends = at.select("rep", start.alias("a"), (start + size).alias("b"))
    low, high = (F.broadcast(prefix.select(F.col("i").alias(c), F.col("s").alias(f"s{c}"))) for c in "ab")
    return ends.join(low, "a").join(high, "b").groupBy("rep").agg((F.sum(F.col("sb") - F.col("sa")) / n).alias("m"))


def _in_order(daily: DataFrame, x: Column) -> DataFrame:
    return daily.select("date", x.alias("x")).where("x is not null").select("x", (F.row_number().over(Window.orderBy("date")) - 1).cast("long").alias("i"))


def block_bootstrap_mean(daily: DataFrame, column: str, block: int, reps: int = 1000, seed: int = 42) -> DataFrame:
    """Interval from circular moving blocks; refused (null) for fewer than two blocks of dates."""
    days = _in_order(daily, F.col(column))
    spark, n = daily.sparkSession, days.count()
    if n < 2 * block:
        return spark.createDataFrame([(n, None, None)], "n int, low double, high double")
    return _interval(spark, _block_means(days, n, block, reps, seed), n)


def paired_interval(daily: DataFrame, treated: str, control: str, block: int, reps: int = 1000, seed: int = 42) -> DataFrame:
    """(status, mean_difference, low, high, paired_dates, total_dates): block bootstrap of paired daily differences.

    Refused, with the reason as status, where no date has both values, where fewer than two blocks are paired, and where
    some dates lack a value: complete dates pushed together are no calendar.
    """
    diff = F.col(treated) - F.col(control)
    spark = daily.sparkSession
    n, total, mean = daily.agg(F.count(diff), F.count(F.lit(1)), F.avg(diff)).first()
    status = "no_common_cohorts" if not n else "insufficient_blocks" if n < 2 * block else "incomplete_calendar" if n < total else "ok"
    schema = "status string, mean_difference double, low double, high double, paired_dates long, total_dates long"
    if status != "ok":
        return spark.createDataFrame([(status, mean, None, None, n, total)], schema)
    known = _interval(spark, _block_means(_in_order(daily, diff), n, block, reps, seed), n)
    return known.select(F.lit("ok").alias("status"), F.lit(mean).alias("mean_difference"), "low", "high", F.lit(n).alias("paired_dates"), F.lit(total).alias("total_dates"))


def winsorised(df: DataFrame, column: str, by: list[str], low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Mean after clipping to two quantiles, and the share of the five largest gains in all gains."""
    known = df.where(F.col(column).isNotNull())
    q = known.groupBy(*by).agg(F.percentile(column, F.array(F.lit(low), F.lit(high))).alias("q"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(column), "symbol", "date"))
    j = known.withColumn("place", place).join(q, by)
    x = F.col(column)
    return j.groupBy(*by).agg(
        F.avg(F.least(F.greatest(x, F.col("q")[0]), F.col("q")[1])).alias("winsorised_mean"),
        (F.sum(F.when((F.col("place") <= 5) & (x > 0), x)) / F.sum(F.when(x > 0, x))).alias("top5_share"),
    )


def decile_daily(preds: DataFrame) -> DataFrame:
    df = with_decile(preds.where("score is not null and outcome is not null"))
    return df.groupBy("date", "decile").agg(F.count(F.lit(1)).alias("names"), F.avg("score").alias("score"), F.avg("outcome").alias("mean"), F.median("outcome").alias("median"))


def decile_spreads(preds: DataFrame) -> DataFrame:
    """Top and bottom decile of each date side by side."""
    d = decile_daily(preds)
    out = d.groupBy("date").agg(F.max_by("mean", "decile").alias("top_mean"), F.min_by("mean", "decile").alias("bottom_mean"), F.max_by("median", "decile").alias("top_median"), F.min_by("median", "decile").alias("bottom_median"))
    return out.withColumns({"spread": F.col("top_mean") - F.col("bottom_mean"), "spread_median": F.col("top_median") - F.col("bottom_median")})


def segments(preds: DataFrame) -> DataFrame:
    """Mean of daily means of overlapping segments: top 5, top 10, top and bottom decile."""
    df = with_decile(preds.where("score is not null and outcome is not null")).withColumn("from_top", F.col("n") - F.col("place") + 1)
    hi, lo = F.max("decile").over(Window.partitionBy("date")), F.min("decile").over(Window.partitionBy("date"))
    names = F.array_compact(F.array(F.when(F.col("from_top") <= 5, "top_5"), F.when(F.col("from_top") <= 10, "top_10"), F.when(F.col("decile") == hi, "top_decile"), F.when(F.col("decile") == lo, "bottom_decile")))
    daily = df.withColumn("names", names).select("date", "outcome", F.explode("names").alias("segment")).groupBy("segment", "date").agg(F.avg("outcome").alias("mean"), F.count(F.lit(1)).alias("count"))
    return daily.groupBy("segment").agg(F.count(F.lit(1)).alias("dates"), F.avg("count").alias("names"), F.avg("mean").alias("mean"), F.median("mean").alias("median"))


def spearman(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Rank correlation with averaged ties."""
    known = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    r = known.select(*by, pct_rank(F.col(a), *by).alias("ra"), pct_rank(F.col(b), *by).alias("rb"))
    return r.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr("ra", "rb").alias("spearman"))


def entrants(preds: DataFrame, look: int = 5, jump: int = 10) -> DataFrame:
    """Latest top decile with earlier ranks, streak and the reason a name is in."""
    df = with_decile(preds.where("score is not null")).withColumn("rank", F.col("n") - F.col("place") + 1)
    days = df.select("date").distinct().withColumn("back", F.row_number().over(Window.orderBy(F.desc("date"))) - 1)
    df = df.join(F.broadcast(days), "date")
    top = df.where("back = 0").agg(F.max("decile")).first()[0]
    df = df.withColumn("is_top", F.col("decile") == F.lit(top))
    at = lambda k, c: F.max(F.when(F.col("back") == k, F.col(c)))
    nearest_out = F.min(F.when(~F.col("is_top"), F.col("seq")))
    seq = F.row_number().over(Window.partitionBy("symbol").orderBy("back"))
    g = df.withColumn("seq", seq).groupBy("symbol").agg(
        F.max(F.when(F.col("back") == 0, F.col("is_top").cast("int"))).alias("in_top"), at(0, "rank").alias("rank"), at(1, "decile").alias("prior_1_decile"), at(look, "decile").alias("prior_n_decile"),
        at(1, "rank").alias("prior_1_rank"), at(look, "rank").alias("prior_n_rank"), at(10, "rank").alias("prior_10_rank"),
        (F.coalesce(nearest_out, F.count(F.lit(1)) + 1) - 1).alias("streak"), F.min(F.when(F.col("is_top"), F.col("date"))).alias("first_top_date"),
    ).where("in_top = 1")
    gain = F.col("prior_n_rank") - F.col("rank")
    new = lambda c: F.col(c).isNull() | (F.col(c) != top)
    reason = F.when(new("prior_1_decile"), "New since prior scoring date").when(new("prior_n_decile"), F.lit(f"New within {look} scoring dates")).when(gain >= jump, F.concat(F.lit("Rank improved "), gain.cast("string"))).otherwise("Existing top-decile constituent")
    return g.select("symbol", "rank", "prior_1_rank", "prior_n_rank", "prior_10_rank", "streak", "first_top_date", reason.alias("reason"))


def health(daily: DataFrame) -> DataFrame:
    """Six checks on daily baskets and the status they add up to."""
    d = daily.agg(F.avg("top_mean").alias("a"), F.avg("top_median").alias("b"), F.avg("spread").alias("c"), F.avg("spread_median").alias("d"), F.avg("top_hit").alias("e"), F.avg((F.col("spread") > 0).cast("int")).alias("f"))
    passed = sum(F.coalesce((x).cast("int"), F.lit(0)) for x in (F.col("a") > 0, F.col("b") > 0, F.col("c") > 0, F.col("d") > 0, F.col("e") >= 0.52, F.col("f") >= 0.70))
    return d.select(passed.cast("int").alias("passed")).withColumn("status", F.when(F.col("passed") >= 5, "Healthy").when(F.col("passed") >= 3, "Watch").otherwise("Deteriorating"))


def recent_window(preds: DataFrame, dates: int) -> DataFrame:
    """Rows with a known outcome on the last `dates` dates that have any."""
    known = preds.where("outcome is not null")
    last = known.select("date").distinct().orderBy(F.desc("date")).limit(dates)
    return known.join(F.broadcast(last), "date", "left_semi")


def best_strategy(daily: DataFrame, arms: list[str]) -> DataFrame:
    """Strategy with the largest mean, then median, on the dates all arms have."""
    common = paired(daily, arms).unpivot("date", arms, "strategy", "value")
    return common.groupBy("strategy").agg(F.avg("value").alias("mean"), F.median("value").alias("median"), F.count(F.lit(1)).alias("dates")).orderBy(F.desc("mean"), F.desc("median"), "strategy").limit(1)


def score_overlap(preds: DataFrame, a: str, b: str) -> DataFrame:
    """By date: share of the top baskets that two scores have in common, and their rank correlation."""
    tops = [ranked(preds.withColumn("score", F.col(c)).where("score is not null")).where(F.col("place") <= tail_size(F.col("n"))).groupBy("date").agg(F.collect_set("symbol").alias(c + "_top")) for c in (a, b)]
    both = tops[0].join(tops[1], "date").select("date", (F.size(F.array_intersect(f"{a}_top", f"{b}_top")) / F.size(f"{a}_top")).alias("overlap"))
    return both.join(spearman(preds, a, b, ["date"]).select("date", "spearman"), "date")


def treatment_check(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Rows removed, cells changed and outcomes newly unknown between two versions of a table keyed by (symbol, date)."""
    b = before.select("symbol", "date", *[F.col(c).alias(f"b_{c}") for c in columns])
    j = b.join(after.select("symbol", "date", F.lit(1).alias("there"), *columns), ["symbol", "date"], "left")
    gone = F.col("there").isNull()
    changed = [F.count_if(~gone & ~F.col(c).eqNullSafe(F.col(f"b_{c}"))).alias(f"changed_{c}") for c in columns]
    return j.agg(F.count(F.lit(1)).alias("rows"), F.count_if(gone).alias("removed"), *changed, F.count_if(~gone & F.col("outcome").isNull() & F.col("b_outcome").isNotNull()).alias("newly_unknown"))


def activation_grid(rows: DataFrame, closes: DataFrame, context: DataFrame, multiples: list[float], windows: list[int], hold: int = 14, cost: float = 0.0015) -> DataFrame:
    """Sector-neutral outcomes of entering at the first close at or above a trigger.

    `rows` has (symbol, sector, date, session_ix, close, vol20); the trigger is close * (1 + multiple * vol20).
    Each row meets its next max(windows) sessions once, by an equi-join on (symbol, session); rules are then
    exploded from small arrays.
    """
    span = max(windows)
    path = closes.select("symbol", F.col("session_ix").alias("s"), F.col("close").alias("c"))
    exits = closes.select("symbol", (F.col("session_ix") - hold).alias("s"), F.col("close").alias("exit_close"))
    sector = context.select("sector", F.col("session_ix").alias("s"), F.col("etf_close").alias("e0"))
    later = context.select("sector", (F.col("session_ix") - hold).alias("s"), F.col("etf_close").alias("e1"))
    ahead = rows.select("*", F.explode(F.sequence(F.col("session_ix") + 1, F.col("session_ix") + span)).alias("s"))
    ahead = ahead.join(path, ["symbol", "s"]).select("*", F.explode(F.array(*[F.lit(m) for m in multiples])).alias("multiple"))
    hit = ahead.where(F.col("c") >= F.col("close") * (1 + F.col("multiple") * F.col("vol20")))
    first = hit.groupBy("symbol", "sector", "date", "session_ix", "multiple").agg(F.min("s").alias("s"), F.min_by("c", "s").alias("entry"))
    tried = first.select("*", F.explode(F.array(*[F.lit(w) for w in windows])).alias("window")).where(F.col("s") - F.col("session_ix") <= F.col("window"))
    out = tried.join(exits, ["symbol", "s"]).join(sector, ["sector", "s"], "left").join(later, ["sector", "s"], "left")
    return out.select("symbol", "date", "multiple", "window", (F.col("exit_close") / F.col("entry") - 1 - F.coalesce(F.col("e1") / F.col("e0") - 1, F.lit(0.0)) - cost).alias("outcome"))


def label_comparison(preds: DataFrame, cohorts: dict[str, DataFrame], measures: list[str], outcome: str = "outcome", share: float = 0.1) -> DataFrame:
    """By cohort: how a score does on one label's return and on further measures (adjusted return, drawdowns) of the same top names.

    Columns date, symbol, score, `outcome` and the measures. A cohort is a table of dates. Means and medians are
    over dates, of each date's mean in the top basket; `spread` is top less bottom.
    """
    df = ranked(preds.where(F.col("score").isNotNull() & F.col(outcome).isNotNull()))
    k = F.greatest(F.lit(1), F.ceil(F.col("n") * share))
    top, bottom = F.col("place") <= k, F.col("place") > F.col("n") - k
    daily = df.groupBy("date").agg(*[F.avg(F.when(top, F.col(x))).alias(f"top_{x}") for x in (outcome, *measures)], F.avg(F.when(bottom, F.col(outcome))).alias("bottom")).withColumn("spread", F.col(f"top_{outcome}") - F.col("bottom")).drop("bottom")
    names = [c for c in daily.columns if c != "date"]
    parts = []
    for name, dates in cohorts.items():
        kept = daily.join(F.broadcast(dates.select("date")), "date", "left_semi")
        parts.append(kept.agg(F.count(F.lit(1)).alias("dates"), *[F.avg(c).alias(f"{c}_mean") for c in names], *[F.median(c).alias(f"{c}_median") for c in names]).select(F.lit(name).alias("cohort"), "*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def compounded(daily: DataFrame, column: str, h: int, by: list[str]) -> DataFrame:
    """Growth of daily-equivalent returns of h-session outcomes, each floored at 0.01."""
    x = daily_equivalent(F.col(column), h)
    return daily.where(F.col(column).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("dates"), F.avg(x).alias("mean_daily"), (F.exp(F.sum(F.log(1 + x))) - 1).alias("compounded"))
