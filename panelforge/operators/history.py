"""Point-in-time history: normalised bars, halts, corrections, terminal outcomes, quarantine and coverage.

All side tables carry the security, so range conditions always come with an equality and Spark joins on it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.semantics import pct_rank
from panelforge.operators.cross_section import breadth
from panelforge.operators.joins import members

def build_membership(current: DataFrame, changes: DataFrame) -> DataFrame:
    """(symbol, start, end, quality) from today's list and dated additions and removals.

    A removal closes the latest earlier addition; names that are in today stay open; a removal without an
    addition begins at an unknown date.
    """
    w = Window.partitionBy("symbol").orderBy("date", "kind")
    steps = changes.select("symbol", "date", "kind").withColumn("next_kind", F.lead("kind").over(w)).withColumn("next_date", F.lead("date").over(w)).withColumn("before", F.lag("kind").over(w))
    adds = steps.where("kind = 'add'").select("symbol", F.col("date").alias("start"), F.when(F.col("next_kind") == "remove", F.col("next_date")).alias("end"), F.lit("dated").alias("quality"))
    orphans = steps.where("kind = 'remove' and (before is null or before = 'remove')").select("symbol", F.lit(None).cast("date").alias("start"), F.col("date").alias("end"), F.lit("unknown_start").alias("quality"))
    undated = current.select("symbol").join(steps.select("symbol").distinct(), "symbol", "left_anti").select("symbol", F.lit(None).cast("date").alias("start"), F.lit(None).cast("date").alias("end"), F.lit("undated").alias("quality"))
    return adds.unionByName(orphans).unionByName(undated)


def no_trade_days(days: DataFrame, listed: DataFrame, gaps: DataFrame, periods: DataFrame) -> DataFrame:
    """(symbol, date): listed days, sessions strictly inside exit gaps, and reviewed periods with both ends."""
    span = lambda df, a, b: df.where(a <= b).select("symbol", F.explode(F.sequence(a, b)).alias("date"))
    inside = span(gaps, F.date_add("last_trade", 1), F.date_sub("next_trade", 1))
    closed = span(periods, F.col("start"), F.col("end"))
    at_session = inside.unionByName(closed).join(F.broadcast(days.select("date").distinct()), "date", "left_semi").select("symbol", "date")
    return listed.select("symbol", "date").unionByName(at_session).distinct()


def normalise_bars(raw: DataFrame, halted: DataFrame) -> DataFrame:
    """Adjusted prices; halted and carried sessions become unknown, prices not above zero are dropped with a reason."""
    h = halted.select("symbol", "date", F.lit(True).alias("_halt"))
    df = raw.join(h, ["symbol", "date"], "left")
    scale = F.col("adj_close") / F.col("close")
    void = F.coalesce(F.col("_halt"), F.lit(False)) | F.col("source").contains("carried")
    bad = F.when(F.col("close").isNull() | (F.col("close") <= 0), "bad_close").when(F.col("adj_close").isNull() | (F.col("adj_close") <= 0), "bad_adjusted_close")
    price = lambda c: F.when(~void & bad.isNull(), F.col(c) * scale).alias(c)
    return df.select("symbol", "date", price("open"), price("high"), price("low"), price("close"), F.when(~void, F.col("volume")).alias("volume"), F.when(void, "no_trade").otherwise(bad).alias("reason"))


def rebase(bars: DataFrame, corrections: DataFrame) -> DataFrame:
    """Closes before a correction's date times its factor; several corrections of a symbol multiply."""
    later = bars.select("symbol", "date").join(corrections.select("symbol", "at", "factor"), "symbol").where(F.col("date") < F.col("at"))
    factor = later.groupBy("symbol", "date").agg(F.product("factor").alias("factor"))
    return bars.join(factor, ["symbol", "date"], "left").withColumn("close", F.col("close") * F.coalesce("factor", F.lit(1.0))).drop("factor")


def reviewed_corrections(bars: DataFrame, records: DataFrame) -> DataFrame:
    """(symbol, date, value, factor, status) of reviewed dividends: what each does to all earlier adjusted closes.

    `bars`: symbol, date, close, adj_close, dividends, stock_splits, source; `records`: symbol, date, cash (a share of that
    day), expected (the archive's dividend), source_url. The value in split-adjusted shares divides by the splits after
    the day; the factor turns the day's archived gross return into (close + value) / last close. A record holds only with a
    link to its evidence, one split-adjusted bar, a bar before it, and the dividend it expects.
    """
    w = Window.partitionBy("symbol").orderBy("date")
    later = F.coalesce(F.product(F.when(F.col("stock_splits") > 0, F.col("stock_splits"))).over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(1.0))
    b = bars.select("symbol", "date", "close", "adj_close", "dividends", "source", later.alias("later"), F.lag("close").over(w).alias("close0"), F.lag("adj_close").over(w).alias("adj0"), F.count(F.lit(1)).over(Window.partitionBy("symbol", "date")).alias("bars"))
    j = records.join(b.where("bars = 1"), ["symbol", "date"], "left")
    value = F.col("cash") / F.col("later")
    factor = (F.col("adj_close") / F.col("adj0")) / ((F.col("close") + value) / F.col("close0"))
    status = (
        F.when(~F.coalesce(F.col("source_url").startswith("https://"), F.lit(False)), "no_evidence").when(F.col("bars").isNull() | (F.col("source") != "yahoo"), "no_single_bar").when(value.isNull() | F.isnan(value) | (value < 0), "bad_dividend")
        .when(F.col("close0").isNull() | (F.abs(F.coalesce("dividends", F.lit(0.0)) - F.col("expected")) > 1e-7), "precondition_changed").otherwise("applied")
    )
    return j.select("symbol", "date", value.alias("value"), factor.alias("factor"), status.alias("status"))


def correct_adjusted(bars: DataFrame, corrections: DataFrame) -> DataFrame:
    """Adjusted closes times the factors of all applied corrections after them, a running product from the right; the day's dividend is replaced."""
    c = corrections.where("status = 'applied'").groupBy("symbol", "date").agg(F.product("factor").alias("_f"), F.max("value").alias("_v"))
    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    after = Window.partitionBy("symbol").orderBy(day).rangeBetween(1, Window.unboundedFollowing)
    df = bars.join(c, ["symbol", "date"], "left").withColumn("adj_close", F.col("adj_close") * F.coalesce(F.product("_f").over(after), F.lit(1.0)))
    return df.withColumn("dividends", F.coalesce("_v", "dividends")).drop("_f", "_v")


def terminal_outcomes(panel: DataFrame, events: DataFrame, h: int) -> DataFrame:
    """Forward outcome from the next close, with a verified terminal event inside the holding window paid out in cash.

    An event pays `value` per last traded share; the cash is held to the exit session. The outcome is known at
    the later of exit and value_known_ix. Unverified events and unresolved rights leave it unknown.
    """
    w = Window.partitionBy("symbol").orderBy("session_ix")
    df = panel.select("symbol", "session_ix", F.lead("close", 1).over(w).alias("entry"), F.lead("close", h + 1).over(w).alias("exit"))
    last = panel.where("close is not null").groupBy("symbol").agg(F.max("session_ix").alias("last_ix"), F.max_by("close", "session_ix").alias("last_close"))
    e = events.where("verified and not unresolved").select("symbol", "event_ix", "known_ix", "value")
    df = df.join(last, "symbol", "left").join(e, "symbol", "left")
    end = F.col("session_ix") + h + 1
    paid = F.col("exit").isNull() & (F.col("session_ix") + 1 <= F.col("last_ix")) & (end >= F.col("event_ix")) & (F.col("last_ix") <= F.col("event_ix"))
    outcome = F.when(paid, F.col("last_close") / F.col("entry") * F.col("value") / F.col("last_close") - 1).otherwise(F.col("exit") / F.col("entry") - 1)
    return df.select("symbol", "session_ix", outcome.alias("outcome"), F.when(paid, F.greatest(end, F.col("known_ix"))).otherwise(end).alias("available_ix"), F.coalesce(paid & outcome.isNotNull(), F.lit(False)).alias("resolved"))


def outcome_bounds(panel: DataFrame, events: DataFrame, h: int) -> DataFrame:
    """Lowest and highest outcome of events with unpriced rights worth 0 to rights_max; never labels."""
    sure = events.withColumn("unresolved", F.lit(False))
    low = terminal_outcomes(panel, sure, h).select("symbol", "session_ix", F.col("outcome").alias("low"))
    high = terminal_outcomes(panel, sure.withColumn("value", F.col("value") + F.coalesce("rights_max", F.lit(0.0))), h).select("symbol", "session_ix", F.col("outcome").alias("high"))
    return low.join(high, ["symbol", "session_ix"])


def quarantine(panel: DataFrame, flags: DataFrame) -> DataFrame:
    """Closes of flagged sessions and of those before them become unknown."""
    hit = flags.select("symbol", F.explode(F.array("session_ix", F.col("session_ix") - 1)).alias("session_ix")).distinct().withColumn("_q", F.lit(True))
    return panel.join(hit, ["symbol", "session_ix"], "left").withColumn("close", F.when(F.col("_q").isNull(), F.col("close"))).drop("_q")


def exposure(panel: DataFrame, flags: DataFrame, back: int, h: int) -> DataFrame:
    """Whether flagged sessions lie in a row's lookback (features) or in its holding window (label)."""
    f = flags.select("symbol", F.col("session_ix").alias("f"))
    near = panel.select("symbol", "session_ix").join(f, "symbol").where((F.col("f") > F.col("session_ix") - back) & (F.col("f") <= F.col("session_ix") + h + 1))
    hit = near.groupBy("symbol", "session_ix").agg(F.max((F.col("f") <= F.col("session_ix")).cast("int")).alias("past"), F.max((F.col("f") > F.col("session_ix")).cast("int")).alias("future"))
    return panel.select("symbol", "session_ix").join(hit, ["symbol", "session_ix"], "left").select("symbol", "session_ix", F.coalesce("past", F.lit(0)).alias("past_flag"), F.coalesce("future", F.lit(0)).alias("future_flag"))


def unknown_reason(entry_known: Column, exit_known: Column, entry_halted: Column, exit_halted: Column, after_last: Column, exit_after_last: Column, has_event: Column, verified: Column, rights: Column, outcome_known: Column) -> Column:
    """Why an outcome is unknown, by fixed precedence."""
    # fixed values
    return (
        F.when(~entry_known & entry_halted, "entry_during_halt").when(~entry_known & after_last & verified, "entry_after_verified_termination").when(~entry_known & after_last & has_event, "missing_entry_before_event")
        .when(~entry_known & after_last, "entry_after_unreviewed_series_end").when(~entry_known, "missing_entry_quote").when(exit_halted, "exit_during_halt").when(outcome_known, "missing_sector_benchmark").when(exit_known, "unexpected_label_failure")
        .when(has_event & rights, "unpriced_contingent_rights").when(exit_after_last & has_event, "registered_event_needs_review").when(exit_after_last, "unreviewed_series_end").otherwise("missing_exit_quote")
    )


def missingness(df: DataFrame, by: list[str], outcome: str = "outcome") -> DataFrame:
    """Rows, symbols and median score of known and unknown outcomes."""
    return df.groupBy(*by, F.col(outcome).isNull().alias("unknown")).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("symbol").alias("symbols"), F.median("score").alias("median_score"))


def disagreements(a: DataFrame, b: DataFrame, limit: float) -> DataFrame:
    """Sessions on which two sources' one-session returns differ by more than the limit, and whether two days together agree."""
    w = Window.partitionBy("symbol").orderBy("date")
    r = lambda df, n: df.select("symbol", "date", (F.col("close") / F.lag("close").over(w) - 1).alias(n))
    d = r(a, "ra").join(r(b, "rb"), ["symbol", "date"]).withColumn("gap", F.col("ra") - F.col("rb"))
    pair = F.col("gap") + F.lead("gap").over(w)
    return d.withColumn("pair_gap", pair).where(F.abs("gap") > limit).withColumn("offsetting", F.coalesce(F.abs("pair_gap") <= limit, F.lit(False)))


def coverage(panel: DataFrame, columns: list[str], by: str) -> DataFrame:
    """Share of rows with all columns known."""
    known = None
    for c in columns:
        known = F.col(c).isNotNull() if known is None else known & F.col(c).isNotNull()
    return panel.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), F.avg(known.cast("int")).alias("coverage"))


def point_in_time_matrix(features: DataFrame, intervals: DataFrame, ranked: list[str]) -> DataFrame:
    """Rows of members with their date's breadth and percentile ranks, both over that day's members only.

    Features come from a symbol's whole history and are computed before; membership decides first who is in the
    cross-section, so a name that joins later never moves an earlier day's ranks.
    """
    inside = members(features, intervals)
    df = inside.select("*", *[pct_rank(F.col(c), "date").alias(f"{c}_rank") for c in ranked])
    return df.join(breadth(inside), "date")


def write_years(df: DataFrame, path: str, years: list[int] | None = None) -> DataFrame:
    """Write a dated table partitioned by year and read it back; given years replace just their own partitions.

    Only the named years are computed and written (dynamic partition overwrite), so a correction costs its years. A year
    named without rows is left as it was.
    """
    out = df.withColumn("year", F.year("date"))
    if years is not None:
        out = out.where(F.col("year").isin(years))
    out.repartition("year").sortWithinPartitions("date", "symbol").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)
    return df.sparkSession.read.schema(out.schema).parquet(path)


def reconcile(snapshot: DataFrame, members: DataFrame) -> DataFrame:
    """By date: names in both, only in the snapshot, only in the intervals."""
    s, m = snapshot.select("symbol", "date", F.lit(1).alias("_s")), members.select("symbol", "date", F.lit(1).alias("_m"))
    j = s.join(m, ["symbol", "date"], "full_outer")
    return j.groupBy("date").agg(F.count_if(F.col("_s").isNotNull() & F.col("_m").isNotNull()).alias("both"), F.count_if(F.col("_m").isNull()).alias("only_snapshot"), F.count_if(F.col("_s").isNull()).alias("only_members"))


def survivorship(removed: DataFrame, histories: DataFrame) -> DataFrame:
    """Removed names with and without a cached history up to their removal."""
    last = histories.groupBy("symbol").agg(F.max("date").alias("last_date"))
    return removed.join(last, "symbol", "left").select("symbol", "removed", F.when(F.col("last_date").isNull(), "missing").when(F.col("last_date") < F.date_sub("removed", 7), "short").otherwise("covered").alias("status"))


def _removals(removals: DataFrame, histories: DataFrame, years: int) -> DataFrame:
    """Removals (symbol, removed) of named symbols in the `years` up to the histories' last day; a row of that day rides along."""
    last = histories.agg(F.max("date").alias("as_of"))
    named = removals.where("symbol is not null and symbol != ''").crossJoin(F.broadcast(last))  # one row
    return named.where((F.col("removed") >= F.add_months("as_of", -12 * years)) & (F.col("removed") <= F.col("as_of"))).drop("as_of")


def review_queue(removals: DataFrame, histories: DataFrame, archived: Column, years: int = 15) -> DataFrame:
    """Every removal of the window with what its price history (symbol, date, whether `archived`) can show.

    Nothing is verified by being here: membership and terminal outcome wait for a person.
    """
    ends = histories.groupBy("symbol").agg(F.count(F.lit(1)).alias("provider_rows"), F.max("date").alias("provider_end"), F.bool_or(archived).alias("has_archived_segment"))
    df = _removals(removals, histories, years).join(ends, "symbol", "left")
    # fixed values
    policy = "retain_history_and_finish_existing_labels; no_new_sp500_entries_after_verified_removal"
    return df.select(
        "symbol", "removed", F.when(F.col("provider_rows").isNull(), "not_cached").otherwise("cached").alias("price_status"), F.coalesce("provider_rows", F.lit(0)).alias("provider_rows"), "provider_end",
        F.coalesce("has_archived_segment", F.lit(False)).alias("has_archived_segment"), F.lit(False).alias("membership_verified"), F.lit(False).alias("terminal_outcome_verified"), F.lit(policy).alias("tracking_policy"),
    )


def survivorship_findings(removals: DataFrame, histories: DataFrame, reference: DataFrame, years: int = 15) -> DataFrame:
    """(finding, symbol) of an audit: what blocks a universe from being called free of survivorship.

    `reference` is (symbol, original, current), two snapshots. Names gone since the original one, those of them without a
    removal in the window, removed names without prices, and histories that end before the last day of all.
    """
    gone = reference.where("original and not current").select("symbol").distinct()
    removed = _removals(removals, histories, years).select("symbol").distinct()
    ends = histories.groupBy("symbol").agg(F.max("date").alias("end")).crossJoin(F.broadcast(histories.agg(F.max("date").alias("as_of"))))  # one row
    found = {
        "removed_since_original": gone, "without_removal_event": gone.join(removed, "symbol", "left_anti"),
        "removed_without_prices": removed.join(histories, "symbol", "left_anti"), "terminal_or_alias_review": ends.where("end != as_of").select("symbol"),
    }
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("finding"), "symbol") for name, df in found.items()])


def equal_outcomes(a: DataFrame, b: DataFrame, column: str = "outcome") -> DataFrame:
    """Counts of shared keys and of those whose outcome differs between two versions."""
    j = a.select("symbol", "date", F.col(column).alias("x")).join(b.select("symbol", "date", F.col(column).alias("y")), ["symbol", "date"])
    return j.agg(F.count(F.lit(1)).alias("shared"), F.count_if(~F.col("x").eqNullSafe(F.col("y"))).alias("different"))
