"""Forward outcomes of securities that end: cash, stock, mixed and worthless events, valued point in time.

An event pays per last traded raw share; the proceeds are held without interest to the original exit. Nothing is
extrapolated: an event that cannot be valued leaves the outcome unknown and says why in `status`.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators.joins import asof

#: Days from an event to its successor's first session, and from the last trade to an event, at most.
SUCCESSOR_DAYS, BRIDGE_DAYS = 4, 7
#: Events that end a claim.
KINDS = ("cash_acquisition", "stock_acquisition", "mixed_acquisition", "worthless_cancellation")


def actual_trade() -> Column:
    """Whether a bar was traded: not a halted session, not carried from an earlier one."""
    return ~F.coalesce("no_trade", F.lit(False)) & ~F.lower(F.coalesce("source", F.lit(""))).contains("carried")


def successor_value(events: DataFrame, bars: DataFrame) -> DataFrame:
    """Adds (valued_on, unit): the successor's first session at or after the event, and its close in shares of that day.

    A forward as-of join: events and the successors' bars are one stream a symbol, so there is no comparison of ranges.
    Closes that are already adjusted for splits (source yahoo) are multiplied by the splits after the session, a running
    product from the right.
    """
    names = events.where("stock_ratio != 0 and successor is not null").select(F.col("successor").alias("symbol")).distinct()
    after = Window.partitionBy("symbol").orderBy("date").rowsBetween(1, Window.unboundedFollowing)
    splits = F.coalesce(F.product(F.when(F.col("stock_splits") > 0, F.col("stock_splits"))).over(after), F.lit(1.0))
    unit = F.col("close") * F.when(F.col("source") == "yahoo", splits).otherwise(1.0)
    priced = bars.join(names, "symbol", "left_semi").select("symbol", "date", F.struct(F.col("date").alias("valued_on"), unit.alias("unit")).alias("price"))
    asked = events.select(F.col("successor").alias("symbol"), F.col("effective_date").alias("date"), F.struct("*").alias("event"))
    stream = asked.withColumns({"price": F.lit(None).cast(priced.schema["price"].dataType), "kind": F.lit(0)}).unionByName(priced.withColumns({"event": F.lit(None).cast(asked.schema["event"].dataType), "kind": F.lit(1)}))
    next_price = F.first("price", True).over(Window.partitionBy("symbol").orderBy("date", "kind").rowsBetween(0, Window.unboundedFollowing))
    return stream.withColumn("next", next_price).where("kind = 0").select("event.*", "next.valued_on", "next.unit")


def valued_events(events: DataFrame, bars: DataFrame) -> DataFrame:
    """(symbol, event_date, known, value, extra, last_date, last_close, last_adj, status) of terminal events.

    `events`: symbol, kind, effective_date, known_date, cash, stock_ratio, successor, verified, unresolved, rights_max. A
    stock part is worth the ratio times the successor's unit; the event then moves to that session, and is known no
    earlier. `extra` is the most that unpriced rights may add (null: nothing is unresolved, or no bound is known).
    """
    stock = F.coalesce("stock_ratio", F.lit(0.0)) != 0
    e = successor_value(events, bars)
    e = e.withColumns({
        "event_date": F.when(stock, F.greatest("effective_date", "valued_on")).otherwise(F.col("effective_date")),
        "known": F.when(stock, F.greatest("known_date", "valued_on")).otherwise(F.col("known_date")),
        "value": F.coalesce("cash", F.lit(0.0)) + F.when(stock, F.col("stock_ratio") * F.col("unit")).otherwise(0.0),
        "late": stock & (F.col("valued_on").isNull() | (F.datediff("valued_on", "effective_date") > SUCCESSOR_DAYS)),
    })
    trades = bars.where(actual_trade()).select("symbol", "date", F.col("close").alias("last_close"), F.col("adj_close").alias("last_adj"))
    e = asof(e, trades, "symbol", "event_date", "date", ["last_close", "last_adj"]).withColumnRenamed("seen", "last_date")
    value = F.col("value")
    status = (
        F.when(~F.coalesce("verified", F.lit(False)), "not_verified").when(~F.col("kind").isin(*KINDS), "not_terminal").when(F.col("late"), "no_successor_price")
        .when(F.col("last_date").isNull(), "no_trade_before").when(F.datediff("event_date", "last_date") > BRIDGE_DAYS, "long_gap")
        .when(value.isNull() | F.isnan(value) | (value < 0), "missing_value").when((F.col("kind") == "worthless_cancellation") & (value != 0), "worthless_with_value")
        .when(F.col("unresolved"), "unpriced_rights").otherwise("valued")
    )
    extra = F.when(F.col("unresolved") & (F.col("rights_max") >= 0), F.col("rights_max"))
    return e.select("symbol", "event_date", "known", "value", extra.alias("extra"), "last_date", "last_close", "last_adj", status.alias("status"))


def terminal_labels(spine: DataFrame, bars: DataFrame, events: DataFrame, h: int, as_of: datetime.date | str) -> DataFrame:
    """(symbol, date, outcome, available, resolved, low, high, status): outcomes from the next close to h sessions later.

    `spine`: symbol, date, a row a session; `bars`: symbol, date, close, adj_close, stock_splits, source, no_trade. Where
    the exit quote is missing, the entry was a real trade and the symbol's event falls into the holding time, the event's
    value stands in, once exit, event and value are known at `as_of`. Rights without a price give bounds (`low`, `high`:
    worth nothing or their most), never an outcome. A symbol is one security with one terminal event at most.
    """
    quotes = bars.select("symbol", "date", F.when(actual_trade() & (F.col("adj_close") > 0), F.col("adj_close")).alias("c"))
    w = Window.partitionBy("symbol").orderBy("date")
    ahead = lambda c, k: F.lead(c, k).over(w)
    df = spine.select("symbol", "date").join(quotes, ["symbol", "date"], "left").select("symbol", "date", ahead("c", 1).alias("entry"), ahead("c", h + 1).alias("exit"), ahead("date", 1).alias("entry_date"), ahead("date", h + 1).alias("exit_date"))
    df = df.join(valued_events(events, bars), "symbol", "left")
    quoted = F.col("exit") / F.col("entry") - 1
    available = F.greatest("exit_date", "event_date", "known")
    inside = quoted.isNull() & F.col("entry").isNotNull() & (F.col("entry_date") <= F.col("last_date")) & (F.col("exit_date") >= F.col("event_date")) & (available <= F.lit(as_of).cast("date"))
    paid = lambda value: F.col("last_adj") / F.col("entry") * value / F.col("last_close") - 1
    known = F.coalesce(inside & (F.col("status") == "valued"), F.lit(False))
    outcome = F.when(known, paid(F.col("value"))).otherwise(quoted)
    bounded = inside & (F.col("status") == "unpriced_rights") & F.col("extra").isNotNull()
    bound = lambda add: F.when(bounded, paid(F.col("value") + add)).otherwise(outcome)
    return df.select("symbol", "date", outcome.alias("outcome"), F.when(known, available).otherwise(F.col("exit_date")).alias("available"), known.alias("resolved"), bound(F.lit(0.0)).alias("low"), bound(F.col("extra")).alias("high"), "status")
