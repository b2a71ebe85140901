"""Scalar column functions: symbols, HTML text, numbers, dates, clocks, trading calendar, sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def normal_symbol(x: Column) -> Column:
    """Upper case, class dots as dashes, stars and blanks removed."""
    return F.regexp_replace(F.regexp_replace(F.upper(F.trim(x)), r"[*\s]", ""), r"\.", "-")


def decode_entities(x: Column) -> Column:
    """Named and numeric entities, the ampersand last."""
    # fixed values
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(char))
    return x


def strip_html(x: Column) -> Column:
    """Tags to blanks, entities decoded, white space squeezed."""
    return F.trim(F.regexp_replace(decode_entities(F.regexp_replace(x, r"<[^>]*>", " ")), r"\s+", " "))


def parse_size(x: Column) -> Column:
    """'1.5T', '320B', '12M' as dollars; null if it is no size."""
    number = F.regexp_extract(x, r"^\$?([0-9]+(?:\.[0-9]+)?)([TBM]?)$", 1)
    unit = F.regexp_extract(x, r"^\$?([0-9]+(?:\.[0-9]+)?)([TBM]?)$", 2)
    scale = F.when(unit == "T", 1e12).when(unit == "B", 1e9).when(unit == "M", 1e6).otherwise(1.0)
    return F.when(number != "", number.try_cast("double") * scale)


def format_size(x: Column) -> Column:
    return F.when(x >= 1e12, F.format_string("%.2fT", x / 1e12)).when(x >= 1e9, F.format_string("%.1fB", x / 1e9)).when(x >= 1e6, F.format_string("%.0fM", x / 1e6)).otherwise(F.format_string("%.0f", x))


def cap_bucket(x: Column, edges=(200e9, 10e9, 2e9), names=("Mega", "Large", "Mid", "Small")) -> Column:
    """Bucket by falling thresholds."""
    out = F.when(x.isNull(), "Unknown")
    for e, n in zip(edges, names, strict=False):
        out = out.when(x >= e, n)
    return out.otherwise(names[-1])


def series_delta(x: Column, before: Column, kind: Column) -> Column:
    """Change of a series by kind: basis points, percentage points, percent, or plain."""
    return F.when(kind == "bps", (x - before) * 100).when(kind == "pp", x - before).when((kind == "pct") & (before != 0), (x / before - 1) * 100).otherwise(x - before)


def latest_deltas(values: DataFrame, key: str, at: str, value: str, kind: str) -> DataFrame:
    """(key, latest, previous, delta) by series: the last two valid values and their change by kind; null with fewer than two.

    A value counts if it is a finite number. Places are limited before the shuffle, so a long series sends two rows a task.
    """
    x = F.col(value).cast("double")
    valid = values.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))).select(key, kind, F.struct(F.col(at).alias("at"), x.alias("x")).alias("v"))
    last = valid.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("v")))).where("n <= 2")
    side = lambda n, c: F.max(F.when(F.col("n") == n, F.col(c)))
    g = last.groupBy(key).agg(side(1, "v.x").alias("latest"), side(2, "v.x").alias("previous"), side(1, kind).alias("kind"))
    return g.select(key, "latest", "previous", series_delta(F.col("latest"), F.col("previous"), F.col("kind")).alias("delta"))


def utc_date(x: Column, this_year: int) -> Column:
    """A time from text in one of the usual forms; null outside 2000 to next year."""
    t = F.coalesce(F.try_to_timestamp(x), F.try_to_timestamp(x, F.lit("yyyy/MM/dd HH:mm")), F.try_to_timestamp(x, F.lit("dd MMM yyyy HH:mm:ss Z")))
    return F.when(F.year(t).between(2000, this_year + 1), t)


def eastern(x: Column) -> Column:
    """A New York wall clock as UTC."""
    return F.to_utc_timestamp(x, "America/New_York")


def age_hours(x: Column, now: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp_ltz")) - F.unix_micros(x.cast("timestamp_ltz"))) / F.lit(3.6e9)


def ticker_list(x: Column, most: int = 25) -> Column:
    """Symbols pasted as text: split, checked, first ones kept once."""
    parts = F.transform(F.split(F.upper(x), r"[\s,;]+"), lambda s: F.regexp_replace(s, r"^\$", ""))
    return F.slice(F.array_distinct(F.filter(parts, lambda s: s.rlike(r"^[A-Z][A-Z0-9.-]{0,7}$"))), 1, most)


def first_sentences(x: Column, n: int) -> Column:
    """The first n sentences; common abbreviations do not end one."""
    # fixed values
    kept = F.regexp_replace(F.regexp_replace(x, r"\b(U|e|i)\.(S|g|e)\.", "$1\u0001$2\u0001"), r"\b(Mr|Mrs|Dr|Inc|Corp|vs)\.", "$1\u0001")
    return F.replace(F.trim(F.concat_ws("", F.slice(F.regexp_extract_all(kept, F.lit(r"[^.!?]+[.!?]+"), F.lit(0)), 1, n))), F.lit("\u0001"), F.lit("."))


def trading_days(spark: SparkSession, first: str, last: str) -> DataFrame:
    """(date, is_session) of a New York style calendar: weekends and observed holidays are closed.

    Holidays come from rules: fixed days moved off weekends, nth Mondays and Thursdays, and Good Friday from
    the date of Easter.
    """
    d = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date"))
    y, m, dom, dow = F.year("date"), F.month("date"), F.dayofmonth("date"), F.dayofweek("date")
    nth = F.floor((dom - 1) / 7) + 1
    last_week = F.month(F.date_add("date", 7)) != m

    def fixed(month: int, day: int):
        on = (m == month) & (dom == day) & dow.between(2, 6)
        sunday = (m == month) & (dom == day + 1) & (dow == 2)
        saturday = (m == month) & (dom == day - 1) & (dow == 6) if day > 1 else F.lit(False)
        return on | sunday | saturday

    g, c = y % 19, F.floor(y / 100)
    h = (c - F.floor(c / 4) - F.floor((8 * c + 13) / 25) + 19 * g + 15) % 30
    i = h - F.floor(h / 28) * (1 - F.floor(29 / (h + 1)) * F.floor((21 - g) / 11))
    j = (y + F.floor(y / 4) + i + 2 - c + F.floor(c / 4)) % 7
    k = i - j
    em = 3 + F.floor((k + 40) / 44)
    ed = k + 28 - 31 * F.floor(em / 4)
    good_friday = F.date_sub(F.make_date(y, em.cast("int"), ed.cast("int")), 2)
    closed = (
        fixed(1, 1) | fixed(7, 4) | fixed(12, 25) | (fixed(6, 19) & (y >= 2022)) | ((m == 1) & (dow == 2) & (nth == 3)) | ((m == 2) & (dow == 2) & (nth == 3))
        | ((m == 5) & (dow == 2) & last_week) | ((m == 9) & (dow == 2) & (nth == 1)) | ((m == 11) & (dow == 5) & (nth == 4)) | (F.col("date") == good_friday)
    )
    return d.select("date", (dow.between(2, 6) & ~closed).alias("is_session"))


def latest_session(now: Column, days: DataFrame, cutoff_hour: int = 14) -> Column:
    """Bound for the latest expected session: today after the cut-off, else the day before; look it up as of `days`."""
    return F.when(F.hour(now) >= cutoff_hour, F.to_date(now)).otherwise(F.date_sub(F.to_date(now), 1))
