"""Later steps of the text tape and the scorebook: deeper reads, cleaning, calendars, releases, enrichment, fallbacks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators.text import EDGE


def search(df: DataFrame, words: str, columns: list[str], sector: str | None = None) -> DataFrame:
    """Rows in which any column holds the words, of a sector if given; best rank first, unranked last."""
    hit = F.exists(F.array(*columns), lambda c: F.lower(c).contains(words.lower()))
    df = df.where(hit) if sector is None else df.where(hit & (F.col("sector") == sector))
    return df.orderBy(F.col("rank").asc_nulls_last(), "symbol")


def to_records(df: DataFrame) -> DataFrame:
    """Rows as JSON records, nulls kept out."""
    return df.select(F.to_json(F.struct("*")).alias("record"))


def from_records(df: DataFrame, schema: str) -> DataFrame:
    """JSON records with an explicit schema; records that do not fit are kept in `bad`."""
    r = F.from_json("record", f"{schema}, bad string", {"columnNameOfCorruptRecord": "bad", "mode": "PERMISSIVE"})
    return df.select(r.alias("r")).select("r.*")


def without_groups(columns: list[str], patterns: list[str]) -> list[str]:
    """Feature names less those that match a pattern of a dropped group."""
    import re

    return [c for c in columns if not any(re.search(p, c) for p in patterns)]


def deeper_reads(articles: DataFrame, seen: DataFrame, most: int = 4, least_chars: int = 400) -> DataFrame:
    """Best substantive article of each source, those shown before only if fewer than three are new.

    Columns source, url, text, importance; `seen` has url.
    """
    df = articles.where(F.length("text") >= least_chars)
    fresh = df.join(seen.select("url").distinct().withColumn("_seen", F.lit(True)), "url", "left").withColumn("old", F.coalesce("_seen", F.lit(False))).drop("_seen")
    new = fresh.where("not old").select("source").distinct().limit(3).count() >= 3
    pool = fresh.where("not old") if new else fresh
    one = pool.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy("old", F.desc("importance"), "url"))).where("k = 1")
    return one.orderBy("old", F.desc("importance"), "url").limit(most).drop("k")


def _let(x: Column, f) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.transform(F.array(x), f)[0]


def clean_conclusion(text: Column, title: Column) -> Column:
    """A summary without navigation debris, with white space squeezed and its title in front taken off."""
    # fixed values
    menu = "(?:Markets|Business|Investing|Tech|Politics|Economy|Videos)"
    steps = (
        (lambda x: F.lower(x).contains("skip navigation"), rf"(?is){EDGE}Skip Navigation{EDGE}.*$", " "),
        (None, rf"(?i){EDGE}{menu}\s+{menu}(?:\s+{menu})+", " "),
        (lambda x: F.lower(x).contains("yes a checkmark"), "(?i)Yes A checkmark with a circle around it close", " "),
        (lambda x: x.contains("close"), rf"{EDGE}close\s+([A-Z])", "$1"),
        (None, rf"{EDGE}(data|war|rally|update)\s+(Over in|Stock futures|Earnings season|Investors|The oil){EDGE}", "$1. $2"),
    )

    def step(t: Column, may, pattern: str, to: str) -> Column:
        """A pattern is read only where its fixed part stands in the text."""
        return F.regexp_replace(t, pattern, to) if may is None else _let(t, lambda x: F.when(may(x), F.regexp_replace(x, pattern, to)).otherwise(x))

    t = reduce(lambda t, s: step(t, *s), steps, text)
    squeezed = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    rest = lambda t, head: F.when(F.startswith(F.lower(t), F.lower(head)), F.trim(F.substring(t, F.length(head) + 1, F.length(t)))).otherwise(t)
    return _let(F.struct(squeezed(t).alias("t"), squeezed(title).alias("head")), lambda x: rest(x["t"], x["head"]))


def key_points(text: Column) -> Column:
    """What follows a key-points label, 40 to 700 characters, else the whole text."""
    found = F.regexp_extract(text, rf"(?is){EDGE}Key Points\s+(.{{40,700}})", 1)
    return F.when(found != "", found).otherwise(text)


def dedupe_lists(text: Column) -> Column:
    """A comma list with repeated entries once."""
    return F.array_join(F.array_distinct(F.transform(F.split(text, ","), lambda x: F.trim(x))), ", ")


def useful(text: Column, least: int = 40) -> Column:
    return (F.length(F.trim(text)) >= least) & ~F.lower(text).rlike(r"\b(lorem ipsum|javascript is disabled|enable cookies)\b")


def metric_mode(posts: DataFrame) -> DataFrame:
    """Whether all posts carry scores; else attention is not ranked by them."""
    return posts.agg(F.bool_and(F.col("score").isNotNull()).alias("ranked"), F.count(F.lit(1)).alias("posts"))


def earnings_movers(calendar: DataFrame, movers: DataFrame, most: int = 12) -> DataFrame:
    return movers.join(calendar.select("symbol").distinct(), "symbol", "left_semi").orderBy(F.desc(F.abs("change")), "symbol").limit(most)


def release_metrics(releases: DataFrame) -> DataFrame:
    """(release_id, kind, mom, yoy, payrolls, tone) from the text of macro releases."""
    t = F.lower("text")
    number = lambda p: F.regexp_extract(t, p, 1).try_cast("double")
    kind = F.when(t.contains("payroll"), "payrolls").when(t.contains("consumer price"), "cpi").when(t.contains("producer price"), "ppi").otherwise("other")
    up = F.when(F.regexp_extract(t, r"(decreased|fell|declined) (?:by )?[0-9.]+ percent", 1) != "", -1.0).otherwise(1.0)
    mom = number(r"(?:increased|rose|decreased|fell|declined) (?:by )?([0-9.]+) percent") * up
    df = releases.select("release_id", kind.alias("kind"), mom.alias("mom"), number(r"([0-9.]+) percent over the (?:last|past) 12 months").alias("yoy"), F.regexp_replace(F.regexp_extract(t, r"by ([0-9,]+)", 1), ",", "").try_cast("long").alias("payrolls"))
    return df.withColumn("tone", F.when(F.col("mom") >= 0.4, "hot").when(F.col("mom") <= 0.1, "cooler").otherwise("in line"))


def due_events(events: DataFrame, now, hours: int = 96, most: int = 8) -> DataFrame:
    """Events of the coming hours in order, and whether their day has begun."""
    at = F.unix_timestamp("at") - F.unix_timestamp(now)
    return events.where((at >= 0) & (at <= hours * 3600)).withColumn("today", F.to_date("at") == F.to_date(now)).orderBy("at", "name").limit(most)


def latest_news(items: DataFrame, now, days: int = 30) -> DataFrame:
    """Newest headline of each symbol inside the last days."""
    df = items.where((F.col("published") <= now) & (F.datediff(now, "published") <= days))
    return df.groupBy("symbol").agg(F.max_by("title", F.struct("published", "title")).alias("title"), F.max("published").alias("published"))


def cards(candidates: DataFrame, owners: DataFrame, most: int = 5) -> DataFrame:
    """Cards whose reference belongs to a known source, one a source, first ones kept."""
    j = candidates.join(owners.select("ref", "source"), "ref")
    one = j.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy("ref"))).where("k = 1").drop("k")
    return one.orderBy("ref").limit(most)


def live_or_cached(live: DataFrame, cached: DataFrame, now, hours: int = 24) -> DataFrame:
    """Live rows; if there are none, cached ones not older than `hours`, labelled."""
    if not live.isEmpty():
        return live.withColumn("origin", F.lit("live"))
    fresh = (F.unix_timestamp(now) - F.unix_timestamp("fetched")) <= hours * 3600
    return cached.where(fresh).withColumn("origin", F.lit("cached"))


def scorebook(scored: DataFrame, metadata: DataFrame, technical: DataFrame, strategic: DataFrame) -> DataFrame:
    """Scored rows with names, technical fields and the strategic percentile; a missing side leaves nulls."""
    t = technical.select("symbol", *[c for c in technical.columns if c not in scored.columns])
    m = metadata.select("symbol", *[c for c in metadata.columns if c not in scored.columns and c not in t.columns])
    return scored.join(m, "symbol", "left").join(t, "symbol", "left").join(strategic.select("symbol", F.col("percentile").alias("strategic_percentile")), "symbol", "left")


def market_strip(latest: DataFrame, bench: str) -> DataFrame:
    """Series with their return against the benchmark's, best first, unknown last."""
    b = latest.where(F.col("symbol") == bench).agg(F.max("change")).first()[0]
    return latest.withColumn("relative", F.col("change") - F.lit(b)).orderBy(F.col("relative").desc_nulls_last(), "symbol")


def desk_calls(scored: DataFrame) -> DataFrame:
    """First four confirmed names and the first rebound to watch."""
    n = F.row_number().over(Window.partitionBy("setup").orderBy("rank"))
    df = scored.where("setup in ('momentum_confirmed', 'model_rebound_watch')").withColumn("k", n)
    return df.where((F.col("setup") == "momentum_confirmed") & (F.col("k") <= 4) | (F.col("setup") == "model_rebound_watch") & (F.col("k") <= 1)).drop("k")


def top_sectors(scored: DataFrame, most: int = 3) -> DataFrame:
    return scored.groupBy("sector").agg(F.count(F.lit(1)).alias("names"), F.avg("percentile").alias("percentile")).orderBy(F.desc("names"), F.desc("percentile"), "sector").limit(most)


def action_label(percentile: Column, setup: Column) -> Column:
    # fixed values
    return F.when((percentile >= 90) & (setup == "momentum_confirmed"), "Research now").when((percentile >= 90) & (setup == "model_rebound_watch"), "Wait for activation").when(percentile >= 90, "Watch").when(percentile <= 10, "Avoid").otherwise("Hold")


def rescore(cached: DataFrame, columns: dict[str, float]) -> DataFrame:
    """A cached cross-section under another linear model."""
    total = None
    for c, w in columns.items():
        part = F.coalesce(F.col(c), F.lit(0.0)) * w
        total = part if total is None else total + part
    return cached.withColumn("score", total)


def trim_to_best(nodes: DataFrame, best: int) -> DataFrame:
    return nodes.where(F.col("tree") <= best)


def cross_source(a: DataFrame, b: DataFrame) -> DataFrame:
    """Largest difference of one-session returns between two sources, by symbol."""
    w = Window.partitionBy("symbol").orderBy("date")
    r = lambda df, n: df.select("symbol", "date", (F.col("close") / F.lag("close").over(w) - 1).alias(n))
    return r(a, "ra").join(r(b, "rb"), ["symbol", "date"]).groupBy("symbol").agg(F.max(F.abs(F.col("ra") - F.col("rb"))).alias("largest"), F.count(F.lit(1)).alias("days"))


def sector_observations(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Dated sectors with one value a day and security; conflicts are an error, aliases are resolved."""
    named = rows.join(aliases, F.col("symbol") == F.col("name"), "left").select(F.coalesce("security", "symbol").alias("symbol"), "date", "sector").distinct()
    bad = named.groupBy("symbol", "date").agg(F.countDistinct("sector").alias("n")).where("n > 1").limit(1).collect()
    if bad:
        raise ValueError(f"sectors conflict: {bad[0].asDict()}")
    return named
