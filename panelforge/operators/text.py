"""Text tape: pages to articles, themes, importance, tickers and attention; built-in expressions only."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.scalars import strip_html

# fixed values: theme names, their words, and the order in which a primary theme is chosen
THEMES = {
    "Earnings": "earnings|results|revenue|guidance|profit|eps|quarter|margin|beat|miss",
    "Rates and central banks": "fed|fomc|powell|rate|rates|yield|treasury|bond|ecb|lagarde|bank of england|boe|boj|central bank|monetary policy|inflation|cpi|pce",
    "Geopolitics and policy": "iran|israel|ukraine|russia|china|taiwan|war|conflict|geopolitical|sanction|tariff|trade|election|congress|white house|hormuz",
    "Commodities and energy": "oil|crude|brent|wti|gasoline|opec|energy|natural gas|gold|copper|commodity|commodities",
    "Macro and growth": "gdp|payroll|jobs|unemployment|claims|retail sales|consumer|pmi|ism|growth|recession|soft landing|hard landing",
    "Credit and liquidity": "credit|spread|spreads|liquidity|funding|default|high yield|investment grade|bank stress|refunding|treasury borrowing",
    "AI and semis": "ai|artificial intelligence|semiconductor|semis|chips|gpu|data center|datacenter",
}
DEFAULT_THEME = "Market color"
PRIORITY = ["Geopolitics and policy", "Rates and central banks", "Commodities and energy", "Macro and growth", "Earnings", "AI and semis", "Credit and liquidity", DEFAULT_THEME]
MEDIA = "newsletter|co-author|coauthor|returns to|joins|hires|appointed|promoted|media post|mediapost|journalist|editor|coverage team|will author|will co-author"
PERSONAL = "social security|medicare|401k|ira|retirement|estate plan|mortgage|payroll taxes|my husband|my wife|i claimed|i'm working|i am working|should i|personal finance"
ONE_DEAL = "dulux maker|takeover bid from major rival|stock soars 20% after takeover bid"
BROAD = (
    "s&p|nasdaq|dow|russell|index|indices|futures|sector|industry|semiconductor|semis|chip|chips|ai infrastructure|data center|hyperscaler|"
    "oil|crude|brent|wti|energy|gasoline|gold|copper|treasury|yield|yields|fed|fomc|ecb|boj|boe|inflation|cpi|ppi|pce|jobs|payroll|unemployment|"
    "claims|gdp|consumer spending|retail sales|tariff|trade|china|iran|israel|hormuz|credit|spreads|banks|financials|housing|dollar|rates|"
    "defense sector|aerospace|supply chain"
)
MOVES = "soars?|surges?|jumps?|rips?|pops?|rallies|tumbles|plunges|slides|falls"
SINGLE_NAME = (rf"(?:stock|shares?)\s+(?:{MOVES})", rf"(?:{MOVES})\s+\d+%?\s+(?:on|after|as)", "earnings beat")
ROUNDUP = "live updates|stock market today|daily open|before the bell"
ROUNDUP_TOPIC = "oil|yield|fed|cpi|ppi|payroll|earnings|guidance|hormuz|tariff|credit"
HEADLINE = "breaking|daily open|market pulse|stock market today|before the bell|after hours|wall street|yields?|oil|earnings|central bank"
WALL = "pardon our interruption|privacy|terms|sign in|login|subscribe"
WEIGHTY = ["Earnings", "Rates and central banks", "Geopolitics and policy", "Commodities and energy"]
FRESH_HOURS, IMPORTANT_HOURS, IMPORTANT_SCORE, DRIVERS = 24, 96, 44, 48
STOP_WORDS = [
    "A", "AI", "ALL", "AM", "ATH", "CEO", "CFO", "CPI", "DD", "EPS", "ETF", "FBI", "FDA", "FOMC", "GDP", "IPO", "IRS", "IT", "JOB", "LOL", "M", "MAGA",
    "NYSE", "OP", "OTM", "PCE", "PM", "PUT", "SEC", "USA", "USD", "YOLO",
]
GENERIC_THREAD = "daily discussion|what are your moves|weekend discussion|earnings thread|daily thread|premarket thread|market open thread|moves tomorrow|watchlist"
#: A word boundary that knows ASCII words only, whatever the text around it.
EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def has_words(text: Column, words: str) -> Column:
    """Whether one of the alternatives stands in the text as words, in any case."""
    return text.rlike(rf"(?i){EDGE}(?:{words}){EDGE}")


def _parts(words: str) -> tuple[list[str], list[str]]:
    """The alternatives of a list without groups: single words, with their optional last letters written out, and phrases."""
    single, phrases = [], []
    for x in words.replace("trade[- ]off", "trade-off|trade off").split("|"):
        if re.fullmatch(r"[a-z0-9_]+\??", x):
            single += [x[:-2], x[:-1]] if x.endswith("?") else [x]
        else:
            phrases.append(x)
    return single, phrases


def vocabulary(*lists: str) -> list[str]:
    """The words of the alternatives, those of their phrases too."""
    return sorted({w for words in lists for single, phrases in [_parts(words)] for x in [*single, *phrases] for w in re.findall("[a-z0-9_]+", x.lower())})


def lowered(text: Column) -> Column:
    """Lower case where only A-Z become a-z: two more letters, which lower case turns into ASCII, are blotted out first."""
    return F.lower(F.replace(F.replace(text, F.lit("\u212a"), F.lit("\ufffd")), F.lit("\u0130"), F.lit("\ufffd")))


def found_words(low: Column, known: list[str]) -> Column:
    """Which of the known words stand in a lowered text."""
    return F.array_intersect(F.split(low, "[^a-z0-9_]+"), F.lit(known).cast("array<string>"))


def has_found(found: Column, low: Column, words: str) -> Column:
    """As `has_words`, by the words found in a lowered text: patterns are read only for phrases that stand in it and whose words do."""
    single, phrases = _parts(words)
    here = F.arrays_overlap(found, F.lit(single).cast("array<string>")) if single else F.lit(False)
    for x in phrases:
        pieces = sorted(set(re.findall("[a-z0-9_]+", x.lower())))
        all_ = F.size(F.array_intersect(found, F.lit(pieces).cast("array<string>"))) == len(pieces)
        here = here | (all_ & low.contains(x.lower()) & has_words(low, re.sub(r"([().&$*+?])", r"\\\1", x)))
    return here


def contains_any(low: Column, words: str) -> Column:
    """Whether one of the alternatives (optional last letters are of no account) stands anywhere in a lowered text."""
    return reduce(lambda a, b: a | b, [low.contains(re.sub(r".\?$", "", x)) for x in words.split("|")])


def meta(html: Column, name: str) -> Column:
    return F.regexp_extract(html, rf'(?i)<meta\b[^>]*(?:property|name|itemprop)="{name}"[^>]*content="([^"]*)"', 1)


def _first(*columns: Column) -> Column:
    return F.coalesce(*[F.when(c != "", c) for c in columns])


def page_title(html: Column) -> Column:
    """From metadata, the first heading or the title; 160 characters."""
    raw = _first(meta(html, "og:title"), F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.substring(strip_html(raw), 1, 160)


def page_summary(html: Column) -> Column:
    raw = _first(meta(html, "description"), meta(html, "og:description"), F.regexp_extract(html, r"(?is)<p[^>]*>(.*?)</p>", 1))
    return F.substring(strip_html(raw), 1, 320)


def visible_text(html: Column) -> Column:
    for tag in ("script", "style", "nav", "footer", "header"):
        html = F.regexp_replace(html, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    return strip_html(html)


def published(html: Column) -> Column:
    """Date of a page: metadata, a time element, else the first ISO day in the text."""
    return _first(meta(html, "article:published_time"), F.regexp_extract(html, r'(?i)<time[^>]*datetime="([^"]+)"', 1), F.regexp_extract(html, r'"datePublished"\s*:\s*"([^"]+)"', 1), F.regexp_extract(html, r"(20\d\d-\d\d-\d\d)", 1))


# fixed values
LINK_GOOD = "commentary|insight|research|market|outlook|weekly|capital-market|strategy|economic|macro|article|blog"
LINK_BAD = (
    "login|sign-in|privacy|terms|careers|contact|subscribe|podcast|webinar|event|video|pdf|mailto|javascript|archive|award|recognition|about|account|solution|product|fund|529|college|advisor|client|"
    "why-|alternative-investments|benefits-of|financial-plan|personal-finance|retirement|estate-planning"
)
LINK_DATE = r"20[0-9]{2}[/-][0-9]{1,2}[/-][0-9]{1,2}|[0-9]{1,2}[/-][0-9]{1,2}[/-]20[0-9]{2}"


def links(pages: DataFrame, most: int = 5, least: int = 4) -> DataFrame:
    """Best links of each page (page_id, url, html, source): absolute, of the same host or a subdomain, scored by address and text.

    Labels under eight characters are left out; a fragment is cut off; of equal targets the best counts.
    """
    tags = F.regexp_extract_all("html", F.lit(r'(?is)<a\b[^>]*href="[^"]*"[^>]*>.*?</a>'), F.lit(0))
    df = pages.select("page_id", "url", "source", F.explode(tags).alias("tag")).select(
        "page_id", "url", "source", F.regexp_extract("tag", r'(?i)href="([^"]*)"', 1).alias("href"), strip_html(F.col("tag")).alias("label"))
    host = lambda c: F.regexp_replace(F.regexp_extract(c, r"^https?://([^/?#]+)", 1), r"^www\.", "")
    df = df.withColumn("target", F.when(F.col("href").rlike("^https?://"), F.col("href")).when(F.col("href").startswith("/"), F.concat(F.regexp_extract("url", r"^(https?://[^/]+)", 1), F.col("href"))))
    df = df.withColumns({"here": host("url"), "there": host("target"), "target": F.regexp_replace("target", "#.*$", "")}).where(F.length("label") >= 8)
    df = df.where((F.col("here") == F.col("there")) | F.col("there").endswith(F.concat(F.lit("."), "here")) | F.col("here").endswith(F.concat(F.lit("."), "there")))
    rest = F.regexp_replace("target", r"^https?://[^/?]+", "")
    path = F.regexp_replace(rest, r"\?.*$", "")
    hay = F.lower(F.concat(path, F.lit(" "), F.regexp_extract(rest, r"(\?.*)$", 1), F.lit(" "), "label"))
    points = lambda when, n: F.when(when, n).otherwise(0)
    word = F.substring_index(F.lower(F.coalesce("source", F.lit(""))), " ", 1)
    score = points(hay.rlike(LINK_GOOD), 8) - points(hay.rlike(LINK_BAD), 10) + points(hay.rlike(LINK_DATE), 5) + points(hay.contains(word), 1)
    score = score + points(F.size(F.filter(F.split(path, "/"), lambda x: x != "")) >= 2, 2) - points(path.isin("", "/"), 3)
    best = df.withColumn("score", score).where(F.col("score") >= least).groupBy("page_id", "target").agg(F.max("score").alias("score"), F.max_by("label", F.struct("score", "label")).alias("label"))
    w = Window.partitionBy("page_id").orderBy(F.desc("score"), "target")
    return best.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def themes(text: Column) -> Column:
    found = F.array_compact(F.array(*[F.when(has_words(text, words), F.lit(name)) for name, words in THEMES.items()]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(DEFAULT_THEME)))


def primary_theme(found: Column) -> Column:
    return F.coalesce(*[F.when(F.array_contains(found, t), F.lit(t)) for t in PRIORITY], found[0])


def is_media_meta(text: Column) -> Column:
    return has_words(text, MEDIA)


def is_single_name(text: Column) -> Column:
    """A headline of one stock's move."""
    return has_words(text, SINGLE_NAME[0]) | has_words(text, SINGLE_NAME[1]) | has_words(text, SINGLE_NAME[2])


def is_low_signal(title: Column, summary: Column, excerpt: Column, source: Column) -> Column:
    """Media about media, personal finance, a single deal or name without a broad channel, or a roundup without a topic."""
    text = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(summary, F.lit("")), F.coalesce(excerpt, F.lit("")))
    single = is_single_name(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(summary, F.lit("")))) & ~has_words(text, BROAD)
    roundup = has_words(F.coalesce(title, F.lit("")), ROUNDUP) & ~has_words(text, ROUNDUP_TOPIC)
    personal = has_words(text, PERSONAL) | text.rlike(rf"(?i){EDGE}401\(k\){EDGE}")
    return is_media_meta(F.concat_ws(" ", F.coalesce(source, F.lit("")), text)) | personal | has_words(text, ONE_DEAL) | single | roundup


def trust_score(trust: Column) -> Column:
    t = F.lower(F.coalesce(trust, F.lit("")))
    return F.when(t.contains("very high"), 5.0).when(t.contains("high"), 4.0).when(t.contains("medium"), 3.0).otherwise(2.0)


#: The words of every list that articles are read for.
KNOWN_WORDS = vocabulary(*THEMES.values(), MEDIA, PERSONAL, ONE_DEAL, BROAD, MOVES, "stock|share|shares|on|after|as", SINGLE_NAME[2], ROUNDUP, ROUNDUP_TOPIC)


def behind(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns through a generator of one row: later filters and choices do not move below it and work them out again."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def scored_articles(articles: DataFrame) -> DataFrame:
    """Adds themes, media, low, broad and importance to articles (title, summary, excerpt, source, trust, age, since_previous).

    Importance is trust, news since the last refresh, freshness (`age` in hours, null: undated), weighty
    themes and headline words, less penalties for earnings or single names without a broad channel, undated
    pieces, media about media, low signal and pages behind a wall.
    """
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")), F.coalesce("excerpt", F.lit("")))
    short = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")))
    # each step stands behind a generator, so that nothing after it reads the text again
    df = behind(articles, _low=lowered(text), _short=lowered(short), _source=lowered(F.coalesce("source", F.lit(""))))
    df = behind(df, _found=found_words(F.col("_low"), KNOWN_WORDS), _named=found_words(F.col("_source"), KNOWN_WORDS), headline=contains_any(F.col("_low"), HEADLINE), wall=contains_any(F.col("_low"), WALL))
    found, low, all_ = F.col("_found"), F.col("_low"), F.array_union("_found", "_named")
    has = lambda words: has_found(found, low, words)
    any_of = lambda words: F.arrays_overlap(found, F.lit(words).cast("array<string>"))
    moves = any_of(_parts(MOVES)[0])
    single = (any_of(["stock", "share", "shares"]) & moves & has_words(F.col("_short"), SINGLE_NAME[0])) | (any_of(["on", "after", "as"]) & moves & has_words(F.col("_short"), SINGLE_NAME[1])) | has_found(found, F.col("_short"), SINGLE_NAME[2])
    themed = F.array_compact(F.array(*[F.when(has(words), F.lit(name)) for name, words in THEMES.items()]))
    df = behind(
        df, themes=F.when(F.size(themed) > 0, themed).otherwise(F.array(F.lit(DEFAULT_THEME))), broad=has(BROAD), single=single,
        media=has_found(all_, F.concat_ws(" ", "_source", "_low"), MEDIA), _personal=has(PERSONAL) | (low.contains("401(k)") & low.rlike(rf"{EDGE}401\(k\){EDGE}")),
        _deal=has(ONE_DEAL), _roundup=has_found(found, lowered(F.coalesce("title", F.lit(""))), ROUNDUP) & ~has(ROUNDUP_TOPIC),
    )
    df = df.withColumn("low", F.col("media") | F.col("_personal") | F.col("_deal") | (F.col("single") & ~F.col("broad")) | F.col("_roundup"))
    df = df.drop("_low", "_short", "_source", "_found", "_named", "_personal", "_deal", "_roundup")
    points = lambda when, n: F.when(when, n).otherwise(0)
    fresh = F.when(F.col("age") <= FRESH_HOURS, 24).when(F.col("age") <= IMPORTANT_HOURS, 8).otherwise(0)
    score = (
        trust_score(F.col("trust")) * 8 + points(F.col("since_previous"), 30) + fresh
        + points(F.arrays_overlap("themes", F.lit(WEIGHTY)), 14) + points(F.col("headline"), 8)
        - points(F.array_contains("themes", "Earnings") & ~F.col("broad"), 26) - points(F.col("single") & ~F.col("broad"), 35)
        - points(F.col("age").isNull(), 12) - points(F.col("media"), 80) - points(F.col("low"), 45) - points(F.col("wall"), 40)
    )
    return df.withColumn("importance", score).drop("single", "headline", "wall")


def market_drivers(scored: DataFrame, most: int = DRIVERS) -> DataFrame:
    """The best article of each url among those that are fresh, or important and not old; media, noise and narrow earnings aside."""
    narrow = (F.size("themes") == 1) & (F.col("themes")[0] == "Earnings") & ~F.col("broad")
    fresh = F.col("since_previous") | F.coalesce(F.col("age") <= FRESH_HOURS, F.lit(False))
    important = F.coalesce((F.col("age") <= IMPORTANT_HOURS) & (F.col("importance") >= IMPORTANT_SCORE), F.lit(False))
    kept = scored.where(~F.col("media") & ~F.col("low") & ~narrow & (fresh | important) & F.col("url").isNotNull() & (F.col("title") != ""))
    best = kept.groupBy("url").agg(F.min_by(F.struct("doc_id", "importance", "themes"), F.struct(-F.col("importance"), "doc_id")).alias("a"))
    return best.select("url", "a.*").orderBy(F.desc("importance"), "doc_id").limit(most)


def theme_drivers(drivers: DataFrame, themes: list[str], most: int = DRIVERS) -> DataFrame:
    """(theme, doc_id, importance): for each priority theme in turn its best driver that no earlier theme took.

    A theme can only miss its first candidates to the themes before it, so its best len(themes) ones hold its pick;
    the turns then run over that small table, one conditional aggregate a theme.
    """
    ranked = drivers.limit(most).select("doc_id", "importance", F.explode("themes").alias("theme")).where(F.col("theme").isin(themes))
    few = top_per(ranked, "theme", len(themes), F.desc("importance"), "doc_id").select("theme", "doc_id", "importance")
    lists = [F.array_sort(F.collect_list(F.when(F.col("theme") == t, F.struct((-F.col("importance")).alias("i"), "doc_id")))).alias(f"t{n}") for n, t in enumerate(themes)]
    df = few.agg(*lists).withColumn("used", F.array().cast("array<bigint>"))
    for n in range(len(themes)):
        left = F.filter(F.col(f"t{n}"), lambda x: ~F.array_contains("used", x["doc_id"]))
        df = df.withColumn(f"t{n}", F.get(left, F.lit(0))).withColumn("used", F.array_compact(F.array_append("used", F.col(f"t{n}.doc_id"))))
    picks = F.array(*[F.struct(F.lit(t).alias("theme"), F.col(f"t{n}.doc_id").alias("doc_id"), (-F.col(f"t{n}.i")).alias("importance")) for n, t in enumerate(themes)])
    return df.select(F.inline(picks)).where("doc_id is not null")


def top_per(df: DataFrame, key: str, n: int, *order) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= n)


def _mention(symbol: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.upper(symbol), "-", "."), "[^A-Z0-9.]", "")


def cashtags(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(rf"\$([A-Z][A-Z0-9.-]{{0,7}}){EDGE}"), F.lit(1)), _mention)
    return F.array_distinct(F.filter(found, lambda x: (F.length(x) >= 1) & (F.length(x) <= 6)))


def tickers(text: Column, known: list[str]) -> Column:
    """Cashtags, and known upper-case symbols, without stop words."""
    known_, stop = (F.lit(list(x)).cast("array<string>") for x in (known, STOP_WORDS))
    plain = F.transform(F.regexp_extract_all(text, F.lit(rf"{EDGE}([A-Z]{{2,5}}(?:\.[A-Z])?){EDGE}"), F.lit(1)), _mention)
    return F.array_except(F.array_distinct(F.concat(cashtags(text), F.array_intersect(plain, known_))), stop)


def ticker_signals(posts: DataFrame, known: list[str], body_chars: int = 1200) -> DataFrame:
    """(post_id, symbol, score, comments, n, weight, direct) of posts (post_id, title, body, score, comments).

    Title hits weigh 2.5, cashtags 2, body mentions 0.4 each up to four; symbols below 1 are left out. In
    generic threads, in lists of eight symbols or more without a title hit or cashtag, and with fewer than
    two mentions in the body, only title hits and cashtags count. n is the number of symbols a post keeps.
    """
    body = F.substring(F.coalesce("body", F.lit("")), 1, body_chars)
    df = posts.select("post_id", "score", "comments", F.coalesce("title", F.lit("")).alias("title"), body.alias("body"))
    both, stop, known_ = F.concat_ws(" ", "title", "body"), *(F.lit(list(x)).cast("array<string>") for x in (STOP_WORDS, known))
    cash = cashtags(both)
    df = df.withColumns({"in_title": tickers(F.col("title"), known), "in_body": tickers(F.col("body"), known), "cash": F.array_union(F.array_intersect(cash, known_), F.array_except(cash, stop))})
    df = df.withColumn("all", F.array_union(F.array_union("in_title", "in_body"), "cash"))
    dump = (F.size("all") >= 8) & (F.size("in_title") == 0) & (F.size("cash") == 0)
    df = df.select("*", (has_words(F.col("title"), GENERIC_THREAD) | dump).alias("strict"), F.explode("all").alias("symbol"))
    pattern = F.concat(F.lit(rf"(?i)(?:\$|{EDGE})"), F.regexp_replace("symbol", r"\.", "[.-]"), F.lit(EDGE))
    title, tagged, times = F.array_contains("in_title", F.col("symbol")), F.array_contains("cash", F.col("symbol")), F.regexp_count("body", pattern)
    direct = title | tagged
    weight = F.when(title, 2.5).otherwise(0.0) + F.when(tagged, 2.0).otherwise(0.0) + F.lit(0.4) * F.least(times, F.lit(4))
    kept = df.select("post_id", "symbol", "score", "comments", "strict", times.alias("times"), F.round(weight, 2).alias("weight"), direct.alias("direct"))
    kept = kept.where(F.col("direct") | (~F.col("strict") & (F.col("times") >= 2))).where("weight >= 1")
    n = F.count(F.lit(1)).over(Window.partitionBy("post_id")).cast("int")
    return kept.select("post_id", "symbol", "score", "comments", n.alias("n"), "weight", "direct")


def attention(signals: DataFrame, most: int = 15) -> DataFrame:
    """Attention by symbol: mentions, direct hits, signal, and capped score and comments shared over a post's symbols."""
    share = F.sqrt(F.greatest(F.col("n"), F.lit(1)))
    g = signals.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("mentions"), F.sum(F.col("direct").cast("int")).alias("direct"), F.sum("weight").alias("signal"),
        F.round(F.sum(F.least("score", F.lit(1200)) / share)).alias("score"), F.round(F.sum(F.least("comments", F.lit(500)) / share)).alias("comments"),
        F.slice(F.sort_array(F.collect_list(F.struct((F.col("score") + F.col("comments")).alias("s"), "post_id")), False), 1, 3).alias("top"),
    ).where("direct > 0 or mentions >= 2")
    total = F.col("mentions") * 8 + F.col("direct") * 16 + F.col("signal") * 10 + F.col("score") * 0.015 + F.col("comments") * 0.04
    return g.select("symbol", "mentions", "direct", F.round("signal", 1).alias("signal"), F.round(total.cast("decimal(30,6)"), 2).cast("double").alias("attention"), F.col("top.post_id").alias("top_posts")).orderBy(F.desc("attention"), "symbol").limit(most)


def recent_posts(posts: DataFrame, now, hours: int = 24) -> DataFrame:
    """Posts of the last hours, none dated later than now, the first of each id."""
    df = posts.where((F.col("created") <= now) & (F.col("created") > now - F.expr(f"interval {hours} hours")))
    return df.withColumn("_n", F.row_number().over(Window.partitionBy("post_id").orderBy("created"))).where("_n = 1").drop("_n")


def repeated_list(text: Column) -> Column:
    """Whether a comma list repeats an entry."""
    parts = F.transform(F.split(text, ","), lambda x: F.trim(x))
    return F.size(parts) != F.size(F.array_distinct(parts))


def source_refs(rows: DataFrame, most: int = 36) -> DataFrame:
    """S1, S2, ... newest first."""
    n = F.row_number().over(Window.orderBy(F.desc_nulls_last("published"), "url"))
    return rows.orderBy(F.desc_nulls_last("published"), "url").limit(most).withColumn("ref", F.concat(F.lit("S"), n.cast("string")))


def feed_items(feeds: DataFrame) -> DataFrame:
    """RSS items and Atom entries of (feed_id, body): id, title, link, date, summary (420 characters), excerpt (1,800).

    Each tag of an item is read and cleaned once, behind a generator, over which no later filter or choice repeats the work. Feeds
    may come in parts (a column `first`: the items before a part's own).
    """
    items = F.regexp_extract_all("body", F.lit(r"(?is)<(item|entry)\b.*?</\1>"), F.lit(0))
    text = lambda t: F.when(F.col("_low").contains(f"<{t.lower()}"), F.regexp_extract("item", rf"(?is)<{t}\b[^>]*>(.*?)</{t}>", 1)).otherwise("")
    tag = lambda t: strip_html(F.regexp_replace(text(t), r"<!\[CDATA\[|\]\]>", ""))
    names = ("title", "link", "pubDate", "updated", "published", "description", "summary", "content:encoded", "content", "id", "guid")
    read = F.struct(*[tag(t).alias(t.replace(":", "_")) for t in names], F.regexp_extract("item", r'(?i)<link[^>]*href="([^"]+)"', 1).alias("href"))
    first = F.col("first") if "first" in feeds.columns else F.lit(0)
    df = feeds.select("feed_id", first.alias("first"), F.posexplode(items).alias("pos", "item"))
    df = df.withColumn("_low", F.lower("item"))
    df = df.select("feed_id", (F.col("pos") + F.col("first")).cast("int").alias("pos"), F.inline(F.array(read)))
    one = lambda *of: _first(*map(F.col, of))
    return df.select("feed_id", "pos", "title", one("link", "href").alias("link"), one("pubDate", "updated", "published").alias("date"), F.substring(one("description", "summary"), 1, 420).alias("summary"), F.substring(one("content_encoded", "content", "description", "summary"), 1, 1800).alias("excerpt"), one("id", "guid").alias("id"))


def company_news(feeds: DataFrame, most: int = 8) -> DataFrame:
    """(symbol, item, title, link, date, summary) of the first items of each symbol's feed (feed_id is the symbol); items without title or link go."""
    df = feed_items(feeds).where(F.col("pos") < most).where(F.col("title").isNotNull() & (F.col("title") != "") & F.col("link").isNotNull())
    item = F.concat(F.col("feed_id").cast("string"), F.lit("-N"), (F.col("pos") + 1).cast("string"))
    return df.select(F.col("feed_id").alias("symbol"), item.alias("item"), "title", "link", "date", F.substring("summary", 1, 280).alias("summary"))


def forum_entries(feeds: DataFrame) -> DataFrame:
    """Posts of a forum's Atom listing, in the form of the JSON one; score and comments are not told there."""
    df = feed_items(feeds)
    return df.select(F.col("id").alias("post_id"), "title", F.col("excerpt").alias("body"), F.lit(None).cast("long").alias("score"), F.lit(None).cast("long").alias("comments"), F.try_to_timestamp("date").alias("created"))


def markdown_rows(lines: DataFrame) -> DataFrame:
    """Rows of a Markdown table: cells of lines that begin and end with a bar, without header and ruler."""
    cells = F.transform(F.split(F.trim(F.col("line")), r"\|"), lambda x: F.trim(x))
    df = lines.where(F.trim("line").rlike(r"^\|.*\|$") & ~F.trim("line").rlike(r"^[|:\-\s]+$")).select("pos", F.slice(cells, 2, F.size(cells) - 2).alias("cells"))
    return df.where(F.lower(F.col("cells")[0]) != "name")
