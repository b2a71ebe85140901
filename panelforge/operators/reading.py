"""Reading list and theme drivers of the text tape: how interesting an article is, whether it has substance, how well it fits a theme."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.operators.tape import clean_conclusion
from panelforge.operators.text import MEDIA, WALL, behind, contains_any, found_words, has_found, has_words, lowered, top_per, trust_score, vocabulary

# fixed values: words that raise or lower the interest of an article, and sources whose notes count as analysis or as wire
ANGLE = "why it matters|bottom line|between the lines|zoom out|big picture|variant|contrarian|surprising|overlooked|underappreciated|second-order|structural|regime|cycle|risk map|trade[- ]off"
SUBJECT = "debt to gdp|k-shaped|productivity|supply chain|ai trade|tariff|tariffs|energy crisis|inflation expectations|credit|liquidity|consumer stress|capital spending|capex|hard assets|cultural headwaters|baby boomers|millennials|volatility strategies"
QUESTION = "how|why|could|might|isn't|is not|what to watch|read-through|implication"
HOUSES = r"Axios Macro|Axios Markets|Raymond James|Fidelity|Morgan Stanley|J\\.P\\. Morgan|Bank of America Institute|State Street|Merrill|Schwab"
ROUTINE = "daily open|stock market news|market update|top stories|earnings rss|before the bell|opening comment|live updates|stock futures|oil futures rise|asia-pacific markets fall"
WIRES = "CNBC Top News RSS|CNBC Markets|MarketWatch Top Stories RSS"
ANALYSIS = "why it matters|bottom line|between the lines|zoom out|big picture|what is|what isn't|how|why|k-shaped|debt to gdp|productivity|supply chain|ai trade|tariff|energy crisis|consumer stress|capital spending|capex|hard assets|cultural headwaters|volatility strategies|underappreciated|overlooked"
# fixed values: phrases of pages that say nothing of their own, at the start and anywhere
GENERIC_START = "read our latest market commentary|stock market news, commentary|bond market updates|learn about the bond market|public .* research|markets and economy|stock market news|bond market commentary"
GENERIC = [
    r"official energy statistics from the u\.?s\.? government|independent statistics and analysis|energy information administration",
    "short interest monitor|investing strategies for volatile markets|track stocks with elevated and rising short interest|midyear outlook for the economy and markets|today's options market update|looking to the futures",
    "where thought finds leadership",
    "uncovers powerful insights that move business and society forward",
]
# fixed values: words by which a driver fits a theme, the themes that take a driver in turn, and the fit asked for
FIT = {
    "Geopolitics and policy": "iran|israel|ukraine|russia|china|taiwan|war|conflict|hormuz|sanction|tariff|trade|ceasefire",
    "Rates and central banks": "yield|treasury|fed|fomc|rate|rates|powell|ecb|boe|boj|inflation|cpi|pce",
    "Commodities and energy": "oil|crude|brent|wti|hormuz|energy|natural gas|gold|silver|copper",
    "Macro and growth": "gdp|jobs|payroll|claims|unemployment|pmi|ism|growth|consumer|productivity",
    "Earnings": "earnings|results|revenue|guidance|eps|margin|beat|miss",
    "AI and semis": "ai|semiconductor|semis|chip|gpu|data center",
    "Credit and liquidity": "credit|spread|liquidity|funding|default|high yield",
}
TURNS = ["Geopolitics and policy", "Rates and central banks", "Commodities and energy", "Macro and growth", "AI and semis", "Credit and liquidity"]
LEAST_FIT = 45
RATES, POLICY, CHIPS = "Rates and central banks", "Geopolitics and policy", "AI and semis"
PRICES, HOTTER, AHEAD = "producer price|ppi|consumer price|cpi", "worse|hot|higher|rose|increased|accelerat(?:e|ed|ing)", "upcoming|ahead of|awaiting|due|forecast|expected"
RIVALS, BUILDERS = r"taiwan|u\.?s\.?[- ]china|china", "cisco|ai infrastructure|hyperscaler|data center|networking supercycle"
VERBS = "warns|says|signals|pushes|pressures|jumps|pops|rises|falls|higher|lower|cuts|raises|inflation|tariff|policy|earnings|guidance|orders|yields|oil"
RATE_WORDS = "yield|treasury|rate|inflation|ppi|cpi"


def _joined(*names: str) -> Column:
    return F.concat_ws(" ", *[F.coalesce(n, F.lit("")) for n in names])


def _points(when: Column, n: int) -> Column:
    return F.when(when, n).otherwise(0)


def is_generic(text: Column) -> Column:
    """Whether a text is a page's own description and no news."""
    t = F.trim(F.coalesce(text, F.lit("")))
    found = t.rlike(rf"(?i)^(?:{GENERIC_START})(?!\w)")
    for words in GENERIC:
        found = found | has_words(t, words)
    return found


def _plainly(names: tuple[str, ...], words: str) -> Column:
    """Whether one of the alternatives stands in the joined columns."""
    return has_words(_joined(*names), words)


def interest(seconds: Column, has=_plainly) -> Column:
    """Points of an article (title, summary, excerpt, source, trust) `seconds` old, to one decimal.

    Trust, an angle, a subject and a question in the title add; routine tape, wires and media about media take away; up to ten
    points for freshness fade over ten days. Sums are of whole tenths, halves rounded up, so they are the same everywhere.
    """
    text, source = ("title", "summary", "excerpt"), F.coalesce("source", F.lit(""))
    whole = (
        trust_score(F.col("trust")).cast("int") * 6 + _points(has(text, ANGLE), 18) + _points(has(text, SUBJECT), 18)
        + _points(has(("title",), QUESTION), 8) + _points(has_words(source, HOUSES), 14)
        - _points(has(("title", "source"), ROUTINE), 34) - _points(has_words(source, WIRES), 18)
        - _points(has(("source", "title", "summary", "excerpt"), MEDIA), 90)
    )
    fresh = F.greatest(F.lit(0), F.floor((2 * (864000 - seconds) + 8640) / 17280))
    return (whole * 10 + F.coalesce(fresh, F.lit(0))) / 10


def evidence() -> Column:
    """Summary and excerpt, cleaned, where they are unlike the title and 80 characters long."""
    title, source = F.lower(F.trim(F.coalesce("title", F.lit("")))), F.lower(F.trim(F.coalesce("source", F.lit(""))))
    clean = F.transform(F.array("summary", "excerpt"), lambda x: clean_conclusion(F.coalesce(x, F.lit("")), F.col("title")))
    unlike = lambda t: (F.length(t) >= 80) & (F.lower(t) != title) & (F.lower(t) != F.trim(F.concat_ws(" ", title, source)))
    return F.array_join(F.array_distinct(F.filter(clean, unlike)), " ")


def has_substance(found: Column | None = None) -> Column:
    """Whether the evidence comes to 180 characters and 30 words."""
    found = evidence() if found is None else found
    return (F.length(found) >= 180) & (F.regexp_count(found, F.lit("[A-Za-z][A-Za-z'-]*")) >= 30)


def is_analytical(has=_plainly) -> Column:
    """Whether an article explains: no media about media, no routine tape, and a house's note or words of analysis."""
    every = ("source", "title", "summary", "excerpt")
    known = has_words(F.coalesce("source", F.lit("")), HOUSES)
    return ~has(every, MEDIA) & ~has(every, ROUTINE) & (known | has(every, ANALYSIS))


#: The words of every list that the reading list looks for.
KNOWN_WORDS = vocabulary(ANGLE, SUBJECT, QUESTION, ROUTINE, ANALYSIS, MEDIA)


def reading_candidates(articles: DataFrame, cards: DataFrame, now: Column, most: int = 6, days: float = 7) -> DataFrame:
    """(source, url, quality, used): the most interesting article of each source, best first, `most` at most.

    Articles (url, source, trust, title, summary, excerpt, published) are dated, not older than `days`, not behind a wall, of
    substance and analytical. Sources and pages of the last `cards` (source, url) are left out where three others are there.
    Ties go by url. Only the few best of either kind meet in one row; everything before is by source.
    """
    df = articles.where("published is not null").withColumn("_age", F.unix_timestamp(now) - F.unix_timestamp("published")).where(F.col("_age") <= int(days * 86400))
    # texts are lowered, searched and cleaned once, each step behind a generator that later filters do not pass
    df = behind(df, _low=lowered(_joined("title", "summary", "excerpt")), _title=lowered(F.coalesce("title", F.lit(""))), _source=lowered(F.coalesce("source", F.lit(""))), _front=lowered(_joined("title", "summary")))
    df = behind(df.where(~contains_any(F.col("_front"), WALL)), _text_words=found_words(F.col("_low"), KNOWN_WORDS), _title_words=found_words(F.col("_title"), KNOWN_WORDS), _source_words=found_words(F.col("_source"), KNOWN_WORDS))
    read = {
        ("title", "summary", "excerpt"): (F.col("_text_words"), F.col("_low")), ("title",): (F.col("_title_words"), F.col("_title")),
        ("title", "source"): (F.array_union("_title_words", "_source_words"), F.concat_ws(" ", "_title", "_source")),
        ("source", "title", "summary", "excerpt"): (F.array_union("_source_words", "_text_words"), F.concat_ws(" ", "_source", "_low")),
    }
    has = lambda names, words: has_found(*read[names], words)
    df = behind(df.where(is_analytical(has)), _evidence=evidence()).where(has_substance(F.col("_evidence")))
    one = top_per(df.select("source", "url", interest(F.col("_age"), has).alias("quality")), "source", 1, F.desc("quality"), "url")
    sources = cards.select("source", F.lit(True).alias("_source")).distinct()
    one = one.join(sources, "source", "left").join(cards.select("url", F.lit(True).alias("_url")).distinct(), "url", "left")
    one = one.select("source", "url", "quality", F.coalesce("_source", "_url", F.lit(False)).alias("used"))
    few = top_per(one, "used", max(most, 3), F.desc("quality"), "url")
    row = F.struct((-F.col("quality")).alias("minus"), "url", "source", "used")
    lists = few.agg(F.array_sort(F.collect_list(row)).alias("every"), F.array_sort(F.collect_list(F.when(~F.col("used"), row))).alias("new"))
    pool = F.when(F.size("new") >= 3, F.col("new")).otherwise(F.col("every"))
    return lists.select(F.inline(F.slice(pool, 1, most))).select("source", "url", (-F.col("minus")).alias("quality"), "used")


def is_stated(theme: Column) -> Column:
    """Whether something can be said of a driver under a theme: a known reading, a summary of its own, or a title that tells."""
    head, whole = _joined("title", "summary"), _joined("title", "summary", "excerpt")
    clean, title = clean_conclusion(F.col("summary"), F.col("title")), F.trim(F.coalesce("title", F.lit("")))
    rates = (theme == RATES) & (has_words(whole, "inflation problem is getting worse") | has_words(head, RATE_WORDS) | (has_words(head, PRICES) & has_words(head, HOTTER) & ~has_words(head, AHEAD)))
    known = rates | ((theme == POLICY) & has_words(head, RIVALS)) | ((theme == CHIPS) & has_words(whole, BUILDERS))
    return known | ((F.length(clean) >= 45) & ~is_generic(clean)) | ((F.length(title) >= 50) & ~is_generic(title) & has_words(title, VERBS))


def theme_fit(theme: Column) -> Column:
    """How well a driver (title, summary, excerpt, importance, since_previous) fits a theme."""
    title, summary = F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit(""))
    hit = lambda text: F.coalesce(*[F.when(theme == name, has_words(text, words)) for name, words in FIT.items()], F.lit(False))
    what_if = summary.rlike(r"(?i)^what if(?!\w)") | title.rlike(r"(?i)^what if(?!\w)")
    return (
        F.coalesce("importance", F.lit(0)) + _points(hit(_joined("title", "summary", "excerpt")), 20) + _points(hit(_joined("title", "summary")), 35)
        + F.when(is_generic(summary), -12).otherwise(8) - _points(is_generic(title), 10) - _points(~is_stated(theme), 45) - _points(what_if, 35)
        - _points((theme == RATES) & F.lower(title).contains("looking to the futures"), 55) + _points(F.coalesce("since_previous", F.lit(False)), 6)
    )


def fitted_drivers(drivers: DataFrame, turns: list[str] = TURNS, least: int = LEAST_FIT) -> DataFrame:
    """(theme, doc_id, fit): for each theme in turn the best fitting driver that no earlier theme took; ties by doc_id.

    A theme stays empty where its best driver fits by less than `least` or has nothing to be said of it; that driver stays free
    for later themes. A theme loses a driver at most to each theme before it, so its best len(turns) hold its pick.
    """
    df = drivers.select("*", F.explode("themes").alias("theme")).where(F.col("theme").isin(turns))
    df = df.select("theme", "doc_id", theme_fit(F.col("theme")).alias("fit"), is_stated(F.col("theme")).alias("stated"))
    few = top_per(df, "theme", len(turns), F.desc("fit"), "doc_id")
    row = F.struct((-F.col("fit")).alias("minus"), "doc_id", ((F.col("fit") >= least) & F.col("stated")).alias("takes"))
    lists = few.agg(*[F.array_sort(F.collect_list(F.when(F.col("theme") == t, row))).alias(f"t{n}") for n, t in enumerate(turns)])
    lists = lists.withColumn("used", F.array().cast("array<bigint>"))
    for n in range(len(turns)):
        best = F.get(F.filter(F.col(f"t{n}"), lambda x: ~F.array_contains("used", x["doc_id"])), F.lit(0))
        lists = lists.withColumn(f"t{n}", F.when(best["takes"], best)).withColumn("used", F.array_compact(F.array_append("used", F.col(f"t{n}.doc_id"))))
    picks = F.array(*[F.struct(F.lit(t).alias("theme"), F.col(f"t{n}.doc_id").alias("doc_id"), (-F.col(f"t{n}.minus")).alias("fit")) for n, t in enumerate(turns)])
    return lists.select(F.inline(picks)).where("doc_id is not null")
