"""Queries of scalars and the text tape (P, T) over pages, documents, conversations and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions import scalars as x
from panelforge.functions.semantics import rounded
from panelforge.operators import text as tx
from panelforge.sources.tables import table

QUERIES, SQL = {}, {}


def add(name, run, sql=None):
    QUERIES[name] = lambda s, d: rounded(run(s, d))
    if sql:
        SQL[name] = sql


def pages(s, d):
    return table(s, d, "pages")


STRIP = "trim(regexp_replace(" + "replace(" * 9 + r"""regexp_replace({}, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'), '\s+', ' ', 'g'))"""
add("p1_symbols", lambda s, d: table(s, d, "nation").select("n_nationkey", x.normal_symbol(F.concat(F.lit(" "), F.lower("n_name"), F.lit(".b* "))).alias("symbol")), "SELECT n_nationkey, upper(n_name) || '-B' AS symbol FROM nation")
add("p2_strip_html", lambda s, d: pages(s, d).select("page_id", F.md5(x.strip_html(F.col("html"))).alias("text_md5")), f"SELECT page_id, md5({STRIP.format('html')}) AS text_md5 FROM pages")
add("p3_finite", lambda s, d: table(s, d, "part").select("p_partkey", F.round(F.when(F.col("p_size") % 7 != 0, F.col("p_retailprice") / (F.col("p_size") % 7)), 2).alias("x")), "SELECT p_partkey, round(CASE WHEN p_size % 7 <> 0 THEN p_retailprice / (p_size % 7) END, 2) AS x FROM part")
add("p4_sizes", lambda s, d: table(s, d, "supplier").select("s_suppkey", x.parse_size(F.concat(F.lit("$"), F.col("s_suppkey").cast("string"), F.element_at(F.array(F.lit("T"), F.lit("B"), F.lit("M"), F.lit("x")), (F.col("s_suppkey") % 4 + 1).cast("int")))).alias("size")),
    "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN s_suppkey * 1e12 WHEN 1 THEN s_suppkey * 1e9 WHEN 2 THEN s_suppkey * 1e6 END::DOUBLE AS size FROM supplier")
add("p5_cap_bucket", lambda s, d: table(s, d, "customer").select("c_custkey", x.cap_bucket(F.col("c_acctbal"), (8000, 4000, 1000)).alias("bucket")), "SELECT c_custkey, CASE WHEN c_acctbal IS NULL THEN 'Unknown' WHEN c_acctbal >= 8000 THEN 'Mega' WHEN c_acctbal >= 4000 THEN 'Large' WHEN c_acctbal >= 1000 THEN 'Mid' ELSE 'Small' END AS bucket FROM customer")
add("p6_series_delta", lambda s, d: table(s, d, "part").select("p_partkey", x.series_delta(F.col("p_retailprice"), F.col("p_size").cast("double"), F.when(F.col("p_partkey") % 3 == 0, "bps").when(F.col("p_partkey") % 3 == 1, "pct").otherwise("pp")).alias("delta")),
    "SELECT p_partkey, round(CASE p_partkey % 3 WHEN 0 THEN (p_retailprice - p_size) * 100 WHEN 1 THEN CASE WHEN p_size <> 0 THEN (p_retailprice / p_size - 1) * 100 ELSE p_retailprice - p_size END ELSE p_retailprice - p_size END, 6) + 0.0 AS delta FROM part")
add("p9_age_hours", lambda s, d: table(s, d, "events").select("event_id", x.age_hours(F.col("ts"), F.lit("2024-03-01").cast("timestamp")).alias("age")), "SELECT event_id, round((epoch_us(TIMESTAMP '2024-03-01') - epoch_us(ts)) / 3.6e9, 6) + 0.0 AS age FROM events")
add("p13_ticker_list", lambda s, d: table(s, d, "orders").groupBy((F.col("o_custkey") % 40).alias("k")).agg(F.min("o_orderstatus").alias("a"), F.min("o_orderpriority").alias("b")).select("k", F.array_join(x.ticker_list(F.concat_ws(", ", "a", F.lit("$abc"), "a", F.lit("9x"))), ",").alias("tickers")),
    "SELECT o_custkey % 40 AS k, min(o_orderstatus) || ',ABC' AS tickers FROM orders GROUP BY 1")
add("p14_sentences", lambda s, d: table(s, d, "documents").select("doc_id", F.md5(x.first_sentences(F.regexp_replace("text", "[^A-Za-z.! ]", ""), 2)).alias("md5")), r"SELECT doc_id, md5(trim(array_to_string(list_slice(regexp_extract_all(regexp_replace(text, '[^A-Za-z.! ]', '', 'g'), '[^.!?]+[.!?]+'), 1, 2), ''))) AS md5 FROM documents")
add("t1_titles", lambda s, d: pages(s, d).select("page_id", tx.page_title(F.col("html")).alias("title"), F.md5(F.coalesce(tx.page_summary(F.col("html")), F.lit(""))).alias("summary_md5")),
    "SELECT page_id, left(" + STRIP.format(r"coalesce(nullif(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), ''), nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), ''))") + ", 160) AS title, md5(coalesce(left(" + STRIP.format(r"nullif(regexp_extract(html, '(?is)<p[^>]*>(.*?)</p>', 1), '')") + ", 320), '')) AS summary_md5 FROM pages")
_VIS = "html"
for _t in ("script", "style", "nav", "footer", "header"):
    _VIS = rf"regexp_replace({_VIS}, '(?is)<{_t}\b.*?</{_t}>', ' ', 'g')"
add("t3_visible_text", lambda s, d: pages(s, d).select("page_id", F.md5(tx.visible_text(F.col("html"))).alias("text_md5")), f"SELECT page_id, md5({STRIP.format(_VIS)}) AS text_md5 FROM pages")
add("t2_published", lambda s, d: pages(s, d).select("page_id", F.coalesce(tx.published(F.col("html")), F.lit("")).alias("published")), r"""SELECT page_id, coalesce(nullif(regexp_extract(html, '(?i)<meta\b[^>]*(?:property|name|itemprop)="article:published_time"[^>]*content="([^"]*)"', 1), ''), nullif(regexp_extract(html, '(?i)<time[^>]*datetime="([^"]+)"', 1), ''), nullif(regexp_extract(html, '"datePublished"\s*:\s*"([^"]+)"', 1), ''), regexp_extract(html, '(20\d\d-\d\d-\d\d)', 1)) AS published FROM pages""")
def _linked(s, d):
    """Pages with two more links that carry words of the rules."""
    n = F.col("page_id").cast("string")
    dated = F.concat(F.lit('<a href="/markets/2024/01/'), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0"), F.lit("/n"), n, F.lit('#top">Weekly outlook '), n, F.lit("</a>"))
    bad = F.concat(F.lit('<a href="https://www.elsewhere.example/research/'), n, F.lit('">Research elsewhere</a><a class="x" href="/about/insight-'), n, F.lit('?a=1">About our <b>insight</b></a>'))
    return pages(s, d).select("page_id", "url", F.concat("html", dated, F.when(F.col("page_id") % 2 == 0, bad).otherwise("")).alias("html"), F.when(F.col("page_id") % 3 == 0, "Weekly Desk").otherwise("Other").alias("source"))


add("t4_links", lambda s, d: tx.links(_linked(s, d)).select("page_id", "target", "label", "score", "place"), rf"""WITH l AS (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN 'weekly' ELSE 'other' END AS word, html || '<a href="/markets/2024/01/' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') || '/n' || page_id || '#top">Weekly outlook ' || page_id || '</a>'
 || CASE WHEN page_id % 2 = 0 THEN '<a href="https://www.elsewhere.example/research/' || page_id || '">Research elsewhere</a><a class="x" href="/about/insight-' || page_id || '?a=1">About our <b>insight</b></a>' ELSE '' END AS html FROM pages),
a AS (SELECT page_id, url, word, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*href="[^"]*"[^>]*>.*?</a>')) AS tag FROM l),
b AS (SELECT page_id, url, word, regexp_extract(tag, '(?i)href="([^"]*)"', 1) AS href, {STRIP.format('tag')} AS label FROM a),
c AS (SELECT *, CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN starts_with(href, '/') THEN regexp_extract(url, '^(https?://[^/]+)', 1) || href END AS t FROM b WHERE length(label) >= 8),
e AS (SELECT *, regexp_replace(t, '#.*$', '') AS target, regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^www\.', '') AS here, regexp_replace(regexp_extract(t, '^https?://([^/?#]+)', 1), '^www\.', '') AS there FROM c),
f AS (SELECT *, regexp_replace(target, '^https?://[^/?]+', '') AS rest FROM e WHERE here = there OR suffix(there, '.' || here) OR suffix(here, '.' || there)),
g AS (SELECT *, regexp_replace(rest, '\?.*$', '') AS path, lower(regexp_replace(rest, '\?.*$', '') || ' ' || regexp_extract(rest, '(\?.*)$', 1) || ' ' || label) AS hay FROM f),
h AS (SELECT *, CASE WHEN regexp_matches(hay, '{tx.LINK_GOOD}') THEN 8 ELSE 0 END - CASE WHEN regexp_matches(hay, '{tx.LINK_BAD}') THEN 10 ELSE 0 END + CASE WHEN regexp_matches(hay, '{tx.LINK_DATE}') THEN 5 ELSE 0 END + CASE WHEN contains(hay, word) THEN 1 ELSE 0 END
 + CASE WHEN len(list_filter(string_split(path, '/'), lambda x: x <> '')) >= 2 THEN 2 ELSE 0 END - CASE WHEN path IN ('', '/') THEN 3 ELSE 0 END AS score FROM g),
i AS (SELECT page_id, target, max(score) AS score, arg_max(label, (score, label)) AS label FROM h WHERE score >= 4 GROUP BY ALL)
SELECT page_id, target, label, CAST(score AS INTEGER) AS score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, target) AS place FROM i) WHERE place <= 5""")


def _has(text, words):
    quoted = words.replace("'", "''")
    return f"regexp_matches({text}, '(?i)\\b(?:{quoted})\\b')"


_TH = ", ".join(f"CASE WHEN {_has('text', w)} THEN '{n}' END" for n, w in tx.THEMES.items())
_FOUND = f"list_filter([{_TH}], lambda x: x IS NOT NULL)"
_PRIM = " ".join(f"WHEN list_contains(f, '{p}') THEN '{p}'" for p in tx.PRIORITY[:-1])
add("t6_themes", lambda s, d: table(s, d, "documents").select("doc_id", tx.themes(F.col("text")).alias("f")).select("doc_id", F.array_join("f", "|").alias("themes"), tx.primary_theme(F.col("f")).alias("theme")),
    f"SELECT doc_id, CASE WHEN len(f) > 0 THEN array_to_string(f, '|') ELSE 'Market color' END AS themes, CASE {_PRIM} ELSE 'Market color' END AS theme FROM (SELECT doc_id, {_FOUND} AS f FROM documents)")


def _plain_articles(s, d, docs=None):
    """Documents as articles: the first line is the title, the whole text the summary."""
    of = F.col("doc_id")
    return (table(s, d, "documents") if docs is None else docs).select(
        "doc_id", F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("summary"), F.lit("").alias("excerpt"), "source",
        F.element_at(F.array(F.lit("very high"), F.lit("High"), F.lit("medium"), F.lit(None).cast("string")), (of % 4 + 1).cast("int")).alias("trust"),
        F.when(of % 13 != 0, (of % 150).cast("double")).alias("age"), (of % 10 == 0).alias("since_previous"), F.concat(F.lit("u"), (of % 700).cast("string")).alias("url"),
    )


def _articles(s, d, docs=None):
    return tx.scored_articles(_plain_articles(s, d, docs))


_BROAD, _SINGLE = _has("t", tx.BROAD), "(" + " OR ".join(_has("ts", w) for w in tx.SINGLE_NAME) + ")"
_MEDIA = _has("coalesce(source, '') || ' ' || t", tx.MEDIA)
_LOW = f"({_MEDIA} OR {_has('t', tx.PERSONAL)} OR regexp_matches(t, '(?i)\\b401\\(k\\)\\b') OR {_has('t', tx.ONE_DEAL)} OR ({_SINGLE} AND NOT {_BROAD}) OR ({_has('title', tx.ROUNDUP)} AND NOT {_has('t', tx.ROUNDUP_TOPIC)}))"
_ART = f"""d AS (SELECT doc_id, source, coalesce(split_part(text, chr(10), 1), '') AS title, coalesce(split_part(text, chr(10), 1), '') || ' ' || coalesce(text, '') AS ts, coalesce(split_part(text, chr(10), 1), '') || ' ' || coalesce(text, '') || ' ' AS t,
  CASE WHEN doc_id % 13 <> 0 THEN doc_id % 150 END AS age, doc_id % 10 = 0 AS since, 'u' || (doc_id % 700) AS url FROM documents),
f AS (SELECT *, {_FOUND.replace('text,', 't,')} AS found, {_BROAD} AS broad, {_SINGLE} AS single, {_MEDIA} AS media, {_LOW} AS low FROM d),
art AS (SELECT doc_id, source, url, title, age, since, broad, media, low, CASE WHEN len(found) > 0 THEN found ELSE ['Market color'] END AS f,
  (CASE doc_id % 4 WHEN 0 THEN 5.0 WHEN 1 THEN 4.0 WHEN 2 THEN 3.0 ELSE 2.0 END) * 8 + CASE WHEN since THEN 30 ELSE 0 END + CASE WHEN age <= 24 THEN 24 WHEN age <= 96 THEN 8 ELSE 0 END
  + CASE WHEN list_has_any(found, ['Earnings', 'Rates and central banks', 'Geopolitics and policy', 'Commodities and energy']) THEN 14 ELSE 0 END
  + CASE WHEN regexp_matches(t, '(?i)(?:{tx.HEADLINE})') THEN 8 ELSE 0 END - CASE WHEN list_contains(found, 'Earnings') AND NOT broad THEN 26 ELSE 0 END
  - CASE WHEN single AND NOT broad THEN 35 ELSE 0 END - CASE WHEN age IS NULL THEN 12 ELSE 0 END - CASE WHEN media THEN 80 ELSE 0 END
  - CASE WHEN low THEN 45 ELSE 0 END - CASE WHEN regexp_matches(t, '(?i)(?:{tx.WALL})') THEN 40 ELSE 0 END AS importance FROM f)"""
add("t7_low_signal", lambda s, d: _articles(s, d).select("doc_id", "media", "broad", "low"), f"WITH {_ART} SELECT doc_id, media, broad, low FROM art")
add("t8_importance", lambda s, d: _articles(s, d).select("doc_id", "importance"), f"WITH {_ART} SELECT doc_id, importance::DOUBLE AS importance FROM art")
add("t5_top_per_source", lambda s, d: tx.top_per(_articles(s, d), "source", 3, F.desc("importance"), "doc_id").select("source", "doc_id", "place"), f"WITH {_ART} SELECT source, doc_id, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY importance DESC, doc_id) AS place FROM art) WHERE place <= 3")
add("t9_drivers", lambda s, d: tx.market_drivers(_articles(s, d)).select("url", "doc_id", "importance"),
    f"""WITH {_ART} SELECT url, doc_id, importance::DOUBLE AS importance FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY importance DESC, doc_id) AS n FROM art WHERE NOT media AND NOT low AND title <> ''
 AND NOT (len(f) = 1 AND f[1] = 'Earnings' AND NOT broad) AND (since OR coalesce(age <= 24, false) OR coalesce(age <= 96 AND importance >= 44, false))) WHERE n = 1 ORDER BY importance DESC, doc_id LIMIT 48""")
add("t10_theme_counts", lambda s, d: _articles(s, d).select(F.explode("themes").alias("theme")).groupBy("theme").agg(F.count(F.lit(1)).alias("n")), f"WITH {_ART} SELECT theme, count(*) AS n FROM (SELECT unnest(f) AS theme FROM art) GROUP BY theme")
_TURNS = tx.PRIORITY
_DRV = f"""WITH {_ART}, dv AS (SELECT doc_id, importance, f FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY importance DESC, doc_id) AS n FROM art WHERE NOT media AND NOT low AND title <> ''
 AND NOT (len(f) = 1 AND f[1] = 'Earnings' AND NOT broad) AND (since OR coalesce(age <= 24, false) OR coalesce(age <= 96 AND importance >= 44, false))) WHERE n = 1 ORDER BY importance DESC, doc_id LIMIT 48)"""
_PICKS = ", ".join(f"q{n} AS (SELECT '{t}' AS theme, doc_id, importance FROM dv WHERE list_contains(f, '{t}')" + "".join(f" AND doc_id NOT IN (SELECT doc_id FROM q{m})" for m in range(n)) + " ORDER BY importance DESC, doc_id LIMIT 1)" for n, t in enumerate(_TURNS))
add("t10_theme_drivers", lambda s, d: tx.theme_drivers(tx.market_drivers(_articles(s, d)), _TURNS), f"{_DRV}, {_PICKS} " + " UNION ALL ".join(f"SELECT theme, doc_id, importance::DOUBLE AS importance FROM q{n}" for n in range(len(_TURNS))))
add("t20_source_health", lambda s, d: table(s, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.length("text") >= 200).alias("usable"), F.max("doc_id").alias("newest")), "SELECT source, count(*) AS items, count(*) FILTER (length(text) >= 200) AS usable, max(doc_id) AS newest FROM documents GROUP BY source")
KNOWN = ["THE", "AND", "LES", "QUE", "DER", "UND", "EST"]


_SMALL, _CAPITAL = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _posts(s, d):
    """Conversations as posts: the first turn is the title, the others the body."""
    c = table(s, d, "conversations").withColumn("said", F.translate(F.coalesce("text", F.lit("")), _SMALL, _CAPITAL))
    turns = F.array_sort(F.collect_list(F.struct("turn", "said")))
    posts = c.groupBy(F.col("conv_id").alias("post_id")).agg(turns.alias("turns"), (F.count(F.lit(1)) * 100).alias("score"), F.sum(F.length("text") % 37).alias("comments"))
    return posts.select("post_id", F.col("turns")[0]["said"].alias("title"), F.array_join(F.transform(F.slice("turns", 2, 100000), lambda x: x["said"]), " ").alias("body"), "score", "comments")


_STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
add("t13_tickers", lambda s, d: table(s, d, "conversations").select("conv_id", "turn", F.array_join(F.sort_array(tx.tickers(F.translate("text", _SMALL, _CAPITAL), KNOWN)), ",").alias("tickers")),
    rf"""WITH p AS (SELECT conv_id, turn, translate(text, '{_SMALL}', '{_CAPITAL}') AS t FROM conversations),
c AS (SELECT conv_id, turn, list_filter(list_transform(regexp_extract_all(t, '\$([A-Z][A-Z0-9.-]{{0,7}})\b', 1), lambda x: regexp_replace(replace(x, '-', '.'), '[^A-Z0-9.]', '', 'g')), lambda x: len(x) BETWEEN 1 AND 6) AS cash,
 list_intersect(regexp_extract_all(t, '\b([A-Z]{{2,5}}(?:\.[A-Z])?)\b', 1), ['THE', 'AND', 'LES', 'QUE', 'DER', 'UND', 'EST']) AS plain FROM p)
SELECT conv_id, turn, array_to_string(list_sort(list_filter(list_distinct(list_concat(cash, plain)), lambda x: NOT list_contains([{_STOP}], x))), ',') AS tickers FROM c""")
_GENERIC = _has("title", tx.GENERIC_THREAD)


def _tick(x):
    """SQL lists of the cashtags and known symbols of a text."""
    cash = rf"list_filter(list_transform(regexp_extract_all({x}, '\$([A-Z][A-Z0-9.-]{{0,7}})\b', 1), lambda x: regexp_replace(replace(x, '-', '.'), '[^A-Z0-9.]', '', 'g')), lambda x: len(x) BETWEEN 1 AND 6)"
    plain = rf"list_intersect(list_transform(regexp_extract_all({x}, '\b([A-Z]{{2,5}}(?:\.[A-Z])?)\b', 1), lambda x: regexp_replace(replace(x, '-', '.'), '[^A-Z0-9.]', '', 'g')), {KNOWN})"
    return cash, f"list_filter(list_distinct(list_concat({cash}, {plain})), lambda x: NOT list_contains([{_STOP}], x))"


_TITLE, _BODY, _BOTH = _tick("title"), _tick("body"), _tick("title || ' ' || body")
_SIGNALS = f"""tu AS (SELECT *, translate(coalesce(text, ''), '{_SMALL}', '{_CAPITAL}') AS said FROM conversations),
po AS (SELECT conv_id AS post_id, arg_min(said, turn) AS title, left(array_to_string(list(said ORDER BY turn)[2:], ' '), 1200) AS body, count(*) * 100 AS score, CAST(sum(length(text) % 37) AS BIGINT) AS comments FROM tu GROUP BY conv_id),
tk AS (SELECT *, {_TITLE[1]} AS t, {_BODY[1]} AS b, list_distinct(list_filter({_BOTH[0]}, lambda x: list_contains({KNOWN}, x) OR NOT list_contains([{_STOP}], x))) AS k, {_GENERIC} AS generic FROM po),
ta AS (SELECT *, list_distinct(list_concat(t, b, k)) AS al FROM tk), te AS (SELECT *, generic OR (len(al) >= 8 AND len(t) = 0 AND len(k) = 0) AS strict, unnest(al) AS symbol FROM ta),
tc AS (SELECT *, list_contains(t, symbol) AS it, list_contains(k, symbol) AS ik, len(regexp_extract_all(body, '(?i)(?:\\$|\\b)' || replace(symbol, '.', '[.-]') || '\\b')) AS times FROM te),
tw AS (SELECT *, round(CASE WHEN it THEN 2.5 ELSE 0.0 END + CASE WHEN ik THEN 2.0 ELSE 0.0 END + CAST(0.4 AS DOUBLE) * least(times, 4), 2) AS weight FROM tc),
sg AS (SELECT post_id, symbol, score, comments, CAST(count(*) OVER (PARTITION BY post_id) AS INTEGER) AS n, weight, it OR ik AS direct FROM tw WHERE ((it OR ik) OR (NOT strict AND times >= 2)) AND weight >= 1)"""
add("t14_ticker_signals", lambda s, d: tx.ticker_signals(_posts(s, d), KNOWN), f"WITH {_SIGNALS} SELECT post_id, symbol, score, comments, n, weight, direct FROM sg")
add("t15_attention", lambda s, d: tx.attention(tx.ticker_signals(_posts(s, d), KNOWN)).select("symbol", "mentions", "direct", "signal", "attention"),
    f"""WITH {_SIGNALS}, g AS (SELECT symbol, count(*) AS mentions, CAST(sum(CAST(direct AS INTEGER)) AS BIGINT) AS direct, sum(weight) AS signal, round(sum(least(score, 1200) / sqrt(greatest(n, 1)))) AS sc, round(sum(least(comments, 500) / sqrt(greatest(n, 1)))) AS co FROM sg GROUP BY symbol)
 SELECT symbol, mentions, direct, round(signal, 1) + 0.0 AS signal, CAST(round(CAST(mentions * 8 + direct * 16 + signal * 10 + sc * 0.015 + co * 0.04 AS DECIMAL(30, 6)), 2) AS DOUBLE) AS attention FROM g WHERE direct > 0 OR mentions >= 2 ORDER BY attention DESC, symbol LIMIT 15""")
add("t22_repeated_lists", lambda s, d: table(s, d, "documents").select("doc_id", tx.repeated_list(F.col("text")).alias("repeats")), r"SELECT doc_id, len(p) <> len(list_distinct(p)) AS repeats FROM (SELECT doc_id, list_transform(string_split(text, ','), lambda x: trim(x)) AS p FROM documents)")
add("t23_source_refs", lambda s, d: tx.source_refs(pages(s, d).select("url", F.col("page_id").alias("published"))).select("url", "ref"), "SELECT url, 'S' || row_number() OVER (ORDER BY page_id DESC, url) AS ref FROM pages ORDER BY page_id DESC, url LIMIT 36")
