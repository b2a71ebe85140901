"""Queries of the reading list and of theme drivers by fit (T10, T11) and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.operators import reading as rd
from panelforge.operators import text as tx
from panelforge.plans.tape_queries import _MENU
from panelforge.plans.text_queries import _ART, _articles, _has, _plain_articles
from panelforge.sources.tables import table

QUERIES, SQL = {}, {}
NOW = "2024-01-10 12:00:00"
#: What is added to titles and texts by doc_id, so that each rule has articles it takes and articles it leaves.
TITLES = ["", " and why it holds", ": stock futures", ": editor joins", ": what to watch", " sign in", ""]
ENDS = ["", " The bottom line is in the big picture.", " Capital spending and credit.", "", " Debt to GDP, tariffs.", "", " How it ends.", "", "", " Structural.", ""]
#: What texts start with, by doc_id, so that every theme has drivers.
HEADS = [
    "", "Oil and crude jump as Hormuz traffic slows: ", "Treasury yields climb after auction: ", "Why the inflation problem is getting worse: ", "China tariff talks: ", "Payroll growth and jobless claims: ",
    "AI data center orders: ", "High yield credit spreads: ", "Looking to the futures and rates: ", "", "What if energy and oil fall: ", "Productivity and GDP: ", "",
]
TRUST = ["Very high", "High", "Medium high", "Medium", None]


def add(name, run, sql):
    QUERIES[name] = run
    SQL[name] = sql


def _choice(of, values):
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (of % len(values) + 1).cast("int"))


def _pages(s, d):
    """Documents as pages: the first line and an ending are the title, the second line the summary, the text the excerpt."""
    of = F.col("doc_id")
    text = F.coalesce("text", F.lit(""))
    names = F.when(of % 17 == 3, F.concat(F.lit("Fidelity "), "source")).when(of % 17 == 4, F.lit("CNBC Markets")).otherwise(F.col("source"))
    return table(s, d, "documents").select(
        F.format_string("u%08d", of).alias("url"), names.alias("source"), _choice(of, TRUST).alias("trust"),
        F.concat(F.substring_index(text, "\n", 1), _choice(of, TITLES)).alias("title"), F.coalesce(F.get(F.split(text, "\n"), F.lit(1)), F.lit("")).alias("summary"),
        F.concat(text, _choice(of, ENDS)).alias("excerpt"), F.when(of % 23 != 0, F.timestamp_seconds(F.unix_timestamp(F.lit(NOW).cast("timestamp")) - of * 977 % 864000)).alias("published"),
    )


def _list(values):
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


def _clean(text, title):
    """SQL of a cleaned conclusion."""
    t = text
    for pattern, to, how in (
        (r"(?is)\bSkip Navigation\b.*$", " ", ""), (rf"(?i)\b{_MENU}\s+{_MENU}(?:\s+{_MENU})+", " ", ", 'g'"), ("(?i)Yes A checkmark with a circle around it close", " ", ", 'g'"),
        (r"\bclose\s+([A-Z])", r"\1", ", 'g'"), (r"\b(data|war|rally|update)\s+(Over in|Stock futures|Earnings season|Investors|The oil)\b", r"\1. \2", ", 'g'"), (r"\s+", " ", ", 'g'"),
    ):
        t = f"regexp_replace({t}, '{pattern}', '{to}'{how})"
    head = rf"trim(regexp_replace({title}, '\s+', ' ', 'g'))"
    return f"(SELECT CASE WHEN starts_with(lower(t_), lower(h_)) THEN trim(substring(t_, length(h_) + 1)) ELSE t_ END FROM (SELECT trim({t}) AS t_, {head} AS h_))"


def _points(when, n):
    return f"CASE WHEN {when} THEN {n} ELSE 0 END"


_PARTS = " UNION ALL ".join(f"SELECT url, {n} AS n, {_clean(c, 'title')} AS t, title, source FROM a" for n, c in enumerate(("summary", "excerpt")))
_ALL = "source || ' ' || title || ' ' || summary || ' ' || excerpt"
_TEXT = "title || ' ' || summary || ' ' || excerpt"
add("t11_reading_list", lambda s, d: rd.reading_candidates(_pages(s, d), _pages(s, d).where("cast(substring(url, 2) as int) % 5 = 1 and source like 'src1%'").select("source", "url"), F.lit(NOW).cast("timestamp")),
    f"""WITH a AS (SELECT format('u{{:08d}}', doc_id) AS url, coalesce(CASE WHEN doc_id % 17 = 3 THEN 'Fidelity ' || source WHEN doc_id % 17 = 4 THEN 'CNBC Markets' ELSE source END, '') AS source, ({_list(TRUST)})[doc_id % 5 + 1] AS trust, doc_id,
 split_part(coalesce(text, ''), chr(10), 1) || ({_list(TITLES)})[doc_id % {len(TITLES)} + 1] AS title, split_part(coalesce(text, ''), chr(10), 2) AS summary, coalesce(text, '') || ({_list(ENDS)})[doc_id % {len(ENDS)} + 1] AS excerpt,
 CASE WHEN doc_id % 23 <> 0 THEN doc_id * 977 % 864000 END AS age FROM documents),
p AS (SELECT url, n, t FROM ({_PARTS}) WHERE length(t) >= 80 AND lower(t) <> lower(trim(title)) AND lower(t) <> trim(lower(trim(title)) || ' ' || lower(trim(source)))),
e AS (SELECT url, CASE WHEN count(*) = 2 AND min(t) = max(t) THEN min(t) ELSE string_agg(t, ' ' ORDER BY n) END AS evidence FROM p GROUP BY url),
k AS (SELECT *, (10 * (CASE WHEN contains(lower(coalesce(trust, '')), 'very high') THEN 5 WHEN contains(lower(coalesce(trust, '')), 'high') THEN 4 WHEN contains(lower(coalesce(trust, '')), 'medium') THEN 3 ELSE 2 END * 6
 + {_points(_has(_TEXT, rd.ANGLE), 18)} + {_points(_has(_TEXT, rd.SUBJECT), 18)} + {_points(_has('title', rd.QUESTION), 8)} + {_points(_has('source', rd.HOUSES), 14)}
 - {_points(_has("title || ' ' || source", rd.ROUTINE), 34)} - {_points(_has('source', rd.WIRES), 18)} - {_points(_has(_ALL, tx.MEDIA), 90)}) + greatest(0, (2 * (864000 - age) + 8640) // 17280)) / 10 AS quality
 FROM a JOIN e USING (url) WHERE age <= 7 * 86400 AND NOT regexp_matches(title || ' ' || summary, '(?i)(?:{tx.WALL})') AND length(evidence) >= 180 AND len(regexp_extract_all(evidence, '[A-Za-z][A-Za-z''-]*')) >= 30
 AND NOT {_has(_ALL, tx.MEDIA)} AND NOT {_has(_ALL, rd.ROUTINE)} AND ({_has('source', rd.HOUSES)} OR {_has(_ALL, rd.ANALYSIS)})),
c AS (SELECT source, url FROM a WHERE doc_id % 5 = 1 AND source LIKE 'src1%'),
o AS (SELECT source, url, quality, source IN (SELECT source FROM c) OR url IN (SELECT url FROM c) AS used FROM k QUALIFY row_number() OVER (PARTITION BY source ORDER BY quality DESC, url) = 1),
w AS (SELECT *, count(*) FILTER (NOT used) OVER () AS fresh FROM o)
SELECT source, url, quality::DOUBLE AS quality, used FROM w WHERE NOT used OR fresh < 3 ORDER BY quality DESC, url LIMIT 6""")


def _generic(text):
    found = [rf"regexp_matches(trim({text}), '(?i)^(?:{rd.GENERIC_START})\b')"] + [_has(f"trim({text})", w) for w in rd.GENERIC]
    return "(" + " OR ".join(found) + ")"


def _fit(s, d):
    """Drivers with their texts; every ninth starts with a question, every seventh with a page's own description."""
    docs = table(s, d, "documents")
    docs = docs.withColumn("text", F.concat(_choice(F.col("doc_id"), HEADS), F.coalesce("text", F.lit(""))))
    a, plain = _articles(s, d, docs), _plain_articles(s, d, docs)
    texts = plain.select("doc_id", "title", "since_previous", F.lit("").alias("excerpt"), F.concat(F.when(F.col("doc_id") % 9 == 0, "What if ").when(F.col("doc_id") % 7 == 0, "Markets and economy ").otherwise(""), "summary").alias("summary"))
    return rd.fitted_drivers(tx.market_drivers(a).join(texts, "doc_id"))


_HEAD = "title || ' ' || summary"
_WORDS = " ".join(f"WHEN '{n}' THEN {_has('x', w)}" for n, w in rd.FIT.items())
_PICKS = ", ".join(
    f"q{n} AS (SELECT * FROM (SELECT theme, doc_id, fit, stated FROM fv WHERE theme = '{t}'" + "".join(f" AND doc_id NOT IN (SELECT doc_id FROM q{m})" for m in range(n)) + f" ORDER BY fit DESC, doc_id LIMIT 1) WHERE fit >= {rd.LEAST_FIT} AND stated)"
    for n, t in enumerate(rd.TURNS))
add("t10_fitted_drivers", _fit, f"""WITH docs AS (SELECT doc_id, source, ({_list(HEADS)})[doc_id % {len(HEADS)} + 1] || coalesce(text, '') AS text FROM documents), {_ART.replace("FROM documents", "FROM docs")}, dv AS (SELECT doc_id, importance, since, f FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY importance DESC, doc_id) AS n FROM art WHERE NOT media AND NOT low AND title <> ''
 AND NOT (len(f) = 1 AND f[1] = 'Earnings' AND NOT broad) AND (since OR coalesce(age <= 24, false) OR coalesce(age <= 96 AND importance >= 44, false))) WHERE n = 1 ORDER BY importance DESC, doc_id LIMIT 48),
dt AS (SELECT dv.*, split_part(text, chr(10), 1) AS title, CASE WHEN doc_id % 9 = 0 THEN 'What if ' WHEN doc_id % 7 = 0 THEN 'Markets and economy ' ELSE '' END || coalesce(text, '') AS summary FROM dv JOIN docs USING (doc_id)),
dc AS (SELECT *, {_clean('summary', 'title')} AS clean FROM dt), du AS (SELECT *, unnest(f) AS theme FROM dc),
ds AS (SELECT *, (theme = '{rd.RATES}' AND ({_has(_HEAD, 'inflation problem is getting worse')} OR {_has(_HEAD, rd.RATE_WORDS)} OR ({_has(_HEAD, rd.PRICES)} AND {_has(_HEAD, rd.HOTTER)} AND NOT {_has(_HEAD, rd.AHEAD)})))
 OR (theme = '{rd.POLICY}' AND {_has(_HEAD, rd.RIVALS)}) OR (theme = '{rd.CHIPS}' AND {_has(_HEAD, rd.BUILDERS)}) OR (length(clean) >= 45 AND NOT {_generic('clean')}) OR (length(trim(title)) >= 50 AND NOT {_generic('title')} AND {_has('title', rd.VERBS)}) AS stated,
 {_HEAD} AS x FROM du WHERE theme IN ({', '.join(f"'{t}'" for t in rd.TURNS)})),
fv AS (SELECT theme, doc_id, stated, importance + CASE WHEN CASE theme {_WORDS} END THEN 55 ELSE 0 END + CASE WHEN {_generic('summary')} THEN -12 ELSE 8 END - {_points(_generic('title'), 10)} - {_points('NOT stated', 45)}
 - {_points("regexp_matches(summary, '(?i)^what if') OR regexp_matches(title, '(?i)^what if')", 35)} - {_points(f"theme = '{rd.RATES}' AND contains(lower(title), 'looking to the futures')", 55)} + {_points('since', 6)} AS fit FROM ds), {_PICKS}
""" + " UNION ALL ".join(f"SELECT theme, doc_id, fit::DOUBLE AS fit FROM q{n}" for n in range(len(rd.TURNS))))
