"""What keeps a query's cost in step with its input: bodies parsed once, folds by runs, pages in parts, texts read once."""

import re
from functools import reduce

from pyspark.sql import functions as F

from panelforge.sources import readers as rd


def above_generate(df):
    """The optimised plan's nodes over its first generator."""
    return re.split(r"(?m)^.*?\bGenerate\b", df._jdf.queryExecution().optimizedPlan().toString())[0]


def test_earnings_bodies_are_parsed_before_their_rows(spark):
    body = '{"data": {"asOf": null, "rows": [{"symbol": "A"}, {"symbol": "B", "lastYearEPS": "1"}]}}'
    df = rd.earnings_calendar(spark.createDataFrame([("2024-01-02", body)], "date string, body string"))
    assert "from_json" not in above_generate(df) and "body" not in above_generate(df)
    assert [tuple(r) for r in df.select("date", "as_of", "symbol", "lastYearEps").orderBy("symbol").collect()] == [("2024-01-02", "2024-01-02", "A", None), ("2024-01-02", "2024-01-02", "B", "1")]


def test_grid_spans_reach_from_run_to_run(spark):
    rows = "".join(f"<tr>{f'<td rowspan=5>d{i}</td>' if i % 5 == 0 else ''}<td>a{i}</td>{'<td rowspan=2>r</td>' if i % 2 == 0 else ''}</tr>" for i in range(23))
    df = spark.createDataFrame([(f"<table id='changes'>{rows}</table>",), ("<table id=changes></table>",), ("no",)], "html string")
    whole, cut, default = (df.select(*[rd.table_grid(F.col("html"), "changes", **how).alias("g")]).collect() for how in ({"run": 1000}, {"run": 3}, {}))
    assert whole == cut == default
    assert [r[0] for r in whole[0].g] == [f"d{i - i % 5}" for i in range(23)] and [r[1] for r in whole[0].g] == [f"a{i}" for i in range(23)]


def test_change_table_in_parts_is_the_whole_table(spark):
    head = "<table id=changes><tr><th>Date</th></tr>"
    row = lambda i: f"<tr><td>2001-01-{i + 1:02}</td><td>A{i}</td><td>n</td><td>-</td><td></td><td>x</td></tr>"
    whole = spark.createDataFrame([(1, head + "".join(map(row, range(9))) + "</table>")], "page_id long, html string")
    parts = spark.createDataFrame([(1, k, head + "".join(map(row, range(k, k + 3))) + "</table>") for k in (0, 3, 6)], "page_id long, first long, html string")
    got = [sorted(tuple(r) for r in rd.index_change_pages(x).collect()) for x in (whole, parts)]
    assert got[0] == got[1] and [r[1] for r in got[0]] == list(range(1, 10))


def test_found_words_are_the_words_of_the_patterns(spark):
    from panelforge.operators import reading as rl
    from panelforge.operators import text as tx

    lists = [*tx.THEMES.values(), tx.MEDIA, tx.PERSONAL, tx.ONE_DEAL, tx.BROAD, tx.ROUNDUP, tx.ROUNDUP_TOPIC, rl.ANGLE, rl.SUBJECT, rl.QUESTION, rl.ROUTINE, rl.ANALYSIS]
    whole = [x for words in lists for x in words.split("|") if "[" not in x] + ["trade-off", "trade off"]
    texts = [t for x in whole for t in (x, x.upper(), f"({x})", f"a{x}", f"{x}s", f"é{x}é", x.replace(" ", "  "), x.replace("k", "K").replace("i", "İ"))]
    df = spark.createDataFrame([(t,) for t in [*texts, "", " and ".join(whole)]], "t string")
    low = tx.lowered(F.col("t"))
    df = tx.behind(df, low=low, found=tx.found_words(low, tx.vocabulary(*lists)))
    bad = [tx.has_found(F.col("found"), F.col("low"), words) != tx.has_words(F.col("t"), words) for words in lists]
    bad += [tx.contains_any(F.col("low"), words) != F.col("t").rlike(f"(?i)(?:{words})") for words in (tx.HEADLINE, tx.WALL)]
    assert [r.t for r in df.where(reduce(lambda a, b: a | b, bad)).collect()] == []


def test_filters_on_scored_articles_do_not_read_texts_again(spark):
    from panelforge.operators import text as tx

    rows = spark.createDataFrame([(1, "oil soars 5% on war", "stock jumps", "", "s", "high", 1.0, True, "u")], "doc_id int, title string, summary string, excerpt string, source string, trust string, age double, since_previous boolean, url string")
    plan = tx.market_drivers(tx.scored_articles(rows))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_intersect(split(") <= 2


def test_feed_tags_are_read_once_and_parts_keep_places(spark):
    from panelforge.operators import text as tx

    item = lambda n: f"<item><title>T{n}</title><link>u{n}</link><description>d{n}</description></item>"
    whole = spark.createDataFrame([(1, item(0) + item(1) + item(2))], "feed_id long, body string")
    parts = spark.createDataFrame([(1, 0, item(0) + item(1)), (1, 2, item(2))], "feed_id long, first long, body string")
    got = [sorted(tuple(r) for r in tx.feed_items(x).collect()) for x in (whole, parts)]
    assert got[0] == got[1] and [r[1:4] for r in got[0]] == [(n, f"T{n}", f"u{n}") for n in range(3)]
    plan = tx.feed_items(whole)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("</title>") == 1 and plan.count("</description>") == 1


def test_folds_do_not_compute_their_rows_again(spark):
    from panelforge.operators import model as m

    n = F.col("id") % 5
    rows = spark.range(200).select(
        F.date_add(F.lit("2001-01-01").cast("date"), (F.col("id") / 5).cast("int")).alias("date"), F.concat(F.lit("S"), n.cast("string")).alias("symbol"), F.lit("x").alias("sector"),
        n.cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"), (n / 10).alias("outcome"), n.cast("int").alias("grade"),
    )
    day = F.date_add(F.lit("2001-01-01").cast("date"), F.col("id").cast("int")).alias("date")
    folds = spark.range(40).select((F.col("id") % 2 + 1).alias("fold"), F.when(F.col("id") < 30, "train").otherwise("test").alias("split"), day)
    got = m.fold_predictions(rows, folds, {"both": {"features": ["a", "b"], "trees": 1}, "one": {"features": ["a"], "trees": 1}})
    assert "Range" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, got.groupBy("strategy", "fold").count().collect())) == [("both", 1, 25), ("both", 2, 25), ("one", 1, 25), ("one", 2, 25)]
    assert got.where(F.abs(F.col("score") - F.col("grade")) > 1e-6).isEmpty()


def most_joined(spark, run):
    """The most rows that a join of the queries of `run()` made."""
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty()
    before = store.executionsCount()
    run()
    bus.waitUntilEmpty()
    most, done = 0, store.executionsList()
    for i in range(before, done.size()):
        at = done.apply(i).executionId()
        nodes, values = store.planGraph(at).allNodes(), store.executionMetrics(at)
        for n in (nodes.apply(j) for j in range(nodes.size())):
            for m in (n.metrics().apply(j) for j in range(n.metrics().size()) if "Join" in n.name()):
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most


def test_an_identifiers_labels_do_not_meet_every_question(spark):
    from panelforge.operators import identity as idy

    day = lambda i: F.date_add(F.lit("2001-01-01").cast("date"), i)
    name = F.concat(F.lit("A"), F.col("id").cast("string"))
    isin = F.concat(F.lit("I"), (F.col("id") % 1).cast("string"))
    securities = spark.range(100).select(name.alias("label"), day(F.lit(0)).alias("start"), F.lit(None).cast("date").alias("end"))
    asked = spark.range(400).select(F.concat(F.lit("A"), (F.col("id") % 100).cast("string")).alias("symbol"), isin.alias("isin"), day((F.col("id") / 100).cast("int")).alias("date"))
    asked = asked.union(spark.sql("SELECT 'none', 'I0', date'2001-01-02' UNION ALL SELECT 'none', CAST(NULL AS STRING), date'2001-01-02' UNION ALL SELECT CAST(NULL AS STRING), 'I0', date'2001-01-02' UNION ALL SELECT 'A1', 'J', date'2001-01-02' UNION ALL SELECT 'A1', 'I0', date'2000-01-02'"))
    renames = spark.createDataFrame([("A1", "B1")], "old string, new string")
    got = []
    most = most_joined(spark, lambda: got.extend(idy.resolve_identities(asked, securities, renames, spark.range(100).select(isin.alias("isin"), name.alias("label"))).collect()))
    assert 0 < most <= 500
    assert len(got) == 405 and sum(r.security == r.symbol is not None for r in got) == 401
    rest = {(r.symbol, r.isin, str(r.date)): (len(r.candidates), r.security) for r in got if r.security is None}
    assert rest == {("none", "I0", "2001-01-02"): (100, None), ("none", None, "2001-01-02"): (0, None), (None, "I0", "2001-01-02"): (100, None), ("A1", "I0", "2000-01-02"): (0, None)}
