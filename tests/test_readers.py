import json

import pytest

from panelforge.operators.text import feed_items, markdown_rows, tickers, ticker_signals
from panelforge.sources import readers as rd
from pyspark.sql import functions as F


def test_chart_days_are_the_exchanges_and_last_bar_wins(spark):
    body = {"chart": {"result": [{"meta": {"symbol": "A", "exchangeTimezoneName": "America/New_York"}, "timestamp": [1704205800, 1704292200, 1704292260, 1704378600],
                                  "indicators": {"quote": [{"open": [1, 2, 3, 4], "high": [1, 2, 3, 4], "low": [1, 2, 3, 4], "close": [2, 4, 6, None], "volume": [1, 1, 1, 1]}], "adjclose": [{"adjclose": [1, 2, 3, None]}]}}]}}
    got = {str(r.date): r for r in rd.chart_bars(spark.createDataFrame([(json.dumps(body),)], "body string")).collect()}
    assert got["2024-01-02"].open == 0.5 and got["2024-01-03"].close == 3.0 and got["2024-01-03"].pos == 2
    assert got["2024-01-04"].reason == "bad_close" and got["2024-01-04"].close is None


def test_csv_bars(spark, tmp_path):
    (tmp_path / "ABC.csv").write_text("Date,Open,High,Low,Close,Volume\n2024-01-02,1,2,1,x,5\nbad,1,1,1,1,1\n")
    rows = rd.bars_csv(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0].symbol == "ABC" and rows[0].close is None and rows[0].volume == 5.0


def test_constituents_guard(spark):
    html = "<table>" + "".join(f"<tr><td>AB{c}.B</td><td>N</td><td>S</td><td>I</td></tr>" for c in "CDE") + "</table>"
    pages = spark.createDataFrame([(1, html)], "page_id int, html string")
    assert sorted(r.symbol for r in rd.constituents(pages, 3).collect()) == ["ABC-B", "ABD-B", "ABE-B"]
    with pytest.raises(ValueError):
        rd.constituents(pages, 4)


def test_feeds_and_registry(spark):
    rss = "<rss><item><title>A &amp; B</title><link>http://x/1</link><pubDate>Mon</pubDate><description><![CDATA[<p>Hi</p>]]></description></item></rss>"
    r = feed_items(spark.createDataFrame([(1, rss)], "feed_id int, body string")).first()
    assert (r.title, r.link, r.summary) == ("A & B", "http://x/1", "Hi")
    lines = spark.createDataFrame([(0, "| Name | URL |"), (1, "|---|---|"), (2, "| X | http://x |"), (3, "text")], "pos int, line string")
    assert [r.cells for r in markdown_rows(lines).collect()] == [["X", "http://x"]]


def test_tickers_and_weights(spark):
    df = spark.createDataFrame([(1, "$TSLA up, CEO of MSFT", "MSFT MSFT and NVDA", 10, 5)], "post_id int, title string, body string, score int, comments int")
    assert sorted(df.select(tickers(F.col("title"), ["MSFT", "NVDA", "CEO"])).first()[0]) == ["MSFT", "TSLA"]
    got = {r.symbol: r.weight for r in ticker_signals(df, ["MSFT", "NVDA"]).collect()}
    assert got["TSLA"] == pytest.approx(4.5) and got["MSFT"] == pytest.approx(3.3) and "NVDA" not in got  # below 1


def test_listing_and_screener(spark):
    listing = {"data": {"children": [{"data": {"id": "p", "title": "t", "selftext": "b", "score": 3, "num_comments": 2, "created_utc": 1704205800.0}}]}}
    r = rd.forum_posts(spark.createDataFrame([(json.dumps(listing),)], "body string")).first()
    assert (r.post_id, r.score, r.comments) == ("p", 3, 2)
    screen = {"finance": {"result": [{"id": "day_gainers", "quotes": [{"symbol": "brk.b", "shortName": "B", "regularMarketPrice": 1.0, "regularMarketChangePercent": 2.0, "regularMarketVolume": 3.0}]}]}}
    r = rd.movers(spark.createDataFrame([(json.dumps(screen),)], "body string")).first()
    assert (r.bucket, r.symbol, r.change) == ("day_gainers", "BRK-B", 2.0)


def test_ticker_signal_rules(spark):
    """Generic threads, long lists and single mentions count title hits and cashtags only; body mentions count up to four."""
    known = ["AAA", "BBB", "CCC", "DDD", "EEE", "FFF", "GGG", "HHH", "BRK.B"]
    posts = [(1, "daily discussion", "AAA AAA AAA $BBB"), (2, "mine", "AAA AAA BBB CCC DDD EEE FFF GGG HHH"), (3, "x", "BRK.B BRKXB BRK-B brk.b"), (4, "AAA", "AAA AAA AAA AAA AAA AAA"), (5, None, None)]
    got = {(r.post_id, r.symbol): (r.weight, r.direct) for r in ticker_signals(spark.createDataFrame([(*p, 1, 1) for p in posts], "post_id int, title string, body string, score int, comments int"), known).collect()}
    assert got == {(1, "BBB"): (2.4, True), (3, "BRK.B"): (1.2, False), (4, "AAA"): (4.1, True)}


def test_importance_terms(spark):
    from panelforge.operators.text import market_drivers, scored_articles

    rows = [(1, "Oil jumps", "crude", "Reuters", "very high", 2.0, False, "a"), (2, "Oil slips", "crude", "Reuters", "very high", 2.0, True, "a"), (3, "Acme stock soars", "", "x", None, None, False, "b"), (4, "Editor joins", "the coverage team", "x", "medium", 30.0, False, "c"), (5, "sign in", "", "x", "high", 200.0, False, "d")]
    scored = scored_articles(spark.createDataFrame(rows, "doc_id int, title string, summary string, source string, trust string, age double, since_previous boolean, url string").selectExpr("*", "'' as excerpt"))
    assert {r.doc_id: r.importance for r in scored.collect()} == {1: 86.0, 2: 116.0, 3: -76.0, 4: -93.0, 5: -8.0}
    assert [r.doc_id for r in market_drivers(scored).collect()] == [2]
