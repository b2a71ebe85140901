"""Cases that the tables do not hold: revisions over several batches, themes taken in turn, odd records, reference caches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelforge.operators import matrix as mx
from panelforge.operators import quality as qa
from panelforge.operators import scorebook as k
from panelforge.operators import text as tx
from panelforge.sources import readers as rd
from panelforge.streaming import jobs


def test_revisions_over_batches(spark, tmp_path):
    schema = "symbol long, date date, seq long, close double, volume double"
    at, day = str(tmp_path), dt.date(2024, 1, 2)
    rows = [[(1, day, 1, 10.0, 1.0), (2, day, 2, 20.0, 1.0)], [(1, day, 3, 11.0, 1.0), (1, dt.date(2024, 1, 3), 4, 12.0, 1.0)], [(2, day, 1, 99.0, 1.0)]]
    for batch in rows:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(schema).parquet(f"{at}/in")
        jobs.latest_bars(stream, f"{at}/bars", f"{at}/checkpoint").awaitTermination()
    out = jobs.current_bars(spark, f"{at}/bars", "symbol long, seq long, close double, volume double, date date, batch long")
    assert sorted((r.symbol, str(r.date), r.close) for r in out.collect()) == [(1, "2024-01-02", 11.0), (1, "2024-01-03", 12.0), (2, "2024-01-02", 20.0)]
    touched = spark.read.parquet(f"{at}/bars").groupBy("date").agg(F.countDistinct("batch").alias("n"))
    assert {str(r.date): r.n for r in touched.collect()} == {"2024-01-02": 3, "2024-01-03": 1}


def test_themes_take_turns(spark):
    df = spark.createDataFrame([(1, 9.0, ["A", "B"]), (2, 8.0, ["A"]), (3, 8.0, ["B", "C"]), (4, 1.0, ["D"])], "doc_id long, importance double, themes array<string>").orderBy(F.desc("importance"), "doc_id")
    got = {r.theme: r.doc_id for r in tx.theme_drivers(df, ["A", "B", "C"]).collect()}
    assert got == {"A": 1, "B": 3}
    assert tx.theme_drivers(df.where("doc_id > 9"), ["A"]).collect() == []


def test_ranks_of_ties_nulls_and_no_sector(spark):
    rows = [("a", "x", 1.0), ("b", "x", 1.0), ("c", "x", None), ("d", None, 3.0)]
    df = spark.createDataFrame(rows, "symbol string, sector string, v double").withColumn("date", F.lit("2024-01-02").cast("date"))
    got = {r.symbol: (r.v_rank, r.v_sector_rank, r.v_minus_sector_median) for r in mx.ranks(df, ["v"], ["v"]).collect()}
    assert got == {"a": (0.5, 0.75, 0.0), "b": (0.5, 0.75, 0.0), "c": (None, None, None), "d": (1.0, None, None)}


def test_schema_errors(spark):
    rows = [(1, '{"a": 1}'), (2, '{"a": null}'), (3, '[1]'), (4, '{"a": "x", "b": [1, 2]}'), (5, None), (6, "{bad")]
    df = spark.createDataFrame(rows, "key long, record string")
    got = {(r.key, r.path, r.error) for r in qa.schema_errors(df, {"a": {"type": "number", "required": True}, "b": {"type": "array", "maxItems": 1}}).collect()}
    broken = {(i, "$", "expected object") for i in (3, 5, 6)} | {(i, "$.a", "is required") for i in (3, 5, 6)}
    assert got == broken | {(2, "$.a", "expected number"), (4, "$.a", "expected number"), (4, "$.b", "has more than 1 items")}


def test_reference_cache_of_another_version(spark, tmp_path):
    rd.write_reference(spark.createDataFrame([(0.1 + 0.2,)], "x double"), f"{tmp_path}/r", "v1", "2024-01-02")
    cache = spark.read.parquet(f"{tmp_path}/r")
    assert rd.check_reference(cache, "v1", "2024-01-02").first()["x"] == 0.1 + 0.2
    with pytest.raises(ValueError, match="v1"):
        rd.check_reference(cache, "v2", "2024-01-02")


def test_books_without_news(spark):
    books = spark.createDataFrame([(1,), (2,)], "book long")
    rel = spark.createDataFrame([(1, 1, "error", "x", 1), (1, 2, "ready", "", 2), (1, 3, "ready", "read", 3)], "book long, place long, status string, reading string, ref long")
    drv = spark.createDataFrame([(1, 1, "t", "s", 7)], "book long, place long, title string, summary string, ref long")
    got = {r.book: (r.origin, r.ref, r.text) for r in k.macro_context(books, rel, drv).collect()}
    assert got == {1: ("release", 3, "read"), 2: ("none", None, None)}


def test_link_rules(spark):
    html = '<a href="/">Market research home</a><a href="https://news.site.org/a/b">Weekly outlook</a><a href="https://other.org/market/x">Market outlook</a><a href="/market/fund">Market fund page</a><a href="/m/2024/1/5">Research</a>'
    got = {r.target: r.score for r in tx.links(spark.createDataFrame([(1, "https://www.site.org/x", html, "Desk")], "page_id long, url string, html string, source string")).collect()}
    assert got == {"https://www.site.org/": 5, "https://news.site.org/a/b": 10, "https://www.site.org/m/2024/1/5": 15}
