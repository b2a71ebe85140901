"""Activation paths, bootstrap draws, spanned tables, yearly rewrites, outsiders and streamed rank changes."""

from __future__ import annotations

import datetime
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import activation as ac
from panelforge.operators import backtest as b
from panelforge.operators import history as h
from panelforge.operators import scorebook as sb
from panelforge.operators import trees as tr
from panelforge.sources import readers as rd
from panelforge.streaming import jobs

DAY = datetime.date(2020, 1, 1)


def day(i):
    return DAY + datetime.timedelta(days=i)


def test_activation_enters_at_the_first_close_over_the_trigger(spark):
    closes = [100.0, 99.0, 102.0, 104.0, 103.0, 110.0, 108.0, 120.0]
    frame = spark.createDataFrame([("A", day(i), c, 50.0 + i, day(i)) for i, c in enumerate(closes)] + [("B", day(0), 10.0, 50.0, day(0))], "symbol string, date date, close double, sector_close double, sector_date date")
    cases = spark.createDataFrame([("s", "A", day(1), 0.04, 0.01), ("s", "A", day(2), 0.0, None), ("s", "B", day(0), None, -0.5)], "setup string, symbol string, date date, vol20 double, vs_sma20 double")
    got = {(r.rule, r.window): r for r in ac.activation_report(frame, cases, hold=2, cost=0.0).collect()}
    assert len(got) == 25
    now = got["buy_immediately", 0]
    assert now.n == 2 and now.coverage == 1.0 and now["mean"] == pytest.approx(np.mean([104 / 99 - 53 / 51, 103 / 102 - 54 / 52]))
    r = got["vol_1", 3]  # trigger 102.96 from day 1: entry 104 on day 3, exit 110 on day 5
    assert r.n == 1 and r["mean"] == pytest.approx(110 / 104 - 55 / 53) and r.coverage == pytest.approx(1 / 3) and r.average_trigger == pytest.approx(0.04)
    assert got["vol_2", 3].n == 0 and got["vol_2", 5].n == 1 and got["vol_2", 5]["mean"] == pytest.approx(120 / 110 - 57 / 55)
    assert got["prior_close_high_5", 5].n == 2 and got["sma20", 10].average_trigger == pytest.approx(np.mean([1 / 1.01 - 1, 1.0]))


def test_draws_spread_like_chance(spark):
    n, reps = 60, 2000
    x = np.random.default_rng(1).normal(0.1, 1, n)
    daily = spark.createDataFrame([(day(i), float(v)) for i, v in enumerate(x)], "date date, x double").repartition(5)
    got = b.bootstrap_mean(daily, "x", reps).first()
    own = np.random.default_rng(2).choice(x, (reps, n)).mean(axis=1)
    assert abs(got.low - np.quantile(own, 0.025)) < 0.06 and abs(got.high - np.quantile(own, 0.975)) < 0.06
    counts = np.array([r.c for r in spark.range(6000).select((b.draw(F.floor(F.col("id") / 60), F.col("id") % 60, 42) % 60).alias("d")).groupBy("d").agg(F.count("*").alias("c")).collect()])
    assert len(counts) == 60 and ((counts - 100) ** 2 / 100).sum() < 100  # chi-squared with 59 degrees: 98.3 at 0.1%
    block = b.block_bootstrap_mean(daily, "x", 7, 500).first()
    draws = np.array([[r.v for r in spark.range(500 * 9).select(F.col("id"), (b.draw(F.floor(F.col("id") / 9), F.col("id") % 9, 42) % n).alias("v")).orderBy("id").collect()]]).reshape(500, 9)
    means = [np.concatenate([(s + np.arange(7)) % n for s in row])[:n] for row in draws]
    assert block.low == pytest.approx(np.quantile([x[m].mean() for m in means], 0.025), abs=1e-12)


def test_paired_interval_refuses(spark):
    rows = [(day(i), 1.0 + i % 3, 0.5) for i in range(40)]
    df = spark.createDataFrame(rows, "date date, a double, b double")
    status = lambda x: b.paired_interval(x, "a", "b", 10, 50).first()
    ok = status(df)
    assert ok.status == "ok" and ok.low < ok.mean_difference < ok.high and ok.paired_dates == 40
    gapped = status(df.withColumn("b", F.when(F.col("date") != day(7), F.col("b"))))
    assert gapped.status == "incomplete_calendar" and gapped.low is None and (gapped.paired_dates, gapped.total_dates) == (39, 40)
    assert status(df.limit(19)).status == "insufficient_blocks" and status(df.withColumn("b", F.lit(None).cast("double"))).status == "no_common_cohorts"


def test_spans_and_one_sided_changes(spark):
    html = """<table><tr><td>x</td></tr></table><TABLE class=a id="changes"><tr><th>Date</th><th colspan=2>Added</th></tr><tr><th>Ticker</th></tr>
    <tr><td rowspan="2"><i>May 1,\n 2026</i></td><td>NEW</td><td>New Co</td><td>OLD</td><td>Old &amp; Co</td><td rowspan='3'>Cap</td></tr>
    <tr><td></td><td></td><td>GONE</td><td>Gone</td></tr><tr><td>May 3, 2026</td><td>-</td><td>-</td><td rowspan=2>TWO</td><td>Two</td></tr>
    <tr><td>2026-05-04</td><td>ONE</td><td>One</td><td>Dos</td><td>Spin-off</td></tr><tr><td>bad day</td><td>A</td><td>A</td><td>B</td><td>B</td><td>r</td></tr></TABLE>"""
    pages = spark.createDataFrame([(1, html), (2, "<html/>"), (3, None)], "page_id int, html string")
    got = [(str(r.date), r.symbol, r.name, r.kind, r.reason) for r in rd.index_change_pages(pages).orderBy("pos", "kind").collect()]
    assert got == [
        ("2026-05-01", "NEW", "New Co", "add", "Cap"), ("2026-05-01", "OLD", "Old & Co", "remove", "Cap"), ("2026-05-01", "GONE", "Gone", "remove", "Cap"),
        ("2026-05-03", "TWO", "Two", "remove", "Cap"), ("2026-05-04", "ONE", "One", "add", "Spin-off"), ("2026-05-04", "TWO", "Dos", "remove", "Spin-off"),
    ]


def test_only_changed_years_are_written(spark, tmp_path):
    rows = [("A", datetime.date(y, m, 1), float(y - m)) for y in (2019, 2020, 2021) for m in (1, 2)]
    df = spark.createDataFrame(rows, "symbol string, date date, x double")
    at = str(tmp_path / "matrix")
    h.write_years(df, at)
    before = {y: sorted(os.listdir(f"{at}/year={y}")) for y in (2019, 2020, 2021)}
    out = h.write_years(df.withColumn("x", -F.col("x")), at, [2020])
    after = {y: sorted(os.listdir(f"{at}/year={y}")) for y in (2019, 2020, 2021)}
    assert before[2019] == after[2019] and before[2021] == after[2021] and before[2020] != after[2020]
    assert {(r.date, r.x) for r in out.collect()} == {(d, -x if d.year == 2020 else x) for _, d, x in rows}


def test_members_alone_are_ranked(spark):
    cols = "symbol string, date date, vs_sma20 double, vs_sma50 double, r20 double, r60 double, vol20 double"
    df = spark.createDataFrame([(s, DAY, v, v, v, v, 0.1) for s, v in (("A", 0.1), ("B", -0.2), ("C", 0.3), ("D", 9.0))], cols)
    spans = spark.createDataFrame([("A", DAY, None), ("B", day(-9), day(1)), ("C", day(-9), None), ("D", day(1), None)], "symbol string, start date, end date")
    got = {r.symbol: r for r in h.point_in_time_matrix(df, spans, ["r20"]).collect()}
    assert {s: round(r.r20_rank, 6) for s, r in got.items()} == {"A": round(2 / 3, 6), "B": round(1 / 3, 6), "C": 1.0}
    assert got["A"].above_20 == pytest.approx(2 / 3) and got["A"].r20_median == pytest.approx(0.1)


def test_outsiders_are_ranked_with_the_reference(spark):
    cols = "symbol string, date date, sector string, x double"
    reference = spark.createDataFrame([(f"R{i}", DAY, "s", float(i)) for i in range(4)], cols)
    outsiders = spark.createDataFrame([("O", DAY, "s", 1.5), ("R0", DAY, "s", 99.0)], cols)
    nodes = spark.createDataFrame([("m", 0, 0, 0, 0.55, 1, 2, True, 0.0, False, 1.0), ("m", 0, 1, 0, -1.0, -1, -1, False, 0.0, True, 1.0), ("m", 0, 2, 0, 1.0, -1, -1, False, 0.0, True, 1.0)], "model string, tree int, node int, split_index int, condition double, left int, right int, default_left boolean, gain double, leaf boolean, cover double")
    heads = spark.createDataFrame([("m", 0.0, ["x_rank"], None)], "model string, base double, features array<string>, best_iteration int")
    frozen = spark.createDataFrame([(DAY, 2.0), (DAY, 1.0), (DAY, 0.5), (DAY, None)], "date date, score double")
    got = sb.place_outsiders(reference, outsiders, frozen, tr.packed_models(nodes, heads, ["x_rank"]), "m", ["x_rank"], ["x"], ["x"]).collect()
    # O is third of five: rank 0.6, score 1, one frozen score above
    assert [(r.symbol, r.score, r.place, r.of, r.percentile) for r in got] == [("O", 1.0, 2, 3, 50.0)]


def test_streamed_changes_equal_the_batch(spark, tmp_path):
    schema = "as_of date, model string, symbol string, rank long"
    ranks = lambda k: [(day(k), "m1" if k % 3 else "m2", f"S{j}", (j * 7 + k * k) % 11) for j in range(11 if k != 4 else 9)]
    rows, source = [], str(tmp_path / "in")
    for batch in range(3):
        part = [r for k in range(batch * 6, batch * 6 + 6) for r in ranks(k)]
        rows += part
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        jobs.snapshot_changes(stream, f"{tmp_path}/recent", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
        want = {tuple(r) for r in sb.rank_changes(spark.createDataFrame(rows, schema)).collect()}
        assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/batch={batch}").collect()} == want
        held = spark.read.parquet(f"{tmp_path}/recent/batch={batch}").groupBy("model").agg(F.countDistinct("as_of").alias("n")).collect()
        assert max(r.n for r in held) <= 6
