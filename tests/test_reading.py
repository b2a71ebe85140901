"""The reading list and theme drivers on small cases worked out by hand."""

from pyspark.sql import functions as F

from panelforge.operators import reading as rd

LONG = "Banks lend less to small firms and the reserve path decides how fast that turns, while wages and rents keep prices from falling as quickly as the street has hoped for. " * 2
OTHER = "A second note on the same subject gives numbers by region, by age of the firm and by size of the loan, and it compares them with those of the last slowdown in detail. " * 2
SCHEMA = "url string, source string, trust string, title string, summary string, excerpt string, hours double"
NOW = "2024-01-10 12:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def pages(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumn("published", F.timestamp_seconds((F.unix_timestamp(now()) - F.col("hours") * 3600).cast("long"))).drop("hours")


def cards(spark, rows=()):
    return spark.createDataFrame(list(rows), "source string, url string")


def reads(df):
    return [tuple(r) for r in df.collect()]


def test_points_by_hand(spark):
    df = pages(spark, [
        ("a", "Axios Macro", "Very high", "Why credit matters", LONG, "The bottom line.", 24.0),  # 30 + 18 + 18 + 8 + 14 + 9
        ("b", "CNBC Markets", None, "Stock futures", "", "", 0.0),  # 12 - 34 - 18 + 10
        ("c", None, "Medium", None, None, None, 1000.0),  # 18
        ("d", "x", "high", "An editor", "", "", 1.2),  # 24 - 90 + 9.95, the half up
    ])
    got = df.select("url", rd.interest(F.unix_timestamp(now()) - F.unix_timestamp("published")).alias("q")).collect()
    assert {r.url: r.q for r in got} == {"a": 97.0, "b": -30.0, "c": 18.0, "d": -56.0}


def test_substance_and_analysis(spark):
    df = pages(spark, [
        ("ok", "s", None, "t", LONG, OTHER, 1.0), ("same text twice", "s", None, "t", LONG[:170], LONG[:170], 1.0), ("short parts", "s", None, "t", "How. " * 14, "Why. " * 14, 1.0),
        ("few words", "s", None, "t", "1234 " * 60, None, 1.0), ("only its title", "s", None, LONG, LONG, "", 1.0), ("nothing", None, None, None, None, None, 1.0),
    ])
    assert {r.url for r in df.where(rd.has_substance()).collect()} == {"ok"}
    rows = [("words", "s", "", "How banks lend"), ("house", "Morgan Stanley Research", "", "Note"), ("tape", "s", "Live updates", "How banks lend"), ("media", "s", "Our newsletter", "How"), ("plain", "s", "", "Showing")]
    kinds = spark.createDataFrame([(u, s, t, b, "") for u, s, t, b in rows], "url string, source string, title string, summary string, excerpt string")
    assert {r.url for r in kinds.where(rd.is_analytical()).collect()} == {"words", "house"}


def test_one_per_source_and_rotation(spark):
    rows = [(f"{s}{n}", s, t, "Why", LONG, OTHER, 24.0 * n) for s, t in (("A", "Very high"), ("B", "High"), ("C", "Medium"), ("D", None)) for n in (1, 2)]
    rows += [("old", "E", "Very high", "Why", LONG, OTHER, 169.0), ("wall", "F", "Very high", "Why: subscribe", LONG, OTHER, 1.0), ("undated", "G", "Very high", "Why", LONG, OTHER, None), ("edge", "H", None, "Why", LONG, OTHER, 168.0)]
    df = pages(spark, rows)
    urls = lambda c, n=6: [r[1] for r in reads(rd.reading_candidates(df, cards(spark, c), now(), n))]
    assert urls([]) == ["A1", "B1", "C1", "D1", "edge"]
    # three others are there, so the source shown before and the page shown before are left out
    assert urls([("A", "other"), ("Z", "C1")]) == ["B1", "D1", "edge"]
    # only two are left: all take part again
    assert urls([("A", None), ("B", None), (None, "C1")]) == ["A1", "B1", "C1", "D1", "edge"]
    assert urls([], 2) == ["A1", "B1"]
    assert reads(rd.reading_candidates(df.limit(0), cards(spark), now())) == []


def drivers(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, title string, summary string, excerpt string, importance double, since_previous boolean, themes array<string>")


def test_fit_by_hand(spark):
    df = drivers(spark, [
        (1, "Oil climbs", LONG, "", 10.0, True, ["Commodities and energy"]),  # 10 + 20 + 35 + 8 + 6
        (2, "Notes", LONG, "gold", 10.0, False, ["Commodities and energy"]),  # 10 + 20 + 8
        (3, "Notes", "Markets and economy", "copper", 50.0, False, ["Commodities and energy"]),  # 50 + 20 - 12 - 45
        (4, "Looking to the futures", "What if rates " + LONG, "", 90.0, None, ["Rates and central banks"]),  # 90 + 55 + 8 - 10 - 35 - 55
        (5, None, None, None, None, None, ["Earnings"]),  # 8 - 45
    ])
    got = {r.doc_id: r.fit for r in df.select("doc_id", rd.theme_fit(F.col("themes")[0]).alias("fit")).collect()}
    assert got == {1: 79.0, 2: 38.0, 3: 13.0, 4: 53.0, 5: -37.0}


def test_turns_take_the_best_free_driver(spark):
    rates, energy, growth = "Rates and central banks", "Commodities and energy", "Macro and growth"
    df = drivers(spark, [
        (1, "Treasury yields and oil", LONG, "", 80.0, False, [rates, energy]), (2, "Crude oil", LONG, "", 10.0, False, [energy]), (3, "Crude oil", LONG, "", 10.0, False, [energy]),
        (4, "GDP", "", "", 100.0, False, [growth]),  # the best fit, but nothing can be said of it: the theme stays empty
        (5, "Payroll", LONG, "", 1.0, False, [growth]),
    ])
    got = {(r.theme, r.doc_id, r.fit) for r in rd.fitted_drivers(df).collect()}
    assert got == {(rates, 1, 143.0), (energy, 2, 73.0)}
    assert {(r.theme, r.doc_id) for r in rd.fitted_drivers(df, [energy, rates]).collect()} == {(energy, 1)}
    assert rd.fitted_drivers(df, least=200).collect() == [] and rd.fitted_drivers(df.limit(0)).collect() == []
