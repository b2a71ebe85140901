"""Readers and writers of the panel's raw forms: CSV bars, provider payloads, HTML tables, registries, reports, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.functions.scalars import normal_symbol, strip_html
from panelforge.functions.semantics import finite

BAR_CSV = "date string, open string, high string, low string, close string, volume string"
CHART = """struct<chart:struct<result:array<struct<meta:struct<symbol:string,exchangeTimezoneName:string>,timestamp:array<bigint>,
 indicators:struct<quote:array<struct<open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<double>>>,adjclose:array<struct<adjclose:array<double>>>>>>>>"""
FACTS = "struct<cik:string,facts:map<string,map<string,struct<units:map<string,array<struct<end:string,val:double,filed:string,form:string>>>>>>>"
LISTING = "struct<data:struct<children:array<struct<data:struct<id:string,title:string,selftext:string,score:bigint,num_comments:bigint,created_utc:double>>>>>"
EARNINGS = "struct<data:struct<asOf:string,rows:array<struct<symbol:string,name:string,time:string,marketCap:string,fiscalQuarterEnding:string,epsForecast:string,noOfEsts:string,lastYearRptDt:string,lastYearEPS:string>>>>"
BOOSTER = """struct<learner:struct<gradient_booster:struct<model:struct<trees:array<struct<left_children:array<int>,right_children:array<int>,split_indices:array<int>,
 split_conditions:array<double>,default_left:array<int>,loss_changes:array<double>,sum_hessian:array<double>>>>>,learner_model_param:struct<base_score:string>,
 feature_names:array<string>,attributes:struct<best_iteration:string>>>"""
SCREEN = "struct<finance:struct<result:array<struct<id:string,quotes:array<struct<symbol:string,shortName:string,regularMarketPrice:double,regularMarketChangePercent:double,regularMarketVolume:double>>>>>>"


def bars_csv(spark: SparkSession, path: str, name: str = r"([^/]+)\.csv") -> DataFrame:
    """CSVs by symbol; what is no number becomes null, and `name` finds the symbol in a file's path."""
    df = spark.read.schema(BAR_CSV).option("header", True).option("recursiveFileLookup", True).csv(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), name, 1)
    return df.select(name.alias("symbol"), F.to_date(F.try_to_timestamp(F.substring("date", 1, 10), F.lit("yyyy-MM-dd"))).alias("date"), *[F.col(c).try_cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")]).where("date is not null")


def macro_csv(spark: SparkSession, path: str, name: str = r"([^/]+)\.csv") -> DataFrame:
    """(series_id, date, value) from two-column CSVs whatever their header; `name` finds the series in a file's path."""
    df = spark.read.schema("date string, value string").option("header", True).option("enforceSchema", True).option("recursiveFileLookup", True).csv(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), name, 1)
    return df.select(name.alias("series_id"), F.to_date(F.try_to_timestamp("date", F.lit("yyyy-MM-dd"))).alias("date"), F.col("value").try_cast("double").alias("value")).dropna()


def chart_bars(payloads: DataFrame, column: str = "body") -> DataFrame:
    """Adjusted bars of provider payloads: (symbol, date, open, high, low, close, volume, reason, pos).

    The day is the exchange's; prices are scaled by adjusted over raw close. Bars without a close above zero
    carry a reason and no prices. Of several bars of a day the last one counts.
    """
    r = F.from_json(column, CHART)["chart"]["result"][0]
    q = r["indicators"]["quote"][0]
    zipped = F.arrays_zip(r["timestamp"].alias("t"), q["open"].alias("o"), q["high"].alias("h"), q["low"].alias("l"), q["close"].alias("c"), q["volume"].alias("v"), r["indicators"]["adjclose"][0]["adjclose"].alias("a"))
    df = payloads.select(r["meta"]["symbol"].alias("symbol"), r["meta"]["exchangeTimezoneName"].alias("zone"), F.posexplode(zipped).alias("pos", "x"))
    df = df.select("symbol", "pos", F.expr("to_date(from_utc_timestamp(timestamp_seconds(x.t), zone))").alias("date"), *[F.col("x")[k].alias(k) for k in "ohlcva"])
    reason = F.when(F.col("c").isNull() | (F.col("c") <= 0), "bad_close").when(F.col("a").isNull() | (F.col("a") <= 0), "bad_adjusted_close")
    last = F.row_number().over(Window.partitionBy("symbol", "date").orderBy(F.desc("pos"))) == 1
    df = df.withColumns({"reason": reason, "last": last}).where("last")
    price = lambda k, n: F.when(F.col("reason").isNull(), F.col(k) * F.col("a") / F.col("c")).alias(n)
    return df.select("symbol", "date", price("o", "open"), price("h", "high"), price("l", "low"), price("c", "close"), F.when(F.col("reason").isNull(), F.col("v")).alias("volume"), "reason", "pos")


def ingestion_evidence(bars: DataFrame) -> DataFrame:
    """By symbol: bars read, accepted and rejected, and the last three days."""
    tail = F.slice(F.sort_array(F.collect_list(F.col("date")), False), 1, 3)
    return bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("raw"), F.count_if(F.col("reason").isNull()).alias("accepted"), F.count_if(F.col("reason").isNotNull()).alias("rejected"), F.array_join(F.transform(tail, lambda d: d.cast("string")), ",").alias("tail"))


def html_rows(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, cells) of all table rows of pages."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.transform(F.regexp_extract_all("row", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: strip_html(c))
    return pages.select(key, F.posexplode(rows).alias("pos", "row")).select(key, "pos", cells.alias("cells"), "row")


def constituents(pages: DataFrame, least: int = 400) -> DataFrame:
    """(symbol, name, sector, sub_industry) of a constituent table; fewer than `least` rows are an error."""
    df = html_rows(pages).where(F.size("cells") >= 4).select(normal_symbol(F.col("cells")[0]).alias("symbol"), F.col("cells")[1].alias("name"), F.col("cells")[2].alias("sector"), F.col("cells")[3].alias("sub_industry")).where("symbol rlike '^[A-Z-]{1,6}$'")
    n = df.count()
    if n < least:
        raise ValueError(f"{n} constituents; at least {least} are expected")
    return df


def index_changes(rows: DataFrame) -> DataFrame:
    """(page_id, pos, date, symbol, kind) of change rows whose date cell spans several rows: it is carried forward.

    Columns page_id, pos, date (null where spanned), added, removed; either may be missing.
    """
    w = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    df = rows.withColumn("date", F.last("date", True).over(w))
    both = F.array(F.struct(F.col("added").alias("symbol"), F.lit("add").alias("kind")), F.struct(F.col("removed").alias("symbol"), F.lit("remove").alias("kind")))
    return df.select("page_id", "pos", "date", F.inline(both)).where("symbol is not null and symbol != ''")


def table_grid(html: Column, table_id: str, run: int = 256) -> Column:
    """The cells of an HTML table as an array of rows, spanned cells repeated in every row they cover; null without the table.

    A fold over the rows carries for each column how many more rows its cell covers; a row's own cells fill the columns
    that are free. Cell texts have no tags and squeezed blanks; an empty cell is ''. A step copies the rows put out so far, so
    the fold goes by runs of `run` rows, each with a list of its own, and spans reach from run to run.
    """
    body = F.regexp_extract(html, rf"""(?is)<table[^>]*\bid=["']?{table_id}["']?[^>]*>(.*?)</table>""", 1)
    rows = F.regexp_extract_all(body, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cell = lambda c: F.struct(F.coalesce(F.regexp_extract(c, r"""(?i)^<t[dh][^>]*?\browspan=["']?(\d+)""", 1).try_cast("int"), F.lit(1)).alias("left"), strip_html(F.regexp_replace(c, r"(?is)^<t[dh][^>]*>|</t[dh]>$", "")).alias("text"))
    cells = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)(<t[dh][^>]*>.*?</t[dh]>)"), F.lit(1)), cell))
    free = F.struct(F.lit(0).alias("left"), F.lit("").alias("text"))

    def row(state: Column, own: Column) -> Column:
        width = F.size(own) + F.size(F.filter(state["held"], lambda h: h["left"] > 0))

        def column(acc: Column, c: Column) -> Column:
            held = F.coalesce(F.get(state["held"], c), free)
            taken = held["left"] > 0
            now = F.when(taken, held).otherwise(F.coalesce(F.get(own, acc["next"]), free))
            after = F.struct((now["left"] - 1).alias("left"), now["text"].alias("text"))
            return F.struct((acc["next"] + F.when(taken, 0).otherwise(1)).alias("next"), F.concat(acc["texts"], F.array(now["text"])).alias("texts"), F.concat(acc["held"], F.array(after)).alias("held"))

        empty = F.struct(F.lit(0).alias("next"), F.array().cast("array<string>").alias("texts"), F.array().cast("array<struct<left:int,text:string>>").alias("held"))
        places = F.when(width > 0, F.sequence(F.lit(0), width - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(places, empty, column, lambda done: F.struct(F.concat(state["out"], F.array(done["texts"])).alias("out"), done["held"].alias("held")))

    def some(state: Column, rows: Column) -> Column:
        own = F.struct(F.array().cast("array<array<string>>").alias("out"), state["held"].alias("held"))
        return F.aggregate(rows, own, row, lambda done: F.struct(F.concat(state["out"], F.array(done["out"])).alias("out"), done["held"].alias("held")))

    cut = lambda rows: F.transform(F.sequence(F.lit(0), F.floor(F.size(rows) / run).cast("int")), lambda n: F.slice(rows, n * run + 1, F.lit(run)))
    runs = F.transform(F.array(cells), cut)[0]
    start = F.struct(F.array().cast("array<array<array<string>>>").alias("out"), F.array().cast("array<struct<left:int,text:string>>").alias("held"))
    return F.when(body != "", F.flatten(F.aggregate(runs, start, some)["out"]))


def index_change_pages(pages: DataFrame, table_id: str = "changes", column: str = "html") -> DataFrame:
    """(page_id, pos, date, symbol, name, kind, reason) of raw pages (page_id, html): one row for each side of a change that is filled.

    Columns are date, added symbol and name, removed symbol and name, reason. Head rows, rows without a date and rows of
    fewer cells go; a dash is an empty cell, and a change with one empty side keeps the other. A long table may come in parts
    that no cell spans, each a page with a head row; a column `first` then tells how many rows stand before a part's own.
    """
    first = F.col("first") if "first" in pages.columns else F.lit(0)
    df = pages.select("page_id", first.alias("first"), F.posexplode(table_grid(F.col(column), table_id)).alias("pos", "c")).where(F.size("c") >= 6)
    df = df.withColumn("pos", (F.col("pos") + F.col("first")).cast("int"))
    day = F.coalesce(*[F.try_to_timestamp(F.col("c")[0], F.lit(f)).cast("date") for f in ("MMMM d, yyyy", "MMM d, yyyy", "yyyy-MM-dd")])
    side = lambda i, kind: F.struct(F.when(F.col("c")[i] != "-", F.col("c")[i]).alias("symbol"), F.when(F.col("c")[i + 1] != "-", F.col("c")[i + 1]).alias("name"), F.lit(kind).alias("kind"))
    df = df.select("page_id", "pos", day.alias("date"), F.col("c")[5].alias("reason"), F.inline(F.array(side(1, "add"), side(3, "remove"))))
    return df.where("date is not null and symbol is not null and symbol != ''").select("page_id", "pos", "date", "symbol", "name", "kind", "reason")


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def registry(spark: SparkSession, path: str, schema: str, field: str) -> DataFrame:
    """Records of an array field of multi-line JSON registries."""
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path).select(F.inline(field))


def forum_posts(listings: DataFrame, column: str = "body") -> DataFrame:
    """Posts of listing JSON."""
    kids = F.from_json(column, LISTING)["data"]["children"]
    return listings.select(F.explode(kids).alias("c")).select(F.col("c.data.id").alias("post_id"), F.col("c.data.title").alias("title"), F.col("c.data.selftext").alias("body"), F.col("c.data.score").alias("score"), F.col("c.data.num_comments").alias("comments"), F.timestamp_seconds("c.data.created_utc").alias("created"))


def movers(payloads: DataFrame, column: str = "body") -> DataFrame:
    """(bucket, symbol, name, price, change, volume) of screener payloads."""
    res = F.from_json(column, SCREEN)["finance"]["result"]
    q = payloads.select(F.explode(res).alias("r")).select(F.col("r.id").alias("bucket"), F.explode("r.quotes").alias("q"))
    return q.select("bucket", normal_symbol(F.col("q.symbol")).alias("symbol"), F.col("q.shortName").alias("name"), F.col("q.regularMarketPrice").alias("price"), F.col("q.regularMarketChangePercent").alias("change"), F.col("q.regularMarketVolume").alias("volume"))


def earnings_calendar(payloads: DataFrame, column: str = "body") -> DataFrame:
    """(date, as_of, symbol, name, time, ...) of a day's earnings payloads (date, body); as_of is the date where the payload has none.

    Bodies are parsed before their rows are taken apart; beside `inline` the body would go along with each row and be parsed again there.
    """
    d = F.from_json(column, EARNINGS)["data"]
    df = payloads.select("date", F.coalesce(d["asOf"], F.col("date").cast("string")).alias("as_of"), d["rows"].alias("rows"))
    return df.select("date", "as_of", F.inline("rows")).withColumnsRenamed({"lastYearRptDt": "lastYearReportDate", "lastYearEPS": "lastYearEps"})


def _month_day(text, fmt: str):
    return F.to_date(F.try_to_timestamp(F.regexp_replace(F.trim(text), r"\s+", " "), F.lit(fmt)))


def fred_calendar(pages: DataFrame, first, last) -> DataFrame:
    """(page_id, date, time, title) of release-calendar pages (page_id, html) inside [first, last]; Central times are shown as Eastern."""
    row = r'(?is)<span style="font-weight:\s*bold;">[^<]+</span>.*?<td[^>]*>\s*[0-9]{1,2}:[0-9]{2}\s*[ap]m\s*</td>.*?<a href="/release\?rid=[0-9]+">[^<]+</a>'
    part = lambda p: F.regexp_extract("row", p, 1)
    df = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(row), F.lit(0))).alias("row"))
    at = F.try_to_timestamp(F.concat(F.lit("2000-01-01 "), F.upper(F.regexp_replace(part(r"(?i)>\s*([0-9]{1,2}:[0-9]{2}\s*[ap]m)\s*<"), r"\s+", ""))), F.lit("yyyy-MM-dd h:mma"))
    date = _month_day(part(r">([^<]+)</span>"), "MMMM dd, yyyy")
    df = df.select("page_id", date.alias("date"), F.concat(F.date_format(at + F.expr("interval 1 hour"), "h:mm a"), F.lit(" ET")).alias("time"), strip_html(part(r'(?i)<a href="/release[^>]*>([^<]+)</a>')).alias("title"))
    return df.where(F.col("date").between(first, last))


def bea_event(title):
    # fixed values
    named = (("Personal Income and Outlays", "Personal Income and Outlays"), (r"GDP \(Advance Estimate\)", "GDP Advance Estimate"), (r"GDP \(Second Estimate\)", "GDP Second Estimate"), (r"GDP \(Third Estimate\)", "GDP Third Estimate"), ("GDP", "Gross Domestic Product"))
    return F.coalesce(*[F.when(title.rlike(f"(?i){p}"), F.lit(n)) for p, n in named], title)


def bea_calendar(pages: DataFrame, first, last) -> DataFrame:
    """(page_id, date, time, event, title) of the product and income releases of schedule pages (page_id, html) inside [first, last].

    The year stands in the page's header; a page without one takes the year of `first`.
    """
    year = F.coalesce(F.nullif(F.regexp_extract("html", r"(?i)<th[^>]*>\s*Year\s+([0-9]{4})\s*</th>", 1), F.lit("")), F.year(F.lit(first).cast("date")).cast("string"))
    df = pages.select("page_id", year.alias("year"), F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))).alias("row"))
    part = lambda p: F.regexp_extract("row", p, 1)
    day, at, title = part(r'(?is)<div class="release-date">([^<]+)</div>'), part(r'(?is)<small class="text-muted">([^<]+)</small>'), strip_html(part(r'(?is)<td class="release-title[^"]*"[^>]*>(.*?)</td>'))
    df = df.select("page_id", _month_day(F.concat_ws(", ", F.trim(day), "year"), "MMMM d, yyyy").alias("date"), F.concat(strip_html(at), F.lit(" ET")).alias("time"), title.alias("title"))
    return df.where(F.col("title").rlike("(?i)GDP|Personal Income and Outlays") & F.col("date").between(first, last)).select("page_id", "date", "time", bea_event(F.col("title")).alias("event"), "title")


def fomc_calendar(pages: DataFrame, first, last) -> DataFrame:
    """(page_id, date, title, projections) of rate decisions of meeting pages (page_id, html): the last day of each range, starred ones with projections."""
    panel = r"(?is)<h4><a[^>]*>\s*[0-9]{4}\s+FOMC Meetings.*?(?=<h4><a|$)"
    df = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(panel), F.lit(0))).alias("panel"))
    meeting = r"(?is)fomc-meeting__month.*?<strong>[^<]+</strong>.*?fomc-meeting__date[^>]*>[^<]+</div>"
    df = df.select("page_id", F.regexp_extract("panel", r"([0-9]{4})\s+FOMC", 1).alias("year"), F.explode(F.regexp_extract_all("panel", F.lit(meeting), F.lit(0))).alias("m"))
    month, days = F.trim(F.regexp_extract("m", r"<strong>([^<]+)</strong>", 1)), F.trim(F.regexp_extract("m", r"(?s)fomc-meeting__date[^>]*>([^<]+)<", 1))
    day = F.regexp_extract(F.replace(days, F.lit("*"), F.lit("")), r"([0-9]{1,2})\s*$", 1)
    df = df.select("page_id", _month_day(F.concat_ws(" ", month, F.concat(day, F.lit(",")), "year"), "MMMM d, yyyy").alias("date"), F.format_string("FOMC meeting decision (%s %s, %s)", month, days, F.col("year")).alias("title"), days.contains("*").alias("projections"))
    return df.where(F.col("date").between(first, last))


def saved_trees(models: DataFrame, column: str = "body") -> DataFrame:
    """Nodes as rows (model, tree, node, split_index, condition, left, right, default_left, gain, leaf, cover) of saved boosters (model, body)."""
    trees = F.from_json(column, BOOSTER)["learner"]["gradient_booster"]["model"]["trees"]
    df = models.select("model", F.posexplode(trees).alias("tree", "t"))
    zipped = F.arrays_zip(*[F.col(f"t.{c}").alias(c) for c in ("left_children", "right_children", "split_indices", "split_conditions", "default_left", "loss_changes")], F.coalesce("t.sum_hessian", F.array().cast("array<double>")).alias("sum_hessian"))
    df = df.select("model", "tree", F.posexplode(zipped).alias("node", "x"))
    return df.select("model", "tree", "node", F.col("x.split_indices").alias("split_index"), F.col("x.split_conditions").alias("condition"), F.col("x.left_children").alias("left"), F.col("x.right_children").alias("right"), (F.col("x.default_left") != 0).alias("default_left"), F.col("x.loss_changes").alias("gain"), (F.col("x.left_children") < 0).alias("leaf"), F.col("x.sum_hessian").alias("cover"))


def saved_heads(models: DataFrame, column: str = "body") -> DataFrame:
    """(model, base, features, best_iteration) of saved boosters (model, body): the margin added to all trees, the columns' order, and the last tree kept (null: all)."""
    head = F.from_json(column, BOOSTER)["learner"]
    base = F.translate(head["learner_model_param"]["base_score"], "[]", "").cast("double")
    return models.select("model", F.coalesce(base, F.lit(0.5)).alias("base"), head["feature_names"].alias("features"), head["attributes"]["best_iteration"].cast("int").alias("best_iteration"))


def company_facts(payloads: DataFrame, column: str = "body") -> DataFrame:
    """(cik, taxonomy, tag, unit, end, filed, form, value) of nested company facts."""
    f = F.from_json(column, FACTS)
    df = payloads.select(f["cik"].alias("cik"), F.explode(f["facts"]).alias("taxonomy", "tags"))
    df = df.select("cik", "taxonomy", F.explode("tags").alias("tag", "x")).select("cik", "taxonomy", "tag", F.explode("x.units").alias("unit", "rows"))
    return df.select("cik", "taxonomy", "tag", "unit", F.inline("rows")).withColumnRenamed("val", "value").withColumns({"end": F.to_date("end"), "filed": F.to_date("filed")})


def write_dataset(df: DataFrame, path: str, labels: list[str]) -> DataFrame:
    """Writes a panel by year and returns its one-row description: rows, symbols, span, label rates."""
    df.withColumn("year", F.year("date")).write.mode("overwrite").partitionBy("year").parquet(path)
    return describe_dataset(df.sparkSession.read.parquet(path), labels)


def describe_dataset(df: DataFrame, labels: list[str]) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("symbol").alias("symbols"), F.min("date").alias("first"), F.max("date").alias("last"), *[F.avg((F.col(c) > 0).cast("double")).alias(f"{c}_rate") for c in labels])


def report(df: DataFrame) -> DataFrame:
    """Report form: non-finite numbers as null."""
    return df.select(*[finite(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def manifest_violations(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Assets whose SHA-256 is missing or differs: files (path, content), manifest (path, sha256)."""
    have = files.select("path", F.sha2("content", 256).alias("found"))
    return manifest.join(have, "path", "left").where(~F.col("sha256").eqNullSafe(F.col("found"))).select("path", "sha256", "found")


def cache_manifest(requested: DataFrame, present: DataFrame) -> DataFrame:
    """By key: whether a requested series is cached, with how many rows."""
    n = present.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    return requested.join(n, "key", "left").select("key", F.when(F.col("rows").isNull(), "failed").otherwise("cached").alias("status"), F.coalesce("rows", F.lit(0)).alias("rows"))


def write_reference(rows: DataFrame, path: str, version: str, as_of) -> None:
    """Writes a reference cache in full precision with its version and date."""
    rows.select("*", F.lit(version).alias("version"), F.lit(as_of).alias("as_of")).write.parquet(path)


def check_reference(cache: DataFrame, version: str, as_of) -> DataFrame:
    """Rows of a reference cache; another version or date is an error."""
    bad = cache.where((F.col("version") != version) | (F.col("as_of") != F.lit(as_of))).limit(1).collect()
    if bad:
        raise ValueError(f"reference cache is of {bad[0]['version']} at {bad[0]['as_of']}, not {version} at {as_of}")
    return cache.drop("version")
