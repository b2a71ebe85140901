"""Data quality: calendar and price checks, profiles, readiness gates and published-table contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def calendar_violations(bars: DataFrame, days: DataFrame) -> DataFrame:
    """By symbol: repeated days, prices not above zero, holes on the benchmark's calendar, and a missing last session."""
    last = days.agg(F.max("date")).first()[0]
    ix = bars.join(F.broadcast(days), "date")
    g = ix.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("date").alias("days"), F.count_if(~(F.col("close") > 0)).alias("not_positive"),
        (F.max("session_ix") - F.min("session_ix") + 1).alias("span"), F.max("date").alias("last"),
    )
    return g.select("symbol", (F.col("rows") - F.col("days")).alias("repeated"), "not_positive", (F.col("span") - F.col("days")).alias("holes"), (F.col("last") < F.lit(last)).alias("stale"))


def price_profile(bars: DataFrame, jump: float = 0.5) -> DataFrame:
    r = F.col("close") / F.lag("close").over(Window.partitionBy("symbol").orderBy("date")) - 1
    df = bars.withColumn("r", r)
    return df.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("close").isNull()).alias("nulls"), F.count_if(F.abs("r") > jump).alias("jumps"), F.min("date").alias("first"), F.max("date").alias("last"))


def row_count_quantiles(bars: DataFrame) -> DataFrame:
    n = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    q = F.percentile("n", F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    return n.agg(q.alias("q")).select(*[F.col("q")[i].alias(c) for i, c in enumerate(("least", "p25", "median", "p75", "most"))])


def dataset_profile(df: DataFrame, features: list[str]) -> DataFrame:
    """One row per feature: nulls, non-finite cells, mean and extremes."""
    parts = [F.struct(F.lit(c).alias("feature"), F.count_if(F.col(c).isNull()).alias("nulls"), F.count_if(F.isnan(c) | (F.abs(c) == float("inf"))).alias("non_finite"), F.avg(c).alias("mean"), F.min(c).alias("least"), F.max(c).alias("most")) for c in features]
    return df.agg(F.array(*parts).alias("x")).select(F.inline("x"))


def history_starts(bars: DataFrame, shares: list[float]) -> DataFrame:
    """For each share of symbols, the first day by which so many have history."""
    starts = bars.groupBy("symbol").agg(F.min("date").alias("start"))
    n = F.count(F.lit(1)).over(Window.partitionBy())
    placed = starts.select("start", F.row_number().over(Window.orderBy("start")).alias("k"), n.alias("n"))
    wanted = F.explode(F.array(*[F.lit(x) for x in shares]))
    return placed.select("start", "k", "n", wanted.alias("share")).where(F.col("k") >= F.ceil(F.col("n") * F.col("share"))).groupBy("share").agg(F.min("start").alias("start"))


def readiness(bars: DataFrame, context: list[str], least: float = 0.9) -> DataFrame:
    """Whether all context series and enough others have the latest session, and which are stale."""
    last = bars.groupBy("symbol").agg(F.max("date").alias("last"))
    top = F.max("last").over(Window.partitionBy())
    df = last.withColumn("current", F.col("last") == top).withColumn("is_context", F.col("symbol").isin(context))
    g = df.agg(F.min(F.when(F.col("is_context"), F.col("current").cast("int"))).alias("context_ok"), F.avg(F.when(~F.col("is_context"), F.col("current").cast("int"))).alias("share"), F.array_join(F.slice(F.sort_array(F.collect_list(F.when(~F.col("current"), F.col("symbol")))), 1, 6), ",").alias("stale"))
    return g.withColumn("ready", (F.coalesce("context_ok", F.lit(1)) == 1) & (F.col("share") >= least))


def scorable(df: DataFrame, date, features: list[str]) -> DataFrame:
    """Rows of one date that may be scored: no repeated symbol, all features finite."""
    w = Window.partitionBy("symbol")
    ok = F.lit(True)
    for c in features:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c)
    return df.where(F.col("date") == date).withColumn("_n", F.count(F.lit(1)).over(w)).where((F.col("_n") == 1) & ok).drop("_n")


def label_mismatches(df: DataFrame, a: str, b: str, tolerance: float = 1e-10) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.abs(F.col(a) - F.col(b)) > tolerance).alias("mismatches"), F.count_if(F.col(a).isNull() != F.col(b).isNull()).alias("one_sided"))


def published_violations(scored: DataFrame) -> DataFrame:
    """Rows that break the published table's contract: ranks 1..n without gaps, percentile from the rank."""
    n = F.count(F.lit(1)).over(Window.partitionBy("date"))
    place = F.row_number().over(Window.partitionBy("date").orderBy("rank"))
    df = scored.withColumns({"_n": n, "_p": place})
    want = F.when(F.col("_n") > 1, 100 * (1 - (F.col("rank") - 1) / (F.col("_n") - 1))).otherwise(100.0)
    return df.where((F.col("rank") != F.col("_p")) | (F.abs(F.col("percentile") - want) > 1e-9)).select("date", "symbol", "rank")


def tag_coverage(facts: DataFrame, symbols: int) -> DataFrame:
    """Share of symbols that report each tag."""
    return facts.groupBy("tag").agg(F.countDistinct("symbol").alias("symbols"), F.count(F.lit(1)).alias("facts")).withColumn("coverage", F.col("symbols") / symbols)


def readiness_record(bars: DataFrame, failures: DataFrame, failing: DataFrame, samples: int = 6) -> DataFrame:
    """(kind, key, value): symbols by latest accepted session (`missing` where there is none), and the first failing symbols with theirs.

    `bars` has symbol and date, `failures` symbol and error, `failing` the symbols that block readiness.
    """
    latest = bars.groupBy("symbol").agg(F.max("date").cast("string").alias("latest"))
    rows = latest.join(failures.select("symbol", "error").dropDuplicates(["symbol"]), "symbol", "full").select("symbol", F.coalesce("latest", F.lit("missing")).alias("latest"), "error")
    counts = rows.groupBy("latest").agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit("count").alias("kind"), F.col("latest").alias("key"), "value")
    first = rows.join(failing.select("symbol").distinct(), "symbol", "left_semi").orderBy("symbol").limit(samples)
    return counts.unionByName(first.select(F.lit("sample").alias("kind"), F.col("symbol").alias("key"), F.concat_ws("|", "latest", "error").alias("value")))


def all_gain_windows(bars: DataFrame, n: int = 14) -> DataFrame:
    """By symbol: rows whose last n moves hold a gain and no loss (where RSI rules differ), and the last day."""
    w = Window.partitionBy("symbol").orderBy("date")
    df = bars.where(F.col("close").isNotNull()).select("symbol", "date", (F.col("close") - F.lag("close").over(w)).alias("d"))
    last = w.rowsBetween(1 - n, 0)
    edge = (F.count("d").over(last) == n) & (F.min("d").over(last) >= 0) & (F.max("d").over(last) > 0)
    return df.withColumn("edge", edge).groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.count_if("edge").alias("edge_rows"), F.max("date").alias("last"))


def cache_endings(by_symbol: DataFrame) -> DataFrame:
    """Histogram of last days of `all_gain_windows`, with rows and edge cases."""
    return by_symbol.groupBy("last").agg(F.count(F.lit(1)).alias("symbols"), F.sum("rows").alias("rows"), F.sum("edge_rows").alias("edge_rows"))


def schema_errors(records: DataFrame, fields: dict[str, dict], column: str = "record") -> DataFrame:
    """(key, path, error) of JSON objects that break a schema: type, required, enum, minItems and maxItems of top-level fields.

    `fields` maps a name to {"type": "number|string|boolean|array|object|null"[, "required", "enum", "minItems", "maxItems"]}.
    """
    raw = F.try_parse_json(column)
    found = [F.struct(F.lit("$").alias("path"), F.when(~F.coalesce(F.startswith(F.schema_of_variant(raw), F.lit("OBJECT")), F.lit(False)), F.lit("expected object")).alias("error"))]
    for name, rule in fields.items():
        v = F.try_variant_get(raw, f"$.{name}", "variant")
        kind = F.lower(F.schema_of_variant(v))
        named = F.when(kind.rlike("^(bigint|int|smallint|tinyint|decimal|double|float)"), "number").when(kind == "void", "null").when(kind.startswith("array"), "array").when(kind.startswith("object"), "object").otherwise(kind)
        absent = v.isNull()
        text = F.try_variant_get(raw, f"$.{name}", "string")
        wrong = ~absent & ~named.isin(*rule["type"].split("|"))
        checks = [F.when(wrong, F.lit(f"expected {rule['type']}"))]
        if rule.get("required"):
            checks.append(F.when(absent, F.lit("is required")))
        if "enum" in rule:
            checks.append(F.when(~absent & ~wrong & ~text.isin(*rule["enum"]), F.lit("is not in enum")))
        if "minItems" in rule or "maxItems" in rule:
            size = F.size(F.try_variant_get(raw, f"$.{name}", "array<variant>"))
            if "minItems" in rule:
                checks.append(F.when(~absent & ~wrong & (size < rule["minItems"]), F.lit(f"has fewer than {rule['minItems']} items")))
            if "maxItems" in rule:
                checks.append(F.when(~absent & ~wrong & (size > rule["maxItems"]), F.lit(f"has more than {rule['maxItems']} items")))
        found += [F.struct(F.lit(f"$.{name}").alias("path"), c.alias("error")) for c in checks]
    return records.select("key", F.inline(F.array(*found))).where("error is not null")


def identity_violations(artifacts: DataFrame, datasets: DataFrame, target: str, least_version: int) -> DataFrame:
    """(artifact, reason) of artifacts that do not match the dataset that they name.

    Columns artifact, dataset, sha256, target of artifacts; dataset, sha256, label_version of datasets. The label
    version matters for artifacts of `target` alone.
    """
    j = artifacts.join(datasets.select("dataset", F.col("sha256").alias("have"), "label_version"), "dataset", "left")
    reason = F.when(F.col("have").isNull(), "missing_dataset").when(~F.col("have").eqNullSafe(F.col("sha256")), "other_bytes").when((F.col("target") == target) & (F.coalesce("label_version", F.lit(0)) < least_version), "old_labels")
    return j.select("artifact", reason.alias("reason")).where("reason is not null")


#: Setups whose rows carry a stop, and the one that carries an activation price; fixed values.
STOP_SETUPS = ["momentum_confirmed", "model_rebound_watch", "model_ranked_not_momentum_confirmed"]
REBOUND_SETUP = "model_rebound_watch"


def contract_violations(scorebook: DataFrame, research: DataFrame, decile: DataFrame, metrics: list[str], share: float = 0.1) -> DataFrame:
    """(date, rule, symbol): every row that breaks the contract between the published tables of a date.

    `scorebook` has date, symbol, rank, setup_type, stop_price, activation_price and the metrics; `research` date, symbol and
    the metrics; `decile` date and symbol. Rules: rank_missing (null or not finite), rank_sequence (not 1, 2, 3, ...), decile_missing
    and decile_extra (the published decile is the ranks up to the ceiling of share x rows), stop_missing (a setup of STOP_SETUPS or
    a name of the decile), activation_missing and activation_extra (just rebound rows have one), metric_mismatch (a research row
    disagrees with the scorebook row of its date; two nulls agree). An empty scorebook breaks no rule but decile_extra.
    """
    number = lambda c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double"))
    dates = Window.partitionBy("date")
    rank = number("rank")
    book = scorebook.withColumns({"_r": rank, "_n": F.count(F.lit(1)).over(dates), "_place": F.row_number().over(dates.orderBy(rank.asc_nulls_last(), "symbol"))})
    in_decile = F.coalesce(F.col("_r") <= F.ceil(F.col("_n") * F.lit(share)), F.lit(False))
    book = book.withColumn("_top", in_decile)
    rebound = F.coalesce(F.col("setup_type") == REBOUND_SETUP, F.lit(False))
    stops = F.coalesce(F.col("setup_type").isin(STOP_SETUPS), F.lit(False)) | F.col("_top")
    rules = {
        "rank_missing": F.col("_r").isNull(),
        "rank_sequence": F.col("_r") != F.col("_place"),
        "stop_missing": stops & number("stop_price").isNull(),
        "activation_missing": rebound & number("activation_price").isNull(),
        "activation_extra": ~rebound & number("activation_price").isNotNull(),
    }
    broken = book.select("date", "symbol", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))).alias("rule"))
    published = decile.select("date", "symbol").distinct().withColumn("_published", F.lit(True))
    sides = book.where("_top").select("date", "symbol").distinct().withColumn("_expected", F.lit(True)).join(published, ["date", "symbol"], "full")
    sides = sides.where("_expected is null or _published is null").select("date", "symbol", F.when(F.col("_published").isNull(), "decile_missing").otherwise("decile_extra").alias("rule"))
    other = research.select("date", "symbol", *[number(m).alias(f"_{m}") for m in metrics])
    unlike = F.lit(False)
    for m in metrics:
        unlike = unlike | ~F.col(f"_{m}").eqNullSafe(number(m))
    differ = scorebook.select("date", "symbol", *metrics).join(other, ["date", "symbol"]).where(unlike).select("date", "symbol", F.lit("metric_mismatch").alias("rule")).distinct()
    return broken.unionByName(sides).unionByName(differ).select("date", "rule", "symbol")
