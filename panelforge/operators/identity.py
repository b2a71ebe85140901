"""Which security a printed symbol meant on a day: rename chains, identifiers, and what was active then."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.sources.shared import durable


def symbol_key(x: Column) -> Column:
    """A symbol in its one written form: upper case, class marks as dashes, stars, blanks and numeric endings gone."""
    x = F.translate(F.upper(F.trim(x)), "/*", "-")
    x = F.regexp_replace(x, r"\.\d+$", "")
    x = F.translate(x, ". ", "-")
    # fixed values
    return F.when(x == "BRKB", "BRK-B").when(x == "BFB", "BF-B").otherwise(x)


def label_key(label: Column) -> Column:
    """The symbol that a security's label carries; a six-digit month at its end tells recycled symbols apart."""
    return symbol_key(F.regexp_replace(label, r"-\d{6}$", ""))


def connected_names(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component): the least name reachable over (old, new) links, however long the chain.

    In a round every component is hooked onto the least one that any of its names is linked to, and then every name
    takes its component's component, so chains shorten by doubling. Each round is checkpointed; the loop ends when
    nothing moves. Null ends are ignored.
    """
    both = links.select(F.col("old").alias("id"), F.col("new").alias("to")).where("id is not null and to is not null")
    both = durable(both.union(both.select(F.col("to").alias("id"), F.col("id").alias("to"))).distinct())
    now = durable(both.groupBy("id").agg(F.min("to").alias("m")).select("id", F.least("id", "m").alias("component")))
    for _ in range(max_rounds):
        seen = both.join(now.select(F.col("id").alias("to"), F.col("component").alias("c")), "to").groupBy("id").agg(F.min("c").alias("c"))
        hook = now.join(seen, "id").groupBy("component").agg(F.min("c").alias("c")).select("component", F.least("component", "c").alias("root"))
        hooked = now.join(hook, "component").select("id", F.col("root").alias("component"))
        up = hooked.select(F.col("id").alias("component"), F.col("component").alias("root"))
        after = durable(hooked.join(up, "component", "left").select("id", F.coalesce("root", "component").alias("component")))
        moved = after.join(now.withColumnRenamed("component", "before"), "id").where("component != before")
        now = after
        if moved.isEmpty():
            return now
    raise RuntimeError(f"names did not settle in {max_rounds} rounds")


def resolve_identities(asked: DataFrame, securities: DataFrame, renames: DataFrame, isin_labels: DataFrame) -> DataFrame:
    """(symbol, isin, date, candidates, security): the one active security a symbol and identifier meant, or null.

    `securities`: label, start, end (end excluded, null: open); `renames`: old, new; `isin_labels`: isin, label. Candidates
    by symbol are the securities active on the day whose key is joined to the symbol's by any chain of renames. A known
    identifier narrows them to its own active labels, or names them alone where the symbol gives none; it never brings
    back a security that was not active. Several candidates are ambiguous and resolve to none. Every distinct (chain,
    identifier, day) is answered once, and an identifier's labels meet only the days on which they are the answer.
    """
    links = renames.select(symbol_key(F.col("old")).alias("old"), symbol_key(F.col("new")).alias("new"))
    names = connected_names(links)
    rooted = lambda df, key, out: df.join(names.select(F.col("id").alias(key), F.col("component").alias("_c")), key, "left").withColumn(out, F.coalesce("_c", key)).drop("_c")
    questions = asked.select("symbol", "isin", "date").distinct().withColumn("key", symbol_key(F.col("symbol")))
    questions = rooted(questions, "key", "root").select("symbol", "isin", "date", "root")
    known = durable(rooted(securities.select("label", "start", "end", label_key(F.col("label")).alias("key")), "key", "root").select("label", "start", "end", "root"))
    active = (F.col("date") >= F.col("start")) & (F.col("end").isNull() | (F.col("date") < F.col("end")))
    labels = F.array_sort(F.collect_set("label"))
    none = F.array().cast("array<string>")
    # symbols of a chain mean the same on a day: a chain's day is looked up once
    once = durable(questions.select("root", "isin", "date").distinct())
    by_root = once.select("root", "date").distinct().join(known, "root").where(active).groupBy("root", "date").agg(labels.alias("s"))
    asked_once = durable(once.join(by_root, ["root", "date"], "left").select("root", "isin", "date", F.coalesce("s", none).alias("s")))
    bare = asked_once.where("isin is null").select("root", "isin", "date", F.col("s").alias("candidates"))
    # of an identifier's securities only those of the chain can narrow what the symbol gives
    named = isin_labels.select("isin", "label").distinct()
    own = named.join(known.select("label", "root"), "label").groupBy("isin", "root").agg(F.collect_set("label").alias("own"))
    has_isin = named.select("isin").distinct().withColumn("_known", F.lit(True))
    both = asked_once.where("isin is not null").join(has_isin, "isin", "left").join(own, ["isin", "root"], "left")
    # an identifier's whole list is made for the days on which it is the answer, and for no others
    alone = (F.size("s") == 0) & F.col("_known").isNotNull()
    by_isin = both.where(alone).select("isin", "date").distinct().join(named, "isin").join(known.select("label", "start", "end"), "label").where(active).groupBy("isin", "date").agg(labels.alias("i"))
    narrowed = F.when(F.col("_known").isNull(), F.col("s")).otherwise(F.array_intersect("s", F.coalesce("own", none)))
    met = both.where(~alone).select("root", "isin", "date", narrowed.alias("candidates"))
    lists = both.where(alone).join(by_isin, ["isin", "date"], "left").select("root", "isin", "date", F.coalesce("i", none).alias("candidates"))
    answers = bare.unionByName(met).unionByName(lists)
    same = reduce(lambda a, b: a & b, [F.col(f"q.{c}").eqNullSafe(F.col(f"a.{c}")) for c in ("root", "isin", "date")])
    df = questions.alias("q").join(answers.alias("a"), same)
    candidates = F.col("a.candidates")
    return df.select("q.symbol", "q.isin", "q.date", candidates.alias("candidates"), F.when(F.size(candidates) == 1, candidates[0]).alias("security"))
