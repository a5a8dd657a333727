"""Reading sources and registers: filled shares, contexts, link runs, facts at a date, what columns offer, and findings in lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def filled_share(shares: DataFrame, years: list[int], *, sd: float = 0.02) -> DataFrame:
    """(u, year, share, sd, extended): missing years take the place's mean; their uncertainty grows with the distance to the nearest known year.

    shares: u, year, share. The growth is that of a random walk: sd times the root of the distance.
    """
    grid = shares.select("u").distinct().withColumn("year", F.explode(F.array(*[F.lit(int(y)) for y in years])))
    rows = grid.join(shares, ["u", "year"], "left")
    known = F.when(F.col("share").isNotNull(), F.col("year"))
    before = W.partitionBy("u").orderBy("year").rowsBetween(W.unboundedPreceding, 0)
    after = W.partitionBy("u").orderBy("year").rowsBetween(0, W.unboundedFollowing)
    rows = rows.withColumns({"_b": F.max(known).over(before), "_a": F.min(known).over(after), "_m": F.avg("share").over(W.partitionBy("u"))})
    gap = F.least(F.col("year") - F.col("_b"), F.col("_a") - F.col("year"))
    return rows.select("u", "year", F.coalesce("share", "_m").alias("share"), F.when(F.col("share").isNull(), sd * F.sqrt(gap.cast("double"))).otherwise(F.lit(0.0)).alias("sd"), F.col("share").isNull().alias("extended"))


def context_value(context: DataFrame, denominator: DataFrame, places: DataFrame, window: Column) -> DataFrame:
    """(u, value) for every place: a context's sum over its denominator's in a window; null where there is none. Both: u, year, value."""
    c = context.where(window).groupBy("u").agg(F.sum("value").alias("_c"))
    d = denominator.where(window).groupBy("u").agg(F.sum("value").alias("_d"))
    return places.join(c, "u", "left").join(d, "u", "left").select("u", F.when(F.col("_d") > 0, F.coalesce("_c", F.lit(0.0)) / F.col("_d")).alias("value"))


def source_year(events: DataFrame, links: DataFrame, year: int, *, prefix: int = 3) -> DataFrame:
    """Events of an independent source in a year by place and code prefix: y, and k of them linked. events: id, u, year, code; links: id."""
    rows = events.where(F.col("year") == year).join(links.select("id").distinct().withColumn("_linked", F.lit(1)), "id", "left")
    return rows.groupBy("u", F.substring("code", 1, prefix).alias("code")).agg(F.count("*").alias("y"), F.count("_linked").alias("k"))


def covering_pairs(runs: DataFrame) -> DataFrame:
    """Pairs (l, r) of all runs that cover a side, each with its largest probability and the number of runs that found it."""
    return runs.groupBy("l", "r").agg(F.max("p_match").alias("p_match"), F.count_distinct("run").alias("runs"))


def facts_at(facts: DataFrame, when: Column, *, id: str = "id", at: str = "at") -> DataFrame:
    """The latest facts of each establishment that were known at a date."""
    w = W.partitionBy(id).orderBy(F.desc(at), F.xxhash64(*facts.columns))
    return facts.where(F.col(at) <= when).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def code_attributes(cells: DataFrame) -> DataFrame:
    """Per code the ages and sexes that it occurs with. cells: code, age, sex."""
    return cells.groupBy("code").agg(F.min("age").alias("least_age"), F.max("age").alias("most_age"), F.array_sort(F.collect_set("sex")).alias("sexes"))


def list_fields(cells: DataFrame, concepts: DataFrame) -> DataFrame:
    """Counts of concept lists: fields that hold codes of several blocks. concepts: concept, code (a prefix ends with %)."""
    exact = concepts.where(~F.col("code").endswith("%"))
    prefixes = concepts.where(F.col("code").endswith("%")).select("concept", F.expr("left(code, length(code) - 1)").alias("_p"), (F.length("code") - 1).alias("_n"))
    lengths = [r["_n"] for r in prefixes.select("_n").distinct().collect()]  # lengths of declared prefixes, a handful
    found = cells.join(exact, "code").select("concept", "u", "year", "y", "code")
    for n in lengths:
        rows = cells.withColumn("_p", F.expr(f"left(code, {n})")).join(prefixes.where(F.col("_n") == n).select("concept", "_p"), "_p")
        found = found.union(rows.select("concept", "u", "year", "y", "code"))
    return found.dropDuplicates(["concept", "u", "year", "code"]).groupBy("concept", "u", "year").agg(F.sum("y").alias("y"))


def exchanging_pools(moves: DataFrame, *, least: float = 0.2) -> DataFrame:
    """Fields and the pools with which they exchange at least this share of their events. moves: before, after, n."""
    total = moves.groupBy("before").agg(F.sum("n").alias("_t"))
    rows = moves.join(total, "before").withColumn("share", F.col("n") / F.col("_t"))
    return rows.where((F.col("before") != F.col("after")) & (F.col("share") >= least)).select("before", "after", "share")


def missing_shares(records: DataFrame, columns: list[str], *, by: str = "year") -> DataFrame:
    """(by, column, missing): the share of records without a value, for every column."""
    per = records.groupBy(by).agg(*[F.avg((F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).cast("int")).alias(c) for c in columns])
    return per.select(by, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in columns])).alias("_x")).select(by, "_x.*")


def value_shares(records: DataFrame, column: str) -> DataFrame:
    """Values of a column that make share fields: all but the commonest, with the share of records each holds."""
    per = records.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    top = per.agg(F.max_by("value", F.struct("n", "value")).alias("_top"), F.sum("n").alias("_all"))
    return per.crossJoin(top).where("value <> _top").select("value", (F.col("n") / F.col("_all")).alias("share"))  # top is one row


def by_value(cells: DataFrame, value: str) -> DataFrame:
    """Observed and expected counts of each value in each place, at all places' composition. cells: u, value, y."""
    per = cells.groupBy("u", value).agg(F.sum("y").alias("observed"))
    total = per.agg(F.sum("observed").alias("_all"))
    mu = F.sum("observed").over(W.partitionBy("u")) * F.sum("observed").over(W.partitionBy(value)) / F.col("_all")
    rows = per.crossJoin(total).withColumn("expected", mu)  # total is one row
    return rows.select("u", value, "observed", "expected", ((F.col("observed") + 0.5) / (F.col("expected") + 0.5)).alias("ratio"))


def related_fields(cells: DataFrame, locus: Column) -> DataFrame:
    """Other fields at a locus: observed, expected and ratio of each. cells: field, u, year, y, mu."""
    per = cells.where(locus).groupBy("field").agg(F.sum("y").alias("y"), F.sum("mu").alias("mu"))
    return per.withColumn("ratio", (F.col("y") + 0.5) / (F.col("mu") + 0.5))


def declared_tests(cells: DataFrame, loci: DataFrame) -> DataFrame:
    """One test for each declared locus (id, u, first, last): counts, expectation, ratio and gamma-tail z."""
    from cellweave.operators.explain import tail_z

    rows = cells.join(F.broadcast(loci), "u").where(F.col("year").between(F.col("first"), F.col("last")))  # declared by hand
    per = rows.groupBy("id").agg(F.sum("y").alias("y"), F.sum("mu").alias("mu"), F.sum(F.col("mu") + F.col("mu") ** 2 / F.col("phi")).alias("_v"))
    return per.select("id", "y", "mu", ((F.col("y") + 0.5) / (F.col("mu") + 0.5)).alias("ratio"), tail_z(F.col("y"), F.col("mu"), F.col("_v")).alias("z"))


def find_leads(register: DataFrame, *, cls: str | None = None, tier: int | None = None, place: int | None = None, code: str | None = None, first: int | None = None, last: int | None = None, least_rank: float | None = None) -> DataFrame:
    """Leads that pass every filter given; years filter leads that overlap them."""
    rows = register
    for given, keep in ((cls, lambda: F.col("class") == cls), (tier, lambda: F.col("tier") >= tier), (place, lambda: F.col("place") == place), (code, lambda: F.col("code").startswith(code)), (first, lambda: F.col("last") >= first), (last, lambda: F.col("first") <= last), (least_rank, lambda: F.col("rank") >= least_rank)):
        if given is not None:
            rows = rows.where(keep())
    return rows


def with_siblings(register: DataFrame) -> DataFrame:
    """Each lead with the number of others of its place and the one of highest rank among them."""
    w = W.partitionBy("place").orderBy(F.desc("rank"), "id")
    rows = register.withColumns({"_n": F.row_number().over(w), "siblings": F.count("*").over(W.partitionBy("place")) - 1})
    rows = rows.withColumns({"_1": F.first("id").over(w), "_2": F.max(F.when(F.col("_n") == 2, F.col("id"))).over(W.partitionBy("place"))})
    return rows.withColumn("sibling", F.when(F.col("_n") == 1, F.col("_2")).otherwise(F.col("_1"))).drop("_n", "_1", "_2")


def class_counts(register: DataFrame, by: str) -> DataFrame:
    """Leads by class and another column, and how many of them have been replicated."""
    return register.groupBy("class", by).agg(F.count("*").alias("leads"), F.count(F.when(F.col("tier") >= 1, 1)).alias("replicated"))


def report_lines(register: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` leads of highest rank as lines of a table in Markdown."""
    top = register.orderBy(F.desc("rank"), "id").limit(limit)
    line = F.concat(F.lit("| "), F.concat_ws(" | ", F.col("id").cast("string"), F.col("place").cast("string"), F.col("class"), F.concat_ws("-", F.col("first").cast("string"), F.col("last").cast("string"))), F.lit(" |"))
    return top.select("id", line.alias("line"))


def agreement(flags: DataFrame, methods: list[str]) -> DataFrame:
    """How many units each combination of methods finds. flags: a boolean for each method."""
    names = F.array_join(F.array_compact(F.array(*[F.when(F.col(m), F.lit(m)) for m in methods])), "+")
    return flags.withColumn("methods", names).groupBy("methods").agg(F.count("*").alias("units"))


def closed_weeks(events: DataFrame, n: int, *, time: str = "ts") -> DataFrame:
    """Counts of the last ``n`` weeks (from Sunday) that were over at the latest event."""
    day = F.to_date(time)
    rows = events.withColumn("week_start", F.date_sub(day, F.dayofweek(day) - 1))
    last = rows.agg(F.max(day).alias("_last"))
    rows = rows.crossJoin(last).where("date_add(week_start, 6) < _last")  # one row
    end = rows.agg(F.max("week_start").alias("_end"))
    rows = rows.crossJoin(end).where(F.col("week_start") > F.date_sub("_end", 7 * n))  # one row
    return rows.groupBy("week_start").agg(F.count("*").alias("y"))


def temporal_halves(cells: DataFrame, by: str) -> DataFrame:
    """Log ratios of both halves of the years, split at the middle, and whether they have one sign. cells: by, year, y, mu."""
    middle = cells.agg(((F.min("year") + F.max("year")) / 2).alias("_mid"))
    rows = cells.crossJoin(middle).withColumn("half", (F.col("year") > F.col("_mid")).cast("int"))  # one row
    s = lambda c, h: F.sum(F.when(F.col("half") == h, F.col(c)).otherwise(0))
    per = rows.groupBy(by).agg(*[F.log((s("y", h) + 0.5) / (s("mu", h) + 0.5)).alias(k) for h, k in ((0, "early"), (1, "late"))])
    return per.withColumn("agree", F.signum("early") == F.signum("late"))


def lagged_pair(series: DataFrame, a: str, b: str, lags: int) -> DataFrame:
    """Correlation of two fields over places and years with b leading by 0 to ``lags`` years. series: field, u, year, x."""
    x = series.where(F.col("field") == a).select("u", "year", F.col("x").alias("_a"))
    y = series.where(F.col("field") == b).withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(lags)))).select("u", (F.col("year") + F.col("lag")).alias("year"), "lag", F.col("x").alias("_b"))
    return x.join(y, ["u", "year"]).groupBy("lag").agg(F.corr("_a", "_b").alias("rho"), F.count("*").alias("n"))
