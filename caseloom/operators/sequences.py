"""Ordered computations within a key: budgets, sliding counts, streaks, elapsed time.

Prefix budgets are window sums; greedy budgets, where a later small item may still fit,
fold over one key's ordered items (a message's items, bounded by the parse limits).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.plans.skew import join_unique


def _running(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def prefix_budget(df: DataFrame, keys: list[str], order: list[str], cost: Column, budget: int) -> DataFrame:
    """Rows before the first that overflows the budget, with the running cost and whether rows were left out."""
    w = _running(keys, order)
    whole = Window.partitionBy(*keys)
    cost = F.coalesce(cost, F.lit(0)).cast("long")
    run = df.withColumn("running", F.sum(cost).over(w))
    return run.withColumn("truncated", F.max("running").over(whole) > budget).where(F.col("running") <= budget)


def truncating_budget(df: DataFrame, keys: list[str], order: list[str], text: str, budget: int) -> DataFrame:
    """Texts cut to what is left of the budget; texts for which nothing is left are dropped."""
    n = F.coalesce(F.length(text), F.lit(0)).cast("long")
    before = F.sum(n).over(_running(keys, order)) - n
    left = F.greatest(F.lit(0), F.lit(budget) - before)
    return df.withColumn("kept_chars", F.least(n, left)).where("kept_chars > 0").withColumn(
        text, F.expr(f"substring({text}, 1, cast(kept_chars as int))")
    )


def greedy_budget(df: DataFrame, keys: list[str], order: list[str], item: str, cost: str, budget: int) -> DataFrame:
    """(keys, kept, used): items in order, each kept if it still fits; too large ones are skipped over."""
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(item).alias("__i"), F.coalesce(F.col(cost), F.lit(0)).cast("long").alias("__c"))))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.expr(f"cast(array() as array<{dict(df.dtypes)[item]}>)").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["__c"] <= budget
        return F.struct(
            F.when(fits, acc["used"] + x["__c"]).otherwise(acc["used"]).alias("used"),
            F.when(fits, F.concat(acc["kept"], F.array(x["__i"]))).otherwise(acc["kept"]).alias("kept"),
        )

    folded = df.groupBy(*keys).agg(F.aggregate(items, start, step).alias("__f"))
    return folded.select(*keys, F.col("__f.kept").alias("kept"), F.col("__f.used").alias("used"))


def call_budget(df: DataFrame, run: str, order: list[str], pair: list[str], special: Column, most: int, most_special: int) -> DataFrame:
    """First refusal of each call of a run, in order: repeated pair, then the special budget, then the budget.

    Refused calls use nothing up; hence a fold and not a window.
    """
    base = df.withColumn("__special", special)
    calls = F.array_sort(F.collect_list(F.struct(*order, F.concat_ws("|", *pair).alias("__pair"), "__special")))
    start = F.struct(
        F.lit(0).alias("n"), F.lit(0).alias("s"), F.expr("cast(array() as array<string>)").alias("seen"),
        F.expr("cast(array() as array<string>)").alias("said"),
    )

    def step(a: Column, x: Column) -> Column:
        why = (
            F.when(F.array_contains(a["seen"], x["__pair"]), "duplicate").when(x["__special"] & (a["s"] >= most_special), "special_budget")
            .when(a["n"] >= most, "budget").otherwise("ok")
        )
        ok = why == "ok"
        return F.struct(
            (a["n"] + ok.cast("int")).alias("n"), (a["s"] + (ok & x["__special"]).cast("int")).alias("s"),
            F.when(ok, F.concat(a["seen"], F.array(x["__pair"]))).otherwise(a["seen"]).alias("seen"),
            F.concat(a["said"], F.array(why)).alias("said"),
        )

    folded = base.groupBy(run).agg(F.aggregate(calls, start, step).alias("f"), calls.alias("c"))
    out = folded.select(run, F.explode(F.arrays_zip(F.col("c"), F.col("f.said"))).alias("x"))
    return out.select(run, *(F.col(f"x.c.{o}").alias(o) for o in order), F.col("x.said").alias("outcome"))


def sliding_count(df: DataFrame, key: str, ts: str, seconds: float, out: str, span: float = 86_400) -> DataFrame:
    """Rows of the key in the half-open last ``seconds`` up to and with each row.

    Keys are cut into spans of time; a row near a span's end is lent to the next spans
    that its window reaches, so a key of any length is spread over tasks.  Rows without a
    time count nothing and have 0.
    """
    width = int(max(span, seconds) * 1_000_000)
    reach = int(seconds * 1_000_000) - 1
    us = F.unix_micros(ts)
    timed = df.withColumn("__us", us).withColumn("__own", F.floor(us / width))
    # at most two spans, as a span is no shorter than the window
    lent = timed.withColumn("__span", F.explode(F.array_distinct(F.array("__own", F.floor((F.col("__us") + reach) / width)))))
    w = Window.partitionBy(key, "__span").orderBy("__us").rangeBetween(-reach, 0)
    counted = lent.withColumn(out, F.when(F.col("__us").isNull(), F.lit(0)).otherwise(F.count(F.lit(1)).over(w)))
    return counted.where("__span <=> __own").drop("__us", "__own", "__span")


def daily_count(df: DataFrame, key: str, ts: str, order: list[str], out: str) -> DataFrame:
    """Running number of the key's rows within the UTC day."""
    return df.withColumn("__d", F.to_date(ts)).withColumn(
        out, F.row_number().over(Window.partitionBy(key, "__d").orderBy(ts, *order))
    ).drop("__d")


def failure_streaks(df: DataFrame, key: str, order: list[str], failed: Column, out: str) -> DataFrame:
    """Consecutive failures up to each row; a success sets the count back to 0.

    ``order[0]`` is a time.  Streaks are counted within days; what a day inherits is the
    streak at the end of the days before it, a window over days and not over rows.
    """
    days = df.withColumn("__f", F.coalesce(failed, F.lit(False)).cast("int")).withColumn("__d", F.to_date(order[0]))
    w = _running([key, "__d"], order)
    island = days.withColumn("__i", F.sum(1 - F.col("__f")).over(w))
    inside = Window.partitionBy(key, "__d", "__i").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = island.withColumn("__s", F.sum("__f").over(inside))
    last = F.struct(*order)
    per = local.groupBy(key, "__d").agg(F.max_by("__s", last).alias("__end"), F.max("__i").alias("__ok"))
    before = Window.partitionBy(key).orderBy("__d").rowsBetween(Window.unboundedPreceding, -1)
    # days since the last success add up: number the stretches of days by successes before them
    stretch = per.withColumn("__g", F.coalesce(F.sum((F.col("__ok") > 0).cast("int")).over(before), F.lit(0)))
    within = Window.partitionBy(key, "__g").orderBy("__d").rowsBetween(Window.unboundedPreceding, -1)
    tail = F.last(F.when(F.col("__ok") > 0, F.col("__end")), True).over(before)
    carried = stretch.withColumn("__in", F.coalesce(tail, F.lit(0)) + F.coalesce(F.sum(F.when(F.col("__ok") == 0, F.col("__end"))).over(within), F.lit(0)))
    joined = local.join(carried.select(F.col(key).alias("__k"), F.col("__d").alias("__e"), "__in"), F.col(key).eqNullSafe(F.col("__k")) & F.col("__d").eqNullSafe(F.col("__e")))
    total = F.when(F.col("__i") == 0, F.col("__s") + F.col("__in")).otherwise(F.col("__s"))
    return joined.withColumn(out, total).drop("__f", "__d", "__i", "__s", "__k", "__e", "__in")


def elapsed_ms(df: DataFrame, key: str, ts: str, out: str) -> DataFrame:
    """Milliseconds since the key's first row; rows without a key or time have null."""
    firsts = df.groupBy(key).agg(F.min(F.unix_micros(ts)).alias("__first"), F.count(F.lit(1)).alias("__n"))
    total = df.count()
    timed = join_unique(df.where(F.col(key).isNotNull()), firsts, key, "__n", total)
    rest = df.where(F.col(key).isNull()).withColumn("__first", F.lit(None).cast("long")).withColumn("__n", F.lit(None).cast("long"))
    return timed.unionByName(rest).withColumn(out, (F.unix_micros(ts) - F.col("__first")) / 1000).drop("__first", "__n")


def sections(lines: DataFrame, file: str, no: str, line: str) -> DataFrame:
    """Mailbox lines with their message number: a separator counts at the start or after a blank line.

    Separators are left out; lines before the first separator get number 0.
    """
    w = Window.partitionBy(file).orderBy(no)
    prev = F.lag(line).over(w)
    sep = F.col(line).startswith("From ") & (prev.isNull() | (F.trim(prev) == ""))
    marked = lines.withColumn("__s", sep.cast("int"))
    return marked.withColumn("message_no", F.sum("__s").over(_running([file], [no]))).where("__s = 0").drop("__s")
