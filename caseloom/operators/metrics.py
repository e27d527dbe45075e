"""Classification, latency and coverage metrics that keep null apart from zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.plans.staging import staged

#: The labels, in the order that breaks ties.
LABELS = ("spear_phishing", "phishing", "fraude", "menace", "spam", "legitime")
MALICIOUS = LABELS[:4]
BENIGN = ("legitime", "spam")


def restricted(label: Column) -> Column:
    """A label of the taxonomy, or null."""
    return F.when(label.isin(*LABELS), label)


def ratio(top: Column, bottom: Column) -> Column:
    """Null where the denominator is 0, so that an undefined share is never a 0."""
    return F.round(top / F.nullif(bottom, F.lit(0)), 6)


def _label_rows(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(LABELS)], "label_no int, label string")


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(truth, one count per label, abstained): all labels present, null prediction = abstention."""
    rows = df.select(restricted(F.col(truth)).alias("truth"), restricted(F.col(predicted)).alias("p")).where("truth is not null")
    counts = rows.groupBy("truth").agg(
        *(F.count_if(F.col("p") == x).alias(f"as_{x}") for x in LABELS), F.count_if(F.col("p").isNull()).alias("abstained")
    )
    full = _label_rows(df).select(F.col("label").alias("truth")).join(counts, "truth", "left")
    return full.na.fill(0)


def classification(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Per label: support, predicted, hits, abstentions, precision, recall, F1.

    Never predicted but supported: precision 0; without support: precision, recall and
    F1 are null.
    """
    rows = df.select(restricted(F.col(truth)).alias("t"), restricted(F.col(predicted)).alias("p")).where("t is not null")
    both = rows.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.lit(1).alias("s"), (F.col("p") == F.col("t")).cast("int").alias("h"), F.col("p").isNull().cast("int").alias("a"), F.lit(0).alias("q")), F.struct(F.col("p").alias("label"), F.lit(0).alias("s"), F.lit(0).alias("h"), F.lit(0).alias("a"), F.lit(1).alias("q")))).alias("x")).select("x.*")
    counts = both.where("label is not null").groupBy("label").agg(
        F.sum("s").alias("support"), F.sum("q").alias("predicted"), F.sum("h").alias("hits"), F.sum("a").alias("abstained")
    )
    full = _label_rows(df).join(counts, "label", "left").na.fill(0, ["support", "predicted", "hits", "abstained"])
    s, q, h = (F.col(c) for c in ("support", "predicted", "hits"))
    precision = F.when(s == 0, F.lit(None)).when(q == 0, F.lit(0.0)).otherwise(h / F.nullif(q, F.lit(0)))
    recall = h / F.nullif(s, F.lit(0))
    f1 = F.when(s == 0, F.lit(None)).when(h == 0, F.lit(0.0)).otherwise(2 * h / F.nullif(s + q, F.lit(0)))
    return full.select(
        "label", "support", "predicted", "hits", "abstained",
        F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"),
    )


def macro_f1(report: DataFrame) -> DataFrame:
    """Mean F1 over supported labels, and over all six only if all six have support."""
    supported = F.count_if(F.col("support") > 0)
    mean = F.avg(F.when(F.col("support") > 0, F.col("f1")))
    return report.agg(
        supported.alias("supported"), F.round(mean, 6).alias("macro_f1_supported"),
        F.round(F.when(supported == len(LABELS), mean), 6).alias("macro_f1_all"),
        F.when(supported < len(LABELS), F.lit("labels without support")).alias("reason"),
    )


def false_positives(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Of legitimate records: called malicious, called anything else, and abstained."""
    p = restricted(F.col(predicted))
    n = F.count(F.lit(1))
    legit = df.where(F.col(truth) == "legitime")
    strict, bad, none = F.count_if(p.isNotNull() & (p != "legitime")), F.count_if(p.isin(*MALICIOUS)), F.count_if(p.isNull())
    return legit.agg(
        n.alias("support"), strict.alias("not_legitime"), bad.alias("malicious"), none.alias("abstained"),
        ratio(strict, n).alias("strict_rate"), ratio(bad, n).alias("malicious_rate"), ratio(none, n).alias("abstention_rate"),
    )


def paired(df: DataFrame, truth: str, before: str, after: str) -> DataFrame:
    """Right and wrong before and after: rr, rw, wr, ww, changed (wr + rw), any difference."""
    t, b, a = (restricted(F.col(c)) for c in (truth, before, after))
    br, ar = F.coalesce(b == t, F.lit(False)), F.coalesce(a == t, F.lit(False))
    return df.where(t.isNotNull()).agg(
        F.count_if(br & ar).alias("rr"), F.count_if(br & ~ar).alias("rw"), F.count_if(~br & ar).alias("wr"),
        F.count_if(~br & ~ar).alias("ww"), F.count_if(br != ar).alias("n_changed"), F.count_if(~b.eqNullSafe(a)).alias("n_verdict_diff"),
    )


def usable(value: Column) -> Column:
    """Finite values from 0 on; null for all others."""
    return F.when(value.isNotNull() & ~F.isnan(value) & (value >= 0) & (F.abs(value) != float("inf")), value)


def stats(value: Column) -> list[Column]:
    """n, mean, greatest and total of the usable values; nulls for none.  Medians: ``medians``."""
    v = usable(value)
    return [F.count(v).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.max(v).alias("max"), F.round(F.sum(v), 4).alias("total")]


def ranked_values(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """(groups, value, n, upto, total): rows of a value, rows up to it in order, rows of the group.

    No group is sorted in one task: values are counted, cut into ranges by value, and
    ranks are taken within a range; the counts of the ranges (groups x ranges rows) give
    the offsets.  The ranges are written once, so that both readings see the same ones.
    """
    v = usable(F.col(value).cast("double"))
    counts = df.select(*groups, v.alias("__v")).where("__v is not null").groupBy(*groups, "__v").agg(F.count(F.lit(1)).alias("n"))
    spans = staged(counts.repartitionByRange(*groups, "__v").withColumn("__range", F.spark_partition_id()), "ranges")
    sums = spans.groupBy(*groups, "__range").agg(F.sum("n").alias("__s"))
    w = Window.partitionBy(*groups)
    before = F.coalesce(F.sum("__s").over(w.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(*(F.col(g).alias(f"__{g}") for g in groups), F.col("__range").alias("__r"), before.alias("__before"), F.sum("__s").over(w).alias("total"))
    same = F.col("__range") == F.col("__r")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"__{g}"))
    run = F.sum("n").over(Window.partitionBy(*groups, "__range").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = spans.withColumn("__c", run).join(offsets, same)
    return ranked.select(*groups, F.col("__v").alias(value), "n", (F.col("__c") + F.col("__before")).alias("upto"), "total")


def at_rank(rank: Column) -> Column:
    """Whether the value of a ranked row is the one at ``rank`` (from 1)."""
    return (F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank)


def nearest_rank(df: DataFrame, groups: list[str], value: str, share: float, out: str) -> DataFrame:
    """Per group the value at rank ceil(share * n) of the sorted usable values."""
    at = ranked_values(df, groups, value).where(at_rank(F.ceil(F.col("total") * share)))
    return at.select(*groups, F.col(value).alias(out))


def medians(df: DataFrame, groups: list[str], value: str, out: str = "median") -> DataFrame:
    """Per group the middle of the sorted usable values, or the mean of the two in the middle."""
    low, high = F.ceil(F.col("total") / 2), F.floor(F.col("total") / 2) + 1
    mid = ranked_values(df, groups, value).where(at_rank(low) | at_rank(high))
    return mid.groupBy(*groups).agg(F.round((F.min(value) + F.max(value)) / 2, 6).alias(out))


def tool_coverage(results: DataFrame, tool: str, status: str, reason: str, requests: str) -> DataFrame:
    """Counts by tool and, within tools, by status and by reason; one row per dimension value."""
    sets = results.groupingSets([[F.col(tool)], [F.col(tool), F.col(status)], [F.col(tool), F.col(reason)]], tool, status, reason).agg(
        F.count(F.lit(1)).alias("n"), F.sum(requests).alias("requests"), F.count_if(F.col(status) == "ok").alias("ok"),
        F.grouping(status).alias("gs"), F.grouping(reason).alias("gr"),
    )
    level = F.when((F.col("gs") == 1) & (F.col("gr") == 1), "tool").when(F.col("gs") == 0, "status").otherwise("reason")
    return sets.select(tool, level.alias("level"), F.coalesce(F.when(F.col("gs") == 0, F.col(status)), F.when(F.col("gr") == 0, F.col(reason))).alias("value"), "n", "requests", "ok")


def overall_status(results: DataFrame, keys: list[str], status: str) -> DataFrame:
    """One status of several: any ok, else any unavailable, else all not found, else skipped."""
    s = F.col(status)
    return results.groupBy(*keys).agg(
        F.when(F.bool_or(s == "ok"), "ok").when(F.bool_or(s == "unavailable"), "unavailable")
        .when(F.every(s == "not_found"), "not_found").otherwise("skipped").alias("overall"),
        F.count(F.lit(1)).alias("n"),
    )


def verdict(probabilities: list[str]) -> tuple[Column, Column, Column]:
    """(label, confidence, margin) of a probability vector in taxonomy order; ties go to the earlier label."""
    ps = [F.col(p) for p in probabilities]
    top = F.greatest(*ps)
    label = F.lit(None).cast("string")
    for p, name in reversed(list(zip(ps, LABELS, strict=True))):
        label = F.when(p == top, F.lit(name)).otherwise(label)
    ordered = F.sort_array(F.array(*ps), asc=False)
    return label, top, ordered[0] - ordered[1]


def vector_ok(probabilities: list[str]) -> Column:
    """True where all are finite, within 0..1 and sum to 1 within 1e-6; vectors are never repaired."""
    ps = [F.col(p) for p in probabilities]
    each = [p.isNotNull() & ~F.isnan(p) & p.between(0, 1) for p in ps]
    ok, total = each[0], ps[0]
    for e, p in zip(each[1:], ps[1:], strict=True):
        ok, total = ok & e, total + p
    return F.coalesce(ok & (F.abs(total - 1) <= 1e-6), F.lit(False))


# ---- costs, usage and phases ------------------------------------------------------
def call_cost(input_tokens: Column, cached_tokens: Column, output_tokens: Column, reported: Column, prices: tuple[float, float, float]) -> tuple[Column, Column]:
    """(cost, source) of one model call: what the provider reported, else tokens times prices a million.

    Cached tokens are kept within 0 and the input's; a call with no known input or output
    count has no cost (null, ``unknown``), which is never a cost of 0.
    """
    fresh, cached_price, out_price = prices
    cached = F.least(F.greatest(F.coalesce(cached_tokens, F.lit(0)), F.lit(0)), input_tokens)
    estimate = ((input_tokens - cached) * fresh + cached * cached_price + output_tokens * out_price) / 1_000_000
    cost = F.coalesce(reported.cast("double"), estimate)
    source = F.when(reported.isNotNull(), "provider_reported").when(estimate.isNotNull(), "estimated").otherwise("unknown")
    return cost, source


def run_costs(calls: DataFrame, run: str, cost: str, source: str) -> DataFrame:
    """(run, calls, known, amount, status): a run is complete only if every call's cost is known."""
    known, n = F.count(cost), F.count(F.lit(1))
    reported = F.count_if(F.col(source) == "provider_reported")
    status = F.when(known == 0, "unknown").when(known < n, "partial").when(reported == n, "provider_reported").otherwise("estimated")
    return calls.groupBy(run).agg(n.alias("calls"), known.alias("known"), F.round(F.sum(cost), 8).alias("amount"), status.alias("status"))


def cost_total(runs: DataFrame) -> DataFrame:
    """Over runs: known amounts, their mean over runs with any, and the mean over all only if none is missing."""
    n, known = F.count(F.lit(1)), F.count("amount")
    whole = F.count_if(F.col("status").isin("unknown", "partial")) == 0
    return runs.agg(
        n.alias("runs"), known.alias("with_amount"), F.round(F.sum("amount"), 6).alias("amount"), F.round(F.avg("amount"), 8).alias("mean_known"),
        F.round(F.when(whole, F.sum("amount") / n), 8).alias("mean_all"), F.when(known == 0, "unknown").when(whole, "complete").otherwise("partial").alias("status"),
    )


def phase_validity(calls: DataFrame, run: str, phase: str, order: str, valid: str, retry: str, error: str) -> DataFrame:
    """Per phase: calls, retries, errors, and runs whose last call of the phase was valid; ``order`` is to be unique within a run's phase."""
    last = calls.groupBy(run, phase).agg(
        F.max_by(valid, order).alias("ok"), F.count(F.lit(1)).alias("calls"), F.count_if(retry).alias("retries"), F.count_if(F.col(error).isNotNull()).alias("errors")
    )
    n = F.count(F.lit(1))
    return last.groupBy(phase).agg(
        n.alias("runs"), F.count_if("ok").alias("valid_runs"), ratio(F.count_if("ok"), n).alias("validity"), F.sum("calls").alias("calls"), F.sum("retries").alias("retries"), F.sum("errors").alias("errors"),
    )


def proposal_counts(records: DataFrame, key: str, proposed: str, invalid: str) -> DataFrame:
    """Candidates proposed and refused (sizes of array columns), records with any, and the share refused (null for none)."""
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    return records.select(key, size(proposed).alias("p"), size(invalid).alias("i")).agg(
        F.sum("p").alias("proposals"), F.sum("i").alias("invalid"), F.count_if(F.col("p") > 0).alias("records_with_any"), ratio(F.sum("i"), F.sum("p")).alias("invalid_rate")
    )


def action_coverage(df: DataFrame, action: str, truth: str) -> DataFrame:
    """(action, rows, share, one count a label, unlabelled): how often each action was taken, and on what."""
    t = restricted(F.col(truth))
    n = F.count(F.lit(1))
    rows = df.groupBy(action).agg(n.alias("rows_n"), *(F.count_if(t == x).alias(f"on_{x}") for x in LABELS), F.count_if(t.isNull()).alias("unlabelled"))
    return rows.withColumn("share", ratio(F.col("rows_n"), F.sum("rows_n").over(Window.partitionBy())))  # a row an action


def usage_totals(records: DataFrame, groups: list[str], flags: list[str], amounts: list[str]) -> DataFrame:
    """Roll-up of usage: rows, rows with each flag, sums of the known amounts and how many are unknown, with totals."""
    return records.rollup(*groups).agg(
        F.count(F.lit(1)).alias("rows_n"), *(F.count_if(F.col(f)).alias(f"with_{f}") for f in flags),
        *(x for a in amounts for x in (F.sum(a).alias(f"sum_{a}"), F.count_if(F.col(a).isNull()).alias(f"unknown_{a}"))), F.grouping_id().alias("level"),
    )


def issue_counts(issues: DataFrame, code: str, severity: str, wanted: str) -> DataFrame:
    """(code, n) of the issues of one severity, most frequent first where listed."""
    return issues.where(F.col(severity) == wanted).groupBy(code).agg(F.count(F.lit(1)).alias("n"))


def variant_block(df: DataFrame, variant: str, valid: str, excluded: str, cost: str, latency: str) -> DataFrame:
    """Per variant: rows, valid rows that are not excluded, and means of cost and latency over those only."""
    use = F.col(valid) & ~F.coalesce(F.col(excluded), F.lit(False))
    mean = lambda c: F.round(F.avg(F.when(use, F.col(c))), 6)
    return df.groupBy(variant).agg(
        F.count(F.lit(1)).alias("rows_n"), F.count_if(use).alias("used"), F.count_if(F.coalesce(F.col(excluded), F.lit(False))).alias("excluded_n"), mean(cost).alias("mean_cost"), mean(latency).alias("mean_latency"),
    )


def limitations(facts: DataFrame) -> DataFrame:
    """(no, limitation): what the numbers of one row of facts do not allow to say, in a fixed order."""
    wanted = (("supported", F.col("supported") < len(LABELS), "labels without support"), ("unknown_cost", F.col("unknown_cost") > 0, "costs of some runs are unknown"),
              ("abstained", F.col("abstained") > 0, "some records were not judged"), ("synthetic", F.col("synthetic") > 0, "some records are synthetic"))
    said = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(i).alias("no"), F.lit(text).alias("limitation"))) for i, (_, c, text) in enumerate(wanted))))
    return facts.select(F.explode(said).alias("x")).select("x.*")
