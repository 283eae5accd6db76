"""Detection metrics over tables of (label, pred, prob): counts, rates, curves, sweeps, class metrics, intervals, verdicts.

Curves first reduce the table to one row a distinct score, so the windows that accumulate over scores see the distinct
scores alone, and then to running totals by score ranges, so no single task has to order them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewright.operators.profile import beside, exact_percentiles

EPS = 1e-9


def confusion(df: DataFrame, by: list[str] | None = None, label: str = "label", pred: str = "pred") -> DataFrame:
    """tp, fp, tn, fn and n, by the given columns."""
    y, p = F.col(label), F.col(pred)
    cell = lambda a, b, name: F.sum(F.when((y == a) & (p == b), 1).otherwise(0)).alias(name)
    return df.groupBy(*(by or [])).agg(cell(1, 1, "tp"), cell(0, 1, "fp"), cell(0, 0, "tn"), cell(1, 0, "fn"), F.count("*").alias("n"))


def rates(counts: DataFrame, guard: str = "epsilon") -> DataFrame:
    """Adds precision, recall, f1, fpr, fnr and accuracy. guard: epsilon is added to denominators, or they are 1 at least."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    over = (lambda a, b: a / (b + EPS)) if guard == "epsilon" else (lambda a, b: a / F.greatest(b, F.lit(1.0)))
    precision, recall = over(tp, tp + fp), over(tp, tp + fn)
    f1 = 2 * precision * recall / (precision + recall + EPS)
    if guard != "epsilon":
        f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return counts.withColumns(
        {"precision": precision, "recall": recall, "f1": f1, "fpr": over(fp, fp + tn), "fnr": over(fn, fn + tp), "accuracy": over(tp + tn, tp + tn + fp + fn)}
    )


def binary_metrics(df: DataFrame, by: list[str] | None = None, guard: str = "epsilon") -> DataFrame:
    return rates(confusion(df, by), guard)


def macro_f1(df: DataFrame) -> DataFrame:
    """F1 of either label, their mean, and accuracy; 0 where a denominator is."""
    c = confusion(df)
    f1 = lambda a, b, d: F.when(2 * a + b + d > 0, 2 * a / (2 * a + b + d)).otherwise(0.0)
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    return c.select(
        f1(tn, fn, fp).alias("f1_0"), f1(tp, fp, fn).alias("f1_1"), ((f1(tn, fn, fp) + f1(tp, fp, fn)) / 2).alias("macro_f1"),
        ((tp + tn) / F.greatest(F.col("n"), F.lit(1))).alias("accuracy"),
    )


def per_class(df: DataFrame, cls: str = "attack_class") -> DataFrame:
    """Metrics of each class among its own rows and all benign rows; a benign row of another class counts in both.

    Benign rows are not copied to every class: their two counts are added to each class's.
    """
    own = confusion(df.filter(F.col(cls) != "benign"), [cls])
    benign = confusion(df.filter("label = 0")).select(F.col("fp").alias("bfp"), F.col("tn").alias("btn"))
    met = own.crossJoin(F.broadcast(benign))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    counts = met.select(cls, "tp", (F.col("fp") + zero("bfp")).alias("fp"), (F.col("tn") + zero("btn")).alias("tn"), "fn", (F.col("n") + zero("bfp") + zero("btn")).alias("n"))
    only = confusion(df.filter("label = 0")).filter("n > 0").select(F.lit("benign").alias(cls), "tp", "fp", "tn", "fn", "n")
    return rates(counts.unionByName(only))


def by_score(df: DataFrame, score: str = "prob", label: str = "label") -> DataFrame:
    """Positives and negatives of each distinct score."""
    return df.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("pos"), F.sum((F.col(label) == 0).cast("long")).alias("neg")
    )


#: Ranges of scores that are summed before running totals are taken over them.
RANGES = 1024


def cumulated(df: DataFrame, score: str = "prob", label: str = "label") -> DataFrame:
    """by_score with tp and fp: positives and negatives of this score and all larger ones.

    Scores are dealt to RANGES equal ranges between the smallest and the largest; running totals inside a range are
    separate tasks, and the totals of the ranges themselves are RANGES rows.
    """
    rows = by_score(df, score, label)
    ends = rows.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    part = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")) * RANGES), F.lit(RANGES - 1))).otherwise(0)
    rows = rows.crossJoin(F.broadcast(ends)).withColumn("part", part.cast("int")).drop("lo", "hi")
    above = W.orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy("part").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    totals = totals.select("part", F.coalesce(F.sum("p").over(above), F.lit(0)).alias("p0"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n0"))
    inside = W.partitionBy("part").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.join(F.broadcast(totals), "part")
    return rows.select("score", "pos", "neg", (F.sum("pos").over(inside) + F.col("p0")).alias("tp"), (F.sum("neg").over(inside) + F.col("n0")).alias("fp"))


def auc_rank(df: DataFrame, score: str = "prob", label: str = "label") -> DataFrame:
    """AUC by mean ranks, null where one label is missing: each score's positives beat the negatives below, and half of its own."""
    rows = cumulated(df, score, label)
    wins = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    p, n = F.sum("pos"), F.sum("neg")
    return rows.agg(F.when((p > 0) & (n > 0), wins / (p * n)).alias("auc_roc"), p.alias("n_pos"), n.alias("n_neg"))


def average_precision(df: DataFrame, score: str = "prob", label: str = "label") -> DataFrame:
    """Sum over scores of the gained recall times the precision reached; equal scores are taken together."""
    rows = cumulated(df, score, label)
    return rows.agg((F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.sum("pos")).alias("average_precision"))


def auc_pr(df: DataFrame, score: str = "prob", label: str = "label") -> DataFrame:
    """Area under precision over recall by trapezoids from (0, 1), a point for each distinct score."""
    rows = cumulated(df, score, label)
    before_tp, before_fp = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    before = F.when(before_tp + before_fp > 0, before_tp / (before_tp + before_fp)).otherwise(1.0)
    now = F.col("tp") / (F.col("tp") + F.col("fp"))
    return rows.agg((F.sum(F.col("pos") * (now + before) / 2) / F.sum("pos")).alias("auc_pr"))


def sweep(df: DataFrame, thresholds: list[float], score: str = "prob", label: str = "label", guard: str = "epsilon") -> DataFrame:
    """Confusion counts and rates at each threshold (score >= threshold), from counts by threshold interval in one pass."""
    spots = sorted(set(float(t) for t in thresholds))
    edges = F.array(*[F.lit(t) for t in spots])
    passed = df.select(F.col(label).alias("label"), F.size(F.filter(edges, lambda t: t <= F.col(score).cast("double"))).alias("k"))
    counts = passed.groupBy("k").agg(F.sum((F.col("label") == 1).cast("long")).alias("p"), F.sum((F.col("label") == 0).cast("long")).alias("q"))
    grid = df.sparkSession.createDataFrame(list(enumerate(spots, 1)), "at int, threshold double")
    met = grid.crossJoin(F.broadcast(counts.groupBy().agg(F.collect_list(F.struct("k", "p", "q")).alias("all"))))
    total = lambda name, test: F.aggregate("all", F.lit(0).cast("long"), lambda a, x: a + F.when(test(x["k"]), x[name]).otherwise(F.lit(0)))
    at = F.col("at")
    rows = met.select(
        "threshold",
        total("p", lambda k: k >= at).alias("tp"),
        total("q", lambda k: k >= at).alias("fp"),
        total("q", lambda k: k < at).alias("tn"),
        total("p", lambda k: k < at).alias("fn"),
    )
    return rates(rows.withColumn("n", F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")), guard)


def uniform_thresholds(n: int = 50, low: float = 0.0, high: float = 1.0) -> list[float]:
    return [low + (high - low) * k / (n - 1) for k in range(n)] if n > 1 else [low]


def threshold_at_fpr(swept: DataFrame, target: float) -> DataFrame:
    """The highest threshold whose false-positive rate is within the target; 0.5 without one."""
    return swept.agg(F.coalesce(F.max(F.when(F.col("fpr") <= target, F.col("threshold"))), F.lit(0.5)).alias("threshold"))


def best_threshold(swept: DataFrame, most_fpr: float) -> DataFrame:
    """The best F1 among thresholds within the false-positive rate, or else the lowest rate."""
    fits = (F.col("fpr") <= most_fpr).cast("int")
    order = [F.desc(fits), F.desc(F.when(fits == 1, F.col("f1")).otherwise(-F.col("fpr"))), "threshold"]
    return swept.orderBy(*order).limit(1)


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval, clamped; (0, 0) without trials."""
    k, m = successes.cast("double"), n.cast("double")
    p = k / m
    middle, spread = p + z * z / (2 * m), z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    low, high = (middle - spread) / (1 + z * z / m), (middle + spread) / (1 + z * z / m)
    bound = lambda c: F.when(m > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))).otherwise(0.0)
    safe = lambda c: bound(c)
    return safe(low), safe(high)


def family_recall(df: DataFrame, family: str = "family", least: float = 0.90) -> DataFrame:
    """Recall, mean and smallest score of each family, its Wilson interval, and whether it passes."""
    rows = df.groupBy(family).agg(F.count("*").alias("n"), F.sum("pred").alias("hits"), F.avg("prob").alias("mean_prob"), F.min("prob").alias("min_prob"))
    low, high = wilson(F.col("hits"), F.col("n"))
    recall = F.col("hits") / F.col("n")
    return rows.withColumns({"recall": recall, "ci_low": low, "ci_high": high, "status": F.when(recall >= least, "PASS").otherwise("FAIL")})


def latency(df: DataFrame, value: str = "ms", by: list[str] | None = None) -> DataFrame:
    """Percentiles with linear interpolation, mean, population deviation and rows a second."""
    by = by or []
    plain = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), (F.count("*") * 1000 / F.sum(value)).alias("rps"))
    found = exact_percentiles(df, F.col(value), by, {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p999": 0.999})
    return beside(plain, found, by).select(*by, "p50", "p95", "p99", "p999", "mean", "std", "rps")


def slo_verdicts(df: DataFrame, most_fpr: float = 0.001, most_p99: float = 50.0, least_rps: float = 10_000) -> DataFrame:
    """PASS or FAIL of each target; a missing value fails."""
    ok = lambda c: F.when(F.coalesce(c, F.lit(False)), "PASS").otherwise("FAIL")
    fpr, p99, rps = F.col("fpr") <= most_fpr, F.col("p99") <= most_p99, F.col("rps") >= least_rps
    return df.withColumns({"fpr_verdict": ok(fpr), "p99_verdict": ok(p99), "rps_verdict": ok(rps), "verdict": ok(fpr & p99 & rps)})


def errors(df: DataFrame, k: int = 10, text: str = "raw", cls: str = "attack_class") -> tuple[DataFrame, DataFrame]:
    """The k worst false positives and negatives with the beginning of their text, and the errors by class."""
    kind = F.when((F.col("label") == 0) & (F.col("pred") == 1), "fp").when((F.col("label") == 1) & (F.col("pred") == 0), "fn")
    wrong = df.withColumn("kind", kind).filter("kind IS NOT NULL").withColumn("_gap", F.abs(F.col("prob") - F.col("label")))
    worst = None
    for name in ("fp", "fn"):
        part = wrong.filter(F.col("kind") == name).orderBy(F.desc("_gap"), "id").limit(k)
        worst = part if worst is None else worst.unionByName(part)
    return worst.select("kind", "id", "prob", cls, F.substring(text, 1, 200).alias("text")), wrong.groupBy("kind", cls).agg(F.count("*").alias("n"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """n / (classes * count) of each label."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    return counts.crossJoin(F.broadcast(whole)).select(label, "n", (F.col("total") / (F.col("k") * F.col("n"))).alias("weight"))


def smoothed_labels(label: Column | str, eps: float) -> Column:
    """Labels drawn towards the middle: y (1 - eps) + eps / 2."""
    return (F.col(label) if isinstance(label, str) else label) * (1 - eps) + eps / 2


def smoothing_sweep(df: DataFrame, epsilons: list[float], label: str = "label") -> DataFrame:
    """For each eps, how many labels at the threshold of a half are as they were: all, below an eps of 1."""
    options = F.array(*[F.struct(F.lit(float(e)).alias("eps"), (smoothed_labels(label, e) >= 0.5).cast("int").alias("y")) for e in epsilons])
    rows = df.select(F.col(label).alias("label"), F.explode(options).alias("x"))
    return rows.groupBy("x.eps").agg(F.count("*").alias("n"), F.sum((F.col("x.y") == F.col("label")).cast("long")).alias("n_same"))
