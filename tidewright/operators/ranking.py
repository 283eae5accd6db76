"""Joining reports by model, normalising, and ranking candidates for deployment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewright.operators.metrics import confusion

#: Weights of the composite score.
WEIGHTS = {"auc_pr": 0.5, "latency": 0.3, "robustness": 0.2}


def master_table(detection: DataFrame, latency: DataFrame, adversarial: DataFrame, memory: DataFrame, baselines: DataFrame | None = None) -> DataFrame:
    """Reports side by side by model, missing parts null; latency is that of batches of one, a GPU row before a CPU row."""
    speed = latency.filter("batch_size = 1").withColumn("_gpu", (F.col("device") == "cuda").cast("int"))
    speed = speed.groupBy("model").agg(F.max_by(F.struct("p50", "p95", "p99", "rps"), "_gpu").alias("s")).select("model", "s.*")
    out = detection.join(speed, "model", "left").join(adversarial, "model", "left").join(memory, "model", "left")
    if baselines is not None:
        out = out.unionByName(baselines, allowMissingColumns=True)
    return out.orderBy(F.desc_nulls_last("auc_pr"), "model")


def min_max(df: DataFrame, column: str, out: str) -> DataFrame:
    """The column on a scale from 0 to 1; nulls are 0, a constant is 1 if positive and else 0."""
    value = F.coalesce(F.nanvl(F.col(column).cast("double"), F.lit(0.0)), F.lit(0.0))
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), (value - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise((value > 0).cast("double"))
    return df.crossJoin(F.broadcast(ends)).withColumn(out, scaled).drop("_lo", "_hi")


def latency_score(p99: Column, slo: float) -> Column:
    """1 within the target, falling to 0 at twice the target; 0 without a value."""
    return F.coalesce(F.when(p99 <= slo, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (p99 - slo) / slo)), F.lit(0.0))


def composite_rank(df: DataFrame, slo: float = 50.0) -> DataFrame:
    """Score of detection, latency and robustness, the rank by it, and a sentence of reasons."""
    rows = min_max(df, "auc_pr", "auc_pr_norm").withColumn("latency_score", latency_score(F.col("p99"), slo))
    robust = 1 - F.coalesce(F.col("mean_evasion"), F.lit(1.0))
    score = WEIGHTS["auc_pr"] * F.col("auc_pr_norm") + WEIGHTS["latency"] * F.col("latency_score") + WEIGHTS["robustness"] * robust
    rows = rows.withColumn("composite", score)
    reason = F.concat_ws(
        " ", F.concat("model", F.lit(" has composite score "), F.format_string("%.4f", "composite"), F.lit(".")),
        F.when(F.col("p99") <= slo, F.lit("It meets the latency target.")), F.when(F.col("p99") > slo, F.lit("It misses the latency target.")),
        F.when(F.col("mean_evasion") > 0.3, F.lit("Tampered requests often evade it.")),
    )
    return rows.withColumn("reason", reason).withColumn("rank", F.row_number().over(W.orderBy(F.desc("composite"), "model")))


def deltas(df: DataFrame, a: str, b: str, lower_is_better: list[str]) -> DataFrame:
    """Difference b - a of long metrics (name, model, value) and who wins."""
    met = df.filter(F.col("model").isin(a, b)).groupBy("name").pivot("model", [a, b]).agg(F.first("value"))
    delta = F.round(F.col(b) - F.col(a), 6)
    better = F.when(F.col("name").isin(lower_is_better), -delta).otherwise(delta)
    return met.withColumns({"delta": delta, "winner": F.when(better > 0, b).when(better < 0, a).otherwise("tie")})


def majority(winners: DataFrame, column: str = "winner") -> DataFrame:
    """The value that over half of the rows have, or inconclusive."""
    counts = winners.groupBy(column).agg(F.count("*").alias("n"))
    return counts.agg(F.max_by(F.col(column), F.struct("n", column)).alias("w"), F.max("n").alias("m"), F.sum("n").alias("t")).select(
        F.when(F.col("m") * 2 > F.col("t"), F.col("w")).otherwise("inconclusive").alias("majority")
    )


def saturation(curve: DataFrame, least: float = 0.002) -> DataFrame:
    """STOP where the last two steps of a curve (share, auc_pr) gain less than that, else CONTINUE."""
    steps = curve.withColumn("delta", F.col("auc_pr") - F.lag("auc_pr").over(W.orderBy("share")))
    ranked = steps.withColumn("_r", F.row_number().over(W.orderBy(F.desc("share")))).filter("_r <= 2 AND delta IS NOT NULL")
    return ranked.agg(
        F.when((F.count("*") == 2) & (F.max("delta") < least), "STOP").otherwise("CONTINUE").alias("decision"), F.max("delta").alias("largest_step")
    )


def scaling_factors(df: DataFrame) -> DataFrame:
    """Ratio of the anchors' difference to the probes', and the corrected score."""
    probe, anchor = F.col("probe_b") - F.col("probe_a"), F.col("anchor_b") - F.col("anchor_a")
    return df.withColumns({"factor": F.when(F.abs(probe) > 1e-8, anchor / probe), "corrected": F.col("probe_a") + anchor})


def ablation(df: DataFrame, value, source: str = "source", least: int = 100) -> DataFrame:
    """What a metric gains or loses without each source: source, n_dropped, value and delta (against all rows), in one pass.

    value: function of the columns tp, fp, tn, fn (by name) to the metric. Counts of the rest are those of all less the
    source's own; sources without which fewer than `least` rows are left are skipped.
    """
    names = ("tp", "fp", "tn", "fn", "n")
    own = confusion(df, by=[source])
    whole = F.broadcast(own.agg(*[F.sum(c).alias(f"_{c}") for c in names]))
    rest = {c: F.col(f"_{c}") - F.col(c) for c in names}
    after, before = value(rest), value({c: F.col(f"_{c}") for c in names})
    return own.crossJoin(whole).filter(rest["n"] >= least).select(source, F.col("n").alias("n_dropped"), after.alias("value"), (after - before).alias("delta"))


def memory_report(df: DataFrame, reference: str, params: str = "n_params", width: str = "bytes_per_param") -> DataFrame:
    """Megabytes of each model's parameters, and how many times smaller than the reference model it is."""
    size = F.col(params).cast("double") * F.col(width)
    base = F.broadcast(df.filter(F.col("model") == reference).select(size.alias("_base")).limit(1))
    return df.crossJoin(base).withColumns({"megabytes": size / (1 << 20), "compression": F.when(size > 0, F.col("_base") / size)}).drop("_base")


def flattened(report: dict, prefix: str = "") -> list[tuple[str, float]]:
    """Dotted names and values of the finite numbers of a nested report."""
    out = []
    for k, v in report.items():
        name = f"{prefix}.{k}" if prefix else str(k)
        if isinstance(v, dict):
            out += flattened(v, name)
        elif isinstance(v, (int, float)) and not isinstance(v, bool) and v == v and abs(v) != float("inf"):
            out.append((name, float(v)))
    return out


def distillation_loss(student: Column, teacher: Column, label: Column, temperature: float = 4.0, hard: float = 0.3, soft: float = 0.7) -> Column:
    """Weighted cross entropy and temperature-scaled KL divergence of two arrays of logits."""
    soft_max = lambda a, t: F.transform(a, lambda x: F.exp(x / t) / F.aggregate(F.transform(a, lambda y: F.exp(y / t)), F.lit(0.0), lambda s, y: s + y))
    p, q = soft_max(teacher, temperature), soft_max(student, temperature)
    kl = F.aggregate(F.zip_with(p, q, lambda a, b: a * F.ln(a / b)), F.lit(0.0), lambda s, x: s + x)
    ce = -F.ln(F.element_at(soft_max(student, 1.0), label + 1))
    return hard * ce + soft * temperature**2 * kl
