"""Evaluation queries: scores are functions of columns of documents and embeddings, so SQL can follow every metric."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import metrics, profile, ranking
from tidewright.plans.corpus import labelled
from tidewright.plans.registry import query
from tidewright.session import table

SCORED = """
scored AS (SELECT d.doc_id AS id, CAST(l.toxic AS INTEGER) AS label, (d.doc_id * 37 % 101) / 100.0 AS prob,
                  CASE WHEN (d.doc_id * 37 % 101) / 100.0 >= 0.5 THEN 1 ELSE 0 END AS pred,
                  CASE WHEN l.toxic = 0 THEN 'benign' ELSE d.lang END AS attack_class, d.text AS raw
           FROM documents d JOIN labels l USING (doc_id))
"""


def scored(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    prob = (F.col("id") * 37 % 101) / 100.0
    return rows.select(
        "id", "label", prob.alias("prob"), (prob >= 0.5).cast("int").alias("pred"), F.when(F.col("label") == 0, "benign").otherwise(F.col("attack_class")).alias("attack_class"), "raw"
    )


def _rounded(df, *names, digits=9):
    return df.withColumns({c: F.round(c, digits) for c in names})


RATES = """
    round(tp / (tp + fp + 1e-9), 9) AS precision, round(tp / (tp + fn + 1e-9), 9) AS recall,
    round(2 * (tp / (tp + fp + 1e-9)) * (tp / (tp + fn + 1e-9)) / (tp / (tp + fp + 1e-9) + tp / (tp + fn + 1e-9) + 1e-9), 9) AS f1,
    round(fp / (fp + tn + 1e-9), 9) AS fpr, round(fn / (fn + tp + 1e-9), 9) AS fnr, round((tp + tn) / (tp + tn + fp + fn + 1e-9), 9) AS accuracy
"""
NAMES = ("precision", "recall", "f1", "fpr", "fnr", "accuracy")
COUNTS = """
    count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp,
    count(*) FILTER (WHERE label = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn, count(*) AS n
"""


@query("binary_metrics", f"WITH {SCORED}, c AS (SELECT {COUNTS} FROM scored) SELECT tp, fp, tn, fn, n, {RATES} FROM c")
def binary_metrics(spark, sf_dir):
    return _rounded(metrics.binary_metrics(scored(spark, sf_dir)), *NAMES)


@query(
    "calibration_metrics",
    f"""
    WITH {SCORED}, c AS (SELECT {COUNTS} FROM scored)
    SELECT tp, fp, tn, fn, n, round(tp / greatest(tp + fp, 1), 9) AS precision, round(tp / greatest(tp + fn, 1), 9) AS recall, round(fp / greatest(fp + tn, 1), 9) AS fpr FROM c
    """,
)
def calibration_metrics(spark, sf_dir):
    out = metrics.binary_metrics(scored(spark, sf_dir), guard="one").select("tp", "fp", "tn", "fn", "n", "precision", "recall", "fpr")
    return _rounded(out, "precision", "recall", "fpr")


@query(
    "per_class_metrics",
    f"""
    WITH {SCORED}, k AS (SELECT DISTINCT attack_class FROM scored WHERE attack_class <> 'benign'),
    r AS (SELECT attack_class, label, pred FROM scored WHERE attack_class <> 'benign'
          UNION ALL SELECT k.attack_class, s.label, s.pred FROM scored s, k WHERE s.label = 0 UNION ALL SELECT 'benign', label, pred FROM scored WHERE label = 0),
    c AS (SELECT attack_class, {COUNTS} FROM r GROUP BY attack_class)
    SELECT attack_class, tp, fp, tn, fn, n, {RATES} FROM c
    """,
)
def per_class_metrics(spark, sf_dir):
    return _rounded(metrics.per_class(scored(spark, sf_dir)), *NAMES)


@query(
    "macro_f1",
    f"""
    WITH {SCORED}, c AS (SELECT {COUNTS} FROM scored)
    SELECT round(2 * tn / (2 * tn + fn + fp), 9) AS f1_0, round(2 * tp / (2 * tp + fp + fn), 9) AS f1_1,
           round((2 * tn / (2 * tn + fn + fp) + 2 * tp / (2 * tp + fp + fn)) / 2, 9) AS macro_f1, round((tp + tn) / n, 9) AS accuracy FROM c
    """,
)
def macro_f1(spark, sf_dir):
    return _rounded(metrics.macro_f1(scored(spark, sf_dir)), "f1_0", "f1_1", "macro_f1", "accuracy")


@query(
    "auc_rank",
    f"""
    WITH {SCORED}, r AS (SELECT label, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2 AS r FROM scored),
    s AS (SELECT sum(r) FILTER (WHERE label = 1) AS w, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS q FROM r)
    SELECT round((w - p * (p + 1) / 2) / (p * q), 9) AS auc_roc, p AS n_pos, q AS n_neg FROM s
    """,
)
def auc_rank(spark, sf_dir):
    return _rounded(metrics.auc_rank(scored(spark, sf_dir)), "auc_roc")


CUMULATED = f"""
WITH {SCORED}, g AS (SELECT prob, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM scored GROUP BY prob),
c AS (SELECT *, sum(pos) OVER (ORDER BY prob DESC) AS tp, sum(neg) OVER (ORDER BY prob DESC) AS fp FROM g)
"""


@query("average_precision", CUMULATED + "SELECT round(sum(pos * tp / (tp + fp)) / sum(pos), 9) AS average_precision FROM c")
def average_precision(spark, sf_dir):
    return _rounded(metrics.average_precision(scored(spark, sf_dir)), "average_precision")


@query(
    "auc_pr",
    CUMULATED
    + """SELECT round(sum(pos * (tp / (tp + fp) + CASE WHEN tp - pos + fp - neg > 0 THEN (tp - pos) / (tp - pos + fp - neg) ELSE 1 END) / 2) / sum(pos), 9) AS auc_pr FROM c""",
)
def auc_pr(spark, sf_dir):
    return _rounded(metrics.auc_pr(scored(spark, sf_dir)), "auc_pr")


@query("cumulative_counts", CUMULATED + "SELECT CAST(prob AS DOUBLE) AS score, pos, neg, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp FROM c")
def cumulative_counts(spark, sf_dir):
    return metrics.cumulated(scored(spark, sf_dir))


SWEEP = f"""
WITH {SCORED}, t AS (SELECT i / 20.0 AS threshold FROM range(21) r(i)),
c AS (SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) FILTER (WHERE label = 1 AND prob >= threshold) AS tp, count(*) FILTER (WHERE label = 0 AND prob >= threshold) AS fp,
             count(*) FILTER (WHERE label = 0 AND prob < threshold) AS tn, count(*) FILTER (WHERE label = 1 AND prob < threshold) AS fn, count(*) AS n FROM scored, t GROUP BY threshold)
"""


def _sweep(spark, sf_dir):
    return metrics.sweep(scored(spark, sf_dir), [k / 20 for k in range(21)])


@query("threshold_sweep", SWEEP + f"SELECT threshold, tp, fp, tn, fn, n, {RATES} FROM c")
def threshold_sweep(spark, sf_dir):
    return _rounded(_sweep(spark, sf_dir), *NAMES)


@query("threshold_at_fpr", SWEEP + "SELECT coalesce(max(threshold) FILTER (WHERE fp / (fp + tn + 1e-9) <= 0.4), 0.5) AS threshold FROM c")
def threshold_at_fpr(spark, sf_dir):
    return metrics.threshold_at_fpr(_sweep(spark, sf_dir), 0.4)


@query(
    "best_threshold",
    SWEEP
    + """, m AS (SELECT threshold, fp / (fp + tn + 1e-9) AS fpr, 2 * (tp / (tp + fp + 1e-9)) * (tp / (tp + fn + 1e-9)) / (tp / (tp + fp + 1e-9) + tp / (tp + fn + 1e-9) + 1e-9) AS f1 FROM c)
    SELECT threshold, round(f1, 9) AS f1, round(fpr, 9) AS fpr FROM m ORDER BY CASE WHEN fpr <= 0.4 THEN 0 ELSE 1 END, CASE WHEN fpr <= 0.4 THEN f1 ELSE -fpr END DESC, threshold LIMIT 1""",
)
def best_threshold(spark, sf_dir):
    return _rounded(metrics.best_threshold(_sweep(spark, sf_dir), 0.4).select("threshold", "f1", "fpr"), "f1", "fpr")


@query(
    "wilson_family_recall",
    f"""
    WITH {SCORED}, g AS (SELECT attack_class AS family, count(*) AS n, CAST(sum(pred) AS BIGINT) AS hits, avg(prob) AS mean_prob, CAST(min(prob) AS DOUBLE) AS min_prob FROM scored WHERE label = 1 GROUP BY 1),
    w AS (SELECT *, hits / n AS p, 1.96 AS z FROM g)
    SELECT family, n, hits, round(mean_prob, 9) AS mean_prob, min_prob, round(p, 9) AS recall,
           round(greatest(0, (p + z*z/(2*n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)), 6) AS ci_low,
           round(least(1, (p + z*z/(2*n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)), 6) AS ci_high,
           CASE WHEN p >= 0.9 THEN 'PASS' ELSE 'FAIL' END AS status FROM w
    """,
)
def wilson_family_recall(spark, sf_dir):
    rows = scored(spark, sf_dir).filter("label = 1").withColumnRenamed("attack_class", "family")
    out = metrics.family_recall(rows)
    return _rounded(_rounded(out, "mean_prob", "recall"), "ci_low", "ci_high", digits=6)


@query(
    "latency_stats",
    """
    SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99,
           round(quantile_cont(value, 0.999), 6) AS p999, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(count(*) * 1000 / sum(value), 6) AS rps FROM events GROUP BY event_type
    """,
)
def latency_stats(spark, sf_dir):
    return _rounded(metrics.latency(table(spark, sf_dir, "events"), "value", ["event_type"]), "p50", "p95", "p99", "p999", "mean", "std", "rps", digits=6)


@query(
    "slo_verdict",
    """
    WITH s AS (SELECT event_type, quantile_cont(value, 0.99) AS p99, count(*) * 1000 / sum(value) AS rps, 0.0005 AS fpr FROM events GROUP BY event_type)
    SELECT event_type, 'PASS' AS fpr_verdict, CASE WHEN p99 <= 50 THEN 'PASS' ELSE 'FAIL' END AS p99_verdict, CASE WHEN rps >= 10000 THEN 'PASS' ELSE 'FAIL' END AS rps_verdict,
           CASE WHEN p99 <= 50 AND rps >= 10000 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM s
    """,
)
def slo_verdict(spark, sf_dir):
    stats = metrics.latency(table(spark, sf_dir, "events"), "value", ["event_type"]).withColumn("fpr", F.lit(0.0005))
    return metrics.slo_verdicts(stats).select("event_type", "fpr_verdict", "p99_verdict", "rps_verdict", "verdict")


@query("worst_errors", f"""
    WITH {SCORED}, e AS (SELECT CASE WHEN label = 0 AND pred = 1 THEN 'fp' WHEN label = 1 AND pred = 0 THEN 'fn' END AS kind, *, abs(prob - label) AS gap FROM scored)
    SELECT kind, id, CAST(prob AS DOUBLE) AS prob, attack_class, substr(raw, 1, 200) AS text FROM e WHERE kind IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY kind ORDER BY gap DESC, id) <= 10
    """)  # fmt: skip
def worst_errors(spark, sf_dir):
    return metrics.errors(scored(spark, sf_dir))[0]


@query("error_classes", f"""
    WITH {SCORED} SELECT CASE WHEN label = 0 THEN 'fp' ELSE 'fn' END AS kind, attack_class, count(*) AS n FROM scored WHERE label <> pred GROUP BY 1, 2
    """)  # fmt: skip
def error_classes(spark, sf_dir):
    return metrics.errors(scored(spark, sf_dir))[1]


@query("class_weights", f"WITH {SCORED} SELECT label, count(*) AS n, (SELECT count(*) FROM scored) / (2 * count(*)) AS weight FROM scored GROUP BY label")
def class_weights(spark, sf_dir):
    return metrics.class_weights(scored(spark, sf_dir))


MODELS_SQL = """
m AS (SELECT event_type AS model, round(avg(value) / 100, 6) AS auc_pr, quantile_cont(value, 0.99) AS p99,
             CASE WHEN event_type = 'purchase' THEN NULL ELSE round(stddev_pop(value) / 200, 6) END AS mean_evasion FROM events GROUP BY 1)
"""


def _models(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumnRenamed("event_type", "model")
    plain = e.groupBy("model").agg(
        F.round(F.avg("value") / 100, 6).alias("auc_pr"), F.when(F.col("model") == "purchase", None).otherwise(F.round(F.stddev_pop("value") / 200, 6)).alias("mean_evasion")
    )
    return profile.beside(plain, profile.exact_percentiles(e, F.col("value"), ["model"], {"p99": 0.99}), ["model"])


@query("composite_rank", f"""
    WITH {MODELS_SQL}, e AS (SELECT min(auc_pr) AS lo, max(auc_pr) AS hi FROM m),
    s AS (SELECT model, CASE WHEN hi > lo THEN (auc_pr - lo) / (hi - lo) WHEN auc_pr > 0 THEN 1 ELSE 0 END AS a,
                 CASE WHEN p99 <= 50 THEN 1.0 ELSE greatest(0, 1 - (p99 - 50) / 50) END AS l, 1 - coalesce(mean_evasion, 1) AS r FROM m, e),
    c AS (SELECT model, l, 0.5 * a + 0.3 * l + 0.2 * r AS composite FROM s)
    SELECT model, round(l, 6) AS latency_score, round(composite, 6) AS composite, CAST(row_number() OVER (ORDER BY composite DESC, model) AS INTEGER) AS rank FROM c
    """)  # fmt: skip
def composite_rank(spark, sf_dir):
    out = ranking.composite_rank(_models(spark, sf_dir)).select("model", "latency_score", "composite", "rank")
    return _rounded(out, "latency_score", "composite", digits=6)


@query("master_table", f"""
    WITH {MODELS_SQL}, l AS (SELECT event_type AS model, quantile_cont(value, 0.5) AS p50 FROM events WHERE event_type <> 'click' GROUP BY 1)
    SELECT m.model, m.auc_pr, l.p50, CASE WHEN l.model IS NULL THEN NULL ELSE 1.0 END AS rps, m.mean_evasion, CASE WHEN m.model = 'view' THEN 12.5 END AS mb
    FROM m LEFT JOIN l ON m.model = l.model UNION ALL SELECT 'rules [baseline]', 0.25, NULL, NULL, NULL, NULL
    """)  # fmt: skip
def master_table(spark, sf_dir):
    models = _models(spark, sf_dir)
    e = table(spark, sf_dir, "events").filter("event_type <> 'click'")
    speed = profile.exact_percentiles(e.withColumnRenamed("event_type", "model"), F.col("value"), ["model"], {"p50": 0.5})
    speed = speed.select("model", F.lit(1).alias("batch_size"), F.lit("cpu").alias("device"), "p50", F.lit(0.0).alias("p95"), F.lit(0.0).alias("p99"), F.lit(1.0).alias("rps"))
    memory = models.filter("model = 'view'").select("model", F.lit(12.5).alias("mb"))
    base = spark.createDataFrame([("rules [baseline]", 0.25)], "model string, auc_pr double")
    out = ranking.master_table(models.select("model", "auc_pr"), speed, models.select("model", "mean_evasion"), memory, base)
    return out.select("model", "auc_pr", "p50", "rps", "mean_evasion", "mb")


@query("metric_deltas", """
    WITH a AS (SELECT 'mean' AS name, event_type AS model, avg(value) AS value FROM events GROUP BY 2 UNION ALL SELECT 'n', event_type, count(*) FROM events GROUP BY 2),
    d AS (SELECT name, max(value) FILTER (WHERE model = 'click') AS click, max(value) FILTER (WHERE model = 'view') AS view FROM a GROUP BY name)
    SELECT name, round(view - click, 6) AS delta, CASE WHEN round(view - click, 6) = 0 THEN 'tie' WHEN (round(view - click, 6) > 0) = (name <> 'mean') THEN 'view' ELSE 'click' END AS winner FROM d
    """)  # fmt: skip
def metric_deltas(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("model")).agg(F.avg("value").alias("mean"), F.count("*").cast("double").alias("n"))
    long = e.unpivot("model", ["mean", "n"], "name", "value")
    return ranking.deltas(long, "click", "view", ["mean"]).select("name", "delta", "winner")


@query("saturation", """
    WITH c AS (SELECT lang, row_number() OVER (ORDER BY count(*)) AS share, count(*) / 1000.0 AS auc_pr FROM documents GROUP BY lang),
    d AS (SELECT share, auc_pr - lag(auc_pr) OVER (ORDER BY share) AS delta FROM c)
    SELECT CASE WHEN count(*) = 2 AND max(delta) < 0.002 THEN 'STOP' ELSE 'CONTINUE' END AS decision, round(max(delta), 9) AS largest_step
    FROM (SELECT * FROM d WHERE delta IS NOT NULL ORDER BY share DESC LIMIT 2)
    """)  # fmt: skip
def saturation(spark, sf_dir):
    from pyspark.sql import Window as W

    c = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    curve = c.select(F.row_number().over(W.orderBy("n")).alias("share"), (F.col("n") / 1000.0).alias("auc_pr"))
    return _rounded(ranking.saturation(curve), "largest_step")
