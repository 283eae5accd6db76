"""Queries of comparisons between models, ablations, probes' parts, and the control of runs."""

from __future__ import annotations

import tempfile

from pyspark.ml import Pipeline
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import functions as F

from tidewright.functions import seeded
from tidewright.functions.text import highlighted
from tidewright.operators import jobs, leakage, metrics, probes, ranking, splits
from tidewright.plans.corpus import LABELLED, labelled
from tidewright.plans.evaluation import SCORED, scored
from tidewright.plans.registry import ORACLES, query
from tidewright.session import table
from tidewright.sources import files, sinks

F1 = "2.0 * {tp} / greatest(2 * {tp} + {fp} + {fn}, 1)"


def f1(c):
    return 2.0 * c["tp"] / F.greatest(2 * c["tp"] + c["fp"] + c["fn"], F.lit(1))


@query(
    "source_ablation",
    f"""
    WITH {SCORED}, s AS (SELECT scored.*, d.source FROM scored JOIN documents d ON d.doc_id = scored.id),
    c AS (SELECT source, count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp, count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn, count(*) AS n FROM s GROUP BY source),
    w AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(n) AS n FROM c)
    SELECT source, c.n AS n_dropped, round({F1.format(tp="(w.tp - c.tp)", fp="(w.fp - c.fp)", fn="(w.fn - c.fn)")}, 9) AS value,
           round({F1.format(tp="(w.tp - c.tp)", fp="(w.fp - c.fp)", fn="(w.fn - c.fn)")} - {F1.format(tp="w.tp", fp="w.fp", fn="w.fn")}, 9) AS delta
    FROM c, w WHERE w.n - c.n >= 10
    """,
)
def source_ablation(spark, sf_dir):
    rows = scored(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source"), "id")
    return ranking.ablation(rows, f1, least=10).withColumns({c: F.round(c, 9) for c in ("value", "delta")})


@query(
    "scaling_factors",
    """
    SELECT n_nationkey AS key, round(CASE WHEN n_regionkey > 0 THEN n_nationkey / (n_regionkey / 10) END, 9) AS factor, n_nationkey + 0.5 AS corrected FROM nation
    """,
)
def scaling_factors(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("key"), F.lit(0.5).alias("probe_a"), (F.col("n_regionkey") / 10 + 0.5).alias("probe_b"), F.lit(1.0).alias("anchor_a"), (F.col("n_nationkey") + 1.0).alias("anchor_b")
    )
    return ranking.scaling_factors(n).select("key", F.round("factor", 9).alias("factor"), "corrected")


@query("top_tokens", "SELECT token, mi FROM (" + ORACLES["token_leakage"] + ") ORDER BY mi DESC, token LIMIT 50")
def top_tokens(spark, sf_dir):
    """The 50 tokens that tell most about the label."""
    found = leakage.token_leakage(labelled(spark, sf_dir)).withColumn("mi", F.round("mi", 9))
    return leakage.top_tokens(found, 50).select("token", "mi")


@query(
    "majority_winner",
    """
    WITH w AS (SELECT CASE WHEN length(text) % 3 = 0 THEN 'a' WHEN length(text) % 3 = 1 THEN 'b' ELSE 'tie' END AS w, count(*) AS n FROM documents GROUP BY 1)
    SELECT CASE WHEN max(n) * 2 > sum(n) THEN arg_max(w, n) ELSE 'inconclusive' END AS majority FROM w
    """,
)
def majority_winner(spark, sf_dir):
    size = F.length("text") % 3
    return ranking.majority(table(spark, sf_dir, "documents").select(F.when(size == 0, "a").when(size == 1, "b").otherwise("tie").alias("winner")))


@query("clear_winner", "SELECT 'en' AS majority")
def clear_winner(spark, sf_dir):
    """A value that over half of the rows have."""
    return ranking.majority(table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 10 < 6, "en").otherwise(F.col("lang")).alias("winner")))


@query("union_tables", "SELECT doc_id, text, NULL AS item_id FROM documents UNION ALL SELECT NULL, text, item_id FROM benchmark")
def union_tables(spark, sf_dir):
    """Rows of two tables, columns by name, missing ones null."""
    return table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(table(spark, sf_dir, "benchmark").select("item_id", "text"), allowMissingColumns=True)


@query("quota_fill", "SELECT doc_id, true AS kept, (SELECT 2 * count(*) FROM documents) AS total FROM documents")
def quota_fill(spark, sf_dir):
    """A table filled to twice its rows: every row is there, and the total is met."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    filled = splits.fill_to_quota(docs, 2 * docs.count(), "doc_id")
    total = filled.agg(F.count("*").alias("total"))
    return filled.groupBy("doc_id").agg((F.count("*") >= 1).alias("kept")).crossJoin(F.broadcast(total))


@query("source_mix", "SELECT n_nationkey AS n, CAST(round_even(n_nationkey * 0.3, 0) AS INTEGER) AS first, CAST(n_nationkey - round_even(n_nationkey * 0.3, 0) AS INTEGER) AS second, n_nationkey AS alone FROM nation")
def source_mix(spark, sf_dir):
    """How many of n rows two sources give, and one where the other is missing."""
    rows = [(r["n_nationkey"], *splits.source_mix(r["n_nationkey"], 0.3), splits.source_mix(r["n_nationkey"], 0.3, have_first=False)[1]) for r in table(spark, sf_dir, "nation").collect()]
    return spark.createDataFrame(rows, "n int, first int, second int, alone int")


@query("renormalised_shares", "SELECT * FROM (VALUES ('test', 0.105263158), ('val', 0.157894737), ('train', 0.736842105)) t(name, share)")
def renormalised_shares(spark, sf_dir):
    left = splits.renormalised(splits.SHARES, ["canary", "adversarial"])
    return spark.createDataFrame([(n, round(s, 9)) for n, s in left.items()], "name string, share double")


@query(
    "ranking_reasons",
    """
    WITH m AS (SELECT n_name AS model, n_nationkey / 25 AS auc_pr, CAST(n_regionkey * 20 AS DOUBLE) AS p99, n_nationkey % 7 / 10 AS evasion FROM nation),
    s AS (SELECT *, 0.5 * auc_pr / (24 / 25) + 0.3 * CASE WHEN p99 <= 50 THEN 1 ELSE greatest(0, 1 - (p99 - 50) / 50) END + 0.2 * (1 - evasion) AS c FROM m)
    SELECT model, model || ' has composite score ' || printf('%.4f', c) || '. ' || CASE WHEN p99 <= 50 THEN 'It meets the latency target.' ELSE 'It misses the latency target.' END
           || CASE WHEN evasion > 0.3 THEN ' Tampered requests often evade it.' ELSE '' END AS reason FROM s
    """,
)
def ranking_reasons(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("model"), (F.col("n_nationkey") / 25).alias("auc_pr"), (F.col("n_regionkey") * 20.0).alias("p99"), (F.col("n_nationkey") % 7 / 10).alias("mean_evasion")
    )
    return ranking.composite_rank(rows).select("model", "reason")


@query(
    "error_cards",
    """
    SELECT item_id, regexp_replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'), '(?i)(the|&lt;|und)', '<mark>\\1</mark>', 'g') AS html FROM benchmark
    """,
)
def error_cards(spark, sf_dir):
    """Texts escaped for a page, with what a pattern finds marked."""
    return table(spark, sf_dir, "benchmark").select("item_id", highlighted("text", "the|&lt;|und").alias("html"))


AUC = """
    (SELECT round((sum(r) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2)
     / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0)), 9)
     FROM (SELECT label, rank() OVER (ORDER BY {p}) + (count(*) OVER (PARTITION BY {p}) - 1) / 2 AS r FROM scored))
"""


@query("counterfactual", f"WITH {SCORED} SELECT a AS auc_before, b AS auc_after, round(a - b, 9) AS delta FROM (SELECT {AUC.format(p='prob')} AS a, {AUC.format(p='(id * 53 % 89)')} AS b)")
def counterfactual(spark, sf_dir):
    """Ranking quality of scores before and after fillers were swapped, and the difference."""
    rows = scored(spark, sf_dir).withColumn("prob_swapped", (F.col("id") * 53 % 89).cast("double"))
    out = leakage.counterfactual_delta(rows)
    return out.select(F.round("auc_before", 9).alias("auc_before"), F.round("auc_after", 9).alias("auc_after"), F.round(F.round("auc_before", 9) - F.round("auc_after", 9), 9).alias("delta"))


@query("smoothing_sweep", f"WITH {LABELLED} SELECT e AS eps, count(*) AS n, count(*) AS n_same FROM labelled, (SELECT unnest([0.0, 0.05, 0.1, 0.2, 0.5]) AS e) GROUP BY e")
def smoothing_sweep(spark, sf_dir):
    return metrics.smoothing_sweep(labelled(spark, sf_dir), [0.0, 0.05, 0.1, 0.2, 0.5])


@query("mean_rates", f"WITH {SCORED} SELECT attack_class, round(avg(1.0 - pred), 9) AS evasion FROM scored WHERE label = 1 GROUP BY attack_class")
def mean_rates(spark, sf_dir):
    """Share of each class's attacks that go unnoticed."""
    counts = metrics.confusion(scored(spark, sf_dir).filter("label = 1"), by=["attack_class"])
    return metrics.rates(counts, guard="one").select("attack_class", F.round("fnr", 9).alias("evasion"))


@query(
    "gram_weights",
    """
    WITH w AS (SELECT item_id, ' ' || unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) || ' ' AS w FROM benchmark),
    g AS (SELECT DISTINCT item_id, unnest(list_concat(list_transform(range(1, length(w) + 1), lambda i: substr(w, i, 1)), list_transform(range(1, length(w)), lambda i: substr(w, i, 2)),
          list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3)))) AS gram FROM w)
    SELECT gram, round(ln(((SELECT count(*) FROM benchmark) + 1) / (count(*) + 1)), 9) AS idf FROM g GROUP BY gram
    """,
)
def gram_weights(spark, sf_dir):
    """The inverse document frequency of every character n-gram, as the weighted probe has it."""
    rows = table(spark, sf_dir, "benchmark").select(probes.word_ngrams("text").alias("grams"))
    model = Pipeline(stages=probes.weighted(1 << 20)).fit(rows)
    vocabulary: CountVectorizerModel = model.stages[0]
    return spark.createDataFrame([(g, round(float(w), 9)) for g, w in zip(vocabulary.vocabulary, model.stages[1].idf)], "gram string, idf double")


@query("boosted_probe")
def boosted_probe(spark, sf_dir):
    """Metrics of boosted trees, stopped early on a hashed quarter of the rows that they may learn from."""
    rows = probes.prepared(labelled(spark, sf_dir)).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(4)))
    model = probes.boosted_probe(rows.filter("part < 3").withColumn("stop_by", F.col("part") == 2), trees=20, validation="stop_by")
    return metrics.binary_metrics(probes.scores(model, rows.filter("part = 3")))


@query(
    "token_weights",
    """
    WITH t AS (SELECT item_id, string_split(text, ' ')[k] AS token, k, CASE WHEN k % 2 = 0 THEN -1 ELSE 1 END * (k * 7 % 11) AS weight FROM (SELECT item_id, text, unnest(range(1, len(string_split(text, ' ')) + 1)) AS k FROM benchmark))
    SELECT item_id, token, weight, CAST(row_number() OVER (PARTITION BY item_id ORDER BY abs(weight) DESC, k) AS INTEGER) AS place FROM t QUALIFY place <= 5
    """,
)
def token_weights(spark, sf_dir):
    """The five tokens of each text that weigh most, whatever the sign."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("k", "token")).withColumn("k", F.col("k") + 1)
    rows = rows.withColumn("weight", F.when(F.col("k") % 2 == 0, -1).otherwise(1) * (F.col("k") * 7 % 11))
    return probes.top_weights(rows, "item_id", "weight", 5, "k").select("item_id", "token", "weight", "place")


SOFT = "list_transform({a}, lambda x: exp(x / {t}) / list_sum(list_transform({a}, lambda y: exp(y / {t}))))"


@query(
    "distillation_losses",
    f"""
    WITH e AS (SELECT vec_id, list_transform(embedding[1:4], lambda x: CAST(x AS DOUBLE) * 3) AS s, list_transform(embedding[5:8], lambda x: CAST(x AS DOUBLE) * 3) AS t FROM embeddings),
    p AS (SELECT vec_id, {SOFT.format(a="t", t="4.0")} AS p, {SOFT.format(a="s", t="4.0")} AS q, {SOFT.format(a="s", t="1.0")} AS h FROM e)
    SELECT vec_id, round(0.3 * -ln(h[vec_id % 4 + 1]) + 0.7 * 16 * list_sum(list_transform(list_zip(p, q), lambda z: z[1] * ln(z[1] / z[2]))), 6) AS loss FROM p
    """,
)
def distillation_losses(spark, sf_dir):
    part = lambda a: F.transform(F.slice("embedding", a, 4), lambda x: x.cast("double") * 3)
    loss = ranking.distillation_loss(part(1), part(5), (F.col("vec_id") % 4).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(loss, 6).alias("loss"))


@query(
    "best_checkpoints",
    """
    WITH e AS (SELECT n_nationkey AS epoch, n_nationkey * 7 % 25 / 25 AS macro_f1 FROM nation),
    b AS (SELECT *, epoch - arg_max(epoch, macro_f1) OVER (ORDER BY epoch) AS since FROM e),
    s AS (SELECT *, coalesce(max(CASE WHEN since >= 3 THEN 1 ELSE 0 END) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM b)
    (SELECT 'all' AS run, epoch, macro_f1 FROM e ORDER BY macro_f1 DESC, epoch LIMIT 1) UNION ALL (SELECT 'patient', epoch, macro_f1 FROM s WHERE stopped = 0 ORDER BY macro_f1 DESC, epoch LIMIT 1)
    """,
)
def best_checkpoints(spark, sf_dir):
    """The best epoch of a run, and of one that stops after three epochs without a better one."""
    e = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("epoch"), (F.col("n_nationkey") * 7 % 25 / 25).alias("macro_f1"))
    one = lambda name, patience: jobs.best_checkpoint(e, patience=patience).select(F.lit(name).alias("run"), "epoch", "macro_f1")
    return one("all", None).unionAll(one("patient", 3))


@query("memory_report", "SELECT n_name AS model, round((n_nationkey + 1) * 1e6 * 4 / 1048576, 9) AS megabytes, round(25 / (n_nationkey + 1), 9) AS compression FROM nation")
def memory_report(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    last = n.orderBy(F.desc("n_nationkey")).first()["n_name"]
    rows = n.select(F.col("n_name").alias("model"), ((F.col("n_nationkey") + 1) * 1_000_000).alias("n_params"), F.lit(4).alias("bytes_per_param"))
    return ranking.memory_report(rows, last).select("model", F.round("megabytes", 9).alias("megabytes"), F.round("compression", 9).alias("compression"))


@query(
    "report_assembly",
    "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{p}', {'true' if n in ('slo', 'dedup_report') else 'false'})" for n, p in files.REPORTS.items()) + ") t(name, path, found)",
)
def report_assembly(spark, sf_dir):
    """Which of the known reports are there; one that is broken is missing."""
    with tempfile.TemporaryDirectory() as own:
        for name in ("slo", "dedup_report"):
            sinks.write_report(table(spark, sf_dir, "region").limit(1), own, name)
        files.write_atomic(files.report_path(own, "gate_summary"), b"{broken")
        return spark.createDataFrame(files.report_status(own), "name string, path string, found boolean")


@query(
    "run_control",
    """
    SELECT * FROM (VALUES ('plan', 'load', 'planned'), ('plan', 'train', 'planned'), ('run', 'load', 'skipped'), ('run', 'train', 'done'), ('forced', 'load', 'done'), ('forced', 'train', 'done'),
        ('inputs', 'missing', 'absent'), ('sections', 'counts', '5'), ('sections', 'names', '5')) t(part, name, status)
    """,
)
def run_control(spark, sf_dir):
    """Steps in the order of their needs, planned, skipped where their output is there, and forced; inputs; sections of a report."""
    out = []
    with tempfile.TemporaryDirectory() as own:
        files.write_atomic(f"{own}/loaded", b"x")
        steps = [jobs.Job("train", lambda: None, ["load"]), jobs.Job("load", lambda: None, done=lambda: files.done(f"{own}/loaded"))]
        for part, options in (("plan", {"dry": True}), ("run", {}), ("forced", {"force": True})):
            out += [(part, r["name"], r["status"]) for r in jobs.timings(spark, jobs.run(steps, ["train"], **options)).filter("seconds >= 0").collect()]
        out += [("inputs", p.rsplit("/", 1)[1], "absent") for p in files.missing_inputs([f"{own}/loaded", f"{own}/missing"])]
    region = table(spark, sf_dir, "region")
    parts = jobs.sections(region, {"counts": lambda t: t.agg(F.count("*").alias("n")), "names": lambda t: t.agg(F.countDistinct("r_name").alias("n"))})
    out += [("sections", name, str(t.first()["n"])) for name, t in parts.items()]
    return spark.createDataFrame(out, "part string, name string, status string")


@query("seeded_draws", "SELECT item_id, true AS same, true AS inside FROM benchmark")
def seeded_draws(spark, sf_dir):
    """Draws of a row are the same on any partitioning, and lie in their range."""
    t = table(spark, sf_dir, "benchmark").select("item_id")
    drawn = lambda df: df.select("item_id", seeded.uniform(5, "item_id").alias("u"), seeded.pick(["a", "b", "c"], 6, "item_id").alias("p"))
    other = drawn(t.repartition(5)).select("item_id", F.col("u").alias("v"), F.col("p").alias("q"))
    met = drawn(t).join(other, "item_id")
    return met.select("item_id", ((F.col("u") == F.col("v")) & (F.col("p") == F.col("q"))).alias("same"), ((F.col("u") >= 0) & (F.col("u") < 1) & F.col("p").isin("a", "b", "c")).alias("inside"))
