"""Corpus queries over documents, labels, events and pages: duplicates, profiles, inventories, shifts, leakage, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions.text import byte_entropy, text_or_empty
from tidewright.operators import dedup, leakage, profile, splits
from tidewright.plans.registry import query
from tidewright.session import table


def labelled(spark, sf_dir):
    """Documents with labels as the canonical columns id, raw, label, attack_class and source."""
    d, y = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(y, "doc_id").select(
        F.col("doc_id").alias("id"), F.col("text").alias("raw"), F.col("toxic").cast("int").alias("label"), F.col("lang").alias("attack_class"), "source", "quality"
    )


LABELLED = """
labelled AS (SELECT d.doc_id AS id, d.text AS raw, CAST(l.toxic AS INTEGER) AS label, d.lang AS attack_class, d.source, l.quality
             FROM documents d JOIN labels l USING (doc_id))
"""


@query(
    "dedup_length_profile",
    """
    WITH firsts AS (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY doc_id) = 1)
    SELECT source, count(*) AS n_rows, count(DISTINCT lang) AS n_langs, round(quantile_cont(length(text), 0.5), 6) AS p50,
           round(quantile_cont(length(text), 0.95), 6) AS p95, round(quantile_cont(length(text), 0.99), 6) AS p99
    FROM firsts GROUP BY source
    """,
)
def dedup_length_profile(spark, sf_dir):
    size = F.length("text")
    firsts = dedup.exact_firsts(table(spark, sf_dir, "documents"), "text", "doc_id")
    return firsts.groupBy("source").agg(
        F.count("*").alias("n_rows"), F.countDistinct("lang").alias("n_langs"), *[F.round(F.percentile(size, F.lit(q)), 6).alias(f"p{round(q * 100)}") for q in (0.5, 0.95, 0.99)]
    )


@query(
    "exact_dedup",
    "SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY doc_id) = 1",
)
def exact_dedup(spark, sf_dir):
    return dedup.exact_firsts(table(spark, sf_dir, "documents"), "text", "doc_id").select("doc_id", "lang", "source")


@query(
    "exact_dedup_report",
    """
    WITH g AS (SELECT sha256(coalesce(text, '')) AS h, count(*) AS n FROM documents GROUP BY 1)
    SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_distinct, CAST(sum(n) - count(*) AS BIGINT) AS n_removed, max(n) AS largest_group FROM g
    """,
)
def exact_dedup_report(spark, sf_dir):
    return dedup.exact_report(table(spark, sf_dir, "documents"), "text")


@query(
    "dedup_samples",
    """
    WITH m AS (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY sha256(coalesce(text, ''))) AS original FROM documents)
    SELECT original, doc_id AS duplicate, substr(text, 1, 200) AS preview FROM m WHERE doc_id > original ORDER BY doc_id LIMIT 3
    """,
)
def dedup_samples(spark, sf_dir):
    return dedup.sample_pairs(table(spark, sf_dir, "documents"), "text", "doc_id")


@query(
    "dedup_by_id",
    """
    WITH every AS (SELECT doc_id, 'labels' AS origin, 0 AS t FROM labels UNION ALL SELECT doc_id, 'documents', 1 FROM documents)
    SELECT doc_id, arg_min(origin, t) AS origin FROM every GROUP BY doc_id
    """,
)
def dedup_by_id(spark, sf_dir):
    named = lambda t: table(spark, sf_dir, t).select("doc_id", F.lit(t).alias("origin"))
    return dedup.first_by_id([named("labels"), named("documents")], "doc_id").select("doc_id", "origin")


GRAMS = "list_distinct(list_transform(range(1, greatest(1, length(text) - 2) + 1), lambda i: substr(text, i, 3)))"


@query(
    "near_dup_pairs",
    f"""
    WITH firsts AS (SELECT doc_id, lang, {GRAMS} AS g FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY doc_id) = 1),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, len(list_intersect(a.g, b.g)) AS k, len(a.g) + len(b.g) AS n FROM firsts a JOIN firsts b
          ON a.lang = b.lang AND a.doc_id < b.doc_id AND len(a.g) >= 40 AND len(b.g) >= 40 AND least(len(a.g), len(b.g)) >= 0.85 * greatest(len(a.g), len(b.g)))
    SELECT a, b, round(k / (n - k), 9) AS similarity FROM p WHERE k / (n - k) >= 0.85
    """,
)
def near_dup_pairs(spark, sf_dir):
    """Pairs of documents of one language that are similar at 0.85, found by bands and verified."""
    docs = table(spark, sf_dir, "documents")
    return dedup.similar_pairs(docs, "doc_id", "text", 0.85, group="lang", firsts=True).withColumn("similarity", F.round("similarity", 9))


@query("near_dedup")
def near_dedup(spark, sf_dir):
    """Greedy first-wins near dedup of documents at 0.85, inside each language."""
    docs = table(spark, sf_dir, "documents")
    pairs = dedup.similar_pairs(docs, "doc_id", "text", 0.85, group="lang", firsts=True)
    # The rows need no text any more: its digest tells copies.
    firsts = dedup.exact_firsts(docs.select("doc_id", "lang", "source", F.sha2(text_or_empty("text"), 256).alias("text")), "text", "doc_id")
    return dedup.greedy_kept(firsts, pairs, "doc_id").select("doc_id", "lang", "source")


@query(
    "contamination_filter",
    f"""
    WITH d AS (SELECT doc_id, unnest({GRAMS}) AS g FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)), i AS (SELECT item_id, unnest({GRAMS}) AS g FROM benchmark),
    dn AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1), bn AS (SELECT item_id, count(*) AS n FROM i GROUP BY 1),
    p AS (SELECT doc_id, item_id, count(*) AS k FROM d JOIN i USING (g) GROUP BY 1, 2)
    SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT p.doc_id FROM p JOIN dn USING (doc_id) JOIN bn USING (item_id) WHERE k >= 0.7 * (dn.n + bn.n - k))
    """,
)
def contamination_filter(spark, sf_dir):
    """Documents without a benchmark item that is similar at 0.70."""
    held = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return dedup.without_similar(table(spark, sf_dir, "documents"), held, "doc_id", "text", 0.70, same_id=True).select("doc_id")


@query(
    "split_leakage",
    f"""
    WITH r AS (SELECT doc_id, coalesce(text, '') AS text, (row_number() OVER (PARTITION BY lang ORDER BY sha256('42|' || doc_id), doc_id) - 1) / count(*) OVER (PARTITION BY lang) AS place FROM documents),
    g AS (SELECT doc_id, place, unnest({GRAMS}) AS g FROM r), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
    p AS (SELECT h.doc_id AS a, t.doc_id AS b, count(*) AS k FROM g h JOIN g t ON h.g = t.g WHERE (h.place < 0.02 OR h.place >= 0.05 AND h.place < 0.15) AND t.place >= 0.3 GROUP BY 1, 2)
    SELECT doc_id FROM r WHERE (place < 0.02 OR place >= 0.05 AND place < 0.15)
      AND doc_id NOT IN (SELECT a FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k >= 0.7 * (x.n + y.n - k))
    """,
)
def split_leakage(spark, sf_dir):
    """Rows of the test and canary splits without a similar row in train."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    split = splits.exact_quota_split(docs.drop("text"), "doc_id", "lang").filter("split IN ('test', 'canary', 'train')")
    split = split.select(F.col("doc_id").alias("key"), F.col("lang").alias("group"), F.expr("split = 'train'").alias("held"))
    # Sets move to the splits, as they are smaller than the texts.
    sides = dedup.with_sets(docs, "text").join(split, (F.col("doc_id") == F.col("key")) & F.col("lang").eqNullSafe(F.col("group")))
    found = dedup.leaking(sides.select("key", "size", "grams", "held"), 0.70)
    return split.filter("NOT held").join(found, "key", "left_anti").select(F.col("key").alias("doc_id"))


@query(
    "shingle_counts",
    """
    SELECT item_id, len(list_distinct(list_transform(range(1, greatest(1, length(text) - 2) + 1), lambda i: substr(text, i, 3)))) AS n_shingles
    FROM benchmark
    """,
)
def shingle_counts(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(dedup.shingle_set("text")).cast("long").alias("n_shingles"))


@query(
    "corpus_stats",
    f"""
    WITH {LABELLED}
    SELECT count(*) AS total, count(*) FILTER (WHERE label = 0) AS benign, count(*) FILTER (WHERE label = 1) AS malicious,
           count(*) FILTER (WHERE label = 0) / greatest(1, count(*) FILTER (WHERE label = 1)) AS imbalance FROM labelled
    """,
)
def corpus_stats(spark, sf_dir):
    return profile.label_counts(labelled(spark, sf_dir))


@query(
    "source_counts",
    "SELECT source, lang, count(*) AS n, count(*) / (SELECT count(*) FROM documents) AS share FROM documents GROUP BY source, lang",
)
def source_counts(spark, sf_dir):
    return profile.value_counts(table(spark, sf_dir, "documents"), "source", "lang")


@query(
    "length_distribution",
    """
    SELECT lang, count(*) AS n, min(length(text)) AS min_len, max(length(text)) AS max_len, avg(length(text)) AS mean_len,
           quantile_cont(length(text), 0.5) AS p50, quantile_cont(length(text), 0.75) AS p75, round(quantile_cont(length(text), 0.9), 6) AS p90,
           round(quantile_cont(length(text), 0.95), 6) AS p95, round(quantile_cont(length(text), 0.99), 6) AS p99, avg(length(text)) / 4 AS mean_tokens,
           avg(CASE WHEN length(text) > 1024 THEN 1.0 ELSE 0.0 END) * 100 AS pct_truncated
    FROM documents GROUP BY lang
    """,
)
def length_distribution(spark, sf_dir):
    out = profile.length_summary(table(spark, sf_dir, "documents"), "text", ["lang"])
    return out.withColumns({c: F.round(c, 6) for c in ("p90", "p95", "p99")})


@query(
    "grouped_describe",
    """
    SELECT lang, count(n_chars) AS n, avg(n_chars) AS mean, round(stddev_samp(n_chars), 6) AS std, CAST(min(n_chars) AS BIGINT) AS min,
           quantile_cont(n_chars, 0.25) AS p25, quantile_cont(n_chars, 0.5) AS p50, quantile_cont(n_chars, 0.75) AS p75, max(n_chars) AS max
    FROM documents GROUP BY lang
    """,
)
def grouped_describe(spark, sf_dir):
    return profile.describe(table(spark, sf_dir, "documents"), F.col("n_chars"), "lang").withColumn("std", F.round("std", 6))


@query(
    "taxonomy_inventory",
    """
    WITH need AS (SELECT unnest(['en', 'de', 'fr', 'it']) AS lang), c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang)
    SELECT coalesce(c.lang, need.lang) AS lang, coalesce(n, 0) AS n, need.lang IS NOT NULL AS required,
           CASE WHEN coalesce(n, 0) = 0 THEN 'MISSING' WHEN n < 500 THEN 'LOW' ELSE 'OK' END AS status,
           CASE WHEN need.lang IS NOT NULL THEN greatest(0, 5000 - coalesce(n, 0)) ELSE 0 END AS gap
    FROM c FULL JOIN need ON c.lang = need.lang
    """,
)
def taxonomy_inventory(spark, sf_dir):
    return profile.inventory(table(spark, sf_dir, "documents"), "lang", ["en", "de", "fr", "it"])


@query(
    "coverage_matrix",
    """
    SELECT source, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'de') AS de,
           count(*) FILTER (WHERE lang = 'fr') AS fr, count(*) FILTER (WHERE lang = 'es') AS es FROM documents GROUP BY source
    """,
)
def coverage_matrix(spark, sf_dir):
    return profile.coverage(table(spark, sf_dir, "documents"), "source", "lang", ["en", "de", "fr", "es"])


@query(
    "null_and_distinct_counts",
    """
    SELECT count(*) FILTER (WHERE text IS NULL) AS text, count(*) FILTER (WHERE lang IS NULL) AS lang, count(DISTINCT source) AS sources FROM documents
    """,
)
def null_and_distinct_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    nulls = profile.null_counts(d.select("text", "lang"))
    return nulls.crossJoin(profile.distinct_counts(d, "source").withColumnRenamed("source", "sources"))


@query(
    "language_gini",
    """
    WITH c AS (SELECT CAST(count(*) AS DOUBLE) AS v, row_number() OVER (ORDER BY count(*)) AS i FROM documents GROUP BY lang)
    SELECT round(abs(sum(v * (2 * i - (SELECT count(*) FROM c) - 1))) / (count(*) * sum(v)), 9) AS gini FROM c
    """,
)
def language_gini(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return profile.gini(counts).withColumn("gini", F.round("gini", 9))


@query(
    "distribution_shift",
    f"""
    WITH {LABELLED},
    p AS (SELECT attack_class AS k, count(*) / (SELECT count(*) FROM labelled WHERE label = 0) AS x FROM labelled WHERE label = 0 GROUP BY 1),
    q AS (SELECT attack_class AS k, count(*) / (SELECT count(*) FROM labelled WHERE label = 1) AS y FROM labelled WHERE label = 1 GROUP BY 1),
    m AS (SELECT CASE WHEN coalesce(x, 0) > 0 THEN x ELSE 1e-10 END AS x, CASE WHEN coalesce(y, 0) > 0 THEN y ELSE 1e-10 END AS y,
                 CASE WHEN coalesce(x, 0) + coalesce(y, 0) > 0 THEN (coalesce(x, 0) + coalesce(y, 0)) / 2 ELSE 1e-10 END AS m
          FROM p FULL JOIN q ON p.k = q.k),
    s AS (SELECT sum(x * ln((x + 1e-10) / (y + 1e-10))) AS kl, sum(y * ln((y + 1e-10) / (x + 1e-10))) AS kl_reverse,
                 least(1.0, (sum(x * ln((x + 1e-10) / (m + 1e-10))) + sum(y * ln((y + 1e-10) / (m + 1e-10)))) / 2 / ln(2.0)) AS jsd FROM m)
    SELECT round(kl, 9) AS kl, round(kl_reverse, 9) AS kl_reverse, round(jsd, 9) AS jsd,
           CASE WHEN jsd < 0.05 THEN 'low' WHEN jsd < 0.15 THEN 'moderate' ELSE 'high' END AS band FROM s
    """,
)
def distribution_shift(spark, sf_dir):
    rows = labelled(spark, sf_dir).groupBy("attack_class", "label").agg(F.count("*").alias("n"))
    out = profile.shift(rows.filter("label = 0"), rows.filter("label = 1"), "attack_class")
    return out.withColumns({c: F.round(c, 9) for c in ("kl", "kl_reverse", "jsd")})


@query(
    "byte_entropy",
    """
    WITH b AS (SELECT item_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS b FROM benchmark),
    c AS (SELECT item_id, b, count(*) AS n FROM b GROUP BY 1, 2), t AS (SELECT item_id, sum(n) AS t FROM c GROUP BY 1)
    SELECT item_id, round(-sum(n / t * log2(n / t)), 6) AS entropy FROM c JOIN t USING (item_id) GROUP BY item_id
    """,
)
def entropy(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.round(byte_entropy("text"), 6).alias("entropy"))


TOKENS = r"string_split_regex(lower(raw), '[\s?&=/.;:(){}\[\]<>#''\"%,|\\+*`]+')"


@query(
    "token_leakage",
    f"""
    WITH {LABELLED},
    t AS (SELECT DISTINCT id, label, token FROM (SELECT id, label, unnest({TOKENS}) AS token FROM labelled) WHERE token <> ''),
    c AS (SELECT token, count(*) AS d, CAST(sum(label) AS BIGINT) AS a FROM t GROUP BY token HAVING count(*) >= 5),
    w AS (SELECT c.*, n, p FROM c, (SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS p FROM labelled))
    SELECT token, d AS df, a AS df_pos, a / d AS p_positive, round(a / d - p / n, 9) AS lift,
           CASE WHEN a > 0 THEN round(log2(a * n / (CAST(p AS DOUBLE) * d)), 9) ELSE -99 END AS pmi,
           round(greatest(0, CASE WHEN a > 0 THEN a / n * log2(CAST(a AS DOUBLE) * n / (CAST(d AS DOUBLE) * p)) ELSE 0 END
             + CASE WHEN d - a > 0 THEN (d - a) / n * log2(CAST(d - a AS DOUBLE) * n / (CAST(d AS DOUBLE) * (n - p))) ELSE 0 END
             + CASE WHEN p - a > 0 THEN (p - a) / n * log2(CAST(p - a AS DOUBLE) * n / (CAST(n - d AS DOUBLE) * p)) ELSE 0 END
             + CASE WHEN n - d - p + a > 0 THEN (n - d - p + a) / n * log2(CAST(n - d - p + a AS DOUBLE) * n / (CAST(n - d AS DOUBLE) * (n - p))) ELSE 0 END), 9) AS mi,
           regexp_full_match(token, '[0-9]+') OR (length(token) >= 8 AND regexp_full_match(token, '[0-9a-f]+'))
             OR (length(token) >= 4 AND regexp_matches(token, '[a-z]') AND regexp_matches(token, '[0-9]')) AS incidental
    FROM w
    """,
)
def token_leakage(spark, sf_dir):
    out = leakage.token_leakage(labelled(spark, sf_dir))
    return out.withColumns({c: F.round(c, 9) for c in ("lift", "pmi", "mi")})


@query(
    "leakage_rollup",
    f"""
    WITH {LABELLED},
    t AS (SELECT DISTINCT id, label, token FROM (SELECT id, label, unnest({TOKENS}) AS token FROM labelled) WHERE token <> ''),
    c AS (SELECT token, count(*) AS d, sum(label) AS a FROM t GROUP BY token HAVING count(*) >= 5)
    SELECT count(*) AS n_tokens, max(round(greatest(0, CASE WHEN a > 0 THEN a / n * log2(CAST(a AS DOUBLE) * n / (CAST(d AS DOUBLE) * p)) ELSE 0 END
             + CASE WHEN d - a > 0 THEN (d - a) / n * log2(CAST(d - a AS DOUBLE) * n / (CAST(d AS DOUBLE) * (n - p))) ELSE 0 END
             + CASE WHEN p - a > 0 THEN (p - a) / n * log2(CAST(p - a AS DOUBLE) * n / (CAST(n - d AS DOUBLE) * p)) ELSE 0 END
             + CASE WHEN n - d - p + a > 0 THEN (n - d - p + a) / n * log2(CAST(n - d - p + a AS DOUBLE) * n / (CAST(n - d AS DOUBLE) * (n - p))) ELSE 0 END), 9)) AS max_mi,
           count(*) FILTER (WHERE a / d <= 0.02 OR a / d >= 0.98) AS n_strong,
           count(*) FILTER (WHERE (a / d <= 0.02 OR a / d >= 0.98) AND (regexp_full_match(token, '[0-9]+') OR (length(token) >= 8 AND regexp_full_match(token, '[0-9a-f]+'))
             OR (length(token) >= 4 AND regexp_matches(token, '[a-z]') AND regexp_matches(token, '[0-9]')))) AS n_strong_incidental
    FROM c, (SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS p FROM labelled)
    """,
)
def leakage_rollup(spark, sf_dir):
    return leakage.leakage_rollup(leakage.token_leakage(labelled(spark, sf_dir))).withColumn("max_mi", F.round("max_mi", 9))


@query(
    "neutral_text",
    r"""
    SELECT page_id, regexp_replace(regexp_replace(url, '(?i)\b(?:[a-z0-9-]+\.)+(?:com|net|org|io|dev|app|local|internal|test|example|site|online|info|biz|co|uk|de|fr|ru|cn|xyz|top)\b', 'host.example', 'g'),
           '\b\d{2,}\b', '11', 'g') AS neutral FROM pages
    """,
)
def neutral_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", leakage.neutralised("url").alias("neutral"))


@query(
    "stratified_split",
    """
    WITH r AS (SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY sha256('42|' || doc_id), doc_id) - 1) / count(*) OVER (PARTITION BY lang) AS place FROM documents)
    SELECT doc_id, lang, CASE WHEN place < 0.02 THEN 'canary' WHEN place < 0.05 THEN 'adversarial' WHEN place < 0.15 THEN 'test'
           WHEN place < 0.3 THEN 'val' ELSE 'train' END AS split FROM r
    """,
)
def stratified_split(spark, sf_dir):
    return splits.exact_quota_split(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang")


@query(
    "composite_split",
    f"""
    WITH {LABELLED},
    k AS (SELECT id, concat_ws('_', label, attack_class, CASE WHEN contains(lower(coalesce(source, '')), 'kaggle') THEN 'real_kaggle' ELSE 'real_other' END) AS k FROM labelled),
    c AS (SELECT id, CASE WHEN count(*) OVER (PARTITION BY k) < 2 THEN '(rare)' ELSE k END AS s FROM k),
    r AS (SELECT id, s, (row_number() OVER (PARTITION BY s ORDER BY sha256('42|' || id), id) - 1) / count(*) OVER (PARTITION BY s) AS place FROM c)
    SELECT id, CASE WHEN place < 0.02 THEN 'canary' WHEN place < 0.05 THEN 'adversarial' WHEN place < 0.15 THEN 'test' WHEN place < 0.3 THEN 'val' ELSE 'train' END AS split FROM r
    """,
)
def composite_split(spark, sf_dir):
    """The split of each row by the composite stratum of label, class and source kind; strata of one row are pooled."""
    key = splits.stratum("label", "attack_class", splits.source_bucket("source"))
    return splits.stratified_split(labelled(spark, sf_dir), "id", key).select("id", "split")


@query(
    "split_health",
    f"""
    WITH {LABELLED},
    r AS (SELECT label, (row_number() OVER (PARTITION BY attack_class ORDER BY sha256('42|' || id), id) - 1) / count(*) OVER (PARTITION BY attack_class) AS place FROM labelled),
    s AS (SELECT label, CASE WHEN place < 0.02 THEN 'canary' WHEN place < 0.05 THEN 'adversarial' WHEN place < 0.15 THEN 'test' WHEN place < 0.3 THEN 'val' ELSE 'train' END AS split FROM r),
    g AS (SELECT split, count(*) AS total, count(*) FILTER (WHERE label = 0) AS benign, count(*) FILTER (WHERE label = 1) AS malicious FROM s GROUP BY split),
    w AS (SELECT count(*) FILTER (WHERE label = 0) / greatest(1, count(*) FILTER (WHERE label = 1)) AS whole FROM labelled)
    SELECT split, total, benign, malicious, benign / greatest(1, malicious) AS imbalance,
           benign / greatest(1, malicious) > 2 * whole OR benign / greatest(1, malicious) < 0.5 * whole AS skewed FROM g, w
    """,
)
def split_health(spark, sf_dir):
    return profile.split_health(splits.exact_quota_split(labelled(spark, sf_dir), "id", "attack_class"))


@query(
    "per_class_sample",
    "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sha256('42|' || doc_id), doc_id) <= 5",
)
def per_class_sample(spark, sf_dir):
    return splits.per_stratum(table(spark, sf_dir, "documents").select("doc_id", "lang"), 5, "doc_id", "lang")


@query("balanced_sample", """
    WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('42|' || doc_id), doc_id) AS r FROM documents)
    SELECT doc_id, lang FROM r ORDER BY CASE WHEN r > 25 THEN 1 ELSE 0 END, sha256('43|' || doc_id), doc_id LIMIT 100
    """)  # fmt: skip
def balanced_sample(spark, sf_dir):
    return splits.balanced_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), 100, "doc_id", "lang")


@query("subsample", "SELECT doc_id FROM documents ORDER BY sha256('42|' || doc_id), doc_id LIMIT 100")
def subsample(spark, sf_dir):
    return splits.subsample(table(spark, sf_dir, "documents").select("doc_id"), 100, "doc_id")


@query(
    "first_share",
    """
    WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)
    SELECT doc_id, lang FROM r WHERE r <= floor(n * 0.25)
    """,
)
def first_share(spark, sf_dir):
    return splits.first_share(table(spark, sf_dir, "documents").select("doc_id", "lang"), 0.25, "lang", "doc_id")
