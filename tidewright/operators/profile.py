"""Corpus analytics: counts, lengths, coverage, inventories, distances of distributions, and traffic profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewright.functions.text import path_depth, text_or_empty
from tidewright.session import cut


def label_counts(df: DataFrame, by: list[str] | None = None, label: str = "label") -> DataFrame:
    """total, benign, malicious and their ratio."""
    benign, malicious = F.sum((F.col(label) == 0).cast("long")), F.sum((F.col(label) == 1).cast("long"))
    return df.groupBy(*(by or [])).agg(
        F.count("*").alias("total"), benign.alias("benign"), malicious.alias("malicious"), (benign / F.greatest(F.lit(1), malicious)).alias("imbalance")
    )


def value_counts(df: DataFrame, *by: str) -> DataFrame:
    """Rows and share of each value; shares come from one total row."""
    counts = df.groupBy(*by).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("_total")).drop("_total")


def length_summary(df: DataFrame, text: str = "raw", by: list[str] | None = None, limit: int = 256) -> DataFrame:
    """Exact percentiles of the length in characters, and the percentage above four times a token limit."""
    size = F.length(text_or_empty(text))
    at = lambda p: F.percentile(size, F.lit(p / 100)).alias(f"p{p}")
    return df.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.min(size).alias("min_len"), F.max(size).alias("max_len"), F.avg(size).alias("mean_len"),
        *[at(p) for p in (50, 75, 90, 95, 99)], (F.avg(size) / 4).alias("mean_tokens"), (F.avg((size > 4 * limit).cast("double")) * 100).alias("pct_truncated"),
    )


def exact_percentiles(df: DataFrame, value: Column, by: list[str], shares: dict[str, float]) -> DataFrame:
    """by and one column for each share: exact percentiles with linear interpolation, as F.percentile has them.

    F.percentile keeps every distinct value of a group in one task, which for doubles has no bound. Here distinct values are
    counted, dealt by ranges of group and value, and numbered inside a range; the counts of the ranges before it give each value
    its ranks. Null values take no part; a group without values has nulls.
    """
    names = [f"_by_{k}" for k in range(len(by))]
    rows = df.select(*[F.col(c).alias(n) for c, n in zip(by, names)], value.cast("double").alias("_v"))
    counted = rows.groupBy(*names, "_v").agg(F.count("_v").alias("_c"))
    # A range has to hold the same rows when its counts are summed and when its rows are numbered.
    placed = cut(counted.repartitionByRange(*names, "_v").withColumn("_part", F.spark_partition_id()))
    group = W.partitionBy(*names) if names else W.partitionBy(F.lit(0))
    sums = placed.groupBy(*names, "_part").agg(F.sum("_c").alias("_s"))
    sums = sums.withColumns({"_before": F.coalesce(F.sum("_s").over(group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "_n": F.sum("_s").over(group)})
    sums = sums.select(*[F.col(n).alias(f"{n}r") for n in names], F.col("_part").alias("_partr"), "_before", "_n")
    same = [F.col(n).eqNullSafe(F.col(f"{n}r")) for n in names] + [F.col("_part") == F.col("_partr")]
    before = F.coalesce(F.sum("_c").over(W.partitionBy(*names, "_part").orderBy("_v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = placed.withColumn("_inside", before).join(sums, same).withColumn("_first", F.col("_before") + F.col("_inside"))
    picked = []
    for k, share in enumerate(shares.values()):
        place = F.lit(share) * (F.col("_n") - 1)
        at = lambda rank: F.max(F.when((F.col("_first") <= rank) & (rank < F.col("_first") + F.col("_c")), F.col("_v")))
        picked += [F.max(place).alias(f"_place_{k}"), at(F.floor(place)).alias(f"_lo_{k}"), at(F.ceil(place)).alias(f"_hi_{k}")]
    found = ranked.groupBy(*names).agg(*picked)
    out = []
    for k, name in enumerate(shares):
        place, lo, hi = (F.col(f"{c}_{k}") for c in ("_place", "_lo", "_hi"))
        out.append(F.when(F.floor(place) == F.ceil(place), lo).otherwise((F.ceil(place) - place) * lo + (place - F.floor(place)) * hi).alias(name))
    return found.select(*[F.col(n).alias(c) for c, n in zip(by, names)], *out)


def beside(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Two tables of one row a group, side by side; null groups meet."""
    if not by:
        return left.crossJoin(right)
    renamed = right.select(*[F.col(c).alias(f"_{k}r") for k, c in enumerate(by)], *[c for c in right.columns if c not in by])
    return left.join(renamed, [F.col(c).eqNullSafe(F.col(f"_{k}r")) for k, c in enumerate(by)], "left").drop(*[f"_{k}r" for k in range(len(by))])


def describe(df: DataFrame, value: Column, *by: str) -> DataFrame:
    """Count, mean, deviation, minimum, quartiles and maximum by group."""
    plain = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    quartiles = exact_percentiles(df, value, list(by), {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return beside(plain, quartiles, list(by)).select(*by, "n", "mean", "std", "min", "p25", "p50", "p75", "max")


def inventory(df: DataFrame, cls: str, required: list[str], low: int = 500, target: int = 5000) -> DataFrame:
    """Rows of each required or present class, whether it is OK, LOW or MISSING, and what it lacks to the target."""
    need = df.sparkSession.createDataFrame([(c,) for c in required], f"{cls} string").withColumn("required", F.lit(True))
    counts = df.groupBy(cls).agg(F.count("*").alias("n"))
    met = counts.join(need, cls, "full").withColumns({"n": F.coalesce("n", F.lit(0)), "required": F.coalesce("required", F.lit(False))})
    status = F.when(F.col("n") == 0, "MISSING").when(F.col("n") < low, "LOW").otherwise("OK")
    return met.withColumns({"status": status, "gap": F.when(F.col("required"), F.greatest(F.lit(0), target - F.col("n"))).otherwise(0)})


def coverage(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts of values by row, 0 where there are none."""
    return df.groupBy(row).pivot(column, values).count().na.fill(0, values)


def null_counts(df: DataFrame) -> DataFrame:
    """Nulls of every column, one row."""
    return df.agg(*[F.sum(F.col(f"`{c}`").isNull().cast("long")).alias(c) for c in df.columns])


def distinct_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.agg(*[F.countDistinct(c).alias(c) for c in columns])


def split_health(df: DataFrame, split: str = "split", label: str = "label") -> DataFrame:
    """Label counts by split, flagged where the imbalance is over twice or under half of the whole table's."""
    whole = label_counts(df, label=label).select(F.col("imbalance").alias("_all"))
    rows = label_counts(df, [split], label).crossJoin(F.broadcast(whole))
    return rows.withColumn("skewed", (F.col("imbalance") > 2 * F.col("_all")) | (F.col("imbalance") < 0.5 * F.col("_all"))).drop("_all")


def gini(counts: DataFrame, n: str = "n") -> DataFrame:
    """Gini coefficient of a short table of counts, such as classes."""
    ranked = counts.select(F.col(n).cast("double").alias("v"), F.row_number().over(W.orderBy(n)).alias("i"))
    k = F.count("*")
    return ranked.agg(F.abs(F.sum(F.col("v") * 2 * F.col("i")) - (k + 1) * F.sum("v")).alias("top"), k.alias("k"), F.sum("v").alias("s")).select(
        F.when(F.col("s") > 0, F.col("top") / (F.col("k") * F.col("s"))).otherwise(0.0).alias("gini")
    )


def shift(left: DataFrame, right: DataFrame, key: str, eps: float = 1e-10) -> DataFrame:
    """Smoothed KL divergence either way, the Jensen-Shannon divergence in bits, and its band, of two tables of key and n."""
    p = left.groupBy(key).agg(F.sum("n").alias("a"))
    q = right.groupBy(key).agg(F.sum("n").alias("b"))
    whole = p.agg(F.sum("a").alias("ta")).crossJoin(q.agg(F.sum("b").alias("tb")))
    met = p.join(q, key, "full").crossJoin(F.broadcast(whole))
    x, y = F.coalesce(F.col("a") / F.col("ta"), F.lit(0.0)), F.coalesce(F.col("b") / F.col("tb"), F.lit(0.0))
    rows = met.select(x.alias("x"), y.alias("y"), ((x + y) / 2).alias("m"))
    some = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(eps)
    kl = lambda a, b: F.sum(some(a) * F.ln((some(a) + eps) / (some(b) + eps)))
    out = rows.agg(kl("x", "y").alias("kl"), kl("y", "x").alias("kl_reverse"), F.least(F.lit(1.0), (kl("x", "m") + kl("y", "m")) / 2 / F.ln(F.lit(2.0))).alias("jsd"))
    return out.withColumn("band", F.when(F.col("jsd") < 0.05, "low").when(F.col("jsd") < 0.15, "moderate").otherwise("high"))


def top_frequencies(df: DataFrame, value: Column, k: int = 50, order: str | None = None) -> DataFrame:
    """The k most frequent values with their share of all rows; ties go to the value seen first by `order`, else by value."""
    rows = df.select(value.alias("value"), *([F.col(order).alias("_ord")] if order else []))
    seen = F.min("_ord") if order else F.min("value")
    counts = rows.groupBy("value").agg(F.count("*").alias("n"), seen.alias("_first"))
    total = rows.agg(F.count("*").alias("_total"))
    return counts.orderBy(F.desc("n"), "_first").limit(k).crossJoin(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("_total")).alias("share"))


def header_rates(df: DataFrame, headers: Column, names: list[str]) -> DataFrame:
    """Share of rows that have each header, whatever its case."""
    low = F.transform(F.map_keys(headers), F.lower)
    return df.select(low.alias("k")).agg(*[F.avg(F.array_contains("k", n).cast("double")).alias(n.replace("-", "_")) for n in names])


def traffic_profile(df: DataFrame, headers: Column, uri: str = "path", k: int = 50) -> DataFrame:
    """Methods, path depths, agents, content types and accept headers by frequency, as rows (facet, value, n, share)."""
    get = lambda name, default=None: F.coalesce(F.element_at(F.transform_keys(headers, lambda a, _: F.lower(a)), name), F.lit(default))
    facets = {
        "method": (F.col("method"), k), "path_depth": (path_depth(uri).cast("string"), 10), "user_agent": (get("user-agent", "unknown"), k),
        "content_type": (get("content-type"), k), "accept": (get("accept"), k),
    }
    long = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("facet"), v.alias("value")) for n, (v, _) in facets.items()])).alias("x")).select("x.*")
    counts = long.filter("value IS NOT NULL").groupBy("facet", "value").agg(F.count("*").alias("n"))
    totals = counts.groupBy("facet").agg(F.sum("n").alias("_t"))
    rank = F.row_number().over(W.partitionBy("facet").orderBy(F.desc("n"), "value"))
    most = F.when(F.col("facet") == "path_depth", 10).otherwise(k)
    return counts.withColumn("_r", rank).filter(F.col("_r") <= most).join(F.broadcast(totals), "facet").select("facet", "value", "n", (F.col("n") / F.col("_t")).alias("share"))
