"""URL filters: host-suffix and path-prefix expressions, an equi-join on short hash prefixes, then full digests.

A rule is a host, a path that begins with "/", and an action (block or allow). It fits a url whose host is the rule's or
below it and whose path starts with the rule's. Of the rules that fit, the longest (host and path together) wins; of
equally long ones the longer host, then block before allow.

Defined cases: a null url, or one without "://", has an empty host and path and gets the default verdict. Rules with a
null part or an empty host take no part, repeated rules count once. Repeated rows stay repeated, columns of other names are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of hex digest that the equi-join compares; the full digest is compared after it.
PREFIX_DIGITS = 8
#: Up to so many rules are sent to every executor; more are joined by a shuffle.
BROADCAST_RULES = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a url as the module states."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2), F.lit(""))


def _digests(rules: DataFrame) -> DataFrame:
    shown = F.concat("rule_host", "rule_path")
    return (
        rules.select(
            F.translate(F.col("host"), _UPPER, _LOWER).alias("rule_host"), F.col("path").alias("rule_path"), "action"
        )
        .dropna()
        .filter("length(rule_host) > 0")
        .groupBy("rule_host", "rule_path")
        .agg(F.max("action").alias("action"))
        .select(
            F.sha2(shown, 256).alias("digest"),
            F.substring(F.sha2(shown, 256), 1, PREFIX_DIGITS).alias("prefix"),
            shown.alias("rule"),
            F.length("rule_host").alias("host_size"),
            F.length(shown).alias("rule_size"),
            "action",
        )
    )


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns of keep, and host, path, rule and verdict of each row.

    Only host suffixes and path prefixes of lengths that some rule has are expanded, so a url gives no more expressions
    than its labels and the rules' path lengths allow, however long it is.
    """
    digests = _digests(rules)
    sizes = digests.agg(
        F.collect_set("host_size"), F.collect_set(F.col("rule_size") - F.col("host_size")), F.count("*")
    ).first()
    host_sizes, path_sizes, n_rules = (sorted(sizes[0]), sorted(sizes[1]), sizes[2])
    host, path = split_url(F.col(url))
    rows = pages.select(*[F.col(c).alias(f"_keep_{k}") for k, c in enumerate(keep)], host.alias("host"), path.alias("path"))
    kept = [F.col(f"_keep_{k}").alias(c) for k, c in enumerate(keep)]
    if not n_rules:
        return rows.select(*kept, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    below = F.filter(
        F.array(*[F.lit(n) for n in host_sizes]),
        lambda n: (F.length("host") == n)
        | ((F.length("host") > n) & (F.substring(F.col("host"), F.length("host") - n, F.lit(1)) == ".")),
    )
    within = F.filter(F.array(*[F.lit(n) for n in path_sizes]), lambda n: F.length("path") >= n)
    expression = F.flatten(
        F.transform(
            below,
            lambda n: F.transform(
                within,
                lambda m: F.concat(
                    F.substring(F.col("host"), F.length("host") - n + 1, n), F.substring(F.col("path"), F.lit(1), m)
                ),
            ),
        )
    )
    asked = (
        rows.withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_expression", F.explode_outer(expression))
        .withColumn("_digest", F.sha2("_expression", 256))
        .withColumn("_prefix", F.substring("_digest", 1, PREFIX_DIGITS))
    )
    known = F.broadcast(digests) if n_rules <= BROADCAST_RULES else digests
    found = asked.join(known, asked._prefix == known.prefix, "left").withColumn(
        "_hit", F.when(F.col("_digest") == F.col("digest"), F.struct("rule_size", "host_size", "action", "rule"))
    )
    columns = [f"_keep_{k}" for k in range(len(keep))]
    best = found.groupBy("_row", *columns, "host", "path").agg(F.max("_hit").alias("_best"))
    return best.select(
        *kept,
        "host",
        "path",
        F.col("_best.rule").alias("rule"),
        F.coalesce("_best.action", F.lit(default)).alias("verdict"),
    )


#: The rules of the query: host, path, action.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return judge(pages, rules, keep=("page_id",))


SQL = """
WITH cut AS (
    SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
    SELECT page_id,
           translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM cut),
judged AS (
    SELECT *, CASE
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""
