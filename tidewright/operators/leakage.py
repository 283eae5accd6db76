"""Token leakage: how much single tokens tell about the label, and how much of a score hangs on incidental fillers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions import grammar
from tidewright.functions.text import tokens
from tidewright.operators.metrics import auc_rank

LEAST_DF = 5


def is_incidental(token: Column | str) -> Column:
    """Digits, eight or more hex digits, or four or more characters with a letter and a digit."""
    t = F.col(token) if isinstance(token, str) else token
    return t.rlike(r"^\d+$") | ((F.length(t) >= 8) & t.rlike("^[0-9a-f]+$")) | ((F.length(t) >= 4) & t.rlike("[a-z]") & t.rlike("[0-9]"))


def token_counts(df: DataFrame, text: str = "raw", label: str = "label") -> DataFrame:
    """Documents and positive documents of each token; a token counts once a document."""
    rows = df.select(F.col(label).cast("long").alias("y"), F.explode(F.array_distinct(tokens(text))).alias("token"))
    return rows.groupBy("token").agg(F.count("*").alias("df"), F.sum("y").alias("df_pos"))


def mutual_information(a: Column, d: Column, n_pos: Column, n: Column) -> Column:
    """Mutual information in bits of having a token and being positive; empty cells add nothing."""
    cells = [(a, d, n_pos), (d - a, d, n - n_pos), (n_pos - a, n - d, n_pos), (n - d - n_pos + a, n - d, n - n_pos)]
    part = lambda k, r, c: F.when(k > 0, (k / n) * F.log2(k * n / (r.cast("double") * c))).otherwise(0.0)
    total = sum((part(k, r, c) for k, r, c in cells[1:]), part(*cells[0]))
    return F.greatest(F.lit(0.0), total)


def token_leakage(df: DataFrame, text: str = "raw", label: str = "label", least: int = LEAST_DF) -> DataFrame:
    """Of each token in `least` documents or more: share of positives, lift, pointwise and mutual information."""
    counts = token_counts(df, text, label).filter(F.col("df") >= least)
    whole = df.agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("n_pos"))
    c = counts.crossJoin(F.broadcast(whole))
    p = F.col("df_pos") / F.col("df")
    pmi = F.when((F.col("df_pos") > 0) & (F.col("n_pos") > 0), F.log2(F.col("df_pos") * F.col("n") / (F.col("n_pos").cast("double") * F.col("df")))).otherwise(-99.0)
    return c.select(
        "token", "df", "df_pos", p.alias("p_positive"), (p - F.col("n_pos") / F.col("n")).alias("lift"), pmi.alias("pmi"),
        mutual_information(F.col("df_pos"), F.col("df"), F.col("n_pos"), F.col("n")).alias("mi"), is_incidental("token").alias("incidental"),
    )


def leakage_rollup(scored: DataFrame) -> DataFrame:
    """Largest mutual information, and how many tokens all but decide the label, in one row."""
    strong = (F.col("p_positive") <= 0.02) | (F.col("p_positive") >= 0.98)
    return scored.agg(
        F.count("*").alias("n_tokens"), F.max("mi").alias("max_mi"), F.sum(strong.cast("long")).alias("n_strong"),
        F.sum((strong & F.col("incidental")).cast("long")).alias("n_strong_incidental"),
    )


def top_tokens(scored: DataFrame, k: int = 50) -> DataFrame:
    return scored.orderBy(F.desc("mi"), "token").limit(k)


#: Top-level names that mark a host.
HOST_ENDS = "com|net|org|io|dev|app|local|internal|test|example|site|online|info|biz|co|uk|de|fr|ru|cn|xyz|top"


def neutralised(text: Column | str) -> Column:
    """The text with IPv4 addresses, hosts and numbers of two or more digits replaced by one constant a kind."""
    c = F.col(text) if isinstance(text, str) else text
    c = F.regexp_replace(c, r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "9.9.9.9")
    c = F.regexp_replace(c, rf"(?i)\b(?:[a-z0-9-]+\.)+(?:{HOST_ENDS})\b", "host.example")
    return F.regexp_replace(c, r"\b\d{2,}\b", "11")


_SWAPPED = re.compile(rf"(?ai)(?P<ip>\b\d{{1,3}}(?:\.\d{{1,3}}){{3}}\b)|(?P<host>\b(?:[a-z0-9-]+\.)+(?:{HOST_ENDS})\b)|(?P<number>\b\d{{2,}}\b)")
_DRAWS = {"ip": grammar.Filler.ip, "host": grammar.Filler.host, "number": lambda filler: str(filler.rng.randrange(10, 100_000))}


def swapped(df: DataFrame, text: str, key: str, seed: int = 42) -> DataFrame:
    """The table with `text` freshly filled: other IPv4 addresses, hosts and numbers of two or more digits, each drawn anew.

    Draws depend on the seed, the row's key and the place alone. A null text stays null.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for value, row in zip(part[text], part[key]):
                filler = grammar.Filler(grammar.row_random(seed, row))
                out.append(None if pd.isna(value) else _SWAPPED.sub(lambda m, filler=filler: _DRAWS[m.lastgroup](filler), value))
            yield part.assign(**{text: out})

    return df.mapInPandas(run, df.schema)


def counterfactual_delta(df: DataFrame, before: str = "prob", after: str = "prob_swapped", label: str = "label") -> DataFrame:
    """AUC with the score before and after fillers are swapped, and the difference."""
    a = auc_rank(df, before, label).select(F.col("auc_roc").alias("auc_before"))
    b = auc_rank(df, after, label).select(F.col("auc_roc").alias("auc_after"))
    return a.crossJoin(b).withColumn("delta", F.col("auc_before") - F.col("auc_after"))
