"""Tokenising with given vocabularies, and what token ids say about a tokenizer. Tokenizers are never trained here."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_loaded: dict[str, object] = {}


def _tokenizer(path: str):
    """The tokenizer of a JSON file, loaded once a worker."""
    if path not in _loaded:
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
        _loaded[path].encode_special_tokens = True  # their strings in a text are ordinary text
    return _loaded[path]


def encoder(path: str):
    """A column function from text to array of ids, by the vocabulary file at a path that every executor has; no truncation,
    no padding. Nulls are empty texts."""

    @F.pandas_udf("array<int>")
    def ids(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = _tokenizer(path)
        for part in parts:
            yield pd.Series([e.ids for e in tokenizer.encode_batch(part.fillna("").tolist(), add_special_tokens=False)])

    return ids


def decoder(path: str, byte_level: bool = False):
    """A column function from array of ids to text, by the vocabulary file; nulls are empty arrays.

    byte_level: tokens are characters that stand for bytes, and the file does not say so.
    """

    @F.pandas_udf("string")
    def texts(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = _tokenizer(path)
        if byte_level:
            from tokenizers import Tokenizer, decoders

            tokenizer = Tokenizer.from_str(tokenizer.to_str())
            tokenizer.decoder = decoders.ByteLevel()
        for part in parts:
            yield pd.Series(tokenizer.decode_batch([[] if x is None else list(map(int, x)) for x in part], skip_special_tokens=False))

    return texts


def dual(df: DataFrame, text: str, student: str, teacher: str, width: int = 256) -> DataFrame:
    """The table with the ids of two vocabularies, each cut to the width."""
    cut = lambda path: F.slice(encoder(path)(text), 1, width)
    return df.withColumns({"student_ids": cut(student), "teacher_ids": cut(teacher)})


def augmented_vocabulary(vocabulary: DataFrame, candidates: DataFrame) -> DataFrame:
    """token and id: the vocabulary (token, id), and the candidates that it lacks, numbered on in the order of their names.

    Candidates are few, as they are chosen by hand.
    """
    name, token = candidates.columns[0], vocabulary.columns[0]
    new = missing_tokens(candidates.distinct(), vocabulary.select(token))
    last = F.broadcast(vocabulary.agg(F.max("id").alias("_last")))
    numbered = new.crossJoin(last).select(F.col(name).alias("token"), (F.col("_last") + F.row_number().over(W.orderBy(name))).alias("id"))
    return vocabulary.select(F.col(token).alias("token"), "id").unionByName(numbered)


def collated(df: DataFrame, ids: str = "ids", width: int = 256, pad_id: int = 0, by: list[str] | None = None) -> DataFrame:
    """Ids cut to the width and padded to the longest of their batch (the columns of by, else the whole table), with masks."""
    cut = F.slice(F.col(ids), 1, width)
    longest = df.groupBy(*(by or [])).agg(F.max(F.least(F.size(ids), F.lit(width))).alias("_most"))
    met = df.join(F.broadcast(longest), by) if by else df.crossJoin(F.broadcast(longest))
    fill = lambda value: F.array_repeat(F.lit(value), F.greatest(F.col("_most") - F.size(cut), F.lit(0)))
    return met.withColumns({"input_ids": F.concat(cut, fill(pad_id)), "attention_mask": F.concat(F.array_repeat(F.lit(1), F.size(cut)), fill(0))}).drop("_most")


def tokenizer_metrics(df: DataFrame, ids: str = "ids", text: str = "raw", by: list[str] | None = None, unknown_id: int | None = None, pad_id: int | None = None, width: int = 256) -> DataFrame:
    """Texts, share of unknown tokens, tokens a text, tokens a character, characters a token, share of texts over the width."""
    real = F.filter(ids, lambda x: x != pad_id) if pad_id is not None else F.col(ids)
    rows = df.select(*(by or []), F.size(real).alias("n"), (F.size(F.filter(real, lambda x: x == unknown_id)) if unknown_id is not None else F.lit(0)).alias("u"), F.length(F.coalesce(text, F.lit(""))).alias("c"))
    n, c = F.sum("n"), F.sum("c")
    return rows.groupBy(*(by or [])).agg(
        F.count("*").alias("n_texts"), (F.sum("u") / F.greatest(n, F.lit(1))).alias("oov_rate"), F.avg("n").alias("tokens_per_text"),
        (n / F.greatest(c, F.lit(1))).alias("fertility"), (c / F.greatest(n, F.lit(1))).alias("chars_per_token"), F.avg((F.col("n") > width).cast("double")).alias("truncation_rate"),
    )


def shadowing(spark, candidates: list[str], path: str) -> DataFrame:
    """Fragments of each candidate token, and whether it has more than one."""
    rows = spark.createDataFrame([(c,) for c in candidates], "token string")
    return rows.withColumn("fragments", F.size(encoder(path)("token"))).withColumn("shadowed", F.col("fragments") > 1)


def vocabulary_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sizes, common tokens and Jaccard similarity of two one-column vocabularies."""
    both = a.distinct().withColumn("_a", F.lit(1)).join(b.distinct().withColumn("_b", F.lit(1)), a.columns[0], "full")
    common = F.sum((F.col("_a").isNotNull() & F.col("_b").isNotNull()).cast("long"))
    return both.agg(F.count("_a").alias("n_a"), F.count("_b").alias("n_b"), common.alias("n_common"), (common / F.count("*")).alias("jaccard"))


def missing_tokens(candidates: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Candidates that the vocabulary has neither as they are nor in lower case."""
    name, known = candidates.columns[0], vocabulary.columns[0]
    v = vocabulary.select(F.col(known).alias("_v"))
    return candidates.join(v, F.col(name) == F.col("_v"), "left_anti").join(v, F.lower(F.col(name)) == F.col("_v"), "left_anti")


def padded_length(ids: Column, width: int) -> Column:
    return F.least(F.size(ids), F.lit(width))
