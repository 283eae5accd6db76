"""Queries of tokenizers: metrics over ids that SQL can make as well, and round trips through a given vocabulary."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import tokenization
from tidewright.plans.records import IDS, word_ids
from tidewright.plans.registry import query
from tidewright.session import table

#: Vocabulary files; every executor has them at this path.
FOLDER = "/opt/tokenizers"
STUDENT, TEACHER = f"{FOLDER}/byte_bpe_50k.json", f"{FOLDER}/word_bpe_49k.json"

METRICS = """
    count(*) AS n_texts, round(sum(len(list_filter(real, lambda x: x = 1))) / greatest(1, sum(len(real))), 9) AS oov_rate, round(avg(len(real)), 9) AS tokens_per_text,
    round(sum(len(real)) / greatest(1, sum(length(coalesce(text, '')))), 9) AS fertility, round(sum(length(coalesce(text, ''))) / greatest(1, sum(len(real))), 9) AS chars_per_token,
    round(avg(CASE WHEN len(real) > 256 THEN 1.0 ELSE 0.0 END), 9) AS truncation_rate
"""


def _measured(spark, sf_dir, by=None):
    docs = table(spark, sf_dir, "documents").withColumn("ids", word_ids(F.coalesce("text", F.lit(""))))
    out = tokenization.tokenizer_metrics(docs, "ids", "text", by, unknown_id=1, pad_id=0)
    return out.withColumns({c: F.round(c, 9) for c, t in out.dtypes if t == "double"})


REAL = IDS.replace("text", "coalesce(text, '')")


@query("tokenizer_metrics", f"WITH i AS (SELECT text, list_filter({REAL}, lambda x: x <> 0) AS real FROM documents) SELECT {METRICS} FROM i")
def tokenizer_metrics(spark, sf_dir):
    """Unknown tokens, tokens a text, tokens a character and back, and cut texts, of all documents."""
    return _measured(spark, sf_dir)


@query("tokenizer_metrics_by_class", f"WITH i AS (SELECT lang, text, list_filter({REAL}, lambda x: x <> 0) AS real FROM documents) SELECT lang, {METRICS} FROM i GROUP BY lang")
def tokenizer_metrics_by_class(spark, sf_dir):
    return _measured(spark, sf_dir, ["lang"])


@query("encode_decode", "SELECT item_id, text FROM benchmark")
def encode_decode(spark, sf_dir):
    """Texts from the ids of a byte-level vocabulary: what went in."""
    ids = tokenization.encoder(STUDENT)("text")
    return table(spark, sf_dir, "benchmark").select("item_id", tokenization.decoder(STUDENT)(ids).alias("text"))


@query("dual_tokens", "SELECT item_id, text AS student_text, regexp_replace(lower(text), '\\s+', '', 'g') AS teacher_text FROM benchmark")
def dual_tokens(spark, sf_dir):
    """Texts from the ids of two vocabularies; the second one's has lower case and no white space."""
    rows = tokenization.dual(table(spark, sf_dir, "benchmark"), "text", STUDENT, TEACHER, width=1 << 20)
    teacher = F.regexp_replace(F.replace(tokenization.decoder(TEACHER, byte_level=True)("teacher_ids"), F.lit("</w>"), F.lit("")), r"\s+", "")
    return rows.select("item_id", tokenization.decoder(STUDENT)("student_ids").alias("student_text"), teacher.alias("teacher_text"))


@query(
    "collated_ids",
    f"""
    WITH i AS (SELECT item_id, item_id % 4 AS part, list_slice({IDS}, 1, 24) AS ids FROM benchmark), m AS (SELECT part, max(len(ids)) AS most FROM i GROUP BY part)
    SELECT item_id, array_to_string(list_resize(ids, most, 9), ' ') AS input_ids, array_to_string(list_resize(list_transform(ids, lambda x: 1), most, 0), ' ') AS attention_mask FROM i JOIN m USING (part)
    """,
)
def collated_ids(spark, sf_dir):
    """Ids cut to a width and padded to the longest of their batch, with masks."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") % 4).alias("part"), word_ids("text").alias("ids"))
    out = tokenization.collated(rows, width=24, pad_id=9, by=["part"])
    return out.select("item_id", *[F.array_join(F.col(c).cast("array<string>"), " ").alias(c) for c in ("input_ids", "attention_mask")])


WORDS = "unnest(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: w <> '')) AS w"


def _words(t):
    return t.select(F.explode(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != "")).alias("w"))


@query(
    "vocabulary_overlap",
    f"""
    WITH a AS (SELECT DISTINCT w FROM (SELECT {WORDS} FROM benchmark)), b AS (SELECT DISTINCT w FROM (SELECT {WORDS} FROM documents))
    SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM a JOIN b USING (w)) AS n_common,
           round((SELECT count(*) FROM a JOIN b USING (w)) / (SELECT count(*) FROM (SELECT w FROM a UNION SELECT w FROM b)), 9) AS jaccard
    """,
)
def vocabulary_overlap(spark, sf_dir):
    a, b = (_words(table(spark, sf_dir, t)) for t in ("benchmark", "documents"))
    return tokenization.vocabulary_overlap(a, b).withColumn("jaccard", F.round("jaccard", 9))


@query("shadowed_tokens", "SELECT * FROM (VALUES ('the', false), (' select', false), ('xqzkwv', true), ('UNIONSELECTX', true)) t(token, shadowed)")
def shadowed_tokens(spark, sf_dir):
    """Candidates that a vocabulary cuts in several pieces."""
    return tokenization.shadowing(spark, ["the", " select", "xqzkwv", "UNIONSELECTX"], STUDENT).select("token", "shadowed")


@query(
    "augmented_vocabulary",
    f"""
    WITH v AS (SELECT w AS token, CAST(row_number() OVER (ORDER BY w) AS INTEGER) AS id FROM (SELECT DISTINCT {WORDS} FROM benchmark)),
    c AS (SELECT DISTINCT n_name AS token FROM nation WHERE n_name NOT IN (SELECT token FROM v) AND lower(n_name) NOT IN (SELECT token FROM v))
    SELECT token, id FROM v UNION ALL SELECT token, CAST((SELECT max(id) FROM v) + row_number() OVER (ORDER BY token) AS INTEGER) FROM c
    """,
)
def augmented_vocabulary(spark, sf_dir):
    """A vocabulary with the candidates that it has neither as they are nor in lower case, numbered on."""
    from pyspark.sql import Window as W

    known = _words(table(spark, sf_dir, "benchmark")).distinct().select(F.col("w").alias("token"), F.row_number().over(W.orderBy("w")).alias("id"))
    return tokenization.augmented_vocabulary(known, table(spark, sf_dir, "nation").select("n_name"))
