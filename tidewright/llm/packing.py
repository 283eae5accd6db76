"""Packing into optimal length buckets: dynamic programming over the global histogram, then token-budget batches.

The lengths of all documents are counted; a dynamic programme picks the upper bounds of BUCKETS buckets so that the sum of
bound minus length over all documents is the smallest possible. In each bucket, documents in a hashed order form batches
of as many rows as the token budget holds at the bucket's bound (one at least, also above the budget).

The histogram is exact, one row on the driver for each distinct length. Distinct lengths add up to no more than all tokens, so
T tokens have fewer than the root of 2 T of them: 6 million at 2 * 10^13 tokens, if lengths up to that all occur.

Lengths are counted once and written to the shared folder, one row for each id and length with its number of rows, so rows of
a null or repeated id are counted before they move. Batches are numbered without gathering a bucket in one task: cells of
hashed rows are counted, running totals of those counts give each cell its first position, and rows are numbered in cells.

Defined cases: a null or empty text has length 0; an empty table gives no rows; repeated rows are packed one by one; ids
may be null. With fewer distinct lengths than buckets each length is a bucket and nothing is padded.
"""

from __future__ import annotations

from array import array
from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewright.llm.common import cut
from tidewright.llm.mixing import numbered, words

BUCKETS, TOKEN_BUDGET = 16, 65_536
#: Rows of a cell, about.
CELL_ROWS = 512


def boundaries(histogram: list[tuple[int, int, int]], buckets: int = BUCKETS) -> list[int]:
    """The bounds with the least padding, ascending, for (bound, rows, sum of lengths) of each distinct bound.

    With C and S the running rows and lengths, a bucket from entry i to j pads bound_j * (C_j - C_i) - (S_j - S_i), so
    each layer is a lower envelope of lines with falling slopes -C_i asked at growing bounds: linear in the histogram.
    """
    entries = sorted(histogram)
    n = len(entries)
    if n <= buckets:
        return [e[0] for e in entries]
    count, total = [0], [0]
    for _, rows, size in entries:
        count.append(count[-1] + rows)
        total.append(total[-1] + size)
    bound = [0, *(e[0] for e in entries)]
    best = [0] + [bound[j] * count[j] - total[j] for j in range(1, n + 1)]
    cuts: list[array] = []
    for _ in range(buckets - 1):
        hull: deque[tuple[int, int, int]] = deque()  # slope, height, entry
        fresh, came = best[:], array("i", [-1]) * (n + 1)
        for j in range(1, n + 1):
            slope, height = -count[j - 1], best[j - 1] + total[j - 1]
            while len(hull) > 1 and (height - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - slope):
                hull.pop()
            hull.append((slope, height, j - 1))
            while len(hull) > 1 and hull[1][0] * bound[j] + hull[1][1] <= hull[0][0] * bound[j] + hull[0][1]:
                hull.popleft()
            cost = bound[j] * count[j] - total[j] + hull[0][0] * bound[j] + hull[0][1]
            if cost < fresh[j]:
                fresh[j], came[j] = cost, hull[0][2]
        cuts.append(came)
        best = fresh
    found, j = [], n
    for came in reversed(cuts):
        if came[j] >= 0:
            found.append(bound[j])
            j = came[j]
            if not j:
                break
    if j:
        found.append(bound[j])
    return sorted(found)


def pack(
    docs: DataFrame, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET, length: Column | None = None, doc_id: str = "doc_id", text: str = "text", seed: int = 1
) -> DataFrame:
    """doc_id, n_tokens, bucket (from 0), bucket_length, batch (from 0 in its bucket), slot (from 0 in its batch), padding.

    length: tokens of a row (null: 0); without it, words are counted.
    """
    size = words(F.col(text)) if length is None else F.coalesce(length.cast("long"), F.lit(0))
    rows = cut(docs.select(F.col(doc_id).alias("doc_id"), size.alias("n_tokens")).groupBy("doc_id", "n_tokens").agg(F.count("*").alias("_rows")))
    counted = rows.groupBy("n_tokens").agg(F.sum("_rows").alias("rows")).collect()
    bounds = boundaries([(r["n_tokens"], r["rows"], r["n_tokens"] * r["rows"]) for r in counted], buckets)
    n_rows = sum(r["rows"] for r in counted)
    spots = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<long>")
    placed = (
        numbered(rows, "_rows", "_nth").drop("_rows")
        .withColumn("bucket", F.size(F.filter(spots, lambda b: b < F.col("n_tokens"))))
        .withColumn("bucket_length", F.element_at(spots, F.col("bucket") + 1))
        .withColumn("_order", F.xxhash64("doc_id", "n_tokens", "_nth", F.lit(seed)))
        .withColumn("_cell", F.pmod("_order", F.lit(max(1, -(-n_rows // CELL_ROWS)))))
    )
    cells = placed.groupBy("bucket", "_cell").agg(F.count("*").alias("_n"))
    # Running totals in two levels, so no bucket's cells have to meet in one task beyond a count each of their blocks.
    cells = cells.withColumn("_block", F.floor(F.col("_cell") / CELL_ROWS))
    inner = W.partitionBy("bucket", "_block").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("_inner", F.coalesce(F.sum("_n").over(inner), F.lit(0)))
    outer = W.partitionBy("bucket").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    block = cells.groupBy("bucket", "_block").agg(F.sum("_n").alias("_b")).withColumn("_outer", F.coalesce(F.sum("_b").over(outer), F.lit(0)))
    first = cells.join(block, ["bucket", "_block"]).select("bucket", "_cell", (F.col("_inner") + F.col("_outer")).alias("_first"))
    within = W.partitionBy("bucket", "_cell").orderBy("_order", "doc_id", "n_tokens", "_nth")
    at = F.col("_first") + F.row_number().over(within) - 1
    per_batch = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("bucket_length", F.lit(1)))).cast("long")
    return (
        placed.join(first, ["bucket", "_cell"])
        .withColumn("_at", at)
        .withColumn("_rows", per_batch)
        .select(
            "doc_id",
            "n_tokens",
            "bucket",
            "bucket_length",
            F.floor(F.col("_at") / F.col("_rows")).cast("long").alias("batch"),
            (F.col("_at") % F.col("_rows")).cast("long").alias("slot"),
            (F.col("bucket_length") - F.col("n_tokens")).alias("padding"),
        )
    )


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
