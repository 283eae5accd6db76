"""Mixing sources to target weights by pivotal dependent rounding over a reduction tree.

The rate of a source is its target over its size. Each document takes floor(rate) copies for certain; the rest is a
probability of one copy more. Two open documents of a source exchange words: a random one of the two directions, weighted
so that no expectation changes, moves mass until one of the two has a whole number of copies; the other stays open. A cell
of a source ends with at most one open document, and the open documents of many cells meet in the next level of the tree,
until the source has one, which a coin decides. The words that a source takes thus differ from its target by less than
one document; as large documents meet first, the last open one tends to be small.

Rows alike in id, source and text are counted first (so the copies of one row are one row before they move) and numbered:
they are interchangeable, and no row needs a key of its own. Every random choice is a hash of the seed and of the two rows
that meet, and cells are hashes that hold rows in a fixed order, so a rerun, on any number of partitions, takes the same.

Defined cases: a null text has size 0; documents of size 0 take floor(rate) copies of nothing; a null source is a source
of its own and the last; an empty table gives no rows; a null id is an id of its own. Rows that repeat an id are decided
one by one, whatever their texts. Texts are known by 96 bits. The table of sources is held by the driver: one short row a
source.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewright.llm.common import cut

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: Rows of a cell of the lowest level, and cells that meet in one of the next.
CELL_ROWS, FAN_IN = 256, 64
#: Up to so many sources are sent to every executor; more are joined by a shuffle.
BROADCAST_SOURCES = 10_000
#: Rows alike that one row of a sequence stands for.
ALIKE = 1024
#: What names rows that are alike in id, source and text.
_KEY = ("_mix_a", "_mix_b")
_STATE = "_mix_a long, _mix_b int, doc_id long, rnd long, src int, size long, whole long, open double, cell long"


def words(text: Column) -> Column:
    """Number of runs of characters other than space and 9 to 13; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[float], weights: Iterable[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Shares the given part of all sizes by weight; what is above `most` times a size goes to the others by weight."""
    cycle = list(weights)
    weight = [cycle[k % len(cycle)] for k in range(len(sizes))]
    found, left, active = [0.0] * len(sizes), share * sum(sizes), set(range(len(sizes)))
    while active:
        total = sum(weight[k] for k in active)
        over = {k for k in active if left * weight[k] / total > most * sizes[k]}
        for k in over or active:
            found[k] = most * sizes[k] if over else left * weight[k] / total
        left -= sum(found[k] for k in over)
        active = active - over if over else set()
    return found


def _uniform(*parts: int) -> float:
    """In [0, 1), the same for the same integers."""
    x = 0x243F6A8885A308D3
    for p in parts:
        x = ((x ^ (p & 0xFFFFFFFFFFFFFFFF)) * 0x9E3779B97F4A7C15 + 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 29
        x = x * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 32
    return (x >> 11) / (1 << 53)


def meet(a: tuple[int, float], b: tuple[int, float], u: float) -> tuple[float, float]:
    """The open probabilities of two documents (size, probability) after the exchange that u in [0, 1) decides."""
    (sa, pa), (sb, pb) = a, b
    up, down = min(sa * (1 - pa), sb * pb), min(sb * (1 - pb), sa * pa)
    if up + down <= 0:
        return round(pa), round(pb)
    if u < down / (up + down):
        return (1.0, max(0.0, pb - up / sb)) if sa * (1 - pa) <= sb * pb else (min(1.0, pa + up / sa), 0.0)
    return (max(0.0, pa - down / sa), 1.0) if sb * (1 - pb) <= sa * pa else (0.0, min(1.0, pb + down / sb))


def _round_cell(seed: int, last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["src", "size", "rnd"], ascending=[True, False, True], kind="stable", ignore_index=True)
        src, size, rnd = rows["src"].tolist(), rows["size"].tolist(), rows["rnd"].tolist()
        whole, rest = rows["whole"].tolist(), rows["open"].tolist()
        held: dict[int, int] = {}
        for k in range(len(rows)):
            if not 0 < rest[k] < 1:
                continue
            j = held.pop(src[k], None)
            if j is None:
                held[src[k]] = k
                continue
            rest[j], rest[k] = meet((size[j], rest[j]), (size[k], rest[k]), _uniform(seed, src[k], rnd[j], rnd[k], size[j]))
            for i in (j, k):
                if 0 < rest[i] < 1:
                    held[src[i]] = i
        if last:
            for s, k in held.items():
                rest[k] = float(_uniform(seed, s, rnd[k]) < rest[k])
        closed = [not 0 < r < 1 for r in rest]
        rows["whole"] = [w + round(r) if c else w for w, r, c in zip(whole, rest, closed)]
        rows["open"] = [0.0 if c else r for r, c in zip(rest, closed)]
        return rows

    return run


def _named(docs: DataFrame, text: str, source: str, doc_id: str) -> DataFrame:
    """The rows with the two columns that name those alike in id, source and text."""
    of = [F.col(c) for c in (doc_id, source, text)]
    return docs.withColumn(_KEY[0], F.xxhash64(*of)).withColumn(_KEY[1], F.hash(*reversed(of)))


def numbered(rows: DataFrame, count: str, number: str) -> DataFrame:
    """Each row as often as the column says, with a number from 1; no row holds a long list on the way."""
    first = rows.withColumn("_first", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / ALIKE))))
    few = F.sequence(F.lit(1).cast("long"), F.least(F.lit(ALIKE).cast("long"), F.col(count) - F.col("_first") * ALIKE))
    each = first.withColumn("_few", F.explode(few))
    return each.withColumn(number, F.col("_few") + F.col("_first") * ALIKE).drop("_first", "_few")


def _decided(docs: DataFrame, weights: Iterable[float], share: float, most: float, seed: int, text: str, source: str, doc_id: str) -> DataFrame:
    """What mix gives, with the columns that name rows alike."""
    slim = _named(docs, text, source, doc_id).select(
        *_KEY, F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size")
    )
    classes = cut(slim.groupBy(*_KEY, "doc_id", "source", "size").agg(F.count("*").alias("n")))
    found = classes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("n"), F.sum("n").alias("rows")).collect()
    found = sorted(found, key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    aims = targets([r["n"] for r in found], weights, share, most)
    spark = docs.sparkSession
    known = spark.createDataFrame(
        [
            (k, r["source"], int(r["n"]), float(t), float(t / r["n"]) if r["n"] else 0.0, math.ceil(r["rows"] / CELL_ROWS))
            for k, (r, t) in enumerate(zip(found, aims))
        ],
        "src int, name string, source_size long, target double, rate double, cells long",
    )
    known = F.broadcast(known) if len(found) <= BROADCAST_SOURCES else known
    cells = max([1, *(math.ceil(r["rows"] / CELL_ROWS) for r in found)])
    state = (
        numbered(classes, "n", "nth").join(known, classes.source.eqNullSafe(known.name))
        .withColumn("rnd", F.xxhash64(*_KEY, "nth", F.lit(seed)))
        .withColumn("whole", F.floor("rate"))
        .withColumn("open", F.when(F.col("size") > 0, F.col("rate") - F.col("whole")).otherwise(0.0))
        .withColumn("cell", F.pmod(F.xxhash64("rnd"), F.col("cells")))
        .select(*_KEY, "doc_id", "rnd", "src", "size", "whole", "open", "cell")
    )
    level = cut(state.groupBy("src", "cell").applyInPandas(_round_cell(seed, cells == 1), _STATE))
    done = [level.filter("open = 0")]
    while cells > 1:
        seed, cells = seed + 1, math.ceil(cells / FAN_IN)
        above = level.filter("open > 0").withColumn("cell", F.floor(F.col("cell") / FAN_IN))
        level = cut(above.groupBy("src", "cell").applyInPandas(_round_cell(seed, cells == 1), _STATE))
        done.append(level.filter("open = 0"))
    decided = done[0]
    for more in done[1:]:
        decided = decided.unionAll(more)
    return decided.join(known, "src").select(
        *_KEY,
        "doc_id",
        F.col("name").alias("source"),
        "size",
        "source_size",
        "target",
        F.col("whole").alias("copies"),
        (F.col("whole") * F.col("size")).alias("taken"),
    )


def mix(
    docs: DataFrame,
    weights: Iterable[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: int = 7,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every row."""
    return _decided(docs, weights, share, most, seed, text, source, doc_id).drop(*_KEY)


def materialise(
    docs: DataFrame,
    weights: Iterable[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: int = 7,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with all their columns.

    Rows alike in id, source and text share the copies that they take together as evenly as can be.
    """
    taken = _decided(docs, weights, share, most, seed, text, source, doc_id).groupBy(*_KEY).agg(F.sum("copies").alias("_mix_copies"), F.count("*").alias("_mix_n"))
    # Rows with one name are in one partition and in order after the join, so numbering them moves nothing.
    place = F.row_number().over(W.partitionBy(*_KEY).orderBy(*_KEY))
    extra = (place <= F.pmod("_mix_copies", "_mix_n")).cast("long")
    return (
        _named(docs, text, source, doc_id)
        .join(taken.filter("_mix_copies > 0"), list(_KEY))
        .withColumn("_mix_times", F.floor(F.col("_mix_copies") / F.col("_mix_n")) + extra)
        .withColumn("_mix_copy", F.explode(F.expr("CASE WHEN _mix_times > 0 THEN sequence(1, _mix_times) END")))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )


def query(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
