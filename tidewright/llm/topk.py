"""Exact top-k inner products, pruned a block at a time.

Components become whole numbers, floor(scale * x). Rows in the order of their ids are cut into document-range blocks of BLOCK;
GROUP_BLOCKS of them are a group, which keeps its vectors as a matrix (the forward indexes of its blocks) and, for each block
and term (dimension), the largest and smallest value. For a query, the sum over terms of the larger of query value times
maximum and query value times minimum bounds every score in the block.

1. From the blocks' maxima alone, each query finds the group with the best bound in each set of SET groups, and is scored
   against those. The k-th best of these scores is the query's threshold.
2. Again from the maxima alone, the groups remain whose bound reaches the query's threshold. Only these meet the query: their
   blocks are taken in the order of bounds, until the next bound falls below the k-th score so far.

Work is dealt by pairs of a group (or a set of groups' maxima) and at most about QUERIES queries, so no task holds more than
one of each; a group that is best for a third of all queries is worked on by many tasks. The local best of the groups meet in
k small rows a query and group.

Defined cases: vectors that are null or hold a null or non-finite component take no part; an empty vector has the product 0
with every other, and a shorter one has zeros for its missing components; rows are vectors of their own, also those that
repeat a vec_id; a null vec_id is a candidate (after all others, where scores are equal) and no query. Scores have to fit 64
bits. A lost executor redoes its groups from the written table of groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewright.llm.common import cut

#: Vectors of a block, blocks of a group, groups whose maxima are looked at together, and queries of a batch.
BLOCK, GROUP_BLOCKS, SET, QUERIES = 512, 8, 256, 2048
_LOWEST = np.iinfo(np.int64).min


def bounds(query: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The largest score (query, block) that a vector between low and high can have."""
    return np.maximum(query, 0) @ high.T + np.minimum(query, 0) @ low.T


def extremes(vectors: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest and smallest value of each term in each block."""
    starts = np.arange(0, len(vectors), block)
    return np.maximum.reduceat(vectors, starts), np.minimum.reduceat(vectors, starts)


def prune(query: np.ndarray, vectors: np.ndarray, own: np.ndarray, k: int, block: int = BLOCK, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and scores, best first, of the k best vectors of each query (place -1: none) and the blocks that were scored.

    Equal scores go by place. own: the place of each query, which is no candidate of its own, or -1. least: scores below it
    are not asked for.
    """
    n_q, starts = len(query), np.arange(0, len(vectors), block)
    most = bounds(query, *extremes(vectors, block))
    order = np.argsort(-most, axis=1, kind="stable")
    least = np.full(n_q, _LOWEST) if least is None else least
    best_at = np.full((n_q, k), np.iinfo(np.int64).max)
    best = np.full((n_q, k), _LOWEST)
    live, scored = np.arange(n_q), 0
    for turn in range(len(starts)):
        floor = np.maximum(best[live, -1], least[live])
        live = live[(most[live, order[live, turn]] >= floor) | (floor == _LOWEST)]
        if not len(live):
            break
        at = order[live, turn]
        for b in np.unique(at):
            rows = live[at == b]
            place = np.arange(starts[b], min(starts[b] + block, len(vectors)))
            score = (query[rows] @ vectors[place].T).astype(np.int64)
            score[own[rows][:, None] == place[None, :]] = _LOWEST
            scored += len(rows)
            both = np.concatenate([best[rows], score], axis=1)
            names = np.concatenate([best_at[rows], np.broadcast_to(place, score.shape)], axis=1)
            names = np.where(both == _LOWEST, np.iinfo(np.int64).max, names)
            top = np.lexsort((names, ~both), axis=1)[:, :k]
            best[rows], best_at[rows] = np.take_along_axis(both, top, 1), np.take_along_axis(names, top, 1)
    return np.where(best == _LOWEST, -1, best_at), best, scored


def quantised(vector: Column, scale: float) -> Column:
    """floor(scale * x) of every component as a double holds it; null where the vector takes no part."""
    wide = vector.cast("array<double>")
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(wide, lambda x: F.floor(x * F.lit(float(scale)))))


def _matrix(blobs: list[bytes], kind: str, width: int, wide: bool) -> np.ndarray:
    rows = [np.frombuffer(b, kind).reshape(-1, width) if width else np.zeros((1, 0)) for b in blobs]
    return np.concatenate(rows).astype(np.int64 if wide else np.float64)


_SIZE = BLOCK * GROUP_BLOCKS
_GROUP = "g long, ids array<long>, asks array<boolean>, vectors binary, high binary, low binary"
_FOUND = "key long, query_id long, vec_id long, score long"


def _groups(kind: str, width: int):
    """Groups of the rows of a sorted partition: (id, v, asks)."""

    def pack(number: int, rows: pa.Table) -> pa.RecordBatch:
        values = rows.column("v").combine_chunks()
        size = values.value_lengths().to_numpy(zero_copy_only=False)
        matrix = np.zeros((len(rows), width), kind)
        matrix[np.repeat(np.arange(len(rows)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = values.flatten().to_numpy(zero_copy_only=False)
        high, low = extremes(matrix, BLOCK)
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), x.combine_chunks())
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), one(rows.column("id")), one(rows.column("asks")), *(pa.array([x.tobytes()], pa.binary()) for x in (matrix, high, low))],
            names=["g", "ids", "asks", "vectors", "high", "low"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 24, None
        for batch in batches:
            table = pa.Table.from_batches([batch.select(["id", "v", "asks"])])
            held = table if held is None else pa.concat_tables([held, table])
            while len(held) >= _SIZE:
                yield pack(number, held.slice(0, _SIZE).combine_chunks())
                number, held = number + 1, held.slice(_SIZE)
        if held is not None and len(held):
            yield pack(number, held.combine_chunks())

    return run


def _asking(kind: str, width: int):
    """The queries of the groups: a key (the group and the place in it), id and vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = np.flatnonzero(np.array([bool(a) for a in row["asks"]]))
                matrix = np.frombuffer(row["vectors"], kind).reshape(len(row["ids"]), width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["g"] * _SIZE + at, pa.int64()), pa.array([row["ids"][k] for k in at], pa.int64()), pa.array([matrix[k].tobytes() for k in at], pa.binary())],
                    names=["key", "query_id", "v"],
                )

    return run


def _chosen(kind: str, width: int, wide: bool, first: bool):
    """Of the maxima of some groups and some queries: each query's group of the best bound, or all that reach its threshold."""

    def run(maxima: pa.Table, queries: pa.Table) -> pa.Table:
        key, group = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(maxima) and len(queries):
            asked = _matrix(queries["v"].to_pylist(), kind, width, wide)
            high, low = (_matrix(maxima[c].to_pylist(), kind, width, wide) for c in ("high", "low"))
            blocks = np.array(maxima["blocks"].to_pylist())
            of = np.cumsum(blocks) - blocks
            most = np.maximum.reduceat(bounds(asked, high, low), of, axis=1)
            if first:
                row, column = np.arange(len(asked)), most.argmax(axis=1)
            else:
                row, column = np.nonzero(most >= queries["least"].fill_null(_LOWEST).to_numpy()[:, None])
            key, group = queries["key"].to_numpy()[row], maxima["g"].to_numpy()[column]
        return pa.table({"key": pa.array(key, pa.int64()), "g": pa.array(group, pa.int64())})

    return run


def _scored(kind: str, width: int, wide: bool, k: int):
    """The k best of a group for some queries."""

    def run(group: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(group) or not len(queries):
            return pa.table({c: pa.array([], pa.int64()) for c in ("key", "query_id", "vec_id", "score")})
        ids, key, number = group["ids"].combine_chunks().flatten(), queries["key"].to_numpy(), group["of"][0].as_py()
        vectors = np.frombuffer(group["vectors"][0].as_py(), kind).reshape(len(ids), width).astype(np.int64 if wide else np.float64)
        own = np.where(key // _SIZE == number, key % _SIZE, -1)
        found, score, _ = prune(_matrix(queries["v"].to_pylist(), kind, width, wide), vectors, own, k, least=queries["least"].fill_null(_LOWEST).to_numpy())
        row, column = np.nonzero(found >= 0)
        return pa.table({"key": pa.array(key[row]), "query_id": queries["query_id"].take(pa.array(row)), "vec_id": ids.take(pa.array(found[row, column])), "score": pa.array(score[row, column])})

    return run


def search(
    vectors: DataFrame, queries: Column, k: int, scale: float = 256.0, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best vectors of every row for which `queries` holds."""
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("id"),
        quantised(F.col(vector), scale).alias("v"),
        (F.coalesce(queries, F.lit(False)) & F.col(vec_id).isNotNull()).alias("asks"),
        F.monotonically_increasing_id().alias("tie"),
    ).filter("v IS NOT NULL")
    largest = F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))
    size = rows.agg(F.sum(F.col("asks").cast("long")).alias("asked"), F.max(F.size("v")).alias("width"), largest.alias("most")).first()
    width, most = size["width"] or 0, size["most"] or 0
    if most * most * width >= 1 << 63:
        raise OverflowError("scores do not fit 64 bits")
    kind = next(c for c in ("<i2", "<i4", "<i8") if most < np.iinfo(c).max)
    wide = most * most * width >= 1 << 53
    shape = (kind, width, wide)
    ordered = rows.repartitionByRange(F.col("id").asc_nulls_last(), "tie").sortWithinPartitions(F.col("id").asc_nulls_last(), "tie")
    groups = cut(ordered.mapInArrow(_groups(kind, width), _GROUP))
    n_sets, n_batches = max(1, -(-groups.count() // SET)), max(1, -(-(size["asked"] or 0) // QUERIES))
    asked = cut(groups.select("g", "ids", "asks", "vectors").mapInArrow(_asking(kind, width), "key long, query_id long, v binary"))
    asked = asked.withColumn("batch", F.pmod(F.xxhash64("key"), F.lit(n_batches)))
    maxima = groups.select(F.pmod(F.xxhash64("g"), F.lit(n_sets)).alias("set"), "g", F.ceil(F.size("ids") / BLOCK).cast("int").alias("blocks"), "high", "low")
    maxima = maxima.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(n_batches - 1))))

    def chosen(asked: DataFrame, first: bool) -> DataFrame:
        every = asked.withColumn("set", F.explode(F.sequence(F.lit(0), F.lit(n_sets - 1))))
        return maxima.groupBy("batch", "set").cogroup(every.groupBy("batch", "set")).applyInArrow(_chosen(*shape, first), "key long, g long")

    def scored(pairs: DataFrame, asked: DataFrame) -> DataFrame:
        met = cut(pairs.join(asked, "key").select("g", "batch", "key", "query_id", "v", "least"))
        needed = met.select(F.col("g").alias("of"), F.col("batch").alias("part")).distinct().join(groups.select("g", "ids", "vectors"), F.col("of") == F.col("g")).drop("g")
        return needed.groupBy("of", "part").cogroup(met.groupBy("g", "batch")).applyInArrow(_scored(*shape, k), _FOUND)

    asked = asked.withColumn("least", F.lit(None).cast("long"))
    best = W.partitionBy("key").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    seeds = scored(chosen(asked, True), asked).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k)
    asked = cut(asked.drop("least").join(seeds.select("key", F.col("score").alias("least")), "key", "left"))
    local = scored(chosen(asked, False), asked)
    return local.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, 5)


SQL = """
WITH ready AS (
    SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.n, q.vec_id AS query_id, c.vec_id,
           coalesce(CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT), 0) AS score
    FROM ready q JOIN ready c ON q.n <> c.n WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""
