"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full shingle sets, union-find grouping.

SuperMinHash gives the values of an element's signature slots by one random permutation of the slots: at step j the element
lands in slot p(j) with the value j + r. A slot keeps the smallest value, so an element stops as soon as every slot of its
document holds less than the step. Values are whole numbers: the step in the upper 8 bits, 24 random bits below.

Documents with equal shingle sets are one class, whose smallest doc_id stands for it. Bands of the signatures of the class
representatives give buckets. First each bucket links its members to its smallest one; these pairs are verified on the full
sets, and links are grouped by union-find (inside partitions, then by large-star and small-star rounds). Buckets whose
members are then in one component are done. In the others, what the first round did not put together with the smallest member
is compared with all members on the full sets, in blocks of a bounded number of texts; only links leave a block, so no pair is
ever a row and none is lost.

Two documents of similarity s share no band with probability (1 - s**ROWS)**BANDS: 5e-6 at 0.8. Six rows a band keep
documents that only share frequent words apart: at a similarity of 0.05 a band is shared once in 60 million pairs.

Defined cases: a null or empty text, or one without words, has an empty set and is linked with nothing; a text of fewer
words than a shingle is one shingle; repeated rows are copies of each other; a null doc_id is linked with nothing, has no
component and is kept. Rows that repeat a doc_id with other texts are one node of the graph; each of the texts is compared (a
mark, its hash, tells them apart) and its links are the node's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidewright.llm import kernels
from tidewright.llm.common import cut

BANDS, ROWS = 40, 6
SLOTS = BANDS * ROWS
#: A key that has more rows than HUB_ROWS and this part of all is joined by a broadcast.
HUB_ROWS, HUB_SHARE = 64, 2e-5
#: Pairs of one text that are verified together.
PART_PAIRS = 2048
#: Members of a block, and shingles that are compared at once.
BLOCK, COLUMNS = 512, 4096
#: Nodes that a partition's union-find holds at most (and a batch's more).
FOREST = 500_000
#: Steps of which only the swaps are kept.
LAZY_STEPS = 12
_STEP = np.uint32(24)


def superminhash(doc: np.ndarray, value: np.ndarray, n_docs: int, slots: int = SLOTS, seed: int = 1) -> np.ndarray:
    """Signatures (n_docs, slots) of the documents' distinct values; a document without values has the largest in each slot."""
    signature = np.full((n_docs, slots), 0xFFFFFFFF, np.uint32)
    flat, doc, value = signature.reshape(-1), doc.astype(np.int64), kernels.mix(value + np.uint64(seed))
    order: np.ndarray | None = None
    swaps: list[tuple[np.ndarray, np.ndarray]] = []

    def at(place: np.ndarray) -> np.ndarray:
        """What the permutations hold at these places after the swaps so far."""
        if order is not None:
            return order[np.arange(len(place)), place].astype(np.int64)
        found = place
        for to, what in swaps:
            found = np.where(to == place, what, found)
        return found

    for step in range(slots):
        x = kernels.mix(value + np.uint64(0x9E3779B97F4A7C15 * (step + 1) & 0xFFFFFFFFFFFFFFFF))
        pick = step + ((x & np.uint64(0xFFFFFFFF)) * np.uint64(slots - step) >> np.uint64(32)).astype(np.int64)
        slot, moved = at(pick), at(np.full(len(pick), step))
        np.minimum.at(flat, doc * slots + slot, (np.uint32(step) << _STEP) | (x >> np.uint64(40)).astype(np.uint32))
        if order is None:
            swaps.append((pick, moved))
        else:
            order[np.arange(len(pick)), pick] = moved
        if step + 1 == slots:
            break
        stays = ~(signature.max(axis=1) < np.uint32(step + 1) << _STEP)[doc]
        if not stays.all():
            doc, value = doc[stays], value[stays]
            swaps = [(to[stays], what[stays]) for to, what in swaps]
            order = None if order is None else order[stays]
        if not len(doc):
            break
        if order is None and step == LAZY_STEPS:
            # The few elements that go on are those of short texts: from here on their permutations are written out.
            order = np.tile(np.arange(slots, dtype=np.uint8), (len(doc), 1))
            for to, what in swaps:
                order[np.arange(len(doc)), to] = what
            swaps = []
    return signature


def bands(signature: np.ndarray) -> np.ndarray:
    """One hash for each band of each signature."""
    values = signature.astype(np.uint64).reshape(len(signature), BANDS, -1)
    total = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), values.shape[:2]).copy()
    for k in range(values.shape[2]):
        total = kernels.mix(total * np.uint64(0x9E3779B97F4A7C15) + values[:, :, k])
    return total.view(np.int64)


def _signed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in kernels.blocks(batch.column(1)):
                doc, value = kernels.distinct(*kernels.Words(data, at).shingles(width))
                sizes = np.bincount(doc, minlength=hi - lo)
                edge = np.concatenate(([0], np.cumsum(sizes)))
                raw = value.tobytes()
                keys = [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(edge[:-1], edge[1:])]
                found = bands(superminhash(doc, value, hi - lo))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        batch.column(2).slice(lo, hi - lo),
                        pa.array(sizes, pa.int64()),
                        pa.array(keys, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * BANDS, pa.int32()), pa.array(found.ravel())),
                    ],
                    names=["doc_id", "mark", "n_shingles", "key", "bands"],
                )

    return run


def signed(docs: DataFrame, width: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, mark of the text, n_shingles, a digest of the shingle set, and the band hashes of every row."""
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("mark"))
    return slim.mapInArrow(_signed(width), "doc_id long, mark long, n_shingles long, key binary, bands array<long>")


def _shared(width: int):
    def sets(column: pa.Array, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        data, at = kernels.text_buffers(column.slice(lo, hi - lo))
        return kernels.distinct(*kernels.Words(data, at).shingles(width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, _, _ in kernels.blocks(batch.column(2)):
                (da, va), (db, vb) = sets(batch.column(2), lo, hi), sets(batch.column(3), lo, hi)
                row, value = np.concatenate([da, db]), np.concatenate([va, vb])
                order = np.lexsort((value, row))
                row, value = row[order], value[order]
                both = np.bincount(row[1:][(row[1:] == row[:-1]) & (value[1:] == value[:-1])], minlength=hi - lo)
                either = np.bincount(row, minlength=hi - lo) - both
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(both, pa.int64()), pa.array(either, pa.int64())],
                    names=["a", "b", "both", "either"],
                )

    return run


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, mark_a, b, mark_b, part), as a and b, of which 100 * intersection >= percent * union holds on the full sets.

    part: a number that spreads the pairs of an a with very many; each part gets its text of a.
    """
    left = texts.select(F.col("doc_id").alias("a"), F.col("mark").alias("mark_a"), F.col("text").alias("text_a"))
    left = pairs.select("a", "mark_a", "part").distinct().join(left, ["a", "mark_a"])
    right = texts.select(F.col("doc_id").alias("b"), F.col("mark").alias("mark_b"), F.col("text").alias("text_b"))
    met = pairs.join(right, ["b", "mark_b"]).join(left, ["a", "mark_a", "part"]).select("a", "b", "text_a", "text_b")
    counted = met.mapInArrow(_shared(width), "a long, b long, both long, either long")
    return counted.filter((100 * F.col("both") >= percent * F.col("either")) & (F.col("both") > 0)).select("a", "b")


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of a partition: each node but a root with the smallest node of its tree.

    After FOREST nodes what is known is given out and forgotten, so memory is bounded; the rounds that follow join the trees.
    """
    parent: dict[int, int] = {}

    def trees() -> pa.RecordBatch:
        found = [(x, r) for x in list(parent) if (r := root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > FOREST:
            yield trees()
            parent.clear()
    yield trees()


def _towards(rows: DataFrame, told: DataFrame, total: int, key: str = "u") -> DataFrame:
    """The rows with what is told of their key (key, n: rows of the key, and more columns than n, which stays out).

    Keys with very many rows are told by a broadcast: those with more than a part HUB_SHARE of all rows, so that at most as
    many as its inverse are. The others, of which no partition holds much, are joined by a shuffle.
    """
    often = max(HUB_ROWS, int(total * HUB_SHARE))
    hubs = F.broadcast(told.filter(F.col("n") > often).drop("n").withColumn("_hub", F.lit(True)))
    met = rows.join(hubs, key, "left")
    known = [c for c in told.columns if c not in (key, "n")]
    rest = met.filter("_hub IS NULL").drop("_hub", *known).join(told.filter(F.col("n") <= often).drop("n"), key)
    return met.filter("_hub").drop("_hub").unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node of the edges (a, b) that is not the smallest itself."""

    def saved(df: DataFrame) -> tuple[DataFrame, tuple]:
        """The edges, cut from their lineage, with a count and a checksum of them taken on the way."""
        seen = Observation()
        df = cut(df.distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")))
        return df, (seen.get["n"], seen.get["s"])

    now, before = saved(edges.select("a", "b").mapInArrow(_forest, "u long, v long"))
    while before[0]:
        # large-star: the larger neighbours of a node go to its smallest neighbour
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        star = _towards(both.filter("v > u"), least, 2 * before[0]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small-star: the smaller neighbours of a node, and the node, go to the smallest of them
        # A node has no more smaller neighbours than the forests at the beginning had roots in its component: no hubs here.
        least = star.groupBy("u").agg(F.min("v").alias("m"))
        met = star.join(least, "u")
        now, after = saved(met.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))))
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def alike(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of these sets are linked, as a matrix of all with all; sets are sorted arrays of distinct hashes."""
    n, size = len(sets), np.array([len(x) for x in sets])
    row, value = np.repeat(np.arange(n), size), np.concatenate(sets)
    _, column, count = np.unique(value, return_inverse=True, return_counts=True)
    often = count[column] > 1
    row, column = row[often], np.unique(column[often], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((n, n), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        part = slice(*np.searchsorted(column, [at, at + COLUMNS]))
        has = np.zeros((n, COLUMNS), np.float32)
        has[row[part], column[part] - at] = 1
        both += has @ has.T
    both = np.rint(both).astype(np.int64)
    return (100 * both >= percent * (size[:, None] + size[None, :] - both)) & (both > 0)


def _linked_inside(width: int, percent: int):
    """Links between the texts of a block: each one that is not the smallest of what it is linked with, to the smallest."""

    def run(table: pa.Table) -> pa.Table:
        ids, component = table.column("doc_id").to_numpy(), table.column("component").to_numpy()
        sets: list[np.ndarray] = []
        for lo, hi, data, at in kernels.blocks(table.column("text").combine_chunks()):
            doc, value = kernels.distinct(*kernels.Words(data, at).shingles(width))
            sets += np.split(value, np.searchsorted(doc, np.arange(1, hi - lo)))
        link = alike(sets, percent) & (component[:, None] != component[None, :])
        label = ids.copy()
        while True:
            fresh = np.minimum(label, np.where(link, label[None, :], np.iinfo(np.int64).max).min(axis=1))
            if (fresh == label).all():
                break
            label = fresh
        moved = label != ids
        return pa.table({"a": label[moved], "b": ids[moved]})

    return run


def link(reps: DataFrame, texts: DataFrame, same: DataFrame, width: int, percent: int) -> DataFrame:
    """node and component over the representatives (doc_id, mark, n_shingles, bands) and given links (a, b), as far as they differ."""
    entries = reps.select("doc_id", "mark", "n_shingles", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "mark", "n_shingles")).alias("c")).filter("n > 1")
    n_entries = reps.count() * BANDS
    members = cut(_towards(entries, shared.withColumn("size", F.col("n")), n_entries, "bucket"))
    # The texts that verification may ask for are gathered once; what follows only moves those.
    texts = cut(texts.join(members.select("doc_id", "mark").distinct(), ["doc_id", "mark"], "left_semi").dropDuplicates(["doc_id", "mark"]))
    fits = F.least("n_shingles", "c.n_shingles") * 100 >= F.greatest("n_shingles", "c.n_shingles") * percent
    ends = [F.col("c.doc_id").alias("a"), F.col("c.mark").alias("mark_a"), F.col("doc_id").alias("b"), F.col("mark").alias("mark_b")]
    pairs = members.filter((F.col("c.doc_id") != F.col("doc_id")) & fits).groupBy(*ends).agg(F.max("size").alias("size"))
    part = F.pmod(F.xxhash64("b", "mark_b"), F.ceil(F.col("size") / PART_PAIRS))
    pairs = cut(pairs.select("a", "mark_a", "b", "mark_b", part.alias("part")))
    links = cut(verified(pairs, texts, width, percent).unionAll(same.select("a", "b")))
    named = components(links).withColumnRenamed("node", "doc_id")
    stars = named.select(F.col("component").alias("a"), F.col("doc_id").alias("b"))
    placed = members.select("bucket", "doc_id", "mark", F.col("c.doc_id").alias("centre")).join(named, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    # Members that the first round has put together with the bucket's smallest one meet the others alone, not each other.
    parts = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.max(F.col("doc_id") == F.col("centre")).alias("main"))
    sizes = parts.groupBy("bucket").agg(
        F.sum("n").alias("n"), F.sum(F.when(~F.col("main"), F.col("n"))).alias("others"), F.max(F.when(F.col("main"), F.col("component"))).alias("major")
    ).filter("others > 0")
    sizes = sizes.select("bucket", "n", "major", F.ceil(F.col("others") / BLOCK).cast("int").alias("_others"), F.ceil((F.col("n") - F.col("others")) / BLOCK).cast("int").alias("_mains"))
    open_rows = _towards(placed, sizes, n_entries, "bucket").withColumn("_main", F.col("component") == F.col("major"))
    spread = lambda blocks: F.pmod(F.xxhash64("doc_id"), F.col(blocks)).cast("int")
    met = F.sequence(F.lit(0), F.col("_others") - F.when(F.col("_main"), 1).otherwise(1 - F.col("_mains")))
    open_rows = open_rows.withColumn("_own", F.when(F.col("_main"), F.col("_others") + spread("_mains")).otherwise(spread("_others"))).withColumn("_other", F.explode(met))
    blocks = open_rows.select("bucket", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "doc_id", "mark", "component").join(texts, ["doc_id", "mark"])
    inside = blocks.groupBy("bucket", "i", "j").applyInArrow(_linked_inside(width, percent), "a long, b long")
    return components(stars.unionAll(cut(inside)))


def group(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept (is that document) of every row."""
    every = cut(signed(docs, width, text, doc_id))
    filled = F.col("n_shingles") > 0
    usable = every.filter(filled & F.col("doc_id").isNotNull())
    classes = usable.groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    reps = usable.join(classes, ["key", "doc_id"]).groupBy("doc_id", "key").agg(F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.min("mark").alias("mark"))
    reps = cut(reps)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    # A doc_id with several shingle sets links their classes.
    several = usable.groupBy("doc_id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).filter("lo < hi").select("doc_id")
    same = usable.join(several, "doc_id", "left_semi").select("key", F.col("doc_id").alias("b")).distinct()
    same = same.join(classes.withColumnRenamed("doc_id", "a"), "key").filter("a < b").select("a", "b")
    found = link(reps.select("doc_id", "mark", "n_shingles", "bands"), texts, same, width, percent)
    named = reps.select("key", "doc_id").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    named = cut(named.select("key", F.coalesce("component", "doc_id").alias("component_id")))
    linked = usable.select("key", "doc_id", "n_shingles").join(named, "key").select("doc_id", "n_shingles", "component_id")
    alone = every.filter(~(filled & F.col("doc_id").isNotNull())).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One document of each group, with all its columns; of rows that repeat a kept doc_id and text, one; of null ids, one a text."""
    found = group(docs, width, percent, text, doc_id).filter("kept AND doc_id IS NOT NULL")
    kept = cut(found.groupBy(F.col("doc_id").alias("_near_dup_id")).agg(F.count("*").alias("_near_dup_rows")))
    named = F.col(f"`{doc_id}`")

    def rows(which: str) -> DataFrame:
        return docs.join(kept.filter(which), named.cast("long") == F.col("_near_dup_id"), "left_semi")

    # Ids of one row, which are nearly all, need no more; the others, and null ids, are told apart by their texts.
    return rows("_near_dup_rows = 1").unionAll(rows("_near_dup_rows > 1").dropDuplicates([doc_id, text])).unionAll(docs.filter(named.isNull()).dropDuplicates([text]))


def query(spark, sf_dir: str) -> DataFrame:
    return group(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=2, percent=80)


#: Every pair of documents that share a shingle, and components by reachability: for small tables.
SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 1 THEN [ws[1]] ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
c AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT l.y, c.root FROM c JOIN l ON l.x = c.doc_id)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c.root) AS component_id, d.doc_id = min(c.root) AS kept
FROM documents d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
