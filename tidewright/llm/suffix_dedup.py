"""Removal of repeated strings over all documents: suffix buckets, with the ranks of a cover sample to settle long ties.

Every byte that a string of LENGTH bytes covers which also starts earlier (in a smaller doc_id, or before in the same
document) goes. Suffixes only have to be told apart to that depth.

1. Cover sample. In each string of LENGTH bytes one suffix is sampled: the one whose first GRAM bytes have the smallest
   fingerprint. Equal strings have their sampled suffix at the same shift, wherever they stand, so the sample covers every
   tie. The suffixes that share a sampled one are neighbours; they and what they read are one span.
2. Ranks, one suffix bucket at a time (a bucket is a range of fingerprints of sampled suffixes). A bucket sorts its sampled
   suffixes and ranks their spans by fingerprint. Spans of one rank tie as a whole: all but the earliest are repeated in
   full. The earliest of a rank is unique in full where no other rank has its sampled suffix.
3. Only where several ranks share a sampled suffix, at the ends of repeats, are the suffixes of the earliest spans
   themselves sorted, again one bucket at a time, by fingerprints of LENGTH bytes and then by document.

Texts travel in chunks of CHUNK_BYTES; a chunk tells a bucket each rank once, with its first place, so a passage that a third
of all documents share is one entry a chunk and no task ever holds its copies. Entries are told apart by 72 (spans) and 64
(strings) bits within a bucket, and the bucket is that of other bits (of strings, of a second fingerprint). There is a bucket
for every BUCKET_BYTES, so what shares a bucket by chance does not grow with the input. A bucket is ordered by fingerprints,
not by bytes: equal strings meet all the same.

Chunks are cut from partitions of the input in the order read, so a lost task is redone alike from its lineage; nothing is
kept outside Spark's shuffles. Answers carry a mark of the chunk that they were made for.

Defined cases: a null text is empty; a null doc_id is the largest; rows that repeat a doc_id are the same document, so
neither is earlier than the other; documents shorter than LENGTH stay as they are.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm import kernels
from tidewright.llm.kernels import SEGMENT, span_hash

LENGTH = 100
#: Bytes that rank a sampled suffix.
GRAM = 32
CHUNK_BYTES = 2 << 20
#: Buckets: one for so many bytes of text, and so many at least.
BUCKET_BYTES, LEAST_BUCKETS = 16 << 20, 1024
_TEXT, _PRINTS, _REPLY = 0, 1, 2
_ROWS = "key long, kind int, chunk long, bucket int, a binary, b binary"
_ARROW = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("chunk", pa.int64()), ("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
_LAST_ID = np.iinfo(np.int64).max


#: Values of bytes for a second, independent fingerprint.
_OTHER_VALUES = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sampled(data: np.ndarray, valid: np.ndarray, length: int) -> np.ndarray:
    """The position of the sampled suffix of each string of that length; -1 where no string starts.

    Of the suffixes with the smallest 44 bits of fingerprint the first is taken.
    """
    out = np.full(len(data), -1, np.int64)
    width = length - GRAM + 1
    place = np.arange(SEGMENT + length, dtype=np.uint64)
    for at in range(0, len(data), SEGMENT):
        part = data[at : at + SEGMENT + length - 1]
        n = len(part) - length + 1
        if n <= 0 or not valid[at : at + n].any():
            continue
        grams = np.arange(len(part) - GRAM + 1)
        keys = (span_hash(part, grams, grams + GRAM) & ~np.uint64((1 << 20) - 1)) | place[: len(grams)]
        reach = 1
        while reach < width:
            step = min(reach, width - reach)
            keys = np.minimum(keys[: len(keys) - step], keys[step:])
            reach += step
        ok = valid[at : at + n]
        out[at : at + n][ok] = at + (keys[ok] & np.uint64((1 << 20) - 1)).astype(np.int64)
    return out


def _bucket(prints: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of the upper 32 bits."""
    return ((prints >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def _zip(values: np.ndarray) -> bytes:
    raw = values.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unzip(blob: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(blob[:8], "little")
    return np.frombuffer(pa.decompress(blob[8:], size, "zstd", asbytes=True), kind)


class Chunk:
    """Some whole documents in the order of their ids: the first column is the id, the last one the text."""

    def __init__(self, table: pa.Table, length: int):
        self.table, self.length = table, length
        self.ids = pc.fill_null(table.column(0), _LAST_ID).to_numpy().astype(np.int64)
        self.data, self.at = kernels.text_buffers(table.column(table.num_columns - 1).combine_chunks())
        self.sizes = np.diff(self.at)

    @classmethod
    def of(cls, table: pa.Table, length: int) -> Chunk:
        return cls(table.take(pc.sort_indices(table, [(table.column_names[0], "ascending")])).combine_chunks(), length)

    def mark(self) -> bytes:
        """Four bytes that tell this chunk from others."""
        return zlib.crc32(self.sizes.tobytes(), zlib.crc32(self.ids.tobytes())).to_bytes(4, "little")

    def strings(self) -> np.ndarray:
        """Where a string of the length starts inside a document."""
        marks = np.zeros(len(self.data) + 1, np.int8)
        long = self.sizes >= self.length
        marks[self.at[:-1][long]] += 1
        marks[self.at[1:][long] - self.length + 1] -= 1
        return np.cumsum(marks[:-1], dtype=np.int8) > 0

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and last start of the strings of each span, and fingerprints of its sampled suffix and of what it reads."""
        valid = self.strings()
        at = sampled(self.data, valid, self.length)
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
        begins = self.at[:-1][self.sizes >= self.length]
        new[begins] = True
        first = np.flatnonzero(new)
        stops = np.flatnonzero(new | ~valid)
        following = np.append(stops, len(valid))[np.searchsorted(stops, first, "right")]
        grams = at[first]
        order = np.argsort(grams, kind="stable")
        prints = np.empty(len(first), np.uint64)
        # Sampled suffixes have small fingerprints; mixed again, they fill all buckets alike.
        prints[order] = kernels.mix(span_hash(self.data, grams[order], grams[order] + GRAM) ^ np.uint64(0x5851F42D4C957F2D))
        return first, following - 1, prints, span_hash(self.data, first, following - 1 + self.length)

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, positions, "right") - 1


class Ranks:
    """The distinct spans of a chunk by bucket and first place, and which of all its spans are later than the first."""

    def __init__(self, chunk: Chunk, buckets: int):
        self.chunk = chunk
        self.first, self.last, grams, reads = chunk.spans()
        order = np.lexsort((np.arange(len(grams)), reads, grams))
        same = np.zeros(len(order), bool)
        same[1:] = (grams[order][1:] == grams[order][:-1]) & (reads[order][1:] == reads[order][:-1])
        heads = order[~same]
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(~same) - 1
        bucket = _bucket(grams[heads], buckets)
        by_bucket = np.lexsort((heads, bucket))
        rank = np.empty(len(heads), np.int64)
        rank[by_bucket] = np.arange(len(heads))
        self.place, self.heads = rank[place], heads[by_bucket]
        self.edges = np.searchsorted(bucket[by_bucket], np.arange(buckets + 1))
        self.grams, self.reads = grams[self.heads], reads[self.heads]
        doc = chunk.doc_of(self.first)
        self.ids, inside = chunk.ids[doc], self.first - chunk.at[doc]
        head = self.heads[self.place]
        self.later = (self.ids > self.ids[head]) | ((self.ids == self.ids[head]) & (inside > inside[head]))


_SPAN = np.dtype([("gram", "<u4"), ("read", "V5")])


def _cut(batches: Iterator[pa.RecordBatch], length: int, buckets: int, texts: bool) -> Iterator[pa.RecordBatch]:
    """The texts of each chunk, or for each bucket the distinct spans: halves of fingerprints and differences of ids."""
    number = TaskContext.get().partitionId() << 32
    for table in _chunks(batches):
        chunk = Chunk.of(table, length)
        if texts:
            yield _batch([(number, _TEXT, number, -1, _packed(chunk.table), b"")])
        else:
            ranks = Ranks(chunk, buckets)
            entries = np.empty(len(ranks.heads), _SPAN)
            entries["gram"] = ranks.grams.astype(np.uint32)
            entries["read"] = ranks.reads.view("V8").reshape(-1, 1).view(np.uint8).reshape(-1, 8)[:, :5].copy().view("V5").ravel()
            ids, rows = ranks.ids[ranks.heads], []
            for k in np.flatnonzero(np.diff(ranks.edges)).tolist():
                part = slice(ranks.edges[k], ranks.edges[k + 1])
                rows.append((k, _PRINTS, number, k, chunk.mark() + entries[part].tobytes(), _zip(np.diff(ids[part], prepend=0))))
            if rows:
                yield _batch(rows)
        number += 1


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole rows of about CHUNK_BYTES of text together."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        text = batch.column(batch.num_columns - 1)
        for lo, hi, data, _ in kernels.blocks(text, CHUNK_BYTES):
            if held and size + len(data) > CHUNK_BYTES:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(batch.slice(lo, hi - lo))
            size += len(data)
    if held:
        yield pa.Table.from_batches(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def _grouped(answer: Callable, group: pa.Table) -> pa.Table:
    """Texts pass with their chunk as key; the fingerprints of a bucket are answered to each chunk."""
    rows = group.to_pylist()
    texts = [(r["chunk"], _TEXT, r["chunk"], -1, r["a"], r["b"]) for r in rows if r["kind"] == _TEXT]
    asked = [r for r in rows if r["kind"] == _PRINTS]
    replies = [(r["chunk"], _REPLY, r["chunk"], r["bucket"], a, b) for r, (a, b) in zip(asked, answer(asked) if asked else [])]
    return pa.Table.from_batches([_batch(texts + replies)])


def _ids(row: dict) -> np.ndarray:
    return np.cumsum(_unzip(row["b"], np.int64))


def _answer_spans(rows: list[dict]) -> list[tuple[bytes, bytes]]:
    """Which spans an earlier document of another chunk has, and which earliest ones share their sampled suffix with others."""
    entries = [np.frombuffer(r["a"], _SPAN, offset=4) for r in rows]
    every = np.concatenate(entries)
    read = np.zeros((len(every), 8), np.uint8)
    read[:, :5] = np.ascontiguousarray(every["read"]).view(np.uint8).reshape(-1, 5)
    gram, read, ids = every["gram"].astype(np.uint64), read.view(np.uint64).ravel(), np.concatenate([_ids(r) for r in rows])
    order = np.lexsort((ids, read, gram))
    g, r, i = gram[order], read[order], ids[order]
    n = np.arange(len(order))
    new_gram, new_read = np.ones(len(order), bool), np.ones(len(order), bool)
    new_gram[1:] = g[1:] != g[:-1]
    new_read[1:] = new_gram[1:] | (r[1:] != r[:-1])
    later = i > i[np.maximum.accumulate(np.where(new_read, n, 0))]
    group = np.cumsum(new_gram) - 1
    shared = np.bincount(group, weights=new_read)[group] > 1
    flags = np.empty((2, len(order)), bool)
    flags[0, order], flags[1, order] = later, shared & ~later
    cuts = np.cumsum([len(e) for e in entries])[:-1]
    return [(row["a"][:4] + np.packbits(x).tobytes(), np.packbits(y).tobytes()) for row, x, y in zip(rows, np.split(flags[0], cuts), np.split(flags[1], cuts))]


def _later(prints: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which entries have an equal one with a smaller id."""
    order = np.lexsort((ids, prints))
    p, i = prints[order], ids[order]
    new = np.ones(len(order), bool)
    new[1:] = p[1:] != p[:-1]
    out = np.zeros(len(ids), bool)
    out[order] = i > i[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    return out


def _answer_windows(rows: list[dict]) -> list[tuple[bytes, bytes]]:
    """Which fingerprints of whole strings an earlier document of another chunk has."""
    prints = [np.frombuffer(r["a"], np.uint64) for r in rows]
    later = _later(np.concatenate(prints), np.concatenate([_ids(r) for r in rows]))
    return [(np.packbits(x).tobytes(), b"") for x in np.split(later, np.cumsum([len(p) for p in prints])[:-1])]


def _bits(replies: dict[int, bytes], edges: np.ndarray) -> np.ndarray:
    """The answers of the buckets, in order of the fingerprints that were asked."""
    out = np.zeros(edges[-1], bool)
    for k, blob in replies.items():
        n = edges[k + 1] - edges[k]
        if n:
            out[edges[k] : edges[k + 1]] = np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)
    return out


def _windows(chunk: Chunk, mask: np.ndarray, buckets: int) -> tuple:
    """Starts that the mask marks, their fingerprints' order and firsts.

    Gives starts, place of each start among the distinct fingerprints (by bucket, then by first start), those firsts (as
    indexes of starts), and the edges of the buckets.
    """
    starts = np.flatnonzero(mask)
    prints = span_hash(chunk.data, starts, starts + chunk.length)
    distinct, first, place = np.unique(prints, return_index=True, return_inverse=True)
    at = np.sort(starts[first])
    other = np.empty(len(first), np.uint64)
    other[np.argsort(first, kind="stable")] = span_hash(chunk.data, at, at + chunk.length, _OTHER_VALUES)
    bucket = _bucket(other, buckets)
    order = np.lexsort((first, bucket))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return starts, rank[place], first[order], distinct[order], np.searchsorted(bucket[order], np.arange(buckets + 1))


def _covered(size: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Positions inside the ranges, ends included."""
    marks = np.zeros(size + 1, np.int32)
    np.add.at(marks, first, 1)
    np.add.at(marks, last + 1, -1)
    return np.cumsum(marks[:-1]) > 0


def _search(group: pa.Table, length: int, buckets: int, keep: int, with_text: bool) -> pa.Table:
    """Decided documents of a chunk, texts of the others with what is known of them, and the strings to look up."""
    rows = group.to_pylist()
    text = next(r for r in rows if r["kind"] == _TEXT)
    replies = [r for r in rows if r["kind"] == _REPLY]
    chunk = Chunk(_unpacked(text["a"]), length)
    if any(r["a"][:4] != chunk.mark() for r in replies):
        raise RuntimeError("the input was read in another order than before; answers do not fit their chunk")
    ranks = Ranks(chunk, buckets)
    earlier = _bits({r["bucket"]: r["a"][4:] for r in replies}, ranks.edges)
    shared = _bits({r["bucket"]: r["b"] for r in replies}, ranks.edges)
    size = len(chunk.data)
    later = ranks.later | earlier[ranks.place]
    removed = _covered(size, ranks.first[later], ranks.last[later] + length - 1)
    asks = shared[ranks.place] & ~later
    mask = _covered(size, ranks.first[asks], ranks.last[asks])
    is_open = np.zeros(len(chunk.sizes), bool)
    is_open[chunk.doc_of(ranks.first[asks])] = True
    decided = _results(chunk, removed, np.flatnonzero(~is_open), keep, with_text)
    rest = Chunk(chunk.table.take(pa.array(np.flatnonzero(is_open))).combine_chunks(), length)
    inside = np.repeat(is_open, chunk.sizes)
    blob = _packed(rest.table) + _tail(mask[inside], removed[inside])
    out = [(buckets + text["chunk"], _TEXT, text["chunk"], -1, _packed(decided), blob)]
    if is_open.any():
        starts, _, firsts, distinct, edges = _windows(rest, mask[inside], buckets)
        ids = rest.ids[rest.doc_of(starts[firsts])]
        for k in np.flatnonzero(np.diff(edges)).tolist():
            part = slice(edges[k], edges[k + 1])
            out.append((k, _PRINTS, text["chunk"], k, distinct[part].tobytes(), _zip(np.diff(ids[part], prepend=0))))
    return pa.Table.from_batches([_batch(out)])


def _tail(*masks: np.ndarray) -> bytes:
    """The masks and, in the last 8 bytes, the size of what precedes them here."""
    blob = _zip(np.concatenate([np.packbits(m) for m in masks]))
    return blob + len(blob).to_bytes(8, "little")


def _results(chunk: Chunk, removed: np.ndarray, docs: np.ndarray, keep: int, with_text: bool) -> pa.Table:
    """The kept columns of these documents, and what is removed from each."""
    begins = removed.copy()
    begins[1:] &= ~removed[:-1]
    inner = chunk.at[:-1][chunk.sizes > 0]
    begins[inner] = removed[inner]
    gone, runs = np.concatenate(([0], np.cumsum(removed))), np.concatenate(([0], np.cumsum(begins)))
    lo, hi = chunk.at[docs], chunk.at[docs + 1]
    n_removed, n_spans = gone[hi] - gone[lo], runs[hi] - runs[lo]
    kept = [
        chunk.data[a:b].tobytes() if not n else chunk.data[a:b][~removed[a:b]].tobytes()
        for a, b, n in zip(lo.tolist(), hi.tolist(), n_removed.tolist())
    ]
    columns = {
        "n_bytes": pa.array(hi - lo, pa.int64()),
        "n_removed": pa.array(n_removed, pa.int64()),
        "n_spans": pa.array(n_spans, pa.int64()),
        "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
    }
    if with_text:
        columns["kept_text"] = pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string())
    table = chunk.table.take(pa.array(docs, pa.int64())).select(list(range(keep)))
    for name, values in columns.items():
        table = table.append_column(name, values)
    return table


def _finish(group: pa.Table, length: int, buckets: int, keep: int, with_text: bool) -> pa.Table:
    """What is removed from the open documents of a chunk, with the documents decided before."""
    rows = group.to_pylist()
    text = next(r for r in rows if r["kind"] == _TEXT)
    decided = _unpacked(text["a"])
    size = int.from_bytes(text["b"][-8:], "little")
    rest = Chunk(_unpacked(text["b"][: -8 - size]), length)
    if not len(rest.sizes):
        return decided
    mask, known = (np.unpackbits(half, count=len(rest.data)).astype(bool) for half in _unzip(text["b"][-8 - size : -8], np.uint8).reshape(2, -1))
    starts, place, firsts, _, edges = _windows(rest, mask, buckets)
    earlier = _bits({r["bucket"]: r["a"] for r in rows if r["kind"] == _REPLY}, edges)
    doc = rest.doc_of(starts)
    ids, inside, first = rest.ids[doc], starts - rest.at[doc], firsts[place]
    later = earlier[place] | (ids > ids[first]) | ((ids == ids[first]) & (inside > inside[first]))
    removed = known | _covered(len(rest.data), starts[later], starts[later] + length - 1)
    return pa.concat_tables([decided, _results(rest, removed, np.arange(len(rest.sizes)), keep, with_text)])


def dedup(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """The columns of keep (the id first), n_bytes, n_removed, n_spans and kept_sha256 of every row; kept_text if asked for.

    A removal can cut a character in two; kept_text leaves out the bytes that are then no UTF-8.
    """
    if not GRAM < length < 1 << 16:
        raise ValueError(f"strings of {length} bytes")
    slim = docs.select(
        F.col(keep[0]).cast("long").alias("_keep_0"),
        *[F.col(c).alias(f"_keep_{k}") for k, c in enumerate(keep) if k],
        F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("_text"),
    )
    total = slim.agg(F.sum(F.length("_text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-total // BUCKET_BYTES))
    fixed = {"length": length, "buckets": buckets}
    ends = fixed | {"keep": len(keep), "with_text": with_text}
    schema = ", ".join(f"_keep_{k} {slim.schema[k].dataType.simpleString()}" for k in range(len(keep)))
    schema += ", n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text
    asked = slim.mapInArrow(lambda batches: _cut(batches, texts=False, **fixed), _ROWS)
    texts = slim.mapInArrow(lambda batches: _cut(batches, texts=True, **fixed), _ROWS)
    replies = asked.groupBy("key").applyInArrow(lambda rows: _grouped(_answer_spans, rows), _ROWS)
    found = (
        texts.unionAll(replies)
        .groupBy("key")
        .applyInArrow(lambda rows: _search(rows, **ends), _ROWS)
        .groupBy("key")
        .applyInArrow(lambda rows: _grouped(_answer_windows, rows), _ROWS)
        .groupBy("key")
        .applyInArrow(lambda rows: _finish(rows, **ends), schema)
    )
    return found.select(*[F.col(f"_keep_{k}").alias(c) for k, c in enumerate(keep)], *found.columns[len(keep) :])


def query(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
