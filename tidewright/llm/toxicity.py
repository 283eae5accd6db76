"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, learn from labels of whole documents.

A sentence's evidence x is the sum of the weights (0 or more) of its words' features: the whole word and its beginnings of
4, 5 and 6 bytes, lower case. Its probability is p = 1 - (1 + e^b) / (1 + e^(b + x)), which is 0 without evidence, so long
clean documents gather nothing. A document is toxic unless the leak and all its sentences are not (noisy-or). Weights, b
and the leak are fitted to document labels by gradient descent on the log loss; no sentence is ever labelled. The same
sentence probabilities then locate the offending sentences.

The model is fitted on the driver on a bounded sample of whole labelled documents: SAMPLE_POSITIVE and SAMPLE_NEGATIVE
rows, picked by a hash of the id. Every text is scored whole. Learning and scoring use the text alone.

Defined cases: null and empty texts have no evidence and get the leak as score; without usable labels every score is 0.0
(where all labels are alike, the leak alone is learned); labels that are null take no part, several labels of one document
count as their largest; repeated rows are scored alike; ids may be null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm import kernels
from tidewright.llm.common import held_out, keeping, spread

SAMPLE_POSITIVE, SAMPLE_NEGATIVE = 1500, 2500
#: Features are hashed to so many weights; a kind is a whole word (0) or a beginning of so many bytes.
WIDTH, KINDS = 1 << 18, (0, 4, 5, 6)
#: A feature takes part that so many documents have and whose share in toxic ones is so many standard errors larger.
LEAST_DOCS, LEAST_Z, MOST_FEATURES = 4, 5.0, 8192
#: A sentence ends at . ! ? or a line break, and after so many words.
SENTENCE_WORDS = 40
EPOCHS, RATE, PENALTY = 120, 0.15, 2e-5
#: The largest leak, and the probability from which a sentence offends.
MOST_LEAK, LEAST = 0.2, 0.5
_ENDS = np.zeros(256, bool)
_ENDS[[10, 33, 46, 63]] = True


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    leak: float


class Sentences:
    """The words of a block with features, and the sentences that they form."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        words = kernels.Words(data, at, alphabet=kernels.IN_NAME)
        self.begin, self.end, n = words.begin, words.end, len(words.begin)
        size = self.end - self.begin
        found = []
        for kind in KINDS:
            prints = words.hash if not kind else words.span_hash(self.begin, np.minimum(self.begin + kind, self.end))
            slot = (kernels.mix(prints + np.uint64(kind)) >> np.uint64(64 - 18)).astype(np.int32)
            slot[size < kind] = -1
            found.append(slot)
        self.features = np.stack(found, axis=1) if n else np.zeros((0, len(KINDS)), np.int32)
        ends = np.concatenate(([0], np.cumsum(_ENDS[data])))
        doc = words.doc()
        new = np.ones(n, bool)
        new[1:] = (doc[1:] != doc[:-1]) | (ends[self.begin[1:]] > ends[self.end[:-1]])
        run = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))
        new |= run % SENTENCE_WORDS == 0
        self.starts = np.flatnonzero(new)
        self.sentence = np.cumsum(new) - 1
        self.doc, self.word_doc = doc[self.starts], doc

    def evidence(self, weights: np.ndarray) -> np.ndarray:
        """The sum of weights of each sentence; weights has one more entry, 0, for features that a word lacks."""
        if not len(self.starts):
            return np.zeros(0)
        return np.add.reduceat(weights[self.features].sum(axis=1, dtype=np.float64), self.starts)


def _softplus(x):
    return np.logaddexp(0, x)


def families(texts: list[str]) -> np.ndarray:
    """The smallest hash of three words of each text: near copies mostly share it."""
    out = np.full(len(texts), np.iinfo(np.uint64).max, np.uint64)
    for lo, _, data, at in kernels.blocks(pa.array(texts, pa.string())):
        doc, value = kernels.Words(data, at).shingles(3)
        np.minimum.at(out, doc + lo, value)
    return out


def fit(texts: list[str], toxic: np.ndarray) -> Model | None:
    """The model of these whole documents and their labels (0 or 1). Of near copies with one label, one teaches."""
    if not len(texts):
        return None
    first = np.unique(np.stack([families(texts), toxic.astype(np.uint64)]), axis=1, return_index=True)[1]
    texts, toxic = [texts[k] for k in np.sort(first)], toxic[np.sort(first)]
    pieces, n_docs = [], len(texts)
    column = pa.array(texts, pa.string())
    for lo, _, data, at in kernels.blocks(column):
        found = Sentences(data, at)
        pairs = np.unique((found.word_doc + lo)[:, None].astype(np.int64) * WIDTH + np.maximum(found.features, 0))
        pieces.append((lo, pairs))
    pairs = np.concatenate([p for _, p in pieces])
    n_pos = int(toxic.sum())
    n_neg = n_docs - n_pos
    leak = min(MOST_LEAK, (n_pos + 0.5) / (n_docs + 1))
    if not n_pos or not n_neg:
        return Model(np.zeros(WIDTH + 1, np.float32), -4.0, leak if not n_pos else 0.5)
    slot, positive = pairs % WIDTH, toxic[pairs // WIDTH] > 0
    df_pos, df_neg = np.bincount(slot[positive], minlength=WIDTH), np.bincount(slot[~positive], minlength=WIDTH)
    share = (df_pos + df_neg) / n_docs
    error = np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n_pos + 1 / n_neg))
    z = np.where(df_pos + df_neg >= LEAST_DOCS, (df_pos / n_pos - df_neg / n_neg) / error, 0)
    chosen = np.flatnonzero(z >= LEAST_Z)
    chosen = chosen[np.argsort(-z[chosen], kind="stable")][:MOST_FEATURES]
    dense = np.full(WIDTH + 1, -1, np.int64)
    dense[chosen] = np.arange(len(chosen))

    sentence, feature, doc_of = [], [], []
    base = 0
    for lo, _, data, at in kernels.blocks(column):
        found = Sentences(data, at)
        named = dense[found.features]
        rows, cols = np.nonzero(named >= 0)
        used, place = np.unique(found.sentence[rows], return_inverse=True)
        sentence.append(base + place)
        feature.append(named[rows, cols])
        doc_of.append(found.doc[used] + lo)
        base += len(used)
    sentence, feature, doc_of = map(np.concatenate, (sentence, feature, doc_of))

    w, b, off = np.full(len(chosen), 0.3), -4.0, np.log(0.02 / 0.98)
    moments = [np.zeros(len(w) + 2), np.zeros(len(w) + 2)]
    for epoch in range(1, EPOCHS + 1):
        x = np.bincount(sentence, weights=w[feature], minlength=base)
        hazard = np.bincount(doc_of, weights=_softplus(b + x) - _softplus(b), minlength=n_docs)
        lam = 1 / (1 + np.exp(-off))
        stay = (1 - lam) * np.exp(-hazard)
        p = np.maximum(1 - stay, 1e-6)
        d_hazard = np.where(toxic > 0, -stay / p, 1.0)
        d_x = d_hazard[doc_of] / (1 + np.exp(-(b + x)))
        d_b = (d_hazard[doc_of] * (1 / (1 + np.exp(-(b + x))) - 1 / (1 + np.exp(-b)))).sum()
        d_off = d_hazard.sum() * lam
        grad = np.append(np.bincount(feature, weights=d_x[sentence], minlength=len(w)) / n_docs + PENALTY * w, [d_b / n_docs, d_off / n_docs])
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.99 * moments[1] + 0.01 * grad**2
        move = RATE * (moments[0] / (1 - 0.9**epoch)) / (np.sqrt(moments[1] / (1 - 0.99**epoch)) + 1e-8)
        w = np.maximum(w - move[:-2], 0)
        b = float(np.clip(b - move[-2], -8, -1))
        off = float(np.clip(off - move[-1], -7, np.log(MOST_LEAK / (1 - MOST_LEAK))))
    weights = np.zeros(WIDTH + 1, np.float32)
    weights[chosen] = w
    return Model(weights, b, float(1 / (1 + np.exp(-off))))


def training_rows(docs: DataFrame, labels: DataFrame, positive: int = SAMPLE_POSITIVE, negative: int = SAMPLE_NEGATIVE) -> tuple[list[str], np.ndarray]:
    """Texts and labels of the sample: about so many of each label, by a hash of the id, none of them held out."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic") > 0).alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    picked = None
    for label, most in ((True, positive), (False, negative)):
        share = min(1.0, most / max(1, counts.get(label, 0)))
        order = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30))
        part = known.filter((F.col("toxic") == label) & (order < int(share * (1 << 30)) + 1)).orderBy(order, "doc_id").limit(2 * most)
        picked = part if picked is None else picked.unionAll(part)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "toxic").toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return [t or "" for t in rows.column("text").to_pylist()], rows.column("toxic").to_numpy().astype(np.int64)


def _probabilities(found: Sentences, model: Model) -> np.ndarray:
    return 1 - np.exp(_softplus(model.bias) - _softplus(model.bias + found.evidence(model.weights)))


def _spans(found: Sentences, p: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sentences of that probability or more, and where they begin and end in the block."""
    rows = np.flatnonzero(p >= least)
    last = np.append(found.starts[1:], len(found.begin)) - 1
    return rows, found.begin[found.starts[rows]], found.end[last[rows]]


#: The sentences of a document that offend: bytes and probability.
_OFFENDING = pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())])


def score(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",), text: str = "text", least: float = LEAST) -> DataFrame:
    """The columns of keep, the probability of each row's whole text, and its offending sentences in order.

    A column of keep that has the name of one of these two is given under that name all the same, before it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, counts, spots = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64), []
            for lo, hi, data, at in kernels.blocks(batch.column(len(keep))) if model else ():
                found = Sentences(data, at)
                p = _probabilities(found, model)
                stay = np.log1p(-np.minimum(p, 1 - 1e-12))
                out[lo:hi] = 1 - (1 - model.leak) * np.exp(np.bincount(found.doc, weights=stay, minlength=hi - lo))
                rows, begin, end = _spans(found, p, least)
                doc = found.doc[rows]
                counts[lo:hi] = np.bincount(doc, minlength=hi - lo)
                spots.append(pa.StructArray.from_arrays([pa.array(begin - at[doc], pa.int64()), pa.array(end - at[doc], pa.int64()), pa.array(p[rows])], fields=list(_OFFENDING)))
            every = pa.concat_arrays(spots) if spots else pa.array([], _OFFENDING)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), every)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(np.clip(out, 0, 1)), lists], names=[*inner, "_score", "_offending"])

    columns, inner, schema = keeping(docs, keep)
    schema += "_score double, _offending array<struct<begin:bigint,end:bigint,probability:double>>"
    return docs.select(*columns, F.col(text).alias("_text")).mapInArrow(run, schema).toDF(*keep, "score", "offending")


def offending(docs: DataFrame, model: Model | None, least: float = LEAST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, begin and end (bytes), sentence and probability of every sentence of that probability or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in kernels.blocks(batch.column(1)) if model else ():
                found = Sentences(data, at)
                p = _probabilities(found, model)
                rows, begin, end = _spans(found, p, least)
                doc = found.doc[rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(doc + lo)),
                        pa.array(begin - at[doc], pa.int64()),
                        pa.array(end - at[doc], pa.int64()),
                        pa.array([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(begin, end)], pa.string()),
                        pa.array(p[rows]),
                    ],
                    names=[doc_id, "begin", "end", "sentence", "probability"],
                )

    schema = f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, begin long, end long, sentence string, probability double"
    return docs.select(doc_id, text).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(*training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return score(spread(docs.select("doc_id", "text")), model).select(
        "doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"), "offending"
    )
