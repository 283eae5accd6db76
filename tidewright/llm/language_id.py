"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read the bytes of a text, one forwards and one backwards; at every position their states together
give a softmax over the languages. A document's probabilities are the mean over all positions of its whole text.
The network is trained in numpy by backpropagation through time, every position of a window having its document's label.

A text of up to SEGMENT bytes is read in one go. A longer one is read in segments that go side by side; each begins WARM bytes
before its first position (and, backwards, after its last), so a state always has seen that much or the text's border. What a
position is labelled depends on its text alone, not on the texts read along with it.

It is fitted on the driver on a bounded sample: about SAMPLE_DOCS whole documents a language, picked by a hash of the id; each
step of the training reads windows of WINDOW bytes of them, wherever they fall. Everything is seeded, so the same rows give the
same network. Prediction reads whole texts.

Defined cases: a null text, or one without a letter, is `und` with score 0.0; without usable labels every row is; rows of a
null id or language teach nothing; repeated rows are predicted alike; columns of any other name are left as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm import kernels
from tidewright.llm.common import held_out, keeping, spread

SAMPLE_DOCS = 400
WINDOW, HIDDEN = 32, 12
STEPS, BATCH, RATE = 160, 256, 0.02
#: Bytes of a segment, and bytes read before and after it.
SEGMENT, WARM = 384, 32
#: Segments that go through the network together, and their bytes.
LANES, LANE_BYTES = 1024, 1 << 19
UNKNOWN = "und"
#: The pooled score from which the pipeline takes a document's language for known.
LEAST_SCORE = 0.4
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Network:
    languages: list[str]
    weights: dict[str, np.ndarray] = field(default_factory=dict)


def _start(n: int, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    out = {"out": rng.normal(0, 0.2, (2 * HIDDEN, n)), "bias": np.zeros(n)}
    for way in ("f", "b"):
        out[f"table_{way}"] = rng.normal(0, 0.3, (256, 3 * HIDDEN))
        out[f"state_{way}"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 3 * HIDDEN))
    return {k: v.astype(np.float32) for k, v in out.items()}


def _run(table: np.ndarray, state: np.ndarray, steps: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (time, lane, HIDDEN) over the bytes of each step (time, lane); keep gets what the way back needs."""
    h = np.zeros((steps.shape[1], HIDDEN), np.float32)
    out = np.empty((*steps.shape, HIDDEN), np.float32)
    for t in range(len(steps)):
        x, g = table[steps[t]], h @ state
        gates = x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN]
        np.negative(gates, out=gates)
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        z, r, u = gates[:, :HIDDEN], gates[:, HIDDEN:], g[:, 2 * HIDDEN :]
        n = np.tanh(x[:, 2 * HIDDEN :] + r * u)
        if keep is not None:
            keep.append((h, z, r, n, u))
        h = n + z * (h - n)
        out[t] = h
    return out


def _back(state: np.ndarray, steps: np.ndarray, kept: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of table and state, given those of the states."""
    d_table, d_state = np.zeros((256, 3 * HIDDEN), np.float32), np.zeros_like(state)
    d_h = np.zeros_like(d_out[0])
    d_x = np.empty((*steps.shape, 3 * HIDDEN), np.float32)
    for t in range(len(steps) - 1, -1, -1):
        h, z, r, n, u = kept[t]
        d_h = d_h + d_out[t]
        d_n = d_h * (1 - z) * (1 - n * n)
        d_g = np.concatenate([d_h * (h - n) * z * (1 - z), d_n * u * r * (1 - r), d_n * r], axis=1)
        d_state += h.T @ d_g
        d_x[t] = d_g
        d_x[t, :, 2 * HIDDEN :] = d_n
        d_h = d_h * z + d_g @ state.T
    flat = steps.ravel()
    order = np.argsort(flat, kind="stable")
    begins = np.flatnonzero(np.diff(flat[order], prepend=-1))
    d_table[flat[order][begins]] = np.add.reduceat(d_x.reshape(-1, 3 * HIDDEN)[order], begins)
    return d_table, d_state


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def fit(texts: list[str], languages: list[str], steps: int = STEPS, seed: int = 3) -> Network | None:
    """The network that these texts and their languages teach."""
    names = sorted(set(languages))
    if not names:
        return None
    label = np.array([names.index(x) for x in languages])
    data, at = kernels.text_buffers(pa.array(texts, pa.string()))
    data, size = kernels._LOWER[data], np.diff(at)
    w = _start(len(names), seed)
    by_name = [np.flatnonzero((label == k) & (size > 0)) for k in range(len(names))]
    by_name = [x for x in by_name if len(x)]
    if not by_name:
        return Network(names, w)
    rng = np.random.default_rng(seed)
    first, second = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    for turn in range(1, steps + 1):
        rows = np.concatenate([rng.choice(x, -(-BATCH // len(by_name))) for x in by_name])
        begin = (rng.random(len(rows)) * (np.maximum(size[rows] - WINDOW, 0) + 1)).astype(np.int64)
        place = begin + np.arange(WINDOW)[:, None]
        real = place < size[rows]
        x, y = np.where(real, data[np.minimum(at[rows] + place, len(data) - 1)], 32).astype(np.int64), label[rows]
        kept_f: list = []
        kept_b: list = []
        both = np.concatenate([_run(w["table_f"], w["state_f"], x, kept_f), _run(w["table_b"], w["state_b"], x[::-1], kept_b)[::-1]], axis=2)
        d = _softmax(both @ w["out"] + w["bias"])
        d[:, np.arange(len(y)), y] -= 1
        d *= (real / real.sum())[:, :, None].astype(np.float32)
        grad = {"out": np.tensordot(both, d, ((0, 1), (0, 1))), "bias": d.sum(axis=(0, 1))}
        d_both = d @ w["out"].T
        grad["table_f"], grad["state_f"] = _back(w["state_f"], x, kept_f, d_both[:, :, :HIDDEN])
        grad["table_b"], grad["state_b"] = _back(w["state_b"], x[::-1], kept_b, d_both[::-1, :, HIDDEN:])
        rate = RATE * min(1.0, 2 * (1 - turn / (steps + 1)))
        for k, g in grad.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            w[k] = (w[k] - rate * (first[k] / (1 - 0.9**turn)) / (np.sqrt(second[k] / (1 - 0.99**turn)) + 1e-8)).astype(np.float32)
    return Network(names, w)


def position_labels(network: Network, text: str) -> list[str]:
    """The language of every byte of a text."""
    data, at = kernels.text_buffers(pa.array([text], pa.string()))
    found = np.zeros(len(data), np.int64)
    for segments, p in _segment_scores(network.weights, data, at):
        for k, (begin, skip, size) in enumerate(zip(segments.begin + segments.skip, segments.skip, segments.size)):
            found[begin : begin + size] = p[skip : skip + size, :, k].argmax(axis=1)
    return [network.languages[k] for k in found]


@dataclass
class Segments:
    """Pieces of texts: row, first byte read, bytes read, bytes read before the piece, and bytes of the piece."""

    doc: np.ndarray
    begin: np.ndarray
    read: np.ndarray
    skip: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, at: np.ndarray) -> Segments:
        count = -(-np.diff(at) // SEGMENT)
        doc = np.repeat(np.arange(len(count)), count)
        first = at[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * SEGMENT
        last = np.minimum(first + SEGMENT, at[doc + 1])
        begin, end = np.maximum(first - WARM, at[doc]), np.minimum(last + WARM, at[doc + 1])
        return cls(doc, begin, end - begin, first - begin, last - first)

    def take(self, rows: np.ndarray) -> Segments:
        return Segments(self.doc[rows], self.begin[rows], self.read[rows], self.skip[rows], self.size[rows])


def _segment_scores(w: dict[str, np.ndarray], data: np.ndarray, at: np.ndarray) -> Iterator[tuple[Segments, np.ndarray]]:
    """The segments of texts, of like length together, with probabilities (time, language, segment) of all bytes read."""
    every = Segments.of(at)
    order = np.argsort(every.read, kind="stable")
    lo = 0
    while lo < len(order):
        hi = min(lo + LANES, len(order))
        while hi > lo + 1 and every.read[order[hi - 1]] * (hi - lo) > LANE_BYTES:
            hi = lo + max(1, (hi - lo) // 2)
        part = every.take(order[lo:hi])
        time = np.arange(part.read[-1])[:, None]
        real = time < part.read
        ahead = kernels._LOWER[data[np.minimum(part.begin + time, len(data) - 1)]].astype(np.int64)
        ahead[~real] = 32
        back = np.where(real, part.read - 1 - time, time)
        yield part, _positions(w, ahead, back)
        lo = hi


def _states(table: np.ndarray, state: np.ndarray, shown: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """What _run gives for each way (way, byte, gate; way, HIDDEN, gate), times shown (way, k, HIDDEN), as (time, way, k, lane).

    Long rows, so that the work on gates is on contiguous memory, both ways at once, and of the states only what is shown is
    kept, so that a step's work stays in the processor's cache.
    """
    table, state = np.ascontiguousarray(table.transpose(0, 2, 1)), np.ascontiguousarray(state.transpose(0, 2, 1))
    ways, lanes = len(table), steps[0].shape[1]
    out = np.empty((len(steps[0]), ways, shown.shape[1], lanes), np.float32)
    h = np.zeros((ways, HIDDEN, lanes), np.float32)
    x, g = (np.empty((ways, 3 * HIDDEN, lanes), np.float32) for _ in range(2))
    gates, n, u = x[:, : 2 * HIDDEN], x[:, 2 * HIDDEN :], g[:, 2 * HIDDEN :]
    for t in range(len(out)):
        for way, bytes_ in enumerate(steps):
            np.take(table[way], bytes_[t], axis=1, out=x[way], mode="clip")
        np.matmul(state, h, out=g)
        gates += g[:, : 2 * HIDDEN]
        np.negative(gates, out=gates)
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        u *= gates[:, HIDDEN:]
        n += u
        np.tanh(n, out=n)
        h -= n
        h *= gates[:, :HIDDEN]
        h += n
        np.matmul(shown, h, out=out[t])
    return out


def _positions(w: dict[str, np.ndarray], steps: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Probabilities (time, language, lane) over bytes (time, lane); back: the place that each lane reads at a time, backwards."""
    table, state = (np.stack([w[f"{name}_f"], w[f"{name}_b"]]) for name in ("table", "state"))
    shown = np.ascontiguousarray(w["out"].reshape(2, HIDDEN, -1).transpose(0, 2, 1))
    both = _states(table, state, shown, [steps, np.take_along_axis(steps, back, 0)])
    scores = both[:, 0] + np.take_along_axis(both[:, 1], back[:, None, :], 0)
    scores += w["bias"][:, None]
    np.exp(np.clip(scores, -30, 30, out=scores), out=scores)
    scores /= scores.sum(axis=1, keepdims=True)
    return scores


def pooled(network: Network, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Mean probabilities (row, language) of the texts; 0 for empty ones."""
    total = np.zeros((len(at) - 1, len(network.languages)))
    for part, p in _segment_scores(network.weights, data, at):
        time = np.arange(len(p))[:, None]
        p *= ((time >= part.skip) & (time < part.skip + part.size))[:, None, :]
        np.add.at(total, part.doc, p.sum(axis=0, dtype=np.float64).T)
    return total / np.maximum(np.diff(at), 1)[:, None]


def training_rows(docs: DataFrame, most: int = SAMPLE_DOCS) -> tuple[list[str], list[str]]:
    """Whole texts and languages of about so many documents of each language that are not held out, by a hash of the id."""
    known = docs.select("doc_id", "text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return [], []
    order = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, int(min(1.0, most / n) * (1 << 30)))])
    rows = known.filter(order < share[F.col("lang")]).toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending"), ("text", "ascending")])
    return rows.column("text").to_pylist(), rows.column("lang").to_pylist()


def _predicted(docs: DataFrame, network: Network | None, keep: tuple[str, ...], text: str) -> DataFrame:
    """The columns of keep as _keep_0 and so on, _lang and _score of every row."""
    columns, inner, schema = keeping(docs, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            for lo, hi, data, at in kernels.blocks(batch.column(len(keep))) if network else ():
                p = pooled(network, data, at)
                best = p.argmax(axis=1)
                view = memoryview(data)
                for k in range(hi - lo):
                    known = _lettered(view[at[k] : at[k + 1]])
                    names.append(network.languages[best[k]] if known else UNKNOWN)
                    scores.append(min(1.0, float(p[k, best[k]])) if known else 0.0)
            if not network:
                names, scores = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*inner, "_lang", "_score"]
            )

    return docs.select(*columns, F.col(text).alias("_text")).mapInArrow(run, schema + "_lang string, _score double")


def predict(docs: DataFrame, network: Network | None, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns of keep (one at least), lang_pred and score of every row."""
    return _predicted(docs, network, keep, text).toDF(*keep, "lang_pred", "score")


def _lettered(text: memoryview) -> bool:
    """Whether a text holds a letter; most show one in their first bytes, so those are looked at before the whole."""
    return any(_LETTER.search(bytes(part).decode("utf-8", "ignore")) for part in (text[:64], text))


def accepted(docs: DataFrame, sf_dir: str, least: float = LEAST_SCORE) -> DataFrame:
    """The documents, with all their columns, whose language is known with that score or more.

    The network learns from the documents table. Documents without a letter go; `rejected` counts what else does.
    """
    return _judged(docs, sf_dir).filter((F.col("_lang") != UNKNOWN) & (F.col("_score") >= least)).drop("_lang", "_score").toDF(*docs.columns)


def rejected(docs: DataFrame, sf_dir: str, least: float = LEAST_SCORE) -> DataFrame:
    """Per predicted language, how many documents `accepted` does not take, and their mean score."""
    lost = _judged(docs, sf_dir).filter((F.col("_lang") == UNKNOWN) | (F.col("_score") < least))
    return lost.groupBy(F.col("_lang").alias("lang_pred")).agg(F.count("*").alias("n"), F.avg("_score").alias("score"))


def _judged(docs: DataFrame, sf_dir: str) -> DataFrame:
    network = fit(*training_rows(docs.sparkSession.read.parquet(f"{sf_dir}/documents.parquet")))
    return _predicted(docs, network, tuple(docs.columns), "text")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(spread(docs.select("doc_id", "text")), fit(*training_rows(docs))).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
