"""run() on the small documents, with the rows of each stage held against a plain version of it."""

import math
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest

from tests.llm.test_near_dup import brute as groups
from tidewright.llm import language_id, mixing, packing


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0d]+", text or ""))


def without_repeats(rows, length=100):
    """The text of each doc_id without the strings of so many bytes that start earlier."""
    seen, out = {}, {}
    for d, t in sorted(rows):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen.setdefault(b[i : i + length], (d, i)) < (d, i):
                gone[i : i + length] = True
        out[d] = bytes(x for x, g in zip(b, gone) if not g)
    return out


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """What each stage of run() was given, and what came out at the end."""
    seen, patch = [], pytest.MonkeyPatch()
    watched = [(name, lambda s, docs, d, f=f: (seen.append(docs.toPandas()), f(s, docs, d))[1]) for name, f in corpus_pipeline.STAGES]
    patch.setattr(corpus_pipeline, "STAGES", watched)
    seen.append(corpus_pipeline.run(spark, sf_dir).toPandas())
    patch.undo()
    return seen


def test_language(spark, sf_dir, stages):
    docs, kept = stages[:2]
    scores = {r["doc_id"]: r["score"] for r in language_id.query(spark, sf_dir).collect()}
    lettered = {d for d, t in zip(docs["doc_id"], docs["text"]) if any(c.isalpha() for c in t or "")}
    want = {d for d in lettered if scores[d] >= 0.4}
    assert sorted(kept["doc_id"]) == sorted(want)
    assert want == lettered  # the threshold rejects no document that has a letter
    assert kept.merge(docs, on=list(docs.columns)).shape == kept.shape


def test_near_duplicates(stages):
    docs, kept = stages[1:3]
    want = {d for d, _, _, first in groups(list(zip(docs["doc_id"].tolist(), docs["text"])), 5) if first}
    assert sorted(kept["doc_id"]) == sorted(want)
    assert kept.merge(docs, on=list(docs.columns)).shape == kept.shape


def test_repeated_passages(stages):
    docs, kept = stages[2:4]
    want = without_repeats(list(zip(docs["doc_id"].tolist(), docs["text"])))
    assert {d: t.encode() for d, t in zip(kept["doc_id"], kept["text"])} == want and len(kept) == len(docs)
    assert (kept["n_chars"] == kept["text"].str.len()).all()


def test_mixture(stages):
    docs, taken = stages[3:5]
    size = {d: n_words(t) for d, t in zip(docs["doc_id"], docs["text"])}
    copies = Counter(taken["doc_id"].tolist())
    names = sorted(docs["source"].unique(), key=str.encode)
    of = {s: docs.loc[docs["source"] == s, "doc_id"].tolist() for s in names}
    totals = [sum(size[d] for d in of[s]) for s in names]
    for s, total, target in zip(names, totals, mixing.targets(totals)):
        assert abs(sum(copies[d] * size[d] for d in of[s]) - target) <= max(size[d] for d in of[s])
        rate = target / total
        assert all(math.floor(rate) <= copies[d] <= math.ceil(rate) for d in of[s] if size[d])
    assert len(taken.drop_duplicates()) == len(copies) and taken.drop_duplicates().merge(docs, on=list(docs.columns)).shape[0] == len(copies)


def test_batches(stages):
    docs, packed = stages[4:]
    assert Counter(zip(packed["doc_id"], packed["n_tokens"])) == Counter((d, n_words(t)) for d, t in zip(docs["doc_id"], docs["text"]))
    bounds = sorted(set(packed["bucket_length"]))
    assert len(bounds) <= packing.BUCKETS
    assert all(b == min(x for x in bounds if x >= n) and p == b - n for b, n, p in zip(packed["bucket_length"], packed["n_tokens"], packed["padding"]))
    for bound, rows in packed.groupby("bucket_length"):
        fits = max(1, packing.TOKEN_BUDGET // max(bound, 1))
        assert sorted(zip(rows["batch"], rows["slot"])) == [divmod(k, fits) for k in range(len(rows))]
