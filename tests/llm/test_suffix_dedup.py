import hashlib
import random

import numpy as np

from tidewright.llm import suffix_dedup

SCHEMA = "doc_id long, text string, kept_text string"


def brute(rows, length=100):
    """What the contract says, a string at a time."""
    number = lambda d: 2**63 if d is None else d
    seen = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            k = b[i : i + length]
            seen[k] = min(seen.get(k, (2**64, 0)), (number(d), i))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] < (number(d), i):
                gone[i : i + length] = True
        spans = sum(bool(gone[i]) and (i == 0 or not gone[i - 1]) for i in range(len(b)))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows(seed):
    rng = random.Random(seed)
    words = ["the", "and", "schön", "à", "ñu", "tion", "erth", "moon", "x", "lo"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [text(60) for _ in range(3)]
    out = []
    for d in range(60):
        t = text(rng.randint(0, 120))
        if rng.random() < 0.5:
            t = t[: len(t) // 2] + rng.choice(shared)[rng.randint(0, 40) :] + t[len(t) // 2 :]
        if out and rng.random() < 0.15:
            t = rng.choice(out)[1]
        out.append((d, t))
    out += [(60, "ab" * 300), (61, None), (62, ""), (None, out[5][1]), out[3], (3, "more " + out[7][1])]
    rng.shuffle(out)
    return out


def test_matches_brute_force(spark):
    for seed in (1, 2):
        given = rows(seed)
        df = spark.createDataFrame([(d, t, "clash") for d, t in given], SCHEMA).repartition(3)
        got = sorted((tuple(r) for r in suffix_dedup.dedup(df).collect()), key=str)
        assert got == brute(given)


def test_keeps_columns_and_text(spark):
    line = "a passage that is long enough to be found again, as it has over one hundred bytes, which is what it takes to go. "
    df = spark.createDataFrame([(1, line, "x"), (2, "head " + line + "tail", "y")], SCHEMA)
    found = {r["doc_id"]: r for r in suffix_dedup.dedup(df, keep=("doc_id",), with_text=True).collect()}
    assert found[1]["kept_text"] == line
    assert found[2]["kept_text"] == "head tail" and found[2]["n_spans"] == 1


def test_empty_table(spark):
    assert suffix_dedup.dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_equal_strings_sample_the_same_suffix():
    rng = np.random.default_rng(1)
    shared = rng.integers(97, 101, 400).astype(np.uint8)
    texts = [np.concatenate([rng.integers(97, 101, n).astype(np.uint8), shared, rng.integers(97, 101, 50).astype(np.uint8)]) for n in (0, 7, 333)]
    shifts = []
    for n, t in zip((0, 7, 333), texts):
        valid = np.arange(len(t)) <= len(t) - 100
        at = suffix_dedup.sampled(t, valid, 100)
        shifts.append((at - np.arange(len(t)))[n : n + 301])
        assert ((at >= np.arange(len(t))) & (at <= np.arange(len(t)) + 68))[valid].all()
    assert (shifts[0] == shifts[1]).all() and (shifts[0] == shifts[2]).all()
