import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidewright.llm import kernels, language_id, toxicity

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ei", "ung", "ver"], "cc": ["ção", "nho", "lha", "qué"]}


def word(rng, lang):
    return "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3)))


def text(rng, lang, n):
    return " ".join(word(rng, lang) for _ in range(n))


def held(k):
    return zlib.crc32(str(k).encode()) % 4 == 2


# ---------------------------------------------------------------- language


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    w = language_id._start(3, 2)
    x = rng.integers(97, 110, (6, 5))
    y = rng.integers(0, 3, 5)

    def loss():
        both = np.concatenate([language_id._run(w["table_f"], w["state_f"], x), language_id._run(w["table_b"], w["state_b"], x[::-1])[::-1]], axis=2)
        p = language_id._softmax((both @ w["out"] + w["bias"]).astype(np.float64))
        return -np.log(p[:, np.arange(5), y]).sum()

    kept = []
    ahead = language_id._run(w["table_f"], w["state_f"], x, kept)
    both = np.concatenate([ahead, language_id._run(w["table_b"], w["state_b"], x[::-1])[::-1]], axis=2)
    d = language_id._softmax(both @ w["out"] + w["bias"])
    d[:, np.arange(5), y] -= 1
    table, state = language_id._back(w["state_f"], x, kept, (d @ w["out"].T)[:, :, : language_id.HIDDEN])
    for name, grad in (("table_f", table), ("state_f", state)):
        for at in [(int(x[0, 0]) if name == "table_f" else 1, 3), (int(x[2, 1]) if name == "table_f" else 4, 30)]:
            old = w[name][at]
            w[name][at] = old + 1e-2
            up = loss()
            w[name][at] = old - 1e-2
            down = loss()
            w[name][at] = old
            assert grad[at] == pytest.approx((up - down) / 2e-2, rel=0.05, abs=0.02)


def test_both_layouts_give_the_same_states():
    w = language_id._start(3, 2)
    x = np.random.default_rng(3).integers(0, 256, (9, 7))
    y = np.random.default_rng(4).integers(0, 256, (9, 7))
    both = language_id._states(np.stack([w["table_f"], w["table_b"]]), np.stack([w["state_f"], w["state_b"]]), np.stack([np.eye(language_id.HIDDEN, dtype=np.float32)] * 2), [x, y])
    for way, (name, steps) in enumerate((("f", x), ("b", y))):
        assert np.allclose(language_id._run(w[f"table_{name}"], w[f"state_{name}"], steps), both[:, way].transpose(0, 2, 1), atol=1e-5)


def loop_probabilities(w, raw):
    """The network a position and a number at a time: probabilities of the languages at each byte."""
    low = [b + 32 if 65 <= b <= 90 else b for b in raw]
    sigmoid = lambda x: 1 / (1 + math.exp(-x))

    def states(way, sequence):
        n = language_id.HIDDEN
        table, state, h, out = w[f"table_{way}"].tolist(), w[f"state_{way}"].tolist(), [0.0] * n, []
        for b in sequence:
            x, g = table[b], [sum(h[i] * state[i][j] for i in range(n)) for j in range(3 * n)]
            z, r = ([sigmoid(x[k] + g[k]) for k in range(a, a + n)] for a in (0, n))
            new = [math.tanh(x[2 * n + k] + r[k] * g[2 * n + k]) for k in range(n)]
            h = [(1 - z[k]) * new[k] + z[k] * h[k] for k in range(n)]
            out.append(h)
        return out

    both = [a + b for a, b in zip(states("f", low), states("b", low[::-1])[::-1])]
    out = []
    for h in both:
        scores = [math.exp(sum(x * w["out"][i][k] for i, x in enumerate(h)) + w["bias"][k]) for k in range(len(w["bias"]))]
        out.append([s / sum(scores) for s in scores])
    return out


def test_pooled_against_a_loop(monkeypatch):
    rng = random.Random(5)
    network = language_id.Network(["aa", "bb", "cc"], language_id._start(3, 4))
    texts = ["", "K", "Ab é", text(rng, "bb", 9), text(rng, "cc", 40)]
    data, at = kernels.text_buffers(pa.array(texts, pa.string()))
    found = language_id.pooled(network, data, at)
    for row, t in zip(found, texts):
        p = loop_probabilities(network.weights, t.encode())
        assert np.allclose(row, np.mean(p, axis=0) if p else 0, atol=1e-5)
        assert language_id.position_labels(network, t) == [network.languages[int(np.argmax(x))] for x in p]
    monkeypatch.setattr(language_id, "SEGMENT", 16)  # a long text in segments: near to what it is in one go
    assert np.allclose(language_id.pooled(network, data, at), found, atol=1e-3)


def test_alone_and_together_are_the_same():
    rng = random.Random(6)
    network = language_id.Network(["aa", "bb"], language_id._start(2, 4))
    texts = [text(rng, "aa", n) for n in (1, 3, 50, 400, 2000)]
    data, at = kernels.text_buffers(pa.array(texts, pa.string()))
    together = language_id.pooled(network, data, at)
    for row, t in zip(together, texts):
        assert np.allclose(row, language_id.pooled(network, *kernels.text_buffers(pa.array([t], pa.string())))[0], atol=1e-6)


def test_stage_keeps_columns_of_any_name(spark, tmp_path):
    rng = random.Random(7)
    rows = [(k, text(rng, lang := rng.choice(["aa", "bb"]), 30), lang, 0.5, "zz", "_x") for k in range(80)] + [(90, "12", "aa", 0.5, "zz", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string, _score string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = language_id.accepted(docs, str(tmp_path))
    assert kept.columns == docs.columns and sorted(kept.collect()) == sorted(docs.filter("doc_id < 90").collect())
    assert [(r["lang_pred"], r["n"]) for r in language_id.rejected(docs, str(tmp_path)).collect()] == [("und", 1)]


def test_languages(spark):
    rng = random.Random(1)
    rows = [(k, text(rng, lang := rng.choice(list(SYLLABLES)), rng.randint(3, 60)), lang, "x") for k in range(600)]
    rows += [(1001, None, "aa", "x"), (1002, "", "aa", "x"), (1003, "123 !?", "aa", "x"), (None, text(rng, "bb", 30), "bb", "x"), (1004, text(rng, "cc", 20000), None, "x"), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    network = language_id.fit(*language_id.training_rows(docs))
    got = language_id.predict(docs, network).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    assert all(by[k]["lang_pred"] == "und" and by[k]["score"] == 0 for k in (1001, 1002, 1003))
    assert by[None]["lang_pred"] == "bb" and by[1004]["lang_pred"] == "cc"
    test = [(r[2], by[r[0]]["lang_pred"]) for r in rows[:600] if held(r[0])]
    assert sum(a == b for a, b in test) / len(test) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)
    assert set(language_id.position_labels(network, text(rng, "cc", 30))) <= set(SYLLABLES)


def test_languages_without_rows(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert language_id.training_rows(docs) == ([], [])
    got = language_id.predict(docs, language_id.fit([], [])).collect()
    assert got[0]["lang_pred"] == "und"
    assert language_id.predict(docs.limit(0), None).count() == 0


# ---------------------------------------------------------------- toxicity


def test_toxicity(spark):
    rng = random.Random(2)
    bad = ["grunklet", "vexomar", "zorbid"]
    rows, labels = [], []
    for k in range(900):
        words = text(rng, rng.choice(["aa", "bb"]), rng.randint(1, 150)).split()
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randint(0, len(words)), rng.choice(bad) + rng.choice(["", "s", "ing"]))
        for j in range(9, len(words), 10):
            words[j] += "."
        rows.append((k, " ".join(words), "x"))
        labels.append((k, int(toxic), 1))
    rows += [(2001, None, "x"), (2002, "", "x"), (2003, text(rng, "aa", 30000), "x"), (None, "ka lo grunklet", "x"), rows[0]]
    labels += [(2001, None, 1), (None, 1, 1), labels[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    model = toxicity.fit(*toxicity.training_rows(docs, marks))
    got = toxicity.score(docs, model).collect()
    by = {r["doc_id"]: r["score"] for r in got}
    assert len(got) == len(rows)
    test = [(y, by[k] >= 0.3) for k, y, _ in labels[:900] if held(k)]
    assert sum(y == p for y, p in test) / len(test) > 0.97
    assert by[2001] < 0.3 and by[2002] < 0.3 and by[2003] < 0.3 and by[None] >= 0.3
    spots = toxicity.offending(docs, model).collect()
    assert spots and all(any(b in r["sentence"] for b in bad) for r in spots)
    texts = dict((r[0], r[1]) for r in rows)
    assert all(texts[r["doc_id"]].encode()[r["begin"] : r["end"]].decode() == r["sentence"] for r in spots)


def test_scores_against_plain_sentences(spark):
    rng = random.Random(9)
    vocabulary = [word(rng, "aa") for _ in range(60)] + ["Zorbid", "zorbids", "à", "x1"]
    texts = ["", "...", "one", " ".join(rng.choices(vocabulary, k=130)), "Zorbid zorbid! x1.\nà Zorbids"] + [
        "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", ". ", "\n", "? "]) for _ in range(50)) for _ in range(20)
    ]
    model = toxicity.Model(np.zeros(toxicity.WIDTH + 1, np.float32), -4.0, 0.01)

    def slots(w):
        b = w.encode().lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w).encode()
        out = []
        for kind in toxicity.KINDS:
            if len(b) >= kind:
                one = b[:kind] if kind else b
                print_ = kernels.Words(np.frombuffer(one, np.uint8), np.array([0, len(one)]), alphabet=kernels.IN_NAME).hash
                out.append(int(kernels.mix(print_ + np.uint64(kind))[0] >> np.uint64(46)))
        return out

    for w in vocabulary[-4:] + vocabulary[:9]:
        model.weights[slots(w)] = rng.random() * 3
    want = {}
    for k, t in enumerate(texts):
        sentences, run = [], []
        for piece in re.findall(r"[A-Za-z0-9\u0080-\uffff]+|[.!?\n]", t):
            if piece in ".!?\n" or len(run) == toxicity.SENTENCE_WORDS:
                sentences.append(run)
                run = []
            if piece not in ".!?\n":
                run.append(piece)
        evidence = [sum(float(model.weights[s]) for w in run for s in slots(w)) for run in [*sentences, run]]
        p = [1 - (1 + math.exp(model.bias)) / (1 + math.exp(model.bias + x)) for x in evidence]
        want[k] = (1 - (1 - model.leak) * math.prod(1 - x for x in p), sorted(x for x in p if x >= toxicity.LEAST))
    docs = spark.createDataFrame([(k, t, 0.5, "z") for k, t in enumerate(texts)], "doc_id long, text string, score double, offending string")
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(texts) and any(w[1] for w in want.values())
    for r in got:
        score, spots = want[r["doc_id"]]
        assert r["score"] == pytest.approx(score, abs=1e-6)
        assert sorted(s["probability"] for s in r["offending"]) == pytest.approx(spots, abs=1e-6)
    assert len(toxicity.score(docs, model, keep=("doc_id", "score", "offending")).first()) == 5


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, source string")
    marks = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(*toxicity.training_rows(docs, marks))
    assert model is None and toxicity.score(docs, model).first()["score"] == 0
    assert toxicity.fit(["a", "b"], np.array([0, 0])).leak < 0.3
    assert toxicity.score(docs.limit(0), None).count() == 0
