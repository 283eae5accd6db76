import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewright import schema
from tidewright.functions import grammar, tampers, text
from tidewright.operators import augment, dedup, gate, jobs, leakage, metrics, probes, profile, ranking, requests, rules, splits, tokenization
from tidewright.sources import files, readers, sinks


def one(spark, column, **values):
    names = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'long'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first()["x"]


# ---------------------------------------------------------------- requests


def test_build_raw(spark):
    h = F.create_map(F.lit("Host"), F.lit("example.com"))
    get = one(spark, requests.build_raw(F.lit("GET"), F.lit("/api/users"), F.lit("id=1"), h, F.lit("")), a=1)
    assert get == "GET /api/users?id=1 HTTP/1.1\r\nHost: example.com\r\n"
    post = one(spark, requests.build_raw(F.lit("POST"), F.lit("/login"), F.lit(""), h, F.lit("u=1")), a=1)
    assert post == "POST /login HTTP/1.1\r\nHost: example.com\r\n\r\nu=1"


def test_parse(spark):
    raw = "post http://h/p;x=1?a=b#f HTTP/1.1\r\nA: 1\r\nB:2:3\r\nA: 9\r\nbad\r\n\r\nline\r\n\r\nlast"
    p = one(spark, requests.parsed("r"), r=raw)
    assert (p["method"], p["path"], p["query_string"], p["body"]) == ("POST", "/p", "a=b", "line\n\nlast")
    assert p["headers"] == {"A": "9", "B": "2:3"} and list(p["headers"]) == ["A", "B"]
    assert one(spark, requests.parsed("r"), r="nonsense")["method"] == "GET"
    assert one(spark, requests.parsed("r"), r=None)["path"] == "/"


def test_normalise(spark):
    rows = [(" get ", None, "a=1", "{bad", " b ", None, "7", "SQL Injection", "s"), ("GET", "/x", None, None, None, "raw", "1", "normal", "s"), (None, None, None, None, None, None, None, None, None)]
    out = requests.normalise(spark.createDataFrame(rows, "method string, path string, query_string string, headers string, body string, raw string, label string, attack_class string, source string"))
    got = out.orderBy("raw").collect()
    assert out.columns == schema.COLUMNS and len(got) == 3
    by = {r["raw"]: r for r in got}
    assert by["raw"]["label"] == 0 and by["raw"]["attack_class"] == "benign"
    assert by["GET /?a=1 HTTP/1.1\r\n\r\nb"]["attack_class"] == "sqli"
    assert out.filter("id IS NULL OR source IS NULL").count() == 0


def test_adapters(spark):
    wide = spark.createDataFrame([("post", "http://h/a?b=c", "x=1", "Cookie: s=1", "12", "Anomalous")], "Method string, URL string, content string, cookie string, lenght string, classification string")
    r = requests.adapt_request_table(wide, "csic").first()
    assert (r["method"], r["path"], r["query_string"], r["label"]) == ("POST", "/a", "b=c", 1) and '"Cookie":"s=1"' in r["headers"] and '"Content-Length":"12"' in r["headers"]
    line = spark.createDataFrame([("Method: GET Host: /p?q=1 User-Agent: a b Body: z", "242 - SQL Injection", "1"), (" ", "", "0")], "text string, category string, label string")
    got = requests.adapt_line_table(line, "srbh").collect()
    assert len(got) == 1 and (got[0]["path"], got[0]["query_string"], got[0]["body"], got[0]["attack_class"]) == ("/p", "q=1", "z", "sqli")
    bare = spark.createDataFrame([("<x>", "xxe", "anom"), ("", "sqli", "anom")], "payload string, type string, label string")
    got = requests.adapt_payload_table(bare, "params").collect()
    assert len(got) == 1 and got[0]["method"] == "POST" and got[0]["body"] == "data=<x>"
    with pytest.raises(ValueError):
        requests.adapt_payload_table(spark.createDataFrame([(1,)], "label int"), "x")


def test_text_helpers(spark):
    assert one(spark, text.byte_entropy("t"), t="aabb") == pytest.approx(1.0)
    assert one(spark, text.byte_entropy("t"), t="") == 0
    assert one(spark, text.last_index(F.col("t"), "<"), t="a<b<c") == 3 and one(spark, text.last_index(F.col("t"), "<"), t="abc") == -1
    assert one(spark, text.quote("t"), t="a b~*/é") == "a%20b~%2A%2F%C3%A9"
    assert one(spark, text.tokens("t"), t="GET /a?b=C") == ["get", "a", "b", "c"]


# ---------------------------------------------------------------- rules and gate


def test_rules(spark):
    rows = [(1, "GET /?q=1 UNION SELECT a"), (2, "GET /index"), (3, None), (4, "x http://localhost/a.php http://evil.example/b.php"), (5, "{{a\r\nb}}")]
    out = {r["id"]: r for r in rules.crs_scores(spark.createDataFrame(rows, "id int, raw string")).collect()}
    assert out[1]["score_pl1"] == 5 and out[1]["pred_pl1"] == 1 and 942100 in out[1]["matched_rules"]
    assert out[2]["score_pl4"] == 0 and out[3]["score_pl4"] == 0
    assert 931100 in out[4]["matched_rules"]
    assert out[5]["score_pl1"] == 0
    assert len(rules.active(1)) == 8 and len(rules.RULES) == 19 and len(rules.SIGNATURES) == 41


@pytest.mark.parametrize(
    "cls, payload, ok",
    [
        ("sqli", "1 or (1=1)", True), ("sqli", "or (1=1", False), ("sqli", "hello", False), ("xss", "<img src=x>", True), ("xss", "<img src=x", False), ("xxe", "<!DOCTYPE a [<!ENTITY b>]>", True),
        ("xxe", "<!DOCTYPE a>", False), ("lfi", "../x", True), ("cmdi", "a", False), ("cmdi", "a;b", True), ("ssti", "{{1}}", True), ("ssrf", "http://x", True), ("header_injection", "a%0d%0ab", True), ("other", "", True),
    ],
)
def test_validity(spark, cls, payload, ok):
    assert one(spark, gate.valid_for_class("c", "t"), c=cls, t=payload) is ok


def test_gate(spark):
    rows = [(1, "GET /a?x=1 HTTP/1.1", 0, "benign", "s"), (2, "GET", 0, "benign", "s"), (3, "FETCH /a HTTP/1.1", 0, "benign", "s"), (4, "GET /?q=union select 1 x", 0, "benign", "s"), (5, "GET /?q=union select 1 x", 0, "benign", "aug_edge"), (6, "GET /" + "a" * 9000, 0, "benign", "s")]
    df = spark.createDataFrame(rows, "id long, raw string, label int, attack_class string, source string").withColumns({"query_string": F.lit(""), "body": F.lit(None).cast("string")})
    got = {r["id"]: (r["verdict"], r["rejection_reason"], r["source"]) for r in gate.verdicts(df).collect()}
    assert got[1][0] == "passed" and got[2][1] == "format:too_short" and got[3][1] == "format:invalid_method" and got[6][1] == "format:too_long"
    assert got[4][0] == "quarantined" and got[5] == ("passed", None, "aug_edge_crs_flagged")
    q = spark.createDataFrame([("a",), ("b",), ("c",)], "id string").withColumns({"source": F.lit("s"), "label": F.lit(0).cast("byte")})
    out = gate.review(q, spark.createDataFrame([("a", "A"), ("b", "B"), ("x", "D"), ("c", "Z")], "id string, decision string"))
    assert out["restored"].first()["source"] == "s_reviewed_benign" and out["relabelled"].first()["label"] == 1
    assert out["bad"].count() == 1 and out["extra"].count() == 1 and out["missing"].count() == 0


# ---------------------------------------------------------------- dedup


def test_exact_and_greedy_dedup(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from here today "
    rows = [(0, base * 2, "GET"), (1, base * 2, "GET"), (2, base * 2 + "x", "GET"), (3, base * 2 + "y", "POST"), (4, None, "GET"), (5, "short", "GET")]
    df = spark.createDataFrame(rows, "ord long, raw string, method string")
    assert sorted(r["ord"] for r in dedup.exact_firsts(df).collect()) == [0, 2, 3, 4, 5]
    assert sorted(r["ord"] for r in dedup.greedy_firsts(df, group="method").collect()) == [0, 3, 4, 5]
    once = dedup.greedy_firsts(df)
    assert sorted(r["ord"] for r in once.collect()) == [0, 4, 5] and dedup.greedy_firsts(once).count() == 3
    held = spark.createDataFrame([(100, base * 2 + "z")], "ord long, raw string")
    assert sorted(r["ord"] for r in dedup.without_similar(df, held, "ord", "raw").collect()) == [4, 5]


def test_ties_of_exact_dedup(spark):
    rows = [(0, "A", "x"), (1, "A", "x"), (1, "B", "x"), (2, "C", "p"), (2, "C", "q"), (3, "D", "x"), (3, "D", "x"), (None, "A", "x"), (None, "E", "x")]
    got = dedup.exact_firsts(spark.createDataFrame(rows, "ord long, raw string, other string").repartition(3)).collect()
    assert sorted((r["ord"], r["raw"]) for r in got if r["ord"] is not None) == [(0, "A"), (1, "B"), (2, "C"), (3, "D")]
    assert [r["raw"] for r in got if r["ord"] is None] == ["E"]


def test_point_lookup(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from here today "
    df = spark.createDataFrame([(1, base), (2, base + "x"), (3, "another text"), (4, None)], "id long, raw string")
    assert sorted(r["id"] for r in dedup.similar_to(df, base).collect()) == [1, 2]


def test_greedy_order(spark):
    """b is like a and c, a and c are not alike: a stays, b goes, c stays."""
    rng = random.Random(1)
    words = [f"word{k}" for k in range(200)]
    a = [rng.choice(words) for _ in range(60)]
    b = a[6:] + [rng.choice(words) for _ in range(6)]
    c = b[8:] + [rng.choice(words) for _ in range(8)]
    df = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate((a, b, c))], "ord long, raw string")
    pairs = {(r["a"], r["b"]): r["similarity"] for r in dedup.similar_pairs(df, "ord", "raw", 0.6).collect()}
    limit = (max(pairs.get((0, 2), 0.6), 0.6) + min(pairs[0, 1], pairs[1, 2])) / 2
    assert sorted(r["ord"] for r in dedup.greedy_firsts(df, threshold=limit).collect()) == [0, 2]


def _alike_texts(rng, n, words=150):
    """Texts of one small vocabulary, so that unrelated ones are rather similar too; a fifth are near copies, some exact ones."""
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    texts = []
    for k in range(n):
        near = k % 5 == 4
        text = rng.choice(texts).split(" ") if near else [rng.choice(vocabulary) for _ in range(rng.randint(words // 2, 2 * words))]
        if near and k % 10 == 9:
            text = [*text[: len(text) // 2], "zz" + str(k), *text[len(text) // 2 + rng.randint(0, 6) :]]
        texts.append(" ".join(text))
    return texts


def test_similar_pairs_of_firsts(spark):
    """All pairs by brute force; copies, null keys and null groups as exact_firsts and then the pairs have them."""
    rng = random.Random(3)
    rows = [(k if k % 37 else None, t, rng.choice(["x", "x", "y", None])) for k, t in enumerate(_alike_texts(rng, 160), 1)]
    df = spark.createDataFrame(rows, "ord long, raw string, part string").repartition(3)
    first = {}
    for k, t, g in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(t, (k, g))
    firsts = [(k, g, {t[i : i + 3] for i in range(len(t) - 2)}) for t, (k, g) in first.items() if k is not None and g is not None]
    want = {(a, b): len(x & y) / len(x | y) for a, g, x in firsts for b, h, y in firsts if a < b and g == h and len(x & y) / len(x | y) >= 0.85}
    got = {(r["a"], r["b"]): r["similarity"] for r in dedup.similar_pairs(df, "ord", "raw", 0.85, group="part", firsts=True).collect()}
    assert got == want and len(want) > 3
    pairs = spark.createDataFrame([(*p, s) for p, s in got.items()], "a long, b long, similarity double")
    kept = sorted(r["ord"] for r in dedup.greedy_kept(dedup.exact_firsts(df), pairs, "ord").collect() if r["ord"] is not None)
    gone = set()
    for k in sorted(k for k, _, _ in firsts):
        if any(b == k and a not in gone for a, b in want):
            gone.add(k)
    assert kept == sorted(k for k, _ in first.values() if k is not None and k not in gone)


def test_sketches_drop_no_similar_pair():
    """Texts that share a band: few pairs that are not similar go on to whole sets, all similar ones do."""
    sets = [dedup._packed_grams(t) for t in _alike_texts(random.Random(5), 200)]
    assert all((dedup.unpacked_set(dedup.packed_set(s)) == s).all() for s in sets)
    sketch = np.frombuffer(b"".join(dedup.parity(dedup._spread(s)) for s in sets), np.uint64).reshape(-1, dedup.WORDS)
    size, row = np.array([len(s) for s in sets]), np.arange(len(sets))
    alike = {(a, b): (k := len(np.intersect1d(sets[a], sets[b]))) / (size[a] + size[b] - k) for a in row for b in row[a + 1 :]}
    for threshold in (0.7, 0.85):
        left = {(int(a), int(b)) for a, b in dedup.close_in_cell(size, sketch, row, np.zeros(len(row), np.int64), threshold)}
        similar = {p for p, s in alike.items() if s >= threshold}
        assert similar <= left and len(left - {p for p, s in alike.items() if s >= threshold - 0.15}) < len(alike) / 20
    x, y = np.array(sorted(alike)).T
    exact = dedup.exact_similarity(x, y, lambda k: dedup.packed_set(sets[k]))
    assert exact.tolist() == [alike[p] for p in sorted(alike)]


def test_pairs_of_a_cell_do_not_depend_on_its_order():
    sets = [dedup._packed_grams(x) for x in _alike_texts(random.Random(6), 60)]
    cell = pa.table({
        "id": list(range(60)), "size": [len(s) for s in sets], "sketch": pa.array([dedup.parity(dedup._spread(s)) for s in sets], pa.binary()),
        "bands": pa.array([[1]] * 60, pa.list_(pa.int64())),
    })
    for blocks in (1, 3):
        one, other = (dedup._met(0.7, blocks)(x) for x in (cell, cell.take(list(range(59, -1, -1)))))
        assert one.num_rows and one.equals(other)


def test_without_similar(spark):
    """Leaks by brute force, where many held-out rows are nearly similar; a text of two characters is not one with an end sign."""
    texts = [*_alike_texts(random.Random(8), 200), "ab", None, "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, raw string")
    held = [*list(enumerate(_alike_texts(random.Random(8), 150)[::3], 1000)), (2000, "ab\0"), (2001, "")]
    sets = lambda t: {t[i : i + 3] for i in range(max(1, len(t or "") - 2))} if t else {""}
    other = [sets(t) for _, t in held]
    want = [k for k, t in enumerate(texts) if not any(len(sets(t) & y) >= 0.7 * len(sets(t) | y) for y in other)]
    got = dedup.without_similar(df.repartition(3), spark.createDataFrame(held, "id long, raw string"))
    assert sorted(r["id"] for r in got.collect()) == want and 20 < len(want) < 180 and 200 in want and 201 not in want


def test_without_similar_loses_no_pair(spark):
    """Pairs of similarity 7/10 that share none of the bands of minima by which rows met held-out ones before."""
    whole = ["kimdhflbmifo", "elmbcgkckbbj", "ohgonoedidfc"]
    df = spark.createDataFrame([(k, t[:9]) for k, t in enumerate(whole)] + [(3, whole[0][:8])], "id long, raw string")
    held = spark.createDataFrame(list(enumerate(whole, 10)), "id long, raw string")
    assert [r["id"] for r in dedup.without_similar(df, held).collect()] == [3]


def test_without_similar_in_many_blocks(spark, monkeypatch):
    """The same rows stay whatever the blocks, a row is no leak of its own, and sides may be empty."""
    texts = _alike_texts(random.Random(8), 200)
    df = spark.createDataFrame(list(enumerate(texts)) + [(k, "copy of a row") for k in range(200, 230)], "id long, raw string")
    held = df.filter("id % 3 = 0")
    found = []
    for least in (1024, 8):
        monkeypatch.setattr(dedup, "LEAST_ROWS", least)
        monkeypatch.setattr(dedup, "PARTS", 40)
        found.append(sorted(r["id"] for r in dedup.without_similar(df, held).collect()))
        assert not dedup.without_similar(held, held, same_id=True).count()
    assert found[0] == found[1] and 20 < len(found[0]) < 180 and max(found[0]) < 200
    assert dedup.without_similar(df, held.limit(0)).count() == 230 and not dedup.without_similar(df.limit(0), held).count()


def test_have_similar_where_grams_share_columns():
    rng = np.random.default_rng(3)
    core = rng.choice(400, (6, 60)).astype(np.uint64)
    sets = [np.unique(np.concatenate([core[k % 6][: rng.integers(20, 61)], rng.choice(400, rng.integers(0, 25)).astype(np.uint64)])) for k in range(300)]
    size, packed, name = np.array([len(s) for s in sets]), [dedup.packed_set(s) for s in sets], np.arange(300) % 250
    alike = lambda x, y: len(np.intersect1d(x, y)) / len(np.union1d(x, y)) >= 0.7
    want = [k for k in range(120) if any(name[k] != name[j] and alike(sets[k], sets[j]) for j in range(120, 300))]
    assert 20 < len(want) < 110
    for own, folded in ((None, 512), (64, 32), (8, 4), (0, 1)):
        got = dedup.have_similar(size[:120], packed[:120], name[:120], size[120:], packed[120:], name[120:], 0.7, own, folded)
        assert sorted(got.tolist()) == want


def test_blocks_let_all_similar_sizes_meet():
    size = np.random.default_rng(4).integers(1, 900, 4000)
    kind = np.floor(np.log(size) / np.log(dedup.CLASS)).astype(np.int64)
    classes = [(int(k), int((kind == k).sum()), int(size[kind == k].min()), int(size[kind == k].max())) for k in np.unique(kind)]
    one, other = dedup.Blocks(classes, 100), dedup.Blocks(classes, 700)
    at, to = one.of(kind, np.arange(4000)), other.of(kind, np.arange(4000))
    assert np.bincount(at).max() < 160 and np.bincount(to).max() < 800 and len(one.least) == at.max() + 1
    met = np.zeros((len(one.least), len(other.least)), bool)
    for k, x in enumerate(one.meets(other, 0.7)):
        met[k, x] = True
    fits = np.minimum(size[:, None], size) >= 0.7 * np.maximum(size[:, None], size)
    assert met[at][:, to][fits].all() and not met.all()


# ---------------------------------------------------------------- metrics


def scored(spark, rows):
    return spark.createDataFrame(rows, "label int, pred int, prob double")


def test_metrics(spark):
    perfect = scored(spark, [(k % 2, k % 2, 0.99 if k % 2 else 0.01) for k in range(100)])
    m = metrics.binary_metrics(perfect).first()
    assert m["f1"] > 0.98 and m["fpr"] < 0.02 and metrics.auc_rank(perfect).first()["auc_roc"] == 1
    assert metrics.average_precision(perfect).first()[0] == pytest.approx(1) and metrics.auc_pr(perfect).first()[0] == pytest.approx(1)
    none = metrics.binary_metrics(scored(spark, [(k % 2, 0, 0.1) for k in range(50)])).first()
    assert none["recall"] == 0 and none["fpr"] == 0
    assert metrics.auc_rank(scored(spark, [(0, 0, 0.5), (1, 0, 0.5), (0, 0, 0.5), (1, 0, 0.5)])).first()["auc_roc"] == 0.5
    assert metrics.auc_rank(scored(spark, [(0, 0, 0.5)])).first()["auc_roc"] is None
    swept = metrics.sweep(perfect, metrics.uniform_thresholds(50))
    assert swept.count() == 50
    assert 0 <= metrics.threshold_at_fpr(swept, 0.1).first()[0] <= 1
    assert metrics.sweep(perfect.limit(0), [0.5]).first() is not None


def test_intervals_and_ranks(spark):
    low, high = metrics.wilson(F.lit(0), F.lit(0))
    assert one(spark, F.array(low, high), a=1) == [0.0, 0.0]
    low, high = metrics.wilson(F.lit(8), F.lit(10))
    assert one(spark, F.array(low, high), a=1) == pytest.approx([0.49016, 0.94332], abs=1e-4)
    df = spark.createDataFrame([("a", 0.9, 40.0, 0.1), ("b", None, 80.0, None)], "model string, auc_pr double, p99 double, mean_evasion double")
    got = {r["model"]: r for r in ranking.composite_rank(df).collect()}
    assert got["a"]["rank"] == 1 and got["a"]["composite"] == pytest.approx(0.98) and got["b"]["latency_score"] == pytest.approx(0.4)
    assert ranking.flattened({"a": {"b": 1, "c": float("nan")}, "d": True, "e": 2.5}) == [("a.b", 1.0), ("e", 2.5)]
    epochs = spark.createDataFrame([(1, 0.5), (2, 0.7), (3, 0.6), (4, 0.6), (5, 0.9)], "epoch int, macro_f1 double")
    assert jobs.best_checkpoint(epochs).first()["epoch"] == 5 and jobs.best_checkpoint(epochs, patience=2).first()["epoch"] == 2


def test_profiles(spark):
    a = spark.createDataFrame([("x", 10), ("y", 10)], "k string, n long")
    assert profile.shift(a, a, "k").first()["jsd"] == pytest.approx(0, abs=1e-9)
    assert profile.shift(a, spark.createDataFrame([("z", 5)], "k string, n long"), "k").first()["jsd"] == pytest.approx(1, abs=1e-6)
    assert profile.gini(a).first()[0] == 0 and profile.gini(spark.createDataFrame([(0,), (10,)], "n long")).first()[0] == pytest.approx(0.5)


def test_leakage(spark):
    rows = [(k, f"GET / Host: evilcorp.example id{k}", 1) for k in range(200)] + [(k, f"GET / Host: h{k}.example id{k}", 0) for k in range(200, 400)]
    out = leakage.token_leakage(spark.createDataFrame(rows, "id long, raw string, label int"))
    top = leakage.top_tokens(out, 1).first()
    assert top["token"] == "evilcorp" and top["p_positive"] == 1 and top["mi"] > 0.5
    assert [one(spark, leakage.is_incidental("t"), t=t) for t in ("123", "deadbeef", "ab12", "abcd", "a1")] == [True, True, True, False, False]


# ---------------------------------------------------------------- splits, augmentation


def test_split_sizes_and_stability(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 3).cast("string").alias("label"))
    sizes = {r["split"]: r["count"] for r in splits.stratified_split(df).groupBy("split").count().collect()}
    assert sum(sizes.values()) == 20_000
    assert all(abs(sizes[k] - v * 20_000) < 0.02 * 20_000 for k, v in splits.SHARES.items())
    a = splits.stratified_split(df.repartition(7)).filter("split = 'test'").select("id")
    assert a.exceptAll(splits.stratified_split(df.coalesce(1)).filter("split = 'test'").select("id")).count() == 0
    assert splits.fill_to_quota(df.limit(3), 10, "id").count() == 10 and splits.fill_to_quota(df.limit(0), 5, "id").count() == 0
    assert splits.source_mix(10, 0.3) == (3, 7) and splits.source_mix(10, 2, True, False) == (10, 0)


def test_tampers(spark):
    for name, f in tampers.TAMPERS.items():
        out = one(spark, f(F.col("t"), F.lit(1)), t="ab 12'")
        assert out and ("1" in out or name == "base64_param")
    assert " " not in one(spark, tampers.url_encode("t"), t="a b") and "%" in one(spark, tampers.url_encode("t"), t="a b")
    assert one(spark, tampers.hex_encode("t"), t="aé1") == "0x610xe91"
    assert one(spark, tampers.quote_break("t"), t="cat id") == "c''at id"
    assert one(spark, tampers.ip_octal("t"), t="http://127.0.0.1/a 10.0.0.1") == "http://0177.00.00.01/a 012.00.00.01"
    assert one(spark, tampers.ip_hex("t"), t="127.0.0.1") == "0x7f000001"


def test_no_rule_is_missed_for_want_of_a_literal(spark):
    """Texts made of pieces of the patterns: a guarded pattern is found wherever the bare one is."""
    rng = random.Random(3)
    pieces = ["union", "select", " all ", "from", "t1", "insert into x", "drop table y", "sleep ( 5", "benchmark(1", "waitfor delay '", "<script>", "< script ", "javascript: alert", "onerror=x", "onload = 'y",
              "document.cookie", "<iframe ", "../", "..\\", "%2e%2e/", "/etc/passwd", "/proc/self/", "php://input", "http://evil.example/a.php", "https://localhost/a.php", "169.254.169.254", " 127.0.0.1:", "file://",
              "; id", "| cat /", "`ls -", "$(whoami)", "`abc`", "& curl http:", "<!ENTITY x", "SYSTEM 'file:", "<!DOCTYPE a [", "{{7*7}}", "{% x %}", "${a}", "#{a}", "<%= a %>", "' or '", "' and 1", "or 1 = 1", "AND 1=1",
              "0xdeadbeef", "<svg>", "<details ", "onfocus =", "eval (", "%252e%252e", ".%2e", "boot.ini", "system32\\", "; echo a", "&& python ", "exec (", "xp_cmdshell", "information_schema .", "sys.tables", "src = 'javascript:",
              "href=data:", "\r\nLocation", "\nX-a", "nmap ", "sqlmap ", " where a = b", "<a b onx =", "tmp/", "etc\\", "update a set", "delete  from", "or 'a'='a'", "extractvalue(", "mysql.user", "<svg on", "data : text/html",
              "\\windows\\system32", "localhost:80/admin", "[::1]/", "; ps ", "bash -i >&", "nc -e /bin", "K", "İ", "ß", "=", "'", " ", "\n", "a"]
    texts = [" ".join(rng.choices(pieces, k=rng.randint(1, 4))) for _ in range(1500)] + ["".join(rng.choices(pieces, k=2)) for _ in range(500)] + pieces + [p.upper() for p in pieces]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, raw string")
    low = F.lower("raw")
    assert set(rules.NEEDS) == {r.id for r in rules.RULES} and set(gate.NEEDS) == set(gate.HEURISTICS)
    wrong = [(rules.rule_hit(low, r) != rules.hit(low, r.pattern)).cast("int") for r in rules.RULES]
    hits = [F.max(rules.hit(low, r.pattern).cast("int")).alias(f"h{r.id}") for r in rules.RULES]
    assert df.agg(*[F.sum(w) for w in wrong]).first() == tuple([0] * len(wrong))
    assert set(df.agg(*hits).first()) == {1}  # every rule is met by some text
    bare = F.filter(F.array(*[F.when(F.rlike("raw", F.lit("(?id)" + gate.HEURISTICS[n])), F.lit(n)) for n in sorted(gate.HEURISTICS)]), lambda x: x.isNotNull())
    assert df.filter(gate.heuristic_classes("raw") != bare).count() == 0 and df.filter(F.size(bare) > 0).count() > 100


def test_scores_in_a_session_with_tags(spark):
    """A model must not carry the session into its tasks: a session with tags can't be sent."""
    spark.addTag("a")
    try:
        rows = spark.createDataFrame([(k, f"text {'bad' if k % 2 else 'good'} {k}", k % 2) for k in range(60)], "id long, raw string, label int")
        rows = probes.prepared(rows)
        assert probes.scores(probes.logistic_probe(rows, structural=True), rows).filter("pred = label").count() > 50
        assert probes.scores(probes.boosted_probe(rows.withColumn("stop_by", F.col("id") % 5 == 0), columns=64, trees=5, validation="stop_by"), rows).count() == 60
    finally:
        spark.clearTags()


def test_exact_percentiles(spark):
    df = spark.range(4000).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 7 > 0, F.sin("id")).alias("v"), F.when(F.col("id") % 2 == 0, "a").alias("s"))
    df = df.unionAll(spark.createDataFrame([(9, None, "a"), (8, 1.5, None)], df.schema))
    shares = {"lo": 0.0, "q1": 0.25, "mid": 0.5, "p99": 0.99, "hi": 1.0}
    for by in ([], ["k"], ["k", "s"]):
        got = profile.exact_percentiles(df.repartition(5), F.col("v"), by, shares)
        want = df.groupBy(*by).agg(*[F.percentile("v", F.lit(p)).alias(n) for n, p in shares.items()])
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert profile.exact_percentiles(df.limit(0), F.col("v"), ["k"], shares).count() == 0


def test_exact_ranks_whatever_the_cells(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 300 == 0, F.lit(None)).otherwise("cold").alias("s"))
    got = splits.ranked(df.repartition(5), [F.col("s")], splits._in_order("id", 1)).toPandas()
    for _, rows in got.groupby(got["s"].fillna("?")):
        assert sorted(rows["_r"]) == list(range(1, len(rows) + 1)) and set(rows["_n"]) == {len(rows)}
    assert splits.renormalised({"a": 0.2, "b": 0.2, "c": 0.6}, ["a"])["c"] == pytest.approx(0.75)
    part = splits.first_share(df, 0.5, "s", "id")
    assert part.filter("s = 'hot'").agg(F.max("id")).first()[0] == 1499


def test_logger(capsys):
    jobs.logger("a").info("one")
    jobs.logger("a").info("two")
    lines = [x for x in capsys.readouterr().err.splitlines() if "tidewright.a" in x]
    assert len(lines) in (0, 2)  # a handler of an earlier stream, or each line once
    assert len(jobs.logger("a").handlers) == 1


def test_flattest_productions(spark):
    g = grammar.Grammar({"S": [(9.0, [("n", "A"), ("n", "S")]), (1.0, [("n", "A")])], "A": [(5.0, [("n", "B")]), (1.0, [("t", "a")])], "B": [(1.0, [("t", "b")])]}, start="S", max_depth=2)
    assert {p.body for p in g.flat["S"]} == {(("n", "A"),)} and {p.body for p in g.flat["A"]} == {(("t", "a"),)}
    assert all(set(g.sample(grammar.row_random(k))) <= {"a", "b"} for k in range(50))
    for wrong in ({"S": [(1.0, [("n", "X")])]}, {"X": [(1.0, [("t", "x")])]}):
        with pytest.raises(ValueError):
            grammar.Grammar(wrong, start="S")


def test_swapped_fillers(spark):
    df = spark.createDataFrame([(1, "from 10.1.2.3 to www.shop.com, 12345 times 7"), (2, None), (3, "")], "id long, t string")
    got = {r["id"]: r["t"] for r in leakage.swapped(df, "t", "id").collect()}
    assert got[2] is None and got[3] == "" and re.fullmatch(r"from \d+(\.\d+){3} to [a-z0-9.]+, \d+ times 7", got[1])
    assert "10.1.2.3" not in got[1] and "shop" not in got[1] and got == {r["id"]: r["t"] for r in leakage.swapped(df.repartition(3), "t", "id").collect()}


def test_grammar(spark):
    g = grammar.grammars({"g": {"start": "A", "max_depth": 4, "rules": {"A": [[0.9, ["t:a", "n:A"]], [0.1, ["t:b"]]]}}})["g"]
    for seed in range(300):
        out = g.sample(grammar.row_random(seed))
        assert out.endswith("b") and len(out) <= 6
    with pytest.raises(ValueError):
        grammar.Grammar({"A": [(1.0, [("n", "A"), ("n", "A")])]}, start="A")
    hosts = {grammar.fill("§HOST§", grammar.row_random(1, k)) for k in range(1000)}
    assert len(hosts) > 900
    a, b, c = grammar.fill("§HOST#a§|§HOST#a§|§HOST§", grammar.row_random(2)).split("|")
    assert a == b != c and grammar.fill("§NOPE§", grammar.row_random(3)) == "§NOPE§"
    with pytest.raises(KeyError):
        grammar.fill("§NOPE§", grammar.row_random(3), strict=True)
    quoted = grammar.Grammar({"START": [(1.0, [("openq",), ("t", "x"), ("closeq",)])]})
    assert {quoted.sample(grammar.row_random(k)) for k in range(200)} == {"'x'", '"x"'}
    assert grammar.load_grammars("/nowhere.json") == {}


def test_tampered_records(spark):
    rows = requests.normalise(spark.createDataFrame([("GET", "/a", "q=a b", "{}", "", "", "1", "sqli", "s")], "method string, path string, query_string string, headers string, body string, raw string, label string, attack_class string, source string"))
    assert augment.tampered(rows, ("space2comment", "url_encode")).first()["raw"].startswith("GET /a?q%3Da%2F%2A%2A%2Fb HTTP/1.1")


def test_collation(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([4, 5, 6, 7, 8],)], "ids array<int>")
    got = sorted((r["input_ids"], r["attention_mask"]) for r in tokenization.collated(df).collect())
    assert got == [([1, 2, 3, 0, 0], [1, 1, 1, 0, 0]), ([4, 5, 6, 7, 8], [1] * 5)]
    assert {len(r["input_ids"]) for r in tokenization.collated(df, width=4).collect()} == {4}


# ---------------------------------------------------------------- files, jobs


def test_files(spark, tmp_path):
    assert len(set(files.REPORTS.values())) == len(files.REPORTS) and files.report_path("/r", "zzz") == "/r/_unfiled/zzz.json"
    with pytest.raises(ValueError):
        files.checked_config({"splits": {"a": 0.5, "b": 0.4}})
    with pytest.raises(ValueError):
        files.checked_config({"model": {"d_model": 10, "n_heads": 3}})
    (tmp_path / "a.csv").write_text("label,raw\n1,x\n")
    (tmp_path / "b.tsv").write_text("label\tother\n0\ty\n")
    assert readers.read_delimited(spark, str(tmp_path)).count() == 2
    (tmp_path / "w.txt").write_text("# no\n\n' or 1=1\n")
    assert readers.read_wordlist(spark, str(tmp_path / "w.txt")).first()["query_string"] == "id=' or 1=1"
    (tmp_path / "r.txt").write_text("junk\nGET /a HTTP/1.1\nA: b\n\nPOST /b HTTP/1.1\n\nx=1\n")
    assert readers.read_requests_text(spark, str(tmp_path / "r.txt"), 1).count() == 2
    (tmp_path / "d.arff").write_text("% c\n@relation r\n@attribute a numeric\n@attribute 'b' string\n@data\n1,x\n2,'y z'\n")
    assert [tuple(r) for r in readers.read_arff(spark, str(tmp_path / "d.arff")).collect()] == [("1", "x"), ("2", "y z")]
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "fam.jsonl").write_text('{"text": "a"}\nbroken\n')
    assert [tuple(r) for r in readers.read_jsonl(spark, str(tmp_path / "j")).collect()] == [("a", "fam")]
    assert readers.first_existing(spark, [str(tmp_path / "no"), str(tmp_path / "j")]) == str(tmp_path / "j")
    assert readers.verified(spark, str(tmp_path / "a.csv"), readers.checksums(spark, str(tmp_path / "a.csv")).first()["sha256"])
    import zipfile

    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("../evil", "x")
    with pytest.raises(ValueError):
        files.extract(str(tmp_path / "z.zip"), str(tmp_path / "out"))


def test_capture(spark, tmp_path):
    import struct

    payload = b"GET /a?b=1 HTTP/1.1\r\nHost: x\r\n\r\n"
    ip = bytes([0x45, 0]) + struct.pack(">H", 40 + len(payload)) + bytes(4) + bytes([64, 6]) + bytes(10)
    frame = bytes(12) + b"\x08\x00" + ip + bytes(12) + bytes([0x50]) + bytes(7) + payload
    (tmp_path / "x.pcap").write_bytes(b"\xd4\xc3\xb2\xa1" + bytes(20) + struct.pack("<IIII", 0, 0, len(frame), len(frame)) + frame)
    assert tuple(readers.read_pcap(spark, str(tmp_path / "x.pcap")).first()) == ("GET", "/a?b=1", {"Host": "x"}, "")


def test_sinks(spark, tmp_path):
    rows = requests.normalise(spark.createDataFrame([("raw a", "1", "sqli"), ("raw b", "0", "benign")], "raw string, label string, attack_class string"))
    assert sinks.write_table(rows, str(tmp_path / "t")) == {"total": 2, "benign": 1, "malicious": 1}
    assert spark.read.parquet(str(tmp_path / "t")).columns == schema.COLUMNS
    sinks.write_splits(rows.withColumn("split", F.lit("test")), str(tmp_path / "s"))
    assert files.done(str(tmp_path / "s")) and not files.done(str(tmp_path / "nope"))
    assert files.load_json(sinks.write_report(profile.label_counts(rows), str(tmp_path), "corpus_stats"))[0]["total"] == 2
    assert sinks.write_corpus_text(rows, str(tmp_path / "c")) == 0
    sinks.write_csv_report(profile.label_counts(rows), str(tmp_path / "csv"))


def test_jobs():
    seen = []
    steps = [jobs.Job("a", lambda: seen.append("a")), jobs.Job("b", lambda: seen.append("b"), ["a"]), jobs.Job("c", lambda: seen.append("c"), ["a", "b"], lambda: True)]
    assert [s for _, s, _ in jobs.run(steps, ["c"])] == ["done", "done", "skipped"] and seen == ["a", "b"]
    assert [s for _, s, _ in jobs.run(steps, ["b"], dry=True)] == ["planned", "planned"]
    with pytest.raises(ValueError):
        jobs.order([jobs.Job("a", print, ["b"]), jobs.Job("b", print, ["a"])], ["a"])


# ---------------------------------------------------------------- streams


def test_streams(spark, sf_dir, tmp_path):
    from tidewright.streaming import scoring

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    got = scoring.drained(scoring.rates(stream), "rates_test", str(tmp_path / "k1"), "complete")
    assert got.agg(F.sum("n")).first()[0] == events.count()
    pages = spark.readStream.schema("page_id long, url string, html string").parquet(sf_dir, pathGlobFilter="pages.parquet")
    assert scoring.drained(scoring.scored(pages.select("page_id", "url"), "url"), "scored_test", str(tmp_path / "k2")).count() > 0


def test_random_case_keeps_characters_without_a_one_character_case(spark):
    text = "Straße ŉ İ " * 20
    rows = spark.createDataFrame([(k, text) for k in range(5)], "k long, t string")
    for (mixed,) in rows.select(tampers.random_case("t", "k")).collect():
        assert len(mixed) == len(text) and mixed != text
        assert [c for c in mixed if c in "ßŉİ"] == [c for c in text if c in "ßŉİ"]
