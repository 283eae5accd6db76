import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewright.llm import audio, html_text, mixing, packing, topk, url_filter

DOCS = "doc_id long, text string, source string, size long"


# ---------------------------------------------------------------- URL filters


def test_url_rules(spark):
    urls = [
        "http://a.net/x", "https://www.EXAMPLE.net/en/1?q", "http://example.net/de/", "http://m.example.com/de/x", "http://example.com/DE/", "http://x.org/fr/", "http://x.org/fr",
        "ftp://notexample.net/en/", "http://net/", "http://net", "no scheme", "", None, "x://", "http://a.org/q?u=http://b.net/", "http://a.net:80/",
    ]
    df = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)] + [(0, urls[0], "clash")], "page_id long, url string, prefix string")
    rules = spark.createDataFrame([*url_filter.RULES, url_filter.RULES[0], (None, "/", "block"), ("", "/", "block")], "host string, path string, action string")
    got = {(r["page_id"], r["rule"], r["verdict"]) for r in url_filter.judge(df, rules, keep=("page_id",)).collect()}
    assert got == {
        (0, "net/", "block"), (1, "example.net/en/", "allow"), (2, "net/", "block"), (3, "example.com/de/", "block"), (4, None, "allow"), (5, "org/fr/", "allow"), (6, None, "allow"),
        (7, "net/", "block"), (8, "net/", "block"), (9, None, "allow"), (10, None, "allow"), (11, None, "allow"), (12, None, "allow"), (13, None, "allow"), (14, None, "allow"), (15, None, "allow"),
    }
    assert url_filter.judge(df, rules, keep=("page_id",)).count() == len(urls) + 1
    many = spark.createDataFrame([("a.b", "/x", "block"), ("b", "/x/y", "allow")], "host string, path string, action string")
    one = spark.createDataFrame([(1, "http://a.b/x/y/z")], "page_id long, url string")
    assert url_filter.judge(one, many, keep=("page_id",)).first()["rule"] == "a.b/x"  # as long as b/x/y, with the longer host
    assert url_filter.judge(df.limit(0), rules, keep=("page_id",)).count() == 0
    assert url_filter.judge(one, rules.limit(0), keep=("page_id",)).first()["verdict"] == "allow"


def test_large_rule_sets_join_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", 0)
    df = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, action string")
    assert url_filter.judge(df, rules, keep=("page_id",)).first()["rule"] == "net/"


# ---------------------------------------------------------------- mixing


def test_targets_meet_caps():
    assert mixing.targets([100, 100, 100]) == [200, pytest.approx(166.6666667), pytest.approx(83.3333333)]
    found = mixing.targets([10, 1000, 0, 500])
    assert sum(found) == pytest.approx(1.5 * 1510) and all(t <= 2 * s + 1e-9 for t, s in zip(found, [10, 1000, 0, 500]))
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0]


def test_an_exchange_keeps_words_and_expectation():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (int(rng.integers(1, 50)), float(rng.uniform(0.01, 0.99))), (int(rng.integers(1, 50)), float(rng.uniform(0.01, 0.99)))
        mean = np.zeros(2)
        grid = (np.arange(2000) + 0.5) / 2000
        for u in grid:
            p, q = mixing.meet(a, b, u)
            assert p in (0.0, 1.0) or q in (0.0, 1.0)
            assert a[0] * p + b[0] * q == pytest.approx(a[0] * a[1] + b[0] * b[1])
            mean += (p, q)
        assert mean / len(grid) == pytest.approx([a[1], b[1]], abs=2e-3)


def test_mix(spark):
    rng = np.random.default_rng(2)
    rows = [(k, "w " * int(rng.integers(0, 40)), ["s1", "s2", "s3", None][k % 4], 7) for k in range(1500)] + [(5, None, "s1", 7), (None, "a b", "s2", 7), (7, "x", "s9", 7), (7, "x", "s9", 7)]
    df = spark.createDataFrame(rows, DOCS)
    out = mixing.mix(df)
    got = out.toPandas()
    assert len(got) == len(rows)
    assert (got["taken"] <= 2 * got["size"]).all()
    by = got.groupby(got["source"].fillna("?")).agg(target=("target", "first"), taken=("taken", "sum"), most=("size", "max"))
    assert ((by["target"] - by["taken"]).abs() <= by["most"]).all()
    again = mixing.mix(df.repartition(5)).toPandas()
    key = ["doc_id", "source", "size", "taken"]
    assert got[key].sort_values(key, ignore_index=True).equals(again[key].sort_values(key, ignore_index=True))
    assert mixing.mix(df.limit(0)).count() == 0
    taken = mixing.materialise(df)
    assert taken.columns == df.columns and taken.count() == int(out.agg(F.sum("copies")).first()[0])


def replayed(rows, seed):
    """Pivotal rounding of one cell, in fractions: {row number: copies} for rows (number, rnd, source number, size, rate)."""
    copies = {n: Fraction(math.floor(rate)) for n, _, _, _, rate in rows}
    rest = {n: Fraction(rate) - math.floor(rate) if size else Fraction(0) for n, _, _, size, rate in rows}
    info = {n: (rnd, src, size) for n, rnd, src, size, _ in rows}
    waiting = {}
    for n in sorted(rest, key=lambda n: (info[n][1], -info[n][2], info[n][0])):
        if not rest[n]:
            continue
        src = info[n][1]
        if src not in waiting:
            waiting[src] = n
            continue
        m = waiting.pop(src)
        (ra, _, sa), (rb, _, sb) = info[m], info[n]
        up = min(sa * (1 - rest[m]), sb * rest[n])  # words that may move to m
        down = min(sb * (1 - rest[n]), sa * rest[m])  # words that may move to n
        words = up if mixing._uniform(seed, src, ra, rb, sa) < down / (up + down) else -down
        rest[m] += words / sa
        rest[n] -= words / sb
        for k in (m, n):
            if rest[k].denominator == 1:
                copies[k] += rest[k]
                rest[k] = Fraction(0)
            else:
                waiting[src] = k
    for src, k in waiting.items():
        copies[k] += mixing._uniform(seed, src, info[k][0]) < rest[k]
    return {n: int(c) for n, c in copies.items()}


def test_one_cell_is_rounded_as_in_plain_fractions():
    rng = np.random.default_rng(8)
    for seed in range(30):
        rates = [Fraction(int(a), 64) for a in rng.integers(0, 128, 3)]
        rows = [(n, int(rng.integers(0, 2**62)), int(s), int(rng.integers(0, 60)), rates[s]) for n, s in enumerate(rng.integers(0, 3, 40))]
        given = pd.DataFrame([(n, n, n, rnd, s, size, math.floor(r), float(r - math.floor(r)) if size else 0.0, 0) for n, rnd, s, size, r in rows],
                             columns=[c.split()[0] for c in mixing._STATE.split(", ")])
        out = mixing._round_cell(seed, True)(given)
        assert (out["open"] == 0).all()
        assert dict(zip(out["doc_id"], out["whole"])) == replayed(rows, seed)


def test_rows_alike_share_their_copies(spark):
    rows = [(1, "a b c", "s1", k) for k in range(80)] + [(None, "x y", "s1", k) for k in range(30)] + [(None, "x y z", None, 1), (2, "", "s1", 1), (2, None, "s2", 1)]
    rows += [(k, "w " * k, "s2", 1) for k in range(10, 40)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    decided, taken = mixing.mix(df), mixing.materialise(df)
    want = {(r["doc_id"], r["source"], r["size"]): r["copies"] for r in decided.groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("copies")).collect() if r["copies"]}
    got = taken.groupBy("doc_id", "source", mixing.words(F.col("text")).alias("words")).count().collect()
    assert {(r["doc_id"], r["source"], r["words"]): r["count"] for r in got} == want
    times = [r["count"] for r in taken.filter("doc_id = 1").groupBy("size").count().collect()]
    assert max(times) - (min(times) if len(times) == 80 else 0) <= 1
    assert decided.count() == len(rows)


# ---------------------------------------------------------------- top-k


def best_scores(rows, k=5, every=50):
    """(query_id, rank, vec_id, score) of rows (id, vector), each with all others."""
    ready = [(d, [math.floor(256 * x) for x in v]) for d, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, (d, v) in enumerate(ready):
        if d is None or d % every:
            continue
        scores = [(-sum(a * b for a, b in zip(v, w)), e is None, e) for c, (e, w) in enumerate(ready) if c != q]
        out += [(d, r, e, -s) for r, (s, _, e) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def searched(spark, rows, parts=3):
    df = spark.createDataFrame([(d, v, 1, "x") for d, v in rows], "vec_id long, embedding array<double>, rank int, key string").repartition(parts)
    return sorted((tuple(r) for r in topk.search(df, F.col("vec_id") % 50 == 0, 5).collect()), key=str)


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(0, 0.2, (300, 8))
    vectors[20:40] = vectors[20]
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(vectors)]
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (304, []), (305, [0.5, 0.5]), (None, [1.0] * 8), rows[4]]
    rows += [(350, []), (100, [0.1] * 8), (-(2**62) - 46, [0.2] * 8), (2**62 + 46, [0.3] * 8), (2**63 - 1, [0.1] * 8)]
    assert searched(spark, rows) == best_scores(rows)
    assert searched(spark, []) == [] and searched(spark, [(0, [1.0])]) == [] and searched(spark, [(0, []), (1, [])]) == [(0, 1, 1, 0)]


def test_topk_takes_repeated_ids_as_rows(spark):
    rows = [(50, [1.0, 0.0]), (7, [0.5, 0.0]), (7, [0.25, 0.0]), (8, [0.125, 1.0]), (50, [1.0, 0.0]), (None, [0.5, 0.0])]
    assert searched(spark, rows) == best_scores(rows)


def test_topk_over_many_groups_and_batches(spark, monkeypatch):
    rng = np.random.default_rng(9)
    centres = rng.normal(0, 1, (6, 4))
    rows = [(k, [float(x) for x in centres[k // 100] + rng.normal(0, 0.05, 4)]) for k in range(600)]
    for name, size in (("BLOCK", 8), ("_SIZE", 16), ("SET", 5), ("QUERIES", 4)):
        monkeypatch.setattr(topk, name, size)
    assert searched(spark, rows, 2) == best_scores(rows)


def test_topk_gives_the_rows_of_its_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    assert sorted(tuple(r) for r in topk.query(spark, sf_dir).collect()) == sorted(con.sql(topk.SQL).fetchall())


def test_blocks_are_pruned():
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.integers(-3, 4, (900, 6)), rng.integers(50, 60, (100, 6))]).astype(float)
    _, _, scored = topk.prune(v[-2:], v, np.array([998, 999]), 5, block=100)
    assert scored < 2 * 10


# ---------------------------------------------------------------- audio


def test_payloads_round_trip(spark):
    texts = ["", None, "a", "x" * 192, "é" * 200, "long words " * 5000]
    df = spark.createDataFrame([(k, t, "m") for k, t in enumerate(texts)] + [(None, "a", "m")], "doc_id long, text string, media string")
    stored = audio.store(df)
    for r in audio.digests(stored).collect():
        if r["doc_id"] is None:
            continue
        raw = (texts[r["doc_id"]] or "").encode()
        payload = audio.padded(raw)
        assert len(payload) % 192 == 0 and len(payload) >= 192
        file = audio.encode(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(raw), len(payload), len(file))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["media_sha256"] == hashlib.sha256(file).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-16:])
        assert bytes(audio.decode(file)[0]) == payload
    twice = [r["feature"] for r in audio.digests(stored).filter("doc_id = 2 OR doc_id IS NULL").collect()]
    assert len(twice) == 2 and twice[0] == twice[1]
    windows = audio.segments(stored).filter("doc_id = 5").orderBy("window").toArrow()
    assert windows.column("frames").to_pylist()[0] == audio.WINDOW and len(windows) > 1
    assert audio.tensor_table(windows).schema.field("tensor").type.shape == [audio.WINDOW, audio.MELS]
    assert audio.digests(audio.store(df.limit(0))).count() == 0


def loop_analysis(samples, rate=16_000, target=8_000):
    """Frames of log-mel bands and spans, by the definitions: sums over taps, a plain transform, triangles over its power."""
    g = math.gcd(rate, target)
    up, down = target // g, rate // g
    n_taps = audio.TAPS * up
    taps = [np.sinc((t - (n_taps - 1) / 2) / max(up, down)) * (0.54 - 0.46 * math.cos(2 * math.pi * t / (n_taps - 1))) for t in range(n_taps)]
    taps = [t * up / sum(taps) for t in taps]
    x = [int(s) - 128 for s in samples]

    def output(n):
        """The input with up - 1 zeros after each sample, filtered, at place n * down."""
        at = n * down
        return sum(taps[t] * x[(at - t) // up] for t in range(at % up, n_taps, up) if 0 <= (at - t) // up < len(x))

    total = max(1, len(x) * up // down)
    frames = 1 + max(0, math.ceil((total - audio.FRAME) / audio.HOP))
    y = np.array([output(n) for n in range((frames - 1) * audio.HOP + audio.FRAME)])
    turn = np.exp(-2j * np.pi * np.outer(np.arange(audio.FRAME // 2 + 1), np.arange(audio.FRAME)) / audio.FRAME)
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    edges = [700 * (10 ** ((mel(60) + k * (mel(target / 2) - mel(60)) / (audio.MELS + 1)) / 2595) - 1) for k in range(audio.MELS + 2)]
    bands, energy = [], []
    for k in range(frames):
        piece = [y[k * audio.HOP + i] * (0.5 - 0.5 * math.cos(2 * math.pi * i / (audio.FRAME - 1))) for i in range(audio.FRAME)]
        power = np.abs(turn @ piece) ** 2
        row = []
        for a, b, c in zip(edges, edges[1:], edges[2:]):
            weight = [max(0.0, min((f - a) / (b - a), (c - f) / (c - b))) for f in (i * target / audio.FRAME for i in range(audio.FRAME // 2 + 1))]
            row.append(math.log(sum(w * p for w, p in zip(weight, power)) + 1e-3))
        bands.append(row)
        energy.append(math.log(sum(power) + 1e-3))
    level, spans, k = [e - float(np.median(energy)) for e in energy], [], 0
    while k < frames:
        end = k
        while end < frames and level[end] > audio.CLOSE_AT:
            end += 1
        if any(v > audio.OPEN_AT for v in level[k:end]):
            spans.append((k, end))
        k = max(end, k + 1)
    return np.array(bands), spans


@pytest.mark.parametrize(("rate", "target"), [(16_000, 8_000), (6_000, 8_000), (11_025, 8_000)])
def test_features_against_their_definitions(rate, target):
    rng = np.random.default_rng(11)
    samples = rng.integers(118, 138, 2200).astype(np.uint8)
    samples[900:1500] = rng.integers(20, 230, 600)
    want, spans = loop_analysis(samples.tolist(), rate, target)
    bands, energy = audio.log_mel(samples, rate, target)
    assert bands.shape == want.shape and np.abs(bands - want).max() < 2e-2
    assert audio.spans(energy) == spans and spans


def test_tensors_are_stored_and_read_back(spark):
    texts = ["", "abc" * 40, "long words " * 5000, None]
    df = spark.createDataFrame([(k, t, "m", 7) for k, t in enumerate(texts)], "doc_id long, text string, media string, spans int")
    stored = audio.store(df, keep=("doc_id", "media", "spans"))
    assert stored.columns == ["doc_id", "media", "spans", "n_bytes", "media"]
    stored = audio.store(df)
    rows = {r["doc_id"]: r for r in audio.digests(stored).collect()}
    whole = audio.tensor_table(audio.segments(stored).orderBy("doc_id", "window").toArrow())
    values, of = whole.column("tensor").combine_chunks().to_numpy_ndarray(), np.array(whole.column("doc_id").to_pylist())
    assert values.shape[1:] == (audio.WINDOW, audio.MELS)
    for k, t in enumerate(texts):
        found = audio.analyse(audio.encode(audio.padded((t or "").encode())))
        own = values[of == k]
        assert rows[k]["n_tensors"] == len(own) and rows[k]["tensors_sha256"] == hashlib.sha256(np.ascontiguousarray(own).tobytes()).hexdigest()
        assert np.allclose(own.reshape(-1, audio.MELS)[: len(found["bands"])], found["bands"])
        assert [(s["start_ms"], s["end_ms"]) for s in rows[k]["spans"]] == [(a * 16.0, b * 16.0) for a, b in found["spans"]]


def test_resampling_and_spans():
    tone = (128 + 100 * np.sin(2 * np.pi * 440 * np.arange(16000) / 16000)).astype(np.uint8)
    out = audio.resample(tone, 0, 8000, 1, 2)
    want = 100 * np.sin(2 * np.pi * 440 * np.arange(8000) / 8000)
    lag = max(range(-20, 21), key=lambda s: float(np.dot(np.roll(want, s)[200:-200], out[200:-200])))
    assert np.abs(np.roll(want, lag)[200:-200] - out[200:-200]).max() < 25
    assert audio.spans(np.array([0, 0, 0.3, 0.9, 0.3, 0, 0, 0.3, 0, 0, 0.0])) == [(2, 5)]
    loud = np.full(40000, 128, np.uint8)
    loud[20000:24000] = tone[:4000]
    found = audio.analyse(audio.encode(loud.tobytes()))
    assert len(found["spans"]) == 1
    begin, end = (t * audio.HOP / 8000 for t in found["spans"][0])
    assert begin == pytest.approx(1.25, abs=0.1) and end == pytest.approx(1.5, abs=0.1)


# ---------------------------------------------------------------- HTML


def test_regions_and_blocks():
    page = (
        "<!DOCTYPE html><head><title>T</title><style>p{}</style></head><nav><ul><li>menu</ul></nav><div class='cookie-notice'>ok<div>x</div></div>"
        "<article><h1>Head &amp; tail</h1><p><b>one<br>two<p>three&nbsp;\n four<script>var t='</p>';</script> five<!-- no --><div id=sidebar>side</div>"
        "<aside>q</aside><form><input>send</form><ul><li>x<li>y</ul></article><section id='comments'><article>rude</article></section><footer>f</footer>"
    )
    assert html_text.read_blocks(page) == (["Head & tail", "one two", "three four five", "x", "y"], True)
    assert html_text.read_blocks("<main><p>a</main><p>b") == (["a"], True)
    assert html_text.read_blocks("<nav>never closed<article><p>a</article>") == (["a"], True)
    assert html_text.read_blocks("<p>a < b</p>") == (["a < b"], False)
    assert html_text.read_blocks("<article></article><p>b") == ([], True)
    assert html_text.read_blocks("") == ([], False)


def test_attributes_are_read_as_such():
    for page in (
        '<article><p>one <a href="/x?id=comments">two</a> three</p></article>',
        '<article><p data-id="ad-5">one two three</p></article>',
        "<article><p title='class=ads' data-class=menu>one two three</p></article>",
        '<article><p>one <noscript>two</noscript> <math><mi>three</mi></math></p></article>',
        '<article><p>one <object data="x">two</object> <svg><text>three</text></svg></p></article>',
    ):
        assert html_text.read_blocks(page) == (["one two three"], True)
    assert html_text.read_blocks('<article><p>one</p><p CLASS = "ads">two</p></article>') == (["one"], True)


def test_copies_beyond_a_group_are_one_page(spark, monkeypatch):
    monkeypatch.setattr(html_text, "GROUP_PAGES", 16)
    story = f"<p>{_words(0)}</p><p>{LINE}</p>"
    rows = [(k, f"http://h.example/{k % 2}", story) for k in range(90)]
    want = dict.fromkeys(range(90), f"{_words(0)}\n{LINE}")
    assert _extracted(spark, rows) == want
    rows += [(90, "http://h.example/9", f"<p>{_words(1)}</p><p>{LINE}</p>")]
    assert _extracted(spark, rows) == dict.fromkeys(range(90), _words(0)) | {90: _words(1)}


def test_names_leave_out_no_article():
    for page in (
        '<div class="layout has-sidebar"><div>x</div><article><p>story</article></div>',
        '<div class="page sidebar"><div>x</div><article><p>story</article>y</div>',
        '<main><div class="sidebar"><article><p>story</article></div></main>',
        '<article class="post share-enabled"><p>story</article>',
        '<article class="share"><p>story</article>',
        '<div class="sidebar"><article>teaser</article><div></div><article>teaser</article></div><article><p>story</article>',
        '<div class="related"><article>teaser</article></div><main><p>story</main>',
        '<main><article></article><p>story</main>',
        '<main><p>story<div class="site-footer">x</div><div class="post-share">x</div></main>',
    ):
        assert html_text.read_blocks(page) == (["story"], True)
    assert html_text.read_blocks('<div class="elementor-widget">story</div>') == (["story"], False)
    assert html_text.read_blocks("<main><article>ad</article><p>the whole story</main>") == (["ad", "the whole story"], True)


def test_repeated_runs_go_from_undecided_pages(spark):
    menu = "<div>home news about us contact privacy terms of use imprint</div>"
    own = lambda k: " ".join(f"w{k}{j}" for j in range(12))
    rows = [(k, f"http://h.example/{k}", f"{menu}<p>{own(k)}</p>") for k in range(4)]
    rows += [(10, "http://h.example/a", f"{menu}<article><p>kept</p></article>"), (11, None, None), (12, "http://h.example/e", ""), (13, "http://alone.example/", menu)]
    out = {r["page_id"]: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [out[k]["text"] for k in range(4)] == [own(k) for k in range(4)]
    assert out[10]["text"] == "kept" and out[10]["n_chars"] == 4
    assert out[11]["text"] == "" and out[12]["text"] == ""
    assert out[13]["text"].startswith("home news")
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def _extracted(spark, rows):
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    return {r["page_id"]: r["text"] for r in got}


def _words(k, n=20):
    return " ".join(f"w{k}x{j}" for j in range(n))


LINE = "read more stories like this one in our daily letter"


def test_articles_keep_what_others_have_too(spark):
    rows = [(k, f"http://a.example/{k}", f"<div>{LINE}</div><article><p>{_words(k)}</p><p>{LINE}</p></article>") for k in range(3)]
    rows += [(3 + k, "http://a.example/", f"<article><p>{_words(3, 60)} {k}</p></article>") for k in range(2)]  # a story of two pages
    rows += [(5, "http://a.example/u", f"<p>{_words(9)}</p><p>{LINE}</p>")]  # undecided: the line is on other pages of the host
    want = {k: f"{_words(k)}\n{LINE}" for k in range(3)} | {3 + k: f"{_words(3, 60)} {k}" for k in range(2)} | {5: _words(9)}
    assert _extracted(spark, rows) == want


def test_repetition_is_counted_over_the_whole_host(spark, monkeypatch):
    rows = [(k, f"http://a.example/{k}", f"<p>{_words(k)}</p><p>{LINE if k % 30 == 0 else ''}</p>") for k in range(60)]
    rows += [(60 + k, "http://two.example/", f"<div>{LINE}</div><p>{_words(60 + k)}</p>") for k in range(2)]
    rows += [(62, "http://d.example/", f"<div>{LINE}</div>")] * 2  # one page, twice
    rows += [(63 + k, f"http://e{k}.example/", f"<div>{LINE}</div>") for k in range(2)]
    want = {k: _words(k) for k in range(62)} | dict.fromkeys((62, 63, 64), LINE)
    for size in (3, 512):
        monkeypatch.setattr(html_text, "GROUP_PAGES", size)
        assert _extracted(spark, rows) == want


def test_the_reader_decides_which_pages_are_undecided(spark):
    marks = ["<script>{'articleBody': 1}</script>", "<!-- <main> -->", "<p title='<article>'></p>"]
    rows = [(k, "http://f.example/", f"{mark}<div>{LINE}</div><p>{_words(k, 6)}</p>") for k, mark in enumerate(marks)]
    assert _extracted(spark, rows) == {k: _words(k, 6) for k in range(3)}


def plain_texts(rows):
    """Texts of pages (id, url, html) with runs counted in a dictionary over each host's distinct pages."""
    pages = []
    for _, url, html in rows:
        host = re.match(r"[^/?#]*", url.split("://", 1)[1] if url and "://" in url else "")[0].translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)}))
        blocks, decided = html_text.read_blocks(html or "")
        pages.append((host, [t for b in blocks for t in (*b.split(), "\n")], decided))
    runs, n = {}, html_text.RUN
    for host, tokens in {(h, tuple(t)) for h, t, _ in pages}:
        for run in {tokens[i : i + n] for i in range(len(tokens) - n + 1)}:
            runs[host, run] = runs.get((host, run), 0) + 1
    out = []
    for host, tokens, decided in pages:
        on = [runs[host, tuple(tokens[i : i + n])] >= html_text.PAGES for i in range(len(tokens) - n + 1)]
        gone = set() if decided else {j for i, c in enumerate(on) if c for j in range(i, i + n)}
        lines = "".join(t if t == "\n" else f"{t} " for k, t in enumerate(tokens) if t == "\n" or k not in gone).split("\n")
        out.append("\n".join(line.strip(" ") for line in lines if line.strip(" ")))
    return out


def test_texts_against_a_plain_version(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    rng = np.random.default_rng(12)
    shared = [_words(100 + k, 25) for k in range(4)]
    for k in range(40):
        parts = [_words(200 + k, int(rng.integers(1, 30))), *(shared[j][int(rng.integers(0, 9)) :] for j in rng.integers(0, 4, int(rng.integers(0, 3))))]
        body = "".join(f"<p>{p}</p>" for p in rng.permutation(parts))
        rows.append((10_000 + k, f"HTTP://Host{k % 3}.example/{k}", f"<article>{body}</article>" if k % 2 else f"<nav>n</nav>{body}"))
    rows += [(20_000, None, None), (20_001, "x", "<p>a"), (20_002, "://h", ""), rows[-1], (None, rows[-2][1], rows[-2][2])]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert Counter((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in got) == Counter((p, u, t, len(t)) for (p, u, _), t in zip(rows, plain_texts(rows)))


def test_coverage_against_brute_force():
    rng = np.random.default_rng(5)
    streams = [[str(x) for x in rng.integers(0, 4, 60)] for _ in range(6)]
    for run, pages in ((3, 3), (4, 2)):
        seen = {}
        for k, s in enumerate(streams):
            for i in range(len(s) - run + 1):
                seen.setdefault(tuple(s[i : i + run]), set()).add(k)
        for s, hit in zip(streams, html_text.covered([" ".join(s) for s in streams], run, pages)):
            want = np.zeros(len(s), bool)
            for i in range(len(s) - run + 1):
                if len(seen[tuple(s[i : i + run])]) >= pages:
                    want[i : i + run] = True
            assert (hit == want).all()


# ---------------------------------------------------------------- packing


def test_boundaries_are_optimal():
    from itertools import combinations

    rng = np.random.default_rng(6)
    for _ in range(60):
        sizes = rng.choice(60, int(rng.integers(1, 11)), replace=False).tolist()
        rows = [(s, int(c := rng.integers(1, 5)), int(s * c)) for s in sizes]
        k = int(rng.integers(1, 5))
        cost = lambda bounds: sum(c * (min(b for b in bounds if b >= s) - s) for s, c, _ in rows)
        best = min(cost([*cut, max(sizes)]) for m in range(min(k, len(sizes))) for cut in combinations(sorted(sizes)[:-1], m))
        found = packing.boundaries(rows, k)
        assert len(found) <= k and cost(found) == best


def test_pack(spark):
    rng = np.random.default_rng(7)
    rows = [(k, "w " * int(rng.integers(0, 60)), "s", 1) for k in range(2000)] + [(None, None, "s", 1), (3, "w " * 9000, "s", 1), (5, "a", "s", 1), (5, "a", "s", 1)]
    got = packing.pack(spark.createDataFrame(rows, DOCS), buckets=4, budget=600).toPandas()
    assert len(got) == len(rows)
    assert (got["padding"] == got["bucket_length"] - got["n_tokens"]).all() and (got["padding"] >= 0).all()
    batches = got.groupby(["bucket", "batch"]).agg(n=("slot", "size"), size=("bucket_length", "first"), last=("slot", "max"))
    assert ((batches["n"] * batches["size"] <= 600) | (batches["n"] == 1)).all()
    assert (batches["last"] == batches["n"] - 1).all()
    per = got.groupby("bucket").agg(n=("slot", "size"), size=("bucket_length", "first"), batches=("batch", "nunique"))
    assert (per["batches"] == np.ceil(per["n"] / np.maximum(1, 600 // np.maximum(per["size"], 1)))).all()
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


def test_long_lengths_have_bounds_of_their_own(spark):
    rows = [(None, None, "s", n) for n in (3, 4097, 70_001, 70_003, 1_000_003)] + [(None, None, "s", 3)] * 300
    docs = spark.createDataFrame(rows, DOCS)
    got = packing.pack(docs, buckets=5, length=F.col("size")).toPandas()
    assert len(got) == len(rows) and (got["padding"] == 0).all()
    four = packing.pack(docs, buckets=4, length=F.col("size")).toPandas()
    assert four["padding"].sum() == 2
    assert sorted(got.loc[got["n_tokens"] == 3, ["batch", "slot"]].itertuples(index=False)) == [divmod(k, 65536 // 3) for k in range(301)]
