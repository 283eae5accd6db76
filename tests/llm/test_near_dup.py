import random
import re

import numpy as np

from tidewright.llm import kernels, near_dup

SCHEMA = "doc_id long, text string, key string, component string"


def shingles(text, width):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower() if text is None or text.isascii() else text.encode())
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows, width, percent=80):
    sets = [(d, shingles(t, width)) for d, t in rows]
    up = {d: d for d, _ in sets if d is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and a is not None and b is not None and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    out = []
    for d, s in sets:
        c = root(d) if d is not None else None
        out.append((d, len(s), c, d == c))
    return sorted(out, key=str)


def given(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for d in range(40):
        rows.append((d, " ".join(rng.choices(words, k=rng.randint(1, 90)))))
    for d in range(40, 110):
        base = rng.choice(rows)[1].split()
        for _ in range(rng.choice([0, 1, 1, 2, 3, 8])):
            base[rng.randrange(len(base))] = rng.choice(words)
        rows.append((d, " ".join(base)))
    rows += [(200, None), (201, ""), (202, "  \t"), (203, "one"), (204, "ONE"), (205, "one two"), (None, rows[0][1]), rows[4]]
    rng.shuffle(rows)
    return rows


def test_matches_brute_force(spark):
    for seed, width in ((1, 2), (2, 5)):
        rows = given(seed)
        df = spark.createDataFrame([(d, t, "k", "c") for d, t in rows], SCHEMA).repartition(3)
        got = sorted((tuple(r) for r in near_dup.group(df, width=width).collect()), key=str)
        assert got == brute(rows, width)


def test_a_repeated_id_has_the_links_of_all_its_texts(spark):
    words = [[f"t{k}x{j}" for j in range(40)] for k in range(9)]
    near = lambda k, n: " ".join([*words[k][:-1], f"n{n}"])
    rows = [(5, " ".join(words[k])) for k in range(8)] + [(10 + k, near(k, k)) for k in range(8)]  # eight texts under one id, a near copy of each
    rows += [(3, " ".join(words[8])), (20, " ".join(words[8])), (20, near(7, 20))]  # an id in two classes of others
    rows += [(30, "alone in the world"), (30, "other words of it")]
    df = spark.createDataFrame([(d, t, "k", "c") for d, t in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in near_dup.group(df, width=2).collect()), key=str)
    assert got == brute(rows, 2)
    assert {c for d, _, c, _ in got if d not in (30,)} == {3}


def test_keep_one(spark):
    rows = given(3)
    df = spark.createDataFrame([(d, t, "k", "c", 1) for d, t in rows] + [(None, "n n", "k", "c", 1)] * 2, SCHEMA + ", _near_dup_id int")
    kept = near_dup.keep_one(df.withColumnRenamed("_near_dup_id", "_id"), width=2)
    assert kept.columns == ["doc_id", "text", "key", "component", "_id"]
    assert sorted(r["text"] for r in kept.filter("doc_id IS NULL").collect()) == sorted([rows[[d for d, _ in rows].index(None)][1], "n n"])
    assert sorted(r["doc_id"] for r in kept.filter("doc_id IS NOT NULL").collect()) == sorted({x[0] for x in brute(rows, 2) if x[3] and x[0] is not None})


def test_empty_table(spark):
    assert near_dup.group(spark.createDataFrame([], SCHEMA)).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 62, 800, dtype=np.uint64), rng.integers(0, 1 << 62, 200, dtype=np.uint64)
    sets = [a, np.concatenate([a[:700], b]), a[:3]]
    doc = np.repeat(np.arange(3), [len(s) for s in sets])
    found = near_dup.superminhash(doc, np.concatenate(sets), 3)
    assert abs((found[0] == found[1]).mean() - 0.7) < 0.15
    assert (found[2] != 0xFFFFFFFF).all()
    alone = near_dup.superminhash(np.zeros(3, np.int64), a[:3], 1)
    assert (alone[0] == found[2]).all()


def test_steps_of_an_element_are_a_permutation():
    one = near_dup.superminhash(np.zeros(1, np.int64), np.array([5], np.uint64), 1)[0]
    assert sorted(one >> 24) == list(range(near_dup.SLOTS))


def test_bands_are_the_same_alone_and_together():
    s = np.random.default_rng(2).integers(0, 1 << 20, (4, near_dup.SLOTS)).astype(np.uint32)
    assert (near_dup.bands(s)[2] == near_dup.bands(s[2:3])[0]).all()
    assert kernels.mix(np.array([3], np.uint64))[0] != 3


def test_stars_and_long_chains(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "HUB_ROWS", 2)
    monkeypatch.setattr(near_dup, "HUB_SHARE", 0.0)
    monkeypatch.setattr(near_dup, "FOREST", 5)
    edges = [(0, k) for k in range(1, 60)] + [(k, 1000) for k in range(100, 160)] + [(k, k + 1) for k in range(200, 240)] + [(500, 500)]
    rng = random.Random(4)
    rng.shuffle(edges)
    found = near_dup.components(spark.createDataFrame([e[:: rng.choice((1, -1))] for e in edges], "a long, b long").repartition(7))
    want = {k: 0 for k in range(1, 60)} | {k: 100 for k in [*range(101, 160), 1000]} | {k: 200 for k in range(201, 241)}
    assert {r["node"]: r["component"] for r in found.collect()} == want and found.count() == len(want)


def test_one_text_with_very_many_near_copies(spark, monkeypatch):
    for name, size in (("HUB_ROWS", 4), ("PART_PAIRS", 5), ("BLOCK", 8)):
        monkeypatch.setattr(near_dup, name, size)
    words = [f"w{j}" for j in range(60)]
    rows = [(k, " ".join([*words[:-1], f"n{k}"])) for k in range(40)] + [(100 + k, " ".join(f"v{k}x{j}" for j in range(30))) for k in range(5)]
    df = spark.createDataFrame([(d, t, "k", "c") for d, t in rows], SCHEMA).repartition(3)
    assert sorted((tuple(r) for r in near_dup.group(df, width=2).collect()), key=str) == brute(rows, 2)


def test_gives_the_rows_of_its_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    assert sorted(tuple(r) for r in near_dup.query(spark, sf_dir).collect()) == sorted(con.sql(near_dup.SQL).fetchall())
