"""Whitening, top-k search and the prefix trie, against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspan.llm import prefix_trie as pt
from veilspan.llm import queries, top_k, whitening

EMBEDDINGS = "vec_id long, embedding array<float>, label int"


def tables(spark, tmp_path, **rows):
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def vectors(n, dim, seed=3):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, dim)) @ rng.normal(size=(dim, dim))).astype(np.float32)


BAD = [(900, None, 1), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (902, [float("nan")] + [0.0] * 5, 1),
       (903, [float("inf")] + [0.0] * 5, 1), (904, [], 1), (905, [1.0, 2.0], None)]


def test_whitening_query(spark, tmp_path):
    x = vectors(200, 6)
    ids = list(range(199)) + [7]  # an id that repeats
    rows = [(i, [float(c) for c in v], None) for i, v in zip(ids, x)] + [(None, [float(c) for c in x[3]], 1)]
    d = tables(spark, tmp_path, embeddings=(rows + BAD, EMBEDDINGS))
    got = queries.op11_whitening(spark, d).toPandas()
    full = np.floor(64 * np.array([r[1] for r in rows]).astype(np.float32).astype(np.float64)).astype(np.int64) + 1000000
    n, sums = len(full), full.sum(axis=0)
    centred = (n * full - sums) / n
    covariance = centred.T @ centred / n
    values, vecs = np.linalg.eigh(covariance)
    values, vecs = values[::-1], vecs[:, ::-1]
    assert len(got) == n * 6 and set(got["n"]) == {n} and set(got["component"]) == set(range(1, 7))
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9
    expected = centred @ vecs / np.sqrt(values)
    deviation = ((n * full - sums) ** 2).sum(axis=1)
    for c in range(6):
        part = got[got["component"] == c + 1]
        assert np.allclose(part["explained"], values[c] / values.sum(), rtol=1e-9)
        sign = 1 if abs(sorted(part["whitened"])[0] - sorted(expected[:, c])[0]) < 1e-6 else -1
        want = sorted(zip((-1 if r[0] is None else r[0] for r in rows), deviation, sign * expected[:, c]))
        have = sorted(zip(part["vec_id"].fillna(-1).astype(int), part["deviation"], part["whitened"]))
        assert [w[:2] for w in want] == [h[:2] for h in have]
        assert np.allclose([w[2] for w in want], [h[2] for h in have], atol=1e-8)


def test_whitening_of_doubles_keeps_columns(spark):
    x = vectors(3000, 5)
    df = spark.createDataFrame([(i, [float(c) for c in v], "a", i) for i, v in enumerate(x)],
                               "at long, _x array<double>, whitened string, `_row` long")
    found = whitening.whiten(df, "_x", 2)
    got = found.rows.toPandas().sort_values("at")
    assert list(found.rows.columns) == ["at", "_x", "_row", "whitened"]
    z = np.stack(got["whitened"].to_numpy())
    assert z.shape == (3000, 2) and np.abs(np.cov(z.T, bias=True) - np.eye(2)).max() < 1e-9
    assert found.identity_error < 1e-9 and list(got["_row"]) == list(got["at"])


def test_whitening_over_many_blocks_and_without_variance(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS_PER_BLOCK", 16)
    x = np.round(vectors(300, 4) * 8).astype(int)
    x[:, 3] = 5  # a dimension that never varies
    df = spark.createDataFrame([(i, [int(c) for c in v]) for i, v in enumerate(x)], "id long, v array<int>")
    found = whitening.whiten(df, "v")
    assert len(found.eigenvalues) == 3 and found.sums == [int(s) for s in x.sum(axis=0)]
    assert np.allclose(found.eigenvalues, np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1][:3])
    same = whitening.whiten(df.select("id", F.array(F.lit(1), F.lit(2)).alias("v")), "v")
    assert same.rows.filter(F.size("whitened") > 0).count() == 0 and same.rows.count() == 300
    assert whitening.whiten(df.limit(0), "v") is None


@pytest.mark.parametrize("rows", [[], [(5, [1.0, 2.0], 1)], [(5, [1.0], 1), (5, [1.0], 1)], BAD[:4]])
def test_whitening_of_little(spark, tmp_path, rows):
    d = tables(spark, tmp_path, embeddings=(rows, EMBEDDINGS))
    out = queries.op11_whitening(spark, d)
    assert out.collect() == [] and out.columns == [c.split()[0] for c in queries.WHITENED.split(", ")]


def plain_top(rows, k, asks):
    out = []
    good = [(i, v) for i, v in rows if i is not None and v is not None and None not in v]
    for at, (i, v) in enumerate(good):
        if asks(i):
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for b_at, (j, w) in enumerate(good) if b_at != at)
            out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("case", ["dense", "copies", "small", "ragged"])
def test_top_k(spark, monkeypatch, case):
    monkeypatch.setattr(top_k, "BLOCK", 40)
    monkeypatch.setattr(top_k, "QUERY_BLOCK", 8)
    monkeypatch.setattr(top_k, "BLOCKS_TOGETHER", 2)
    rng = random.Random(4)
    rows = {
        "dense": [(i, [rng.randrange(-300, 300) for _ in range(12)]) for i in range(400)],
        # A third are one vector, others near it; ids repeat, with equal and with other vectors.
        "copies": [(i % 290, [7, -3, 2, 9] if i % 3 == 0 else [rng.randrange(-2, 3) for _ in range(4)])
                   for i in range(400)],
        "small": [(i, [i, -i]) for i in range(3)],
        "ragged": [(0, None), (5, [1, None]), (10, []), (20, [0, 0, 0]), (30, [-1]), (None, [1, 2]), (7, [4, 5]),
                   (8, [-4, 2, 9]), (10, [3, 3])],
    }[case]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "id long, v array<int>, `key` string").repartition(5)
    got = top_k.top_k(df, F.col("id") % 5 == 0, "id", "v", 4)
    assert got.columns == ["query_id", "rank", "id", "score"]
    assert sorted(map(tuple, got.collect())) == plain_top(rows, 4, lambda i: i % 5 == 0)


def test_top_k_of_large_numbers_and_nothing(spark):
    big = 1 << 30
    rows = [(i, [big + i, -big, i]) for i in range(6)]
    df = spark.createDataFrame(rows, "id long, v array<long>")
    assert sorted(map(tuple, top_k.top_k(df, F.col("id") < 2, "id", "v", 3).collect())) == plain_top(
        rows, 3, lambda i: i < 2)
    assert top_k.top_k(df.limit(0), F.col("id") < 2, "id", "v").collect() == []
    assert top_k.top_k(df, F.lit(False), "id", "v").collect() == []
    with pytest.raises(Exception, match="do not fit"):
        top_k.top_k(df.select("id", F.array(F.lit(1 << 62)).alias("v")), F.col("id") < 2, "id", "v").collect()


def test_copies_of_queries_are_not_broadcast(spark, tmp_path):
    rows = spark.range(40).select(F.col("id").alias("class_id"), F.col("id").alias("first"),
                                  F.array(F.col("id"), -F.col("id"), F.lit(70000)).alias("vector"))
    blocks = []
    for name, n in (("c", 10), ("q", 5)):
        top_k.blocks_of(rows.coalesce(1), n, 3).write.parquet(f"{tmp_path}/{name}")
        blocks.append(spark.read.parquet(f"{tmp_path}/{name}"))
    asked = blocks[1].select("slice", F.col("block").alias("q"), F.col("n").alias("q_n"), F.col("data").alias("q_data"))
    met = top_k._meetings(asked, blocks[0], 500)
    # What Spark expects of 500 copies of each query is the size of one.
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    pairs = met.select("q", "c", "slice").collect()
    assert len(pairs) == len(set(pairs)) == 8 * 4 * 2


def test_top_k_of_some_queries_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(top_k, "QUERY_BLOCK", 4)
    monkeypatch.setattr(top_k, "ROUND", 0, raising=False)
    rounds, one = [], getattr(top_k, "_round", None)

    def watched(*given):
        rounds.append(one(*given))
        return rounds[-1]

    monkeypatch.setattr(top_k, "_round", watched, raising=False)
    rng = random.Random(9)
    rows = [(i, [rng.randrange(-90, 90) for _ in range(5)]) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, v array<int>").coalesce(1)
    got = top_k.top_k(df, F.col("id") % 6 == 0, "id", "v", 3)
    assert sorted(map(tuple, got.collect())) == plain_top(rows, 3, lambda i: i % 6 == 0)
    assert len(rounds) > 1 and all(n > 0 for _, n in rounds)


@pytest.mark.parametrize("most", [0, 200, 40000, 1 << 40])
def test_integers_in_few_bytes(most):
    x = np.array([[most, -most, 1], [0, 3, -most - 1]])
    data = top_k._narrow(x)
    assert len(data) == 6 * (2 if most < 1 << 15 else 4 if most < 1 << 31 else 8)
    assert (top_k._matrix(data, 2, 3) == x).all() and top_k._matrix(b"", 2, 0).shape == (2, 0)


def test_top_k_query(spark, tmp_path):
    x = vectors(120, 6)
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(x)]
    d = tables(spark, tmp_path, embeddings=(rows + BAD, EMBEDDINGS))
    plain = [(i, [int(np.floor(np.float64(np.float32(c)) * 256)) for c in v]) for i, v, _ in rows + [BAD[4], BAD[5]]]
    got = sorted(map(tuple, queries.op12_top_k(spark, d).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == plain_top(plain, 5, lambda i: i % 50 == 0)


def plain_trie(rows, families=True):
    conv = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            conv[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in conv.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        first = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        made[c] = own.get(first, [])[:h] + turns[h:] if families else turns
    members, children = defaultdict(list), defaultdict(set)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for n in members:
        if n:
            children[n[:-1]].add(n)
    saved, leaves = defaultdict(int), defaultdict(int)
    for n in members:
        for d in range(len(n) + 1):
            saved[n[:d]] += (len(members[n]) - 1) * len(n[-1][1].encode()) if n else 0
            leaves[n[:d]] += not children[n]
    return sorted(((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), leaves[n], saved[n],
                    hashlib.sha256(",".join(str(c) for c in sorted(m) if len(made[c]) == len(n)).encode())
                    .hexdigest()) for n, m in members.items()), key=str)


def conversations(case):
    rng = random.Random(5)
    if case == "families":
        return [(c, t, rng.choice(["user", "bot"]), rng.choice("ab") * 3) for c in range(-12, 120)
                for t in range(rng.randrange(1, 12))]
    if case == "copies":  # a third are one conversation, many share its first turn
        return [(c * 7, t, "user", "same" if c % 3 == 0 or t == 0 else f"{c % 11} é{t}")
                for c in range(200) for t in range(4)]
    if case == "long":  # one conversation holds most rows
        return [(1, t, "user", f"t{t % 7}") for t in range(300)] + [(c, t, "user", f"t{t % 7}")
                                                                     for c in (0, 2, 30) for t in range(40)]
    return [(1, None, None, None), (1, 2, "user", "b"), (1, 2, "bot", "a"), (None, 1, "user", "x"), (3, 1, "", ""),
            (1 << 62, 1, "user", "x"), (5, 0, "user", "")]


@pytest.mark.parametrize("case", ["families", "copies", "long", "nulls"])
def test_trie_query(spark, tmp_path, monkeypatch, case):
    monkeypatch.setattr(pt, "PART", 16)
    rows = conversations(case)
    schema = "conv_id long, turn long, role string, text string"
    rng = random.Random(6)
    d = tables(spark, tmp_path, conversations=(rng.sample(rows, len(rows)), schema))
    got = queries.op13_prefix_trie(spark, d)
    assert sorted(map(tuple, got.collect()), key=str) == plain_trie(rows)


def test_trie_without_families_and_clashing_names(spark):
    rows = conversations("copies")
    df = spark.createDataFrame([(*r, 1, 2) for r in rows],
                               "conv long, depth long, t1 string, size string, x1 long, `_part` long")
    found = pt.prefix_trie(df, "conv", "depth", "t1", "size")
    got = found.nodes.join(pt.ends_digest(found.ends), list(pt.NODE), "left").select(
        "conv", "depth", "parent_conv", "n_convs", "n_children", "n_leaves", "saved",
        F.coalesce("ends_sha256", F.lit(queries.NOBODY)))
    assert sorted(map(tuple, got.collect()), key=str) == plain_trie(rows, families=False)
    empty = pt.prefix_trie(df.limit(0), "conv", "depth", "t1", "size")
    assert empty.nodes.collect() == [] and pt.ends_digest(empty.ends).collect() == []


def test_trie_of_a_very_long_turn(spark):
    text = "ü" * 3_000_000
    df = spark.createDataFrame([(1, 1, "user", text), (2, 1, "user", text), (2, 2, "user", "b")],
                               "conv_id long, turn long, role string, text string")
    top = pt.prefix_trie(df).nodes.filter("depth = 0").first()
    assert (top.n_convs, top.n_children, top.n_leaves, top.saved) == (2, 1, 1, 6_000_000)
