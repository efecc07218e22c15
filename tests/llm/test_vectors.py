"""Approximate neighbours and centroid clustering held against plain loops."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from gridloom.llm import centroids, neighbours

KIND = "vec_id long, embedding array<float>, label int, leaf int, q long"


def rows_of(seed, n, dims):
    """Clusters, many copies of one vector, ties, and every odd case."""
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(6, dims))
    made = [(100 + k, (c[k % 6] + 0.4 * rng.normal(size=dims)).astype(np.float32).tolist()) for k in range(n)]
    hot = made[3][1]
    made += [(5000 + k, hot) for k in range(n // 2)]
    made += [(9000 + k, [float(k == j) for j in range(dims)]) for k in range(3)]  # equally far from each other
    made += [(9100, None), (9200, [0.0] * dims), (9300, [1.0] * (dims - 1)), (9400, [None] + [1.0] * (dims - 1)), (9500, [math.nan] + [1.0] * (dims - 1)), (9600, [math.inf] + [1.0] * (dims - 1))]
    made += [(None, hot), made[5], made[5], (made[5][0], made[6][1])]
    random.Random(seed).shuffle(made)
    return [(i, v, 1, 2, 3) for i, v in made]


def plain_neighbours(rows, dims, every, k):
    good = {(i, tuple(v)) for i, v, *_ in rows if i is not None and v and len(v) == dims and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good], float)
    out = {}
    for i, v in good:
        if i % every == 0:
            far = np.sqrt(((x - np.array(v, float)) ** 2).sum(1))
            out.setdefault(i, []).extend(sorted((d, j) for d, j in zip(far.tolist(), ids.tolist(), strict=True) if j != i)[:k])
    return out


@pytest.mark.parametrize("leaf", [8, 100_000])
def test_neighbours(spark, leaf):
    rows = rows_of(1, 900, 8)
    df = spark.createDataFrame(rows, KIND).repartition(5)
    index = neighbours.build(df, 8, 11, leaf=leaf)
    found_of_sample = neighbours.calibrate(index, df, 10)
    assert found_of_sample >= neighbours.RECALL
    got = {}
    for r in neighbours.search(index, df.where("vec_id % 20 = 0"), 10).collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id, r["rank"]))
    want = plain_neighbours(rows, 8, 20, 10)
    assert got.keys() == want.keys()
    hit = total = 0
    for q, found in got.items():
        found.sort(key=lambda x: x[2])
        assert [x[2] for x in found] == [*range(1, 11)] and found == sorted(found)
        truth = {j: d for d, j in want[q]}
        hit, total = hit + sum(j in truth and abs(truth[j] - d) < 1e-12 for d, j, _ in found), total + len(truth)
    assert hit >= 0.9 * total
    if leaf == 100_000:  # one leaf: the search is exact
        assert hit == total


def test_neighbours_of_the_table(spark):
    """The query itself against brute force over the whole table."""
    folder = "/root/testdata/sf0.01"
    got = {}
    for r in neighbours.op11_neighbours(spark, folder).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want = {q: {j for _, j in near} for q, near in plain_neighbours(rows, 64, 100, 10).items()}
    assert got.keys() == want.keys() and sum(len(got[q] & want[q]) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_all_candidates_where_there_are_few(spark):
    rows = [(100 * k, [float(k), 1.0], 0, 0, 0) for k in range(5)]
    df = spark.createDataFrame(rows, KIND)
    index = neighbours.build(df, 2, 11, leaf=1)
    neighbours.calibrate(index, df, 10)
    got = neighbours.search(index, df, 10).collect()
    assert len(got) == 20 and {(r.query_id, r["rank"], r.vec_id, r.score) for r in got if r.query_id == 0} == {(0, k, 100 * k, float(k)) for k in range(1, 5)}
    empty = df.where("vec_id < 0")
    index = neighbours.build(empty, 2, 11)
    assert neighbours.calibrate(index, empty, 10) == 1 and neighbours.search(index, df, 10).count() == 0
    assert neighbours.search(neighbours.build(df, 2, 11), empty, 10).count() == 0


def test_large_leaves_are_split(spark, monkeypatch):
    """Pieces smaller than a leaf, blocks smaller than the queries of a piece: the same rows."""
    monkeypatch.setattr(neighbours, "PIECE", 16)
    monkeypatch.setattr(neighbours, "BLOCK", 8)
    rows = rows_of(2, 300, 4)
    df = spark.createDataFrame(rows, KIND)
    index = neighbours.build(df, 4, 11, leaf=100_000)
    assert index.leaves.pieces.max() > 1
    neighbours.calibrate(index, df, 10)
    got = {}
    for r in neighbours.search(index, df.where("vec_id % 10 = 0"), 10).collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    for q, near in plain_neighbours(rows, 4, 10, 10).items():
        assert [j for _, j in sorted(got[q])] == [j for _, j in near]


def test_best_bin_first():
    tree = neighbours.Tree.fit(np.random.default_rng(0).normal(size=(500, 3)), 10)
    leaves = tree.in_order()
    assert len(leaves) > 50
    seen = [*tree.visited(np.zeros(3))]
    assert sorted(seen) == sorted(leaves) and seen[0] == tree.leaf_of(np.zeros((1, 3)))[0]
    near = ((tree.centres[seen] ** 2).sum(1)).argsort()
    assert {*near[:10]} & {*range(15)} == {*near[:10]}  # the nearest bins come early


def plain_clusters(rows, dims, k, rounds, scale):
    kept = [(i, [math.floor(float(x) * scale) for x in v]) for i, v, *_ in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    hashed = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    cents = [v for _, v in sorted(kept, key=hashed)[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    assign = lambda: [min((far(v, c), j) for j, c in enumerate(cents)) for _, v in kept]
    for _ in range(rounds):
        near = assign()
        for j in range(len(cents)):
            own = [v for (_, v), (_, c) in zip(kept, near, strict=True) if c == j]
            if own:
                cents[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    near = assign()
    sums = [sum(d for d, c in near if c == j) for j in range(len(cents))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, c, d, sums[c], sum(sums), sha[c]) for (i, _), (d, c) in zip(kept, near, strict=True)), key=str)


@pytest.mark.parametrize(("n", "dims", "rounds"), [(300, 8, 10), (10, 8, 3), (60, 1, 0)])
def test_clusters(spark, n, dims, rounds, monkeypatch):
    monkeypatch.setattr(centroids, "BLOCK", 50)
    rows = rows_of(n, n, dims)
    df = spark.createDataFrame(rows, KIND).repartition(3)
    got = centroids.cluster(df, 8, rounds, dims)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_clusters(rows, dims, 8, rounds, 1024)


def test_clusters_of_none_and_of_huge_numbers(spark):
    df = spark.createDataFrame([(1, [1e30] * 3, 0, 0, 0), (2, [-1e30] * 3, 0, 0, 0), (3, [0.5] * 3, 0, 0, 0)], KIND)
    got = {r.vec_id: r for r in centroids.cluster(df, 1, 0, 3).collect()}
    assert len(got) == 3 and max(r.distance for r in got.values()) <= 3 * (2 * centroids.MOST) ** 2
    assert centroids.cluster(df.where("vec_id < 0"), dims=3).count() == 0
    assert centroids.cluster(df, dims=4).count() == 0
    few = centroids.cluster(df.where("vec_id = 3"), dims=3).collect()
    assert [(r.cluster, r.distance, r.inertia) for r in few] == [(0, 0, 0)]


def test_clusters_by_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    want = con.execute(centroids.OP12_SQL).fetchall()
    cols = [d[0] for d in con.description]
    got = centroids.op12_centroids(spark, folder)
    assert got.columns == cols and sorted(map(tuple, got.collect())) == sorted(want)
