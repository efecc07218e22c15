"""Operators on hand-made rows; order of the input and number of partitions change nothing."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import consensus, matching, merging, metrics, quality, review, splits, timeline, vectors


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def same_in_any_order(df, apply):
    a = rows(apply(df.repartition(1)))
    assert a == rows(apply(df.orderBy(F.rand(3)).repartition(8)))
    return a


def test_board_measures_without_occupied_cell(spark):
    df = spark.createDataFrame([("a", 64, 64, 0, 0), ("b", 60, 62, 10, 9)], "g string, correct int, occupancy_correct int, occupied int, piece_correct int")
    got = {r["g"]: r for r in metrics.with_overall(df, "g", *metrics.board_measures()).collect()}
    assert math.isnan(got["a"]["piece_rate"]) and got["b"]["piece_rate"] == 0.9 and got["overall"]["n"] == 2 and got["overall"]["within_3"] == 0.5 and got["overall"]["within_5"] == 1.0


def test_nearest_rank_takes_the_upper_of_ten(spark):
    df = spark.createDataFrame([("k", float(v)) for v in range(1, 11)] + [("one", 3.0)], "k string, v double")
    assert same_in_any_order(df, lambda d: metrics.nearest_rank(d, "k", "v", [0.5, 1.0])) == [("k", 0.5, 6.0), ("k", 1.0, 10.0), ("one", 0.5, 3.0), ("one", 1.0, 3.0)]


def test_monotone_drops_and_recovers(spark):
    plies = [0, 5, 4, 1, 6, 3, 7, 40, 8, 41]
    df = spark.createDataFrame([("g", i, float(p)) for i, p in enumerate(plies)], "g string, t int, ply double")
    kept, top = [], -1
    for p in plies:
        if p >= top - 2:
            kept.append(p)
            top = max(top, p)
    assert [r[2] for r in sorted(same_in_any_order(df, lambda d: timeline.monotone(d, ["g"], ["t"], "ply")), key=lambda r: r[1])] == kept


def test_keep_best_null_margin_and_full_tie(spark):
    df = spark.createDataFrame([(1, 3.0), (2, None), (3, None), (4, 9.0)], "pos int, margin double").withColumn("g", F.lit("x"))
    assert [r["pos"] for r in timeline.keep_best(df, ["g"], [F.col("margin").desc_nulls_first(), F.col("pos")]).collect()] == [2]


def test_range_join_is_the_plain_one(spark):
    left = spark.createDataFrame([("a", i, x) for i, x in enumerate([-3.5, 0.0, 2.0, 9.99, 10.0, 31.0])] + [("a", 9, None)], "k string, i int, x double")
    right = spark.createDataFrame([("a", j, lo, hi) for j, (lo, hi) in enumerate([(-4.0, 0.0), (2.0, 2.0), (5.0, 30.0), (7.0, 6.0), (10.0, 31.0)])] + [("a", 9, None, 1.0)], "k string, j int, lo double, hi double")
    plain = {(r["i"], r["j"]) for r in left.join(right, "k").where("x between lo and hi").collect()}
    assert {(r["i"], r["j"]) for r in timeline.range_join(left, right, ["k"], "x", "lo", "hi", 4.0).collect()} == plain and plain


def test_spaced_and_frames(spark):
    df = spark.range(23).withColumn("g", F.lit(1))
    assert sorted(r["id"] for r in timeline.spaced(df, ["g"], ["id"], 10).collect()) == [int(i * 23 / 10) for i in range(10)]
    assert timeline.spaced(df, ["g"], ["id"], 40).count() == 23
    s = spark.createDataFrame([(0, 100), (7, 8), (3, 3)], "a long, b long")
    assert sorted((r["a"], r["frame"]) for r in timeline.sample_frames(s, "a", "b", 30, 2).collect()) == [(0, 12), (0, 37), (0, 62), (0, 87), (3, 3), (7, 7)]


def test_oriented_before_unordered(spark):
    df = spark.createDataFrame([(1, "x", True, True), (1, "y", False, True), (2, "z", False, True), (2, "w", False, False)], "o int, g string, oriented boolean, unordered boolean")
    assert [(r["o"], r["g"]) for r in matching.oriented_else_unordered(df, ["o"]).orderBy("o").collect()] == [(1, "x"), (2, "z")]


def test_hamming_nearest_is_exact(spark):
    import random

    r = random.Random(2)
    known = [(k, [r.randrange(3) for _ in range(64)]) for k in range(30)]
    obs = []
    for i in range(30):
        cells = [*known[i][1]]
        for at in r.sample(range(64), i % 12):
            cells[at] = (cells[at] + 1) % 3
        obs.append((i, cells))
    want = {}
    for i, c in obs:
        d, k = min((sum(x != y for x, y in zip(c, q, strict=True)), k) for k, q in known)
        want[i] = (k, d) if d <= 6 else (None, None)
    got = matching.hamming_nearest(spark.createDataFrame(obs, "obs_id int, cells array<int>"), spark.createDataFrame(known, "known_id int, cells array<int>"), 6)
    assert {r["obs_id"]: (r["known_id"], r["diff"]) for r in got.collect()} == want


def gate(spark, candidates):
    return {r["f"]: r for r in consensus.gate(spark.createDataFrame(candidates, "f int, ply int, placement string, score double, fit int"), "f").collect()}


def test_gates(spark):
    got = gate(spark, [(1, 3, "a", -1.0, 2), (1, 4, "b", -9.0, 20), (2, 3, "a", -1.0, 2), (2, 9, "a", -1.0, 2), (3, 1, "a", -1.0, 9), (3, 2, "b", -2.0, 9), (4, 1, "a", -1.0, 4), (4, 2, "b", -2.0, 9), (5, 7, "a", -2.0, 1), (5, 2, "b", -2.0, 9)])
    assert [(got[k]["bucket"], got[k]["margin"], got[k]["repetition"]) for k in range(1, 5)] == [("accept", 8.0, False), ("accept", None, True), ("quarantine", 1.0, False), ("review", 1.0, False)]
    assert got[5]["ply"] == 2 and got[5]["margin"] == 0.0


def test_score_window_counts_only_where_candidates_differ(spark):
    frames = spark.createDataFrame([(1, [[-1.0, -2.0], [-3.0, -0.5]])], "f int, log_probs array<array<double>>")
    candidates = spark.createDataFrame([(1, 0, [0, 1]), (1, 1, [0, 0])], "f int, ply int, cells array<int>")
    assert rows(consensus.score_window(frames, candidates, "f")) == [(1, 0, 0, -0.5), (1, 1, 1, -3.0)]


def test_quality(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, v string"), spark.createDataFrame([(2, "z"), (3, None), (4, "w")], "k int, v string")
    assert rows(quality.difference(a, b, "k", "v")) == [(1, "missing"), (2, "changed"), (4, "unexpected")]
    assert rows(quality.violations(a, "k", {"is x": F.col("v") == "x"})) == [(2, "is x"), (3, "is x")]
    with pytest.raises(Exception, match="rule broken: is x"):
        quality.validate(a, {"is x": F.col("v") == "x"}).collect()
    assert rows(quality.straddling(spark.createDataFrame([("g", "train"), ("g", "val"), ("h", "val")], "g string, s string"), "g", "s")) == [("g", 2)]


def test_merges(spark):
    old = spark.createDataFrame([(1, 1, 10), (2, 1, 11), (3, 2, 12), (4, 3, 13)], "key int, frame int, pos int")
    fresh = spark.createDataFrame([(1, 3, 0)], "key int, frame int, pos int")
    assert rows(merging.salvage(old, fresh, ["key"], ["frame"], "pos")) == [(2, 1, 11), (3, 2, 12)]
    once = merging.upsert(old, fresh, ["key"])
    assert rows(once) == rows(merging.upsert(once, fresh, ["key"]))
    assert rows(merging.insert_absent(old, fresh, ["key"])) == rows(old)
    log = spark.createDataFrame([("a", 1, 5), ("a", 3, 6), ("a", 2, 7)], "k string, seq int, v int")
    assert rows(merging.last_write(log, ["k"], "seq")) == [("a", 3, 6)]


def test_turns_keep_the_ratio():
    first = splits.turns(100, (60, 30, 10))
    assert [first.count(s) for s in splits.SPLITS] == [60, 30, 10] and splits.turns(40, (60, 30, 10)) == first[:40]
    with pytest.raises(ValueError):
        splits.turns(3, (50, 40, 20))


def test_split_plan_keeps_groups_and_what_was_assigned(spark):
    df = spark.createDataFrame([(f"s{k}", f"g{k % 17}") for k in range(200)], "id string, g string")
    given = spark.createDataFrame([("s0", "test"), ("s17", "test"), ("s34", "val")], "id string, split string")
    plan = {r["id"]: r["split"] for r in splits.plan(df, "g", "id", 3, existing=given).collect()}
    assert len(plan) == 200 and plan["s34"] == "val" and plan["s51"] == "test"
    by_group = {}
    for k in range(200):
        if f"s{k}" not in ("s0", "s17", "s34"):
            by_group.setdefault(k % 17, set()).add(plan[f"s{k}"])
    assert all(len(s) == 1 for s in by_group.values())
    assert plan == {r["id"]: r["split"] for r in splits.plan(df.orderBy(F.rand(5)), "g", "id", 3, existing=given).collect()}


def test_vectors(spark):
    df = spark.createDataFrame([(0, 0, [1.0, 0.0]), (1, 0, [0.8, 0.6]), (2, 1, [0.0, 1.0]), (3, 1, [0.0, 0.0])], "vec_id long, label int, embedding array<double>")
    cents = vectors.centroids(df, "label")
    got = {r["vec_id"]: r["best"]["label"] for r in vectors.nearest_centroid(df, cents, "label").collect()}
    assert got[0] == 0 and got[2] == 1 and got[3] == 0  # a tie goes to the least key
    clusters = {r["cluster"]: r["n"] for r in vectors.leader_clusters(df, "vec_id", "embedding", 0.3).collect()}
    assert clusters == {0: 2, 2: 1}
    score = {r["vec_id"]: (r["neighbours"], r["score"]) for r in vectors.neighbour_score(df.where("vec_id = 0"), df, 2).collect()}
    assert score == {0: (2, 0.0)}


def test_nearest_centroid_in_blocks(spark):

    r = np.random.default_rng(3)
    df = spark.createDataFrame([(k, r.normal(size=6).tolist(), k) for k in range(90)], "vec_id long, embedding array<double>, row int")
    cents = spark.createDataFrame([(k, v) for k, v in enumerate(np.eye(6).tolist())] + [(9, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0])], "label int, centroid array<double>")
    want = rows(vectors.nearest_centroid(df, cents, "label").select("vec_id", "row", "best.similarity", "best.label"))
    assert rows(vectors.nearest_centroid(df, cents, "label", most=3, block=2).select("vec_id", "row", "best.similarity", "best.label")) == want


def test_principal_axes(spark):

    x = np.random.default_rng(1).normal(size=(60, 4)) * [5, 2, 1, 0.1]
    mean, axes = vectors.principal_axes(spark.createDataFrame([(r.tolist(),) for r in x], "embedding array<double>"), 2)
    assert mean == pytest.approx(x.mean(0).tolist())
    want = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:2]
    assert np.abs(np.sum(want * axes, axis=1)) == pytest.approx([1, 1])


def led(items, most):
    """Greedy leaders over (vector sum, count, first), one after the other."""

    out = []
    for v, n, first in items:
        near = [v @ s / np.linalg.norm(s) / np.linalg.norm(v) for s, _, _ in out]
        at = int(np.argmax(near)) if near else -1
        if near and 1 - near[at] <= most:
            out[at] = (out[at][0] + v, out[at][1] + n, out[at][2])
        else:
            out.append((v, n, first))
    return out


def led_by_levels(vectors_, most, rows, fan):
    """vectors_ {id: vector}: pieces of consecutive ids, then pieces of pieces."""

    pieces = {}
    for k in sorted(vectors_):
        pieces.setdefault(k // rows, []).append((np.array(vectors_[k]) / np.linalg.norm(vectors_[k]), 1, k))
    n = max(vectors_) // rows + 1
    now = {p: led(items, most) for p, items in pieces.items()}
    while n > 1:
        up = {}
        for p in sorted(now):
            up.setdefault(p // fan, []).extend(now[p])
        now, n = {p: led(sorted(items, key=lambda x: x[2]), most) for p, items in up.items()}, -(-n // fan)
    return {first: (n, (s / np.linalg.norm(s)).tolist()) for s, n, first in now[0]}


@pytest.mark.parametrize("rows, fan", [(512, 16), (16, 2), (7, 3)])
def test_leader_clusters_by_plain_python(spark, rows, fan):

    r = np.random.default_rng(8)
    centres = r.normal(size=(6, 8))
    held = {k: (centres[k % 6] + 0.5 * r.normal(size=8)).tolist() for k in range(150)}
    df = spark.createDataFrame([*held.items(), (150, [0.0] * 8)], "vec_id long, embedding array<double>")
    got = {r["cluster"]: (r["n"], r["centroid"]) for r in vectors.leader_clusters(df, "vec_id", "embedding", 0.3, rows, fan).collect()}
    want = led_by_levels(held, 0.3, rows, fan)
    assert {k: n for k, (n, _) in got.items()} == {k: n for k, (n, _) in want.items()} and sum(n for n, _ in got.values()) == 150
    assert all(got[k][1] == pytest.approx(want[k][1], abs=1e-6) for k in got)


@pytest.mark.parametrize("rows", [1000, 400, 40])
def test_leaders_in_turn_by_plain_python(spark, rows):
    """Over more ids than one piece of leader_clusters() as one after the other, however many rows a piece has."""
    r = np.random.default_rng(8)
    held = {3 * k: v.tolist() for k, v in enumerate(r.normal(size=(600, 8)))}
    df = spark.createDataFrame([*held.items(), (5000, [0.0] * 8)], "vec_id long, embedding array<double>").orderBy(F.rand(2))
    got = {r["cluster"]: (r["n"], r["centroid"]) for r in vectors.leaders_in_turn(df, "vec_id", "embedding", 0.3, rows).collect()}
    want = {first: (n, s / np.linalg.norm(s)) for s, n, first in led([(np.array(v) / np.linalg.norm(v), 1, k) for k, v in held.items()], 0.3)}
    assert {k: n for k, (n, _) in got.items()} == {k: n for k, (n, _) in want.items()} and len(got) > 20
    assert all(got[k][1] == pytest.approx(want[k][1].tolist(), abs=1e-6) for k in got)


def test_cluster_queries_beyond_one_piece(spark, tmp_path):
    """The registered queries beside their SQL on ids far apart, where pieces of consecutive ids would differ."""
    import duckdb

    from gridloom.plans.registry import load

    queries, oracles = load()
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    e.withColumn("vec_id", F.col("vec_id") * 11).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    for name, key in (("leader_clusters", ["vec_id"]), ("suppressed_clusters", ["kind", "name"])):
        got, want = (f.sort_values(key).reset_index(drop=True) for f in (queries[name](spark, str(tmp_path)).toPandas(), duck.execute(oracles[name]).df()))
        for column in got:
            assert got[column].tolist() == pytest.approx(want[column].tolist(), abs=2e-4, nan_ok=True), (name, column)


@pytest.mark.parametrize("step, most", [(1, 40), (0.25, 12), (1, 20000)])
def test_identify_against_every_pair(spark, step, most):
    """Readings without names beside each place of their round: whole seconds, parts of them, and far apart."""
    from gridloom.operators import alignment

    r = np.random.default_rng(5)
    clock = lambda: None if r.random() < 0.1 else float(step * r.integers(0, most / step + 1))
    p = [(g % 2, g, ply, ["black", "white"][ply % 2], clock(), clock(), 1) for g in range(20) for ply in range(10)]
    o = [(k, k % 2, clock(), clock(), False) for k in range(150)]
    places = spark.createDataFrame(p, "g int, game int, ply int, turn string, white_clk double, black_clk double, increment int")
    read = spark.createDataFrame(o, "obs_id int, g int, white_obs double, black_obs double, names_read boolean")
    want = {}
    for k, g, *seen, _ in o:
        fits = []
        for at, game, ply, turn, white, black, _ in p:
            if at != g or None in (*seen, white, black):
                continue
            still, running, rec, now = (*seen, white, black) if turn == "black" else (*seen[::-1], black, white)
            after = [q[4 if turn == "white" else 5] for q in p if q[1] == game and q[2] == ply + 1]
            low = after[0] - 1 if after and after[0] is not None else 0
            if abs(still - rec) <= 2 and low - 3 <= running <= now + 3:
                fits.append((-0.5 * (1 - abs(still - rec) / 2), game, abs(still - rec), ply))
        want[k] = min(fits)[1:] if fits else (None, None, None)
    got = {x["obs_id"]: (x["game"], x["residual"], x["ply"]) for x in alignment.identify(read, places, ["g"]).collect()}
    assert got == want and (most > 100 or sum(game is not None for game, *_ in got.values()) > 50)


def test_identified_place_in_four_rounds(spark):
    """Games of a round are all those of one remainder, not a few neighbours."""
    from gridloom.plans.registry import load

    folder = "/root/testdata/sf0.001"
    own = {e["event_id"]: e["user_id"] for e in spark.read.parquet(f"{folder}/events.parquet").collect()}
    got = [(own[x["obs_id"]], x["game"]) for x in load()[0]["identified_place"](spark, folder).where("game is not null").collect()]
    assert all(a % 4 == b % 4 for a, b in got) and any(a != b for a, b in got)


def test_neighbour_score_in_slices_of_queries(spark, monkeypatch):
    """So many likenesses at once, whatever the number of queries; the same scores by slices of one query."""
    r = np.random.default_rng(2)
    df = spark.createDataFrame([(k, int(k % 2), r.integers(-2, 3, 3).astype(float).tolist()) for k in range(80)], "vec_id long, label int, embedding array<double>")
    got = lambda: sorted(map(tuple, vectors.neighbour_score(df, df, 5).collect()))
    want = got()
    monkeypatch.setattr(vectors, "CELLS", 1)
    assert got() == want == sorted(map(tuple, vectors.neighbour_score(df, df, 5, most_bytes=0).collect()))


def test_registered_cluster_queries_by_plain_python(spark):
    """leader_clusters and suppressed_clusters on a given table: assignment, tallies and clusters worked out here."""

    from gridloom.plans.registry import load

    folder, queries = "/root/testdata/sf0.001", load()[0]
    e = {r["vec_id"]: (r["label"], np.array(r["embedding"], float)) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    want = led_by_levels({k: v for k, (_, v) in e.items()}, 0.7, 512, 16)
    got = {r["vec_id"]: (r["cluster"], r["similarity"]) for r in queries["leader_clusters"](spark, folder).collect()}
    for k, (_, v) in e.items():
        sims = {c: round(float(v @ np.array(m)), 6) for c, (_, m) in want.items()}
        assert abs(got[k][1] - max(sims.values())) < 2e-4 and abs(sims[got[k][0]] - max(sims.values())) < 2e-4
    sums = {}
    for label, v in e.values():
        sums[label] = sums.get(label, 0) + v
    cents = {label: s / np.linalg.norm(s) for label, s in sums.items()}
    outcome = {}
    for k, (_, v) in e.items():
        best = max(sorted(cents), key=lambda c: round(float(v @ cents[c]), 6))
        s = round(float(v @ cents[best]), 6)
        outcome[k] = "match" if best >= 3 and s >= 0.3 else "absorb" if best < 3 and s >= 0.4 else "unmatched"
    tallies = {o: list(outcome.values()).count(o) for o in outcome.values()}
    clusters = {}
    if "unmatched" in tallies:
        for first, (n, m) in led_by_levels({k: v for k, (_, v) in e.items() if outcome[k] == "unmatched"}, 0.8, 512, 16).items():
            near = max(float(np.array(m) @ c) for c in cents.values())
            if near >= 0.5:
                tallies["unmatched"] -= n
            else:
                clusters[str(first)] = n
    rows_ = queries["suppressed_clusters"](spark, folder).collect()
    assert {r["name"]: r["n"] for r in rows_ if r["kind"] == "tally"} == tallies and {r["name"]: r["n"] for r in rows_ if r["kind"] == "cluster"} == clusters


def test_principal_scores_by_numpy(spark):

    from gridloom.plans.registry import load

    folder = "/root/testdata/sf0.001"
    e = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    x = np.stack(list(e.values()))
    axes = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:3]
    got = {r["vec_id"]: np.array([r["pc1"], r["pc2"], r["pc3"]]) for r in load()[0]["principal_scores"](spark, folder).collect()}
    want = {k: (v - x.mean(0)) @ axes.T for k, v in e.items()}
    want = {k: w / (np.linalg.norm(w) + 1e-9) for k, w in want.items()}
    for a in range(3):  # an axis may point either way
        dot = sum(got[k][a] * want[k][a] for k in e)
        assert all(abs(got[k][a] - np.sign(dot) * want[k][a]) < 1e-3 for k in e)


def test_ratio_of():
    assert splits.ratio_of("60,20, 20") == (60, 20, 20) and splits.ratio_of("100/0/0") == (100, 0, 0)
    for bad in ("60,20", "60,20,21", "120,-20,0", "a,b,c", "33.3,33.3,33.4", ""):
        with pytest.raises(ValueError):
            splits.ratio_of(bad)


def test_pattern_is_the_greedy_turn():
    for ratio, have in (((60, 20, 20), (0, 0, 0)), ((60, 30, 10), (7, 0, 900)), ((33, 33, 34), (5, 400, 1)), ((100, 0, 0), (0, 9, 0))):
        held = list(have)
        for s in splits.turns(3000, ratio, have):
            lack = [r * (sum(held) + 1) - 100 * h for r, h in zip(ratio, held, strict=True)]
            assert s == splits.SPLITS[lack.index(max(lack))]
            held[lack.index(max(lack))] += 1


def test_numbered_and_medians(spark):
    r = random.Random(6)
    ids = r.sample(range(10**6), 900)
    df = spark.createDataFrame([(i, i % 5, float(r.choice([0, 1, r.gauss(0, 9)])) if i % 7 else None) for i in ids], "k long, g long, v double")
    got = {x["k"]: x["p"] for x in splits.numbered(df, "k", "p", 16).collect()}
    assert [got[k] for k in sorted(ids)] == list(range(900))
    import statistics

    from gridloom.operators import metrics

    held = {}
    for _, g, v in df.collect():
        if v is not None:
            held.setdefault(g, []).append(v)
    for parts in (1024, 3, 1):
        got = {x["g"]: x["median"] for x in metrics.medians(df, "g", "v", parts).collect()}
        assert got == {g: pytest.approx(statistics.median(v)) for g, v in held.items()}
    assert splits.numbered(df.where("false"), "k", "p").count() == 0 and metrics.medians(df.where("false"), "g", "v").count() == 0


def test_medians_deal_rows_to_tasks_by_their_number(spark):
    """The shares of the tasks don't grow with the table, and large keys aren't whole in any (F5)."""
    df = spark.range(6000).select((F.col("id") % 1500).alias("g"), (F.hash("id") % 1000).cast("double").alias("v"))
    got = metrics.medians(df, "g", "v", 100)
    held = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(held) == 1500 and max(held) < 100 and got.rdd.getNumPartitions() >= 60
    assert rows(got) == rows(df.groupBy("g").agg(F.expr("percentile(v, 0.5)")))

    one = spark.range(20000).select(F.lit("all").alias("key"), F.lit(0).alias("c"), F.hash("id").cast("double").alias("v"), F.expr("array(20000L)").alias("counts"))
    assert 0 < metrics._about_middle(one, 50, 20000).count() < 1000
    assert rows(metrics.medians(one, "key", "v", 3200)) == rows(one.groupBy("key").agg(F.expr("percentile(v, 0.5)")))


def test_medians_of_odd_values(spark):
    import statistics

    r = random.Random(9)
    inf = float("inf")
    values = {
        None: [3.0, None, 1.0],
        "far": [1e300, -inf, 1.0, 2.0, inf, 3.0, inf],
        "none": [None] * 40,
        "same": [7.0] * 400 + [None] * 90,
        "two": [1.0] * 50 + [2.0] * 50,
        "many": [r.gauss(0, 1) * 10 ** r.randrange(-9, 9) for _ in range(700)],
        "zero": [-0.0, 0.0, -0.0, 0.0, 1.0],
        "one": [5.0],
    }
    df = spark.createDataFrame([(g, v, None if v is None else -v) for g, vs in values.items() for v in vs], "g string, v double, u double").repartition(5)
    told = {g: [v for v in vs if v is not None] for g, vs in values.items()}
    want = {g: statistics.median(vs) if vs else None for g, vs in told.items()}
    for most in (1, 3, 64, 300, 1 << 19):
        got = {x["g"]: (x["m"], x["o"]) for x in metrics.medians_of(df, "g", {"m": "v", "o": "u"}, most).collect()}
        assert got == {g: (m, None if m is None else -m) for g, m in want.items()}, most


def test_names_in_is_name_in(spark):
    from gridloom.functions import text

    r = random.Random(2)
    word = lambda n: "".join(r.choice("abcd") for _ in range(n))
    names = spark.createDataFrame([(word(r.randrange(1, 7)),) for _ in range(60)] + [("",)], "name string")
    blobs = spark.createDataFrame([(" ".join(word(r.randrange(1, 8)) for _ in range(3)),) for _ in range(80)] + [("",), (" ",)], "blob string")
    got = rows(matching.names_in(names, "name", blobs, "blob"))
    want = rows(names.distinct().join(blobs.distinct(), text.name_in(F.col("name"), F.col("blob"))))
    assert got == want and len(want) > 100


def test_identify(spark):
    """A still and a running clock, swapped clocks, clocks repeated over places, missing ones, and names that fit no game."""
    from gridloom.operators import alignment

    places = [(0, 10, 0, "white", 600, 600), (0, 10, 1, "black", 590, 600), (0, 10, 2, "white", 590, 570), (0, 10, 3, "black", 590, 570), (0, 10, 4, "white", 590, None), (0, 11, 0, "black", 590, 600)]
    p = spark.createDataFrame(places, "g int, game int, ply int, turn string, white_clk int, black_clk int").withColumn("increment", F.lit(5))
    o = spark.createDataFrame([(1, 0, 591, 580, False), (2, 0, 580, 591, False), (3, 0, 590, 571, False), (4, 0, None, 571, False), (5, 0, 591, 580, True), (6, 0, 591, 598, True)], "obs_id int, g int, white_obs int, black_obs int, names_read boolean")
    met = sorted((m["obs_id"], m["game"], m["ply"], m["side"], m["residual"]) for m in alignment.clock_matches(o, p, ["g"]).collect())
    want = []
    for i, _, w, b, _ in o.collect():
        for _, game, ply, turn, wc, bc in places:
            if None in (w, b, wc, bc):
                continue
            following = [x for x in places if x[1] == game and x[2] == ply + 1]
            still, rec, run, now, at = (w, wc, b, bc, 5) if turn == "black" else (b, bc, w, wc, 4)
            nxt = following[0][at] if following else None
            if abs(still - rec) <= 2 and (nxt - 5 if nxt is not None else 0) - 3 <= run <= now + 3:
                want.append((i, game, ply, "white" if turn == "black" else "black", float(abs(still - rec))))
    assert met == sorted(want) and len(want) >= 4
    named = spark.createDataFrame([(6, 11)], "obs_id int, game int")
    got = {r["obs_id"]: (r["game"], r["ply"], r["confidence"]) for r in alignment.identify(o, p, ["g"], named).collect()}
    assert got[2] == (None, None, None) and got[4] == (None, None, None) and got[5] == (None, None, None)
    assert got[1] == (10, 1, 0.25) and got[6] == (11, 0, 0.75)


def test_best_oriented(spark):
    df = spark.createDataFrame([("c", 1, "x", 10.0), ("c", 2, "x", 90.0), ("c", 3, "y", 12.0), ("c", 4, "z", 500.0), ("d", 5, "x", 1.0)], "c string, k int, p string, v double")
    assert rows(matching.best_oriented(df, "c", "k", "p", "v", 50)) == [(1, 2, True, 1), (2, 1, True, 1), (3, 1, False, 1), (4, None, False, 0), (5, None, False, 0)]


def test_review(spark):
    from gridloom.operators import review

    data = spark.createDataFrame([(1, 5, False), (2, 6, False), (3, 7, True), (4, 8, False)], "k int, v int, verified boolean")
    decided = spark.createDataFrame([(1, "reject"), (2, "correct"), (4, "accept")], "k int, decision string")
    fixes = spark.createDataFrame([(2, 60)], "k int, v int")
    assert rows(review.applied(data, decided, fixes, "k", ["v"]).select("k", "v", "verified")) == [(2, 60, True), (3, 7, True), (4, 8, True)]
    steps = spark.createDataFrame([("a", k, s, 0) for k, s in enumerate([1, 3, 2, 2, 9])] + [("b", k, k, 0) for k in range(4)], "r string, step int, s int, t int")
    assert rows(review.patient(steps, "r", "step", ["s", "t"], 2)) == [("a", 1, 3, True), ("b", 3, 3, False)]
    with pytest.raises(ValueError):
        review.grouping_unit("match", F.lit(1), F.lit(1), F.lit(1))


def test_hamming_nearest_of_boards_with_a_part_in_common(spark):
    """All boards share their middle, many share more; some are equal."""
    r = random.Random(8)
    base = [r.randrange(4) for _ in range(64)]

    def near(n, free):
        cells = list(base)
        for at in r.sample(free, n):
            cells[at] = r.randrange(13)
        return cells

    outer = [*range(20), *range(48, 64)]
    known = [(k, near(r.choice([0, 3, 20]), outer)) for k in range(150)] + [(200 + k, near(40, [*range(64)])) for k in range(30)]
    obs = [(k, near(r.choice([0, 2, 6, 14]), outer)) for k in range(40)]
    o, k = spark.createDataFrame(obs, "obs_id int, cells array<int>"), spark.createDataFrame(known, "known_id int, cells array<int>")
    want = {}
    for i, a in obs:
        diff, best = min((sum(x != y for x, y in zip(a, b, strict=True)), j) for j, b in known)
        want[i] = (best, diff) if diff <= 6 else (None, None)
    for crowd in (1, 10, 10**6):
        assert {x.obs_id: (x.known_id, x["diff"]) for x in matching.hamming_nearest(o, k, 6, crowd).collect()} == want


def test_neighbours_in_one_pass_or_in_blocks(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.integers(-2, 3, 6).astype(float).tolist() if k else [1.0] + [0.0] * 5, float(k % 2)) for k in range(300)]  # many ties
    df = spark.createDataFrame([(k, v if any(v) else [1.0] * 6, y) for k, v, y in rows], "vec_id long, embedding array<double>, label double").repartition(4)
    q = df.where("vec_id % 30 = 0")
    got = lambda **more: sorted(map(tuple, vectors.neighbour_score(q, df, 7, **more).collect()))
    once = got()
    assert len(once) == 10 and once == got(most_bytes=0, block=64)
    assert vectors.neighbour_score(q.where("vec_id < 0"), df, 7).count() == 0


def test_rounds_of_videos_raise(spark):
    entries = spark.createDataFrame([("a", ["r1", "r2"], None), ("b", [], ["t"]), ("c", None, ["t", "u"]), ("d", None, None)], "video string, round_ids array<string>, tournaments array<string>")
    rounds = spark.createDataFrame([("t", "t1"), ("t", "t2"), ("u", "u1")], "tournament string, round string")
    of = lambda *videos: sorted(map(tuple, review.rounds_of(spark.createDataFrame([(v,) for v in videos], "video string"), entries, rounds).collect()))
    assert of("a", "b", "c") == [("a", "r1"), ("a", "r2"), ("b", "t1"), ("b", "t2"), ("c", "t1"), ("c", "t2"), ("c", "u1")]
    with pytest.raises(Exception, match="unregistered video x"):
        of("a", "x")
    with pytest.raises(Exception, match="no rounds or tournaments for video d"):
        of("d")


def test_no_rates_of_nothing(spark):
    with pytest.raises(ValueError, match="board metrics: no rows"):
        quality.nonempty(spark.range(0), "board metrics")
    assert quality.nonempty(spark.range(1), "board metrics").count() == 1


def test_manifest_issues(spark):
    kind = "index int, sample_id string, image string, split string, game_id string"
    good = [(k, None if k % 2 else f"s{k}", f"images/s{k}.jpg", "train" if k < 4 else "test", f"g{k // 2}") for k in range(6)]
    images = spark.createDataFrame([(f"images/s{k}.jpg",) for k in range(6)], "image string")
    found = lambda rows, expected, there=images, **more: sorted(map(tuple, quality.manifest_issues(spark.createDataFrame(rows, kind), expected, there, **more).collect()))
    assert found(good, {"train": 4, "test": 2}) == []
    bad = good + [(6, None, None, None, None), (7, "s0", "images/s0.jpg", "test", "g0"), (8, "x", "/x.jpg", "val", "g9")]
    assert found(bad, {"train": 4, "test": 2}, images.where("image <> 'images/s5.jpg'"), partial=True) == sorted([
        ("no sample identity", "6"), ("no image path", "6"), ("invalid split", "6"), ("no game", "6"), ("count of split", "none 1"), ("count of split", "test 3"), ("repeated id", "s0"),
        ("repeated image", "images/s0.jpg"), ("game in several splits", "g0"), ("other image path", "8 /x.jpg"), ("invalid split", "8 val"), ("count of split", "val 1"),
        ("missing image", "images/s5.jpg"), ("partial", "the manifest says so itself"),
    ])
    assert found([], {"train": 1}) == [("count of split", "train 0")]


def test_nearest_of_few_and_of_many_points(spark):
    r = random.Random(12)
    df = spark.createDataFrame([(k, float(r.choice([r.randrange(-20, 60), r.randrange(1000), 7]))) for k in range(400)] + [(999, None)], "id int, v double").repartition(3)
    for made in ([(k, float(r.randrange(0, 900))) for k in range(300)], [(k, float(r.choice([5, 6]))) for k in range(40)], [(3, 1.0)]):
        points = spark.createDataFrame([*made, (5000, None)], "k int, at double")
        got = [sorted((x.id, tuple(x.nearest) if x.nearest else None) for x in timeline.nearest_of(df, points, "v", "at", "k", most).collect()) for most in (10_000, 0)]
        assert got[0] == got[1] and dict(got[0])[999] is None
        for i, v in df.where("v is not null").collect():
            gap, k = min((abs(p - v), j) for j, p in made)
            assert dict(got[0])[i][:2] == (gap, k)
    none = spark.createDataFrame([], "k int, at double")
    assert all(x.nearest is None for x in timeline.nearest_of(df, none, "v", "at", "k").collect())
