"""Nested records, fresh ids, split turns, feature bands and the recognizers' hook held against plain Python."""

import hashlib
import json
import math
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import metrics, nested, recognition, splits

R = random.Random(17)
NAMES = ["a", "b", "ä", "漢", "a b", 'q"', "\\", "😀", "z\n"]


def record(depth):
    kind = R.random()
    if depth and kind < 0.35:
        return {n: record(depth - 1) for n in R.sample(NAMES, R.randrange(4))}
    if depth and kind < 0.6:
        return [record(depth - 1) for _ in range(R.randrange(4))]
    return R.choice([None, True, False, 0, -7, 10**25, 1.5, "", "/etc/x", "x/y", 'say "hi" [/{', "/", "\t\\/", "é漢😀"])


def leaves(value, path=""):
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in leaves(v, f"{path}.{k}")]
    if isinstance(value, list):
        return [x for k, v in enumerate(value) for x in leaves(v, f"{path}[{k}]")]
    return [(path, value)]


def shuffled(value):
    if isinstance(value, dict):
        names = R.sample(sorted(value), len(value))
        return {n: shuffled(value[n]) for n in names}
    return [shuffled(v) for v in value] if isinstance(value, list) else value


def test_values_of_any_depth(spark):
    made = [record(R.randrange(6)) for _ in range(300)] + [{"a": {"b": {"c": {"d": {"e": ["/deep"]}}}}}]
    rows = [(k, json.dumps(v), "k") for k, v in enumerate(made)] + [(-1, None, "k")]
    df = spark.createDataFrame(rows, "id int, v string, path string")
    got = sorted((r.id, r.path, r.value) for r in nested.values(df, ["id"], "v").where("value is not null").collect())
    text = lambda x: str(x).lower() if isinstance(x, bool) else str(x)
    assert got == sorted((k, p, text(x)) for k, v in enumerate(made) for p, x in leaves(v) if x is not None)
    found = sorted((r.id, r.path, r.value) for r in nested.absolute_texts(df, ["id"], "v").collect())
    assert found == sorted((k, p, x) for k, v in enumerate(made) for p, x in leaves(v) if isinstance(x, str) and x.startswith("/"))
    held = df.select("id", F.parse_json("v").alias("v"))  # VARIANT gives the same
    assert sorted((r.id, r.path, r.value) for r in nested.absolute_texts(held, ["id"], "v").collect()) == found
    with pytest.raises(ValueError, match=r"absolute local path in v\.a\.b\.c\.d\.e\[0\]: /deep"):
        nested.without_absolute_texts(df.where(F.col("id") == len(made) - 1), ["id"], "v")
    clean = df.where("id = -1")
    assert nested.without_absolute_texts(clean, ["id"], "v").count() == 1 and nested.values(clean.where("id > 0"), ["id"], "v").count() == 0


def test_canonical_json_knows_no_order(spark):
    made = [record(4) for _ in range(200)]
    df = spark.createDataFrame([(k, json.dumps(v), json.dumps(shuffled(v), indent=2, ensure_ascii=False)) for k, v in enumerate(made)], "id int, a string, b string")
    for r in df.select("id", nested.canonical(F.col("a")).alias("a"), nested.canonical(F.col("b")).alias("b")).collect():
        assert r.a == r.b == json.dumps(made[r.id], sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_canonical_numbers(spark):
    groups = [["1", "1.0", "1.00", "1e0", "10E-1"], ["0", "-0", "0.0"], ["1e16", "10000000000000000"], ["123456789.125", "1.23456789125E8"], ["0.000123", "1.23e-4"], ["-1e-7", "-0.0000001"], ["1.5e300"], ["15E-1", "1.5"]]
    rows = [(g, f'{{"E1.0E5": [{x}, "1.0E16 -2.5E-3"]}}') for g, xs in enumerate(groups) for x in xs]
    got = spark.createDataFrame(rows, "g int, j string").select("g", nested.canonical(F.col("j")).alias("c")).distinct().collect()
    assert len(got) == len(groups)
    for r in got:
        number = json.loads(r.c, parse_float=Decimal, parse_int=Decimal)["E1.0E5"]
        assert number[0] == Decimal(groups[r.g][0]) and number[1] == "1.0E16 -2.5E-3" and "E" not in r.c.split("[")[1].split(",")[0]
    s = spark.createDataFrame([(1, {"b": 1.0, "a": None}, (2, [1e20]))], "k int, m map<string,double>, s struct<z:int,a:array<double>>")
    both = s.select(F.struct("s", "m", "k").alias("r"), F.struct("k", "m", "s").alias("t"))
    got = both.select(nested.fingerprint(both, "r").alias("r"), nested.fingerprint(both, "t").alias("t")).first()
    assert got.r == got.t == hashlib.sha256(b'{"k":1,"m":{"a":null,"b":1},"s":{"a":[100000000000000000000],"z":2}}').hexdigest()


def test_fresh_ids(spark):
    for n, size, ahead in ((40, 10, 60), (500, 300, 900), (7, 0, 0), (0, 5, 9)):
        taken = sorted(R.sample(range(max(1, size + ahead)), size))
        ids = [f"t{k}" for k in taken] + ["x7", "t007", "t99999999999999999999", "t", f"t{size + 3}", f"t{size + 4}", f"t{size + 5}"]
        registry = spark.createDataFrame([(i,) for i in ids] + [(ids[0],)], "id string")
        new = spark.createDataFrame([(7 * k, f"r{k}") for k in R.sample(range(n), n)], "k long, name string")
        start, want = len(set(ids)), []
        at = start
        while len(want) < n:
            if f"t{at}" not in ids:
                want.append(f"t{at}")
            at += 1
        got = {r.k: (r.fresh, r["name"]) for r in splits.fresh_ids(new, "k", registry, "id", "t").collect()}
        assert got == {7 * k: (want[k], f"r{k}") for k in range(n)}


def test_fresh_numbers_in_few_ranges(spark):
    taken = sorted({*range(10, 40), *range(41, 44), 50, 1000, *R.sample(range(2000), 300)})
    got = splits.fresh_numbers(spark.range(700), "id", spark.createDataFrame([(t,) for t in taken], "t long"), 5, "n", parts=7).collect()
    free = [k for k in range(5, 3000) if k not in taken]
    assert {r["id"]: r["n"] for r in got} == dict(enumerate(free[:700]))


def test_turns_are_divided_out(spark):
    def one_by_one(n, ratio, have):
        lack, out = [r * sum(have) - 100 * h for r, h in zip(ratio, have, strict=True)], []
        for _ in range(n):
            lack = [x + r for x, r in zip(lack, ratio, strict=True)]
            at = lack.index(max(lack))
            lack[at] -= 100
            out.append(splits.SPLITS[at])
        return out

    for _ in range(60):
        a = R.randrange(101)
        b = R.randrange(101 - a)
        ratio, have = (a, b, 100 - a - b), tuple(R.choice([0, R.randrange(5), R.randrange(300)]) for _ in range(3))
        assert splits.turns(3000, ratio, have) == one_by_one(3000, ratio, have)
    assert splits.turns(60_000, (98, 1, 1), (0, 500, 3)) == one_by_one(60_000, (98, 1, 1), (0, 500, 3))
    once, _ = splits.pattern((98, 1, 1), (0, 10**9, 0))
    assert sum(len(run) for run, _ in once) < 2000 and sum(len(run) * times for run, times in once) > 9 * 10**10
    ratio, have = (60, 30, 10), (7, 0, 900)
    got = spark.range(12_000).select("id", splits.split_of_turn(F.col("id"), ratio, have).alias("s")).collect()
    assert [r["s"] for r in sorted(got)] == one_by_one(12_000, ratio, have)


def test_bands_of_features(spark):
    features = metrics.Features()
    features.add("x")(lambda: F.col("x"))
    features.add("twice")(lambda: F.col("x") * 2)
    with pytest.raises(ValueError, match="there already"):
        features.add("x")(lambda: F.col("x"))
    with pytest.raises(KeyError, match="there are twice, x"):
        features.of("y")
    df = spark.createDataFrame([(float(k), k % 3) for k in range(10)] + [(None, 1)], "x double, w int")
    assert metrics.middle_cuts(df, features, features.names()) == {"x": [5.0], "twice": [10.0]}
    out = metrics.by_bands(df, features, {"x": [5.0], "twice": [18.0, 6.0, 8.0]}, [F.count("*").alias("n")])
    got = {(r.feature, r.band, r.place): r.n for r in out.collect()}
    assert got == {("overall", None, None): 11, ("x", "low", 0): 5, ("x", "high", 1): 5, ("x", None, None): 1,
                   ("twice", "band0", 0): 3, ("twice", "band1", 1): 1, ("twice", "band2", 2): 5, ("twice", "band3", 3): 1, ("twice", None, None): 1}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") + plan.count("LocalTableScan") <= 2 and "Expand" in plan


def test_recognizers_hook(spark):
    rng = np.random.default_rng(0)
    scores = [rng.integers(0, 4, 832).astype(float).tolist() for _ in range(30)]
    odd = [None, [], scores[0][:831], [None, *scores[1][1:]], [math.nan, *scores[2][1:]], [*scores[3][:-1], -math.inf], [None, math.inf, *scores[3][2:]]]
    df = spark.createDataFrame([(k, s, "p", k) for k, s in enumerate(scores + odd)], "id int, scores array<double>, problem string, more int").repartition(3)
    got = {r.id: r for r in recognition.recognized(df).collect()}
    want = {r.id: r.l for r in df.where("id < 30").select("id", recognition.native_labels(F.col("scores")).alias("l")).collect()}
    assert len(got) == 37 and all(got[k].labels == want[k] and got[k].problem is None and got[k].more == k for k in range(30))
    assert [got[k].problem for k in range(30, 37)] == [recognition.MISSING, recognition.LENGTH, recognition.LENGTH, recognition.HOLE, recognition.INFINITE, recognition.INFINITE, recognition.HOLE]
    assert all(got[k].labels is None for k in range(30, 37))
    high = lambda s: np.where(s.sum((1, 2))[:, None] > 1250, 13, 5) + np.zeros((1, 64), int)
    told = {r.id: (r.problem, r.labels) for r in recognition.recognized(df.where("id < 30"), predict=high).collect()}
    assert all(told[k] == ((recognition.LABELS, None) if sum(scores[k]) > 1250 else (None, [5] * 64)) for k in range(30))
    with pytest.raises(Exception, match="whole numbers are asked for"):
        recognition.recognized(df, predict=lambda s: s[:, 0]).collect()
    assert recognition.recognized(df.where("id < 0")).count() == 0


def test_canonical_takes_zeros_off_in_one_go(spark):
    """Numbers without exponents beside texts that look like them, and with one; no number is spelled digit by digit without need."""
    texts = {
        '{"b":[1.500,-0.0,0.0,100.0,10.050,-2.50,7],"a":"1.50 -0.0 E \\"2.0"}': '{"a":"1.50 -0.0 E \\"2.0","b":[1.5,0,0,100,10.05,-2.5,7]}',
        '{"b":1e30,"a":[2.50,"3.0"]}': '{"a":[2.5,"3.0"],"b":1000000000000000000000000000000}',
        "505.0505": "505.0505",
        "-0.050": "-0.05",
    }
    df = spark.createDataFrame([(k,) for k in texts], "j string")
    assert {r["j"]: r["c"] for r in df.select("j", nested.canonical(F.col("j")).alias("c")).collect()} == texts
    assert nested.ZEROS in df.select(nested.canonical(F.col("j")))._jdf.queryExecution().analyzed().toString()
