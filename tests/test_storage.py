"""Splittable game text, .npy arrays, versions behind a pointer, rebuilt partitions and bucketed logs."""

import hashlib
import os
import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.sources import npy, readers, sinks, versions
from gridloom.streaming import incremental

R = random.Random(4)


def game(k, end="\n"):
    moves = " ".join(f"{n + 1}. e{n % 8 + 1} {{[%clk 0:{n % 60:02d}:0{k % 10}]}} d{n % 8 + 1}" for n in range(R.randrange(30)))
    return end.join([f'[Event "E{k}"]', f'[White "W{k}"]', f'[Note "[Event is no line"]', "", f"{moves} {{a note [Event }} 1-0", "", ""])


def whole(spark, path):
    """games() by whole files, as plain as can be."""
    out = []
    for f in sorted(os.listdir(path)):
        with open(f"{path}/{f}", newline="", encoding="utf-8") as h:
            text = h.read()
        parts = text.split("\n[Event ")
        parts = [parts[0], *["[Event " + p for p in parts[1:]]]
        out += [(f, n, g) for n, g in enumerate(p for p in parts if p.strip())]
    return out


def test_games_are_read_by_many_tasks(spark, tmp_path):
    files = {
        "plain.pgn": "".join(game(k) for k in range(300)),
        "crlf.pgn": "".join(game(k, "\r\n") for k in range(40)),
        "blank.pgn": "\n\n" + game(1) + game(2).rstrip("\n"),
        "note.pgn": "; written by hand\n" + game(3),
        "one.pgn": game(4).strip(),
        "empty.pgn": "",
        "first.pgn": "\n" + game(5),
        "wide.pgn": game(6).replace("a note", "é漢" * 20_000) + game(7),
    }
    for name, text in files.items():
        (tmp_path / name).write_bytes(text.encode())
    want = whole(spark, tmp_path)
    limit = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1000", "7777", limit):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            texts = readers.game_texts(spark, str(tmp_path))
            assert sorted((r.path.rsplit("/", 1)[1], r.game_no, r.g) for r in texts.collect()) == sorted(want)
            tasks = spark.read.text(str(tmp_path / "plain.pgn"), lineSep="\n[Event ").rdd.getNumPartitions()
            assert (tasks > 5) == (size != limit)
        got = {(r.path.rsplit("/", 1)[1], r.game_no): r for r in readers.games(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
    assert len(got) == len(want) and got["plain.pgn", 123].headers == {"Event": "E123", "White": "W123", "Note": "[Event is no line"}
    assert all(m.clock is not None for m in got["crlf.pgn", 7].moves if m.san.startswith("e"))


def test_npy(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(1000, 7)).astype(np.float32)
    path = str(tmp_path / "d.npy")
    np.save(path, x)
    df = npy.vectors(spark, path, 7, "descriptor", rows=130)
    assert df.rdd.getNumPartitions() == 8 and df.columns == ["row", "descriptor"]
    got = df.orderBy("row").collect()
    assert [r["row"] for r in got] == [*range(1000)] and np.array_equal(np.array([r["descriptor"] for r in got], np.float32), x)
    assert readers.cached_vectors(spark, path, "v", 7).count() == 1000
    assert readers.cached_vectors(spark, path, "v", 8) is None and readers.cached_vectors(spark, str(tmp_path / "none.npy"), "v", 7) is None
    for kind in ("f8", ">f4", "i4", "i8"):
        np.save(path, (x * 100).astype(kind))
        assert np.allclose([r["vector"] for r in npy.vectors(spark, path, 7).orderBy("row").collect()], (x * 100).astype(kind))
    np.save(path, x[0])
    assert npy.vectors(spark, path, 7) is None
    np.save(path, np.zeros((0, 7)))
    assert npy.vectors(spark, path, 7).count() == 0
    np.save(path, np.asfortranarray(x))
    with pytest.raises(ValueError, match="column order"):
        npy.vectors(spark, path, 7)
    np.save(path, np.array([[{"a": 1}]], object), allow_pickle=True)
    with pytest.raises(ValueError, match="not plain numbers"):
        npy.vectors(spark, path, 1)
    np.save(path, x)
    with open(path, "r+b") as f:
        f.truncate(os.path.getsize(path) - 10)
    with pytest.raises(Exception, match="ends before row 1000"):
        npy.vectors(spark, path, 7).collect()


def test_versions_stop_anywhere(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "t")
    assert versions.current(spark, target) is None
    first = versions.commit(spark.range(3), target)
    assert versions.current(spark, target).count() == 3

    def refuse(df):
        raise ValueError("no")

    with pytest.raises(ValueError):  # while it is checked
        versions.commit(spark.range(9), target, refuse)
    assert versions.current(spark, target).count() == 3
    left = versions.stage(spark.range(9), target)  # after the data, before the pointer
    assert versions.current(spark, target).count() == 3
    (tmp_path / "t/pointers/0000000002").write_text(left[:7])  # in the middle of the pointer
    assert versions.current(spark, target).count() == 3
    assert versions.current(spark, target, back=1) is None
    second = versions.commit(spark.range(5), target)  # a later writer goes on
    assert versions.current(spark, target).count() == 5 and versions.current(spark, target, back=1).count() == 3
    monkeypatch.setattr(versions, "_numbers", lambda *_: [1])  # another writer took the number in the meantime
    with pytest.raises(Exception, match="exist"):
        versions.point(spark, target, left)
    monkeypatch.undo()
    third = versions.commit(versions.current(spark, target).where("id > 0"), target)  # reads what it replaces
    gone = versions.vacuum(spark, target, keep=2)
    assert first in gone and left in gone and {second, third}.isdisjoint(gone)
    assert versions.current(spark, target).count() == 4 and versions.current(spark, target, back=1).count() == 5
    assert versions.commit(spark.range(1), target) and versions.current(spark, target).count() == 1


def test_a_rebuild_leaves_other_partitions_alone(spark, tmp_path):
    target = str(tmp_path / "t")
    rows = lambda k, v: [(f"{s:02d}", i, v) for s in k for i in range(4)]
    kind = "source string, id int, v int"
    assert sinks.rebuild(spark.createDataFrame(rows(range(5), 1), kind), target, "source", [f"{s:02d}" for s in range(5)], ["id"]).count() == 0
    files = lambda s: {(f, os.path.getmtime(f"{target}/source={s}/{f}")) for f in os.listdir(f"{target}/source={s}")}
    before = {s: files(s) for s in ("00", "03", "04")}
    old = spark.read.schema(kind).parquet(target)
    fresh = old.where("source in ('01', '02') and source <> '02' and id <> 3").withColumn("v", F.lit(2))  # reads what it replaces
    dropped = sinks.rebuild(fresh, target, "source", ["01", "02"], ["id"])
    assert sorted(map(tuple, dropped.collect())) == [("01", 3), ("02", 0), ("02", 1), ("02", 2), ("02", 3)]
    assert {s: files(s) for s in before} == before and not os.path.exists(f"{target}/source=02")
    got = sorted((r.source, r.id, r.v) for r in spark.read.schema(kind).parquet(target).collect())
    assert got == sorted(rows((0, 3, 4), 1) + [("01", i, 2) for i in range(3)])
    with pytest.raises(ValueError, match="beyond the scope"):
        sinks.rebuild(spark.createDataFrame(rows([3], 9), kind), target, "source", ["01"], ["id"])
    assert sinks.rebuild(spark.createDataFrame([], kind), target, "source", [], ["id"]).count() == 0
    assert sorted((r.source, r.id, r.v) for r in spark.read.schema(kind).parquet(target).collect()) == got and not [p for p in os.listdir(tmp_path) if "stage" in p]


def test_a_log_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "t")
    kind = "k string, seq long, v int"

    def feed(name, rows):
        spark.createDataFrame(rows, kind).coalesce(1).write.json(str(source / name))

    def run(to="c"):
        stream = spark.readStream.schema(kind).option("recursiveFileLookup", "true").json(str(source))
        incremental.upsert_buckets(stream, target, ["k"], "seq", str(tmp_path / to)).awaitTermination()
        return {r.k: (r.seq, r.v) for r in incremental.read_buckets(spark, target).collect()}

    feed("a", [(f"k{i}", 1, i) for i in range(400)])
    assert run() == {f"k{i}": (1, i) for i in range(400)}
    held = lambda: {(b, f) for b in os.listdir(target) if b.startswith("bucket=") for f in os.listdir(f"{target}/{b}")}
    first = held()
    assert len({b for b, _ in first}) == 64
    feed("b", [("k7", 2, 70), ("k7", 3, 71), ("k9", 0, -1), ("new", 1, 5)])
    want = {f"k{i}": (1, i) for i in range(400)} | {"k7": (3, 71), "new": (1, 5)}
    assert run() == want
    second = held()
    assert 1 <= len({b for b, _ in first - second}) <= 3
    assert run("again") == want  # everything once more, from the start
    # a batch that broke off while it wrote over its buckets: its stage is there, a bucket is gone
    feed("d", [("k7", 9, 99)])
    name = hashlib.sha256(str(tmp_path / "c").encode()).hexdigest()[:16]
    bucket = incremental.read_buckets(spark, target).where("k = 'k7'").select(F.pmod(F.xxhash64("k"), F.lit(64)).alias("b")).first()["b"]
    own = spark.read.parquet(target).where(F.col("bucket") == int(bucket)).withColumn("v", F.when(F.col("k") == "k7", 99).otherwise(F.col("v"))).withColumn("seq", F.when(F.col("k") == "k7", 9).otherwise(F.col("seq")))
    own.write.parquet(f"{target}.stage/{name}-2")
    shutil.rmtree(f"{target}/bucket={bucket}")
    assert run() == want | {"k7": (9, 99)}


def test_checksums_of_large_files(spark, tmp_path):
    made = {"a.bin": b"a", "b/c.bin": R.randbytes(5000), "b/d e.bin": R.randbytes(100)}
    for name, data in made.items():
        (tmp_path / "r" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / name).write_bytes(data)
    want = {name: hashlib.sha256(data).hexdigest() for name, data in made.items()}
    for whole in (sinks.WHOLE, 100, 99, -1):
        assert {r.path: r.digest for r in sinks.checksums(spark, str(tmp_path / "r"), whole=whole).collect()} == want
    assert {r.path for r in sinks.checksums(spark, str(tmp_path / "r"), "^b/").collect()} == {"a.bin"}
