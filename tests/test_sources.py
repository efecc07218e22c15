"""Readers, sinks and streams on small files."""

import json

import pytest
from pyspark.sql import functions as F

from gridloom.sources import readers, sinks
from gridloom.streaming import incremental


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


def test_annotated_boards(spark, tmp_path):
    p = {"image_id": 1, "category_id": 0, "chessboard_position": "a8"}
    path = put(
        tmp_path / "a.json",
        {
            "images": [{"id": k, "file_name": f"{k}.png", "more": 1} for k in (1, 2, 3)],
            "categories": [{"id": 0, "name": "x"}],
            "annotations": {"pieces": [p, p | {"category_id": 1}, p | {"category_id": 9, "chessboard_position": "b8"}, p | {"image_id": 3}]},
            "splits": {"train": {"image_ids": [1, 2]}, "test": {"image_ids": [3]}},
        },
    )
    got = {r["sample_id"]: r["cells"] for r in readers.annotated_boards(spark, path, "train", {0: 6, 1: 2}).collect()}
    assert got == {"1": [2] + [0] * 63, "2": [0] * 64}


def test_manifest_and_lists(spark, tmp_path):
    empty = "8/8/8/8/8/8/8/8"
    path = put(tmp_path / "m.json", {"samples": [{"image": "images/v_1.png", "gt_fen": empty, "split": "val"}, {"id": "b", "image": "x.png", "gt_fen": "bad", "split": "test"}]})
    assert [(r["sample_id"], r["cells"]) for r in readers.manifest(spark, path, "val").collect()] == [("v_1", [0] * 64)]
    labels = put(tmp_path / "l.json", [{"image": "x.png", "gt_fen": empty}, {"image": "y.png", "gt_fen": empty}])
    views = spark.createDataFrame([("x.png", "top")], "image string, viewpoint string")
    assert {r["image"]: r["viewpoint"] for r in readers.label_list(spark, labels, views).collect()} == {"x.png": "top", "y.png": None}
    put(tmp_path / "r/val/s1.json", {"fen": empty})
    got = readers.split_directories(spark, str(tmp_path / "r"), "fen string").first()
    assert (got["split"], got["sample_id"], got["fen"], got["image"].endswith("/val/s1.png")) == ("val", "s1", empty, True)
    assert readers.first_there(spark, str(tmp_path / "none"), labels) == labels


def test_append_log_takes_the_last_and_counts_torn_lines(spark, tmp_path):
    path = put(tmp_path / "log.jsonl", '{"k": "a", "seq": 1, "v": 1}\n\n{"k": "a", "seq": 3, "v": 3}\n{"k": "a", "seq": 2, "v": 2}\n{"k": "b", "se')
    last, torn = readers.append_log(spark, path, "k string, seq long, v int", "k", "seq")
    assert [tuple(r) for r in last.collect()] == [("a", 3, 3)] and torn.first()["torn"] == 1


def test_games(spark, tmp_path):
    path = put(tmp_path / "g.pgn", '[Event "A"]\n[White "Li, B"]\n\n1. e4 {[%clk 0:10:00] good} e5 2. Nf3 (2. f4 exf4) Nc6 $1 1-0\n\n[Event "B"]\n\n1. d4! {note} *\n')
    got = readers.games(spark, path).orderBy("game_no").collect()
    assert [[(m["ply"], m["san"], m["clock"]) for m in g["moves"]] for g in got] == [[(1, "e4", 600), (2, "e5", None), (3, "Nf3", None), (4, "Nc6", None)], [(1, "d4", None)]]
    assert got[0]["headers"]["White"] == "Li, B"


def test_survey_and_manifests(spark, tmp_path):
    put(tmp_path / "w/v1/shots.json", "[]")
    put(tmp_path / "w/v2/reviewed.json", "[]")
    got = readers.artifacts(spark, str(tmp_path / "w"), {"shots": r"^shots", "done": r"^reviewed"}).orderBy("video").collect()
    assert [tuple(r) for r in got] == [("v1", True, False), ("v2", False, True)]
    videos = readers.video_manifest(spark, put(tmp_path / "v.json", {"a": {"title": "t", "tournament": "x"}, "b": {"tournaments": ["y", "z"]}})).orderBy("id").collect()
    assert [r["tournaments"] for r in videos] == [["x"], ["y", "z"]]
    assert readers.tolerant(spark, str(tmp_path / "nothing"), "a int").count() == 0 and readers.cached_vectors(spark, str(tmp_path / "nothing"), "v", 2) is None


def test_replace_is_all_or_nothing(spark, tmp_path):
    target = str(tmp_path / "t")
    sinks.replace(spark.range(3), target)

    def refuse(df):
        raise ValueError("no")

    with pytest.raises(ValueError):
        sinks.replace(spark.range(9), target, check=refuse)
    assert spark.read.parquet(target).count() == 3
    sinks.replace(spark.range(5), target, backup=True)
    assert spark.read.parquet(target).count() == 5 and spark.read.parquet(target + ".bak").count() == 3
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t", "t.bak"]


def test_scored_pair_and_checksums(spark, tmp_path):
    truth = spark.createDataFrame([("a",), ("b",)], "id string")
    for wrong in (spark.createDataFrame([("a",)], "id string"), truth.union(truth)):
        with pytest.raises(ValueError):
            sinks.scored_pair(truth, wrong, truth, "id", str(tmp_path / "out"))
    put(tmp_path / "d/x.txt", "1")
    put(tmp_path / "d/s/y.txt", "2")
    root = str(tmp_path / "d")
    before = spark.createDataFrame(sinks.checksums(spark, root).collect())
    assert {r["path"] for r in before.collect()} == {"x.txt", "s/y.txt"} and sinks.verify(spark, root, before).count() == 0
    put(tmp_path / "d/x.txt", "3")
    assert [tuple(r) for r in sinks.verify(spark, root, before).collect()] == [("x.txt", "changed")]


def test_json_file_is_replaced_whole(spark, tmp_path):
    target = str(tmp_path / "list.json")
    sinks.replace_json(spark.range(3), target)
    sinks.replace_json(spark.range(2).where("id > 0"), target)
    assert [r["id"] for r in spark.read.json(target).collect()] == [1] and (tmp_path / "list.json").is_file()
    sinks.replace_json(spark.range(0), target)
    assert (tmp_path / "list.json").read_text() == "" and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["list.json"]


def test_bundle(spark, tmp_path):
    """A release is whole or not there; what an incomplete run staged is kept to go on from; changed files are found."""
    target, resume = str(tmp_path / "release"), str(tmp_path / "resume")
    records = spark.createDataFrame([("a", "train"), ("b", "val")], "id string, split string")
    problems = lambda t: t["records"].join(t["images"], "id", "left_anti").select(F.lit("no image").alias("issue"), F.col("id").alias("what"))
    sinks.bundle(spark, {"records": records, "images": records.select("id")}, target, problems, resume)
    assert spark.read.parquet(f"{target}/records").count() == 2 and sinks.bundle_differences(spark, target).count() == 0 and sinks.resumed(spark, resume, "images") is None
    with pytest.raises(ValueError, match=r"no image \(1\)"):
        sinks.bundle(spark, {"records": records, "images": records.select("id").where("id = 'a'")}, target, problems, resume)
    assert spark.read.parquet(f"{target}/images").count() == 2 and sinks.resumed(spark, resume, "images").count() == 1
    part = next((tmp_path / "release/images").glob("part-*"))
    part.write_bytes(b"x" + part.read_bytes()[1:])
    for crc in (tmp_path / "release/images").glob(".*.crc"):
        crc.unlink()
    assert [r["status"] for r in sinks.bundle_differences(spark, target).collect()] == ["changed"]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["release", "resume"]


def test_registry():
    r = readers.Registry()
    r.add("a")(lambda: 1)
    assert r.load("a") == 1 and r.names() == ["a"]
    with pytest.raises(KeyError):
        r.load("b")


def test_streams(spark, tmp_path):
    boards = spark.createDataFrame([([1, 0], [1, 2]), ([0, 2], [0, 1])], "pred array<int>, truth array<int>")
    boards.write.parquet(str(tmp_path / "in"))
    query = incremental.running_errors(spark.readStream.schema(boards.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("errors").start()
    query.processAllAvailable()
    query.stop()
    assert {r["cell"]: (r["occupancy_wrong"], r["type_wrong"]) for r in spark.table("errors").collect()} == {0: (0, 0), 1: (1, 1)}
    log = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 1, 3)], "k string, seq int, v int")
    log.write.parquet(str(tmp_path / "log"))
    for _ in range(2):
        incremental.upsert_log(spark.readStream.schema(log.schema).parquet(str(tmp_path / "log")), str(tmp_path / "table"), ["k"], "seq", str(tmp_path / "ck")).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "table")).collect()) == [("a", 2, 2), ("b", 1, 3)]
