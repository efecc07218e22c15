"""Sketches and neighbours against plain Python."""

import hashlib
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from gridloom.llm import sketch

from .odd import LOWER, ODD, R, empty, prose

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain_sketch(spark_hash, text, scale=sketch.SCALE):
    """By sets; spark_hash has the 63-bit hash of each shingle of any of the texts."""
    import re

    w = re.findall(WORD, (text or "").translate(LOWER))
    all_ = {spark_hash(tuple(w[i : i + 5])) for i in range(max(1, len(w) - 4))} if w else set()
    low = sorted(x for x in all_ if x < (1 << 63) // scale)
    return low or sorted(all_)[:1]


def spark_hash(words):
    """xxhash64 of Spark over the words' own hashes: each is the seed of the next."""
    h = 42
    for w in words:
        one = xxhash.xxh64_intdigest(w.encode(), 42)
        h = xxhash.xxh64_intdigest(struct.pack("<Q", one), h)
    # shingles of fewer words leave the seed as it is: a null changes nothing
    return h & (1 << 63) - 1


def plain_likeness(a, b, scale=sketch.SCALE):
    stand_in = lambda s: not s or s[0] >= (1 << 63) // scale
    if not a and not b:
        return 1.0
    if stand_in(a) != stand_in(b):
        return 0.0
    return len({*a} & {*b}) / len({*a} | {*b})


def written(s):
    return "".join(f"{x:016x}" for x in s)


def wanted(rows):
    """All columns of op8 for (doc_id, text) rows in order."""
    out = []
    for i, (k, t) in enumerate(rows):
        t, following = t or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        s, e, f = (plain_sketch(spark_hash, x) for x in (t, edited, following))
        out.append((k, len(t), hashlib.sha256(edited.encode()).hexdigest(), written(s), written(e), plain_likeness(s, e), plain_likeness(s, f)))
    return out


@pytest.mark.parametrize("bucket_rows", [2000, 3])
def test_op8_by_brute_force(spark, odd, monkeypatch, tmp_path, bucket_rows):
    """Null ids and texts, repeated ids, empty and long texts; in one bucket and in several."""
    monkeypatch.setattr(sketch, "BUCKET_ROWS", bucket_rows)
    docs = odd.select("doc_id", "text")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    got = sorted((tuple(r) for r in sketch.op8_fingerprint(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(wanted(rows), key=str)


def test_op8_on_the_small_tables(spark):
    folder = "/root/testdata/sf0.001"
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    assert sorted(tuple(r) for r in sketch.op8_fingerprint(spark, folder).collect()) == wanted(rows)


def test_one_row_and_none(spark, tmp_path):
    df = spark.createDataFrame([(7, "one two three four five six")], "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    row = sketch.op8_fingerprint(spark, str(tmp_path)).first()
    assert row["near_next"] == 1.0 and row["n_chars"] == 27
    ready = sketch.with_next(df.where("false"), {"t": F.col("text")})
    assert ready.count() == 0 and ready.columns == ["doc_id", "text", "t", "next"]


def test_merged_is_the_sketch_of_both(spark, odd):
    """Short and long texts, stand-ins among them: the union of two sketches is the sketch of their shingles together."""
    texts = [t for t in ODD if t] + [prose(n) for n in (6, 7, 9, 12, 40, 900)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string").withColumn("s", sketch.sketch(F.col("text"))).withColumn("all", sketch.sketch(F.col("text"), scale=1))
    a, b = df.select(F.col("i").alias("i"), F.col("s").alias("a"), F.col("all").alias("all_a")), df.select(F.col("i").alias("j"), F.col("s").alias("b"), F.col("all").alias("all_b"))
    both = a.join(b, F.col("i") <= F.col("j"))
    rows = both.select("i", "j", sketch.merged(F.array("a", "b")).alias("m"), F.array_union("all_a", "all_b").alias("u"), "a", "b", "all_a", "all_b", sketch.containment(F.col("a"), F.col("b")).alias("c"), sketch.is_stand_in(F.col("a")).alias("sa"), sketch.is_stand_in(F.col("b")).alias("sb")).collect()
    limit = (1 << 63) // sketch.SCALE
    assert any(r["sa"] and not r["sb"] for r in rows)
    for r in rows:
        low = sorted(x for x in r["u"] if x < limit)
        assert r["m"] == (low or sorted(r["u"])[:1])
        if r["sa"] and not r["sb"] and r["a"]:
            assert r["c"] is None
        else:
            assert r["c"] == (len({*r["a"]} & {*r["b"]}) / len(r["a"]) if r["a"] else 1.0)


def test_containment_of_an_excerpt(spark):
    """An excerpt of 300 words in a text of 6,000: contained, though hardly alike."""
    long = " ".join(f"w{R.randrange(10**6)}" for _ in range(6000))
    part = " ".join(long.split()[2000:2300])
    row = spark.createDataFrame([(part, long)], "a string, b string").select(sketch.sketch(F.col("a")).alias("a"), sketch.sketch(F.col("b")).alias("b"))
    got = row.select(sketch.containment(F.col("a"), F.col("b")).alias("c"), sketch.containment(F.col("b"), F.col("a")).alias("d"), sketch.likeness(F.col("a"), F.col("b")).alias("l")).first()
    assert got["c"] == 1.0 and abs(got["d"] - 0.05) < 0.02 and got["l"] < 0.1


def test_neighbours_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(sketch, "BUCKET_ROWS", 3)
    ids = R.sample(range(1000), 50) + [-7, None]
    df = spark.createDataFrame([(i, f"t{i}", 1, 2) for i in ids], "doc_id long, text string, Next int, guest int")
    order = [None, *sorted(i for i in ids if i is not None)]
    got = {r["doc_id"]: (r["next"]["id"], r["guest"]) for r in sketch.with_next(df, {"id": F.col("doc.doc_id")}).collect()}
    assert [got[i][0] for i in order] == order[1:] + order[:1] and {g for _, g in got.values()} == {2}
    one = sketch.with_next(df.where("doc_id = -7"), {"id": F.col("doc.doc_id")}).first()
    assert one["next"]["id"] == -7
    assert sketch.with_next(empty(df), {"id": F.col("doc.doc_id")}).count() == 0
