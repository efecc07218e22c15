"""Toxicity on rows held out, and its scores by hand."""

import random
import zlib

import numpy as np
import zstandard

from gridloom.llm import toxicity

from .odd import ODD, R, empty, prose


def test_toxicity(spark, odd):
    bad = ["scumbag", "moronic", "vile", "idiot"]
    texts, labels = [], []
    for k in range(300):
        w = prose(60).split()
        for _ in range(4 if k % 3 == 0 else 0):
            w[R.randrange(60)] = R.choice(bad)
        texts.append(" ".join(w))
        labels.append(int(k % 3 == 0))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    marks = spark.createDataFrame([(k, y, 1) for k, y in enumerate(labels)], "doc_id long, toxic int, quality int")
    model = toxicity.train(docs, marks)
    scored = {r["doc_id"]: (r["held"], r["score"]) for r in toxicity.score(docs, model).select("doc_id", toxicity.held_out("doc_id").alias("held"), "score").collect()}
    assert {k for k, (h, _) in scored.items() if h} == {k for k in range(300) if zlib.crc32(str(k).encode()) % 5 == 0}
    assert np.mean([(s >= 0.5) == labels[k] for k, (h, s) in scored.items() if h]) >= 0.95
    odd_scores = toxicity.score(odd, model).collect()
    assert len(odd_scores) == odd.count() and all(0 <= r["score"] <= 1 for r in odd_scores)
    assert toxicity.keep_ordinary(docs, marks).columns == ["doc_id", "text"] and toxicity.score(empty(odd), model).count() == 0
    blank = toxicity.train(docs, marks.where("false"))
    assert all(0 <= s <= 0.5 for s in blank.scores([None, "", "idiot"]))


def test_toxicity_at_its_caps(spark):
    """Lowered caps, by which half of the sample is toxic and not a tenth, leave the scores nearly as they were."""
    r = random.Random(3)
    rows = []
    for k in range(6000):
        y = int(k % 10 == 0)
        # bad words stand in ordinary texts too, so that many likelihoods are neither 0 nor 1
        w = [r.choice(["scumbag", "moronic", "vile", "idiot"]) if r.random() < (0.08 if y else 0.02) else f"word{r.randrange(80)}" for _ in range(30)]
        rows.append((k, " ".join(w), y))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    texts = [t for _, t, _ in rows]
    whole = toxicity.train(docs, docs).scores(texts)
    capped = toxicity.train(docs, docs, 400, 400).scores(texts)
    print("mean", whole.mean(), capped.mean(), "same", ((whole >= 0.5) == (capped >= 0.5)).mean(), "toxic", (whole >= 0.5).mean(), (capped >= 0.5).mean())
    assert abs(whole.mean() - capped.mean()) < 0.03 and ((whole >= 0.5) == (capped >= 0.5)).mean() >= 0.95


def test_scores_by_hand(spark):
    """Distances by one compressor call for each window and dictionary, features and the logistic score spelled out."""
    rows = [(k, f"the quick brown word{k % 7} jumps " + ("you IDIOT! moron " if k % 4 == 0 else "you friend dear ") + f"over {k}", int(k % 4 == 0)) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs, docs)
    assert b" idiot" in model.toxic and b" idiot" not in model.ordinary and b" friend" in model.ordinary and b" friend" not in model.toxic

    def length(dictionary, data):
        params = zstandard.ZstdCompressionParameters.from_level(toxicity.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        return len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params).compress(data))

    for t in [*ODD[:8], rows[0][1], rows[1][1]]:
        found = []
        for w in [w.strip(".,!?*#%$&|()").lower() for w in (t or "").split()]:
            held = toxicity.CARRIER + b" " + w.encode() + b" " + toxicity.CARRIER
            found.append(length(model.ordinary, held) - length(model.toxic, held))
        n, beyond = max(1, len(found)), [sum(d >= k for d in found) for k in range(1, 9)]
        x = np.array([*np.log1p(beyond), *np.sqrt(np.array(beyond) / n), np.log(n), np.mean(found) if found else 0.0])
        want = 1 / (1 + np.exp(-(((x - model.mean) / model.scale) @ model.weight[:-1] + model.weight[-1])))
        assert abs(model.scores([t])[0] - want) < 1e-9


def test_op10_on_the_small_tables(spark):
    folder = "/root/testdata/sf0.01"
    marks = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = toxicity.op10_toxicity(spark, folder).collect()
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got)
    held = [(r["predicted"], marks[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in marks]
    assert np.mean([p == y for p, y in held]) >= 0.9
    again = {r["doc_id"]: r["score"] for r in toxicity.op10_toxicity(spark, folder).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-9 for r in got)
