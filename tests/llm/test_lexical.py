"""Lexical search held against plain loops and SQL."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import lexical

from .odd import LOWER, R, empty, prose


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def ranked(docs, items, k):
    split = [(i, Counter(words(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in split), sum(sum(c.values()) for _, c in split)
    df = Counter(w for _, c in split for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in split:
            m = 50 + 50 * sum(c.values()) * n // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in {*words(text)} if c[w])
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("k", "part"), [(5, 8192), (50, 3)])
def test_ranks(spark, odd, k, part, monkeypatch):
    monkeypatch.setattr(lexical, "PART", part)
    texts = [prose(R.randrange(1, 120)) for _ in range(150)]
    more = spark.createDataFrame([(200 + j, t) for j, t in enumerate(texts + texts[:40])], "doc_id long, text string")
    docs = odd.unionByName(more, allowMissingColumns=True).repartition(3)
    items = [(1, prose(20)), (2, texts[7]), (3, None), (4, " ?!"), (5, "Ünknown zzz"), (1, texts[9]), (6, "the THE the"), (7, "é" * 3000 + " 漢字")]
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, rank string")
    got = lexical.rank(docs, asked, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, got.collect()), key=str) == ranked(rows, items, k)


def test_many_passes_and_empty_tables(spark, odd):
    asked = spark.createDataFrame([(j, prose(12)) for j in range(20)], "item_id long, text string")
    once = sorted(map(tuple, lexical.rank(odd, asked, 5).collect()), key=str)
    assert once and once == sorted(map(tuple, lexical.rank(odd, asked, 5, most_terms=30).collect()), key=str)
    assert lexical.rank(empty(odd), asked, 5).count() == 0
    assert lexical.rank(odd.withColumn("text", F.lit(" ")), asked, 5).count() == 0
    assert lexical.rank(odd, asked.where("item_id < 0"), 5).count() == 0


def test_reading_stops_early():
    """Long lists, few documents far ahead of the rest: few places are read, and the best are the same."""
    rng = np.random.default_rng(3)
    docs, terms = 4000, 6
    impact = rng.integers(1, 50, (docs, terms))
    impact[rng.choice(docs, 20, replace=False)] += 1000
    doc, term = (x.ravel() for x in np.meshgrid(np.arange(docs), np.arange(terms), indexing="ij"))
    lists = lexical.Lists(doc, term, impact.ravel(), np.arange(docs))
    at, score, read = lists.search(np.arange(terms), 10, np.zeros(0, np.int64))
    total = impact.sum(1)
    assert sorted(score)[-10:] == sorted(total)[-10:] and (total[at] == score).all()
    assert read < 0.1 * docs * terms
    # a floor from elsewhere above all of these stops at once; one that they tie with does not lose them
    assert lists.search(np.arange(terms), 10, np.full(10, 10**9))[2] == terms * lexical.STEP
    best = np.sort(total)[-1]
    at, score, _ = lists.search(np.arange(terms), 1, np.array([best]))
    assert best in score


def test_by_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    want = con.execute(lexical.OP13_SQL).fetchall()
    got = lexical.op13_lexical(spark, folder)
    assert got.columns == [d[0] for d in con.description] and sorted(map(tuple, got.collect())) == sorted(want)
