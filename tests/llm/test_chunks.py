"""Content-defined chunks and repeated spans against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from gridloom.llm import chunks

from .odd import ODD, empty

R = random.Random(21)


def fresh(n):
    """Words that no other call gives."""
    return " ".join(f"{R.choice(['la', 'ñu', 'tor', '漢', 'en'])}{R.randrange(10**7)}" for _ in range(n))


def pieces(text):
    _, begin, end, *_ = chunks.chunks_of([text])
    return list(zip(begin.tolist(), end.tolist(), strict=True))


def brute(rows, min_run, within):
    """Spans as repeated_spans() has them, by a dict of chunk texts and comparison of the texts beyond the ends."""
    places = {}
    for row, doc_id, t in rows:
        for a, b in pieces(t):
            places.setdefault(t[a:b], []).append((doc_id, row, a))
    text = {row: t for row, _, t in rows}

    def reach(row, at, row2, at2, side):
        out = 0
        for k in chunks.STEPS:
            x = text[row][at - k : at] if side < 0 and at >= k else text[row][at : at + k] if side > 0 else ""
            y = text[row2][at2 - k : at2] if side < 0 and at2 >= k else text[row2][at2 : at2 + k] if side > 0 else ""
            if len(x) == len(y) == k and x == y:
                out = k
        return out

    out = []
    for row, doc_id, t in rows:
        run = []
        for a, b in [*pieces(t), (None, None)]:
            held = sorted(places[t[a:b]]) if a is not None else []
            again = len(held) > 1 if within else len({r for _, r, _ in held}) > 1
            if run and (not again or run[-1][1] != a):
                first = run[0][2], run[-1][2]
                start = run[0][0] - reach(row, run[0][0], first[0][1], first[0][2], -1)
                end = run[-1][1] + reach(row, run[-1][1], first[1][1], first[1][2] + run[-1][1] - run[-1][0], 1)
                if end - start >= min_run:
                    out.append((doc_id, start, end, len(run), sum(r[3] for r in run), min(r[4] for r in run)))
                run = []
            if again:
                extra = (doc_id, row, a) != held[0]
                run.append((a, b, held[0] if extra else held[-1], extra, held[0][0]))
    return sorted(out)


def test_repeated_spans_by_brute_force(spark):
    """Passages in several documents, within one, beside each other and at the ends; short stock phrases; repeated rows."""
    passages, phrase = [fresh(60) for _ in range(6)], fresh(4)
    texts = [fresh(30) + " " + " ".join(R.sample(passages, R.randrange(3))) + " " + phrase + fresh(R.randrange(40)) + " " + R.choice(passages) for _ in range(40)]
    texts += ["", "x", passages[0], passages[0], passages[1] + passages[1], "again and again. " * 60, "z" * 9000, "漢" * 5000]
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in enumerate(texts)], "doc_id long, text string, row int, place int").coalesce(1)
    for within in (False, True):
        for least in (200, 60):
            got = sorted(tuple(r) for r in chunks.repeated_spans(df, least, within).select("doc_id", "start", "end", "chunks", "n_extra", "first_doc_id").collect())
            want = brute([(k, k, t) for k, t in enumerate(texts)], least, within)
            # a reach is a step too far once in 255 ends
            assert len({*got} ^ {*want}) <= 0.03 * len(want) and len(got) == len({*got})
            assert got and (within or all(d != 45 for d, *_ in got))
    assert {46, 47} <= {r["doc_id"] for r in chunks.repeated_spans(df, within=True).collect()}


def test_recall_on_short_passages(spark):
    """Passages of 51 words of six letters, each in two documents of their own, at other places of these."""
    rows, held = [], {}
    for k in range(400):
        p = " ".join("".join(R.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(R.randrange(3, 8))) for _ in range(51))
        for j in (0, 1):
            before = fresh(R.randrange(60))
            rows.append((2 * k + j, before + " " + p + " " + fresh(30)))
            held[2 * k + j] = (len(before) + 1, len(before) + 1 + len(p))
    rows += [(2000 + k, fresh(150)) for k in range(200)]
    got = {r["doc_id"]: r for r in chunks.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    share = len(set(got) & set(held)) / len(held)
    covered = np.mean([(got[d]["end"] - got[d]["start"]) / (b - a) for d, (a, b) in held.items() if d in got])
    print("recall", share, "covered", covered)
    assert share >= 0.99 and covered >= 0.9 and set(got) <= set(held)
    beyond = [d for d in got if got[d]["start"] < held[d][0] - 2 or got[d]["end"] > held[d][1] + 2]
    assert len(beyond) <= 0.05 * len(got)


def test_the_query_by_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in chunks.op6_chunks(spark, folder).collect())
    want = brute(rows, chunks.MIN_RUN, False)
    assert want and len({*got} ^ {*want}) <= 0.03 * len(want) and len(got) == len({*got})


def test_no_passage_is_lost(spark):
    """1,500 passages, each in two documents with prose of their own, of a vocabulary that repeats by chance."""
    vocab = ["the", "of", "and", "ering", "ionth", "la", "que", "con", "ness", "ly"] + ["".join(R.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(R.randrange(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(R.choice(vocab) for _ in range(n))
    parts = {2 * k + j: (prose(R.randrange(60)), p, prose(30)) for k in range(1500) for p in [prose(60)] for j in (0, 1)}
    texts = {d: " ".join(x) for d, x in parts.items()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(2)
    spans = chunks.repeated_spans(df).collect()
    assert len(spans) >= 2990
    for s in spans:  # first copies have nothing extra and name themselves, second ones name them
        assert s.first_doc_id == s.doc_id // 2 * 2 and (s.n_extra == 0) == (s.doc_id % 2 == 0)
    for within in (True, False):
        out = {r.doc_id: r.text for r in chunks.remove_repeats(df, within=within).collect()}
        for d, text in texts.items():
            if d % 2 == 0:
                assert out[d] == text
            elif out[d] != text:
                same = next((k for k, (a, b) in enumerate(zip(text, out[d], strict=False)) if a != b), len(out[d]))
                gone = [text[k : k + len(text) - len(out[d])] for k in range(max(0, same - 80), same + 1) if text[:k] + text[k + len(text) - len(out[d]) :] == out[d]]
                assert any(g in texts[d - 1] for g in gone)  # one stretch, and it stands in the first copy still
        assert sum(out[d] != t for d, t in texts.items()) >= 1490


def test_chunks_are_not_short():
    text = " ".join(R.choice(["a", "the", "of", "x,"]) + R.choice(["", "ing", "漢"]) for _ in range(20_000))
    sizes = [b - a for a, b in pieces(text)]
    assert min(sizes) > chunks.APART and abs(np.mean(sizes) - 2 * chunks.APART - 1) < 3 and max(sizes) < 400


def test_cuts(odd, spark):
    texts = [t or "" for t in ODD]
    of, begin, end, *rest = chunks.chunks_of(texts)
    for k, t in enumerate(texts):
        alone = chunks.chunks_of([t])
        here = of == k
        assert "".join(t[a:b] for a, b in pieces(t)) == t and all(0 < b - a <= chunks.MOST for a, b in pieces(t))
        assert all((x[here] == y).all() for x, y in zip((begin, end, *rest), alone[1:], strict=True))  # whatever stands beside it
    assert chunks.repeated_spans(empty(odd)).count() == 0 and chunks.repeated_spans(odd).where("doc_id = 99").count() >= 1


def test_remove_repeats(spark, odd):
    p = fresh(80)
    rows = [(1, fresh(20) + " " + p + " " + fresh(20), "a"), (2, "start " + p + " end", "b"), (3, p + " mid " + p, "c"), (4, None, "d"), (5, "", "e"), (6, fresh(50), "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string").withColumn("spans", F.lit(7))
    out = {r["doc_id"]: r for r in chunks.remove_repeats(df).collect()}
    assert out[1]["text"] == rows[0][1] and out[6]["text"] == rows[5][1] and out[4]["text"] is None and out[5]["text"] == ""
    assert out[2]["row"] == "b" and out[2]["spans"] == 7 and len(out[2]["text"]) < 120 and out[2]["text"].startswith("start") and len(out[3]["text"]) < 250
    assert chunks.remove_repeats(odd).count() == odd.count() and chunks.remove_repeats(empty(odd)).count() == 0
