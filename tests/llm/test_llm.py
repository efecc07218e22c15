"""Operators of gridloom.llm against brute force, on texts with every odd case."""

import hashlib
import random
import re
import string
import time

import duckdb
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, pieces, simhash
from gridloom.llm.common import tokenizer_file

from .odd import LOWER, ODD, R, empty, prose


def plain_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def test_decontaminate(spark, odd):
    w = ODD[5].split()
    items = spark.createDataFrame([(1, " ".join(w[10:30])), (12, " ".join(w[25:28])), (3, ""), (4, None), (5, "WORD"), (6, " ".join(w[20:45])), (7, prose(30))], "item_id long, text string")
    found = decontaminate.find(odd, items).collect()
    grams = {}
    for i, t in items.collect():
        q = plain_words(t)
        n = min(10, len(q))
        for a in range(len(q) - n + 1 if n else 0):
            grams.setdefault(tuple(q[a : a + n]), set()).add(str(i))
    for r in found:
        q, hit, ids = plain_words(r["text"]), set(), set()
        for n in {len(g) for g in grams}:
            for a in range(len(q) - n + 1):
                if tuple(q[a : a + n]) in grams:
                    hit |= set(range(a + 1, a + n + 1))
                    ids |= grams[tuple(q[a : a + n])]
        assert (r["n_words"], r["hit"], r["items"]) == (len(q), sorted(hit), sorted(ids)), r["doc_id"]
    assert len(found) == odd.count() and sum(len(r["hit"]) > 0 for r in found) >= 3
    cut = decontaminate.remove_spans(decontaminate.find(odd, items))
    again = decontaminate.find(cut.select("doc_id", "text"), items.where("item_id = 1")).where("doc_id = 5").collect()
    assert all(not r["hit"] for r in again)
    assert decontaminate.find(empty(odd), items).count() == 0
    assert all(not r["hit"] for r in decontaminate.find(odd, items.where("item_id = 3")).collect())


def test_pieces_are_the_library_s(spark, odd):
    enc = pieces.encoder(tokenizer_file(pieces.MODEL))
    texts = [t or "" for t in ODD] + ["".join(R.choice("ab \n\té漢🙂▁<>/s0the and ing=-") for _ in range(R.randrange(90))) for _ in range(400)] + ["thethe" * 50, "=" * 300, "   x  y"]
    for t, (ids, decoded) in zip(texts, enc.encode(texts), strict=True):
        want = enc.library.encode(t, add_eos=True)
        assert ids == " ".join(map(str, want)) and decoded == enc.library.decode(want)
    got = pieces.tokenize(odd, tokenizer_file(pieces.MODEL), texts=True)
    row = got.where("doc_id = 0").first()
    assert (row["n_tokens"], row["ids"], row["decoded"]) == (1, "2", "") and got.count() == odd.count() and pieces.tokenize(empty(odd), tokenizer_file(pieces.MODEL)).count() == 0


def test_long_words_take_time_in_proportion():
    """Unbroken words of every kind, as the library encodes them; a million characters in seconds."""
    path = tokenizer_file(pieces.MODEL)
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Encoder(path)
    keys = string.ascii_letters + string.digits + "+/"
    kinds = {"base64": [*keys], "syllable": ["the"], "letters": [*"acgt"], "one": ["a"], "line": ["="], "words": ["the", "ing", "tion", "er", "re", "q"], "wide": [*"漢字é日本e语"]}
    for name, parts in kinds.items():
        for n in (pieces.LONG - 1, pieces.LONG, 1000, 10_000, 100_000, *([1_000_000] if name in ("base64", "syllable", "letters") else [])):
            text = "".join(R.choices(parts, k=max(1, n // len(parts[0]))))
            began = time.perf_counter()
            ids, decoded = own.encode([text])[0]
            took = time.perf_counter() - began
            want = lib.encode(text)
            assert ids == " ".join(map(str, [*want, lib.eos_id()])) and decoded == lib.decode(want), (name, n)
            assert took < 1 + 20e-6 * n, (name, n, took)


def test_both_ways_of_minima_agree(monkeypatch):
    """Short words by the minimum over as many neighbours as a long one's, too."""
    own = pieces.Encoder(tokenizer_file(pieces.MODEL))
    vocab = [p for p in R.sample(sorted(own.id_of), 3000) if " " not in p]
    words = ["▁" + "".join(R.choices(R.choice([vocab, [*"abcdeth"], [*"aA=-"], ["in", "g", "ti", "on", "n"]]), k=R.randrange(1, 25))) for _ in range(6000)]
    sym, ends = own._short(words)
    want = [p.tolist() for p in np.split(sym, ends[:-1])]
    monkeypatch.setattr(pieces, "LONG", 0)
    sym, ends = own.merged(words)
    assert [p.tolist() for p in np.split(sym, ends[:-1])] == want


def test_simhash_groups(spark, odd, monkeypatch):
    import xxhash

    extra = [(200 + k, ODD[5].replace("the", "thee", k)) for k in range(4)]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    prints = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        prints.append(sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)))
    root = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if bin(prints[i] ^ prints[j]).count("1") <= 2:
                    root[i] = root[j] = min(root[i], root[j])
    least = {k: min(rows[i][0] for i in range(len(rows)) if root[i] == k and rows[i][0] is not None) if any(root[i] == k and rows[i][0] is not None for i in range(len(rows))) else None for k in set(root)}
    want = sorted(((rows[i][0], prints[i], least[root[i]]) for i in range(len(rows))), key=str)
    for crowded in (32, 1):
        monkeypatch.setattr(simhash, "CROWDED", crowded)
        assert sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.groups(docs).collect()), key=str) == want
    assert simhash.groups(empty(odd)).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert all(got[k] == 0 for k in range(1, 41)) and got[101] == 100


def test_drop_near(spark, odd):
    base = prose(300).split()
    variants = []
    for k in range(30):
        v = [*base]
        for at in R.sample(range(300), k % 6):
            v[at] = f"new{k}{at}"
        variants.append((1000 + k, " ".join(v)))
    others = [(2000 + k, prose(200)) for k in range(10)]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(variants + others, "doc_id long, text string"))
    kept = simhash.drop_near(docs.withColumn("key", F.lit(1)))
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None and i >= 1000) == [1000] + [2000 + k for k in range(10)]
    assert ids.count(5) == 1 and 99 not in ids and 6 in ids and len({0, 1} & set(ids)) == 1 and kept.columns == ["doc_id", "text", "key"]
    assert simhash.drop_near(empty(odd)).count() == 0


def test_drop_near_in_a_crowded_family(spark):
    """300 copies of one text with six edits each: near to the text itself, to few others, so to no leader."""
    r = random.Random(5)
    base = [f"w{k}" for k in range(300)]
    texts = [" ".join(base)]
    for k in range(300):
        v = [*base]
        for at in r.sample(range(300), 6):
            v[at] = f"new{k}x{at}"
        texts.append(" ".join(v))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n):
                i_, j_ = top(i), top(j)
                root[max(i_, j_)] = min(i_, j_)
    want = sorted({top(i) for i in range(len(texts))})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(r["doc_id"] for r in simhash.drop_near(docs).collect())
    print("kept", len(got), "brute force", len(want))
    assert got == want


def test_pipeline_on_the_small_tables(spark):
    import corpus_pipeline as cp

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = cp.run(spark, folder)
    ids = [r["doc_id"] for r in out.select("doc_id").collect()]
    assert 0 < len(ids) == len(set(ids)) < docs.count() and "ids" in out.columns
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
    digest = {r["doc_id"]: r["decoded_sha256"] for r in out.collect()}
    kept = docs.where(F.col("doc_id").isin(ids)).collect()
    assert sum(digest[r["doc_id"]] == hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in kept) > len(kept) / 2


@pytest.mark.parametrize("bits", [0, 1, 2])
def test_links_at_each_distance(spark, monkeypatch, bits):
    """Groups at 0, 1 and 2 bits, in cells that are paired up and in crowded ones."""
    r = random.Random(4)
    seeds = [r.getrandbits(64) for _ in range(12)]
    prints = sorted({s ^ sum(1 << b for b in r.sample(range(64), r.randrange(4))) for s in seeds for _ in range(12)})
    root = {p: p for p in prints}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for p in prints:
        for q in prints:
            if p < q and (p ^ q).bit_count() <= bits:
                root[max(top(p), top(q))] = min(top(p), top(q))
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    groups = {}
    for p in prints:
        groups.setdefault(top(p), set()).add(signed(p))
    for crowded in (32, 1):
        monkeypatch.setattr(simhash, "CROWDED", crowded)
        fps = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
        roots = {x["node"]: x["root"] for x in simhash.components(simhash.links(fps, bits)).collect()}
        got = {}
        for p in prints:
            got.setdefault(roots.get(signed(p), signed(p)), set()).add(signed(p))
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))
    with pytest.raises(ValueError):
        simhash.links(fps, 3)


def test_drop_near_when_nodes_collide(spark, monkeypatch):
    """Texts that share a node by chance: none goes as a copy of another."""
    monkeypatch.setattr(simhash, "text_keys", lambda t: (F.length(t).cast("long"), F.hash(t)))
    rows = [(1, "one two three four"), (2, "two one four three"), (3, "two one four three"), (4, "x"), (5, "y"), (6, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tid", F.lit(0)).withColumn("n", F.lit(3))
    kept = simhash.drop_near(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4, 5, 6] and kept.columns == docs.columns


def test_near_copies_recall_on_a_given_table(spark):
    """The stage against exact likenesses of all pairs, found by an inverted list of shingles."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    first = {}
    for k, t in sorted((r["doc_id"], r["text"] or "") for r in docs.collect()):
        first.setdefault(t, k)
    sets, held = {}, {}
    for t, k in first.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER))
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        for s in sets[k]:
            held.setdefault(s, []).append(k)
    common = {}
    for ks in held.values():
        for i, a in enumerate(ks):
            for b in ks[:i]:
                common[a, b] = common.get((a, b), 0) + 1
    root = {k: k for k in sets}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    pairs = [(a, b) for (a, b), n in common.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    for a, b in pairs:
        root[max(top(a), top(b))] = min(top(a), top(b))
    want = {top(k) for k in sets}
    got = {r["doc_id"] for r in simhash.drop_near(docs).collect()}
    print("pairs", len(pairs), "kept", len(got), "brute force", len(want))
    assert got == want


def test_op3_op4_op7_on_the_small_tables(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    want = sorted(con.execute(f"select doc_id, n_words, n_hit, n_items, items_sha256, contaminated from ({decontaminate.OP3_SQL})").fetchall())
    assert sorted(tuple(r) for r in decontaminate.op3_decontaminate(spark, folder).collect()) == want
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    lib = pieces.encoder(tokenizer_file(pieces.MODEL)).library
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in pieces.op4_pieces(spark, folder).collect():
        ids = lib.encode(texts[r["doc_id"]], add_eos=True)
        assert tuple(r)[1:] == (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids)))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op7_simhash(spark, folder).collect()}
    assert got.keys() == texts.keys()
    prints = {k: int(f, 16) for k, (f, _) in got.items()}
    assert all(prints[k] == simhash.text_fingerprint(texts[k], 3) % (1 << 64) for k in texts)
    assert all(got[k][1] == got[j][1] for k in texts for j in texts if (prints[k] ^ prints[j]).bit_count() <= 2)


def test_pipeline_stages_on_odd_documents(spark, odd, tmp_path):
    """Nulls, empty and long texts, repeated rows and ids, extra columns, and an empty table, through every stage."""
    import corpus_pipeline as cp

    labels = spark.createDataFrame([(k, 1, int(k == 3)) for k in range(8)] + [(None, None, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, " ".join(ODD[5].split()[10:30])), (2, None)], "item_id long, text string")
    for n, (docs, marks, bench) in enumerate([(odd, labels, items), (empty(odd), labels.where("false"), items.where("false"))]):
        folder = f"{tmp_path}/{n}"
        for name, df in (("documents", docs), ("labels", marks), ("benchmark", bench)):
            df.write.parquet(f"{folder}/{name}.parquet")
        stored = spark.read.parquet(f"{folder}/documents.parquet")
        for name, stage in cp.STAGES:
            out = stage(spark, stored, folder)
            kept = out.count()
            assert out.columns == stored.columns or name == "tokens"
            same = {"doc_id", "lang", "score", "base", "hit"}  # columns that operators have names of
            assert {tuple(r) for r in out.select(*sorted(same)).collect()} <= {tuple(r) for r in stored.select(*sorted(same)).collect()}
            assert kept <= stored.count() and (name not in ("personal data", "tokens") or kept == stored.count())
        ids = [r["doc_id"] for r in cp.run(spark, folder).collect()]
        assert len(ids) == len(set(ids)) and (n == 0) == bool(ids)
