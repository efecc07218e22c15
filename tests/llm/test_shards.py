"""Token shards against the tokenizers library and plain arrays."""

import zlib

import numpy as np

from gridloom.llm import shards
from gridloom.llm.common import tokenizer_file

from .odd import R, empty


def test_wavelet_matrix():
    for n in (3001, shards.CHUNK, 3 * shards.CHUNK + 77):
        ids = np.array([R.choice([7, R.randrange(40000)]) for _ in range(n)], np.uint16)
        w = shards.WaveletMatrix(shards.WaveletMatrix.pack(ids))
        assert (w.all() == ids).all() and (w.access(np.arange(n)) == ids).all()
        for token in (7, int(ids[5]), int(ids[-1]), 60000, 1 << 20):
            for end in (0, 1, 1234, n // 2, n):
                assert w.rank(token, end) == (ids[:end] == token).sum()
            assert w.count(token) == (ids == token).sum() and (w.occurrences(token) == np.flatnonzero(ids == token)).all()
    none = shards.WaveletMatrix(shards.WaveletMatrix.pack(ids[:0]))
    assert len(none.all()) == 0 and none.count(7) == 0 and len(none.occurrences(7)) == 0


def test_rank_and_select_inflate_few_chunks():
    """One access reads one chunk of each plane, a rank two, an occurrence one, whatever the size of the file."""
    ids = np.array(np.random.default_rng(5).integers(0, 40000, 20 * shards.CHUNK), np.uint16)
    ids[777_777] = 50_000
    data = shards.WaveletMatrix.pack(ids)
    for ask, most in ((lambda w: w.access([777_777]), 16), (lambda w: w.rank(9, 700_000), 32), (lambda w: w.occurrences(50_000), 48)):
        w = shards.WaveletMatrix(data)
        ask(w)
        assert w.bits == 16 and 0 < len(w.inflated) <= most < w.bits * w.chunks
    assert shards.WaveletMatrix(data).occurrences(50_000).tolist() == [777_777]
    directories = len(data) - shards.WaveletMatrix(data).body + shards.WaveletMatrix(data).blocks.nbytes
    assert len(data) < 1.1 * 2 * len(ids) and directories > 0


def wanted(rows, lib):
    out, at = [], 0
    for k, t in rows:
        ids = [*lib.encode(t, add_special_tokens=False).ids, 2]
        out.append((None if k == -1 else k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    return out


def test_shards(spark, odd, monkeypatch):
    path = tokenizer_file(shards.MODEL)
    lib = shards.encoder(path).library
    key = lambda t: np.array([*lib.encode(t, add_special_tokens=False).ids, 2], "<u2").tobytes()
    rows = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in odd.collect()), key=lambda r: (r[0], key(r[1])))
    want = wanted(rows, lib)
    for docs, ids in ((5, 8_000_000), (4096, 50), (2, 1)):
        monkeypatch.setattr(shards, "SHARD_DOCS", docs)
        monkeypatch.setattr(shards, "FILE_IDS", ids)
        folder = shards.write_shards(odd, path)
        got = [tuple(r) for r in shards.read_shards(spark, folder, ids=True).collect()]
        assert sorted(got, key=lambda r: r[1]) == want
        token = want[6][4][0]
        places = [r["place"] for r in shards.look_up(spark, folder, token).collect()]
        assert sorted(places) == [a + k for _, a, _, _, ids in want for k, i in enumerate(ids) if i == token]
    assert shards.read_shards(spark, shards.write_shards(empty(odd), path)).count() == 0


def test_encoder_is_the_library():
    enc = shards.encoder(tokenizer_file(shards.MODEL))
    texts = ["".join(R.choice("aAbB.,''sS tT\n\r\x1c\x85 éÉİΣς漢🙂12'll<|é") for _ in range(R.randrange(60))) for _ in range(1500)] + ["<|endoftext|> a", "x<|endoftext|>y", None, "", "é" * 9000]
    want = [enc.library.encode(t or "", add_special_tokens=False).ids for t in texts]

    def encoded():
        tokens, bound = enc.encode(texts)
        return [tokens[a:b].tolist() for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)]

    assert enc.by_words and encoded() == want
    enc.by_words = False  # as for a file that doesn't cut at words
    try:
        assert encoded() == want
    finally:
        enc.by_words = True


def test_op5_on_the_small_tables(spark):
    folder = "/root/testdata/sf0.001"
    lib = shards.encoder(tokenizer_file(shards.MODEL)).library
    rows = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    got = sorted(tuple(r) for r in shards.op5_token_shards(spark, folder).collect())
    assert got == [w[:4] for w in wanted(rows, lib)]
