"""Substring duplicates by content-defined chunks with a gear rolling hash.

A chunk ends where the rolling hash of the last WINDOW bytes is the least within APART characters either way, so what
is inserted before a passage moves no cut inside it, and a chunk has more than APART characters unless its text has
fewer: none is so short that it repeats by chance everywhere. Chunks with one digest of 96 bits are the same text (of
2.5e12 chunks, 100 TB, two others agree with a probability of 4e-5); the first by doc_id and place stays, the others
are extra. Neighbouring repeated chunks are a run. Cuts agree only inside a passage, so a run lacks what the passage
has before its first and after its last common cut: with each chunk go short hashes of STEPS characters before and
after it, and a run reaches as far as these agree with the other copy's (a step too far once in 255 ends). A run
that reaches over at least MIN_RUN characters is a repeated span: shorter repeats, such as stock phrases, are no
passages. What is cut out of a text are extra chunks alone, never what the short hashes add. All places are in
characters (code points).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, importable, row_key, slices, stored

#: Bytes that a hash depends on, characters either way in which a cut's is the least (chunks have twice as many and one
#: in the mean), greatest characters of a chunk, least characters of a repeated span.
WINDOW, APART, MOST, MIN_RUN = 16, 20, 1023, 200
#: Characters that are chunked at once.
BATCH_CHARS = 2_000_000
#: Characters beyond either end of a chunk that are compared, by a byte of hash each.
STEPS = (16, 32, 56, 96)
#: 256 fixed numbers from a linear congruential rule; the factor of the hashes beyond the ends, and its inverse.
GEAR = np.array([(k * 6364136223846793005 + 1442695040888963407) * 2862933555777941757 >> 17 & 0xFFFFFFFF for k in range(1, 257)], np.uint32)
FACTOR = 6364136223846793005
INVERSE = pow(FACTOR, -1, 1 << 64)


class _Powers:
    """Powers of FACTOR and of its inverse, as far as they were asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= size:
            many = max(size, 2 * len(self.up))
            of = lambda f: np.cumprod(np.append(np.uint64(1), np.full(many, f, np.uint64)), dtype=np.uint64)
            self.up, self.down = of(FACTOR), of(INVERSE)
        return self.up, self.down


_powers = _Powers()


def _hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: the sum of gear[data[i - j]] << j over j < WINDOW."""
    h = GEAR[data]
    width = 1
    while width < WINDOW:
        moved = np.zeros_like(h)
        moved[width:] = h[:-width] << np.uint32(width)
        h = h + moved
        width *= 2
    return h


def _least(h: np.ndarray, size: int) -> np.ndarray:
    """The least of each size neighbouring values, by where they begin."""
    width = 1
    while 2 * width <= size:
        h, width = np.minimum(h[:-width], h[width:]), 2 * width
    return h if width == size else np.minimum(h[: -(size - width)], h[size - width :])


def _cuts(h: np.ndarray) -> np.ndarray:
    """Places of the hashes that are less than the APART before them and no more than the APART after them."""
    if len(h) <= 2 * APART:
        return np.zeros(0, np.int64)
    least, own = _least(h, APART), h[APART:-APART]
    return np.flatnonzero((own < least[: len(own)]) & (own <= least[APART + 1 :])) + APART


def _edges(data: np.ndarray, starts: np.ndarray, begin: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Hashes of STEPS characters before begin (low bytes) and after end (high bytes); 0 beyond low and high, the text's bounds."""
    up, down = _powers.to(len(data))
    sums = np.append(np.uint64(0), np.cumsum(up[: len(data)] * (data.astype(np.uint64) + np.uint64(1)), dtype=np.uint64))

    def hashed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = starts[a], starts[b]
        return np.maximum((sums[b] - sums[a]) * down[a] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56), np.uint64(1))

    out = np.zeros(len(begin), np.uint64)
    for k, step in enumerate(STEPS):
        for inside, a, b, at in ((begin - step >= low, np.maximum(begin - step, low), begin, k), (end + step <= high, end, np.minimum(end + step, high), len(STEPS) + k)):
            out |= np.where(inside, hashed(a, b), np.uint64(0)) << np.uint64(8 * at)
    return out.view(np.int64)


def chunks_of(texts: list[str]) -> tuple:
    """Of several texts at once the text's number, begin and end (in its characters), digest, check (32 more bits of it), and edges, of every chunk.

    The texts lie one after the other with APART zero bytes between them, so no cut depends on another text.
    """
    from xxhash import xxh3_128_digest

    each = [t.encode("utf-8", "surrogatepass") for t in texts]
    gap = bytes(APART)
    raw = b"".join([gap + e for e in each]) + gap
    data = np.frombuffer(raw, np.uint8)
    starts = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    size = np.array([len(e) for e in each], np.int64)
    at = np.cumsum(size + APART) - size
    low, high = np.searchsorted(starts, at), np.searchsorted(starts, at + size)  # the texts' first characters and ends
    h, edge = _hashes(data)[starts[1:] - 1], np.zeros(len(starts), np.int64)
    np.add.at(edge, low, 1)
    np.add.at(edge, high, -1)
    h[np.cumsum(edge)[:-1] == 0] = 0xFFFFFFFF  # between the texts
    cut = _cuts(h) + 1
    of = np.searchsorted(low, cut - 1, "right") - 1
    far = (of >= 0) & (cut - low[of] > APART) & (high[of] - cut > APART)
    end = np.sort(np.append(cut[far], high[size > 0]))
    of = np.searchsorted(low, end - 1, "right") - 1
    begin = np.maximum(np.append(0, end[:-1])[: len(end)], low[of])
    pieces = (end - begin - 1) // MOST + 1
    if (pieces > 1).any():  # long stretches without a cut, such as one character repeated
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        of, begin, end = (np.repeat(x, pieces) for x in (of, begin, end))
        begin = begin + nth * MOST
        end = np.minimum(begin + MOST, end)
    cut = zip(starts[begin].tolist(), starts[end].tolist(), strict=True)
    digest = np.frombuffer(b"".join([xxh3_128_digest(raw[a:b]) for a, b in cut]), np.int64).reshape(-1, 2)
    return of, begin - low[of], end - low[of], digest[:, 0], digest[:, 1] >> 32, _edges(data, starts, begin, end, low[of], high[of])


def chunked(docs: DataFrame) -> DataFrame:
    """row, doc_id, place (begin << 10 | length, in characters), digest, check and edges of every chunk.

    docs has row, doc_id and text; null and empty texts have no chunks.
    """
    import pyarrow as pa

    importable(docs.sparkSession)
    kinds = {"row": pa.int64(), "doc_id": pa.int64(), "place": pa.int64(), "digest": pa.int64(), "check": pa.int32(), "edges": pa.int64()}

    def run(batches: Iterator) -> Iterator:
        for some in slices(batches, BATCH_CHARS):
            of, begin, end, *rest = chunks_of([t or "" for t in some.column("text").to_pylist()])
            values = [*[some.column(c).to_numpy(zero_copy_only=False)[of] for c in ("row", "doc_id")], begin << 10 | end - begin, *rest]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds.values(), strict=True)], names=[*kinds])

    return (
        docs.select("row", "doc_id", "text")
        .mapInArrow(run, "row bigint, doc_id bigint, place bigint, digest bigint, check int, edges bigint")
    )


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        row_key().alias("row"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    )


def _reach(own: Column, other: Column, first: int) -> Column:
    """The most of STEPS characters whose hashes agree up to there, in the bytes of two edges from the one numbered first."""
    byte = lambda e, k: F.shiftrightunsigned(e, 8 * (first + k)).bitwiseAND(255)
    agree = [(byte(own, k) == byte(other, k)) & (byte(own, k) != 0) for k in range(len(STEPS))]
    out = F.when(~agree[0], F.lit(0))
    for k in range(1, len(STEPS)):
        out = out.when(~agree[k], F.lit(STEPS[k - 1]))
    return out.otherwise(F.lit(STEPS[-1]))


def _repeated(keyed: DataFrame, within: bool) -> DataFrame:
    """Every repeated chunk: row, doc_id, start, end, extra, first_doc_id, before and after (its reach)."""
    all_ = chunked(keyed)  # made twice: a table of all chunks is as large as the texts
    here = F.struct("doc_id", "row", "place", "edges")
    met = all_.groupBy("digest", "check").agg(F.min(here).alias("first"), F.max(here).alias("last"))
    twice = met.where(F.col("first") < F.col("last") if within else F.col("first.row") != F.col("last.row"))
    at = F.struct("doc_id", "row", "place")
    extra = at != F.struct("first.doc_id", "first.row", "first.place")
    other = F.when(extra, F.col("first.edges")).otherwise(F.col("last.edges"))
    start = F.shiftright("place", 10)
    return all_.join(twice, ["digest", "check"]).select(
        "row", "doc_id", start.alias("start"), (start + F.col("place").bitwiseAND(1023)).alias("end"), extra.cast("int").alias("extra"), F.col("first.doc_id").alias("first_doc_id"),
        _reach(F.col("edges"), other, 0).alias("before"), _reach(F.col("edges"), other, len(STEPS)).alias("after"),
    )


def _spans(repeated: DataFrame, min_run: int) -> DataFrame:
    """Runs of neighbouring chunks that reach over min_run characters: low and high without, start and end with their reach."""
    w = Window.partitionBy("row", "doc_id").orderBy("start")
    fresh = F.coalesce(F.lag("end").over(w) != F.col("start"), F.lit(True))
    runs = repeated.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(w))
    spans = runs.groupBy("row", "doc_id", "run").agg(
        (F.min("start") - F.min_by("before", "start")).cast("int").alias("start"),
        (F.max("end") + F.max_by("after", "start")).cast("int").alias("end"),
        F.min("start").cast("int").alias("low"),
        F.max("end").cast("int").alias("high"),
        F.count("*").alias("chunks"),
        F.sum("extra").alias("n_extra"),
        F.min("first_doc_id").alias("first_doc_id"),
    )
    return spans.where(F.col("end") - F.col("start") >= min_run).drop("run")


def repeated_spans(docs: DataFrame, min_run: int = MIN_RUN, within: bool = False) -> DataFrame:
    """row, doc_id, start, end, chunks, n_extra and first_doc_id of every repeated span.

    Spans hold neighbouring chunks whose text occurs in more than one row, and what the hashes beyond their ends add;
    with within also what only one row has more than once. n_extra counts the chunks of which an earlier row, or an
    earlier place of the same row, has the first; where it is 0 the span is the first of its kind and stays.
    first_doc_id is the least doc_id that has one of the chunks. A null doc_id counts as -1; null and empty texts have
    no spans, an empty table none at all. Other columns than doc_id and text aren't looked at. row tells
    repeated rows apart. docs is read twice, so it should be a stored table.
    """
    return _spans(_repeated(_keyed(docs), within), min_run).drop("low", "high")


def remove_repeats(docs: DataFrame, min_run: int = MIN_RUN, within: bool = True) -> DataFrame:
    """docs with runs of neighbouring extra chunks, such as reach over min_run characters, cut out of text.

    What goes is in each case chunks of which the first copies, by doc_id and place, aren't extra and so stay: every
    character that goes stands there still. What a repeated passage has before its first and after its last common cut,
    a few tens of characters, stays in all copies. Null and empty texts, and those without such a stretch, stay as they are; columns of any name stay.
    """
    from .pii import cut_out

    held = stored(docs.select(row_key().alias("row"), F.struct("*").alias("doc")), "held")  # rows keep their numbers
    keyed = held.select(
        "row",
        F.coalesce(F.col("doc.doc_id").cast("long"), F.lit(-1)).alias("doc_id"),
        F.col("doc.text").cast("string").alias("text"),
    )
    extra = _spans(_repeated(keyed, within).where("extra = 1"), min_run)
    found = extra.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.col("low").alias("start"), F.col("high").alias("end")))).alias("spans"))
    left = (
        held.join(found, "row", "left")
        .withColumn(
            "cut",
            F.when(F.col("spans").isNotNull(), cut_out(F.col("doc.text"), F.col("spans"), F.lit(""))).otherwise(F.col("doc.text")),
        )
    )
    return left.select(*[F.col("cut").alias(c) if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns])


def op6_chunks(spark, sf_dir: str, min_run: int = MIN_RUN, within: bool = False) -> DataFrame:
    """doc_id, start, end, chunks, n_extra and first_doc_id of every span that several documents share."""
    found = repeated_spans(documents(spark, sf_dir), min_run, within)
    return found.select("doc_id", "start", "end", "chunks", "n_extra", "first_doc_id")
